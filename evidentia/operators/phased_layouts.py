"""Layouts of reports on renovations: what they say before and after the works, by building.

Fixed values: the headings, labels and names that these reports print, the fields they fill, and the limits a value must keep.
"""

from __future__ import annotations

from .phases import Layout, Mark, Part, Reading


def by_phase(before: str, after: str) -> tuple[tuple[str, str], ...]:
    return (("before", before), ("after", after))


UBAT = by_phase("ubat_before", "ubat_after")
CEP = by_phase("cep_before", "cep_after_final")
HEATING = by_phase("heating_vector_before", "heating_vector_after")
WATER = by_phase("ecs_vector_before", "ecs_vector_after")
AIR = by_phase("ventilation_before", "ventilation")

ENERGIES = (("electri", "Électricité"), ("gaz|propane", "Gaz"), ("fioul|fuel", "Fioul"), ("bois|granul|biomasse", "Bois / biomasse"), ("reseau|chauffage urbain|chaleur urbain|\\bcpcu\\b", "Réseau de chaleur urbain"))
VECTORS = (("\\bgaz\\b", "Gaz"), ("\\bfioul\\b", "Fioul"), ("reseau de chaleur|chauffage urbain|\\bcpcu\\b", "Réseau de chaleur urbain"), ("\\bbois\\b|granul|biomasse", "Bois / biomasse"), ("electri|effet joule|pompe a chaleur|\\bpac\\b", "Électricité"))
VENTILATIONS = (("double flux", "VMC double flux"), ("hygro\\w* ?(?:type )?b\\b", "VMC Hygro B"), ("hygro\\w* ?(?:type )?a\\b", "VMC Hygro A"), ("simple flux", "VMC simple flux"))
INSULATIONS = (
    ("fibre de bois|laine de bois", "Fibre de bois"), ("laine de verre|isover|isoconfort|\\bibr\\b|\\bgr ?3[0-9]\\b", "Laine de verre"), ("laine de roche|rockwool|rockmur|ecorock|fibraroc", "Laine de roche"),
    ("polyurethane|\\bpu[ri]?\\b|efigreen|efisol|utherm|enertherm|eurotoit", "PUR"), ("extrude|\\bxps\\b|styrodur", "XPS"), ("polystyr|\\bpse\\b|fibrastyr|fibra ultra", "PSE"),
    ("ouate|cellulose", "Ouate de cellulose"), ("chanvre|coton|\\blin\\b", "Biosourcé chanvre/lin/coton"), ("liege", "Liège"), ("laine minerale|flocage|floque", "Laine minérale"),
)
INSULATION_WORD = "(?:" + "|".join(p for p, _ in INSULATIONS) + ")"
MASONRY = (("beton cellulaire", "Béton cellulaire"), ("parpaing|bloc|agglo", "Bloc béton / parpaing"), ("brique", "Brique terre cuite"), ("poutrelle|hourdis", "Poutrelles-hourdis"), ("beton|dalle", "Béton armé"), ("pierre|moellon|meuliere", "Pierre"), ("bois", "Ossature bois"))
SHADES = (("\\bbso\\b|brise[- ]soleil orientable", "BSO"), ("persienne", "Persiennes"), ("volets? roulant", "Volets roulants"), ("volets? battant", "Volets battants"), ("stores? (?:exterieur|toile)", "Stores extérieurs"), ("stores? interieur", "Stores intérieurs"))
FRAMES = (("\\bpvc\\b", "PVC"), ("\\balu", "Aluminium"), ("\\bbois\\b", "Bois"))
GLAZINGS = (("triple vitrage|\\btv\\b", "Triple vitrage"), ("double vitrage|\\bdv\\b", "Double vitrage"), ("simple vitrage", "Simple vitrage"))
BOILERS = (("compression electrique|pompe a chaleur|systeme thermo", "PAC"), ("condensation", "Chaudière condensation"), ("chaudiere", "Chaudière gaz"), ("effet joule|convecteur|panneau|radiateur", "Chauffage électrique direct"))


def _wall(kind: str, where: str, pattern: str, *, block: str, pick: str = "first", unless: str = "", key: int = 2) -> Reading:
    """An insulated layer: name, conductivity, thickness in cm, resistance."""
    parts = (
        Part(f"{kind}_insulation", "choice", choices=INSULATIONS, confidence=0.93), Part(f"{kind}_insulation_thickness", at=2, factor=10, low=1, high=800, confidence=0.92),
        Part(f"{kind}_insulation_r", at=3, low=0.1, high=15, confidence=0.92),
    )
    return Reading(f"{where}:{kind}", pattern, parts, states=(("block", (block,)),), unless=unless, strip="^.*?(?=\\b0[.,][0-9]{2,3} )", least=3, pick=pick, key=key, by_phase=False)


NOTICE = Layout(
    "rtex_notice",
    ("notice thermique", "rt[- ]?ex\\b|rt existant", "ubat initial cep initial"),
    (
        Mark("building", "^batiment ((?:sur )?[a-z0-9]+) ?: ?$", prefix="Batiment ", clears=("block",)),
        Mark("building", "^immeuble (rue|cour|[a-z0-9]{1,3})\\b", prefix="Batiment "),
        Mark("block", "ubat initial cep initial", "results"),
        Mark("block", "ubat initial cep initial.*ubat projet cep projet", "results+project"),
        Mark("block", "^> ?parois verticales", "walls"), Mark("block", "^> ?toitures", "roofs"), Mark("block", "^> ?planchers bas", "floors"), Mark("block", "^> ?planchers intermediaires", "middle"),
        Mark("block", "^dormant\\b|^ouvertures\\b", "openings"),
    ),
    (
        Reading("rtex_notice:initial", "^[^a-z]*[0-9][^a-z]*(?:(?:w/\\(m².k\\)|kwhep/m²|kgeqco2/m².an)[^a-z]*)*$", (Part("ubat_before", at=1, confidence=0.95), Part("cep_before", at=2, confidence=0.95)), states=(("block", ("results", "results+project",)),), within=5, strip="w/\\(m².k\\)|kwhep/m²|kgeqco2/m².an", least=4, by_phase=False),
        Reading("rtex_notice:project", "^[^a-z]*[0-9][^a-z]*(?:(?:w/\\(m².k\\)|kwhep/m²|kgeqco2/m².an)[^a-z]*)*$", (Part("ubat_after", at=-3, confidence=0.95), Part("cep_after_final", at=-2, confidence=0.95)), states=(("block", ("results+project",)),), within=5, strip="w/\\(m².k\\)|kwhep/m²|kgeqco2/m².an", least=6, by_phase=False),
        _wall("wall", "rtex_notice", f"{INSULATION_WORD}.*\\bexterieur\\b.* 0[.,][0-9]{{2,3}} ", block="walls", pick="max"),
        _wall("roof", "rtex_notice", f"{INSULATION_WORD}.* 0[.,][0-9]{{2,3}} ", block="roofs", pick="max"),
        _wall("floor", "rtex_notice", f"{INSULATION_WORD}.* 0[.,][0-9]{{2,3}} ", block="floors"),
        Reading("rtex_notice:frame", "cadre bois", (Part("window_material", "constant", text="Bois"),), by_phase=False, everywhere=True),
        Reading("rtex_notice:glazing", "double vitrage", (Part("window_glazing", "constant", text="Double vitrage", confidence=0.88),), by_phase=False, everywhere=True),
        Reading("rtex_notice:air", "vmc (?:simple|double) flux", (Part("ventilation", "choice", choices=VENTILATIONS, confidence=0.93),), by_phase=False, everywhere=True),
        Reading("rtex_notice:heating", "(?:chauffage par|assures? par) (?:des )?radiateurs? electriques|radiateurs? electriques? connectes", (Part("heating_mode_after", "constant", text="Chauffage électrique direct", confidence=0.92), Part("heating_vector_after", "constant", text="Électricité", confidence=0.92)), by_phase=False, everywhere=True),
        Reading("rtex_notice:water", "ballons? electriques? a accumulation", (Part("ecs", "constant", text="Ballon électrique"), Part("ecs_vector_after", "constant", text="Électricité")), by_phase=False, everywhere=True),
    ),
)

PHASED = Layout(
    "phased_notice",
    ("notice thermique|etude thermique", "rt ?-? ?ex(?:istant)?\\b|th ?-? ?c ?-? ?e ?-? ?ex\\b", "(?m:^ ?[0-9]+(?:\\.[0-9]+)*\\.? etat (?:existant|initial|actuel|avant travaux)\\b)", "(?m:^ ?[0-9]+(?:\\.[0-9]+)*\\.? etat (?:projete|projet|apres travaux|renove)\\b)"),
    (
        Mark("phase", "^[0-9]+(?:\\.[0-9]+)*\\.? etat (?:existant|initial|actuel|avant travaux)\\b(?!.*\\.{5})", "before", clears=("block", "vector")),
        Mark("phase", "^[0-9]+(?:\\.[0-9]+)*\\.? etat (?:projete|projet|apres travaux|renove)\\b(?!.*\\.{5})", "after", clears=("block", "vector")),
        Mark("block", "^tableau [0-9]+", "table"), Mark("block", "descriptif des parois", "walls"), Mark("block", "descriptif des menuiseries", "windows"),
        Mark("block", "chauffage ?[-–] ?generation|generation (?:de )?chauffage|production de chauffage", "heating", clears=("vector",)),
        Mark("block", "^(?!tableau).*(?:occultations?|protections? solaires)", "shades"),
        Mark("wall", "\\b(?:murs?|pignon)\\b", "wall"), Mark("wall", "\\b(?:couverture|toiture|terrasse|rampants?|plancher haut|combles?)\\b", "roof"), Mark("wall", "\\bplancher bas\\b", "floor"),
        *[Mark("vector", f"^(?:combustible|energie|vecteur) ?:? ?.*(?:{p})", v) for p, v in reversed(VECTORS)],
    ),
    (
        Reading("phased:cep", "^cep\\b(?: (?:projet|initial|existant|total))? ?(?:\\( ?kwh[^\\n]*?\\) ?|[:=] ?)[0-9]+(?:[.,][0-9]+)? ?(?:kwh\\S*)?$", (Part(CEP, low=0.01, high=1499.99, confidence=0.95), Part((("after", "cep"),), low=0.01, high=1499.99)), states=(("phase", ("before", "after",)),), strip="\\( ?kwh[^\\n]*?\\)"),
        Reading("phased:dpe", "^.{0,80}?[0-9]+(?:[.,][0-9]+)? ?kwh ?ep/m.{0,12}?an\\b.{0,80}?[0-9]+(?:[.,][0-9]+)? ?kg ?eq ?co2.{0,120}?etiquettes? (?:de (?:niveau|classe) )?([a-g])\\b(?: et ([a-g])\\b)?", (Part(by_phase("dpe_energy_before", "dpe_energy_after"), "text", at=1, confidence=0.92), Part(by_phase("dpe_ges_before", "dpe_ges_after"), "text", at=2, confidence=0.92)), states=(("phase", ("before", "after",)),), over=3),
        Reading("phased:vector", "^(?:combustible|energie|vecteur) ?:? ?\\S", (Part(HEATING, "choice", choices=VECTORS, confidence=0.93),), states=(("phase", ("before", "after",)), ("block", ("heating",))), within=10),
        Reading("phased:water", "^mode ?:? ?.*\\becs\\b", (Part(WATER, "state", text="vector", confidence=0.92),), states=(("phase", ("before", "after",)), ("block", ("heating",))), within=10),
        Reading("phased:mode", "^type ?:? ?\\S", (Part((("after", "heating_mode_after"),), "choice", choices=BOILERS),), states=(("phase", ("after",)), ("block", ("heating",))), within=10),
        Reading("phased:air", "ventilation (?:simple|double) flux|vmc|hygro", (Part(AIR, "choice", choices=VENTILATIONS, confidence=0.92),), states=(("phase", ("before", "after",)),)),
        *[
            Reading(f"phased:{kind}", f"{INSULATION_WORD}[^0-9]{{0,20}}0[.,][0-9]{{2,3}} ", (Part((("after", f"{kind}_insulation"),), "choice", choices=INSULATIONS, confidence=0.93), Part((("after", f"{kind}_insulation_thickness"),), at=2, factor=10, low=1, high=799, confidence=0.92), Part((("after", f"{kind}_insulation_r"),), at=3, low=0.4, high=15, confidence=0.92)), states=(("phase", ("after",)), ("block", ("walls",)), ("wall", (kind,))), within=40, strip="^.*?(?=\\b0[.,][0-9]{2,3} )", least=2)
            for kind in ("wall", "roof", "floor")
        ],
        Reading("phased:structure", "\\bmurs?\\b", (Part("wall_structure", "choice", choices=MASONRY),), states=(("block", ("walls",)),), by_phase=False),
        Reading("phased:frame", "\\b(?:pvc|alu\\w*|bois)\\b", (Part((("after", "window_material"),), "choice", choices=FRAMES, confidence=0.92),), states=(("phase", ("after",)), ("block", ("windows",))), within=40),
        Reading("phased:glazing", "(?:simple|double|triple) vitrage", (Part((("after", "window_glazing"),), "choice", choices=GLAZINGS),), states=(("phase", ("after",)), ("block", ("windows",))), within=40),
        Reading("phased:shades", "bso|persienne|volet|store", (Part((("after", "window_shading"),), "choice", choices=SHADES),), states=(("phase", ("after",)), ("block", ("shades",))), within=8),
        Reading("phased:homes", "(?:compte|comprenant|de|creation de) [0-9]{1,4} logements\\b", (Part("housing_count", confidence=0.92),), unless="pour [0-9]+ logements", strip="^.*?(?=[0-9]+ logements)", by_phase=False, everywhere=True),
    ),
    never="rset\\b|fichier standardise",
)

SYNTHESIS = Layout(
    "climawin_synthesis",
    ("climawin", "synthese d.etude rtex", "cepinit"),
    (
        Mark("building", "^batiment ?: ?(?:bat(?:iment)?\\.? )?(.+?) ?(?:-? ?(?:apres|avant) travaux\\b.*?|-? ?(?:solution|option|variante|scenario)\\b.*?)?-? ?(?:synthese d.etude rtex|informations|generalites)", prefix="Batiment "),
        Mark("block", "ubatinit.*ubatproj", "ubat"), Mark("block", "cepinit.*cepproj", "cep"), Mark("block", "^comparatif des consommations en energie primaire", "uses"), Mark("block", "ticinitial.*ticprojet.*ticref", "tic"),
        Mark("block", "^detail des consommations", "detail"), Mark("block", "^auxiliaires\\b", "other"),
    ),
    (
        Reading("climawin:ubat", "[0-9]", tuple(Part(f, at=k, low=1e-6, high=4.999999, confidence=0.95) for k, f in ((1, "ubat_before"), (2, "ubat_after"), (3, "ubat_ref"))), states=(("block", ("ubat",)),), within=3, least=3, by_phase=False),
        Reading("climawin:cep", "[0-9]", (Part("cep_before", at=-5, confidence=0.95), Part("cep_after_final", at=-4, confidence=0.95), Part("cep", at=-4, confidence=0.92), Part("cep_max", at=-3, confidence=0.93), Part("cep_gain", "gain", at=-4, of=-3, confidence=0.93)), states=(("block", ("cep",)),), within=3, least=5, by_phase=False),
        Reading("climawin:uses", "^projet [0-9]", (Part("cep_cooling", at=2, confidence=0.92), Part("cep_aux_vent", at=4, confidence=0.92), Part("cep_aux_dist", at=5, confidence=0.92), Part("cep_lighting", at=6, confidence=0.92)), states=(("block", ("uses",)),), within=4, least=7, by_phase=False),
        Reading("climawin:tic", "[0-9]", (Part("tic", at=-2, confidence=0.95), Part("tic_ref", at=-1, confidence=0.95)), states=(("block", ("tic",)),), within=3, least=3, by_phase=False),
        *[
            Reading(f"climawin:{f}", "^(?:electricite|gaz|fioul|bois|reseau) ", (Part(f, "choice", choices=ENERGIES, confidence=0.92),), states=(("block", ("detail",)),), within=15, least=8, pick="share", key=k, by_phase=False)
            for k, f in ((1, "heating_vector_before"), (2, "heating_vector_after"), (7, "ecs_vector_before"), (8, "ecs_vector_after"))
        ],
        Reading("climawin:frame", "^[0-9]+(?:[.,][0-9]+)? fenetre .*\\b(?:pvc|alu\\w*|bois)\\b", (Part("window_material", "choice", choices=FRAMES, confidence=0.92),), by_phase=False),
        Reading("climawin:shades", "^[0-9]+(?:[.,][0-9]+)? fenetre .*volet", (Part("window_shading", "constant", text="Volet roulant", confidence=0.88),), by_phase=False),
    ),
)

_AFTER_M2 = "^.*?m²\\)"
FIXED = Layout(
    "u48win",
    ("catalogue des parois de l.etat (?:initial|projet)", "resultats de l.etat (?:initial|projet)|batiment n° ?[0-9]+ ?:", "thcex|shon/srt|th-c-e ?ex|u48win"),
    (
        Mark("phase", "^resultats de l.etat initial$", "before", clears=("use", "entry")), Mark("phase", "^resultats de l.etat projet$", "after", clears=("use", "entry")), Mark("block", "^resultats de l.etat (?:initial|projet)$", "results"),
        Mark("building", "^batiment n° ?[0-9]+ ?: ?(.+)$", prefix="Batiment "),
        Mark("use", "^(chauffage|refroidissement|ecs|eclairage|auxiliaires|autres usages|total)$"),
        Mark("block", "^resume de l.etude$", "summary", clears=("phase", "use")),
        Mark("block", "^catalogue des parois de l.etat projet|^modification n° ?[0-9]+ ?: ?(?:catalogue|details) des parois", "walls", clears=("phase", "use", "wall")),
        Mark("block", "^catalogue des parois de l.etat initial", "old walls", clears=("phase", "use", "wall")),
        Mark("block", "^(?:modification n° ?[0-9]+ ?: ?)?(?:catalogue des vitrages|catalogue des ponts|details des ponts)", "windows", clears=("wall",)),
        Mark("wall", "^type ?: ?(?:mur exterieur|mur sur)", "wall"), Mark("wall", "^type ?: ?mur (?:interieur|mitoyen)", "inner"), Mark("wall", "^type ?: ?(?:plafond|toiture|terrasse)", "roof"), Mark("wall", "^type ?: ?plancher", "floor"),
        Mark("phase", "^etat initial$", "before", clears=("block", "use")), Mark("phase", "^etat (?:pressenti|projet)$|^variante [0-9]+ ?: ?projet$", "after", clears=("block", "use")), Mark("entry", "^etat (?:initial|pressenti|projet)$|^variante [0-9]+ ?: ?projet$", "yes"),
        Mark("building", "^batiment ?: ?(.+)$", prefix="Batiment "),
    ),
    (
        Reading("u48win:ubat", "^ubat du batiment [0-9]", (Part(UBAT, confidence=0.95),), states=(("block", ("results",)),), within=40),
        Reading("u48win:cep", "^coefficient cep\\b.*[0-9]", (Part(CEP, confidence=0.96), Part((("after", "cep"),), confidence=0.93)), states=(("block", ("results",)),), within=40, strip=_AFTER_M2),
        Reading("u48win:heating", "^[a-z][^0-9]* [0-9]", (Part(HEATING, "choice", choices=ENERGIES, confidence=0.93),), states=(("block", ("results",)), ("use", ("chauffage",))), unless="^(?:total|vent)\\b", pick="max"),
        Reading("u48win:water", "^[a-z][^0-9]* [0-9]", (Part(WATER, "choice", choices=ENERGIES, confidence=0.93),), states=(("block", ("results",)), ("use", ("ecs",))), unless="^(?:total|vent)\\b", pick="max"),
        *[
            Reading(f"u48win:{f}", "^total energie primaire", (Part((("after", f),), confidence=c),), states=(("block", ("results",)), ("use", (u,))), strip=_AFTER_M2)
            for u, f, c in (("eclairage", "cep_lighting", 0.93), ("auxiliaires", "cep_aux_dist", 0.9), ("refroidissement", "cep_cooling", 0.9))
        ],
        Reading("u48win:fans", "^vent ?- ?total energie primaire", (Part((("after", "cep_aux_vent"),), confidence=0.93),), states=(("block", ("results",)),), strip=_AFTER_M2),
        Reading("u48win:tic", "\\bce[12] [0-9]+,[0-9]+ [0-9]+,[0-9]+$|^tic ?= ?[0-9,]+ ?- ?ticref ?= ?[0-9,]+", (Part("tic", at=-2, confidence=0.94), Part("tic_ref", at=-1, confidence=0.94)), states=(("block", ("summary",)),), by_phase=False),
        Reading("u48win:limit", "^c [0-9,]+ [0-9,]+ -?[0-9,]+", (Part("cep_max", at=2, confidence=0.93), Part("cep_gain", at=3, confidence=0.93)), states=(("block", ("summary",)),), by_phase=False),
        *[
            Reading(f"u48win:{kind}", f"{INSULATION_WORD}.* [0-9]{{1,3}},[0-9] (?:[0-9],[0-9]{{3}} )?[0-9]{{1,2}},[0-9]{{2,3}} [0-9]{{1,3}} ", (Part(f"{kind}_insulation", "choice", choices=INSULATIONS, confidence=0.92), Part(f"{kind}_insulation_thickness", at=1, factor=10, confidence=0.92), Part(f"{kind}_insulation_r", at=-2, confidence=0.93)), states=(("block", ("walls",)), ("wall", (kind,))), strip="^.*?(?=[0-9]{1,3},[0-9] )|(?<=,[0-9]{2} [0-9]{1,3}|,[0-9]{3} [0-9]{1,3}) .*$", least=3, pick="max", key=-2, by_phase=False, everywhere=True)
            for kind in ("wall", "roof", "floor")
        ],
        Reading("u48win:year", "^annee de construction\\b.*[0-9]{4}$", (Part("construction_year", low=1500, high=2100),), states=(("entry", ("yes",)),), unless="avant| et ", by_phase=False),
        Reading("u48win:old", "^annee de construction\\b.*avant 1948", (Part("built_before_1948", "constant", text="Oui", confidence=0.95),), states=(("entry", ("yes",)),), by_phase=False),
        Reading("u48win:air", "^(?:systeme|type) de ventilation\\b", (Part(AIR, "choice", choices=VENTILATIONS, confidence=0.92),), states=(("entry", ("yes",)),)),
        Reading("u48win:homes", "^nombre de logements\\b.*[0-9]", (Part((("after", "housing_count"),), confidence=0.96),), states=(("entry", ("yes",)),)),
        Reading("u48win:department", "^numero de departement ?: ?([0-9]{2,3}|2[ab])\\b", (Part("department", "text", at=1, confidence=0.95),), by_phase=False, everywhere=True),
        Reading("u48win:area", "^surface utile ?: ?[0-9 ,]+m²", (Part("shab", confidence=0.92),), by_phase=False),
    ),
)

SHEET = Layout(
    "rtex_sheet",
    ("coefficient cep", "ubat ?\\(hiver\\)", "shon renovee|initial ?\\(a\\)|projet ?\\(b\\)"),
    (
        Mark("building", "^(?:caracteristiques generales du )?batiment ?: ?(.+)$", prefix="Batiment ", clears=("block",)),
        Mark("block", "tic ?\\(a\\) ticref ?\\(b\\)", "tic"), Mark("block", "^art\\b", "other"), Mark("block", "^type d.energie", "energy"),
    ),
    (
        Reading("rtex_sheet:area", "^surface utile ou habitable ?\\(m2\\) ?[0-9.,]+$", (Part("shab", confidence=0.97),), strip="^.*\\(m2\\)", by_phase=False),
        Reading("rtex_sheet:year", "^annee de la construction [0-9]{4}$", (Part("construction_year", low=1500, high=2100, confidence=0.96),), by_phase=False),
        Reading("rtex_sheet:homes", "^nombre de logements [0-9]+$", (Part("housing_count", confidence=0.96),), by_phase=False),
        Reading("rtex_sheet:cep", "^coefficient cep [0-9-]", (Part("cep_before", at=1, confidence=0.97), Part("cep_after_final", at=2, confidence=0.97), Part("cep", at=2, confidence=0.92), Part("cep_max", at=5, confidence=0.93), Part("cep_gain", "gain", at=2, of=5, confidence=0.92)), unless="kwh-?ep/m2", strip="^coefficient cep", cells=True, by_phase=False),
        Reading("rtex_sheet:ubat", "^ubat ?\\(hiver\\)", (Part("ubat_before", at=1, confidence=0.97), Part("ubat_after", at=2, confidence=0.97)), strip="^ubat ?\\(hiver\\)", cells=True, by_phase=False),
        Reading("rtex_sheet:tic", "° ?c [0-9]+[.,][0-9]+ [0-9]+[.,][0-9]+(?: -?[0-9]+[.,][0-9]+)?$", (Part("tic", at=1, confidence=0.96), Part("tic_ref", at=2, confidence=0.96)), states=(("block", ("tic",)),), within=11, strip="^.*° ?c", pick="max", by_phase=False),
        Reading("rtex_sheet:energy", "^(?:electrique|gaz|fioul|bois|reseau).* oui (?:oui|non)$", (Part("heating_vector_before", "choice", choices=ENERGIES),), states=(("block", ("energy",)),), within=11, by_phase=False),
        Reading("rtex_sheet:energy after", "^(?:electrique|gaz|fioul|bois|reseau).* (?:oui|non) oui$", (Part("heating_vector_after", "choice", choices=ENERGIES),), states=(("block", ("energy",)),), within=11, by_phase=False),
    ),
    never="ubat initial cep initial",
)

STRUCTURED = Layout(
    "structured_renovation",
    ("numero de departement", "type de batiment ?:", "(?m:^ ?etat (?:initial|apres travaux|projet))", "coefficient ubat ?="),
    (
        Mark("phase", "^etat initial$", "before"), Mark("phase", "^etat (?:apres travaux|projet)$", "after"), Mark("building", "^batiment n[°o]? ?([0-9]+)", prefix="Batiment "),
        Mark("wall", "murs? exterieurs?", "wall"), Mark("wall", "type de plafond", "roof"), Mark("wall", "type de plancher", "floor"),
    ),
    (
        Reading("structured:department", "numero de departement ?: ?([0-9]{1,3})", (Part("department", "text", at=1, confidence=0.999),), by_phase=False, everywhere=True),
        Reading("structured:kind", "type de batiment ?: ?.*(?:logements? collectifs?|maisons? individuelles?|logements? individuels?)", (Part("work_type", "choice", choices=(("collectif", "Logement collectif"), ("individuel", "Maison individuelle")), confidence=0.995),), by_phase=False, everywhere=True),
        Reading("structured:area", "surface habitable ?: ?[0-9]", (Part("shab", low=20, confidence=0.999),), by_phase=False),
        Reading("structured:ubat", "coefficient ubat ?= ?-?[0-9]", (Part(UBAT, confidence=0.99),), states=(("phase", ("before", "after",)),), strip="^.*?ubat ?="),
        Reading("structured:water", "type d.ecs ?: ?\\S", (Part(WATER, "choice", choices=VECTORS, confidence=0.99),), states=(("phase", ("before", "after",)),)),
        Reading("structured:heat", "type d.energie pour la production de chaud ?: ?\\S", (Part(HEATING, "choice", choices=VECTORS, confidence=0.99),), states=(("phase", ("before", "after",)),)),
        Reading("structured:air", "systeme de ventilation ?: ?\\S", (Part(AIR, "choice", choices=VENTILATIONS, confidence=0.99),), states=(("phase", ("before", "after",)),)),
        Reading("structured:boiler", "type de generateur ?: ?\\S", (Part((("after", "heating_mode_after"),), "choice", choices=BOILERS, confidence=0.98),), states=(("phase", ("after",)),)),
        Reading("structured:cold", "systeme de refroidissement ?: ?sans", (Part((("after", "cooling"),), "constant", text="Sans système de refroidissement", confidence=0.99),), states=(("phase", ("after",)),)),
    ),
)

LAYOUTS = (FIXED, NOTICE, SYNTHESIS, PHASED, SHEET, STRUCTURED)
