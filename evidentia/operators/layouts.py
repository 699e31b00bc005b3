"""Reports of known layouts: buildings and their parts of a text, dispatch to a pack of rules, facts by building.

A text is cut at the headings of its buildings (a line's building is the last heading at or before it, lines before the first go to the first), the document gets the
first pack whose signature it bears, else the packs of its families, else the general ones, and all rules run in one pass over the parts. Patterns are matched on lines without
accents and with single spaces. Everything is an expression on the document's row: no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions.numbers import fr_number
from ..functions.text import _MARKS, _PLAIN, _SOURCE, _TARGET, fold
from .extract import Rule, facts

# The families of each document type.
FAMILIES = {"RSET_RE2020": ("rset",), "RSEE_RE2020": ("rset", "carbone"), "RT2012": ("rt2012",), "RT_EXISTING": ("thcex",), "THERMAL": ("thcex",), "RSENV": ("carbone",), "CARBON": ("carbone",), "CCTP": ("cctp",), "DPGF": ("dpgf",), "DPE": ("dpe",), "FINANCIAL": ("financier",)}
# Fixed value: what shows that a study has carbon results.
CARBON_SIGNS = "ic (?:composants?|construction|energie)\\b|contributeur (?:composant|energie)|indicateur co ?2? dynamique|(?m:^ ?0?1 ?[-–] ?vrd\\b)|total lot ?:"
NUMBER = "(-?[0-9][0-9 ]*(?:[.,][0-9]+)?)"
# What a heading of a building must not be.
_NO_NAME = "(?i)^(?:de la valeur du batiment|(?:non )?conforme|etiquettes?(?: dpe)?|total|(?:extremement )?(?:peu )?performant|s|srt|sref|zones?|usage|surface|ref|m2|projet)$"


def plain(text: Column) -> Column:
    """A text without accents, with plain quotes and single spaces within its lines."""
    t = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit("fi")), _SOURCE + _MARKS, _TARGET + _PLAIN)
    # Single spaces stay as they are, so that only what changes is matched.
    return F.regexp_replace(F.replace(t, F.lit("\r"), F.lit("")), "[ \\t]{2,}|\\t", " ")


def expected_buildings(text: Column) -> Column:
    """The number of buildings a text announces; null for none."""
    return _expected(plain(text))


def _expected(text: Column) -> Column:
    return F.regexp_extract(text, "(?i)nombre de batiments?(?: ?/ ?zones?)? du projet ?[:-]? ?([0-9]+)", 1).try_cast("int")


_HEADING = "^ ?(?:[0-9]+(?:\\.[0-9]+)*\\.? )?(?:[Ii]dentifiant )?[Bb](?:[Aa][Tt]\\.?|[Aa][Tt][Ii][Mm][Ee][Nn][Tt])(?![A-Za-z]) ?([:-]?) ?\"?([^\"].{0,100}?)\"? ?$"


def headings(lines: Column) -> Column:
    """(at, name) of the lines that announce a building ('Bâtiment : A', '2.1 BATIMENT B2', a row of a table that begins with one), with its display name; not of pieces of sentences.

    Each step is a transform of its own over the few lines that look like a heading, so nothing in it is evaluated twice.
    """
    some = F.filter(F.transform(lines, lambda t, i: F.struct(i.alias("at"), t.alias("t"))), lambda x: x["t"].rlike(_HEADING))
    read = F.transform(some, lambda x: F.struct(x["at"].alias("at"), x["t"].alias("t"), (F.regexp_extract(x["t"], _HEADING, 1) != "").alias("told"), F.trim(F.regexp_extract(x["t"], _HEADING, 2)).alias("raw")))
    split = F.transform(F.filter(read, lambda x: (x["raw"] != "") & ~x["raw"].rlike(_NO_NAME)), lambda x: F.struct(x["at"].alias("at"), x["t"].alias("t"), x["told"].alias("told"), x["raw"].alias("raw"), F.split(x["raw"], " ").alias("words")))

    def named(x: Column) -> Column:
        first, rest = F.element_at(x["words"], 1), F.slice(x["words"], 2, F.greatest(F.size(x["words"]), F.lit(1)))
        short = first.rlike("^(?i:[A-Z]{1,3}[0-9]{0,3}|[0-9]{1,3}|[A-Z][0-9]?/[A-Z][0-9]?)$")
        row = F.exists(rest, lambda t: t.rlike("[0-9][.,][0-9]|%|²|(?i)m3 ?/ ?h|kwh")) | (F.size(F.filter(rest, lambda t: t.rlike("^-?[0-9]+(?:[.,][0-9]+)?$"))) >= 2)
        return F.struct(x["at"].alias("at"), x["t"].alias("t"), x["told"].alias("told"), x["raw"].alias("raw"), names.repair(names.canonical(F.when(row, F.when(short, first)).otherwise(x["raw"]))).alias("shown"))

    def good(x: Column) -> Column:
        sentence = x["t"].rlike("^ ?b") & ~x["raw"].rlike("^[A-Z0-9][A-Z0-9._/-]{0,4}$") | x["raw"].rlike("[.;!?] ?$") & x["raw"].contains(" ")
        list_of = x["raw"].rlike("(?:^| )[A-Z0-9](?: [A-Z0-9]){2,}(?: |$)")
        return ~list_of & ~names.is_ghost(x["shown"]) & (x["told"] | ~sentence & ~names.is_garbage(x["shown"]))

    shown = F.filter(F.transform(split, named), lambda x: x["shown"].isNotNull() & (x["shown"] != names.UNIQUE))
    return F.transform(F.filter(shown, good), lambda x: F.struct(x["at"].alias("at"), x["shown"].alias("name")))


def heading(line: Column) -> Column:
    """The display name of the building a line announces; null for other lines."""
    return F.get(headings(F.array(line)), F.lit(0))["name"]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once a row: behind an explode; as plain columns they would be put into each place that uses them."""
    return df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_o")).select(*df.columns, "_o.*")


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cleaned: bool = False) -> DataFrame:
    """(doc_id, part, building, first_line, text, keep): a document cut at the headings of its buildings; one part named 'Bâtiment unique' where it has none. Null texts are empty; cleaned texts went through plain already."""
    text = F.col("_text") if cleaned else plain(F.col("_text"))
    d = _once(docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text")), _l=F.split(text, "\n")).drop("_text")
    d = _once(d, _m=headings(F.col("_l")))
    first = F.coalesce(F.get("_m", F.lit(0))["name"], F.lit(names.UNIQUE))
    d = _once(d, _c=F.when(F.coalesce(F.get("_m", F.lit(0))["at"], F.lit(1)) == 0, F.col("_m")).otherwise(F.concat(F.array(F.struct(F.lit(0).alias("at"), first.alias("name"))), F.col("_m")))).drop("_m")
    end = lambda i: F.coalesce(F.get("_c", i + 1)["at"], F.size("_l"))
    cut = F.transform("_c", lambda m, i: F.struct(m["name"].alias("building"), m["at"].alias("first_line"), F.array_join(F.slice("_l", m["at"] + 1, F.greatest(end(i) - m["at"], F.lit(0))), "\n").alias("text")))
    return d.select("doc_id", *keep, F.posexplode(cut).alias("part", "_p")).select("doc_id", "part", "_p.*", *keep)


def detect_buildings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, building, first_line, complete): the buildings that a document's headings name, and whether they are as many as it announces; the single one where none is named."""
    d = _once(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_whole")), _plain=plain(F.col("_whole"))).drop("_whole")
    # A document's parts are dealt by its id once, for all that follows.
    p = parts(_once(d, _n=_expected(F.col("_plain"))), "doc_id", "_plain", ("_n",), cleaned=True).select("doc_id", "building", "_n", "first_line").repartition("doc_id")
    per = p.groupBy("doc_id", "building", "_n").agg(F.min("first_line").alias("first_line"))
    named = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return per.withColumn("_k", named).select("doc_id", "building", "first_line", (F.coalesce("_n", "_k") == F.col("_k")).alias("complete"))


def resultless(facts_: DataFrame, results: list[str], manual: DataFrame | None = None) -> DataFrame:
    """Facts (op, building, field) without those of buildings that have no result field, where another building of the operation has some; buildings named by hand (op, building) stay."""
    has = facts_.filter(F.col("field").isin(*results)).select("op", "building").distinct()
    good = has if manual is None else has.unionByName(manual.select("op", "building")).distinct()
    return facts_.join(good, ["op", "building"], "left_semi").unionByName(facts_.join(has.select("op").distinct(), "op", "left_anti"))


@dataclass(frozen=True)
class Signature:
    """What the folded text of a document must hold: all, one of any, and none of none; weight for the classifier."""

    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    doc_type: str | None = None
    weight: float = 8.0

    def holds(self, norm: Column) -> Column:
        test = F.lit(True)
        for w in self.all:
            test = test & norm.contains(w)
        some = F.lit(not self.any)
        for w in self.any:
            some = some | norm.contains(w)
        for w in self.none:
            test = test & ~norm.contains(w)
        return test & some


def signature_scores(norm: Column, signatures: list[Signature]) -> Column:
    """A map of document type to the added weights of the signatures a text bears."""
    types = sorted({s.doc_type for s in signatures if s.doc_type})
    each = [F.struct(F.lit(t).alias("k"), sum((F.when(s.holds(norm), s.weight).otherwise(0.0) for s in signatures if s.doc_type == t), F.lit(0.0)).alias("v")) for t in types]
    return F.map_from_entries(F.filter(F.array(*each), lambda e: e["v"] > 0))


def rewrite(text: Column, rules: list[tuple[str, str, str | None]]) -> Column:
    """A text after ordered replacements (pattern, replacement, when): a rule applies only where its condition is found, null for always."""
    for find, by, when in rules:
        done = F.regexp_replace(text, find, by)
        text = F.when(text.rlike(when), done).otherwise(text) if when else done
    return text


# Patterns of the packs: (field, pattern on plain lines, kind). Group 1 is the value. Labels are those printed by the programs that write the reports.
_V = f"[^0-9\\n]{{0,40}}?(?<![A-Za-z]){NUMBER}"
_ROW2 = f"[^0-9\\n]{{0,20}}?{NUMBER} {NUMBER}".replace("[0-9 ]*", "[0-9]*")
_TWO = "[^0-9\\n]{0,20}?(?:-?[0-9]+(?:[.,][0-9]+)?) (-?[0-9]+(?:[.,][0-9]+)?)"
_ONE = "[^0-9\\n]{0,20}?(-?[0-9]+(?:[.,][0-9]+)?) (?:-?[0-9]+(?:[.,][0-9]+)?)"
_THREE = "[^0-9\\n]{0,20}?(?:-?[0-9]+(?:[.,][0-9]+)? ){2}(-?[0-9]+(?:[.,][0-9]+)?)"
_KG = "[^0-9\\n]{0,25}?(?:kg ?(?:eq\\.? ?)?co2 ?(?:e|eq)? ?/ ?m(?:2|²))?[^0-9\\n]{0,12}?(?<![A-Za-z])" + NUMBER

SIGNATURES: dict[str, Signature] = {
    "booklet": Signature(all=("livret d'operation", "de contrat")), "dpe_recap": Signature(all=("lgt", "etiquette"), any=("init", "reno")), "biosourced": Signature(any=("label batiment biosource",)),
    "heat_loss": Signature(all=("departement :",), any=("en 12831", "deperditions")), "summer_comfort": Signature(any=("simulation thermique dynamique", "rapport de simulation dynamique")),
    "services_summary": Signature(all=("points", "synthese des prestations")), "acv_report": Signature(all=("donnees generales batiment", "ic construction")), "financial": Signature(all=("questionnaire financier",)),
}
PACKS: dict[str, list[tuple[str, str, str]]] = {
    "rset": [
        ("bbio", "^coefficient bbio\\b" + _ONE, "number"), ("bbio_max", "^coefficient bbio\\b" + _TWO, "number"), ("bbio_gain", "^coefficient bbio\\b" + _THREE, "number"), ("cep", "^coefficient cep\\b(?! ?,? ?nr)" + _ONE, "number"),
        ("cep_max", "^coefficient cep\\b(?! ?,? ?nr)" + _TWO, "number"), ("cepnr", "^coefficient cep ?,? ?nr\\b" + _ONE, "number"), ("cepnr_max", "^coefficient cep ?,? ?nr\\b" + _TWO, "number"), ("dh", "^(?:dh|degres[- ]heures)\\b(?! ?max)" + _V, "number"),
        ("dh_max", "^(?:dh|degres[- ]heures) ?max\\b" + _V, "number"), ("shab", "^(?:surface habitable|shab)\\b" + _V, "number"), ("housing_count", "^nombre (?:total )?de logements? ?[:=]? ?([0-9]+)", "number"),
    ],
    "rt2012": [
        ("bbio", "^coefficient bbio\\b" + _ONE, "number"), ("bbio_max", "^coefficient bbio\\b" + _TWO, "number"), ("bbio_gain", "^coefficient bbio\\b" + _THREE, "number"), ("cep", "^coefficient cep\\b" + _ONE, "number"), ("cep_max", "^coefficient cep\\b" + _TWO, "number"),
        ("cep_gain", "^coefficient cep\\b" + _THREE, "number"), ("tic", "([0-9]{2}(?:[.,][0-9]+)?) [0-9]{2}(?:[.,][0-9]+)? -?[0-9]+(?:[.,][0-9]+)? conforme", "number"), ("tic_ref", "[0-9]{2}(?:[.,][0-9]+)? ([0-9]{2}(?:[.,][0-9]+)?) -?[0-9]+(?:[.,][0-9]+)? conforme", "number"),
    ],
    "carbone": [
        ("ic_components", "^ic composants?\\b(?![^|\\n]{0,40}\\blot\\b)" + _KG, "number"), ("ic_site", "^ic chantier\\b" + _KG, "number"), ("ic_energy", "^ic energie\\b(?! ?max)(?![^|\\n]{0,40}annualis)" + _KG, "number"), ("ic_energy_max", "^ic energie max\\b(?! 2028)" + _KG, "number"),
        ("ic_construction", "^ic construction\\b(?! ?max)" + _KG, "number"), ("ic_construction_max", "^ic construction max\\b(?! 2028)" + _KG, "number"), ("stock_c_per_m2", "stock(?:age)?(?: carbone)?(?: stock)? ?,? ?c?\\b[^|\\n]{0,40}?([-+]?[0-9]+(?:[.,][0-9]+)?) ?kg ?c ?/ ?m(?:2|²)", "number"),
        *[(f"ic_lot_{n}", f"ic composants? lot 0?{n} ?[:=|-] ?([-+]?[0-9]+(?:[.,][0-9]+)?)", "number") for n in range(1, 14)],
        ("ic_energy_heating", "ic energie[^|0-9\\n]{0,45}chauffage" + _KG, "number"), ("ic_energy_ecs", "ic energie[^|0-9\\n]{0,45}(?:ecs|eau chaude)" + _KG, "number"), ("ic_energy_cooling", "ic energie[^|0-9\\n]{0,45}(?:refroid\\w*|froid)" + _KG, "number"),
        ("ic_energy_aux_vent", "ic energie[^|0-9\\n]{0,60}auxiliaires?[^|0-9\\n]{0,25}ventil\\w*" + _KG, "number"), ("ic_energy_aux_dist", "ic energie[^|0-9\\n]{0,60}auxiliaires?[^|0-9\\n]{0,25}distribution" + _KG, "number"),
    ],
    "cep_breakdown": [
        ("cep_cooling", "\\bcep\\b[^|0-9\\n]{0,45}(?:refroidissement|froid|climatisation)" + _V, "number"), ("cep_lighting", "\\bcep\\b[^|0-9\\n]{0,45}eclairage" + _V, "number"), ("cep_aux_vent", "\\bcep\\b[^|0-9\\n]{0,60}ventilation" + _V, "number"),
        ("cep_aux_dist", "\\bcep\\b[^|0-9\\n]{0,60}distribution" + _V, "number"), ("cep_mobility", "\\bcep\\b[^|0-9\\n]{0,60}(?:deplacements?|ascenseurs?)" + _V, "number"), ("cep_electricity", "\\bcep\\b[^|0-9\\n]{0,45}electricite" + _V, "number"),
        ("cep_gas", "\\bcep\\b[^|0-9\\n]{0,45}\\bgaz\\b" + _V, "number"), ("cep_district", "\\bcep\\b[^|0-9\\n]{0,55}(?:reseau de chaleur|rcu)" + _V, "number"), ("cep_biomass", "\\bcep\\b[^|0-9\\n]{0,55}(?:bois|biomasse|granules)" + _V, "number"),
    ],
    "thcex": [
        ("ubat_before", "^ubat (?:initial|avant|existant)\\b" + _V, "number"), ("ubat_after", "^ubat (?:projet|apres|final)\\b" + _V, "number"), ("ubat_ref", "^ubat ref(?:erence)?\\b" + _V, "number"), ("cep_before", "^cep (?:initial|avant|existant)\\b" + _V, "number"),
        ("cep_after_final", "^cep (?:final|projet|apres)\\b" + _V, "number"), ("tic", "^tic ?\\|? ?([0-9]{2}[.,][0-9]{1,2}) ?°? ?c ?\\|? ?[0-9]{2}[.,][0-9]{1,2} ?°? ?c\\b", "number"), ("tic_ref", "^tic ?\\|? ?[0-9]{2}[.,][0-9]{1,2} ?°? ?c ?\\|? ?([0-9]{2}[.,][0-9]{1,2}) ?°? ?c\\b", "number"),
        *[(f"dpe_{k}_{p}", f"^etat (?:{w}) [0-9]+(?:[.,][0-9]+)? [0-9][.,][0-9]+ {g} ?$", "text") for k, g in (("energy", "([a-gA-G]) [a-gA-G]"), ("ges", "[a-gA-G] ([a-gA-G])")) for p, w in (("before", "existant|initial|actuel"), ("after", "projet|renove|final"))],
    ],
    "programme": [
        ("housing_count", "(?:(?:nombre|nb\\.?|nombre total) (?:de )?logements? ?[:=-]? ?|construction de |programme (?:de|comprenant) |\\b(?:comprend|comprenant|comporte) )([0-9]{1,4})(?= logements?|\\b(?! logements?)(?<=logements? ?[:=-] ?[0-9]{1,4}))", "number"),
        ("construction_year", "(?:annee de construction|construit en|construction en|acheve en|annee d'achevement)[^0-9\\n]{0,20}((?:17|18|19|20)[0-9]{2})(?! ?(?:et|a|-) ?(?:17|18|19|20)[0-9]{2})", "number"),
    ],
    "envelope": [
        *[(f"{t}_insulation_thickness", f"^(?:{w})[^\\n]{{0,80}}?([0-9]{{2,3}}) ?mm\\b", "number") for t, w in (("wall", "murs?|facades?|parois? verticales?"), ("roof", "toitures?|combles?|terrasses?|planchers? hauts?"), ("floor", "planchers? bas|dalles?"))],
        *[(f"{t}_insulation_r", f"^(?:{w})[^\\n]{{0,100}}?\\br ?(?:=|:|de) ?([0-9]+(?:[.,][0-9]+)?) ?m", "number") for t, w in (("wall", "murs?|facades?|parois? verticales?"), ("roof", "toitures?|combles?|terrasses?|planchers? hauts?"), ("floor", "planchers? bas|dalles?"))],
        ("window_glazing", "(double|triple) vitrage", "text"), ("window_material", "menuiseries?[^\\n]{0,40}?\\b(pvc|bois|aluminium|alu|mixte)\\b", "text"),
    ],
    "systems": [
        ("heating_mode_after", "chauffage[^\\n]{0,60}?\\b(pompe a chaleur|pac|chaudiere (?:gaz|bois|biomasse|fioul)|chaudiere|reseau de chaleur|convecteurs?|radiateurs? electriques?|poele)", "text"), ("ecs", "(?:\\becs\\b|eau chaude sanitaire)[^\\n]{0,60}?\\b(chauffe[- ]eau thermodynamique|ballon thermodynamique|ballon electrique|chaudiere|pompe a chaleur|pac|reseau de chaleur|cesi)", "text"),
        ("ventilation", "\\b(vmc double flux|vmc hygro\\w* (?:type )?[ab]|vmc simple flux|vmc|ventilation naturelle|cta)\\b", "text"), ("cooling", "(?:refroidissement|climatisation|rafraichissement)[^\\n]{0,40}?\\b(aucun|sans|split|vrv|drv|groupe froid|adiabatique|geocooling)", "text"),
        ("enr_type", "\\b(photovoltaique|solaire thermique|geothermie|biomasse)\\b", "text"), ("fan_count", "nombre (?:total )?(?:de )?brasseurs? d.?air(?: de la zone)? ?[:=] ?([0-9]+)", "number"), ("fan_type", "(?:pose|fourniture|installation|equipes?)[^\\n]{0,40}(brasseurs? d.?air|ventilateurs? de plafond)", "text"),
    ],
    "dpe": [
        *[(f"dpe_{k}_{p}", f"(?s)(?:{w})(?:(?!{o}).){{0,400}}?(?:classe|etiquette) (?:{n}) ?[:=-]? ?([A-G])(?![A-Za-z])", "text") for k, n in (("energy", "(?:dpe )?(?:energie|energetique|de consommation)"), ("ges", "(?:dpe )?(?:ges|climat|emissions?(?: de ges)?)"))
          for p, w, o in (("before", "avant (?:travaux|renovation)|etat (?:initial|actuel|existant)|logement actuel", "apres (?:travaux|renovation)|etat projete"), ("after", "apres (?:travaux|renovation)|etat projete|situation projetee", "avant (?:travaux|renovation)|etat (?:initial|actuel|existant)"))],
        ("shab", "surface habitable" + _V, "number"), ("construction_year", "annee de construction ?[:=]? ?((?:17|18|19|20)[0-9]{2})", "number"),
    ],
    "regulatory": [
        ("bbio_max", "\\bbbio ?(?:max|maxi|maximal|_max)\\b" + _V, "number"), ("bbio", "\\bbbio\\b(?! ?(?:max|maxi|maximal|_max))" + _V, "number"), ("cepnr_max", "\\bcep ?[,._-]? ?nr ?(?:max|maxi|maximal|_max)\\b" + _V, "number"), ("cepnr", "\\bcep ?[,._-]? ?nr\\b(?! ?(?:max|maxi|maximal|_max))" + _V, "number"),
        ("cep_max", "\\bcep ?(?:max|maxi|maximal|_max)\\b" + _V, "number"), ("cep", "\\bcep\\b(?! ?[,._-]? ?nr| ?(?:max|maxi|maximal|_max))" + _V, "number"), ("dh_max", "\\b(?:dh|degres?[- ]heures?) ?(?:max|maxi|maximal|seuil)\\b" + _V, "number"),
        ("dh", "\\b(?:dh|degres?[- ]heures?)\\b(?! ?(?:max|maxi|maximal|seuil))" + _V, "number"), ("tic_ref", "\\btic ?(?:ref|reference|max)\\b[^0-9\\n]{0,40}?([1-5]?[0-9](?:[.,][0-9]+)?)(?![0-9])", "number"), ("tic", "\\btic\\b(?! ?(?:ref|reference|max))[^0-9\\n]{0,40}?([1-5]?[0-9](?:[.,][0-9]+)?)(?![0-9])", "number"),
    ],
    "address": [
        ("address", "^ ?(?:adresse|lieu|localisation|situation|implantation) (?:de l' ?operation|du (?:projet|chantier|terrain|site|programme|batiment)|des travaux|de la construction) ?[:–-]? ?([^\\n]*?[a-z]{3}[^\\n]*?),? ?[0-9]{5}\\b", "text"),
        ("postcode", "^ ?(?:adresse|lieu|localisation|situation|implantation) (?:de l' ?operation|du (?:projet|chantier|terrain|site|programme|batiment)|des travaux|de la construction) ?[:–-]? ?[^\\n]*?\\b([0-9]{5})\\b", "text"),
        ("city", "^ ?(?:adresse|lieu|localisation|situation|implantation) (?:de l' ?operation|du (?:projet|chantier|terrain|site|programme|batiment)|des travaux|de la construction) ?[:–-]? ?[^\\n]*?\\b[0-9]{5} ?[-–]? ?([^0-9,\\n]+)", "text"),
    ],
    "operation_address": [
        ("address", "^operation\\n(?:(?!^(?:maitre|bureau|architecte))[^\\n]*\\n){0,20}?adresse ?([^\\n]*[a-z]{3}[^\\n]*?)[ \\n][0-9]{5}\\b", "text"), ("postcode", "^operation\\n(?:(?!^(?:maitre|bureau|architecte))[^\\n]*\\n){0,20}?adresse[^\\n]*(?:\\n[^\\n]*?)?\\b([0-9]{5})\\b", "text"),
    ],
    "booklet": [
        ("contract_number", "^n° de contrat ?/ ?operation ?:? ?([0-9]+)", "text"), ("internal_code", "^n° de contrat ?/ ?operation ?:? ?[^/\\n]+/ ?([^\\n]+)", "text"), ("operation_name", "^nom de l.operation ?:? ?([^\\n]+)", "text"), ("owner_company", "^maitre d.ouvrage ?:? ?([^\\n]+)", "text"),
        ("postcode", "^adresse de l.operation[^\\n]*(?:\\n[^\\n]*)??\\b([0-9]{5})\\b", "text"), ("department", "^adresse de l.operation[^\\n]*(?:\\n[^\\n]*)??\\b(97[0-9]|[0-9]{2})[0-9]{2,3}\\b", "text"), ("work_type", "^ouvrage ?:? ?([^:\\n]+?) ?: ?[0-9]+ logement", "text"),
        ("housing_total", "^ouvrage[^\\n]*?: ?([0-9]+) logement", "number"), ("building_total", "^ouvrage[^\\n]*- ?([0-9]+) batiment", "number"), ("reference_name", "^referentiel ?:? ?([^\\n]+?)(?: ?[–-] ?version du [^\\n]+)?$", "text"), ("reference_version", "^referentiel[^\\n]*version du ([^\\n]+)", "text"),
        ("mentions", "^mention(?:\\(s\\)|s)? ?: ?([^\\n]+)", "text"), ("specific_profile", "^profil specifique ?:? ?([^\\n]+)", "text"), ("performance", "^performance ?:? ?([^\\n]+)", "text"),
    ],
    "dpe_recap": [
        *[(f, f"^lgt\\.? ?\\S+ .*?\\bt[0-9] {p} ?$", k) for f, p, k in (("shab", "([0-9]+(?:[.,][0-9]+)?) [0-9]+ [0-9]+ [A-G] [A-G] [0-9]+ [0-9]+ [A-G] [A-G]", "number"), ("dpe_energy_before", "\\S+ [0-9]+ [0-9]+ ([A-G]) [A-G] [0-9]+ [0-9]+ [A-G] [A-G]", "text"), ("dpe_ges_before", "\\S+ [0-9]+ [0-9]+ [A-G] ([A-G]) [0-9]+ [0-9]+ [A-G] [A-G]", "text"),
          ("dpe_energy_after", "\\S+ [0-9]+ [0-9]+ [A-G] [A-G] [0-9]+ [0-9]+ ([A-G]) [A-G]", "text"), ("dpe_ges_after", "\\S+ [0-9]+ [0-9]+ [A-G] [A-G] [0-9]+ [0-9]+ [A-G] ([A-G])", "text"))],
    ],
    "biosourced": [("mention_biosourced_building", "label batiment biosource", "Oui"), ("biosourced_2013", "label batiment biosource[^\\n]*(niveau [0-9]) du label 2012", "text")],
    "heat_loss": [("department", "^departement ?: ?([0-9]{2,3}|2[ab]) ?-", "text")],
    "summer_comfort": [("cooling", "pas envisage de rafraichir|sans (?:systeme de )?rafraichissement actif", "Aucun"), ("window_shading", "brise ?-?soleil orientable|\\bbso\\b", "BSO"), ("window_glazing", "triples? vitrages?", "Triple vitrage"), ("ventilation", "\\bcta\\b", "CTA")],
    "services_summary": [(f, f"^(?:{NUMBER[1:-1]} ?/ ?{NUMBER[1:-1]} [^0-9\\n]{{1,14}}2? ){{{k}}}" + (f"{NUMBER} ?/" if first else f"{NUMBER[1:-1]} ?/ ?{NUMBER}"), "number") for k, pair in enumerate((("bbio", "bbio_max"), ("cep", "cep_max"), ("cepnr", "cepnr_max"), ("ic_energy", "ic_energy_max"))) for f, first in ((pair[0], True), (pair[1], False))],
    "acv_report": [(f, f"^{label} kg[^\\n]*? {NUMBER} ?$", "number") for f, label in (("ic_construction_max_2028", "ic construction max 2028"), ("ic_construction_max", "ic construction max"), ("ic_construction", "ic construction"), ("ic_energy_max_2028", "ic energie max 2028"), ("ic_energy_max", "ic energie max"), ("ic_energy", "ic energie"), ("ic_components", "ic composants?"), ("ic_site", "ic chantier"), ("stock_c_per_m2", "stock c batiment"))],
    "financial": [("internal_code", "\\b(ope-[0-9]{6})\\b", "text"), ("contract_number", "^n° (?:de|du) contrat ?:? ?([0-9]{3,8})\\b", "text")],
}
CONFIDENCE = {"rset": 0.999, "rt2012": 0.999, "carbone": 0.96, "cep_breakdown": 0.90, "thcex": 0.92, "programme": 0.88, "envelope": 0.92, "systems": 0.94, "dpe": 0.96, "regulatory": 0.91, "address": 0.85, "operation_address": 0.97, "booklet": 0.95, "dpe_recap": 0.90, "biosourced": 0.92, "heat_loss": 0.97, "summer_comfort": 0.88, "services_summary": 0.99, "acv_report": 0.99, "financial": 0.95}
#: The packs of each family, and those that run on every document that has no signature.
FAMILY_PACKS = {"rset": ("rset", "cep_breakdown", "systems", "envelope", "operation_address"), "rt2012": ("rt2012", "systems", "envelope"), "carbone": ("carbone",), "thcex": ("thcex", "envelope", "systems", "programme"), "cctp": ("envelope", "systems"), "dpgf": ("envelope", "systems"), "dpe": ("dpe", "systems", "envelope"), "financier": ("financial",), "annex": ("programme", "regulatory", "address")}
GENERAL = ("regulatory", "programme", "address")


def families(doc_type: Column, norm: Column, manual: Column | None = None) -> Column:
    """The families of a document: set by hand, else by its type; a study with carbon results is of the carbon family too."""
    out = F.array(F.lit("annex"))
    for t, f in FAMILIES.items():
        out = F.when(doc_type == t, F.array(*map(F.lit, f))).otherwise(out)
    carbon = (F.size(out) == 1) & F.array_contains(out, "rset") & norm.rlike(CARBON_SIGNS)
    out = F.when(carbon, F.array_append(out, F.lit("carbone"))).otherwise(out)
    return F.when(F.size(manual) > 0, manual).otherwise(out) if manual is not None else out


def dispatch(doc_type: Column, norm: Column, manual: Column | None = None) -> Column:
    """The packs that read a document: the one of the first signature it bears, else those of its families, else the general ones."""
    out = F.lit(None).cast("array<string>")
    for name, signature in reversed(SIGNATURES.items()):
        out = F.when(signature.holds(norm), F.array(F.lit(name))).otherwise(out)
    of = families(doc_type, norm, manual)
    packs = F.create_map(*[x for f, p in FAMILY_PACKS.items() for x in (F.lit(f), F.array(*map(F.lit, p)))])
    by_family = F.array_distinct(F.flatten(F.transform(of, lambda f: F.coalesce(packs[f], F.array(*map(F.lit, GENERAL))))))
    return F.coalesce(out, by_family)


def rules(packs: tuple[str, ...] | None = None) -> list[Rule]:
    """The rules of packs (all of them without); each applies where its pack is among the document's."""
    made = []
    for pack in packs or tuple(PACKS):
        for k, (field, pattern, kind) in enumerate(PACKS[pack]):
            constant = kind not in ("number", "text")
            made.append(Rule(f"{pack}:{k}", field, f"(?im){pattern}", 1 if not constant else 0, "text" if constant else kind, CONFIDENCE[pack], (pack,), max_matches=1, constant=kind if constant else None))
    return made


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str = "doc_type", packs: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, doc_type, building, field, value_num, value_text, confidence, method, excerpt) of documents by their packs; a value found by several rules of one building comes once, from the most confident.

    docs has the columns named; a null type is none. packs limits what may run.
    """
    d = _once(docs.select(id_col, F.col(type_col).alias("_type"), F.col(text_col).alias("_whole")), _plain=plain(F.col("_whole"))).drop("_whole")
    # Without accents already, so folded once it is in lower case.
    d = _once(d, _norm=F.lower("_plain"))
    d = _once(d, _packs=dispatch(F.col("_type"), F.col("_norm"))).select(id_col, F.col("_type").alias(type_col), F.col("_plain").alias(text_col), "_packs")
    p = parts(d, id_col, text_col, (type_col, "_packs"), cleaned=True).withColumn("_key", F.struct("doc_id", "part", "building", type_col))
    held = p.withColumn("_pack", F.concat(F.lit(" "), F.array_join("_packs", " "), F.lit(" ")))
    found = facts(held, rules(packs), "_key", "text", "_pack", among=True)
    found = found.select("doc_id.*", "field", "value_num", F.trim("value_text").alias("value_text"), "confidence", F.col("rule").alias("method"))
    best = F.struct("confidence", "method", "value_num", "value_text")
    out = found.groupBy("doc_id", type_col, "building", "field", F.coalesce(F.format_string("%.6f", "value_num"), fold(F.col("value_text"))).alias("_v")).agg(F.max_by(best, F.struct("confidence", "method")).alias("w"))
    return out.select("doc_id", F.col(type_col).alias("doc_type"), "building", "field", "w.value_num", "w.value_text", "w.confidence", "w.method")


def clean_facts(docs: DataFrame, whitelist: dict[str, tuple[str, ...]], id_col: str = "doc_id", text_col: str = "text", type_col: str = "doc_type") -> DataFrame:
    """(doc_id, doc_type, building, field, value_num, value_text, confidence, method, rank): what documents say, from text to readings that may be compared.

    The packs and the layouts with phases read the text; what comes from both comes once, from the phases. Fields that the whitelist doesn't have for any of the document's families go (families
    without an entry have all), then weak readings beside strong ones, then what can't be true; the rest is spelled alike and ranked by its place.
    """
    from .fusion import prune_shadowed, semantic_rank
    from .phased_layouts import LAYOUTS
    from .phases import read
    from .sanity import sanitize

    packs = parse(docs, id_col, text_col, type_col)
    kinds = docs.select(F.col(id_col).alias("doc_id"), F.col(type_col).alias("doc_type"), fold(plain(F.col(text_col))).alias("_norm"))
    kinds = _once(kinds, families=families(F.col("doc_type"), F.col("_norm"))).drop("_norm")
    staged = read(docs, LAYOUTS, id_col, text_col).withColumnRenamed(id_col, "doc_id").withColumnRenamed("rule", "method")
    staged = staged.groupBy("doc_id", "building", "field").agg(F.max_by(F.struct("value_num", "value_text", "confidence", "method"), F.struct("confidence", "method")).alias("w")).select("doc_id", "building", "field", "w.*")
    cols = ["doc_id", "building", "field", "value_num", "value_text", "confidence", "method"]
    both = staged.select(*cols, F.lit(True).alias("_staged")).unionByName(packs.select(*cols, F.lit(False).alias("_staged")))
    told = F.max("_staged").over(Window.partitionBy("doc_id", "building", "field"))
    found = both.withColumn("_told", told).filter("_staged or not _told").drop("_staged", "_told")
    # A row for each document, however small the table is that it is made from: never broadcast.
    found = found.join(kinds.hint("merge"), "doc_id")
    known = F.create_map(*[x for f, fields in whitelist.items() for x in (F.lit(f), F.array(*map(F.lit, fields)))]) if whitelist else F.create_map().cast("map<string,array<string>>")
    found = found.filter(F.exists("families", lambda f: known[f].isNull() | F.array_contains(known[f], F.col("field")))).drop("families")
    found = found.withColumn("excerpt", F.lit(None).cast("string")).withColumn("validated", F.lit(False)).withColumn("structured", F.lit(False))
    kept = sanitize(prune_shadowed(found))
    rank = semantic_rank(F.col("doc_type"), F.col("method"), F.col("excerpt"))
    return kept.select("doc_id", "doc_type", "building", "field", "value_num", "value_text", "confidence", "method", rank.alias("rank"))


def add_missing(own: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """own, and the rows of more whose keys it does not have."""
    return own.unionByName(more.join(own.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def page_scores(pages: DataFrame, tags: dict[str, list[str]], labels: dict[str, str]) -> Column:
    """How much a page's folded text (column norm) has to do with fields: of each field the first six tags it holds (2 for those of more than six characters, else 1), and half a point for each word of its label of six characters or more."""
    score = F.lit(0.0)
    for field, words in tags.items():
        for w in words[:6]:
            score = score + F.when(F.col("norm").contains(w.lower()), 2.0 if len(w) > 6 else 1.0).otherwise(0.0)
        for w in labels.get(field, "").lower().split():
            if len(w) >= 6:
                score = score + F.when(F.col("norm").contains(w), 0.5).otherwise(0.0)
    return score


def pages_to_ask(pages: DataFrame, tags: dict[str, list[str]], labels: dict[str, str], most: int = 6, chars: int = 6000) -> DataFrame:
    """(doc_id, page, text) of pages (doc_id, page, text): the best pages of each document, up to `most`, in order; a document of few pages without any match gives its first ones. Texts are cut as asked for."""
    p = pages.filter(F.trim("text") != "").withColumn("norm", fold(plain(F.col("text"))))
    p = p.withColumn("score", page_scores(p, tags, labels))

    w = Window.partitionBy("doc_id")
    p = p.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_hits", F.count_if(F.col("score") > 0).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("score").desc(), "page")))
    kept = (F.col("_r") <= most) & ((F.col("score") > 0) | (F.col("_hits") == 0) & (F.col("_n") <= most))
    return p.filter(kept).select("doc_id", "page", F.substring("text", 1, chars).alias("text"))


def verify_proposals(proposals: DataFrame, pages: DataFrame, allowed: dict[str, str], cap: float = 0.85) -> DataFrame:
    """proposals (doc_id, field, value, page, quote) with reason (null: accepted), value_num and confidence: the field has to be allowed (name to number or text), the page there, the quote of 4 to 400 characters in it word for
    word, and the value in the quote."""
    loose = lambda c: F.trim(F.regexp_replace(F.regexp_replace(fold(plain(c)), "\\s*([:;,=|/()])\\s*", "$1"), "\\s+", " "))
    j = proposals.join(pages.select("doc_id", "page", F.col("text").alias("_t")), ["doc_id", "page"], "left")
    kinds = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.lit(v))])
    n, q = fr_number(F.col("value")), F.trim("quote")
    numbers = F.transform(F.regexp_extract_all(plain(q), F.lit("[-+]?[0-9]+(?: [0-9]{3})*(?:[.,][0-9]+)?"), F.lit(0)), fr_number)
    inside = F.exists(numbers, lambda x: F.abs(x - n) <= F.greatest(F.lit(1e-9), F.abs(n) * 1e-6))
    number = kinds[F.col("field")] == "number"
    why = F.when(kinds[F.col("field")].isNull(), "field").when(F.col("_t").isNull(), "page").when(F.coalesce(F.char_length(q), F.lit(0)) < 4, "short quote").when(F.char_length(q) > 400, "long quote").when(~loose(F.col("_t")).contains(loose(q)), "not on the page")
    why = why.when(number & n.isNull(), "no number").when(number & ~F.coalesce(inside, F.lit(False)), "value not in the quote").when(~number & (F.coalesce(F.trim("value"), F.lit("")) == ""), "empty").when(~number & ~loose(q).contains(loose(F.col("value"))), "value not in the quote")
    j = j.withColumn("reason", why).drop("_t")
    return j.withColumn("value_num", F.when(F.col("reason").isNull() & number, n)).withColumn("confidence", F.when(F.col("reason").isNull(), cap))


# Sources of energy by pattern, in the order in which they are tried.
ENERGIES = [("Réseau de chaleur urbain", "\\brcu\\b|reseau de chaleur|chauffage urbain|sous[- ]station"), ("Bois / biomasse", "\\bbois\\b|biomasse|granules?\\b|pellets?\\b"), ("Géothermie", "geotherm\\w*"), ("Fioul", "\\bfioul\\b|\\bfuel\\b|mazout"), ("Gaz", "\\bgaz\\b|propane"),
            ("Électricité", "\\bpac\\b|pompes? a chaleur|electri\\w*|effet joule|thermodynamique")]
# What names a heating as hybrid, what names a second generator, and short names in labels.
_HYBRID = "\\bhybrides?\\b|\\bbi[- ]?energies?\\b|\\bbivalente?s?\\b|\\b(?:pac|pompes? a chaleur)\\b[^|\\n]{0,60}\\+ *chaudieres?\\b|\\bchaudieres?\\b[^|\\n]{0,60}\\+ *(?:pac|pompes? a chaleur)\\b"
_SECOND = "(?:appoint|releve|secours|complement)"
SHORT_ENERGIES = {"Réseau de chaleur urbain": "RCU", "Bois / biomasse": "Bois"}


def hybrid_label(first: Column, second: Column) -> Column:
    """'Hybride Gaz/Électricité' of two energies, 'Hybride' where one isn't known."""
    short = lambda c: F.coalesce(F.create_map(*[F.lit(x) for p in SHORT_ENERGIES.items() for x in p])[c], c)
    return F.when(first.isNull() | second.isNull(), F.lit("Hybride")).otherwise(F.concat(F.lit("Hybride "), short(first), F.lit("/"), short(second)))


def hybrid_energy(text: Column) -> Column:
    """The label of a hybrid heating by the energies within 90 characters of its first mention; null where none is mentioned.

    Of the first three energies, the main one is the first that isn't named as auxiliary ('PAC en appoint', 'appoint gaz'), the other the first of the rest; a word for
    an auxiliary counts for the energy before it unless a comma stands between, and for the one after it only when small words stand between. A geothermal heat pump is no electricity.
    """
    # A value that is used several times goes through a lambda, which computes it once.
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def window(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(_HYBRID))
        return F.when(at > 0, F.substr(t, F.greatest(at - 90, F.lit(1)), F.char_length(F.regexp_extract(t, _HYBRID, 0)) + 90 + F.least(at - 1, F.lit(90))))

    # An energy is found with what stands before and after it, so a mention is judged by one pattern.
    not_geo = "(?!(?s:.{0,32})geotherm)"
    after = f"(?=(?: (?:[a-z/]+ ){{0,3}}?)?(?:en |d. *|de )?{_SECOND})"
    before = f"{_SECOND}\\w*(?: (?:par|en|au|a|de|d|du|une?|des?|la|le))* (?:[a-z]+ )?"

    def seen(w: Column, name: str, pattern: str) -> Column:
        p = f"{not_geo}(?:{pattern})" if name == "Électricité" else f"(?:{pattern})"
        told = lambda at: F.substr(w, at).rlike(f"^(?:{pattern}){after}") | F.substr(w, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30))).rlike(f"{before}$")
        return let(F.regexp_instr(w, F.lit(p)), lambda at: F.when(at > 0, F.struct(at.alias("at"), F.lit(name).alias("v"), told(at).alias("second"))))

    def label(f: Column) -> Column:
        main = F.coalesce(F.get(F.filter(f, lambda x: ~x["second"]), F.lit(0))["v"], F.get(f, F.lit(0))["v"])
        return let(main, lambda m: hybrid_label(m, F.get(F.filter(f, lambda y: y["v"] != m), F.lit(0))["v"]))

    found = let(let(F.regexp_replace(fold(plain(text)), "(?:ventilation|vmc|traitement|mode) hybrides?", " "), window), lambda w: F.when(w.isNotNull(), F.slice(F.array_sort(F.array_compact(F.array(*[seen(w, v, p) for v, p in ENERGIES]))), 1, 3)))
    return let(found, lambda f: F.when(f.isNotNull(), label(f)))
