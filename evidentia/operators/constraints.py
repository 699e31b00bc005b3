"""Constraints between the fields of a building, columns derived from others, and categories of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, normalize

# The plausible range of each field of a finished row.
PLAUSIBLE_RANGES = {
    "bbio": (5, 300), "bbio_max": (5, 300), "cep": (5, 700), "cep_max": (5, 1500), "cepnr": (5, 700), "cepnr_max": (5, 700), "dh": (0, 5000), "dh_zt": (0, 5000), "dh_znt": (0, 5000), "dh_max": (0, 5000),
    "tic": (15, 45), "tic_ref": (15, 45), "ubat_before": (0.05, 5), "ubat_after": (0.05, 5), "ubat_ref": (0.05, 5), "ges": (0, 150), "ges_before": (0, 250), "ges_ref": (0, 250), "cep_before": (5, 1500),
    "cep_after_final": (5, 1500), "shab": (8, 500000), "housing_count": (1, 5000), "ic_components": (100, 2500), "ic_site": (0, 250), "ic_energy": (0, 2000), "stock_c_per_m2": (0, 400), "bbio_gain": (-100, 100),
    "cep_gain": (-100, 100), "cepnr_gain": (-100, 100), "ubat_gain": (-100, 100), "ges_gain": (-100, 100), "construction_year": (1700, 2035),
}
LOTS = [f"ic_lot_{i}" for i in range(1, 14)]
POSTS = ["ic_energy_heating", "ic_energy_cooling", "ic_energy_ecs", "ic_energy_aux_vent", "ic_energy_aux_dist", "ic_energy_mobility"]
# Value, limit, gain and initial state that belong together.
GAINS = [("bbio", "bbio_max", "bbio_gain", None), ("cep", "cep_max", "cep_gain", "cep_before"), ("cepnr", "cepnr_max", "cepnr_gain", None), ("ubat_after", "ubat_ref", "ubat_gain", "ubat_before"), ("ges", "ges_ref", "ges_gain", "ges_before")]
LIMITS = [("bbio", "bbio_max"), ("cep", "cep_max"), ("cepnr", "cepnr_max"), ("dh", "dh_max")]
# Words that tell a category, by kind of field; categories are tried in this order.
CATEGORIES = {
    "energy": [("pac", "\\bpac\\b|pompe a chaleur|thermodynamique|\\bcet\\b|zepac|effipac|aerotherm|geotherm"), ("reseau", "reseau de chaleur|chauffage urbain|sous ?-?station|\\brcu\\b|reseau urbain"),
               ("gaz", "\\bgaz\\b|chaudiere(?! bois)(?! a granul)|condensation|\\bgn\\b"), ("elec", "electri|effet joule|\\bjoule\\b|convecteur|panneaux? rayonnant"), ("bois", "\\bbois\\b|granul|biomasse|pellet|buche"),
               ("solaire", "solaire|\\bcesi\\b|\\bssc\\b"), ("fioul", "fioul|fuel|mazout")],
    "ventilation": [("double", "double flux|\\bdf\\b"), ("hygro", "hygro|\\bsimple flux\\b|\\bsf\\b|vmc"), ("naturelle", "naturelle|vmr|ventilation par conduit")],
    "glazing": [("triple", "triple"), ("double", "double|\\b4[ ./-]?1[0-9][ ./-]?4\\b|\\b44[.,]2")],
    "insulation": [("lv", "laine de verre|\\blv\\b|\\bgr ?3[0-9]\\b"), ("lr", "laine de roche|\\blr\\b|roche"), ("pse", "polystyrene expanse|\\bpsee?\\b|\\bpse[- ]?th"), ("xps", "extrude|\\bxps\\b"), ("pu", "polyurethane|\\bp(?:u|ur|ir)\\b"),
                   ("fibre_bois", "fibre de bois|laine de bois|\\bfdb\\b"), ("ouate", "ouate|cellulose"), ("biosource", "chanvre|lin\\b|coton|paille"), ("laine_minerale", "laine minerale")],
}
KINDS = {"heating_mode_after": "energy", "heating_vector_after": "energy", "heating_vector_before": "energy", "ecs": "energy", "ecs_vector_after": "energy", "ecs_vector_before": "energy", "ventilation": "ventilation", "window_glazing": "glazing",
         "roof_insulation": "insulation", "wall_insulation": "insulation", "floor_insulation": "insulation", "wall_ite_insulation": "insulation", "wall_iti_insulation": "insulation"}


def _gain(limit: Column, value: Column) -> Column:
    return F.floor((limit - value) / limit * 1000 + 0.5) / 10


def _sum(cols: list[str]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))


def check_suite(rows: DataFrame, key: str = "building") -> DataFrame:
    """(key, check, status, detail, fields): every constraint that can be tested on wide rows; columns that rows lacks count as null.

    Ranges; the thirteen lots sum to the components (2 or 3 %); at least three energy posts stay below the energy total (3 % and 1); cepnr stays below cep (0.5);
    gains agree with their recalculation (1.5 points; a fraction is read as percent) on the initial state where it is known. status is ok, fail, calculated (a gain
    that was missing: detail is its value) or alert (a limit exceeded: told, never removed). Passed ranges are not listed.
    """
    fields = {*PLAUSIBLE_RANGES, *LOTS, *POSTS, *[x for g in GAINS for x in g if x]}
    r = rows.select(key, *[(F.col(f).cast("double") if f in rows.columns else F.lit(None).cast("double")).alias(f) for f in sorted(fields)])
    c = F.col
    line = lambda check, status, detail, fs: F.struct(F.lit(check).alias("check"), status.alias("status"), detail.cast("double").alias("detail"), F.array(*map(F.lit, fs)).alias("fields"))
    ok = lambda test: F.when(test, "ok").otherwise("fail")
    out = [F.when(~c(f).between(lo, hi), line(f"range {f}", F.lit("fail"), c(f), [f])) for f, (lo, hi) in [*PLAUSIBLE_RANGES.items(), *[(f, (-100, 1500)) for f in LOTS]]]
    whole, total = c("ic_components").isNotNull(), _sum(LOTS)
    for f in LOTS:
        whole = whole & c(f).isNotNull()
    out.append(F.when(whole, line("lots", ok(F.abs(total - c("ic_components")) <= F.greatest(F.lit(2.0), F.abs("ic_components") * 0.03)), total, [*LOTS, "ic_components"])))
    posts = sum((c(f).isNotNull().cast("int") for f in POSTS), F.lit(0))
    out.append(F.when(c("ic_energy").isNotNull() & (posts >= 3), line("posts", ok(_sum(POSTS) <= c("ic_energy") * 1.03 + 1), _sum(POSTS), [*POSTS, "ic_energy"])))
    out.append(F.when(c("cep").isNotNull() & c("cepnr").isNotNull(), line("cepnr", ok(c("cepnr") <= c("cep") + 0.5), c("cepnr"), ["cep", "cepnr"])))
    for value, limit, gain, initial in GAINS:
        base = F.when(c(initial) > 0, c(initial)).otherwise(c(limit)) if initial else c(limit)
        made = _gain(base, c(value))
        read = F.when((F.abs(c(gain)) <= 1) & (F.abs(made) > 1), c(gain) * 100).otherwise(c(gain))
        status = F.when(c(gain).isNull(), "calculated").otherwise(ok(F.abs(read - made) <= 1.5))
        out.append(F.when(c(value).isNotNull() & (base != 0), line(f"gain {value}", status, made, [gain])))
    out += [F.when(c(v) > c(m) * 1.0001, line(f"limit {v}", F.lit("alert"), c(v), [v])) for v, m in LIMITS]
    out.append(F.when(c("tic") > c("tic_ref") + 0.05, line("limit tic", F.lit("alert"), c("tic"), ["tic"])))
    return r.select(key, F.inline(F.array_compact(F.array(*out))))


def demote(finals: DataFrame, checks: DataFrame, key: str = "building") -> tuple[DataFrame, DataFrame]:
    """(finals that stay, demoted): finals (key, field, confidence, protected) named by a failed check fall, with their confidence capped at 0.89 and the check as reason; protected ones stay."""
    failed = checks.filter("status = 'fail'").select(key, F.explode("fields").alias("field"), "check").groupBy(key, "field").agg(F.min("check").alias("reason"))
    j = finals.join(failed, [key, "field"], "left").withColumn("_out", F.col("reason").isNotNull() & ~F.coalesce("protected", F.lit(False)))
    gone = j.filter("_out").drop("_out").withColumn("confidence", F.least(F.coalesce("confidence", F.lit(0.89)), F.lit(0.89)))
    return j.filter("not _out").drop("_out", "reason"), gone


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")).isin("", "non précisé"), F.lit(True))


def derive(rows: DataFrame) -> DataFrame:
    """Wide rows with derived columns where they are blank: gains on the initial state, built before or after 1948, DH by type of zone, wall sides and their sums,
    fans and cooling. Columns that rows lacks are null; what is there is kept, gains and sums aside, which follow their parts unless listed in manual (array of fields).
    """
    texts = ["built_before_1948", "built_after_1948", "cross_ventilated", "non_cross_ventilated", "wall_ite", "wall_iti", "wall_ite_insulation", "wall_iti_insulation", "fan_presence", "fan_type", "cooling", "cooling_active"]
    numbers = ["cep_before", "cep", "cep_after_final", "cep_gain", "ubat_before", "ubat_after", "ubat_gain", "ges_before", "ges", "ges_gain", "construction_year", "dh", "dh_zt", "dh_znt", "wall_ite_thickness", "wall_iti_thickness",
               "wall_insulation_thickness", "wall_ite_r", "wall_iti_r", "wall_insulation_r", "fan_count"]
    for name, kind in [*[(t, "string") for t in texts], *[(n, "double") for n in numbers], ("manual", "array<string>")]:
        rows = rows.withColumn(name, F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind))
    c, manual = F.col, lambda f: F.coalesce(F.array_contains("manual", f), F.lit(False))
    fill = lambda f, v: F.when(_blank(c(f)), v).otherwise(c(f))
    yes = lambda f: ~_blank(c(f)) & ~fold(c(f)).rlike("^(?:non|aucun|0)$")
    for start, gain, values in (("cep_before", "cep_gain", ["cep", "cep_after_final"]), ("ubat_before", "ubat_gain", ["ubat_after"]), ("ges_before", "ges_gain", ["ges"])):
        rows = rows.withColumn(gain, F.when((c(start) > 0) & F.coalesce(*values).isNotNull() & ~manual(gain), _gain(c(start), F.coalesce(*values))).otherwise(c(gain)))
    old = c("construction_year") > 1000
    rows = rows.withColumn("built_before_1948", fill("built_before_1948", F.when(old, F.when(c("construction_year") < 1948, "Oui").otherwise("Non"))))
    rows = rows.withColumn("built_after_1948", fill("built_after_1948", F.when(old, F.when(c("construction_year") >= 1948, "Oui").otherwise("Non"))))
    for zone, f in (("dh_zt", "cross_ventilated"), ("dh_znt", "non_cross_ventilated")):
        rows = rows.withColumn(f, fill(f, F.when(c(zone).isNotNull(), "Oui")))
    house = c("building").rlike("(?i)^(?:b[aâ]timent\\s+)?(?:maisons?|villas?|pavillons?)\\b") if "building" in rows.columns else F.lit(False)
    through = (house | yes("cross_ventilated")) & ~yes("non_cross_ventilated")
    none = c("dh_zt").isNull() & c("dh_znt").isNull() & c("dh").isNotNull()
    rows = rows.withColumn("_zt", F.when(none & through, c("dh")).otherwise(c("dh_zt"))).withColumn("dh_znt", F.when(none & ~through, c("dh")).otherwise(c("dh_znt"))).withColumn("dh_zt", c("_zt")).drop("_zt")
    side = {s: ~(_blank(c(f"wall_{s}_insulation")) & c(f"wall_{s}_thickness").isNull() & c(f"wall_{s}_r").isNull()) for s in ("ite", "iti")}
    rows = rows.withColumn("wall_ite", fill("wall_ite", F.when(side["ite"], "Oui").when(side["iti"], "Non"))).withColumn("wall_iti", fill("wall_iti", F.when(side["iti"], "Oui").when(side["ite"], "Non")))
    for kind in ("thickness", "r"):
        whole = (c(f"wall_ite_{kind}") > 0) & (c(f"wall_iti_{kind}") > 0) & ~manual(f"wall_insulation_{kind}")
        rows = rows.withColumn(f"wall_insulation_{kind}", F.when(whole, F.floor((c(f"wall_ite_{kind}") + c(f"wall_iti_{kind}")) * 100 + 0.5) / 100).otherwise(c(f"wall_insulation_{kind}")))
    rows = rows.withColumn("fan_presence", fill("fan_presence", F.when(c("fan_count") == 0, "Non").when((c("fan_count") > 0) | ~_blank(c("fan_type")), "Oui")))
    cold = fold(normalize(c("cooling")))
    active = F.when(cold.rlike("^(?:aucun|non|sans|pas de)\\b"), "Non").when(cold.rlike("clim|split|reversible|rafraichiss|froid|adiabatique|geocooling|free[\\s-]?cooling|\\b[vd]rv\\b|ventilo[\\s-]?convecteur|thermo[\\s-]?frigo"), "Oui")
    return rows.withColumn("cooling_active", fill("cooling_active", active)).drop("manual")


def wall_side(text: Column) -> Column:
    """ite or iti for a text that tells on which side a wall is insulated; plain words count before hints; null for both or none."""
    t = fold(normalize(text))
    strong_e = t.rlike("\\bite\\b|isol(?:ation|ant)s?\\s+(?:thermique\\s+)?(?:(?:par|a|de|depuis)\\s+l'\\s*)?exterieur|\\betics\\b|enduit\\s+sur\\s+isolant|mur\\s+manteau")
    strong_i = t.rlike("\\biti\\b|isol(?:ation|ant)s?\\s+(?:thermique\\s+)?(?:(?:par|a|de|depuis)\\s+l'\\s*)?interieur")
    weak_e, weak_i = t.rlike("bardage|veture|vetage"), t.rlike("doublage|contre[- ]cloison|plaque\\s+de\\s+platre")
    return F.when(strong_e & ~strong_i, "ite").when(strong_i & ~strong_e, "iti").when(strong_e, None).when(weak_e & ~weak_i, "ite").when(weak_i & ~weak_e, "iti")


def sided(facts: DataFrame) -> DataFrame:
    """Facts and a copy of each fact on wall insulation under the field of its side, and of each DH under that of its zone (column dh_zone: zt or znt, if there)."""
    part = F.when(F.col("field") == "wall_insulation", "insulation").when(F.col("field") == "wall_insulation_thickness", "thickness").when(F.col("field") == "wall_insulation_r", "r")
    side = F.when(part.isNotNull(), F.concat(F.lit("wall_"), wall_side(F.col("excerpt")), F.lit("_"), part))
    zone = F.when((F.col("field") == "dh") & F.col("dh_zone").isin("zt", "znt"), F.concat(F.lit("dh_"), "dh_zone")) if "dh_zone" in facts.columns else F.lit(None).cast("string")
    return facts.withColumn("_f", F.explode(F.array_compact(F.array("field", F.coalesce(side, zone))))).withColumn("field", F.col("_f")).drop("_f")


def settle_phases(facts: DataFrame) -> DataFrame:
    """Facts whose phase was guessed (phase_guess) as before the works become after, where another document of the building has an explicit initial state. A count of documents decides, so no set is collected."""
    explicit = facts.filter(~F.coalesce("phase_guess", F.lit(False)) & F.col("field").rlike("^dpe_(?:energy|ges)_before$")).groupBy("building").agg(F.min("doc_id").alias("_d0"), F.max("doc_id").alias("_d1"))
    other = F.coalesce((F.col("_d0") != F.col("doc_id")) | (F.col("_d1") != F.col("doc_id")), F.lit(False))
    after = F.when(F.col("field") == "ventilation_before", "ventilation").otherwise(F.regexp_replace("field", "_before$", "_after"))
    move = F.col("phase_guess") & other & F.col("field").isin("dpe_energy_before", "dpe_ges_before", "heating_vector_before", "ecs_vector_before", "ventilation_before")
    j = facts.join(explicit, "building", "left").withColumn("_m", F.coalesce(move, F.lit(False)))
    return j.withColumn("field", F.when(F.col("_m"), after).otherwise(F.col("field"))).withColumn("phase_guess", F.col("phase_guess") & ~F.col("_m")).drop("_m", "_d0", "_d1")


def categories(field: Column, text: Column) -> Column:
    """The categories a text names, for fields compared by category; null for other fields."""
    t = F.concat(F.lit(" "), fold(normalize(text)), F.lit(" "))
    out = F.lit(None).cast("array<string>")
    for kind, rules in CATEGORIES.items():
        found = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in rules]))
        if kind == "insulation":  # mineral wool says no more than glass or rock wool
            found = F.when(F.arrays_overlap(found, F.array(F.lit("lv"), F.lit("lr"))), F.array_remove(found, "laine_minerale")).otherwise(found)
        out = F.when(field.isin(*[f for f, k in KINDS.items() if k == kind]), found).otherwise(out)
    return out


def same_category(field: Column, document: Column, reference: Column) -> Column:
    """right where every category the document names is the reference's, wrong where not, incomparable where either names none; null for fields without categories."""
    d, r = categories(field, document), categories(field, reference)
    wool = lambda a, k: F.array_contains(a, k)
    fits = F.forall(d, lambda k: F.array_contains(r, k) | (k == "laine_minerale") & (wool(r, "lv") | wool(r, "lr")) | k.isin("lv", "lr") & wool(r, "laine_minerale"))
    return F.when(d.isNull(), None).when((F.size(d) == 0) | (F.size(r) == 0), "incomparable").when(fits, "right").otherwise("wrong")


def reference_grade(result: Column, odd_document: Column, odd_reference: Column, document: Column, reference: Column, elsewhere: Column) -> Column:
    """How a reading stands to its reference: right, missing, aberrant, odd reference, minor (10 %), version (the reference's value is read in another document) or major; null for incomparable."""
    near = F.abs(document - reference) <= F.abs(reference) * 0.10
    return (
        F.when(result == "incomparable", None).when(result == "right", "right").when(result == "missing", "missing").when(odd_document.isNotNull() & odd_reference.isNull(), "aberrant")
        .when(odd_reference.isNotNull() & odd_document.isNull(), "odd reference").when(near, "minor").when(elsewhere, "version").otherwise("major")
    )


def accuracy(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, right, wrong, missing, incomparable, coverage, accuracy): what a bench of results (right, wrong, missing, incomparable) comes to."""
    n = lambda k: F.count_if(F.col("result") == k)
    g = results.groupBy(*by).agg(*[n(k).alias(k) for k in ("right", "wrong", "missing", "incomparable")])
    read = F.col("right") + F.col("wrong")
    return g.withColumn("coverage", F.try_divide(read, read + F.col("missing"))).withColumn("accuracy", F.try_divide(F.col("right"), read))


def contested_accuracy(rows: DataFrame, measured: DataFrame, least: int = 12, floor: float = 0.85) -> DataFrame:
    """rows with contested_accuracy: of the field's own contested cases from `least` on, else of all, unless the few own ones fall below the floor."""
    own = measured.groupBy("field").agg(F.avg(F.col("ok").cast("double")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    whole = measured.agg(F.avg(F.col("ok").cast("double")).alias("p")).scalar()
    j = rows.join(own, "field", "left")
    value = F.when(F.col("_n") >= least, F.col("_p")).when((F.col("_n") > 0) & (F.col("_p") < floor), F.col("_p")).otherwise(whole)
    return j.withColumn("contested_accuracy", value).drop("_p", "_n")


def constructive_system(structure: Column, ite: Column, iti: Column, insulation: Column) -> Column:
    """(system, note) of a wall: timber, masonry insulated outside or inside (or by itself); blank with a note where it cannot be told. ite and iti are Oui, Non or null."""
    s, ins = fold(normalize(structure)), F.coalesce(fold(normalize(insulation)), F.lit(""))
    wood = s.rlike("ossature\\s*bois|\\b(?:mob|cob|clt)\\b|bois\\s*massif|colombage|pans?\\s*de\\s*bois")
    mass = s.rlike("beton|brique|parpaing|\\bblocs?\\b|pierre|meuliere|moellon|maconn|porotherm|monomur|banche|prefabriqu|\\bvoiles?\\b|terre\\s*cuite|agglo")
    spread = s.rlike("monomur|beton\\s*cellulaire|isolation\\s*repartie|thermo\\s*brique|brique\\s*isolante")
    yes = lambda c, words: F.when(fold(c).startswith("oui"), True).when(fold(c).startswith("non"), False).otherwise(ins.rlike(words))
    out, inside = yes(ite, "\\bite\\b|exterieur|isofacade"), yes(iti, "\\biti\\b|interieur|doublage|doublissimo|complexe isolant")
    given = F.coalesce(s != "", F.lit(False))
    pair = lambda system, note: F.struct(F.lit(system).alias("system"), F.lit(note).alias("note"))
    walled = F.when(out & inside, pair("", "both sides")).when(out, pair("masonry, outside", "")).when(inside | spread, pair("masonry, inside or by itself", "")).otherwise(pair("", "insulation not told"))
    return F.when(given & wood, pair("timber", "")).when(given & mass, walled).when(given, pair("", "other structure")).when(out | inside, pair("", "structure not told")).otherwise(pair("", ""))


def family_mismatch(docs: DataFrame) -> DataFrame:
    """Documents (manual, detected: arrays of families; confidence) whose family set by hand has nothing in common with one detected with 0.75 or more, neither being generic."""
    generic = lambda c: F.array_contains(c, "generic") | (F.size(c) == 0)
    return docs.filter((F.col("confidence") >= 0.75) & ~generic(F.col("manual")) & ~generic(F.col("detected")) & ~F.arrays_overlap("manual", "detected"))


def stale(docs: DataFrame, versions: dict[str, int]) -> DataFrame:
    """(docs, derivation): each derivation whose stamp in the map column stamps lies below its current version, or is missing: what a catch-up has to run again."""
    marks = F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at("stamps", F.lit(k)), F.lit(0)) < v, F.lit(k)) for k, v in versions.items()]))
    return docs.withColumn("derivation", F.explode(marks))
