"""One value for each building and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold

ELIGIBLE = 0.90
# Document types whose readings of insulation are direct, fields by which a document is recognised as the reference's own, fields that never come from unattributed readings.
DIRECT_TYPES = ("RSET_RE2020", "RSEE_RE2020", "RT2012")
ANCHOR_FIELDS = ("bbio", "cep")
SCOPED = ("shab", "housing_count", "construction_year")
SCOPED_FAMILIES = ("performance energetique", "confort d'ete", "carbone", "dpe")


def scoped(field: Column, family: Column) -> Column:
    """Whether a field belongs to one building and must not be inherited from readings without one (family: the field's, null for none)."""
    own = field.isin(*SCOPED) | F.translate(fold(family), "’", "'").isin(*SCOPED_FAMILIES)
    return F.coalesce(own & ~field.isin("fan_type", "fan_presence"), F.lit(False))


def pool(occ: DataFrame) -> DataFrame:
    """Eligible candidates: not forbidden, confident, and of main sources where there are any. Keys with a main source are found map-side; no row meets all others of its key."""
    ok = occ.filter((F.col("tier") != "forbidden") & (F.col("confidence") >= ELIGIBLE))
    has = ok.filter("tier = 'main'").select("building", "field").distinct()
    return ok.filter("tier = 'main'").unionByName(ok.filter("tier <> 'main'").join(has, ["building", "field"], "left_anti"))


def winners(occ: DataFrame) -> DataFrame:
    """The winning row of each building and field among main sources, or among all where there are none.

    Order: definitive entries; direct readings (of insulation: of a direct document type), then those not from a library; attributed before global;
    the anchor documents of the building; source rank; hierarchy rank (50 unless given); the later file revision; the newest hour of study; surface priority (of shab
    only); confidence; seq. occ has building, field, value, doc_id, tier, source_rank, confidence, study_date, seq; the columns definitive,
    library_derived, doc_type, is_global, is_anchor, hierarchy_rank, revision and surface_priority count where they are there.

    The reference compares revisions only of two files of one type and dates only if both are there, which is no order; here missing ones come last.
    A min of an order struct instead of a window: it is folded map-side, so a field with very many readings meets in no one task.
    """
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in occ.columns else F.lit(default)
    insulation = F.col("field").rlike("^(?:wall|floor|roof)_insulation(?:_|$)")
    library = given("library_derived", False)
    direct = F.when(insulation & ~library & given("doc_type", "").isin(*DIRECT_TYPES), 0).when(~library, 1).otherwise(2)
    main = F.col("tier") == "main"
    keys = [
        ~main, ~given("definitive", False), direct, given("is_global", False), ~(given("is_anchor", False) & ~F.col("field").isin(*ANCHOR_FIELDS)), F.col("source_rank"), given("hierarchy_rank", 50),
        -given("revision", -1.0), -F.unix_timestamp(F.date_trunc("hour", "study_date")), F.when(F.col("field") == "shab", -given("surface_priority", 0.0)).otherwise(0.0), -F.col("confidence"), F.col("seq"),
    ]
    order = F.struct(*[F.coalesce(k, F.lit(1 << 62)).alias(f"k{i}") if i == 8 else k.alias(f"k{i}") for i, k in enumerate(keys)])
    ok = occ.filter((F.col("tier") != "forbidden") & (F.col("confidence") >= ELIGIBLE))
    kept = F.struct("value", "doc_id", "tier", "source_rank", "confidence", "seq")
    n = F.when(F.count_if(main) > 0, F.count_if(main)).otherwise(F.count(F.lit(1)))
    return ok.groupBy("building", "field").agg(F.min_by(kept, order).alias("w"), n.alias("n_candidates")).select("building", "field", "n_candidates", "w.*")


def anchor_docs(readings: DataFrame, reference: DataFrame, fields: tuple[str, ...] = ANCHOR_FIELDS, tolerance: float = 0.011) -> DataFrame:
    """(building, doc_id): documents that have, for every anchor field of a building whose reference has them all, a value within the tolerance."""
    ref = reference.filter(F.col("field").isin(*fields)).groupBy("building", "field").agg(F.min("value").alias("_ref"))
    r = readings.filter(F.col("field").isin(*fields) & F.col("doc_id").isNotNull()).join(ref, ["building", "field"])
    near = F.abs(F.col("value") - F.col("_ref")) <= tolerance * F.greatest(F.lit(1.0), F.abs("_ref"))
    return r.filter(near).groupBy("building", "doc_id").agg(F.countDistinct("field").alias("n")).filter(F.col("n") == len(fields)).select("building", "doc_id")


def semantic_rank(doc_type: Column, method: Column, excerpt: Column) -> Column:
    """The place of a reading in its document, 1 (structured output) to 80 (a mere mention); 50 where nothing is known."""
    m, e = F.coalesce(method, F.lit("")), fold(F.coalesce(excerpt, F.lit("")))
    # Ranks by document type and pattern of the method, first match first.
    out = F.when(m.rlike("^xml:re2020:.*envelope"), 5).when(m.startswith("xml:re2020:"), 1).when(m.startswith("climawin:"), 2).when(m.startswith("recap-be:"), 12)
    chapters = [("rset:coefficient-direct|rset:detailed-output-(?:primary|cep)", 10), ("rset:(?:chapter4|equipment|generation)-", 15)]
    table = [
        (("RT2012",), "m", [("rt2012:chapter2-|rset:chapter2-|rset:rt2012-cep-table|rset:bbio-table", 5), *chapters, ("rset:(?:bbio|cep|cepnr)-summary-row", 25)]),
        (("RT2012",), "e", [("annexe|valeurs\\s+cles|synthese", 35)]), (("RT2012",), "m", [("generic:|tags:", 80), ("", 45)]),
        (("RSET_RE2020", "RSEE_RE2020"), "m", [("rset:chapter2-|rset:cep-table|rset:bbio-table|rset:dh-(?:row|explicit)", 5), *chapters, ("rset:carbon-(?:components|energy|site|lot|energy-post)-total|rsenv:(?:building|lot)-summary", 8), ("rset:(?:bbio|cep|cepnr)-summary-row", 25), ("generic:|tags:", 80), ("", 45)]),
        (("RSENV",), "m", [("rsenv:building-summary", 5), ("rsenv:lot-summary|rset:carbon-lot-", 10), ("rset:carbon-(?:components|energy|site)-total", 8), ("carbon:|parse-carbon|generic:|tags:", 70), ("", 40)]),
        (("CARBON",), "em", [("ic_|carbon|acv", 25), ("", 75)]), (("RT_EXISTING",), "em", [("patch:|rt-existing|cype|therm", 10)]), (("RT_EXISTING",), "m", [("generic:", 70), ("", 35)]),
    ]
    for types, of, rules in table:
        text = {"m": m, "e": e, "em": F.concat(e, m)}[of]
        for pattern, rank in rules:
            out = out.when(doc_type.isin(*types) & text.rlike(pattern), rank)
    return out.otherwise(50)


def prune_shadowed(facts: DataFrame) -> DataFrame:
    """Facts (doc_id, doc_type, field, method, validated) without weak readings of a field that the same document has a strong one for."""
    m = F.coalesce("method", F.lit(""))
    strong = F.when(F.col("doc_type") == "RSENV", m.rlike("^rsenv:(?:building|lot)-summary")).when(F.col("doc_type") == "RT2012", m.rlike("^rt2012:chapter2-|^rset:(?:chapter2-|bbio-table|rt2012-cep-table)"))
    weak = F.when(F.col("doc_type") == "RSENV", ~m.rlike("^rsenv:(?:building|lot)-summary")).when(F.col("doc_type") == "RT2012", m.rlike("rset:(?:bbio|cep|cepnr)-summary-row|generic:regulatory-label"))
    # By a window and not by a join of the facts with themselves, which would put all that they come from into the plan three times.
    of = Window.partitionBy("doc_id", "field")
    shadowed = F.coalesce(weak, F.lit(False)) & ~F.coalesce("validated", F.lit(False)) & F.max(F.coalesce(strong, F.lit(False))).over(of) & F.col("doc_id").isNotNull() & F.col("field").isNotNull()
    return facts.withColumn("_shadowed", shadowed).filter("not _shadowed").drop("_shadowed")


def learned_fill(candidates: DataFrame, finals: DataFrame, least: float = 0.85) -> DataFrame:
    """(building, field, value, precision) for fields without a final: the candidate of a main or secondary source with the best measured precision of at least so much."""
    ok = candidates.filter(F.col("tier").isin("main", "secondary") & (F.col("precision") >= least)).join(finals.select("building", "field"), ["building", "field"], "left_anti")
    order = F.struct(F.col("precision"), F.col("confidence"), (-F.col("seq")).alias("s"))
    return ok.groupBy("building", "field").agg(F.max_by(F.struct("value", "precision"), order).alias("w")).select("building", "field", "w.*")


def newest_only(readings: DataFrame, by: list[str], time: str = "study_date", hours: int = 1) -> DataFrame:
    """Readings within so many hours of the newest of their group, and those without a time."""
    newest = readings.groupBy(*by).agg(F.max(time).alias("_newest"))
    joined = readings.join(newest, by)
    return joined.filter(F.col(time).isNull() | (F.col(time) >= F.col("_newest") - F.make_interval(hours=F.lit(hours)))).drop("_newest")


def vote(finals: DataFrame, readings: DataFrame, gap: float = 0.15, fill: float = 0.85) -> DataFrame:
    """(building, field, value, p, change): finals after a vote of documents. A value of probability p replaces the final when it beats the final's own by gap, and fills an
    empty field from fill on; protected finals stay. change is replaced, filled or kept.

    finals: building, field, value, protected; readings: building, field, value, doc_id, weight (measured precision, or a prior).
    """
    p = noisy_or(readings)
    best = p.groupBy("building", "field").agg(F.max_by(F.struct("value", "p"), F.struct("p", "value")).alias("b")).select("building", "field", F.col("b.value").alias("_v"), F.col("b.p").alias("_p"))
    own = p.select("building", "field", "value", F.col("p").alias("_own"))
    j = finals.join(own, ["building", "field", "value"], "left").join(best, ["building", "field"], "full")
    beats = ~F.coalesce("protected", F.lit(False)) & F.col("value").isNotNull() & (F.col("_v") != F.col("value")) & (F.col("_p") >= F.coalesce("_own", F.lit(0.0)) + gap)
    change = F.when(F.col("value").isNull() & (F.col("_p") >= fill), "filled").when(beats, "replaced").when(F.col("value").isNotNull(), "kept")
    return j.withColumn("change", change).filter("change is not null").select("building", "field", F.when(F.col("change") == "kept", F.col("value")).otherwise(F.col("_v")).alias("value"), F.when(F.col("change") == "kept", F.col("_own")).otherwise(F.col("_p")).alias("p"), "change")


def wide(finals: DataFrame, fields: list[str], value: str = "value") -> DataFrame:
    """One row for each building, one column for each field of a fixed list."""
    return finals.groupBy("building").pivot("field", fields).agg(F.first(value))


def review_queue(occ: DataFrame, finals: DataFrame) -> DataFrame:
    """The best doubtful reading of every building and field without a value."""
    open_ = occ.filter((F.col("tier") != "forbidden") & (F.col("confidence") >= 0.65) & (F.col("confidence") < ELIGIBLE)).join(finals.select("building", "field"), ["building", "field"], "left_anti")
    order = F.struct(F.col("source_rank"), (-F.col("confidence")).alias("c"), F.col("seq"))
    return open_.groupBy("building", "field").agg(F.min_by(F.struct("value", "confidence", "seq"), order).alias("w")).select("building", "field", "w.*")


def overrides(finals: DataFrame, manual: DataFrame) -> DataFrame:
    """Finals with manual values laid over: reference-own, then reference, then own, then the last entry; the document's value stays beside."""
    order = F.struct((F.col("is_reference") & F.col("is_own")).alias("a"), F.col("is_reference").alias("b"), F.col("is_own").alias("c"), F.col("seq").alias("d"))
    best = manual.groupBy("building", "field").agg(F.max_by("value", order).alias("manual_value"))
    j = finals.select("building", "field", F.col("value").alias("doc_value")).join(best, ["building", "field"], "full")
    return j.withColumn("value", F.coalesce("manual_value", "doc_value"))


def noisy_or(readings: DataFrame, clip: float = 0.995) -> DataFrame:
    """(building, field, value, p, n_docs): 1 - product(1 - w) over documents, the largest weight of each document. The product is a sum of logarithms in decimals, so the order
    of rows changes no bit of it and equal weights give equal p."""
    per_doc = readings.groupBy("building", "field", "value", "doc_id").agg(F.max("weight").alias("w"))
    log = F.log(1 - F.least(F.col("w"), F.lit(clip))).cast("decimal(28,20)")
    return per_doc.groupBy("building", "field", "value").agg((1 - F.exp(F.sum(log).cast("double"))).alias("p"), F.count(F.lit(1)).alias("n_docs"))
