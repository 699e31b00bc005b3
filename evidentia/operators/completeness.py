"""How complete and how reliable an operation's values are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a document of each family should give; a group in brackets counts with any of its fields.
EXPECTED = {
    "rset": ["housing_count", "shab", "bbio", "bbio_max", "cep", "cep_max", "cepnr", "cepnr_max", "dh", "dh_max", "heating_vector_after", "ecs_vector_after"],
    "rt2012": ["housing_count", "shab", "bbio", "bbio_max", "cep", "cep_max", "tic", "tic_ref"],
    "thcex": ["shab", "ubat_before", "ubat_after", "cep_before", "cep_after_final", "heating_vector_before", "heating_vector_after"],
    "carbone": ["ic_components", "ic_site", "ic_energy", *[f"ic_lot_{i}" for i in range(1, 14)], "ic_energy_heating", "ic_energy_ecs"],
    "cctp": ["wall_insulation", "roof_insulation", "floor_insulation", "window_material", "window_glazing", "heating_mode_after", "ventilation"],
    "dpgf": ["wall_insulation", "roof_insulation", "window_material", "heating_mode_after", "ventilation"],
    "dpe": [["dpe_energy_before", "dpe_energy_after"], ["dpe_ges_before", "dpe_ges_after"]],
    "financier": ["internal_code"],
}


def document_status(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, expected, hit): of what documents (doc_id, families: array) should give, how much facts (doc_id, field) do; a group is hit by any of its fields."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit("|".join(e if isinstance(e, list) else [e])).alias("want"), F.lit(x).alias("field")) for f, wants in EXPECTED.items() for e in wants for x in (e if isinstance(e, list) else [e])]
    wanted = docs.select("doc_id", F.inline(F.filter(F.array(*rows), lambda r: F.array_contains("families", r["family"])))).select("doc_id", "want", "field").distinct()
    met = wanted.join(facts.select("doc_id", "field").distinct().withColumn("_in", F.lit(1)), ["doc_id", "field"], "left").groupBy("doc_id", "want").agg(F.max(F.coalesce("_in", F.lit(0))).alias("hit"))
    per = met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"), F.sum("hit").alias("hit"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("hit", F.lit(0)).alias("hit"))


def completion(rows: DataFrame, op: str, expected: list[str]) -> DataFrame:
    """(op, pct): the mean over buildings of the share of expected columns that are filled, in whole percent; halves, told from whole numbers, go up."""
    filled = sum((F.when(F.trim(F.col(c).cast("string")) != "", 1).otherwise(0) for c in expected), F.lit(0))
    half = F.count(F.lit(1)) * len(expected)
    g = rows.groupBy(op).agg((200 * F.sum(filled) + half).alias("_n"), F.nullif(2 * half, F.lit(0)).alias("_d"))
    return g.select(op, ((F.col("_n") - F.col("_n") % F.col("_d")) / F.col("_d")).cast("int").alias("pct"))


def levels(table: DataFrame, by: list[str], level: str, names: tuple[str, ...] = ("certified", "sure", "probable", "to-check")) -> DataFrame:
    """(by, one count for each level)."""
    return table.groupBy(*by).agg(*[F.count_if(F.col(level) == n).alias(n) for n in names])


def first_filled(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """(by, columns): of each column the first filled value in order; null where none is."""
    pick = lambda c: F.min_by(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.when(F.trim(F.col(c).cast("string")) != "", F.struct(*order)))
    return rows.groupBy(by).agg(*[pick(c).alias(c) for c in columns])


def only_in_reference(reference: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Buildings that the reference has and no document."""
    return reference.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")


def position(text: Column, at: Column) -> Column:
    """(line, column) of a character of a text, both from 0: line ends before it are counted."""
    head = F.substr(text, F.lit(1), at)
    line = F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.struct(line.alias("line"), (at - F.char_length(F.substring_index(head, "\n", -1))).alias("start"))
