"""Columns of tables by their headers: exact, by alias, by variant, by shared words; tagged sheets, operation rows, exports of a customer base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize

# Words that say nothing in a header, prefixes that may be left out, words that change the meaning.
STOP_WORDS = ("de", "du", "des", "la", "le", "les", "l", "d", "un", "une", "pour", "operation", "opportunite", "certification", "evaluation", "societe", "nom")
PREFIXES = ("operation", "opportunite", "certification", "evaluation", "operation evaluation", "nom de la societe", "maitre d ouvrage", "affaire", "contrat")
QUALIFIERS = ("max", "maximum", "min", "minimum", "seuil", "initial", "avant", "apres", "final", "projet", "ref", "reference", "2025", "2028", "2031")
LEAST_SCORE, MARGIN, TABLE_CONFIDENCE = 0.84, 0.08, 0.965


def header(c: Column) -> Column:
    """A header in one spelling."""
    s = F.regexp_replace(F.regexp_replace(normalize(c), "['’]", " "), "[^a-zA-Z0-9+&/,.-]+", " ")
    return F.lower(F.trim(F.regexp_replace(s, "\\s+", " ")))


def header_tokens(c: Column) -> Column:
    """The words of a header that say something."""
    words = F.split(F.regexp_replace(header(c), "[,:/.-]+", " "), "\\s+")
    return F.array_distinct(F.filter(words, lambda t: (F.char_length(t) > 1) & ~t.isin(*STOP_WORDS)))


def variants(c: Column) -> Column:
    """A header, and without each prefix it begins with, and without 'de l operation' and 'de la societe'."""
    h = header(c)
    cut = [F.when(h.startswith(p + " "), F.trim(F.substr(h, F.lit(len(p) + 2)))) for p in PREFIXES]
    bare = F.trim(F.regexp_replace(F.regexp_replace(h, "\\bde l operation\\b|\\bde la societe\\b", ""), "\\s+", " "))
    return F.array_distinct(F.filter(F.array_compact(F.array(h, *cut, bare)), lambda v: v != ""))


def match_headers(headers: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None, col: str = "header") -> DataFrame:
    """(header, field, mode, score) of distinct headers that match a field of the catalog (field, label: a label or tag, place: order of fields).

    exact 1, alias .99, a variant by label .97 or alias .96; else by words: .58 of the share of the smaller side and .42 of the Jaccard share, from .84 on and with .08 more than
    the second best label. Words that change the meaning (max, avant, 2028, ...) have to be on both sides. Headers meet labels on words they share, never all with all.
    """
    h = headers.select(F.col(col).alias("header")).filter("header is not null").distinct()
    known = catalog.select("field", "place", header(F.col("label")).alias("text")).filter("text <> ''")
    exact = known.groupBy("text").agg(F.min_by("field", "place").alias("field"))
    named = aliases.select(header(F.col("alias")).alias("text"), "field").groupBy("text").agg(F.min("field").alias("field")) if aliases is not None else exact.filter("false")
    keyed = h.select("header", F.posexplode(F.concat(F.array(header(F.col("header"))), variants(F.col("header")))).alias("at", "text"))
    found = keyed.join(exact, "text").select("header", "field", F.when(F.col("at") == 0, F.struct(F.lit(0).alias("o"), F.lit("exact").alias("mode"), F.lit(1.0).alias("score"))).otherwise(F.struct(F.lit(2).alias("o"), F.lit("normalized").alias("mode"), F.lit(0.97).alias("score"))).alias("m"), "at")
    found = found.unionByName(keyed.join(named, "text").select("header", "field", F.when(F.col("at") == 0, F.struct(F.lit(1).alias("o"), F.lit("alias").alias("mode"), F.lit(0.99).alias("score"))).otherwise(F.struct(F.lit(3).alias("o"), F.lit("alias").alias("mode"), F.lit(0.96).alias("score"))).alias("m"), "at"))
    sure = found.groupBy("header").agg(F.min_by(F.struct("field", "m.mode", "m.score"), F.struct("m.o", "at")).alias("w")).select("header", "w.*")

    labels = catalog.select("field", F.explode(variants(F.col("label"))).alias("text")).distinct().withColumn("lt", header_tokens(F.col("text"))).filter("size(lt) > 0")
    open_ = h.join(sure, "header", "left_anti").withColumn("ht", header_tokens(F.col("header"))).filter("size(ht) >= 2")
    met = open_.select("header", "ht", F.explode("ht").alias("w")).join(labels.select("field", "text", "lt", F.explode("lt").alias("w")), "w").select("header", "field", "text", "ht", "lt").distinct()
    fits = F.forall("ht", lambda t: ~t.isin(*QUALIFIERS) | F.array_contains("lt", t))
    both, either = F.size(F.array_intersect("ht", "lt")), F.size(F.array_union("ht", "lt"))
    scored = met.filter(fits).withColumn("score", 0.58 * both / F.least(F.size("ht"), F.size("lt")) + 0.42 * both / either)
    w = Window.partitionBy("header").orderBy(F.col("score").desc(), "field", "text")  # as many rows as labels share a word with a header
    best = scored.withColumn("r", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter("r = 1")
    fuzzy = best.filter((F.col("score") >= LEAST_SCORE) & (F.col("score") - F.col("second") >= MARGIN)).select("header", "field", F.lit("fuzzy").alias("mode"), "score")
    return sure.unionByName(fuzzy)


def tagged_sheets(cells: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None, by: str = "doc_id", within: int = 12, least: int = 2) -> DataFrame:
    """(by, row, field, value, confidence): values below the header of each sheet, cells (by, row, col, text). The header is the row with most recognised columns among
    the first twelve, the first of equals, with two at least; a field given by several columns is read from the first.
    """
    head = cells.filter(F.col("row") < within)
    known = head.join(match_headers(head, catalog, aliases, "text"), F.col("text") == F.col("header")).select(by, "row", "col", "field")
    rows = known.groupBy(by, "row").agg(F.countDistinct("field").alias("n")).filter(F.col("n") >= least)
    top = rows.groupBy(by).agg(F.max_by("row", F.struct("n", (-F.col("row")).alias("r"))).alias("_head"))
    cols = known.join(top.hint("merge"), by).filter("row = _head").groupBy(by, "_head", "field").agg(F.min("col").alias("col"))
    return cells.join(cols.hint("merge"), [by, "col"]).filter((F.col("row") > F.col("_head")) & (F.trim("text") != "")).select(by, "row", "field", F.trim("text").alias("value"), F.lit(TABLE_CONFIDENCE).alias("confidence"))


def operation_rows(values: DataFrame, existing: DataFrame, by: str = "doc_id") -> DataFrame:
    """(operation, building, field, value, change) of values (by, row, field, value) as of tagged_sheets, laid over existing (operation, building, field, value).

    A row's operation is its contract number, padded, or else its internal code; its building its building field. Blanks are filled; where a value differs from what is there it is a conflict, to be confirmed, and the old one stays.
    """
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    at = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    keys = values.groupBy(by, "row").agg(at("contract_number").alias("c"), at("internal_code").alias("i"), at("building").alias("building"))
    contract = F.when(F.char_length(digits(F.col("c"))).between(1, 8), F.lpad(digits(F.col("c")), 8, "0"))
    keys = keys.select(by, "row", F.coalesce(contract, "i").alias("operation"), F.coalesce("building", F.lit("Bâtiment unique")).alias("building")).filter("operation is not null")
    new = values.filter(~F.col("field").isin("contract_number", "internal_code", "building")).join(keys.hint("merge"), [by, "row"]).groupBy("operation", "building", "field").agg(F.min_by("value", F.struct(by, "row")).alias("new"))
    j = new.join(existing.select("operation", "building", "field", F.col("value").alias("old")), ["operation", "building", "field"], "full")
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull() | (F.trim("old") == ""), "filled").when(F.col("old") == F.col("new"), "kept").otherwise("conflict")
    return j.select("operation", "building", "field", F.when(change == "filled", F.col("new")).otherwise(F.col("old")).alias("value"), change.alias("change"))


# What the columns of an export of the customer base are called.
ROLES = {
    "contract": "num[e]?e?ro du contrat|^contrat$", "code": "(?:^|: )code interne$", "status": "evaluation: statut$", "buildings": "(?:^|: )(?:total (?:des )?batiments|nombre (?:de |des )?batiments|nb (?:de )?batiments)$",
    "street": "(?:^|: )(?:rue|adresse|voie|(?:adresse|rue) de l'? ?operation)$", "city": "(?:^|: )(?:ville|commune|ville de l'? ?operation)$", "postcode": "(?:^|: )code postal",
}


def role(text: Column) -> Column:
    """The role of a column of an export by its header; null for others."""
    t = F.lower(normalize(text))
    out = F.when(t.rlike(ROLES["contract"]), "contract")
    for name, pattern in list(ROLES.items())[1:]:
        out = out.when(t.rlike(pattern), name)
    return out


def export_records(cells: DataFrame, by: str = "doc_id", within: int = 40) -> DataFrame:
    """(by, row, contract, code, status, street, city, postcode, buildings) of cells (by, row, col, text): the header is the first of forty rows with a contract or code column, else the first row.

    Contracts are up to eight digits, padded; codes look like OPE-000000; postcodes of four digits get a zero; others are null. buildings is a count above 0.
    """
    r = cells.withColumn("role", role(F.col("text")))
    head = r.filter(F.col("row") < within).groupBy(by).agg(F.min(F.when(F.col("role").isin("contract", "code"), F.col("row"))).alias("h"), F.min("row").alias("first")).select(by, F.coalesce("h", "first").alias("_head"))
    # A sheet is many cells of a small table, so estimates would broadcast rows for every sheet: these joins are merged.
    cols = r.join(head.hint("merge"), by).filter("row = _head and role is not null").groupBy(by, "_head", "role").agg(F.min("col").alias("col"))
    held = cells.join(cols.hint("merge"), [by, "col"]).filter("row > _head").groupBy(by, "row").pivot("role", list(ROLES)).agg(F.first("text"))
    solid = lambda c: F.regexp_replace(c, "\\s", "")
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, "\\s+", " ")), F.lit(""))
    code = F.lpad(solid(F.col("postcode")), 5, "0")
    n = F.floor(F.translate(solid(F.col("buildings")), ",", ".").try_cast("double")).cast("int")
    return held.select(
        by, "row", F.when(solid(F.col("contract")).rlike("^[0-9]{1,8}$"), F.lpad(solid(F.col("contract")), 8, "0")).alias("contract"), F.when(F.trim("code").rlike("^OPE-[0-9]{6}$"), F.trim("code")).alias("code"), tidy(F.col("status")).alias("status"),
        tidy(F.col("street")).alias("street"), tidy(F.col("city")).alias("city"), F.when(solid(F.col("postcode")).rlike("^[0-9]{4,5}$"), code).alias("postcode"), F.when(n > 0, n).alias("buildings"),
    )


def contract_column(cells: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, contract) of a pasted table: distinct contract numbers of the column that has most of them, the first of equals."""
    key = F.when(F.regexp_replace("text", "\\s", "").rlike("^[0-9]{3,8}$"), F.lpad(F.regexp_replace("text", "\\s", ""), 8, "0"))
    k = cells.withColumn("contract", key).filter("contract is not null")
    col = k.groupBy(by, "col").agg(F.countDistinct("contract").alias("n")).groupBy(by).agg(F.max_by("col", F.struct("n", (-F.col("col")).alias("c"))).alias("_col"))
    return k.join(col.hint("merge"), by).filter("col = _col").select(by, "contract").distinct()
