"""Queries on texts: numbers, rules, tags, classes, search, quality, links; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, spread, table
from ..functions import numbers
from ..functions.text import fold
from ..operators import extract, search
from ..sources import formats

_FOLDED = "lower(strip_accents(text))"


@register("numbers_parsed", rf"""WITH r AS (SELECT doc_id, regexp_extract(text, '{numbers.NUMBER}', 0) AS raw, list_filter(regexp_extract_all({_FOLDED}, '{numbers._CHUNK}'), lambda x: regexp_matches(x, '{numbers._PLAIN}')) AS found FROM documents)
SELECT doc_id, CASE WHEN raw <> '' AND length(regexp_replace(raw, '[^.,]', '', 'g')) <= 1 THEN try_cast(translate(raw, ',−{numbers._SPACES}', '.-') AS DOUBLE) END AS first_number, len(found) AS n_numbers FROM r""")  # fmt: skip
def numbers_parsed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", numbers.fr_number(F.col("text")).alias("first_number"), F.size(numbers.numbers_in(F.col("text"))).cast("bigint").alias("n_numbers"))


@register("string_formats", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(1 + c_custkey % 26 AS DOUBLE) ELSE round(c_custkey % 9 + (c_custkey % 100) / 100.0::DOUBLE, 2) END AS revision,
  lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS contract, (4 + c_nationkey) || '.16.4 Ar' AS glazing, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS postcode, 'Ville ' || c_mktsegment AS commune, date '2020-01-01' + CAST(c_custkey % 365 AS INTEGER) AS file_date FROM customer""")  # fmt: skip
def string_formats(spark, sf_dir):
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 365).cast("int"))
    name = F.when(k % 2 == 0, F.concat(F.lit("Plan_IND_"), F.chr(65 + k % 26), F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit(".pdf"))).otherwise(F.concat(F.lit("Plan_V"), s(k % 9), F.lit("."), F.lpad(s(k % 100), 2, "0"), F.lit("_"), F.date_format(day, "dd-MM-yyyy"), F.lit(".pdf")))
    c = table(spark, sf_dir, "customer").withColumn("name", name)
    glass = F.concat(s(F.col("c_nationkey") + 4), F.lit(" / 16/4 argon"))
    line = numbers.postal(F.concat(F.lit("1 rue A, "), F.lpad(s(k % 100000), 5, "0"), F.lit(" Ville "), F.col("c_mktsegment")))
    return c.select("c_custkey", numbers.revision(F.col("name")).alias("revision"), numbers.contract_key(F.concat(F.lit("N° "), s(k))).alias("contract"), numbers.glazing(glass).alias("glazing"), line["postcode"].alias("postcode"), line["commune"].alias("commune"), numbers.iso_date(F.col("name")).alias("file_date"))


RULES = [
    extract.Rule("licence", "licence", "License, [Vv]ersion ([0-9.]+)", confidence=0.95),
    extract.Rule("token", "token", 'token = "([0-9a-f]+)"', kind="text", selection="all"),
    extract.Rule("phone", "phone", "\\+1 \\(([0-9]{3})\\)", selection="max"),
    extract.Rule("mail", "mail", "([a-z0-9.]+@[a-z0-9.]+[a-z0-9])", kind="text", selection="all", max_matches=3),
    extract.Rule("open", "status", kind="constant", constant="open", require_any=("license",), forbid_any=("token =",)),
]


@register("rule_facts", rf"""WITH f AS (
  SELECT doc_id, 'licence' AS rule, '' AS v, regexp_extract(text, 'License, [Vv]ersion ([0-9.]+)', 1) AS raw FROM documents WHERE regexp_matches(text, 'License, [Vv]ersion ([0-9.]+)')),
n AS (SELECT doc_id, rule, CAST(regexp_extract(raw, '[0-9]+([.][0-9]+)*', 0) AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS value_text FROM f WHERE length(regexp_replace(regexp_extract(raw, '[0-9]+([.][0-9]+)*', 0), '[^.]', '', 'g')) <= 1)
SELECT * FROM n
UNION ALL SELECT doc_id, 'token', NULL, unnest(list_slice(regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1), 1, 20)) FROM documents
UNION ALL SELECT doc_id, 'mail', NULL, unnest(list_slice(regexp_extract_all(text, '([a-z0-9.]+@[a-z0-9.]+[a-z0-9])', 1), 1, 3)) FROM documents
UNION ALL SELECT doc_id, 'phone', max(CAST(p AS DOUBLE)), NULL FROM (SELECT doc_id, unnest(list_slice(regexp_extract_all(text, '\+1 \(([0-9]{{3}})\)', 1), 1, 20)) AS p FROM documents) GROUP BY doc_id
UNION ALL SELECT doc_id, 'open', NULL, 'open' FROM documents WHERE contains({_FOLDED}, 'license') AND NOT contains({_FOLDED}, 'token =')""")  # fmt: skip
def rule_facts(spark, sf_dir):
    return extract.facts(table(spark, sf_dir, "documents"), RULES).select("doc_id", "rule", "value_num", "value_text")


def order_sheets(spark, sf_dir):
    """Orders as texts of labelled lines."""
    o = table(spark, sf_dir, "orders")
    text = F.concat_ws("\n", F.lit("Fiche"), F.concat(F.lit("État : "), "o_orderstatus"), F.lit("Priorité ="), F.col("o_orderpriority"), F.concat(F.lit("Client = "), F.col("o_custkey").cast("string")))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


@register("tagged_scan", """SELECT o_orderkey AS doc_id, 'state' AS field, 1 AS idx, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', 2, o_orderpriority FROM orders
UNION ALL SELECT o_orderkey, 'customer', 4, CAST(o_custkey AS VARCHAR) FROM orders""")  # fmt: skip
def tagged_scan(spark, sf_dir):
    tags = {"state": ["état", "etat"], "priority": ["priorité", "priorite"], "customer": ["client"]}
    return extract.tagged(order_sheets(spark, sf_dir), tags).drop("confidence")


@register("key_values", """SELECT o_orderkey AS doc_id, 1 AS idx, 'etat' AS label, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 4, 'client', CAST(o_custkey AS VARCHAR) FROM orders""")
def key_values(spark, sf_dir):
    return formats.key_values(order_sheets(spark, sf_dir), "doc_id", "text")


SCORES = [("en", "the", 3), ("en", "tion", 1), ("de", "sch", 4), ("de", "lich", 2), ("fr", "eau", 4), ("fr", "ouest", 1), ("es", "cion", 4), ("es", "que ", 1)]
DAMPING = [("en", "sch", 0.5), ("fr", "cion", 0.25)]


def _score_sql(kind: str) -> str:
    s = " + ".join(f"CASE WHEN regexp_matches(n, '{p}') THEN {w}.0::DOUBLE ELSE 0 END" for t, p, w in SCORES if t == kind)
    return f"({s})" + "".join(f" * CASE WHEN regexp_matches(n, '{p}') THEN {w}::DOUBLE ELSE 1 END" for t, p, w in DAMPING if t == kind)


@register("classify_winner", f"""WITH d AS (SELECT doc_id, {_FOLDED} AS n FROM documents), s AS (SELECT doc_id, unnest(['de', 'en', 'es', 'fr']) AS t, unnest([{', '.join(_score_sql(t) for t in ('de', 'en', 'es', 'fr'))}]) AS score FROM d)
SELECT doc_id, CASE WHEN score > 0 THEN t ELSE 'generic' END AS doc_type, round(score, 6) AS score, CASE WHEN score > 0 THEN round(least(0.98::DOUBLE, 0.4::DOUBLE + score / 20), 6) ELSE 0 END AS confidence FROM s
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, t) = 1""")  # fmt: skip
def classify_winner(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("n"))
    c = d.select("doc_id", extract.classify(F.col("n"), SCORES, DAMPING).alias("c"))
    return c.select("doc_id", "c.doc_type", F.round("c.score", 6).alias("score"), F.round("c.confidence", 6).alias("confidence"))


GRID = [
    search.Criterion("licence", "law", ("license",), exclude=("gnu",), inferred=True),
    search.Criterion("version", "law", ("version",), kind="number", low=2, high=2.5, required=True),
    search.Criterion("near", "text", ("the",), context=("license",), window=1),
]
_LINES = f"l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS t FROM (SELECT doc_id, string_split(coalesce({_FOLDED}, ''), chr(10)) AS a FROM documents))"
_HAS = lambda t, *words: f"regexp_matches({t}, '{'|'.join(f'(?:{search.term_pattern(w)})' for w in words)}')"


@register("search_grid_status", rf"""WITH {_LINES}, w AS (SELECT *, concat_ws(chr(10), lag(t) OVER o, t, lead(t) OVER o) AS near FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, {_HAS('t', 'license')} AND NOT {_HAS('t', 'gnu')} AS a, {_HAS('t', 'version')} AND len(list_filter(list_filter(regexp_extract_all(t, '{numbers._CHUNK}'), lambda x: regexp_matches(x, '{numbers._PLAIN}')), lambda x: try_cast(translate(x, ',{numbers._SPACES}', '.') AS DOUBLE) BETWEEN 2 AND 2.5)) > 0 AS b, {_HAS('t', 'the')} AND {_HAS('near', 'license')} AS c FROM w),
g AS (SELECT doc_id, min(i) FILTER (a) AS a, min(i) FILTER (b) AS b, min(i) FILTER (c) AS c FROM h GROUP BY 1)
SELECT doc_id, 'licence' AS criterion, CASE WHEN a IS NULL THEN 'ABSENT_INFERRED' ELSE 'PRESENT' END AS status, CAST(a AS INTEGER) AS first_line FROM g
UNION ALL SELECT doc_id, 'version', CASE WHEN b IS NULL THEN 'NOT_GIVEN' ELSE 'PRESENT' END, CAST(b AS INTEGER) FROM g UNION ALL SELECT doc_id, 'near', CASE WHEN c IS NULL THEN 'UNDETERMINED' ELSE 'PRESENT' END, CAST(c AS INTEGER) FROM g""")  # fmt: skip
def search_grid_status(spark, sf_dir):
    return search.grid(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), GRID).select("doc_id", "criterion", "status", "first_line")


@register("text_quality", rf"""WITH d AS (SELECT doc_id, {_FOLDED} AS n, length(regexp_replace(text, '\s', '', 'g')) AS solid, list_filter(string_split_regex({_FOLDED}, '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT doc_id, length(regexp_replace(n, '[^a-z0-9]', '', 'g')) / solid::DOUBLE AS alnum, length(regexp_replace(n, '[a-z0-9\s.,;:''()%/-]', '', 'g')) / solid::DOUBLE AS symbols, len(list_filter(w, lambda x: x IN ({', '.join(f"'{c}'" for c in formats.COMMON)}))) / nullif(len(w), 0)::DOUBLE AS common FROM d)
SELECT doc_id, round(alnum, 6) AS alnum, round(symbols, 6) AS symbols, round(coalesce(common, 0), 6) AS common, coalesce(common < 0.02 OR symbols > 0.12, false) AS garbled FROM q""")  # fmt: skip
def text_quality(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", formats.quality(F.col("text")).alias("q"))
    return q.select("doc_id", *[F.round(f"q.{c}", 6).alias(c) for c in ("alnum", "symbols", "common")], "q.garbled")


@register("page_links", """SELECT page_id, generate_subscripts(a, 1) - 1 AS idx, unnest(a) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)""")
def page_links(spark, sf_dir):
    return formats.html_links(table(spark, sf_dir, "pages"), "page_id", "html").withColumn("idx", F.col("idx").cast("bigint"))


_ASKED = ["thation", "ouest"]
_IN = lambda w: f"regexp_matches(n, '(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)')"


@register("free_search_scored", rf"""WITH {_LINES}, m AS (SELECT doc_id, i, t, {' , '.join(f"CASE WHEN regexp_matches(t, '(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)') THEN 1 ELSE 0 END AS w{k}" for k, w in enumerate(_ASKED))} FROM l),
c AS (SELECT doc_id, i, t, {', '.join(f'max(w{k}) OVER o AS c{k}' for k in range(len(_ASKED)))}, string_agg(t, ' | ') OVER o AS x FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
s AS (SELECT *, (c0 + c1) / 2.0::DOUBLE AS share FROM c WHERE c0 + c1 >= 1),
masked AS (SELECT *, regexp_replace(t, '\br[et] ?20[0-9]{{2}}\b|\bv[0-9]+(?:\.[0-9]+)+\b', 'x', 'g') AS mt, regexp_replace(x, '\br[et] ?20[0-9]{{2}}\b|\bv[0-9]+(?:\.[0-9]+)+\b', 'x', 'g') AS mx FROM s),
v AS (SELECT *, regexp_matches(t, '^(?:chapitre|section|partie) [0-9]+\b|^[0-9]+(?:\.[0-9]+)+\.?\s+|logiciel et version|version\s*:') AS heading,
  coalesce(list_filter(regexp_extract_all(mt, '{numbers._CHUNK}'), lambda z: regexp_matches(z, '{numbers._PLAIN}'))[-1], list_filter(regexp_extract_all(mx, '{numbers._CHUNK}'), lambda z: regexp_matches(z, '{numbers._PLAIN}'))[-1]) AS raw FROM masked),
r AS (SELECT doc_id, i, CASE WHEN NOT heading THEN try_cast(translate(raw, ',{numbers._SPACES}', '.') AS DOUBLE) END AS value, share, heading FROM v),
b AS (SELECT *, CASE WHEN value IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN share >= 0.99 THEN 0.06::DOUBLE ELSE 0 END AS bonus FROM r),
k AS (SELECT doc_id, i, value, share + bonus - CASE WHEN heading THEN 0.18::DOUBLE ELSE 0 END AS score, least(0.98::DOUBLE, 0.46::DOUBLE + 0.46::DOUBLE * share + bonus) AS confidence FROM b)
SELECT doc_id, CAST(i AS INTEGER) AS idx, value, round(score, 6) AS score, round(confidence, 6) AS confidence FROM k WHERE confidence >= 0.9::DOUBLE - 1e-9 QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY round(score, 9) DESC, round(confidence, 9) DESC, i) = 1
ORDER BY round(score, 9) DESC, round(confidence, 9) DESC, doc_id, i LIMIT 150""")  # fmt: skip
def free_search_scored(spark, sf_dir):
    found = search.free_search(table(spark, sf_dir, "documents"), " ".join(_ASKED))
    return found.select("doc_id", "idx", "value", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def _security(spark, sf_dir):
    """Short descriptions, one of six kinds."""
    k = F.col("o_orderkey") % 6
    n = F.format_string("%.0f", (F.col("o_custkey") % 40).cast("double"))
    texts = ["Porte A2P BP1\nfin", "Porte A2P seule", "Porte d'escalier A2P BP1\nsans condamnation", "Hauteur de clôture :\n2 m", "Sans porte A2P", "Barrière Heras\nclôture de 2 m"]
    text = F.element_at(F.array(*map(F.lit, texts)), (k + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", text, F.concat(F.lit("Éclairement du hall : "), n, F.lit(" lux"))).alias("text"))


SECURITY = [
    search.Criterion("door", "doors", ("porte",), weak=("a2p",), all_of=("a2p", "bp1"), contrary_near=("sans condamnation",), negative=("sans porte",), window=1, required=True),
    search.Criterion("fence", "outside", ("cloture",), exclude_near=("heras",), kind="number", low=1.8, unit="m"),
    search.Criterion("light", "inside", ("re:hall : ([0-9]+) lux",), kind="stats", low=10),
    search.Criterion("temporary", "outside", ("heras",), inverse=True),
]


@register("search_grid_policies", """WITH o AS (SELECT o_orderkey AS d, o_orderkey % 6 AS k, o_custkey % 40 AS n FROM orders)
SELECT d AS doc_id, 'door' AS criterion, CASE WHEN k = 0 THEN 'PRESENT' WHEN k = 4 THEN 'ABSENT_EXPLICIT' ELSE 'UNDETERMINED' END AS status, k IN (1, 2) AS contrary, 0 AS n_values FROM o
UNION ALL SELECT d, 'fence', CASE WHEN k = 3 THEN 'PRESENT' ELSE 'NOT_GIVEN' END, false, CASE WHEN k = 3 THEN 1 ELSE 0 END FROM o
UNION ALL SELECT d, 'light', CASE WHEN n >= 10 THEN 'PRESENT' ELSE 'NOT_GIVEN' END, false, CASE WHEN n >= 10 THEN 1 ELSE 0 END FROM o
UNION ALL SELECT d, 'temporary', 'UNDETERMINED', k = 5, 0 FROM o""")  # fmt: skip
def search_grid_policies(spark, sf_dir):
    return search.grid(_security(spark, sf_dir), SECURITY).select("doc_id", "criterion", "status", "contrary", F.size("values").alias("n_values"))


@register("search_themes_gated", """WITH o AS (SELECT o_orderkey AS d, o_orderkey % 6 AS k, o_custkey % 40 AS n FROM orders)
SELECT d AS doc_id, 'doors' AS theme, CASE WHEN k = 0 THEN 1 ELSE 0 END AS n_found, k = 0 AS ok FROM o UNION ALL SELECT d, 'outside', CASE WHEN k = 3 THEN 1 ELSE 0 END, CASE WHEN n >= 10 THEN k = 3 END FROM o UNION ALL SELECT d, 'inside', CASE WHEN n >= 10 THEN 1 ELSE 0 END, n >= 10 FROM o""")  # fmt: skip
def search_themes_gated(spark, sf_dir):
    return search.themes(search.grid(_security(spark, sf_dir), SECURITY), applicable_if={"outside": "light"})
