"""The reference's operators as queries over the driver's tables, each with its SQL twin.

Roles of the tables: events are readings (a user's building, an event type as field), documents are lines, orders and line items
are facts with reference totals, names of nations and suppliers are entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import register, table
from ..functions.text import fold, share, tokens, value_key
from ..operators import checks, fusion, joins, routing, stats
from ..sources.lines import lines, sentence_block, with_context

FIELDS = ["click", "error", "purchase", "signup", "view"]
# The demonstration's source rules (document type, tier, rank).
RULES = [("T0", "main", 0), ("T1", "main", 1), ("T2", "secondary", 0), ("T3", "forbidden", 0), ("T4", "forbidden", 0), ("T4", "main", 2)]

OCC_SQL = """
occ AS (
  SELECT event_type AS field, 'B' || (user_id % 20) AS building, 5 * floor(value / 5) AS value,
    'T' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 6) AS doc_type, 'D' || (CAST(json_extract_string(props, '$.k') AS BIGINT)) AS doc_id,
    event_id % 3 AS page, 'x' || (event_id % 2) AS excerpt, CAST(0.8 AS DOUBLE) + (event_id % 20) / 100.0::DOUBLE AS confidence, ts AS study_date, event_id AS seq
  FROM events),
rules(doc_type, f, m, s) AS (VALUES ('T0', 0, 0, NULL), ('T1', 0, 1, NULL), ('T2', 0, NULL, 0), ('T3', 1, NULL, NULL), ('T4', 1, 2, NULL)),
routed AS (
  SELECT o.*, CASE WHEN r.f = 1 THEN 'forbidden' WHEN r.m IS NOT NULL THEN 'main' WHEN r.s IS NOT NULL THEN 'secondary' ELSE 'unrouted' END AS tier,
    CASE WHEN r.m IS NOT NULL THEN r.m WHEN r.s IS NOT NULL THEN 100 + r.s WHEN r.f = 1 THEN 10000 ELSE 1000 END AS source_rank
  FROM occ o LEFT JOIN rules r ON o.doc_type = r.doc_type),
weighed AS (
  SELECT * REPLACE (greatest(0, least(1, confidence + CASE tier WHEN 'main' THEN 0.05::DOUBLE WHEN 'secondary' THEN -0.03::DOUBLE WHEN 'forbidden' THEN -0.5::DOUBLE ELSE -0.1::DOUBLE END)) AS confidence) FROM routed),
agreed AS (
  SELECT w.* REPLACE (least(1, w.confidence + CASE WHEN n >= 3 THEN 0.05::DOUBLE WHEN n >= 2 THEN 0.03::DOUBLE ELSE 0::DOUBLE END) AS confidence), n AS agreement
  FROM weighed w JOIN (SELECT building, field, value, count(DISTINCT doc_id) AS n FROM weighed GROUP BY ALL) USING (building, field, value)),
deduped AS (
  SELECT * FROM agreed QUALIFY row_number() OVER (PARTITION BY field, value, building, doc_id, page, excerpt ORDER BY confidence DESC, seq) = 1),
pooled AS (
  SELECT * FROM (SELECT *, max(CASE WHEN tier = 'main' THEN 1 ELSE 0 END) OVER (PARTITION BY building, field) AS has_main
    FROM deduped WHERE tier <> 'forbidden' AND confidence >= 0.9) WHERE has_main = 0 OR tier = 'main'),
finals AS (
  SELECT *, count(*) OVER (PARTITION BY building, field) AS n_candidates FROM pooled
  QUALIFY row_number() OVER (PARTITION BY building, field ORDER BY source_rank, date_trunc('hour', study_date) DESC, confidence DESC, seq) = 1)
"""


def occurrences(spark: SparkSession, sf_dir: str, building: Column | None = None) -> DataFrame:
    """Events as occurrences; building is an expression on events, one of twenty buildings unless given."""
    if building is None:
        building = F.concat(F.lit("B"), (F.col("user_id") % 20).cast("string"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf_dir, "events")
    value = 5 * F.floor(F.col("value") / 5).cast("double")
    return e.select(
        F.col("event_type").alias("field"), building.alias("building"), value.alias("value"), value_key(value, F.lit(None)).alias("value_key"),
        F.concat(F.lit("T"), (k % 6).cast("string")).alias("doc_type"), F.concat(F.lit("D"), k.cast("string")).alias("doc_id"), (F.col("event_id") % 3).alias("page"),
        F.concat(F.lit("x"), (F.col("event_id") % 2).cast("string")).alias("excerpt"), (F.lit(0.8) + (F.col("event_id") % 20) / F.lit(100.0)).alias("confidence"), F.col("ts").alias("study_date"), F.col("event_id").alias("seq"),
    )


def routed(spark: SparkSession, sf_dir: str, building: Column | None = None) -> DataFrame:
    rules = spark.createDataFrame([(f, *r) for f in FIELDS for r in RULES], "field string, doc_type string, tier string, rank int")
    return routing.route(occurrences(spark, sf_dir, building), rules)


def agreed(spark: SparkSession, sf_dir: str, building: Column | None = None) -> DataFrame:
    r = routed(spark, sf_dir, building)
    return routing.with_agreement(r.withColumn("confidence", routing.tier_confidence(F.col("tier"), F.col("confidence"))))


@register("route_tiers", f"WITH {OCC_SQL} SELECT seq, field, doc_type, tier, CAST(source_rank AS INTEGER) AS source_rank FROM routed")
def route_tiers(spark, sf_dir):
    return routed(spark, sf_dir).select("seq", "field", "doc_type", "tier", "source_rank")


@register("agreement_boost", f"WITH {OCC_SQL} SELECT seq, agreement, round(confidence, 6) AS confidence FROM agreed")
def agreement_boost(spark, sf_dir):
    return agreed(spark, sf_dir).select("seq", "agreement", F.round("confidence", 6).alias("confidence"))


@register("dedup_best", f"WITH {OCC_SQL} SELECT seq, field, building, value FROM deduped")
def dedup_best(spark, sf_dir):
    return routing.dedup(agreed(spark, sf_dir)).select("seq", "field", "building", "value")


def finals(spark, sf_dir):
    return fusion.winners(routing.dedup(agreed(spark, sf_dir)))


@register("fuse_winner", f"WITH {OCC_SQL} SELECT building, field, value, doc_id, tier, seq, n_candidates FROM finals")
def fuse_winner(spark, sf_dir):
    return finals(spark, sf_dir).select("building", "field", "value", "doc_id", "tier", "seq", "n_candidates")


@register("flagship_wide", f"WITH {OCC_SQL} SELECT building, {', '.join(f'''max(CASE WHEN field = '{f}' THEN value END) AS "{f}"''' for f in FIELDS)} FROM finals GROUP BY building")
def flagship_wide(spark, sf_dir):
    return fusion.wide(finals(spark, sf_dir), FIELDS)


# The same readings of many small buildings, so that some fields have doubtful readings only.
SMALL_SQL = OCC_SQL.replace("'B' || (user_id % 20)", "'B' || user_id || '-' || (event_id % 40)")


@register("review_queue", f"""WITH {SMALL_SQL} SELECT building, field, value, seq FROM (
  SELECT * FROM deduped d WHERE tier <> 'forbidden' AND confidence >= 0.65 AND confidence < 0.9 AND NOT EXISTS (SELECT 1 FROM finals f WHERE f.building = d.building AND f.field = d.field))
  QUALIFY row_number() OVER (PARTITION BY building, field ORDER BY source_rank, confidence DESC, seq) = 1""")  # fmt: skip
def review_queue(spark, sf_dir):
    small = F.concat(F.lit("B"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 40).cast("string"))
    occ = routing.dedup(agreed(spark, sf_dir, small))
    return fusion.review_queue(occ, fusion.winners(occ)).select("building", "field", "value", "seq")


@register("override_priority", f"""WITH {OCC_SQL}, manual AS (
  SELECT 'B' || (o_custkey % 25) AS building, CASE o_orderkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'signup' END AS field, o_totalprice AS value,
    o_orderstatus = 'F' AS is_reference, o_orderkey % 2 = 0 AS is_own, o_orderkey AS seq FROM orders),
best AS (SELECT * FROM manual QUALIFY row_number() OVER (PARTITION BY building, field ORDER BY (is_reference AND is_own) DESC, is_reference DESC, is_own DESC, seq DESC) = 1)
SELECT coalesce(f.building, b.building) AS building, coalesce(f.field, b.field) AS field, f.value AS doc_value, b.value AS manual_value, coalesce(b.value, f.value) AS value
FROM finals f FULL JOIN best b ON f.building = b.building AND f.field = b.field""")  # fmt: skip
def override_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    manual = o.select(F.concat(F.lit("B"), (F.col("o_custkey") % 25).cast("string")).alias("building"), F.when(F.col("o_orderkey") % 3 == 0, "click").when(F.col("o_orderkey") % 3 == 1, "view").otherwise("signup").alias("field"),
                      F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("is_reference"), (F.col("o_orderkey") % 2 == 0).alias("is_own"), F.col("o_orderkey").alias("seq"))
    return fusion.overrides(finals(spark, sf_dir), manual).select("building", "field", "doc_value", "manual_value", "value")


@register("noisy_or_vote", f"""WITH {OCC_SQL}, d AS (SELECT building, field, value, doc_id, max(confidence * 0.5::DOUBLE) AS w FROM occ GROUP BY ALL)
SELECT building, field, value, round(1 - product(1 - least(w, 0.995::DOUBLE)), 9) AS p, count(*) AS n_docs FROM d GROUP BY ALL""")  # fmt: skip
def noisy_or_vote(spark, sf_dir):
    r = occurrences(spark, sf_dir).withColumn("weight", F.col("confidence") * 0.5)
    return fusion.noisy_or(r).withColumn("p", F.round("p", 9))


LINES_SQL = "lines AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS idx, unnest(a) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))"


@register("lines_folded", f"WITH {LINES_SQL} SELECT doc_id, idx, lower(strip_accents(text)) AS norm FROM lines")
def lines_folded(spark, sf_dir):
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "idx", "norm")


@register("context_windows", f"""WITH {LINES_SQL} SELECT doc_id, idx, string_agg(text, ' | ') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM lines""")
def context_windows(spark, sf_dir):
    return with_context(table(spark, sf_dir, "documents"), 2, 2).select("doc_id", "idx", "context")


@register("sentence_blocks", f"""WITH {LINES_SQL}, n AS (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS nx FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, CASE WHEN p IS NOT NULL AND rtrim(p, ' ') LIKE '%:' THEN p || ' ' || text
  WHEN NOT regexp_matches(rtrim(text, ' '), '[.:;]$') AND nx IS NOT NULL AND NOT regexp_matches(nx, '^\\s*[0-9]+[.)]') THEN text || ' ' || nx ELSE text END AS block FROM n""")  # fmt: skip
def sentence_blocks(spark, sf_dir):
    return sentence_block(table(spark, sf_dir, "documents")).select("doc_id", "idx", "block")


QUERY_WORDS = ["thation", "the", "er"]


@register("free_search_topk", f"""WITH {LINES_SQL}, t AS (SELECT doc_id, idx, list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS w FROM lines),
s AS (SELECT doc_id, idx, len(list_intersect(w, {QUERY_WORDS})) / 3.0::DOUBLE AS share FROM t)
SELECT doc_id, idx, round(least(0.98::DOUBLE, 0.46::DOUBLE + 0.46::DOUBLE * share), 6) AS score FROM s WHERE share > 0 ORDER BY share DESC, doc_id, idx LIMIT 150""")  # fmt: skip
def free_search_topk(spark, sf_dir):
    found = lines(table(spark, sf_dir, "documents")).withColumn("share", share(tokens(F.col("text")), F.array(*map(F.lit, QUERY_WORDS)))).filter("share > 0")
    top = found.orderBy(F.col("share").desc(), "doc_id", "idx").limit(150)
    return top.select("doc_id", "idx", F.round(F.least(F.lit(0.98), 0.46 + 0.46 * F.col("share")), 6).alias("score"))


# The demonstration's criteria (theme, word, required).
CRITERIA = [("energy", "thation", True), ("energy", "onthe", False), ("shell", "ouest", False), ("shell", "queleau", False)]


@register("search_grid_themes", f"""WITH {LINES_SQL}, c(theme, word, required) AS (VALUES {', '.join(f"('{t}', '{w}', {r})" for t, w, r in CRITERIA)}),
hit AS (SELECT DISTINCT doc_id, theme, word FROM lines, c WHERE contains(lower(strip_accents(text)), word))
SELECT d.doc_id, c.theme, count(h.word) AS n_found, bool_and(NOT c.required OR h.word IS NOT NULL) AND count(h.word) >= 1 AS ok
FROM documents d CROSS JOIN c LEFT JOIN hit h ON h.doc_id = d.doc_id AND h.theme = c.theme AND h.word = c.word GROUP BY d.doc_id, c.theme""")  # fmt: skip
def search_grid_themes(spark, sf_dir):
    norm = fold(F.coalesce(F.col("text"), F.lit("")))
    marks = F.array(*[F.struct(F.lit(t).alias("theme"), norm.contains(w).alias("found"), F.lit(r).alias("required")) for t, w, r in CRITERIA])
    c = table(spark, sf_dir, "documents").select("doc_id", F.inline(marks))
    return c.groupBy("doc_id", "theme").agg(F.count_if("found").alias("n_found"), (F.bool_and(~F.col("required") | F.col("found")) & (F.count_if("found") >= 1)).alias("ok"))


@register("tag_first_evidence", f"""WITH {LINES_SQL}, r(label, word) AS (VALUES ('heat', 'thation'), ('wall', 'ouest'), ('roof', 'ciones'))
SELECT doc_id, label, min(idx) AS idx FROM lines, r WHERE contains(lower(strip_accents(text)), word) GROUP BY doc_id, label""")  # fmt: skip
def tag_first_evidence(spark, sf_dir):
    rules = {"heat": "thation", "wall": "ouest", "roof": "ciones"}
    marks = F.array_compact(F.array(*[F.when(F.col("norm").contains(w), F.lit(k)) for k, w in rules.items()]))
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "idx", F.explode(marks).alias("label")).groupBy("doc_id", "label").agg(F.min("idx").alias("idx"))


@register("anchor_tolerance_join", """SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND abs(l.l_extendedprice - o.o_totalprice) <= 0.011 * greatest(1, abs(o.o_totalprice)))""")
def anchor_tolerance_join(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    near = F.abs(F.col("l_extendedprice") - F.col("o_totalprice")) <= 0.011 * F.greatest(F.lit(1.0), F.abs("o_totalprice"))
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & near, "left_semi").select("o_orderkey")


@register("asof_last_heading", """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS heading
FROM events""")  # fmt: skip
def asof_last_heading(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    marks = e.filter("event_type = 'signup'").withColumn("heading", F.col("event_id"))
    return joins.last_before(e, marks.select("user_id", "ts", "event_id", "heading"), ["user_id"], ["ts", "event_id"], "heading").select("event_id", F.coalesce("heading", F.lit(-1).cast("long")).alias("heading"))


@register("nearest_within_tolerance", """SELECT c_custkey, s_suppkey, s_acctbal FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 400
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) = 1""")  # fmt: skip
def nearest_within_tolerance(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return joins.nearest_within(c, s, "nation", "c_acctbal", "s_acctbal", 400.0, "s_suppkey").select("c_custkey", "s_suppkey", "s_acctbal")


@register("global_fallback_union", """WITH r AS (SELECT l_linenumber, l_orderkey, CASE WHEN l_suppkey % 10 = 0 THEN 'all' ELSE 'S' || (l_suppkey % 10) END AS building FROM lineitem), b AS (SELECT DISTINCT building FROM r WHERE building <> 'all')
SELECT building, count(*) AS n, count(*) FILTER (g) AS n_global FROM (SELECT building, false AS g FROM r WHERE building <> 'all' UNION ALL SELECT b.building, true FROM r, b WHERE r.building = 'all') GROUP BY building""")  # fmt: skip
def global_fallback_union(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", F.when(F.col("l_suppkey") % 10 == 0, "all").otherwise(F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string"))).alias("building"))
    j = joins.global_fallback(r, r.select("building").distinct().filter("building <> 'all'"), "all")
    return j.groupBy("building").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_global").alias("n_global"))


@register("bounded_edit_join", """WITH a AS (SELECT DISTINCT unnest(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+')) AS word FROM benchmark), b AS (SELECT DISTINCT unnest(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+')) AS other FROM documents)
SELECT word, other, levenshtein(word, other) AS distance FROM a JOIN b ON substr(word, 1, 1) = substr(other, 1, 1) AND abs(length(word) - length(other)) <= 2
WHERE word <> '' AND levenshtein(word, other) <= CASE WHEN length(other) >= 11 THEN 2 WHEN length(other) >= 5 THEN 1 ELSE 0 END""")  # fmt: skip
def bounded_edit_join(spark, sf_dir):
    words = lambda t, name: table(spark, sf_dir, t).select(F.explode(tokens(F.col("text"))).alias(name)).distinct()
    near = joins.near_names(words("benchmark", "word"), words("documents", "other"), "word", "other")
    return near.select(F.col("name").alias("word"), "other", F.col("distance").cast("bigint").alias("distance"))


@register("reconcile_status", """WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)), 2) AS v, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT o_orderkey, CASE WHEN s.v IS NULL AND o_orderstatus = 'O' THEN 'NON_VERIFIEE' WHEN s.v IS NULL THEN 'NON_RETROUVEE' WHEN abs(s.v - o_totalprice) <= greatest(0.051, o_totalprice / 1000) THEN 'CONFIRMEE' ELSE 'DIVERGENCE' END AS status
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")  # fmt: skip
def reconcile_status(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))), 2).alias("v"))
    j = table(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    near = F.abs(F.col("v") - F.col("o_totalprice")) <= F.greatest(F.lit(0.051), F.col("o_totalprice") / 1000)
    status = F.when(F.col("v").isNull() & (F.col("o_orderstatus") == "O"), "NON_VERIFIEE").when(F.col("v").isNull(), "NON_RETROUVEE").when(near, "CONFIRMEE").otherwise("DIVERGENCE")
    return j.select("o_orderkey", status.alias("status"))


@register("contract_match_classes", """WITH f AS (SELECT o_custkey AS k, count(*) AS n, bool_and(o_orderstatus = 'F') AS gone FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN gone THEN 'onlyCancelled' WHEN n > 1 THEN 'multiple' ELSE 'found' END AS status FROM customer LEFT JOIN f ON k = c_custkey""")  # fmt: skip
def contract_match_classes(spark, sf_dir):
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_orderstatus") == "F").alias("gone"))
    j = table(spark, sf_dir, "customer").join(f, F.col("c_custkey") == F.col("k"), "left")
    return j.select("c_custkey", F.when(F.col("n").isNull(), "missing").when(F.col("gone"), "onlyCancelled").when(F.col("n") > 1, "multiple").otherwise("found").alias("status"))


@register("lww_merge", "SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 100000 DESC) = 1")
def lww_merge(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", F.col("event_id") % 100000)).alias("value"))


@register("version_rank", """SELECT o_orderkey, row_number() OVER w AS version, coalesce(lead(o_orderstatus = 'F') OVER w = (o_orderstatus = 'F') AND lead(o_orderdate) OVER w = o_orderdate, false) AS is_ambiguous
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey)""")  # fmt: skip
def version_rank(spark, sf_dir):
    old = F.col("o_orderstatus") == "F"
    w = Window.partitionBy("o_custkey").orderBy(old, F.col("o_orderdate").desc(), "o_orderkey")
    tie = (F.lead(old).over(w) == old) & (F.lead("o_orderdate").over(w) == F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("version"), F.coalesce(tie, F.lit(False)).alias("is_ambiguous"))


# Six digits: halves at the second would be rounded either way by the last bit of a sum.
_P = ", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 6) AS p{round(100 * p)}" for p in stats.PERCENTILES)


@register("stats_percentiles", f"SELECT l_returnflag, count(l_extendedprice) AS n, round(min(l_extendedprice), 6) AS v_min, round(avg(l_extendedprice), 6) AS v_mean, round(max(l_extendedprice), 6) AS v_max, {_P} FROM lineitem GROUP BY 1")
def stats_percentiles(spark, sf_dir):
    return stats.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", digits=6)


@register("multi_grouping_summary", """SELECT l_returnflag, l_linestatus, coalesce(CAST(l_linenumber AS INTEGER), -1) AS l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), (l_linenumber), ())""")  # fmt: skip
def multi_grouping_summary(spark, sf_dir):
    c = [F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")]
    g = table(spark, sf_dir, "lineitem").groupingSets([[c[0]], [c[0], c[1]], [c[2]], []], *c)
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total")).withColumn("l_linenumber", F.coalesce("l_linenumber", F.lit(-1)))


@register("share_dominant", """WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, s / sum(s) OVER (PARTITION BY l_suppkey) AS share, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_returnflag) AS r FROM s)
SELECT l_suppkey, max(l_returnflag) FILTER (r = 1) AS dominant, round(max(share) FILTER (r = 1), 6) AS share, coalesce(max(share >= 0.3) FILTER (r = 2), false) AS is_hybrid FROM r GROUP BY 1""")  # fmt: skip
def share_dominant(spark, sf_dir):
    return stats.dominant_share(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity")


@register("cost_pivot_pct", """WITH s AS (SELECT p_brand, sum(l_extendedprice) AS t, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 0) AS a, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 0) AS n, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0) AS r
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT p_brand, round(t, 2) AS total, round(100 * a / t, 1) AS pct_a, round(100 * n / t, 1) AS pct_n, round(100 * r / t, 1) AS pct_r FROM s""")  # fmt: skip
def cost_pivot_pct(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = j.groupBy("p_brand").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_extendedprice")).na.fill(0.0, ["A", "N", "R"]).withColumn("t", F.col("A") + F.col("N") + F.col("R"))
    return p.select("p_brand", F.round("t", 2).alias("total"), *[F.round(100 * F.col(k) / F.col("t"), 1).alias(f"pct_{k.lower()}") for k in "ANR"])


@register("range_violations", """SELECT l_orderkey, l_linenumber, 'l_quantity' AS field, l_quantity AS value FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem WHERE l_discount > 0.09""")
def range_violations(spark, sf_dir):
    return checks.out_of_range(table(spark, sf_dir, "lineitem"), {"l_quantity": (0, 45), "l_discount": (0, 0.09)}, ["l_orderkey", "l_linenumber"])


@register("missing_required", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_required(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@register("completeness", "SELECT source, count(*) AS n, count(l.quality) AS filled, round(100.0::DOUBLE * count(l.quality) / count(*), 1) AS pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def completeness(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("filled"), F.round(100.0 * F.count("quality") / F.count(F.lit(1)), 1).alias("pct"))


@register("calibration_crossfold", """WITH d AS (SELECT source, doc_id % 2 AS fold, quality FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, fold, count(*) AS n, avg(CAST(quality AS DOUBLE)) AS p FROM d GROUP BY 1, 2), g AS (SELECT fold, avg(CAST(quality AS DOUBLE)) AS p FROM d GROUP BY 1)
SELECT d.source, d.fold, count(*) AS n, round(max(CASE WHEN c.n >= 12 THEN c.p ELSE g.p END), 6) AS accuracy FROM d JOIN g ON g.fold = 1 - d.fold LEFT JOIN c ON c.source = d.source AND c.fold = 1 - d.fold GROUP BY 1, 2""")  # fmt: skip
def calibration_crossfold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", (F.col("doc_id") % 2).alias("fold"), F.col("quality").cast("double").alias("q"))
    own = d.groupBy("source", (1 - F.col("fold")).alias("fold")).agg(F.count(F.lit(1)).alias("m"), F.avg("q").alias("p"))
    whole = d.groupBy((1 - F.col("fold")).alias("fold")).agg(F.avg("q").alias("pg"))
    n = d.groupBy("source", "fold").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(own, ["source", "fold"], "left").join(whole, "fold")
    return j.select("source", "fold", "n", F.round(F.when(F.col("m") >= 12, F.col("p")).otherwise(F.col("pg")), 6).alias("accuracy"))


@register("journal_stats", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_unsynced, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def journal_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_unsynced"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("tumbling_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n")


@register("session_counts", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")  # fmt: skip
def session_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "4 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("session_window.start").alias("start"), "n")


@register("set_ops_tokens", """WITH a AS (SELECT DISTINCT unnest(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+')) AS w FROM documents), b AS (SELECT DISTINCT unnest(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+')) AS w FROM benchmark)
SELECT 'both' AS side, count(*) AS n FROM (SELECT w FROM a WHERE w <> '' INTERSECT SELECT w FROM b) UNION ALL SELECT 'benchmark', count(*) FROM (SELECT w FROM b WHERE w <> '' EXCEPT SELECT w FROM a)
UNION ALL SELECT 'any', count(*) FROM (SELECT w FROM a WHERE w <> '' UNION SELECT w FROM b WHERE w <> '')""")  # fmt: skip
def set_ops_tokens(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select(F.explode(tokens(F.col("text"))).alias("w")).distinct() for t in ("documents", "benchmark"))
    n = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a.intersect(b), "both").union(n(b.exceptAll(a), "benchmark")).union(n(a.union(b).distinct(), "any"))
