"""Queries on records: names, checks, economics, measures, versions, feedback, streams; with SQL twins where SQL can tell them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, spread, table
from ..operators import checks, economics, entities, learning, measures, versions
from ..sources.store import work_path
from ..streaming import journal


@register("alias_follow", """WITH RECURSIVE a AS (SELECT s_suppkey AS n, s_suppkey // 2 AS t FROM supplier WHERE s_suppkey > 1), f AS (SELECT n, t, 1 AS h FROM a UNION ALL SELECT f.n, a.t, h + 1 FROM f JOIN a ON f.t = a.n WHERE h < 16)
SELECT n AS name, t AS target FROM f QUALIFY row_number() OVER (PARTITION BY n ORDER BY h DESC) = 1""")  # fmt: skip
def alias_follow(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_suppkey > 1").select(F.lit("op").alias("op"), F.col("s_suppkey").alias("name"), F.floor(F.col("s_suppkey") / 2).cast("bigint").alias("target"))
    return entities.follow(s, "op").select("name", "target")


@register("similar_names", """WITH n AS (SELECT DISTINCT p_brand, p_name || ' ' || p_type AS name FROM part), t AS (SELECT *, string_split(lower(name), ' ') AS t FROM n),
s AS (SELECT a.p_brand, a.name, b.name AS other, len(list_intersect(a.t, b.t)) AS i, len(list_distinct(a.t || b.t)) AS u, list_sort(a.t) = list_sort(b.t) AS same, least(len(list_distinct(a.t)), len(list_distinct(b.t))) AS l FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.name < b.name)
SELECT p_brand, name, other, round(CASE WHEN same THEN 0.97 WHEN i = l THEN 0.78 ELSE i / u::DOUBLE END, 6) AS score FROM s WHERE i = l OR i / u::DOUBLE >= 0.5""")  # fmt: skip
def similar_names(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return entities.similar_names(n, "p_brand", "name", floor=0.5).withColumn("score", F.round("score", 6))


@register("same_result_groups", """WITH RECURSIVE r AS (SELECT p_brand AS op, p_size AS building, p_type AS field, floor(max(p_retailprice) / 50) AS v FROM part GROUP BY 1, 2, 3),
p AS (SELECT x.op, x.building AS a, y.building AS b FROM r x JOIN r y ON x.op = y.op AND x.field = y.field AND x.building < y.building GROUP BY 1, 2, 3 HAVING count(*) FILTER (x.v = y.v) >= 2 AND bool_and(x.v = y.v)),
e AS (SELECT op, a, b FROM p UNION SELECT op, b, a FROM p), c AS (SELECT op, a AS name, a AS root FROM e UNION SELECT c.op, e.b, c.root FROM c JOIN e ON e.op = c.op AND e.a = c.name)
SELECT op, name, min(root) AS root FROM c GROUP BY op, name""")  # fmt: skip
def same_result_groups(spark, sf_dir):
    r = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("op"), F.col("p_size").alias("building"), F.col("p_type").alias("field")).agg(F.floor(F.max("p_retailprice") / 50).cast("double").alias("value"))
    return entities.groups(entities.same_results(r, "op"), "op", "a", "b")


@register("name_match", """WITH v AS (SELECT c_custkey AS k, c_custkey % 6 AS v, 'Bâtiment CUSTOMER#' || lpad(c_custkey::VARCHAR, 9, '0') AS t FROM customer)
SELECT CASE v WHEN 0 THEN 'Customer#' || lpad(k::VARCHAR, 9, '0') WHEN 1 THEN 'bât. customer ' || k WHEN 2 THEN 'Customer ' || k || ' - 40 lgts' WHEN 3 THEN 'Custommers ' || k WHEN 4 THEN 'Lot n ' || k ELSE 'Mairie ' || k || ' et ' || (k + 1) END AS name,
  CASE WHEN v < 4 OR v = 4 AND k < 1000 THEN t END AS target, CASE WHEN v = 0 THEN '1 exact' WHEN v = 1 THEN '2 key' WHEN v = 2 THEN '5 prefix' WHEN v = 3 THEN '6 loose' WHEN v = 4 AND k < 1000 THEN '7 end' END AS rule FROM v""")  # fmt: skip
def name_match(spark, sf_dir):
    op, k = F.lit("op").alias("op"), F.col("c_custkey")
    v = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    spelled = F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, v("bât. customer ", k)).when(k % 6 == 2, v("Customer ", k, " - 40 lgts")).when(k % 6 == 3, v("Custommers ", k)).when(k % 6 == 4, v("Lot n ", k)).otherwise(v("Mairie ", k, " et ", k + 1))
    return entities.match_names(c.select(op, spelled.alias("name")), c.select(op, F.col("c_name").alias("target")), "op").select("name", "target", "rule")


@register("perimeter_fan_out", """WITH r AS (SELECT c_nationkey AS building, c_mktsegment AS field, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1, 2), t AS (SELECT n_nationkey AS building FROM nation WHERE n_regionkey < 3),
o AS (SELECT * FROM r WHERE building IN (FROM t)), x AS (SELECT * FROM r WHERE building NOT IN (FROM t))
SELECT building, field, value, 'own' AS fate FROM o UNION ALL SELECT building, field, value, 'review' FROM x WHERE field <> 'BUILDING'
UNION ALL SELECT t.building, field, value, 'shared' FROM x, t WHERE field = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM o WHERE o.building = t.building AND o.field = x.field)""")  # fmt: skip
def perimeter_fan_out(spark, sf_dir):
    op = F.lit("op").alias("op")
    r = table(spark, sf_dir, "customer").groupBy(op, F.col("c_nationkey").alias("building"), F.col("c_mktsegment").alias("field")).agg(F.round(F.sum("c_acctbal"), 2).alias("value"))
    t = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(op, F.col("n_nationkey").alias("building"))
    return entities.perimeter(r, t, "op", F.col("field") == "BUILDING").select("building", "field", "value", "fate")


@register("constraint_checks", """WITH s AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n_parts, round(s, 2) AS parts_sum, CASE WHEN s IS NULL THEN 'unchecked' WHEN abs(s - o_totalprice) <= greatest(2, 0.3 * abs(o_totalprice)) THEN 'ok' ELSE 'wrong' END AS status FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")  # fmt: skip
def constraint_checks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return checks.parts_and_total(li, table(spark, sf_dir, "orders"), "o_orderkey", "l_extendedprice", "o_totalprice", relative=0.3).select("o_orderkey", "n_parts", F.round("parts_sum", 2).alias("parts_sum"), "status")


_CASE = lambda v, limits: "CASE " + " ".join(f"WHEN {v} <= {t} THEN '{c}'" for c, t in zip("ABCDEF", limits)) + " ELSE 'G' END"


@register("energy_classes", f"SELECT p_partkey, greatest({_CASE('p_retailprice / 4', checks.ENERGY_LIMITS)}, {_CASE('p_size * 2', checks.CARBON_LIMITS)}) AS class FROM part")
def energy_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", checks.energy_class(F.col("p_retailprice") / 4, F.col("p_size") * 2).alias("class"))


@register("contested_values", """SELECT user_id, event_type, min(floor(value / 10)) <> max(floor(value / 10)) AND min(event_id % 7) <> max(event_id % 7) AS contested FROM events GROUP BY 1, 2""")
def contested_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") / 10).alias("v"), (F.col("event_id") % 7).alias("doc"))
    return checks.contested(e, ["user_id", "event_type"], "v", "doc")


@register("reliability_grade", """WITH d AS (SELECT doc_id, source, lang, quality FROM documents LEFT JOIN labels USING (doc_id)), l AS (SELECT * FROM d WHERE quality IS NOT NULL),
a AS (SELECT source, lang, avg(quality::DOUBLE) AS p, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) >= 12), b AS (SELECT source, avg(quality::DOUBLE) AS p, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 12)
SELECT d.doc_id, round(coalesce(a.p, b.p), 6) AS precision, CASE WHEN a.n IS NOT NULL THEN 0 WHEN b.n IS NOT NULL THEN 1 END AS level,
  CASE WHEN coalesce(a.n, b.n) >= 12 THEN CASE WHEN coalesce(a.p, b.p) >= 0.95 THEN 'sure' WHEN coalesce(a.p, b.p) >= 0.85 THEN 'probable' ELSE 'to-check' END ELSE 'to-check' END AS grade
FROM d LEFT JOIN a ON d.source = a.source AND d.lang = a.lang LEFT JOIN b ON d.source = b.source""")  # fmt: skip
def reliability_grade(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "lang", F.col("quality").alias("ok"))
    r = checks.backoff(d, d.filter("ok is not null"), [["source", "lang"], ["source"]])
    none = F.lit(None)
    grade = checks.reliability(F.lit("pdf"), F.col("precision"), F.col("n"), F.lit(0.8), none.cast("boolean"), none.cast("double"))
    return r.select("doc_id", F.round("precision", 6).alias("precision"), "level", grade.alias("grade"))


@register("ewma_values", """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, value AS m FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, 0.72::DOUBLE * f.m + 0.28::DOUBLE * e.value FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, round(m, 4) AS ewma, k AS n FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")  # fmt: skip
def ewma_values(spark, sf_dir):
    return checks.ewma(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").withColumn("ewma", F.round("ewma", 4))


@register("cost_shares", """WITH s AS (SELECT l_orderkey, l_returnflag AS category, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, sum(amount) AS total FROM s GROUP BY 1)
SELECT s.l_orderkey, category, round(amount, 2) AS amount, round(coalesce(o_totalprice, total), 2) AS total FROM s JOIN t USING (l_orderkey) LEFT JOIN orders ON o_orderkey = s.l_orderkey AND o_orderstatus = 'F'""")  # fmt: skip
def cost_shares(spark, sf_dir):
    declared = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total"))
    c = economics.costs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_extendedprice", declared)
    return c.select("l_orderkey", "category", F.round("amount", 2).alias("amount"), F.round("total", 2).alias("total"))


@register("aid_summary", """WITH s AS (SELECT l_suppkey, l_returnflag AS k, sum(l_quantity) AS a, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, sum(a) AS total, sum(s) AS secured, arg_max(k, (a, k)) AS dominant, max(a) AS first_amount, count(*) AS n_kinds, floor(sum(s) / sum(a) * 1000 + 0.5) / 10 AS secured_pct FROM s GROUP BY 1""")  # fmt: skip
def aid_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("status", F.when(F.col("l_linestatus") == "F", "Versée").otherwise("Demandée"))
    return economics.aids(li, "l_suppkey", "l_returnflag", "l_quantity", "status")


@register("best_lots", "SELECT l_orderkey, l_returnflag, arg_max(l_extendedprice, (l_discount, l_linenumber, l_partkey, l_extendedprice)) AS price FROM lineitem GROUP BY 1, 2")
def best_lots(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("*", F.col("l_extendedprice").alias("price"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("seq"))
    return economics.best_lots(li, ["l_orderkey", "l_returnflag"], "l_discount", "seq", ["price"])


@register("polygon_measures", """WITH p AS (SELECT l_orderkey AS k, l_quantity AS x, l_discount * 100 AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)),
e AS (SELECT p.k, p.n, p.i, p.x, p.y, q.x AS x2, q.y AS y2 FROM p JOIN p q ON p.k = q.k AND q.i = p.i % p.n + 1)
SELECT k AS l_orderkey, round(coalesce(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) FILTER (i < n), 0), 4) AS length, CASE WHEN max(n) >= 3 THEN round(abs(sum(x * y2 - x2 * y)) / 2, 4) ELSE 0 END AS area, round(avg(x), 4) AS cx FROM e GROUP BY k""")  # fmt: skip
def polygon_measures(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    corner = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), "l_discount", (F.col("l_discount") * 100).alias("y"))
    p = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(corner)).alias("p"))
    return p.select("l_orderkey", F.round(measures.path_length(F.col("p")), 4).alias("length"), F.round(measures.area(F.col("p")), 4).alias("area"), F.round(measures.centre(F.col("p"))["x"], 4).alias("cx"))


@register("correspondence_summary", """WITH m AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'count' ELSE 'length' END AS kind, l_quantity AS v, l_orderkey FROM lineitem)
SELECT l_suppkey, kind, count(*) AS n, CASE kind WHEN 'count' THEN sum(v) END AS total, CASE kind WHEN 'length' THEN min(v) END AS v_min, CASE kind WHEN 'length' THEN round(avg(v), 6) END AS v_mean, CASE kind WHEN 'length' THEN max(v) END AS v_max, min(l_orderkey) AS first_id FROM m GROUP BY 1, 2""")  # fmt: skip
def correspondence_summary(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").withColumn("kind", F.when(F.col("l_returnflag") == "A", "count").otherwise("length"))
    return measures.correspondence(m, ["l_suppkey"], "kind", "l_quantity", "l_orderkey").withColumn("v_mean", F.round("v_mean", 6))


@register("file_versions", """WITH f AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS old, CASE WHEN o_orderkey % 3 <> 0 THEN 1 + o_orderkey % 26 END AS rev, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS fam, CAST(o_orderdate AS DATE) AS m FROM orders)
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS version, CAST(rev AS DOUBLE) AS revision, d AS date FROM f WINDOW w AS (PARTITION BY o_custkey, fam ORDER BY old, rev DESC NULLS LAST, d DESC NULLS LAST, m DESC, o_orderkey)""")  # fmt: skip
def file_versions(spark, sf_dir):
    k = F.col("o_orderkey")
    rev = F.when(k % 3 != 0, F.concat(F.lit("_IND_"), F.chr(65 + k % 26))).otherwise("")
    name = F.concat(F.lit("Étude lot "), F.element_at(F.array(*map(F.lit, ["gros oeuvre", "toiture", "chauffage", "menuiserie"])), (k % 4 + 1).cast("int")), rev, F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".pdf"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", name.alias("file"), F.when(F.col("o_orderstatus") == "F", "01 Archives").otherwise("02 Pièces").alias("folder"), F.to_date("o_orderdate").alias("m"))
    # Names are ranked by the file's own key; the order's key decides between files that agree in all else.
    files = o.select("o_orderkey", "o_custkey", F.col("file").alias("name"), "folder", F.struct("m", (-k).alias("k")).alias("mtime"))
    return versions.rank_files(files, ["o_custkey"]).select("o_orderkey", "version", "revision", "date")


@register("listing_diff", """WITH b AS (SELECT l_orderkey AS k, CAST(floor(sum(l_extendedprice) / 100000) AS BIGINT) AS s, min(epoch(l_shipdate)) AS t FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice / 100000) AS BIGINT) AS s, epoch(o_orderdate) AS t FROM orders)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'gone' WHEN a.s <> b.s OR abs(a.t - b.t) > 31536000 THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k""")  # fmt: skip
def listing_diff(spark, sf_dir):
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 100000).alias("size"), at("o_orderdate").alias("mtime"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.floor(F.sum("l_extendedprice") / 100000).alias("size"), F.min(at("l_shipdate")).alias("mtime"))
    return versions.compare_listings(a, b, "k", seconds=31536000)


@register("fresh_files", "SELECT o_orderkey FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) USING (o_custkey) WHERE date_diff('day', o_orderdate, m) <= 45")
def fresh_files(spark, sf_dir):
    return versions.fresh(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate").select("o_orderkey")


_READ = "r AS (SELECT user_id AS building, event_type AS field, 5 * floor(value / 5) AS value, ts AS study_date, event_id % 3 AS source_rank, (event_id % 50) / 50.0::DOUBLE AS precision, event_id FROM events)"


def _readings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("building"), F.col("event_type").alias("field"), (5 * F.floor(F.col("value") / 5)).cast("double").alias("value"), F.col("ts").alias("study_date"), (F.col("event_id") % 3).alias("source_rank"), ((F.col("event_id") % 50) / F.lit(50.0)).alias("precision"), "event_id")


@register("worst_of_best", f"""WITH {_READ}, n AS (SELECT *, max(study_date) OVER (PARTITION BY building, field) AS m FROM r), k AS (SELECT * FROM n WHERE study_date >= m - INTERVAL 1 HOUR)
SELECT building, field, max(value) AS value FROM k JOIN (SELECT building, field, min(source_rank) AS source_rank FROM k GROUP BY 1, 2) USING (building, field, source_rank) GROUP BY 1, 2""")  # fmt: skip
def worst_of_best(spark, sf_dir):
    return learning.worst_of_best(_readings(spark, sf_dir))


@register("learned_pick", f"""WITH {_READ}, f AS (SELECT building, field, arg_min(value, event_id) AS value FROM r GROUP BY 1, 2), p AS (SELECT building, field, value, max(precision) AS p FROM r GROUP BY 1, 2, 3),
b AS (SELECT building, field, arg_max(value, (p, value)) AS bv, max(p) AS bp FROM p GROUP BY 1, 2)
SELECT f.building, f.field, CASE WHEN bp >= p.p + 0.1::DOUBLE AND bv <> f.value THEN bv ELSE f.value END AS value, bp >= p.p + 0.1::DOUBLE AND bv <> f.value AS learned FROM f JOIN p USING (building, field, value) JOIN b ON b.building = f.building AND b.field = f.field""")  # fmt: skip
def learned_pick(spark, sf_dir):
    r = _readings(spark, sf_dir)
    return learning.learned_pick(r, r.groupBy("building", "field").agg(F.min_by("value", "event_id").alias("value")))


@register("learning_boosts", """WITH s AS (SELECT user_id, event_type, count(*) FILTER (value >= 20) AS c, count(*) FILTER (value < 20) AS r FROM events GROUP BY 1, 2)
SELECT user_id, event_type, round((c + 1) / (c + r + 2)::DOUBLE, 6) AS reliability, round(CASE WHEN c >= 10 THEN 0.08 WHEN c >= 5 THEN 0.06 WHEN c >= 3 THEN 0.04 WHEN c >= 2 THEN 0.02 ELSE 0 END::DOUBLE * ((c + 1) / (c + r + 2)::DOUBLE), 6) AS boost FROM s""")  # fmt: skip
def learning_boosts(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") >= 20).alias("c"), F.count_if(F.col("value") < 20).alias("r"))
    return s.select("user_id", "event_type", F.round(learning.smoothed(F.col("c"), F.col("r")), 6).alias("reliability"), F.round(learning.boost(F.col("c"), F.col("r")), 6).alias("boost"))


@register("signal_profiles")
def signal_profiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    words = F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int").cast("string")), F.concat(F.lit("v"), F.floor(F.col("value") / 20).cast("string")))
    return learning.profiles(e.select("user_id", "event_type", F.col("event_id").alias("seq"), words.alias("words"), (F.col("value") > 20).alias("positive")), ["user_id", "event_type"])


@register(
    "location_boosts",
    """
    WITH e AS (
      SELECT event_id, user_id, ['k' || CAST(props->>'$.k' AS INTEGER) % 7, event_type, 'v' || CAST(floor(value / 20) AS BIGINT) % 5] AS w, event_id % 12 AS page, (value % 50) / 50 AS ratio,
        event_id % 14 AS yes, event_id % 3 AS no, value FROM events),
    p AS (SELECT *, (yes + 1) / CAST(yes + no + 2 AS DOUBLE) AS r FROM e WHERE event_id % 5 = 0),
    g AS (SELECT *, CASE WHEN yes >= 10 THEN 0.075 WHEN yes >= 5 THEN 0.055 WHEN yes >= 3 THEN 0.035 WHEN yes >= 2 THEN 0.018 ELSE 0 END * least(1.0, (r - 0.45) / CAST(0.45 AS DOUBLE)) AS gain FROM p WHERE r >= 0.55 AND yes >= 2),
    m AS (
      SELECT a.event_id, g.event_id AS profile, g.gain,
        least(1.0, len(list_intersect(a.w, g.w)) / CAST(len(list_distinct(a.w || g.w)) AS DOUBLE) * CAST(0.72 AS DOUBLE) + greatest(1 - abs(a.page - g.page) / CAST(5 AS DOUBLE), 0.0) * CAST(0.12 AS DOUBLE) + greatest(1 - abs(a.ratio - g.ratio) / CAST(0.35 AS DOUBLE), 0.0) * CAST(0.16 AS DOUBLE)) AS match
      FROM e a JOIN g ON a.user_id = g.user_id),
    b AS (SELECT event_id, arg_max(gain, {'m': match, 'p': -profile}) AS gain, max(match) AS match FROM m WHERE match >= 0.42 GROUP BY event_id),
    d AS (SELECT event_id, match, least(0.08, gain * least(1.0, match / CAST(0.72 AS DOUBLE))) AS boost FROM b)
    SELECT e.event_id, round(CASE WHEN boost > 0.002 THEN boost ELSE 0 END, 9) AS boost, round(match, 9) AS match FROM e LEFT JOIN d USING (event_id)
    """,
)
def location_boosts(spark, sf_dir):
    """What the most similar profile of a user adds to each event's confidence."""
    e = table(spark, sf_dir, "events")
    k, v = F.get_json_object("props", "$.k").cast("int"), F.floor(F.col("value") / 20)
    words = F.array(F.concat(F.lit("k"), k % 7), F.col("event_type"), F.concat(F.lit("v"), v % 5))
    box = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("box")
    e = e.select("user_id", F.col("event_id").alias("id"), words.alias("words"), (F.col("event_id") % 12).cast("int").alias("page"), (F.col("value") % 50 / 50).alias("ratio"), box)
    known = e.filter("id % 5 = 0").withColumnRenamed("id", "profile").withColumn("confirmed", F.col("profile") % 14).withColumn("rejected", F.col("profile") % 3)
    found = learning.boosted(e, known, ["user_id"])
    return found.select(F.col("id").alias("event_id"), F.round(F.coalesce("boost", F.lit(0.0)), 9).alias("boost"), F.round("match", 9).alias("match"))


def _events(spark, sf_dir):
    return journal.read_journal(spark, f"{sf_dir}/events.parquet")


# A window is sent when the watermark, an hour behind the newest event, has passed its end.
_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@register("stream_tumbling", f"SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events, {_MARK} GROUP BY 1, 2, mark HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= mark")
def stream_tumbling(spark, sf_dir):
    return journal.drain(journal.window_counts(_events(spark, sf_dir), ["event_type"], "6 hours"), "tumbling")


@register("stream_sliding", f"""SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 3 HOUR) + INTERVAL 3 HOUR]) AS start FROM events), {_MARK} WHERE start + INTERVAL 6 HOUR <= mark GROUP BY 1""")
def stream_sliding(spark, sf_dir):
    return journal.drain(journal.window_counts(_events(spark, sf_dir), [], "6 hours", "3 hours"), "sliding")


@register("stream_sessions", f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s, {_MARK} GROUP BY user_id, sid, mark HAVING max(ts) + INTERVAL 4 HOUR <= mark""")  # fmt: skip
def stream_sessions(spark, sf_dir):
    return journal.drain(journal.session_counts(_events(spark, sf_dir), ["user_id"], "4 hours"), "sessions")


@register("stream_append_once", "SELECT event_id, user_id FROM events")
def stream_append_once(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    return journal.drain(journal.append_once(e.union(e)), "journal").select("event_id", "user_id")


@register("stream_registry", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_registry(spark, sf_dir):
    path = work_path(spark, "registry")
    journal.merge_registry(_events(spark, sf_dir).select("user_id", "ts", "event_id", "value"), path, "user_id", ["ts", "event_id"])
    return journal.registry(spark, path).select("user_id", "value")
