"""Queries on facts: sanity, winners by all keys, votes, constraints, derived columns, categories; each with a SQL twin that is told from the numbers the texts were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, spread, table
from ..operators import checks, constraints, fusion, joins, sanity


def _s(c):
    return F.format_string("%.0f", c)


# Eight kinds of readings by the line's key: plain, out of range, a regulation's year, glued to a label, a period, a chapter, a page of contents, entered by hand.
_KIND = "(l_orderkey + l_linenumber) % 8"


@register("sanity_reasons", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_KIND} AS kind, CASE {_KIND}
  WHEN 0 THEN CASE WHEN l_quantity * 40 NOT BETWEEN 10 AND 1500 THEN 'range' END WHEN 1 THEN 'regulation' WHEN 2 THEN NULL WHEN 3 THEN 'glued' WHEN 4 THEN CASE WHEN l_quantity > 25 THEN 'period' END
  WHEN 5 THEN CASE WHEN l_quantity > 5 THEN 'range' WHEN l_quantity >= 3 THEN 'chapter' END WHEN 6 THEN 'page' END AS reason FROM lineitem""")  # fmt: skip
def sanity_reasons(spark, sf_dir):
    q, k = F.col("l_quantity"), (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    pick = lambda *v: F.element_at(F.array(*v), (k + 1).cast("int"))
    text = lambda t, c: F.concat(F.lit(t), _s(c))
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", k.alias("kind"), pick(*map(F.lit, ["cep", "cep_before", "wall_insulation_thickness", "bbio", "construction_year", "ubat_before", "tic", "cep"])).alias("field"),
        pick(q * 40, F.lit(2012.0), q + 10, q + 10, F.lit(1948.0), q, F.lit(20.0), q * 4000).cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_text"),
        pick(text("Cep projet : ", q * 40), F.lit("Étude RT2012, Cep initial"), F.concat(F.lit("Mur isolé, e = "), _s(q + 10), F.lit(" mm")), text("Bbio du Bat.", q + 10), F.when(q > 25, "Bâti avant 1948").otherwise("Bâti en 1948"), text("Ubat ", q), F.lit("Tic ............ 20"), F.lit("saisie")).alias("excerpt"),
        F.when(k == 7, "manual:entry").otherwise("label:value").alias("method"), F.lit("THERMAL").alias("doc_type"), F.lit(False).alias("validated"), F.lit(False).alias("structured"),
    )
    li = spread(li)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", sanity.reason(li).alias("reason"))


@register("sanity_kept", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(1 + c_custkey % 95 AS VARCHAR), 2, '0') WHEN 1 THEN chr(65 + CAST(c_custkey % 7 AS INTEGER)) ELSE 'Béton banché' END AS value_text,
  CASE WHEN c_custkey % 3 = 2 THEN 0.72 ELSE 0.95 END::DOUBLE AS confidence FROM customer WHERE NOT (c_custkey % 3 = 2 AND c_custkey % 2 = 0)""")  # fmt: skip
def sanity_kept(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lpad((1 + k % 95).cast("string"), 2, "0"), F.lit(" - Département"))).when(k % 3 == 1, F.concat(F.lit("Classe énergie : "), F.lower(F.chr(65 + k % 7)))).when(k % 2 == 0, "Autre Nature").otherwise("Béton banché")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 3 == 0, "department").when(k % 3 == 1, "dpe_energy_after").otherwise("wall_structure").alias("field"), F.lit(None).cast("double").alias("value_num"), text.alias("value_text"), text.alias("excerpt"),
        F.when(k % 3 == 2, "envelope:structure-context").otherwise("label").alias("method"), F.lit("RT Existant").alias("doc_type"), F.lit(False).alias("validated"), F.lit(False).alias("structured"), F.lit(0.95).alias("confidence"),
    )
    return sanity.sanitize(c).select("c_custkey", "value_text", "confidence")


@register("odd_values", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 AND l_quantity < 24 THEN 'low' WHEN l_linenumber % 2 = 1 AND l_quantity * 10 > 300 THEN 'high' END AS odd FROM lineitem""")
def odd_values(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    value = F.when(even, F.col("l_quantity")).otherwise(F.col("l_quantity") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sanity.odd(F.when(even, "tic").otherwise("cep"), value, F.lit(None).cast("string")).alias("odd"))


_OCC = """occ AS (SELECT 'B' || (user_id % 40) AS building, CASE event_type WHEN 'click' THEN 'shab' WHEN 'view' THEN 'wall_insulation_r' WHEN 'error' THEN 'cep' ELSE event_type END AS field, value, event_id AS seq, ts, 0.85 + (event_id % 15) / 100.0 AS confidence,
  CASE event_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'main' WHEN 2 THEN 'secondary' WHEN 3 THEN 'forbidden' ELSE 'secondary' END AS tier, event_id % 4 AS rank, event_id % 97 = 0 AS definitive, event_id % 3 = 0 AS library, CASE event_id % 4 WHEN 1 THEN 'RT2012' ELSE 'CCTP' END AS doc_type,
  event_id % 6 = 1 AS is_global, event_id % 7 = 2 AS is_anchor, 10 * (event_id % 3) AS hier, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 9 AS DOUBLE) END AS revision, CAST(event_id % 5 AS DOUBLE) AS surface FROM events),
ok AS (SELECT *, max(tier = 'main') OVER (PARTITION BY building, field) AS has_main FROM occ WHERE tier <> 'forbidden' AND confidence >= 0.9)"""


def _occurrences(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.concat(F.lit("B"), (F.col("user_id") % 40).cast("string")).alias("building"), F.when(F.col("event_type") == "click", "shab").when(F.col("event_type") == "view", "wall_insulation_r").when(F.col("event_type") == "error", "cep").otherwise(F.col("event_type")).alias("field"),
        "value", F.concat(F.lit("D"), (i % 50).cast("string")).alias("doc_id"), F.element_at(F.array(*map(F.lit, ["main", "main", "secondary", "forbidden", "secondary"])), (i % 5 + 1).cast("int")).alias("tier"), (i % 4).cast("int").alias("source_rank"),
        (F.lit(0.85) + (i % 15) / F.lit(100.0)).alias("confidence"), F.col("ts").alias("study_date"), i.alias("seq"), (i % 97 == 0).alias("definitive"), (i % 3 == 0).alias("library_derived"), F.when(i % 4 == 1, "RT2012").otherwise("CCTP").alias("doc_type"),
        (i % 6 == 1).alias("is_global"), (i % 7 == 2).alias("is_anchor"), (10 * (i % 3)).cast("int").alias("hierarchy_rank"), F.when(i % 2 == 0, (i % 9).cast("double")).alias("revision"), (i % 5).cast("double").alias("surface_priority"),
    )


@register("fuse_all_keys", f"""WITH {_OCC}
SELECT building, field, value, seq, count(*) OVER (PARTITION BY building, field) AS n_candidates FROM ok WHERE NOT has_main OR tier = 'main'
QUALIFY row_number() OVER (PARTITION BY building, field ORDER BY definitive DESC, CASE WHEN field = 'wall_insulation_r' AND NOT library AND doc_type = 'RT2012' THEN 0 WHEN NOT library THEN 1 ELSE 2 END, is_global, CASE WHEN field <> 'cep' THEN NOT is_anchor ELSE true END,
  rank, hier, revision DESC NULLS LAST, date_trunc('hour', ts) DESC, CASE WHEN field = 'shab' THEN surface END DESC, confidence DESC, seq) = 1""")  # fmt: skip
def fuse_all_keys(spark, sf_dir):
    return fusion.winners(_occurrences(spark, sf_dir)).select("building", "field", "value", "seq", "n_candidates")


@register("candidate_pool", f"WITH {_OCC} SELECT seq, building, field, tier FROM ok WHERE NOT has_main OR tier = 'main'")
def candidate_pool(spark, sf_dir):
    return fusion.pool(_occurrences(spark, sf_dir)).select("seq", "building", "field", "tier")


@register("learned_fill", """WITH o AS (SELECT 'B' || (user_id % 40) AS building, event_type AS field, value, event_id, (event_id % 50) / 50.0::DOUBLE AS p, event_id % 5 AS t FROM events), f AS (SELECT DISTINCT building, field FROM o WHERE event_id % 400 = 0)
SELECT building, field, value, p AS precision FROM o WHERE t IN (0, 1, 2) AND p >= 0.85 AND (building, field) NOT IN (SELECT building, field FROM f) QUALIFY row_number() OVER (PARTITION BY building, field ORDER BY p DESC, event_id % 15 DESC, event_id) = 1""")  # fmt: skip
def learned_fill(spark, sf_dir):
    i = F.col("event_id")
    o = table(spark, sf_dir, "events").select(F.concat(F.lit("B"), (F.col("user_id") % 40).cast("string")).alias("building"), F.col("event_type").alias("field"), "value", ((i % 50) / F.lit(50.0)).alias("precision"), F.when(i % 5 == 0, "main").when(i % 5 <= 2, "secondary").otherwise("unrouted").alias("tier"), (i % 15).alias("confidence"), i.alias("seq"))
    return fusion.learned_fill(o, o.filter(F.col("seq") % 400 == 0).select("building", "field").distinct())


@register("anchor_docs", """WITH r AS (SELECT o_custkey AS b, 1000 * (1 + o_custkey % 90) AS v FROM orders GROUP BY 1, 2), x AS (SELECT o_custkey AS b, o_orderkey AS d, 'bbio' AS f, 10 * (1 + o_custkey % 90) * (1 + (o_orderkey % 5 - 2) / 100.0) AS v, r.v / 100 AS ref FROM orders JOIN r ON b = o_custkey
  UNION ALL SELECT o_custkey, o_orderkey, 'cep', 10 * (1 + o_custkey % 90) * (1 + (o_orderkey % 3 - 1) / 50.0), r.v / 100 FROM orders JOIN r ON b = o_custkey)
SELECT b AS building, d AS doc_id FROM x WHERE abs(v - ref) <= 0.011 * greatest(1, abs(ref)) GROUP BY 1, 2 HAVING count(DISTINCT f) = 2""")  # fmt: skip
def anchor_docs(spark, sf_dir):
    o, base = table(spark, sf_dir, "orders"), 10 * (1 + F.col("o_custkey") % 90)
    one = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("double").alias("value"))
    r = o.select(F.col("o_custkey").alias("building"), F.col("o_orderkey").alias("doc_id"), F.inline(F.array(one("bbio", base * (1 + (F.col("o_orderkey") % 5 - 2) / F.lit(100.0))), one("cep", base * (1 + (F.col("o_orderkey") % 3 - 1) / F.lit(50.0))))))
    ref = o.select(F.col("o_custkey").alias("building"), F.inline(F.array(one("bbio", base), one("cep", base)))).distinct()
    return fusion.anchor_docs(r, ref)


@register("prune_shadowed", """WITH f AS (SELECT event_id, user_id AS doc_id, event_type AS field, event_id % 4 AS m FROM events), s AS (SELECT DISTINCT doc_id, field FROM f WHERE m = 0)
SELECT event_id FROM f WHERE m <> 1 OR (doc_id, field) NOT IN (SELECT doc_id, field FROM s)""")  # fmt: skip
def prune_shadowed(spark, sf_dir):
    m = F.element_at(F.array(*map(F.lit, ["rt2012:chapter2-cep", "rset:cep-summary-row", "patch:x", "rset:chapter4-x"])), (F.col("event_id") % 4 + 1).cast("int"))
    f = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.lit("RT2012").alias("doc_type"), F.col("event_type").alias("field"), m.alias("method"), F.lit(False).alias("validated"))
    return fusion.prune_shadowed(f).select("event_id")


@register("semantic_ranks", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 25 WHEN 2 THEN 35 WHEN 3 THEN 80 WHEN 4 THEN 8 WHEN 5 THEN 10 WHEN 6 THEN 25 ELSE 50 END AS rank FROM events""")
def semantic_ranks(spark, sf_dir):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 8 + 1).cast("int"))
    kind = pick("RT2012", "RT2012", "RT2012", "RSET_RE2020", "RSEE_RE2020", "RSENV", "CARBON", "PLAN")
    method = pick("rt2012:chapter2-tic", "rset:cep-summary-row", "other", "tags:presence", "rset:carbon-lot-total", "rsenv:lot-summary", "carbon:x", "x")
    return table(spark, sf_dir, "events").select("event_id", fusion.semantic_rank(kind, method, F.lit("Synthèse des valeurs")).alias("rank"))


@register("newest_readings", "SELECT event_id FROM events QUALIFY ts >= max(ts) OVER (PARTITION BY user_id, event_type) - INTERVAL 1 HOUR")
def newest_readings(spark, sf_dir):
    return fusion.newest_only(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("event_id")


@register("document_vote", """WITH r AS (SELECT user_id AS building, event_type AS field, floor(value / 20) * 20 AS value, event_id % 30 AS doc, max(0.1 + (event_id % 9) / 21.0::DOUBLE) AS w FROM events GROUP BY 1, 2, 3, 4),
p AS (SELECT building, field, value, 1 - product(1 - least(w, 0.995)) AS p FROM r GROUP BY 1, 2, 3), b AS (SELECT building, field, arg_max(value, (p, value)) AS bv, max(p) AS bp FROM p GROUP BY 1, 2),
f AS (SELECT user_id AS building, event_type AS field, floor(arg_min(value, event_id) / 20) * 20 AS value, user_id % 10 = 0 AS protected FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
j AS (SELECT coalesce(f.building, b.building) AS building, coalesce(f.field, b.field) AS field, f.value, f.protected, p.p AS own, bv, bp FROM f FULL JOIN b ON f.building = b.building AND f.field = b.field LEFT JOIN p ON p.building = f.building AND p.field = f.field AND p.value = f.value),
c AS (SELECT *, CASE WHEN value IS NULL AND bp >= 0.85 THEN 'filled' WHEN value IS NOT NULL AND NOT protected AND bv <> value AND bp >= coalesce(own, 0) + 0.15 THEN 'replaced' WHEN value IS NOT NULL THEN 'kept' END AS change FROM j)
SELECT building, field, CASE change WHEN 'kept' THEN value ELSE bv END AS value, round(CASE change WHEN 'kept' THEN own ELSE bp END, 6) AS p, change FROM c WHERE change IS NOT NULL""")  # fmt: skip
def document_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") / 20).cast("double") * 20)
    r = e.select(F.col("user_id").alias("building"), F.col("event_type").alias("field"), F.col("v").alias("value"), (F.col("event_id") % 30).alias("doc_id"), (F.lit(0.1) + (F.col("event_id") % 9) / F.lit(21.0)).alias("weight"))
    f = e.filter("event_type <> 'view'").groupBy(F.col("user_id").alias("building"), F.col("event_type").alias("field")).agg(F.min_by("v", "event_id").alias("value")).withColumn("protected", F.col("building") % 10 == 0)
    return fusion.vote(f, r).withColumn("p", F.round("p", 6))


@register("scoped_fallback", """WITH r AS (SELECT event_id, user_id % 7 AS op, CASE WHEN event_id % 10 = 0 THEN 'all' ELSE 'B' || (event_id % 4) END AS building, CASE WHEN event_id % 3 = 0 THEN 'shab' ELSE 'wall' END AS field FROM events), b AS (SELECT DISTINCT op, building FROM r WHERE building <> 'all')
SELECT event_id, building, false AS is_global FROM r WHERE building <> 'all' UNION ALL SELECT r.event_id, b.building, true FROM r JOIN b ON r.op = b.op WHERE r.building = 'all' AND (field <> 'shab' OR (SELECT count(*) FROM b b2 WHERE b2.op = r.op) = 1)""")  # fmt: skip
def scoped_fallback(spark, sf_dir):
    i = F.col("event_id")
    r = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("op"), F.when(i % 10 == 0, "all").otherwise(F.concat(F.lit("B"), (i % 4).cast("string"))).alias("building"), F.when(i % 3 == 0, "shab").otherwise("wall").alias("field"))
    j = joins.global_fallback(r, r.select("op", "building"), "all", ["op"], fusion.scoped(F.col("field"), F.lit(None).cast("string")))
    return j.select("event_id", "building", "is_global")


_WIDE = "w AS (SELECT p_partkey AS building, p_size * 10.0 AS cep, p_size * 10.0 + p_partkey % 3 - 1 AS cepnr, 400.0 AS cep_max, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN round(100 - p_size * 2.5, 1) WHEN p_partkey % 4 = 2 THEN 1.0 ELSE 50 END AS cep_gain, p_retailprice AS ic_energy, CAST(300 AS DOUBLE) AS post FROM part)"


@register("constraint_suite", f"""WITH {_WIDE}, g AS (SELECT *, floor((cep_max - cep) / cep_max * 1000 + 0.5) / 10 AS made FROM w)
SELECT building, 'cepnr' AS "check", CASE WHEN cepnr <= cep + 0.5 THEN 'ok' ELSE 'fail' END AS status, round(cepnr, 3) AS detail FROM w
UNION ALL SELECT building, 'gain cep', CASE WHEN cep_gain IS NULL THEN 'calculated' WHEN abs(CASE WHEN abs(cep_gain) <= 1 AND abs(made) > 1 THEN cep_gain * 100 ELSE cep_gain END - made) <= 1.5 THEN 'ok' ELSE 'fail' END, round(made, 3) FROM g
UNION ALL SELECT building, 'limit cep', 'alert', round(cep, 3) FROM w WHERE cep > 400.04 UNION ALL SELECT building, 'range cepnr', 'fail', round(cepnr, 3) FROM w WHERE cepnr NOT BETWEEN 5 AND 700
UNION ALL SELECT building, 'posts', CASE WHEN 900 <= ic_energy * 1.03 + 1 THEN 'ok' ELSE 'fail' END, 900 FROM w UNION ALL SELECT building, 'range ic_energy', 'fail', round(ic_energy, 3) FROM w WHERE ic_energy > 2000""")  # fmt: skip
def constraint_suite(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size") * 10.0
    gain = F.when(k % 4 == 1, F.round(100 - F.col("p_size") * 2.5, 1)).when(k % 4 == 2, 1.0).when(k % 4 == 3, 50.0)
    w = table(spark, sf_dir, "part").select(k.alias("building"), size.alias("cep"), (size + k % 3 - 1).alias("cepnr"), F.lit(400.0).alias("cep_max"), gain.alias("cep_gain"), F.col("p_retailprice").alias("ic_energy"), *[F.lit(300.0).alias(p) for p in constraints.POSTS[:3]])
    return constraints.check_suite(w).select("building", "check", "status", F.round("detail", 3).alias("detail"))


@register("constraint_lots", """WITH s AS (SELECT o_orderkey AS b, o_totalprice / 400 AS total, (o_orderkey % 7 - 3) * 4.0 AS off FROM orders)
SELECT b AS building, CASE WHEN abs(off) <= greatest(2, total * 0.03) THEN 'ok' ELSE 'fail' END AS status FROM s""")  # fmt: skip
def constraint_lots(spark, sf_dir):
    total, off = F.col("o_totalprice") / 400, (F.col("o_orderkey") % 7 - 3) * 4.0
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("building"), total.alias("ic_components"), *[((total + off) / 13).alias(f) for f in constraints.LOTS])
    return constraints.check_suite(o).filter(F.col("check") == "lots").select("building", "status")


@register("constraint_demotion", """WITH f AS (SELECT o_orderkey AS b, o_orderstatus = 'F' AS protected, o_totalprice > 150000 AS bad FROM orders)
SELECT b AS building, 'kept' AS fate, 0.95::DOUBLE AS confidence FROM f WHERE protected OR NOT bad UNION ALL SELECT b, 'demoted', 0.89 FROM f WHERE bad AND NOT protected""")  # fmt: skip
def constraint_demotion(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    wide = o.select(F.col("o_orderkey").alias("building"), F.when(F.col("o_totalprice") > 150000, 900.0).otherwise(100.0).alias("cep"))
    finals = o.select(F.col("o_orderkey").alias("building"), F.lit("cep").alias("field"), F.lit(0.95).alias("confidence"), (F.col("o_orderstatus") == "F").alias("protected"))
    kept, gone = constraints.demote(finals, constraints.check_suite(wide))
    return kept.select("building", F.lit("kept").alias("fate"), "confidence").unionByName(gone.select("building", F.lit("demoted").alias("fate"), "confidence"))


@register("derived_columns", """WITH w AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 4 AS m FROM part)
SELECT k, CASE WHEN 1900 + s < 1948 THEN 'Oui' ELSE 'Non' END AS built_before_1948, CASE WHEN m = 0 THEN 10.0 * s END AS dh_zt, CASE WHEN m <> 0 THEN 10.0 * s END AS dh_znt, CASE WHEN m IN (1, 2) THEN 'Oui' WHEN m = 3 THEN 'Non' END AS wall_ite, CASE WHEN m IN (2, 3) THEN 'Oui' WHEN m = 1 THEN 'Non' END AS wall_iti,
  CASE WHEN m = 2 THEN 100.0 + s ELSE NULL END AS thickness, CASE WHEN s % 3 = 0 THEN 'Non' ELSE 'Oui' END AS fan_presence, CASE m WHEN 0 THEN 'Non' WHEN 1 THEN 'Oui' END AS cooling_active, floor((200.0 - s) / 200.0 * 1000 + 0.5) / 10 AS cep_gain FROM w""")  # fmt: skip
def derived_columns(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    m = k % 4
    w = table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(m == 0, "Villa 2").otherwise("Bâtiment A").alias("building"), (1900 + s).alias("construction_year"), (10 * s).alias("dh"), F.when(m.isin(1, 2), 100.0).alias("wall_ite_thickness"), F.when(m.isin(2, 3), s).alias("wall_iti_thickness"),
        (F.col("p_size") % 3).cast("double").alias("fan_count"), F.when(m == 0, "Aucun").when(m == 1, "Split réversible").when(m == 2, "Poêle").alias("cooling"), F.lit(200.0).alias("cep_before"), s.alias("cep"),
    )
    d = constraints.derive(w)
    return d.select("k", "built_before_1948", "dh_zt", "dh_znt", "wall_ite", "wall_iti", F.col("wall_insulation_thickness").alias("thickness"), "fan_presence", "cooling_active", "cep_gain")


@register("wall_sides", """SELECT event_id, field FROM (SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['wall_insulation_r', 'wall_ite_r'] WHEN 1 THEN ['wall_insulation_r', 'wall_iti_r'] WHEN 2 THEN ['wall_insulation_r'] ELSE ['dh', 'dh_zt'] END) AS field FROM events)""")
def wall_sides(spark, sf_dir):
    m = F.col("event_id") % 4
    f = table(spark, sf_dir, "events").select("event_id", F.when(m == 3, "dh").otherwise("wall_insulation_r").alias("field"), F.when(m == 0, "Isolation par l’extérieur, R = 4").when(m == 1, "Doublage R = 3").when(m == 2, "ITE et ITI R = 5").alias("excerpt"), F.when(m == 3, "zt").alias("dh_zone"))
    return constraints.sided(f).select("event_id", "field")


@register("settled_phases", """WITH f AS (SELECT event_id, user_id AS b, event_id % 5 AS d, event_id % 7 <> 0 AS guess FROM events), x AS (SELECT b, min(d) AS d0, max(d) AS d1 FROM f WHERE NOT guess GROUP BY 1)
SELECT event_id, CASE WHEN guess AND (d0 <> d OR d1 <> d) THEN 'dpe_energy_after' ELSE 'dpe_energy_before' END AS field FROM f LEFT JOIN x USING (b)""")  # fmt: skip
def settled_phases(spark, sf_dir):
    f = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("building"), (F.col("event_id") % 5).alias("doc_id"), F.lit("dpe_energy_before").alias("field"), (F.col("event_id") % 7 != 0).alias("phase_guess"))
    return constraints.settle_phases(f).select("event_id", "field")


_TEXTS = ["PAC air/eau + appoint électrique", "Réseau de chaleur urbain", "Chaudière gaz à condensation", "Production commune"]
_CATS = ["['pac', 'elec']", "['reseau']", "['gaz']", "CAST([] AS VARCHAR[])"]


@register("category_match", f"""WITH c AS (SELECT c_custkey AS k, [{', '.join(_CATS)}][1 + c_custkey % 4] AS d, [{', '.join(_CATS)}][1 + c_nationkey % 4] AS r FROM customer)
SELECT k AS c_custkey, array_to_string(d, '+') AS found, CASE WHEN len(d) = 0 OR len(r) = 0 THEN 'incomparable' WHEN len(list_intersect(d, r)) = len(d) THEN 'right' ELSE 'wrong' END AS result FROM c""")  # fmt: skip
def category_match(spark, sf_dir):
    text = lambda c: F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col(c) % 4 + 1).cast("int"))
    field = F.lit("heating_mode_after")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(constraints.categories(field, text("c_custkey")), "+").alias("found"), constraints.same_category(field, text("c_custkey"), text("c_nationkey")).alias("result"))


@register("reference_grades", """WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity AS d, 25.0 AS r, l_suppkey % 2 = 0 AS e FROM lineitem), t AS (SELECT *, CASE WHEN abs(d - r) <= 0.051 THEN 'right' ELSE 'wrong' END AS res, d < 24 AS od FROM g)
SELECT CASE WHEN res = 'right' THEN 'right' WHEN od THEN 'aberrant' WHEN abs(d - r) <= 2.5 THEN 'minor' WHEN e THEN 'version' ELSE 'major' END AS grade, count(*) AS n FROM t GROUP BY 1""")  # fmt: skip
def reference_grades(spark, sf_dir):
    d, r = F.col("l_quantity"), F.lit(25.0)
    none = F.lit(None).cast("string")
    odd = lambda v: sanity.odd(F.lit("tic"), v, none)
    grade = constraints.reference_grade(F.when(checks.differs(d, r), "wrong").otherwise("right"), odd(d), odd(r), d, r, F.col("l_suppkey") % 2 == 0)
    return table(spark, sf_dir, "lineitem").groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


_RES = "CASE WHEN quality IS NULL THEN 'missing' WHEN toxic = 1 THEN 'incomparable' WHEN quality = 1 THEN 'right' ELSE 'wrong' END"


@register("accuracy_bench", f"""WITH r AS (SELECT source, {_RES} AS result FROM documents LEFT JOIN labels USING (doc_id)), g AS (SELECT source, count(*) FILTER (result = 'right') AS "right", count(*) FILTER (result = 'wrong') AS wrong, count(*) FILTER (result = 'missing') AS missing, count(*) FILTER (result = 'incomparable') AS incomparable FROM r GROUP BY 1)
SELECT *, round(CASE WHEN "right" + wrong + missing > 0 THEN ("right" + wrong) / ("right" + wrong + missing)::DOUBLE END, 6) AS coverage, round(CASE WHEN "right" + wrong > 0 THEN "right" / ("right" + wrong)::DOUBLE END, 6) AS accuracy FROM g""")  # fmt: skip
def accuracy_bench(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    r = F.when(F.col("quality").isNull(), "missing").when(F.col("toxic") == 1, "incomparable").when(F.col("quality") == 1, "right").otherwise("wrong")
    return constraints.accuracy(d.withColumn("result", r), ["source"]).withColumn("coverage", F.round("coverage", 6)).withColumn("accuracy", F.round("accuracy", 6))


@register("contested_accuracies", """WITH m AS (SELECT source, quality FROM documents JOIN labels USING (doc_id)), o AS (SELECT source, avg(quality::DOUBLE) AS p, count(*) AS n FROM m GROUP BY 1)
SELECT d.doc_id, round(CASE WHEN n >= 12 THEN p WHEN n > 0 AND p < 0.85 THEN p ELSE (SELECT avg(quality::DOUBLE) FROM m) END, 6) AS contested_accuracy FROM documents d LEFT JOIN o ON o.source = d.source""")  # fmt: skip
def contested_accuracies(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "field")
    m = d.join(table(spark, sf_dir, "labels"), "doc_id").select("field", F.col("quality").alias("ok"))
    return constraints.contested_accuracy(d, m).select("doc_id", F.round("contested_accuracy", 6).alias("contested_accuracy"))


@register("constructive_systems", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'timber' WHEN 1 THEN 'masonry, outside' WHEN 2 THEN 'masonry, inside or by itself' ELSE '' END AS system, CASE p_partkey % 6 WHEN 3 THEN 'both sides' WHEN 4 THEN 'other structure' WHEN 5 THEN 'insulation not told' ELSE '' END AS note FROM part""")
def constructive_systems(spark, sf_dir):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("p_partkey") % 6 + 1).cast("int"))
    none = None
    s = constraints.constructive_system(pick("Ossature bois", "Béton banché", "Parpaing", "Brique", "Acier", "Béton"), pick(none, "Oui", none, "Oui", none, none), pick(none, none, none, "Oui", none, none), pick(none, none, "Doublage collé", none, none, none))
    return table(spark, sf_dir, "part").select("p_partkey", s["system"].alias("system"), s["note"].alias("note"))


@register("family_mismatches", "SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 AND c_nationkey % 2 = 0")
def family_mismatches(spark, sf_dir):
    k = F.col("c_custkey") % 4
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 1, F.array(F.lit("generic"))).otherwise(F.array(F.lit("rset"))).alias("manual"), F.when(k == 2, F.array(F.lit("rset"), F.lit("carbone"))).when(k == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("dpe"))).alias("detected"), F.when(F.col("c_nationkey") % 2 == 0, 0.8).otherwise(0.7).alias("confidence"))
    return constraints.family_mismatch(c).select("c_custkey")


@register("stale_derivations", "SELECT c_custkey, unnest(list_filter(['buildings', 'hours'], lambda d: CASE d WHEN 'buildings' THEN c_custkey % 5 < 4 ELSE c_custkey % 3 < 2 END)) AS derivation FROM customer")
def stale_derivations(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("buildings"), (k % 5).cast("int"), F.lit("hours"), (k % 3).cast("int")).alias("stamps"))
    return constraints.stale(c, {"buildings": 4, "hours": 2}).select("c_custkey", "derivation")
