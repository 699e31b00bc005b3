"""Queries on economics, plans, pages, completeness and kept readings; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, spread, table
from ..operators import completeness, economics, layouts, measures
from ..sources import pages
from ..sources.store import work_path
from ..streaming import journal


def _t(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_POST = "CASE l_linenumber % 4 WHEN 0 THEN 'structure' WHEN 1 THEN 'openings' WHEN 2 THEN 'other' ELSE 'heating' END"


@register("cost_posts", f"""WITH s AS (SELECT l_orderkey, {_POST} AS post, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, post, round(amount, 2) AS amount, floor(amount / sum(amount) OVER (PARTITION BY l_orderkey) * 1000 + 0.5) / 10 AS pct FROM s""")
def cost_posts(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ["Lot 2 - Gros œuvre / maçonnerie", "Menuiseries extérieures", "Chauffage | Plomberie", "CVC"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    li = table(spark, sf_dir, "lineitem").withColumn("label", label)
    return economics.by_post(li, "l_orderkey", "label", "l_extendedprice").withColumn("amount", F.round("amount", 2))


@register("lot_lines", """SELECT o_orderkey, 'LOT ' || (o_orderkey % 20) || ' - Peinture' AS label, CAST(floor(o_totalprice) AS DOUBLE) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 0.99 ELSE 0.91 END AS confidence FROM orders WHERE o_orderkey % 5 > 0""")
def lot_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, _t("Sous-total LOT ", k % 20, " | 12 | 5")).when(k % 3 == 0, _t("Total LOT ", k % 20, " - Peinture | u | ", F.floor("o_totalprice"), " €")).otherwise(_t("LOT ", k % 20, " - Peinture : | 3 | ", F.floor("o_totalprice")))
    return economics.lot_lines(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("text")), ["o_orderkey"])


@register("economic_results", """WITH o AS (SELECT o_orderkey AS op, o_orderkey % 4 AS k, o_totalprice AS t FROM orders)
SELECT op, round(CASE k WHEN 0 THEN t WHEN 1 THEN 300 WHEN 2 THEN t ELSE 77 END, 2) AS cost_total, CASE WHEN k < 2 THEN 100.0 END AS aid_total, round(CASE k WHEN 0 THEN t - 60 WHEN 1 THEN 240 WHEN 2 THEN t ELSE 77 END, 2) AS own_funds, CASE k WHEN 2 THEN 'bill' WHEN 3 THEN 'manual' ELSE 'questionnaire' END AS source FROM o""")  # fmt: skip
def economic_results(spark, sf_dir):
    k, t = F.col("o_orderkey") % 4, F.col("o_totalprice")
    total = F.when(k == 0, _t('"montantTotalOperation": ', t, ",")).otherwise("")
    doc = _t('{"operation": {"numeroOperation": "OPE-1", "contrat": "12"}, "financier": {', total, '"lignesValidees": [{"source": "DPGF", "lot": "a", "categorie": "Travaux", "montant": 100}, {"lot": "b", "categorie": null, "montant": 200}]}, "aides": {"lignes": [{"aideId": "x", "categorie": "capital", "montant": 60, "etat": "Versée"}, {"aideId": "y", "categorie": "fisc", "montant": 40}]}}')
    o = table(spark, sf_dir, "orders")
    identity, costs, aids = economics.questionnaires(o.select("o_orderkey", F.when(k < 2, doc).when(k == 2, "[1]").alias("json")), "o_orderkey", "json")
    named = lambda df: df.withColumnRenamed("id", "op")
    bills = o.filter(k < 3).select(F.col("o_orderkey").alias("op"), t.alias("amount"))
    manual = o.filter(k == 3).select(F.col("o_orderkey").alias("op"), F.lit(77.0).alias("cost_total"))
    r = economics.result(named(identity), named(costs), bills, named(aids), "op", manual)
    return r.select("op", F.round("cost_total", 2).alias("cost_total"), "aid_total", F.round("own_funds", 2).alias("own_funds"), "source")


@register("questionnaire_cells", """SELECT o_orderkey AS op, 'costs' AS section, 'Travaux' AS label, CAST(o_custkey AS DOUBLE) AS amount FROM orders UNION ALL SELECT o_orderkey, 'aids', 'Prime', 12.5 FROM orders""")
def questionnaire_cells(spark, sf_dir):
    lines = F.array(F.lit("Questionnaire financier"), F.lit("Identité | 5"), F.lit("Données financières validées"), _t("Travaux | HT | ", F.col("o_custkey"), " €"), F.lit("sans montant | ?"), F.lit("Aides mobilisées"), F.lit("Prime | 12,5"), F.lit("Contrôle"), F.lit("x | 9"))
    return economics.questionnaire_cells(spread(table(spark, sf_dir, "orders"), rounds=8).select(F.col("o_orderkey").alias("op"), F.posexplode(lines).alias("idx", "text")), "op")


_CATS = ["visible", "hidden", "recess", "path", "access", "hall", "frame"]


@register("plan_rules", """WITH m AS (SELECT l_suppkey AS s, l_linenumber % 7 AS c, l_quantity / 25 AS v FROM lineitem), g AS (SELECT s, coalesce(sum(v) FILTER (c = 0), 0) AS vi, coalesce(sum(v) FILTER (c = 1), 0) AS hi, max(v) FILTER (c = 2) AS r, min(v) FILTER (c = 3) AS t, coalesce(sum(v) FILTER (c = 4), 0) AS a, coalesce(sum(v) FILTER (c = 5), 0) AS ha, coalesce(sum(v) FILTER (c = 6), 0) AS fr FROM m GROUP BY 1)
SELECT s AS l_suppkey, 'visible_access' AS rule, CASE WHEN vi + hi > 0 THEN CASE WHEN vi / (vi + hi) >= 0.6 THEN 'Oui' ELSE 'Non' END END AS verdict FROM g UNION ALL SELECT s, 'separation', NULL FROM g UNION ALL SELECT s, 'blind_rooms', NULL FROM g UNION ALL SELECT s, 'recess', CASE WHEN r <= 1.2 + 1e-9 THEN 'Oui' WHEN r IS NOT NULL THEN 'Non' END FROM g
UNION ALL SELECT s, 'path_width', CASE WHEN t >= 1.4 - 1e-9 THEN 'Oui' WHEN t IS NOT NULL THEN 'Non' END FROM g UNION ALL SELECT s, 'hall_access', CASE WHEN a = 1 THEN 'Oui' WHEN a > 0 THEN 'Non' END FROM g UNION ALL SELECT s, 'hall_glazing', CASE WHEN ha > 0 AND fr > 0 THEN CASE WHEN fr * 2.2 / ha >= 0.3 THEN 'Oui' ELSE 'Non' END END FROM g""")  # fmt: skip
def plan_rules(spark, sf_dir):
    c = (F.col("l_linenumber") % 7 + 1).cast("int")
    kinds = F.element_at(F.array(*map(F.lit, ["count", "count", "length", "length", "count", "area", "length"])), c)
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", F.element_at(F.array(*map(F.lit, _CATS)), c).alias("cat"), kinds.alias("kind"), (F.col("l_quantity") / 25).alias("value"))
    return measures.plan_rules(m, "l_suppkey").select("l_suppkey", "rule", "verdict")


@register("plan_facts", """WITH m AS (SELECT l_suppkey AS op, l_orderkey AS p, l_linenumber % 3 AS k, l_quantity AS v FROM lineitem), g AS (SELECT op, p, coalesce(sum(2 * v) FILTER (k = 0), 0) AS w, coalesce(sum(6 * v) FILTER (k = 1), 0) AS a, sum(v) FILTER (k = 2) AS n FROM m GROUP BY 1, 2)
SELECT op, 'hall_glazing' AS rule, bool_and(w * 2.2 / a >= 0.3) AS ok FROM g WHERE w > 0 AND a > 0 GROUP BY 1 UNION ALL SELECT op, 'hall_access', bool_and(n = 1) FROM g WHERE n IS NOT NULL GROUP BY 1""")  # fmt: skip
def plan_facts(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("op"), F.col("l_orderkey").alias("plan"), pick("Menuiseries vitrées", "Surface du hall", "Accès au hall").alias("ref"), pick("width", "area", "count").alias("kind"), F.col("l_quantity").alias("avg"), F.when(k == 0, 2).otherwise(6).alias("n"), F.col("l_quantity").alias("total"))
    return measures.plan_facts(r, "op", "plan")


@register("plan_quantities", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'fan_count' AS field, l_quantity AS value FROM lineitem WHERE l_linenumber % 3 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'housing_count', l_quantity FROM lineitem WHERE l_linenumber % 3 = 1")
def plan_quantities(spark, sf_dir):
    ref = F.element_at(F.array(*map(F.lit, ["Nombre de brasseurs d'air", "logements", "Cave"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ref.alias("ref"), F.lit("count").alias("kind"), F.col("l_quantity").alias("total"))
    catalog = spark.createDataFrame([("fan_count", "Brasseur d’air"), ("housing_count", "Nombre de logements")], "field string, label string")
    return measures.plan_quantities(li, catalog).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "field", "value")


@register("plan_labels", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Chambre 2' WHEN 1 THEN 'Logement ' || c_custkey || ' - T3 bis' ELSE 'Hall' END AS name, CASE c_custkey % 3 WHEN 0 THEN 'Chambre' WHEN 1 THEN 'Logement' END AS cat, CASE c_custkey % 3 WHEN 1 THEN 'T3 bis' END AS typology, CASE WHEN c_custkey % 3 < 2 THEN c_nationkey + 0.25 END AS surface FROM customer""")
def plan_labels(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    label = F.when(k % 3 == 0, _t("Chambre  2 ", n, ".25 m²")).when(k % 3 == 1, _t("Logement ", k, " - T3 bis - ", n, ",25 m2")).otherwise("Hall")
    p = measures.plan_label(label)
    return table(spark, sf_dir, "customer").select("c_custkey", *[p[f].alias(f) for f in ("name", "cat", "typology", "surface")])


@register("insulation_layers", """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN greatest(20.0 + p_size, 40) END AS principal, CASE p_partkey % 3 WHEN 0 THEN 60.0 + p_size WHEN 1 THEN greatest(20.0 + p_size, 40) + CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 0 END END AS total, CASE WHEN p_partkey % 3 = 0 THEN floor((60.0 + p_size) / 1000 / 0.04 / 0.05 + 0.5) * 5 / 100 END AS r FROM part""")
def insulation_layers(spark, sf_dir):
    k, s = F.col("p_partkey") % 3, F.col("p_size")
    text = F.when(k == 0, _t("LDV ", s + 20, " + 40 mm, λ 0,040")).when(k == 1, _t("PSE ", F.greatest(s + 20, F.lit(40)), "mm + plaque 13 mm")).otherwise("béton 12 mm")
    x = measures.layers(text)
    r = measures.resistance(text, x["total"])
    return table(spark, sf_dir, "part").select("p_partkey", x["principal"].alias("principal"), x["total"].alias("total"), r.alias("r"))


@register("layer_quality", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS ocr, event_id % 5 = 3 AS dense FROM events""")
def layer_quality(spark, sf_dir):
    good = "Le bâtiment est isolé par l'extérieur et les logements sont chauffés par une chaudière au gaz dans la cave. "
    texts = ["", "@@ ## && ++ == << >> %% $$ !! " * 8, "Chapitre deux, résultats du calcul", good * 6, "xqz wvk jjq zzx qqw " * 8]
    k = (F.col("event_id") % 5 + 1).cast("int")
    e = spread(table(spark, sf_dir, "events").select("event_id")).select("event_id", F.element_at(F.array(*map(F.lit, texts)), k).alias("t"), F.element_at(F.array(*map(F.lit, [0, 40, 2, 60, 40])), k).alias("n"))
    e = e.withColumn("q", pages.layer_quality(F.col("t"), F.col("n")))
    return e.select("event_id", pages.needs_recognition(F.col("q"), F.col("n")).alias("ocr"), pages.clean_dense(F.col("q"), F.col("n")).alias("dense"))


@register("cells_by_column", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity >= 34 THEN 'right' WHEN l_quantity >= 14 THEN 'middle' WHEN l_quantity >= 4 THEN 'left' END AS \"column\" FROM lineitem")
def cells_by_column(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_orderkey").alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"))
    heads = li.select(F.col("l_orderkey").alias("page")).distinct().select("page", F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(n).alias("name")) for x, n in ((10.0, "left"), (20.0, "middle"), (40.0, "right"))])))
    return pages.cells_by_column(items, heads, ["page"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "column")


@register("recognised_lines", "SELECT o_orderkey, 0 AS idx, 'a' || o_orderkey AS text, 5.0::DOUBLE AS y FROM orders UNION ALL SELECT o_orderkey, 1, 'b', 9.0 FROM orders WHERE o_orderkey % 2 = 0")
def recognised_lines(spark, sf_dir):
    box = lambda y: F.struct(F.lit(0.0).alias("x0"), F.lit(y).alias("y0"), F.lit(1.0).alias("x1"), F.lit(y + 1).alias("y1"))
    line = lambda t, y: F.struct(t.alias("text"), F.lit(90.0).alias("confidence"), box(y).alias("bbox"))
    block = lambda *x: F.struct(F.array(*x).alias("lines"))
    b = F.array(block(line(_t(" a", F.col("o_orderkey")), 5.0), line(F.lit("  "), 7.0)), block(line(F.when(F.col("o_orderkey") % 2 == 0, "b"), 9.0)))
    return pages.recognised_lines(table(spark, sf_dir, "orders").select("o_orderkey", b.alias("blocks")), ["o_orderkey"]).select("o_orderkey", "idx", "text", "y")


@register("document_status", """WITH d AS (SELECT user_id AS doc_id, user_id % 2 AS k FROM events GROUP BY 1, 2), f AS (SELECT DISTINCT user_id AS doc_id, event_type AS field FROM events)
SELECT d.doc_id, CASE WHEN k = 0 THEN 2 ELSE 7 END AS expected, CASE WHEN k = 0 THEN (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id AND field = 'click') ELSE (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id AND field IN ('view', 'error')) END AS hit FROM d""")  # fmt: skip
def document_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("doc_id")).distinct().withColumn("families", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("dpe"))).otherwise(F.array(F.lit("cctp"))))
    names = {"click": "dpe_energy_after", "view": "ventilation", "error": "wall_insulation"}
    f = e.select(F.col("user_id").alias("doc_id"), F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")].alias("field")).filter("field is not null")
    return completeness.document_status(d, f)


@register("operation_completion", """SELECT l_suppkey, CAST(floor(avg((CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END + 1) / 3.0::DOUBLE) * 100 + 0.5) AS INTEGER) AS pct FROM lineitem GROUP BY 1""")
def operation_completion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise(" ").alias("a"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("b"), "l_returnflag")
    return completeness.completion(li, "l_suppkey", ["a", "b", "l_returnflag"])


@register("reliability_counts", """SELECT l_suppkey, count(*) FILTER (l_linenumber = 1) AS certified, count(*) FILTER (l_linenumber = 2) AS sure, count(*) FILTER (l_linenumber = 3) AS probable, count(*) FILTER (l_linenumber > 3) AS "to-check" FROM lineitem GROUP BY 1""")
def reliability_counts(spark, sf_dir):
    level = F.when(F.col("l_linenumber") == 1, "certified").when(F.col("l_linenumber") == 2, "sure").when(F.col("l_linenumber") == 3, "probable").otherwise("to-check")
    return completeness.levels(table(spark, sf_dir, "lineitem").withColumn("level", level), ["l_suppkey"], "level")


@register("first_filled", """SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 > 0) AS status, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 5 = 0) AS priority FROM orders GROUP BY 1""")
def first_filled(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 3 > 0, F.col("o_orderstatus")).otherwise(" ").alias("status"), F.when(k % 5 == 0, F.col("o_orderpriority")).alias("priority"))
    return completeness.first_filled(o, "o_custkey", ["o_orderkey"], ["status", "priority"])


@register("reference_only", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def reference_only(spark, sf_dir):
    return completeness.only_in_reference(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@register("text_positions", """SELECT doc_id, length(h) - length(replace(h, chr(10), '')) AS line, p - (length(h) - coalesce(length(h) - strpos(reverse(h), chr(10)) + 1, 0) * CASE WHEN contains(h, chr(10)) THEN 1 ELSE 0 END) AS start
FROM (SELECT doc_id, length(text) // 2 AS p, substr(text, 1, length(text) // 2) AS h FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def text_positions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    p = completeness.position(F.col("text"), F.floor(F.char_length("text") / 2).cast("int"))
    return d.select("doc_id", p["line"].cast("bigint").alias("line"), p["start"].cast("bigint").alias("start"))


@register("retained_readings", "SELECT event_id, event_id % 2 = 1 AS removed FROM events WHERE event_id % 2 = 0 OR user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0)")
def retained_readings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"))
    return pages.with_retained(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")).select("event_id", "removed")


@register("manual_facts", "SELECT c_custkey, 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey > 5")
def manual_facts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment").alias("segment"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("nation"))
    return pages.manual_facts(c, ["c_custkey"], ["segment", "nation"]).select("c_custkey", "field", "value")


@register("last_events", "SELECT event_id FROM events WHERE value > 20 ORDER BY ts DESC, event_id DESC LIMIT 500")
def last_events(spark, sf_dir):
    return pages.last_events(table(spark, sf_dir, "events"), ["ts", "event_id"], 500, F.col("value") > 20).select("event_id")


@register("paste_rewrites", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Bâtiment ' || c_custkey || ' : 5' ELSE 'Bat ' || c_custkey || ' = 5' END AS text FROM customer")
def paste_rewrites(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, _t("Bat. ", F.col("c_custkey"), " = 5")).otherwise(_t("Bat ", F.col("c_custkey"), " = 5"))
    return table(spark, sf_dir, "customer").select("c_custkey", layouts.rewrite(text, [("Bat\\. ", "Bâtiment ", None), (" = ", " : ", "Bâtiment")]).alias("text"))


@register("signature_scores", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 8.0 END AS rset, CASE event_id % 3 WHEN 1 THEN 8.0 WHEN 0 THEN 3.0 END AS carbon FROM events""")
def signature_scores(spark, sf_dir):
    t = F.element_at(F.array(*map(F.lit, ["recapitulatif standardise re2020 acv", "acv logiciel", "acv brouillon"])), (F.col("event_id") % 3 + 1).cast("int"))
    s = layouts.signature_scores(t, [layouts.Signature(all=("recapitulatif",), any=("re2020", "rt2012"), doc_type="rset"), layouts.Signature(all=("acv", "logiciel"), doc_type="carbon"), layouts.Signature(any=("acv",), none=("brouillon", "logiciel"), doc_type="carbon", weight=3.0)])
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(s, F.lit("rset")).alias("rset"), F.try_element_at(s, F.lit("carbon")).alias("carbon"))


@register("stream_journal_for_good", "SELECT event_id, user_id FROM events")
def stream_journal_for_good(spark, sf_dir):
    """The journal is sent twice, days apart in event time and by two runs of the stream."""
    path = work_path(spark, "journal-for-good")
    e = journal.read_journal(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    journal.append_for_good(e, path)
    journal.append_for_good(e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 90 DAYS")), f"{path}", offsets="again")
    return spark.read.parquet(f"{path}/rows").select("event_id", "user_id")


@register("unchanged_files", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def unchanged_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("size"))
    seen = e.filter("event_id % 3 <> 0").union(e.filter("event_id % 3 = 0").select("event_id", F.col("size") + 1))
    return journal.unchanged(e, seen, "event_id", ["size"]).select("event_id")


@register("stream_progress", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_progress(spark, sf_dir):
    """What an update-mode stream has told last of each key."""
    path = work_path(spark, "progress")
    q = journal.progress(journal.read_journal(spark, f"{sf_dir}/events.parquet"), ["event_type"])
    journal.keep_last(q, path, ["event_type"])
    return journal.registry(spark, path).select("event_type", "n", F.round("total", 4).alias("total"))
