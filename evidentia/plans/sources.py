"""Queries on names, headers, folders, layouts and regulatory XML. Their inputs are texts made of the tables' numbers, so that the SQL twins are told from the numbers alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, spread, table
from ..functions import names
from ..functions.text import fold
from ..operators import folders, headers, layouts
from ..sources import re2020


def _t(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@register("building_names", """WITH v AS (SELECT c_custkey, c_custkey % 900 AS k, c_custkey % 6 AS v FROM customer)
SELECT c_custkey, CASE v WHEN 0 THEN 'Bâtiment A' || k WHEN 1 THEN 'Bâtiment ' || k || ' EST' WHEN 2 THEN 'Bâtiment RUE' WHEN 3 THEN 'Bâtiment unique' WHEN 4 THEN 'Bâtiment ' || k || '.5' ELSE 'Bâtiment ' || k || ' ET ' || (k + 1) END AS canonical,
  CASE v WHEN 0 THEN 'a' || k WHEN 1 THEN k || ' est' WHEN 2 THEN 'rue' WHEN 3 THEN 'unique' WHEN 4 THEN k || ' 5' ELSE k || ' et ' || (k + 1) END AS key, CASE WHEN v = 1 THEN CAST(k AS VARCHAR) ELSE '' END AS qualified, v = 4 AS ghost, v = 5 OR v = 4 AS listed FROM v""")  # fmt: skip
def building_names(spark, sf_dir):
    v, k = F.col("c_custkey") % 6, F.col("c_custkey") % 900
    name = F.when(v == 0, _t("bât. a", k, " (2 zones)")).when(v == 1, _t("Bâtiment : ", k, " Est")).when(v == 2, "Immeuble rue").when(v == 3, "unique").when(v == 4, _t("Bâtiment ", k, ".5")).otherwise(_t("Bâtiment ", k, " et ", k + 1))
    c = table(spark, sf_dir, "customer").select("c_custkey", name.alias("n"))
    n = F.col("n")
    return c.select("c_custkey", names.canonical(n).alias("canonical"), names.key(n).alias("key"), names.qualified_core(n).alias("qualified"), names.is_ghost(names.canonical(n)).alias("ghost"), names.is_list(n).alias("listed"))


CATALOG = [("cep", "Cep projet"), ("cep_max", "Cep max projet"), ("shab", "Surface habitable totale"), ("owner", "Nom du maître d'ouvrage"), ("contract_number", "Numéro du contrat"), ("internal_code", "Code interne"), ("stage", "Phase")]


def _catalog(spark):
    return spark.createDataFrame([(f, label, i) for i, (f, label) in enumerate(CATALOG)], "field string, label string, place int")


@register("header_match", """WITH v AS (SELECT DISTINCT c_custkey % 8 AS v FROM customer)
SELECT v, CASE v WHEN 0 THEN 'cep' WHEN 1 THEN 'shab' WHEN 2 THEN 'stage' WHEN 3 THEN 'cep_max' WHEN 4 THEN 'shab' END AS field, CASE v WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'normalized' WHEN 3 THEN 'fuzzy' WHEN 4 THEN 'fuzzy' END AS mode,
  CASE v WHEN 0 THEN 1 WHEN 1 THEN 0.99 WHEN 2 THEN 0.97 WHEN 3 THEN 1 WHEN 4 THEN 1 END::DOUBLE AS score FROM v WHERE v <= 4""")  # fmt: skip
def header_match(spark, sf_dir):
    v = F.col("c_custkey") % 8
    shown = F.element_at(F.array(*map(F.lit, ["CEP  PROJET", "SHAB", "Opération phase", "Projet : cep, max", "totale surface habitable", "Cep 2028", "Habitable", "xyz"])), (v + 1).cast("int"))
    h = table(spark, sf_dir, "customer").select(v.alias("v"), shown.alias("header"))
    found = headers.match_headers(h, _catalog(spark), spark.createDataFrame([("SHAB", "shab")], "alias string, field string"))
    return h.distinct().join(found, "header").select("v", "field", "mode", F.round("score", 6).alias("score"))


def _sheet(spark, sf_dir):
    """A sheet for each customer: a title, a header, and a row for each order."""
    o = table(spark, sf_dir, "orders").withColumn("n", F.col("o_orderkey"))
    cell = lambda row, col, text: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), text.alias("text"))
    rows = F.array(cell(F.col("n") + 3, 0, F.col("o_orderkey").cast("string")), cell(F.col("n") + 3, 1, _t("", F.floor("o_totalprice"))), cell(F.col("n") + 3, 2, F.lit("note")))
    body = o.select(F.col("o_custkey").alias("doc_id"), F.inline(rows))
    head = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text")) for r, c, t in ((0, 0, "Suivi des opérations"), (2, 0, "Numéro du contrat"), (2, 1, "Cep projet"), (2, 2, "Remarques"))])
    return body.unionByName(o.select(F.col("o_custkey").alias("doc_id")).distinct().select("doc_id", F.inline(head)))


_SHEET = "s AS (SELECT o_custkey AS doc_id, o_orderkey + 3 AS row, o_orderkey, floor(o_totalprice) AS p FROM orders)"


@register("sheet_values", f"""WITH {_SHEET} SELECT doc_id, CAST(row AS INTEGER) AS row, 'contract_number' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM s UNION ALL SELECT doc_id, CAST(row AS INTEGER), 'cep', CAST(CAST(p AS BIGINT) AS VARCHAR) FROM s""")
def sheet_values(spark, sf_dir):
    return headers.tagged_sheets(_sheet(spark, sf_dir), _catalog(spark)).select("doc_id", "row", "field", "value")


@register("operation_rows", """WITH n AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS op, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS v FROM orders), e AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS op, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE '12' END AS v FROM orders WHERE o_orderkey % 4 < 3)
SELECT op AS operation, CASE WHEN e.v IS NULL OR e.v = '' THEN n.v ELSE e.v END AS value, CASE WHEN e.v IS NULL OR e.v = '' THEN 'filled' WHEN e.v = n.v THEN 'kept' ELSE 'conflict' END AS change FROM n LEFT JOIN e USING (op)""")  # fmt: skip
def operation_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    old = table(spark, sf_dir, "orders").filter(k % 4 < 3).select(F.lpad(k.cast("string"), 8, "0").alias("operation"), F.lit("Bâtiment unique").alias("building"), F.lit("cep").alias("field"), F.when(k % 4 == 0, "").when(k % 4 == 1, _t("", F.floor("o_totalprice"))).otherwise("12").alias("value"))
    values = headers.tagged_sheets(_sheet(spark, sf_dir), _catalog(spark))
    return headers.operation_rows(values, old).select("operation", "value", "change")


@register("export_records", """SELECT c_custkey AS doc_id, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS contract, CASE WHEN c_custkey % 2 = 0 THEN 'OPE-' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') END AS code, CASE WHEN c_custkey % 3 > 0 THEN lpad(CAST(1000 + c_custkey % 80000 AS VARCHAR), 5, '0') END AS postcode,
  'Ville ' || c_nationkey AS city, CASE WHEN c_nationkey > 0 THEN CAST(c_nationkey AS INTEGER) END AS buildings FROM customer""")  # fmt: skip
def export_records(spark, sf_dir):
    k = F.col("c_custkey")
    cells = [F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), x.cast("string").alias("text")) for c, x in enumerate(row)]) for r, row in enumerate([
        [F.lit("Export du jour"), F.lit(""), F.lit(""), F.lit(""), F.lit("")], [F.lit("Opération: Numéro du contrat"), F.lit("Évaluation: Code interne"), F.lit("Code postal de l'opération (texte)"), F.lit("Opération: Ville"), F.lit("Total bâtiments")],
        [_t("", k), F.when(k % 2 == 0, _t("OPE-", F.lpad((k % 1000000).cast("string"), 6, "0"))).otherwise("X"), F.when(k % 3 > 0, _t("", 1000 + k % 80000)).otherwise("?"), _t("Ville   ", F.col("c_nationkey")), _t("", F.col("c_nationkey"))],
    ])]
    c = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.inline(F.flatten(F.array(*cells))))
    return headers.export_records(c).select("doc_id", "contract", "code", "postcode", "city", "buildings")


@register("pasted_contracts", "SELECT c_custkey AS doc_id, lpad(CAST(100 + c_custkey AS VARCHAR), 8, '0') AS contract FROM customer UNION ALL SELECT c_custkey, lpad(CAST(5000 + c_custkey AS VARCHAR), 8, '0') FROM customer")
def pasted_contracts(spark, sf_dir):
    k = F.col("c_custkey")
    cell = lambda r, c, x: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), x.cast("string").alias("text"))
    c = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.inline(F.array(cell(0, 0, F.lit("Dupont")), cell(0, 1, 100 + k), cell(1, 0, F.lit("123456")), cell(1, 1, 5000 + k), cell(2, 0, F.lit("nom")), cell(2, 1, 100 + k))))
    return headers.contract_column(c)


@register("contract_folders", """WITH f AS (SELECT o_orderkey AS k, 100000 + o_custkey AS c, o_orderstatus = 'F' AS gone FROM orders), g AS (SELECT c, count(*) FILTER (NOT gone) AS n, count(*) AS m FROM f GROUP BY 1)
SELECT lpad(CAST(100000 + c_custkey AS VARCHAR), 8, '0') AS contract, CASE WHEN m IS NULL THEN 'missing' WHEN n = 0 THEN 'only cancelled' WHEN n = 1 THEN 'found' ELSE 'multiple' END AS status, coalesce(n, 0) AS n FROM customer LEFT JOIN g ON c = 100000 + c_custkey""")  # fmt: skip
def contract_folders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(_t("archives/", F.when(F.col("o_orderstatus") == "F", "Annulée - ").otherwise(""), 100000 + F.col("o_custkey"), " - 93 - Opération ", F.col("o_orderkey")).alias("name"))
    wanted = table(spark, sf_dir, "customer").select(F.lpad((100000 + F.col("c_custkey")).cast("string"), 8, "0").alias("contract"))
    return folders.match_contracts(o, wanted).select("contract", "status", "n")


@register("shared_contracts", "SELECT lpad(CAST(100000 + o_custkey AS VARCHAR), 8, '0') AS contract, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def shared_contracts(spark, sf_dir):
    return folders.shared_contracts(table(spark, sf_dir, "orders").select(_t("", 100000 + F.col("o_custkey"), " - Opération ", F.col("o_orderkey")).alias("name")))


@register("folder_rules", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'outdated folder' WHEN 1 THEN 'outdated folder' WHEN 3 THEN 'hidden' WHEN 4 THEN 'too deep' END AS skipped, CASE event_id % 8 WHEN 2 THEN 'product sheet' WHEN 5 THEN 'format dwg' WHEN 6 THEN 'temporary file' WHEN 7 THEN 'no extension' END AS ignored FROM events""")
def folder_rules(spark, sf_dir):
    paths = ["03 - Études/Anciennes versions/a.pdf", "OLD/a.pdf", "2. Ancienne Mairie/FDES_isolant.pdf", ".git/a.pdf", "a/b/c/d/e/f/g/h/i/a.pdf", "Plans/x.dwg", "Plans/~$x.xlsx", "Plans/lisez"]
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, paths)), (F.col("event_id") % 8 + 1).cast("int")).alias("path"))
    w = folders.walk(e).select("path", "name", "skipped").distinct()
    return e.join(w, "path").select("event_id", "skipped", folders.ignore_reason(F.col("name")).alias("ignored"))


@register("lots_to_read", """SELECT event_id, event_id % 4 <> 1 AS read, CASE event_id % 4 WHEN 0 THEN 'wanted lot' WHEN 1 THEN 'other lot' WHEN 3 THEN 'wanted lot' ELSE '' END AS reason FROM events""")
def lots_to_read(spark, sf_dir):
    n = F.element_at(F.array(*map(F.lit, ["CCTP_lot 05 Plomberies.pdf", "CCTP lot 3 - Peinture.pdf", "CCTP compilé.pdf", "CCTP-PLB.pdf"])), (F.col("event_id") % 4 + 1).cast("int"))
    d = folders.read_lot(n, ["plomberie"])
    return spread(table(spark, sf_dir, "events").select("event_id")).withColumn("d", d).select("event_id", F.col("d.read").alias("read"), F.col("d.reason").alias("reason"))


@register("loadable_files", "SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 > 0 AND (event_id % 5 = 0 OR (event_id % 5 = 1 AND event_id % 7 = 0))")
def loadable_files(spark, sf_dir):
    i = F.col("event_id")
    f = table(spark, sf_dir, "events").select("event_id", i.alias("id"), (i % 2 == 0).alias("current"), (i % 3 == 0).alias("missing"), F.lit("r").alias("result"), F.when(i % 5 == 0, "done").when(i % 5 == 1, "review").otherwise("error").alias("state"))
    return folders.loadable(f, f.filter(i % 7 == 0).select("id", F.lit(True).alias("accepted"))).select("event_id")


@register("operation_counters", """SELECT user_id AS operation, count(*) AS total, count(*) FILTER (event_type = 'view') AS done, count(*) FILTER (event_type = 'click') AS review, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS ignored,
  count(*) FILTER (value > 20) AS missing, count(*) FILTER (event_type = 'purchase') AS todo FROM events GROUP BY 1""")  # fmt: skip
def operation_counters(spark, sf_dir):
    state = F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "click", "review").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "ignored")
    return folders.counters(table(spark, sf_dir, "events").select(F.col("user_id").alias("operation"), state.alias("state"), (F.col("value") > 20).alias("missing")))


@register("content_reuse", "WITH r AS (SELECT text, max(doc_id) AS result FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT d.doc_id, r.result FROM documents d LEFT JOIN r ON r.text = d.text")
def content_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return folders.reuse(d, d.filter(F.col("doc_id") % 2 == 0).select("sha", F.col("doc_id").alias("result"))).select("doc_id", "result")


def _reports(spark, sf_dir):
    """A report of two buildings for each order, of one of four types."""
    k, p = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda c: F.format_string("%.0f", c.cast("double"))
    one = lambda b, v: F.concat_ws("\n", F.concat(F.lit("1.2 BÂTIMENT "), F.lit(b)), F.concat(F.lit("Coefficient Bbio "), n(v), F.lit(",5 80,0 10 %")), F.concat(F.lit("Coefficient Cep "), n(v + 20), F.lit(" 90,0 5 %")))
    v = 40 + p % 20
    rset = F.concat_ws("\n", F.lit("Récapitulatif standardisé"), one("A", v), one("B2", v + 1))
    carbon = F.concat_ws("\n", F.lit("Bâtiment C"), F.concat(F.lit("Ic composant kgCO2e/m² : "), n(600 + p % 50)), F.concat(F.lit("IC composants lot 8 = "), n(10 + p % 9), F.lit(",25")))
    cctp = F.concat_ws("\n", F.lit("Descriptif"), F.concat(F.lit("Murs : laine de verre "), n(100 + p % 90), F.lit(" mm")), F.lit("Menuiseries extérieures PVC, double vitrage"), F.lit("Chauffage par pompe à chaleur"))
    other = F.concat_ws("\n", F.lit("Notice"), F.lit("Label bâtiment biosourcé, niveau 2 du label 2012"))
    kind = k % 4
    return spread(table(spark, sf_dir, "orders"), rounds=8).select(k.alias("doc_id"), F.when(kind == 0, rset).when(kind == 1, carbon).when(kind == 2, cctp).otherwise(other).alias("text"), F.when(kind == 0, "RT2012").when(kind == 1, "CARBON").when(kind == 2, "CCTP").alias("doc_type"), kind.alias("kind"))


@register("layout_facts", """WITH o AS (SELECT o_orderkey AS d, o_orderkey % 4 AS k, o_custkey AS p, 40 + o_custkey % 20 AS v FROM orders), b AS (SELECT d, v + i AS v, 'Bâtiment ' || n AS b FROM o, (VALUES (0, 'A'), (1, 'B2')) x(i, n) WHERE k = 0)
SELECT d AS doc_id, b AS building, 'bbio' AS field, v + 0.5 AS value_num, NULL AS value_text FROM b UNION ALL SELECT d, b, 'bbio_max', 80, NULL FROM b UNION ALL SELECT d, b, 'bbio_gain', 10, NULL FROM b UNION ALL SELECT d, b, 'cep', v + 20, NULL FROM b UNION ALL SELECT d, b, 'cep_max', 90, NULL FROM b UNION ALL SELECT d, b, 'cep_gain', 5, NULL FROM b
UNION ALL SELECT d, 'Bâtiment C', 'ic_components', 600 + p % 50, NULL FROM o WHERE k = 1 UNION ALL SELECT d, 'Bâtiment C', 'ic_lot_8', 10.25 + p % 9, NULL FROM o WHERE k = 1
UNION ALL SELECT d, 'Bâtiment unique', 'wall_insulation_thickness', 100 + p % 90, NULL FROM o WHERE k = 2 UNION ALL SELECT d, 'Bâtiment unique', f, NULL, t FROM o, (VALUES ('window_material', 'PVC'), ('window_glazing', 'double'), ('heating_mode_after', 'pompe a chaleur')) x(f, t) WHERE k = 2
UNION ALL SELECT d, 'Bâtiment unique', f, NULL, t FROM o, (VALUES ('mention_biosourced_building', 'Oui'), ('biosourced_2013', 'niveau 2')) x(f, t) WHERE k = 3""")  # fmt: skip
def layout_facts(spark, sf_dir):
    return layouts.parse(_reports(spark, sf_dir)).select("doc_id", "building", "field", "value_num", "value_text")


@register("layout_packs", """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'rt2012+systems+envelope' WHEN 1 THEN 'carbone' WHEN 2 THEN 'envelope+systems' ELSE 'biosourced' END AS packs FROM orders""")
def layout_packs(spark, sf_dir):
    return _reports(spark, sf_dir).select("doc_id", F.array_join(layouts.dispatch(F.col("doc_type"), fold(layouts.plain(F.col("text")))), "+").alias("packs"))


@register("detected_buildings", """WITH o AS (SELECT o_orderkey AS d, o_orderkey % 4 AS k FROM orders) SELECT d AS doc_id, b AS building, CAST(l AS INTEGER) AS first_line FROM o, (VALUES (0, 'Bâtiment A', 0), (0, 'Bâtiment B2', 4), (1, 'Bâtiment C', 0), (2, 'Bâtiment unique', 0), (3, 'Bâtiment unique', 0)) x(kk, b, l) WHERE k = kk""")
def detected_buildings(spark, sf_dir):
    return layouts.detect_buildings(_reports(spark, sf_dir)).select("doc_id", "building", "first_line")


@register("resultless_buildings", """WITH f AS (SELECT user_id AS op, event_id % 5 AS building, event_type AS field, event_id FROM events), h AS (SELECT DISTINCT op, building FROM f WHERE field = 'error' AND event_id % 3 = 0)
SELECT event_id FROM f WHERE (op, building) IN (SELECT op, building FROM h) OR op NOT IN (SELECT op FROM h)""")  # fmt: skip
def resultless_buildings(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("op"), (F.col("event_id") % 5).alias("building"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "cep").otherwise("other").alias("field"), "event_id")
    return layouts.resultless(f, ["cep"]).select("event_id")


_HEATERS = [("chaudière gaz", "Gaz"), ("fioul", "Fioul"), ("chaudière bois", "Bois"), ("PAC air/eau", "Électricité"), ("réseau de chaleur", "RCU")]


@register(
    "hybrid_energies",
    f"""
    WITH e AS (SELECT event_id, 1 + CAST(props->>'$.k' AS BIGINT) % 5 AS a, 1 + CAST(floor(value) AS BIGINT) % 5 AS b, (event_id + user_id) % 6 AS f, {[v for _, v in _HEATERS]} AS v FROM events),
    n AS (SELECT event_id, f, v[a] AS x, v[b] AS y FROM e)
    SELECT event_id, CASE WHEN f = 4 THEN NULL WHEN f = 5 OR x = y THEN 'Hybride' WHEN f = 0 THEN 'Hybride ' || y || '/' || x ELSE 'Hybride ' || x || '/' || y END AS energies FROM n
    """,
)
def hybrid_energies(spark, sf_dir):
    """Sentences on heating whose generators, their order and the word for the auxiliary vary with the numbers of a row."""
    e = table(spark, sf_dir, "events")
    pick = lambda i: F.element_at(F.array(*[F.lit(t) for t, _ in _HEATERS]), (1 + i % len(_HEATERS)).cast("int"))
    a, b, f = pick(F.get_json_object("props", "$.k").cast("long")), pick(F.floor("value")), (F.col("event_id") + F.col("user_id")) % 6
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    told = (
        F.when(f == 0, text("Chauffage hybride : ", a, " en appoint, ", b)).when(f == 1, text("Bi-énergie : ", a, " et relève par ", b)).when(f == 2, text("Système hybride, ", a, " avec appoint ", b))
        .when(f == 3, text("Production bivalente ", a, " puis ", b)).when(f == 4, text(a, " | VMC hybride | ", b)).otherwise(text("Chauffage hybride ", a))
    )
    return spread(e.select("event_id", told.alias("t"))).select("event_id", layouts.hybrid_energy(F.col("t")).alias("energies"))


@register("proposal_checks", """SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'field' WHEN 2 THEN 'page' WHEN 3 THEN 'not on the page' WHEN 4 THEN 'value not in the quote' WHEN 5 THEN 'short quote' END AS reason, CASE WHEN event_id % 6 = 0 THEN 10.0 + event_id % 50 END AS value_num FROM events""")
def proposal_checks(spark, sf_dir):
    i = F.col("event_id")
    v = 10 + i % 50
    e = table(spark, sf_dir, "events")
    pages = e.select(i.alias("doc_id"), F.lit(1).alias("page"), _t("Étude\nCep  projet : ", v, ",0 kWh").alias("text"))
    quote = F.when(i % 6 == 3, "Cep initial : 5").when(i % 6 == 5, "Cep").otherwise(_t("cep projet: ", v, ",0"))
    p = e.select(i.alias("event_id"), i.alias("doc_id"), F.when(i % 6 == 1, "other").otherwise("cep").alias("field"), F.when(i % 6 == 4, "999").otherwise(_t("", v)).alias("value"), F.when(i % 6 == 2, 7).otherwise(1).alias("page"), quote.alias("quote"))
    return layouts.verify_proposals(p, pages, {"cep": "number"}).select("event_id", "reason", "value_num")


@register("pages_to_ask", """WITH p AS (SELECT o_custkey AS d, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 2.5 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS s FROM orders), w AS (SELECT *, count(*) OVER (PARTITION BY d) AS c, count(*) FILTER (s > 0) OVER (PARTITION BY d) AS h, row_number() OVER (PARTITION BY d ORDER BY s DESC, n) AS r FROM p)
SELECT d AS doc_id, n AS page FROM w WHERE r <= 6 AND (s > 0 OR (h = 0 AND c <= 6))""")  # fmt: skip
def pages_to_ask(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("page"), F.when(k % 3 == 0, "Surface habitable").when(k % 3 == 1, "le cep").otherwise("rien").alias("text"))
    return layouts.pages_to_ask(p, {"shab": ["habitable"], "cep": ["cep"]}, {"shab": "Surface de plancher", "cep": "Cep"}).select("doc_id", "page")


def _studies(spark, sf_dir):
    """A regulatory XML study of one building for each order, its walls the order's lines."""
    li = table(spark, sf_dir, "lineitem")
    wall = _t('<parois_opaques type_paroi="', F.when(F.col("l_returnflag") == "A", 100).when(F.col("l_returnflag") == "N", 300).otherwise(400), '"><nature>101</nature><name>', F.col("l_linestatus"), "</name><surface_totale>", F.col("l_quantity"), "</surface_totale><resistance_thermique_isolant>", F.col("l_linenumber"), "</resistance_thermique_isolant></parois_opaques>")
    walls = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(wall)), "").alias("walls"))
    o = table(spark, sf_dir, "orders").join(walls, F.col("o_orderkey") == F.col("k"), "left")
    c = F.col("o_custkey")
    xml = F.concat_ws("", _t("<?xml version='1.0'?><projet version='1'><Datas_Comp><donnees_generales><operation><nom>Op &amp; ", F.col("o_orderkey"), "</nom><adresse><postcode>75011</postcode></adresse></operation></donnees_generales><batiment_collection><batiment><Index>1</Index><enveloppe>"), F.coalesce("walls", F.lit("")), F.lit("</enveloppe></batiment></batiment_collection></Datas_Comp>"),
        _t("<RSET><Entree_Projet><Batiment_Collection><Batiment><Index>1</Index><Name>Bât A</Name><Zone_Collection><Zone><Index>1</Index><NB_logement>", c % 50, "</NB_logement><Is_Traversant>1</Is_Traversant><Groupe_Collection><Groupe><SHAB>", 100 + c, "</SHAB></Groupe><Groupe><SHAB>50</SHAB></Groupe></Groupe_Collection></Zone></Zone_Collection></Batiment></Batiment_Collection></Entree_Projet>"),
        _t("<Sortie_Projet><Sortie_Batiment_B_Collection><Sortie_Batiment_B><Index>1</Index><O_Bbio_pts_annuel>", c % 90, ".5</O_Bbio_pts_annuel></Sortie_Batiment_B></Sortie_Batiment_B_Collection><Sortie_Batiment_C_Collection><Sortie_Batiment_C><Index>1</Index><O_Cef_elec_imp_annuel>10</O_Cef_elec_imp_annuel><O_Cef_gaz_imp_ch_annuel>", c % 7, "</O_Cef_gaz_imp_ch_annuel></Sortie_Batiment_C></Sortie_Batiment_C_Collection>"),
        _t("<Sortie_Batiment_D_Collection><Sortie_Batiment_D><Index>1</Index><Sortie_Zone_D_Collection><Sortie_Zone_D><Index>1</Index><Sortie_Groupe_D_Collection><Sortie_Groupe_D><O_NbDegresHeures>", c % 400, "</O_NbDegresHeures><O_NbDegresHeures_max>1250</O_NbDegresHeures_max></Sortie_Groupe_D><Sortie_Groupe_D><O_NbDegresHeures>100</O_NbDegresHeures><O_NbDegresHeures_max>1250</O_NbDegresHeures_max></Sortie_Groupe_D></Sortie_Groupe_D_Collection></Sortie_Zone_D></Sortie_Zone_D_Collection></Sortie_Batiment_D></Sortie_Batiment_D_Collection></Sortie_Projet></RSET>"),
        _t("<RSEnv><sortie_projet><batiment><index>1</index><indicateur_perf_env><ic_energie>", 5 + c % 300, "</ic_energie></indicateur_perf_env><contributeur><composant><lot ref='3'><ic>12.5</ic></lot></composant><energie><sous_contributeur ref='2'><indicateur_co2_dynamique><valeur_phase_acv>1.5</valeur_phase_acv><valeur_phase_acv>2.25</valeur_phase_acv></indicateur_co2_dynamique></sous_contributeur></energie></contributeur></batiment></sortie_projet></RSEnv></projet>"))
    return o.select("o_orderkey", xml.alias("xml"))


@register("study_facts", """SELECT o_orderkey AS id, 'Bâtiment A' AS building, f AS field, v AS value_num, t AS value_text FROM orders, LATERAL (VALUES ('operation_name', NULL::DOUBLE, 'Op & ' || o_orderkey), ('postcode', NULL, '75011'), ('department', NULL, '75'), ('housing_count', o_custkey % 50, NULL), ('shab', 150.0 + o_custkey, NULL), ('cross_ventilated', NULL, 'Oui'),
  ('bbio', o_custkey % 90 + 0.5, NULL), ('cep_electricity', 23.0, NULL), ('heating_vector_after', NULL, CASE WHEN o_custkey % 7 > 0 THEN 'Gaz' END), ('dh', greatest(100, o_custkey % 400), NULL), ('dh_zt', greatest(100, o_custkey % 400), NULL), ('dh_max', 1250, NULL), ('ic_energy', 5 + o_custkey % 300, NULL), ('ic_lot_3', 12.5, NULL), ('ic_energy_ecs', 3.75, NULL)) x(f, v, t)
WHERE v IS NOT NULL OR t IS NOT NULL""")  # fmt: skip
def study_facts(spark, sf_dir):
    return re2020.facts(re2020.buildings(re2020.parse(_studies(spark, sf_dir), "o_orderkey", "xml"))).select("id", "building", "field", "value_num", "value_text")


@register("dominant_walls", """WITH p AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'wall' WHEN 'N' THEN 'roof' ELSE 'floor' END AS target, l_linestatus AS name, sum(l_quantity) AS surface FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2, 3)
SELECT id, target, arg_max(name, (surface, name)) AS name, max(surface) AS surface FROM p GROUP BY 1, 2""")  # fmt: skip
def dominant_walls(spark, sf_dir):
    return re2020.envelope(re2020.parse(_studies(spark, sf_dir), "o_orderkey", "xml")).select("id", "target", "name", "surface")


@register("certificate_xml", """SELECT c_custkey AS id, DATE '2024-03-05' AS study_date, 1900 + c_nationkey AS construction_year, 10.5 * c_nationkey AS energy, chr(65 + CAST(c_custkey % 7 AS INTEGER)) AS energy_class FROM customer WHERE c_custkey % 5 > 0""")
def certificate_xml(spark, sf_dir):
    k = F.col("c_custkey")
    good = _t("<dpe version='8'><administratif><date_etablissement_dpe>2024-03-05</date_etablissement_dpe></administratif><logement><caracteristique_generale><annee_construction>", 1900 + F.col("c_nationkey"), "</annee_construction></caracteristique_generale><sortie><ep_conso><ep_conso_5_usages_m2>", 10.5 * F.col("c_nationkey"), "</ep_conso_5_usages_m2><classe_bilan_dpe>", F.chr(65 + k % 7), "</classe_bilan_dpe></ep_conso></sortie></logement></dpe>")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 5 > 0, good).when(k % 2 == 0, "<dpe><broken").alias("xml"))
    return re2020.certificates(c, "c_custkey", "xml").select("id", "study_date", "construction_year", "energy", "energy_class")
