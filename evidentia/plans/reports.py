"""Queries over reports and pages that are made from the tables' numbers; the twins tell what they were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import register, spread, table
from ..functions import names
from ..operators import extract, grouping, layouts, phased_layouts, phases, tables
from ..streaming import journal, progress


def _french(number) -> F.col:
    """12345.6 as '12 345,60'."""
    return F.translate(F.format_number(number, 2), ",.", " ,")


@register(
    "positional_table_facts",
    """
    WITH rows AS (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row FROM lineitem)
    SELECT l_orderkey AS doc, row, field, CASE field WHEN 'quantity' THEN round(l_quantity, 2) ELSE round(l_extendedprice, 2) END AS value_num
    FROM rows, (VALUES ('quantity'), ('price')) f(field)
    WHERE field = 'price' OR CAST(l_quantity AS BIGINT) % 5 <> 0
    """,
)
def positional_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a page: its lines are a table whose first cells take two lines of the page and whose quantities may be missing or stand a line lower."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("row", F.row_number().over(order))
    item = lambda x, y, w, t: F.struct(F.lit(float(x)).alias("x") if isinstance(x, (int, float)) else x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(float(w)).alias("width"), t.alias("text"))
    top = 10000 - 20 * F.col("row")
    # Cells are set to the right, so a long number begins farther left than its header; every third quantity stands a line lower.
    quantity, price = _french(F.col("l_quantity")), _french(F.col("l_extendedprice"))
    of_row = F.array(
        item(50, top, 60, F.concat(F.lit("Part "), F.col("l_partkey"))), item(50, top - 9, 60, F.lit("of a supplier")),
        item(F.lit(240) - 5 * F.char_length(quantity), F.when(F.col("l_partkey") % 3 == 0, top - 9).otherwise(top), 30, F.when(F.col("l_quantity").cast("long") % 5 != 0, quantity)),
        item(F.lit(360) - 5 * F.char_length(price), top, 45, price),
    )
    of_page = F.array(item(50, F.lit(10000), 60, F.lit("Designation")), item(200, F.lit(10000), 45, F.lit("Quantity")), item(320, F.lit(10000), 40, F.lit("Price")))
    items = rows.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.explode(F.when(F.col("row") == 1, F.concat(of_page, of_row)).otherwise(of_row)).alias("i"))
    found = tables.cells(items.select("doc", "page", "i.x", "i.y", "i.width", F.lit(8.0).alias("height"), "i.text"), "designation|quantity|price")
    facts = tables.table_facts(found, [("^part ", "^quantity", "quantity"), ("^part ", "^price", "price")])
    return facts.select("doc", "row", "field", "value_num")


_ENERGY = ("Gaz", "Fioul", "Bois", "Electricite")


@register(
    "phased_facts",
    """
    WITH o AS (
      SELECT o_orderkey AS doc_id, round(200 + o_totalprice % 300, 1) AS b, round(50 + o_totalprice % 100, 1) AS a, 1 + (o_orderkey + o_custkey) % 4 AS eb, 1 + (o_orderkey // 7) % 4 AS ea, o_orderdate FROM orders),
    n AS (SELECT *, ['Gaz', 'Fioul', 'Bois / biomasse', 'Électricité'] AS e FROM o)
    SELECT doc_id, 'Bâtiment unique' AS building, f.phase, f.field, f.value_num, f.value_text FROM n, LATERAL (VALUES
      ('before', 'cep_before', b, NULL), ('after', 'cep_after_final', a, NULL), ('after', 'cep', a, NULL),
      ('before', 'heating_vector_before', NULL, e[eb]), ('after', 'heating_vector_after', NULL, e[ea]),
      ('after', CASE WHEN doc_id % 3 = 0 THEN 'ecs_vector_after' END, NULL, e[ea]),
      (NULL, 'wall_structure', NULL, 'Pierre'), ('after', 'wall_insulation', NULL, 'Laine de roche'), ('after', 'wall_insulation_thickness', 60 + 10 * (doc_id % 20), NULL), ('after', 'wall_insulation_r', round(0.5 + (doc_id % 50) / 10, 1), NULL)
    ) f(phase, field, value_num, value_text) WHERE f.field IS NOT NULL
    """,
)
def phased_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice for each order: its chapters before and after the works stand in either order, with other chapters between them."""
    o = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p")))
    # Rounded as the twin does, by the doubles themselves: 460.05 is a little less in binary, but ten times it is 4600.5.
    dec = lambda c: F.translate(F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10), ".", ",")
    pick = lambda i: F.element_at(F.array(*map(F.lit, _ENERGY)), i.cast("int"))
    lines = lambda *x: F.concat_ws("\n", *[F.lit(v) if isinstance(v, str) else v for v in x])
    before = lines("2. Etat existant", F.concat(F.lit("Cep (kWh/(m²SRT.an)) "), dec(200 + F.col("p") % 300)), "Descriptif des parois", "Mur en pierre", "laine de roche 0,040 4 1,0", "Chauffage - Generation", F.concat(F.lit("Combustible "), pick(1 + (F.col("k") + F.col("c")) % 4)))
    after = lines(
        "3. État projeté", F.concat(F.lit("Cep (kWh/(m²SRT.an)) "), dec(50 + F.col("p") % 100)), "Descriptif des parois", "Mur extérieur",
        F.concat(F.lit("laine de roche 0,036 "), (6 + F.col("k") % 20).cast("string"), F.lit(" "), dec(0.5 + (F.col("k") % 50) / 10)),
        "Tableau 4", "Production de chauffage", F.concat(F.lit("Combustible : "), pick(1 + F.floor(F.col("k") / 7) % 4)), F.when(F.col("k") % 3 == 0, "Mode Chauffage + ECS").otherwise("Mode Chauffage"),
    )
    text = lines("Notice thermique RT existant", F.when(F.col("c") % 2 == 0, before).otherwise(after), "4. Annexes", F.when(F.col("c") % 2 == 0, after).otherwise(before))
    return phases.read(o.select(F.col("k").alias("doc_id"), text.alias("text")), phased_layouts.LAYOUTS).select("doc_id", "building", "phase", "field", "value_num", "value_text")


def _building_id(k):
    """A letter and a number of at most three digits, different for 26000 keys in a row."""
    return F.concat(F.char((65 + k % 26).cast("int")), (F.floor(k / 26) % 1000).cast("string"))


@register(
    "building_name_groups",
    """
    WITH c AS (
      SELECT c_nationkey + 100 * (c_custkey // 26000) AS op, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || ((c_custkey // 26) % 1000) AS id, c_acctbal > 0 AS auth, CAST(floor(abs(c_acctbal)) AS BIGINT) % 10 = 3 AS split FROM customer),
    n AS (SELECT op, auth, split, 'Bâtiment ' || id AS full, 'bat. ' || id AS short FROM c)
    SELECT op, m.name, m.target, m.mode FROM n, LATERAL (VALUES
      (n.full, CASE WHEN auth OR split THEN n.full ELSE short END, CASE WHEN auth OR split THEN 'master' ELSE 'spelling' END),
      (short, CASE WHEN split OR NOT auth THEN short ELSE n.full END, CASE WHEN split THEN 'distinct' WHEN auth THEN 'authority' ELSE 'master' END),
      (n.full || ' Est', CASE WHEN auth OR split THEN n.full ELSE short END, CASE WHEN auth THEN 'authority' ELSE 'qualifier' END),
      (n.full || ' Ouest', n.full || ' Ouest', 'distinct')) m(name, target, mode)
    """,
)
def building_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each customer's building by rule, with splits made by hand, and no group with two qualifiers."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    k = F.col("c_custkey")
    c = c.select((F.col("c_nationkey") + 100 * F.floor(k / 26000)).alias("op"), _building_id(k).alias("id"), (F.col("c_acctbal") > 0).alias("auth"), (F.floor(F.abs("c_acctbal")) % 10 == 3).alias("split"))
    full, short = F.concat(F.lit("Bâtiment "), "id"), F.concat(F.lit("bat. "), "id")
    rows = c.select("op", "auth", F.posexplode(F.array(full, short, F.concat(full, F.lit(" Est")), F.concat(full, F.lit(" Ouest")))).alias("at", "name"))
    rows = rows.select("op", "name", (F.col("auth") & (F.col("at") == 0)).alias("authority"), F.lit(False).alias("pinned"))
    splits = c.filter("split").select("op", full.alias("a"), short.alias("b"))
    return grouping.building_groups(rows, "op", splits=splits, apart=True).select("op", "name", "target", "mode")


@register(
    "buildings_by_results",
    """
    WITH o AS (SELECT o_custkey AS op, o_orderkey AS k, round(o_totalprice % 1000 + 1, 2) AS ic FROM orders),
    r AS (SELECT *, floor(ic * 10 + 0.5) / 10 AS near, row_number() OVER (PARTITION BY op ORDER BY k) AS i FROM o),
    f AS (SELECT * FROM r WHERE i = 1)
    SELECT op, 'copy' AS name, 'main' AS target FROM f
    UNION ALL SELECT op, 'near', 'main' FROM f WHERE near <> floor(near) OR near = ic
    """,
)
def buildings_by_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of a customer that are one by their results: one repeats two results, one holds a third with fewer decimals, one is another building."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("op")).agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("o"))
    ic = F.round(F.col("o.o_totalprice") % 1000 + 1, 2)
    near = F.floor(ic * 10 + 0.5) / 10
    tic, dh = 20 + (F.col("op") % 1000) / 8, 100 + (F.col("o.o_orderkey") % 4096) / 16
    of = lambda b, f, v: F.struct(F.lit(b).alias("building"), F.lit(f).alias("field"), v.cast("double").alias("value"))
    values = F.array(
        of("main", "tic", tic), of("main", "dh", dh), of("main", "ic", ic), of("copy", "tic", tic), of("copy", "dh", dh), of("near", "ic", near),
        of("other", "tic", tic + 0.125), of("other", "dh", dh), of("other", "ic", ic + 0.5),
    )
    return grouping.result_merges(first.select("op", F.explode(values).alias("v")).select("op", "v.*"), "op")


@register(
    "stream_job_progress",
    """
    WITH RECURSIVE e AS (SELECT user_id AS job, event_id AS id, epoch_ms(ts) AS ms, event_id % 5 AS doc, least(1.0, greatest(0.0, value / 50)) AS p FROM events),
    mark AS (SELECT max(ms) - 3600000 AS mark FROM e),
    seen AS (SELECT e.* FROM e, mark WHERE ms <= mark),
    gaps AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY job ORDER BY ms, id) > 43200000 THEN 1 ELSE 0 END AS new FROM seen),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
    steps AS MATERIALIZED (SELECT job, run, ms, p - coalesce(lag(p) OVER (PARTITION BY job, run, doc ORDER BY ms, id), 0) AS more, row_number() OVER (PARTITION BY job, run ORDER BY ms, id) AS i,
      greatest(0.001, (ms - min(ms) OVER (PARTITION BY job, run)) / CAST(1000 AS DOUBLE)) AS elapsed, count(*) OVER (PARTITION BY job, run) AS n, max(run) OVER (PARTITION BY job) AS runs FROM runs),
    walk AS (
      SELECT job, run, i, ms, elapsed, n, runs, CAST(more AS DOUBLE) AS work, ms AS shown, true AS seen_now, CAST(NULL AS DOUBLE) AS total FROM steps WHERE i = 1
      UNION ALL
      SELECT job, run, i, ms, elapsed, n, runs, work, CASE WHEN seen_now THEN ms ELSE shown END, seen_now,
        CASE WHEN seen_now AND elapsed >= 4 AND work >= 0.15 THEN CASE WHEN total IS NULL THEN elapsed / greatest(0.001, share) ELSE total * 0.72 + elapsed / greatest(0.001, share) * 0.28 END ELSE total END
      FROM (SELECT s.job, s.run, s.i, s.ms, s.elapsed, s.n, s.runs, w.work + s.more AS work, w.shown, s.ms - w.shown >= 350 AS seen_now, least(1.0, greatest(0.0, (w.work + s.more) / 5)) AS share, w.total
        FROM walk w JOIN steps s ON s.job = w.job AND s.run = w.run AND s.i = w.i + 1)),
    told AS (SELECT *, least(1.0, greatest(0.0, work / 5)) AS share FROM walk)
    SELECT job, ms, 'progress' AS kind, elapsed, share, round(total, 6) AS total, CASE WHEN total IS NOT NULL THEN round(greatest(0.0, total - elapsed), 6) END AS remaining FROM told WHERE seen_now
    UNION ALL SELECT job, ms, 'closed', elapsed, share, round(total, 6), 0.0 FROM told, mark WHERE i = n AND (run < runs OR ms + 43200001 <= mark)
    """,
)
def stream_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as progress of a job of five documents that is closed after twelve hours without one."""
    e = journal.read_journal(spark, f"{sf_dir}/events.parquet")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 50))
    rows = e.select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("doc"), share.alias("progress"), F.lit(5).alias("docs"), F.lit(None).cast("double").alias("prior"))
    with progress.rocks(spark):
        found = journal.drain(progress.estimates(rows, 12 * 3600 * 1000), "progress")
    return found.withColumn("total", F.round("total", 6)).withColumn("remaining", F.when(F.col("total").isNotNull() | (F.col("kind") == "closed"), F.round("remaining", 6)))


_EQUIPMENT = {"vmc": ["VMC"], "cta": ["CTA", "centrale de traitement d'air"], "solar": ["panneaux solaires", "capteurs"], "lift": ["ascenseur"]}


@register(
    "presence_mentions",
    """
    WITH o AS (SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice) AS BIGINT) AS p, o_custkey AS c FROM orders),
    n AS (SELECT *, ['vmc', 'cta', 'solar', 'lift'] AS f, 1 + c % 4 AS i, 1 + (c + 1 + p % 3) % 4 AS j FROM o)
    SELECT doc_id, idx, field, value, confidence FROM n, LATERAL (VALUES
      (0, f[i], CASE WHEN p % 2 = 0 THEN 'Non' ELSE 'Oui' END, CAST(0.82 AS DOUBLE)), (0, f[j], CASE WHEN p % 5 < 2 THEN 'Non' ELSE 'Oui' END, 0.82),
      (1, f[j], CASE WHEN p % 7 = 0 THEN 'Non' ELSE 'Oui' END, 0.90)) m(idx, field, value, confidence)
    """,
)
def presence_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with two mentions, each negated or not, and a line of a choice, by the numbers of an order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").alias("p"), F.col("o_custkey").alias("c"))
    names = ("VMC", "centrale de traitement d'air", "Capteurs", "ascenseur")
    name = lambda i: F.element_at(F.array(*map(F.lit, names)), (1 + i % 4).cast("int"))
    p, first, second = F.col("p"), name(F.col("c")), name(F.col("c") + 1 + F.col("p") % 3)
    one = F.concat(F.when(p % 2 == 0, "Bâtiment sans ").otherwise("Bâtiment à "), first, F.when(p % 5 == 0, ", aucune ").when(p % 5 == 1, " mais pas de ").when(p % 5 == 2, " avec ").otherwise(", "), second)
    two = F.concat(F.lit("Label : "), F.when(p % 7 == 0, "non retenu ").otherwise("retenu "), second)
    return extract.presence(spread(o.select("doc_id", F.concat_ws("\n", one, two).alias("text"))), _EQUIPMENT).select("doc_id", "idx", "field", "value", "confidence")


_TAILS = (" - 08-02-2020", " - RAPPORT PROMOTELEC", " - RT2012", "......73", " REGLEMENTAIRE", "", " (RE2020)")
_LABELS = ("A usage d'habitation", "CONDITIONS DE BASE", "257 KW.", "ZONES GROUPES")


@register(
    "mended_names",
    """
    WITH c AS (SELECT c_custkey AS k, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || (c_custkey // 26) % 1000 AS id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS b FROM customer)
    SELECT k, CASE WHEN b % 5 <> 0 THEN 'Bâtiment ' || id || CASE WHEN b % 3 = 0 THEN ' NORD' ELSE '' END END AS name FROM c
    """,
)
def mended_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with what reports put behind them, and headings that are no names."""
    k, b = F.col("c_custkey"), F.floor(F.abs("c_acctbal"))
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (1 + i % len(words)).cast("int"))
    name = F.concat(_building_id(k), F.when(b % 3 == 0, " NORD").otherwise(""), pick(_TAILS, F.floor(b / 7) + k))
    label = F.concat(F.lit("Bâtiment "), F.when(b % 5 == 0, pick(_LABELS, F.floor(b / 5))).otherwise(name))
    return spread(table(spark, sf_dir, "customer").select(k.alias("k"), label.alias("label"))).select("k", names.repair(F.col("label")).alias("name"))


@register(
    "clean_facts",
    """
    WITH o AS (SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderkey % 3 AS kind FROM orders)
    SELECT doc_id, 'Bâtiment unique' AS building, f.field, CAST(f.value_num AS DOUBLE) AS value_num, f.value_text FROM o, LATERAL (VALUES
      (CASE WHEN kind = 0 THEN 'cep_before' END, CASE WHEN 5 + p % 3000 BETWEEN 10 AND 1499 THEN 5 + p % 3000 END, NULL), (CASE WHEN kind = 0 THEN 'cep_after_final' END, 50 + p % 40, NULL), (CASE WHEN kind = 0 THEN 'heating_vector_before' END, NULL, 'Fioul'),
      (CASE WHEN kind = 1 THEN 'wall_insulation_thickness' END, 20 + p % 200, NULL), (CASE WHEN kind = 1 THEN 'window_material' END, NULL, 'PVC')
    ) f(field, value_num, value_text) WHERE f.field IS NOT NULL AND (f.value_num IS NOT NULL OR f.value_text IS NOT NULL)
    """,
)
def clean_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to clean readings: values out of range, fields that aren't wanted of a family, and texts that say nothing go."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").alias("p"), (F.col("o_orderkey") % 3).alias("kind"))
    lines = lambda *x: F.concat_ws("\n", *[F.lit(v) if isinstance(v, str) else v for v in x])
    told = lambda before, n, after: F.concat(F.lit(before), n.cast("long").cast("string"), F.lit(after))
    p = F.col("p")
    notice = lines("Notice thermique RT existant", "3. Etat projeté", told("Cep (kWh/(m²SRT.an)) ", 50 + p % 40, ",0"), "VMC double flux", "2. Etat existant", told("Cep (kWh/(m²SRT.an)) ", 5 + p % 3000, ",0"), "Production de chauffage", "Combustible Fioul")
    cctp = lines("Descriptif", told("Murs : laine de verre ", 20 + p % 200, " mm"), "Menuiseries extérieures PVC, double vitrage", "Chauffage par pompe à chaleur")
    kind = F.when(F.col("kind") == 0, "RT_EXISTING").when(F.col("kind") == 1, "CCTP")
    docs = o.select("doc_id", F.when(F.col("kind") == 0, notice).when(F.col("kind") == 1, cctp).otherwise("Note sans valeur").alias("text"), kind.alias("doc_type"))
    wanted = {"thcex": ("cep_before", "cep_after_final", "heating_vector_before"), "cctp": ("wall_insulation_thickness", "window_material")}
    return layouts.clean_facts(spread(docs), wanted).select("doc_id", "building", "field", "value_num", "value_text")
