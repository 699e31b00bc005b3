"""Work that must not grow faster than its input: shared values computed once, no rows dealt by a handful of keys."""

from pyspark.sql import functions as F


def _plan(df):
    return str(df._jdf.queryExecution().optimizedPlan().toString())


def test_lots_fold_a_name_once(spark):
    from evidentia.operators import folders

    df = spark.range(3).select(F.concat(F.lit("CCTP lot "), "id").alias("n")).repartition(2)
    d = df.withColumn("d", folders.read_lot(F.col("n"), ["plomberie"])).select("d.read", "d.reason")
    assert _plan(d).count("translate(") == 1
    assert {tuple(r) for r in d.collect()} == {(False, "other lot")}


def test_layer_quality_cleans_a_text_once(spark):
    from evidentia.sources import pages

    df = spark.createDataFrame([("Le bâtiment est isolé " * 30, 60), (None, 0)], "t string, n int").repartition(2)
    df = df.withColumn("q", pages.layer_quality(F.col("t"), F.col("n"))).select(pages.needs_recognition(F.col("q"), F.col("n")).alias("ocr"), pages.clean_dense(F.col("q"), F.col("n")).alias("dense"))
    assert _plan(df).count("coalesce(t#") == 1
    assert {tuple(r) for r in df.collect()} == {(False, True), (True, False)}


def test_plan_quantities_deal_no_rows_by_label(spark):
    from evidentia.operators import measures

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select("id", F.lit("logements").alias("ref"), F.lit("count").alias("kind"), F.col("id").cast("double").alias("total"))
        df = measures.plan_quantities(rows, spark.createDataFrame([("housing_count", "Nombre de logements")], "field string, label string"))
        assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_are_walked_once_and_in_bulk(spark):
    from evidentia.operators import tables

    rows = [(d, 1, x, y, 40.0, 8.0, t) for d in range(3) for x, y, t in ((50.0, 100.0, "Designation"), (150.0, 100.0, "Price"), (50.0, 80.0, "Part 1"), (150.0, 80.0, f"{d},5"))]
    found = tables.cells(spark.createDataFrame(rows, "doc long, page int, x double, y double, width double, height double, text string"), "designation|price")
    facts = tables.table_facts(found, [("^part", "^price", "price")])
    plan = _plan(facts)
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "UDTF" not in plan
    assert {(r.doc, r.row, r.value_num) for r in facts.collect()} == {(0, 1, 0.5), (1, 1, 1.5), (2, 1, 2.5)}


def test_buildings_are_detected_in_one_pass(spark):
    from evidentia.operators import layouts

    docs = spark.createDataFrame([(1, "Nombre de bâtiments : 2\nBâtiment A\nx\nBâtiment B2"), (2, None)], "doc_id long, text string").repartition(2)
    found = layouts.detect_buildings(docs)
    plan = _plan(found)
    assert "Join" not in plan and plan.count("translate(coalesce(replace(") + plan.count("translate(replace(coalesce(") == 1
    assert {tuple(r) for r in found.collect()} == {(1, "Bâtiment A", 0, True), (1, "Bâtiment B2", 3, True), (2, "Bâtiment unique", 0, True)}


def test_reports_are_dealt_to_more_tasks_than_run_at_once(spark):
    from evidentia.plans import sources

    assert sources._reports(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_layouts_clean_a_text_once_and_rules_share_their_gate(spark):
    from evidentia.operators import layouts

    docs = spark.createDataFrame([(1, "Coefficient Bbio 41,5 80,0 10 %", "RT2012")], "doc_id long, text string, doc_type string").repartition(2)
    found = layouts.parse(docs, packs=("rt2012",))
    assert _plan(found).count(" rt2012 ") == 1
    assert {(r.field, r.value_num) for r in found.collect()} == {("bbio", 41.5), ("bbio_max", 80.0), ("bbio_gain", 10.0)}


def test_questionnaires_sort_no_texts(spark):
    from evidentia.operators import economics

    rows = [(1, k, t) for k, t in enumerate(["Identité | 5", "Données financières validées", "Travaux | 12 €", "sans montant | ?", None, "Aides mobilisées", "Prime | 12,5", "Contrôle", "x | 9"])]
    found = economics.questionnaire_cells(spark.createDataFrame(rows, "op long, idx int, text string").repartition(2), "op")
    plan = _plan(found)
    assert "text#" not in plan[plan.index("Window") : plan.index("Generate")]
    assert {tuple(r) for r in found.collect()} == {(1, "costs", "Travaux", 12.0), (1, "aids", "Prime", 12.5)}


def test_similar_sets_are_judged_where_they_meet(spark):
    from evidentia.operators import learning

    rows = [(1, 1, ["a", "b"]), (1, 2, ["a", "b", "c"]), (1, 3, ["a", None]), (1, 4, None), (2, 5, ["a", "b"]), (1, 6, ["c", "d", "e"])]
    df = spark.createDataFrame(rows, "g long, i long, w array<string>").repartition(2)
    found = learning.similar_sets(df.select("g", F.col("i").alias("a"), F.col("w").alias("wa")), df.select("g", F.col("i").alias("b"), F.col("w").alias("wb")), ["g"], 0.3)
    plan = _plan(found)
    assert sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) == 3  # words with their use on both sides, and the meeting
    assert {(r.a, r.b, round(r.share, 6)) for r in found.collect() if r.a < r.b} == {(1, 2, 0.666667), (1, 3, 0.333333)}


def test_boosts_score_pairs_where_they_meet(spark):
    from evidentia.operators import learning

    box = "struct<x:double,y:double,w:double,h:double>"
    df = spark.createDataFrame([(1, k, [f"w{k % 3}", "z"], k, 0.1 * k, (0.1, 0.1, 0.1, None) if k % 2 else None) for k in range(6)], f"u long, id long, words array<string>, page int, ratio double, box {box}").repartition(2)
    known = df.withColumnRenamed("id", "profile").withColumn("confirmed", F.lit(10)).withColumn("rejected", F.lit(0))
    found = learning.boosted(df, known, ["u"])
    assert sum(line.lstrip(" :+-").startswith("Join") for line in _plan(found).splitlines()) == 5  # use of words twice, words, cells, readings
    assert {(r.id, round(r.match, 6)) for r in found.collect()} == {(k, 1.0) for k in range(6)}


def test_name_queries_spread_a_small_table(spark):
    from evidentia.operators import entities, grouping
    from evidentia.plans import records, reports

    seen = []
    old = entities.match_names, grouping.building_groups
    entities.match_names = lambda found, reference, by: seen.extend((found, reference)) or found.selectExpr("name", "name as target", "'x' as rule")
    grouping.building_groups = lambda rows, by, splits, apart: seen.append(rows) or rows.selectExpr("op", "name", "name as target", "'x' as mode")
    try:
        records.name_match(spark, "/root/testdata/sf0.001")
        reports.building_name_groups(spark, "/root/testdata/sf0.001")
    finally:
        entities.match_names, grouping.building_groups = old
    assert len(seen) == 3 and all(df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for df in seen)
