import datetime as dt
import random

from evidentia.functions.text import fold, value_key
from evidentia.operators import fusion, joins, routing
from pyspark.sql import functions as F


def test_fold_and_value_key(spark):
    df = spark.createDataFrame([("Éçole  ÖßŒ", 1.5)], "t string, n double")
    r = df.select(fold(F.col("t")).alias("f"), value_key(F.col("n"), F.col("t")).alias("k"), value_key(F.lit(None).cast("double"), F.col("t")).alias("kt")).first()
    assert (r.f, r.k, r.kt) == ("ecole  oßœ", "1.500000", "ecole oßœ")


def test_forbidden_decides_the_tier_and_main_the_rank(spark):
    rules = spark.createDataFrame([("f", "a", "main", 3), ("f", "a", "forbidden", 0), ("f", "b", "secondary", 1)], "field string, doc_type string, tier string, rank int")
    occ = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c"), ("g", "a")], "field string, doc_type string")
    got = {(r.field, r.doc_type): (r.tier, r.source_rank) for r in routing.route(occ, rules).collect()}
    assert got == {("f", "a"): ("forbidden", 3), ("f", "b"): ("secondary", 101), ("f", "c"): ("unrouted", 1000), ("g", "a"): ("unrouted", 999)}


def test_winner_prefers_main_then_rank_then_date(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("b", "f", 1.0, "d1", "secondary", 100, 0.99, t(5), 1), ("b", "f", 2.0, "d2", "main", 1, 0.91, t(1), 2), ("b", "f", 3.0, "d3", "main", 1, 0.90, t(2), 3), ("b", "f", 4.0, "d4", "main", 0, 0.5, t(2), 4)]
    occ = spark.createDataFrame(rows, "building string, field string, value double, doc_id string, tier string, source_rank int, confidence double, study_date timestamp, seq int")
    assert [r.value for r in fusion.winners(occ).collect()] == [3.0]


def test_last_before_takes_marks_at_the_same_place(spark):
    p = spark.createDataFrame([("d", 1), ("d", 3), ("d", 5)], "doc string, line int")
    m = spark.createDataFrame([("d", 3, "A")], "doc string, line int, name string")
    assert sorted((r.line, r.name) for r in joins.last_before(p, m, ["doc"], ["line"], "name").collect()) == [(1, None), (3, "A"), (5, "A")]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_names_agree_with_all_pairs(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(150)} | {"été", "étés", "a", "ab"}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("ab",)], "n string")
    most = lambda n: 2 if len(n) >= 11 else 1 if len(n) >= 5 else 0
    want = {(x, y, _edits(x, y)) for x in names for y in names if x and y and x[0] == y[0] and _edits(x, y) <= most(y)}
    assert sorted(tuple(r) for r in joins.near_names(df, df, "n", "n").collect()) == sorted(want)


def test_overrides_prefer_reference_then_own_then_last(spark):
    finals = spark.createDataFrame([("b", "f", 1.0), ("b", "g", 2.0)], "building string, field string, value double")
    manual = [("b", "f", 3.0, False, True, 9), ("b", "f", 4.0, True, False, 1), ("b", "f", 5.0, True, False, 2), ("c", "f", 6.0, None, None, 1), ("c", "f", 7.0, None, False, 0)]
    m = spark.createDataFrame(manual, "building string, field string, value double, is_reference boolean, is_own boolean, seq int")
    assert sorted((r.building, r.field, r.value) for r in fusion.overrides(finals, m).collect()) == [("b", "f", 5.0), ("b", "g", 2.0), ("c", "f", 7.0)]


def test_empty_inputs(spark):
    occ = spark.createDataFrame([], "building string, field string, value double, doc_id string, tier string, source_rank int, confidence double, study_date timestamp, seq int")
    assert fusion.winners(occ).count() == 0


def test_entry_imports_and_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "flagship_wide" in e.queries()
