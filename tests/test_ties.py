"""Equal shares and halves: the order of rows decides nothing."""

import itertools

from evidentia.operators import completeness, fusion

def test_equal_weights_in_any_order_tie(spark):
    # Each value has the same weights in another order, so all are equally likely and the greatest wins.
    weights = [0.1 + k / 21 for k in (1, 3, 4, 6, 8)]
    rows = [("B", f, float(v), d, w) for f in range(40) for v, p in enumerate(list(itertools.permutations(weights))[f :: 40]) for d, w in enumerate(p)]
    readings = spark.createDataFrame(rows, "building string, field int, value double, doc_id int, weight double").coalesce(1)
    p = fusion.noisy_or(readings)
    assert p.select("p").distinct().count() == 1
    finals = spark.createDataFrame([], "building string, field int, value double, protected boolean")
    assert {r["value"] for r in fusion.vote(finals, readings).collect()} == {2.0}

def test_halves_of_a_percent_go_up(spark):
    # k of 200 buildings hold all three columns, the others two: (k + 400) / 6 percent is a half for many k.
    rows = [(k, *(("x", "x", "x") if i < k else ("x", " ", "y"))) for k in range(200) for i in range(200)]
    got = completeness.completion(spark.createDataFrame(rows, "op int, a string, b string, c string"), "op", ["a", "b", "c"]).collect()
    assert {r["op"]: r["pct"] for r in got} == {k: (200 * (k + 400) + 600) // 1200 for k in range(200)}
