"""Groups with forbidden pairs, and buildings known by their results, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import grouping


def walk(links, forbidden, kinds):
    """The links one by one."""
    group = {n: {n} for _, a, b in links for n in (a, b)}
    for _, a, b in sorted((r, *sorted((a, b))) for r, a, b in links if a != b):
        if group[a] is group[b]:
            continue
        both = group[a] | group[b]
        if any(x in both and y in both for x, y in forbidden):
            continue
        labels = {}
        for n in both:
            for kind, label in kinds.get(n, ()):
                labels.setdefault(kind, set()).add(label)
        if any(len(v) > 1 for v in labels.values()):
            continue
        for n in both:
            group[n] = both
    return {n: min(g) for n, g in group.items()}


def test_groups_against_a_walk(spark):
    rng = random.Random(5)
    links, forbidden, kinds, want = [], [], [], {}
    for op in range(40):
        nodes = [f"n{i:02d}" for i in range(rng.randint(2, 14))]
        own = [(rng.randint(0, 3), *rng.sample(nodes, 2)) for _ in range(rng.randint(1, 24))] + [(0, nodes[0], nodes[0])]
        no = [tuple(rng.sample(nodes, 2)) for _ in range(rng.randint(0, 4))]
        of = {n: [("q", rng.choice("abc"))] for n in nodes if rng.random() < 0.3}
        least = {}
        for r, a, b in own:  # a pair of links counts with its first rank
            k = tuple(sorted((a, b)))
            least[k] = min(r, least.get(k, 9))
        want |= {(op, n): r for n, r in walk([(r, a, b) for (a, b), r in least.items() if a != b], no, of).items()}
        links += [(op, a, b, r) for r, a, b in own]
        forbidden += [(op, a, b) for a, b in no]
        kinds += [(op, n, k, v) for n, x in of.items() for k, v in x]
    found = grouping.constrained_groups(
        spark.createDataFrame([*links, (0, None, "n00", 0)], "op int, a string, b string, rank int"), spark.createDataFrame([*forbidden, (0, "n00", None)], "op int, a string, b string"), "op",
        spark.createDataFrame(kinds, "op int, name string, kind string, label string"),
    )
    assert {(r.op, r.name): r.root for r in found.collect()} == want
    assert len({(op, r) for (op, _), r in want.items()}) > 60


@pytest.fixture(scope="module")
def names(spark):
    rows = [
        ("o", "Bâtiment A", True, False), ("o", "bat. A", False, False), ("o", "A2 nord", False, False), ("o", "Bâtiment 1", False, False), ("o", "Bâtiment 01", False, False), ("o", "Bâtiment 1 Est", False, False), ("o", "Bâtiment 1 Ouest", False, False),
        ("o", "Logements 28 à 31", False, False), ("o", "Logement 30", False, False), ("o", "Collé A", False, True), ("o", None, False, False), ("o", "Tour Z", False, False), ("p", "Bâtiment 1 Est", False, False), ("p", "Bâtiment 1 Ouest", False, False),
    ]
    return spark.createDataFrame(rows, "op string, name string, authority boolean, pinned boolean")


def targets(df):
    return {(r.op, r.name): (r.target, r.mode) for r in df.collect()}


def test_rules_in_order(names):
    got = targets(grouping.building_groups(names, "op"))
    assert got == {
        ("o", "Bâtiment A"): ("Bâtiment A", "master"), ("o", "bat. A"): ("Bâtiment A", "authority"), ("o", "A2 nord"): ("A2 nord", "distinct"),
        ("o", "Bâtiment 1"): ("Bâtiment 1", "master"), ("o", "Bâtiment 01"): ("Bâtiment 1", "spelling"), ("o", "Bâtiment 1 Est"): ("Bâtiment 1", "qualifier"), ("o", "Bâtiment 1 Ouest"): ("Bâtiment 1", "qualifier"),
        ("o", "Logements 28 à 31"): ("Logements 28 à 31", "master"), ("o", "Logement 30"): ("Logements 28 à 31", "dwelling"), ("o", "Collé A"): ("Collé A", "pinned"), ("o", "Tour Z"): ("Tour Z", "distinct"),
        ("p", "Bâtiment 1 Est"): ("Bâtiment 1 Est", "distinct"), ("p", "Bâtiment 1 Ouest"): ("Bâtiment 1 Ouest", "distinct"),
    }


def test_splits_qualifiers_and_manual_targets(spark, names):
    splits = spark.createDataFrame([("o", "bat. A", "Bâtiment A")], "op string, a string, b string")
    manual = spark.createDataFrame([("o", "Tour Z", "Tour Y"), ("o", "Tour Y", "Tour X"), ("o", "Bâtiment 1", "Bâtiment Un")], "op string, name string, target string")
    got = targets(grouping.building_groups(names, "op", manual, splits, apart=True))
    assert got["o", "bat. A"] == ("bat. A", "distinct") and got["o", "Tour Z"] == ("Tour X", "manual") and got["o", "Bâtiment 1"] == ("Bâtiment Un", "manual")
    apart = targets(grouping.building_groups(names, "op", apart=True))
    assert apart["o", "Bâtiment 1 Est"] == ("Bâtiment 1", "qualifier") and apart["o", "Bâtiment 1 Ouest"][0] == "Bâtiment 1 Ouest"


def decimals(x):
    return len(f"{x:.6f}".split(".")[1].rstrip("0"))


def agrees(x, y):
    m = min(decimals(x), decimals(y))
    return x == y if m == 0 else math.floor(x * 10**m + 0.5) == math.floor(y * 10**m + 0.5)


def test_contained_results_against_all_pairs(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for op in range(30):
        pool = {f: [round(rng.uniform(1, 9), rng.choice([0, 1, 3])) for _ in range(3)] for f in ("tic", "dh", "ic", "cep", "bbio")}
        of = {}
        for b in range(rng.randint(2, 9)):
            fields = rng.sample(sorted(pool), rng.randint(1, 5))
            of[f"b{b}"] = {f: (lambda v: round(v, 1) if rng.random() < 0.3 and decimals(v) > 1 else v)(rng.choice(pool[f])) for f in fields}
        rows += [(op, b, f, float(v)) for b, x in of.items() for f, v in x.items()]
        for a, x in of.items():
            hold = [b for b, y in of.items() if b != a and len(y) > len(x) and all(f in y and agrees(v, y[f]) for f, v in x.items())]
            if len(hold) == 1:
                want[op, a] = hold[0]
    rows += [(0, "b0", "dh", None), (0, None, "dh", 1.0), (1, "zero", "dh", 0.0)]
    found = grouping.contained_results(spark.createDataFrame(rows, "op int, building string, field string, value double"), "op")
    assert {(r.op, r.name): r.other for r in found.collect()} == want and len(want) > 10


def test_a_value_that_all_share_makes_no_pairs(spark):
    n = 20000
    same = spark.range(n).select(F.lit(1).alias("op"), F.concat(F.lit("b"), "id").alias("building"), F.explode(F.array(F.struct(F.lit("tic").alias("field"), F.lit(27.5).alias("value")), F.struct(F.lit("dh").alias("field"), (F.col("id") + 0.5).alias("value")))).alias("v"))
    one = spark.createDataFrame([(1, "small", "tic", 27.5), (1, "twin", "dh", 7.5)], "op int, building string, field string, value double")
    rows = same.select("op", "building", "v.field", "v.value").unionByName(one)
    assert [(r.name, r.other) for r in grouping.contained_results(rows, "op").collect()] == [("twin", "b7")]


def test_merges_take_the_best_name(spark):
    rows = [("o", "B1", "tic", 27.5), ("o", "B1", "dh", 300.0), ("o", "Bâtiment Nord", "tic", 27.5), ("o", "Bâtiment Nord", "dh", 300.0), ("o", "Bâtiment Nord", "ic", 640.25), ("o", "B3", "ic", 640.3), ("o", "M", "ic", 640.2)]
    df = spark.createDataFrame(rows, "op string, building string, field string, value double")
    got = {r.name: r.target for r in grouping.result_merges(df, "op").collect()}
    assert got == {"B1": "Bâtiment Nord", "B3": "Bâtiment Nord"}
    manual = spark.createDataFrame([("o", "B3", "M")], "op string, name string, target string")
    assert {r.name for r in grouping.result_merges(df, "op", manual=manual).collect()} == {"B1"}
