import random

import pytest
from evidentia.functions import names
from evidentia.operators import checks, economics, entities, learning, measures, versions
from pyspark.sql import functions as F


def test_keys(spark):
    r = spark.createDataFrame([("Bâtiment A-02",), ("12 Est",), (None,)], "n string").select(entities.merge_key(F.col("n")).alias("k"), entities.core_id(F.col("n")).alias("c")).collect()
    assert [tuple(x) for x in r] == [("a 2", "a"), ("12 est", "12"), ("", None)]


def test_follow_twelve_hops_and_rings(spark):
    rows = [("o", f"n{i}", f"n{i + 1}") for i in range(12)] + [("o", "r", "r"), ("p", "n0", "x"), ("o", None, "y"), ("o", "z", None)]
    got = {(r.op, r.name): r.target for r in entities.follow(spark.createDataFrame(rows, "op string, name string, target string"), "op").collect()}
    assert got["o", "n0"] == "n12" and got["o", "r"] == "r" and got["p", "n0"] == "x" and ("o", "z") not in got


def test_similar_names_agree_with_all_pairs(spark):
    rng = random.Random(7)
    names = {" ".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(120)}
    df = spark.createDataFrame([("g", n) for n in names] + [("g", None), ("g", "")], "op string, n string")
    got = {(r.name, r.other): round(r.score, 6) for r in entities.similar_names(df, "op", "n", floor=0.6).collect()}
    want = {}
    for x in names:
        for y in names:
            a, b = x.split(), y.split()
            i, u, least = len({*a} & {*b}), len({*a} | {*b}), min(len({*a}), len({*b}))
            s = 0.97 if sorted(a) == sorted(b) else 0.78 if i == least else i / u
            if x < y and s >= 0.6:
                want[x, y] = round(s, 6)
    assert got == want


def test_groups_of_long_chains(spark):
    links = [("o", i, i + 1) for i in range(50)] + [("o", 100, 101), ("p", 0, 5), ("o", None, 3)]
    got = {(r.op, r.name): r.root for r in entities.groups(spark.createDataFrame(links, "op string, a int, b int"), "op", "a", "b").collect()}
    assert {got["o", i] for i in range(51)} == {0} and got["o", 101] == 100 and got["p", 5] == 0


def test_same_results_need_two_equal_and_none_other(spark):
    rows = [("o", b, f, v) for b, vs in {"a": (1.0, 2.0, 3.0), "b": (1.0, 2.0, None), "c": (1.0, 2.0, 4.0), "d": (1.0, None, None), "e": (1.00000049999, 2.0, 3.0), "f": (1.00000050001, 2.0, 3.5)}.items() for f, v in zip("xyz", vs)]
    got = {(r.a, r.b) for r in entities.same_results(spark.createDataFrame(rows, "op string, building string, field string, value double"), "op").collect()}
    assert got == {("a", "b"), ("b", "c"), ("a", "e"), ("b", "e"), ("b", "f")}


@pytest.mark.parametrize("value", [0.0, 1e-9, 1.0, 12345.678, -7e8])
def test_same_results_at_cell_borders(spark, value):
    near, far = value * (1 + 9e-7), value * (1 + 3e-6) + 1e-30
    rows = [("o", b, f, v) for b, v in (("a", value), ("b", near), ("c", far)) for f in "xy"]
    got = {(r.a, r.b) for r in entities.same_results(spark.createDataFrame(rows, "op string, building string, field string, value double"), "op").collect()}
    assert ("a", "b") in got and ("a", "c") not in got


REFERENCE = ["A", "Bâtiment B", "Basson I", "Log 5 - 1 lot (T3)", "BEG-3 A 7", "Colectif Nord", "C - Batiment Accession", "Charquemont", "Macrolot G"]


@pytest.mark.parametrize(
    ("name", "target", "rule"),
    [
        ("a", "Bâtiment A", "1 exact"), ("Bat-B", "Bâtiment B", "7 end"), ("Basson-I", "Bâtiment BASSON I", "2 key"), ("Bât B (2 zones)", "Bâtiment B", "1 exact"), ("Bât A aile nord", "Bâtiment A", "3 core"), ("A et B", None, None), ("A, B", None, None),
        ("Basson I - 40 lgts", "Bâtiment BASSON I", "5 prefix"), ("BEG 3-7", "Bâtiment BEG-3 A 7", "5 prefix"), ("Collectifs Nord", "Bâtiment COLECTIF NORD", "6 loose"), ("Accession", "Bâtiment C - BATIMENT ACCESSION", "6 loose"),
        ("G", "Bâtiment MACROLOT G", "7 end"), ("Charquemon", "Bâtiment CHARQUEMONT", "8 truncated"), ("Charque", None, None), ("inconnu", None, None), ("Les Lilas Nord", None, None),
    ],
)
def test_match_by_each_rule(spark, matched, name, target, rule):
    got = matched[name]
    assert got == (target, rule)


@pytest.fixture(scope="module")
def matched(spark):
    found = [p.values[0] if hasattr(p, "values") else p[0] for m in test_match_by_each_rule.pytestmark for p in m.args[1]]
    ref = spark.createDataFrame([("o", n) for n in [*REFERENCE, "Lilas Sud", "Lilas"]], "op string, target string")
    return {r.name: (r.target, r.rule) for r in entities.match_names(spark.createDataFrame([("o", n) for n in found], "op string, name string"), ref, "op").collect()}


def test_match_letters_only_buildings_and_manual(spark):
    ref = spark.createDataFrame([("l", "A"), ("l", "B"), ("n", "1"), ("n", "2"), ("s", "Tilleul"), ("e", "X1")], "op string, target string")
    found = spark.createDataFrame([("l", "2"), ("l", "30"), ("n", "Bât a"), ("s", "unique"), ("s", "Bât 4"), ("s", "Chênes"), ("e", "X1"), ("e", "Y"), ("e", None), ("zz", "A")], "op string, name string")
    manual = spark.createDataFrame([("e", "X1", None), ("e", "Y", "x1"), ("s", "Chênes", "Erable")], "op string, name string, target string")
    got = {(r.op, r.name): (r.target, r.rule) for r in entities.match_names(found, ref, "op", manual=manual).collect()}
    assert got["l", "2"] == ("Bâtiment B", "4 letter") and got["l", "30"][0] is None and got["n", "Bât a"] == ("Bâtiment 1", "4 letter")
    assert got["s", "unique"] == ("Bâtiment TILLEUL", "9 only") and got["s", "Bât 4"] == ("Bâtiment TILLEUL", "9 only")
    assert got["e", "X1"] == (None, "0 manual") and got["e", "Y"] == ("Bâtiment X1", "0 manual") and got["s", "Chênes"] == (None, "0 manual") and got["zz", "A"] == (None, None) and len(got) == 9


def test_names(spark):
    cases = {
        "canonical": [("  bât. a (2 zones)", "Bâtiment A"), ("Immeuble rue", "Bâtiment RUE"), ("Batiment sur cour", "Bâtiment COUR"), ("principal", "Bâtiment unique"), ("R1 - R2 0 0 7 14 28", "Bâtiment R1 - R2"), ("", "Bâtiment unique"), (None, None)],
        "core": [("Bât B02 nord", "b2"), ("Les Tilleuls", "les"), ("Tilleul vert", "tilleul vert"), ("007", "7"), (None, "")], "qualified_core": [("Bâtiment 1 Est", "1"), ("A et B", ""), ("1 2", ""), ("Bat A aile nord", "a"), ("A", "")],
        "is_list": [("A et B", True), ("1, 2", True), ("Bât A", False), ("A nord", False)], "is_ghost": [("Bâtiment 3117.92", True), ("A 14 rue X", True), ("I4 ≤ 0,60", True), ("B BP 30055", True), ("Bâtiment A", False), ("00040", False), (None, False)],
        "is_garbage": [("Bâtiment ET DES TRAVAUX", True), ("realises sur chantiers.", True), ("Bâtiment A", False), ("Les Tilleuls", False), (None, False)], "is_part": [("Cage 3", True), ("Maisons 2/3", False), ("A/B", True), ("Tilleul", False)],
        "split_group": [("Bât 2 & 3", ["Bâtiment 2", "Bâtiment 3"]), ("AB", ["AB"]), ("A et Tilleul", ["A et Tilleul"])],
    }
    for f, pairs in cases.items():
        rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], "i int, n string").select("i", getattr(names, f)(F.col("n")).alias("v")).orderBy("i").collect()
        assert [(x, r.v) for r, (x, _) in zip(rows, pairs, strict=True)] == pairs, f


def test_ranked_names_and_perimeter(spark):
    rows = [("o", "Bât A", 5), ("o", "1", 9), ("o", "Cage 3", 20), ("o", "Tilleul", 2), ("o", "unique", 50), ("o", None, 1), ("p", "Chêne", 3), ("p", "Cage 1", 9), ("q", "B", 4), ("q", "C", 1)]
    found = spark.createDataFrame(rows, "op string, name string, results int")
    got = [(r.name, r.doubtful) for r in entities.rank_names(found, "op").filter("op = 'o'").orderBy("place").collect()]
    assert got == [("Bâtiment 1", False), ("Bâtiment TILLEUL", False), ("Bâtiment CAGE 3", True)]
    top = entities.top_names(found, spark.createDataFrame([("o", 2.0), ("p", None)], "op string, total double"), "op")
    assert sorted(map(tuple, top.collect())) == [("o", "Bâtiment 1"), ("o", "Bâtiment TILLEUL"), ("p", "Bâtiment CHENE")]
    named = spark.createDataFrame([("q", "Bât B & D", 1), ("q", "E", 2), ("r", "Z", 1), ("r", "Y", 2)], "op string, name string, seq int")
    totals = spark.createDataFrame([("o", 2.0), ("q", 4.0), ("r", 1.0)], "op string, total double")
    got = sorted(map(tuple, entities.reference_perimeter(named, totals, found, "op").collect()))
    assert got == [("o", "Bâtiment 1", "counted"), ("o", "Bâtiment TILLEUL", "counted"), ("q", "Bâtiment B", "named"), ("q", "Bâtiment C", "found"), ("q", "Bâtiment D", "named"), ("q", "Bâtiment E", "named"), ("r", "Bâtiment Z", "named")]


def test_checks(spark):
    row = spark.range(1).select(
        checks.energy_class(F.lit(100), F.lit(60)).alias("e"), checks.energy_class(F.lit(None).cast("int"), F.lit(5)).alias("n"), checks.gain(F.lit(200.0), F.lit(150.0)).alias("g"),
        checks.cap_confidence(F.lit(0.93), F.lit(0.05), F.lit(False), F.lit(None).cast("double")).alias("c"), checks.differs(F.lit(100.0), F.lit(100.05)).alias("d"),
        checks.reliability(F.lit("x"), F.lit(0.96), F.lit(20), F.lit(0.9), F.lit(True), F.lit(0.9)).alias("r"),
    ).first()
    assert tuple(row) == ("E", "A", 25.0, 0.899, False, "probable")
    bad = checks.out_of_range(spark.createDataFrame([(1, 5.0, 200), (2, None, 10)], "id int, a double, b int"), {"a": (0, 4), "b": (0, 100)}, ["id"])
    assert sorted((r.id, r.field, r.value) for r in bad.collect()) == [(1, "a", 5.0), (1, "b", 200.0)]


def test_ewma_is_the_recursion(spark):
    values = [3.0, 5.0, None, 1.0, 8.0]
    m = None
    for v in values:
        if v is not None:
            m = v if m is None else 0.72 * m + 0.28 * v
    got = checks.ewma(spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v double"), ["k"], ["i"], "v").first()
    assert abs(got.ewma - m) < 1e-12 and got.n == 4


def test_geometry(spark):
    p = lambda *xy: "array(" + ",".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in xy) + ")"
    r = spark.range(1).select(F.expr(p((0, 0), (4, 0), (4, 3), (0, 3))).alias("p"), F.expr(f"array({p((1, 1), (2, 1), (2, 2), (1, 2))})").alias("h"))
    r = r.select(measures.path_length(F.col("p")), measures.area(F.col("p")), measures.net_area(F.col("p"), F.col("h")), measures.centre(F.col("p")), measures.area(F.slice("p", 1, 2))).first()
    assert r[0] == 11 and r[1] == 12 and r[2] == 11 and tuple(r[3]) == (2.0, 1.5) and r[4] == 0


def test_economics(spark):
    lines = spark.createDataFrame([("o", "a", 30.0), ("o", None, 70.0), ("o", "a", -5.0), ("p", "a", None)], "op string, cat string, v double")
    got = {(r.op, r.category): (r.amount, r.pct) for r in economics.costs(lines, "op", "cat", "v").collect()}
    assert got == {("o", "a"): (30.0, 30.0), ("o", "other"): (70.0, 70.0), ("p", "a"): (0.0, None)}


def test_versions(spark):
    files = [("Étude ind B.pdf", "x", 1), ("Etude IND C.pdf", "Archives", 2), ("etude.pdf", "x", 3), ("Autre 2024-01-02.pdf", "x", 1), ("Autre 2023-01-02.pdf", "x", 9)]
    got = {r.name: r.version for r in versions.rank_files(spark.createDataFrame(files, "name string, folder string, mtime int"), []).collect()}
    assert got == {"Étude ind B.pdf": 1, "etude.pdf": 2, "Etude IND C.pdf": 3, "Autre 2024-01-02.pdf": 1, "Autre 2023-01-02.pdf": 2}


def test_profiles(spark):
    rows = [("f", 1, ["a", "b"], True), ("f", 2, ["a", "b", "c"], True), ("f", 3, ["z"], False), ("f", 4, None, True)]
    got = sorted((r.profile, r.confirmed, r.rejected) for r in learning.profiles(spark.createDataFrame(rows, "field string, seq int, words array<string>, positive boolean"), ["field"]).collect())
    assert got == [(0, 2, 0), (1, 0, 1), (2, 1, 0)]


def test_profiles_agree_with_the_walk_over_all_signals(spark):
    rng = random.Random(8)
    rows = [(rng.choice("fg"), i, rng.sample("abcdefgh", rng.randint(0, 4)), rng.random() < 0.6) for i in range(400)]
    want = {}
    for field in "fg":
        found = []
        for _, _, words, positive in (r for r in rows if r[0] == field):
            w = set(words)
            best = max([((len(w & p[0]) / len(w | p[0]) if w | p[0] else 1.0), -i) for i, p in enumerate(found)], default=(-1, 0))
            if best[0] < 0.52:
                found.append([w, 0, 0])
                best = (1, 1 - len(found))
            found[-best[1]][1 if positive else 2] += 1
        want |= {(field, i): (" ".join(sorted(p[0])), p[1], p[2]) for i, p in enumerate(found)}
    df = spark.createDataFrame(rows, "field string, seq int, words array<string>, positive boolean")
    assert {(r.field, r.profile): (r.anchor, r.confirmed, r.rejected) for r in learning.profiles(df, ["field"]).collect()} == want
