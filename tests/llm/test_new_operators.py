"""Importance resampling, whitening and the quality classifier against plain Python, with their edge cases."""

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from evidentia.llm import importance, quality, queries, whitening

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest=2):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def resampled(docs, target, buckets, longest, percent, least, seed):
    of = [(i, *features(t, longest)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets
    s = collections.Counter(bucket(x) for _, f, _ in of for x in f)
    t = collections.Counter(bucket(x) for y in target for x in features(y, longest)[0])
    total, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in range(buckets)]
    rows = []
    for i, f, n in of:
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted((repr((*r, rank.get(id(r)))) for r in rows))


def test_resampling_with_edges(spark, monkeypatch):
    # Small blocks and slices, so that texts of one document and features of one word are dealt over many.
    monkeypatch.setattr(importance, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(importance, "COMMON", 20)
    long_ = " ".join(f"W{i % 800} é{i % 7}" for i in range(9000))
    texts = [None, "", "  .,;", "one", "A b", "ÄÖ 漢字漢字 x1", "tie tie tie", "tie tie tie", "the cat " * 40, "the cat " * 40, long_, "z" * 30000, *(f"the cat sat on mat {i} " * (1 + i % 9) for i in range(120))]
    docs = [(i if i != 4 else None, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 2), (9, "another text of this id", 3)]
    target = ["the cat sat", None, "", "漢字漢字 x1 Zebra"]
    left = spark.createDataFrame(docs, "doc_id long, text string, block int").repartition(5)
    right = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id int, text string")
    for kw in ({}, {"buckets": 37, "longest": 3, "percent": 60, "least_words": 0, "seed": 11}):
        got = importance.resample(left, right, **kw)
        want = resampled([d[:2] for d in docs], target, kw.get("buckets", 10000), kw.get("longest", 2), kw.get("percent", 25), kw.get("least_words", 20), kw.get("seed", 7))
        assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == want


def test_resampling_with_text_ids_and_no_target(spark):
    docs = spark.createDataFrame([(f"d{i}", "word " * 30 + str(i)) for i in range(9)], "doc_id string, text string")
    none = spark.createDataFrame([], "text string")
    got = importance.resample(docs, none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4] and {r.doc_id for r in got} == {f"d{i}" for i in range(9)}


def exact_covariance(x):
    n, sums = len(x), [sum(c) for c in zip(*x)]
    return n, sums, [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(len(sums))] for i in range(len(sums))]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.RandomState(3)
    v = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * 3 + 100000).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(900 + i, v[0]) for i in range(200)]
    bad = [(5000, None), (5001, [1.0, None, 2.0, 3.0, 4.0]), (5002, [1.0, float("nan"), 2.0, 3.0, 4.0]), (5003, [float("-inf"), 1.0, 2.0, 3.0, 4.0]), (5004, [1.0, 2.0]), (5005, []), (5006, [3e37, 1.0, 2.0, 3.0, 4.0])]
    return rows, bad


def test_covariance_has_more_digits_than_a_double(spark, vectors):
    rows, bad = vectors
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, x int").repartition(7)
    whole = whitening.materialize(whitening.whole(df), "t-whole")
    assert {r.id for r in whole.collect()} == {i for i, _ in rows}
    f = whitening.fit(whole)
    x = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in rows})
    n, sums, cov = exact_covariance(x)
    assert (f.n, f.sums) == (n, sums) == (300, sums)
    most = max(abs(c) for r in cov for c in r)
    error = max(abs(Fraction(float(f.cov[0][i, j])) + Fraction(float(f.cov[1][i, j])) - cov[i][j]) for i in range(5) for j in range(5))
    assert error <= most * Fraction(1, 10**25)


def test_whitened_rows(spark, vectors):
    rows, bad = vectors
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, components=16).collect()
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {300} and all(r.identity_error < 1e-9 for r in got)
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    n, sums, cov = exact_covariance(sorted(set(map(tuple, x.values()))))
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    values, vecs = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    for r in got:
        k = 5 - r.component
        want = float(np.dot([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x[r.vec_id], sums)], vecs[:, k]) / math.sqrt(values[k]))
        assert math.isclose(abs(r.whitened), abs(want), rel_tol=1e-6, abs_tol=1e-6) and math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9)
    # One sign for each component.
    first = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert all(r.whitened == first[r.component] for r in got if 900 <= r.vec_id < 1100)


def test_flat_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    # Two distinct vectors span one component.
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted((r.component, abs(round(r.whitened, 9)), r.explained) for r in got) == [(1, 1.0, 1.0), (1, 1.0, 1.0)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], schema)).collect()
    assert {r.vec_id: r.deviation for r in huge}[1] is None


def test_factorisation_machine_sums_pairs():
    rng = np.random.RandomState(0)
    texts = ["a b c a", "", "x | y | z!!! 12", "Été A A A"]
    m = quality.train(["good words here in a row. Fine."] * 5 + ["BAD!!! ### | | |"] * 5, np.array([1.0] * 5 + [0.0] * 5))
    m.factors = rng.normal(size=m.factors.shape)
    m.linear = rng.normal(size=m.linear.shape)
    ends, at, values = m.features(texts)
    got = m.margin(ends, at, values)[0]
    for k in range(len(texts)):
        i, x = at[ends[k] : ends[k + 1]], values[ends[k] : ends[k + 1]]
        want = m.bias + (m.linear[i] * x).sum() + sum((m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert math.isclose(got[k], want, rel_tol=1e-9, abs_tol=1e-9)


def test_statistics_of_texts_do_not_depend_on_neighbours():
    texts = ["", "a", " \n ", "One two. One two.\nthree!", "Ä" * 10, "𝒳 y", "x|y " * 30, "\x0b\x0c tab"]
    alone = np.vstack([quality.sparse([t])[3] for t in texts])
    assert np.allclose(quality.sparse(texts)[3], alone)
    names = dict(zip(quality.STATISTICS, quality.sparse(["One two. One two.\nthree!"])[3][0]))
    assert math.isclose(names["words"], math.log1p(5)) and math.isclose(names["bangs"], 1 / 24) and names["repeated_words"] == 2 / 5 and math.isclose(names["word_length"], 20 / 5) and names["capital_words"] == 0


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op13_quality"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in label]
    good, poor = ([r.score for r in test if label[r.doc_id] == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in poor) >= 0.97 * len(good) * len(poor)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "w" * 200_000), (3, "w" * 200_000), (None, "text"), (5, "nice text"), (6, "bad ###")], "doc_id long, text string")
    no = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, no)).collect()
    assert [r.score for r in got] == [0.5] * 7 and {r.predicted for r in got} == {1}
    one = spark.createDataFrame([(5, 1), (6, 1), (5, None), (99, 0), (None, 0)], "doc_id long, quality int")
    assert {round(r.score, 4) for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1.0}
    both = quality.fit(docs, spark.createDataFrame([(5, 1), (6, 0), (6, 1)], "doc_id long, quality int"))
    again = quality.fit(docs, spark.createDataFrame([(6, 1), (6, 0), (5, 1)], "doc_id long, quality int"))
    scores = [sorted((r.doc_id or 0, r.score) for r in quality.score(docs, m).collect()) for m in (both, again)]
    assert scores[0] == scores[1] and len(scores[0]) == 7


def test_a_source_beside_one_ten_thousand_times_its_size(spark, tmp_path, monkeypatch):
    """The registered mix, with shards small enough that the large source has a hundred."""
    from evidentia.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_TOKENS", 32_000)
    large = [(i, "w " * 800, "a", "en", 1600) for i in range(4000)]
    small = [(10_000 + i, "w " * 20, "b", "en", 40) for i in range(16)]
    spark.createDataFrame(large + small, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op7_mix_sources"](spark, str(tmp_path)).collect()
    for ids in (range(4000), range(10_000, 10_016)):
        part = [r for r in got if r.doc_id in ids]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 0.05 * part[0].target and all(r.taken <= 2 * r.size for r in part)
    assert {r.source_size for r in got} == {3_200_000, 320}


def test_near_duplicates_take_simhash_candidates_and_verify_them(spark):
    """With no min-hash pair let through, SimHash alone links near copies; equal fingerprints of sets that are not similar stay apart."""
    import random

    from evidentia.llm import near_dedup, simhash

    rng = random.Random(5)
    long_ = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    texts = [" ".join(long_), " ".join([*long_, "end"]), " ".join(["x"] * 30 + ["p", "q", "r"]), " ".join(["x"] * 30 + ["s", "t", "u"])]
    fps = [simhash.fingerprint(t) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 and fps[2] == fps[3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dedup.signatures(docs)
    ids = {bytes(r.digest): r.id for r in found.collect()}
    edges = near_dedup.links(docs, found, agree=81).collect()
    assert {frozenset((ids[bytes(r.a)], ids[bytes(r.b)])) for r in edges} == {frozenset((0, 1))}
