"""The registered queries on the smallest tables: against their SQL, against plain Python, or against what the tables were made of."""

import hashlib
import html
import math
import re

import duckdb
import pytest
import xxhash
from evidentia.llm import decontaminate, langid, near_dedup, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WHITE = re.compile("[^ \t\n\x0b\x0c\r]+")


def rows(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf).collect()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = con.sql(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_op1_against_plain_loops(spark, documents):
    seen, want = set(), {}
    for r in sorted(documents, key=lambda r: r.doc_id):
        w = WHITE.findall(r.text or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[r.doc_id] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op1_substring_dedup")} == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_op3_gives_the_articles(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").join(queries.QUERIES["op3_html_extract"](spark, SF).select("page_id", "text", "n_chars"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h[1-6])\b[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op4_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in rows(spark, "op4_language_id", sf) if r.held_out and lang[r.doc_id]]
    assert len(found) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_op4_counts_and_cosines_told_plainly():
    texts = ["Ab, ç!", "", "Été 1962 était beau", "a"]
    letters = langid._letters()
    fold = lambda h: ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20
    got = [row for m, _ in langid.counts(texts, letters) for row in m]
    for t, row in zip(texts, got, strict=True):
        c = [0, 0, *[ord(x) if x.isalpha() else 0 for x in t.lower()], 0, 0]
        want = [0] * langid.DIMS
        two = [(a * 0x9E3779B1 ^ b * 0x85EBCA77) & 0xFFFFFFFF for a, b in zip(c, c[1:])]
        for i in range(len(c) - 1):
            if c[i] or c[i + 1]:
                want[fold(two[i])] += 1
        for i in range(len(c) - 2):
            if c[i + 1]:
                want[fold(((two[i] * 0x27D4EB2F) ^ (c[i + 2] * 0xC2B2AE3D) ^ 0x165667B1) & 0xFFFFFFFF)] += 1
        assert sum(row) == sum(want) and list(row) == want


def fingerprint(text):
    w = WHITE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op9_against_all_pairs(spark, documents):
    fp = {r.doc_id: fingerprint(r.text) for r in documents}
    root = {i: i for i in fp}
    for i in fp:
        for j in fp:
            if i < j and root[i] != root[j] and (fp[i] ^ fp[j]).bit_count() <= 2:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op9_simhash")} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_op5_finds_every_verbatim_item(spark, documents):
    plain = lambda t: " " + " ".join(w.decode() for w in decontaminate._plain(decontaminate.split(t))) + " "
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: plain(r.text) for r in documents}
    want = {(i, k) for i, text in texts.items() for k, t in items.items() if t in text}
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op5_decontaminate")}
    assert want and want <= got and {d for d, _ in got} == {d for d, _ in want}


def test_op10_two_records_a_page(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = rows(spark, "op10_warc_derivatives")
    assert len(found) == 2 * len(pages) == len({r.record_id for r in found}) and {r.warc_type for r in found} == {"metadata", "conversion"}
    for r in found:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode()) and r.refers_to and r.refers_to != r.record_id
        if r.warc_type == "metadata":
            assert "source-payload-digest: sha256:" + hashlib.sha256(pages[r.page_id].html.encode()).hexdigest() in r.block


def jaccard_groups(texts):
    split = [[x.lower() for x in WHITE.findall(t or "")] for t in texts]
    sets = [set(zip(*(w[i:] for i in range(min(5, len(w)))))) for w in split]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (a == sets[j] or a and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python or the SQL of op7; run() gives the last one's rows."""
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = before.collect(), docs.collect()
    ids = lambda rs: sorted(r.doc_id for r in rs)
    a, b = kept["language_id"]
    lettered = [r.doc_id for r in a if r.text and any(c.isalpha() for c in r.text)]
    assert set(ids(b)) <= set(lettered) and len(b) >= 0.98 * len(lettered) and all(r in a for r in b)
    a, b = kept["line_dedup"]
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for r in a:
        for x in (r.text or "").split("\n"):
            held.setdefault(low(x), set()).add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if len(low(x)) < 40 or len(held[low(x)]) < 5 or r.doc_id == max(held[low(x)])) for r in a}
    assert {r.doc_id: r.text for r in b} == want and any(want[r.doc_id] != r.text for r in a)
    assert all(r.n_chars == len(r.text) for r in b if want[r.doc_id] != next(x.text for x in a if x.doc_id == r.doc_id))
    a, b = kept["near_dedup"]
    a = sorted(a, key=lambda r: r.doc_id)
    root = jaccard_groups([r.text for r in a])
    assert ids(b) == sorted(a[i].doc_id for i in set(root)) and len(b) < len(a)
    a, b = kept["benchmark_decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = decontaminate.contaminated(spark.createDataFrame([(r.doc_id, r.text) for r in a], "doc_id long, text string"), bench, cos_min=-1.0)
    assert ids(b) == sorted({r.doc_id for r in a} - {r.doc_id for r in found.collect()})
    a, b = kept["mix_sources"]
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/benchmark_decontamination/*.parquet'")
    want = con.sql(f"select doc_id, taken from ({queries.SQL['op7_mix_sources']})").fetchall()
    assert sorted((r.doc_id, r.taken) for r in b) == sorted(want)
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_near_groups_against_all_pairs_with_ties(spark):
    texts = ["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "A B c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "", None, " ", "x y", "x  Y", "x y z"] + [f"{' '.join(str(i) for i in range(40))} tail{k}" for k in range(70)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, digest int, component int")
    got = {r.doc_id: r.component for r in near_dedup.near_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_groups(texts)


def test_crowds_that_share_passages(spark):
    """Crowded keys: chains of near copies, which no middle reaches, among texts that share most of a passage without being near."""
    import random

    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    chain = [passage + [f"c{k}" for k in range(i, i + 12)] for i in range(0, 90)]
    loose = [passage + [f"u{i}x{k}" for k in range(30)] for i in range(60)]
    texts = [" ".join(w) for w in chain + loose]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in near_dedup.near_components(docs, bucket=8).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_groups(texts)
    assert len(set(got.values())) == 61


def clashing(docs):
    """The table with columns named as the operators name theirs."""
    for c in ("id", "i", "b", "h1", "word", "keys", "digest", "spans", "key", "slice", "k1", "hit", "seen", "start", "n", "size", "shard", "pos", "fp", "kept", "score", "rejected", "hi", "lo", "target", "draw", "x", "u", "v", "a"):
        docs = docs.withColumn(c, F.lit(7))
    return docs


def test_clashing_names_change_nothing(spark, documents, tmp_path):
    sf = tmp_path / "clash"
    for t in ("documents", "benchmark", "labels", "embeddings"):
        clashing(spark.read.parquet(f"{SF}/{t}.parquet")).write.parquet(str(sf / f"{t}.parquet"))
    for name in ("op1_substring_dedup", "op4_language_id", "op5_decontaminate", "op6_line_dedup", "op7_mix_sources", "op8_exact_dedup", "op9_simhash", "op11_importance_resample", "op13_quality"):
        plain = lambda rs: sorted((repr(tuple(round(v, 4) if isinstance(v, float) else v for v in r)) for r in rs))
        assert plain(rows(spark, name, str(sf))) == plain(rows(spark, name)), name


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").filter("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in queries.QUERIES:
        n = len(rows(spark, name, str(tmp_path)))
        assert n == (1 if name.startswith("op2_") else 0), name


def test_very_long_texts_and_repeated_rows(spark, tmp_path):
    text = " ".join(f"w{i % 997}x{i // 997}" for i in range(60_000))
    table = [(1, text, "en", "s", len(text)), (2, text + "\nend", "en", None, len(text) + 4), (2, text + "\nend", "en", None, len(text) + 4), (3, None, None, "s", None), (4, "a" * 300_000, "en", "s", 300_000), (5, "\n" * 50_000, "en", "s", 50_000)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(text.split()[500:560]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {name: rows(spark, name, str(tmp_path)) for name in ("op1_substring_dedup", "op4_language_id", "op5_decontaminate", "op6_line_dedup", "op7_mix_sources", "op8_exact_dedup", "op9_simhash")}
    one = {r.doc_id: r for r in got["op1_substring_dedup"]}
    assert (one[1].n_words, one[1].n_removed, one[2].n_words, one[2].n_removed, one[3].n_words, one[4].n_words) == (60_000, 0, 60_001, 60_000, 0, 1)
    assert {r.doc_id for r in got["op5_decontaminate"]} == {1, 2} and len(got["op8_exact_dedup"]) == 6 and len(got["op7_mix_sources"]) == 6
    assert {r.doc_id: r.n_lines for r in got["op6_line_dedup"]}[5] == 50_001
    nine = {r.doc_id: r for r in got["op9_simhash"]}
    assert nine[1].fingerprint == f"{fingerprint(text):016x}" and nine[2].component_id == (1 if (fingerprint(text) ^ fingerprint(text + ' end')).bit_count() <= 2 else 2)
    assert math.isclose(sum(r.taken for r in got["op7_mix_sources"]), sum({r.source_size: r.target for r in got["op7_mix_sources"]}.values()), rel_tol=0.01)
