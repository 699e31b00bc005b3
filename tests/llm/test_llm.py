"""The dealt operators on small tables with nulls, empty and repeated rows, against plain Python."""

import gzip
import hashlib
import html as H
import random
import re
import zlib

import pytest
from evidentia.llm import chat, components, decontaminate, exact_dedup, html_extract, langid, line_dedup, mixing, near_dedup, simhash, substring, warc
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word int"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}" if i % 7 else None, None, 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["w" + "".join(rng.choices("abcde", k=4)) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passage, line = make(60), "A very common line of more than forty code points, indeed"
    out = [None, "", "   ", "one", make(19), make(20)]
    out += [make(50) + " " + passage + " " + make(30) for _ in range(8)]
    out += [make(100) + "\n" + line + "\n" + make(5) for _ in range(7)] + [line.upper(), " " + line]
    out += [out[8], out[8], out[9].replace(" ", "\n"), passage + " " + passage, make(5000)]
    return out


@pytest.mark.parametrize("batches, max_runs, compactions", [(1, 1, 0), (3, 1, 1), (6, 2, 2)])
def test_substring(spark, texts, batches, max_runs, compactions):
    docs = docs_of(spark, texts).union(docs_of(spark, texts[8:10], 8)).union(spark.createDataFrame([(None, texts[8], None, None, None, 1)], SCHEMA))
    counts = {}
    spans = substring.removals(docs, batches=batches, max_runs=max_runs, counts=counts)
    got = {(r.doc_id): (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.strip(docs, spans).collect()}
    assert counts["compactions"] == compactions
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("substring_run_")]
    seen = set()
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert got[None][1] == 0


def test_exact(spark, texts):
    docs = docs_of(spark, texts)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    norm = [re.sub("[ \t\n\x0b\x0c\r]", "", t or "") for t in texts]
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        assert got[i] == (keep, len(same), keep == i)


def test_lines(spark, texts):
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.text for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    for i, t in enumerate(texts):
        kept = [x for x in (t or "").split("\n") if len(key(x)) < 40 or len(held[key(x)]) < 5 or i == max(held[key(x)])]
        assert (got[i] or "") == "\n".join(kept)


def test_lines_with_a_hot_line_and_clashing_names(spark):
    line = "The same line of more than forty code points in all documents"
    docs = spark.createDataFrame([(i, line if i % 3 else f"x{i}\n{line}\n{line}", i) for i in range(400)], "doc_id long, text string, keep int")
    got = {r.doc_id: (r.text, r.n_dropped, r["keep"]) for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    assert all(got[i] == (("" if i % 3 else f"x{i}"), 1 if i % 3 else 2, i) for i in range(399)) and got[399] == (f"x399\n{line}\n{line}", 0, 399)
    with pytest.raises(ValueError, match="n_dropped"):
        line_dedup.apply_bitmaps(docs.withColumn("n_dropped", F.lit(9)), line_dedup.keep_bitmaps(docs))


def test_mix(spark, texts):
    docs = docs_of(spark, texts * 3)
    a, b = (sorted(map(tuple, mixing.mix(docs, block=8, shard_tokens=3000).drop("target").collect()), key=str) for _ in range(2))
    assert a == b
    rows = mixing.mix(docs, block=8).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 24 for t, n in by.values())
    assert mixing.mix(docs.filter("false")).count() == 0


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(3)
    weights = [rng.randint(1, 500) for _ in range(40)]
    p = spark.createDataFrame([(1, i, float(w), 777) for i, w in enumerate(weights)], "g int, i int, w double, n int")
    got = {r.i: r.quota for r in mixing.sainte_lague(p, ["g"], "w", "n", ["i"]).collect()}
    want = [0] * 40
    for _ in range(777):
        k = max(range(40), key=lambda j: (weights[j] / (2 * want[j] + 1), -j))
        want[k] += 1
    assert [got[i] for i in range(40)] == want


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\<|im_end|>", "<\\|", "<|im_start|>user<|im_sep|>", "", None, "a\n\\\\n<s>", "é𝄞<"]
    rows = [(1, i, ["user", "assistant", None, "ro<|le"][i % 4], t) for i, t in enumerate(nasty)] + [(None, None, "assistant", "x"), (None, None, "assistant", "x")]
    m = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(chat.text_parts(m)).withColumn("t", chat.read_turns(F.col("formatted"))).withColumn("l", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(x.role, x.text) for x in out[1].t] == [(r[2] or "", r[3] or "") for r in rows[:-2]]
    assert out[1].l == "".join(r[3] or "" for r in rows[:-2] if r[2] == "assistant") and out[None].n_turns == 2
    assert "</s>" not in out[1].formatted and "[INST]" not in out[1].formatted


def test_chat_parts(spark):
    part = lambda k, t=None, r=None, n=None: (k, t, r, n)
    rows = [(1, 0, "user", [part("text", "see "), part("image", None, "a.png", 7), part("audio", None, "b.wav"), part("text", "<|end")]), (1, 1, "assistant", None)]
    m = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_chats(m).first()
    assert "see <|image:0|><|audio:1|><\\|end" in r.formatted and r.attachment_tokens == 7 + 128
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 7), ("audio", "b.wav", 128)]


def test_simhash_components(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(30)]
    fps = base + [b ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for b in base for _ in range(8)]
    nodes = spark.createDataFrame(sorted({f: i for i, f in enumerate(fps)}.items()), "fp long, id long")
    want = {i: i for _, i in map(tuple, nodes.collect())}
    items = [(r.fp, r.id) for r in nodes.collect()]
    changed = True
    while changed:
        changed = False
        for a, i in items:
            for b, j in items:
                if (a ^ b).bit_count() <= 2 and want[i] != want[j]:
                    want[i] = want[j] = min(want[i], want[j])
                    changed = True
    for bucket in (512, 2):
        got = {r.node: r.component for r in components.components(simhash.links(nodes, bucket=bucket), "a", "b").collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_fingerprint_edges(spark, texts):
    got = {r.doc_id: (r.fp, r.component) for r in simhash.simhash_components(docs_of(spark, texts)).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 0) and got[2] == (0, 0) and got[23][1] == 8
    assert simhash.simhash_components(docs_of(spark, texts).filter("false")).count() == 0


def test_allocate_is_best(spark):
    pairs, probes = [[0, 5, 50, 500], [0, 1, 9, 90], [0, 30, 60, 100]], [[0, 1, 20, 200]] * 3
    cost, ts = simhash.allocate(pairs, probes, 2)
    every = [(sum(pairs[i][t + 1] + probes[i][t + 1] for i, t in enumerate(x)), x) for x in [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3)] if sum(x) == 0]
    assert cost == min(every)[0] and sum(ts) == 0


def test_language(spark):
    rng = random.Random(1)
    vocab = {"aa": ["abba", "acca", "adda"], "bb": ["zuzu", "zyzy", "xoxo"]}
    rows = [(i, " ".join(rng.choices(vocab[k], k=30)), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, "12 !", None), (902, "щщщ ъъъ ыыы " * 20, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected for i, _, k in rows[:120])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].rejected
    empty = langid.identify(d, langid.fit(d.filter("false"))).collect()
    assert {r.lang_pred for r in empty} == {"und"}


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><nav><a>One</a></nav></header><div class="cookie-notice">We use cookies, fine. Please accept, now.</div>
<aside>Side text, with words.</aside><div class="content"><h2>Title &amp; more</h2><p>First paragraph, of   the text. It is &eacute;long.<p>Second<b>bold</b> one, indeed, with text.<ul><li>x one<li>y two</ul>
<form>Name <input></form><div class="comments"><p>Nice post, thanks a lot. I like it, really, much.</p></div></div><footer>(c) 2020, all.</footer>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>cut off <b>here"), (5, "u", "<<<>><div></p>")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Title & more\n\nFirst paragraph, of the text. It is élong.\n\nSecondbold one, indeed, with text.\n\nx one\n\ny two"
    assert got[2].text == got[3].text == "" and got[4].text == "cut off here" and len(got) == 5 and got[1].n_chars == len(got[1].text)
    assert H.unescape("&eacute;") == "é"


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(3)
    noise = [(10 + i, f"http://n/{i}", "".join(chr(rng.randrange(32, 0x2000)) for _ in range(3000))) for i in range(40)]
    rows = [(1, "http://a/x y", PAGE), (1, "http://a/x y", "<p>later</p>"), (2, None, None), (2, None, None), (None, "http://b", "<p>é\r\n\r\n</p>"), *noise]
    source = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    made = warc.derive(source)
    whole = made.unionByName(source.select(*made.columns))
    warc.write_warc(whole.repartition(3), str(tmp_path / "w"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    ids = {r.record_id for r in source.collect()}
    assert len(ids) == 44 and len(back) == 3 * 45
    assert len({r.record_id for r in made.collect()}) == 2 * 44
    by_id = {r.record_id: r for r in whole.collect()}
    for r in back:
        h = {x.name: x.value for x in r.headers}
        assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert h["WARC-Type"] == "response" or h["WARC-Refers-To"].strip("<>") in ids
        assert by_id[h["WARC-Record-ID"].strip("<>")].block == r.block
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_members_and_damage(spark, tmp_path):
    made = warc.responses(spark.createDataFrame([(i, f"http://a/{i}", PAGE) for i in range(5)], "page_id long, url string, html string"))
    warc.write_warc(made.coalesce(1), str(tmp_path / "w"))
    file = next((tmp_path / "w").glob("part-*"))
    data, n = file.read_bytes(), 0
    plain = gzip.decompress(data)
    assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n") and plain.count(b"WARC/1.1\r\n") == 5
    while data:
        d = zlib.decompressobj(31)
        assert d.decompress(data).count(b"WARC/1.1") == (n + 1) % 2
        data, n = d.unused_data, n + 1
    assert n == 10
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a").write_bytes(file.read_bytes()[:-60])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a").write_bytes(gzip.compress(plain))
    assert warc.read_warc(spark, str(tmp_path / "one")).count() == 5


def test_warc_records_told_plainly(spark):
    """Block, digests and links of each derivative from the page alone."""
    rows = [(7, "http://a/x y", "<p>One</p><p>two &amp; three"), (8, None, None)]
    made = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    for key, url, html in rows:
        conversion, metadata = ([r for r in made if r.page_id == key and r.warc_type == k][0] for k in ("conversion", "metadata"))
        text = "One\ntwo & three" if html else ""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len((html or '').encode())}\r\n"
        assert conversion.block == text and conversion.block_digest == sha(text) and conversion.content_length == len(text.encode()) and conversion.target_uri == ("http://a/x%20y" if url else "urn:none")
        fields = dict(line.split(": ", 1) for line in metadata.block.strip().split("\r\n") if not line.startswith("source-http"))
        assert fields == {"conversion": f"<{conversion.record_id}>", "source-payload-digest": sha(html or ""), "source-block-digest": sha(http + "\r\n" + (html or "")), "text-digest": sha(text), "text-chars": str(len(text))}
        assert metadata.refers_to == conversion.refers_to != metadata.record_id and metadata.block_digest == sha(metadata.block)
        heads = {x.name: x.value for x in conversion.headers}
        assert heads["WARC-Source-Payload-Digest"] == sha(html or "") and heads["WARC-Source-Content-Type"] == "text/html; charset=utf-8"


def test_decontamination(spark):
    rng = random.Random(2)
    words = ["q" + "".join(rng.choices("abcdefg", k=5)) for _ in range(3000)]
    make = lambda n: rng.choices(words, k=n)
    items = [make(rng.randint(16, 60)) for _ in range(20)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    rows = [(i, " ".join(make(300))) for i in range(150)] + [(900, None), (901, ""), (902, "...")]
    rows += [(1000 + i, " ".join(make(70) + [x if rng.random() > 0.15 else rng.choice(words) for x in w] + make(40))) for i, w in enumerate(items)] + [(1100, " ".join(items[3]).upper() + ".")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, bench).collect()}
    want = {(1000 + i, i) for i in range(20)} | {(1100, 3)}
    assert not got - want and len(got & want) >= 0.9 * len(want)
    assert decontaminate.contaminated(d, bench.filter("false")).count() == 0 and decontaminate.contaminated(d.filter("false"), bench).count() == 0
    # Blocks and passes change nothing; equal items are one, by the least id.
    twice = bench.union(bench.selectExpr("item_id + 500", "text"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, twice, block_items=3, pass_items=9).collect()} <= got | want
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, twice, block_items=3).collect()}
    assert found == got


@pytest.mark.parametrize("replaced", [0.1, 0.2, 0.3])
def test_decontamination_recall_against_brute_force(spark, replaced):
    """Items of sf0.01 written into its documents with words replaced: candidates by cosine against all passages with all items."""
    rng = random.Random(17)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text and 50 < len(r.text.split()) < 2000]
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in bench.collect() if len(r.text.split()) >= 8]
    words = [w for t in docs[:200] for w in t.split()]
    rows = []
    for n in range(160):
        item, text = rng.choice(items)[1], docs[n % len(docs)].split()
        at = rng.randrange(len(text))
        rows.append((n, " ".join(text[:at] + [rng.choice(words) if rng.random() < replaced else w for w in item] + text[at:])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = lambda low: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, bench, cos_min=low).collect()}
    want, got = pairs(-1.0), pairs(decontaminate.COS_MIN)
    print(f"replaced {replaced}: {len(got & want)} of {len(want)} pairs of the brute force, planted 160")
    assert len(want) >= 100 and got <= want and len(got) >= 0.9 * len(want)


def test_pipeline_keeps_columns_and_empty_tables(spark, texts, tmp_path):
    import corpus_pipeline

    docs_of(spark, texts * 2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"z{i}" for i in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        assert stage(spark, d.filter("false"), str(tmp_path)).count() == 0
        if k < 4:
            assert out.columns == d.columns
            d = out
    assert out.count() == d.count() > 0


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(11)
    words = ["n" + "".join(rng.choices("abcdefg", k=5)) for _ in range(2000)]
    base = [rng.choices(words, k=rng.randint(60, 200)) for _ in range(40)]
    crowd = rng.choices(words, k=150)
    texts = [" ".join(b) for b in base]
    for b in [*base, *[crowd] * 60]:
        copy = list(b)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [None, "", "a b", "A  b", texts[3]]
    split = [(t or "").lower().split() for t in texts]
    sets = [set(zip(*(w[i:] for i in range(min(5, len(w)))))) for w in split]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if want[i] != want[j] and (a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    docs = docs_of(spark, texts)
    for bucket in (64, 3):
        got = {r.doc_id: r.component for r in near_dedup.near_components(docs, bucket=bucket).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(want)
    assert len(set(want)) < len({frozenset(x) for x in sets})
    assert near_dedup.near_components(docs.filter("false")).count() == 0


def test_language_left_out_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    train = docs.filter(~langid.held_out(F.col("doc_id")))
    rng = random.Random(4)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(rng.randint(20, 200))) for _ in range(100)]
    every = langid.fit(train)
    rate = lambda d, model: langid.identify(d, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert rate(docs, every) <= 0.005
    assert rate(docs_of(spark, junk), every) >= 0.95
    for lang in ("en", "fr"):
        assert rate(docs.filter(F.col("lang") == lang), langid.fit(train.filter(F.col("lang") != lang))) >= 0.95


def test_mix_tiny_source_beside_huge(spark):
    rows = [(i, " ".join(["w"] * 200), "huge") for i in range(200)] + [(1000 + i, " ".join(["w"] * 20), "tiny") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix(docs, block=32, shard_tokens=400).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 0.08 * t for t, n in by.values()), by


def test_html_words_in_names_keep_article_text():
    long = "This is a paragraph of the article, with enough words and signs, as one would expect of it. " * 3
    inner = [f'<h2 id="sharing-files">Sharing files</h2><p class="widget-text">{long}</p>', f'<section id="discussion"><h2>What it means</h2><p>{long}</p></section>',
             f'<h3 id="related-work">Related work</h3><p data-id="notice">See <a href="/hidden-gems">gems</a> too, {long}</p>', f'<div class="overflow-hidden"><p>{long}</p></div>']
    page = f"<html><body class='has-sidebar'><nav><a>Site</a></nav><div class='sidebar-wrapper'><article><h1>Head</h1>{''.join(inner)}<p hidden>Gone.</p><div class='comments'><p>{long}</p></div></article></div><div class='ad'>Buy, now.</div></body></html>"
    s = " ".join(long.split())
    assert html_extract.main_text(page).split("\n\n") == ["Head", "Sharing files", s, "What it means", s, "Related work", f"See gems too, {s}", s]


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div>", "</div>"), ("", "")])
def test_html_keeps_all_beside_a_long_block(open_, close):
    short = "A short paragraph, which is part of the article, though little beside the long one stands here."
    long = "Many words, many signs; and so on, for a long time. " * 200
    page = lambda body: f"<html><body><nav><a>Site</a></nav>{open_}{body}{close}<footer>Foot, all.</footer></body></html>"
    for body in (f"<section><p>{long}</p></section><section><h2>Two</h2><p>{short}</p></section>", f"<p>{short}</p><ul><li>{long}</li></ul>", f"<blockquote><p>{long}</p></blockquote><p>{short}</p>"):
        got = html_extract.main_text(page(body))
        assert short in got and long.strip() in got and "Site" not in got and "Foot" not in got
    if open_:
        assert short in html_extract.main_text(page(f"<div class='lead'><p>{short}</p></div><div><p>{long}</p></div>"))
