"""Substring de-duplication over a log-structured index of window hashes.

A window is `window` consecutive words. A window is repeated when its words also start earlier: in a smaller id, or earlier in
the same document. Every window is represented by its anchor, the `gram` consecutive words in it with the least hash (leftmost of
equals), so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a stretch, hashed
once over all its words: about one index entry for eight windows.

Index: each batch of documents, in order of id, writes one immutable run of entries (anchor hash, stretch hash, id, start,
windows), bucketed and sorted by anchor hash. A new batch is merge-joined bucket by bucket with the earlier runs; neither side is
shuffled again. A stretch whose anchor and stretch hash (128 bits on all its words) stand earlier is repeated as a whole. Where
an anchor stands in different stretches, the entries are ambiguous and are verified window by window: their documents are read again, each window gets a
128-bit hash, and the earliest of equal windows stays. Verified windows are runs too, bucketed by hash and merge-joined in the same way. When there
are more than max_runs runs of a kind they are compacted by a merge join into one that keeps the first entry of each stretch or window.

Skew: each map task folds equal stretches to their first before anything is shuffled, and an anchor that is ambiguous inside the
task sends its stretches to buckets of their own and a single marker to the anchor's bucket. So one anchor's bucket gets at
most two rows from a task however common its words are, and the work on them is in proportion to their number.

Null text has no words; texts of fewer than `window` words are never touched. Rows repeated under one id are one document. Rows with a null id are
neither indexed nor touched. Ids are integers. Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bitmap_of, by_first_key, discard, in_bitmap, materialize, small_batches, work_dir, written

WINDOW, GRAM = 20, 6
SINGLE, AMBIGUOUS, MARKER, KNOWN = 0, 1, 2, 3
CHUNK_WORDS, FOLD_ROWS = 400_000, 1_500_000
_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ENTRY = "b bigint, ctx bigint, id bigint, start int, n int, kind int"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text) -> list[bytes]:
    """bytes.split cuts at space and U+0009 to U+000D only."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes of any slice of an array of word hashes."""

    def __init__(self, w: np.ndarray, m: int):
        n = len(w)
        powers = np.full(n + 1, m, np.uint64)
        back = np.full(n + 1, pow(m, -1, 1 << 64), np.uint64)
        powers[0] = back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(w ^ np.uint64(m)) * np.cumprod(powers, dtype=np.uint64)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length, np.uint64))


def stretches(w: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(document index, start in the document, windows, anchor hash, stretch hash) of all stretches; w holds the documents' word hashes one after another."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    none = np.zeros(0, np.int64)
    if len(w) < window:
        return none, none, none, none, none
    grams = Rolling(w, _M1).of(np.arange(len(w) - gram + 1), gram)
    val, pos, span, want = grams, np.arange(len(grams)), 1, window - gram + 1
    while span < want:
        step = min(span, want - span)
        later = val[step:] < val[:-step]
        val, pos = np.where(later, val[step:], val[:-step]), np.where(later, pos[step:], pos[:-step])
        span += step
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(val)]
    inside = np.arange(len(val)) + window <= offsets[doc + 1]
    s = np.nonzero(inside)[0]
    if not len(s):
        return none, none, none, none, none
    cut = np.concatenate([[True], (np.diff(pos[s]) != 0) | (np.diff(s) != 1) | (np.diff(doc[s]) != 0)])
    first = np.nonzero(cut)[0]
    n = np.diff(np.concatenate([first, [len(s)]]))
    a = s[first]
    return doc[a], a - offsets[doc[a]], n, val[a].view(np.int64), Rolling(w, _M2).of(a, n + window - 1).view(np.int64)


def _fold(rows: list[np.ndarray]) -> pd.DataFrame:
    """A task's entries with equal stretches folded; see the module's notes on skew."""
    h, ctx, ids, start, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((start, ids, ctx, h))
    h, ctx, ids, start, n = h[order], ctx[order], ids[order], start[order], n[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]) | (ids[1:] != ids[:-1]) | (start[1:] != start[:-1])])
    h, ctx, ids, start, n = h[once], ctx[once], ids[once], start[once], n[once]  # a repeated row is the same document
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    first = new_h | np.concatenate([[True], ctx[1:] != ctx[:-1]])
    many = np.add.reduceat(first.astype(np.int64), np.nonzero(new_h)[0])[np.cumsum(new_h) - 1] > 1
    kind = np.where(~first, KNOWN, np.where(many, AMBIGUOUS, SINGLE))
    spread = _mixed(h.view(np.uint64) ^ ctx.view(np.uint64)).view(np.int64)
    b = np.where(kind == SINGLE, h, np.where(kind == AMBIGUOUS, spread, _mixed(ids.view(np.uint64)).view(np.int64)))
    out = pd.DataFrame({"b": b, "ctx": ctx, "id": ids, "start": start, "n": n, "kind": kind})
    marks = h[new_h & many]
    return pd.concat([out, pd.DataFrame({"b": marks, "ctx": 0, "id": 0, "start": 0, "n": 0, "kind": MARKER})], ignore_index=True) if len(marks) else out


def _slices(table: pd.DataFrame, rows: int = 100_000) -> Iterator[pd.DataFrame]:
    for i in range(0, len(table), rows):
        yield table.iloc[i : i + rows]


def entries(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Index entries of documents (id, text)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rows, held = WordHashes(), [], 0
        words, ids, lengths = [], [], []

        def flush():
            nonlocal held
            d, start, n, h, ctx = stretches(known.of(words), np.array(lengths, np.int64), window, gram)
            if len(d):
                rows.append((h, ctx, np.array(ids, np.int64)[d], start, n))
                held += len(d)
            words.clear(), ids.clear(), lengths.clear()

        for batch in batches:
            for i, text in zip(batch["id"], batch["text"], strict=True):
                w = words_of(text)
                if len(w) >= window:
                    words.extend(w), ids.append(i), lengths.append(len(w))
                if len(words) >= CHUNK_WORDS:
                    flush()
                if held >= FOLD_ROWS:
                    yield from _slices(_fold(rows))
                    rows, held = [], 0
        if words:
            flush()
        if rows:
            yield from _slices(_fold(rows))

    return small_batches(docs).mapInPandas(of, ENTRY)


class SubstringIndex:
    """The index: runs of entries and runs of verified windows, tables on shared storage until close."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, max_runs: int = 1, buckets: int | None = None):
        self.spark, self.window, self.gram, self.max_runs = spark, window, gram, max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str]] = []
        self.windows: list[tuple[str, str]] = []
        self.compactions = 0

    def _write_run(self, rows: DataFrame, keys: tuple[str, str], dealt: bool = False) -> tuple[str, str]:
        name = f"substring_run_{uuid.uuid4().hex}"
        path = f"{work_dir(self.spark)}/{name}"
        rows = rows if dealt else rows.repartition(self.buckets, keys[0])
        rows.write.format("parquet").bucketBy(self.buckets, keys[0]).sortBy(*keys).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)

    def close(self) -> None:
        """Drop all runs."""
        self._drop(self.runs + self.windows)
        self.runs, self.windows = [], []

    def _compact(self) -> None:
        """Merge all runs of entries into one by merge joins on the anchor; of equal stretches the first stays."""
        entry = "array<struct<ctx:bigint,kind:int,id:bigint,start:int,n:int>>"
        none = F.array().cast(entry)
        merged = None
        for k, (name, _) in enumerate(self.runs):
            per = self.spark.table(name).filter(F.col("kind") != KNOWN).groupBy("b").agg(F.collect_list(F.struct("ctx", "kind", "id", "start", "n")).alias(f"e{k}"))
            if merged is None:
                merged = per.select("b", F.col("e0").alias("e"))
            else:
                per = per.withColumnRenamed("b", "b_other")
                merged = merged.join(per, F.col("b") == F.col("b_other"), "full").select(F.coalesce("b", "b_other").alias("b"), F.concat(F.coalesce("e", none), F.coalesce(f"e{k}", none)).alias("e"))
        merged = merged.withColumn("e", F.array_sort("e"))
        before = lambda i: F.get("e", i - 1)
        firsts = F.filter("e", lambda x, i: (i == 0) | (x["ctx"] != before(i)["ctx"]) | (x["kind"] != before(i)["kind"]))
        run = self._write_run(merged.select("b", F.inline(firsts)).select("b", "ctx", "id", "start", "n", "kind"), ("b", "ctx"), dealt=True)
        self._drop(self.runs)
        self.runs = [run]
        self.compactions += 1

    def _compact_windows(self) -> None:
        """The same for the runs of verified windows."""
        first = None
        for k, (name, _) in enumerate(self.windows):
            per = self._firsts(name, f"f{k}")
            first = per.withColumnRenamed("f0", "first") if first is None else first.join(per, ["k1", "k2"], "full").select("k1", "k2", F.least("first", f"f{k}").alias("first"))
        with by_first_key(self.spark):
            run = self._write_run(first.select("k1", "k2", "first.id", "first.pos", F.lit(2).alias("role")), ("k1", "k2"), dealt=True)
        self._drop(self.windows)
        self.windows = [run]

    def _firsts(self, name: str, col: str) -> DataFrame:
        """(k1, k2, first place) of the windows of a run; the run's buckets make it free of shuffles."""
        return self.spark.table(name).groupBy("k1", "k2").agg(F.min(F.struct("id", "pos")).alias(col))

    def ingest(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """(id, start, length) spans of repeated words in batch (id, text), whose ids all come after those taken in before; a written table.

        corpus (id, text) holds the batch and everything before it; only its documents with ambiguous entries are read again.
        """
        if len(self.runs) > self.max_runs:
            self._compact()
        if len(self.windows) > self.max_runs:
            self._compact_windows()
        run = self._write_run(entries(batch, self.window, self.gram), ("b", "ctx"))
        rows, held, old = self.spark.table(run[0]), F.lit(False), F.lit(0)
        for k, (name, _) in enumerate(self.runs):
            other = self.spark.table(name).filter(F.col("kind") != KNOWN)
            rows = rows.join(other.filter(F.col("kind") != MARKER).groupBy("b", "ctx").agg(F.count(F.lit(1)).alias(f"c{k}")), ["b", "ctx"], "left")
            rows = rows.join(other.groupBy("b").agg(F.count(F.lit(1)).alias(f"o{k}")), "b", "left")
            held, old = held | F.col(f"c{k}").isNotNull(), old + F.coalesce(f"o{k}", F.lit(0))
        at, order = Window.partitionBy("b"), Window.partitionBy("b").orderBy("ctx", "id", "start")
        real = F.col("kind").isin(SINGLE, AMBIGUOUS)
        # A repeated row is the same document: its entries aren't repeats of themselves, and go on to be verified.
        same = (F.lag("ctx").over(order) == F.col("ctx")) & ((F.lag("id").over(order) != F.col("id")) | (F.lag("start").over(order) != F.col("start")))
        rows = rows.withColumn("old", old).withColumn("again", F.coalesce(same, F.lit(False)) | held)
        rows = rows.withColumn("row", F.row_number().over(order)).withColumn("new", real & ~F.col("again"))
        rows = rows.withColumn("news", F.sum(F.col("new").cast("int")).over(at)).withColumn("marks", F.max((F.col("kind").isin(AMBIGUOUS, MARKER)).cast("int")).over(at))
        doubt = (F.col("news") + F.col("old") > 1) | (F.col("marks") == 1)
        one = lambda role: F.array(F.struct(F.lit(role).alias("role"), F.col("id"), F.col("start"), F.col("n")))
        none = F.array().cast("array<struct<role:int,id:bigint,start:int,n:int>>")
        own = F.when((F.col("kind") == KNOWN) | real & F.col("again"), one(0)).when(F.col("new") & doubt, one(1)).otherwise(none)
        # Anchors whose earlier single entries have to be verified too: their hash stands in the place of an id.
        touched = (F.col("row") == 1) & (F.col("old") > 0) & ((F.col("news") > 0) | (F.col("marks") == 1))
        anchor = F.array(F.struct(F.lit(3).alias("role"), F.col("b").alias("id"), F.lit(0).alias("start"), F.lit(0).alias("n")))
        with by_first_key(self.spark):
            found, found_at = written(rows.select(F.inline(F.concat(own, F.when(touched, anchor).otherwise(none)))), "substring-found")
        doubts = found.filter("role = 1")
        anchors = found.filter("role = 3").select(F.col("id").alias("b"))
        for name, _ in self.runs:
            doubts = doubts.union(self.spark.table(name).filter(F.col("kind") == SINGLE).join(anchors, "b", "left_semi").select(F.lit(2).alias("role"), "id", "start", "n"))
        doubts, doubts_at = written(doubts, "substring-doubts")
        self.runs.append(run)
        spans = found.filter("role = 0").select("id", "start", (F.col("n") + self.window - 1).alias("length"))
        windows, windows_at = self._verify(doubts, corpus)
        with by_first_key(self.spark):
            spans = materialize(spans.union(windows), "substring-spans")
        for path in (found_at, doubts_at, windows_at):
            discard(self.spark, path)
        return spans

    def _verify(self, doubts: DataFrame, corpus: DataFrame) -> tuple[DataFrame, str]:
        """Spans of the windows of new entries in doubt (role 1) that stand earlier in any entry in doubt, and the path of a work table they read."""
        window = self.window
        per_doc = doubts.groupBy("id").agg(F.collect_list(F.struct("start", "n", "role")).alias("spans")).withColumnRenamed("id", "i")
        hit = in_bitmap(corpus, F.col("id"), bitmap_of(doubts, F.col("id")), "maybe").filter("maybe").drop("maybe")
        texts = hit.dropDuplicates(["id"]).join(per_doc, F.col("id") == F.col("i")).select("id", "text", "spans")

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, parts, held = WordHashes(), [], 0

            def fold():
                k1, k2, ids, pos, role = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((pos, ids, k2, k1))
                k1, k2, ids, pos, role = k1[order], k2[order], ids[order], pos[order], role[order]
                same = np.concatenate([[False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])])
                t = pd.DataFrame({"k1": k1, "k2": k2, "id": ids, "pos": pos, "role": np.where(same & (role == 1), 0, role)})
                yield from _slices(t[~(same & (role == 2))])

            for batch in batches:
                for i, text, spans in zip(batch["id"], batch["text"], batch["spans"], strict=True):
                    w = known.of(words_of(text))
                    start = np.array([x["start"] for x in spans], np.int64)
                    n = np.array([x["n"] for x in spans], np.int64)
                    role = np.repeat(np.array([x["role"] for x in spans], np.int64), n)
                    pos = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pos, at = np.unique(pos, return_index=True)
                    parts.append((Rolling(w, _M1).of(pos, window).view(np.int64), Rolling(w, _M2).of(pos, window).view(np.int64), np.full(len(pos), i, np.int64), pos, role[at]))
                    held += len(pos)
                    if held >= FOLD_ROWS:
                        yield from fold()
                        parts, held = [], 0
            if parts:
                yield from fold()

        hashed, hashed_at = written(texts.mapInPandas(of, "k1 bigint, k2 bigint, id bigint, pos bigint, role int"), "substring-windows")
        run = self._write_run(hashed.filter("role > 0"), ("k1", "k2"))
        first = self._firsts(run[0], "first")
        for k, (name, _) in enumerate(self.windows):
            first = first.join(self._firsts(name, f"f{k}"), ["k1", "k2"], "left").select("k1", "k2", F.least("first", f"f{k}").alias("first"))
        self.windows.append(run)
        later = self.spark.table(run[0]).filter("role = 1").join(first, ["k1", "k2"]).filter((F.col("id") != F.col("first.id")) | (F.col("pos") != F.col("first.pos")))
        spans = later.select("id", "pos").union(hashed.filter("role = 0").select("id", "pos"))
        return spans.select("id", F.col("pos").cast("int").alias("start"), F.lit(window).alias("length")), hashed_at


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, window: int = WINDOW, gram: int = GRAM, max_runs: int = 1, counts: dict | None = None) -> DataFrame:
    """(id, start, length) word spans to remove from the whole table, taken into a fresh index in `batches` batches by id; a written table.

    With more batches than max_runs + 1 the index is compacted on the way; counts, if given, gets their number as "compactions".
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    cuts = sorted(set(rows.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    index, spans = SubstringIndex(spark, window, gram, max_runs), None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.filter(F.col("id") > int(low))
        upto = rows if high is None else rows.filter(F.col("id") <= int(high))
        part = part if high is None else part.filter(F.col("id") <= int(high))
        found = index.ingest(part, upto)
        spans = found if spans is None else spans.union(found)
    index.close()
    if counts is not None:
        counts["compactions"] = index.compactions
    return spans


def strip(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) for each row, without the words of its spans; kept words are joined by one space.

    spans are read twice, so they should be a written table, as removals gives.
    """
    per_doc = spans.groupBy("id").agg(F.collect_list(F.struct("start", "length")).alias("spans")).withColumnRenamed("id", "i")
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = in_bitmap(rows, F.col("id").cast("bigint"), bitmap_of(per_doc, F.col("i")), "maybe")
    hit = marked.filter("maybe").join(per_doc, F.col("id").cast("bigint") == F.col("i"), "left").select("id", "text", "spans")
    kind = "array<struct<start:int,length:int>>"
    rest = marked.filter("not maybe").select("id", "text", F.lit(None).cast(kind).alias("spans"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, spans in zip(b["id"], b["text"], b["spans"], strict=True):
                words, total = words_of(text), 0
                total = len(words)
                if spans is not None and len(spans):
                    gone = np.zeros(total + 1, np.int64)
                    start = np.array([x["start"] for x in spans])
                    np.add.at(gone, np.minimum(start, total), 1)
                    np.add.at(gone, np.minimum(start + np.array([x["length"] for x in spans]), total), -1)
                    words = [words[k] for k in np.nonzero(np.cumsum(gone)[:total] == 0)[0]]
                kept = b" ".join(words)
                out.append((i, total, total - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if kept_text else [])))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_sha256", *(["kept"] if kept_text else [])])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * kept_text
    return hit.union(rest).mapInPandas(of, schema).withColumnRenamed("id", id_col)
