"""Importance resampling towards a target distribution, by a dictionary of the distinct features of all documents.

Features are all runs of 1 to `longest` consecutive words of a text (A-Z lowered, words are runs of ASCII letters and digits and of characters above
U+007F), repeats counted. Steps:

1. Documents are packed a block at a time: the block's per-document feature counts go to slices of the features by a hash, each
   slice's part as one compressed Arrow table (feature, documents, counts), so the shuffle carries each string once a block.
2. Each slice is a part of the dictionary: its strings are made distinct and counted over all blocks, each distinct string is hashed to
   its bucket once, and the counts are added up by bucket. What leaves the slice is the per-document counts, now by bucket, and the sums.
3. The gain of a bucket is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))); s of S are the corpus's features and t of T the target's.
4. Gains (one number a bucket) meet the per-document counts; a document's weight is the floored mean over its features (none: 0).
5. With Gumbel noise from a hash of the id, the highest scores are drawn. Ranks come from counts by score (integers in a narrow range)
   and row numbers among equal scores, so no task holds all scores.

A feature that stands in more than an eighth of a block's documents is dealt by the block instead of by its hash: the work for a very common
word is spread over all slices, and its string is hashed in several of them. Memory: a block is `BLOCK_CHARS` code points or one text, a slice
about `SLICE_CHARS` code points of text over all blocks.

Null and wordless texts have no features and weight 0. Rows repeated under one id are rows of their own. A null id is hashed as `null`
and sorted first. An empty table gives no rows; an empty target has T = 0. Extra columns don't matter. The blocks follow the order
of the input's partitions, so docs should be a table that reads the same again (files or a written table), as lost tasks are run again.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import materialize, small_batches

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10000, 2, 25, 20, 7
BLOCK_CHARS, BLOCK_DOCS, SLICE_CHARS, LEAST_SLICES, COMMON, HELD = 4 << 20, 4096, 8 << 20, 32, 1000, 2_000_000
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=7)


def packed(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    """Unsigned numbers, each array in its narrowest type, and a text, as compressed bytes."""
    narrow = [_narrow(a) for a in arrays]
    head = struct.pack(f"<I{len(narrow)}IB{len(narrow)}B", len(text), *map(len, narrow), len(narrow), *[a.itemsize for a in narrow])
    whole = text + b"".join(a.tobytes() for a in narrow)
    return struct.pack("<BII", len(head), len(whole), len(narrow)) + head + _codec().compress(whole, asbytes=True)


def unpacked(data: bytes) -> tuple[list[np.ndarray], bytes]:
    size, length, k = struct.unpack_from("<BII", data)
    told = struct.unpack_from(f"<I{k}IB{k}B", data, 9)
    whole, at = _codec().decompress(memoryview(data)[9 + size :], length, asbytes=True), told[0]
    arrays = []
    for n, width in zip(told[1 : k + 1], told[k + 2 :]):
        arrays.append(np.frombuffer(whole, f"<u{width}", n, at))
        at += n * width
    return arrays, whole[: told[0]]


def _joined(strings: pa.Array) -> bytes:
    """All strings as one text, with line ends between; no feature holds one."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(strings)], pa.int64()), strings), pa.scalar("\n", pa.large_string())).cast(pa.large_binary())[0].as_py()


def _split(text: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([text], pa.large_binary()).cast(pa.large_string()), "\n").values


def _crcs(strings: pa.Array) -> np.ndarray:
    """The crc32 of each string's bytes."""
    return np.fromiter(map(zlib.crc32, _joined(strings).split(b"\n")), np.uint64, len(strings)) if len(strings) else np.zeros(0, np.uint64)


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _features(words: list[list[str]], longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of run: (distinct features in order of code points, a hash of each and of its first word, and by feature and document: feature, document, count)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(words)), lens)
    coded = pa.array([w for x in words for w in x], pa.large_string()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    vocabulary = coded.dictionary.take(pa.array(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    run = word = place[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.int64)
    strings, hashes = vocabulary, _crcs(vocabulary)
    word_hash = first = hashes
    docs = max(len(words), 1)
    for n in range(1, longest + 1):
        if n > 1:
            # Longer by one word, where the document goes on: pairs of a run and a word are made distinct as numbers, then as strings.
            on = doc[: len(doc) - n + 1] == doc[n - 1 :]
            at = np.flatnonzero(on)
            pair, back = np.unique(run[at] * len(vocabulary) + word[at + n - 1], return_inverse=True)
            a, b = np.divmod(pair, max(len(vocabulary), 1))
            strings = pc.binary_join_element_wise(strings.take(pa.array(a)), vocabulary.take(pa.array(b)), pa.scalar(" ", pa.large_string()))
            first = first[a]
            hashes = (hashes[a] * np.uint64(0x9E3779B97F4A7C15)) ^ (word_hash[b] + np.uint64(n))
            run = np.zeros(len(doc), np.int64)
            run[at] = back
            here, where = back, doc[at]
        else:
            here, where = run, doc
        both, count = np.unique(here * docs + where, return_counts=True)
        feature, of = np.divmod(both, docs)
        yield strings, hashes, first, feature, of, count


def _packs(slices: int, longest: int, corpus: int, id_type: pa.DataType):
    """A function from (id, text) batches to rows (slice, block, corpus, ids, words, counts); ids and words for the corpus (0) only."""

    def block_rows(block: int, held: list[tuple]) -> Iterator[dict]:
        words = [WORDS.findall(t) for _, t in held]
        spread = int(np.uint64(block * 0x9E3779B97F4A7C15 % (1 << 64)) >> np.uint64(33)) % slices
        if corpus == 0:
            n = np.fromiter(map(len, words), np.int64, len(words))
            yield {"slice": spread, "block": block, "corpus": corpus, "ids": [i for i, _ in held], "words": n.tolist(), "counts": None}
        for strings, hashes, first, feature, of, count in _features(words, longest):
            if not len(feature):
                continue
            # Features of one first word go together, so that their texts shrink; those of a very common one are dealt by all words.
            _, back, runs = np.unique(first, return_inverse=True, return_counts=True)
            mixed = np.where(runs[back] * COMMON > len(first), hashes, first)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            dealt = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(slices)).astype(np.int64)
            start = np.flatnonzero(np.diff(feature, prepend=-1))
            many = np.diff(start, append=len(feature))
            dealt[many > max(len(held) // 8, 8)] = spread
            dealt = _narrow(dealt)
            order = np.argsort(dealt, kind="stable")
            by_slice = np.argsort(dealt[feature], kind="stable")
            of, count = of[by_slice], count[by_slice]
            cuts = np.searchsorted(dealt[order], np.arange(slices + 1))
            ends = np.concatenate([[0], np.cumsum(many[order])])
            for s in np.flatnonzero(np.diff(cuts)):
                lo, hi = cuts[s], cuts[s + 1]
                docs = slice(ends[lo], ends[hi])
                counts = packed(many[order[lo:hi]], of[docs], count[docs], text=_joined(strings.take(pa.array(order[lo:hi]))))
                yield {"slice": int(s), "block": block, "corpus": corpus, "ids": None, "words": None, "counts": counts}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, chars = TaskContext.get().partitionId() << 31, [], 0
        schema = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("corpus", pa.int32()), ("ids", pa.list_(id_type)), ("words", pa.list_(pa.int64())), ("counts", pa.binary())])
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), pc.ascii_lower(pc.fill_null(b.column(1), "")).to_pylist()):
                if held and (chars + len(t) > BLOCK_CHARS or len(held) >= BLOCK_DOCS):
                    for row in block_rows(block, held):
                        yield pa.RecordBatch.from_pylist([row], schema)
                    block, held, chars = block + 1, [], 0
                    pa.default_memory_pool().release_unused()
                held.append((i, t))
                chars += len(t)
        if held:
            yield from (pa.RecordBatch.from_pylist([row], schema) for row in block_rows(block, held))

    return of


def _dictionary(buckets: int, id_type: pa.DataType):
    """A function from the rows of one slice to the same rows by bucket, and one row of sums by bucket for each side."""

    def of(rows: pa.Table) -> pa.Table:
        ids, words, counts = (rows.column(c).to_pylist() for c in ("ids", "words", "counts"))
        side, block = np.asarray(rows.column("corpus")), np.asarray(rows.column("block"))
        out = [{"block": int(block[k]), "ids": ids[k], "words": words[k]} for k in range(len(ids)) if ids[k] is not None]
        at = [k for k, c in enumerate(counts) if c is not None]
        if at:
            parts = [unpacked(counts[k]) for k in at]
            coded = pa.concat_arrays([_split(text) for _, text in parts]).dictionary_encode()
            codes = coded.indices.to_numpy()
            bucket = (_crcs(coded.dictionary) % np.uint64(buckets)).astype(np.int64)
            total, first = np.zeros((2, len(bucket)), np.int64), 0
            for k, ((many, of_doc, n), _) in zip(at, parts):
                here = np.repeat(codes[first : first + len(many)], many)
                first += len(many)
                np.add.at(total[side[k]], here, n.astype(np.int64))
                if side[k] == 0:
                    order = np.argsort(of_doc, kind="stable")
                    out.append({"block": int(block[k]), "counts": packed(of_doc[order], bucket[here][order], n[order])})
            for s in (0, 1):
                if total[s].any():
                    out.append({"corpus": s, "sums": np.bincount(bucket, weights=total[s], minlength=buckets).astype(np.int64).tolist()})
        schema = pa.schema([("block", pa.int64()), ("corpus", pa.int32()), ("ids", pa.list_(id_type)), ("words", pa.list_(pa.int64())), ("counts", pa.binary()), ("sums", pa.list_(pa.int64()))])
        return pa.Table.from_pylist(out, schema)

    return of


def feature_counts(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The written table of steps 1 and 2: rows with `counts` hold a block's (document, bucket, n) of one slice, rows with `ids` its ids and
    numbers of words, rows with `sums` a slice's counts by bucket of the corpus (0) or the target (1)."""
    chars = docs.agg(F.sum(F.octet_length(text_col)).alias("c")).first()["c"] or 0
    slices = max(LEAST_SLICES, math.ceil(chars / slice_chars))
    kind = docs.schema[id_col].dataType
    of_id, packs = to_arrow_type(kind), f"slice int, block bigint, corpus int, ids array<{kind.simpleString()}>, words array<bigint>, counts binary"
    sent = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    goal = target.select(F.lit(None).cast(kind).alias("id"), F.col(target_text).alias("text"))
    rows = sent.mapInArrow(_packs(slices, longest, 0, of_id), packs).unionByName(goal.mapInArrow(_packs(slices, longest, 1, of_id), packs))
    return materialize(rows.groupBy("slice").applyInArrow(_dictionary(buckets, of_id), packs.replace("slice int, ", "") + ", sums array<bigint>"), "feature-counts")


def gains(counted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from the sums of feature_counts: one number a bucket."""
    by = counted.filter("sums is not null").select("corpus", F.posexplode("sums").alias("bucket", "n")).groupBy("corpus", "bucket").agg(F.sum("n").alias("n"))
    s = np.zeros((2, buckets), object)
    for r in by.collect():  # two rows a bucket
        s[r["corpus"], r["bucket"]] = r["n"]
    total, goal = (sum(x) for x in s)
    return [math.floor(1000 * math.log((float(t + 1) * float(total + buckets)) / (float(n + 1) * float(goal + buckets)))) for n, t in zip(*s)]


def weights(counted: DataFrame, gain: list[int], id_type: T.DataType, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of each document: the floored mean of its features' gains."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, held, size = np.array(gain, np.int64), {}, 0

        def flush() -> pd.DataFrame:
            # Gains may be negative: a block's sums are sent with their least taken off.
            low = {b: int(t.min()) for b, t in held.items()}
            rows = pd.DataFrame({"block": list(held), "ids": None, "words": None, "sums": [struct.pack("<q", low[b]) + packed(t - low[b]) for b, t in held.items()]})
            held.clear()
            return rows

        for b in batches:
            meta = b["words"].notna()
            yield b.loc[meta, ["block", "ids", "words"]].assign(sums=None)
            for block, c in zip(b.loc[~meta, "block"], b.loc[~meta, "counts"]):
                (doc, bucket, n), _ = unpacked(c)
                total = np.bincount(doc, weights=g[bucket] * n.astype(np.int64)).astype(np.int64)
                old = held.get(block, np.zeros(0, np.int64))
                size += max(len(total) - len(old), 0)
                held[block] = np.pad(total, (0, max(len(old) - len(total), 0))) + np.pad(old, (0, max(len(total) - len(old), 0)))
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def close(block: pd.DataFrame) -> pd.DataFrame:
        row = block[block["words"].notna()].iloc[0]
        words = np.asarray(row["words"], np.int64)
        n = sum((np.maximum(words - k, 0) for k in range(longest)), np.zeros(len(words), np.int64))
        total = np.zeros(len(words), np.int64)
        for c in block["sums"]:
            if c is not None:
                (part,), _ = unpacked(c[8:])
                total[: len(part)] += part.astype(np.int64) + struct.unpack("<q", c[:8])[0]
        return pd.DataFrame({"id": pd.Series(list(row["ids"]), dtype=pd.ArrowDtype(of_id)), "n_words": words, "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)})

    of_id = to_arrow_type(id_type)
    kept = f"block bigint, ids array<{id_type.simpleString()}>, words array<bigint>, sums binary"
    rows = counted.filter("sums is null").select("block", "ids", "words", "counts").mapInPandas(add, kept)
    return rows.groupBy("block").applyInPandas(close, f"id {id_type.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) for a u in (0, 1) from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT, id_col: str = "id") -> DataFrame:
    """scored with the column rank: 1, 2, 3... by falling score, ties to the smaller id, for the floor(percent * N / 100) highest of the N
    eligible rows; null for the others."""
    some = scored.withColumn("__ev_in", F.coalesce(eligible, F.lit(False)))
    by_score = some.filter("__ev_in").groupBy("score").agg(F.count(F.lit(1)).alias("__ev_n"))
    # One row for each score, an integer within some tens of thousands, whatever the number of documents.
    order = Window.orderBy(F.col("score").desc())
    above = by_score.select("score", (F.sum("__ev_n").over(order) - F.col("__ev_n")).alias("__ev_above"), F.floor(F.sum("__ev_n").over(Window.partitionBy()) * percent / 100).alias("__ev_k"))
    found = some.join(F.broadcast(above), "score", "left")
    reached = F.coalesce(F.col("__ev_in") & (F.col("__ev_above") < F.col("__ev_k")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("score", "__ev_reached").orderBy(F.col(id_col).asc_nulls_first()))
    found = found.withColumn("__ev_reached", reached)
    ranked = found.filter("__ev_reached").withColumn("rank", F.col("__ev_above") + place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("__ev_k"), F.col("rank")))
    return ranked.unionByName(found.filter("not __ev_reached").withColumn("rank", F.lit(None).cast("long"))).drop("__ev_in", "__ev_n", "__ev_above", "__ev_k", "__ev_reached")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each document."""
    counted = feature_counts(docs, target, id_col, text_col, target_text, buckets, longest)
    found = weights(counted, gains(counted, buckets), docs.schema[id_col].dataType, longest)
    scored = materialize(found.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    return draw(scored, F.col("n_words") >= least_words, percent).withColumnRenamed("id", id_col)
