"""Near duplicates by the similarity of their shingles: SimHash and min-hash candidates, each verified on the whole sets.

Two texts are near duplicates when the Jaccard similarity of their sets of 5-word shingles (A-Z lowered) is `similarity` (0.8) or more; a text of
fewer words is one shingle. Texts of equal sets are one node (its least id), so copies never form pairs. First come the candidates of
SimHash by the generalised pigeonhole principle (`simhash.links`: fingerprints of 3-word shingles that differ in two bits at most, equal ones included).
Near copies lie up to ten bits apart, so others follow by min-hash: these share one of `bands` keys of `rows` min-hashes (16 of 5: a pair at 0.8 is met with probability 0.998, one at 0.9 with 0.9999997), and no
candidate of either kind becomes a link before its similarity is counted on the whole sets.

A key shared by more than `bucket` nodes is not paired whole: its nodes are compared with one of them (that in most such keys, so near the
middle of its crowd). Those that are not near it are joined with the nodes of all crowded keys by an exact prefix filter: with shingles in order of rarity, two sets of similarity s
have one of their first n - ceil(s n) + 1 shingles in common, and its places in both bound how much the rest can agree; sets that the links so far make one group don't meet. Rarity is counted in a sketch of 2^18 hashed counters (any order common
to all sets is right; a rare one makes few pairs), so members of a crowd that share long passages but are no near duplicates don't meet. Pairs that agree on
fewer than `agree` of the 80 min-hashes (a pair at 0.8 does so with probability 0.0005) are left out before the sets are read.

Null or wordless texts have an empty set and are one group. Rows repeated under one id agree when their texts do. Rows with a
null id get a component only from others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, small_batches
from .components import components

SIMILARITY, SHINGLE, BANDS, ROWS, BUCKET, AGREE = 0.8, 5, 16, 5, 64, 52
_CHUNK = 512
_ODD = np.random.RandomState(42).randint(0, 1 << 62, BANDS * ROWS * 4, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(42))), ">u8").astype(np.uint64)
    n = min(shingle, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[i : len(h) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def min_hashes(s: np.ndarray, n: int) -> np.ndarray:
    """n min-hashes of a set that is not empty."""
    return np.min([(s[i : i + _CHUNK, None] * _ODD[:n]).min(0) for i in range(0, len(s), _CHUNK)], axis=0)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, digest of the set, its size, SimHash fingerprint, a byte of each min-hash, a key for each band) for each row; no keys for an empty set."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests, sizes, sketches, keys = [], [], [], []
            for t in b["text"]:
                s = shingles(t if isinstance(t, str) else None)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                m = min_hashes(s, bands * rows).reshape(bands, rows) if len(s) else []
                sketches.append(np.asarray(m).astype(np.uint8).tobytes())
                keys.append([xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(m)])
            fps = [simhash.fingerprint(t if isinstance(t, str) else None) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "digest": digests, "n": sizes, "fp": fps, "sketch": sketches, "keys": keys})

    sent = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return sent.mapInPandas(of, f"id {sent.schema['id'].dataType.simpleString()}, digest binary, n int, fp bigint, sketch binary, keys array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, set) of the rows whose id is in ids."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t if isinstance(t, str) else None) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in found], "held": [s.view(np.int64) for s in found]})

    sent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    return small_batches(sent).mapInPandas(of, f"id {sent.schema['id'].dataType.simpleString()}, digest binary, held array<bigint>")


def _alike(pairs: DataFrame, nodes: DataFrame, agree: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree in at least agree places."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), np.uint8).reshape(len(p), -1) for c in ("sa", "sb"))
                yield p.loc[(x == y).sum(1) >= agree, ["a", "b"]]

    left = nodes.select(F.col("digest").alias("a"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("digest").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(of, "a binary, b binary")


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    left = sets.select(F.col("digest").alias("a"), F.col("held").alias("ha"))
    right = sets.select(F.col("digest").alias("b"), F.col("held").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("ha", "hb")))
    return both.filter(F.col("same") >= similarity * (F.size("ha") + F.size("hb") - F.col("same")) - 1e-9).select("a", "b")


#: Counters of the sketch of rarity.
COUNTERS = 1 << 18


def _rarity(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each counter are, for sets with the column held."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for h in b["held"]:
                np.add.at(total, h.view(np.uint64) % np.uint64(COUNTERS), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    found = sets.select("held").mapInPandas(of, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # COUNTERS rows at most
    counters = np.zeros(COUNTERS, np.int64)
    counters[found["at"]] = found["n"]
    return counters


def _prefixes(sets: DataFrame, counters: np.ndarray, similarity: float) -> DataFrame:
    """(shingle, digest, n, at): the rarest shingles of each set (digest, held), as many as two similar sets must share one of, with their places."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for digest, h in zip(b["digest"], b["held"]):
                n = len(h)
                k = n - math.ceil(similarity * n - 1e-9) + 1
                order = np.lexsort((h, counters[h.view(np.uint64) % np.uint64(COUNTERS)]))[:k]
                out.append(pd.DataFrame({"shingle": h[order], "digest": digest, "n": n, "at": np.arange(k)}))
            if out:
                yield pd.concat(out)

    return sets.filter("size(held) > 0").select("digest", "held").mapInPandas(of, "shingle bigint, digest binary, n int, at int")


def _sharing(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sets (shingle, digest, n, at, group) of different groups that share a shingle of their prefixes and can be as similar by its places."""
    x, y = left.toDF("shingle", "x", "n", "i", "g"), right.toDF("shingle", "y", "m", "j", "k")
    need = similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
    can = (F.col("g") != F.col("k")) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need)
    return x.join(y, "shingle").filter(can).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of digests of nodes (id, digest, n, fp) by SimHash. Nodes of one fingerprint pair with that of the least id, which stands for them
    in `simhash.links`; sizes that the similarity rules out are left to `links`."""
    least = materialize(nodes.groupBy("fp").agg(F.min(F.struct("id", "digest")).alias("f")).select("fp", F.col("f.id").alias("id"), F.col("f.digest").alias("low")), "near-fingerprints")
    same = nodes.select("fp", "digest").join(least, "fp").filter("digest <> low").select(F.col("low").alias("a"), F.col("digest").alias("b"))
    at = lambda side: least.select(F.col("id").alias(f"i{side}"), F.col("low").alias(side))
    far = simhash.links(least.select("id", "fp")).toDF("ia", "ib").distinct().join(at("a"), "ia").join(at("b"), "ib").select("a", "b")
    pairs = same.union(far)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET, agree: int = AGREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges (a, b) between the digests of nodes (id, digest, n, fp, sketch, keys): enough for the components of all candidates that are similar."""
    index = nodes.select("digest", "id", "n", F.explode("keys").alias("key"))
    counts = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "near-keys")
    index = materialize(index.join(counts, "key"), "near-index")
    # Sets whose sizes differ by more than the similarity allows can't be similar.
    sizes = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    size_of = lambda side, n: nodes.select(F.col("digest").alias(side), F.col("n").alias(n))
    printed = materialize(simhash_pairs(nodes).join(size_of("a", "n"), "a").join(size_of("b", "m"), "b").filter(sizes).select("a", "b"), "near-printed")
    held = index.select("digest").union(printed.select("a")).union(printed.select("b")).distinct()
    met = nodes.join(held, "digest", "left_semi")
    sketches = materialize(met.select("digest", "sketch"), "near-sketches")
    sets = _sets(docs, met.select("id"), id_col, text_col).join(met.select("id", "digest"), ["id", "digest"], "left_semi")
    sets = materialize(sets.dropDuplicates(["digest"]).select("digest", "held"), "near-sets")
    close = materialize(_near(printed, sets, similarity), "near-prints")

    few = index.filter(F.col("held") <= bucket)
    paired = few.select("key", F.col("digest").alias("a"), "n").join(few.select("key", F.col("digest").alias("b"), F.col("n").alias("m")), "key").filter((F.col("a") < F.col("b")) & sizes)
    # What SimHash told already isn't counted again.
    paired = paired.select("a", "b").distinct().join(printed, ["a", "b"], "left_anti")
    first = close.union(_near(_alike(paired, sketches, agree), sets, similarity))

    crowd = index.filter(F.col("held") > bucket).select("key", "digest", "n")
    often = crowd.groupBy("digest").agg(F.count(F.lit(1)).alias("times"))
    middle = crowd.join(often, "digest").groupBy("key").agg(F.max(F.struct("times", "digest"))["digest"].alias("mid"))
    crowd = materialize(crowd.join(middle, "key"), "near-crowds")
    star = crowd.filter("digest <> mid").select(F.col("mid").alias("a"), F.col("digest").alias("b")).distinct()
    tied = materialize(_near(star, sets, similarity), "near-stars")
    apart = crowd.filter("digest <> mid").join(tied.select(F.col("a").alias("mid"), F.col("b").alias("digest")), ["mid", "digest"], "left_anti").select("digest").distinct()
    crowded = materialize(sets.join(crowd.select("digest").distinct(), "digest", "left_semi"), "near-crowded")
    # What is tied by now is a group, whose members need not meet each other.
    first = materialize(first, "near-first")
    group = components(first.union(tied), "a", "b").select(F.col("node").alias("digest"), F.col("component").alias("group"))
    prefixes = _prefixes(crowded, _rarity(crowded), similarity).join(group, "digest", "left").select("shingle", "digest", "n", "at", F.coalesce("group", "digest").alias("group"))
    prefixes = materialize(prefixes, "near-prefixes")
    rest = _sharing(prefixes.join(apart, "digest", "left_semi").select(prefixes.columns), prefixes, similarity)
    return first.union(tied).union(_near(_alike(rest, sketches, agree), sets, similarity))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(id, component) for each row: the least id of its group."""
    found = materialize(signatures(docs, id_col, text_col), "signatures")
    nodes = materialize(found.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.min(F.struct("id", "fp"))["fp"].alias("fp"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "near-nodes")
    edges = links(docs, nodes, similarity, bucket, id_col=id_col, text_col=text_col)
    at = nodes.select("digest", "id")
    ids = edges.join(at.select(F.col("digest").alias("a"), F.col("id").alias("u")), "a").join(at.select(F.col("digest").alias("b"), F.col("id").alias("v")), "b")
    tied = components(ids.select("u", "v"), "u", "v")
    named = at.join(tied, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"))
    return found.select("id", "digest").join(named, "digest", "left").select(F.col("id").alias(id_col), "component")
