"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits by majority vote over the XXH64 (seed 42) hashes of the 3-word shingles of a text, A-Z lowered.
Documents of one fingerprint are one node (its least id), so copies never form pairs. Two nodes are linked at max_bits or
fewer differing bits. Index: bits that vary together are grouped into the same partition (correlations over all
fingerprints); a dynamic program gives each partition its own threshold, -1 (unused) upward, with the sum that the pigeonhole principle asks
for (max_bits - partitions + 1), so that probes plus expected candidates are least; expected candidates come from the
measured key collisions of every partition. Nodes meet where a partition key lies within the partition's threshold, and the whole fingerprint is verified.

A key shared by more than `bucket` nodes is not paired: each node near it instead names all fingerprints one bit away
from its own, and nodes that name the same one (they differ in two bits at most) are tied to the least among them. That costs 65
rows a node and gives the same components for links of up to two bits, which is why max_bits is 0 or 2.

Null or wordless texts have fingerprint zero and link like any other. Rows repeated under one id agree. Rows with a null
id get a component only from others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .components import components

MAX_BITS, SHINGLE, BUCKET = 2, 3, 512
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BITS_OF_BYTE for i in range(8)])
    return int(np.packbits(2 * ones > len(raw)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": [fingerprint(t if isinstance(t, str) else None, shingle) for t in b["text"]]})

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(of, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the 64 x 64 matrix of how many have both bits set."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(bits), both + bits.T @ bits
        yield pd.DataFrame({"i": np.arange(65), "row": [list(r) for r in both] + [[float(n)] * 64]})

    sums = nodes.select("fp").mapInPandas(of, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = np.zeros((65, 64))
    for r in sums.collect():  # 65 x 64 numbers whatever the input
        found[r["i"], r["j"]] = r["v"]
    return int(found[64, 0]), found[:64]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of even size, each grown by the bit most correlated with what it holds."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, groups = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (round(corr[b, free].sum() - corr[b, b], 9), -b))]
        free.remove(group[0])
        while len(group) < size:
            nxt = max(free, key=lambda b: (round(corr[b, group].mean(), 9), -b))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def allocate(pairs: list[list[float]], probes: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """The thresholds t_i >= -1 with sum max_bits - parts + 1 of the least cost; row i of both tables is for t = -1, 0, 1..."""
    parts = len(pairs)
    best = {0: (0.0, [])}
    for i in range(parts):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, max_bits + 1):
                u = used + t + 1
                c = cost + pairs[i][t + 1] + probes[i][t + 1]
                if u <= max_bits + 1 and (u not in nxt or c < nxt[u][0]):
                    nxt[u] = (c, [*ts, t])
        best = nxt
    return best[max_bits + 1]


def _key(bits: list[int]):
    """The bits of a fingerprint, packed into one integer."""
    return sum((F.shiftright("fp", b).bitwiseAND(F.lit(1).cast("long")) * (1 << i) for i, b in enumerate(bits)), F.lit(0).cast("long"))


def plan(nodes: DataFrame, max_bits: int = MAX_BITS, choices=(2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """The partitions of the bits and their thresholds, of the least expected cost."""
    n, both = _moments(nodes)
    groups = {m: group_bits(n, both, m) for m in choices}
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _key(g).alias("key")) for m in choices for i, g in enumerate(groups[m])])
    met = nodes.select(F.inline(keys)).groupBy("m", "i", "key").count().groupBy("m", "i").agg(F.sum(F.expr("double(count) * (count - 1) / 2")).alias("pairs"))
    same = {(r["m"], r["i"]): r["pairs"] for r in met.collect()}  # one row for each partition
    p = np.diag(both) / max(n, 1)
    found = []
    for m in choices:
        pairs, probes = [], []
        for i, g in enumerate(groups[m]):
            dist = np.array([1.0] + [0.0] * max_bits)  # of the distance of two fingerprints on these bits
            for b in g:
                d = 2 * p[b] * (1 - p[b])
                dist = dist * (1 - d) + np.concatenate([[0.0], dist[:-1] * d])
            within = np.cumsum(dist) / max(dist[0], 1e-30)
            ball = np.cumsum([float(_choose(len(g), j)) for j in range(max_bits + 1)])
            pairs.append([0.0, *(same.get((m, i), 0.0) * within)])
            probes.append([0.0, *(n * ball)])
        cost, ts = allocate(pairs, probes, max_bits)
        found.append((cost, groups[m], ts))
    _, bits, ts = min(found, key=lambda x: x[0])
    return bits, ts


def _choose(n: int, k: int) -> int:
    return 1 if k == 0 else n * _choose(n - 1, k - 1) // k


def _variants(width: int, t: int) -> list[int]:
    """Masks of at most t of the low width bits."""
    out = [0]
    for _ in range(t):
        out = sorted({x ^ (1 << i) for x in out for i in range(width)} | set(out))
    return out


def links(nodes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between nodes (id, fp): enough for the components of all links of at most max_bits bits."""
    if max_bits not in (0, 2):
        raise ValueError("max_bits has to be 0 or 2")
    bits, ts = plan(nodes, max_bits)
    used = [(i, g, t) for i, (g, t) in enumerate(zip(bits, ts, strict=True)) if t >= 0]
    rows = nodes.select("id", "fp")
    index = rows.select("id", "fp", F.inline(F.array(*[F.struct(F.lit(i).alias("part"), _key(g).alias("key")) for i, g, _ in used])))
    index = materialize(index, "simhash-index")
    turn = F.create_map(*[x for i, g, t in used for x in (F.lit(i), F.array(*[F.lit(v).cast("long") for v in _variants(len(g), t)]))])
    near = index.select("id", "fp", "part", F.explode(turn[F.col("part")]).alias("v"), "key").select("id", "fp", "part", F.col("key").bitwiseXOR(F.col("v")).alias("key"))
    counts = index.groupBy("part", "key").count().filter("count > 1 or part in ({})".format(",".join(str(i) for i, _, t in used if t > 0) or "-1"))
    small = counts.filter(F.col("count") <= bucket).select("part", "key")
    held = index.join(small, ["part", "key"]).select("part", "key", F.col("id").alias("a"), F.col("fp").alias("fa"))
    asks = near.join(small, ["part", "key"]).select("part", "key", F.col("id").alias("b"), F.col("fp").alias("fb"))
    close = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits
    paired = held.join(asks, ["part", "key"]).filter((F.col("a") != F.col("b")) & close).select("a", "b")
    large = counts.filter(F.col("count") > bucket).select("part", "key")
    crowd = near.join(large, ["part", "key"]).select("id", "fp").distinct()
    around = [0] if max_bits == 0 else _variants(64, 1)
    flip = F.array(*[F.lit(v if v < 1 << 63 else v - (1 << 64)).cast("long") for v in around])
    named = crowd.select("id", F.explode(F.transform(flip, lambda v: F.col("fp").bitwiseXOR(v))).alias("z"))
    star = named.groupBy("z").agg(F.min("id").alias("low"))
    tied = named.join(star, "z").filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    return paired.union(tied)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component) for each row."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    found = components(links(nodes.filter("id is not null"), max_bits, bucket), "a", "b")
    named = nodes.join(found, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "id").alias("component"))
    return fps.join(named, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), "fp", "component")
