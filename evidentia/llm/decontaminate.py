"""Benchmark decontamination by latent semantic retrieval.

Words (A-Z lowered, punctuation at the ends dropped) are hashed into bins. Passages are runs of 48 words. Inverse passage frequencies are counted
over all documents. A randomised SVD of the TF-IDF passages of all documents and all benchmark items, computed by partitions as sums of A'A times a thin
matrix, gives the latent space; it is fitted once.
Retrieval covers every document in full: passages of lengths that follow the items' lengths slide over each
text and are folded into the latent space; pairs of passage and item with a cosine of cos_min or more are candidates.
Each candidate is verified on the words: the longest common subsequence of item and passage surroundings has to cover lcs_min of the item, and
answer_min of the item's answer words have to be there (the words of an answer column, or else the item's rarest words).

The items are an index in blocks of BLOCK_ITEMS that a task goes through for each stretch of text, so its arrays don't grow with the benchmark; one pass over the documents
probes up to pass_items of them (about a kilobyte each in a task), and only beyond that there is another pass. Items of equal text and answer are one item, named
by the least id. Documents are not shuffled, so an item leaked into very many documents costs nothing more. Null or empty texts match
nothing; items without words are skipped; rows repeated give repeated results; rows with a null id are searched like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize, small_batches

BINS, RANK, PASSAGE, STEP = 16384, 64, 48, 8
BLOCK_ITEMS, PASS_ITEMS = 1024, 65_536
COS_MIN, LCS_MIN, ANSWER_MIN, ANSWER_WORDS = 0.38, 0.6, 0.5, 6
_EDGE = b".,;:!?\"'()[]{}*#%$&-_/\\"
#: Bytes of text that are worked on at once; a longer text is hashed in pieces of that size.
CHUNK = 250_000
#: Sums of all tasks are added in so many parts, by so many tasks or as many as the session runs at once.
PARTS, SUM_TASKS = 64, 64

_WHITES = [c.encode() for c in WHITE]
_SPACE = np.isin(np.arange(256), list(WHITE.encode()))
_CORE = ~_SPACE & ~np.isin(np.arange(256), list(_EDGE))
#: Bytes in lower case as numbers from 1; the hash of a word is the sum of them times powers of an odd number, modulo 2**64.
_LOW = (np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)) + 1).astype(np.uint64)
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _powers(odd: int, n: int) -> np.ndarray:
    """Not kept: a cached function or its arrays would have to go to the workers."""
    out = np.full(n, odd, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin, the start and the end of each word; words that are punctuation alone go to the bin of no weight."""
    a = np.frombuffer(raw, np.uint8)
    up, down = _powers(_ODD, len(a) + 1), _powers(pow(_ODD, -1, 1 << 64), len(a) + 1)
    border = np.diff(np.concatenate([[True], _SPACE[a], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(border == -1), np.flatnonzero(border == 1)
    core = _CORE[a]
    at, upto = np.append(np.flatnonzero(core), 0), np.append(0, np.cumsum(core))
    none = upto[starts] == upto[ends]
    first, last = at[upto[starts]], at[upto[ends] - 1] + 1
    sums = np.append(np.uint64(0), np.cumsum(_LOW[a] * up[: len(a)], dtype=np.uint64))
    h = (sums[last] - sums[first]) * down[first]
    bins = (((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(50)).astype(np.int64)
    bins[none] = BINS
    return bins, starts, ends


def _hashed_word(word: bytes) -> int:
    """The bin of one very long word, by blocks."""
    plain, h, up = word.lower().strip(_EDGE), 0, _powers(_ODD, CHUNK)
    for i in range(0, len(plain), CHUNK):
        block = np.frombuffer(plain[i : i + CHUNK], np.uint8)
        h += int((_LOW[block] * up[: len(block)]).sum(dtype=np.uint64)) * pow(_ODD, i, 1 << 64)
    h %= 1 << 64
    return (((h ^ (h >> 32)) * int(_MIX)) % (1 << 64)) >> 50 if plain else BINS


def hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _hashed, a long text by pieces that end between words, so that the arrays over its bytes stay small."""
    found, done = [], 0
    while len(raw) - done > 2 * CHUNK:
        cut = max(raw.rfind(c, done, done + CHUNK) for c in _WHITES) + 1
        if cut:
            found.append((done, _hashed(raw[done:cut])))
        else:
            cut = min((at for c in _WHITES if (at := raw.find(c, done + CHUNK)) >= 0), default=len(raw))
            found.append((done, (np.array([_hashed_word(raw[done:cut])]), np.array([0]), np.array([cut - done]))))
        done = cut
    found.append((done, _hashed(raw[done:])))
    return tuple(np.concatenate([x[k] + (at if k else 0) for at, x in found]) for k in range(3))


def split(text) -> list[bytes]:
    return _bytes(text).split()


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _chunks(texts) -> Iterator[tuple]:
    """(texts' places, raw, bins, starts, ends, place of each text's first word and of the end) of about CHUNK bytes of texts at a time."""

    def of() -> tuple:
        raw = b" ".join(held)
        bins, starts, ends = hashed(raw)
        borders = np.cumsum([0, *[len(x) + 1 for x in held]])
        return places, raw, bins, starts, ends, np.searchsorted(starts, borders)

    places, held, n = [], [], 0
    for i, t in enumerate(texts):
        b = _bytes(t)
        if not b:
            continue
        if held and n + len(b) > CHUNK:
            yield of()
            places, held, n = [], [], 0
        places.append(i)
        held.append(b)
        n += len(b)
    if held:
        yield of()


def _laid_out(bins: np.ndarray, words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The bins of texts, whose words begin at `words`, from the places `at` on; the bin of no weight between them."""
    out = np.full(size, BINS)
    out[np.arange(len(bins)) + np.repeat(at - words[:-1], np.diff(words))] = bins
    return out


def passages(texts) -> Iterator[np.ndarray]:
    """Arrays of passages, each a row of PASSAGE bins (filled up with the bin of no weight)."""
    for _, _, bins, _, _, words in _chunks(texts):
        if len(bins):
            filled = np.append(0, np.cumsum(-(-np.diff(words) // PASSAGE))) * PASSAGE
            yield _laid_out(bins, words, filled[:-1], filled[-1]).reshape(-1, PASSAGE)


def _summed(texts: DataFrame, of: Callable[[Iterator[np.ndarray]], np.ndarray], shape: tuple, kind: str) -> np.ndarray:
    """The sum over all tasks of what `of` makes of their passages, an array of that shape and kind. The tasks are few, so the sums of one part fit in one task."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = of(p for b in batches for p in passages(b["text"]))
        yield pd.DataFrame({"part": np.arange(PARTS), "sums": [x.astype(kind).tobytes() for x in np.array_split(sums, PARTS)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for x in group["sums"]:
            total = total + np.frombuffer(x, kind)
        return pd.DataFrame({"part": group["part"].iloc[:1], "sums": [total.tobytes()]})

    tasks = max(SUM_TASKS, texts.sparkSession.sparkContext.defaultParallelism)
    rows = texts.select("text").coalesce(tasks).mapInPandas(task, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").collect()  # PARTS rows
    parts = [np.frombuffer(r["sums"], kind) for r in sorted(rows, key=lambda r: r["part"])]
    return (np.concatenate(parts) if parts else np.zeros(shape, kind)).reshape(shape)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Of the bins, over the passages of all documents; the bin of no weight gets 0."""

    def of(found: Iterator[np.ndarray]) -> np.ndarray:
        df, n = np.zeros(BINS + 1, np.int64), 0
        for p in found:
            p = np.sort(p.astype(np.uint16), axis=1)
            new = np.concatenate([np.ones((len(p), 1), bool), p[:, 1:] != p[:, :-1]], axis=1)
            df += np.bincount(p[new], minlength=BINS + 1)
            n += len(p)
        df[BINS] = n
        return df

    out = _summed(docs, of, (BINS + 1,), "int64")
    idf = np.log((1 + out[BINS]) / (1 + out)) + 0.05
    idf[BINS] = 0
    return idf.astype(np.float32)


def _rows_times(p: np.ndarray, idf: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF rows of passages times a thin matrix (the bin of no weight its last row), before they are brought to length one, and their lengths."""
    s = np.sort(p.astype(np.uint16), axis=1)
    first = np.flatnonzero(np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1))
    weight = np.diff(np.append(first, s.size)) * idf[s.ravel()[first]]
    length = np.sqrt(np.bincount(first // PASSAGE, weight * weight, minlength=len(s)))
    return np.matmul(idf[p][:, None, :], thin[p])[:, 0], np.maximum(length, 1e-9).astype(np.float32)[:, None]


def _times_gram(texts: DataFrame, idf: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """A'A thin, A being the TF-IDF matrix of the texts' passages with rows of length one."""
    thin = np.vstack([thin, np.zeros((1, thin.shape[1]))]).astype(np.float32)

    def of(found: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros(thin.shape)
        for p in found:
            y, length = _rows_times(p, idf, thin)
            y /= length * length
            flat = p.ravel().astype(np.uint16)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            runs = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            total[flat[runs]] += np.add.reduceat(y[order // PASSAGE], runs, axis=0)
        return total * idf[:, None]

    return _summed(texts, of, thin.shape, "float32")[:BINS].astype(np.float64)


def _gram_within(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """basis' A'A basis, A as above."""
    thin = np.vstack([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)

    def of(found: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((thin.shape[1], thin.shape[1]))
        for p in found:
            y, length = _rows_times(p, idf, thin)
            y /= length
            total += y.T @ y
        return total

    return _summed(texts, of, (thin.shape[1], thin.shape[1]), "float64")


def latent_space(docs: DataFrame, items: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(BINS + 1) x rank: what each word adds to the latent place of its passage, TF-IDF weight included (folding in: V / sigma). Fitted on the passages of all
    documents and items (text)."""
    texts = docs.select("text").union(items.select("text"))
    thin = np.linalg.qr(np.random.default_rng(7).standard_normal((BINS, rank + 8)))[0].astype(np.float32)
    basis = np.linalg.qr(_times_gram(texts, idf, thin))[0]
    val, vec = np.linalg.eigh(_gram_within(texts, idf, basis))
    top = np.argsort(-val)[:rank]
    v = basis @ vec[:, top] / np.sqrt(np.maximum(val[top], max(val[top].max(), 1e-9) * 1e-6))
    return np.vstack([v * idf[:BINS, None], np.zeros((1, len(top)))]).astype(np.float32)


def lcs(words: list[bytes], masks: dict[bytes, int], size: int) -> int:
    """Length of the longest common subsequence with the item whose word places are in masks."""
    v = full = (1 << size) - 1
    for w in words:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _plain(words: list[bytes]) -> list[bytes]:
    return [p for w in words if (p := w.lower().strip(_EDGE))]


class Item:
    """A benchmark item as a task needs it; what only candidates need is made when one comes up."""

    __slots__ = ("id", "words", "bins", "answer", "answer_bins", "_masks")

    def __init__(self, item_id, text, answer, idf: np.ndarray):
        self.id, raw = item_id, split(text)
        self.words, self._masks = _plain(raw), None
        self.bins = hashed(_bytes(text))[0]
        weight = {w: float(idf[b]) for w, b in zip(self.words, self.bins[self.bins < BINS].tolist())}
        self.answer = set(_plain(split(answer))) or set(sorted(weight, key=lambda w: (-weight[w], w))[:ANSWER_WORDS])
        self.answer_bins = hashed(b" ".join(sorted(self.answer)))[0].tolist()

    @property
    def size(self) -> int:
        return len(self.words)

    @property
    def masks(self) -> dict[bytes, int]:
        """The places of each word as bits."""
        if self._masks is None:
            self._masks = {}
            for i, w in enumerate(self.words):
                self._masks[w] = self._masks.get(w, 0) | 1 << i
        return self._masks


class Block:
    """BLOCK_ITEMS items with their places in the latent space, by classes of length."""

    def __init__(self, items: list[Item], space: np.ndarray, answer_min: float):
        self.items = items
        places = np.stack([space[i.bins].sum(0) for i in items])
        self.places = places / np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-9)
        self.classes: dict[int, list[int]] = {}
        for k, i in enumerate(items):
            self.classes.setdefault(int(np.log2(max(i.size, STEP))), []).append(k)
        self.needed = np.array([answer_min * len(set(i.answer_bins)) - 1e-9 for i in items])

    def answers(self) -> np.ndarray:
        """Which bins hold answer words of which item."""
        held = np.zeros((len(self.items), BINS + 1), bool)
        for k, i in enumerate(self.items):
            held[k, i.answer_bins] = True
        return held


def search(docs: DataFrame, items: list[Item], space: np.ndarray, cos_min: float, lcs_min: float, answer_min: float, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, item_id, cosine, lcs, answer, start) of documents (id, text) against the items of one pass."""
    rank = space.shape[1]
    index = [Block(items[i : i + block_items], space, answer_min) for i in range(0, len(items), block_items)]
    shapes = {c: max(1, round(1.5 * 2**c / STEP)) for block in index for c in block.classes}
    gap = max(shapes.values())

    def found(texts) -> Iterator[tuple]:
        """(place of the text, id of the item, cosine, lcs, answer, start) for the best passage of each pair."""

        def look(chunk: tuple) -> Iterator[tuple]:
            words = chunk[5]
            starts = gap + np.append(0, np.cumsum(-(-np.diff(words) // STEP) + gap))
            flat = _laid_out(chunk[2], words, starts[:-1] * STEP, starts[-1] * STEP)
            pieces = space[flat].reshape(-1, STEP, rank).sum(1)
            starts = starts[:-1]
            windows: dict[int, tuple] = {}
            for c, k in shapes.items():
                stride = max(1, k // 3)
                where = np.arange(gap - k + 1, len(pieces) - k + 1, stride)
                sums = sum(pieces[where + j] for j in range(k))
                windows[c] = k, stride * STEP + 2**c // 2, where, sums, np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
            for block in index:
                yield from probe(block, chunk, flat, starts, windows)

        def probe(block: Block, chunk: tuple, flat: np.ndarray, starts: np.ndarray, windows: dict[int, tuple]) -> Iterator[tuple]:
            best: dict[tuple[int, int], tuple] = {}
            places, raw, _, begins, ends, texts_words = chunk
            answers = kept[0][1] if kept and kept[0][0] is block else block.answers()
            kept[:] = [(block, answers)]
            for c, members in block.classes.items():
                k, around, where, sums, norm = windows[c]  # around is at most gap * STEP, so surroundings end in filling
                cos = (sums @ block.places[members].T) / norm
                ws, ms = np.nonzero(cos >= cos_min)
                for cut in range(0, len(ws), 5_000):
                    w, m = ws[cut : cut + 5_000], np.array(members)[ms[cut : cut + 5_000]]
                    near = where[w][:, None] * STEP + np.arange(-around, k * STEP + around)
                    there = answers[m[:, None], flat[np.clip(near, 0, len(flat) - 1)]].sum(1) >= block.needed[m]  # no fewer words than distinct ones
                    for j in np.nonzero(there)[0]:
                        item = block.items[m[j]]
                        o = max(int(np.searchsorted(starts, where[w[j]] + k - 1, side="right")) - 1, 0)  # filling parts documents by a window
                        first = (int(where[w[j]]) - int(starts[o])) * STEP
                        low, high = texts_words[o] + max(0, first - around), min(texts_words[o + 1], texts_words[o] + max(0, first + k * STEP + around))
                        words = _plain(raw[begins[low] : ends[high - 1]].split()) if low < high else []
                        share = lcs(words, item.masks, item.size) / item.size
                        answer = len(item.answer & set(words)) / len(item.answer)
                        key = (places[o], int(m[j]))
                        if share >= lcs_min and answer >= answer_min and (key not in best or best[key][1] < share):
                            best[key] = (float(cos[w[j], members.index(m[j])]), share, answer, max(first, 0))
            for (i, m), v in best.items():
                yield (i, block.items[m].id, *v)

        kept: list[tuple] = []
        for chunk in _chunks(texts):
            if len(chunk[2]):
                yield from look(chunk)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].tolist()
            rows = [(ids[i], *rest) for i, *rest in found(b["text"])]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "item_id", "cosine", "lcs", "answer", "start"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInPandas(of, f"id {kind}, item_id bigint, cosine double, lcs double, answer double, start bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None,
                 cos_min: float = COS_MIN, lcs_min: float = LCS_MIN, answer_min: float = ANSWER_MIN, pass_items: int = PASS_ITEMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, item_id, cosine, lcs, answer, start): one row for each document and item that it holds."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer"))
    bench = bench.filter(F.col("text").isNotNull()).groupBy("text", "answer").agg(F.min("item").alias("item")).withColumn("draw", F.xxhash64("text", "answer"))
    bench = materialize(bench, "benchmark")
    passes = -(-bench.count() // pass_items)
    idf, space, out = inverse_frequencies(rows) if passes else None, None, None
    for part in range(passes):
        mine = bench.filter(F.pmod("draw", F.lit(passes)) == part).orderBy("item", "text").collect()  # about pass_items rows, all different
        items = [i for r in mine if (i := Item(r["item"], r["text"], r["answer"], idf)).size]
        if not items:
            continue
        if space is None:
            space = latent_space(rows, bench, idf)
        found = search(rows, items, space, cos_min, lcs_min, answer_min, block_items)
        out = found if out is None else out.union(found)
    if out is None:
        out = rows.filter("false").select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "bigint"), ("cosine", "double"), ("lcs", "double"), ("answer", "double"), ("start", "bigint"))])
    return out.withColumnRenamed("id", id_col)
