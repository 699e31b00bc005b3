"""A quality classifier: a factorisation machine over hashed words, statistics of the text's structure and metadata.

A document is a sparse vector: one feature for each distinct word (A-Z lowered, hashed to WORD_DIMS places, log count, the block of length one) and one
for each of STATISTICS (its bin among BINS quantile bins of the fit; numbers of words and lines and lengths are the metadata). The score is
sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs are summed in linear time by
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is learned from at most `most` labelled rows (a documented bound: the ids of least hash), by Adam on the logistic loss with weight
decay, in one task. Only text enters a score.

Null, empty and wordless texts have statistics and no words, and get a score. Rows keep their number; repeated rows get equal scores. Without
labelled rows of both classes the score is the share of label 1 (0.5 without any). Null labels and labels of absent documents count for
nothing; a document with several labels is learned from each. Extra columns don't matter.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WORD_DIMS, BINS, FACTORS = 1 << 15, 24, 8
MOST, EPOCHS, BATCH, RATE, DECAY, SEED = 4_000, 8, 64, 0.02, 2e-4, 13
#: Classes of characters, as bits.
LETTER, CAPITAL, DIGIT, SYMBOL, WHITE = 1, 2, 4, 8, 16
STATISTICS = (
    "words", "letters", "capitals", "digits", "symbols", "white", "commas", "bangs", "bars", "word_length", "long_words", "short_words", "words_with_symbol", "capital_words",
    "lines", "line_length", "repeated_lines", "repeated_sentences", "repeated_words", "top_word", "same_as_last",
)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class bits of each code point up to U+FFFF."""
    kind = [unicodedata.category(chr(c)) for c in range(0x10000)]
    bits = np.array([LETTER * (k[0] == "L") | CAPITAL * (k == "Lu") | DIGIT * (k[0] == "N") | SYMBOL * (k[0] in "PSC") for k in kind], np.uint8)
    bits[[9, 10, 11, 12, 13, 32]] = WHITE
    bits[[ord(c) for c in ".,;:!?'\"()-"]] = 0
    return bits


def _by_char(texts: list[str]) -> np.ndarray:
    """The first fourteen of STATISTICS but the words' own counts: from the characters of all texts at once."""
    codes = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = np.where(codes < 0x10000, _classes()[np.minimum(codes, 0xFFFF)], LETTER).astype(np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    chars = np.maximum(ends - starts - 1, 1)
    per = lambda hit, at=starts: np.add.reduceat(hit, at, dtype=np.int64)
    white = (bits & WHITE) > 0
    white_n = per(white) - 1  # one space was put behind each text
    of_char = [per((bits & k) > 0) / chars for k in (LETTER, CAPITAL, DIGIT, SYMBOL)] + [white_n / chars] + [per(codes == ord(c)) / chars for c in ",!|"]
    # Words: runs of what isn't white; each ends before its text does.
    turn = np.flatnonzero(np.diff(white, prepend=True))
    first, last = turn[::2], turn[1::2]
    cuts = np.searchsorted(first, np.concatenate([starts, ends[-1:]]))
    n = np.diff(cuts)
    size = last - first
    sum_of = lambda k: (c := np.concatenate([[0], np.cumsum((bits & k) > 0)]))[last] - c[first]
    symbols, capitals, letters = sum_of(SYMBOL), sum_of(CAPITAL), sum_of(LETTER)
    total = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[cuts])
    share = [total(h) / np.maximum(n, 1) for h in (size, size > 14, size < 3, symbols > 0, (capitals == letters) & (letters > 1))]
    return np.stack([np.log1p(n), *of_char, *share], 1)


def _by_word(text: bytes, words: list[bytes], counts: Counter) -> tuple[float, ...]:
    """The rest of STATISTICS, from a text in lower case."""
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x] or [b""]
    sentences = [x for x in map(bytes.strip, text.split(b".")) if x] or [b""]
    w = max(len(words), 1)
    return np.log1p(len(lines)), np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines), 1 - len(set(sentences)) / len(sentences), 1 - len(counts) / w, max(counts.values(), default=0) / w, sum(map(eq, words, islice(words, 1, None))) / w


def sparse(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows' ends among the words, places of words, their values, statistics) of texts."""
    if not texts:
        return np.zeros(1, int), np.zeros(0, int), np.zeros(0), np.zeros((0, len(STATISTICS)))
    texts = [t if isinstance(t, str) else "" for t in texts]
    ends, at, values, stats = [0], [], [], []
    for t in texts:
        low = t.encode("utf-8", "surrogatepass").lower()
        words = low.split()
        counts = Counter(words)
        v = np.log1p(np.fromiter(counts.values(), float, len(counts)))
        at.append(np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORD_DIMS)
        values.append(v / max(np.sqrt((v * v).sum()), 1e-9))
        stats.append(_by_word(low, words, counts))
        ends.append(ends[-1] + len(counts))
    return np.array(ends), np.concatenate(at), np.concatenate(values), np.hstack([_by_char(texts), np.array(stats)])


@dataclass
class Machine:
    """The model: bias, linear weights, factors; limits of the bins of each statistic."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    limits: np.ndarray

    def features(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, places, values): words and one bin for each statistic, a list for each row."""
        return _rows(*sparse(texts), self.limits)

    def score(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.features(texts))[0], -30, 30)))

    def margin(self, ends: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of rows and the sums of factors that they were made of."""
        start = ends[:-1]
        x = values[:, None] * self.factors[at]
        sums = np.add.reduceat(x, start, 0)
        return self.bias + np.add.reduceat(values * self.linear[at], start) + 0.5 * (sums * sums - np.add.reduceat(x * x, start, 0)).sum(1), sums


def _rows(ends: np.ndarray, at: np.ndarray, values: np.ndarray, stats: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = stats.shape
    bins = np.stack([np.searchsorted(limits[j], stats[:, j], side="left") for j in range(k)], 1)
    place = WORD_DIMS + np.arange(k) * BINS + bins
    row = np.repeat(np.arange(n), np.diff(ends))
    order = np.argsort(np.concatenate([row, np.repeat(np.arange(n), k)]), kind="stable")
    return ends + k * np.arange(n + 1), np.concatenate([at, place.ravel()])[order], np.concatenate([values, np.full(n * k, 1 / np.sqrt(k))])[order]


def train(texts: list, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Machine:
    """A machine for texts and their labels 0 or 1; the same for the same rows in the same order."""
    dims = WORD_DIMS + BINS * len(STATISTICS)
    share = float(labels.mean()) if len(labels) else 0.5
    rng = np.random.RandomState(SEED)
    ends, at, values, stats = sparse(texts)
    limits = np.stack([np.quantile(stats[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) if len(texts) else np.zeros(BINS - 1) for j in range(len(STATISTICS))])
    m = Machine(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if len(labels) else 0.0, np.zeros(dims), rng.normal(0, 0.01, (dims, FACTORS)), limits)
    if not 0 < share < 1 or len(labels) < 2:
        m.factors[:] = 0
        return m
    ends, at, values = _rows(ends, at, values, stats, limits)
    first, second = np.zeros((dims, FACTORS + 1)), np.zeros((dims, FACTORS + 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            sizes = ends[rows + 1] - ends[rows]
            part = np.concatenate([[0], np.cumsum(sizes)])
            pick = np.repeat(ends[rows] - part[:-1], sizes) + np.arange(part[-1])
            i, x, of = at[pick], values[pick], np.repeat(np.arange(len(rows)), sizes)
            margin, sums = m.margin(part, i, x)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            gx = g[of] * x
            each = np.empty((len(i), FACTORS + 1))
            each[:, 0] = gx
            each[:, 1:] = gx[:, None] * (sums[of] - x[:, None] * m.factors[i])
            sort = np.argsort(i, kind="stable")
            start = np.flatnonzero(np.diff(i[sort], prepend=-1))
            u = i[sort][start]
            grad = np.add.reduceat(each[sort], start, 0)
            grad[:, 0] += decay * m.linear[u]
            grad[:, 1:] += decay * m.factors[u]
            step += 1
            first[u] = 0.9 * first[u] + 0.1 * grad
            second[u] = 0.999 * second[u] + 0.001 * grad * grad
            move = rate * (first[u] / (1 - 0.9**step)) / (np.sqrt(second[u] / (1 - 0.999**step)) + 1e-8)
            m.linear[u] -= move[:, 0]
            m.factors[u] -= move[:, 1:]
            m.bias -= rate * float(g.sum())
    return m


def held_out(id_col: Column) -> Column:
    """The test fold: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", most: int = MOST) -> Machine:
    """The machine of at most `most` labelled rows; which rows may be learned from is the caller's choice (labels without the test fold)."""
    rows = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    # Some more rows than wanted by hash, then the least hashes: the sort is over a bounded number of rows.
    rows = rows.withColumn("draw", draw).filter(F.col("draw") < F.lit((1 << 30) * 1.5 * most / max(n, 1))).orderBy("draw", "id", "label").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id").select("draw", "id", "label", "text")

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "id", "label", "text"], na_position="first")
        m = train(group["text"].tolist(), group["label"].to_numpy(float))
        return pd.DataFrame({"bias": [m.bias], "linear": [m.linear.astype(np.float32)], "factors": [m.factors.astype(np.float32).ravel()], "limits": [m.limits.ravel()]})

    found = texts.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(of, "bias double, linear array<float>, factors array<float>, limits array<double>").collect()  # one model
    if not found:
        return train([], np.zeros(0))
    r = found[0]
    return Machine(r["bias"], np.array(r["linear"]), np.array(r["factors"]).reshape(-1, FACTORS), np.array(r["limits"]).reshape(len(STATISTICS), -1))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row."""
    sent = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.concatenate([machine.score(b["text"].iloc[k : k + 100].tolist()) for k in range(0, len(b), 100)])
                yield pd.DataFrame({"id": b["id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return sent.mapInPandas(of, f"id {sent.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
