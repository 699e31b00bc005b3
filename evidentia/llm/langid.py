"""Language identification by nearest centroids of TF-IDF character n-grams.

A text is a vector of hashed character bigrams and trigrams (letters in lower case, everything else a gap), log term frequency times
inverse document frequency, of length one. Document frequencies are counted over all training documents. Each language has several
centroids, clustered on a sample of at most `per_lang` training documents of that language (a documented bound of the fit; the sample is
the ids of least hash). A text gets the language of the centroid with the largest cosine. It is rejected when that cosine lies
below the centroid's own limit: `slack` times the `tail` quantile of its members' cosines, by the number of letters (short texts
lie farther out, so each length class has its own limit).

Null texts and texts without a letter are `und` with score 0 and are rejected. Without training rows everything is `und`. Rows keep
their number; repeated rows get equal answers; only the text enters a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches

DIMS, PER_LANG, CENTROIDS, ROUNDS = 4096, 1500, 3, 8
SLACK, TAIL = 0.6, 0.01
LENGTHS = (40, 200, 1000)
_CHUNK = 300_000


def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)])


def _bins(codes: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigram and trigram of each place, and which places count (those that begin with a letter or end with one)."""
    c = np.where(gap, 0, codes).astype(np.uint32)
    two = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA77))
    three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (c[2:] * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x165667B1)
    fold = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64)
    return fold(two), fold(three)


def counts(texts: list, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(counts of n-grams, numbers of letters) of texts in order, some texts at a time."""
    held, chars = [], 0
    for k, t in enumerate(texts):
        t = t.lower() if isinstance(t, str) else ""
        held.append(t)
        chars += len(t)
        if chars >= _CHUNK or len(held) >= 200 or k == len(texts) - 1:
            joined = ("  " + "  ".join(held) + "  ").encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(joined, np.uint32)
            low = codes < 0x10000
            is_letter = np.where(low, letters[np.where(low, codes, 0)], False)
            if not low.all():
                high = np.unique(codes[~low])
                is_letter[~low] = np.isin(codes[~low], [x for x in high if chr(x).isalpha()])
            doc = np.repeat(np.arange(len(held)), [len(t) + 2 for t in held])
            doc = np.concatenate([doc, [len(held) - 1] * (len(codes) - len(doc))])
            n = np.bincount(doc[is_letter], minlength=len(held))
            two, three = _bins(codes, ~is_letter)
            some2 = is_letter[:-1] | is_letter[1:]
            some3 = is_letter[1:-1]
            m = np.bincount(doc[:-1][some2] * DIMS + two[some2], minlength=len(held) * DIMS)
            m += np.bincount(doc[1:-1][some3] * DIMS + three[some3], minlength=len(held) * DIMS)
            yield m.reshape(len(held), DIMS), n
            held, chars = [], 0


def vectors(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(m).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Centroids with their languages and, by length class, the cosine below which a text is rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    limits: np.ndarray


def _cluster(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from the mean and the texts farthest from what is chosen; no randomness."""
    c = v.mean(0, keepdims=True)
    while len(c) < min(k, len(v)):
        c = np.vstack([c, v[(v @ c.T).max(1).argmin()]])
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = (v @ c.T).argmax(1)
        c = np.vstack([v[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, centroids: int = CENTROIDS,
        slack: float = SLACK, tail: float = TAIL) -> Model:
    """A model of labelled rows; rows with a null label count for nothing."""
    rows = small_batches(docs).filter(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, total, n = _letters(), np.zeros(DIMS), 0
        for b in batches:
            for m, some in counts(b["text"].tolist(), letters):
                total += (m > 0).sum(0)
                n += int((some > 0).sum())
        yield pd.DataFrame({"at": np.arange(DIMS + 1), "n": np.concatenate([total, [n]]).astype(np.int64)})

    df = np.zeros(DIMS + 1)
    for r in rows.select("text").mapInPandas(document_frequency, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        df[r["at"]] = r["n"]
    idf = (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)

    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # One row for each language, less than the model that every task gets anyway; without the hint all texts would be shuffled by language.
    likely = rows.withColumn("draw", draw).join(F.broadcast(sizes), "lang").filter(F.col("draw") < F.lit(float(1 << 30)) * 1.5 * per_lang / F.col("size"))
    order = Window.partitionBy("lang").orderBy("draw", "id", "text")
    sample = likely.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= per_lang).select("lang", "text")

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        letters = _letters()
        parts = list(counts(group["text"].tolist(), letters))
        n = np.concatenate([x[1] for x in parts])
        v = np.vstack([vectors(m, idf) for m, _ in parts])
        v, n = v[n > 0], n[n > 0]
        if not len(v):
            return pd.DataFrame({"lang": [], "centroid": [], "limits": []})
        c = _cluster(v, centroids, ROUNDS)
        best = (v @ c.T).max(1)
        limits = [slack * float(np.quantile(best[lies], tail)) if (lies := np.searchsorted(LENGTHS, n, side="right") == k).sum() >= 20 else -1.0 for k in range(len(LENGTHS) + 1)]
        known = [x for x in limits if x >= 0]
        limits = [x if x >= 0 else (min(known) / 2 if known else 0.0) for x in limits]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [x.tolist() for x in c], "limits": [limits] * len(c)})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, limits array<double>").collect()  # a few centroids for each language
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    return Model(idf, np.array([r["centroid"] for r in found], np.float32).reshape(-1, DIMS), [r["lang"] for r in found], np.array([r["limits"] for r in found]).reshape(-1, len(LENGTHS) + 1))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with lang_pred, score (the cosine, 0 to 1) and rejected, one row for each row of docs."""
    from pyspark.sql import types as T

    shown = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*[T.StructField(f"k_{i}", f.dataType) for i, f in enumerate(shown)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = [f.name for f in shown]
    at_text = f"k_{names.index(text_col)}" if text_col in names else "_text"
    sent = small_batches(docs).select(*[F.col(f.name).alias(f"k_{i}") for i, f in enumerate(shown)], *([] if text_col in names else [F.col(text_col).alias("_text")]))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, langs = _letters(), np.array([*model.langs, "und"], object)
        for b in batches:
            best, score, rejected = [], [], []
            for m, n in counts(b[at_text].tolist(), letters):
                none = (n == 0) | (len(model.langs) == 0)
                cos = vectors(m, model.idf) @ model.centroids.T if len(model.langs) else np.zeros((len(m), 1))
                at = cos.argmax(1)
                top = np.clip(cos[np.arange(len(at)), at], 0, 1)
                limit = model.limits[at, np.searchsorted(LENGTHS, n, side="right")] if len(model.langs) else 0
                best.append(np.where(none, len(model.langs), at)), score.append(np.where(none, 0.0, top)), rejected.append(none | (top < limit))
            out = b.drop(columns="_text", errors="ignore")
            if len(b):
                out = out.assign(lang_pred=langs[np.concatenate(best)], score=np.concatenate(score).astype(float), rejected=np.concatenate(rejected))
                yield out

    return sent.mapInPandas(of, schema).select(*[F.col(f"k_{i}").alias(f.name) for i, f in enumerate(shown)], "lang_pred", "score", "rejected")


def held_out(id_col: Column) -> Column:
    """The test fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
