"""The latent space of decontamination: fitted on all passages; hashing of words."""

import random

import numpy as np
from evidentia.llm import decontaminate


def test_latent_space_is_fitted_on_all_passages(spark):
    # Few words, so the space has fewer dimensions than are kept, and the places of all passages in it are orthonormal by dimension: of a sample they would not be.
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{chr(97 + k)}" for k in range(20)], k=40)) for _ in range(6000)]
    items = [" ".join(rng.choices([f"i{chr(97 + k)}" for k in range(20)], k=40)) for _ in range(5000)]
    docs, bench = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in items], "text string")
    idf = decontaminate.inverse_frequencies(docs)
    space = decontaminate.latent_space(docs, bench, idf)
    rows = np.concatenate(list(decontaminate.passages(texts + items)))
    assert len(rows) == 11000
    counts = np.zeros((len(rows), decontaminate.BINS + 1), np.float32)
    np.add.at(counts, (np.arange(len(rows))[:, None], rows), 1)
    a = counts[:, np.unique(rows)[:-1]] * idf[np.unique(rows)[:-1]]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    sigma = np.linalg.svd(a.astype(np.float64), compute_uv=False)
    kept = int((sigma > 1e-2 * sigma[0]).sum())
    assert 30 < kept < decontaminate.RANK
    places = space[rows].sum(1)[:, :kept] / np.linalg.norm(counts * idf, axis=1, keepdims=True)
    assert np.abs(places.T @ places - np.eye(kept)).max() < 1e-2


def test_words_are_hashed_as_they_are_split():
    rng = random.Random(4)
    for n in (0, 1, 40, 3000, 1_200_000):
        raw = bytes(rng.choices(b" .,aAbB\n\xc3\xa9-", k=n)) + b" " + b"x" * n + b" y."
        bins, starts, ends = decontaminate.hashed(raw)
        words = raw.split()
        assert [raw[i:j] for i, j in zip(starts, ends)] == words
        plain = [w.lower().strip(decontaminate._EDGE) for w in words]
        of = {}
        assert all(of.setdefault(w, b) == b and (b == decontaminate.BINS) == (w == b"") for w, b in zip(plain, bins.tolist()))
