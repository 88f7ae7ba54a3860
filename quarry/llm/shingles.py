"""Word-run sets of texts, as 64-bit hashes, and steps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.llm.common import freeze, lean, select_texts

_P1, _P2, _29 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
_CHARS = 4 << 20  # of texts that one step of a task holds


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word runs."""
    import xxhash

    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ (h >> _29)) * _P1 + w[i : len(w) - size + 1 + i]
    h = (h ^ (h >> _29)) * _P2
    return np.unique(h ^ (h >> _29))


def text_steps(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in steps of about ``_CHARS`` characters of ``text``."""
    size = b["text"].str.len().fillna(0).to_numpy(np.int64)
    step = (np.cumsum(size) - size) // _CHARS
    for at in np.split(np.arange(len(b)), np.flatnonzero(np.diff(step)) + 1):
        yield b.iloc[at]


def full_sets(docs: DataFrame, reps: DataFrame, words: int, name: str) -> DataFrame:
    """node, n, set: sets of the texts that ``reps`` (node, doc_id, th) name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for b in text_steps(whole):
                sets = [shingles(t, words) for t in b["text"]]
                yield pd.DataFrame({"node": b["node"].to_numpy(), "n": [len(s) for s in sets], "set": [s.tobytes() for s in sets]})

    texts = select_texts(docs, reps.select("node", "doc_id", "th"))
    return freeze(texts.mapInPandas(lean(run), "node long, n long, set binary"), name)
