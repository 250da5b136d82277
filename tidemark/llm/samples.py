"""Bounded samples of labelled rows, for fitting classifiers; and batches of texts as distinct words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(df: DataFrame, key: str, bound: int, seed: int = 0, text: str | None = None, most: int = 0) -> list:
    """At most `bound` rows of df, and about `most` bytes of the column `text`, if it is named, dealt by a hash of the key so that every
    part of the table has its share."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(text)) if text else F.lit(0)).first()
    share = min(bound / max(1, n), most / max(1, size or 0) if text else 1.0)
    if share < 1:
        df = df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * share))
    return df.limit(bound).collect()


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct white-space chunks of a batch, the place of each occurrence among them, and where each text's begin."""
    place: dict[str, int] = {}
    split = [t.split() for t in texts]
    for s in split:
        for w in s:
            if w not in place:
                place[w] = len(place)
    sizes = np.array([len(s) for s in split], np.int64)
    at = np.fromiter((i for s in split for i in map(place.__getitem__, s)), np.int64, int(sizes.sum()))
    return list(place), at, np.r_[0, np.cumsum(sizes)]
