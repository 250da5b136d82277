"""Language identification: averaged hashed subword embeddings and a linear softmax, fitted by stochastic gradient descent in numpy.

A text is the average of the embeddings of all 2- to 4-byte grams of its words. A temperature makes the probabilities fit a part of
the sample that was not trained on; there, too, the threshold is found under which a prediction is rejected.

Texts that are null or have no letter are `und` with score 0 and are rejected. Rows with a null language are predicted, never learned
from. With no labelled rows every text is `und`. Very long texts are read whole, in scripts of any kind. Rows are independent: repeated
rows get equal results. A kept column named lang_pred, score or rejected gives way to the operator's own. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, mapped, table
from tidemark.llm.samples import sample, words_of

LETTER = re.compile(r"[^\W\d_]")
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed grams of each lower-cased word between < and >, one after another, and where each word's begin."""
    raw = [b"<%b>" % w.lower().encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(words)), size)
    out, owner = [], []
    h = flat * np.uint32(2654435761)
    for n in GRAMS:
        h = (h[:-1] if n > 1 else h) * np.uint32(31) + flat[n - 1 :] * np.uint32(40503)
        ok = word[: len(h)] == word[n - 1 :]
        out.append(((h ^ h >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(17))[ok])
        owner.append(word[: len(h)][ok])
    ids, owner = np.concatenate(out), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return ids[by].astype(np.int64) % BUCKETS, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


class Model:
    """score: each gram's contribution to each language; threshold: probabilities below it are rejected."""

    def __init__(self, langs: list[str], score: np.ndarray, bias: np.ndarray, heat: float, threshold: float):
        self.langs, self.score, self.bias, self.heat, self.threshold = langs, score, bias, heat, threshold

    def probabilities(self, texts: list[str]) -> np.ndarray:
        words, at, begins = words_of(texts)
        if not words:
            return np.full((len(texts), len(self.langs)), 1 / max(1, len(self.langs)))
        ids, ends = grams(words)
        sums = np.add.reduceat(self.score[ids], ends[:-1], axis=0).astype(np.float64)
        n = np.diff(ends).astype(np.float64)
        text = np.repeat(np.arange(len(texts)), np.diff(begins))
        total = np.stack([np.bincount(text, weights=sums[at, c], minlength=len(texts)) for c in range(sums.shape[1])], 1)
        mean = total / np.maximum(1, np.bincount(text, weights=n[at], minlength=len(texts)))[:, None]
        return _softmax((mean + self.bias) * self.heat)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fitted(rows: list[tuple[str, str]], dim: int = 16, epochs: int = 8, rate: float = 0.4, snippets: int = 4, keep: float = 0.9995, seed: int = 5) -> Model | None:
    """A model from (text, lang) rows. Besides each whole text, `snippets` stretches of 2 to 40 words are learned from. A fifth of the
    rows is held back for temperature and threshold; `keep` is the share of them, if rightly predicted, that must not be rejected."""
    rows = [(t, g) for t, g in rows if t and g and LETTER.search(t)]
    langs = sorted({g for _, g in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    back = [zlib.crc32(t.encode()) % 5 == 0 for t, _ in rows]
    bags, labels = [], []
    for (t, g), b in zip(rows, back, strict=True):
        if not b:
            w = t.split()
            parts = [w] + [w[a : a + int(rng.integers(2, 41))] for a in rng.integers(0, len(w), snippets)]
            for p in parts:
                ids, count = np.unique(grams(p)[0], return_counts=True)  # of a long text, each gram once, with its share
                bags.append((ids.astype(np.int32), (count / count.sum()).astype(np.float32)))
            labels += [langs.index(g)] * len(parts)
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    labels = np.array(labels, np.int64)
    for epoch in range(epochs if len(labels) else 0):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(labels)), -(-len(labels) // 64)):
            ids, part = (np.concatenate([bags[i][k] for i in at]) for k in (0, 1))
            size = np.array([len(bags[i][0]) for i in at])
            own = np.repeat(np.arange(len(at)), size)
            mean = np.add.reduceat(embed[ids] * part[:, None], np.cumsum(size) - size, axis=0)
            slope = _softmax(mean @ out + bias)
            slope[np.arange(len(at)), labels[at]] -= 1
            slope = (slope / len(at)).astype(np.float32)
            back_to = (slope @ out.T).astype(np.float32)
            out -= step * 4 * mean.T @ slope
            bias -= step * slope.sum(0)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(ids[by]) != 0])
            embed[ids[by][first]] -= np.add.reduceat((step * 200 * back_to)[own[by]] * part[by, None], first, axis=0)
    model = Model(langs, embed @ out, bias.astype(np.float64), 1.0, 0.0)
    held = [r for r, b in zip(rows, back, strict=True) if b] or rows
    p = np.concatenate([model.probabilities([t for t, _ in held[i : i + 200]]) for i in range(0, len(held), 200)])
    truth = np.array([langs.index(g) for _, g in held])
    logits = np.log(np.maximum(p, 1e-30))
    heats = [0.1, 0.2, 0.35, 0.5, 0.75, 1, 1.5, 2, 3, 5]
    loss = [-np.log(np.maximum(_softmax(logits * h)[np.arange(len(truth)), truth], 1e-12)).mean() for h in heats]
    model.heat = heats[int(np.argmin(loss))]
    p = _softmax(logits * model.heat)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    if len(right):
        model.threshold = float(min(right[int((1 - keep) * len(right))], 0.5))
    return model


def identified(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score and rejected (boolean)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = held.value

        def predict(texts: list) -> list[pa.Array]:
            texts = [t or "" for t in texts]
            und = np.array([model is None or not LETTER.search(t) for t in texts], bool)
            if model is None:
                langs, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), und
            else:
                p = model.probabilities(texts)
                langs = ["und" if u else model.langs[b] for u, b in zip(und, p.argmax(1).tolist(), strict=True)]
                score = np.where(und, 0.0, p.max(1))
                rejected = und | (score < model.threshold)
            return [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]

        return predict

    return mapped(docs, text, keep, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]), work)


def model_of(docs: DataFrame, bound: int = 3000, most: int = 96 << 20) -> Model | None:
    """A model fitted on at most `bound` rows (doc_id, text, lang) with text and lang, and about `most` bytes of text."""
    rows = docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    return fitted([(r["text"], r["lang"]) for r in sample(rows, "doc_id", bound, text="text", most=most)])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    return identified(docs, model_of(docs.filter("not held_out")), keep=("doc_id", "held_out"))
