"""Toxicity by a support vector machine over a subsequence string kernel, with Nystroem landmarks.

The kernel compares words by their common character triples, in order but not next to each other: a triple that spans n places weighs
decay ** n. Gaps, inserted characters and characters standing for letters so cost little. Landmark words span the Nystroem features;
labelled sentences train a linear machine on them: a sentence labelled toxic is a bag with some words at least that are, a clean one
has none. The machine picks each toxic bag's witnesses and the clean words that come nearest, and trains again. As the machine is linear,
landmarks and weights fold into one weight for each triple, and a word costs no more than its own triples; machines of several draws of
landmarks are averaged, at no cost.

One such word also comes up by chance in a long clean text, so a text is scored as a sequence: by how large a share of its words
has margins over each of several cuts, by its highest margins, and by the highest of two words with up to two others between them, a gap
that decays. A logistic fit on the labelled sentences makes these a score from 0 to 1. What only the meeting of two harmless words shows is
not learned: their margins are those of harmless words.

Null texts count as empty; texts without words get the score of the lowest margins. Words of more than 40 characters are compared in
overlapping stretches, very long texts are read whole. Rows are independent: repeated rows get equal results. Without labels of
both kinds every text gets score 0. Labels whose document is missing, or that are null, teach nothing. A kept column named score or
predicted gives way to the operator's own. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, mapped, table
from tidemark.llm.samples import sample, words_of

SPAN, DECAY, SIZE = 8, 0.7, 29
#: Letters are 1 to 26, those other than a to z by a hash that they share; the word's edges are 27 and 28, all else 0: a place that
#: matches nothing.
_CODES = np.array([1 + c * 2654435761 % 2**32 * 26 // 2**32 if c > 127 and chr(c).isalpha() else 0 for c in range(0x33480)], np.int32)
_CODES[97:123] = np.arange(1, 27)
#: Characters written in place of letters.
LOOKALIKES = str.maketrans("0134578@$!|", "oieastbasil")
_SPELLED = re.compile(r"(?<!\S)\w(?:[ .*_-]\w){2,}(?!\S)")
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_LONG = 40

def plain(word: str) -> str:
    """A word in lower case, without marks on letters and without other characters around it; look-alikes inside become letters."""
    word = word.lower()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    if not word.isalpha():
        word = word.strip("\"'.,;:?!()[]{}<>*#%&$~^`|/\\-_+=")
        if any(c.isalpha() for c in word):
            word = word.translate(LOOKALIKES)
    return word

def _coded(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Words by length, as codes between edges, with their places. Longer ones go in overlapping stretches."""
    by: dict[int, list] = {}
    for i, w in enumerate(words):
        if len(w) <= _LONG:
            by.setdefault(len(w), []).append((i, w))
        else:
            for a in range(0, len(w) - _LONG // 2, _LONG // 2):
                part = w[a : a + _LONG]
                by.setdefault(len(part), []).append((i, part))
    out = {}
    for n, xs in by.items():
        raw = np.frombuffer("".join(w for _, w in xs).encode("utf-32-le", "replace"), "<u4").reshape(len(xs), n)
        codes = np.full((len(xs), n + 2), 27, np.int32)
        codes[:, 1:-1] = _CODES[np.where(raw < len(_CODES), raw, 0)]
        codes[:, -1] = 28
        out[n] = np.array([i for i, _ in xs]), codes
    return out

def _norm(n: int) -> float:
    """The weight of a word with n places if each triple occurs once."""
    return float(np.sqrt(sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in _OFFSETS))) or 1.0

def kernel_sums(words: list[str], weights: np.ndarray) -> np.ndarray:
    """For each word, the sum of its triples' weights times decay ** span, over its norm: weights is (SIZE ** 3,) or (SIZE ** 3, m)."""
    out = np.full((len(words), *weights.shape[1:]), -np.inf)
    for n, (at, codes) in _coded(words).items():
        total = np.zeros((len(at), *weights.shape[1:]))
        for a, b in _OFFSETS:
            if n + 2 > b:
                key = (codes[:, : n + 2 - b] * SIZE + codes[:, a : n + 2 - b + a]) * SIZE + codes[:, b:]
                total += DECAY ** (b + 1) * weights[key].sum(1)
        np.maximum.at(out, at, total / _norm(n + 2))
    return out

def triples(word: str) -> np.ndarray:
    """A word's place in the kernel's feature space."""
    out = np.zeros(SIZE**3)
    c = [27, *(int(_CODES[ord(x)]) if ord(x) < len(_CODES) else 0 for x in word), 28]
    for i in range(len(c)):
        for a, b in _OFFSETS:
            if i + b < len(c) and c[i] and c[i + a] and c[i + b]:
                out[(c[i] * SIZE + c[i + a]) * SIZE + c[i + b]] += DECAY ** (b + 1)
    return out / _norm(len(c))

#: Margins over which the words of a text are counted.
CUTS = (-0.2, 0.2, 0.6, 1.0, 1.4)
#: What a gap of a word costs a pair.
GAP = 0.8


class Model:
    """weight: of each triple; a word's margin is its kernel sum plus bias. centre, spread, factors: of the logistic fit over a text's
    features, the last factor is constant."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias
        n = len(CUTS) + 3
        self.centre, self.spread, self.factors = np.zeros(n), np.ones(n), np.zeros(n + 1)

    def margins(self, texts: list[str]) -> list[np.ndarray]:
        """The margins of each text's words, in order, with spelled-out words at the end."""
        words, at, begins = words_of(texts)
        forms = [plain(w) for w in words]
        more = [[plain(m[0].translate(_GLUE)) for m in _SPELLED.finditer(t)] for t in texts]
        new = sorted({w for own in more for w in own})
        place = {w: len(words) + i for i, w in enumerate(new)}
        sums = (np.maximum(kernel_sums(forms + new, self.weight), -1.0) + self.bias) if forms or new else np.zeros(0)
        return [np.r_[sums[at[begins[i] : begins[i + 1]]], [sums[place[w]] for w in own]] for i, own in enumerate(more)]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(m) for m in self.margins(texts)]).reshape(len(texts), len(CUTS) + 3)
        return 1 / (1 + np.exp(-np.clip((x - self.centre) / self.spread @ self.factors[:-1] + self.factors[-1], -30, 30)))


def features(margins: np.ndarray) -> list[float]:
    """What a text is scored by, from the margins of its words in order."""
    n = len(margins)
    rates = [float(np.log(((margins > c).sum() + 0.3) / (n + 20))) for c in CUTS]
    if not n:
        return [*rates, -1.0, -1.0, -1.0]
    top = np.sort(margins)[-3:]
    two = max([float((margins[:-g] + margins[g:]).max()) * GAP ** (g - 1) for g in (1, 2, 3) if n > g], default=float(top[-1]) - 1)
    return [*rates, float(top[-1]), float(top.mean()), two]


_GLUE = str.maketrans("", "", " .*_-")

def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, target: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss below each row's target margin, by Newton steps over the rows that still have a loss."""
    x = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return penalty * w @ w + (weight * np.maximum(0, target - y * (x @ w)) ** 2).sum()

    for _ in range(30):
        on = y * (x @ w) < target
        xs = x[on] * weight[on, None]
        step = np.linalg.solve(ridge + xs.T @ x[on], xs.T @ (y * target)[on]) - w
        now, size = loss(w), 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if now - loss(w) < 1e-9:
            break
    return w[:-1], float(w[-1])


def _copies(texts: list[str], y: np.ndarray) -> np.ndarray:
    """The places of texts without later near copies of the same label: those with two of six least hashes of 3-word shingles in
    common."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        w = t.split()
        h = np.array([zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))], np.uint32)
        least = [int((h * np.uint32(m)).min()) for m in (1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
        keys = {(int(y[i]), a, b, least[a], least[b]) for a, b in combinations(range(6), 2)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return np.array(out)


def _telling(toxic: dict, clean: dict, n1: int, n0: int) -> tuple[dict, dict, list]:
    """Of the words of toxic texts: how far their toxic texts exceed those that their clean ones lead to expect, in standard deviations;
    their odds; and those beyond doubt, in order."""
    share = n1 / n0
    excess = {w: (n - share * clean.get(w, 0)) / np.sqrt(share * clean.get(w, 0) + 0.5) for w, n in toxic.items()}
    odds = {w: np.log((n + 0.1) / (share * (clean.get(w, 0) + 0.5))) for w, n in toxic.items()}
    sure = sorted((w for w in toxic if excess[w] >= 3 and odds[w] >= 2.5 and toxic[w] >= (3 if n1 >= 20 else 1)), key=lambda w: (-excess[w], w))
    return excess, odds, sure


def _machine(bags: list, y: np.ndarray, toxic: Counter, clean: Counter, excess: dict, odds: dict, sure: list, landmarks: int, rounds: int, words: int, negatives: int, step: int, rng) -> tuple[np.ndarray, float] | None:
    """Weight and bias of a machine over words."""
    short = lambda ws: [w for w in ws if len(w) <= _LONG]  # longer words are compared in stretches, and are no landmarks
    telling, certain = short(sure)[: landmarks // 2], set(sure)

    common = short(w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])))[: 20 * landmarks]
    marks = telling + [common[i] for i in rng.permutation(len(common))[: landmarks - len(telling)] if common[i] not in set(telling)]
    pool = sorted(set(clean) - set(sure))
    pool = [pool[i] for i in rng.permutation(len(pool))[:words]]
    own = [[w for w in b if w in odds] if v else [] for b, v in zip(bags, y, strict=True)]
    score, floor, hard = {w: excess[w] for w in sure}, 0.0, set()
    for r in range(rounds):
        phi = np.stack([triples(w).astype(np.float32) for w in marks], 1)  # triples x landmarks
        values, vectors = np.linalg.eigh((phi.T @ phi).astype(np.float64))
        good = values > 1e-3 * values.max()
        half = vectors[:, good] / np.sqrt(values[good])  # K^(-1/2) of the Nystroem map
        to = phi @ half.astype(np.float32)
        witness = Counter(sure)
        for b in own:  # a bag without any telling word: a wrong label, or nothing to learn
            witness.update(w for w in b if score.get(w, -9.0) > floor)
        pos = sorted(witness)
        neg = sorted((set(pool[:negatives]) | hard) - set(pos))
        if not neg:
            return None
        x = kernel_sums(pos + neg, to)
        weight = np.array([1.0 + toxic[w] for w in pos] + [1.0 + np.sqrt(clean[w]) * (w in hard) for w in neg])
        weight[: len(pos)] *= 0.5 * weight[len(pos) :].sum() / weight[: len(pos)].sum()
        target = np.array([1 + min(1.0, max(0.0, excess[w] / 6 - 1)) for w in pos] + [1.0] * len(neg))  # beyond doubt: twice the margin
        w, b = _svm(x, np.r_[np.ones(len(pos)), -np.ones(len(neg))], weight, target)
        fold_in = phi.astype(np.float64) @ (half @ w)
        known = sorted(odds) + pool
        margin = dict(zip(known, (kernel_sums(known, fold_in) + b).tolist(), strict=True))
        near = sorted((x for x in pool if x not in witness), key=lambda x: (-margin[x], x))[:step]
        hard |= set(near)
        # the clean words that come nearest are landmarks of the next round
        marks = telling + list(dict.fromkeys([x for x in short(near) if x not in marks][: landmarks // 4] + [x for x in marks if x not in telling]))[: landmarks - len(telling)] if r < rounds - 1 else marks
        # a word that is no sure one is a witness only where the machine is certain of it
        score, floor = {w: margin[w] + (w in certain) for w in odds}, 0.5
    return fold_in, float(b)


def fitted(rows: list[tuple[str, int]], landmarks: int = 256, rounds: int = 2, words: int = 40_000, negatives: int = 3000, step: int = 300, draws: int = 3, seed: int = 3) -> Model | None:
    """A model from (text, toxic) rows, the average of `draws` machines. Each knows `words` clean words, dealt at random; it trains on
    `negatives` of them, and on the `step` nearest of all in each round, as a solver with an active set does."""
    rows = sorted({(t or "", int(y)) for t, y in rows if y is not None})  # copies teach once
    y = np.array([v for _, v in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    once = _copies([t for t, _ in rows], y)
    texts, y = [rows[i][0] for i in once], y[once]
    del rows
    if y.min() == y.max():
        return None
    held: dict[str, str] = {}  # one string for each word, however many texts have it
    bags = []
    for t in texts:
        own = {held.setdefault(p, p) for w in t.split() if (p := plain(w))}
        bags.append(sorted(own | {held.setdefault(p, p) for m in _SPELLED.finditer(t) if (p := plain(m[0].translate(_GLUE)))}))
    del held
    toxic, clean = (Counter(w for b, v in zip(bags, y, strict=True) if v == c for w in b) for c in (1, 0))
    excess, odds, sure = _telling(toxic, clean, int(y.sum()), int((1 - y).sum()))
    if not sure:
        sure = sorted(toxic, key=lambda w: (-excess[w], w))[:8]
    machines = [_machine(bags, y, toxic, clean, excess, odds, sure, landmarks, rounds, words, negatives, step, np.random.default_rng([seed, k])) for k in range(draws)]
    machines = [m for m in machines if m]
    if not machines:
        return None
    model = Model(np.mean([w for w, _ in machines], 0), float(np.mean([b for _, b in machines])))
    _logistic(model, np.array([features(m) for i in range(0, len(texts), 200) for m in model.margins(texts[i : i + 200])]), y)
    return model


def _logistic(model: Model, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> None:
    """The likeliest logistic weights of standardised features, by Newton steps, with a small penalty on all but the constant."""
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - model.centre) / model.spread, np.ones(len(x))]
    ridge = penalty * len(y) * np.r_[np.ones(x.shape[1]), 1e-6]

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.logaddexp(0, np.where(y > 0, -m, m)).sum() + 0.5 * (ridge * w * w).sum())

    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        now, size = loss(w), 1.0
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        if now - loss(w) < 1e-9:
            break
    model.factors = w


def scored(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The kept columns, score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = held.value

        def score(texts: list) -> list[pa.Array]:
            s = np.zeros(len(texts)) if model is None else model.scores([t or "" for t in texts])
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

        return score

    return mapped(docs, text, keep, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), work)


def model_of(docs: DataFrame, labels: DataFrame, bound: int = 4000, most: int = 128 << 20) -> Model | None:
    """A model fitted on at most `bound` labelled documents, and about `most` bytes of text: docs has doc_id and text, labels doc_id and
    toxic."""
    taken = sample(labels.filter("toxic is not null and doc_id is not null").select("doc_id", "toxic"), "doc_id", bound, seed=1)
    marks = docs.sparkSession.createDataFrame([(int(r["doc_id"]), int(r["toxic"])) for r in taken], "doc_id long, toxic int")
    rows = sample(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marks), "doc_id"), "doc_id", bound, seed=2, text="text", most=most)
    return fitted([(r["text"], r["toxic"]) for r in rows])

def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(fold(F.col("doc_id"), 4) != 2)
    return scored(docs, model_of(docs.filter("not held_out"), labels), keep=("doc_id", "held_out"))
