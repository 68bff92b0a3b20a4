"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader updates and scored as sparse dot products.

A text's tokens are runs of letters, of digits and of other signs. Each gives a lexical token
(lower case; a repeat of the token before it becomes a sign of its own) and a shape (kind,
case, length class). The features are single tokens, pairs of tokens, and triples of
shapes, hashed to ``2 ** bits`` weights; a feature's value is its share of the text's features.

Learning reads at most ``sample`` labelled rows, chosen by a hash of their id and text; that and the
weights are all the driver holds. Scoring reads whole texts.

Nulls and blanks: a null or blank text has no feature and scores the bias's probability. Rows
without an id or label, or whose label is not 0 or 1, are not learned from; a document
with several labels counts with each. Without any labelled row every score is 0.5. Repeated rows
get equal scores; a null ``doc_id`` hashes as the empty text and has no label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches
from .language import fold

_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*|\p{N}+|[^\p{L}\p{N}\s]+")
_PART = 1 << 16
#: A feature's value is its share of the text times this: steps of a useful size.
_SCALE = 20.0


def _token_hashes(token: str) -> tuple[int, int]:
    if token[0].isalpha():
        kind = 1 if token.islower() else 2 if token.isupper() else 3 if token.istitle() else 4
    else:
        kind = 5 if token[0].isdigit() else 6
    shape = kind * 8 + min(len(token).bit_length(), 7)
    return xxhash.xxh64_intdigest(token.lower(), 9), shape


class Features:
    """Feature numbers of texts. Token hashes are kept between texts, up to a bound."""

    def __init__(self, bits: int, keep: int = 200_000):
        self.mask, self.keep, self.known = np.uint64((1 << bits) - 1), keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        out = [self._part(tokens[max(at - 2, 0) : at + _PART], min(at, 2)) for at in range(0, len(tokens), _PART)]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _part(self, tokens: list[str], before: int) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = _token_hashes(t)
        both = np.array([known[t] for t in tokens], np.uint64)
        word, shape = both[:, 0], both[:, 1]
        again = np.concatenate([[False], word[1:] == word[:-1]])
        word = np.where(again, np.uint64(77), word)
        pair = mix(word[:-1] * np.uint64(3) + mix(word[1:]))
        triple = shape[:-2] * np.uint64(4096) + shape[1:-1] * np.uint64(64) + shape[2:]
        # what ends among the tokens carried over was counted with the part before
        made = [mix(word ^ np.uint64(1))[before:], pair[max(before - 1, 0) :], mix(triple + np.uint64(1 << 40))[max(before - 2, 0) :]]
        return (np.concatenate(made) & self.mask).astype(np.int64)


class Model:
    """Weights by follow-the-regularised-leader: each keeps the sum of its adjusted
    gradients z and of their squares n, and is zero until z exceeds ``l1``."""

    def __init__(self, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias
        self.w: np.ndarray | None = None

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, features: np.ndarray, label: int) -> None:
        at, many = np.unique(features, return_counts=True)
        x = np.append(_SCALE * many / max(len(features), 1), 1.0)
        at = np.append(at, 1 << self.bits)
        w = self._weights(at)
        g = (_sigmoid(float(w @ x)) - label) * x
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown

    def done(self) -> "Model":
        self.w = self._weights(np.arange(len(self.z))).astype(np.float32)
        self.z = self.n = None
        return self

    def score(self, features: np.ndarray) -> float:
        dot = _SCALE * float(self.w[features].mean(dtype=np.float64)) if len(features) else 0.0
        return _sigmoid(dot + float(self.w[-1]))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, bits: int = 18, passes: int = 4, seed: int = 5) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality): at most ``sample`` rows, as
    hashed features. None if no row has a label."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    total = known.count()
    if not total:
        return None
    # a share of the labels, about twice the sample, picks documents; their order cuts it to size
    share = min(1.0, 2.0 * sample / total)
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(4 * sample)

    @F.pandas_udf("array<int>")
    def hashed(text: pd.Series) -> pd.Series:
        of = Features(bits)
        with np.errstate(over="ignore"):
            return pd.Series([of(t).astype(np.int32) for t in text], dtype=object)

    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    made = rows.select(F.xxhash64("doc_id", "text").alias("h"), "quality", hashed("text").alias("f"))
    found = made.orderBy("h", "quality").limit(sample).toArrow()
    labels_of, features = found["quality"].to_numpy(), [x.values.to_numpy() for x in found["f"]]
    model, rng = Model(bits), np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(features)):
            model.update(features[i].astype(np.int64), int(labels_of[i]))
    return model.done()


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits numbers

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        m = held.value
        if m is None:
            return pd.Series(np.full(len(text), 0.5))
        of = Features(m.bits)
        with np.errstate(over="ignore"):
            return pd.Series([m.score(of(t)) for t in text], dtype=float)

    return small_batches(docs).withColumn(out, scored(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted): learn from four folds of five, score all rows.
    Rows whose fold is 0 are held out; ``predicted`` is 1 from ``threshold`` up."""
    held_out = fold("doc_id", 5) == 0
    model = train(docs.filter(~held_out), labels, **options)
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
