"""Language identification: a bidirectional gated recurrent network over bytes.

Every byte of a text gets a label distribution from a forward and a backward network of
``hidden`` gated units; the mean over the text's positions is the document's. Texts are
read in windows of ``WINDOW`` bytes, each with fresh state, so a text of any length costs
memory for a bounded part of it and nothing is left out.

The network is trained in numpy by backpropagation through time on a sample of labelled
documents, bounded by ``sample`` documents for each language and ``SPAN`` bytes of each.

Nulls and blanks: a text that is null or has no letter is ``und`` with score 0, as is every
text if nothing could be learned. Rows with a null language are not learned from. Repeated
rows and other columns change nothing; a null ``doc_id`` hashes as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches

UNKNOWN = "und"
WINDOW = 128
SPAN = 384
_BATCH = 2048
_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def fold(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _tanh_cell(x: np.ndarray, h: np.ndarray, u_gates: np.ndarray, u_new: np.ndarray):
    """One step of the gated unit; gates are written as tanh of half their argument."""
    k = h.shape[1]
    gates = h @ u_gates
    gates += x[:, : 2 * k]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    rec = h @ u_new
    new = gates[:, k:] * rec
    new += x[:, 2 * k :]
    np.tanh(new, out=new)
    z = gates[:, :k]
    out = h - new
    out *= z
    out += new
    return out, gates, rec, new


class Network:
    """``table``: input weights of each byte for (update, reset, new); ``gates``, ``new``:
    recurrent weights; index 0 reads forward, 1 backward. ``out``, ``bias``: the labels."""

    def __init__(self, labels: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.p = {"out": draw(2 * hidden, len(labels), s=0.3), "bias": np.zeros(len(labels), np.float32)}
        for d in (0, 1):
            self.p |= {
                f"table{d}": draw(256, 3 * hidden, s=0.3),
                f"gates{d}": draw(hidden, 2 * hidden, s=0.3),
                f"new{d}": draw(hidden, hidden, s=0.5),
            }

    def _states(self, codes: np.ndarray, d: int) -> np.ndarray:
        steps, rows = codes.shape
        states = np.empty((steps, rows, self.hidden), np.float32)
        h = np.zeros((rows, self.hidden), np.float32)
        table, gates, new = self.p[f"table{d}"], self.p[f"gates{d}"], self.p[f"new{d}"]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            h = _tanh_cell(table[codes[t]], h, gates, new)[0]
            states[t] = h
        return states

    def position_labels(self, codes: np.ndarray) -> np.ndarray:
        """(steps, rows) bytes -> (steps, rows, labels) probabilities."""
        k = self.hidden
        logits = self._states(codes, 0) @ self.p["out"][:k]
        logits += self._states(codes, 1) @ self.p["out"][k:]
        logits += self.p["bias"]
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Backpropagation through time of the mean cross-entropy over weighted positions."""
        k, (steps, rows) = self.hidden, codes.shape
        p, g = self.p, {name: np.zeros_like(v) for name, v in self.p.items()}
        kept, states = {}, {}
        for d in (0, 1):
            h, seen, run = np.zeros((rows, k), np.float32), [], np.empty((steps, rows, k), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                after, gates, rec, new = _tanh_cell(p[f"table{d}"][codes[t]], h, p[f"gates{d}"], p[f"new{d}"])
                seen.append((t, h, gates, rec, new))
                run[t] = h = after
            kept[d], states[d] = seen, run
        both = np.concatenate([states[0], states[1]], axis=2)
        logits = both @ p["out"] + p["bias"]
        logits = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob = logits / logits.sum(axis=2, keepdims=True)
        total = max(float(weight.sum()), 1.0)
        hit = prob[:, np.arange(rows), target]
        loss = float(-(np.log(hit + 1e-9) * weight).sum() / total)
        prob[:, np.arange(rows), target] -= 1
        delta = prob * (weight / total)[:, :, None].astype(np.float32)
        g["out"] = np.einsum("trk,trl->kl", both, delta, optimize=True)
        g["bias"] = delta.sum(axis=(0, 1))
        down = delta @ p["out"].T
        for d in (0, 1):
            back = np.zeros((rows, k), np.float32)
            for t, h, gates, rec, new in reversed(kept[d]):
                back = back + down[t, :, d * k : (d + 1) * k]
                z, r = gates[:, :k], gates[:, k:]
                pre_new = back * (1 - z) * (1 - new * new)
                pre = np.concatenate([back * (h - new) * z * (1 - z) * 2, pre_new * rec * r * (1 - r) * 2], axis=1)
                g_rec = pre_new * r
                g[f"gates{d}"] += h.T @ pre
                g[f"new{d}"] += h.T @ g_rec
                np.add.at(g[f"table{d}"], codes[t], np.concatenate([pre, pre_new], axis=1))
                back = back * z + pre @ p[f"gates{d}"].T + g_rec @ p[f"new{d}"].T
        return loss, g

    def fit(self, codes: np.ndarray, target: np.ndarray, length: np.ndarray, steps: int, rows: int, rate: float, seed: int):
        """Adam over random batches of windows (windows, bytes) with their label numbers."""
        rng = np.random.default_rng(seed)
        first = {n: np.zeros_like(v) for n, v in self.p.items()}
        second = {n: np.zeros_like(v) for n, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), rows)
            weight = (np.arange(codes.shape[1])[:, None] < length[pick][None, :]).astype(np.float32)
            _, g = self.gradients(codes[pick].T, target[pick], weight)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            now = rate * (1 - 0.9 * step / steps)
            for n, v in g.items():
                v = v * scale
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.99 * second[n] + 0.01 * v * v
                self.p[n] -= (now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean label distribution over all positions of each text (none of them empty)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        codes = np.zeros(int(windows.sum()) * WINDOW, np.uint8)
        ends = np.cumsum(windows) * WINDOW
        for end, n, t in zip(ends, windows, texts):
            codes[end - n * WINDOW : end - n * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        codes = codes.reshape(-1, WINDOW)
        filled = np.full(len(codes), WINDOW)
        filled[np.cumsum(windows) - 1] = sizes - (windows - 1) * WINDOW
        sums = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(codes), _BATCH):
            part = np.ascontiguousarray(codes[at : at + _BATCH].T)
            prob = self.position_labels(part)
            prob *= (np.arange(WINDOW)[:, None] < filled[at : at + _BATCH][None, :])[:, :, None]
            np.add.at(sums, owner[at : at + _BATCH], prob.sum(axis=0, dtype=np.float64))
        return sums / sizes[:, None]


def training_sample(docs: DataFrame, sample: int, labels: int = 256) -> DataFrame:
    """(lang, part): about ``sample`` documents of each of the ``labels`` most frequent
    languages, chosen by a hash of the row, and of each at most ``SPAN`` characters from a
    place that the hash names. The share to take comes from counts over all rows; at most
    twice ``sample`` times ``labels`` rows leave the tasks."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    share = (
        known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels)
        .select("lang", (F.lit(float(sample)) / F.col("count")).alias("share"))
    )
    h = F.xxhash64("doc_id", "text")
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - SPAN + 1, F.lit(1))).cast("int") + 1
    chosen = known.join(F.broadcast(share), "lang").withColumn("h", h)
    chosen = chosen.filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    parts = chosen.select("lang", "h", F.substring(F.col("text"), at, F.lit(SPAN)).alias("part"))
    return parts.orderBy("h").limit(2 * sample * labels).drop("h")


def train(
    docs: DataFrame, sample: int = 300, hidden: int = 8, steps: int = 450, rows: int = 96, rate: float = 0.02, seed: int = 11
) -> Network | None:
    """Learn from ``docs`` (doc_id, text, lang); the id only picks the sample. The sample (languages x ``sample`` x ``SPAN``
    characters) is all that reaches the driver. None if there is nothing to learn."""
    found = sorted((r.lang, r.part) for r in training_sample(docs, sample).collect())
    labels = sorted({lang for lang, _ in found})
    if not labels:
        return None
    pieces, target = [], []
    for lang, part in found:
        raw = part.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), WINDOW):
            pieces.append(raw[at : at + WINDOW])
            target.append(labels.index(lang))
    length = np.array([len(x) for x in pieces])
    codes = np.zeros((len(pieces), WINDOW), np.uint8)
    for i, x in enumerate(pieces):
        codes[i, : len(x)] = np.frombuffer(x, np.uint8)
    target = np.array(target)
    # the same number of windows of every language
    rng = np.random.default_rng(seed)
    most = np.bincount(target).max()
    even = np.concatenate([rng.choice(np.flatnonzero(target == k), most) for k in range(len(labels))])
    return Network(labels, hidden, seed).fit(codes[even], target[even], length[even], steps, rows, rate, seed)


def predict(docs: DataFrame, network: Network | None, text: str = "text", chars: int = 1 << 20) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the pooled probability of that language."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf(_RESULT)
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = model.value
        for texts in parts:
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            some = [
                i for i, t in enumerate(texts) if net is not None and t is not None and any(map(str.isalpha, t))
            ]
            raw = [texts.iloc[i].encode("utf-8", "surrogatepass") for i in some]
            begin, size = 0, 0
            for end, x in enumerate(raw, 1):  # about ``chars`` bytes at a time
                size += len(x)
                if size >= chars or end == len(raw):
                    pooled = net.pooled(raw[begin:end])
                    best = pooled.argmax(axis=1)
                    names[some[begin:end]] = np.array(net.labels, object)[best]
                    scores[some[begin:end]] = np.minimum(pooled[np.arange(len(best)), best], 1.0)
                    begin, size = end, 0
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return small_batches(docs).withColumn("__label", label(F.col(text))).select(
        *[c for c in docs.columns if c not in ("lang_pred", "score")], "__label.lang_pred", "__label.score"
    )


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from three folds of four, label all rows.
    Rows whose fold is 2 are held out."""
    held_out = fold("doc_id", 4) == 2
    network = train(docs.filter(~held_out).select("doc_id", "text", "lang"), **options)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), network).drop("text")
