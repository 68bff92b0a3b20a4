"""Repeated passages by a sparse suffix array over words.

A window of ``w`` neighbouring ``k``-word grams keeps its least gram (a minimiser), so which
suffixes are retained depends on the words alone: two copies of a passage of ``length``
words retain a suffix at the same place among their first ``w`` words. With ``ahead`` =
length - w + 1 words after it, that place lies wholly inside the passage.

1. Retained suffixes are sorted over the cluster by their first ``ahead`` words (as one
   64-bit hash, then by place, so that no value is too frequent for one task) and each is
   compared with its neighbours. A suffix that agrees with none goes.
2. Matches are extended left and right. A suffix owns the windows of ``length`` words whose
   minimiser it is; together they are its extent. Suffixes with equal extents are one
   class: they agree in all their windows. Where the suffixes with one head are all of one
   class, nothing else can agree with them. Elsewhere, at the ends of passages, one member
   for each class is compared window by window, by two 64-bit hashes.
3. Windows that occur in another document are repeats. Overlapping ones make one span.

All passages of ``length`` words or more that stand in two documents are found, to the word.

Nulls and blanks: a null or blank text, or one of fewer than ``length`` words, has no span.
Words are runs of anything but ASCII white space. Rows are told apart by a row name made of
``doc_id`` and the text's hash: repeated rows (equal id and text) count once and get the same
spans. A null ``doc_id`` stays null and sorts first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..session import cut
from .common import mix, small_batches

_NO_ID = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)


class Words:
    """Hashes of a text's words, and of any run of them in constant time."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = raw.split()
        n, h = len(self.words), xxhash.xxh64_intdigest
        self.hashes = np.fromiter(map(h, self.words), np.uint64, n)
        self.raw = raw
        self._kept: dict = {}

    def _sums(self, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Sums of hash * base ** i over the words before each, and base ** -i."""
        if base not in self._kept:
            n = len(self.hashes)
            power, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
            power[1:], back[1:] = base, np.uint64(pow(int(base), -1, 1 << 64))
            power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
            self._kept[base] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * power[:n], dtype=np.uint64)]), back
        return self._kept[base]

    def spans(self, begin: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
        """Hash of the words [begin, end) for each pair (polynomial, mod 2^64)."""
        sums, back = self._sums(base)
        return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))

    def runs(self, length: int, base: np.uint64 = _BASE) -> np.ndarray:
        """Hash of the ``length`` words from each word on."""
        begin = np.arange(max(len(self.hashes) - length + 1, 0))
        return self.spans(begin, begin + length, base)

    def minimisers(self, k: int, w: int) -> np.ndarray:
        """For each window of ``w`` grams of ``k`` words, the place of its least gram (the
        first of equal ones)."""
        grams = self.runs(k)
        if len(grams) < w:
            return np.empty(0, np.int64)
        return np.lib.stride_tricks.sliding_window_view(grams, w).argmin(axis=1) + np.arange(len(grams) - w + 1)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where each word starts and ends."""
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        codes = np.frombuffer(self.raw, np.uint8)
        black = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
        start = np.flatnonzero(black & ~np.concatenate([[False], black[:-1]]))
        return start, start + size


def _named(docs: DataFrame) -> DataFrame:
    """``doc``: the id, with the least long for null; ``row``: a name of the id and text."""
    return small_batches(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")


def _suffixes(docs: DataFrame, length: int, k: int, w: int) -> DataFrame:
    """(doc, row, lo, n, head, ext): retained suffixes with the first of the windows each owns,
    how many they are, and the hashes of its first words and of its extent."""
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    kind = StructType([StructField("lo", ints), StructField("n", ints), StructField("head", longs), StructField("ext", longs)])
    ahead = length - w + 1

    @F.pandas_udf(kind)
    def retained(text: pd.Series) -> pd.DataFrame:
        rows = []
        with np.errstate(over="ignore"):
            for t in text:
                words = Words(t)
                owner = words.minimisers(k, w)[: max(len(words.hashes) - length + 1, 0)]
                lo = np.flatnonzero(np.diff(owner, prepend=-1))
                n = np.diff(lo, append=len(owner))
                place = owner[lo]
                head = words.spans(place, place + ahead).view(np.int64)
                ext = words.spans(lo, lo + n + length - 1).view(np.int64)
                rows.append((lo.astype(np.int32), n.astype(np.int32), head, ext))
        return pd.DataFrame(rows, columns=["lo", "n", "head", "ext"])

    return (
        _named(docs)
        .withColumn("s", retained("text"))
        .select("doc", "row", F.explode(F.arrays_zip("s.lo", "s.n", "s.head", "s.ext")).alias("s"))
        .select("doc", "row", "s.lo", "s.n", "s.head", "s.ext")
    )


def shared_suffixes(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose head some other suffix has too, from one sort of all of them.
    Neighbours may stand in two tasks: the first and last row of each task are compared
    once more (two rows for each task)."""
    keys = ["head", "row", "lo"]
    columns = suffixes.columns
    suffixes = cut(suffixes)  # range bounds take a pass of their own
    ordered = suffixes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, before, opens = None, None, True  # the last row so far waits for its successor
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            head = frame["head"].to_numpy()
            same = head[1:] == head[:-1]
            like = np.concatenate([[before == head[0] if before is not None else False], same])
            like[:-1] |= same
            edge = np.zeros(len(head), bool)
            edge[0] = opens
            out = frame.assign(like=like, edge=edge).iloc[:-1]
            yield out[out["like"] | out["edge"]]
            held, before, opens = frame.iloc[-1:], (head[-2] if len(head) > 1 else before), bool(edge[-1])
        if held is not None:
            yield held.assign(like=before is not None and before == held["head"].iloc[0], edge=True)

    found = cut(ordered.mapInPandas(compare, f"{kind}, like boolean, edge boolean"))
    # a head at the edges of two tasks is shared
    edges = found.filter("edge")
    meet = edges.groupBy("head").agg(F.count("*").alias("m")).filter("m > 1").select("head")
    late = edges.filter(~F.col("like")).join(meet, "head", "left_semi")
    return found.filter("like").select(columns).union(late.select(columns))


def repeated_runs(docs: DataFrame, length: int, k: int, w: int) -> DataFrame:
    """(doc, row, start, n, first_doc, first): runs of ``n`` windows of ``length`` words, from word
    ``start`` on, that stand in two documents or more; ``first`` tells the occurrences with the
    smallest (doc, row, start)."""
    found = cut(shared_suffixes(_suffixes(docs, length, k, w)))
    classes = cut(
        found.groupBy("head", "ext").agg(
            F.min(F.struct("doc", "row", "lo", "n")).alias("at"), F.min("row").alias("low"), F.max("row").alias("high")
        )
    )
    # written, so that the joins on it are of two plain shuffles: Spark splits a hot head then
    mixed = cut(classes.groupBy("head").agg(F.count("*").alias("c")).filter("c > 1").select("head"))
    pure = classes.join(mixed, "head", "left_anti").filter("low <> high")
    whole = pure.select("head", "ext", F.lit(0).alias("off"), F.lit(None).cast("int").alias("many"), "at.doc", "at.row", F.col("at.lo").alias("start"))
    single = _compared(docs, cut(classes.join(mixed, "head", "left_semi")), length).withColumn("many", F.lit(1))
    repeats = whole.unionByName(single).select(
        "head", "ext", "off", "many", F.col("doc").alias("first_doc"), F.col("row").alias("first_row"), F.col("start").alias("first_start")
    )
    start = F.col("lo") + F.col("off")
    return found.join(repeats, ["head", "ext"]).select(
        "doc", "row", start.alias("start"), F.coalesce("many", "n").alias("n"), "first_doc",
        ((F.col("row") == F.col("first_row")) & (start == F.col("first_start"))).alias("first"),
    )


def _compared(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(head, ext, off, doc, row, start): the windows of ``classes`` that stand in two documents
    or more, with the smallest place of each."""
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    kind = StructType([StructField("i", ints), StructField("off", ints), StructField("h1", longs), StructField("h2", longs)])

    @F.pandas_udf(kind)
    def extended(text: pd.Series, lo: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        with np.errstate(over="ignore"):
            for t, begin, many in zip(text, lo, n):
                words = Words(t)
                i = np.repeat(np.arange(len(begin)), many)
                off = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                at = begin[i] + off
                hashes = [words.spans(at, at + length, base).view(np.int64) for base in (_BASE, _BASE2)]
                rows.append((i.astype(np.int32), off.astype(np.int32), *hashes))
        return pd.DataFrame(rows, columns=["i", "off", "h1", "h2"])

    # the places of one document are one task's, as its text is
    asked = classes.groupBy("at.row").agg(F.collect_list(F.struct("head", "ext", "low", "high", "at")).alias("c"))
    texts = _named(docs).join(asked, "row")
    made = texts.withColumn("x", extended("text", F.col("c.at.lo"), F.col("c.at.n")))
    windows = cut(
        made.select("c", F.explode(F.arrays_zip("x.i", "x.off", "x.h1", "x.h2")).alias("x"))
        .select(F.get("c", F.col("x.i")).alias("c"), "x.off", "x.h1", "x.h2")
        .select("c.head", "c.ext", "c.low", "c.high", "c.at.doc", "c.at.row", (F.col("c.at.lo") + F.col("off")).alias("start"), "off", "h1", "h2")
    )
    groups = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc", "row", "start")).alias("p"), F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("low <> high")
        .select("h1", "h2", "p")
    )
    groups = cut(groups)
    return windows.select("head", "ext", "off", "h1", "h2").join(groups, ["h1", "h2"]).select("head", "ext", "off", "p.doc", "p.row", "p.start")


def _merge(runs: DataFrame, length: int) -> DataFrame:
    """(row, begin, end): arrays of the word spans [begin, end) that the runs of each document
    cover. The runs of one document are one task's, as its text is."""
    held = runs.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("r"))
    # a suffix's windows follow the one's before it, so their ends are in order too
    begin = F.expr(f"filter(r, (x, i) -> i = 0 OR x.start > r[i - 1].start + r[i - 1].n + {length - 1})").getField("start")
    last = F.expr(f"filter(r, (x, i) -> i = size(r) - 1 OR r[i + 1].start > x.start + x.n + {length - 1})")
    return held.select("row", begin.alias("begin"), F.transform(last, lambda x: x["start"] + x["n"] + (length - 1)).alias("end"))


def repeated_passages(docs: DataFrame, length: int = 50, k: int = 8, w: int = 32) -> DataFrame:
    """(doc_id, begin, end, n_words, first_doc): one row for each maximal span of words
    [begin, end) covered by passages of at least ``length`` words that stand in another
    document too. ``first_doc`` is the smallest id that holds a part of it."""
    _fits(length, k, w)
    runs = cut(repeated_runs(docs, length, k, w))
    spans = _merge(runs, length).select("row", F.explode(F.arrays_zip("begin", "end")).alias("x"))
    inside = (F.col("r.start") >= F.col("s.x.begin")) & (F.col("r.start") < F.col("s.x.end"))
    known = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return (
        runs.alias("r").join(spans.alias("s"), (F.col("r.row") == F.col("s.row")) & inside)
        .groupBy("s.row", "s.x.begin", "s.x.end")
        .agg(F.min("r.doc").alias("doc"), F.min("r.first_doc").alias("first_doc"))
        .select(known("doc").alias("doc_id"), "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), known("first_doc").alias("first_doc"))
    )


def _fits(length: int, k: int, w: int) -> None:
    if w + k - 1 > length or min(k, w) < 1:
        raise ValueError("a passage of length words must hold a whole window: w + k - 1 <= length")


def drop_repeats(docs: DataFrame, length: int = 50, k: int = 8, w: int = 32) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` wherever they are not the first
    occurrence; the words around a cut stay, joined by a blank. Documents without such a
    passage are unchanged. A document with no word left goes. ``n_chars``, where there is
    such a column, follows the text."""
    _fits(length, k, w)
    spans = _merge(repeated_runs(docs, length, k, w).filter(~F.col("first")), length)

    @F.pandas_udf("string")
    def without(text: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for t, opens, closes in zip(text, begin, end):
            if opens is None:
                out.append(t)
                continue
            words = Words(t)
            starts, ends = words.places()
            pieces, at = [], 0
            for b, e in zip(opens, closes):
                pieces.append(words.raw[at : starts[b]].rstrip())
                at = int(ends[e - 1])
            pieces.append(words.raw[at:].lstrip())
            out.append(b" ".join(x for x in pieces if x.strip()).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    named = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    spans = spans.select(F.col("row").alias("__row"), F.col("begin").alias("__begin"), F.col("end").alias("__end"))
    cleaned = named.join(spans, "__row", "left").withColumn("__text", without("text", "__begin", "__end"))
    changed = F.col("__begin").isNotNull()
    columns = {"text": F.when(changed, F.col("__text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    kept = cleaned.filter(~changed | (F.length("__text") > 0))
    return kept.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
