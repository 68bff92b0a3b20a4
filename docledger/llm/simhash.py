"""SimHash near-duplicates: sharded BK-trees over word-shingle fingerprints.

A fingerprint bit is 1 if it is set in over half the hashes of a text's shingles. Texts
with one fingerprint are one node from the start, so copies are never paired. Nodes are
dealt to shards such that linked nodes meet in one; a shard of more than ``cap`` nodes is
cut into parts, and every pair of parts is searched by a task of its own: the tree of one
part (at most ``cap`` nodes) is sent to the other part's nodes. A driver-side broadcast of
all trees would grow with the corpus; a tree here has a fixed bound.

Nulls and blanks: a null text is an empty one; a text without words has fingerprint zero
and is linked like any other. Rows with a null ``doc_id`` take part; they never name a
component unless all its ids are null, when the name is null too. Repeated rows are kept
and share a component. Other columns of the input are ignored by ``near_duplicates``.

``similar_texts`` takes fingerprints as a filter only: a link is one of exact similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..session import cut
from .bktree import Forest, merged
from .common import mix, small_batches

_PRINT = StructType([StructField("fp", BinaryType()), StructField("minima", ArrayType(LongType()))])
_PART = 1 << 15
#: Of the sets that are compared exactly: one text's fingerprint, name and size.
_SET = StructType([*_PRINT.fields, StructField("id", LongType()), StructField("n", LongType())])
#: Shingles of a part of a group of candidates, on average.
_PART_SHINGLES = 1 << 20
#: Pairs compared before the classes found are looked up again.
_CHECKED = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included. Words are runs of
    anything but ASCII white space, with A-Z in lower case."""
    if not text:
        return np.empty(0, np.uint64)
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    n = max(1, len(w) - words + 1)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(b" ".join(w[i : i + words]), 42) for i in range(n)), np.uint64, n)


def _fingerprint(hashes: np.ndarray, bits: int, minima: int) -> tuple[bytes, list[int]]:
    n = len(hashes)
    counts, low = np.zeros(bits, np.int64), np.full(minima, np.uint64(2**64 - 1))
    for at in range(0, n, _PART):
        part = hashes[at : at + _PART]
        for k in range(bits // 64):
            h = part if not k else mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
            counts[64 * k : 64 * k + 64] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(
                axis=0, dtype=np.int64
            )
        for k in range(minima):
            low[k] = min(low[k], mix(part ^ np.uint64((k + 1) * 0xD1B54A32D192ED03 % 2**64)).min())
    return np.packbits(2 * counts > n).tobytes(), low.view(np.int64).tolist() if n else []


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, minima: int = 0) -> DataFrame:
    """(doc_id, fp, minima): ``bits`` fingerprint bits of whole texts as bytes, and the least
    values of ``minima`` orders of its shingles."""

    @F.pandas_udf(_PRINT)
    def prints(text: pd.Series) -> pd.DataFrame:
        with np.errstate(over="ignore"):
            rows = [_fingerprint(shingle_hashes(t, words), bits, minima) for t in text]
        return pd.DataFrame(rows, columns=["fp", "minima"])

    return small_batches(docs).select("doc_id", prints("text").alias("p")).select("doc_id", "p.fp", "p.minima")


def block_shards(bits: int, radius: int, blocks: int) -> Column:
    """Shard names of a fingerprint of 64 bits: its bits in ``blocks`` blocks; two
    fingerprints at most ``radius`` apart agree in ``blocks - radius`` of them, so they meet
    in a shard. More blocks make more and smaller shards, for very large tables."""
    if not radius < blocks <= bits or bits != 64:
        raise ValueError("blocks must be more than radius, and fingerprints have 64 bits")
    value = _as_long("fp")
    edges = [bits * i // blocks for i in range(blocks + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return F.array(
        *[
            F.xxhash64(F.lit(k), value.bitwiseAND(F.lit(_signed(sum(masks[i] for i in chosen)))))
            for k, chosen in enumerate(combinations(range(blocks), blocks - radius))
        ]
    )


def _as_long(fp: str) -> Column:
    return F.conv(F.hex(fp), 16, -10).cast("long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, radius: int, cap: int = 2048) -> DataFrame:
    """(a, b): links that connect all nodes at most ``radius`` bits apart that share a shard.

    ``nodes``: (id long, fp, shards array<long>). Within a task, links that add nothing to
    the connection are not returned, so a dense group gives about as many links as nodes."""
    keyed = nodes.select("id", "fp", F.explode(F.array_distinct("shards")).alias("shard"))
    # written, so that the join on it is of two plain shuffles: Spark splits a hot shard then
    sizes = cut(keyed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"))
    parts = F.ceil(F.col("n") / F.lit(cap)).cast("int")
    return _searched(keyed.join(sizes.select("shard", parts.alias("parts")), "shard"), ["id", "fp"], lambda f, g: _connected(f, g, radius))


def _searched(keyed: DataFrame, columns: list[str], connect: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]) -> DataFrame:
    """(a, b): what ``connect(rows, group)`` finds in each pair of a shard's ``parts``.

    ``keyed``: ``columns`` with id, and shard, parts."""
    dealt = (
        keyed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "shard", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", *columns
        )
    )
    keys = ["shard", "lo", "hi"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            changed = (frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(axis=1)
            group = np.concatenate([[0], np.cumsum(changed)])
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            rest = frame.iloc[whole:]
            if whole:
                yield connect(frame.iloc[:whole], group[:whole])
        if rest is not None and len(rest):
            yield connect(rest, np.zeros(len(rest), np.int64))

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(search, "a long, b long")


def _connected(frame: pd.DataFrame, group: np.ndarray, radius: int) -> pd.DataFrame:
    fp = frame["fp"].tolist()
    words = np.frombuffer(b"".join(fp), ">u8").astype(np.uint64).reshape(len(fp), -1)
    part, ids = frame["part"].to_numpy(), frame["id"].to_numpy()
    tree = np.flatnonzero(part == frame["lo"].to_numpy())
    asks = np.flatnonzero(part == frame["hi"].to_numpy())
    label = np.arange(len(frame))
    forest = Forest(words[tree], group[tree])
    for query, node in forest.within(words[asks], group[asks], radius):
        label = merged(label, asks[query], tree[node])
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def _alike(frame: pd.DataFrame, group: np.ndarray, radius: int, similarity: float) -> pd.DataFrame:
    """As ``_connected``, of the pairs whose ``shingles`` (sorted, distinct) are alike."""
    fp, ids, sets = frame["fp"].tolist(), frame["id"].to_numpy(), frame["shingles"].tolist()
    words = np.frombuffer(b"".join(fp), ">u8").astype(np.uint64).reshape(len(fp), -1)
    size = np.array([len(x) for x in sets])
    part = frame["part"].to_numpy()
    tree = np.flatnonzero(part == frame["lo"].to_numpy())
    asks = np.flatnonzero(part == frame["hi"].to_numpy())
    up, label = list(range(len(frame))), np.arange(len(frame))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    forest = Forest(words[tree], group[tree])
    for query, node in forest.within(words[asks], group[asks], radius):
        left, right = asks[query], tree[node]
        low, high = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
        # within one part each pair is met from both sides
        able = ((part[left] != part[right]) | (left < right)) & (low / np.maximum(high, 1) >= similarity)
        left, right = left[able], right[able]
        for at in range(0, len(left), _CHECKED):
            a, b = left[at : at + _CHECKED], right[at : at + _CHECKED]
            apart = label[a] != label[b]
            for i, j in zip(a[apart].tolist(), b[apart].tolist()):
                x, y = find(i), find(j)
                if x != y:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both / (size[i] + size[j] - both) >= similarity:
                        up[max(x, y)] = min(x, y)
            label = np.array([find(i) for i in range(len(up))])
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def near_duplicates(
    docs: DataFrame, words: int = 4, bits: int = 64, radius: int = 4, blocks: int = 5, minima: int = 0, cap: int = 2048
) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of ``docs``; ``component_id`` is the
    smallest id that links reach, null where none of them has an id.

    With ``minima`` 0 shards are blocks of fingerprint bits and no link is missed. With
    ``minima`` above 0, for fingerprints of many bits and a large radius, where blocks select
    nothing, shards are the least shingles under that many orders: texts of similarity s
    fail to meet with probability (1 - s) ** minima."""
    from .components import components

    prints = cut(fingerprints(docs, words, bits, minima))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("minima").alias("minima"))
    # an id may stand on rows of different texts, so a node is named by its fingerprint
    name = _as_long("fp") if bits == 64 else F.xxhash64("fp")
    nodes = cut(nodes.select("fp", "minima", F.col("id").alias("doc"), name.alias("id")))
    shards = F.col("minima") if minima else block_shards(bits, radius, blocks)
    found = components(near_links(nodes.withColumn("shards", shards), radius, cap))
    placed = (
        nodes.select("fp", "doc", "id")
        .join(found.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    placed = cut(placed)
    names = cut(placed.groupBy("root").agg(F.min("doc").alias("component_id")))
    placed = placed.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.select("doc_id", "fp").join(placed, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that repeat another: of each component the row with the
    smallest ``doc_id`` stays (of rows with that id and one text, one). Rows without an id
    stay only where their whole component has none, and then one of each text does."""
    found = near_duplicates(docs, **options)
    keep = found.select(F.col("component_id").alias("__keep")).distinct()
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__keep")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def _text_key() -> Column:
    """Names a text; a null one is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def similar_texts(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, bits: int = 512, radius: int = 150, minima: int = 8, cap: int = 2048
) -> DataFrame:
    """(doc_id, key): of each component the smallest id and the text that it stands on. Links
    are pairs whose sets of shingles have at least ``similarity`` (shared of all).

    Equal sets are one node. Nodes that share a shard and lie within ``radius`` bits are
    candidates, and so are all pairs of a component of candidates within that radius; each
    of these is compared by its sets, unless it is connected already. At most, two sets of
    similarity 0.8 lie 96 bits apart on average (4 shared of 5, spread 9; 78 bits for long
    texts), so that the radius of 150 is 6 spreads away; they fail to share a shard with
    probability 0.2 ** minima. A group of candidates is cut into parts by its nodes
    and its shingles, and each pair of parts is a task's."""
    from .components import components

    @F.pandas_udf(_SET)
    def prints(text: pd.Series) -> pd.DataFrame:
        rows = []
        with np.errstate(over="ignore"):
            for t in text:
                hashes = np.unique(shingle_hashes(t, words))
                name = xxhash.xxh64_intdigest(hashes.tobytes(), 7)
                rows.append((*_fingerprint(hashes, bits, minima), _signed(name), len(hashes)))
        return pd.DataFrame(rows, columns=["fp", "minima", "id", "n"])

    @F.pandas_udf(ArrayType(LongType()))
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words).view(np.int64)) for t in text], dtype=object)

    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    rows = small_batches(docs).select("doc_id", _text_key().alias("key"), prints("text").alias("p")).select("doc_id", "key", "p.*")
    nodes = cut(
        rows.groupBy("id").agg(F.min(first).alias("first"), F.min("fp").alias("fp"), F.min("minima").alias("minima"), F.min("n").alias("n"))
    )
    wide = components(near_links(nodes.select("id", "fp", F.col("minima").alias("shards")), radius, cap))
    members = wide.select(F.col("a").alias("id"), F.col("b").alias("shard")).union(wide.select("b", "b").distinct())
    members = cut(nodes.select("id", "fp", "n", "first").join(members, "id"))
    parts = F.ceil(F.greatest(F.count("*") / F.lit(cap), F.sum("n") / F.lit(_PART_SHINGLES))).cast("int")
    sizes = cut(members.groupBy("shard").agg(parts.alias("parts")))
    asked = cut(members.join(sizes, "shard").select("id", "fp", "shard", "parts", F.col("first.doc_id").alias("__doc"), F.col("first.key").alias("key")))
    texts = docs.select("doc_id", "text", _text_key().alias("key"))
    held = texts.join(asked, _same_row(texts, asked)).select("id", "fp", "shard", "parts", "text").dropDuplicates(["id"])
    held = small_batches(held).select("id", "fp", "shard", "parts", shingles("text").alias("shingles"))
    found = components(_searched(held, ["id", "fp", "shingles"], lambda f, g: _alike(f, g, radius, similarity)))
    placed = nodes.select("id", "first").join(found.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left")
    names = placed.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    return cut(names.select("first.doc_id", "first.key"))


def _same_row(texts: DataFrame, named: DataFrame) -> Column:
    return (texts["key"] == named["key"]) & texts["doc_id"].eqNullSafe(named["__doc"])


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that repeat another: of each component of ``similar_texts``
    one row stays, the one with the smallest ``doc_id`` (one without an id only where the whole
    component has none)."""
    keep = similar_texts(docs, **options).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"))
    same = (_text_key() == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    return docs.join(keep, same, "left_semi").dropDuplicates(["doc_id", "text"])
