"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Documents are range-partitioned on their id, so that shard k holds ids below those of shard
k + 1, and each task writes one shard. A record is one document: 8 bytes length, 4 bytes masked
checksum of those, the ids as little-endian unsigned integers, 4 bytes masked checksum of the
ids. Checksums are CRC-32C, turned by 15 bits and added to a constant: the TFRecord frame. An id
takes 2 bytes if all of the vocabulary fits, else 4. The index is a Parquet table beside the shards
with one row for each record: shard, file, offset, n_tokens, bytes of an id, and the ids before
it in its shard. Any subset in any order is read by it.

A task's file has a name of its own and takes it when complete; only files that the committed
index names count, so a task that runs twice leaves no second copy of a record.

Where the tokenizer drops white space, a text is cut at blanks, tabs and line ends, and distinct
pieces are tokenized once: a Python worker keeps them, up to a bound, for its next tasks too.

Nulls and blanks: a null text is the empty one and has the end id alone; null ids come first. Rows
with equal ids stand in the order of a hash of their texts; repeated rows are all written. An
empty table has no shard and reads back empty. Other columns are ignored. A shard that does not
match its checksums raises.
"""

from __future__ import annotations

import functools
import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.broadcasting import maybe_broadcast, plan_bytes
from .common import small_batches

#: Bytes of stored text that make a shard, as the plan estimates them.
SHARD_BYTES = 32 << 20
#: Distinct pieces of text that a task keeps.
_KEPT_PIECES = 600_000
#: Bytes of texts that are encoded at once, if no text is longer.
_PART_BYTES = 2 << 20
#: Bytes read from a shard at once, if no record is longer.
_READ_BYTES = 8 << 20
_HEAD = np.dtype([("length", "<u8"), ("check", "<u4")])
_MASK = 0xA282EAD8
_POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
_BLOCK = 128  # half-words of a block


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lookups that take a checksum over 2 zero bytes, and over a block of zeros; and the two
    half-words that take a checksum from 0 to the standard's first state, all ones."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(_POLYNOMIAL), first >> 1).astype(np.uint32)
    half = np.stack([first[first & 255] ^ (first >> 8), first])
    block = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_BLOCK):
        block = _over_half(block, half)
    state = 0xFFFFFFFF
    for _ in range(4):  # back by a byte
        byte = int(np.flatnonzero(first >> 24 == state >> 24)[0])
        state = (((state ^ int(first[byte])) << 8) | byte) & 0xFFFFFFFF
    return half, block, np.array([state & 0xFFFF, state >> 16], dtype=np.uint16)


def _over_half(checks: np.ndarray, half: np.ndarray) -> np.ndarray:
    return half[0][checks & 255] ^ half[1][(checks >> 8) & 255] ^ (checks >> 16)


def _over_block(checks: np.ndarray) -> np.ndarray:
    return _BLOCKS[0][checks & 255] ^ _BLOCKS[1][(checks >> 8) & 255] ^ _BLOCKS[2][(checks >> 16) & 255] ^ _BLOCKS[3][checks >> 24]


_HALF, _BLOCKS, _ONES = _tables()


def checksums(halves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The masked CRC-32C of each run of ``halves`` (16 bits, little-endian), ``sizes`` of any length. Runs are cut
    into blocks that go side by side; leading zeros do not change a checksum that starts at 0,
    so a run's first block is filled up in front, before the half-words that set all ones."""
    blocks = -(-(sizes + 2) // _BLOCK)
    first = np.cumsum(blocks) - blocks
    start = np.cumsum(sizes) - sizes
    laid = np.zeros(int(blocks.sum()) * _BLOCK, dtype=np.uint16)
    begins = (first + blocks) * _BLOCK - sizes
    laid[begins - 2], laid[begins - 1] = _ONES
    laid[np.repeat(begins - start, sizes) + np.arange(len(halves))] = halves
    columns = np.ascontiguousarray(laid.reshape(-1, _BLOCK).T)
    parts = np.zeros(columns.shape[1], dtype=np.uint32)
    for column in columns:
        parts = _over_half(parts ^ column, _HALF)
    longest = np.argsort(-blocks, kind="stable")
    left, at = blocks[longest], first[longest]
    sums = np.zeros(len(sizes), dtype=np.uint32)
    top = int(left[0]) if len(left) else 0
    for k in range(top):
        n = int(np.searchsorted(-left, -(top - k), side="right"))  # runs that have begun
        sums[:n] = _over_block(sums[:n]) ^ parts[at[:n] + (k - top + left[:n])]
    out = np.empty_like(sums)
    out[longest] = sums ^ np.uint32(0xFFFFFFFF)
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(_MASK)


class Encoder:
    """Texts to ids, as bytes. ``encode`` equals the tokenizer's own, without special tokens added."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.kept: dict[str, bytes] = {}
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letter = "H" if self.type.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        # does white space only part what stands around it?
        self.parted = all(self._plainly(a + s + b) == self._plainly(a) + self._plainly(b) for a, s, b in _PARTED)
        # are letters alone a unit, of lower-case bytes? Then the model can be asked directly
        self.direct = self.parted and all(self._plainly(w + t) == self._asked(w.lower()) + self._plainly(t) for w, t in _UNITS)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.parted:
            return [self._plainly(t or "") for t in texts]
        cut = [(t or "").replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.kept) > _KEPT_PIECES:
            self.kept = {}
        self._learn(set().union(*cut).difference(self.kept))
        return [b"".join(map(self.kept.__getitem__, pieces)) for pieces in cut]

    def _plainly(self, text: str) -> bytes:
        return self._raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _raw(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _asked(self, word: str) -> bytes:
        """Ids of a unit of lower-case letters, as the model has them for its bytes."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return self._raw([t.id for t in self.model.tokenize(word)])

    def _learn(self, pieces: set[str]) -> None:
        """A piece of letters, with or without stops and commas after it, is looked up by its letters
        in lower case; other pieces go through the whole tokenizer."""
        kept = self.kept
        for piece in pieces:
            word = piece.rstrip(".,")
            lower = word.lower()
            # letters below U+0250 are composed, and no neighbour changes their lower case
            if self.direct and word.isalpha() and lower.isalpha() and max(word) < "\u0250":
                found = kept.get(lower)
                if found is None:
                    found = kept[lower] = self._asked(lower)
                tail = piece[len(word) :]
                if tail and tail not in kept:
                    kept[tail] = self._plainly(tail)
                kept[piece] = found + kept[tail] if tail else found
            else:
                kept[piece] = self._plainly(piece)


_PARTED = [(a, s, b) for a, b in (("a", "b"), ("It", "is."), ("x1", "'s"), ("é", "́"), ("", "!?")) for s in (" ", "\n", "\r\n", " \t ")]
_UNITS = [(w, t) for w in ("a", "Word", "Éclair", "straße", "ıÎ", "internationally") for t in ("", ".", ",", "...")]
#: The letters that byte-level models write bytes with: printable bytes as they are, others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


@functools.lru_cache(maxsize=1)
def _encoder(model: str) -> Encoder:
    """A worker's encoder: tasks that run in the worker one after the other share it."""
    return Encoder(model)


def frames(bodies: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The records of ``bodies`` (ids of 2 or 4 bytes), and their lengths in bytes."""
    sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    heads = np.zeros(len(bodies), dtype=_HEAD)
    heads["length"] = sizes
    heads["check"] = checksums(sizes.astype("<u8").view("<u2"), np.full(len(bodies), 4))
    checks = checksums(np.frombuffer(b"".join(bodies), dtype="<u2"), sizes // 2).astype("<u4")
    raw, tails = heads.tobytes(), checks.tobytes()
    out: list[bytes] = []
    for i, body in enumerate(bodies):
        out += (raw[12 * i : 12 * i + 12], body, tails[4 * i : 4 * i + 4])
    return out, sizes + 16


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of few bytes, or of one row: a text's pieces take many times its size."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // _PART_BYTES
    bounds = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(bounds, [*bounds[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _parts_for(rows: DataFrame, part_bytes: int) -> list[int]:
    """How many parts of that size ``rows`` make; the session's own number where the plan does not know."""
    known = plan_bytes(rows)
    return [max(rows.sparkSession.sparkContext.defaultParallelism, -(-known // part_bytes))] if known < 1 << 60 else []


def write(docs: DataFrame, folder: str, model: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` to shards and the index below ``folder`` (which all executors share: a path or an
    address that pyarrow opens) and returns the index: (key, shard, file, offset, n_tokens,
    width, before), ``width`` being the bytes of an id and ``before`` the ids before a record in its shard. ``end_id`` is put after each text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # equal rows may be dealt to several shards: a hash and a number follow the id
    order = ["key", "hash", "tie"]
    dealt = rows.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(*_parts_for(rows, SHARD_BYTES), *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    field = rows.schema["key"]
    schema = f"key {field.dataType.simpleString()}, shard int, file string, offset long, n_tokens long, width int, before long"

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        encoder, out, name, temporary, end = _encoder(model), None, "", "", b""
        offset = before = 0
        for batch in (part for whole in batches for part in _parts(whole)):
            if out is None:
                end = np.array([] if end_id is None else [end_id], dtype=encoder.type).tobytes()
                store.create_dir(f"{base}/shards", recursive=True)
                number = batch.column("shard")[0].as_py()
                name = f"shards/{number:06d}-{uuid.uuid4().hex}.records"
                temporary = posixpath.join(base, posixpath.dirname(name), "_" + posixpath.basename(name))
                out = store.open_output_stream(temporary)
            bodies = [ids + end for ids in encoder.encode(batch.column("text").to_pylist())]
            parts, sizes = frames(bodies)
            out.write(b"".join(parts))
            tokens = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) // encoder.type.itemsize
            width = np.full(batch.num_rows, encoder.type.itemsize, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("shard"), pa.array([name] * batch.num_rows),
                    pa.array(offset + np.cumsum(sizes) - sizes), pa.array(tokens), pa.array(width), pa.array(before + np.cumsum(tokens) - tokens),
                ],
                names=["key", "shard", "file", "offset", "n_tokens", "width", "before"],
            )
            offset += int(sizes.sum())
            before += int(tokens.sum())
        if out is not None:
            out.close()
            store.move(temporary, posixpath.join(base, name))

    index = small_batches(dealt.select("key", "text", "shard")).mapInArrow(shard, schema)
    index.write.parquet(f"{folder.rstrip('/')}/index")
    return read_index(spark, folder, key)


def read_index(spark, folder: str, key: str = "doc_id") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/index").withColumnRenamed("key", key)


def read(index: DataFrame, folder: str, key: str = "doc_id", seed: int | None = None) -> DataFrame:
    """(key, shard, before, n_tokens, ids): the records that ``index`` names, ids as little-endian unsigned 32-bit
    integers in one binary. Rows come in the order of the shards, or with a ``seed`` in an order shuffled over all shards."""
    spark = index.sparkSession
    place = ["shard", "offset"] if seed is None else ["turn", "shard", "offset"]
    turn = F.xxhash64(F.lit(seed or 0), "shard", "offset")
    named = index.select(F.col(key).alias("key"), "shard", "file", "offset", "n_tokens", "width", "before", turn.alias("turn"))
    # an index row stands for a document: parts of some thousand rows, whatever the index's size
    dealt = named.repartitionByRange(*_parts_for(index, 1 << 20), *place).sortWithinPartitions(*place)
    field = named.schema["key"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            file = batch.column("file").to_pylist()
            offset = batch.column("offset").to_numpy()
            width = batch.column("width").to_numpy()
            sizes = batch.column("n_tokens").to_numpy() * width
            ends = offset + sizes + 16
            a = 0
            while a < batch.num_rows:
                b = a + 1
                while b < batch.num_rows and file[b] == file[a] and offset[b] == ends[b - 1] and ends[b] - offset[a] <= _READ_BYTES:
                    b += 1
                with store.open_input_file(posixpath.join(base, file[a])) as shard:
                    raw = shard.read_at(int(ends[b - 1] - offset[a]), int(offset[a]))
                bodies = _checked(raw, offset[a:b] - offset[a], sizes[a:b], file[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("shard"), part.column("before"), part.column("n_tokens"), pa.array([_wide(x, w) for x, w in zip(bodies, width[a:b].tolist())], pa.binary())],
                    names=["key", "shard", "before", "n_tokens", "ids"],
                )
                a = b

    schema = f"key {field.dataType.simpleString()}, shard int, before long, n_tokens long, ids binary"
    return dealt.drop("turn").mapInArrow(load, schema).withColumnRenamed("key", key)


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def _checked(raw: bytes, offset: np.ndarray, sizes: np.ndarray, file: str) -> list[bytes]:
    bodies = [raw[a + 12 : a + 12 + n] for a, n in zip(offset.tolist(), sizes.tolist())]
    if b"".join(frames(bodies)[0]) != raw:
        raise ValueError(f"{file}: records do not match their lengths and checksums")
    return bodies


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """``records`` with ``start``: the ids of all records before each, in the order of the shards.
    The window holds one row for each shard."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("__ids"))
    earlier = F.sum("__ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(earlier, F.lit(0)).alias("__base"))
    return records.join(maybe_broadcast(bases), "shard").withColumn("start", F.col("__base") + F.col("before")).drop("__base")
