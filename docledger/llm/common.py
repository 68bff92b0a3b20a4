"""Small helpers that several operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that a Python task gets at once.
_BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python at most 8 MB of rows at once (or one longer row):
    texts differ in length by orders of magnitude, and a batch of them is held several
    times over. A lower setting of the session's own is kept."""
    spark = df.sparkSession
    conf = spark.conf
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(_BATCH))
    if not 0 < now <= _BATCH_BYTES:
        conf.set(_BATCH, str(_BATCH_BYTES))
    return df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row. Inside a lambda a plain
    expression would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def digests(pieces: DataFrame, keys: list[str], order: list[str], separator: bytes) -> DataFrame:
    """(keys, sha256): the SHA-256 of each key's ``piece`` values (binary), in order and joined by
    ``separator``. A digest is taken in sequence: pieces pass through a task as a stream and
    none is kept, so a key may have any number of them; join short ones to longer ones before."""
    fields = [f for f in pieces.schema.fields if f.name in keys]
    names = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sha256 string"
    dealt = pieces.repartition(*names).sortWithinPartitions(*names, *order).select(*names, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        for batch in batches:
            types = [batch.schema.field(n).type for n in names]
            rows = zip(*[batch.column(n).to_pylist() for n in names])
            done = []
            for now, piece in zip(rows, batch.column("piece")):
                if digest is None or now != key:
                    if digest is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(separator)
                digest.update(piece.as_buffer())
            if done:
                yield _rows(done, [*names, "sha256"], [*types, pa.string()])
        if digest is not None:
            yield _rows([(*key, digest.hexdigest())], [*names, "sha256"], [*types, pa.string()])

    return small_batches(dealt).mapInArrow(run, schema)


#: Bytes of a strung piece.
_PIECE = 1 << 20


def strung(rows: DataFrame, keys: list[str], order: list[str], separator: bytes) -> DataFrame:
    """(keys, part, number, piece): each key's ``value`` texts in order, joined by ``separator`` into pieces.
    Ranges of (keys, order) are joined apart, so a key with very many values is spread; ``order`` has to
    tell its rows apart. Pieces stand in the order of (part, number)."""
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", part int, number int, piece binary"
    place = [*keys, *[c for c in order if c not in keys]]
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(*place).select(*keys, "value", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, number = None, [], 0, 0
        types = part = None
        for batch in batches:
            types = types or [*[batch.schema.field(n).type for n in keys], pa.int32(), pa.int32(), pa.binary()]
            done = []
            for *now, part, value in zip(*[batch.column(n).to_pylist() for n in (*keys, "part", "value")]):
                if held and (now != key or size > _PIECE):
                    done.append((*key, part, number, separator.join(held)))
                    number = number + 1 if now == key else 0
                    held, size = [], 0
                key = now
                held.append(value.encode())
                size += len(value) + len(separator)
            if done:
                yield _rows(done, [*keys, "part", "number", "piece"], types)
        if held:
            yield _rows([(*key, part, number, separator.join(held))], [*keys, "part", "number", "piece"], types)

    return dealt.mapInArrow(run, schema)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
