"""Connected components of a link table, as joins and aggregates that repeat until stable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, in any direction, repeats allowed) -> (a, b): every node but the
    smallest of its component, with that smallest node.

    Alternating star contraction: a node's larger neighbours are moved to its smallest
    neighbour, then its smaller ones. The number of links never grows; rounds grow with the
    logarithm of the longest chain. A node with very many links is reduced by ``min`` before
    its shuffle, and its joins are ones that Spark can split. Each round is written to the
    shared folder; the driver sees one count and checksum."""
    now = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    sign = _sign(now)
    while sign[0]:
        both = now.union(now.select("b", "a"))
        # written, so that the join on it is of two plain shuffles: Spark splits a hot node then
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = (
            both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = (
            large.join(least, F.col("a") == F.col("u"))
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        now = cut(small)
        sign, before = _sign(now), sign
        if sign == before:
            break
    return now
