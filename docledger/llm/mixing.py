"""Mixing sources to target weights by fair scheduling, in DataFrame operations only.

Rows of a source are put in a fixed random order (a hash of ``doc_id``) and cut into blocks.
Target weights are whole shares of a period of ``Q`` slots; block b of a source with share a
is released at slot floor(b Q / a) and due by slot ceil((b + 1) Q / a). Each slot takes, of
the blocks released, the one with the earliest deadline (of equal ones that of the first
source in order). As the shares fill the period exactly, no block is early or late: in any
prefix a source's blocks differ from its weight by less than one, as long as it has blocks.
Periods repeat, so one period's schedule (as long as the weights are fine, whatever the
number of rows) places every block of every period.

A source may hold most rows: its rows are numbered in buckets of the order, each bucket a
task's, and the buckets' counts are summed before.

Nulls: a null source is a source of its own, ordered first; a null ``doc_id`` is ordered as the
empty text. Rows with equal ids keep any order among themselves, repeated rows all take part.
An empty table gives an empty result. A source without a target weight is placed by its own
count, one with weight 0 or less raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a bucket, on average: what one task sorts at a time.
_BUCKET_ROWS = 2_000


def tempered_shares(docs: DataFrame, exponent: float = 0.7, resolution: int = 1000, weights: dict | None = None) -> DataFrame:
    """(source, share): shares of a period in proportion to count ** exponent, at least 1
    each, about ``resolution`` in all. ``weights`` sets weights by source in place of that
    power of the count."""
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    weight = F.pow(F.col("n").cast("double"), F.lit(exponent))
    if weights:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(given[F.col("source")], weight)
    total = F.sum("w").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    # the window holds one row for each source
    return sizes.withColumn("w", weight).select(
        "source", F.greatest(F.lit(1).cast("long"), F.round(F.lit(resolution) * F.col("w") / total).cast("long")).alias("share")
    )


def period(shares: DataFrame) -> DataFrame:
    """(source, share, q, k, at): block k of a source in one period stands at slot ``at``.

    The earliest deadline is chosen slot by slot in one row's arrays: as many steps as
    shares, which the weights bound, not the rows."""
    every = shares.agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("s")).select(
        "s", F.expr("transform(s, x -> x.share)").alias("a"), F.expr("aggregate(s, 0L, (t, x) -> t + x.share)").alias("q")
    )
    run = """
      aggregate(
        sequence(0L, q - 1),
        named_struct('done', transform(a, x -> 0L), 'slots', cast(array() AS array<struct<i:int,k:bigint>>)),
        (state, t) -> transform(
          array(array_min(filter(
            transform(state.done, (c, i) -> named_struct('late', ((c + 1) * q + a[i] - 1) div a[i], 'i', i, 'k', c)),
            x -> (x.k * q) div a[x.i] <= t
          ))),
          next -> named_struct(
            'done', transform(state.done, (c, i) -> IF(i = next.i, c + 1, c)),
            'slots', concat(state.slots, array(named_struct('i', next.i, 'k', next.k)))
          )
        )[0],
        state -> state.slots
      )"""
    placed = every.filter("q > 0").select("s", "q", F.posexplode(F.expr(run)).alias("at", "x"))
    return placed.select(
        F.expr("s[x.i].source").alias("source"), F.expr("s[x.i].share").alias("share"), "q", "x.k", F.col("at").cast("long").alias("at")
    )


def _order() -> list[Column]:
    return [F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.col("doc_id")]


def ranked(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` (about ``rows`` of them) with ``__rank``: from 0, each row's place in its source."""
    buckets = max(1, -(-rows // _BUCKET_ROWS))
    key = F.conv(F.substring(_order()[0], 1, 8), 16, 10).cast("long")
    dealt = docs.withColumn("__bucket", F.shiftright(key * F.lit(buckets), 32))
    inside = W.partitionBy("source", "__bucket").orderBy(*_order())
    before = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = (
        dealt.groupBy("source", "__bucket").agg(F.count("*").alias("__n"))
        .select(F.col("source").alias("__source"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    numbered = dealt.withColumn("__rank", F.row_number().over(inside) - 1)
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__at"))
    return numbered.join(counts, same).withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__source", "__at", "__before", "__bucket")


def schedule(docs: DataFrame, shares: DataFrame, block: int = 16) -> DataFrame:
    """``docs`` with ``__slot`` (where its block stands), ``__place`` (in the block), ``__block``
    (of its source), ``__release`` and ``__deadline``."""
    rows = docs.count()
    plan = period(shares).withColumnsRenamed({c: f"__p_{c}" for c in ("source", "share", "q", "k", "at")})
    sized = shares.select(F.col("source").alias("__s"), F.col("share").alias("__share"))
    ordered = ranked(docs, rows).withColumns({"__block": F.floor(F.col("__rank") / block), "__place": F.col("__rank") % block})
    # shares and plan have as many rows as the weights have sources and slots
    known = ordered.join(F.broadcast(sized), F.col("source").eqNullSafe(F.col("__s")))
    at = F.col("source").eqNullSafe(F.col("__p_source")) & (F.col("__block") % F.col("__share") == F.col("__p_k"))
    b, q, a = F.col("__block"), F.col("__p_q"), F.col("__share")
    return known.join(F.broadcast(plan), at).withColumns(
        {
            "__slot": F.floor(b / a) * q + F.col("__p_at"),
            "__release": F.floor(b * q / a),
            "__deadline": F.ceil((b + 1) * q / a),
        }
    ).drop("__s", "__share", "__p_source", "__p_share", "__p_q", "__p_k", "__p_at", "__rank")


def exhausted(docs: DataFrame, shares: DataFrame, block: int = 16) -> int | None:
    """The first slot whose source has no block left; None if there are no rows."""
    sizes = docs.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).alias("b"))
    plan = period(shares).withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("b") % F.col("share") == F.col("k"))
    return sizes.join(F.broadcast(plan), same).agg(F.min(F.floor(F.col("b") / F.col("share")) * F.col("q") + F.col("at"))).first()[0]


def arranged(docs: DataFrame, shares: DataFrame, block: int = 16) -> DataFrame:
    """All of ``docs`` in the order of the mixture: the result's partitions, and files written
    from it, follow one another in training order. A source without blocks leaves its slots
    empty and the others go on, so weights hold up to there and no row is left out."""
    return _in_order(schedule(docs, shares, block), docs)


def mixture(docs: DataFrame, shares: DataFrame, block: int = 16) -> DataFrame:
    """``docs`` up to the first slot that cannot be filled, in the order of the mixture. What
    lies beyond would break the weights and is left out: a sample as small as the source that
    runs out first makes it. ``arranged`` keeps every row."""
    end = exhausted(docs, shares, block)
    if end is None:
        return docs
    return _in_order(schedule(docs, shares, block).filter(F.col("__slot") < end), docs)


def _in_order(placed: DataFrame, docs: DataFrame) -> DataFrame:
    return placed.repartitionByRange("__slot", "__place").sortWithinPartitions("__slot", "__place").select(*[F.col(f"`{c}`") for c in docs.columns])
