"""Order-dependent steps that stay spread over the cluster when one key is hot.

Numbering, running sums and carry-forward are windows over a key. When a third of all
rows share that key, one task would do a third of the work. These helpers cut each key
into blocks by a deterministic function of the order (a page, a row range, a day), run
the window inside each block, reduce every block to one row before that row is shuffled,
and carry the totals across the blocks.

``blocks`` are the expressions that together name a block, in sorting order (a page, then
a row range inside it); they must follow the row order. A key with ``n`` rows and blocks
of ``b`` rows costs tasks of ``b`` and of ``n / b`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(cols: list[Column], descending: bool) -> list[Column]:
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols]


def _named(blocks: list[Column], level: int) -> list[str]:
    return [f"__b{level}_{i}" for i in range(len(blocks))]


def carry_last(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    blocks: list[Column] | None = None,
    descending: bool = False,
    inclusive: bool = False,
    beyond_first: Column | None = None,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` before each row (``inclusive``: up to and
    including it). ``descending`` walks the order backwards: the next value after a row.

    ``beyond_first`` (descending only, one block expression) is true for rows outside
    block 0. Only those can hand a value to another block, so the pass that collects block
    edges reads nothing else; where every key fits one block it reads nothing at all.
    """
    blocks = blocks or []
    order_cols = [F.col(c) for c in order]
    end = 0 if inclusive else -1
    names = _named(blocks, 0)
    work = df.withColumns({**dict(zip(names, blocks)), "__v": value})
    inner = W.partitionBy(*keys, *names).orderBy(*_order(order_cols, descending)).rowsBetween(
        W.unboundedPreceding, end
    )
    local = F.last("__v", ignorenulls=True).over(inner)
    if not blocks:
        return work.withColumn(out, local).drop("__v")

    # one row per block: its last value in walking order
    pick = F.min_by if descending else F.max_by
    at = F.struct(*order)
    edges = work if beyond_first is None else work.filter(beyond_first)
    tails = edges.groupBy(*keys, *names).agg(
        pick("__v", F.when(F.col("__v").isNotNull(), at)).alias("__tail")
    )
    if beyond_first is not None:
        block_zero = (
            tails.select(*keys)
            .distinct()
            .withColumns(
                {names[0]: F.lit(0).cast("long"), "__tail": F.lit(None).cast(tails.schema["__tail"].dataType)}
            )
        )
        tails = tails.unionByName(block_zero)
    outer = W.partitionBy(*keys).orderBy(*_order([F.col(n) for n in names], descending)).rowsBetween(
        W.unboundedPreceding, -1
    )
    incoming = tails.withColumn("__in", F.last("__tail", ignorenulls=True).over(outer)).drop("__tail")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, *names]]
    joined = (
        work.withColumn("__local", local)
        .alias("l")
        .join(incoming.alias("r"), on, "left")
        .select("l.*", F.coalesce("l.__local", "r.__in").alias(out))
    )
    return joined.drop("__local", "__v", *names)


def carry_several(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[Column, bool]],
    blocks: list[Column],
) -> DataFrame:
    """Add, for each ``out: (value, inclusive)``, the last non-null value before each row (inclusive: up to and
    including it). One pass for all; what crosses blocks is joined only where a key has several."""
    names = _named(blocks, 0)
    work = df.withColumns({**dict(zip(names, blocks)), **{f"__v{i}": v for i, (v, _) in enumerate(values.values())}})
    at = F.struct(*order)
    spots = W.partitionBy(*keys, *names).orderBy(*_order([F.col(c) for c in order], False))
    local = {
        f"__l{i}": F.last(f"__v{i}", ignorenulls=True).over(spots.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
        for i, (_, inclusive) in enumerate(values.values())
    }
    several = range(len(values))
    tails = work.groupBy(*keys, *names).agg(*[F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), at)).alias(f"__t{i}") for i in several])
    outer = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    incoming = tails.select(*keys, *names, *[F.last(f"__t{i}", ignorenulls=True).over(outer).alias(f"__i{i}") for i in several])
    incoming = incoming.filter(F.coalesce(*[F.col(f"__i{i}").cast("string") for i in several]).isNotNull())
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, *names]]
    joined = work.withColumns(local).alias("l").join(incoming.alias("r"), on, "left")
    out = [F.coalesce(f"l.__l{i}", f"r.__i{i}").alias(n) for i, n in enumerate(values)]
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *out)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    blocks: list[Column] | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before each row."""
    blocks = blocks or []
    names = _named(blocks, 0)
    work = df.withColumns({**dict(zip(names, blocks)), "__v": value})
    inner = W.partitionBy(*keys, *names).orderBy(*[F.col(c) for c in order]).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    local = F.coalesce(F.sum("__v").over(inner), F.lit(0))
    if not blocks:
        return work.withColumn(out, local).drop("__v")
    totals = work.groupBy(*keys, *names).agg(F.sum("__v").alias("__t"))
    outer = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(outer), F.lit(0))).drop("__t")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, *names]]
    return (
        work.withColumn("__local", local)
        .alias("l")
        .join(before.alias("r"), on, "left")
        .select("l.*", (F.col("l.__local") + F.col("r.__before")).alias(out))
        .drop("__local", "__v", *names)
    )


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "n",
    blocks: list[Column] | None = None,
) -> DataFrame:
    """Add ``out``: 1-based position of each row in its key. The order must be total."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, blocks, inclusive=True)
