"""Sorting, paging and top-n for documents, audit entries, users and departments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import cut


def locale_key(c: Column) -> Column:
    """Ordering of a reader's locale: ``a < A < b``."""
    return F.collate(F.coalesce(c, F.lit("")), "UNICODE")


def numeric_key(c: Column) -> Column:
    """Locale ordering where runs of digits compare as numbers: ``a2 < a10``."""
    runs = F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))

    def key(run: Column) -> Column:
        bare = F.regexp_replace(run, "^0+", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare).cast("string"), 9, "0"), bare)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, key), ""), "UNICODE")


def _moment(c: Column) -> Column:
    return F.coalesce(c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _orders(sort: str, keys: dict[str, Column], tie: Column) -> list[Column]:
    """``[]`` for an unknown sort: the input order stays."""
    name, _, way = sort.partition("-")
    if name not in keys or way not in ("asc", "desc"):
        return []
    return [keys[name].asc() if way == "asc" else keys[name].desc(), tie.asc()]


def document_order(sort: str = "date-desc") -> list[Column]:
    """``date|id|name`` - ``asc|desc`` over documents (SOR1)."""
    keys = {"date": _moment(F.col("uploaded_at")), "id": locale_key(F.col("id")), "name": locale_key(F.col("name"))}
    return _orders(sort, keys, F.col("id"))


def audit_order(sort: str = "date-desc") -> list[Column]:
    """The same orders over audit entries, ids compared as numbers (SOR2)."""
    keys = {
        "date": _moment(F.col("ts")), "id": numeric_key(F.col("user_id")), "name": locale_key(F.col("name")),
    }
    return _orders(sort, keys, F.col("seq"))


def admin_order(sort: str = "date-desc") -> list[Column]:
    """The same orders over users or departments (SOR3)."""
    keys = {
        "date": _moment(F.col("created_at")), "id": numeric_key(F.col("id")), "name": locale_key(F.col("name")),
    }
    return _orders(sort, keys, F.col("id"))


def sort_documents(df: DataFrame, sort: str = "date-desc") -> DataFrame:
    order = document_order(sort)
    return df.orderBy(*order) if order else df


def sort_audit(df: DataFrame, sort: str = "date-desc") -> DataFrame:
    order = audit_order(sort)
    return df.orderBy(*order) if order else df


def sort_admin(df: DataFrame, sort: str = "date-desc") -> DataFrame:
    order = admin_order(sort)
    return df.orderBy(*order) if order else df


def clamp_limit(n: int) -> int:
    """A requested number of rows between 0 and the audit capacity (SOR5)."""
    return max(0, min(n, V.AUDIT_CAPACITY))


def newest_n(df: DataFrame, n: int = V.AUDIT_CAPACITY) -> DataFrame:
    """The newest entries (WIN10): a distributed top-k, ties by arrival."""
    return df.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)


def feed(notifications: DataFrame, receiver_id: str) -> DataFrame:
    """A receiver's notifications, newest first (SOR4)."""
    return notifications.filter(F.col("receiver_id") == receiver_id).orderBy(
        F.col("created_at").desc(), F.col("id").asc()
    )


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``position`` (0-based) of every row in an order over the whole table.

    The table is range-partitioned on the order itself and sorted inside each range; one
    count for each range gives the positions before it. The sorted rows are written once,
    as ranges are sampled anew each time a plan runs.
    """
    # the id holds the range in its upper bits and the row's number in its range below
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each range: the only step without a key
    before = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select(
        "__part",
        F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    joined = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.select(*df.columns, (local + F.col("__before")).alias("position"))


def page_info(total: int, page: int, size: int = V.PAGE_SIZE) -> dict:
    """Clamped page number and the ``start-end of n`` label (WIN11)."""
    pages = max(-(-total // size), 1)
    page = min(max(page, 1), pages)
    start = 0 if total == 0 else (page - 1) * size + 1
    end = min(page * size, total)
    return {"page": page, "pages": pages, "total": total, "label": f"{start}–{end} of {total}"}


def paginate(
    df: DataFrame, order: list[Column], page: int = 1, size: int = V.PAGE_SIZE, deep: bool = False
) -> DataFrame:
    """One page of an ordered table (WIN11). The page number is taken as given; clamp it
    with ``page_info`` where the total is known.

    A page is a top-k, which holds the rows before it at the driver. ``deep`` takes it from
    the numbered table instead: the same rows, for pages far down a large table.
    """
    offset = (page - 1) * size
    if deep:
        rows = numbered(df, order)
        return rows.filter(F.col("position").between(offset, offset + size - 1)).orderBy("position").drop("position")
    return df.orderBy(*order).offset(offset).limit(size)


def page_summary(df: DataFrame, size: int = V.PAGE_SIZE) -> DataFrame:
    """``total, pages`` as one row (WIN11)."""
    n = F.count("*")
    return df.agg(
        n.alias("total"), F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("long").alias("pages")
    )


def page_of(df: DataFrame, row_id: str, size: int = V.PAGE_SIZE) -> DataFrame:
    """Page of one document in the default order, newest first (WIN12).

    Counts the rows that sort before it: one scan with partial counts, no sort. No row when
    the id is absent.
    """
    target = df.filter(F.col("id") == row_id).select(_moment(F.col("uploaded_at")))
    at = target.scalar()
    moment = _moment(F.col("uploaded_at"))
    before = (moment > at) | ((moment == at) & (F.col("id") < row_id))
    return df.agg(
        F.count_if(before).alias("before"), F.count_if(F.col("id") == row_id).alias("present")
    ).filter(F.col("present") > 0).select((F.floor(F.col("before") / size) + 1).cast("long").alias("page"))


def unread_counts(notifications: DataFrame) -> DataFrame:
    """Unread notifications per receiver (AGG8)."""
    return notifications.groupBy("receiver_id").agg(F.count_if(~F.col("has_read")).alias("unread"))
