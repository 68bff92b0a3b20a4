"""How good extraction and redaction are, against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.amounts import parse_amount, parse_amount_bs, same_amount
from ..session import cut

# boxes that overlap share a tile of the page; tiles bound the pairs that are compared
_TILES_X, _TILES_Y = 4, 64


def score_fields(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth rows with ``correct`` and ``got`` (JOI12, AGG6, AGG7).

    ``truth``: doc_id, field, expected (text), expected_basis (income only); ``predicted``:
    one row per document with the field columns. Lists: each truth value must be in the
    extracted list. Amounts: within a cent; income also needs its basis. Texts: one of the
    truth values of that field, counted once per document.
    """
    have = set(predicted.columns)
    texts = [k for k in ["name", "address", "bsb", "account_number"] if k in have]
    lists = [k for k in V.LIST_KEYS if k in have]
    totals = [k for k in V.BALANCE_KEYS if k in have]
    joined = truth.join(predicted.select("doc_id", *[c for c in predicted.columns if c != "doc_id"]), "doc_id", "left")
    field, expected = F.col("field"), F.col("expected")
    correct, got = F.when(F.lit(False), False), F.when(F.lit(False), "")
    for k in texts:
        correct = correct.when(field == k, F.col(k) == expected)
        got = got.when(field == k, F.col(k))
    for k in lists:
        correct = correct.when(field == k, F.array_contains(k, expected))
        got = got.when(field == k, F.array_join(k, ", "))
    for k in totals:
        correct = correct.when(field == k, same_amount(F.col(k), parse_amount_bs(expected)))
        got = got.when(field == k, F.col(k).cast("string"))
    if "income" in have:
        basis = F.col("income_basis") == F.col("expected_basis") if "expected_basis" in truth.columns else F.lit(True)
        correct = correct.when(field == "income", same_amount(F.col("income"), parse_amount(expected)) & basis)
        got = got.when(field == "income", F.col("income").cast("string"))
    if "annual_salary" in have:
        correct = correct.when(field == "annual_salary", same_amount(F.col("annual_salary"), parse_amount(expected)))
        got = got.when(field == "annual_salary", F.col("annual_salary").cast("string"))
    scored = joined.select(
        "doc_id", "field", "expected", F.coalesce(correct, F.lit(False)).alias("correct"), got.alias("got")
    )
    is_list = F.col("field").isin(V.LIST_KEYS)
    singles = (
        scored.filter(~is_list)
        .groupBy("doc_id", "field")
        .agg(
            F.min("expected").alias("expected"), F.bool_or("correct").alias("correct"), F.first("got").alias("got")
        )
    )
    return scored.filter(is_list).unionByName(singles)


def misses(scored: DataFrame) -> DataFrame:
    return scored.filter(~F.col("correct"))


def unanswered(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth of documents with no prediction at all (JOI12)."""
    return truth.join(predicted.select("doc_id"), "doc_id", "left_anti")


def percent(correct: Column, total: Column) -> Column:
    """``100*c/t`` with one decimal and a sign, ``n/a`` without truth (AGG4)."""
    share = F.try_divide(correct * F.lit(100.0), total)
    # a NULL argument is printed, not passed on
    return F.when(share.isNotNull(), F.concat(F.format_string("%.1f", F.bround(share, 1)), F.lit("%"))).otherwise("n/a")


def accuracy(scored: DataFrame) -> DataFrame:
    """Correct, total and percentage per field and overall (``field`` NULL) in one pass
    (AGG4, AGG5)."""
    return (
        scored.rollup("field")
        .agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
        .withColumn("pct", percent(F.col("correct"), F.col("total")))
    )


def report_lines(scored: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``ord, key, line`` of the accuracy report (SNK2): header, one line per field, the
    overall line, then every miss. Order by ``ord, key`` when writing. ``fields`` are shown in
    their order, ``n/a`` where there is no truth; without them the fields found, by name."""
    table = accuracy(scored)
    if fields is not None:
        asked = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(f).alias("field")) for i, f in enumerate(fields)]))
        listed = scored.sparkSession.range(1).select(asked.alias("a")).select("a.at", "a.field")
        counted = listed.join(table.filter(F.col("field").isNotNull()), "field", "left").na.fill(0, ["correct", "total"])
        counted = counted.withColumn("pct", percent(F.col("correct"), F.col("total")))
        shown = counted.withColumn("key", F.lpad(F.col("at").cast("string"), 4, "0"))
    else:
        shown = table.filter(F.col("field").isNotNull()).withColumn("key", F.col("field"))
    counts = F.format_string("%3d / %3d  (%s)", "correct", "total", "pct")
    per_field = shown.select(
        F.lit(2).alias("ord"), "key",
        F.concat(F.lit("  "), F.rpad("field", 15, " "), F.lit(": "), counts).alias("line"),
    )
    overall = table.filter(F.col("field").isNull()).select(
        F.lit(3).alias("ord"), F.lit("").alias("key"),
        F.concat(
            F.lit("Overall: "), F.col("correct").cast("string"), F.lit(" / "), F.col("total").cast("string"),
            F.lit("  ("), F.col("pct"), F.lit(")"),
        ).alias("line"),
    )
    head = scored.select("doc_id").distinct().agg(F.count("*").alias("n")).select(
        F.lit(0).alias("ord"), F.lit("").alias("key"),
        F.concat(F.lit("Documents scored: "), F.col("n").cast("string")).alias("line"),
    )
    missed = misses(scored)
    miss_head = missed.agg(F.count("*").alias("n")).select(
        F.lit(4).alias("ord"), F.lit("").alias("key"),
        F.concat(F.lit("Misses ("), F.col("n").cast("string"), F.lit("):")).alias("line"),
    )
    miss_rows = missed.select(
        F.lit(5).alias("ord"),
        F.concat_ws(" ", F.col("doc_id").cast("string"), "field", "expected").alias("key"),
        F.concat(
            F.lit("  "), F.col("doc_id").cast("string"), F.lit(" field="), F.col("field"), F.lit(" expected="),
            F.col("expected"), F.lit(" got="), F.coalesce("got", F.lit("None")),
        ).alias("line"),
    )
    return head.unionByName(per_field).unionByName(overall).unionByName(miss_head).unionByName(miss_rows)


def write_report(scored: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Write the report as text, in order, by as many tasks as it needs."""
    # counted, listed and sampled for its order: scored once
    report_lines(cut(scored), fields).orderBy("ord", "key").select("line").write.mode("overwrite").text(path)


def doc_groups(files: DataFrame) -> DataFrame:
    """Documents and pages behind page-image names like ``scan_p0.png`` (AGG12)."""
    shape = r"^(.+)_p(\d+)\.[A-Za-z0-9]+$"
    pages = files.select(
        F.regexp_extract("filename", shape, 1).alias("doc"), F.regexp_extract("filename", shape, 2).alias("page")
    ).filter(F.col("doc") != "")
    per_doc = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    return per_doc.agg(F.count("*").alias("documents"), F.sum("pages").alias("page_images"))


def iou(a: str, b: str) -> Column:
    """Shared area of two percent boxes over their joint area, 0 when that is empty."""

    def side(p: str) -> tuple[Column, ...]:
        x, y = F.col(f"{p}.x_pct"), F.col(f"{p}.y_pct")
        w, h = F.col(f"{p}.w_pct"), F.col(f"{p}.h_pct")
        return x, y, x + w, y + h, w * h

    ax1, ay1, ax2, ay2, aa = side(a)
    bx1, by1, bx2, by2, ba = side(b)
    shared = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(
        F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1)
    )
    joint = aa + ba - shared
    return F.when(joint > 0, shared / joint).otherwise(0.0)


#: Up to this many predictions a document and field are compared as they are.
_DENSE = 64


def _tile(df: DataFrame) -> DataFrame:
    """A row for each tile that a box of a dense key touches, one row for other boxes;
    ``fx, fy`` is the box's first tile."""

    def first(lo: Column, n: int) -> Column:
        return F.least(F.greatest(F.floor(lo * n), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))

    def span(name: str, lo: Column, size: Column, n: int) -> DataFrame:
        low = F.when(F.col("dense"), first(lo, n)).otherwise(F.lit(0).cast("long"))
        high = F.when(F.col("dense"), F.greatest(first(lo + size, n), low)).otherwise(low)
        return low.alias(f"f{name}"), F.sequence(low, high).alias(f"s{name}")

    spans = [*span("x", F.col("x_pct"), F.col("w_pct"), _TILES_X), *span("y", F.col("y_pct"), F.col("h_pct"), _TILES_Y)]
    wide = df.select("*", *spans).withColumn("tx", F.explode("sx"))
    return wide.withColumn("ty", F.explode("sy")).drop("sx", "sy", "dense")


def score_boxes(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Best IoU of every truth box with the predictions of its document and field; a hit
    needs 0.5, no overlapping prediction gives 0 (JOI13).

    Boxes meet on document and field, a handful of them. Only where a field has very many
    predictions do they meet on tiles of the page, and a pair counts in its first shared tile.

    ``truth``: doc_id, field, box_idx and percentages; ``predicted``: doc_id, field and
    percentages.
    """
    key = ["doc_id", "field"]
    many = predicted.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > _DENSE).select(*key, F.lit(True).alias("dense"))

    def tiled(df: DataFrame) -> DataFrame:
        return _tile(df.join(many, key, "left").withColumn("dense", F.coalesce("dense", F.lit(False))))

    sides = {"t": tiled(truth), "p": tiled(predicted.select(*key, "x_pct", "y_pct", "w_pct", "h_pct"))}
    on = [F.col(f"t.{k}") == F.col(f"p.{k}") for k in [*key, "tx", "ty"]]
    once = (F.col("t.tx") == F.greatest("t.fx", "p.fx")) & (F.col("t.ty") == F.greatest("t.fy", "p.fy"))
    best = (
        sides["t"].alias("t").join(sides["p"].alias("p"), on).filter(once)
        .groupBy("t.doc_id", "t.field", "t.box_idx")
        .agg(F.max(iou("t", "p")).alias("best_iou"))
    )
    scored = truth.select(*key, "box_idx").join(best, [*key, "box_idx"], "left")
    return scored.withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0))).withColumn(
        "correct", F.col("best_iou") >= V.IOU_HIT
    )


def box_accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Box hits per field and overall (RED8)."""
    return accuracy(score_boxes(truth, predicted))
