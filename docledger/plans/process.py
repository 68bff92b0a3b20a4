"""The whole reading chain: files and their text, rows and lines to one result per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.extract_au import FIELD_TYPES, hit_columns, pay_period_error, suppress_salary, with_hits, with_text_fields
from ..functions.validation import route
from ..operators.balance import cross_check, first_page_wins, missing_fields, read_pages
from ..operators.geometry import recover_rows, repair_split, sensitive_boxes, to_composite
from ..operators.merge import assemble_result, doc_quality, merge_pages
from ..operators.spans import sensitive_spans
from ..session import cut

REDACTION = (
    "struct<type:string,items:array<struct<field:string,value:string,start:int,end:int,"
    "x_pct:double,y_pct:double,w_pct:double,h_pct:double,detection_method:string>>>"
)


def field_columns() -> dict[str, Column]:
    return {k: F.col(k) for k in FIELD_TYPES}


def read_text_documents(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Documents with their own text (``doc_id, text``) and, where they have tables, the
    totals found there: fields, cross-check, spans."""
    hits = hit_columns()
    out = with_text_fields(with_hits(docs), hits=hits).withColumn("error", pay_period_error(F.col("text")))
    totals = first_page_wins(read_pages(rows)) if rows is not None else None
    if totals is not None:
        out = out.join(totals, "doc_id", "left")
    else:
        out = out.withColumns({k: F.lit(None).cast("double") for k in V.BALANCE_KEYS})
    out = suppress_salary(cross_check(out))
    spans = sensitive_spans(F.col("text"), field_columns(), hits)
    items = F.transform(
        spans,
        lambda s: F.struct(
            s["field"].alias("field"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"),
            *[F.lit(None).cast("double").alias(k) for k in ("x_pct", "y_pct", "w_pct", "h_pct")],
            s["detection_method"].alias("detection_method"),
        ),
    )
    return out.withColumn("redaction", F.struct(F.lit("spans").alias("type"), items.alias("items")).cast(REDACTION)).drop(*[c for c in out.columns if c.startswith("__hits_")])


def read_scanned_pages(
    pages: DataFrame, lines: DataFrame, rows: DataFrame, frags: DataFrame
) -> DataFrame:
    """Fields of each recognised page (``doc_id, page, text``): text fields, table totals,
    values on other lines, totals of lost rows."""
    out = with_text_fields(pages).withColumn("error", pay_period_error(F.col("text")))
    # each step below reads its input more than once
    out = cut(suppress_salary(out.join(read_pages(rows), ["doc_id", "page"], "left")))
    out = cut(repair_split(out, lines))
    missing = out.select("doc_id", "page", F.explode(missing_fields(out)).alias("field"))
    found = recover_rows(frags, missing)
    wide = found.groupBy("doc_id", "page").agg(
        *[F.max(F.when(F.col("field") == k, F.col("value"))).alias(f"__{k}") for k in V.BALANCE_KEYS]
    )
    return (
        out.join(wide, ["doc_id", "page"], "left")
        .withColumns({k: F.coalesce(F.col(k), F.col(f"__{k}")) for k in V.BALANCE_KEYS})
        .drop(*[f"__{k}" for k in V.BALANCE_KEYS])
    )


def read_scanned_documents(
    pages: DataFrame, lines: DataFrame, rows: DataFrame, frags: DataFrame,
    cells: DataFrame, words: DataFrame, word_pages: DataFrame, geom: DataFrame,
) -> DataFrame:
    """Scanned documents: page fields merged, boxes in the coordinates of the stacked pages,
    worst page quality. ``word_pages``: doc_id, page, text of the word reconstruction."""
    page_fields = cut(read_scanned_pages(pages, lines, rows, frags))
    merged = merge_pages(page_fields)
    errors = page_fields.groupBy("doc_id").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error")
    )
    boxed = word_pages.join(page_fields.drop("text"), ["doc_id", "page"])
    boxes = to_composite(sensitive_boxes(boxed, words, geom, cells, frags), geom)
    item = F.struct(
        "field", "value", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
        "x_pct", "y_pct", "w_pct", "h_pct", "detection_method",
    )
    redaction = boxes.groupBy("doc_id").agg(
        F.struct(
            F.lit("boxes").alias("type"),
            F.transform(F.array_sort(F.collect_list(F.struct("page", "y_pct", "x_pct", item.alias("item")))), lambda b: b["item"]).alias("items"),
        ).alias("redaction")
    )
    quality = doc_quality(geom).select(
        "doc_id", F.struct("blur_score", "contrast_score", "low_quality").alias("quality")
    )
    empty = F.struct(F.lit("boxes").alias("type"), F.array().alias("items")).cast(REDACTION)
    return (
        merged.join(errors, "doc_id", "left")
        .join(redaction, "doc_id", "left")
        .withColumn("redaction", F.coalesce(F.col("redaction").cast(REDACTION), empty))
        .join(quality, "doc_id", "left")
    )


def process_documents(
    files: DataFrame,
    text_docs: DataFrame,
    rows: DataFrame | None = None,
    scanned: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, ai_result`` for every file.

    ``files``: doc_id, filename, text_len and optionally repayment, existing_debt;
    ``text_docs``: doc_id, text; ``scanned``: what ``read_scanned_documents`` returns.
    Files are routed first; each branch reads only its own documents.
    """
    routed = files.withColumn("__r", route(F.col("filename"), F.col("text_len"))).withColumns(
        {"processing_path": F.col("__r.path"), "route_error": F.col("__r.error")}
    ).drop("__r")
    native = routed.filter(F.col("processing_path") == "text_native").select("doc_id")
    read = read_text_documents(
        text_docs.join(native, "doc_id", "left_semi"),
        None if rows is None else rows.join(native, "doc_id", "left_semi"),
    ).select("doc_id", *FIELD_TYPES, "redaction", "error")
    read = read.withColumn("quality", F.lit(None).cast("struct<blur_score:double,contrast_score:double,low_quality:boolean>"))
    if scanned is not None:
        read = read.unionByName(scanned.select("doc_id", *FIELD_TYPES, "redaction", "error", "quality"))
    out = routed.join(read, "doc_id", "left").withColumns(
        {
            "failed": F.col("processing_path").isNull() | F.col("redaction").isNull(),
            "error": F.coalesce(
                F.col("route_error"), F.col("error"),
                F.when(F.col("redaction").isNull(), "no text was read from this document"),
            ),
        }
    )
    return assemble_result(out).select("doc_id", "ai_result")


