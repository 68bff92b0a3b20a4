"""From pages to documents, and the assembled result of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.extract_au import FIELD_TYPES
from .balance import needs_balance_check
from .rules import balance_readiness, loan_readiness, monthly_income
from .spans import sensitive_keys


def _in_page_order(key: str) -> Column:
    pairs = F.collect_list(F.when(F.size(key) > 0, F.struct(F.col("page"), F.col(key).alias("v"))))
    return F.coalesce(
        F.flatten(F.transform(F.array_sort(pairs), lambda p: p["v"])), F.array().cast("array<string>")
    )


def merge_pages(pages: DataFrame, mode: str = "live") -> DataFrame:
    """One row per document from one row per page (AGG1).

    Lists concatenate in page order; other fields take the first page with a value; income
    and its basis move together. ``mode="bench"`` (AGG2) treats ``''`` as missing and takes
    income and basis separately.
    """
    keys = [k for k in FIELD_TYPES if k in pages.columns]
    lists = [k for k in keys if FIELD_TYPES[k].startswith("array")]
    paired = mode == "live" and "income" in keys
    scalars = [k for k in keys if k not in lists and not (paired and k in ("income", "income_basis"))]

    def present(k: str) -> Column:
        filled = F.col(k).isNotNull()
        return filled & (F.col(k) != "") if mode == "bench" and FIELD_TYPES[k] == "string" else filled

    aggs = [_in_page_order(k).alias(k) for k in lists]
    aggs += [F.min_by(k, F.when(present(k), F.col("page"))).alias(k) for k in scalars]
    if paired:
        aggs.append(
            F.min_by(
                F.struct("income", "income_basis"), F.when(F.col("income").isNotNull(), F.col("page"))
            ).alias("__income")
        )
    out = pages.groupBy("doc_id").agg(*aggs)
    if paired:
        out = out.withColumns(
            {"income": F.col("__income.income"), "income_basis": F.col("__income.income_basis")}
        ).drop("__income")
    return out


def low_quality(blur: Column, contrast: Column) -> Column:
    return (blur < V.MIN_BLUR) | (contrast < V.MIN_CONTRAST)


def doc_quality(pages: DataFrame) -> DataFrame:
    """Worst blur and contrast of a document's pages, and whether any page is poor (AGG3)."""
    return pages.groupBy("doc_id").agg(
        F.min("blur_score").alias("blur_score"),
        F.min("contrast_score").alias("contrast_score"),
        F.bool_or("low_quality").alias("low_quality"),
    )


def has_any_total(df: DataFrame) -> Column:
    return F.coalesce(*[F.col(k) for k in V.BALANCE_KEYS if k in df.columns]).isNotNull()


def any_list_filled(df: DataFrame) -> Column:
    """Any list field has an element (AGG11)."""
    cond = F.lit(False)
    for k in V.LIST_KEYS:
        cond = cond | (F.size(k) > 0)
    return cond


def assemble_result(docs: DataFrame) -> DataFrame:
    """Add ``ai_result`` (RUL5).

    Input: one row per document with ``processing_path``, the field columns, ``redaction``
    (struct of type and items), and optionally ``quality``, ``error``, ``repayment`` and
    ``existing_debt``. A document with an extraction ``error`` and no fields keeps only its
    path and error; rules never fail a row because their arithmetic cannot raise.
    """

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in docs.columns else F.lit(None).cast(kind)

    failed = col("failed", "boolean")
    failed = F.coalesce(failed, F.lit(False))
    fields = F.struct(*[col(k, t).cast(t).alias(k) for k, t in FIELD_TYPES.items()])
    month = monthly_income(col("income", "double"), col("annual_salary", "double"), col("pay_period_days", "int"))
    loan = loan_readiness(
        month["amount"], col("income_basis", "string"), col("repayment", "double"),
        col("existing_debt", "double"), month["source"],
    )
    totals = {k: col(k, "double") for k in V.BALANCE_KEYS}
    balance = F.when(
        needs_balance_check(docs.withColumns({k: c for k, c in totals.items()})),
        balance_readiness(
            totals["total_current_assets"], totals["total_current_liabilities"],
            totals["total_liabilities"], totals["total_equity"],
        ),
    )
    result = F.struct(
        F.col("processing_path").alias("processing_path"),
        F.when(~failed, fields).alias("fields"),
        F.when(~failed, F.col("redaction")).alias("redaction"),
        F.when(~failed, loan).alias("loan_readiness"),
        F.when(~failed, balance).alias("balance_sheet_readiness"),
        F.when(
            ~failed,
            col("quality", "struct<blur_score:double,contrast_score:double,low_quality:boolean>"),
        ).alias("quality"),
        F.when(failed, F.array().cast("array<string>")).otherwise(sensitive_keys()).alias("sensitive_field_keys"),
        col("error", "string").alias("error"),
    )
    missing = {k: c for k, c in totals.items() if k not in docs.columns}
    return docs.withColumns(missing).withColumn("ai_result", result) if missing else docs.withColumn("ai_result", result)
