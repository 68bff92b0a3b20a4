"""Field extraction from Vietnamese contracts and payslips."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .amounts import parse_vnd
from .cleaning import clean_value, strip_diacritics
from .extract_au import first_accepted
from .text import find_all, first_not_null, let, strip


def minus_keep_dups(a: Column, b: Column) -> Column:
    """Elements of ``a`` not in ``b``, duplicates kept (SET2)."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def vn_regex_fields(text: Column) -> dict[str, Column]:
    """``cccd, phone, tax_code, dates, salary`` (EXV1); a phone number is no tax code."""
    phone = find_all(text, V.VN_PHONE)
    return {
        "cccd": find_all(text, V.CCCD),
        "phone": phone,
        "tax_code": let(phone, lambda p: minus_keep_dups(find_all(text, V.TAX_CODE), p)),
        "dates": find_all(text, V.DATE),
        "salary": find_all(text, V.VN_SALARY),
    }


def vn_label_fields(text: Column) -> dict[str, Column]:
    """Name, address and bank account; the value is the rest of the line (EXV2)."""
    return {k: first_accepted(text, p, "vn") for k, p in V.VN_LABELS.items()}


def vn_income(text: Column) -> Column:
    """``(amount, basis)``, gross before net (EXV4)."""

    def first(basis: str) -> Column:
        return first_not_null(
            F.transform(find_all(text, V.VN_INCOME[basis], 1), lambda v: parse_vnd(clean_value(v, "vn")))
        )

    def pick(p: Column) -> Column:
        return F.struct(
            F.coalesce(p["gross"], p["net"]).alias("amount"),
            F.when(p["gross"].isNotNull(), F.lit("gross")).when(p["net"].isNotNull(), F.lit("net")).alias("basis"),
        )

    return let(F.struct(first("gross").alias("gross"), first("net").alias("net")), pick)


def row_label_value(cells: Column, field: str) -> Column:
    """Value belonging to the first bare label cell of one table row: text after a colon
    in the cell, else the next cell (EXV3)."""

    def one(cell: Column, i: Column) -> Column:
        after = F.when(
            cell.contains(":"),
            clean_value(F.substring(cell, F.position(F.lit(":"), cell) + 1, F.length(cell)), "vn"),
        )
        return F.when(
            (strip(cell) != "") & cell.rlike(V.VN_BARE_LABELS[field]),
            F.coalesce(after, clean_value(F.get(cells, i + 1), "vn")),
        )

    return first_not_null(F.transform(cells, one))


def vn_cells(rows: DataFrame) -> DataFrame:
    """First label value per document over table rows, in (page, row) order (EXV3)."""
    found = rows.select(
        "doc_id",
        F.struct("page", "row_idx").alias("at"),
        *[row_label_value(F.col("cells"), f).alias(f) for f in V.VN_BARE_LABELS],
    ).filter(F.coalesce(*[F.col(f) for f in V.VN_BARE_LABELS]).isNotNull())
    firsts = [
        F.min_by(F.struct(F.col(f).alias("v")), F.when(F.col(f).isNotNull(), F.col("at")))["v"].alias(f)
        for f in V.VN_BARE_LABELS
    ]
    return found.groupBy("doc_id").agg(*firsts)


def _surname_map() -> Column:
    pairs: list[Column] = []
    for name in V.VN_SURNAMES:
        flat = unicodedata.normalize("NFD", name.replace("Đ", "D").replace("đ", "d"))
        key = "".join(ch for ch in flat if not unicodedata.combining(ch)).lower()
        pairs += [F.lit(key), F.lit(name)]
    return F.create_map(*pairs)


def restore_surname(c: Column) -> Column:
    """Give known surnames their marks back, word by word (EXV5)."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    lookup = _surname_map()
    fixed = F.transform(words, lambda w: F.coalesce(F.try_element_at(lookup, F.lower(strip_diacritics(w))), w))
    return F.when(F.length(c) > 0, F.array_join(fixed, " ")).otherwise(c)


def with_vn_fields(docs: DataFrame, rows: DataFrame | None = None, text: str = "text") -> DataFrame:
    """All Vietnamese fields of each document; table cells fill only what text missed."""
    c = F.col(text)
    out = docs.withColumns({**vn_regex_fields(c), **vn_label_fields(c), "__income": vn_income(c)})
    if rows is not None:
        cells = vn_cells(rows).select("doc_id", *[F.col(f).alias(f"__{f}") for f in V.VN_BARE_LABELS])
        out = out.join(cells, "doc_id", "left")
        out = out.withColumns(
            {f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in V.VN_BARE_LABELS}
        ).drop(*[f"__{f}" for f in V.VN_BARE_LABELS])
    return out.withColumns(
        {
            "name": restore_surname(F.col("name")),
            "income": F.col("__income.amount"),
            "income_basis": F.col("__income.basis"),
        }
    ).drop("__income")
