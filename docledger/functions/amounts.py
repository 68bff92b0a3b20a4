"""Amount parsers. A text without an amount gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import despace, let

def _number(text: Column, drop: str) -> Column:
    return F.nullif(F.regexp_replace(text, drop, ""), F.lit("")).try_cast("double")


def parse_amount(c: Column) -> Column:
    """Payslip amount: first grouped or bare run of digits, optional cents; signs are
    not read (PAR1)."""
    return _number(F.regexp_extract(c, V.AMOUNT, 0), ",")


def parse_amount_bs(c: Column) -> Column:
    """Balance-sheet amount (PAR2): blanks are dropped, prose is refused, text before a
    ``$`` is ignored and dots may group thousands."""

    def from_dollar(v: Column) -> Column:
        return F.when(v.contains("$"), F.substring(v, F.position(F.lit("$"), v), F.length(v))).otherwise(v)

    def read(v: Column) -> Column:
        dotted = F.replace(F.regexp_extract(v, V.PERIOD_THOUSANDS, 0), F.lit("."), F.lit(""))
        dotted_amount = F.concat(
            F.substring(dotted, F.lit(1), F.length(dotted) - 2), F.lit("."), F.right(dotted, F.lit(2))
        ).try_cast("double")
        return F.when(v.rlike(V.PERIOD_THOUSANDS), dotted_amount).otherwise(
            _number(F.regexp_extract(v, V.BALANCE_AMOUNT, 0), "[, ]")
        )

    return let(despace(c), lambda v: F.when(~v.rlike("[A-Za-z]{2,}"), let(from_dollar(v), read)))


def parse_vnd(c: Column) -> Column:
    """Dong amount: dots and commas both group thousands (PAR3)."""
    return _number(F.regexp_extract(c, V.VN_AMOUNT, 0), "[.,]")


def same_amount(a: Column, b: Column) -> Column:
    """Equal within one cent; false when either is missing (AGG7)."""
    return F.coalesce(F.abs(a - b) < V.MONEY_TOLERANCE, F.lit(False))
