"""Loan and balance-sheet readiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import let


def monthly_income(income: Column, annual_salary: Column, days: Column) -> Column:
    """``(amount, source)``: income per month from a yearly salary or a pay period (RUL1)."""

    def within(span: tuple[int, int]) -> Column:
        return days.between(*span)

    amount = (
        F.when(annual_salary.isNotNull(), annual_salary / 12.0)
        .when(days.isNull(), income)
        .when(within(V.WEEKLY_DAYS), income * F.lit(52 / 12))
        .when(within(V.FORTNIGHTLY_DAYS), income * F.lit(26 / 12))
        .when(within(V.MONTHLY_DAYS), income)
    )
    known_period = within(V.WEEKLY_DAYS) | within(V.FORTNIGHTLY_DAYS) | within(V.MONTHLY_DAYS)
    source = (
        F.when(annual_salary.isNotNull(), "annual_salary")
        .when(income.isNull(), "insufficient_data")
        .when(days.isNull(), "already_monthly")
        .when(known_period, "period_gross")
        .otherwise("insufficient_data")
    )
    return F.struct(amount.alias("amount"), source.alias("source"))


def _check(passed: Column | None, value: Column | None, threshold: float) -> Column:
    return F.struct(
        (F.lit(None).cast("boolean") if passed is None else passed).alias("pass"),
        (F.lit(None).cast("double") if value is None else value).alias("value"),
        F.lit(float(threshold)).alias("threshold"),
    )


def loan_readiness(monthly: Column, basis: Column, repayment: Column, debt: Column, source: Column) -> Column:
    """Verdict and checks for a proposed repayment; NULL when none is proposed (RUL2)."""

    def judge(income: Column) -> Column:
        known = F.coalesce(income > 0, F.lit(False))
        share = F.try_divide(repayment, income)
        total = F.try_divide(F.coalesce(debt, F.lit(0.0)) + repayment, income)
        tests = {
            "min_income": (income >= V.MIN_MONTHLY_INCOME, income, V.MIN_MONTHLY_INCOME),
            "repayment_ratio": (share <= V.MAX_REPAYMENT_RATIO, share, V.MAX_REPAYMENT_RATIO),
            "dti": (total <= V.MAX_DTI_RATIO, total, V.MAX_DTI_RATIO),
        }
        all_pass = tests["min_income"][0] & tests["repayment_ratio"][0] & tests["dti"][0]
        entries: list[Column] = []
        for name, (passed, value, threshold) in tests.items():
            entries += [F.lit(name), _check(F.when(known, passed), F.when(known, value), threshold)]
        return F.struct(
            F.when(~known, "INSUFFICIENT_DATA").when(all_pass, "READY").otherwise("NOT_READY").alias("verdict"),
            basis.alias("income_basis"),
            source.alias("income_source"),
            debt.isNull().alias("existing_debt_assumed_zero"),
            F.create_map(*entries).alias("checks"),
        )

    return F.when(repayment.isNotNull(), let(monthly, judge))


def balance_readiness(
    current_assets: Column, current_liabilities: Column, liabilities: Column, equity: Column
) -> Column:
    """Verdict and checks from balance-sheet totals; unknown checks are left out of the
    verdict (RUL3)."""
    has_ratio = current_assets.isNotNull() & current_liabilities.isNotNull()
    has_debt = liabilities.isNotNull() & equity.isNotNull()
    ratio = F.try_divide(current_assets, current_liabilities)
    debt = F.try_divide(liabilities, equity)
    ratio_pass = F.when(has_ratio, F.coalesce(ratio >= V.MIN_CURRENT_RATIO, F.lit(False)))
    debt_pass = F.when(has_debt, (equity > 0) & F.coalesce(debt <= V.MAX_DEBT_TO_EQUITY, F.lit(False)))
    verdict = (
        F.when(~has_ratio & ~has_debt, "INSUFFICIENT_DATA")
        .when(F.coalesce(ratio_pass, F.lit(True)) & F.coalesce(debt_pass, F.lit(True)), "READY")
        .otherwise("NOT_READY")
    )
    return F.struct(
        verdict.alias("verdict"),
        F.create_map(
            F.lit("current_ratio"), _check(ratio_pass, F.when(has_ratio, ratio), V.MIN_CURRENT_RATIO),
            F.lit("debt_to_equity"), _check(debt_pass, F.when(has_debt, debt), V.MAX_DEBT_TO_EQUITY),
        ).alias("checks"),
    )
