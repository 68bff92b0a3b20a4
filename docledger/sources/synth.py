"""Deterministic synthetic documents with known truth, and a seed organisation.

Every value is a hash of (seed, document, purpose), so any part of the corpus can be
recomputed alone, on any executor, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V

KINDS = ["contract", "payslip", "balance_single", "balance_years"]
# names for generated people and streets; any list would do
_GIVEN = ["Amelia", "Oliver", "Charlotte", "Jack", "Isla", "Noah", "Mia", "Leo", "Grace", "Henry", "Ava", "Lucas"]
_FAMILY = ["Smith", "Nguyen", "Brown", "Wilson", "Taylor", "Singh", "Martin", "White", "Kelly", "Ross", "Chen", "Walker"]
_STREETS = ["Flinders St", "High Rd", "Station Ave", "Park Ln", "Church St", "Mill Ct"]
_TOWNS = ["Ballarat", "Geelong", "Cairns", "Hobart", "Dubbo", "Albany"]


class _Dice:
    """Hash-based draws for one seed."""

    def __init__(self, seed: int):
        self.seed = seed

    def number(self, salt: str, lo: int, hi: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.col("id"), F.lit(salt)), F.lit(hi - lo + 1)) + lo

    def pick(self, salt: str, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (self.number(salt, 1, len(values))).cast("int"))

    def name(self, salt: str) -> Column:
        return F.concat(self.pick(f"{salt}.given", _GIVEN), F.lit(" "), self.pick(f"{salt}.family", _FAMILY))

    def address(self, salt: str) -> Column:
        return F.concat(
            self.number(f"{salt}.no", 1, 400).cast("string"), F.lit(" "), self.pick(f"{salt}.street", _STREETS),
            F.lit(", "), self.pick(f"{salt}.town", _TOWNS), F.lit(" "), self.pick(f"{salt}.state", V.AU_STATES),
            F.lit(" "), self.number(f"{salt}.post", 1000, 9999).cast("string"),
        )

    def grouped(self, salt: str, parts: list[tuple[int, int]], sep: str) -> Column:
        return F.concat_ws(sep, *[self.number(f"{salt}.{i}", *p).cast("string") for i, p in enumerate(parts)])

    def dollars(self, salt: str) -> Column:
        return F.concat(F.lit("$"), F.format_number((self.number(salt, 1000, 90000) / 100).cast("decimal(12,2)"), 2))

    def thousands(self, salt: str) -> Column:
        return F.concat(F.lit("$"), F.format_number(self.number(salt, 30, 150) * 1000, 0))


def _corpus(ids: DataFrame, seed: int) -> tuple[DataFrame, _Dice]:
    dice = _Dice(seed)
    base = ids.select(F.col("id").cast("long").alias("id")).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("id") % len(KINDS) + 1).cast("int")))
    return base.withColumn("doc_id", F.concat(F.col("kind"), F.lit("-"), F.col("id").cast("string"))), dice


def _payslip_lines(d: _Dice) -> list[Column]:
    day = F.date_add(F.lit("2026-01-01").cast("date"), d.number("day", 0, 300).cast("int"))
    period = d.pick("period", ["6", "13", "30"]).cast("int")
    return [
        F.concat(F.lit("*Employer: "), d.name("employer"), F.lit(" Pty Ltd")),
        F.concat(F.lit("*ABN: "), d.grouped("abn", [(10, 99)] + [(100, 999)] * 3, " ")),
        F.concat(F.lit("*Employee: "), d.name("employee")),
        F.concat(F.lit("*Pay period: "), F.date_format(day, "dd/MM/yyyy"), F.lit(" to "), F.date_format(F.date_add(day, period), "dd/MM/yyyy")),
        F.concat(F.lit("*Annual salary: [if applicable] "), d.thousands("annual")),
        F.concat(F.lit("Ordinary hours "), d.number("hours", 10, 380).cast("string"), F.lit(" "), d.dollars("rate")),
        F.concat(F.lit("Total gross payment: "), d.dollars("gross")),
        F.concat(F.lit("NET PAY: "), d.dollars("net")),
        F.concat(F.lit("BSB: "), d.grouped("bsb", [(100, 999)] * 2, "-")),
        F.concat(F.lit("Account: "), d.grouped("account", [(1000, 9999)] * 2, " "), F.lit(" [This is the amount paid]")),
    ]


def _contract_lines(d: _Dice) -> list[Column]:
    return [
        F.lit("EMPLOYMENT CONTRACT"),
        F.concat(F.lit("Employer Name: "), d.name("employer")),
        F.concat(F.lit("Employer Address: "), d.address("employer")),
        F.lit("Employee Name: ____________"),
        F.concat(F.lit("Employee Name: "), d.name("employee")),
        F.lit("Employee Address: <insert employee address>"),
        F.concat(F.lit("Employee Address: "), d.address("employee")),
    ]


_TOTAL_LABELS = {
    "total_current_assets": "Total Current Assets", "total_assets": "TOTAL ASSETS",
    "total_current_liabilities": "Total Current Liabilities", "total_liabilities": "TOTAL LIABILITIES",
    "total_equity": "NET ASSETS (NET WORTH)",
}


def _single_rows(d: _Dice) -> Column:
    rows = [F.array(F.lit("Balance sheet"), F.lit(""))]
    rows += [F.array(F.lit(label), d.thousands(f"single.{k}")) for k, label in _TOTAL_LABELS.items()]
    return F.array(*rows)


def _years_rows(d: _Dice) -> Column:
    def values(k: str) -> list[Column]:
        return [d.thousands(f"years.{k}.{y}") for y in range(1, 6)]

    blank = [F.lit("")] * 5
    rows = [
        [F.lit(""), *[F.lit(f"[Year {y}]") for y in range(1, 6)]],
        [F.lit("Current assets"), *blank],
        [F.lit("Cash"), *values("cash")],
        [F.lit("Total"), *values("total_current_assets")],
        [F.lit("Fixed assets"), *blank],
        [F.lit("Total"), *values("fixed")],
        [F.lit("TOTAL ASSETS"), *values("total_assets")],
        [F.lit("Current/short-term liabilities"), *blank],
        [F.lit("Total"), *values("total_current_liabilities")],
        [F.lit("TOTAL LIABILITIES"), *values("total_liabilities")],
        [F.lit("NET ASSETS (NET WORTH)"), *values("total_equity")],
    ]
    return F.array(*[F.array(*r) for r in rows])


def synth_docs(ids: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, kind, text, rows``: filled contracts, payslips and two kinds of balance
    sheet, one per row of ``ids`` (column ``id``; ``spark.range(n)`` for n documents)
    (SRC7). ``rows`` is empty for the first two."""
    base, d = _corpus(ids, seed)
    empty = F.array().cast("array<array<string>>")
    rows = (
        F.when(F.col("kind") == "balance_single", _single_rows(d))
        .when(F.col("kind") == "balance_years", _years_rows(d))
        .otherwise(empty)
    )
    row_text = F.array_join(F.transform(F.col("rows"), lambda r: F.array_join(r, " ")), "\n")
    text = (
        F.when(F.col("kind") == "payslip", F.concat_ws("\n", *_payslip_lines(d)))
        .when(F.col("kind") == "contract", F.concat_ws("\n", *_contract_lines(d)))
        .otherwise(row_text)
    )
    return base.withColumn("rows", rows).select("doc_id", "kind", text.alias("text"), "rows")


def synth_rows(docs: DataFrame) -> DataFrame:
    """Table rows of the corpus: doc_id, page, row_idx, cells."""
    return docs.select("doc_id", F.lit(0).alias("page"), F.posexplode_outer("rows").alias("row_idx", "cells")).filter(
        F.col("row_idx").isNotNull()
    )


def synth_truth(ids: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, field, expected, expected_basis``: what the corpus was filled with (SRC7)."""
    base, d = _corpus(ids, seed)

    def fact(field: str, value: Column, basis: str | None = None) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("expected"), F.lit(basis).cast("string").alias("expected_basis"))

    facts = {
        "contract": [fact("name", d.name("employee")), fact("address", d.address("employee"))],
        "payslip": [
            fact("name", d.name("employee")),
            fact("abn", d.grouped("abn", [(10, 99)] + [(100, 999)] * 3, " ")),
            fact("bsb", d.grouped("bsb", [(100, 999)] * 2, "-")),
            fact("account_number", d.grouped("account", [(1000, 9999)] * 2, " ")),
            fact("annual_salary", d.thousands("annual")),
            fact("salary", d.dollars("rate")),
            fact("income", d.dollars("gross"), "gross"),
        ],
        "balance_single": [fact(k, d.thousands(f"single.{k}")) for k in V.BALANCE_KEYS],
        "balance_years": [fact(k, d.thousands(f"years.{k}.5")) for k in V.BALANCE_KEYS],
    }
    chain = None
    for kind, entries in facts.items():
        arr = F.array(*entries)
        chain = F.when(F.col("kind") == kind, arr) if chain is None else chain.when(F.col("kind") == kind, arr)
    return base.select("doc_id", F.explode_outer(chain).alias("f")).select("doc_id", "f.*")


def synth_org(spark: SparkSession, now: str = "2026-01-01 00:00:00") -> tuple[DataFrame, DataFrame]:
    """``(users, departments)``: one administrator, five departments with a manager and
    four staff each, staff created ``now - i`` days (SRC8)."""
    moment = F.lit(now).cast("timestamp_ntz")
    i = F.col("id")
    role = F.when(i == 0, "ADMIN").when(i <= 5, "MANAGER").otherwise("STAFF")
    place = F.when(i == 0, F.lit(None)).when(i <= 5, i).otherwise(F.floor((i - 6) / 4) + 1)
    name = F.when(i == 0, "Admin").when(i <= 5, F.concat(F.lit("Manager "), i.cast("string"))).otherwise(
        F.concat(F.lit("Staff "), (i - 5).cast("string"))
    )
    users = spark.range(26).select(
        F.concat(F.lit("user-"), i.cast("string")).alias("id"),
        F.when(i > 5, moment - F.make_dt_interval((i - 5).cast("int"))).otherwise(moment).alias("created_at"),
        F.concat(F.lower(F.replace(name, F.lit(" "), F.lit("."))), F.lit("@example.com")).alias("email"),
        name.alias("name"),
        F.concat(F.lit("dept-"), place.cast("string")).alias("department_id"),
        role.alias("role"),
        F.lit(False).alias("is_deleted"),
    )
    departments = spark.range(1, 6).select(
        F.concat(F.lit("dept-"), i.cast("string")).alias("id"),
        moment.alias("created_at"),
        F.concat(F.lit("Department "), i.cast("string")).alias("name"),
        F.concat(F.lit("user-"), i.cast("string")).alias("manager_id"),
    )
    return users, departments
