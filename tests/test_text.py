"""Text extraction, cleaning, amounts, spans, with Python's ``re`` as second opinion."""

import re

import pytest
from pyspark.sql import functions as F

from docledger import fixed_values as V
from docledger.functions import amounts, cleaning, extract_au, extract_vn, text
from docledger.operators import spans

DOCS = {
    "slip": "*Employer: Acme Pty Ltd\n*ABN: 12 345 978 910\n*Employee: Jo Worker",
    "contract": "Employer Name: Acme Pty Ltd\nEmployer Address: 1 Business St, Melbourne VIC\nEmployee Name: Sam Employee\nEmployee Address: 22 Home St, Melbourne VIC 3000",
    "dropped": "mployee Name: Steven Wood\nSB: 123-456\nccount: 1234 5678\nross Pay: $718.66\nET PAY: $625.36",
    "net": "NET PAY: $625.36\nOrdinary hours 15.0 $27.81 $417.15",
    "wrapped": "Total $106\r\n,000 $74,\r\n000 more text",
    "annual": "*Annual salary: [if applicable] $67,000\n*Pay period: 16/07/2026 to 22/07/2026",
    "blank": "Employee Name: ____________\nEmployee Address: <insert employee address>\nEmployee Address: 22 Home St VIC 3000",
    "bad_date": "Pay period: 31/02/2026 to 12/03/2026\nEmployee: Jo Worker",
    "context": "ay Slip For:\nRymer, Mark\nCheque No:\n71",
    "unrelated": "Approved by the finance team.\nJohn Smith reviewed this document.",
    "ross": "Employer Name: Christopher Ross\nEmployer Address: 1 Crossing St",
    "empty": "",
}


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame(list(DOCS.items()), "doc_id string, text string")
    out = extract_au.with_text_fields(df).withColumn("err", extract_au.pay_period_error(F.col("text")))
    out = out.withColumn("spans", spans.sensitive_spans(F.col("text"), {k: F.col(k) for k in extract_au.TEXT_KEYS}))
    return {r.doc_id: r for r in out.withColumn("masked", spans.mask_text(F.col("text"), F.col("spans"))).collect()}


def test_fields(read):
    assert (read["slip"].name, read["slip"].abn) == ("Jo Worker", ["12 345 978 910"])
    assert (read["contract"].name, read["contract"].address) == ("Sam Employee", "22 Home St, Melbourne VIC 3000")
    assert read["contract"].employer_name == "Acme Pty Ltd"
    d = read["dropped"]
    assert (d.name, d.bsb, d.account_number, d.income, d.income_basis) == ("Steven Wood", "123-456", "1234 5678", 718.66, "gross")
    assert (read["net"].income, read["net"].income_basis) == (625.36, "net")
    assert read["net"].salary == ["$625.36", "$27.81", "$417.15"]
    assert read["wrapped"].salary == ["$106\r\n,000", "$74,\r\n000"]
    assert (read["annual"].annual_salary, read["annual"].pay_period_days) == (67000.0, 6)
    assert read["blank"].address == "22 Home St VIC 3000"
    assert read["bad_date"].pay_period_days is None and read["bad_date"].err and read["bad_date"].name == "Jo Worker"
    assert read["context"].name == "Rymer, Mark" and read["unrelated"].name is None and read["ross"].income is None


def test_span_invariant_and_mask(read):
    seen = 0
    for r in read.values():
        for s in r.spans:
            assert r.text[s.start:s.end] == s.value
            seen += 1
        assert len(r.masked) == len(r.text)
        for s in r.spans:
            assert set(r.masked[s.start:s.end]) == {"█"}
    assert seen > 15


def test_positions_equal_finditer(spark):
    cases = [*DOCS.values(), "é $1,000.00 ü$5 $ 7", "$1 $2\n$3", "no amount", "$ 12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string")
    for row in df.withColumn("m", text.match_spans(F.col("text"), V.SALARY)).collect():
        want = [(m.start(), m.end(), m.group(0)) for m in re.finditer(r"\$\s?\d{1,3}(?:\s*,\s*\d{3})*(?:\.\d{2})?\b", row.text)]
        assert [(s.start, s.end, s.value) for s in row.m] == want


@pytest.mark.parametrize(
    "parser, cases",
    [
        (amounts.parse_amount, [("$1,234.56", 1234.56), ("9500", 9500.0), ("-5", 5.0), ("none", None)]),
        (
            amounts.parse_amount_bs,
            [("$89.000.00", 89000.0), ("0 $84, 000", 84000.0), ("in 12 months", None), ("$106 ,000", 106000.0),
             ("120.000", 120.0), ("89 000.00", 89000.0), ("165000", 165000.0), ("$435,879,843.89", 435879843.89), ("", None)],
        ),
        (amounts.parse_vnd, [("30.000.000 VND", 30000000.0), ("5,964,265 (1)", 5964265.0), ("x", None)]),
    ],
)
def test_amounts(spark, parser, cases):
    df = spark.createDataFrame(cases, "raw string, want double").withColumn("got", parser(F.col("raw")))
    assert [r.got for r in df.collect()] == [w for _, w in cases]


def test_clean_value(spark):
    cases = [
        (" Jo Worker ", "Jo Worker"), ("<insert>", None), ("{insert}", None), ("[member]", None), ("....", None), ("", None),
        ("a: b", None), ("PAYSLIP HEADER", None), ("ABC", "ABC"), ("Nguyễn Văn A", None), ("Nguyễn Văn An", "Nguyễn Văn An"),
        ("người lao động", None), ("Mẫu số 01", None),
    ]
    df = spark.createDataFrame(cases, "raw string, want string").withColumn("got", cleaning.clean_value(F.col("raw")))
    assert [r.got for r in df.collect()] == [w for _, w in cases]


def test_vietnamese(spark):
    doc = "Họ và tên: Duong Vu\nĐịa chỉ:\nSTK: 0123456789\nTổng thu nhập: 30.000.000 VND\n0912345678 1234567890 123456789012"
    df = spark.createDataFrame([("d", doc)], "doc_id string, text string")
    rows = spark.createDataFrame([("d", 0, 0, ["Địa chỉ", "12 Lê Lợi"])], "doc_id string, page int, row_idx int, cells array<string>")
    r = extract_vn.with_vn_fields(df, rows).first()
    assert (r.name, r.address, r.bank_account, r.income, r.income_basis) == ("Dương Vũ", "12 Lê Lợi", "0123456789", 30000000.0, "gross")
    assert r.cccd == ["123456789012"] and r.phone == ["0912345678"] and "0912345678" not in r.tax_code


def test_dewrapped_and_occurrences(spark):
    df = spark.createDataFrame([("a $92,\r\n000 b $92,\r\n000", "$92,000")], "t string, v string")
    r = df.select(
        text.find_first(F.col("t"), F.col("v")).alias("one"), text.find_dewrapped(F.col("t"), F.col("v"), 5).alias("two"),
        text.literal_occurrences(F.col("t"), F.lit("$92")).alias("all"), text.line_of_offset(F.col("t"), F.lit(7)).alias("line"),
    ).first()
    assert (r.one.start, r.one.end) == (2, 11) and (r.two.start, r.two.end) == (14, 23)
    assert [(o.start, o.end) for o in r.all] == [(2, 5), (14, 17)] and r.line == 0


def test_positions_of_many_matches(spark):
    words = " ".join(f"w{i}é" for i in range(500)) + "　\x1c end"
    df = spark.createDataFrame([(words,), ("",), (None,), ("a﷑b c",)], "t string")
    out = [r.s for r in df.select(text.match_spans(F.col("t"), r"(\w)\S*", 1).alias("s")).collect()]
    for t, spans_found in zip([words, "", "", "a﷑b c"], out):
        # \w and \s are ASCII in this pattern
        expected = [(m.start(), m.end(), m.group(0), m.group(1)) for m in re.finditer(r"([A-Za-z0-9_])[^ \t\n\x0b\f\r]*", t)]
        assert [tuple(s) for s in spans_found] == expected
    # the running state holds positions, not the spans found so far
    joins = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("zip_with")
    assert joins(text.match_spans(F.col("t"), r"\S+")) > joins(text._cut_spans(F.col("t"), r"\S+", 0))


def test_blanks_at_both_ends(spark):
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    df = spark.createDataFrame([(f"{b}x{blanks}y{blanks}{b}",) for b in blanks] + [(blanks,), ("​x᠎",), (None,)], "t string")
    rows = df.select(text.strip(F.col("t")), text.leading_blanks(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(f"x{blanks}y", 1)] * len(blanks) + [("", len(blanks)), ("​x᠎", 0), (None, None)]
