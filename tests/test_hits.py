"""Fields and spans read from one set of matches are those of separate searches."""

from docledger import fixed_values as V
from docledger.functions import cleaning
from docledger.functions import extract_au as X
from docledger.functions.text import match_spans, strip
from docledger.operators.spans import sensitive_spans
from pyspark.sql import functions as F

TEXTS = [
    None, "", "nothing here", "Employee:   \nEmployee Name: Ann Lee \nEmployee: [x]\nmployee: Ann Lee",
    "Gross Pay: n/a\nNet Pay: $1,200.50\nTotal gross payment 900\nNET PAY: 77", "Annual salary: [if any] $85,000\nAnnual salary: $85,000.00\nAnnual salary: $90,000",
    "ABN: 12 345 678 901 phone 0412 345 678, $5 and $1,000.25; 01/02/2024\nBSB: 062-000\nAccount: 12345678\nAccount: 12345678\nccount: 1",
    "marks ﷐ of ﷑ its ﷒ own\nBSB: 123-456\nEmployer: Acme \U0001f600 Pty\nEmployer Address: 1 A St, Perth WA 6000 $12",
    "Employee Address: " + "long " * 20000 + "\nSB: 111-222",
]


def test_hits_give_the_same(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    keys = {k: F.col(k) for k in X.TEXT_KEYS}
    plain = X.with_text_fields(df)
    plain = plain.withColumn("spans", sensitive_spans(F.col("text"), keys)).select("i", *X.TEXT_KEYS, "spans")
    hits = X.hit_columns()
    once = X.with_text_fields(X.with_hits(df), hits=hits)
    once = once.withColumn("spans", sensitive_spans(F.col("text"), keys, hits)).select("i", *X.TEXT_KEYS, "spans")
    want, got = (sorted(map(tuple, x.collect()), key=lambda r: r[0]) for x in (plain, once))
    assert got == want
    for row, text in zip(got, TEXTS):
        # positions are counted in code points, as Python's are
        assert all(text[s.start : s.end] == s.value for s in row[-1] or [])
    assert sum(len(r[-1] or []) for r in got) > 15


VALUES = [
    None, "", "Ann Lee", "<x>", "a <x>", "<x> a", "<x", "{y}", "{y} z", "[z]", "[z", "_", "-5", "…", ". x", "x.", "a:b", ":", "ACME PTY LTD", "ACME PT", "12 A B C D E F G", "Thong tu so 5", "x THONG  TU SO",
    "thông tư số", "thong tư so", "mau so", "MẪU SỐ", "Phu luc", "phụ lục A", "nghi dinh", "nghị định", "nghi đinh", "ban hanh", "BAN HÀNH", "mauso", "ma uso", "van a", "Nguyen Van A", "nguyen thi b",
    "Nguyễn Văn A", "van ab", "người lao động", "Người Lao Động", "người lao động x", "nlđ", "nld", " \u00a0Jo Bloggs\t", "ſ pam", "mau\x85so", "x\n", "a\n<b>", "ÀÁÂÃÈÉÊ", "đ",
]


def test_values_are_refused_as_by_one_pattern(spark):
    """``is_data`` looks at the start apart, and with fewer phrases at ASCII: the whole list refuses the same."""
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, v string").withColumn("v", strip(F.col("v")))
    for locale, more in (("au", [V.ANGLE_PLACEHOLDER, V.CURLY_PLACEHOLDER]), ("vn", [])):
        parts = [*more, "^$", V.FILLER_START, V.BRACKET_PLACEHOLDER, f"(?iU)^(?:{'|'.join(V.GENERIC_ROLES)})$", V.BOILERPLATE, r"^(?:\P{L}*\p{Lu}){7,}\P{L}*$", ":"]
        whole = ~(F.col("v").rlike("|".join(f"(?:{p})" for p in parts)) | cleaning.strip_diacritics(F.col("v")).rlike(V.PLACEHOLDER_NAME))
        rows = df.select("v", whole.alias("want"), cleaning.is_data(F.col("v"), locale).alias("got")).collect()
        assert [(r.v, r.got) for r in rows] == [(r.v, r.want) for r in rows]
        assert 5 < sum(r.got is True for r in rows) < len(rows) - 20


def test_single_matches_stand_outside_of_loops(spark):
    """A loop per pattern made up most of the cost of rows that hold a pattern once or not at all."""
    df = spark.createDataFrame([(0, "BSB: 1")], "i int, text string")
    plan = X.with_hits(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"CASE WHEN (size(__raw_{k}" in plan.replace("isnull", "") for k in X.CLEANED)
    # a pattern is searched once: for ASCII and for other texts, and cut where a text holds the marks
    assert plan.count("B?SB") == 5


def test_begins_hold_for_every_match(spark):
    """The characters tried first lose no match, whatever is left out or put between."""
    texts = [
        "EMPLOYEE :a\nmployee name: b\nEmployee  Address:c\nmployer: d\nE mployer address :e", "sb:1\nBSB :2\nbSb: 3\nxbsb:4", "ccount:1\nACCOUNT: 2\naccount : 3",
        "otal gross payment 1\nTotal ross payment: 2\nTOTALGROSSPAYMENT 3\nross pay 4\nGrossPay:5\notalrosspayment 6",
        "et pay 1\nNETPAY: 2\notal et payment 3\nTotal net payment 4\nTOTALETPAYMENT:5\nnet  pay", "annual salary: $5\nANNUALSALARY:[x] $1,0",
        "11 222 333 444,12 345 678 9012 0412345678 04 12 34 56 78 0912345678 01/02/2024 1/02/2024 101/02/2024 $ 5 $1,000.50 $12345",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    searched = {**V.AU_LISTS, "annual_salary": V.ANNUAL_SALARY, **X.CLEANED}
    # one letter outside ASCII at the end takes the whole pattern
    cols = [match_spans(F.concat("text", F.lit(end)), p, 0 if k in V.AU_LISTS else 1, begin).alias(f"{k}{n}") for k, p in searched.items() for n, (end, begin) in enumerate([("\n-\n.", X._BEGINS[k]), ("\n-\né", "")])]
    for r in df.select(*cols).collect():
        for k in searched:
            assert r[f"{k}0"] == r[f"{k}1"], k
