"""Queries over document text: extraction, cleaning, amounts, rules, spans, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import amounts, cleaning, extract_au, extract_vn, text
from ..operators import merge, rules, scoring, spans
from ..session import scratch_path
from .registry import query

_LABEL = {k: p.replace("(?iU)", "(?i)") for k, p in V.AU_LABELS.items()}


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_clean(raw: str) -> str:
    """Cleaning of ASCII label values, for the SQL side."""
    v = _sql_strip(raw)
    letters = f"regexp_replace({v}, '[^A-Za-z]', '', 'g')"
    return (
        f"CASE WHEN {v} = '' OR regexp_matches({v}, '^<[^<>]*>$|^\\{{{{[^{{{{}}}}]*\\}}}}$|^[.…_\\-]|^\\[[^\\[\\]]*\\]$') OR contains({v}, ':') "
        f"OR (length({letters}) > 6 AND upper({letters}) = {letters}) THEN NULL ELSE {v} END"
    )


def _sql_first(src: str, pattern: str) -> str:
    clean = _sql_clean("x")
    return f"list_filter(list_transform(regexp_extract_all({src}, '{pattern}', 1), lambda x: {clean}), lambda y: y IS NOT NULL)[1]"


def _sql_amount(v: str) -> str:
    return f"TRY_CAST(replace(regexp_extract({v}, '(?:\\d{{{{1,3}}}}(?:,\\d{{{{3}}}})+|\\d+)(?:\\.\\d{{{{2}}}})?'), ',', '') AS DOUBLE)"


def _sql_braces(p: str) -> str:
    return p.replace("{", "{{").replace("}", "}}").replace("'", "''")


def _joined(expr: str) -> str:
    return f"array_to_string({expr}, '|')"


# --- AU fields -----------------------------------------------------------------------
@query(
    "ext1_regex_fields",
    "SELECT doc_id, "
    + ", ".join(
        f"{_joined('regexp_extract_all(text, ' + chr(39) + _sql_braces(p.replace('(?U)', '')) + chr(39) + ')')} AS {k}"
        for k, p in V.AU_LISTS.items()
    )
    + " FROM {v_payslip}",
)
def _(t):
    cols = extract_au.regex_fields(F.col("text"))
    return t.spread("v_payslip").select("doc_id", *[F.array_join(c, "|").alias(k) for k, c in cols.items()])


@query(
    "ext1_document_texts",
    "SELECT doc_id, "
    + ", ".join(
        f"CAST(len(regexp_extract_all(text, '{_sql_braces(p.replace('(?U)', ''))}')) AS INT) AS {k}" for k, p in V.AU_LISTS.items()
    )
    + " FROM {documents}",
)
def _(t):
    cols = extract_au.regex_fields(F.col("text"))
    return t.spread("documents").select("doc_id", *[F.size(c).alias(k) for k, c in cols.items()])


@query(
    "ext2_label_fields",
    "SELECT doc_id, " + ", ".join(f"{_sql_first('text', _sql_braces(p))} AS {k}" for k, p in _LABEL.items()) + " FROM {v_payslip}",
)
def _(t):
    return t.spread("v_payslip").select("doc_id", *[c.alias(k) for k, c in extract_au.label_fields(F.col("text")).items()])


_GROSS = _sql_braces(V.AU_INCOME["gross"].replace("(?iU)", "(?i)"))
_NET = _sql_braces(V.AU_INCOME["net"].replace("(?iU)", "(?i)"))


@query(
    "ext3_income",
    f"""SELECT doc_id, coalesce(g, n) AS amount, CASE WHEN g IS NOT NULL THEN 'gross' WHEN n IS NOT NULL THEN 'net' END AS basis
        FROM (SELECT doc_id, {_sql_amount(_sql_first('text', _GROSS))} AS g, {_sql_amount(_sql_first('text', _NET))} AS n FROM {{v_payslip}}) s""",
)
def _(t):
    return t.spread("v_payslip").select("doc_id", extract_au.income(F.col("text")).alias("i")).select("doc_id", "i.*")


@query(
    "ext4_annual_salary",
    "SELECT doc_id, CASE WHEN k % 5 = 0 THEN CAST(annual_k * 1000 AS DOUBLE) END AS annual_salary FROM {v_payslip_values}",
)
def _(t):
    return t.spread("v_payslip").select("doc_id", extract_au.annual_salary(F.col("text")).alias("annual_salary"))


@query("ext5_pay_period_days", "SELECT doc_id, period_days AS days, CAST(NULL AS VARCHAR) AS error FROM {v_payslip_values}")
def _(t):
    c = F.col("text")
    return t.spread("v_payslip").select("doc_id", extract_au.pay_period_days(c).alias("days"), extract_au.pay_period_error(c).alias("error"))


@query(
    "ext6_context_name",
    """SELECT c.c_custkey AS custkey, CASE WHEN c.c_custkey % 3 = 0 THEN 'Ann ' || c.c_mktsegment_name ELSE NULL END AS name
       FROM (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS c_mktsegment_name FROM {customer}) c""",
)
def _(t):
    who = F.concat(F.lit("Ann "), F.initcap("c_mktsegment"))
    lead = F.when(F.col("c_custkey") % 3 == 0, F.lit("ay Slip For:\n")).otherwise("Reviewed by\n")
    body = F.concat(lead, who, F.lit("\nCheque No:\n71"))
    return t["customer"].select(F.col("c_custkey").alias("custkey"), extract_au.context_name(body).alias("name"))


@query(
    "ext7_suppress_salary",
    "SELECT doc_id, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 2 <> 0 AND k % 5 = 0 THEN 1 ELSE 0 END AS n FROM {v_payslip_values}",
)
def _(t):
    df = extract_au.with_text_fields(t.spread("v_payslip"), keys=["salary"])
    k = F.col("k")
    df = df.withColumns({f: F.lit(None).cast("double") for f in V.BALANCE_KEYS}).withColumn("total_assets", F.when(k % 2 == 0, 5.0))
    return extract_au.suppress_salary(df).select("doc_id", F.size("salary").alias("n"))


@query(
    "ext9_shape_gates",
    """SELECT doc_id, true AS address_ok, true AS bsb_ok, true AS account_ok, length(employer) <= 60 AS employer_is_name FROM {v_payslip_values}""",
)
def _(t):
    v = t["v_payslip_values"]
    return v.select(
        "doc_id", cleaning.looks_like_address(F.col("address")).alias("address_ok"), cleaning.looks_like_bsb(F.col("bsb")).alias("bsb_ok"),
        cleaning.looks_like_bsb(F.col("account")).alias("account_ok"), cleaning.looks_like_name(F.col("employer")).alias("employer_is_name"),
    )


@query(
    "ext10_line_of_offset",
    "SELECT doc_id, CAST(len(regexp_extract_all(substr(text, 1, CAST(n_chars // 2 AS BIGINT)), chr(10))) AS INT) AS line FROM {documents}",
)
def _(t):
    return t.spread("documents").select("doc_id", text.line_of_offset(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).alias("line"))


@query("win1_first_accepted", "SELECT doc_id, CASE WHEN k % 10 <> 0 THEN employee END AS name FROM {v_payslip_values}")
def _(t):
    return t.spread("v_payslip").select("doc_id", extract_au.first_accepted(F.col("text"), V.AU_LABELS["name"]).alias("name"))


# --- cleaning and amounts ------------------------------------------------------------
@query(
    "cln1_clean_value",
    f"SELECT p_partkey, {_sql_clean('v')} AS cleaned FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN '<' || p_name || '>' "
    "WHEN 2 THEN '[' || p_name || ']' WHEN 3 THEN p_type WHEN 4 THEN '..' || p_name WHEN 5 THEN p_name || ': x' WHEN 6 THEN '{{' || p_name || '}}' "
    "ELSE p_type || ' ' || p_type END AS v FROM {part}) s",
)
def _(t):
    name, kind, m = F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 8
    v = (
        F.when(m == 0, F.concat(F.lit("  "), name, F.lit(" "))).when(m == 1, F.concat(F.lit("<"), name, F.lit(">")))
        .when(m == 2, F.concat(F.lit("["), name, F.lit("]"))).when(m == 3, kind).when(m == 4, F.concat(F.lit(".."), name))
        .when(m == 5, F.concat(name, F.lit(": x"))).when(m == 6, F.concat(F.lit("{"), name, F.lit("}")))
        .otherwise(F.concat(kind, F.lit(" "), kind))
    )
    return t["part"].select("p_partkey", cleaning.clean_value(v).alias("cleaned"))


@query("par1_parse_amount", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS amount FROM {lineitem}")
def _(t):
    shown = F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), F.lit(" (1)"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", amounts.parse_amount(shown).alias("amount"))


@query("par2_parse_amount_bs", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE round(l_extendedprice, 2) END AS amount FROM {lineitem}")
def _(t):
    plain = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    m = F.col("l_linenumber") % 4
    shown = (
        F.when(m == 0, F.concat(F.lit("0 $ "), F.replace(plain, F.lit(","), F.lit(" ,"))))
        .when(m == 1, F.replace(plain, F.lit(","), F.lit(" ")))
        .when(m == 2, F.when(F.col("l_extendedprice") >= 1000, F.replace(plain, F.lit(","), F.lit("."))).otherwise(plain))
        .otherwise(F.concat(F.lit("in "), plain, F.lit(" months")))
    )
    return t["lineitem"].select("l_orderkey", "l_linenumber", amounts.parse_amount_bs(shown).alias("amount"))


@query("par3_parse_vnd", "SELECT o_orderkey, CAST(floor(o_totalprice) * 1000 AS DOUBLE) AS amount FROM {orders}")
def _(t):
    shown = F.concat(F.replace(F.format_number(F.floor("o_totalprice") * 1000, 0), F.lit(","), F.lit(".")), F.lit(" VND"))
    return t["orders"].select("o_orderkey", amounts.parse_vnd(shown).alias("amount"))


@query("mat1_despace", "SELECT doc_id, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS INT) AS n FROM {documents}")
def _(t):
    return t.spread("documents").select("doc_id", F.length(text.despace(F.col("text"))).alias("n"))


@query(
    "mat3_find_dewrapped",
    """SELECT doc_id, CAST(kept[p] - 1 AS INT) AS start, CAST(kept[p + length(v) - 1] AS INT) AS "end" FROM (
         SELECT doc_id, v, position(v in flat) AS p, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) NOT IN (chr(10), chr(13))) AS kept FROM (
           SELECT doc_id, text, replace(replace(text, chr(10), ''), chr(13), '') AS flat,
             substr(replace(replace(text, chr(10), ''), chr(13), ''), greatest(length(replace(replace(text, chr(10), ''), chr(13), '')) - 9, 1), 10) AS v FROM {documents}) a) b
       WHERE p > 0""",
)
def _(t):
    # the last ten characters of each text without its line breaks, found again in the text
    flat = text.dewrap(F.col("text"))
    value = F.substring(flat, F.greatest(F.length(flat) - 9, F.lit(1)), F.lit(10))
    hit = text.find_dewrapped(F.col("text"), value)
    # exploded: a filter on the search itself would be pushed below the dealing out and search there, too
    found = t.spread("documents").select("doc_id", F.explode_outer(F.array(hit)).alias("hit"))
    return found.filter("hit IS NOT NULL").select("doc_id", "hit.start", "hit.end")


# --- rules ---------------------------------------------------------------------------
_MONTHLY = """SELECT doc_id, department_id, repayment, basis,
   CASE WHEN k % 5 = 0 THEN annual_k * 1000 / 12.0 WHEN period_days = 6 THEN (pay + 0.5) * (52.0 / 12) WHEN period_days = 14 THEN (pay + 0.5) * (26.0 / 12)
        WHEN period_days = 30 THEN pay + 0.5 END AS m,
   CASE WHEN k % 5 = 0 THEN 'annual_salary' WHEN period_days = 11 THEN 'insufficient_data' ELSE 'period_gross' END AS source FROM {v_payslip_values}"""


def _fields(t):
    return extract_au.with_text_fields(t.spread("v_payslip"), keys=["income", "annual_salary", "pay_period_days"])


def _monthly(df):
    return rules.monthly_income(F.col("income"), F.col("annual_salary"), F.col("pay_period_days"))


@query("rul1_monthly_income", f"SELECT doc_id, round(m, 4) AS amount, source FROM ({_MONTHLY}) s")
def _(t):
    df = _fields(t)
    return df.select("doc_id", _monthly(df).alias("m")).select("doc_id", F.round("m.amount", 4).alias("amount"), F.col("m.source").alias("source"))


_VERDICT = f"""SELECT *, CASE WHEN m IS NULL OR m <= 0 THEN 'INSUFFICIENT_DATA'
   WHEN m >= 4000 AND repayment / m <= 0.30 AND repayment / m <= 0.40 THEN 'READY' ELSE 'NOT_READY' END AS verdict FROM ({_MONTHLY}) s0"""


def _loan(t):
    df = _fields(t).withColumn("m", _monthly(None))
    loan = rules.loan_readiness(F.col("m.amount"), F.col("income_basis"), F.col("repayment"), F.lit(None).cast("double"), F.col("m.source"))
    return df.withColumn("loan", loan)


@query(
    "rul2_loan_readiness",
    f"""SELECT doc_id, verdict, CASE WHEN verdict <> 'INSUFFICIENT_DATA' THEN m >= 4000 END AS income_pass,
        CASE WHEN verdict <> 'INSUFFICIENT_DATA' THEN round(repayment / m, 6) END AS ratio, true AS debt_assumed_zero FROM ({_VERDICT}) s""",
)
def _(t):
    return _loan(t).select(
        "doc_id", F.col("loan.verdict").alias("verdict"), F.col("loan.checks")["min_income"]["pass"].alias("income_pass"),
        F.round(F.col("loan.checks")["repayment_ratio"]["value"], 6).alias("ratio"), F.col("loan.existing_debt_assumed_zero").alias("debt_assumed_zero"),
    )


@query(
    "loan_ready_by_department",
    f"""SELECT coalesce(p.name, 'none') AS department, s.verdict, s.source, count(*) AS n FROM ({_VERDICT}) s
        LEFT JOIN {{v_department}} p ON p.id = s.department_id GROUP BY 1, 2, 3""",
)
def _(t):
    names = t["v_department"].select(F.col("id").alias("department_id"), "name")
    counts = _loan(t).groupBy("department_id", F.col("loan.verdict").alias("verdict"), F.col("loan.income_source").alias("source")).agg(F.count("*").alias("n"))
    return counts.join(names, "department_id", "left").select(F.coalesce("name", F.lit("none")).alias("department"), "verdict", "source", "n")


@query(
    "rul3_balance_readiness",
    """SELECT doc_id, CASE WHEN r AND d THEN 'READY' ELSE 'NOT_READY' END AS verdict, r AS ratio_pass, d AS debt_pass FROM (
         SELECT doc_id, current_liabilities <> 0 AND current_assets >= current_liabilities AS r,
                assets > liabilities AND liabilities <= 2 * (assets - liabilities) AS d FROM {v_balance}) s""",
)
def _(t):
    def d(c):
        return F.col(c).cast("double")

    b = t["v_balance"].withColumn("r", rules.balance_readiness(d("current_assets"), d("current_liabilities"), d("liabilities"), d("assets") - d("liabilities")))
    return b.select(
        "doc_id", F.col("r.verdict").alias("verdict"), F.col("r.checks")["current_ratio"]["pass"].alias("ratio_pass"),
        F.col("r.checks")["debt_to_equity"]["pass"].alias("debt_pass"),
    )


@query("rul4_needs_balance_check", "SELECT doc_id, k % 3 <> 0 AS needed FROM {v_balance}")
def _(t):
    from ..operators.balance import needs_balance_check

    b = t["v_balance"].withColumns({f: F.lit(None).cast("double") for f in V.BALANCE_KEYS}).withColumns(
        {"total_assets": F.col("assets").cast("double"), "total_equity": F.when(F.col("k") % 3 != 0, 1.0)}
    )
    return b.select("doc_id", needs_balance_check(b).alias("needed"))


@query(
    "rul5_assemble_result",
    f"""SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 6 = 0 THEN NULL ELSE verdict END AS verdict, CASE WHEN CAST(doc_id AS BIGINT) % 6 = 0 THEN 0 ELSE 16 END AS n_keys,
        CASE WHEN CAST(doc_id AS BIGINT) % 6 = 0 THEN 'unreadable' END AS error FROM ({_VERDICT}) s""",
)
def _(t):
    bad = F.col("k") % 6 == 0
    df = _fields(t).withColumns(
        {
            "processing_path": F.lit("text_native"), "failed": bad, "error": F.when(bad, "unreadable"),
            "redaction": F.struct(F.lit("spans").alias("type"), F.array().cast(spans.EMPTY).alias("items")),
        }
    )
    r = merge.assemble_result(df)
    return r.select("doc_id", F.col("ai_result.loan_readiness.verdict").alias("verdict"), F.size("ai_result.sensitive_field_keys").alias("n_keys"), F.col("ai_result.error").alias("error"))


@query(
    "fil7_visible_fields",
    """SELECT type, key, count(*) AS n FROM (
         SELECT CASE WHEN k % 2 = 0 THEN 'PAY_SLIP' ELSE 'CONTRACT' END AS type, unnest(list_filter([
           CASE WHEN k % 10 <> 0 THEN 'name' END, 'address', 'abn', 'bsb', 'account_number', 'salary', 'income', CASE WHEN k % 2 = 1 THEN 'income_basis' END,
           CASE WHEN k % 5 = 0 THEN 'annual_salary' END, 'dates', CASE WHEN k % 6 = 0 THEN 'phone' END], lambda x: x IS NOT NULL)) AS key FROM {v_payslip_values}) s
       GROUP BY 1, 2""",
)
def _(t):
    from ..operators.views import visible_fields

    df = extract_au.with_text_fields(t.spread("v_payslip").withColumn("type", F.when(F.col("k") % 2 == 0, "PAY_SLIP").otherwise("CONTRACT")), is_person=lambda c: F.lit(False))
    shown = visible_fields(df.select("doc_id", "type", F.struct(*extract_au.TEXT_KEYS).alias("fields")))
    return shown.join(df.select("doc_id", "type"), "doc_id").groupBy("type", "key").agg(F.count("*").alias("n"))


@query(
    "acl7_sensitive_keys",
    """SELECT doc_id, array_to_string(list_filter(['abn', 'account_number', 'address', CASE WHEN k % 5 = 0 THEN 'annual_salary' END, 'bsb', 'employer_name', 'income',
         CASE WHEN k % 10 <> 0 THEN 'name' END, CASE WHEN k % 6 = 0 THEN 'phone' END, 'salary'], lambda x: x IS NOT NULL), ',') AS keys FROM {v_payslip_values}""",
)
def _(t):
    # of the keys a document has, those that are hidden from others
    df = extract_au.with_text_fields(t.spread("v_payslip"), is_person=lambda c: F.lit(False))
    kinds = dict(df.dtypes)
    has = lambda k: F.size(k) > 0 if kinds[k].startswith("array") else F.col(k).isNotNull()
    present = F.array_compact(F.array(*[F.when(has(k), F.lit(k)) for k in extract_au.TEXT_KEYS]))
    return df.select("doc_id", F.array_join(F.array_sort(F.array_intersect(present, spans.sensitive_keys())), ",").alias("keys"))


# --- spans ---------------------------------------------------------------------------
def _payslip_spans(t):
    hits = extract_au.hit_columns()
    df = extract_au.with_text_fields(extract_au.with_hits(t.spread("v_payslip")), is_person=lambda c: F.lit(False), hits=hits)
    return df.withColumn("spans", spans.sensitive_spans(F.col("text"), {k: F.col(k) for k in extract_au.TEXT_KEYS}, hits))


_SPANS = """SELECT doc_id, field, value, position(marker in text) - 1 + length(marker) AS start FROM (
    SELECT p.doc_id, p.text, u.field, u.value, u.marker FROM {v_payslip} p JOIN (
      SELECT doc_id, 'name' AS field, employee AS value, '*Employee: ' AS marker FROM {v_payslip_values} WHERE k % 10 <> 0
      UNION ALL SELECT doc_id, 'employer_name', employer, '*Employer: ' FROM {v_payslip_values}
      UNION ALL SELECT doc_id, 'abn', abn, '*ABN: ' FROM {v_payslip_values}
      UNION ALL SELECT doc_id, 'address', address, 'Employee Address: ' FROM {v_payslip_values}
      UNION ALL SELECT doc_id, 'bsb', bsb, 'BSB: ' FROM {v_payslip_values}
      UNION ALL SELECT doc_id, 'account_number', account, 'Account: ' FROM {v_payslip_values}
      UNION ALL SELECT doc_id, 'phone', '04' || phone_digits, 'Phone: ' FROM {v_payslip_values} WHERE k % 6 = 0
      UNION ALL SELECT doc_id, 'annual_salary', '$' || CAST(annual_k AS STRING) || ',000', 'applicable] ' FROM {v_payslip_values} WHERE k % 5 = 0
      UNION ALL SELECT doc_id, 'salary', '$' || CAST(annual_k AS STRING) || ',000', 'applicable] ' FROM {v_payslip_values} WHERE k % 5 = 0
      UNION ALL SELECT doc_id, f, regexp_extract(text, '(?:NET PAY|payment): (.*)$', 1), CASE WHEN contains(text, 'NET PAY') THEN 'NET PAY: ' ELSE 'payment: ' END
        FROM {v_payslip}, (SELECT 'income' AS f UNION ALL SELECT 'salary') x) u ON u.doc_id = p.doc_id) s"""


@query("red1_sensitive_spans", f"SELECT doc_id, field, value, CAST(start AS INT) AS start, CAST(start + length(value) AS INT) AS \"end\" FROM ({_SPANS}) s")
def _(t):
    return _payslip_spans(t).select("doc_id", F.explode_outer("spans").alias("s")).filter("s IS NOT NULL").select("doc_id", "s.field", "s.value", "s.start", "s.end")


@query("set1_spans_by_detector", f"SELECT field, count(*) AS n, CAST(0 AS BIGINT) AS broken FROM ({_SPANS}) s GROUP BY 1")
def _(t):
    found = _payslip_spans(t).select("text", F.explode_outer("spans").alias("s")).filter("s IS NOT NULL")
    wrong = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) != F.col("s.value")
    return found.groupBy("s.field").agg(F.count("*").alias("n"), F.count_if(wrong).alias("broken"))


@query(
    "red7_mask_text",
    f"""SELECT p.doc_id, CAST(length(p.text) AS INT) AS n, sum(length(s.value)) FILTER (WHERE s.field NOT IN ('income', 'annual_salary'))::BIGINT AS masked, false AS shows_bsb FROM {{v_payslip}} p
        JOIN ({_SPANS}) s ON s.doc_id = p.doc_id GROUP BY p.doc_id, p.text""",
)
def _(t):
    m = _payslip_spans(t).withColumn("masked_text", spans.mask_text(F.col("text"), F.col("spans")))
    return m.select(
        "doc_id", F.length("masked_text").alias("n"),
        F.length(F.regexp_replace("masked_text", "[^█]", "")).cast("long").alias("masked"), F.col("masked_text").rlike(r"BSB: \d").alias("shows_bsb"),
    )


@query(
    "red3_value_occurrences",
    "SELECT doc_id, CAST(len(string_split(text, '. ')) - 1 AS INT) AS n, CAST(CASE WHEN contains(text, '. ') THEN position('. ' in text) - 1 END AS INT) AS first_at FROM {documents}",
)
def _(t):
    df = t.spread("documents").withColumn("o", text.literal_occurrences(F.col("text"), F.lit(". ")))
    return df.select("doc_id", F.size("o").alias("n"), F.get("o", F.lit(0))["start"].alias("first_at"))


@query(
    "red4_amount_occurrence",
    "SELECT doc_id, CAST(position('$' in substr(text, position('Pay period' in text) + 45 + CASE WHEN k % 5 = 0 THEN 40 ELSE 0 END)) + position('Pay period' in text) + 43 + CASE WHEN k % 5 = 0 THEN 40 ELSE 0 END AS INT) AS start FROM {v_payslip}",
)
def _(t):
    df = extract_au.with_text_fields(t.spread("v_payslip"), keys=["income"])
    return df.select("doc_id", spans.amount_occurrence(F.col("text"), F.col("income"))["start"].alias("start"))


@query(
    "win8_claimed_amounts",
    """SELECT doc_id, field, CAST(start AS INT) AS start FROM (
         SELECT doc_id, 'total_current_assets' AS field, 4 AS start FROM {v_balance}
         UNION ALL SELECT doc_id, 'total_assets', 4 + length('$' || CAST(assets AS STRING) || ' and ') FROM {v_balance}
         UNION ALL SELECT doc_id, 'total_equity', 4 + 2 * length('$' || CAST(assets AS STRING) || ' and ') + length('Net Worth ') FROM {v_balance}) s""",
)
def _(t):
    amount = F.concat(F.lit("$"), F.col("assets").cast("string"))
    body = F.concat(F.lit("Sum "), amount, F.lit(" and "), amount, F.lit(" and Net Worth "), amount)
    target = F.col("assets").cast("double")
    found = spans.balance_spans(
        F.col("body"), {k: target if k in ("total_current_assets", "total_assets", "total_equity") else F.lit(None).cast("double") for k in V.BALANCE_KEYS}
    )
    return t["v_balance"].withColumn("body", body).select("doc_id", F.explode_outer(found).alias("s")).filter("s IS NOT NULL").select("doc_id", "s.field", "s.start")


@query("set4_accepted_only", "SELECT doc_id, CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN 1 ELSE 0 END AS n FROM {v_payslip_values}")
def _(t):
    from ..operators.geometry import accepted_only

    hits = text.match_spans(F.col("text"), V.SALARY)
    accepted = F.when(F.col("k") % 2 == 0, F.slice(F.filter(text.find_all(F.col("text"), V.SALARY), lambda v: v.endswith(",000")), 1, 1)).otherwise(F.array())
    return t.spread("v_payslip").select("doc_id", F.size(accepted_only(hits, accepted)).alias("n"))


# --- page merging --------------------------------------------------------------------
# pages of a document: the turns of a conversation, amounts taken from their lengths
_PAGES = """SELECT conv_id, turn, length(text) AS n, role FROM {conversations}"""


def _pages(t):
    n = F.length("text")
    return t["conversations"].select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page"),
        F.when(n % 3 == 0, F.array(n.cast("string"))).otherwise(F.array()).cast("array<string>").alias("salary"),
        F.when(n % 4 != 0, F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("N"), n.cast("string")))).alias("name"),
        F.when(n % 2 == 0, n.cast("double")).alias("income"), F.when(n % 6 != 0, F.col("role")).alias("income_basis"),
    )


@query(
    "agg1_merge_pages",
    f"""SELECT CAST(conv_id AS STRING) AS doc_id, coalesce(string_agg(CAST(n AS STRING), ',' ORDER BY turn) FILTER (WHERE n % 3 = 0), '') AS salary,
          arg_min(CASE WHEN n % 5 = 0 THEN '' ELSE 'N' || CAST(n AS STRING) END, turn) FILTER (WHERE n % 4 <> 0) AS name,
          CAST(arg_min(n, turn) FILTER (WHERE n % 2 = 0) AS DOUBLE) AS income,
          replace(arg_min(CASE WHEN n % 6 <> 0 THEN role ELSE '-' END, turn) FILTER (WHERE n % 2 = 0), '-', '') AS income_basis FROM ({_PAGES}) p GROUP BY conv_id""",
)
def _(t):
    m = merge.merge_pages(_pages(t))
    basis = F.when(F.col("income").isNotNull(), F.coalesce("income_basis", F.lit("")))
    return m.select("doc_id", F.array_join("salary", ",").alias("salary"), "name", "income", basis.alias("income_basis"))


@query(
    "agg2_merge_pages_bench",
    f"""SELECT CAST(conv_id AS STRING) AS doc_id, arg_min('N' || CAST(n AS STRING), turn) FILTER (WHERE n % 4 <> 0 AND n % 5 <> 0) AS name,
          CAST(arg_min(n, turn) FILTER (WHERE n % 2 = 0) AS DOUBLE) AS income, arg_min(role, turn) FILTER (WHERE n % 6 <> 0) AS income_basis FROM ({_PAGES}) p GROUP BY conv_id""",
)
def _(t):
    return merge.merge_pages(_pages(t), mode="bench").select("doc_id", "name", "income", "income_basis")


@query(
    "agg3_doc_quality",
    """SELECT CAST(l_orderkey AS STRING) AS doc_id, min(l_quantity * 5) AS blur_score, min(l_extendedprice / 1000) AS contrast_score,
         bool_or(l_quantity * 5 < 100 OR l_extendedprice / 1000 < 15) AS low_quality FROM {lineitem} GROUP BY 1""",
)
def _(t):
    blur, contrast = F.col("l_quantity") * 5, F.col("l_extendedprice") / 1000
    pages = t["lineitem"].select(
        F.col("l_orderkey").cast("string").alias("doc_id"), blur.alias("blur_score"), contrast.alias("contrast_score"), merge.low_quality(blur, contrast).alias("low_quality")
    )
    return merge.doc_quality(pages)


@query("agg11_any_list_filled", "SELECT doc_id, k % 6 = 0 AS filled, k % 2 = 0 AS has_total FROM {v_payslip_values}")
def _(t):
    df = extract_au.with_text_fields(t.spread("v_payslip"), keys=["phone"]).withColumns({k: F.array().cast("array<string>") for k in ("abn", "dates", "salary")})
    df = df.withColumn("total_equity", F.when(F.col("k") % 2 == 0, 1.0))
    return df.select("doc_id", merge.any_list_filled(df).alias("filled"), merge.has_any_total(df).alias("has_total"))


# --- VN fields -----------------------------------------------------------------------
_VN = {"cccd": V.CCCD, "phone": V.VN_PHONE, "dates": V.DATE, "salary": V.VN_SALARY}


def _vn_sql(p: str) -> str:
    return f"regexp_extract_all(text, '{_sql_braces(p.replace('(?U)', ''))}')"


@query(
    "exv1_regex_fields",
    "SELECT doc_id, " + ", ".join(f"{_joined(_vn_sql(p))} AS {k}" for k, p in _VN.items())
    + f", {_joined(f'list_filter({_vn_sql(V.TAX_CODE)}, lambda x: NOT list_contains({_vn_sql(V.VN_PHONE)}, x))')} AS tax_code FROM {{documents}}",
)
def _(t):
    return t.spread("documents").select("doc_id", *[F.array_join(c, "|").alias(k) for k, c in extract_vn.vn_regex_fields(F.col("text")).items()])


@query(
    "set2_minus_keep_dups",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n FROM {orders}",
)
def _(t):
    k = F.col("o_orderkey").cast("string")
    a = F.array(k, k, F.lit("x"))
    b = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(k))
    return t["orders"].select("o_orderkey", F.size(extract_vn.minus_keep_dups(a, b)).alias("n"))


_VN_DOC = """SELECT c_custkey AS k, c_name, 'Họ và tên: ' || CASE WHEN c_custkey % 4 = 0 THEN 'Người lao động' ELSE 'Duong Van ' || c_name END || chr(10) ||
   'Địa chỉ: ' || CASE WHEN c_custkey % 5 = 0 THEN '......' ELSE CAST(c_custkey AS STRING) || ' Lê Lợi' END || chr(10) || 'STK: ' || CAST(100000000 + c_custkey AS STRING) || chr(10) ||
   CASE WHEN c_custkey % 3 = 0 THEN 'Thực lĩnh (VND): ' ELSE 'Tổng thu nhập: ' END || CAST(5 + c_custkey % 90 AS STRING) || '.000.000 VND' AS text FROM {customer}"""


@query(
    "exv2_label_fields",
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN 'Duong Van ' || c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS STRING) || ' Lê Lợi' END AS address,
         CAST(100000000 + c_custkey AS STRING) AS bank_account FROM {customer}""",
)
def _(t):
    return t.sql(_VN_DOC).select("k", *[c.alias(n) for n, c in extract_vn.vn_label_fields(F.col("text")).items()])


@query(
    "exv3_cells",
    """SELECT CAST(c_custkey AS STRING) AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_name ELSE 'X ' || c_name END AS name,
         'Lane ' || CAST(c_custkey AS STRING) AS address FROM {customer}""",
)
def _(t):
    k, n = F.col("c_custkey"), F.col("c_name")
    empty = F.lit("")
    first = F.array(F.when(k % 3 == 2, F.concat(F.lit("Họ tên: X "), n)).otherwise("Họ tên"), F.when(k % 3 == 1, n).otherwise(empty))
    rows = F.array(first, F.array(empty, empty), F.array(F.lit("Địa chỉ"), F.concat(F.lit("Lane "), k.cast("string"))))
    cells = t["customer"].select(k.cast("string").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(rows).alias("row_idx", "cells"))
    return extract_vn.vn_cells(cells)


@query(
    "exv4_income",
    "SELECT c_custkey AS k, CAST((5 + c_custkey % 90) * 1000000 AS DOUBLE) AS amount, CASE WHEN c_custkey % 3 = 0 THEN 'net' ELSE 'gross' END AS basis FROM {customer}",
)
def _(t):
    return t.sql(_VN_DOC).select("k", extract_vn.vn_income(F.col("text")).alias("i")).select("k", "i.*")


@query(
    "exv5_restore_surname",
    "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Nguyễn' WHEN 1 THEN 'Dương' ELSE 'Smith' END || ' ' || c_name AS name FROM {customer}",
)
def _(t):
    k = F.col("c_custkey")
    lead = F.when(k % 3 == 0, "Nguyen  ").when(k % 3 == 1, "DUONG ").otherwise("Smith ")
    return t["customer"].select(k.alias("k"), extract_vn.restore_surname(F.concat(lead, "c_name")).alias("name"))


@query("exv6_strip_diacritics", "SELECT doc_id, strip_accents(text) = text AS plain, md5(strip_accents(text)) AS digest FROM {documents}")
def _(t):
    flat = cleaning.strip_diacritics(F.col("text"))
    return t.spread("documents").select("doc_id", (flat == F.col("text")).alias("plain"), F.md5(flat).alias("digest"))


# --- scoring -------------------------------------------------------------------------
def _prediction(t):
    return extract_au.with_text_fields(t.spread("v_payslip"), keys=["name", "bsb", "abn", "income"], is_person=lambda c: F.lit(False))


_CORRECT = "SELECT doc_id, field, expected, CASE WHEN field = 'income' THEN CAST(doc_id AS BIGINT) % 9 <> 0 AND CAST(doc_id AS BIGINT) % 7 <> 0 ELSE true END AS correct FROM {v_payslip_truth}"


@query("joi12_score_fields", f"SELECT doc_id, field, expected, correct FROM ({_CORRECT}) s")
def _(t):
    return scoring.score_fields(t["v_payslip_truth"], _prediction(t)).select("doc_id", "field", "expected", "correct")


@query("joi12_unanswered", "SELECT doc_id, field FROM {v_payslip_truth} WHERE CAST(doc_id AS BIGINT) % 50 = 0")
def _(t):
    answered = t.spread("v_payslip").filter(F.col("k") % 50 != 0)
    return scoring.unanswered(t["v_payslip_truth"], answered).select("doc_id", "field")


_PCT = "CAST(round(100.0 * count(*) FILTER (WHERE correct) / count(*), 1) AS DECIMAL(5,1))::VARCHAR || '%'"


@query(
    "agg4_accuracy_by_field",
    f"SELECT field, count(*) FILTER (WHERE correct) AS correct, count(*) AS total, {_PCT} AS pct FROM ({_CORRECT}) s GROUP BY field",
)
def _(t):
    return scoring.accuracy(scoring.score_fields(t["v_payslip_truth"], _prediction(t))).filter(F.col("field").isNotNull())


@query(
    "agg5_accuracy_rollup",
    f"SELECT field, count(*) FILTER (WHERE correct) AS correct, count(*) AS total, {_PCT} AS pct FROM ({_CORRECT}) s GROUP BY ROLLUP (field)",
)
def _(t):
    return scoring.accuracy(scoring.score_fields(t["v_payslip_truth"], _prediction(t)))


@query("agg6_list_recall", "SELECT count(*) AS correct, count(*) AS total FROM {v_payslip_truth} WHERE field = 'abn'")
def _(t):
    s = scoring.score_fields(t["v_payslip_truth"], _prediction(t)).filter(F.col("field") == "abn")
    return s.agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))


@query(
    "agg7_numeric_match",
    "SELECT count(*) FILTER (WHERE CAST(doc_id AS BIGINT) % 9 <> 0 AND CAST(doc_id AS BIGINT) % 7 <> 0) AS correct, count(*) AS total FROM {v_payslip_truth} WHERE field = 'income'",
)
def _(t):
    s = scoring.score_fields(t["v_payslip_truth"], _prediction(t)).filter(F.col("field") == "income")
    return s.agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))


_REPORT_FIELDS = ["name", "bsb", "abn", "phone", "income"]
_PAD = "CASE WHEN length(CAST({x} AS VARCHAR)) < 3 THEN lpad(CAST({x} AS VARCHAR), 3, ' ') ELSE CAST({x} AS VARCHAR) END"


@query(
    "snk2_report_lines",
    f"""SELECT line FROM (
      SELECT 'Documents scored: ' || CAST(count(DISTINCT doc_id) AS STRING) AS line FROM ({_CORRECT}) s
      UNION ALL SELECT '  ' || rpad(field, 15, ' ') || ': ' || {_PAD.format(x="c")} || ' / ' || {_PAD.format(x="n")} || '  (' || coalesce(p, 'n/a') || ')'
        FROM (SELECT f.field, coalesce(c, 0) AS c, coalesce(n, 0) AS n, p FROM (SELECT unnest({_REPORT_FIELDS}) AS field) f
          LEFT JOIN (SELECT field, count(*) FILTER (WHERE correct) AS c, count(*) AS n, {_PCT} AS p FROM ({_CORRECT}) s GROUP BY field) g ON g.field = f.field) h
      UNION ALL SELECT 'Overall: ' || CAST(count(*) FILTER (WHERE correct) AS STRING) || ' / ' || CAST(count(*) AS STRING) || '  (' || {_PCT} || ')' FROM ({_CORRECT}) s
      UNION ALL SELECT 'Misses (' || CAST(count(*) FILTER (WHERE NOT correct) AS STRING) || '):' FROM ({_CORRECT}) s
      UNION ALL SELECT '  ' || t.doc_id || ' field=income expected=' || t.expected || ' got=' || CASE WHEN v.pay >= 1000 THEN CAST(CAST(v.pay AS DOUBLE) + 0.5 AS VARCHAR) ELSE CAST(CAST(v.pay AS DOUBLE) + 0.5 AS VARCHAR) END
        FROM {{v_payslip_truth}} t JOIN {{v_payslip_values}} v ON v.doc_id = t.doc_id WHERE t.field = 'income' AND (v.k % 9 = 0 OR v.k % 7 = 0)) r""",
)
def _(t):
    # the written file, read back
    root = scratch_path(t.spark, "report")
    scoring.write_report(scoring.score_fields(t["v_payslip_truth"], _prediction(t)), root, _REPORT_FIELDS)
    return t.spark.read.text(root).select(F.col("value").alias("line"))


@query(
    "agg12_doc_groups",
    "SELECT count(DISTINCT l_orderkey) AS documents, count(*) AS page_images FROM {lineitem}",
)
def _(t):
    name = F.concat(F.lit("scan "), F.col("l_orderkey").cast("string"), F.lit("_p"), F.col("l_linenumber").cast("string"), F.lit(".png"))
    return scoring.doc_groups(t["lineitem"].select(name.alias("filename")))
