"""Field extraction from Australian contracts, payslips and balance sheets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .amounts import parse_amount
from .cleaning import clean_value, is_data, looks_like_name
from .text import find_all, first_not_null, leading_blanks, let, map_few, marked_pieces, match_spans, spans_of_pieces, strip


def first_accepted(text: Column, pattern: str, locale: str = "au") -> Column:
    """First label match whose value survives cleaning (WIN1), without a shuffle."""
    return first_not_null(F.transform(find_all(text, pattern, 1), lambda v: clean_value(v, locale)))


def regex_fields(text: Column) -> dict[str, Column]:
    """``abn, phone, dates, salary``: all matches, in order (EXT1)."""
    return {k: find_all(text, p) for k, p in V.AU_LISTS.items()}


def label_fields(text: Column) -> dict[str, Column]:
    """Label-anchored identity and bank fields (EXT2)."""
    return {k: first_accepted(text, p) for k, p in V.AU_LABELS.items()}


def _gross_before_net(gross: Column, net: Column) -> Column:
    def pick(pair: Column) -> Column:
        gross, net = pair["gross"], pair["net"]
        return F.struct(
            F.coalesce(gross, net).alias("amount"),
            F.when(gross.isNotNull(), F.lit("gross")).when(net.isNotNull(), F.lit("net")).alias("basis"),
        )

    return let(F.struct(gross.alias("gross"), net.alias("net")), pick)


def income(text: Column) -> Column:
    """``(amount, basis)``; every gross label is tried before any net label (EXT3)."""

    def first(basis: str) -> Column:
        amounts = F.transform(
            find_all(text, V.AU_INCOME[basis], 1), lambda v: parse_amount(clean_value(v))
        )
        return first_not_null(amounts)

    return _gross_before_net(first("gross"), first("net"))


def annual_salary(text: Column) -> Column:
    """Yearly salary printed with a ``$``; first match only (EXT4)."""
    return parse_amount(F.regexp_extract(text, V.ANNUAL_SALARY, 1))


def pay_period_days(text: Column) -> Column:
    """Days between the two dates of the first pay period, end exclusive; NULL for an
    impossible date (EXT5)."""
    start = F.try_to_date(F.nullif(F.regexp_extract(text, V.PAY_PERIOD, 1), F.lit("")), "dd/MM/yyyy")
    end = F.try_to_date(F.nullif(F.regexp_extract(text, V.PAY_PERIOD, 2), F.lit("")), "dd/MM/yyyy")
    return F.datediff(end, start)


def pay_period_error(text: Column) -> Column:
    """Message for a pay period whose dates cannot exist, else NULL (EXT5)."""
    bad = text.rlike(V.PAY_PERIOD) & pay_period_days(text).isNull()
    return F.when(bad, F.concat(F.lit("impossible pay period date: "), F.regexp_extract(text, V.PAY_PERIOD, 0)))


def reads_as_person(c: Column) -> Column:
    """Stand-in for a named-entity tagger: no digits, every word starts with a capital."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return ~c.rlike(r"(?U)\d") & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))


def context_name(text: Column, is_person=reads_as_person) -> Column:
    """Name next to a context word, used only when no label gave one (EXT6).

    ``is_person`` maps a candidate Column to a boolean Column; pass a tagger's verdict
    where one is available.
    """
    lines = F.split(text, "\n", -1)

    def accept(v: Column) -> Column:
        return F.when(looks_like_name(v) & is_person(v), v)

    def hits(all_lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            # lowered once for all words
            keyed = F.lower(line).rlike("|".join(map(re.escape, V.NAME_CONTEXT)))
            same = F.when(
                line.contains(":"),
                clean_value(F.substring(line, F.position(F.lit(":"), line) + 1, F.length(line))),
            )
            below = clean_value(strip(F.get(all_lines, i + 1)))
            return F.when(
                keyed, F.coalesce(let(same, accept), let(below, accept))
            )

        return first_not_null(F.transform(all_lines, one))

    return let(lines, hits)


def cleaned_hits(text: Column, pattern: str) -> Column:
    """``value, start, end`` of the matches whose captured value survives cleaning."""
    return clean_hits(match_spans(text, pattern, 1))


def clean_hits(spans: Column) -> Column:
    """The same of matches found before.

    Every label pattern ends with its capture group, so the group starts at the match end
    minus its length; blanks dropped by cleaning shift it right.
    """

    def place(span: Column) -> Column:
        raw = span["grp"]

        def placed(v: Column) -> Column:
            start = span["end"] - F.length(raw) + leading_blanks(raw)
            return let(start, lambda s: F.struct(v.alias("value"), s.alias("start"), (s + F.length(v)).alias("end")))

        return let(clean_value(raw), lambda v: F.when(v.isNotNull(), placed(v)))

    return F.array_compact(F.transform(spans, place))


CLEANED = {**V.AU_LABELS, **V.AU_INCOME}
_HIT = "__hits_"
CLEAN_SPANS = "array<struct<value:string,start:int,end:int>>"


# what every match in an ASCII text begins with
_BEGINS = {
    "abn": r"\d\d[ ]", "phone": "0[2-478]", "dates": r"\d\d/", "salary": "", "annual_salary": "[aA][nN]",
    **dict.fromkeys(["name", "address", "employer_name", "employer_address"], "[eEmM][mMpP]"),
    "bsb": "[bBsS][sSbB]", "account_number": "[aAcC][cC]",
    "gross": "[tToOgGrR][oOtTrR]", "net": "[nNeEtToO][eEtToO]",
}


def with_hits(df: DataFrame, text: str = "text") -> DataFrame:
    """One column for each pattern with all its matches and their places, from one pass of the
    pattern. Fields and spans are both read from these (``hits=hit_columns()``).

    They are columns of their own: a struct of them would be taken apart by the optimizer and
    its patterns searched again for every use. So are the steps to them."""
    c = F.col(text)
    searched = {k: (p, 0) for k, p in V.AU_LISTS.items()} | {k: (p, 1) for k, p in {"annual_salary": V.ANNUAL_SALARY, **CLEANED}.items()}
    out = df.withColumns({"__cut_" + k: marked_pieces(c, p, group, _BEGINS[k]) for k, (p, group) in searched.items()})
    # a null text has no lists, an empty one has empty lists
    out = out.withColumns({("__raw_" if k in CLEANED else _HIT) + k: spans_of_pieces(F.col("__cut_" + k), c, p, group) for k, (p, group) in searched.items()})
    out = out.withColumns({"__one_" + k: strip(F.get(F.col("__raw_" + k), F.lit(0))["grp"]) for k in CLEANED})
    out = out.withColumns({_HIT + k: _clean_few(F.col("__raw_" + k), F.col("__one_" + k)) for k in CLEANED})
    return out.select(*df.columns, *hit_columns().values())


def _clean_few(spans: Column, one: Column) -> Column:
    """``clean_hits`` of a column; ``one`` is the first match's stripped group."""
    first = F.get(spans, F.lit(0))
    start = first["end"] - F.length(first["grp"]) + leading_blanks(first["grp"])
    hit = F.struct(one.alias("value"), start.alias("start"), (start + F.length(one)).alias("end"))
    none = F.array().cast(CLEAN_SPANS)
    return (
        F.when(F.size(spans) == 0, none)
        .when(F.size(spans) == 1, F.when(is_data(one), F.array(hit)).otherwise(none))
        .otherwise(clean_hits(spans))
    )


def hit_columns() -> dict[str, Column]:
    return {k: F.col(_HIT + k) for k in [*V.AU_LISTS, "annual_salary", *CLEANED]}


def _fields_of_hits(hits: dict[str, Column]) -> dict[str, Column]:
    """EXT1 to EXT4 from all matches."""
    out = {k: map_few(hits[k], "array<string>", lambda s: s["value"]) for k in V.AU_LISTS}
    out |= {k: F.get(hits[k], F.lit(0))["value"] for k in V.AU_LABELS}
    first = {b: first_not_null(map_few(hits[b], "array<double>", lambda s: parse_amount(s["value"]))) for b in V.AU_INCOME}
    out["__income"] = _gross_before_net(first["gross"], first["net"])
    out["annual_salary"] = parse_amount(F.get(hits["annual_salary"], F.lit(0))["grp"])
    return out


FIELD_TYPES = {
    "abn": "array<string>", "phone": "array<string>", "dates": "array<string>", "salary": "array<string>",
    "name": "string", "address": "string", "employer_name": "string", "employer_address": "string",
    "bsb": "string", "account_number": "string", "income": "double", "income_basis": "string",
    "annual_salary": "double", "pay_period_days": "int",
    "total_current_assets": "double", "total_assets": "double", "total_current_liabilities": "double",
    "total_liabilities": "double", "total_equity": "double",
}
TEXT_KEYS = [k for k in FIELD_TYPES if k not in V.BALANCE_KEYS]


def with_text_fields(df: DataFrame, text: str = "text", is_person=reads_as_person, keys: list[str] | None = None, hits: dict[str, Column] | None = None) -> DataFrame:
    """Add one column per text field (EXT1-6). ``keys`` limits the work to the fields a
    caller needs; each pattern is a pass over the text, unless its matches are in ``hits``."""
    c = F.col(text)
    want = set(keys or TEXT_KEYS)
    if want & {"income", "income_basis"}:
        want.add("__income")
    if hits:
        cols = _fields_of_hits(hits)
    else:
        cols = {**regex_fields(c), **label_fields(c), "__income": income(c), "annual_salary": annual_salary(c)}
    cols = {k: v for k, v in cols.items() if k in want}
    if "pay_period_days" in want:
        cols["pay_period_days"] = pay_period_days(c)
    out = df.withColumns(cols)
    if "name" in want:
        out = out.withColumn("name", F.coalesce(F.col("name"), context_name(c, is_person)))
    if "__income" in cols:
        out = out.withColumns(
            {"income": F.col("__income.amount"), "income_basis": F.col("__income.basis")}
        ).drop("__income")
    return out


def suppress_salary(df: DataFrame) -> DataFrame:
    """A document with any balance-sheet total has no salary list (EXT7)."""
    found = F.coalesce(*[F.col(k) for k in V.BALANCE_KEYS]).isNotNull()
    return df.withColumn("salary", F.when(found, F.array().cast("array<string>")).otherwise(F.col("salary")))
