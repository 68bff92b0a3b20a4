"""Balance-sheet reader over table rows ``doc_id, page, row_idx, cells``.

The reader writes its blocks once and is a lazy plan from there:

1. per row, without a shuffle: classify cells (header, bare total, label, possible misread
   label) and find the period column it declares; blank rows go;
2. rows meet once, in blocks of a page (up to 4,096 rows): a row array in order;
3. per block one slim row: the section left open (WIN2) and the period column (WIN3) are carried
   over the blocks and pages of a document;
4. in the block's row: the section of each bare total, misread labels, and the values before,
   after or below each kept cell (BAL2, BAL3);
5. per page a fold over its kept cells settles the fields (WIN4, WIN5), exact labels before
   misread ones; then per document the first page with a value wins.

A page of several blocks is folded from the cells that can settle a field at all: a cell that
settles nothing while some fields are settled settles nothing when more are, so from each of
the 32 sets of settled fields a block has at most five such cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.amounts import parse_amount_bs
from ..functions.fuzzy import fuzzy_labels, plausible
from ..functions.text import despace, find_all, is_ascii, let, strip
from ..session import cut
from .ordered import carry_last, carry_several

KEYS = V.BALANCE_KEYS
_SECTIONS = ("assets", "liabilities", "other", "total")
ROW_BLOCK = 4096
PAGE_BLOCK = 1024


# every period word contains one of these once blanks are gone
_PERIOD_HINT = r"(?iU)CURRENT|THISY|PRIOR|PREVIOUS|LASTY|Y\d|YEAR\d"
_PERIOD_WORDS = ["current", "thisy", "prior", "previous", "lasty"]
# headers, totals, labels and misread labels all contain two letters side by side once blanks
# are gone
_LETTERS = r"(?U)\p{L}[\s\x1c-\x1f]*\p{L}"

# any of the labels
_ANY_LABEL = f"(?iU)(?:{'|'.join(V.BALANCE_LABELS.values())})"


def label_pattern(field: str) -> str:
    return f"(?iU)(?:{V.BALANCE_LABELS[field]})"


def value_pattern(field: str) -> str:
    return f"(?iU)(?:{V.BALANCE_LABELS[field]}){V.BALANCE_VALUE_SUFFIX}"


def period_kind(cell: Column) -> Column:
    """``(kind, number)`` of a header cell: current, prior, numbered or NULL; the raw text
    first, the text without blanks only when the raw text says nothing (MAT4)."""

    def says_something(c: Column) -> Column:
        return c.rlike(V.PERIOD_CURRENT) | c.rlike(V.PERIOD_PRIOR) | c.rlike(V.PERIOD_NUMBERED)

    def kind(c: Column) -> Column:
        # only digits are cast: a failed cast costs an exception
        number = F.when(c.rlike(V.PERIOD_NUMBERED), F.regexp_extract(c, V.PERIOD_NUMBERED, 1).try_cast("decimal(38,0)"))
        return F.struct(
            F.when(c.rlike(V.PERIOD_CURRENT), "current")
            .when(c.rlike(V.PERIOD_PRIOR), "prior")
            .when(c.rlike(V.PERIOD_NUMBERED), "numbered")
            .alias("kind"),
            number.alias("number"),
        )

    return let(
        strip(cell), lambda raw: let(F.when(says_something(raw), raw).otherwise(despace(raw)), kind)
    )


def row_period_column(cells: Column) -> Column:
    """Column this row declares as the current period, or NULL (BAL1)."""
    kinds = F.transform(
        cells,
        lambda c, i: let(
            period_kind(c), lambda k: F.struct(k["kind"].alias("kind"), k["number"].alias("number"), i.alias("col"))
        ),
    )

    def decide(found: Column) -> Column:
        current = F.array_max(F.transform(F.filter(found, lambda k: k["kind"] == "current"), lambda k: k["col"]))
        numbered = F.array_max(
            F.transform(
                F.filter(found, lambda k: k["kind"] == "numbered"),
                lambda k: F.struct(k["number"].alias("number"), k["col"].alias("col")),
            )
        )
        return F.when(F.size(found) >= 2, F.coalesce(current, numbered["col"]))

    # most rows hold no period word at all: one scan of the joined row settles those
    def hinted(flat: Column) -> Column:
        low = F.lower(flat)
        plain = reduce(lambda a, b: a | b, [low.contains(w) for w in _PERIOD_WORDS]) | low.rlike("y(?:ear)?[0-9]")
        return F.when(is_ascii(flat), plain).otherwise(flat.rlike(_PERIOD_HINT))

    return F.when(let(despace(F.array_join(cells, " ")), hinted), let(F.filter(kinds, lambda k: k["kind"].isNotNull()), decide))


def page_period_columns(rows: DataFrame) -> DataFrame:
    """``doc_id, page, detected``: the first deciding row of each page (BAL1)."""
    declared = rows.withColumn("__col", row_period_column(F.col("cells")))
    return declared.groupBy("doc_id", "page").agg(
        F.min_by("__col", F.when(F.col("__col").isNotNull(), F.col("row_idx"))).alias("detected")
    )


def period_columns(rows: DataFrame) -> DataFrame:
    """``doc_id, page, prefer_col``: the page's own period column, else the last one
    detected on an earlier page; never reset (WIN3)."""
    carried = carry_last(
        page_period_columns(rows),
        ["doc_id"],
        ["page"],
        F.col("detected"),
        "prefer_col",
        [F.floor(F.col("page") / PAGE_BLOCK)],
        inclusive=True,
    )
    return carried.select("doc_id", "page", "prefer_col")


def last_amount(cells: Column, first_col: Column, prefer_col: Column) -> Column:
    """Last amount of a run of cells, or the one in the preferred column; the run ends at
    the first other text that is not just a currency symbol (BAL2)."""
    start = F.struct(
        F.lit(False).alias("stopped"),
        F.lit(None).cast("double").alias("last"),
        F.lit(None).cast("double").alias("preferred"),
        first_col.cast("int").alias("col"),
    )

    def step(acc: Column, cell: Column) -> Column:
        def move(amount: Column) -> Column:
            text = strip(cell)
            stop = acc["stopped"] | (amount.isNull() & (text != "") & ~text.rlike(V.BARE_SYMBOL))
            use = ~acc["stopped"] & amount.isNotNull()
            here = use & (acc["col"] == prefer_col)
            return F.struct(
                stop.alias("stopped"),
                F.when(use, amount).otherwise(acc["last"]).alias("last"),
                F.when(F.coalesce(here, F.lit(False)), amount).otherwise(acc["preferred"]).alias("preferred"),
                (acc["col"] + 1).alias("col"),
            )

        return let(parse_amount_bs(cell), move)

    return F.aggregate(cells, start, step, lambda acc: F.coalesce(acc["preferred"], acc["last"]))


def is_section_header(cells: Column, i: Column) -> Column:
    """No other cell of the row has a ``$`` or a digit (BAL5)."""
    numeric = F.transform(cells, lambda c: c.rlike(r"(?U)[$\d]").cast("int"))
    total = F.aggregate(numeric, F.lit(0), lambda a, n: a + n)
    return total - F.get(numeric, i) == 0


def label_hits(cell: Column) -> Column:
    """Fields named in one cell, in order of appearance, ``[]`` when it holds a ``/`` (BAL4)."""
    return F.when(cell.contains("/"), F.array().cast("array<string>")).otherwise(let(despace(cell), _fields_named))


def _fields_named(text: Column) -> Column:
    """Fields named in the text of a cell without its blanks, in order of appearance."""
    found = F.array(
        *[
            F.when(
                text.rlike(label_pattern(f)),
                F.struct(F.regexp_instr(text, F.lit(label_pattern(f))).alias("pos"), F.lit(f).alias("field")),
            )
            for f in KEYS
        ]
    )
    named = F.transform(F.array_sort(F.filter(found, lambda h: h.isNotNull())), lambda h: h["field"])
    return F.when(text.rlike(_ANY_LABEL), named).otherwise(F.array().cast("array<string>"))


def _marks(cells: Column, numeric: Column, n: Column) -> Column:
    """The cells of a row that the reader looks at, with their kind; ``numeric`` tells which cells have a
    ``$`` or digit, ``n`` how many."""

    def one(cell: Column, i: Column) -> Column:
        def mark(raw: Column) -> Column:
            def with_flat(flat: Column) -> Column:
                alone = n - F.get(numeric, i) == 0
                assets, liabilities = flat.rlike(V.SECTION_ASSETS), flat.rlike(V.SECTION_LIABILITIES)
                header = assets | liabilities | flat.rlike(V.SECTION_OTHER)

                def with_fields(fields: Column) -> Column:
                    kind = (
                        F.when(alone & assets, "assets")
                        .when(alone & liabilities, "liabilities")
                        .when(alone & header, "other")
                        .when(flat.rlike(V.BARE_TOTAL), "total")
                        .when(raw.contains("/"), F.lit(None))
                        .when(F.size(fields) > 0, "label")
                        .when(~header & plausible(raw), "text")
                    )
                    return F.struct(
                        i.alias("col"), kind.alias("kind"), raw.alias("text"), fields.alias("fields"),
                        (~header).alias("may_be_misread"),
                    )

                fields = F.when(raw.contains("/"), F.array().cast("array<string>")).otherwise(_fields_named(flat))
                return let(fields, with_fields)

            return let(despace(raw), with_flat)

        return F.when(cell.rlike(_LETTERS), let(strip(cell), mark))

    return F.filter(F.transform(cells, one), lambda m: m["kind"].isNotNull())


def _with_numeric(rows: DataFrame) -> DataFrame:
    """Add ``__numeric`` (which cells have a ``$`` or digit) and ``__n`` (how many)."""
    numeric = F.transform("cells", lambda c: F.coalesce(c.rlike(r"[$0-9]") | (~is_ascii(c) & c.rlike(r"(?U)\d")), F.lit(False)).cast("int"))
    return rows.withColumn("__numeric", numeric).withColumn("__n", F.aggregate("__numeric", F.lit(0), lambda a, n: a + n))


def marked_cells(rows: DataFrame) -> DataFrame:
    """The cells the reader looks at, one row each, with their kind (BAL4, BAL5); other
    columns of ``rows`` are kept.

    ``kind``: ``assets`` / ``liabilities`` / ``other`` section header, ``total``,
    ``label`` (with ``fields``) or ``text`` (a possible misread label).
    """
    marks = _marks(F.col("cells"), F.col("__numeric"), F.col("__n"))
    return (
        # outer: an inner explode would make the optimizer classify every cell twice
        _with_numeric(rows).withColumn("__m", F.explode_outer(marks))
        .filter(F.col("__m").isNotNull())
        .drop("__numeric", "__n")
        .select("*", "__m.*")
        .drop("__m")
    )


def _with_section(marked: DataFrame) -> DataFrame:
    """Add ``before``: the kind of the last header or bare total before each cell."""
    return carry_last(
        marked,
        ["doc_id"],
        ["page", "row_idx", "col"],
        F.when(F.col("kind").isin(*_SECTIONS), F.col("kind")),
        "before",
        [F.col("page"), F.floor(F.col("row_idx") / ROW_BLOCK)],
    )


def _section_field() -> Column:
    return F.when(F.col("before") == "assets", "total_current_assets").when(
        F.col("before") == "liabilities", "total_current_liabilities"
    )


def section_at(marked: DataFrame) -> DataFrame:
    """Bare totals with the field of the section they close; NULL when no open section
    precedes them (WIN2). The event before a total decides: a header opens its section,
    any other header and every total closes it, across pages."""
    # written once: cells are classified for it, and the carry reads its input twice
    events = cut(marked.filter(F.col("kind").isin(*_SECTIONS)))
    return (
        _with_section(events)
        .filter(F.col("kind") == "total")
        .withColumn("section_field", _section_field())
        .drop("before")
    )


def with_row_below(rows: DataFrame) -> DataFrame:
    """Add ``below``: the cells of the next row of the page that is not blank (BAL3)."""
    return carry_last(
        rows,
        ["doc_id", "page"],
        ["row_idx"],
        F.when(F.exists("cells", lambda c: strip(c) != ""), F.col("cells")),
        "below",
        [F.floor(F.col("row_idx") / ROW_BLOCK)],
        descending=True,
        beyond_first=F.col("row_idx") >= ROW_BLOCK,
    )


def own_row_value(cells: Column, i: Column, prefer_col: Column) -> Column:
    """Value standing before a cell in its row, else after it (BAL3)."""
    before = last_amount(F.slice(cells, F.lit(1), i), F.lit(0), prefer_col)
    after = last_amount(F.slice(cells, i + 2, F.size(cells)), i + 1, prefer_col)
    return F.coalesce(before, after)


#: Cells of a block that are folded as they are.
_FOLDED = 64
_KEPT = "array<struct<row_idx:int,col:int,fields:array<int>,misread:int,vals:array<double>>>"


def _places(fields: Column) -> Column:
    """Field names as their places in KEYS."""
    keys = F.array(*[F.lit(k) for k in KEYS])
    return F.transform(fields, lambda f: (F.array_position(keys, f) - 1).cast("int"))


def _row_blocks(rows: DataFrame) -> DataFrame:
    """``doc_id, page, block, rows``: the rows of a page that are not blank, in order, with their marks and the
    period column they declare."""

    def slim(m: Column) -> Column:
        may_be = m["kind"].isin("text", "label") & m["may_be_misread"] & plausible(m["text"])
        return F.struct(m["col"].cast("int").alias("col"), m["kind"].alias("kind"), m["fields"].alias("fields"), F.when(may_be, m["text"]).alias("guess"))

    marks = F.transform(_marks(F.col("cells"), F.col("__numeric"), F.col("__n")), slim)
    record = F.struct(F.col("row_idx").cast("int").alias("row_idx"), row_period_column(F.col("cells")).cast("int").alias("declared"), marks.alias("marks"), "cells")
    some = rows.filter(F.exists("cells", lambda c: strip(c) != ""))
    return (
        # never null: blocks meet their slim rows again by it
        _with_numeric(some).withColumn("block", F.coalesce(F.floor(F.col("row_idx") / ROW_BLOCK), F.lit(0).cast("long")))
        .groupBy("doc_id", "page", "block").agg(F.sort_array(F.collect_list(record)).alias("rows"))
    )


def _carried(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, block`` with ``before`` (the last section event before the block), ``prefer_col`` of its page, and
    ``next_cells``, the first row of the page's next block."""
    rows = F.col("rows")
    events = F.filter(F.flatten(F.transform(rows, lambda r: r["marks"])), lambda m: m["kind"].isin(*_SECTIONS))
    declared = F.filter(F.transform(rows, lambda r: r["declared"]), lambda d: d.isNotNull())
    slim = blocks.select(
        "doc_id", "page", "block", F.get(events, F.size(events) - 1)["kind"].alias("event"), F.get(declared, F.lit(0)).alias("declared"),
        F.get(rows, F.lit(0))["cells"].alias("first_cells"),
    )
    page = W.partitionBy("doc_id", "page").orderBy("block")
    whole = page.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    paged = slim.withColumns({"declared": F.first("declared", ignorenulls=True).over(whole), "next_cells": F.lead("first_cells").over(page)})
    values = {"before": (F.col("event"), False), "prefer_col": (F.col("declared"), True)}
    return carry_several(paged, ["doc_id"], ["page", "block"], values, [F.floor(F.col("page") / PAGE_BLOCK)]).drop("event", "declared", "first_cells")


def _resolved(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, block, kept``: the cells of a block that name fields, each with the value it gives at every
    column offset; cells without any value go."""
    rows = F.col("rows")

    def entries(r: Column, i: Column) -> Column:
        below = F.coalesce(F.get(rows, i + 1)["cells"], F.col("next_cells"))
        return F.transform(r["marks"], lambda m: F.struct(r["row_idx"].alias("row_idx"), m.alias("m"), r["cells"].alias("cells"), below.alias("below")))

    flat = blocks.withColumn("entries", F.flatten(F.transform(rows, entries))).drop("rows", "next_cells")
    named = flat.withColumn("misread", fuzzy_labels(F.transform("entries", lambda e: e["m"]["guess"])))
    keys = {"assets": KEYS.index("total_current_assets"), "liabilities": KEYS.index("total_current_liabilities")}
    kind = "array<struct<i:int,fields:array<int>>>"
    start = F.struct(F.col("before").alias("open"), F.lit(0).alias("i"), F.array().cast(kind).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        what = e["m"]["kind"]
        opened = F.when(acc["open"] == "assets", keys["assets"]).when(acc["open"] == "liabilities", keys["liabilities"])
        fields = F.when(what == "total", F.array_compact(F.array(opened))).when(what == "label", _places(e["m"]["fields"]))
        here = F.struct(acc["i"].alias("i"), F.coalesce(fields, F.array().cast("array<int>")).alias("fields"))
        names = what.isin("text", "label") | ((what == "total") & opened.isNotNull())
        return F.struct(
            F.when(what.isin(*_SECTIONS), what).otherwise(acc["open"]).alias("open"), (acc["i"] + 1).alias("i"),
            F.when(names, F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"),
        )

    def valued(x: Column) -> Column:
        e, misread = F.get(F.col("entries"), x["i"]), F.get(F.col("misread"), x["i"])

        def with_own(own: Column) -> Column:
            offsets = F.sequence(F.lit(0), F.greatest(F.size(x["fields"]) - 1, F.lit(0)))
            vals = F.transform(offsets, lambda o: F.coalesce(own, parse_amount_bs(F.get(e["below"], e["m"]["col"] + o))))
            place = F.get(_places(F.array(misread)), F.lit(0))
            return F.struct(
                e["row_idx"].alias("row_idx"), e["m"]["col"].alias("col"), x["fields"].alias("fields"), F.when(place >= 0, place).alias("misread"), vals.alias("vals")
            )

        return let(own_row_value(e["cells"], e["m"]["col"], F.col("prefer_col")), with_own)

    named = named.withColumn("named", F.aggregate("entries", start, step, lambda acc: acc["out"]))
    useful = F.filter("named", lambda x: (F.size(x["fields"]) > 0) | F.get(F.col("misread"), x["i"]).isNotNull())
    kept = F.filter(F.transform(useful, valued), lambda k: F.exists(k["vals"], lambda v: v.isNotNull()))
    return named.select("doc_id", "page", "block", kept.cast(_KEPT).alias("kept"))


def _settle(acc: Column, cell: Column) -> Column:
    """One cell's turn: its label's rank among the fields still missing picks the column (WIN5)."""
    missing = F.filter(cell["fields"], lambda f: F.get(acc, f).isNull())

    def take(left: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            rank = (F.array_position(left, i) - 1).cast("int")
            value = F.get(cell["vals"], F.when(F.size(left) > 1, rank).otherwise(F.lit(0)))
            return F.coalesce(v, F.when(rank >= 0, value))

        return F.when(F.size(left) > 0, F.transform(acc, one)).otherwise(acc)

    return let(missing, take)


def _thinned(kept: Column) -> Column:
    """Of many cells those that can settle a field, whatever is settled before."""
    sets = F.sequence(F.lit(0), F.lit(2 ** len(KEYS) - 1))
    numbered = F.transform(kept, lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def hits(settled: Column) -> Column:
        known = F.transform(F.sequence(F.lit(0), F.lit(len(KEYS) - 1)), lambda b: F.when(F.pmod(F.floor(settled / F.pow(F.lit(2), b)), F.lit(2)) == 1, F.lit(0.0)))
        start = F.struct(known.cast("array<double>").alias("acc"), F.array().cast("array<int>").alias("hits"))

        def step(state: Column, x: Column) -> Column:
            def compare(after: Column) -> Column:
                count = lambda a: F.size(F.filter(a, lambda v: v.isNotNull()))
                changed = count(after) > count(state["acc"])
                return F.struct(after.alias("acc"), F.when(changed, F.array_append(state["hits"], x["i"])).otherwise(state["hits"]).alias("hits"))

            return let(_settle(state["acc"], x["c"]), compare)

        return F.aggregate(numbered, start, step, lambda state: state["hits"])

    misread = F.transform(
        F.sequence(F.lit(0), F.lit(len(KEYS) - 1)),
        lambda f: F.get(F.filter(numbered, lambda x: (x["c"]["misread"] == f) & F.get(x["c"]["vals"], F.lit(0)).isNotNull()), F.lit(0))["i"],
    )
    wanted = F.array_distinct(F.concat(F.flatten(F.transform(sets, hits)), F.array_compact(misread)))
    return let(wanted, lambda w: F.filter(kept, lambda c, i: F.array_contains(w, i)))


def read_pages(rows: DataFrame) -> DataFrame:
    """Totals of every page that has any, ``doc_id, page`` and one column per field (BAL6).

    Inside a page an exact label beats a misread one; misread labels fill what is missing.
    """
    # written once: every cell is classified for it, and it is read for the slim rows and for itself
    blocks = cut(_row_blocks(rows.select("doc_id", "page", "row_idx", "cells")))
    known = _resolved(blocks.join(_carried(blocks), ["doc_id", "page", "block"]))
    useful = F.when(F.size("kept") > _FOLDED, _thinned(F.col("kept"))).otherwise(F.col("kept"))
    pages = (
        known.withColumn("kept", useful)
        .groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("block", "kept"))).alias("x"))
        .select("doc_id", "page", F.flatten(F.transform("x", lambda b: b["kept"])).alias("kept"))
    )
    nothing = F.array(*[F.lit(None).cast("double") for _ in KEYS])

    def guess(acc: Column, cell: Column) -> Column:
        given = F.transform(acc, lambda v, i: F.coalesce(v, F.when(cell["misread"] == i, F.get(cell["vals"], F.lit(0)))))
        return F.when(cell["misread"].isNotNull(), given).otherwise(acc)

    exact = pages.withColumn("exact", F.aggregate("kept", nothing, _settle))
    # exploded from one element: a filter on its fields does not fold the cells again
    settled = exact.select("doc_id", "page", F.explode(F.array(let(F.aggregate("kept", F.col("exact"), guess), _named_fields))).alias("s"))
    return settled.select("doc_id", "page", "s.*").filter(F.coalesce(*[F.col(f) for f in KEYS]).isNotNull())


def _named_fields(values: Column) -> Column:
    return F.struct(*[F.get(values, F.lit(i)).alias(k) for i, k in enumerate(KEYS)])


def read_balance_sheet(rows: DataFrame) -> DataFrame:
    """Totals of every document: the first page with a value wins, per field (BAL6)."""
    return first_page_wins(read_pages(rows))


def first_page_wins(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per document and key, the value of the first page that has one (WIN4)."""
    keys = keys or KEYS
    return pages.groupBy("doc_id").agg(
        *[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("page"))).alias(k) for k in keys]
    )


def plain_text_value(text: Column, field: str) -> Column:
    """Last ``$`` amount between a label and the next label or ``Total`` in running text;
    NULL unless there are at least two amounts (BAL8)."""
    others = "|".join([*(f"(?:{V.BALANCE_LABELS[f]})" for f in KEYS), "Total"])
    window = f"(?iUs)(?:{V.BALANCE_LABELS[field]})(.*?)(?={others}|\\z)"

    def last_of(amounts: Column) -> Column:
        return F.when(F.size(amounts) > 1, F.element_at(amounts, -1))

    def read(flat: Column) -> Column:
        amounts = F.filter(
            F.transform(find_all(F.regexp_extract(flat, window, 1), V.BARE_AMOUNT), parse_amount_bs),
            lambda a: a.isNotNull(),
        )
        return F.when(flat.rlike(label_pattern(field)), let(amounts, last_of))

    return let(F.regexp_replace(text, r"[\r\n]", ""), read)


def cross_check(df: DataFrame, text: str = "text") -> DataFrame:
    """Override a total found in a table when running text disagrees (BAL9)."""

    def one(field: str) -> Column:
        table = F.col(field)
        return F.when(
            table.isNotNull(),
            let(
                plain_text_value(F.col(text), field),
                lambda plain: F.when(plain.isNotNull() & (F.abs(plain - table) >= V.MONEY_TOLERANCE), plain).otherwise(
                    table
                ),
            ),
        )

    return df.withColumns({f: one(f) for f in KEYS})


def missing_fields(df: DataFrame, keys: list[str] | None = None) -> Column:
    """Configured fields a row has no value for (SET3)."""
    keys = keys or KEYS
    have = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys]))
    return F.array_except(F.array(*[F.lit(k) for k in keys]), have)


def needs_balance_check(df: DataFrame) -> Column:
    """A check runs when one of four totals is present; total assets alone do not count (RUL4)."""
    return reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in V.READINESS_TRIGGER_KEYS])
