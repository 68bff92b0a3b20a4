"""Queries over table rows, cells, fragments, words and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text
from ..functions.extract_au import hit_columns, with_hits, with_text_fields
from ..functions.fuzzy import fuzzy_label, plausible
from ..operators import balance as B
from ..operators import geometry as G
from ..operators import ordered, scoring
from .q_text import _SPANS
from .registry import query

KEYS = V.BALANCE_KEYS
# what the printed balance sheets of v_balance_lines hold
_SHIFT = "CASE WHEN k % 3 = 1 THEN 0 ELSE 7 END"


def _rows(t):
    return t["v_balance_lines"].select("doc_id", "k", "page", "row_idx", F.split("line", r"\|", -1).alias("cells"))


def _dollars(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("$"), c.cast("string"))


@query(
    "bal1_period_column",
    "SELECT doc_id, page, CASE WHEN page = 0 THEN CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END END AS detected FROM {v_balance_lines} GROUP BY doc_id, page, k",
)
def _(t):
    return B.page_period_columns(_rows(t))


@query("win3_period_carry", "SELECT doc_id, page, CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS prefer_col FROM {v_balance_lines} GROUP BY doc_id, page, k")
def _(t):
    return B.period_columns(_rows(t))


@query(
    "mat4_period_kind",
    """SELECT doc_id, page, row_idx, CAST(i - 1 AS INT) AS cell, CASE WHEN c IN ('Year 1', 'Year 2') THEN 'numbered' WHEN contains(lower(c), 'current') THEN 'current' WHEN c = 'PRIOR YEAR' THEN 'prior' END AS kind
       FROM (SELECT doc_id, page, row_idx, unnest(string_split(line, '|')) AS c, generate_subscripts(string_split(line, '|'), 1) AS i FROM {v_balance_lines}) s""",
)
def _(t):
    cells = _rows(t).select("doc_id", "page", "row_idx", F.posexplode("cells").alias("cell", "c"))
    return cells.select("doc_id", "page", "row_idx", "cell", B.period_kind(F.col("c"))["kind"].alias("kind"))


@query(
    "win2_section_at",
    """SELECT doc_id, page, CASE WHEN page = 0 THEN 'total_current_assets' ELSE 'total_current_liabilities' END AS section_field
       FROM {v_balance_lines} WHERE line LIKE 'Total|%'""",
)
def _(t):
    return B.section_at(B.marked_cells(_rows(t))).select("doc_id", "page", "section_field")


@query(
    "bal2_last_amount",
    """SELECT doc_id, page, row_idx,
         CAST(CASE row WHEN '0.2' THEN current_assets + 7 WHEN '0.3' THEN assets + 7 WHEN '1.0' THEN current_liabilities + 7 WHEN '1.1' THEN liabilities + 7 WHEN '1.4' THEN 3 END AS DOUBLE) AS last,
         CAST(CASE row WHEN '0.2' THEN current_assets WHEN '0.3' THEN assets WHEN '1.0' THEN current_liabilities WHEN '1.1' THEN liabilities WHEN '1.4' THEN 3 END AS DOUBLE) AS preferred
       FROM (SELECT l.doc_id, page, row_idx, CAST(page AS VARCHAR) || '.' || CAST(row_idx AS VARCHAR) AS row, v.current_assets, v.assets, v.current_liabilities, v.liabilities
             FROM {v_balance_lines} l JOIN {v_balance} v ON v.doc_id = l.doc_id WHERE NOT (page = 0 AND row_idx = 0)) s""",
)
def _(t):
    # every row under the head: the amounts after its first cell
    rows = _rows(t).filter(~((F.col("page") == 0) & (F.col("row_idx") == 0)))
    values = F.slice("cells", 2, 5)
    none = F.lit(None).cast("int")
    return rows.select("doc_id", "page", "row_idx", B.last_amount(values, F.lit(1), none).alias("last"), B.last_amount(values, F.lit(1), F.lit(1)).alias("preferred"))


@query(
    "bal3_value_below",
    """SELECT doc_id, page, row_idx, lead(CASE WHEN replace(line, '|', '') <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY row_idx) AS below FROM {v_balance_lines}""",
)
def _(t):
    return B.with_row_below(_rows(t)).select("doc_id", "page", "row_idx", F.array_join("below", "|").alias("below"))


_CELLS = """SELECT doc_id, page, row_idx, CAST(i - 1 AS INT) AS cell, c FROM (
    SELECT doc_id, page, row_idx, unnest(string_split(line, '|')) AS c, generate_subscripts(string_split(line, '|'), 1) AS i FROM {v_balance_lines}) s"""


def _cells(t):
    return _rows(t).select("doc_id", "page", "row_idx", "cells", F.posexplode("cells").alias("cell", "c"))


@query(
    "bal4_label_hits",
    f"""SELECT doc_id, page, row_idx, cell, CASE WHEN c = 'TOTAL ASSETS' THEN 'total_assets' WHEN c = 'TOTAL LIABILITIES' THEN 'total_liabilities'
         WHEN c LIKE 'NET ASSETS%' THEN 'total_equity' ELSE '' END AS hits FROM ({_CELLS}) x""",
)
def _(t):
    return _cells(t).select("doc_id", "page", "row_idx", "cell", F.array_join(B.label_hits(F.col("c")), ",").alias("hits"))


@query(
    "bal5_is_section_header",
    "SELECT doc_id, page, row_idx, NOT regexp_matches(substr(line, position('|' in line)), '[$0-9]') AS header FROM {v_balance_lines}",
)
def _(t):
    return _rows(t).select("doc_id", "page", "row_idx", B.is_section_header(F.col("cells"), F.lit(0)).alias("header"))


@query(
    "mat2_fuzzy_label",
    f"""SELECT doc_id, page, row_idx, cell, CASE c WHEN 'TOTAL ASSETS' THEN 'total_assets' WHEN 'TOTAL LIABILITIES' THEN 'total_liabilities'
         WHEN 'Total Liabililies' THEN 'total_liabilities' END AS field FROM ({_CELLS}) x""",
)
def _(t):
    may_be = plausible(F.col("c"))
    return _cells(t).select("doc_id", "page", "row_idx", "cell", F.when(may_be, fuzzy_label(F.when(may_be, F.col("c")))).alias("field"))


@query(
    "bal6_read_balance_sheet",
    f"""SELECT doc_id, CAST(current_assets + {_SHIFT} AS DOUBLE) AS total_current_assets, CAST(assets + {_SHIFT} AS DOUBLE) AS total_assets,
          CAST(current_liabilities + {_SHIFT} AS DOUBLE) AS total_current_liabilities, CAST(liabilities + {_SHIFT} AS DOUBLE) AS total_liabilities,
          CAST(assets AS DOUBLE) AS total_equity FROM {{v_balance}}""",
)
def _(t):
    return B.read_balance_sheet(_rows(t))


@query(
    "win4_first_page_wins",
    "SELECT CAST(conv_id AS STRING) AS doc_id, arg_min(length(text), turn) FILTER (WHERE length(text) % 3 = 0) AS total_assets FROM {conversations} GROUP BY 1",
)
def _(t):
    n = F.length("text").cast("long")
    pages = t["conversations"].select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("page"), F.when(n % 3 == 0, n).alias("total_assets"))
    return B.first_page_wins(pages, ["total_assets"])


@query(
    "win5_label_rank",
    """SELECT doc_id, CAST(current_assets AS DOUBLE) AS total_current_assets, CAST(CASE WHEN k % 2 = 0 THEN assets ELSE liabilities END AS DOUBLE) AS total_assets,
         CAST(CASE WHEN k % 2 = 0 THEN liabilities ELSE 3 END AS DOUBLE) AS total_equity FROM {v_balance}""",
)
def _(t):
    b = t["v_balance"]
    first = F.array(F.when(F.col("k") % 2 == 0, "TOTAL ASSETS").otherwise("Cash"), _dollars("assets"))
    rows = F.array(
        first, F.array(F.lit("TOTAL CURRENT ASSETS TOTAL ASSETS TOTAL EQUITY")),
        F.array(_dollars("current_assets"), _dollars("liabilities"), F.lit("$3")),
    )
    table = b.select("doc_id", F.lit(0).alias("page"), F.posexplode(rows).alias("row_idx", "cells"))
    return B.read_balance_sheet(table).select("doc_id", "total_current_assets", "total_assets", "total_equity")




def _plain_text(t):
    body = F.concat(F.lit("TOT\r\nAL ASSETS "), _dollars("current_assets"), F.lit(" "), _dollars("assets"), F.lit(" Total Liabilities "), _dollars("liabilities"))
    return t["v_balance"].withColumn("text", body)


@query("bal8_plain_text_value", "SELECT doc_id, CAST(assets AS DOUBLE) AS assets_value, CAST(NULL AS DOUBLE) AS liabilities_value FROM {v_balance}")
def _(t):
    c = F.col("text")
    return _plain_text(t).select("doc_id", B.plain_text_value(c, "total_assets").alias("assets_value"), B.plain_text_value(c, "total_liabilities").alias("liabilities_value"))


@query("bal9_cross_check", "SELECT doc_id, CASE WHEN k % 2 = 0 THEN CAST(assets AS DOUBLE) END AS total_assets, CAST(5 AS DOUBLE) AS total_liabilities FROM {v_balance}")
def _(t):
    null = F.lit(None).cast("double")
    df = _plain_text(t).withColumns({k: null for k in KEYS}).withColumns({"total_assets": F.when(F.col("k") % 2 == 0, 1.0), "total_liabilities": F.lit(5.0)})
    return B.cross_check(df).select("doc_id", "total_assets", "total_liabilities")


@query(
    "set3_missing_fields",
    "SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'total_current_assets,total_current_liabilities,total_liabilities,total_equity' ELSE 'total_current_assets,total_assets,total_current_liabilities,total_liabilities' END AS missing FROM {v_balance}",
)
def _(t):
    null = F.lit(None).cast("double")
    df = t["v_balance"].withColumns({k: null for k in KEYS}).withColumns({"total_assets": F.when(F.col("k") % 2 == 0, 1.0), "total_equity": F.when(F.col("k") % 2 != 0, 1.0)})
    return df.select("doc_id", F.array_join(B.missing_fields(df), ",").alias("missing"))


def _boxed(entries: list[tuple]) -> Column:
    """Array of (text, x1, y1, x2, y2) from literals and Columns."""
    return F.array(
        *[
            F.struct(
                (F.lit(e[0]) if isinstance(e[0], str) else e[0]).alias("text"),
                *[(F.lit(float(v)) if isinstance(v, (int, float)) else v.cast("double")).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e[1:])],
            )
            for e in entries
        ]
    )


@query("bal7_recover_rows", "SELECT doc_id, 0 AS page, 'total_assets' AS field, CAST(assets AS DOUBLE) AS value FROM {v_balance}")
def _(t):
    frags = _boxed(
        [("Cash", 10, 50, 60, 70), ("TOT", 10, 100, 40, 120), ("AL ASSE", 12, 122, 60, 140), ("TS", 10, 142, 30, 160),
         ("$1,000", 300, 100, 340, 120), (_dollars("assets"), 500, 101, 540, 121), ("-", 505, 140, 510, 150), ("$7", 500, 400, 540, 420)]
    )
    table = t["v_balance"].select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("table_idx"), F.posexplode(frags).alias("frag_idx", "f")).select("doc_id", "page", "table_idx", "frag_idx", "f.*")
    missing = t["v_balance"].select("doc_id", F.lit(0).alias("page"), F.explode(F.array(F.lit("total_assets"), F.lit("total_equity"))).alias("field"))
    return G.recover_rows(table, missing)


# --- lines ---------------------------------------------------------------------------
def _lines(t):
    k = F.col("k")
    value = F.concat((k % 900 + 100).cast("string"), F.lit("-"), (k % 800 + 100).cast("string"))
    right = _boxed([("top", 0, 0, 1000, 10), ("BSB:", 0, 100, 40, 122), (value, 50, 102, 120, 124), ("far", 500, 102, 600, 124)])
    below = _boxed([("top", 0, 0, 1000, 10), ("BSB:", 0, 100, 40, 122), (value, 2, 130, 60, 152), ("far", 500, 102, 600, 124)])
    nothing = _boxed([("top", 0, 0, 1000, 10), ("BSB:", 0, 100, 40, 122), (value, 0, 300, 60, 322), ("far", 500, 102, 600, 124)])
    lines = F.when(k % 3 == 0, right).when(k % 3 == 1, below).otherwise(nothing)
    return t["v_balance"].select("doc_id", F.lit(0).alias("page"), F.posexplode(lines).alias("line_idx", "l")).select("doc_id", "page", "line_idx", "l.*")


_BSB = "CAST(k % 900 + 100 AS STRING) || '-' || CAST(k % 800 + 100 AS STRING)"


@query("joi7_adjacent_value", f"SELECT doc_id, {_BSB} AS value FROM {{v_balance}} WHERE k % 3 <> 2")
def _(t):
    labels = t["v_balance"].select("doc_id", F.lit(0).alias("page"), F.lit("bsb").alias("field"), F.lit(1).alias("label_idx"))
    return G.adjacent_value(_lines(t), labels).select("doc_id", "value")


@query("ext8_repair_split", f"SELECT doc_id, CASE WHEN k % 3 <> 2 THEN {_BSB} END AS bsb FROM {{v_balance}}")
def _(t):
    from ..sources.files import lines_to_text

    lines = _lines(t)
    pages = with_text_fields(lines_to_text(lines), keys=["name", "address", "bsb", "account_number", "income"])
    return G.repair_split(pages, lines).select("doc_id", "bsb")


# --- cells and fragments -------------------------------------------------------------
def _grid(t):
    """A two-row table per document: label cell and two value cells in each row."""
    b = t["v_balance"].withColumns({"page": F.lit(0), "table_idx": F.lit(0)})
    cells = _boxed([("", 0, 0, 200, 50), ("", 200, 0, 400, 50), ("", 400, 0, 600, 50), ("", 0, 50, 200, 100), ("", 200, 50, 400, 100), ("", 400, 50, 600, 100)])
    amount, other = _dollars("assets"), _dollars(F.col("assets") + 1000)
    frags = _boxed(
        [("Total As", 10, 5, 60, 20), ("sets", 10, 25, 40, 40), (other, 210, 5, 260, 20), (amount, 410, 5, 470, 20),
         ("Cash", 10, 55, 60, 70), (amount, 210, 55, 280, 70), (amount, 410, 55, 480, 70)]
    )
    keys = ["doc_id", "page", "table_idx"]
    c = b.select(*keys, F.posexplode(cells).alias("cell_idx", "c")).select(*keys, "cell_idx", "c.x1", "c.y1", "c.x2", "c.y2")
    f = b.select(*keys, F.posexplode(frags).alias("frag_idx", "f")).select(*keys, "frag_idx", "f.*")
    return c, f


@query(
    "joi8_frags_in_cells",
    """SELECT CAST(l.l_orderkey AS STRING) AS doc_id, CAST(l.l_linenumber AS INT) AS frag_idx, c.cell_idx, count(*) AS n FROM {lineitem} l,
         (SELECT CAST(0 AS INT) AS cell_idx, 0 AS lo, 200 AS hi UNION ALL SELECT 1, 200, 350 UNION ALL SELECT 2, 340, 520) c
       WHERE l.l_quantity * 10 + 5 BETWEEN c.lo AND c.hi GROUP BY 1, 2, 3""",
)
def _(t):
    q = F.col("l_quantity")
    keys = [F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("table_idx")]
    frags = t["lineitem"].select(*keys, F.col("l_linenumber").alias("frag_idx"), (q * 10).alias("x1"), F.lit(0.0).alias("y1"), (q * 10 + 10).alias("x2"), F.lit(20.0).alias("y2"))
    boxes = _boxed([("", 0, 0, 200, 50), ("", 200, 0, 350, 50), ("", 340, 0, 520, 50)])
    cells = t["lineitem"].select(*keys).distinct().select("doc_id", "page", "table_idx", F.posexplode(boxes).alias("cell_idx", "c")).select("doc_id", "page", "table_idx", "cell_idx", "c.x1", "c.y1", "c.x2", "c.y2")
    return G.frags_in_cells(cells, frags).groupBy("doc_id", "frag_idx", "cell_idx").agg(F.count("*").alias("n"))


@query("joi9_row_label_matches", "SELECT doc_id, CAST(2 AS INT) AS cell_idx FROM {v_balance} UNION ALL SELECT doc_id, CAST(1 AS INT) FROM {v_balance}")
def _(t):
    cells, frags = _grid(t)
    texts = G.cell_texts(cells, frags)
    candidates = texts.withColumn("field", F.lit("total_assets"))
    return G.row_label_matches(candidates, texts).select("doc_id", "cell_idx")


@query("sor6_reading_order", "SELECT doc_id, 'Total Assets' AS joined FROM {v_balance}")
def _(t):
    _, frags = _grid(t)
    return G.reading_order(frags.filter((F.col("x1") < 200) & (F.col("y1") < 50)), ["doc_id"])


@query("red5_balance_boxes", "SELECT doc_id, 'total_assets' AS field, '$' || CAST(assets AS STRING) AS value, 410.0::DOUBLE AS x1, 5.0::DOUBLE AS y1, 470.0::DOUBLE AS x2, 20.0::DOUBLE AS y2 FROM {v_balance}")
def _(t):
    cells, frags = _grid(t)
    targets = t["v_balance"].select("doc_id", F.lit(0).alias("page"), F.lit("total_assets").alias("field"), F.col("assets").cast("double").alias("target"))
    return G.balance_boxes(cells, frags, targets).drop("page")


@query("win9_rightmost_wins", "SELECT doc_id, 410.0::DOUBLE AS x1, 55.0::DOUBLE AS y1 FROM {v_balance}")
def _(t):
    cells, frags = _grid(t)
    targets = t["v_balance"].select("doc_id", F.lit(0).alias("page"), F.lit("total_equity").alias("field"), F.col("assets").cast("double").alias("target"))
    below = frags.filter(F.col("y1") > 50)
    return G.balance_boxes(cells, below, targets).select("doc_id", "x1", "y1")


# --- words ---------------------------------------------------------------------------
def _words(t):
    """Words of every payslip on one long line: ten pixels per character."""
    spans = text.match_spans(F.col("text"), r"\S+")
    found = t.spread("v_payslip").select("doc_id", F.lit(0).alias("page"), F.explode_outer(spans).alias("w")).filter("w IS NOT NULL")
    s, e = F.col("w.start"), F.col("w.end")
    return found.select(
        "doc_id", "page", F.col("w.value").alias("word"), s.alias("start"), e.alias("end"), (s * 10).cast("double").alias("x1"),
        F.lit(100.0).alias("y1"), (e * 10).cast("double").alias("x2"), F.lit(120.0).alias("y2"),
    )


@query(
    "joi10_words_for_span",
    """SELECT doc_id, CAST(len(regexp_extract_all(substr(text, CAST(k % 50 AS BIGINT) + 1, length(text) - CAST(k % 50 + k % 31 AS BIGINT)), '\\S+')) AS BIGINT) AS n FROM {v_payslip}""",
)
def _(t):
    # another range of every text, up to the whole of it
    k = F.col("k")
    spans = t["v_payslip"].select(
        "doc_id", F.lit(0).alias("page"), F.lit(0).alias("item_idx"), (k % 50).cast("int").alias("start"), (F.length("text") - k % 31).cast("int").alias("end")
    )
    return G.words_for_span(spans, _words(t)).groupBy("doc_id").agg(F.count("*").alias("n"))


def _word_rows(t):
    """Three words per order, stacked, the third at a varying distance."""
    k = F.col("o_orderkey")
    gap = (k % 20).cast("double")
    words = _boxed([("a", 10, 100, 50, 120), ("b", 60, 102, 90, 120), ("c", 10, 120 + gap, 50, 140 + gap)])
    w = t["orders"].select(k.cast("string").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(words).alias("i", "w"))
    return w.select("doc_id", "page", (F.col("i") * 2).alias("start"), (F.col("i") * 2 + 1).alias("end"), "w.*")


@query(
    "agg10_union_box",
    """SELECT CAST(o_orderkey AS STRING) AS doc_id, 3.0::DOUBLE AS x1, 100.0::DOUBLE AS y1, 93.0::DOUBLE AS x2,
         120.0 + least(7.0, CAST((o_orderkey % 20) // 2 AS DOUBLE)) AS y2 FROM {orders}""",
)
def _(t):
    words = _word_rows(t)
    spans = t["orders"].select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("item_idx"), F.lit(0).alias("start"), F.lit(3).alias("end"))
    return G.union_box(spans, words).select("doc_id", "x1", "y1", "x2", "y2")


@query(
    "red2_sensitive_boxes",
    f"""SELECT doc_id, field, value, round((start * 10 - 7) / 20000.0, 8) AS x_pct, round((length(value) * 10 + 10) / 20000.0, 8) AS w_pct, 0.1::DOUBLE AS y_pct, 0.027::DOUBLE AS h_pct
        FROM ({_SPANS}) s""",
)
def _(t):
    hits = hit_columns()
    pages = with_hits(t.spread("v_payslip").select("doc_id", F.lit(0).alias("page"), "text"))
    pages = with_text_fields(pages, is_person=lambda c: F.lit(False), hits=hits)
    pages = pages.withColumns({k: F.lit(None).cast("double") for k in KEYS})
    geom = t["v_payslip"].select("doc_id", F.lit(0).alias("page"), F.lit(20000.0).alias("width"), F.lit(1000.0).alias("height"))
    boxes = G.sensitive_boxes(pages, _words(t), geom, hits=hits)
    return boxes.select("doc_id", "field", "value", *[F.round(c, 8).alias(c) for c in ("x_pct", "w_pct", "y_pct", "h_pct")])


@query("set5_not_yet_boxed", "SELECT l_orderkey, count(*) AS n FROM {lineitem} WHERE l_quantity >= 25 GROUP BY 1")
def _(t):
    q = F.col("l_quantity").cast("int")
    occ = t["lineitem"].select("l_orderkey", F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page"), q.alias("start"), (q + 5).alias("end"))
    boxed = occ.filter(F.col("start") < 25).distinct()
    return G.not_yet_boxed(occ, boxed).groupBy("l_orderkey").agg(F.count("*").alias("n"))


_PAIRED = """
  SELECT i.doc_id, i.item_idx, o.page FROM
   (SELECT CAST(user_id AS STRING) AS doc_id, event_id AS item_idx, event_type AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM {events} WHERE event_id % 2 = 0) i
  JOIN (SELECT CAST(user_id AS STRING) AS doc_id, event_id AS page, event_type AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM {events} WHERE event_id % 3 <> 0) o
    ON o.doc_id = i.doc_id AND o.value = i.value AND o.n = i.n"""


@query("joi11_pair_occurrences", _PAIRED)
def _(t):
    e = t["events"].select(F.col("user_id").cast("string").alias("doc_id"), "event_id", F.col("event_type").alias("value"))
    items = e.filter(F.col("event_id") % 2 == 0).select("doc_id", F.col("event_id").alias("item_idx"), "value")
    occ = e.filter(F.col("event_id") % 3 != 0).select("doc_id", F.col("event_id").alias("page"), F.lit(0).alias("pos"), "value")
    return G.pair_occurrences(items, occ).select("doc_id", "item_idx", "page")


@query("win7_occurrence_number", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM {events}")
def _(t):
    rows = t["events"].select("event_id", "event_type")
    return ordered.number_rows(rows, ["event_type"], ["event_id"], "n", [F.floor(F.col("event_id") / 512)]).select("event_id", "n")


# --- stacked pages and box scores ----------------------------------------------------
def _geom(t):
    n = F.length("text")
    return t["conversations"].select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page"), (n % 300 + 100).cast("double").alias("width"), (n % 500 + 100).cast("double").alias("height"))


_GEOM = """SELECT CAST(conv_id AS STRING) AS doc_id, CAST(turn AS INT) AS page, CAST(length(text) % 300 + 100 AS DOUBLE) AS width, CAST(length(text) % 500 + 100 AS DOUBLE) AS height FROM {conversations}"""
_OFFSETS = f"""SELECT *, coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_offset,
   sum(height) OVER (PARTITION BY doc_id) AS total_h, max(width) OVER (PARTITION BY doc_id) AS max_w FROM ({_GEOM}) g"""


@query("win6_page_offsets", f"SELECT doc_id, page, page_offset, total_h, max_w FROM ({_OFFSETS}) o")
def _(t):
    return G.page_offsets(_geom(t)).select("doc_id", "page", "page_offset", "total_h", "max_w")


@query(
    "red6_to_composite",
    f"SELECT doc_id, page, round(0.1 * width / max_w, 8) AS x_pct, round((page_offset + 0.2 * height) / total_h, 8) AS y_pct, round(0.3 * height / total_h, 8) AS h_pct FROM ({_OFFSETS}) o",
)
def _(t):
    g = _geom(t)
    boxes = g.select("doc_id", "page", F.lit(0.1).alias("x_pct"), F.lit(0.2).alias("y_pct"), F.lit(0.5).alias("w_pct"), F.lit(0.3).alias("h_pct"))
    return G.to_composite(boxes, g).select("doc_id", "page", *[F.round(c, 8).alias(c) for c in ("x_pct", "y_pct", "h_pct")])


def _truth_boxes(t):
    k = F.col("l_orderkey")
    box = t["lineitem"].select(
        k.cast("string").alias("doc_id"), F.when(k % 2 == 0, "abn").otherwise("name").alias("field"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("box_idx"),
        (F.col("l_quantity") / 100).alias("x_pct"), (F.col("l_discount") * 5).alias("y_pct"), F.lit(0.2).alias("w_pct"), F.lit(0.1).alias("h_pct"),
    )
    predicted = box.filter(k % 5 != 0).select("doc_id", "field", (F.col("x_pct") + 0.05).alias("x_pct"), "y_pct", "w_pct", "h_pct")
    return box, predicted


_BOXES = """SELECT l_orderkey AS k, CAST(l_orderkey AS STRING) AS doc_id, CASE WHEN l_orderkey % 2 = 0 THEN 'abn' ELSE 'name' END AS field,
   concat_ws('-', l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS box_idx, l_quantity / 100 AS x, l_discount * 5 AS y FROM {lineitem}"""
_SHARED = "greatest(0, least(a.x + 0.2, b.x + 0.05 + 0.2) - greatest(a.x, b.x + 0.05)) * greatest(0, least(a.y + 0.1, b.y + 0.1) - greatest(a.y, b.y))"
_SCORES = f"""SELECT a.doc_id, a.field, a.box_idx, coalesce(max(CASE WHEN b.k % 5 <> 0 THEN ({_SHARED}) / (0.2 * 0.1 * 2 - ({_SHARED})) END), 0) AS best_iou
   FROM ({_BOXES}) a LEFT JOIN ({_BOXES}) b ON a.doc_id = b.doc_id AND a.field = b.field GROUP BY 1, 2, 3"""


@query("joi13_score_boxes", f"SELECT doc_id, field, round(best_iou, 6) AS best_iou FROM ({_SCORES}) s")
def _(t):
    return scoring.score_boxes(*_truth_boxes(t)).select("doc_id", "field", F.round("best_iou", 6).alias("best_iou"))


@query("red8_box_accuracy", f"SELECT field, count(*) FILTER (WHERE best_iou >= 0.5) AS correct, count(*) AS total FROM ({_SCORES}) s GROUP BY ROLLUP (field)")
def _(t):
    return scoring.box_accuracy(*_truth_boxes(t)).select("field", "correct", "total")


