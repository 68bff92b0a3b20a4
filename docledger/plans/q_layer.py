"""Queries over text layers: conversations as documents, a turn as a page, ten points a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from ..operators import text_layer as L
from ..session import cut
from .registry import query

_BOX = ("x_pct", "y_pct", "w_pct", "h_pct")


def layer_pages(t):
    """Pages with a run for each character: five points wide, on the line that breaks give it."""
    height = (F.length("text") % 500 + 100).cast("double")
    lines = F.split("text", "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.array().cast("array<struct<at:int,line:int,n:int>>").alias("out"))

    def placed(acc, line):
        here = F.struct(acc["at"].alias("at"), acc["line"].alias("line"), F.length(line).alias("n"))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), (acc["line"] + 1).alias("line"), F.array_append(acc["out"], here).alias("out"))

    def characters(x):
        top = F.col("height") - x["line"] * 10
        return F.transform(
            F.sequence(F.lit(0), x["n"] - 1),
            lambda c: F.struct(
                (x["at"] + c).alias("start"), (x["at"] + c + 1).alias("end"), (c * 5).cast("double").alias("left"),
                (top - 8).cast("double").alias("bottom"), (c * 5 + 5).cast("double").alias("right"), top.cast("double").alias("top"),
            ),
        )

    # written once: dealing the texts out again for every use would shuffle them each time
    pages = cut(t.spread("conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text",
        (F.length("text") % 300 + 100).cast("double").alias("width"), height.alias("height"),
    ))
    whole = F.filter(F.aggregate(lines, start, placed, lambda acc: acc["out"]), lambda x: x["n"] > 0)
    return pages.withColumn("runs", F.flatten(F.transform(whole, characters)))


def layer_items(pages):
    """Of every page its first word; the letters around its first break, without it; a value that
    is nowhere; nothing; and an item that has a box."""
    nothing = F.lit(None).cast("double")
    at = F.instr("text", "\n")
    around = F.concat(F.substring("text", at - 4, F.lit(4)), F.substring("text", at + 1, F.lit(4)))

    def item(n, field, value, box=nothing):
        return F.struct((F.col("page") * 5 + n).alias("item_idx"), F.lit(field).alias("field"), value.alias("value"), *[box.alias(c) for c in _BOX])

    values = [
        item(0, "first", F.substring_index("text", " ", 1)), item(1, "around", F.when(at > 4, around).otherwise("")),
        item(2, "absent", F.lit("§ nowhere")), item(3, "none", F.lit("")), item(4, "boxed", F.lit("kept"), F.lit(0.25)),
    ]
    return pages.select("doc_id", F.explode(F.array(*values)).alias("i")).select("doc_id", "i.*")


_PAGES = """SELECT CAST(conv_id AS STRING) AS doc_id, turn AS page, text, CAST(length(text) % 300 + 100 AS DOUBLE) AS width,
   CAST(length(text) % 500 + 100 AS DOUBLE) AS height, instr(text, chr(10)) AS cut FROM {conversations}"""
_ITEMS = """SELECT doc_id, page * 5 AS item_idx, 'first' AS field, string_split(text, ' ')[1] AS value, page FROM pages_of
   UNION ALL SELECT doc_id, page * 5 + 1, 'around', substr(text, cut - 4, 4) || substr(text, cut + 1, 4), page FROM pages_of WHERE cut > 4
   UNION ALL SELECT doc_id, page * 5 + 2, 'absent', '§ nowhere', page FROM pages_of"""
# the n-th search of a value in a page, one after the other
_WITH = f"""WITH RECURSIVE pages_of AS ({_PAGES}),
sized AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   sum(height) OVER (PARTITION BY doc_id) AS total_h, max(width) OVER (PARTITION BY doc_id) AS max_w FROM pages_of),
items_of AS ({_ITEMS}),
wanted AS (SELECT doc_id, value, count(*) AS asked FROM items_of WHERE value <> '' GROUP BY ALL),
places AS (SELECT p.doc_id, p.page, text, replace(replace(text, chr(13), ''), chr(10), '') AS flat, value, asked, lower(text) AS low, lower(value) AS small
   FROM pages_of p JOIN wanted w ON w.doc_id = p.doc_id WHERE strpos(lower(text), lower(value)) > 0 OR strpos(replace(replace(text, chr(13), ''), chr(10), ''), value) > 0),
searches AS (
  SELECT doc_id, page, value, 0::BIGINT AS n, 0::BIGINT AS start_at, 0::BIGINT AS cursor_at FROM places
  UNION ALL
  SELECT doc_id, page, value, n + 1,
    CASE WHEN plain > 0 THEN cursor_at + plain - 1 ELSE kept[flat_at + wrapped] END,
    CASE WHEN plain > 0 THEN cursor_at + plain - 1 + length(value) ELSE kept[flat_at + wrapped + length(value) - 1] + 1 END
  FROM (
    SELECT *, CASE WHEN plain = 0 THEN strpos(substr(flat, flat_at + 1), value) ELSE 0 END AS wrapped,
      CASE WHEN plain = 0 THEN list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 1) NOT IN (chr(10), chr(13))) END AS kept
    FROM (
      SELECT s.*, p.text, flat, asked, strpos(substr(low, cursor_at + 1), small) AS plain,
        length(replace(replace(substr(p.text, 1, cursor_at), chr(13), ''), chr(10), '')) AS flat_at
      FROM searches s JOIN places p ON p.doc_id = s.doc_id AND p.page = s.page AND p.value = s.value WHERE s.n < asked
    )
  ) WHERE plain > 0 OR wrapped > 0
),
spots AS (SELECT doc_id, page, value, start_at AS s, cursor_at AS e, row_number() OVER (PARTITION BY doc_id, value ORDER BY page, n) AS n FROM searches WHERE n > 0)"""


def _sql_box(s: str, e: str) -> str:
    """left, right and lines of the characters from s to before e of ``text``."""
    col = "length(regexp_extract(substr(text, 1, i), '[^\\n]*$'))"
    inside = f"list_filter(range({s}, {e}), lambda i: substr(text, i + 1, 1) <> chr(10))"
    lines = f"list_transform({inside}, lambda i: length(substr(text, 1, i)) - length(replace(substr(text, 1, i), chr(10), '')))"
    return f"""list_min(list_transform({inside}, lambda i: {col})) * 5 / max_w AS x_pct,
      (before + list_min({lines}) * 10) / total_h AS y_pct,
      (list_max(list_transform({inside}, lambda i: {col} + 1)) - list_min(list_transform({inside}, lambda i: {col}))) * 5 / max_w AS w_pct,
      ((list_max({lines}) - list_min({lines})) * 10 + 8) / total_h AS h_pct"""


_FOUND = f"""SELECT i.doc_id, i.item_idx, i.field, i.value, {_sql_box("s", "e")}
   FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY item_idx) AS n FROM items_of) i
   JOIN spots o ON o.doc_id = i.doc_id AND o.value = i.value AND o.n = i.n JOIN sized p ON p.doc_id = o.doc_id AND p.page = o.page"""


@query(
    "joi11_text_native_boxes",
    f"""{_WITH}
    SELECT doc_id, item_idx, field, value, round(x_pct, 8) AS x_pct, round(y_pct, 8) AS y_pct, round(w_pct, 8) AS w_pct, round(h_pct, 8) AS h_pct FROM ({_FOUND}) f
    UNION ALL SELECT doc_id, page * 5 + 4, 'boxed', 'kept', 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE FROM pages_of""",
)
def _(t):
    pages = layer_pages(t)
    boxes = L.text_native_boxes(layer_items(pages), pages)
    return boxes.select("doc_id", F.col("item_idx").cast("long").alias("item_idx"), "field", "value", *[F.round(c, 8).alias(c) for c in _BOX])


_TRUTH = f"""SELECT i.doc_id, i.item_idx, i.field, {_sql_box("CASE WHEN field = 'first' THEN 0 ELSE cut - 5 END", "CASE WHEN field = 'first' THEN length(i.value) ELSE cut + 4 END")}
   FROM items_of i JOIN sized p ON p.doc_id = i.doc_id AND p.page = i.page WHERE field <> 'absent' AND i.value <> ''"""
_JOINT = """greatest(0, least(a.x_pct + a.w_pct, b.x_pct + b.w_pct) - greatest(a.x_pct, b.x_pct)) *
   greatest(0, least(a.y_pct + a.h_pct, b.y_pct + b.h_pct) - greatest(a.y_pct, b.y_pct))"""


@query(
    "red8_text_native",
    f"""{_WITH}, truth AS ({_TRUTH}), found AS ({_FOUND}),
    best AS (SELECT a.doc_id, a.item_idx, a.field, coalesce(max(({_JOINT}) / (a.w_pct * a.h_pct + b.w_pct * b.h_pct - ({_JOINT}))), 0) AS score
      FROM truth a LEFT JOIN found b ON a.doc_id = b.doc_id AND a.field = b.field GROUP BY ALL)
    SELECT field, count(*) FILTER (WHERE score >= 0.5) AS correct, count(*) AS total FROM best GROUP BY ROLLUP (field)""",
)
def _(t):
    """Where values were taken from against where the search places them."""
    pages = layer_pages(t)
    items = layer_items(pages)
    at = F.instr("text", "\n")
    first = F.struct(F.lit("first").alias("field"), (F.col("page") * 5).alias("box_idx"), F.lit(0).alias("s"), F.length(F.substring_index("text", " ", 1)).alias("e"))
    around = F.struct(F.lit("around").alias("field"), (F.col("page") * 5 + 1).alias("box_idx"), (at - 5).alias("s"), F.least(at + 4, F.length("text")).alias("e"))
    spots = F.filter(F.array(first, F.when(at > 4, around)), lambda s: s["e"] > s["s"])
    known = pages.withColumn("i", F.explode(spots)).withColumn("box", L.range_box(F.col("runs"), F.col("i.s"), F.col("i.e")))
    box = F.col("box")
    truth = known.select("doc_id", "page", "i.field", "i.box_idx", "box").join(L.page_offsets(pages), ["doc_id", "page"]).select(
        "doc_id", "field", "box_idx", (box["left"] / F.col("max_w")).alias("x_pct"),
        ((F.col("page_offset") + F.col("height") - box["top"]) / F.col("total_h")).alias("y_pct"),
        ((box["right"] - box["left"]) / F.col("max_w")).alias("w_pct"), ((box["top"] - box["bottom"]) / F.col("total_h")).alias("h_pct"),
    )
    found = L.text_native_boxes(items, pages)
    return scoring.box_accuracy(truth, found).select("field", "correct", "total")
