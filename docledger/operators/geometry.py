"""Boxes on pages: lines, fragments, cells and words.

Joins here are range joins. Each carries an equality on the page *and* on a band or tile
of it, so candidates are compared only with their neighbours and a page holding a large
share of all rows still spreads over many tasks. No join emits all pairs of a page. Boxes
of sensitive text find their words in the row of their page instead (``_placed``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.amounts import parse_amount, parse_amount_bs, same_amount
from ..functions.cleaning import clean_value, looks_like_address, looks_like_bsb, looks_like_name
from ..functions.extract_au import CLEANED, cleaned_hits, reads_as_person
from ..functions.text import bisect, despace, let, line_of_offset, literal_occurrences, match_spans, strip
from ..session import cut
from .balance import label_pattern
from .ordered import carry_last, number_rows, running_sum
from .spans import annual_salary_spans, income_spans

BAND = 256
TILE = 128
OFFSET_BIN = 64
#: Words of a page that are looked at one by one: bisection pays for more.
SCANNED = 64
PAGE = ["doc_id", "page"]
TABLE = ["doc_id", "page", "table_idx"]


def bands(lo: Column, hi: Column, size: int = BAND) -> Column:
    """Band numbers an interval touches."""
    first, last = F.floor(lo / size), F.floor(hi / size)
    return F.sequence(first, F.greatest(first, last))


def overlap_ratio(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    shared = F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo)
    smaller = F.least(a_hi - a_lo, b_hi - b_lo)
    return F.when((shared > 0) & (smaller > 0), shared / smaller).otherwise(0.0)


def adjacent_value(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, page, field, label_idx, value``: the text beside or below a label (JOI7).

    ``labels``: doc_id, page, field, label_idx. Right of the label beats below it, nearer
    beats farther, a lower line index breaks ties.
    """
    width = lines.groupBy(*PAGE).agg(F.max("x2").alias("page_width"))
    anchors = (
        labels.join(
            lines.select(
                *PAGE, F.col("line_idx").alias("label_idx"),
                *[F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")],
            ),
            [*PAGE, "label_idx"],
        )
        .join(width, PAGE)
        .withColumn("h", F.col("ly2") - F.col("ly1"))
        .withColumn("band", F.explode(bands(F.col("ly1"), F.col("ly2") + V.BELOW_GAP_OF_HEIGHT * F.col("h"))))
    )
    near = lines.withColumn("band", F.explode(bands(F.col("y1"), F.col("y2"))))
    right = (F.col("x1") >= F.col("lx2")) & (
        overlap_ratio(F.col("ly1"), F.col("ly2"), F.col("y1"), F.col("y2")) >= V.LINE_OVERLAP
    )
    below = (
        ~right
        & (F.col("y1") >= F.col("ly2"))
        & (overlap_ratio(F.col("lx1"), F.col("lx2"), F.col("x1"), F.col("x2")) >= V.LINE_OVERLAP)
    )
    right_gap, below_gap = F.col("x1") - F.col("lx2"), F.col("y1") - F.col("ly2")
    rank = F.when(
        right & (right_gap <= V.RIGHT_GAP_OF_PAGE * F.col("page_width")),
        F.struct(F.lit(0).alias("kind"), right_gap.alias("gap"), F.col("line_idx").alias("idx")),
    ).when(
        below & (below_gap <= V.BELOW_GAP_OF_HEIGHT * F.col("h")),
        F.struct(F.lit(1).alias("kind"), below_gap.alias("gap"), F.col("line_idx").alias("idx")),
    )
    pairs = (
        anchors.join(near, [*PAGE, "band"])
        .filter(F.col("line_idx") != F.col("label_idx"))
        .withColumn("rank", rank)
        .filter(F.col("rank").isNotNull())
    )
    return pairs.groupBy(*PAGE, "field", "label_idx").agg(F.min_by(strip(F.col("text")), "rank").alias("value"))


def repair_split(pages: DataFrame, lines: DataFrame, is_person=reads_as_person) -> DataFrame:
    """Fill identity fields and income whose value stands on another line (EXT8).

    ``pages``: doc_id, page, text (lines joined by newlines) and the field columns.
    """
    c = F.col("text")
    patterns = {k: V.AU_LABELS[k] for k in ("name", "address", "bsb", "account_number")}
    wanted = [
        F.when(
            F.col(k).isNull() & c.rlike(p),
            F.struct(F.lit(k).alias("field"), line_of_offset(c, F.get(match_spans(c, p), F.lit(0))["start"]).alias("label_idx")),
        )
        for k, p in patterns.items()
    ] + [
        F.when(
            F.col("income").isNull() & c.rlike(p),
            F.struct(
                F.lit(basis).alias("field"), line_of_offset(c, F.get(match_spans(c, p), F.lit(0))["start"]).alias("label_idx")
            ),
        )
        for basis, p in V.AU_INCOME.items()
    ]
    labels = (
        pages.select(*PAGE, F.explode_outer(F.array_compact(F.array(*wanted))).alias("w"))
        .filter(F.col("w").isNotNull())
        .select(*PAGE, "w.*")
    )
    found = adjacent_value(lines, labels).withColumn("v", clean_value(F.col("value")))
    gates = {
        "name": looks_like_name(F.col("v")) & is_person(F.col("v")),
        "address": looks_like_address(F.col("v")),
        "bsb": looks_like_bsb(F.col("v")),
        "account_number": looks_like_bsb(F.col("v")),
    }
    values = [F.max(F.when((F.col("field") == k) & g, F.col("v"))).alias(f"__{k}") for k, g in gates.items()]
    values += [F.max(F.when(F.col("field") == b, parse_amount(F.col("v")))).alias(f"__{b}") for b in V.AU_INCOME]
    wide = found.groupBy(*PAGE).agg(*values)
    out = pages.join(wide, PAGE, "left")
    repaired = F.coalesce("__gross", "__net")
    basis = F.when(F.col("__gross").isNotNull(), "gross").when(F.col("__net").isNotNull(), "net")
    return out.withColumns(
        {
            **{k: F.coalesce(F.col(k), F.col(f"__{k}")) for k in gates},
            "income_basis": F.when(F.col("income").isNull(), basis).otherwise(F.col("income_basis")),
            "income": F.coalesce(F.col("income"), repaired),
        }
    ).drop(*[f"__{k}" for k in [*gates, *V.AU_INCOME]])


# --- table cells ---------------------------------------------------------------------
def frags_in_cells(cells: DataFrame, frags: DataFrame) -> DataFrame:
    """Fragments with the cells that contain their centre, edges included (JOI8).

    Both sides meet on a tile of the page: a centre lies in one tile, a cell in the few it
    covers.
    """
    fx, fy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    points = frags.withColumns({"fcx": fx, "fcy": fy}).withColumns(
        {"tx": F.floor(F.col("fcx") / TILE), "ty": F.floor(F.col("fcy") / TILE)}
    )
    regions = (
        cells.select(*TABLE, "cell_idx", *[F.col(c).alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")])
        .withColumn("tx", F.explode(bands(F.col("cx1"), F.col("cx2"), TILE)))
        .withColumn("ty", F.explode(bands(F.col("cy1"), F.col("cy2"), TILE)))
    )
    inside = F.col("fcx").between(F.col("cx1"), F.col("cx2")) & F.col("fcy").between(F.col("cy1"), F.col("cy2"))
    return points.join(regions, [*TABLE, "tx", "ty"]).filter(inside).drop("tx", "ty", "fcx", "fcy")


def reading_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of each group joined top to bottom, then left to right (SOR6)."""
    parts = F.array_sort(F.collect_list(F.struct("y1", "x1", "text")))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("joined"))


def cell_texts(cells: DataFrame, frags: DataFrame) -> DataFrame:
    """One row per non-empty cell: its text in reading order and the union of its
    fragments' boxes (RED5). Written once: callers read it as candidates and as labels."""
    parts = F.array_sort(F.collect_list(F.struct("y1", "x1", "text")))
    return cut(
        frags_in_cells(cells, frags)
        .groupBy(*TABLE, "cell_idx")
        .agg(
            F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("joined"),
            *[F.first(f"c{c}").alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")],
            F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        )
    )


def row_label_matches(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with a cell of the same row, wholly to the left, whose text names the
    field (JOI9): a left semi join, so neighbours are tested, not paired."""
    named = F.array_compact(F.array(*[F.when(F.col("joined").rlike(label_pattern(f)), F.lit(f)) for f in V.BALANCE_KEYS]))
    # every label holds one of these words
    named = F.when(F.col("joined").rlike("(?iu)total|net"), named)
    labels = (
        texts.withColumn("field", F.explode_outer(named))
        .filter(F.col("field").isNotNull())
        .select(*TABLE, "field", F.col("cell_idx").alias("label_cell"), F.col("cy1").alias("ly1"),
                F.col("cy2").alias("ly2"), F.col("cx2").alias("lx2"))
        .withColumn("band", F.explode(bands(F.col("ly1"), F.col("ly2"))))
    )
    mid = (F.col("c.cy1") + F.col("c.cy2")) / 2
    on = [F.col(f"c.{k}") == F.col(f"l.{k}") for k in [*TABLE, "field", "band"]]
    on += [
        F.col("l.ly1") <= mid, mid <= F.col("l.ly2"), F.col("l.lx2") <= F.col("c.cx1"),
        F.col("l.label_cell") != F.col("c.cell_idx"),
    ]
    banded = candidates.withColumn("band", F.floor((F.col("cy1") + F.col("cy2")) / 2 / BAND))
    return banded.alias("c").join(labels.alias("l"), reduce(lambda a, b: a & b, on), "left_semi").drop("band")


def balance_boxes(cells: DataFrame, frags: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, page, field, value, x1, y1, x2, y2``: where each total is printed (RED5, WIN9).

    ``targets``: doc_id, page, field, target. Cells confirmed by their row label beat the
    others; among equals the rightmost wins, then the first.
    """
    texts = cell_texts(cells, frags)
    # exploded: a filter on the amount itself would read it a second time; written once: read
    # as they are and as the ones with a label
    hits = cut(
        texts.withColumn("amount", F.explode_outer(F.array(parse_amount_bs(F.col("joined")))))
        .filter(F.col("amount").isNotNull())
        .join(targets, PAGE)
        .filter(same_amount(F.col("amount"), F.col("target")))
    )
    confirmed = row_label_matches(hits, texts)
    box = F.struct(
        F.col("joined").alias("value"),
        *[F.bround(F.col(c), 0).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )
    rank = F.struct(
        F.col("labeled"), F.col("x1"),
        (-F.col("table_idx")).alias("t"), (-F.col("cell_idx")).alias("c"),
    )
    return (
        # a confirmed cell stands here twice, and wins as such
        hits.withColumn("labeled", F.lit(0)).unionByName(confirmed.withColumn("labeled", F.lit(1)))
        .groupBy(*PAGE, "field")
        .agg(F.max_by(box, rank).alias("b"))
        .select(*PAGE, "field", "b.*")
    )


# --- words and spans -----------------------------------------------------------------
def words_for_span(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Words whose character range meets a span's (JOI10).

    ``spans``: doc_id, page, item_idx, start, end; ``words``: doc_id, page, start, end,
    x1..y2. Both sides are cut into bins of text; a pair is kept in the first bin it shares.
    """
    s = spans.select(*PAGE, "item_idx", F.col("start").alias("s_start"), F.col("end").alias("s_end")).withColumn(
        "bin", F.explode(bands(F.col("s_start"), F.col("s_end") - 1, OFFSET_BIN))
    )
    w = words.withColumn("bin", F.explode(bands(F.col("start"), F.col("end") - 1, OFFSET_BIN)))
    first_shared = F.floor(F.greatest("start", "s_start") / OFFSET_BIN)
    return (
        s.join(w, [*PAGE, "bin"])
        .filter((F.col("start") < F.col("s_end")) & (F.col("end") > F.col("s_start")) & (F.col("bin") == first_shared))
        .drop("bin")
    )


def union_box(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Box around the words of each span, widened by fixed shares of its height and, at the
    bottom, by at most half the gap to the next word below (AGG10). Written once, as callers
    may read the boxes several times."""
    item = F.struct("item_idx", "start", "end")
    asked = spans.filter(F.col("item_idx").isNotNull()).groupBy(*PAGE).agg(F.collect_list(item).alias("items"))
    boxes = F.array_distinct(F.transform("placed", lambda p: F.struct(p["item"]["item_idx"].alias("item_idx"), p["box"].alias("box"))))
    # outer: an inner explode would make the optimizer find the boxes twice
    out = _placed(asked, words).select(*PAGE, F.explode_outer(boxes).alias("p")).filter(F.col("p").isNotNull())
    return cut(out.select(*PAGE, "p.item_idx", "p.box.*"))


def _placed(asked: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, page, placed``: the items of a page (``asked``: doc_id, page, items, one row for each page) that touch
    words, each as ``item`` with the widened ``box`` around all words of its ``item_idx``.

    The words of a page are shuffled once, to one sorted array: a range finds its words, and a box the
    next word below it, by bisection inside the row."""
    word = F.struct("start", "end", "x1", "y1", "x2", "y2")
    layer = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(word)).alias("words"))

    def around(hit: Column) -> Column:
        def of(name: str, pick) -> Column:
            return pick(F.transform(hit, lambda w: w[name])).alias(name)

        return F.when(F.size(hit) > 0, F.struct(of("x1", F.array_min), of("y1", F.array_min), of("x2", F.array_max), of("y2", F.array_max)))

    def found(page: Column) -> Column:
        def box(s: Column) -> Column:
            # words may overlap: only where no end lies before an earlier one does bisection tell the first
            first = F.when(page["ordered"], bisect(page["words"], lambda w: w["end"] <= s["start"])).otherwise(F.lit(0))
            last = bisect(page["words"], lambda w: w["start"] < s["end"])
            some = let(first, lambda n: F.slice(page["words"], n + 1, F.greatest(last - n, F.lit(0))))
            near = F.when(F.size(page["words"]) > SCANNED, some).otherwise(page["words"])
            hit = F.filter(near, lambda w: (w["start"] < s["end"]) & (w["end"] > s["start"]))
            return F.struct(s.alias("item"), let(hit, around).alias("box"))

        return F.filter(F.transform("items", box), lambda p: p["box"].isNotNull())

    def of_items(boxes: Column) -> Column:
        # several ranges of one item share a box
        def shared(ids: Column) -> Column:
            def of(p: Column) -> Column:
                same = F.transform(F.filter(boxes, lambda o: o["item"]["item_idx"] == p["item"]["item_idx"]), lambda o: o["box"])
                return F.struct(p["item"].alias("item"), let(same, around).alias("box"))

            return F.when(F.size(ids) == F.size(boxes), boxes).otherwise(F.transform(boxes, of))

        return let(F.array_distinct(F.transform(boxes, lambda p: p["item"]["item_idx"])), shared)

    def widened(boxes: Column) -> Column:
        def with_tops(tops: Column) -> Column:
            return F.transform(boxes, lambda p: F.struct(p["item"].alias("item"), let(p["box"], lambda b: _widened(b, tops)).alias("box")))

        # a word with no height may be part of a box and lie on its lower edge: it counts as
        # below only boxes that end strictly above it
        turn = lambda w: F.when(w["y2"] > w["y1"], 1).otherwise(-1)
        tops = F.transform(F.filter("words", lambda w: w["y1"].isNotNull()), lambda w: F.struct(w["y1"].alias("y"), turn(w).alias("turn")))
        return let(F.array_sort(F.array_distinct(tops)), with_tops)

    usable = F.filter("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    ends = lambda ws: F.transform(ws, lambda w: w["end"])
    page = let(usable, lambda ws: F.struct(ws.alias("words"), (F.sort_array(ends(ws)) == ends(ws)).alias("ordered")))
    placed = let(let(let(page, found), of_items), widened)
    return asked.join(layer, PAGE).select(*PAGE, placed.alias("placed"))


def _widened(box: Column, tops: Column) -> Column:
    """A box with its margins; ``tops``: upper edges of the page's words, sorted."""
    h = box["y2"] - box["y1"]
    wanted = F.bround(h * V.BOTTOM_MARGIN, 0)
    passed = lambda t: (t["y"] < box["y2"]) | ((t["y"] == box["y2"]) & (t["turn"] < 0))
    above = F.when(F.size(tops) > SCANNED, bisect(tops, passed)).otherwise(F.size(F.filter(tops, passed)))
    next_top = F.get(tops, above)["y"]

    def bottom(top: Column) -> Column:
        room = F.greatest(F.floor((top - box["y2"]) / 2).cast("double"), F.lit(0.0))
        return F.when(top.isNotNull(), F.least(wanted, room)).otherwise(wanted)

    return F.struct(
        (box["x1"] - F.bround(h * V.LEFT_MARGIN, 0)).alias("x1"), box["y1"].cast("double").alias("y1"),
        (box["x2"] + F.bround(h * V.RIGHT_MARGIN, 0)).alias("x2"), (box["y2"] + let(next_top, bottom)).alias("y2"),
    )


def accepted_only(hits: Column, accepted: Column) -> Column:
    """Matches whose text is in the accepted list (SET4)."""
    return F.filter(hits, lambda h: F.array_contains(accepted, h["value"]))


def not_yet_boxed(occurrences: DataFrame, boxed: DataFrame) -> DataFrame:
    """Occurrences whose exact range has no box yet (SET5)."""
    return occurrences.join(boxed.select(*PAGE, "start", "end"), [*PAGE, "start", "end"], "left_anti")


def box_candidates(pages: DataFrame, hits: dict[str, Column] | None = None) -> DataFrame:
    """Text ranges that may get a box: ``doc_id, page, item_idx, grp, rank, field, value,
    start, end``. Rows of one ``grp`` are alternatives; the lowest ``rank`` with words wins.

    ``pages``: doc_id, page, text and field columns. ``hits`` are the matches the fields were
    read from (``with_hits``); without them every pattern is searched again.
    """
    return (
        _candidates(pages, hits).select(*PAGE, F.posexplode_outer("items").alias("item_idx", "i"))
        .filter(F.col("item_idx").isNotNull())
        .select(*PAGE, "item_idx", "i.*")
        .withColumn("grp", F.when(F.col("tier") == 0, F.col("item_idx")).otherwise(-1))
        .withColumn("rank", F.struct("tier", "start"))
    )


def _candidates(pages: DataFrame, hits: dict[str, Column] | None) -> DataFrame:
    """``doc_id, page, items``: the ranges of ``box_candidates`` as one array for each row of ``pages``."""
    c = F.col("text")
    if hits is None:
        hits = {k: match_spans(c, V.AU_LISTS[k]) for k in V.SENSITIVE_LIST_KEYS}
        hits |= {k: cleaned_hits(c, p) for k, p in CLEANED.items()}
        hits["annual_salary"] = match_spans(c, V.ANNUAL_SALARY, 1)
    kind = "array<struct<tier:int,field:string,value:string,start:int,end:int>>"

    def tiered(spans: Column, tier: int, field: str) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                F.lit(tier).alias("tier"), F.lit(field).alias("field"), s["value"].alias("value"),
                s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"),
            ),
        )

    empty = F.array().cast(kind)
    parts = [
        F.when(F.size(k) > 0, tiered(accepted_only(hits[k], F.col(k)), 0, k)).otherwise(empty)
        for k in V.SENSITIVE_LIST_KEYS
    ]
    labelled = F.concat(
        *[
            F.when(
                F.length(k) > 0,
                tiered(F.filter(hits[k], lambda s: s["value"] == F.col(k)), 0, k),
            ).otherwise(empty)
            for k in V.AU_LABELS
        ]
    )
    work = pages.withColumn("__labelled", labelled)
    taken = F.transform("__labelled", lambda s: F.struct(s["start"], s["end"]))
    for k in V.AU_LABELS:
        found = F.filter(
            literal_occurrences(c, F.col(k)),
            lambda o: ~F.exists(taken, lambda t: (t["start"] == o["start"]) & (t["end"] == o["end"])),
        )
        parts.append(
            F.when(
                F.length(k) > 0,
                tiered(F.transform(found, lambda o: F.struct(F.col(k).alias("value"), o["start"], o["end"])), 0, k),
            ).otherwise(empty)
        )
    parts.append(F.col("__labelled"))
    parts.append(tiered(annual_salary_spans(hits["annual_salary"], F.col("annual_salary")), 0, "annual_salary"))
    income = F.col("income")
    parts.append(tiered(income_spans(hits, income, F.col("income_basis")), 1, "income"))
    bare = F.when(
        income.isNotNull(),
        tiered(
            F.filter(match_spans(c, V.BARE_AMOUNT), lambda s: same_amount(parse_amount(s["value"]), income)),
            2, "income",
        ),
    ).otherwise(empty)
    parts.append(bare)
    return work.select(*PAGE, F.concat(*[p.cast(kind) for p in parts]).alias("items"))


def box_pct(width: Column, height: Column) -> dict[str, Column]:
    x1, x2 = F.greatest(F.col("x1"), F.lit(0.0)), F.least(F.col("x2"), width)
    y1, y2 = F.col("y1"), F.least(F.col("y2"), height)
    return {"x_pct": x1 / width, "y_pct": y1 / height, "w_pct": (x2 - x1) / width, "h_pct": (y2 - y1) / height}


def sensitive_boxes(
    pages: DataFrame, words: DataFrame, geom: DataFrame,
    cells: DataFrame | None = None, frags: DataFrame | None = None, hits: dict[str, Column] | None = None,
) -> DataFrame:
    """Boxes of all sensitive text, in percent of their page (RED2).

    ``pages``: doc_id, page, text, field columns; ``geom``: doc_id, page, width, height;
    ``hits``: columns of ``pages`` with the matches its fields were read from. A range
    without words gets no box.
    """
    # dealt out by page as they are: what finds the ranges runs before, and the rows of a page meet without another shuffle
    ranges = _candidates(pages, hits).repartition(*PAGE).groupBy(*PAGE).agg(F.collect_list("items").alias("lists"))
    numbered = F.transform(
        "lists", lambda items: F.transform(
            items, lambda s, i: F.struct(i.alias("item_idx"), F.when(s["tier"] == 0, i).otherwise(-1).alias("grp"), *[s[k].alias(k) for k in ("tier", "start", "end", "field", "value")])
        )
    )
    placed = _placed(ranges.select(*PAGE, F.flatten(numbered).alias("items")), words)

    def lowest(found: Column) -> Column:
        # in order of group and rank
        return F.filter(found, lambda p, i: (i == 0) | (F.get(found, i - 1)["grp"] != p["grp"]))

    ranked = F.transform("placed", lambda p: F.struct(*[p["item"][k].alias(k) for k in ("grp", "tier", "start", "field", "value")], p["box"].alias("box")))
    boxes = (
        placed.select(*PAGE, F.explode_outer(let(F.array_sort(ranked), lowest)).alias("b")).filter(F.col("b").isNotNull())
        .select(*PAGE, "b.field", "b.value", "b.box.*")
        .withColumn("detection_method", F.lit("regex"))
    )
    if cells is not None and frags is not None:
        targets = pages.select(
            *PAGE,
            F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("target")) for k in V.BALANCE_KEYS])).alias("t"),
        ).select(*PAGE, "t.*").filter(F.col("target").isNotNull())
        totals = balance_boxes(cells, frags, targets).withColumn("detection_method", F.lit("table_ocr"))
        boxes = boxes.unionByName(totals)
    sized = boxes.join(geom.select(*PAGE, "width", "height"), PAGE)
    return sized.withColumns(box_pct(F.col("width"), F.col("height"))).drop("width", "height", "x1", "y1", "x2", "y2")


# --- pages stacked into one image ----------------------------------------------------
def page_offsets(geom: DataFrame) -> DataFrame:
    """``doc_id, page, width, height, page_offset, total_h, max_w`` of pages stacked top to
    bottom (WIN6)."""
    pages = geom.select(*PAGE, "width", "height")
    offsets = running_sum(pages, ["doc_id"], ["page"], F.col("height"), "page_offset", [F.floor(F.col("page") / 1024)])
    whole = pages.groupBy("doc_id").agg(F.sum("height").alias("total_h"), F.max("width").alias("max_w"))
    return offsets.join(whole, "doc_id")


def to_composite(boxes: DataFrame, geom: DataFrame) -> DataFrame:
    """Page percentages turned into percentages of the stacked image (RED6)."""
    return (
        boxes.join(page_offsets(geom), PAGE)
        .withColumns(
            {
                "x_pct": F.col("x_pct") * F.col("width") / F.col("max_w"),
                "y_pct": (F.col("page_offset") + F.col("y_pct") * F.col("height")) / F.col("total_h"),
                "w_pct": F.col("w_pct") * F.col("width") / F.col("max_w"),
                "h_pct": F.col("h_pct") * F.col("height") / F.col("total_h"),
            }
        )
        .drop("width", "height", "page_offset", "total_h", "max_w")
    )


def pair_occurrences(items: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Items paired with successive occurrences of their value; items without one are
    dropped (JOI11, WIN7).

    ``items``: doc_id, item_idx, field, value; ``occurrences``: doc_id, page, pos, value.
    """
    keys = ["doc_id", "value"]
    left = number_rows(
        items.filter(F.col("value") != ""), keys, ["item_idx"], "n", [F.floor(F.col("item_idx") / 4096)]
    )
    right = number_rows(
        occurrences, keys, ["page", "pos"], "n", [F.col("page"), F.floor(F.col("pos") / 65536)]
    )
    return left.join(right, [*keys, "n"]).drop("n")


# --- rows a table reader lost --------------------------------------------------------
def recover_rows(frags: DataFrame, missing: DataFrame) -> DataFrame:
    """``doc_id, page, field, value`` for totals found in loose fragments (BAL7).

    ``frags``: doc_id, page, table_idx, frag_idx, text, x1..y2; ``missing``: doc_id, page,
    field. A label is a run of at most eight fragments of the leftmost column whose joined
    text begins with it; its value is the rightmost readable column in a window below.

    Fragments are shuffled once, to one row for each band of a table; runs and columns are
    found in arrays of that row. A run that leaves its band is completed from the first
    fragments of the bands that follow, which is all that meets for a whole table.
    Fragments without a position are left out.
    """
    band = [*TABLE, "band"]
    piece = F.struct("y1", "x1", despace(F.col("text")).alias("text"), "frag_idx")
    blocks = (
        frags.filter(F.col("x1").isNotNull() & F.col("y1").isNotNull())
        .groupBy(*TABLE, F.floor(F.col("y1") / BAND).alias("band"))
        .agg(F.array_sort(F.collect_list(piece)).alias("parts"), F.min("x1").alias("min_x"))
    )
    wanted = missing.groupBy(*PAGE).agg(F.collect_set("field").alias("wanted"))
    left_x = F.min("min_x").over(W.partitionBy(*TABLE))
    edges = blocks.select(*band, "min_x").repartition(*PAGE).join(wanted, PAGE).select(*band, "wanted", "min_x", left_x.alias("left_x"))
    # only bands with a fragment of the leftmost column; a filter on what is found there would find it a second time
    edges = edges.filter(F.col("min_x") - F.col("left_x") < V.LABEL_BAND)
    labels = F.filter("parts", lambda p: p["x1"] - F.col("left_x") < V.LABEL_BAND)
    rest = V.LABEL_RUN - 1

    def in_block(found: Column) -> Column:
        inside = F.greatest(F.size(found) - rest, F.lit(0))
        return F.struct(
            _label_rows(found, inside, F.col("wanted")).alias("rows"),
            F.slice(found, 1, rest).alias("first"),
            F.slice(found, inside + 1, F.lit(rest)).alias("last"),
        )

    seen = blocks.drop("min_x").join(edges, band).withColumn("b", let(labels, in_block)).select(*band, "wanted", "left_x", "b.*")
    after = F.flatten(F.collect_list("first").over(W.partitionBy(*TABLE).orderBy("band").rowsBetween(1, rest)))
    rows = (
        seen.withColumn("after", F.slice(after, 1, rest))
        .withColumn("across", let(F.concat("last", "after"), lambda a: _label_rows(a, F.size("last"), F.col("wanted"))))
        .select(*TABLE, "left_x", F.explode(F.concat("rows", "across")).alias("row"))
        .groupBy(*TABLE, "row.field")
        .agg(F.min("row.y1").alias("row_y1"), F.first("left_x").alias("left_x"))
    )
    top, bottom = F.col("row_y1") - V.VALUE_WINDOW_ABOVE, F.col("row_y1") + V.VALUE_WINDOW_BELOW
    near = F.filter("parts", lambda p: (p["x1"] - F.col("left_x") >= V.LABEL_BAND) & p["y1"].between(top, bottom))
    by_x = F.transform(near, lambda p: F.struct(p["x1"], p["frag_idx"], p["y1"], p["text"]))
    values = rows.withColumn("band", F.explode(bands(top, bottom))).join(blocks, band).select(*TABLE, "field", by_x.alias("near"))
    columns = values.groupBy(*TABLE, "field").agg(F.flatten(F.collect_list("near")).alias("near"))
    # exploded: a filter on the amount itself would read it a second time
    amounts = columns.select(*TABLE, "field", F.explode_outer(F.array(let(F.array_sort("near"), _rightmost_amount))).alias("amount"))
    found = amounts.filter(F.col("amount").isNotNull())
    return found.groupBy(*PAGE, "field").agg(F.min_by("amount", "table_idx").alias("value"))


def _label_rows(labels: Column, starts: Column, wanted: Column) -> Column:
    """``(field, y1)`` of the first run, among those beginning in the first ``starts``
    fragments, that opens with each wanted field's label."""

    def run(part: Column, i: Column) -> Column:
        texts = F.transform(F.slice(labels, i + 1, F.lit(V.LABEL_RUN)), lambda p: p["text"])
        could_begin = part["text"].rlike(r"(?iU)^(?:[tn]|$)")
        return F.when(could_begin, F.struct(part["y1"].alias("y1"), texts.alias("texts"), F.array_join(texts, "").alias("whole")))

    def begins(r: Column, field: str) -> Column:
        pattern = f"(?iU)^(?:{V.BALANCE_LABELS[field]})"
        # a label found in a shorter run is found in the whole one, unless it depends on
        # what follows; those are tried on every length
        if "(?!" not in pattern:
            return r["whole"].rlike(pattern)
        lengths = F.sequence(F.lit(1), F.size(r["texts"]))
        return F.exists(lengths, lambda k: F.array_join(F.slice(r["texts"], F.lit(1), k), "").rlike(pattern))

    def first(runs: Column, field: str) -> Column:
        opening = F.get(F.filter(runs, lambda r: begins(r, field)), F.lit(0))
        return F.when(F.array_contains(wanted, field) & opening.isNotNull(), F.struct(F.lit(field).alias("field"), opening["y1"].alias("y1")))

    runs = F.array_compact(F.transform(F.slice(labels, F.lit(1), starts), run))
    return let(runs, lambda r: F.array_compact(F.array(*[first(r, f) for f in V.BALANCE_KEYS])))


def _rightmost_amount(parts: Column) -> Column:
    """The last readable amount of the columns that ``parts``, sorted by ``x1``, form: islands
    of fragments whose left edges are close together."""
    opens = F.filter(
        F.transform(parts, lambda p, i: F.when((i == 0) | (p["x1"] - F.get(parts, i - 1)["x1"] > V.COLUMN_GAP), i)),
        lambda i: i.isNotNull(),
    )

    def amounts(opens: Column) -> Column:
        def amount(begin: Column, j: Column) -> Column:
            island = F.slice(parts, begin + 1, F.coalesce(F.get(opens, j + 1), F.size(parts)) - begin)
            read = F.array_sort(F.transform(island, lambda p: F.struct(p["y1"], p["x1"], p["frag_idx"], p["text"])))
            return parse_amount_bs(F.array_join(F.transform(read, lambda p: p["text"]), ""))

        return F.array_compact(F.transform(opens, amount))

    return let(let(opens, amounts), lambda a: F.get(a, F.size(a) - 1))
