"""Boxes for documents that carry their own text: values are looked up in the text layer.

A page's text layer is its text and the boxes of its pieces (characters or words). The pieces
of a page stand in one array in order of their offsets, so a range of text finds its pieces
by bisection inside the row; no piece is ever shuffled or joined by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bisect, dewrap, let, literal_occurrences
from ..session import cut
from .geometry import PAGE, page_offsets, pair_occurrences

#: Values that are looked up in a page together.
_VALUES = 256
RUN = "struct<start:int,end:int,left:double,bottom:double,right:double,top:double>"
_SPAN = "array<struct<start:int,end:int>>"


def layer_of(runs: DataFrame) -> DataFrame:
    """``doc_id, page, runs``: the pieces of each page, given as rows (doc_id, page, start, end, left, bottom,
    right, top), as one sorted array. A page is one value, as its text is."""
    piece = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (x.split(":") for x in RUN[7:-1].split(","))])
    return runs.groupBy(*PAGE).agg(F.sort_array(F.collect_list(piece)).alias("runs"))


def range_box(runs: Column, start: Column, end: Column) -> Column:
    """The box around all pieces that a range of text touches; NULL if there is none."""

    def around(hit: Column) -> Column:
        def of(name: str, pick) -> Column:
            return pick(F.transform(hit, lambda r: r[name])).alias(name)

        box = F.struct(of("left", F.array_min), of("bottom", F.array_min), of("right", F.array_max), of("top", F.array_max))
        return F.when(F.size(hit) > 0, box)

    first = bisect(runs, lambda r: r["end"] <= start)
    last = bisect(runs, lambda r: r["start"] < end)
    return let(F.slice(runs, first + 1, F.greatest(last - first, F.lit(0))), around)


def keeps_length(text: Column) -> Column:
    """No letter changes its length in lower case, so positions stay."""
    return F.length(F.lower(text)) == F.length(text)


def _lowered(text: Column, whole: Column) -> Column:
    """Lower case that keeps positions: all of it, or else A to Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(whole, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def value_occurrences(text: Column, value: Column, whole: Column | None = None, low: Column | None = None, flat: Column | None = None) -> Column:
    """``(start, end)`` of a value in a page, as successive searches find it (MAT3, JOI11).

    Each search starts where the last one ended. It looks for the value as it stands, in any
    case; when nothing is left, for the value with line breaks inside, which then are passed
    over, case as given. A search that has gone on to the latter cannot come back to the former,
    so all matches as they stand come first. ``whole``, ``low`` and ``flat`` are ``keeps_length``, the
    lowered text and the text without breaks, where the caller has them.
    """
    whole = keeps_length(text) if whole is None else whole
    low = _lowered(text, whole) if low is None else low
    flat = dewrap(text) if flat is None else flat
    plain = literal_occurrences(low, _lowered(value, whole))

    def wrapped(found: Column) -> Column:
        cursor = F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0))
        flat_start = F.length(dewrap(F.substring(text, F.lit(1), cursor)))
        # kept characters before each break
        lengths = F.transform(F.split(text, r"[\r\n]", -1), F.length)
        none = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

        def grown(acc: Column, n: Column) -> Column:
            return F.struct((acc["n"] + n).alias("n"), F.array_append(acc["out"], acc["n"] + n).alias("out"))

        breaks = F.aggregate(F.slice(lengths, F.lit(1), F.size(lengths) - 1), none, grown, lambda acc: acc["out"])
        later = literal_occurrences(F.substring(flat, flat_start + 1, F.length(flat)), value)

        def original(kept: Column, marks: Column) -> Column:
            return kept + bisect(marks, lambda b: b <= kept)

        def back(spans: Column, marks: Column) -> Column:
            return F.transform(
                spans,
                lambda o: F.struct(
                    original(o["start"] + flat_start, marks).alias("start"), (original(o["end"] + flat_start - 1, marks) + 1).alias("end")
                ),
            )

        none_left = F.array().cast(_SPAN)
        more = let(later, lambda l: F.when(F.size(l) > 0, let(breaks, lambda marks: back(l, marks)).cast(_SPAN)).otherwise(none_left))
        return F.concat(found.cast(_SPAN), F.when(F.length(flat) < F.length(text), more).otherwise(none_left))

    return F.when(F.length(value) > 0, let(plain, wrapped)).otherwise(F.array().cast(_SPAN))


def _packed(runs: Column) -> Column:
    """Pieces as one array for each of their columns: a shuffle of them is much smaller."""

    def column(name: str) -> Column:
        return F.transform(runs, lambda r: r[name]).alias(name)

    return F.struct(*[column(x.split(":")[0]) for x in RUN[7:-1].split(",")])


def _unpacked(packed: Column) -> Column:
    return F.arrays_zip(*[packed[x.split(":")[0]] for x in RUN[7:-1].split(",")]).cast(f"array<{RUN}>")


def find_values(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page, value, pos, end, box``: every occurrence of a document's values on its pages, with the box of
    its pieces (NULL without one).

    ``wanted``: doc_id, value; ``pages``: doc_id, page, text, runs. A page meets its document's values
    in groups of some hundred, and only values that it holds leave the row.
    """
    values = wanted.filter("value <> ''").select("doc_id", "value").distinct()
    sizes = values.groupBy("doc_id").agg(F.ceil(F.count("*") / _VALUES).alias("groups"))
    grouped = (
        values.join(sizes, "doc_id").withColumn("group", F.pmod(F.xxhash64("value"), F.col("groups")))
        .groupBy("doc_id", "group").agg(F.collect_list("value").alias("values"))
    )
    text = F.col("text")
    folds, low, flat = F.col("__folds"), F.col("__low"), F.col("__flat")
    # the text is folded and dewrapped behind the join: one text of a page is shuffled, not three
    met = pages.select(*PAGE, "text", _packed(F.col("runs")).alias("__runs")).join(grouped, "doc_id")
    met = met.withColumns({"runs": _unpacked(F.col("__runs")), "__folds": keeps_length(text), "__flat": dewrap(text)}).withColumn("__low", _lowered(text, folds))
    held = F.filter("values", lambda v: low.contains(_lowered(v, folds)) | flat.contains(v))
    found = met.withColumn("value", F.explode(held)).withColumn("o", F.explode(value_occurrences(text, F.col("value"), folds, low, flat)))
    return found.select(
        *PAGE, "value", F.col("o.start").alias("pos"), F.col("o.end").alias("end"), range_box(F.col("runs"), F.col("o.start"), F.col("o.end")).alias("box")
    )


def _taken_past_gaps(items: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, value, item_idx, page, box`` where some occurrence of a value has no box: an item that meets it
    goes on to the next page, and the next item starts behind it. One value of one document at a time."""
    asked = items.groupBy("doc_id", "value").agg(F.sort_array(F.collect_list("item_idx")).alias("left"))
    on_page = F.sort_array(F.collect_list(F.struct("pos", "box")))
    per_page = found.groupBy(*PAGE, "value").agg(on_page.alias("o")).groupBy("doc_id", "value").agg(F.sort_array(F.collect_list(F.struct("page", "o"))).alias("pages"))
    kinds = dict(found.dtypes)
    out = f"array<struct<item_idx:{dict(items.dtypes)['item_idx']},page:{kinds['page']},box:{kinds['box']}>>"

    def visit(acc: Column, page: Column) -> Column:
        n = F.least(F.size(acc["left"]), F.size(page["o"]))
        pairs = F.zip_with(
            F.slice(acc["left"], F.lit(1), n), F.slice(page["o"], F.lit(1), n),
            lambda i, o: F.struct(i.alias("item_idx"), page["page"].alias("page"), o["box"].alias("box")),
        )
        passed = F.transform(F.filter(pairs, lambda p: p["box"].isNull()), lambda p: p["item_idx"])
        return F.struct(
            F.concat(passed, F.slice(acc["left"], n + 1, F.size(acc["left"]))).alias("left"),
            F.concat(acc["out"], F.filter(pairs, lambda p: p["box"].isNotNull())).cast(out).alias("out"),
        )

    start = F.struct(F.col("left"), F.array().cast(out).alias("out"))
    folded = F.aggregate("pages", start, visit, lambda acc: acc["out"])
    return asked.join(per_page, ["doc_id", "value"]).select("doc_id", "value", F.explode(folded).alias("t")).select("doc_id", "value", "t.*")


def text_native_boxes(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``items`` with boxes in percent of the document's stacked pages (JOI11).

    ``items``: doc_id, item_idx, field, value and x_pct, y_pct, w_pct, h_pct, NULL where an item has
    no box yet; ``pages``: doc_id, page, text, width, height and runs (``layer_of``), bottom-up as in a
    PDF. Items with a box pass through. The others take, in their order, successive
    occurrences of their value, page by page; an item that finds none is left out.
    """
    # items are read five times and sizes twice below: written once, so that the texts they may be
    # made from are not read for each
    items, sizes = cut(items), cut(pages.select(*PAGE, "width", "height"))
    kept = items.filter(F.col("x_pct").isNotNull())
    asked = items.filter(F.col("x_pct").isNull() & (F.col("value") != "")).drop("x_pct", "y_pct", "w_pct", "h_pct")
    # read three times below: written once, as texts are searched for it
    found = cut(find_values(asked, pages))
    keys = ["doc_id", "value"]
    gaps = found.groupBy(*keys).agg(F.bool_or(F.col("box").isNull()).alias("gap")).filter("gap").select(*keys)
    number = ["doc_id", "value", "item_idx"]
    whole = pair_occurrences(asked.join(gaps, keys, "left_anti").select(*number), found.join(gaps, keys, "left_anti").drop("end"))
    past = _taken_past_gaps(asked.join(gaps, keys, "left_semi"), found.join(gaps, keys, "left_semi"))
    taken = whole.select(*number, "page", "box").unionByName(past.select(*number, "page", "box"))
    placed = taken.join(page_offsets(sizes), PAGE)
    box = F.col("box")
    sized = placed.select(
        *number, (box["left"] / F.col("max_w")).alias("x_pct"),
        ((F.col("page_offset") + (F.col("height") - box["top"])) / F.col("total_h")).alias("y_pct"),
        ((box["right"] - box["left"]) / F.col("max_w")).alias("w_pct"), ((box["top"] - box["bottom"]) / F.col("total_h")).alias("h_pct"),
    )
    return kept.unionByName(asked.join(sized, number).select(*kept.columns))
