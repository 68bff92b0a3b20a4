"""Column helpers for working with text positions. All native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# \s plus the four ASCII separators that count as blank in text but not in Java's \s
_BLANK = r"[\s\x1c-\x1f]"
_ALL_BLANKS = rf"(?U){_BLANK}+"
# the same characters one by one, for functions that take no pattern
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

SPANS = "array<struct<start:int,end:int,value:string,grp:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bisect(items: Column, before) -> Column:
    """How many elements at the front of an array satisfy ``before``; it must hold for none behind the
    first that fails it. Halves the array, so long arrays cost few steps."""

    def halve(bounds: Column, _: Column) -> Column:
        middle = F.floor((bounds["lo"] + bounds["hi"]) / 2).cast("int")
        inside = before(F.get(items, middle))
        return F.when(
            bounds["lo"] < bounds["hi"],
            F.struct(
                F.when(inside, middle + 1).otherwise(bounds["lo"]).alias("lo"), F.when(inside, bounds["hi"]).otherwise(middle).alias("hi")
            ),
        ).otherwise(bounds)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1)).cast("int"))
    whole = F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi"))
    return F.aggregate(rounds, whole, halve, lambda b: b["lo"])


def first_not_null(values: Column) -> Column:
    """First non-null element of an array, NULL when there is none."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def despace(c: Column) -> Column:
    """Remove all whitespace (MAT1)."""
    return F.when(is_ascii(c), F.regexp_replace(c, ascii_pattern(_ALL_BLANKS), "")).otherwise(F.regexp_replace(c, _ALL_BLANKS, ""))


def leading_blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.ltrim(c, F.lit(_BLANKS)))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in text order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def is_ascii(c: Column) -> Column:
    """Every character of the text is one byte."""
    return F.octet_length(c) == F.length(c)


def ascii_pattern(pattern: str) -> str:
    """The pattern that finds the same in ASCII texts without looking characters up in Unicode's
    tables: blanks, digits, words and letter cases of ASCII are the same in both."""
    if not pattern.isascii():
        return pattern
    return re.sub(r"\(\?([a-zA-Z]+)\)", lambda m: f"(?{f})" if (f := m[1].replace("U", "")) else "", pattern)


# noncharacters: no text that came through a decoder holds them
_OPEN, _MID, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def match_spans(text: Column, pattern: str, group: int = 0, begin: str = "") -> Column:
    """All matches with 0-based ``[start, end)`` positions, computed without a UDF.

    One pass of the pattern writes each match and its group between marks; the marked text
    is then cut at the marks, and the lengths of its pieces add up to the positions. A text
    that holds a mark of its own is cut by the pattern instead. ``begin``: see ``marked_pieces``.
    """
    found = let(marked_pieces(text, pattern, group, begin), lambda pieces: F.when(F.size(pieces) > 1, _fold_pieces(pieces)).otherwise(F.array().cast(SPANS)))
    return F.when(_holds_marks(text), _cut_spans(text, pattern, group)).otherwise(found)


def marked_pieces(text: Column, pattern: str, group: int = 0, begin: str = "") -> Column:
    """The text cut before each match, its matches and their groups marked.

    ``begin`` is a pattern of the characters that every match in an ASCII text begins with: it is
    tried first, as most places fail it sooner than the whole pattern."""
    marks = F.lit(f"{_OPEN}$0{_MID}${group}{_CLOSE}")
    quick = f"(?={begin}){ascii_pattern(pattern)}" if begin else ascii_pattern(pattern)
    marked = F.when(is_ascii(text), F.regexp_replace(text, F.lit(quick), marks)).otherwise(
        F.regexp_replace(text, F.lit(pattern), marks)
    )
    return F.split(marked, _OPEN, -1)


def spans_of_pieces(pieces: Column, text: Column, pattern: str, group: int = 0) -> Column:
    """``match_spans`` of a column of its ``marked_pieces``. A single match needs no loop, and
    Spark compiles what stands outside of loops."""
    only = F.get(pieces, F.lit(1))
    hit = F.substring_index(only, _MID, 1)
    start = F.length(F.get(pieces, F.lit(0)))
    grp = F.substring_index(F.substring_index(only, _MID, -1), _CLOSE, 1)
    single = F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"), grp.alias("grp"))
    return (
        F.when(_holds_marks(text), _cut_spans(text, pattern, group))
        .when(F.size(pieces) == 1, F.array().cast(SPANS))
        .when(F.size(pieces) == 2, F.array(single))
        .when(F.size(pieces) > 2, _fold_pieces(pieces))
    )


def _holds_marks(text: Column) -> Column:
    return ~is_ascii(text) & (text.contains(_OPEN) | text.contains(_MID) | text.contains(_CLOSE))


def _fold_pieces(pieces: Column) -> Column:
    def part(piece: Column) -> Column:
        hit = F.substring_index(piece, _MID, 1)
        return F.struct(
            hit.alias("hit"), F.substring_index(F.substring_index(piece, _MID, -1), _CLOSE, 1).alias("grp"),
            F.length(hit).alias("n"), F.length(F.substring_index(piece, _CLOSE, -1)).alias("gap"),
        )

    # positions alone are carried: spans carried in the state would be copied at every match
    start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("pos"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["pos"] + p["n"] + p["gap"]).alias("pos"), F.array_append(acc["out"], acc["pos"]).alias("out"))

    def span(p: Column, at: Column) -> Column:
        return F.struct(at.alias("start"), (at + p["n"]).alias("end"), p["hit"].alias("value"), p["grp"].alias("grp"))

    def spans(parts: Column) -> Column:
        return F.zip_with(parts, F.aggregate(parts, start, step, lambda acc: acc["out"]), span)

    return let(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), part), spans)


def map_few(items: Column, kind: str, body: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """``body`` of the elements that ``keep`` holds for. ``items`` must be a column, as it is read several
    times: most hold no element or one, and Spark compiles what stands outside of loops."""
    none, first = F.array().cast(kind), F.get(items, F.lit(0))
    single, kept = F.array(body(first)), items
    if keep is not None:
        single, kept = F.when(keep(first), single).otherwise(none), F.filter(items, keep)
    return F.when(F.size(items) == 0, none).when(F.size(items) == 1, single).otherwise(F.transform(kept, body))


def _cut_spans(text: Column, pattern: str, group: int) -> Column:
    """The same spans from the matches and the text between them."""
    hits = find_all(text, pattern)
    groups = find_all(text, pattern, group) if group else hits
    gaps = F.split(text, pattern, -1)

    def fold(pairs: Column) -> Column:
        triples = F.zip_with(
            pairs,
            F.slice(gaps, F.lit(1), F.size(pairs)),
            lambda p, g: F.struct(p["hit"].alias("hit"), p["grp"].alias("grp"), g.alias("gap")),
        )
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, t: Column) -> Column:
            s = acc["pos"] + F.length(t["gap"])
            e = s + F.length(t["hit"])
            span = F.struct(s.alias("start"), e.alias("end"), t["hit"].alias("value"), t["grp"].alias("grp"))
            return F.struct(e.alias("pos"), F.array_append(acc["out"], span).alias("out"))

        return F.when(
            F.size(pairs) > 0, F.aggregate(triples, start, step, lambda acc: acc["out"])
        ).otherwise(F.array().cast(SPANS))

    pairs = F.zip_with(hits, groups, lambda h, g: F.struct(h.alias("hit"), g.alias("grp")))
    return let(pairs, fold)


def literal_occurrences(text: Column, value: Column) -> Column:
    """Every non-overlapping occurrence of a literal value, as ``(start, end)`` (RED3)."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    kind = "array<struct<start:int,end:int>>"
    state = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        s = acc["pos"] + F.length(piece)
        e = s + F.length(value)
        return F.struct(
            e.alias("pos"), F.array_append(acc["out"], F.struct(s.alias("start"), e.alias("end"))).alias("out")
        )

    found = let(
        pieces,
        lambda p: F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), state, step, lambda acc: acc["out"]),
    )
    return F.when((F.length(value) > 0) & text.isNotNull(), found).otherwise(F.array().cast(kind))


def line_of_offset(text: Column, offset: Column) -> Column:
    """Index of the line holding a 0-based offset; an offset on a newline belongs to the
    line it ends (EXT10)."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def dewrap(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]", "")


def find_dewrapped(text: Column, value: Column, start: Column | int = 0) -> Column:
    """First occurrence of ``value`` at or after ``start`` when line breaks inside the
    text are ignored; returns ``(start, end)`` in the original text or NULL (MAT3)."""
    start = F.lit(start) if isinstance(start, int) else start
    flat_start = F.length(dewrap(F.substring(text, F.lit(1), start)))
    # kept characters of each line that a break ends
    lines = F.split(text, r"[\r\n]", -1)
    lengths = F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), F.length)

    def original(kept: Column, breaks: Column) -> Column:
        # kept-character index -> original index: add the breaks that come before it
        zero = F.struct(F.lit(0).alias("cum"), F.lit(0).alias("n"))

        def step(acc: Column, n: Column) -> Column:
            cum = acc["cum"] + n
            return F.struct(cum.alias("cum"), (acc["n"] + (cum <= kept).cast("int")).alias("n"))

        return kept + F.aggregate(breaks, zero, step, lambda acc: acc["n"])

    def search(v: Column) -> Column:
        def build(k: Column) -> Column:
            def span(breaks: Column) -> Column:
                return F.struct(original(k, breaks).alias("start"), (original(k + F.length(v) - 1, breaks) + 1).alias("end"))

            return F.when(k >= 0, let(lengths, span))

        return F.when(F.length(v) > 0, let(F.position(v, dewrap(text), flat_start + 1) - 1, build))

    # bound, as the value may be an expression over the text itself
    return let(value, search)


def find_first(text: Column, value: Column, start: Column | int = 0) -> Column:
    """Exact search first, dewrapped search only when that finds nothing."""
    start = F.lit(start) if isinstance(start, int) else start
    pos = F.position(value, text, start + 1) - 1
    exact = let(
        pos,
        lambda p: F.when(
            p >= 0, F.struct(p.alias("start"), (p + F.length(value)).alias("end"))
        ),
    )
    return F.coalesce(F.when(F.length(value) > 0, exact), find_dewrapped(text, value, start))
