"""Reading documents, and turning lines, paragraphs, rows and HTML into text and cells."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import let, strip


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, filename, byte_size, content`` of every file below a folder (SRC1).
    ``content`` is read only when selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.sha2("path", 256).alias("doc_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("byte_size"),
        "content",
    )


def regular_csv_as_text(text: Column) -> Column:
    """CSV text with each row's values joined by a space: quotes taken off, doubled quotes inside
    them made single, line breaks inside them kept. NULL for irregular quoting: a quote in
    the middle of a bare value, text right after a closing quote, a quote left open.

    A quote opens a value only at its start, so cutting at quotes gives stretches outside and
    inside of them in turn; outside, commas become blanks and row ends become line breaks."""
    return let(F.split(text, '"', -1), lambda p: F.when(~_irregular(p), _join_stretches(p)))


def _join_stretches(p: Column) -> Column:
    last = F.size(p) - 1

    def outside(piece: Column, i: Column) -> Column:
        # the reader ends a row at any of the three line ends and knows no row after the last
        rows = F.translate(F.regexp_replace(piece, r"\r\n|\r", "\n"), ",", " ")
        # blank rows give blank lines; the end of the last row starts no row
        return F.when((i == last) & piece.rlike(r"[\r\n]$"), F.substring(rows, F.lit(1), F.length(rows) - 1)).otherwise(rows)

    # an empty stretch between two quotes, not at the text's ends, is a doubled quote
    doubled = lambda i: (i > 0) & (i < last)
    made = F.transform(
        p,
        lambda x, i: F.when(i % 2 == 1, x).when(doubled(i) & (x == ""), F.lit('"')).otherwise(outside(x, i)),
    )
    # of a known length, where array_join doubles what it has
    return F.concat_ws("", made)


def _irregular(p: Column) -> Column:
    last = F.size(p) - 1
    broken = F.transform(
        p,
        lambda x, i: (i % 2 == 0)
        & (
            ((i < last) & ~((x == "") | x.rlike(r"[,\r\n]$")))  # before an opening quote
            | ((i > 0) & ~((x == "") | x.rlike(r"^[,\r\n]")))  # after a closing one
        ),
    )
    # the library's reader also stops inside an open quote, and drops what is unquoted and NUL
    return F.exists(broken, lambda b: b) | (last % 2 == 1)


def csv_rows_as_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the CSV text of ``column`` with each row's values joined by a space (SRC2).
    Only texts with irregular quoting go through the standard library's reader."""
    bare = F.regexp_replace(column, "^\ufeff", "")
    work = df.withColumn("__bare", bare).withColumn("__regular", regular_csv_as_text(F.col("__bare")))
    read = F.pandas_udf(_csv_reader(), StringType())(F.when(F.col("__regular").isNull(), F.col("__bare")))
    return work.withColumn("__read", read).withColumn(out, F.coalesce("__regular", "__read")).drop("__bare", "__regular", "__read")


def _csv_reader():
    """Function of a series of whole CSV texts, values of any length."""

    def flatten(texts):
        import csv
        import io

        csv.field_size_limit(2**31 - 1)

        def one(value):
            return "\n".join(" ".join(row) for row in csv.reader(io.StringIO(value, newline="")))

        return texts.map(one, na_action="ignore")

    import pandas as pd

    flatten.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return flatten


#: Names of files that are unpacked while they are read, so that their size is not the text's.
_PACKED = r"(?i)\.(?:gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$"
_BOM_BYTES = 3


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, filename, text`` of CSV files, byte-order mark removed (SRC2).

    Files are read by blocks, in the stretches between their quotes; the stretches of a file
    meet in order and are joined as they are. Only irregular files are made whole for the
    library's reader, and only packed or tiny ones are read whole."""
    size = F.col("_metadata.file_size")
    names = [F.sha2(F.col("_metadata.file_path"), 256).alias("doc_id"), F.col("_metadata.file_name").alias("filename")]
    unsplit = (size <= _BOM_BYTES) | F.col("_metadata.file_name").rlike(_PACKED)
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).filter(unsplit).select(*names, "value")
    at = [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")]
    stretches = spark.read.text(path, lineSep='"', recursiveFileLookup=True).filter(~unsplit).select(
        *names, size.alias("size"), F.octet_length("value").alias("bytes"), F.struct(*at, F.make_valid_utf8("value").alias("text")).alias("piece")
    )
    found = F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["text"])
    # the reader takes off the mark, and a quote after each stretch; after a text's last quote it knows none
    left = F.first("size") - F.sum("bytes") - F.count("*")
    pieces = F.when(left.isin(0, _BOM_BYTES), F.concat(found, F.array(F.lit("")))).otherwise(found)

    files = stretches.groupBy("doc_id", "filename").agg(pieces.alias("p"))
    # told apart by their stretches: a condition on the text would need it as a column of a row
    odd = _irregular(F.col("p"))
    regular = files.filter(~odd).select("doc_id", "filename", _join_stretches(F.col("p")).alias("text"))
    irregular = files.filter(odd).select("doc_id", "filename", F.concat_ws('"', "p").alias("value"))
    read = irregular.select("doc_id", "filename", F.pandas_udf(_csv_reader(), StringType())("value").alias("text"))
    rest = csv_rows_as_text(whole, "value", "text").select("doc_id", "filename", "text")
    return regular.unionByName(read).unionByName(rest)


def _joined(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def flatten_doc(paragraphs: DataFrame, rows: DataFrame) -> DataFrame:
    """``doc_id, text``: non-blank paragraphs, then table rows with cells joined by a space
    (SRC3). ``paragraphs``: doc_id, para_idx, text; ``rows``: doc_id, row_idx, cells."""
    lead = paragraphs.filter(strip(F.col("text")) != "").select(
        "doc_id", F.lit(0).alias("part"), F.col("para_idx").cast("long").alias("idx"), "text"
    )
    tail = rows.select(
        "doc_id", F.lit(1).alias("part"), F.col("row_idx").cast("long").alias("idx"), F.array_join("cells", " ").alias("text")
    )
    return _joined(lead.unionByName(tail), ["doc_id"], ["part", "idx"])


def join_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, text`` from page texts in page order (SRC4)."""
    return _joined(pages, ["doc_id"], ["page"])


def lines_to_text(lines: DataFrame) -> DataFrame:
    """``doc_id, page, text`` from recognised lines in index order (SRC4)."""
    return _joined(lines, ["doc_id", "page"], ["line_idx"])


def text_length(pages: DataFrame) -> DataFrame:
    """``doc_id, text_len``: sum of the stripped page lengths, what routing looks at."""
    return pages.groupBy("doc_id").agg(F.sum(F.length(strip(F.col("text")))).alias("text_len"))


# --- HTML ----------------------------------------------------------------------------
#: A character reference, or the text up to the next one.
_REFERENCE = r"(?s)&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]{0,31};?|.[^&]*"


def _named() -> tuple[Column, str]:
    """The standard's names (from the library's table) as a literal map, and a pattern of those
    that need no semicolon, longest first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    table = F.from_json(F.lit(json.dumps(html5, ensure_ascii=False)), "map<string,string>")
    return table, "^&(" + "|".join(bare) + ")"


def unescape(c: Column) -> Column:
    """Character references as characters: all names of the standard, with the semicolon where
    it may not be missing; numbers; code points that stand for others in old pages."""
    table, prefix = _named()

    def from_number(code: Column) -> Column:
        # what browsers read in the place of code points that are no characters
        char = F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | code.isNull(), "\ufffd")
        char = char.when(code == 0x0D, "\r")
        page = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")
        windows = F.substring(F.lit(page), (code - 0x7F).cast("int"), F.lit(1))
        kept = code.isin(0x81, 0x8D, 0x8F, 0x90, 0x9D)  # no sign in that page: the code point itself
        char = char.when(code.between(0x80, 0x9F) & ~kept, windows)
        nothing = code.between(1, 8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | (code == 0xB)
        nothing = (nothing & ~kept) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return char.when(nothing, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def decode(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^&#([0-9]+);?$", 1)
        hexa = F.regexp_extract(token, r"^&#[xX]([0-9a-fA-F]+);?$", 1)
        # a number of more digits than a code point has is none
        code = F.when(hexa != "", F.conv(F.when(F.length(F.ltrim(hexa)) <= 15, hexa), 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
        whole = F.try_element_at(table, F.substring(token, 2, 64))
        short = F.regexp_extract(token, prefix, 1)
        part = F.concat(F.try_element_at(table, short), F.substring(token, F.length(short) + 2, F.length(token)))
        named = F.coalesce(whole, F.when(short != "", part), token)
        return F.when(token.startswith("&#"), F.when((hexa == "") & (digits == ""), token).otherwise(let(code, from_number))).when(
            token.startswith("&"), named
        ).otherwise(token)

    tokens = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(tokens, decode), "")).otherwise(c)


def table_cells(html: Column) -> Column:
    """Rows of cell texts of an HTML table: ``array<array<string>>`` (SRC5)."""
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    rows = F.regexp_extract_all(clean, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))

    def cells(row: Column) -> Column:
        raw = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
        return F.transform(raw, lambda c: strip(unescape(F.regexp_replace(c, r"(?s)<[^>]*>", ""))))

    return F.transform(rows, cells)


def html_rows(tables: DataFrame) -> DataFrame:
    """``doc_id, page, row_idx, cells`` from ``doc_id, page, table_idx, html`` (SRC5); the
    row index runs over all tables of a page, in table order."""
    rows = tables.select("doc_id", "page", "table_idx", F.posexplode(table_cells(F.col("html"))).alias("i", "cells"))
    # the rows of one page are numbered in one task, as its tables are read from one page
    at = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("table_idx", "i")) - 1
    return rows.select("doc_id", "page", at.alias("row_idx"), "cells")
