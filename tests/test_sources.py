"""Readers against the standard library's, on awkward and random texts."""

import csv
import gzip
import html
import io
import random
from html.entities import html5

from pyspark.sql import functions as F

from docledger.sources.files import csv_rows_as_text, html_rows, read_csv_text, unescape


def test_csv_reads_as_the_library_does(spark):
    r = random.Random(1)
    texts = [
        "", "a", "a,b\n", '"a",b\r\nc,"d ""q"" e"\n', '"x\ny",z', '""', '"",x', '""""', 'a"b,c', '"a"b,c', 'a,"b', "﻿h,i\nj,k\n",
        "\n\na\n\n", '"a\r\nb"\r\n', "a\rb\rc", '"' + "z" * 200_000 + '",q\n', 'x,"' + '""' * 5000 + '"\n', ",,\n,", '" a ", b', None,
    ]
    parts = ["a", "b", " ", ",", '"', "\n", "\r\n", '"a"', ',"x"', ',"y""z"']
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    csv.field_size_limit(10**9)

    def read(text):
        if text is None:
            return None
        return "\n".join(" ".join(row) for row in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")))

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.o for x in csv_rows_as_text(df, "t", "o").collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, read(t)) for t in texts]


def test_csv_file_is_one_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x,"two\nlines"\ny,z\n', encoding="utf-8")
    rows = read_csv_text(spark, str(tmp_path)).collect()
    assert [(r.filename, r.text) for r in rows] == [("a.csv", "x two\nlines\ny z")]


def test_csv_files_are_read_by_blocks(spark, tmp_path):
    """Files of any quoting, cut into blocks anywhere, read as the library reads them whole."""
    r = random.Random(3)
    parts = ["a", "é", " ", ",", '"', "\n", "\r\n", "\r", '"a"', ',"x"', ',"y""z"\n', '"p,\nq"', "\ufeff"]
    texts = ["\ufeff", "\ufeff\ufeff", "a", '""', '""""', '"a","b"', '\ufeff"a,b","c"\r\n', '\ufeffx,"', 'a,"b\n', "a\n", '\ufeffa"b', "a\r\n", '"a"\n\n', "\ufeffé"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(120)]
    texts += ["".join(r.choice(['"a, ""b""\n",', "c,d\n", '"e",', "é\r\n"]) for _ in range(3000))]
    for i, text in enumerate(texts):
        (tmp_path / f"{i:04d}.csv").write_bytes(text.encode())
    (tmp_path / "9999.csv.gz").write_bytes(gzip.compress(b'"g,h"\ni\n'))
    csv.field_size_limit(10**9)
    want = {f"{i:04d}.csv": "\n".join(" ".join(row) for row in csv.reader(io.StringIO(t.removeprefix("\ufeff"), newline=""))) for i, t in enumerate(texts)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        read = read_csv_text(spark, str(tmp_path))
        rows = read.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {x.filename: x.text for x in rows} == {**want, "9999.csv.gz": "g,h\ni"} and len(rows) == len(want) + 1
    # only packed and tiny files are read whole
    assert "collect_list" in read._jdf.queryExecution().optimizedPlan().toString()


def test_character_references_read_as_the_library_does(spark):
    r, names = random.Random(2), list(html5)
    texts = [
        "&agrave;", "&amp;lt;", "&notit;", "&notin;", "&#128;", "&#x80;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999999999999;",
        "&#13;", "&#1;", "& x", "&;", "&#;", "&#x;", "&unknown;", "&ampx", "&AMP", "a&b&c", "&#65", "&#x41g", "&copy2024", "&#129;",
        "&#xFFFE;", "&NotEqualTilde;", "plain", "&nbsp;&euro;é&#x1F600;", "",
    ]
    for _ in range(800):
        parts = ["&", "#", "x", ";", " ", "a", "1", "&" + r.choice(names), f"&#{r.randint(0, 1023)};", f"&#x{r.randint(0, 0x110010):x}"]
        texts.append("".join(r.choice(parts) for _ in range(r.randint(1, 6))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.o for x in df.select("i", unescape(F.col("t")).alias("o")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, html.unescape(t)) for t in texts]


def test_rows_of_a_page_are_numbered_over_its_tables(spark):
    one = "<table><tr><td>a</td><td>&eacute;</td></tr><tr><th>b</th></tr></table>"
    rows = [("d", 0, 1, one), ("d", 0, 0, "<table><tr><td>first</td></tr></table>"), ("d", 0, 2, "<p>none</p>"), ("e", 3, 0, None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, table_idx int, html string")
    got = sorted((r.doc_id, r.row_idx, r.cells) for r in html_rows(df).collect())
    assert got == [("d", 0, ["first"]), ("d", 1, ["a", "é"]), ("d", 2, ["b"])]
