"""Steps that must not work twice, or meet in one task, on large tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docledger.functions import text as T
from docledger.functions.extract_au import context_name, hit_columns, with_hits, with_text_fields
from docledger.operators import balance as B
from docledger.operators import geometry as G
from docledger.operators.scoring import write_report
from docledger.operators.spans import mask_text
from docledger.operators.views import join_known
from docledger.plans.all_queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 4, F.concat(F.lit("k"), "id")).alias("key"))
    names = spark.createDataFrame([("k1", "one"), ("k2", "two")], ["key", "name"])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # no names at all for most rows: a literal on the right side would leave one task with them
        joined = join_known(rows, names, "key")
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        found = {r.id: r.name for r in joined.filter("name IS NOT NULL").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert found == {1: "one", 2: "two"}


def test_a_dewrapped_text_is_searched_once(spark, tmp_path):
    texts = ["alpha beta\nga\nmma delta", "", None, "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["mat3_find_dewrapped"](spark, str(tmp_path))
    # no filter on the search below the dealing out
    assert "Filter" not in plan(found).split("Repartition")[1]
    assert {r.doc_id: (r.start, r.end) for r in found.collect()} == {0: (12, 23), 3: (0, 1)}


def test_context_lines_are_lowered_once(spark):
    df = spark.createDataFrame([("Ann WORKER:\nAnn Lee Low",), ("no key:\nAnn Lee",)], ["text"]).withColumn("n", context_name(F.col("text")))
    assert "contains(lower(" not in plan(df).lower()
    assert [r.n for r in df.collect()] == ["Ann Lee Low", None]


def test_masks_carry_positions_only(spark):
    kind = "array<struct<start:int,end:int>>"
    cases = [("abcdefgh", [(4, 6), (1, 3), (2, 5)]), ("abc", []), ("abc", None), ("abc", [(0, 3), (1, 2)]), (None, [(0, 1)])]
    df = spark.createDataFrame(cases, f"text string, spans {kind}").withColumn("m", mask_text(F.col("text"), F.col("spans"), "#"))
    assert [r.m for r in df.collect()] == ["a#####gh", "abc", None, "###", None]
    assert "parts" not in plan(df)


def test_ascii_texts_take_the_plain_pattern(spark):
    p = r"(?iU)N?ame\s*:\s*(\d+)"
    assert T.ascii_pattern(p) == r"(?i)N?ame\s*:\s*(\d+)" and T.ascii_pattern(r"(?U)\b\d") == r"\b\d" and T.ascii_pattern("(?iU)ọ") == "(?iU)ọ"
    # a long s, a no-break space and Arabic digits count only in texts that hold them
    df = spark.createDataFrame([("NAME: 12 x ame:3",), ("name\u00a0: \u0661\u0662 ame:3",)], ["t"])
    spans = df.select(T.match_spans(F.col("t"), p, 1).alias("s")).collect()
    assert [[(x.start, x.end, x.grp) for x in r.s] for r in spans] == [[(0, 8, "12"), (11, 16, "3")], [(0, 9, "\u0661\u0662"), (10, 15, "3")]]


def test_cells_of_a_balance_sheet_are_classified_once(spark):
    rows = [("a", 0, 0, ["Current assets", ""]), ("a", 0, 1, ["Total", "$5"]), ("a", 0, 2, ["Total Liabililies", "$7"])]
    totals = B.read_pages(spark.createDataFrame(rows, "doc_id string, page int, row_idx int, cells array<string>"))
    assert "^Total$" not in plan(totals)  # written before
    (r,) = totals.collect()
    assert (r.total_current_assets, r.total_liabilities, r.total_assets) == (5.0, 7.0, None)


def test_cells_meet_their_fragments_once(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0, 0.0, 0.0, 200.0, 50.0), ("a", 0, 0, 1, 200.0, 0.0, 400.0, 50.0), ("a", 0, 0, 2, 400.0, 0.0, 600.0, 50.0), ("a", 0, 0, 3, 700.0, 60.0, 800.0, 90.0)],
                                  "doc_id string, page int, table_idx int, cell_idx int, x1 double, y1 double, x2 double, y2 double")
    frags = spark.createDataFrame([("a", 0, 0, 0, "Total Assets", 10.0, 5.0, 60.0, 20.0), ("a", 0, 0, 1, "$9", 210.0, 5.0, 260.0, 20.0), ("a", 0, 0, 2, "$8", 410.0, 5.0, 460.0, 20.0), ("a", 0, 0, 3, "$9", 710.0, 65.0, 760.0, 80.0)],
                                  "doc_id string, page int, table_idx int, frag_idx int, text string, x1 double, y1 double, x2 double, y2 double")
    targets = spark.createDataFrame([("a", 0, "total_assets", 9.0), ("a", 0, "total_equity", 9.0)], "doc_id string, page int, field string, target double")
    assert "collect_list" not in plan(G.cell_texts(cells, frags))
    boxes = G.balance_boxes(cells, frags, targets)
    assert "collect_list" not in plan(boxes)
    # next to its label, though another stands further right; without a label the rightmost
    assert {r.field: (r.value, r.x1) for r in boxes.collect()} == {"total_assets": ("$9", 210.0), "total_equity": ("$9", 710.0)}


def test_texts_are_dealt_out_once_for_a_layer(spark, tmp_path):
    turns = [(1, 0, "user", "one two\nthree four"), (1, 1, "assistant", "one more")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    boxes = QUERIES["joi11_text_native_boxes"](spark, str(tmp_path))
    assert "Repartition" not in plan(boxes)
    assert sorted((r.item_idx, r.field) for r in boxes.collect()) == [(0, "first"), (1, "around"), (4, "boxed"), (5, "first"), (9, "boxed")]


def test_rows_of_lost_totals_are_searched_once(spark):
    frags = [("d", 0, 0, i, x, 10.0 + 300 * (i % 2), 700.0 * (i // 2), 20.0, 9.0) for i, x in enumerate(["Total Assets", "$5", "Net Worth", "n/a"])]
    frags = spark.createDataFrame(frags, "doc_id string, page int, table_idx int, frag_idx int, text string, x1 double, y1 double, x2 double, y2 double")
    missing = spark.createDataFrame([("d", 0, "total_assets"), ("d", 0, "total_equity")], "doc_id string, page int, field string")
    found = G.recover_rows(frags, missing)
    # neither labels nor amounts are read in a condition, and then again
    assert not [x for x in plan(found).splitlines() if ("Filter" in x or "Join" in x) and "transform(" in x]
    assert [(r.field, r.value) for r in found.collect()] == [("total_assets", 5.0)]


def test_a_report_scores_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def right(i):
        calls.add(1)
        return i % 3 > 0

    scored = spark.range(30).select("id", right.asNondeterministic()("id").alias("correct"))
    scored = scored.select(F.col("id").alias("doc_id"), F.lit("bsb").alias("field"), F.lit("e").alias("expected"), "correct", F.lit("g").alias("got"))
    write_report(scored, f"{tmp_path}/report", ["bsb"])
    assert calls.value == 30
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert len(lines) == 14 and {"Documents scored: 30", "Overall: 20 / 30  (66.7%)", "Misses (10):"} < set(lines)


def test_boxes_share_matches_and_words(spark):
    texts = [("a", 0, "BSB: 062-000\nBSB: 062-000 $5\nNet Pay: $5"), ("b", 0, ""), ("c", 0, None)]
    pages = spark.createDataFrame(texts, "doc_id string, page int, text string")
    hits = hit_columns()
    once, again = (G.box_candidates(with_text_fields(p, hits=h), h) for p, h in ((with_hits(pages), hits), (pages, None)))
    # no pattern is searched again
    assert plan(once).count("B?SB") == plan(with_hits(pages)).count("B?SB")
    want = sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, once.collect())) == want and len(want) == 7
    words = T.match_spans(F.col("text"), r"\S+")
    words = pages.select("doc_id", "page", F.explode(words).alias("w")).select("doc_id", "page", "w.start", "w.end", *[F.col(f"w.{e}").cast("double").alias(c) for c, e in (("x1", "start"), ("y1", "start"), ("x2", "end"), ("y2", "end"))])
    boxed = G.union_box(again, words)
    assert "regexp_replace" not in plan(boxed) and "s_start" not in plan(boxed)
    assert boxed.count() == len(want)


def _box_around(rows, spans):
    """Box of each item, as ``union_box`` finds it: word by word."""
    out = {}
    for page, item, *_ in spans:
        ranges = [(s, e) for p, i, s, e in spans if (p, i) == (page, item)]
        words = [w for w in rows if w[0] == page]
        hit = [w[3:] for w in words if any(w[1] < e and w[2] > s for s, e in ranges)]
        if hit:
            x1, y1, x2, y2 = (pick(w[k] for w in hit) for k, pick in enumerate((min, min, max, max)))
            below = [w[4] for w in words if w[4] > y2 or (w[4] == y2 and w[6] > w[4])]
            h = y2 - y1
            bottom = float(round(h * 0.35))
            if below:
                bottom = min(bottom, float((min(below) - y2) // 2))
            out[page, item] = (x1 - round(h * 0.35), y1, x2 + round(h * 0.15), y2 + bottom)
    return out


@pytest.mark.parametrize("scanned", [64, 0])
def test_words_of_a_page_meet_its_spans_in_a_row(spark, monkeypatch, scanned):
    monkeypatch.setattr(G, "SCANNED", scanned)
    r = random.Random(2)
    rows, spans = [], []
    for page in range(30):
        at = 0
        for _ in range(r.randint(1, 40)):
            # words that lie apart; on every third page some within others, and some without height
            at, n = at + r.randint(0, 4), r.randint(1, 9)
            x, y = float(10 * at), float(20 * r.randint(0, 5))
            rows.append((page, at, at + n, x, y, x + 10 * n, y + (r.choice([0.0, 20.0]) if page % 3 == 0 else 17.0)))
            at += 0 if page % 3 == 0 else n
        spans += [(page, r.randint(0, 9) if page % 4 == 0 else i, s, s + r.randint(0, 30)) for i, s in enumerate(r.choices(range(at + 9), k=9))]
    word_table = spark.createDataFrame([("d", *w) for w in rows], "doc_id string, page int, start int, end int, x1 double, y1 double, x2 double, y2 double")
    span_table = spark.createDataFrame([("d", *s) for s in spans], "doc_id string, page int, item_idx int, start int, end int")
    pages = spark.createDataFrame([("d", 0, "BSB: 062-000\nBSB: 062-000 $5\nNet Pay: $5")], "doc_id string, page int, text string")
    written = []
    monkeypatch.setattr(G, "cut", lambda df: written.append(df) or df)
    sensitive = G.sensitive_boxes(with_text_fields(with_hits(pages), hits=hit_columns()), word_table, pages.selectExpr("doc_id", "page", "100.0D AS width", "100.0D AS height"), hits=hit_columns())
    # nothing is written, no word is joined by itself, and no range is searched for words twice
    assert not written
    assert "Window" not in plan(sensitive) and plan(sensitive).count("collect_list") == 2
    assert not [x for x in plan(sensitive).splitlines() if "Filter" in x and "transform(" in x]
    boxed = G.union_box(span_table, word_table)
    found = {(x.page, x.item_idx): (x.x1, x.y1, x.x2, x.y2) for x in boxed.collect()}
    want = _box_around(rows, spans)
    assert len(want) > 150 and found == want and boxed.count() == len(want)
