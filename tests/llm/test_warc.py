import base64
import hashlib
import random

import pytest
from cases import FOLDER
from compare import compare, connect
from pyspark.sql import functions as F

from docledger.llm import queries, warc
from docledger.session import scratch_path

SCHEMA = "page_id long, url string, html string, archive string, run int"


def test_query_and_its_sql(spark):
    text, ok = compare(spark, connect(FOLDER), FOLDER, "op7", queries.op7_warc, queries.ORACLES["op7_warc"])
    assert ok, text


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(runs):
    r = random.Random(runs)
    lists = [sorted((r.randint(0, 30), r.randint(0, 3)) for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(runs)]
    out = list(warc.LoserTree(lists))
    assert [x for _, _, x in out] == sorted(x for part in lists for x in part)
    assert all(lists[run][at] == x for run, at, x in out)


def pages(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [
        (1, "http://A.Example.com", "same"), (2, "https://b.example.com/x?y#z", "same"), (2, "https://b.example.com/x?y#z", "same"),
        (3, None, None), (4, "", ""), (5, "http://a.example.com/\r\nWARC-Type: x", tricky), (None, "http://a.example.com/", "same"),
        (None, "http://n.org", "only without id"), (6, "http://long.org", "é\n" * 300_000), (7, "http://a.example.com/?q=1", "\r\n\r\n"),
    ]
    return spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA)


def test_awkward_pages_come_back_byte_for_byte(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark), folder)
    got = warc.read_archives(spark, folder, payload=True).collect()
    given = [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]
    assert len(got) == len(given)
    largest = {}
    for d, b in given:
        largest[b] = max(largest.get(b, -1), -1 if d is None else d)
    size = {}
    for r in got:
        size.setdefault((r.page_id, r.payload_digest), []).append(r)
    for d, b in given:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        for r in size[d, digest]:
            assert r.payload_bytes == len(b)
            first = largest[b] == (-1 if d is None else d)
            assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", largest[b]))
            assert r.payload == (b if first else None)
    urls = {r.page_id: r.url for r in got}
    assert urls[5] == "http://a.example.com/%0D%0AWARC-Type: x" and urls[3] is None and urls[4] == ""


def test_small_payloads_may_all_be_responses(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark), folder, min_bytes=5)
    kinds = {(r.page_id, r.record_type) for r in warc.read_archives(spark, folder).filter("payload_bytes = 4").collect()}
    assert kinds == {(1, "response"), (2, "response"), (7, "response"), (None, "response")}


def test_index_is_in_global_order_and_numbers_histories(spark):
    many = spark.range(3000).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, F.lit("http://hot.org/a")).otherwise(F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".org/"))).alias("url"),
        F.col("id").cast("string").alias("html"),
    )
    folder = scratch_path(spark, "warc-test")
    warc.write_archives(many.repartition(6), folder)
    rows = warc.capture_index(warc.read_archives(spark, folder)).collect()
    history = {}
    for r in sorted(rows, key=lambda r: (r.url_key, r.captured_at, r.page_id)):
        history.setdefault(r.url_key, []).append(r)
    assert all([r.capture_no for r in h] == list(range(1, len(h) + 1)) for h in history.values())
    assert len(rows) == 3000 and len(history["org,hot)/a"]) == 1000


def test_empty_table(spark):
    assert warc.archived(pages(spark).filter("false")).collect() == []
