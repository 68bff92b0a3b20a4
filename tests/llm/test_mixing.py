import collections

import corpus_pipeline
import pytest
from cases import FOLDER, docs, empty
from compare import compare, connect
from pyspark.sql import functions as F

from docledger.llm import mixing, queries


def test_query_and_its_sql(spark):
    text, ok = compare(spark, connect(FOLDER), FOLDER, "op8", queries.op8_mixing, queries.ORACLES["op8_mixing"])
    assert ok, text


def earliest_deadline(shares: list[tuple[str, int]]) -> list[tuple[str, int]]:
    q, done, out = sum(a for _, a in shares), dict.fromkeys([s for s, _ in shares], 0), []
    for t in range(q):
        ready = [(-(-(done[s] + 1) * q // a), i, s) for i, (s, a) in enumerate(shares) if done[s] * q // a <= t]
        s = min(ready)[2]
        out.append((s, done[s]))
        done[s] += 1
    return out


@pytest.mark.parametrize("shares", [[("a", 1)], [("a", 3), ("b", 2), ("c", 1)], [("a", 97), ("b", 2), ("c", 41), ("d", 7), ("e", 1)]])
def test_period_deviates_by_less_than_a_block(spark, shares):
    rows = mixing.period(spark.createDataFrame(shares, "source string, share long")).orderBy("at").collect()
    assert [(r.source, r.k) for r in rows] == earliest_deadline(shares)
    q, seen = sum(a for _, a in shares), collections.Counter()
    for t, r in enumerate(rows, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * a / q) < 1 for s, a in shares)


def test_hot_source_is_numbered_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_BUCKET_ROWS", 20)
    table = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = collections.defaultdict(list)
    for r in mixing.ranked(table, 700).collect():
        got[r.source].append(r["__rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got["big"]) == 234


def test_mixture_stops_at_the_first_gap(spark):
    table = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 800, "big").otherwise("small").alias("source"))
    shares = spark.createDataFrame([("big", 1), ("small", 1)], "source string, share long")
    rows = mixing.mixture(table, shares, block=10).collect()
    assert collections.Counter(r.source for r in rows) == {"big": 210, "small": 200}
    # training order: blocks of ten take turns
    names = [r.source for r in rows]
    assert all(len(set(names[i : i + 10])) == 1 for i in range(0, len(names), 10)) and names[0] != names[10]


def test_awkward_rows(spark):
    shares = mixing.tempered_shares(docs(spark))
    placed = mixing.schedule(docs(spark), shares, block=2)
    assert placed.count() == 15 and placed.filter("source is null").count() == 4
    assert mixing.mixture(docs(spark), shares, block=1).columns == docs(spark).columns
    none = mixing.tempered_shares(empty(spark))
    assert mixing.schedule(empty(spark), none).collect() == [] and mixing.mixture(empty(spark), none).collect() == []
    given = {r.source: r.share for r in mixing.tempered_shares(docs(spark), weights={"s0": 5.0, "s1": 5.0}).collect()}
    assert given["s0"] == given["s1"]
    with pytest.raises(ValueError):
        mixing.tempered_shares(docs(spark), weights={"s0": 0})


def test_stage_keeps_every_row(spark):
    """One source has one row, one is null, one holds nearly all."""
    name = F.when(F.col("id") == 7, "rare").when(F.col("id") == 8, None).when(F.col("id") < 400, F.concat(F.lit("s"), F.col("id") % 3)).otherwise("hot")
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), name.alias("source"))
    rows = corpus_pipeline.mix_sources(spark, table, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == list(range(20_000))
    # training order: before the first source ends all sources take turns, the hot one goes on alone
    assert len({r.source for r in rows[:2000]}) > 2 and {r.source for r in rows[-1000:]} == {"hot"}
