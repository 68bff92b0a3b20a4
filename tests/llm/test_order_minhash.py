import collections
import hashlib
import re

import pytest
from cases import FOLDER, docs, empty
from pyspark.sql import functions as F

from docledger.llm import order_minhash, queries


def spark_hash(spark, *columns):
    """xxhash64 of rows of longs or texts, from Spark itself."""
    rows = list(zip(*columns))
    kinds = ", ".join(f"c{i} {'string' if isinstance(x, str) else 'long'}" for i, x in enumerate(rows[0]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + kinds)
    return [r.h for r in df.select("i", F.xxhash64(*[f"c{i}" for i in range(len(rows[0]))]).alias("h")).orderBy("i").collect()]


def brute(spark, text, k=2, slots=32, take=2):
    words = [w for w in re.split(r"[\x09-\x0D\x20]+", text) if w]
    if not words:
        return [0] * slots
    h = spark_hash(spark, words)
    n = max(len(h) - k + 1, 1)
    grams = [tuple(h[i : i + k]) for i in range(n)]
    if len(h) < k:
        grams = [tuple(h + [None] * (k - len(h)))]
        df = spark.createDataFrame([(h[0], None)], "a long, b long")
        g = [df.select(F.xxhash64("a", "b")).first()[0]]
    else:
        g = spark_hash(spark, *zip(*grams))
    seen, occurrence = collections.Counter(), []
    for x in g:
        occurrence.append(seen[x])
        seen[x] += 1
    df = spark.createDataFrame([(i, x, o) for i, (x, o) in enumerate(zip(g, occurrence))], "i int, x long, o int")
    full = {r.i: r.h % 2**64 for r in df.select("i", F.xxhash64("x", "o").alias("h")).collect()}
    tuples = []
    for j in range(slots):
        moved = sorted((((full[i] >> 30 << 30) | i) ^ (j << 59), i) for i in full)
        chosen = sorted(i for _, i in moved[:take])
        tuples.append([(full[i] - 2**64 if full[i] >> 63 else full[i]) >> 30 for i in chosen])
    df = spark.createDataFrame([(j, t) for j, t in enumerate(tuples)], "j int, t array<long>")
    return [r.h for r in df.select("j", F.xxhash64("t").alias("h")).orderBy("j").collect()]


@pytest.mark.parametrize("text", ["", "one", "a b", " the the the cat the cat\tthe the ", "w" + " ".join(f"w{i % 37}" for i in range(300))])
def test_signature_is_the_definition(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(order_minhash.signature(F.col("text")).alias("s")).first().s
    assert got == brute(spark, text)


@pytest.mark.parametrize("before", ["", "w191316 and more words than two "])
def test_occurrences_of_grams_with_equal_leading_bits(spark, before):
    """The hashes of these two words agree in their leading 34 bits."""
    text = before + "w181519 w191316 w181519 w191316 w191316"
    a, b = spark_hash(spark, ["w181519", "w191316"])
    pair = spark_hash(spark, [a, b])
    assert pair[0] >> 30 == pair[1] >> 30 and pair[0] != pair[1]
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(order_minhash.signature(F.col("text"), k=1).alias("s")).first().s == brute(spark, text, k=1)


def test_order_matters_and_distance_shows(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[:-5]), " ".join(words[100:] + words[:100]), " ".join(reversed(words)), " ".join(f"v{i}" for i in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("s", order_minhash.signature(F.col("text"), k=1, slots=256))
    sig = {r.i: r.s for r in df.collect()}
    near = [sum(a == b for a, b in zip(sig[0], sig[i])) / 256 for i in range(5)]
    assert near[0] == 1 > near[1] > near[2] > near[3] >= near[4] == 0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(order):
        follow = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        third = len(t) // 3
        out[d] = (len(t), hashlib.sha256((t[: len(t) - third] + follow[:third]).encode()).hexdigest())
    return out


def test_query_and_edited_texts(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = queries.op6_order_minhash(spark, FOLDER).collect()
    want = expected(table)
    assert len(rows) == 200 and all(want[r.doc_id] == (r.n_chars, r.edited_sha256) for r in rows)
    same = collections.defaultdict(set)
    for r in rows:
        same[dict(table)[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert sum(r.near_edited for r in rows) / 200 > 0.2 > 0.02 > sum(r.near_next for r in rows) / 200


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_next_rows_across_blocks(spark, size):
    ids = [5, -3, 900, 10**15, 7, 8, 2, 3, 44, -(10**12)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in order_minhash.with_next(df, ["text"], size).collect()}
    down = sorted(ids, reverse=True)
    assert got == {d: f"t{down[(i + 1) % len(down)]}" for i, d in enumerate(down)}


def test_awkward_rows(spark):
    rows = order_minhash.compare_edits(docs(spark)).collect()
    assert len(rows) == 15 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    want = expected([(r.doc_id, r.text) for r in docs(spark).dropDuplicates(["doc_id"]).collect()])
    assert all(want[r.doc_id] == (r.n_chars, r.edited_sha256) for r in rows if r.doc_id not in (1, 2))
    one = order_minhash.compare_edits(docs(spark).filter("doc_id = 8")).collect()
    assert [(r.near_edited, r.near_next) for r in one] == [(1.0, 1.0)]
    assert order_minhash.compare_edits(docs(spark).filter("doc_id is null")).count() == 1
    assert order_minhash.compare_edits(empty(spark)).collect() == []
