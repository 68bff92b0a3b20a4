import itertools

import numpy as np
from cases import FOLDER, prose
from compare import compare, connect
from pyspark.sql import functions as F

from docledger.llm import chat, queries


def test_query_and_its_sql(spark):
    text, ok = compare(spark, connect(FOLDER), FOLDER, "op4", queries.op4_chat, queries.ORACLES["op4_chat"])
    assert ok, text


def model(seed=0):
    rng = np.random.default_rng(seed)
    shows = {name: rng.integers(0, 50, (chat.STATES, size)).astype(float) for name, size in chat.FEATURES.items()}
    return chat.Model(rng.integers(0, 50, (chat.STATES + 1, chat.STATES)).astype(float), shows)


def test_path_is_the_best_of_all_paths(monkeypatch):
    m, rng = model(), np.random.default_rng(1)
    shown = rng.integers(-3000, 0, (4, chat.STATES))

    def value(path, before=chat.START):
        return sum(m.moves[b][s] + e[s] for b, s, e in zip((before, *path[:-1]), path, shown))

    best = max(value(p) for p in itertools.product(range(chat.STATES), repeat=4))
    assert value(m.path(shown, chat.START, None)) == best
    ended = max(value(p, 2) for p in itertools.product(range(chat.STATES), repeat=4) if p[-1] == 5)
    assert value(m.path(shown, 2, 5), 2) == ended == m.summary(shown)[2, 5]


def test_parts_give_the_path_of_the_whole():
    m, rng = model(3), np.random.default_rng(2)
    shown = rng.integers(-4000, 0, (90, chat.STATES))
    whole = m.path(shown, chat.START, None)
    for cuts in ([10], [1, 2, 3], [30, 31, 80], [89]):
        parts = np.split(shown, cuts)
        ends = chat.borders([m.summary(p) for p in parts])
        got = np.concatenate([m.path(p, before, last) for p, (before, last) in zip(parts, ends)])
        assert np.array_equal(got, whole)


def conversations(spark):
    rows = []
    for c in range(24):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * (1 + c % 4)
        for t, role in enumerate(roles):
            rows.append((c, t, role, "\n".join(prose(1000 * c + 10 * t + i, 3 + (30 if role == "assistant" else 5)) for i in range(1 + t % 3))))
    # one conversation of very many turns
    rows += [(99, t, ("user", "assistant")[t % 2], prose(50_000 + t, 4)) for t in range(600)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def recovered(spark, table, parts=None):
    lines = chat.transcribe(table).select("conv_id", "turn", "at", "line")
    if parts:
        lines = lines.repartition(parts)
    found = chat.turns(lines, chat.train_on(table), ["turn", "at"])
    return sorted((r.conv_id, r.turn_no, r.role, r.text) for r in found.collect())


def test_long_conversation_is_spread_and_recovered(spark):
    table = conversations(spark)
    want = sorted((r.conv_id, r.turn, r.role, r.text) for r in table.collect())
    assert recovered(spark, table) == want
    model_ = chat.train_on(table)
    lines = chat.transcribe(table).select("conv_id", "turn", "at", "line")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # small ranges: conversations span several
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = chat.turns(lines, model_, ["turn", "at"])
        assert sorted((r.conv_id, r.turn_no, r.role, r.text) for r in found.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_markers_and_rendering(spark):
    cases = [("User: hi", 2, "hi"), ("### Human: hi", 2, "hi"), ("<|assistant|>x", 3, "x"), ("[system] be kind", 1, "be kind"), ("**AI**:", 3, ""), ("A: b", 3, "b"), ("users: no", 0, "users: no"), ("q", 0, "q"), (" User: x", 0, " User: x")]
    df = chat.features(spark.createDataFrame([(i, x[0]) for i, x in enumerate(cases)], "i int, line string"))
    rows = df.withColumn("bare", chat.without_marker(F.col("line"))).orderBy("i").collect()
    assert [(r.line, r.marker, r.bare) for r in rows] == cases
    assert spark.range(1).select(chat.render(F.lit("user"), F.lit("a\nb")).alias("x")).first().x == "<|user|>\na\nb<|end|>\n"


def test_awkward_lines(spark):
    table = conversations(spark)
    m = chat.train_on(table)
    kind = "conv_id long, at long, line string, state string, marker string"
    rows = [(None, 0, "User: hello"), (None, 1, None), (None, 2, "Assistant: yes"), (7, None, "User: a"), (7, 1, ""), (8, 0, ""), (8, 1, "Q: x"), (8, 1, "Q: x"), (9, 0, "User: " + prose(5, 50_000)), (9, 1, "")]
    lines = spark.createDataFrame([(*r, "s", "m") for r in rows], kind).drop("state", "marker")
    got = sorted(((r.conv_id, r.turn_no, r.role, r.text) for r in chat.turns(lines, m, ["at"]).collect()), key=str)
    assert (None, 0, "user", "hello") in got and (None, 1, "assistant", "yes") in got
    assert (7, 0, "user", "a") in got and (9, 0, "user", prose(5, 50_000)) in got
    assert all(r[2] == "user" for r in got if r[0] == 8)
    assert chat.turns(lines.filter("false"), m, ["at"]).collect() == []
    assert chat.turns(lines.filter("false"), chat.train_on(table.filter("false")), ["at"]).collect() == []
