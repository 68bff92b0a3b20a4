import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docledger.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string, fault string, row long, conv string"


def cheapest(rows):
    """(cost, audit, lines) by whole tables of whole strings. rows: (role, text, truncated, must go)."""
    far = (10**9, "", ())
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}

    def inserts(table):
        for _ in range(4):
            for q in range(4):
                c, a, r = table[q]
                table[step[q]] = min(table[step[q]], (c + 5, a + "I", (*r, names[step[q]] + ":")))
        return table

    table = [(0, "", ()), far, far, far]
    for role, text, cut, gone in rows:
        table = inserts(table)
        new = [(c + 2, a + "D", r) for c, a, r in table]
        if not gone:
            more = 5 if cut else 0
            for q in range(4):
                c, a, r = table[q]
                t = step[q]
                new[t] = min(new[t], (c + 1 + more, a + "R", (*r, f"{names[t]}:{text}")))
                keep = 1 if role[:1] == "s" and q == 0 else t if role[:1] == names[t][0] else None
                if keep is not None:
                    new[keep] = min(new[keep], (c + more, a + "K", (*r, f"{role}:{text}")))
        table = new
    table = inserts(table)
    return min(table[0], table[3])


def report(rows):
    """Of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults, coded = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        ink = re.findall(structure.BLANK, text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        coded.append((role, text, fault == "truncated", fault in ("blank", "duplicate")))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = cheapest(coded)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def compare(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)
    found = {r.conv_id: tuple(r)[1:] for r in structure.repair(frame, **options).collect()}
    expected = {c: report([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert found == expected


def random_rows(conv, n, r):
    return [
        (conv, r.choice([None, *range(n)]), r.choice(["user", "assistant", "system", "tool", "user", "assistant", None, "", "écho"]), r.choice(["Hi.", "Why?", "no end", "", " \t", None, f"t{r.randint(0, n)}.", f"u{r.randint(0, n)}"]))
        for _ in range(n)
    ]


def test_division_equals_whole_tables():
    r = random.Random(5)
    for n in [1, 2, 3, 7, 16, 33, 60]:
        codes = [np.array([r.randrange(9) for _ in range(n)] + [structure.END]) for _ in range(20)]
        sizes = np.array([len(c) for c in codes])
        last = np.cumsum(sizes)
        joined = np.concatenate(codes)
        nothing = np.zeros(len(codes), dtype=np.int64)
        states = structure.divide(joined, last - sizes, last, nothing, nothing)
        for c, a, b in zip(codes, last - sizes, last):
            path = [*states[a:b].tolist(), 0]
            steps = list(zip(c, path, path[1:]))
            cost, audit, _ = cheapest([("suax"[k % 4], "", 4 <= k < 8, k == 8) for k in c[:-1].tolist()])
            assert sum(structure.COST[s] for s in steps) == cost
            assert "".join(structure.LETTERS[k][p][q] for k, p, q in steps) == audit


def test_small_conversations(spark):
    r = random.Random(1)
    rows = [x for conv in [*range(150), None] for x in random_rows(conv, r.randint(1, 9), r)]
    compare(spark, rows)


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_conversations_over_blocks_and_tasks(spark, block_rows):
    """A conversation of most rows spans all tasks, and is settled from its blocks' tables."""
    r = random.Random(2)
    rows = [x for conv in range(20) for x in random_rows(conv, r.randint(1, 40), r)] + random_rows(30, 400, r) + random_rows(None, 60, r)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(spark, rows, block_rows=block_rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repeated_rows_long_texts_and_empty(spark):
    rows = [(1, 0, "user", "Same.")] * 30 + [(1, 1, "assistant", "x " * 200_000 + "."), (2, None, "user", "")]
    compare(spark, rows)
    assert structure.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_damage_follows_the_rule(spark):
    rows = [(c, t, "assistant", f"a. b! {c}?") for c in range(30) for t in [None, *range(6)]] + [(None, 3, None, None)]
    found = sorted(structure.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).drop("copy").collect(), key=str)
    expected = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        expected += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
