import hashlib
import random
import re
import zlib

import pytest

from docledger.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, block long, depth long, words long, id string, part int"


def trie(rows):
    """Nodes from whole prefixes."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    lists = {}
    for c, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:32], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        lists[c] = [t[1:] for t in turns]
    built = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 4
        template = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(lists.get(template, [])[:h] + turns[h:])
    members: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children: dict = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, convs in members.items():
        words = len(re.findall(prefix_trie.WORDS, path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * words
    return {
        (
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children.get(path, [])), leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(convs) if built[c] == path).encode()).hexdigest(),
        )
        for path, convs in members.items()
    }


def compare(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], SCHEMA)
    found = prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.turns(frame), frame)).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == trie(rows)


def random_rows(r, convs, longest, few):
    rows = []
    for c in convs:
        for _ in range(r.randint(1, longest)):
            rows.append((c, r.choice([None, 0, 1, 2, 3]), r.choice(["user", "assistant", None, ""]), r.choice(["", None, "a b", "same words here", f"x {r.randint(0, few)}"])))
    return rows


def test_small_conversations(spark):
    r = random.Random(3)
    compare(spark, random_rows(r, [*range(0, 120), -5, -20, -21, 2**40, None], 5, 2))


def test_conversations_longer_than_a_block(spark, monkeypatch):
    """Shared beginnings over several blocks; running sums over runs of two blocks."""
    monkeypatch.setattr(prefix_trie, "_BLOCKS", 2)
    r = random.Random(4)
    long = [("user" if t % 2 else "assistant", f"turn {t}") for t in range(60)]
    rows = [(c, t, *long[t]) for c in range(40, 70) for t in range(r.choice([7, 8, 9, 16, 17, 24, 59]))]
    rows += [(c, t, "user", f"other {t}") for c in range(70, 75) for t in range(30)]
    compare(spark, rows)


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_one_conversation_and_one_node_hold_most(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        rows = [(7, t, "user", f"t {t % 3}") for t in range(300)] + [(c, 0, "user", "the same") for c in range(100, 300)] + [(7, 0, "user", "again")] * 40
        compare(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_turnless_conversations_long_texts_and_empty(spark):
    turnless = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    compare(spark, [(turnless, 0, "user", "gone"), (1000, 0, "user", "w " * 300_000), (1000, 0, "user", "w " * 300_000)])
    compare(spark, [])
