"""Conversation structure repair: the cheapest edits that give alternating turns.

Repaired roles are nothing, or pairs of user and assistant after at most one system turn. Going
through the rows, a prefix is in one of four states: nothing yet, after the system turn, after
a user turn, after an assistant turn. Keep costs 0, Rerole 1, Delete 2, Insert 5, and a
truncated row that stays 5 more. Each state allows one next role only, so the letters of the
edits name the repair.

Edits are found by Hirschberg's division: over the first half costs run forward from the known
state before, over the second half backward from the known state after; where their
sum is least the two meet, and both halves go on alone. Only four costs are held at a time.
Of equal crossings the one with the ASCII-least letters is taken: forward costs carry the order of
the four states' least letters, which are never prefixes of one another, as each ends with the
edit of a row. All parts of all conversations of a batch are divided side by side.

Rows are range-partitioned by conversation and order and packed into blocks. Of a conversation
with several blocks each gives its table of four by four costs and orders; the tables settle
the states between blocks by the same rule, and every block is divided alone. Nothing but the
results (letters, digest) of one conversation comes together, and those as one row for each block.

Nulls and blanks: null roles and texts become one space; a null conversation id is a
conversation; null turns come first. Rows of equal turns stand by role, the first 32 characters
of the text, and a digest of it; equal rows are kept, and all but the first are duplicates. An
empty role, like any other that opens with none of s, u, a, has to be changed or deleted. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import digests, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES = 4  # nothing, system, user, assistant
_NEVER = 1 << 40
_ROLES = ("user", "assistant")
#: Rows and characters of a block.
_BLOCK_ROWS = 65_536
_BLOCK_CHARS = 4 << 20

BLANK = r"[^\x20\x09-\x0D]"  # what a blank text lacks
NOTHING = hashlib.sha256(b"").hexdigest()
_FORCED = 8  # the code of a row that must go; others are 4 * truncated + initial


def _next(state: int) -> int:
    """Where a user or assistant turn leads: after a user turn to the assistant's."""
    return 3 if state == 2 else 2


def _edits() -> tuple[np.ndarray, list[list[list[str]]], np.ndarray]:
    """By code, state before and state after: least cost, its ASCII-least letters, and the
    letters' place among all letters in order. Code 9 is the end, reached from states 0 and 3."""
    cost = np.full((10, STATES, STATES), _NEVER, dtype=np.int64)
    best = [[["" for _ in range(STATES)] for _ in range(STATES)] for _ in range(10)]
    for code in range(10):
        for before in range(STATES):
            found: dict[int, tuple[int, str]] = {}
            state, paid, letters = before, 0, ""
            for _ in range(STATES):  # more inserts would only come round
                ends = []
                if code == 9:
                    ends = [(0, paid, letters)] if state in (0, 3) else []
                else:
                    ends.append((state, paid + DELETE, letters + "D"))
                    if code != _FORCED:
                        more = TRUNCATED if code >= 4 else 0
                        initial = code % 4  # s, u, a, other
                        if initial < 3 and ((initial == 0 and state == 0) or (initial > 0 and initial + 1 == _next(state))):
                            ends.append((initial + 1, paid + KEEP + more, letters + "K"))
                        ends.append((_next(state), paid + REROLE + more, letters + "R"))
                for after, c, w in ends:
                    if after not in found or (c, w) < found[after]:
                        found[after] = (c, w)
                state, paid, letters = _next(state), paid + INSERT, letters + "I"
            for after, (c, w) in found.items():
                cost[code, before, after] = c
                best[code][before][after] = w
    places = {w: i for i, w in enumerate(sorted({w for a in best for b in a for w in b}))}
    order = np.array([[[places[w] for w in b] for b in a] for a in best], dtype=np.int64)
    return cost, best, order


COST, LETTERS, ORDER = _edits()
END = 9
_STEP = (COST << 16) + ORDER  # one number: cost, then letters in order
_LETTER_TABLE = np.array(LETTERS, dtype=object)


def _start(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and orders before the first row, by state, when it is known."""
    cost = np.full((len(states), STATES), _NEVER, dtype=np.int64)
    cost[np.arange(len(states)), states] = 0
    return cost, np.zeros((len(states), STATES), dtype=np.int64)


def _forward(cost: np.ndarray, order: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row further. ``step`` holds (cost, place of letters) by state before and after; of equal
    costs the state before with the lesser letters wins, then the row's own letters."""
    sums = (cost[:, :, None] << 16) + (order[:, :, None] << 8) + step
    least = sums.min(axis=1)
    low = least & 0xFFFF
    return np.minimum(least >> 16, _NEVER), (low[:, None, :] < low[:, :, None]).sum(axis=2)


def _backward(cost: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.minimum((cost[:, None, :] + step).min(axis=2), _NEVER)


def _crossing(forward: np.ndarray, order: np.ndarray, backward: np.ndarray) -> np.ndarray:
    return (((forward + backward) << 8) + order).argmin(axis=1)


def divide(codes: np.ndarray, first: np.ndarray, last: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For rows [first, last) of ``codes`` in parts with known states around: the state before
    each row. Parts of a level are halved together."""
    states = np.zeros(len(codes), dtype=np.int64)
    while len(first):
        single = last - first == 1
        states[first[single]] = before[single]
        many = last - first > 1
        first, last, before, after = first[many], last[many], before[many], after[many]
        if not len(first):
            break
        half = (first + last) // 2
        # forward over [first, half), backward over [half, last): the longest parts first
        cost, order = _start(before)
        left = np.argsort(first - half, kind="stable")
        size = (half - first)[left]
        for k in range(int(size[0])):
            n = int(np.searchsorted(-size, -k, side="left"))
            at = left[:n]
            cost[at], order[at] = _forward(cost[at], order[at], _STEP[codes[first[at] + k]])
        back, _ = _start(after)
        right = np.argsort(half - last, kind="stable")
        size = (last - half)[right]
        for k in range(int(size[0])):
            n = int(np.searchsorted(-size, -k, side="left"))
            at = right[:n]
            back[at] = _backward(back[at], COST[codes[last[at] - 1 - k]])
        met = _crossing(cost, order, back)
        first, last = np.concatenate([first, half]), np.concatenate([half, last])
        before, after = np.concatenate([before, met]), np.concatenate([met, after])
    return states


def summary(codes: np.ndarray) -> np.ndarray:
    """Costs and orders from every state before to every state after the rows: 2 x 4 x 4."""
    cost, order = _start(np.arange(STATES))
    for code in codes:
        cost, order = _forward(cost, order, _STEP[code][None])
    return np.stack([cost, order])


def settle(tables: list[np.ndarray]) -> list[int]:
    """The states before each block of a conversation and at its end, from the blocks' tables.

    The same division, over blocks: ``tables`` are the steps, and the end is one more."""
    steps = [(t[0] << 16) + t[1] for t in tables] + [_STEP[END]]
    states = [0] * (len(steps) + 1)
    todo = [(0, len(steps), 0, 0)]
    while todo:
        first, last, before, after = todo.pop()
        states[first] = before
        if last - first == 1:
            continue
        half = (first + last) // 2
        cost, order = _start(np.array([before]))
        for k in range(first, half):
            cost, order = _forward(cost, order, steps[k][None])
        back, _ = _start(np.array([after]))
        for k in range(last - 1, half - 1, -1):
            back = _backward(back, steps[k][None] >> 16)
        met = int(_crossing(cost, order, back)[0])
        todo += [(first, half, before, met), (half, last, met, after)]
    return states[: len(steps)]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with known faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row,
    1 empties its text, 2 takes out its stops, 3 repeats it, 4 gives it to the user."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
        .filter("kind <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text without nulls) with ``fault``: blank, duplicate, truncated or none,
    ``row`` (a number of its own), ``head`` and ``digest`` of the text."""
    named = rows.select("conv_id", "turn", "role", "text").withColumns(
        {
            "row": F.monotonically_increasing_id(),
            "head": F.substring("text", 1, 32),
            "digest": F.md5(F.col("text").cast("binary")),
            "blank": ~F.col("text").rlike(BLANK),
        }
    )
    # the rows' numbers must not change between uses
    held = cut(named)
    first = (
        held.filter(~F.col("blank")).groupBy("conv_id", "role", "digest")
        .agg(F.min(F.struct("turn", "head", "row"))["row"].alias("row")).select("row", F.lit(True).alias("first"))
    )
    stops = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
        .when(~F.substring(stops, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none")
    )
    return held.join(first, "row", "left").withColumn("fault", fault).drop("first", "blank")


def _code() -> Column:
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1))
    place = F.when(initial == 0, 3).otherwise(initial - 1)
    return F.when(F.col("fault").isin("blank", "duplicate"), _FORCED).otherwise(place + F.when(F.col("fault") == "truncated", 4).otherwise(0))


_BLOCKS = (
    "conv long, conv_null boolean, part int, block int, edge boolean, codes binary, initials binary, "
    "roles array<string>, texts array<string>, n_table array<long>"
)


def _pack(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks: rows of one conversation, up to a bound. A conversation that may go on in
    another block or task is an edge and brings its table."""
    out: list[tuple] = []
    held: list = []  # the open block
    key = part = None
    number = chars = 0
    opening = True  # the partition's first conversation

    def close(more: bool, edge: bool) -> tuple:
        codes = np.array([h[0] for h in held], dtype=np.uint8)
        table = summary(codes).reshape(-1).tolist() if edge else None
        return (
            key or 0, key is None, part, number, edge, codes.tobytes(), bytes(h[1] for h in held), [h[2] for h in held], [h[3] for h in held], table,
        )

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    size = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "code", "initial", "role", "text")]
        for conv, p, code, initial, role, text in zip(*columns):
            new = bool(held) and conv != key
            full = bool(held) and not new and (len(held) >= block_rows or chars >= _BLOCK_CHARS)
            if new or full:
                out.append(close(full, opening or full or number > 0))
                size += chars + 64 * len(held)
                opening = opening and not new
                number = 0 if new else number + 1
                held, chars = [], 0
                if size > _BLOCK_CHARS:
                    yield sent(out)
                    out, size = [], 0
            key, part = conv, p
            held.append((code, initial, role, text))
            chars += len(role) + len(text)
    if held:
        out.append(close(False, True))
    if out:
        yield sent(out)


_SOLVED = (
    "conv long, conv_null boolean, part int, block int, audit string, cost long, illegal long, edge_initials binary, "
    "repaired binary, sha256 string"
)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their states around: letters and cost of each. ``after`` of -1 is the conversation's
    end, whose inserts belong to its last block. A block that is a whole conversation is digested
    here; of others the repaired rows are handed on."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        got = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        ends = np.array(got["after"], dtype=np.int64)
        pieces = [np.frombuffer(c + (b"\x09" if e < 0 else b""), dtype=np.uint8) for c, e in zip(got["codes"], ends.tolist())]
        codes = np.concatenate(pieces).astype(np.int64)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        last = np.cumsum(sizes)
        first = last - sizes
        before = np.array(got["before"], dtype=np.int64)
        after = np.where(ends < 0, 0, ends)
        states = divide(codes, first, last, before, after)
        following = np.empty_like(states)
        following[:-1] = states[1:]
        following[last - 1] = after
        costs = np.concatenate([[0], np.cumsum(COST[codes, states, following])])
        letters = _LETTER_TABLE[codes, states, following].tolist()
        audits, repaired, illegal, sums = [], [], [], []
        for i in range(n):
            a, b = int(first[i]), int(last[i])
            audits.append("".join(letters[a:b]))
            lines = _repaired(letters[a:b], int(before[i]), got["roles"][i], got["texts"][i])
            repaired.append(lines if got["edge"][i] else None)
            sums.append(None if got["edge"][i] else hashlib.sha256(lines or b"").hexdigest())
            illegal.append(_illegal(got["initials"][i]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv"), batch.column("conv_null"), batch.column("part"), batch.column("block"),
                pa.array(audits), pa.array(costs[last] - costs[first]), pa.array(illegal, pa.int64()),
                pa.array([x[:1] + x[-1:] for x in got["initials"]], pa.binary()), pa.array(repaired, pa.binary()),
                pa.array(sums, pa.string()),
            ],
            names=[c.split()[0] for c in _SOLVED.split(", ")],
        )


_LEGAL = {b"su", b"ua", b"au"}


def _illegal(initials: bytes) -> int:
    return sum(initials[k : k + 2] not in _LEGAL for k in range(len(initials) - 1))


def _repaired(letters: list[str], state: int, roles: list[str], texts: list[str]) -> bytes | None:
    """The rows that remain, ``role:text`` in lines; None if there is none."""
    lines = []
    for k, word in enumerate(letters):
        for letter in word:
            if letter == "I":
                state = _next(state)
                lines.append(_ROLES[state - 2] + ":")
            elif letter == "R":
                state = _next(state)
                lines.append(f"{_ROLES[state - 2]}:{texts[k]}")
            elif letter == "K":
                state = 1 if roles[k][:1] == "s" else _next(state)
                lines.append(f"{roles[k]}:{texts[k]}")
    return "\n".join(lines).encode() if lines else None


def repair(rows: DataFrame, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """Of ``rows`` (conv_id, turn, role, text) one row for each conversation: (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256). Results do not depend on ``block_rows``."""
    spaced = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    known = cut(with_faults(spaced))
    counts = known.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    # a conversation's turns are counted once each
    turns = known.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("*").alias("turns"))

    solved = cut(blocks_repaired(known, block_rows))
    group = ["conv", "conv_null"]
    # blocks of a conversation, in order: letters are joined, and pairs of rows that meet there counted
    order = F.struct("part", "block", "audit", "edge_initials")
    ends = F.expr(
        "aggregate(sequence(1, greatest(1, size(x) - 1)), 0L, (n, k) -> n + IF(size(x) > 1 AND NOT "
        "concat(right(decode(get(x, k - 1).edge_initials, 'ISO-8859-1'), 1), left(decode(get(x, k).edge_initials, 'ISO-8859-1'), 1)) IN ('su', 'ua', 'au'), 1L, 0L))"
    )
    whole = (
        solved.groupBy(*group).agg(F.sort_array(F.collect_list(order)).alias("x"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.max("sha256").alias("own"))
        .withColumns({"audit": F.array_join(F.transform("x", lambda b: b["audit"]), ""), "illegal": F.col("illegal") + ends})
    )
    left = solved.filter(F.col("repaired").isNotNull()).select(*group, "part", "block", F.col("repaired").alias("piece"))
    sums = digests(left, group, ["part", "block"], b"\n")
    conv = F.when(~F.col("conv_null"), F.col("conv")).alias("conv_id")
    results = whole.join(sums, group, "left").select(conv, "illegal", "cost", "audit", F.coalesce("own", "sha256", F.lit(NOTHING)).alias("repaired_sha256"))
    same = lambda a, b: a.conv_id.eqNullSafe(b.conv_id)
    counted = counts.join(turns.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    counted = counted.withColumn("gaps", F.col("span") - F.coalesce("turns", F.lit(0))).drop("span", "turns")
    return counted.join(results, same(counted, results)).select(
        counted.conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def blocks_repaired(known: DataFrame, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """The blocks of all conversations with letters, cost and repaired rows."""
    order = ["conv_id", "turn", "role", "head", "digest", "row"]
    initial = F.ascii(F.substring("role", 1, 1))
    coded = known.withColumns({"code": _code().cast("int"), "initial": F.when(initial.between(1, 127), initial).otherwise(32).cast("int")})
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    packed = cut(small_batches(dealt.select("conv_id", "part", "code", "initial", "role", "text")).mapInArrow(lambda batches: _pack(batches, block_rows), _BLOCKS))
    key = ["conv", "conv_null", "part", "block"]

    def settled(frame):
        frame = frame.sort_values(["part", "block"])
        states = settle([np.array(t, dtype=np.int64).reshape(2, STATES, STATES) for t in frame["n_table"]])
        return frame.assign(before=states[:-1], after=[*states[1:-1], -1])[["number", "before", "after"]]

    # one row for each block at the edge of a task or of a very long conversation
    edges = packed.filter("edge").select("conv", "conv_null", "part", "block", "n_table", F.xxhash64(*key).alias("number"))
    borders = edges.groupBy("conv", "conv_null").applyInPandas(settled, "number long, before int, after int")
    asked = packed.withColumn("number", F.when(F.col("edge"), F.xxhash64(*key))).join(borders, "number", "left")
    asked = asked.withColumns({"before": F.coalesce("before", F.lit(0)), "after": F.coalesce("after", F.lit(-1))})
    return small_batches(asked.select(*key, "edge", "codes", "initials", "roles", "texts", "before", "after")).mapInArrow(_solve, _SOLVED)
