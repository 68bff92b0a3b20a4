"""The trie of conversation prefixes, by ROLLUP over positional columns of turn ids.

A turn's id is a digest of its role and text. Conversations are cut into blocks of eight turns, one
row each: the id of every position is a column, null beyond the conversation's end. A block is
keyed by the node that the turns before it lead to, so rows of one key share all of their earlier
turns. ``GROUP BY block, key, ROLLUP(t0, ..., t7)`` then aggregates all prefixes of all blocks
together, and ``grouping_id`` tells how many of a block's turns a row stands for. Blocks of a long
conversation do not wait for one another: a node's identity is its depth and the sums, over the
turns before, of four 32-bit hashes of position and turn, which running sums give for every block.

Sums over subtrees are sums over members too, so a second ROLLUP gives them: a conversation that
is the smallest of a node owns it, and with it all nodes below on its path; words of distinct nodes
are words of owned turns, and each childless node counts for its owner.

A conversation may hold most turns: turns are numbered in ranges of the order and sums are taken
over blocks of blocks. A node may hold most conversations: all its figures are combined before
they move; the ids that end there are strung together range by range and pass one digest as a stream.

Nulls and blanks: a null role or text is empty; rows without a conversation id belong to no
conversation and count nowhere; null turns come first. Rows of equal turns stand by role, the first
32 characters of the text, and its digest; repeated rows are turns of their own. An empty table has no
nodes. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import number_rows
from ..session import cut
from .common import digests, strung

#: Turns of a block: columns of the ROLLUP.
WIDTH = 8
#: Blocks whose running sums are taken in one window.
_BLOCKS = 4_096
_LANES = ("k0", "k1", "k2", "k3")
WORDS = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, words): the turns of every conversation, numbered from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), F.substring(text, 1, 32).alias("head"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("id"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["turn", "role", "head", "id", "tie"]
    dealt = rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    numbered = number_rows(cut(dealt), ["conv_id"], order, "pos", [F.col("part")])
    return numbered.select("conv_id", (F.col("pos") - 1).alias("pos"), "id", "words")


def rebuilt(own: DataFrame, conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """``own`` turns after a head taken from another conversation: c begins with the first h turns (or as
    many as there are) of c - c % ``every``, h being crc32(c) % ``heads``, and goes on with its own
    turns after its first h. (conv_id, length, pos, id, words); a conversation without a turn has one row
    without ``pos``. Every head is one of few: at most ``heads`` - 1 turns."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    named = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id").distinct().join(sizes, "conv_id", "left")
    given = (
        own.filter((F.col("conv_id") % every == 0) & (F.col("pos") < heads - 1))
        .groupBy(F.col("conv_id").alias("template"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("given"))
    )
    known = named.withColumns({"template": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(given, "template", "left")
    none = F.array().cast("array<struct<pos:bigint,id:binary,words:bigint>>")
    known = known.withColumn("head", F.slice(F.coalesce("given", none), 1, F.col("h")))
    known = cut(known.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.coalesce("n", F.lit(0)) - F.col("h"), F.lit(0))).alias("length")))
    first = known.select("conv_id", "length", F.explode_outer("head").alias("t"), "h").filter(F.col("t").isNotNull() | (F.col("length") == 0))
    first = first.select("conv_id", "length", "t.pos", "t.id", "t.words")
    rest = own.join(known.select("conv_id", "h", "length", F.size("head").alias("taken")), "conv_id").filter(F.col("pos") >= F.col("h"))
    return first.unionByName(rest.select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "words"))


def _hashes(pos: Column, turn: Column) -> list[Column]:
    """Four hashes of 32 bits of a turn at a position."""
    two = [F.xxhash64(F.lit(k), pos.cast("long"), turn) for k in (1, 2)]
    return [part for h in two for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def _running(blocks: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``blocks`` with ``b_<value>``: the sums of the blocks before in the same conversation."""
    wide = blocks.withColumn("wide", F.floor(F.col("block") / _BLOCKS))
    inner = W.partitionBy("conv_id", "wide").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("conv_id").orderBy("wide").rowsBetween(W.unboundedPreceding, -1)
    totals = wide.groupBy("conv_id", "wide").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    # only conversations of several such runs have anything before a run
    earlier = totals.select("conv_id", "wide", *[F.sum(f"t_{v}").over(outer).alias(f"e_{v}") for v in values]).filter("wide > 0")
    local = wide.withColumns({f"l_{v}": F.sum(v).over(inner) for v in values}).join(earlier, ["conv_id", "wide"], "left")
    zero = F.lit(0).cast("long")
    both = {f"b_{v}": F.coalesce(f"l_{v}", zero) + F.coalesce(f"e_{v}", zero) for v in values}
    return local.withColumns(both).drop("wide", *[f"{p}_{v}" for p in "le" for v in values])


def blocks(steps: DataFrame) -> DataFrame:
    """A row for each block of a conversation: (conv_id, length, block, key and words before, key and words of the
    block, t0, w0, ...)."""
    at = F.coalesce(F.col("pos"), F.lit(0).cast("long"))
    slot = at % WIDTH
    hashes = [F.when(F.col("id").isNotNull(), h) for h in _hashes(at, F.col("id"))]
    grouped = (
        steps.withColumns({"block": F.floor(at / WIDTH), "slot": slot, **dict(zip(_LANES, hashes))})
        .groupBy("conv_id", "block")
        .agg(
            F.max("length").alias("length"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in _LANES], F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
            *[F.max(F.when(F.col("slot") == j, F.struct("id", "words"))).alias(f"t{j}") for j in range(WIDTH)],
        )
    )
    # a turnless conversation's row has no turn: its struct of nulls is none
    none = {f"t{j}": F.when(F.col(f"t{j}.id").isNotNull(), F.col(f"t{j}")) for j in range(WIDTH)}
    return _running(grouped.withColumns(none), (*_LANES, "words"))


def _rolled(table: DataFrame, sums: str) -> DataFrame:
    """All nodes of ``table`` with aggregates ``sums``: depth, key (of the node), up (its parent's), before (words
    before its last turn) and last (words of that)."""
    slots = ", ".join(f"t{j}" for j in range(WIDTH))
    keys = ", ".join(f"b_{k}" for k in _LANES)
    rolled = table.sparkSession.sql(
        f"SELECT block, {keys}, {slots}, b_words, grouping_id() AS open, {sums} FROM {{table}} "
        f"GROUP BY block, {keys}, b_words, ROLLUP ({slots})",
        table=table,
    )
    # a rolled-up column is null, as is one beyond a conversation's end
    level = (F.lit(WIDTH) - F.round(F.log2(F.col("open") + 1))).cast("int")
    leveled = rolled.withColumn("level", level)
    last = F.coalesce(*[F.when(F.col("level") == j + 1, F.col(f"t{j}")) for j in range(WIDTH)])
    # level 0 is the node that the block before ends at; a null in the last place stands for no turn
    real = leveled.withColumn("last", last).filter(((F.col("level") == 0) & (F.col("block") == 0)) | F.col("last").isNotNull())
    zero = F.lit(0).cast("long")
    start = F.col("block") * WIDTH
    at_slot = [_hashes(start + j, F.col(f"t{j}.id")) for j in range(WIDTH)]
    own = _hashes(start + F.col("level") - 1, F.col("last.id"))

    def total(parts: list[Column]) -> Column:
        return functools.reduce(lambda a, b: a + b, parts)

    reached = {
        f"key{k}": F.col(f"b_{_LANES[k]}") + total([F.when(F.col(f"t{j}").isNotNull(), at_slot[j][k]).otherwise(zero) for j in range(WIDTH)])
        for k in range(4)
    }
    above = {f"up{k}": F.col(f"key{k}") - F.when(F.col("last").isNotNull(), own[k]).otherwise(zero) for k in range(4)}
    words = total([F.coalesce(F.col(f"t{j}.words"), zero) for j in range(WIDTH)])
    return (
        real.withColumns({"depth": start + F.col("level"), **reached, "before": F.col("b_words") + words - F.coalesce("last.words", zero)})
        .withColumns(above)
        .drop("block", "open", "level", "last", "b_words", *[f"b_{k}" for k in _LANES], *[f"t{j}" for j in range(WIDTH)])
    )


def nodes(steps: DataFrame) -> DataFrame:
    """All nodes of the conversations in ``steps`` (as of ``rebuilt``): (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256)."""
    held = cut(blocks(steps))
    first = _rolled(held, "min(conv_id) AS conv_id, max(length) AS longest")
    owners = first.groupBy("conv_id").agg(
        F.min(F.struct("depth", "before")).alias("own"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf")
    )
    whole = held.groupBy("conv_id").agg(F.max("length").alias("length"), F.sum("words").alias("total"), *[F.sum(k).alias(k) for k in _LANES])
    zero = F.lit(0).cast("long")
    convs = cut(
        whole.join(owners, "conv_id", "left").select(
            "conv_id", "length", "total", *_LANES, F.coalesce("leaf", zero).alias("leaf"), F.col("own.before").alias("own_before"),
            F.when(F.col("own").isNotNull(), F.col("total") - F.col("own.before")).otherwise(zero).alias("owned"),
        )
    )
    told = held.drop("length", "words", *_LANES).join(convs.select("conv_id", "total", "leaf", "own_before", "owned"), "conv_id")
    second = cut(
        _rolled(
            told,
            "count(*) AS n_convs, min(struct(conv_id, own_before)) AS least, sum(total) AS total, sum(owned) AS owned, sum(leaf) AS n_leaves",
        )
        .withColumns({"conv_id": F.col("least.conv_id"), "own_before": F.col("least.own_before")})
        .drop("least")
    )
    # words of members' turns from here on, less those of distinct nodes
    saved = F.col("total") - F.col("n_convs") * F.col("before") - (F.col("owned") - (F.col("before") - F.col("own_before")))
    keys, ups = [f"key{k}" for k in range(4)], [f"up{k}" for k in range(4)]
    parents = second.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(u) for k, u in zip(keys, ups)], F.col("conv_id").alias("parent_conv_id"))
    children = second.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(u).alias(k) for k, u in zip(keys, ups)]).agg(F.count("*").alias("n_children"))
    ending = convs.select(F.col("length").cast("long").alias("depth"), *[F.col(c).alias(k) for c, k in zip(_LANES, keys)], "conv_id", F.col("conv_id").cast("string").alias("value"))
    node = ["depth", *keys]
    ends = digests(strung(ending, node, ["conv_id"], b","), node, ["part", "number"], b",")
    return (
        second.withColumn("saved_tokens", saved)
        .join(children, node, "left")
        .join(ends, node, "left")
        .join(parents, ["depth", *ups], "left")
        .select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )
