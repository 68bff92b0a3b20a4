"""Chat transcripts: a hidden Markov model recovers who speaks, then turns are rendered.

A transcript is a run of lines. Each line is in one of 12 states: a role (system, user,
assistant, tool) and a part of its turn (first line, inside, the blank line after it). A line
shows features: the speaker marker it opens with, if any, whether it is blank, whether it
asks, and its length class. Transition and feature probabilities are counts over labelled
transcripts; scores are whole numbers, so sums do not depend on their order. The Viterbi
path gives each line's state; a first line opens a turn. Turns without a marker are
recovered from the turn before and their lines.

Lines are dealt to tasks by (conversation, order), so a conversation of any length is spread.
Of a conversation that spans several tasks each gives the best score from every state
before its lines to every state at their end; these small tables settle the states at
the borders, and each task then finds the path between its own.

Nulls and blanks: a null line is a blank one; a null conversation id is a conversation; null
order values come first. Lines equal in order stand in the order of their text. Repeated
lines are kept. Blank lines before the first turn belong to no turn and go. An empty table gives no
turns. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

ROLES = ("system", "user", "assistant", "tool")
PARTS = ("first", "inside", "after")
STATES = len(ROLES) * len(PARTS)
START = STATES  # the place before a transcript's first line
_NEVER = -(10**12)
_SCALE = 1000

#: Names that open a line, by role.
NAMES = {
    "system": ("system", "instructions"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "a"),
    "tool": ("tool", "function", "observation"),
}
#: How markers are written; {} is the name. A blank after a colon or bracket belongs to it.
FORMS = (r"<\|{}\|>", r"\[{}\](?: |$)", r"#{{1,4}} {}:(?: |$)", r"\*\*{}\*\*:(?: |$)", r"{}:(?: |$)")
FEATURES = {"marker": len(ROLES) + 1, "blank": 2, "asks": 2, "length": 8}


def _pattern(role: str) -> str:
    name = "(?:" + "|".join(NAMES[role]) + ")"
    return "(?i)^(?:" + "|".join(form.format(name) for form in FORMS) + ")"


def features(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with the features of each line (``marker`` is 0 or a role's number from 1)."""
    text = F.coalesce(F.col(line), F.lit(""))
    marker = F.lit(0)
    for i, role in reversed(list(enumerate(ROLES, 1))):
        marker = F.when(text.rlike(_pattern(role)), i).otherwise(marker)
    return lines.withColumns(
        {
            "marker": marker,
            "blank": (F.trim(text) == "").cast("int"),
            "asks": text.endswith("?").cast("int"),
            "length": F.least(F.floor(F.log2(F.length(text) + F.lit(1))).cast("int"), F.lit(7)),
        }
    )


def without_marker(line: Column) -> Column:
    out = line
    for role in ROLES:
        out = F.when(line.rlike(_pattern(role)), F.regexp_replace(line, _pattern(role), "")).otherwise(out)
    return out


class Model:
    """Whole-number log scores: ``moves`` (state or start, state), ``shows`` by feature."""

    def __init__(self, moves: np.ndarray, shows: dict[str, np.ndarray]):
        def log(counts):
            share = (counts + 0.01) / (counts + 0.01).sum(axis=1, keepdims=True)
            return np.round(_SCALE * np.log(share)).astype(np.int64)

        self.moves, self.shows = log(moves), {name: log(c) for name, c in shows.items()}

    def emissions(self, frame: pd.DataFrame) -> np.ndarray:
        """(lines, states) scores."""
        return sum(self.shows[name][:, frame[name].to_numpy()].T for name in FEATURES)

    def paths(self, shown: np.ndarray, bounds: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The best states of groups of lines [bounds[i], bounds[i + 1]), each after a state
        ``before`` and ending in ``last`` (-1: in the best). All groups go one line further at a time."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")  # those that go on stand in front
        start, size, before, last = bounds[:-1][order], size[order], before[order], last[order]
        back, score = np.zeros((len(shown), STATES), np.int8), self.moves[before] + shown[start]
        for t in range(1, int(size[0]) if len(size) else 0):
            at = start[: np.searchsorted(-size, -t)] + t
            step = score[: len(at), :, None] + self.moves[None, :STATES]
            back[at] = step.argmax(axis=1)
            score[: len(at)] = step.max(axis=1) + shown[at]
        state, out = np.where(last < 0, score.argmax(axis=1), last), np.empty(len(shown), np.int64)
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            at = start[: np.searchsorted(-size, -t)] + t
            out[at] = state[: len(at)]
            if t:
                state[: len(at)] = back[at, state[: len(at)]]
        return out

    def path(self, shown: np.ndarray, before: int, last: int | None) -> np.ndarray:
        """The best states of some lines after state ``before``, ending in ``last`` if given."""
        return self.paths(shown, np.array([0, len(shown)]), np.array([before]), np.array([-1 if last is None else last]))

    def summary(self, shown: np.ndarray) -> np.ndarray:
        """(state or start before, state at the end): the best score over some lines."""
        score = self.moves + shown[0]
        for row in shown[1:]:
            score = (score[:, :, None] + self.moves[None, :STATES]).max(axis=1) + row
        return score


def borders(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, state at the end) of each of a transcript's parts, from their summaries."""
    scores = [tables[0][START]]
    for t in tables[1:]:
        scores.append((scores[-1][:, None] + t[:STATES]).max(axis=0))
    last = [int(scores[-1].argmax())]
    for i in range(len(tables) - 1, 0, -1):
        last.append(int((scores[i - 1] + tables[i][:STATES, last[-1]]).argmax()))
    last.reverse()
    return list(zip([START, *last[:-1]], last))


def train(turns: DataFrame, lines: DataFrame) -> Model:
    """Count ``lines`` (role, part, features) and the moves of ``turns`` (conv_id, turn, role,
    n_lines). What reaches the driver is as large as the model."""
    state = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    shows = {name: np.zeros((STATES, size)) for name, size in FEATURES.items()}
    counted = (
        lines.withColumn("s", state * len(PARTS) + F.array_position(F.array(*map(F.lit, PARTS)), F.col("part")) - 1)
        .filter("s >= 0").groupBy("s", *FEATURES).count()
    )
    for r in counted.collect():
        for name in FEATURES:
            shows[name][r.s, r[name]] += r["count"]
    moves = np.zeros((STATES + 1, STATES))
    known = turns.withColumn("s", (state * len(PARTS)).cast("int")).filter("s >= 0")
    inside = known.groupBy("s").agg(
        F.sum((F.col("n_lines") == 1).cast("long")).alias("one"),
        F.sum((F.col("n_lines") > 1).cast("long")).alias("more"),
        F.sum(F.greatest(F.col("n_lines") - 2, F.lit(0))).alias("stay"),
    )
    for r in inside.collect():
        moves[r.s, r.s + 2] += r.one
        moves[r.s, r.s + 1] += r.more
        moves[r.s + 1, r.s + 1] += r.stay
        moves[r.s + 1, r.s + 2] += r.more
    here = known.select("conv_id", "turn", F.col("s").alias("before"))
    following = known.select("conv_id", (F.col("turn") - 1).alias("turn"), "s")
    for r in here.join(following, ["conv_id", "turn"]).groupBy("before", "s").count().collect():
        moves[r.before + 2, r.s] += r["count"]
    for r in known.filter("turn = 0").groupBy("s").count().collect():
        moves[START, r.s] += r["count"]
    return Model(moves, shows)


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups of sorted frames, many at a time, with their bounds. The last group of a
    frame may go on in the next: it waits."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame.reset_index(drop=True) if rest is None else pd.concat([rest, frame], ignore_index=True)
        values = [frame[k].to_numpy() for k in keys]
        changed = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        bounds = np.concatenate([[0], np.flatnonzero(changed) + 1])
        rest = frame.iloc[bounds[-1] :]
        if len(bounds) > 1:
            yield frame.iloc[: bounds[-1]], bounds
    if rest is not None:
        yield rest.reset_index(drop=True), np.array([0, len(rest)])


def states(lines: DataFrame, model: Model, order: list[str]) -> DataFrame:
    """``lines`` (conv_id, the ``order`` columns, line) with ``state`` and ``turn_no`` (from 0; null
    before the first turn)."""
    held = lines.sparkSession.sparkContext.broadcast(model)
    kept = [*lines.columns]
    keys = ["conv_id", *order, "line"]
    dealt = features(lines.withColumn("line", F.coalesce("line", F.lit("")))).repartitionByRange(*keys)
    # the conversation's number: ids may be null, which frames would blur
    dealt = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__conv", F.xxhash64("conv_id")))
    group = ["__conv", "__part"]
    parts = dealt.groupBy(*group).agg(F.count("*").alias("n"))
    split = cut(parts.groupBy("__conv").agg(F.count("*").alias("p")).filter("p > 1").select("__conv"))

    def summarise(frames):
        for g, bounds in _groups(frames, group):
            shown = held.value.emissions(g)
            tables = [held.value.summary(shown[a:b]).reshape(-1).tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            yield g.iloc[bounds[:-1]][group].assign(t=tables)

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__part")
        pairs = borders([np.array(t).reshape(STATES + 1, STATES) for t in frame["t"]])
        return frame.assign(before=[a for a, _ in pairs], last=[b for _, b in pairs])[["__conv", "__part", "before", "last"]]

    spread = dealt.join(split, "__conv", "left_semi").select(*group, *FEATURES, *keys)
    tables = spread.repartition(*group).sortWithinPartitions(*group, *order, "line").drop(*keys).mapInPandas(summarise, "__conv long, __part int, t array<long>")
    ends = tables.groupBy("__conv").applyInPandas(settle, "__conv long, __part int, before int, last int")

    def decode(frames):
        for g, bounds in _groups(frames, group):
            at = bounds[:-1]
            found = held.value.paths(held.value.emissions(g), bounds, g["before"].to_numpy()[at], g["last"].to_numpy()[at])
            opened = np.cumsum(found % len(PARTS) == 0)
            earlier = np.repeat(np.concatenate([[0], opened[bounds[1:-1] - 1]]), np.diff(bounds))
            yield pd.DataFrame({"__row": g["__row"], "state": found, "__local": opened - earlier, "__conv": g["__conv"], "__part": g["__part"]})

    # the row's place among its group's, so that texts need not pass through the decoder
    numbered = cut(dealt.withColumn("__row", F.row_number().over(W.partitionBy(*group).orderBy(*order, "line"))))
    asked = numbered.select(*group, "__row", *FEATURES).join(ends, group, "left")
    asked = asked.withColumns({"before": F.coalesce("before", F.lit(START)), "last": F.coalesce("last", F.lit(-1))})
    decoded = cut(
        asked.repartition(*group).sortWithinPartitions(*group, "__row")
        .mapInPandas(decode, "__row int, state int, __local long, __conv long, __part int")
    )
    before = W.partitionBy("__conv").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    opened = (
        decoded.join(split, "__conv", "left_semi").groupBy(*group).agg(F.max("__local").alias("n"))
        .select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    )
    counted = decoded.join(opened, group, "left").withColumn("__no", F.col("__local") + F.coalesce("__before", F.lit(0)) - 1)
    turn_no = F.when(F.col("__no") >= 0, F.col("__no"))
    return numbered.join(counted, [*group, "__row"]).select(*kept, "state", turn_no.alias("turn_no"))


def turns(lines: DataFrame, model: Model, order: list[str]) -> DataFrame:
    """(conv_id, turn_no, role, text, rendered): the turns that ``lines`` hold, markers and the
    blank line after a turn taken off, and their canonical form."""
    found = states(lines.select("conv_id", *order, "line"), model, order).filter(F.col("turn_no").isNotNull())
    part = F.col("state") % len(PARTS)
    line = F.when(part == 0, without_marker(F.col("line"))).otherwise(F.col("line"))
    # a turn is one value, as the text of a document is
    grouped = found.withColumn("line", line).withColumn("part", part).groupBy("conv_id", "turn_no").agg(
        F.min("state").alias("state"),
        F.sort_array(F.collect_list(F.when(part < 2, F.struct(*order, "line")))).alias("lines"),
    )
    role = F.get(F.array(*map(F.lit, ROLES)), F.floor(F.col("state") / len(PARTS)).cast("int"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return grouped.select("conv_id", "turn_no", role.alias("role"), text.alias("text")).withColumn("rendered", render(F.col("role"), F.col("text")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


#: Ways to write a transcript: the markers of system, user, assistant, tool.
STYLES = (
    ("System: ", "User: ", "Assistant: ", "Tool: "),
    ("### System: ", "### Human: ", "### Assistant: ", "### Tool: "),
    ("<|system|>", "<|user|>", "<|assistant|>", "<|tool|>"),
    ("[system] ", "Q: ", "A: ", "[tool] "),
    ("**System**: ", "**User**: ", "**AI**: ", "**Tool**: "),
)


def transcribe(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as raw transcript lines: (conv_id, turn, at, line,
    role, part). A hash of the id picks the style; one assistant turn of four, by hash,
    goes without its marker. A blank line follows each turn."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    table = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    who = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    bare = (F.col("role") == "assistant") & (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0)
    mark = F.when(bare, F.lit("")).otherwise(F.coalesce(F.get(F.get(table, style), who - 1), F.concat(F.coalesce("role", F.lit("user")), F.lit(": "))))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    n = F.size(lines)
    return (
        conversations.withColumn("mark", mark)
        .select("conv_id", "turn", "role", "mark", F.posexplode(F.concat(lines, F.array(F.lit("")))).alias("at", "raw"), n.alias("n"))
        .select(
            "conv_id", "turn", "at",
            F.when(F.col("at") == 0, F.concat("mark", "raw")).otherwise(F.col("raw")).alias("line"), "role",
            F.when(F.col("at") == F.col("n"), "after").when(F.col("at") == 0, "first").otherwise("inside").alias("part"),
        )
    )


def train_on(conversations: DataFrame) -> Model:
    counts = conversations.select("conv_id", "turn", "role", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"))
    return train(counts, features(transcribe(conversations)))
