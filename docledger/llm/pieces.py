"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that occurs in it; a piece of
rank r weighs (r + 2) ** -theta. A forward pass sums the weights of all ways to reach each
place, a backward pass draws one way in proportion to its weight. The draws are a function
of ``seed``, the row's key, the place and the step: a text is cut the same way in every run,
wherever it is processed. A large ``theta`` draws nearly always the heaviest way.

A blank opens a piece and never stands inside one, so words with the blanks before them
have lattices of their own. Each distinct word is built once for a part of the input and
drawn from for each occurrence.

Lossless: a text gets a leading blank, which decoding takes off; characters without a piece,
and U+2581 (the vocabulary's sign for a blank), are encoded as their UTF-8 bytes.

Nulls and blanks: a null text gives null ids and decodes to null; an empty one gives no ids
and decodes to the empty text. Texts of any length are read whole. Repeated rows give equal
ids; a null key draws like one that hashes to 42. Other columns pass through unless named like the result.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Stands for U+2581 in a text; a lone surrogate is no character of any text.
_LITERAL = "\ud800"
_UNIT = re.compile(rf"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
_END = "\x00"
_CUT = "\ud802"
_CHARS = 1 << 21
#: Filter of the pieces' hashes, looked at before an exact search.
_SLOTS = 1 << 18
_PRIME = np.uint64(0x100000001B3)


class Vocabulary:
    """What tasks need of a model: at most a few megabytes, as large as the vocabulary."""

    def __init__(self, model: str = MODEL, theta: float = 2.0):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.vocab_size()
        self.pieces: dict[str, int] = {}
        self.byte_ids = np.zeros(256, np.int32)
        self.raw = [b""] * size
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.pieces[piece] = i
                self.raw[i] = piece.replace(BLANK, " ").encode()
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece has a blank inside; words are not independent")
        self.pieces.pop(_END, None)
        first = min(self.pieces.values(), default=0)
        self.log = -theta * np.log(np.maximum(np.arange(size) - first, 0) + 2.0)
        self.fallback = -theta * np.log(size + 2.0)
        # by length: hashes of its pieces, sorted by slot, with their ids, filters of those hashes,
        # and of the hashes of what longer pieces begin with
        self.by_length = []
        with np.errstate(over="ignore"):
            for n in range(1, max(map(len, self.pieces), default=0) + 1):
                some = [p for p in self.pieces if len(p) == n]
                hashes = _hashed(some, n)
                order = np.argsort(hashes & np.uint64(_SLOTS - 1), kind="stable")
                if len(np.unique(hashes)) < len(hashes):
                    raise ValueError("two pieces of one length share a hash")
                longer = {p[:n] for p in self.pieces if len(p) > n}
                ids = np.array([self.pieces[p] for p in some], np.int32)[order]
                self.by_length.append((hashes[order], ids, _filter(hashes), _filter(_hashed(list(longer), n))))

    @functools.cached_property
    def slots(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length: where a slot's hashes begin, and how many it has. Built by each worker."""
        out = []
        for hashes, *_ in self.by_length:
            counts = np.bincount((hashes & np.uint64(_SLOTS - 1)).astype(np.int64), minlength=_SLOTS)
            out.append(((np.cumsum(counts) - counts).astype(np.uint16 if len(hashes) < 1 << 16 else np.int32), counts.astype(np.uint8)))
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in a text given as code points, longest first: (place after it, length, id)."""
        to, length, piece = [], [], []
        codes = mix(codes + np.uint64(1))
        at, hashes = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.uint64)
        for n, (known, ids, filled, begun) in enumerate(self.by_length, 1):
            hashes = _grow(hashes, codes[at + np.int32(n - 1)])
            slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int32)
            some = np.flatnonzero(filled[slot])
            if len(known) and len(some):
                begin, count = self.slots[n - 1]
                nth = 0
                while len(some):  # most slots have one hash
                    spot = begin[slot[some]].astype(np.int32) + np.int32(nth)
                    hit = known[spot] == hashes[some]
                    found = some[hit]
                    to.append(at[found] + np.int32(n))
                    length.append(np.full(len(found), n, np.uint8))
                    piece.append(ids[spot[hit]])
                    nth += 1
                    some = some[~hit]
                    some = some[count[slot[some]] > nth]
            # only where a longer piece may begin
            on = np.flatnonzero(begun[slot] & (at < len(codes) - n))
            at, hashes = at[on], hashes[on]
        return tuple(np.concatenate(x[::-1]) if x else np.empty(0, np.int32) for x in (to, length, piece))


def _grow(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one more (mixed) character long."""
    hashes = (hashes ^ codes) * _PRIME
    return hashes ^ (hashes >> np.uint64(29))


def _hashed(texts: list[str], n: int) -> np.ndarray:
    """Hashes of texts of ``n`` characters."""
    hashes = np.zeros(len(texts), np.uint64)
    for k in range(n):
        hashes = _grow(hashes, mix(np.array([ord(t[k]) for t in texts], np.uint64) + np.uint64(1)))
    return hashes


def _filter(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(_SLOTS, bool)
    out[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
    return out


class Lattice:
    """The lattices of many words side by side: words stand one after the other, each with
    an end mark; node ``i`` is the place before character ``i``. ``edge`` arrays are sorted
    by the node they lead to, the longest first, from ``first`` [node] on; ``upto`` is the running
    share of a node's edges."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.end = np.cumsum(size) - 1  # the node after a word's last character
        start_of = np.repeat(self.end + 1 - size, size)
        text = _END.join(words) + _END
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        to, length, piece = vocabulary.edges(codes)
        known = np.zeros(len(text), bool)
        known[to[length == 1] - 1] = True
        known[self.end] = True
        bare = np.flatnonzero(~known)  # characters without a piece: their bytes
        to = np.concatenate([to, (bare + 1).astype(np.int32)])
        length = np.concatenate([length, np.ones(len(bare), np.uint8)])
        piece = np.concatenate([piece, np.full(len(bare), -1, np.int32)])
        order = np.argsort(to, kind="stable")
        self.to, self.length, self.piece = to, length, piece = to[order], length[order], piece[order]
        depth = (to - start_of[to]).astype(np.int32)
        if len(depth) and depth.max() < 1 << 16:
            depth = depth.astype(np.uint16)
        order = np.argsort(depth, kind="stable").astype(np.int32)
        depth = depth[order]
        alpha = np.full(len(text), -np.inf)
        alpha[start_of[self.end]] = 0.0  # forward: all words one character further at a time
        share = np.empty(len(to))
        cuts = np.flatnonzero(np.diff(depth.astype(np.int64), prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            goal, kind = to[at], piece[at]
            value = alpha[goal - length[at]] + np.where(kind < 0, vocabulary.fallback, vocabulary.log[kind])
            begin = np.flatnonzero(np.diff(goal, prepend=-1))
            count = np.diff(begin, append=b - a)
            most = np.maximum.reduceat(value, begin)
            part = np.exp(value - np.repeat(most, count))
            total = np.add.reduceat(part, begin)
            alpha[goal[begin]] = most + np.log(total)
            share[at] = part / np.repeat(total, count)
        begin = np.flatnonzero(np.diff(self.to, prepend=np.int32(-1)))
        count = np.diff(begin, append=len(self.to))
        run = np.cumsum(share)
        run -= np.repeat(run[begin] - share[begin], count)
        self.upto = run
        self.upto[begin + count - 1] = 2.0  # a draw stops at a node's last edge
        self.first = np.zeros(len(text), np.int32)
        self.first[self.to[begin]] = begin
        self.start, self.text, self.alpha = self.end + 1 - size, text, alpha

    def draw(self, word: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward sampling for occurrences of words: (occurrence, edge, step from the end)."""
        node, goal, live = self.end[word], self.start[word], np.arange(len(word), dtype=np.int32)
        parts, step = [], 0
        while len(live):
            u = mix(noise + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
            u = (u >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node]
            open_ = np.flatnonzero(self.upto[edge] <= u)
            while len(open_):
                edge[open_] += 1
                open_ = open_[self.upto[edge[open_]] <= u[open_]]
            parts.append((live, edge, np.full(len(live), step, np.int32)))
            node = node - self.length[edge]
            on = np.flatnonzero(node > goal)
            node, goal, noise, live = node[on], goal[on], noise[on], live[on]
            step += 1
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int32),) * 3


def _units(text: str) -> list[str]:
    """Words with the blanks before them, and line ends, in order."""
    if BLANK * 2 in text:
        return _UNIT.findall(text)
    # the common case, without runs of blanks: cut before blanks and around line ends
    marked = text.replace(BLANK, _CUT + BLANK).replace("\n", f"{_CUT}\n{_CUT}")
    return [u for u in marked.split(_CUT) if u]


def _encode(texts: list[str | None], keys: np.ndarray, vocabulary: Vocabulary, seed: int) -> list[np.ndarray]:
    """The ids of each text."""
    ids, at = _encode_all(texts, keys, vocabulary, seed)
    return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _encode_all(texts: list[str | None], keys: np.ndarray, vocabulary: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's begin and the last end."""
    index: dict[str, int] = defaultdict(counter().__next__)  # words by order of appearance
    word, row, place = [], [], []
    for r, t in enumerate(texts):
        if not t:
            continue
        units = _units(BLANK + t.replace(BLANK, _LITERAL).replace("\x00", "\ud801").replace(" ", BLANK))
        word += map(index.__getitem__, units)
        row.append(np.full(len(units), r, np.int32))
        place.append(np.arange(len(units), dtype=np.int32))
    if not word:
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    word, row, place = np.array(word, np.int32), np.concatenate(row), np.concatenate(place)
    noise = mix(keys[row] ^ mix(np.uint64(seed) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    lattice = Lattice(list(index), vocabulary)
    occurrence, edge, step = lattice.draw(word, noise)
    piece = lattice.piece[edge]
    width = np.ones(len(edge), np.int32)
    bare = np.flatnonzero(piece < 0)
    spelt = [_bytes(lattice.text[lattice.to[e] - 1]) for e in edge[bare]]
    width[bare] = [len(s) for s in spelt]
    # the steps of an occurrence stand in reverse: put them in order, then give each its ids
    many = np.bincount(occurrence, minlength=len(word))
    at = (np.cumsum(many) - 1)[occurrence] - step
    ordered = np.empty(len(edge), np.int32)
    ordered[at] = width
    offset = (np.cumsum(ordered, dtype=np.int64) - ordered)[at]
    ids = np.empty(int(width.sum()), np.int32)
    plain = piece >= 0
    ids[offset[plain]] = piece[plain]
    for o, s in zip(offset[bare], spelt):
        ids[o : o + len(s)] = vocabulary.byte_ids[list(s)]
    per_row = np.bincount(row[occurrence], weights=width, minlength=len(texts)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(per_row)])


def _bytes(char: str) -> bytes:
    return {_LITERAL: BLANK, "\ud801": "\x00"}.get(char, char).encode("utf-8")


def encode(
    docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", out: str = "ids", seed: int = 1,
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with ``out``: the ids (array<int>) of one sampled segmentation of ``text``; and with
    ``decoded``, if named: the text that those ids decode to, read back in the same pass."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = "ids array<int>" + (", decoded string" if decoded else "")

    @F.arrow_udf(kind)
    def sampled(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in parts:
            keys = keys.to_numpy().view(np.uint64)
            sizes = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy().astype(np.int64)
            bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // _CHARS, prepend=-1)).tolist()
            made = []
            for a, b in zip(bounds, [*bounds[1:], len(texts)]):
                part = texts.slice(a, b - a).to_pylist()
                with np.errstate(over="ignore"):
                    ids, at = _encode_all(part, keys[a:b], held.value, seed)
                none = np.fromiter((t is None for t in part), bool, len(part))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(none))
                columns = [lists]
                if decoded:
                    told = [None if t is None else _decode(ids[c:d], held.value.raw) for t, c, d in zip(part, at[:-1].tolist(), at[1:].tolist())]
                    columns.append(pa.array(told, pa.string()))
                made.append(pa.StructArray.from_arrays(columns, names=["ids", "decoded"][: len(columns)]))
            yield pa.concat_arrays(made)

    coded = small_batches(docs).withColumn("__coded", sampled(F.col(text), F.xxhash64(F.col(key))))
    coded = coded.withColumn(out, F.col("__coded.ids"))
    return (coded.withColumn(decoded, F.col("__coded.decoded")) if decoded else coded).drop("__coded")


def decode(ids: DataFrame, vocabulary: Vocabulary, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``ids`` with ``out``: the text that ``column`` stands for."""
    held = ids.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def joined(rows: pd.Series) -> pd.Series:
        return pd.Series([_decode(r, held.value.raw) for r in rows], dtype=object)

    return small_batches(ids).withColumn(out, joined(F.col(column)))


def _decode(ids: np.ndarray | None, raw: list[bytes]) -> str | None:
    return None if ids is None else _text(b"".join(map(raw.__getitem__, ids.tolist())))


def _text(raw: bytes) -> str:
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")
