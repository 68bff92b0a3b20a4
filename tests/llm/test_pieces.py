import numpy as np
import pytest
from cases import FOLDER, docs, empty, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from docledger.llm import pieces, queries


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def coded(texts, vocabulary, keys=None, seed=1):
    with np.errstate(over="ignore"):
        keys = np.arange(len(texts)) if keys is None else np.array(keys)
        return [x.tolist() for x in pieces._encode(texts, keys.astype(np.uint64), vocabulary, seed)]


def text_of(ids, vocabulary):
    return pieces._text(b"".join(vocabulary.raw[i] for i in ids))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40), max_size=4))
def test_round_trip_of_any_text(vocabulary, texts):
    assert [text_of(i, vocabulary) for i in coded(texts, vocabulary)] == texts


def test_round_trip_of_awkward_and_long_texts(vocabulary):
    texts = ["", " ", "  a", "▁", "▁▁ ▁x\n\n", "\x00\n\x00", "x" * 70_000, "é" * 999, prose(3, 20_000)]
    assert [text_of(i, vocabulary) for i in coded(texts, vocabulary)] == texts


def ways(word, vocabulary):
    """All segmentations of a word with their weights."""
    if not word:
        return [((), 0.0)]
    out = []
    for n in range(1, len(word) + 1):
        if (i := vocabulary.pieces.get(word[:n])) is not None:
            out += [((i, *rest), vocabulary.log[i] + w) for rest, w in ways(word[n:], vocabulary)]
    return out


def test_samples_follow_the_weights_of_all_ways(vocabulary):
    flat = pieces.Vocabulary(theta=0.3)
    word = "there"
    known = dict(ways(pieces.BLANK + word, flat))
    total = sum(np.exp(w) for w in known.values())
    n = 20_000
    drawn = [tuple(i) for i in coded([word] * n, flat)]
    assert set(drawn) <= set(known) and len(known) > 10
    for way, w in known.items():
        p = np.exp(w) / total
        assert abs(drawn.count(way) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4
    lattice = pieces.Lattice([pieces.BLANK + word], flat)
    assert np.isclose(lattice.alpha[lattice.end[0]], np.log(total))


def test_draws_depend_on_key_and_seed_not_on_company(vocabulary):
    texts = [prose(i, 60) for i in range(6)]
    together = coded(texts, vocabulary)
    alone = [coded([t], vocabulary, keys=[i])[0] for i, t in enumerate(texts)]
    assert together == alone
    assert coded(texts, vocabulary, seed=2) != together
    assert coded([texts[0]] * 2, vocabulary)[0] != coded([texts[0]] * 2, vocabulary)[1]


def test_large_theta_draws_the_heaviest_way():
    strong = pieces.Vocabulary(theta=300.0)
    best = max(ways(pieces.BLANK + "therein", strong), key=lambda x: x[1])[0]
    assert {tuple(x) for x in coded(["therein"] * 50, strong)} == {best}


def test_awkward_rows(spark, vocabulary):
    df = docs(spark).withColumnRenamed("h", "ids_")
    rows = pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()
    assert len(rows) == df.count() and all(r.decoded == r.text for r in rows)
    assert all((r.ids is None) == (r.text is None) for r in rows)
    twice = [r.ids for r in rows if r.doc_id == 1]
    assert twice[0] == twice[1]
    assert pieces.encode(empty(spark), vocabulary).collect() == []


def test_query_decodes_every_document(spark):
    rows = queries.op1_sentencepiece(spark, FOLDER).collect()
    assert len(rows) == 200 and all(r.lossless and r.n_ids == len(r.ids) > 0 for r in rows)
    again = {r.doc_id: r.ids for r in queries.op1_sentencepiece(spark, FOLDER).collect()}
    assert all(again[r.doc_id] == r.ids for r in rows)
