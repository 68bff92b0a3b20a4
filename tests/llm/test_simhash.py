import collections

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from cases import FOLDER, docs, empty, prose
from pyspark.sql import functions as F

from docledger.llm import bktree, queries, simhash
from docledger.llm.components import components


def brute(texts: list[tuple]) -> dict:
    prints = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    out = {}
    for i, (d, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if label[j] == label[i] and texts[j][0] is not None]
        out[d, prints[i]] = (f"{prints[i]:016x}", min(ids, default=None))
    return out


def result(df):
    return sorted(((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in df.collect()), key=str)


def expected(texts):
    known = brute(texts)
    want = []
    for d, t in texts:
        key = next(k for k in known if k[0] == d and known[k][0] == simhash._fingerprint(simhash.shingle_hashes(t, 4), 64, 0)[0].hex())
        want.append((d, *known[key]))
    return sorted(want, key=str)


def test_query_is_the_brute_force_result(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, FOLDER).collect())
    assert got == sorted((d, *v) for (d, _), v in brute(texts).items())


@pytest.mark.parametrize("cap", [2, 2048])
def test_awkward_rows_and_cut_shards(spark, cap):
    texts = [(r.doc_id, r.text) for r in docs(spark).collect()]
    assert result(simhash.near_duplicates(docs(spark), cap=cap)) == expected(texts)


def test_more_blocks_find_the_same(spark):
    assert result(simhash.near_duplicates(docs(spark), blocks=6)) == result(simhash.near_duplicates(docs(spark)))


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.drop_near_duplicates(empty(spark), words=5, bits=512, radius=90, minima=8).collect() == []


@pytest.mark.parametrize("words", [1, 8])
def test_forest_finds_all_within_the_radius(words):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 2**63, (40, words)).astype(np.uint64)
    near = base[rng.integers(0, 40, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, words)).astype(np.uint64))
    points = np.concatenate([base, near, near[:50]])
    shard = rng.integers(0, 3, len(points))
    forest = bktree.Forest(points, shard)
    got = set()
    for q, n in forest.within(points, shard, 9):
        got |= set(zip(q.tolist(), n.tolist()))
    gap = np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2)
    assert got == {(i, j) for i, j in np.argwhere(gap <= 9).tolist() if shard[i] == shard[j]}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 60)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (7, 1)], "a long, b long")
    got = {(r.a, r.b) for r in components(edges).collect()}
    assert got == {(i, 100) for i in range(101, 161)} | {(i, 1) for i in range(2, 60)}


def test_stage_keeps_one_of_each_group(spark):
    kept = simhash.drop_near_duplicates(docs(spark), words=5, bits=512, radius=90, minima=8)
    assert kept.columns == docs(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # one of the repeated rows, of the blank texts, and of the three long copies stays; ids without links stay
    assert ids == sorted([1, 2, 5, 6, 7, 8, 9, 10, 11, None], key=str)


def test_wide_fingerprints_catch_similar_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in table.collect()}

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, at, both = {d: shingles(t) for d, t in texts.items()}, {}, {}
    for d, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(d)
    for group in at.values():
        for i in group:
            for j in group:
                if i < j:
                    both[i, j] = both.get((i, j), 0) + 1
    like = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in both.items()}
    found = simhash.near_duplicates(table, words=5, bits=512, radius=90, minima=8)
    part = {r.doc_id: r.component_id for r in found.collect()}
    pairs = [p for p, s in like.items() if s >= 0.8]
    assert len(pairs) > 50 and sum(part[a] == part[b] for a, b in pairs) >= 0.99 * len(pairs)
    best = {d: max([s for p, s in like.items() if d in p], default=0) for d in texts}
    assert all(best[d] > 0.65 for d in texts if part[d] != d)


def test_fingerprint_bits(spark):
    assert simhash._fingerprint(np.array([0b101, 0b100, 0b001], np.uint64), 64, 0)[0] == (0b101).to_bytes(8, "big")
    row = docs(spark).filter("doc_id = 2").select("doc_id", "text")
    assert [bytes(r.fp) for r in simhash.fingerprints(row).collect()] == [bytes(8)]
    assert simhash.fingerprints(row.withColumn("n", F.lit(1))).columns == ["doc_id", "fp", "minima"]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_stage(texts: dict) -> set:
    """Ids left of {id: text}, by all pairs that share a shingle."""
    sets, at, shared = {d: shingle_set(t) for d, t in texts.items()}, collections.defaultdict(list), collections.Counter()
    for d, s in sets.items():
        for x in s or {b""}:
            at[x].append(d)
    for group in at.values():
        shared.update((a, b) for a in group for b in group if a < b)
    label = {d: d for d in texts}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for (a, b), n in shared.items():
        if not sets[a] or n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    return {d for d in texts if find(d) == d}


def of_set(spark, texts: dict):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")


def overlapping(seed: int, shared: int, own: int) -> tuple[str, str]:
    """Two texts of shared + own shingles each that have ``shared`` in common."""
    words = prose(seed, shared + 4 + 2 * own).split()
    common, a, b = words[: shared + 4], words[shared + 4 : shared + 4 + own], words[shared + 4 + own :]
    return " ".join(common + a), " ".join(common + b)


def test_stage_finds_every_similar_pair(spark):
    """Short pairs of 0.8, where fingerprints are far apart, long ones of 0.8, and texts that
    repeat one another's shingles."""
    texts = {}
    for k in range(120):
        short = prose(1000 + k, 8)
        texts[10 * k], texts[10 * k + 1] = short, short + " more"
        texts[10 * k + 2], texts[10 * k + 3] = overlapping(2000 + k, 80, 10)
        run = prose(3000 + k, 30)
        texts[10 * k + 4], texts[10 * k + 5] = f"{run} {run}", " ".join([run] * 3)
        texts[10 * k + 6], texts[10 * k + 7] = overlapping(5000 + k, 400, 50)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, of_set(spark, texts), FOLDER).collect()}
    want = expected_stage(texts)
    assert want == {10 * k + i for k in range(120) for i in (0, 2, 4, 6)}
    assert got == want


@pytest.mark.parametrize("cap", [5, 2048])
def test_stage_is_the_brute_force_result(spark, cap):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = simhash.drop_similar(of_set(spark, texts), similarity=0.8, words=5, cap=cap)
    assert {r.doc_id for r in got.collect()} == expected_stage(texts)


def test_stage_keeps_related_but_distinct_texts(spark):
    """Pairs of 0.75, and a series in which each text has 0.75 of the one before."""
    texts = {2 * k + i: t for k in range(60) for i, t in enumerate(overlapping(7000 + k, 300, 50))}
    line = prose(8000, 1600).split()
    texts |= {1000 + k: " ".join(line[60 * k : 60 * k + 424]) for k in range(16)}
    assert expected_stage(texts) == set(texts)
    got = corpus_pipeline.near_dedup(spark, of_set(spark, texts), FOLDER)
    assert {r.doc_id for r in got.collect()} == set(texts)
