import collections

import pytest
from cases import FOLDER, docs, empty
from pyspark.sql import functions as F

import corpus_pipeline
from docledger.llm import pieces
from docledger.session import cut

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def kept(spark):
    """The rows after each stage."""
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"": table}
    for name, stage in corpus_pipeline.STAGES:
        table = out[name] = cut(stage(spark, table, FOLDER))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_all_but_the_last_return_the_columns_of_documents(kept):
    assert all(kept[name].dtypes == kept[""].dtypes for name in NAMES[:-1])
    assert NAMES == ["language_id", "near_dedup", "passage_dedup", "mix_sources", "encode_pieces"]


def test_clean_documents_pass_language_id(kept):
    assert ids(kept["language_id"]) == ids(kept[""])


def test_no_similar_pair_is_left(kept):
    sets = {}
    for r in kept["near_dedup"].collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    shared = collections.Counter()
    at = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    for group in at.values():
        shared.update((a, b) for a in group for b in group if a < b)
    assert all(n / (len(sets[a]) + len(sets[b]) - n) < 0.82 for (a, b), n in shared.items())
    assert 0.85 * kept["language_id"].count() < len(sets) < kept["language_id"].count()


def test_no_passage_is_left_twice(kept):
    at = collections.defaultdict(set)
    before = {r.doc_id: r.text for r in kept["near_dedup"].collect()}
    after = {r.doc_id: r for r in kept["passage_dedup"].collect()}
    for d, r in after.items():
        w = r.text.split()
        assert r.n_chars == len(r.text)
        for i in range(len(w) - 49):
            at[" ".join(w[i : i + 50])].add(d)
    assert all(len(v) == 1 for v in at.values())
    source = collections.defaultdict(set)
    for d, t in before.items():
        w = t.split()
        for i in range(len(w) - 49):
            source[" ".join(w[i : i + 50])].add(d)
    clean = [d for d, t in before.items() if all(len(source[" ".join(t.split()[i : i + 50])]) == 1 for i in range(len(t.split()) - 49))]
    assert len(clean) > 100 and all(after[d].text == before[d] for d in clean)


def test_mixture_is_a_part_of_its_input(kept):
    assert ids(kept["mix_sources"]) <= ids(kept["passage_dedup"])


def test_ids_decode_to_the_text(kept):
    vocabulary = pieces.Vocabulary()
    texts = {r.doc_id: r.text for r in kept["mix_sources"].collect()}
    for r in kept["encode_pieces"].collect():
        assert r.text == texts[r.doc_id] == pieces._text(b"".join(vocabulary.raw[i] for i in r.ids)) and r.n_ids == len(r.ids)


def test_run_gives_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((r.doc_id, r.ids) for r in kept["encode_pieces"].collect())


@pytest.mark.parametrize("table", [docs, empty])
def test_awkward_rows_pass_every_stage(spark, table):
    now = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        now, columns = cut(stage(spark, now, FOLDER)), now.columns
        assert name == NAMES[-1] or now.columns == columns
    assert (now.count() > 0) == (table is docs)


def test_language_id_without_labels_keeps_all_with_a_letter(spark):
    table = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language_id(spark, table, FOLDER)
    assert got.columns == table.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([1, 1, 5, 6, 7, None, 8, 9, 10, 11, 12, 13], key=str)


def test_least_language_score_follows_the_number_of_labels():
    assert corpus_pipeline.least_score(1) == 0 and corpus_pipeline.least_score(4) == pytest.approx(0.3)
    assert all(1 / n < corpus_pipeline.least_score(n) < 1 / n + 0.067 for n in range(2, 200))
