import collections

import numpy as np
from cases import FOLDER, docs, empty, prose

from docledger.llm import queries, suffixes


def brute(texts, length=50):
    at = collections.defaultdict(list)
    for d, t in set(texts):
        w = (t or "").encode().split()
        for i in range(len(w) - length + 1):
            at[b" ".join(w[i : i + length])].append((d is not None, d or 0, i, t))
    hits = collections.defaultdict(list)
    for group in at.values():
        if len({(k, d, t) for k, d, _, t in group}) > 1:
            first = min(group)[:2]
            for k, d, i, t in group:
                hits[k, d, t].append((i, first))
    out = []
    for (k, d, _), found in hits.items():
        spans = []
        for i, first in sorted(found):
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + length, min(spans[-1][2], first))
            else:
                spans.append((i, i + length, first))
        out += [(d if k else None, b, e, e - b, f[1] if f[0] else None) for b, e, f in spans]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.begin, r.end, r.n_words, r.first_doc) for r in df.collect()), key=str)


def test_query_is_the_brute_force_result(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = result(queries.op3_suffix_array(spark, FOLDER))
    assert got == brute(texts) and len(got) > 20


def test_awkward_rows(spark):
    texts = [(r.doc_id, r.text) for r in docs(spark).collect()]
    assert result(suffixes.repeated_passages(docs(spark))) == brute(texts)


def test_passages_of_many_lengths_and_small_tasks(spark):
    body = prose(9, 300).split()
    texts = [(i, " ".join(prose(100 + i, 20).split() + body[i * 7 % 100 : i * 7 % 100 + 48 + i % 6] + prose(200 + i, 9).split())) for i in range(40)]
    texts += [(100 + i, " ".join(body[i : i + 60])) for i in range(0, 40, 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(13)
    assert result(suffixes.repeated_passages(df)) == brute(texts)


def test_cuts_leave_first_occurrences_and_clean_texts(spark):
    got = {(r.doc_id, r.text): r for r in suffixes.drop_repeats(docs(spark)).collect()}
    before = {(r.doc_id, r.text): r for r in docs(spark).collect()}
    changed = {d for d, t in before if (d, t) not in got}
    assert changed == {7, 12, 13}
    assert (7, prose(5, 10)) in got
    # 12 repeats 11 as a whole and goes; of 13 only what its windows do not cover stays
    assert not [k for k in got if k[0] == 12]
    assert [(t, got[d, t].n_chars) for d, t in got if d == 13] == [("end", 3)]
    assert suffixes.drop_repeats(docs(spark)).columns == docs(spark).columns


def test_empty_table(spark):
    assert suffixes.repeated_passages(empty(spark)).collect() == []
    assert suffixes.drop_repeats(empty(spark)).collect() == []


def test_hashes_of_runs_depend_on_the_words_alone():
    with np.errstate(over="ignore"):
        a, b = suffixes.Words("one two  three\nfour two three four"), suffixes.Words("two three four")
        assert a.runs(3)[1] == b.runs(3)[0] == a.runs(3)[4] != a.runs(3)[0]
        assert len(suffixes.Words(None).runs(2)) == 0
