import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docledger.llm import queries, records

MODEL = public_tokenizers.path("word_bpe_49k.json")


def tokens(text, model=MODEL):
    return Tokenizer.from_file(model).encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


def masked(crc):
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def crc32c(data):
    """Bit by bit."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums_are_the_standard_ones():
    assert crc32c(b"123456789") == 0xE3069283
    r = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 3, 126, 127, 128, 129, 700, 0, 5])
    halves = r.integers(0, 1 << 16, sizes.sum()).astype("<u2")
    ends = np.cumsum(sizes)
    expected = [masked(crc32c(halves[b - n : b].tobytes())) for b, n in zip(ends, sizes)]
    assert records.checksums(halves, sizes).tolist() == expected


@pytest.mark.parametrize("model", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizers(model):
    path = public_tokenizers.path(model)
    encoder = records.Encoder(path)
    assert encoder.direct == (model == "word_bpe_49k.json")
    texts = [t for _, t, *_ in cases.rows()] + [
        "<|endoftext|> <|ENDOFTEXT|>, a<|startoftext|>b.", "Don't. we'll,, 's .,. x.", "é ́a İstanbul ΣΑΣ ﬁ ß", "a\x1cb\x85c d e　f\r\n\tg",
        "Word word WORD word. word, word..", "٣ ½ ² x² ſ", "\x00 ﻿bom", "日本 語. 한글, i̇",
    ]
    assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts)] == [tokens(t, path) for t in texts]
    encoder.kept = dict.fromkeys(map(str, range(records._KEPT_PIECES + 1)), b"")
    assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts[:3])] == [tokens(t, path) for t in texts[:3]]


def test_round_trip_of_awkward_rows(spark, tmp_path):
    docs = cases.docs(spark).withColumns({"key": F.lit(1), "shard": F.lit(2), "hash": F.lit(3), "n_tokens": F.lit(4)})
    index = records.write(docs, str(tmp_path / "r"), MODEL, end_id=1)
    found = records.with_starts(records.read(index, str(tmp_path / "r")), index).collect()
    expected = sorted((d is not None, d or 0, raw([*tokens(t), 1])) for d, t, *_ in cases.rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in found) == expected
    found.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in found]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    some = index.filter("doc_id IN (5, 9, 11)")
    assert {r.doc_id for r in records.read(some, str(tmp_path / "r"), seed=3).collect()} == {5, 9, 11}


def test_without_end_id_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, ""), (2, "a b"), (3, None)], "doc_id long, text string")
    index = records.write(docs, str(tmp_path / "a"), MODEL)
    assert {r.doc_id: bytes(r.ids) for r in records.read(index, str(tmp_path / "a")).collect()} == {1: b"", 2: raw(tokens("a b")), 3: b""}
    index = records.write(cases.empty(spark), str(tmp_path / "b"), MODEL, end_id=1)
    assert records.with_starts(records.read(index, str(tmp_path / "b")), index).collect() == []


def test_shuffled_order_follows_the_seed(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    index = records.write(docs, str(tmp_path / "r"), MODEL, end_id=1)
    orders = [[r.doc_id for r in records.read(index, str(tmp_path / "r"), seed=s).collect()] for s in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    assert sorted(orders[0]) == sorted(orders[2]) == list(range(200)) != orders[0]


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, "and more words")], "doc_id long, text string")
    index = records.write(docs.coalesce(1), str(tmp_path / "r"), MODEL)
    row = index.filter("doc_id = 2").first()
    path = tmp_path / "r" / row.file
    data = bytearray(path.read_bytes())
    data[row.offset + 13] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="checksums"):
        records.read(index, str(tmp_path / "r")).collect()


def test_query_equals_the_tokenizer(spark):
    found = queries.QUERIES["op13_binary_records"](spark, cases.FOLDER).collect()
    start = 0
    expected = set()
    for r in sorted(spark.read.parquet(f"{cases.FOLDER}/documents.parquet").select("doc_id", "text").collect()):
        ids = [*tokens(r.text), 1]
        expected.add((r.doc_id, start, len(ids), zlib.crc32(raw(ids))))
        start += len(ids)
    assert {tuple(r) for r in found} == expected
