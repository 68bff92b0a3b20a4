"""Columns that operators use for themselves, and ids of any size."""

from pyspark.sql import functions as F

from docledger.llm import audio, chat, pieces, simhash


def test_large_ids_keep_their_component(spark):
    big = 2**62 + 5
    docs = spark.createDataFrame([(big, "one two three four"), (2**63 - 1, "one two three four"), (None, "no id here at all"), (3, "")], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(big, big), (2**63 - 1, big), (None, None), (3, 3)}


def test_transcripts_ignore_columns_named_like_results(spark):
    known = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for c in range(6) for t in range(4)]
    model = chat.train_on(spark.createDataFrame(known, "conv_id long, turn long, role string, text string"))
    rows = [(1, 0, "User: hello", "s", 9, "x", 1), (1, 1, "", "s", 9, "x", 1), (1, 2, "Assistant: yes", "s", 9, "x", 1)]
    lines = spark.createDataFrame(rows, "conv_id long, at long, line string, state string, turn_no int, marker string, __row int")
    got = sorted((r.turn_no, r.role, r.text) for r in chat.turns(lines, model, ["at"]).collect())
    assert got == [(0, "user", "hello"), (1, "assistant", "yes")]


def test_media_columns_are_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc", "old", 5, "t")], "doc_id long, text string, media string, n_bytes int, tensor string")
    media = audio.with_media(docs)
    audio.with_features(media).write.parquet(str(tmp_path / "f"))
    row = spark.read.parquet(str(tmp_path / "f")).first()
    assert row.n_bytes == 3 and row.payload_bytes == 64 and len(row.tensor) == audio.TIMES * audio.MELS


def test_pieces_keep_null_rows_in_place(spark):
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else "word " * i) for i in range(40)], "doc_id long, text string")
    coded = pieces.encode(docs.coalesce(1), pieces.Vocabulary(), decoded="again")
    for r in coded.collect():
        assert (r.ids is None) == (r.text is None) and r.again == r.text
    assert coded.filter(F.size("ids") > 0).count() == 26
