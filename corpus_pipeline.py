"""From raw documents to sampled token ids: five stages, each one operator of the library.

Every stage takes (spark, docs, sf_dir), works on all rows of the stage before, and is
written as Parquet and read again before the next. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import language, mixing, pieces, simhash, suffixes
from docledger.session import cut

#: How far from 1/n, the least that the best of n languages can have, to 1 a score must be.
MIN_LANGUAGE_SCORE = 1 / 15


def least_score(labels: int) -> float:
    """Below this a text is in none of ``labels`` languages (0.3 for four); a single language
    has score 1 always and rejects nothing."""
    return 1 / labels + (1 - 1 / labels) * MIN_LANGUAGE_SCORE if labels > 1 else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that fit no learned language, go; if no language can be
    learned, only the former."""
    network = language.train(docs.filter(language.fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    if network is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    seen = language.predict(docs.withColumnsRenamed({"score": "__score", "lang_pred": "__pred"}), network)
    kept = seen.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least_score(len(network.labels))))
    return kept.drop("lang_pred", "score").withColumnsRenamed({"__score": "score", "__pred": "lang_pred"})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are alike (similarity 0.8 or more) the
    one with the smallest id stays. 512 fingerprint bits, the least shingles of 8 orders and a
    wide radius choose the candidates; the sets themselves decide."""
    return simhash.drop_similar(docs, similarity=0.8, words=5)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in several documents stay in the first only."""
    return suffixes.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in training order, sources to weights of count ** 0.7 as long as they have blocks."""
    return mixing.arranged(docs, mixing.tempered_shares(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_ids, text): sampled piece ids, and the text they decode to."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.Vocabulary(), decoded="text")
    return coded.withColumn("n_ids", F.size("ids"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: The stages sample, train and hash: no SQL. Tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
