"""A training-data pipeline over `documents`: toxicity, line dedup, near duplicates, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

In every stage other columns than those of documents are left out, repeated rows are rows of their own, and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, ngram_join, packing, secrets, toxicity
from quern.llm.common import discard, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same_columns(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and n_chars to match."""
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents whose score is at least one half.  Labels whose crc32(doc_id) mod 5 is 0 are not learned from.

    Null and empty texts have the score of a text without words; without toxic labels nothing is rejected.
    """
    labels = table(spark, sf_dir, "labels")
    labels = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, labels)
    return toxicity.score_toxicity(docs, model, out="_toxic").where("_toxic < 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more hold, except in the last; a document with nothing left goes.

    A null or blank text that lost nothing stays as it is: emptiness is no repeat.
    """
    docs = docs.select(*COLUMNS)
    return line_dedup.dedup_rows(docs).where("n_dropped = 0 or trim(left_text) <> ''").transform(
        lambda x: _same_columns(x, F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("left_text")))
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that five-word shingles link at a similarity of 0.8, the one with the smallest doc_id stays.

    Documents without a word, and rows without a doc_id, link with nothing and stay; rows of the smallest doc_id all do.
    """
    docs = docs.select(*COLUMNS)
    found = ngram_join.link_components(docs, words=5, percent=80)
    extra = found.where("node <> component").select("node")
    return docs.join(extra, docs["doc_id"] == extra["node"], "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [secret] in the place of each secret.  A null text stays null."""
    docs = docs.select(*COLUMNS)
    scanned = secrets.scan_secrets(docs)
    return _same_columns(scanned, F.when(F.col("text").isNotNull(), F.col("scan.redacted")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 2048 tokens.  A null or empty text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL has neither the toxicity model nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
