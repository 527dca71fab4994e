"""A corpus pipeline: rejects bad documents, keeps one of each near-duplicate group, drops documents that hold benchmark
items, masks secrets, encodes what is left.

STAGES lists (name, function); each takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
Null and empty texts have no words, so the first stage rejects them; repeated rows are near duplicates of each other, and of
ties one row stays. Texts of any length are worked on whole, further columns pass through whatever their names, nulls in
them included, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontamination, quality_rules, secret_scans, sentencepiece_codec, simhash
from logweave.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    rest = F.struct(*[F.col(c) for c in docs.columns if c not in new])  # packed, so that none clashes with the rules' results
    kept = quality_rules.quality(docs.select("text", rest.alias("_rest"))).where("kept")
    return kept.select(*[new.get(c, F.col("_rest").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of five-word shingles of 0.8 or more) the document with the smallest doc_id."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scans.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_pieces, and whether the ids decode to the text."""
    rows = sentencepiece_codec.round_trip(docs)
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("sentencepiece", encode),
]
#: Near-duplicate components and model scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
