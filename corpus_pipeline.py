"""A training corpus from the documents table: each stage takes what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), docs being a Parquet table
with the columns of documents, and returns a DataFrame. All stages but the last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickweave.llm.common import read_table, written
from clickweave.llm.hyperminhash import one_of_each
from clickweave.llm.quality_rules import good_documents
from clickweave.llm.queries import piece_model
from clickweave.llm.sentencepiece_scan import encode
from clickweave.llm.source_mixing import mix_documents
from clickweave.llm.trie_dedup import deduplicate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return good_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) one document stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per document and pass, with the words taken."""
    return mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text: doc_id, n_chars, n_chunks, n_pieces, ids, and the
    digest of what they decode to."""
    return encode(docs, piece_model(), digests=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("MinHash near-dedup", near),
          ("mixing sources", mixing), ("SentencePiece encoding", pieces)]

#: Estimates of robust statistics and sketches aren't for SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
