"""The corpus pipeline: quality, near duplicates, benchmark contamination,
secrets, encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  Stages follow each other through Parquet in the shared folder.

Documents go that the quality classifier rejects, that are near duplicates (five
words, similarity 0.8) of one that stays, or that hold a whole window of eight
words of a benchmark item; secrets are replaced by a mark; what is left is
encoded.

Cases, for every stage: a null text counts as empty for the classifier, is its own
group, holds no window and no secret, and has null ids; empty and blank texts are
like it but are encoded as such.  Of rows that share an id the near-duplicate
stage keeps one, also of equal rows; rows without an id are told apart by their
text, and stay unless they are near duplicates of a row with an id.  Equal scores
and similarities at a threshold count as reaching it.  An empty table of documents
gives an empty one.  Other columns of documents, whatever their names, go through
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm import decontaminate, near_dedup, quality, secret_scan, sentencepieces
from wavegrid.llm.common import bucket_of, drop_tables, materialize, tables_made
from wavegrid.llm.queries import table, vocabulary
from wavegrid.runtime import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the classifier learns from the labelled
    ones among them whose crc32 is not divisible by 5."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, eligible=bucket_of(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, model, threshold=0.3)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group of near duplicates."""
    ship(spark)
    return near_dedup.keep_first(docs, k=5, percent=80)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole benchmark window."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), size=8)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret."""
    return secret_scan.redact(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_pieces of each document."""
    ship(spark)
    encoded = sentencepieces.encode(docs, vocabulary("piece_bpe_32k.model"))
    return encoded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_distinct),
    ("benchmark decontamination", keep_clean),
    ("secret scans", hide_secrets),
    ("SentencePiece encoding", encode),
]

#: The classifier, the signatures and the encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; once a stage is written, what it was made from
    is dropped."""
    docs, first = table(spark, sf_dir, "documents"), tables_made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, first, tables_made() - 1)
        first = tables_made() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
