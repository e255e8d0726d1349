"""A corpus pipeline: quality, near-duplicates, contamination, mixture, token files.

run() applies STAGES to the documents of a folder of tables. Each stage takes (spark, docs,
sf_dir), works on all rows that its predecessor kept, and its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import decontam, mixing, near_copies, quality_mil, token_store
from pitchlake.llm.queries import tokenizer_file
from pitchlake.llm.shared import crc_of_id, cut_at, documents, quoted, remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score reaches 0.7; learns as op3 does, never from held-out rows."""
    held_out = crc_of_id() % 4 == 2
    model = quality_mil.train(docs.filter(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    kept = [F.col(quoted(c)) for c in docs.columns]
    return quality_mil.score(docs, model, kept, out=("__score", "__accepted")).filter("__accepted = 1").select(*kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that five-word Jaccard similarities of 0.8 or more link, met by SimHash."""
    return near_copies.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that overlap no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say."""
    return mixing.emit(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns what it holds for each document."""
    return token_store.round_trip(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixture", mixture),
    ("token files", token_files),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs, done = cut_at(stage(spark, docs, sf_dir))
        if path:
            remove(spark, path)  # the next stage's table is written, and nobody reads this one again
        path = done
    return STAGES[-1][1](spark, docs, sf_dir)
