"""A corpus for training: reject toxic documents, deduplicate, mix the sources, encode.

Each stage takes what its predecessor kept as ``docs`` and returns a DataFrame; all but the last
return the columns of documents.

Nulls, ties, odd rows: a null text counts as empty, is not toxic, and is one text with all empty ones; of
equal and of near texts the row that stays is told by the operators (a null id goes last); rows that repeat
are copies of each other; a null source is a source of its own; extra columns go through all stages as they
are, but ``ids`` and ``n_tokens``, which the last stage makes anew; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from onsetlab.llm import exact, nearcopies, mixing, pieces, toxicity
from onsetlab.staging import staged


#: Rows with texts that Spark hands to Python at a time; a smaller setting of the session stays.
BATCH_ROWS = 2048


def _lean(spark: SparkSession) -> None:
    """Bound the Arrow batches of texts, of which an executor holds one a task on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels beside the documents; the documents that score 0.5 or more go."""
    _lean(spark)
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, one row stays."""
    return exact.kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 on five words one document stays."""
    _lean(spark)
    return nearcopies.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each source; a document taken twice is two rows."""
    _lean(spark)
    return mixing.taken_text(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with the ids of their pieces."""
    _lean(spark)
    return pieces.tokenised(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can express neither the trained scores nor the hashes and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
