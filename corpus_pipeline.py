"""The corpus pipeline: each stage takes what the one before kept, written out and
reread. All stages but the last return the columns of documents.

The toxicity and language models are fitted anew on what their stage is given: labelled
rows outside the held-out fold, and rows with a language. Null and empty texts score as
the intercept says in the first stage and have no language, so the second drops them;
the third keeps exactly one row of each class of similar texts, whether doc_ids are
unique, repeated or null; the fourth drops rows by their own text. Columns of any name come through unchanged. Empty tables give no rows.

Texts go to Python 2,000 at a time, by a setting of the session: `run` puts it back; a
stage called on its own leaves it, because its result is computed later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import staged
from docloom.llm.decontaminate import drop_contaminated
from docloom.llm.jaccard import keep_one_of_each
from docloom.llm.language import keep_known_languages
from docloom.llm.packing import pack_documents
from docloom.llm.toxicity import drop_toxic


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """A batch is held several times over by an executor and its workers."""
    spark.conf.set(BATCH, "2000")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (operator 3) rejects go."""
    _small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language (operator 8) go."""
    _small_batches(spark)
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each n-gram Jaccard component (operator 10) stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item (operator 5) go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens (operator 4)."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models and a tokenizer decide; SQL cannot state them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH)
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = staged(docs, name)
    finally:
        spark.conf.set(BATCH, before)
    return docs
