"""The corpus pipeline: toxicity, near duplicates, substring dedup, PII surrogates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  Columns of its own have names that
the table lacks, so extra columns of any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe, minhash, packing, pii, queries, shared, substrings, toxicity


def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """docs' columns out of ``changed``, with ``text`` as the text and its length in n_chars."""
    def one(c: str):
        if c == "text":
            return F.col(text).alias(c)
        if c == "n_chars":
            return F.coalesce(F.length(text).cast(docs.schema[c].dataType), F.col(c)).alias(c)
        return F.col(c)

    return changed.select(*[one(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or higher go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.learnable())
    score, predicted = shared.fresh(docs.columns, "score", "predicted")
    return toxicity.score(docs, model, docs.columns, (score, predicted)).where(F.col(predicted) == 0).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one row stays, that of the smallest doc_id."""
    return minhash.first_of_each(docs, size=5, percent=80, name="pipeline-minhash")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that occur elsewhere go; a document that loses all stays, empty."""
    names = shared.fresh(docs.columns, *substrings.RESULTS)
    return _with_text(docs, substrings.remove_repeats(docs, docs.columns, "pipeline-substrings", tuple(names)), names[2])


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (count,) = shared.fresh(docs.columns, "n_entities")
    return _with_text(docs, pii.replace_entities(docs, docs.columns, queries.KEY, "pipeline-pii", count), "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into bins."""
    rows = bpe.encode_texts(docs.select("doc_id", "text"), *queries.tokenizer())
    return packing.pack_sequences(rows, rows["ids"], name="pipeline-packing")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substring_dedup", drop_repeated_passages), ("pii", replace_pii), ("packing", pack)]

#: Trained scores, keyed surrogates and packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = shared.Workspace(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
