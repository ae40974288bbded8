"""The corpus pipeline: quality, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of ``documents``, the last
one the packed pieces. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import fresh, own_columns, table, written
from reportloom.llm.decontamination import without_leaks
from reportloom.llm.packing import pack, word_vocabulary
from reportloom.llm.quality import scored, train
from reportloom.llm.secrets import redact
from reportloom.llm.simhash import keep_one


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of at least 0.5).

    Null and empty texts are scored like others (their one feature is the bias). Repeated rows and rows with a null id are
    scored each and never learnt from twice; rows of equal scores share their fate. No rows give no rows.
    """
    score = fresh(docs, "score_")
    weights = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, weights, "text", score).where(F.col(score) >= 0.5).select(*own_columns(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that SimHash links.

    Null and empty texts have fingerprint zero and form a group with what is near it. Of rows that repeat an id one stays;
    rows with a null id all stay. No rows give no rows.
    """
    return keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay. Rows of an id go together; rows with a null id stay. No rows give no rows.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and lengths brought up to date.

    Null and empty texts stay as they are, and a null text keeps its length. Every row is handled alone.
    """
    clean = redact(docs, "text")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op9 gives them.

    Null and empty texts are one piece, the end token. Repeated rows and rows with a null id are packed each. No rows give
    no pieces.
    """
    return pack(docs, word_vocabulary)


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", no_benchmark),
    ("secret_scans", no_secrets),
    ("packing", packed),
]
#: SQL can express neither the classifier nor the retrieval nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; runs jobs.

    What a stage keeps is written once, in the shared folder, and read by the next: stages read their documents several times,
    and would work out all stages before them each time. The last stage is left to the action on the result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
