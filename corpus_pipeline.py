"""The corpus pipeline: the stages that turn ``documents`` into packed training sequences.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read back as the next one's ``docs``. All but the
last return the columns they got, with ``text`` and ``n_chars`` as the stage leaves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import quality, secrets, simhash, substrings
from tidemark.llm.common import saved, table
from tidemark.llm.queries import pack_table


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` as (row, id, text): no column of theirs meets one of a stage. A null id is
    given as the operators give it."""
    return docs.select(F.struct(*docs.columns).alias("row"),
                       F.coalesce("doc_id", F.lit(simhash.LAST)).alias("id"), "text")


def _columns(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every document; rejected documents go."""
    judged = quality.quality(_rows(docs)).filter("kept")
    return judged.select(*_columns(docs, F.col("cleaned")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, once; of several texts with that
    id the one with the smallest digest."""
    found = simhash.near_duplicates(docs, "doc_id")
    stays = found.groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("s")).select("s.*")
    rows = _rows(docs).withColumn("text_key", simhash.text_key(F.col("text")))
    return rows.join(stays, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a document with a smaller id has in the same passage go; so do documents of
    which nothing is left."""
    _, changed = substrings.deduplicate(docs, "doc_id")
    rows = _rows(docs).withColumn("digest", substrings.words_digest(F.col("text")))
    joined = rows.join(changed, ["id", "digest"], "left").filter("kept_text is null or kept_text <> ''")
    return joined.select(*_columns(docs, F.coalesce("kept_text", "text")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced in its text."""
    ledger = saved(secrets.scan(docs, ["doc_id"]), "ledger")
    return secrets.redacted(docs, ledger).select(F.struct(*docs.columns).alias("row"), "text").select(
        *_columns(docs, F.col("text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in their sequences."""
    return pack_table(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SimHash, the difference cover and packing have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{i + 1}")
    return docs
