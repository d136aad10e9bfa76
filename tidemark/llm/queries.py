"""The ``opN_*`` queries: each operator of this package on its whole driver table.

``QUERIES`` maps a name to a callable ``(spark, sf_dir)``; ``ORACLES`` has DuckDB SQL for
those that SQL expresses. The other queries are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    byte_pairs, centroids, chat, embeddings, oracles, packing, quality, repair, secrets, sentencepiece_bpe, simhash,
    substrings, tokens, warc)
from tidemark.llm.common import table

#: The folder of the public vocabulary files; the same place on every machine.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {
    "op1_secret_scans": oracles.SECRETS,
    "op2_quality_rules": oracles.QUALITY,
    "op6_chat_formatting": oracles.CHAT,
    "op8_substring_dedup": oracles.SUBSTRINGS,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_paths(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("findings", lambda s: s["ord"] < len(secrets.BASE_RULES))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(secrets.spans_string(base), 256).alias("base_sha256"),
                        secrets.spans_string(F.col("findings")).alias("spans"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines_removed", "lost_share")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text",
                                  vocabulary("word_bpe_49k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select(F.nullif("id", F.lit(embeddings.LAST)).alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


#: The byte-level vocabulary: its library file, the same as ranks, its word pattern (a fixed
#: value) and the strings that are special in texts.
BYTE_BPE = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken",
            r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
            {"<|endoftext|>": 50256})


def pack_table(docs: DataFrame) -> DataFrame:
    library, ranks, pattern, special = BYTE_BPE
    return packing.pack_documents(docs, "doc_id", "text", vocabulary(library), vocabulary(ranks),
                                  pattern, special).withColumnRenamed("id", "doc_id")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_table(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
SAMPLE_TURNS = [(-7, 0, "user", "\\### Assistant: </turn> ok"),
                (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    (conv, _, first, said), (_, _, second, _) = SAMPLE_TURNS
    sample = spark.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, first).otherwise(second).alias("role"), F.lit(said).alias("text"))
    records = chat.records_from_rows(rows.unionByName(sample), "conv_id", "turn", "role", "text")
    out = chat.render(chat.canonical_turns(records)).select("conv_id", "mapping", "formatted", "loss_spans")
    out = out.withColumns({"_turns": chat.read_turns(F.col("formatted")),
                           "_loss": chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))})
    joined = F.array_join(F.transform("_turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"),
                      F.sha2(joined, 256).alias("turns_sha256"),
                      F.length("_loss").cast("long").alias("loss_chars"),
                      F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "mapping")


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    coded = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    both = sentencepiece_bpe.decode(coded, path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = substrings.deduplicate(table(spark, sf_dir, "documents"), "doc_id")
    return report.select(F.nullif("id", F.lit(substrings.LAST)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id")
    return found.select(F.nullif("id", F.lit(simhash.LAST)).alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no capture time: a second for each id stands for it
    captures = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url",
        F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 30))).alias("ts"),
        F.coalesce("html", F.lit("")).alias("payload"))
    index = warc.archive_and_index(captures)
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
                        "urlkey", F.col("ts").alias("captured"), "archive", "offset", "length")


@query
def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    coded = byte_pairs.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    both = byte_pairs.decode(coded, path)
    return both.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return found.withColumnRenamed("id", "conv_id")
