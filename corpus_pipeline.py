"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicatrix.llm import byte_bpe, decontamination, exact_dedup, language_id, parity_join
from indicatrix.llm.common import Scratch, identified, ship, table, whole

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: SQL for the rows of run(): none, as SQL cannot express languages, near duplicates and tokens.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or letters go. Without labelled rows, all go."""
    ship(spark)
    into = "indicatrix_language"
    while into in docs.columns:
        into += "_"
    named = language_id.predict(docs, language_id.learn(docs.where(~language_id.held_out())), into=into)
    return named.where(F.col(into)["lang_pred"] != language_id.UNDETERMINED).drop(into)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest ``doc_id``; null is the smallest, and of equal ids one stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts, the row with the smallest ``doc_id``; null is the largest.

    A row without words is linked with nothing and stays. Texts are known by a 64-bit hash here; of rows
    equal in ``doc_id`` and text one stays.
    """
    ship(spark)
    rows, keys = identified(docs, F.xxhash64(whole()))
    own = F.struct(F.col(keys[1]), F.col(keys[0]), F.col(keys[2]))  # by id, none last
    linked = parity_join.parity_join(rows.select(F.col(keys[2]).alias("doc_id"), "text"))
    linked = linked.where("n_shingles > 0").select(F.col("doc_id").alias(keys[2]), "component_id").distinct()
    groups = rows.select(*keys).join(linked, keys[2], "left")
    # Without words there is no group: such a row is one of its own.
    stays = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), own).alias("alone")).agg(F.min(own).alias("first"))
    stays = stays.select(*[F.col("first")[k].alias(k) for k in keys])
    return rows.join(stays, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark, whatever their ids. Texts are known by a 64-bit hash here."""
    ship(spark)
    rows, keys = identified(docs, F.xxhash64(whole()))
    held = decontamination.contaminated(rows.select(F.col(keys[2]).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(held.select(F.col("doc_id").alias(keys[2])).distinct(), keys[2], "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decoded_sha256``: the token ids, and the digest of what they decode to.

    A row for each row; other columns go. A null text has no ids.
    """
    ship(spark)
    coded = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), RANKS, public_tokenizers.PATTERN)
    return coded.selectExpr("doc_id", "lang", "source", "CAST(size(ids) AS BIGINT) AS n_tokens", "ids", "sha2(decoded, 256) AS decoded_sha256")


STAGES = [
    ("language", known_language),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Its table stays in the shared folder; those of the others are emptied."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES:
            docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.hand_over()
    return docs
