"""Exact duplicates: frequent digests are settled map-side, the others by one ordinary shuffle.

A frequent-items sketch (Misra-Gries with a bounded number of counters) names digests that may be
frequent. An exact count verifies them, and the winners, at most ``MAX_WINNERS`` rows, are broadcast:
their copies are settled where they are read and never shuffled. All other digests are aggregated, which
combines copies before the shuffle, and joined back, which Spark splits where a digest has very many rows.
So no group has to fit into a task, and a frequent digest that the sketch misses is only slower.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import cut, identified, whole

COUNTERS = 4096  # of each sketch
MAX_WINNERS = 1000  # rows of the broadcast
FREQUENT = 100  # copies from which a verified digest is settled map-side
FAN_IN = 64  # input tasks whose sketches are merged together before the last merge


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, row, text_sha256``: the lower-case hex SHA-256 of each whole text in UTF-8; null counts as empty."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(whole(text), 256).alias("text_sha256"))


def frequent_candidates(hashed: DataFrame) -> DataFrame:
    """``text_sha256`` of at most ``MAX_WINNERS`` digests that may be frequent.

    Sketches are merged in two steps, so the last merge reads one sketch for every ``FAN_IN`` tasks.
    """
    sketches = (
        hashed.select("text_sha256", (F.spark_partition_id() / FAN_IN).cast("int").alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(text_sha256, {COUNTERS})").alias("sketch"))
    )
    merged = sketches.groupBy((F.col("part") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    top = merged.selectExpr(f"explode(approx_top_k_estimate(sketch, {MAX_WINNERS})) AS top")
    return top.where(F.col("top.count") >= 2).select(F.col("top.item").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, row``.

    Texts are equal when identical. Of equal texts the row with the largest ``doc_id`` stays; null is
    the smallest ``doc_id``. A null text counts as empty, so null and empty texts are one group. Of
    rows equal in ``doc_id`` and text, exactly one is ``kept``. Other columns are not looked at. An
    empty table gives an empty result. ``row`` numbers the rows of this result.
    """
    hashed = cut(digests(docs, text))
    best = F.max(F.struct("doc_id", "row")).alias("best")
    winners = (
        hashed.join(F.broadcast(frequent_candidates(hashed)), "text_sha256")
        .groupBy("text_sha256")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= frequent)
    )
    winners = cut(winners)
    marked = hashed.join(F.broadcast(winners), "text_sha256", "left")
    rest = marked.where(F.col("group_size").isNull()).select("text_sha256", "doc_id", "row")
    # Of most digests there is one row, which is settled by its own aggregate. The others are joined back.
    groups = cut(rest.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size")))
    alone = groups.where("group_size = 1").select("text_sha256", "best.doc_id", "best.row", "best", "group_size")
    copied = rest.join(groups.where("group_size > 1"), "text_sha256").select("text_sha256", "doc_id", "row", "best", "group_size")
    rest = alone.unionAll(copied)
    settled = marked.where(F.col("group_size").isNotNull()).select("text_sha256", "doc_id", "row", "best", "group_size")
    return settled.unionAll(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        "row",
    )


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever those are called.

    Rows are told apart by ``doc_id`` and text, so of rows equal in both, one stays. An empty table stays
    empty. Texts move once, to meet the digests of the rows that stay.
    """
    rows, keys = identified(docs, F.sha2(whole(text), 256))
    stays = exact_dedup(docs, text).where("kept")
    stays, _ = identified(stays.select("doc_id", "text_sha256"), F.col("text_sha256"))
    stays = stays.drop("doc_id", "text_sha256").toDF(*keys)
    return rows.join(stays, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
