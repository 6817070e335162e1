"""Filters, counts, top lists and export rows over indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.functions.constants import (
    HASH_LENGTHS,
    REPORT_ROWS_PER_TYPE,
    TYPE_ORD,
    TYPES,
)
from indicatrix.functions.normalize import defang, in_list, literal, lookup
from indicatrix.operators.extract import resolve_types
from indicatrix.operators.numbering import ranked

_CONFIDENCE = {t[1]: t[3] for t in TYPES}
_NOTE = {t[1]: t[4] for t in TYPES}
_SHARES = (0.0001, 0.001, 0.01, 0.05, 0.2, 0.5)  # of a type's rows, below which its top list may end
IS_HASH = f"type IN {in_list(list(HASH_LENGTHS.values()))}"


def filter_types(indicators: DataFrame, names: str) -> DataFrame:
    """Keep the types a user asked for, aliases included.

    Prefer passing ``resolve_types(names)`` to the extraction: then the other
    expressions never run.
    """
    return indicators.where(F.col("type").isin(resolve_types(names)))


def defang_values(indicators: DataFrame) -> DataFrame:
    """Disarm every value for sharing."""
    return indicators.withColumn("value", F.expr(defang("value")))


def count_by_type(indicators: DataFrame) -> DataFrame:
    counts = indicators.groupBy("type").count()
    return counts.selectExpr("type", "count AS n", f"{lookup('type', TYPE_ORD)} AS type_ord")


def count_total(indicators: DataFrame) -> DataFrame:
    """Counts per type with the grand total as type ``total``."""
    rolled = indicators.rollup("type").agg(F.expr("count(*) AS n"), F.expr("grouping(type) AS _all"))
    return rolled.selectExpr("CASE WHEN _all = 1 THEN 'total' ELSE type END AS type", "n")


def hash_family_counts(indicators: DataFrame) -> DataFrame:
    """Digest counts per type beside the family total."""
    hashes = indicators.where(IS_HASH).selectExpr("'hash' AS family", "type")
    counts = hashes.rollup("family", "type").agg(
        F.expr("count(*) AS n"), F.expr("grouping(family) AS _f"), F.expr("grouping(type) AS _t")
    )
    return counts.where("_f = 0").selectExpr(
        "family", "CASE WHEN _t = 1 THEN 'all' ELSE type END AS type", "n", "n > 0 AS present"
    )


def top_per_type(listed: DataFrame, k: int = REPORT_ROWS_PER_TYPE) -> DataFrame:
    """The first ``k`` rows of each type in list order, ranked; any ``k``.

    Approximate quantiles of a type's positions give thresholds, an exact count finds the lowest with
    ``k`` rows below it, and what lies above is cut. The rest is sorted by ranges, so no task sees a type.
    """
    marks = listed.groupBy("type").agg(F.percentile_approx("ord", list(_SHARES), 10_000).alias("_marks"))
    below = [F.count_if(F.col("ord") <= F.col("_marks")[i]).alias(f"_n{i}") for i in range(len(_SHARES))]
    # Marks and limits are one row for each type.
    counts = listed.join(F.broadcast(marks), "type").groupBy("type", "_marks").agg(*below)
    enough = " ".join(f"WHEN _n{i} >= {int(k)} THEN _marks[{i}]" for i in range(len(_SHARES)))
    limits = counts.selectExpr("type", f"CASE {enough} END AS _limit")
    kept = listed.join(F.broadcast(limits), "type").where("_limit IS NULL OR ord <= _limit").select(*listed.columns)
    return ranked(kept, "type", "ord").where(F.col("rank") <= k)


def overflow_per_type(listed: DataFrame, k: int = REPORT_ROWS_PER_TYPE) -> DataFrame:
    """How many rows of each type lie beyond its top list."""
    return count_by_type(listed).selectExpr("*", f"greatest(n - {k}, 0) AS more")


def flatten_export(listed: DataFrame, source_label: str, default_confidence: str = "High") -> DataFrame:
    """Export rows ``type, value, confidence, source, note``; sort columns stay."""
    return listed.selectExpr(
        "type",
        "value",
        f"{lookup('type', _CONFIDENCE, default_confidence)} AS confidence",
        f"{literal(source_label)} AS source",
        f"{lookup('type', _NOTE)} AS note",
        *[c for c in ("type_ord", "ord") if c in listed.columns],
    )


def source_label(files: str, url: str, cert: str, label: str) -> str:
    """Label of a run: its files, else its URL, else its CERT feed, else the user's text.

    Takes and returns SQL expressions; ``files`` is an array.
    """
    by_files = f"CASE WHEN size({files}) <= 3 THEN array_join({files}, ', ') ELSE concat(size({files}), ' dosya') END"
    return (
        f"CASE WHEN size({files}) > 0 THEN {by_files} WHEN {url} <> '' THEN {url} "
        f"WHEN {cert} <> '' THEN concat('CERT-', {cert}) ELSE {label} END"
    )
