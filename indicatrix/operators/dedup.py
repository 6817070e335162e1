"""Duplicate removal over a whole corpus, in first-seen order.

The position of an occurrence is one decimal, so the smallest position per
``(type, value)`` is a hash aggregate with a fixed-width buffer: occurrences of
a hot value are combined before the only shuffle, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from indicatrix.functions.constants import TYPE_ORD
from indicatrix.functions.normalize import lookup

# Digits, from the left: derived 1 | source_ord 7 | doc_id 20 | pos 10; a decimal has no more.
_DERIVED = "10000000000000000000000000000000000000BD"
_SOURCE = "1000000000000000000000000000000BD"
MAX_SOURCE = 9_999_999
_DOC = "10000000000BD"
_SHIFT = "9223372036854775808BD"  # makes any bigint doc_id non-negative

# Corpus position of an occurrence: direct matches come before derived ones.
_SOURCE_ORD = f"IF(source_ord BETWEEN 0 AND {MAX_SOURCE}, source_ord, raise_error('source_ord is out of range'))"
POSITION = (
    f"CAST(CAST(derived AS INT) * {_DERIVED} + {_SOURCE_ORD} * {_SOURCE}"
    f" + (CAST(doc_id AS DECIMAL(20, 0)) + {_SHIFT}) * {_DOC} + pos AS DECIMAL(38, 0))"
)
_TYPE_ORD = f"{lookup('type', TYPE_ORD)} AS type_ord"


def with_position(indicators: DataFrame) -> DataFrame:
    """Every occurrence with its ``ord``; the form to list when duplicates stay."""
    return indicators.selectExpr("*", f"{POSITION} AS ord", _TYPE_ORD)


def first_seen(indicators: DataFrame) -> DataFrame:
    """One row per ``(type, value)``: ``type, value, ord, type_ord`` of the first one."""
    placed = indicators.selectExpr("type", "value", f"{POSITION} AS ord")
    firsts = placed.groupBy("type", "value").min("ord")
    return firsts.selectExpr("type", "value", "`min(ord)` AS ord", _TYPE_ORD)


def unpack_position(rows: DataFrame) -> DataFrame:
    """Replace ``ord`` by ``derived, source_ord, doc_id, pos``."""
    digits = "lpad(CAST(ord AS STRING), 38, '0')"
    doc_id = f"CAST(substr({digits}, 9, 20) AS DECIMAL(20, 0)) - {_SHIFT}"
    return rows.selectExpr(
        *[c for c in rows.columns if c != "ord"],
        f"substr({digits}, 1, 1) = '1' AS derived",
        f"CAST(substr({digits}, 2, 7) AS INT) AS source_ord",
        f"CAST({doc_id} AS BIGINT) AS doc_id",
        f"CAST(substr({digits}, 29, 10) AS INT) AS pos",
    )


def distinct_indicators(indicators: DataFrame) -> DataFrame:
    """The same set without an order: the cheaper form when none is needed."""
    return indicators.select("type", "value").distinct()
