"""Documents as ordered line tables.

A report over a large corpus is itself large, so it never becomes one string in
one task.  Each builder gives rows ``section, type_ord, part, ord, line``; sorting
by the first four gives the document, and :func:`write_document` stores it as
text files whose concatenation in name order is the document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

SORT_KEYS = ["section", "type_ord", "part", "ord"]


def block(rows: DataFrame, section: int, part: int, line: str, type_ord: str = "type_ord") -> DataFrame:
    """One line, a SQL expression, per row of ``rows``."""
    return rows.selectExpr(
        f"{section} AS section",
        f"CAST({type_ord} AS INT) AS type_ord",
        f"{part} AS part",
        f"CAST({'ord' if 'ord' in rows.columns else 0} AS DECIMAL(38, 0)) AS ord",
        f"{line} AS line",
    )


def fixed(one_row: DataFrame, section: int, lines: Sequence[str]) -> DataFrame:
    """Several lines, SQL expressions over a single row such as one with the totals."""
    rows = one_row.selectExpr(f"posexplode(array({', '.join(lines)})) AS (ord, line)")
    return block(rows, section, 0, "line", type_ord="0")


def stack(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def document_lines(lines: DataFrame) -> DataFrame:
    """The document in order, as a single text column."""
    return lines.orderBy(*SORT_KEYS).select("line")


def write_document(lines: DataFrame, path: str, end: str = "\n") -> None:
    document_lines(lines).write.option("lineSep", end).text(path)
