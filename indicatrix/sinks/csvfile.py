"""CSV export: header, minimal quoting, CRLF line ends."""

from __future__ import annotations

from pyspark.sql import DataFrame

from indicatrix.sinks import lines as L

FIELDS = ["type", "value", "confidence", "source", "note"]


def _cell(name: str) -> str:
    quoted = f"concat('\"', replace({name}, '\"', '\"\"'), '\"')"
    return f"CASE WHEN rlike({name}, '[\",\\r\\n]') THEN {quoted} ELSE {name} END"


def csv_document(rows: DataFrame) -> DataFrame:
    """Export rows as the lines of a CSV document, its header first."""
    one = rows.sparkSession.range(1)
    line = f"concat_ws(',', {', '.join(_cell(name) for name in FIELDS)})"
    return L.stack(L.fixed(one, 0, [f"'{','.join(FIELDS)}'"]), L.block(rows, 1, 0, line))


def write_csv(rows: DataFrame, path: str) -> None:
    """Text files whose concatenation in name order is the CSV document, lines ending in CRLF."""
    L.write_document(csv_document(rows), path, "\r\n")
