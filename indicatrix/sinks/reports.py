"""Markdown and plain-text reports as ordered lines.

The indicators are read several times, so store them first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.functions.constants import (
    ALL_TYPES,
    MARKDOWN_LABELS,
    MARKDOWN_NOTES,
    MARKDOWN_TITLE,
    TEXT_LABELS,
)
from indicatrix.functions.normalize import literal, lookup
from indicatrix.operators.report import IS_HASH, count_by_type, overflow_per_type, top_per_type
from indicatrix.sinks import lines as L


def _texts(*lines: str) -> list[str]:
    return [literal(line) for line in lines]


def markdown_report(
    listed: DataFrame, source: str, run_ts: str, confidence: str = "High", top: int | None = None
) -> DataFrame:
    """Summary, distribution and the indicators of each type; with ``top``, the first ones and how many follow."""
    listed = listed.select("type", "type_ord", "value", "ord")
    counts = count_by_type(listed) if top is None else overflow_per_type(listed, top)
    totals = counts.agg(F.expr("coalesce(sum(n), 0) AS total"))
    label = lookup("type", MARKDOWN_LABELS)
    head = [
        *_texts(
            MARKDOWN_TITLE,
            "",
            "---",
            "",
            "## Executive Summary",
            f"- **Kaynak:** `{source}`",
            f"- **Tarih:** {run_ts}",
        ),
        "concat('- **Toplam IOC:** **', total, '**')",
        *_texts(
            f"- **Confidence:** {confidence}",
            "",
            "## IOC Dağılımı",
            "",
            "| IOC Türü | Adet |",
            "|----------|------|",
        ),
    ]
    rows = listed if top is None else top_per_type(listed, top)
    more = [] if top is None else [L.block(counts.where("more > 0"), 3, 2, "concat('- ... ve ', more, ' adet daha')")]
    return L.stack(
        L.fixed(totals, 0, head),
        L.block(counts, 1, 0, f"concat('| ', {label}, ' | ', n, ' |')"),
        L.fixed(totals, 2, _texts("", "## Detaylı IOC Listesi", "")),
        L.block(counts, 3, 0, f"concat('### ', {label}, ' (', n, ' adet)')"),
        L.block(rows, 3, 1, "concat('- `', value, '`')"),
        *more,
        L.block(counts, 3, 3, "''"),
        L.fixed(totals, 4, _texts("---", "", "## Kullanım Notları", *MARKDOWN_NOTES)),
    )


def text_report(listed: DataFrame, source: str, run_ts: str) -> DataFrame:
    """Every indicator under its heading; digests share one heading."""
    listed = listed.select("type", "type_ord", "value", "ord")
    counts = count_by_type(listed)
    totals = counts.agg(
        F.expr("coalesce(sum(n), 0) AS total"), F.expr(f"coalesce(max({IS_HASH}), false) AS hashes")
    )
    label = lookup("type", TEXT_LABELS)
    rule = "=" * 40
    head = _texts(rule, "  IOC Extraction Report", rule, f"Source: {source}", f"Date: {run_ts}", "")
    plain = f"NOT {IS_HASH}"
    return L.stack(
        L.fixed(totals, 0, head),
        L.block(counts.where(plain), 1, 0, f"concat('[', {label}, '] (', n, ' found)')"),
        L.block(listed.where(plain), 1, 1, "concat('  - ', value)"),
        L.block(counts.where(plain), 1, 2, "''"),
        L.fixed(totals.where("hashes"), 2, _texts("[Hashes]")),
        L.block(counts.where(IS_HASH), 3, 0, f"concat('  ', {label}, ' (', n, ' found):')"),
        L.block(listed.where(IS_HASH), 3, 1, "concat('    - ', value)"),
        L.fixed(totals.where("hashes"), 4, _texts("")),
        L.fixed(totals, 5, ["concat('Total IOCs: ', total)"]),
    )


assert list(MARKDOWN_LABELS) == ALL_TYPES and list(TEXT_LABELS) == ALL_TYPES
