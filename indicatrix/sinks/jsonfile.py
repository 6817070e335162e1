"""JSON export: the indented document as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.functions.constants import ALL_TYPES, LIST_KEY, TYPE_ORD
from indicatrix.functions.normalize import literal, lookup
from indicatrix.sinks import lines as L


def json_string(x: str) -> str:
    """A JSON string literal, non-ASCII characters as they are."""
    wrapped = f"to_json(array({x}))"
    return f"substr({wrapped}, 2, length({wrapped}) - 2)"


def _extent(listed: DataFrame) -> DataFrame:
    """``type_ord, last``: the last position per type; at most one row per type."""
    return listed.groupBy("type_ord").agg(F.expr("max(ord) AS last"))


def json_document(
    listed: DataFrame,
    source: str,
    run_ts: str,
    tlp: str | None = None,
    enrichment: DataFrame | None = None,
) -> DataFrame:
    """The result document of a run, two-space indented.

    ``listed`` has ``type, type_ord, value, ord`` and is read several times, so
    store it first.  With ``tlp`` this is the full result, to which
    ``enrichment`` (``value, payload``) adds its answers.
    """
    listed = listed.select("type_ord", "value", "ord")
    totals = listed.agg(F.expr("count(*) AS total"))
    q = literal
    head = [
        q("{"),
        q('  "metadata": {'),
        f"concat({q('    \"source\": ')}, {json_string(q(source))}, ',')",
        f"concat({q('    \"total_iocs\": ')}, total, {q(',' if tlp else '')})",
    ]
    if tlp:
        head.append(f"concat({q('    \"tlp\": ')}, {json_string(q(tlp))})")
    head += [q("  },"), q('  "iocs": {')]

    # Every type has its list, so the extent starts from the type table.
    spark = listed.sparkSession
    types = spark.range(1, len(ALL_TYPES) + 1).selectExpr("CAST(id AS INT) AS type_ord")
    extent = types.join(F.broadcast(_extent(listed)), "type_ord", "left")
    key = lookup("type_ord", {TYPE_ORD[t]: LIST_KEY[t] for t in ALL_TYPES})
    opening = f"concat('    \"', {key}, CASE WHEN last IS NULL THEN '\": [],' ELSE '\": [' END)"

    items = listed.join(F.broadcast(_extent(listed)), "type_ord")
    item = f"concat('      ', {json_string('value')}, CASE WHEN ord = last THEN '' ELSE ',' END)"

    stamp = f"concat({q('      \"extracted_at\": ')}, {json_string(q(run_ts))})"
    tail = [q('    "metadata": {'), stamp, q("    }"), q("  }")]
    if enrichment is None:
        tail.append(q("}"))
    parts = [
        L.fixed(totals, 0, head),
        L.block(extent, 1, 0, opening),
        L.block(items, 1, 1, item),
        L.block(extent.where("last IS NOT NULL"), 1, 2, "'    ],'"),
        L.fixed(totals, 2, tail),
    ]
    if enrichment is not None:
        # A comma after the previous member is a line of its own: valid JSON,
        # and absent when no lookup succeeded.
        # An answer stands where its value is listed first, so no two lines tie.
        first = listed.groupBy("value").agg(F.expr("min(struct(type_ord, ord)) AS place"))
        answers = enrichment.select("value", "payload").join(first, "value").select("value", "payload", "place.*")
        end = answers.agg(F.expr("max(struct(type_ord, ord)) AS last"), F.expr("count(*) AS n"))
        some = end.where("n > 0")
        last = some.selectExpr("last.type_ord AS type_ord", "last.ord AS ord", "true AS is_last")
        rows = answers.join(F.broadcast(last), ["type_ord", "ord"], "left")
        comma = "CASE WHEN is_last THEN '' ELSE ',' END"
        parts += [
            L.fixed(some, 3, [q("  ,"), q('  "enrichment": {')]),
            L.block(rows, 4, 0, f"concat('    ', {json_string('value')}, ': ', payload, {comma})"),
            L.fixed(some, 5, [q("  }")]),
            L.fixed(totals, 6, [q("}")]),
        ]
    return L.stack(*parts)


def write_json(document: DataFrame, path: str) -> None:
    L.write_document(document, path)


assert [TYPE_ORD[t] for t in ALL_TYPES] == list(range(1, len(ALL_TYPES) + 1))
