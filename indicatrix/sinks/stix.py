"""STIX 2.1 indicator objects and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.functions.constants import STIX_CONFIDENCE, STIX_OBJECT_PATHS, TLP_MARKINGS
from indicatrix.functions.normalize import in_list, literal, lookup
from indicatrix.sinks import lines as L

# Namespace of name-based identifiers, as hex digits.
ID_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
DEFAULT_CONFIDENCE = 50


def tlp_marking(tlp: str) -> str:
    """Marking reference of a TLP level; an unknown level counts as clear."""
    return lookup(f"upper({tlp})", TLP_MARKINGS, TLP_MARKINGS["TLP:CLEAR"])


def name_based_uuid(name: str) -> str:
    """A version 5 UUID: the same value has the same id in every run."""
    digest = f"sha1(concat(unhex('{ID_NAMESPACE}'), encode({name}, 'utf-8')))"
    variant = f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (
        f"concat_ws('-', substr({digest}, 1, 8), substr({digest}, 9, 4), concat('5', substr({digest}, 14, 3)), "
        f"concat({variant}, substr({digest}, 18, 3)), substr({digest}, 21, 12))"
    )


def stix_id(prefix: str, name: str | None = None) -> str:
    """``prefix--uuid``, random or, with ``name``, repeatable."""
    return f"concat('{prefix}--', {'uuid()' if name is None else name_based_uuid(name)})"


def stix_objects(
    listed: DataFrame, confidence: str, tlp: str, run_ts: str, random_ids: bool = False
) -> DataFrame:
    """One indicator object per row, as a struct; types without a pattern are left out."""
    rows = listed.where(f"type IN {in_list(list(STIX_OBJECT_PATHS))}")
    path = lookup("type", STIX_OBJECT_PATHS)
    ts = literal(run_ts)
    members = {
        "type": "'indicator'",
        "spec_version": "'2.1'",
        "id": stix_id("indicator", None if random_ids else "concat(type, '|', value)"),
        "created": ts,
        "modified": ts,
        "name": "concat(type, ' indicator: ', value)",
        "pattern": f"concat('[', {path}, ' = \\'', value, '\\']')",
        "pattern_type": "'stix'",
        "valid_from": ts,
        "confidence": str(STIX_CONFIDENCE.get(confidence, DEFAULT_CONFIDENCE)),
        "labels": "array('malicious-activity')",
        "object_marking_refs": f"array({tlp_marking(literal(tlp))})",
    }
    struct = ", ".join(f"'{name}', {sql}" for name, sql in members.items())
    return rows.selectExpr("type_ord", "ord", f"named_struct({struct}) AS object")


def stix_json(objects: DataFrame) -> DataFrame:
    """One JSON object per line: the form to store a large result in."""
    return objects.selectExpr("type_ord", "ord", "to_json(object) AS line")


def write_stix_objects(objects: DataFrame, path: str) -> None:
    objects.orderBy("type_ord", "ord").select("object.*").write.json(path)


def stix_bundle(objects: DataFrame, bundle_id: str) -> DataFrame:
    """The bundle document as ordered lines, one object per line."""
    # The position of the last object decides where the commas end.
    end = objects.agg(F.expr("max(struct(type_ord, ord)) AS last"), F.expr("count(*) AS n"))
    some = end.where("n > 0")
    last = some.selectExpr("last.type_ord AS type_ord", "last.ord AS ord", "true AS is_last")
    rows = stix_json(objects).join(F.broadcast(last), ["type_ord", "ord"], "left")
    line = "concat('    ', line, CASE WHEN is_last THEN '' ELSE ',' END)"
    head = [literal(text) for text in ("{", '  "type": "bundle",', f'  "id": "{bundle_id}",')]
    opening = "CASE WHEN n > 0 THEN '  \"objects\": [' ELSE '  \"objects\": []' END"
    return L.stack(
        L.fixed(end, 0, [*head, opening]),
        L.block(rows, 1, 0, line),
        L.fixed(some, 2, [literal("  ]")]),
        L.fixed(end, 3, [literal("}")]),
    )
