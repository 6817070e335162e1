"""Documents -> indicators.

Documents are ``(source_ord int, source string, doc_id bigint, text string)``;
further columns, such as an event time, pass through.  Every operator here is
one projection and one generate: no shuffle, so it runs on a stream as well.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.functions import extract as X
from indicatrix.functions import validate as V
from indicatrix.functions.constants import ALL_TYPES, HASH_LENGTHS, LIST_KEY, TYPE_ALIASES
from indicatrix.functions.normalize import literal, lookup, refang
from indicatrix.functions.patterns import URL_STRICT_SCHEME

_HASH_TYPES = list(HASH_LENGTHS.values())
_NO_HITS = "CAST(array() AS ARRAY<STRUCT<type:STRING,derived:BOOLEAN,pos:INT,value:STRING>>)"


def resolve_types(names: str) -> list[str]:
    """``"ip,hash"`` -> canonical types in export order; unknown names are ignored."""
    wanted = {t for name in names.split(",") for t in TYPE_ALIASES.get(name.strip().lower(), [])}
    return [t for t in ALL_TYPES if t in wanted]


def _hits(matches: str, type_: str, derived: bool = False, value: str = "v") -> str:
    """Matches ``v`` as structs."""
    return _structs(matches, literal(type_), derived, value)


def _hash_hits(matches: str) -> str:
    """Digests, typed by their length."""
    return _structs(matches, lookup("length(v)", HASH_LENGTHS), False, "lower(v)")


def _structs(matches: str, type_: str, derived: bool, value: str) -> str:
    fields = f"'type', {type_}, 'derived', {literal(derived)}, 'pos', i, 'value', {value}"
    return f"transform({matches}, (v, i) -> named_struct({fields}))"


# The check a match must pass to count as an indicator of its type.
_IS_VALID = (
    f"CASE WHEN type = 'ipv4' THEN {V.is_ipv4('value')} "
    f"WHEN type = 'domain' THEN {V.is_indicator_name('lower(value)')} ELSE true END"
)


def _raw_text(docs: DataFrame, do_refang: bool) -> DataFrame:
    return docs.withColumn("_raw", F.expr(refang("text")) if do_refang else F.col("text"))


def extract_indicators(
    docs: DataFrame, types: Iterable[str] | None = None, do_refang: bool = True, derived: bool | None = None
) -> DataFrame:
    """All indicators in long form, duplicates kept.

    Adds ``type, derived, pos, value``.  ``derived`` marks a domain taken from
    a URL; ``pos`` counts the matches of a type within a document.  Only the
    expressions of the wanted ``types`` enter the plan, and with ``derived`` only
    the direct or only the derived ones.
    """
    types = set(ALL_TYPES if types is None else types)
    keep = [c for c in docs.columns if c != "text"]
    parts = []
    from_urls = "domain" in types and derived is not False
    if derived:
        types = set()
    if "ipv4" in types:
        parts.append(_hits(X.ipv4_matches("_raw"), "ipv4"))
    if "ipv6" in types:
        parts.append(_hits(X.ipv6_matches("_raw"), "ipv6"))
    if "domain" in types:
        parts.append(_hits(X.domain_matches("_raw"), "domain"))
    if from_urls:
        parts.append(_hits("_urls", "domain", derived=True, value=X.url_host("v")))
    if "url" in types:
        parts.append(_hits("_urls", "url"))
    if "email" in types:
        parts.append(_hits(X.email_matches("text"), "email"))
    if "cve" in types:
        parts.append(_hits(X.cve_matches("_raw"), "cve"))
    if "mitre" in types:
        parts.append(_hits(X.mitre_matches("_raw"), "mitre"))
    wanted_hashes = [t for t in _HASH_TYPES if t in types]
    if wanted_hashes:
        parts.append(_hash_hits(X.hash_matches("_raw")))

    staged = _raw_text(docs, do_refang)
    if from_urls or "url" in types:
        staged = staged.withColumn("_urls", F.expr(X.url_matches("_raw")))
    hits = f"explode(concat({', '.join(parts or [_NO_HITS])})) AS _hit"
    rows = staged.selectExpr(*keep, hits).selectExpr(*keep, "_hit.*").where(_IS_VALID)
    if 0 < len(wanted_hashes) < len(_HASH_TYPES):
        rows = rows.where(F.col("type").isin(sorted(types)))
    if do_refang and "email" in types:
        live = f"CASE WHEN type = 'email' THEN {refang('value')} ELSE value END"
        rows = rows.withColumn("value", F.expr(live))
    return rows


# check -> where its candidates are found, and the check of one.
_CHECKS = {
    "is_ipv4": (X.ipv4_matches("_raw"), V.is_ipv4("v")),
    "is_ipv6": (X.ipv6_matches("_raw"), V.is_ipv6("v")),
    "hash_type": (X.hash_matches("_raw"), f"{V.hash_type('v')} IS NOT NULL"),
    "is_cve": (X.cve_matches("_raw"), V.is_cve("v")),
    "is_indicator_domain": (X.domain_matches("_raw"), V.is_indicator_domain("v")),
    "is_domain_name": (X.domain_matches("_raw"), V.is_domain_name("v")),
    "is_email": (X.email_matches("text"), V.is_email("v")),
    "is_url": (X.url_matches("_raw"), V.is_url("v")),
}


def count_checks(docs: DataFrame, do_refang: bool = True) -> DataFrame:
    """``check, valid, n``: how many of the candidates that a corpus holds pass each check, in one pass over the texts."""
    parts = [
        f"transform({found}, v -> named_struct('check', '{name}', 'valid', coalesce({valid}, false)))"
        for name, (found, valid) in _CHECKS.items()
    ]
    rows = _raw_text(docs, do_refang).selectExpr(f"inline(concat({', '.join(parts)}))")
    return rows.groupBy("check", "valid").agg(F.count(F.lit(1)).alias("n"))


def extract_wide(
    docs: DataFrame,
    run_ts: str | None = None,
    do_refang: bool = True,
    unique: bool = True,
    types: Iterable[str] | None = None,
) -> DataFrame:
    """One row per document with an array per type; arrays of unwanted types are empty."""
    types = set(ALL_TYPES if types is None else types)
    keep = [c for c in docs.columns if c != "text"]
    staged = _raw_text(docs, do_refang)
    staged = staged.withColumns(
        {"_urls": F.expr(X.url_matches("_raw")), "_hashes": F.expr(X.hash_matches("_raw"))}
    )
    emails = X.email_matches("text")
    hosts = f"transform(_urls, u -> {X.url_host('u')})"
    lists = {
        "ipv4": f"filter({X.ipv4_matches('_raw')}, v -> {V.is_ipv4('v')})",
        "ipv6": X.ipv6_matches("_raw"),
        "domain": f"filter(concat({X.domain_matches('_raw')}, {hosts}), v -> {V.is_indicator_domain('v')})",
        "url": "_urls",
        "email": f"transform({emails}, e -> {refang('e')})" if do_refang else emails,
        "cve": X.cve_matches("_raw"),
        "mitre": X.mitre_matches("_raw"),
    }
    for length, name in HASH_LENGTHS.items():
        lists[name] = f"transform(filter(_hashes, h -> length(h) = {length}), h -> lower(h))"
    cols = []
    for name in ALL_TYPES:
        values = lists[name] if name in types else X.NO_STRINGS
        cols.append(f"{f'array_distinct({values})' if unique else values} AS {LIST_KEY[name]}")
    stamp = "CAST(current_timestamp() AS STRING)" if run_ts is None else literal(run_ts)
    return staged.selectExpr(*keep, *cols, f"{stamp} AS extracted_at")


# --- single-type sets ---------------------------------------------------------
_STRICT = f"filter({X.strict_url_matches('text')}, u -> {V.matches('u', URL_STRICT_SCHEME)})"
_LITE = f"filter({X.domain_matches('text', any_case=True)}, d -> {V.is_lite_domain('d')})"
_SETS = {
    "ip": (
        f"concat({_hits(f'filter({X.ipv4_matches("text")}, a -> {V.is_ipv4("a")})', 'ipv4')}, "
        f"{_hits(X.ipv6_matches('text'), 'ipv6')})"
    ),
    "domain": _hits(_LITE, "domain", value="lower(v)"),
    "url": _hits(_STRICT, "url"),
    "email": _hits(X.email_matches("text"), "email"),
    "hash": _hash_hits(X.hash_matches("text")),
    "cve": _hits(X.cve_matches("text"), "cve", value="upper(v)"),
}


def indicator_set(docs: DataFrame, kind: str) -> DataFrame:
    """The distinct indicators of one kind over a corpus, on the text as it stands.

    ``kind`` is one of ip, domain, url, email, hash, cve.  The text is not
    refanged; domains use the shorter acceptance lists, CVE ids are upper-cased.
    """
    hits = docs.selectExpr(f"explode({_SETS[kind]}) AS _hit")
    return hits.select("_hit.type", "_hit.value").distinct()


# --- user-defined types -------------------------------------------------------
def extract_custom(docs: DataFrame, specs: Iterable[dict], do_refang: bool = True) -> DataFrame:
    """Indicators of types the user adds.

    A spec is ``{"type", "pattern", "validator", "normaliser"}``: a Java regular
    expression and two optional SQL expressions over the column ``value``.
    """
    specs = list(specs)
    keep = [c for c in docs.columns if c != "text"]
    parts = [_hits(X.find_all("_raw", spec["pattern"]), spec["type"]) for spec in specs]
    hits = f"explode(concat({', '.join(parts)})) AS _hit"
    rows = _raw_text(docs, do_refang).selectExpr(*keep, hits).selectExpr(*keep, "_hit.*")
    valid = normal = ""
    for spec in specs:
        mine = f" WHEN type = {literal(spec['type'])} THEN "
        valid += mine + (spec.get("validator") or "true")
        normal += mine + (spec.get("normaliser") or "value")
    return rows.where(f"CASE{valid} END").withColumn("value", F.expr(f"CASE{normal} END"))
