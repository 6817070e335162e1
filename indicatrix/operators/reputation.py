"""Reputation snapshots and their join to indicators.

A landed snapshot is ``rep_raw(provider, kind, key, body)`` with the provider's
JSON answer in ``body``; a failed lookup has a null or unreadable body.  Where
answers land repeatedly, :func:`newest` leaves one per key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.functions.constants import (
    LOOKUP_KIND,
    LOOKUP_PRIORITY,
    PROVIDER_TYPES,
    PROVIDERS,
)
from indicatrix.functions.normalize import literal, lookup
from indicatrix.operators.numbering import ranked
from indicatrix.plans.tables import checkpointed
from indicatrix.sources import landings

_STATS = "$.data.attributes.last_analysis_stats"
_ATTRS = "$.data.attributes"
_VT_STATS = [
    (name, f"{_STATS}.{name}", "bigint", 0)
    for name in ("malicious", "suspicious", "harmless", "undetected")
]

# Fixed values: (provider, kind) -> objects on the way, fields
# (name, path, type, default when absent).
PROJECTIONS = {
    ("virustotal", "ip"): (
        ["$.data", _ATTRS, _STATS],
        _VT_STATS
        + [
            ("country", f"{_ATTRS}.country", "string", "N/A"),
            ("as_owner", f"{_ATTRS}.as_owner", "string", "N/A"),
            ("reputation", f"{_ATTRS}.reputation", "bigint", 0),
        ],
    ),
    ("virustotal", "hash"): (
        ["$.data", _ATTRS, _STATS],
        _VT_STATS
        + [
            ("type_description", f"{_ATTRS}.type_description", "string", "N/A"),
            ("reputation", f"{_ATTRS}.reputation", "bigint", 0),
            ("names", f"{_ATTRS}.names", "array<string>", []),
        ],
    ),
    ("virustotal", "domain"): (
        ["$.data", _ATTRS, _STATS],
        _VT_STATS
        + [
            ("reputation", f"{_ATTRS}.reputation", "bigint", 0),
            ("registrar", f"{_ATTRS}.registrar", "string", "N/A"),
        ],
    ),
    ("otx", "ip"): (
        ["$.pulse_info"],
        [
            ("pulse_count", "$.pulse_info.count", "bigint", 0),
            ("reputation", "$.reputation", "bigint", 0),
            ("country", "$.country_code", "string", "N/A"),
            ("asn", "$.asn", "string", "N/A"),
        ],
    ),
    ("otx", "domain"): (
        ["$.pulse_info"],
        [
            ("pulse_count", "$.pulse_info.count", "bigint", 0),
            ("alexa", "$.alexa", "string", "N/A"),
            ("whois", "$.whois", "string", "N/A"),
        ],
    ),
    ("otx", "hash"): (["$.pulse_info"], [("pulse_count", "$.pulse_info.count", "bigint", 0)]),
    ("abuseipdb", "ip"): (
        ["$.data"],
        [
            ("abuse_confidence_score", "$.data.abuseConfidenceScore", "bigint", 0),
            ("total_reports", "$.data.totalReports", "bigint", 0),
            ("country_code", "$.data.countryCode", "string", "N/A"),
            ("isp", "$.data.isp", "string", "N/A"),
            ("usage_type", "$.data.usageType", "string", "N/A"),
            ("is_public", "$.data.isPublic", "boolean", True),
        ],
    ),
    ("shodan", "ip"): (
        [],
        [
            ("ports", "$.ports", "array<int>", []),
            ("os", "$.os", "string", "N/A"),
            ("country_code", "$.country_code", "string", "N/A"),
            ("org", "$.org", "string", "N/A"),
            ("isp", "$.isp", "string", "N/A"),
            ("vulns", "$.vulns", "array<string>", []),
        ],
    ),
    ("greynoise", "ip"): (
        [],
        [
            ("noise", "$.noise", "boolean", False),
            ("riot", "$.riot", "boolean", False),
            ("classification", "$.classification", "string", "unknown"),
            ("name", "$.name", "string", "N/A"),
            ("link", "$.link", "string", ""),
        ],
    ),
}

def _node(path: str, type_: str = "variant") -> str:
    return f"try_variant_get(_json, '{path}', '{type_}')"


def _is(path: str, kind: str) -> str:
    """Whether a JSON node is absent or of the given kind (OBJECT or ARRAY)."""
    return f"({_node(path)} IS NULL OR startswith(schema_of_variant({_node(path)}), '{kind}'))"


_ASKED = ["provider", "kind", "key"]


def newest(rep_raw: DataFrame, at: str = "landed", wanted: DataFrame | None = None) -> DataFrame:
    """One answer per ``provider, kind, key``: that of the latest ``at``, whether it succeeded or not.

    Only of ``wanted`` keys, if given. Answers are read last, as in :func:`indicatrix.sources.landings.newest`.
    """
    return landings.newest(rep_raw.select(*_ASKED, at, "body"), _ASKED, at, wanted).drop(at)


def _fields(provider: str, kind: str, max_names: int | None = None, max_whois: int | None = None) -> dict[str, str]:
    out = {}
    for name, path, type_, default in PROJECTIONS[(provider, kind)][1]:
        fallback = "array()" if default == [] else literal(default)
        # An explicit JSON null stays null; only an absent field has a default.
        out[name] = (
            f"CASE WHEN {_node(path)} IS NULL THEN CAST({fallback} AS {type_}) ELSE {_node(path, type_)} END"
        )
    if "names" in out and max_names is not None:
        out["names"] = f"slice({out['names']}, 1, {max_names})"
    if "whois" in out:
        whois = _node("$.whois", "string")
        whois = whois if max_whois is None else f"substr({whois}, 1, {max_whois})"
        out["whois"] = f"coalesce(nullif({whois}, ''), 'N/A')"
    return out


def _succeeded(provider: str, kind: str) -> str:
    """Whether an answer is an object whose nested parts are objects, too."""
    tests = ["_json IS NOT NULL", "startswith(schema_of_variant(_json), 'OBJECT')"]
    tests += [_is(path, "OBJECT") for path in PROJECTIONS[(provider, kind)][0]]
    if (provider, kind) == ("virustotal", "hash"):
        tests.append(_is(f"{_ATTRS}.names", "ARRAY"))
    return " AND ".join(tests)


def project_reputation(
    rep_raw: DataFrame, provider: str, kind: str, max_names: int | None = None, max_whois: int | None = None
) -> DataFrame:
    """Successful answers of one provider and kind as typed columns, by ``key``.

    Values are whole unless the caller limits names or the length of whois texts.
    A filter on success would be pushed below the parsing and parse each answer
    once per test; a generator is not.
    """
    fields = _fields(provider, kind, max_names, max_whois)
    members = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    found = f"array_compact(array(CASE WHEN {_succeeded(provider, kind)} THEN named_struct({members}) END))"
    rows = rep_raw.where(f"provider = '{provider}' AND kind = '{kind}'")
    parsed = rows.selectExpr("key", "try_parse_json(body) AS _json")
    return parsed.selectExpr("key", f"inline({found}) AS ({', '.join(fields)})")


def with_payload(answers: DataFrame, providers: Iterable[str] = PROVIDERS) -> DataFrame:
    """Replace ``body`` by ``payload``, the projected fields as JSON; failed lookups drop out.

    One pass over all providers: a row runs the projection of its own provider
    and kind.  Failed rows go by way of an empty array, because a filter would be
    pushed below a join and parse the whole snapshot.
    """
    providers = set(providers)
    branches = " WHEN false THEN ''"
    for provider, kind in PROJECTIONS:
        if provider in providers:
            members = ", ".join(f"'{name}', {sql}" for name, sql in _fields(provider, kind).items())
            body = f"to_json(named_struct('{kind}', key, {members}), map('ignoreNullFields', 'false'))"
            mine = f"provider = '{provider}' AND kind = '{kind}' AND {_succeeded(provider, kind)}"
            branches += f" WHEN {mine} THEN {body}"
    kept = f"explode(array_compact(array(CASE{branches} END))) AS payload"
    rest = [c for c in answers.columns if c != "body"]
    return answers.selectExpr(*rest, "try_parse_json(body) AS _json").selectExpr(*rest, kept)


def lookup_budget(listed: DataFrame, provider: str, max_lookups: int) -> DataFrame:
    """The indicators a provider is asked about: the first ``max_lookups`` by type, then list order.

    ``listed`` is duplicate-free with ``type, value, ord``.
    """
    return lookup_budgets(listed, [provider], max_lookups)


def lookup_budgets(listed: DataFrame, providers: Iterable[str], max_lookups: int) -> DataFrame:
    """``provider, lookup_no, type, value, kind``: the budgets of several providers, numbered in one sort by ranges."""
    priority = lookup("type", {t: i for i, t in enumerate(LOOKUP_PRIORITY)})
    asked = eligible(listed, providers, "ord", f"{priority} AS priority")
    numbered = ranked(asked, "provider", "priority", "ord", into="lookup_no").where(F.col("lookup_no") <= max_lookups)
    return numbered.select("provider", "lookup_no", "type", "value", "kind")


def _answering(providers: Iterable[str]) -> str:
    """The providers that answer for a type; null for other types."""
    names = {t: [p for p in PROVIDERS if p in set(providers) and t in PROVIDER_TYPES[p]] for t in LOOKUP_KIND}
    lists = " ".join(f"WHEN '{t}' THEN array({', '.join(map(literal, ps))})" for t, ps in names.items() if ps)
    return f"CASE type {lists or "WHEN '' THEN array('')"} END"


def eligible(listed: DataFrame, providers: Iterable[str], *more: str) -> DataFrame:
    """``provider, kind, type, value``: every indicator beside each provider that answers for its type, in one pass."""
    asked = f"explode({_answering(providers)}) AS provider"
    return listed.selectExpr(asked, f"{lookup('type', LOOKUP_KIND)} AS kind", "type", "value", *more)


# A type beside a provider that answers for it, known by its place.
_QUESTIONS = [(t, p, kind) for t, kind in LOOKUP_KIND.items() for p in PROVIDERS if t in PROVIDER_TYPES[p]]


def _question(type_: str, provider: str) -> str:
    return lookup(f"concat_ws(' ', {type_}, {provider})", {f"{t} {p}": i for i, (t, p, _) in enumerate(_QUESTIONS)})


def newest_asked(asked: DataFrame, rep_raw: DataFrame, at: str) -> DataFrame:
    """``provider, kind, key, body, type, copies`` of what is asked, ``key, type, providers, copies``: of each the newest answer.

    As :func:`newest`, but all is dealt out by ``key`` alone, the indicators once and not for each provider, and what
    follows by key stays there. Keys and times come first and are stored with what is asked; only then are answers read.
    """
    mine = rep_raw.select(*_ASKED, at, "body")
    kinds = lookup("type", LOOKUP_KIND)
    wanted = asked.selectExpr("key", f"{kinds} AS _kind", "type", "providers", "copies").withColumnRenamed("key", "_key")
    landed = mine.select(*_ASKED, at)
    # No equality but that of keys, as rows would be dealt out by the others, too.
    meant = "array_contains(transform(providers, p -> named_struct('p', p, 'k', _kind)), named_struct('p', provider, 'k', kind))"
    found = landed.join(wanted, F.expr(f"key = _key AND {meant}"))
    found = found.selectExpr("key AS _key", f"{_question('type', 'provider')} AS _question", "copies", f"`{at}` AS _at")
    found = found.groupBy("_key", "_question", "copies", "_at").agg(F.count(F.lit(1)).alias("_n"))
    latest = found.groupBy("_key", "_question", "copies").agg(F.max("_at").alias("_at"), F.coalesce(F.max_by("_n", "_at"), F.max("_n")).alias("_n"))
    latest = checkpointed(latest, "latest")

    def answers(rows: DataFrame) -> DataFrame:
        types, providers, kinds = (lookup("_question", {i: q[j] for i, q in enumerate(_QUESTIONS)}) for j in range(3))
        own = f"array_contains(array(named_struct('p', {providers}, 'k', {kinds}, 't', _at)), named_struct('p', provider, 'k', kind, 't', `{at}`))"
        return mine.join(rows, F.expr(f"key = _key AND {own}")).selectExpr(*_ASKED, f"`{at}`", "body", f"{types} AS type", "copies")

    # One row for each question, unless some landed at the same time: those are few.
    alone = answers(latest.where("_n = 1"))
    if latest.where("_n > 1").isEmpty():
        return alone.drop(at)
    ties = answers(latest.where("_n > 1")).groupBy(*_ASKED, "type", "copies").agg(F.max_by(F.struct(at, "body"), F.xxhash64(at, "body")).alias("_row"))
    return alone.drop(at).unionByName(ties.select(*_ASKED, "_row.body", "type", "copies"))


def enrich(
    listed: DataFrame,
    rep_raw: DataFrame,
    enabled: Iterable[str] = PROVIDERS,
    max_lookups: int | None = None,
    at: str | None = None,
) -> DataFrame:
    """Answers of the enabled providers: ``provider, type, value, payload``.

    All eligible indicators are looked up, in one pass over the list, unless the
    caller gives each provider a budget; a failed lookup costs budget and gives
    no row.  The snapshot is cut to what is asked, and only what is left is
    parsed.  ``rep_raw`` has one answer per ``provider, kind, key``, unless ``at``
    names the column by which the newest counts.
    """
    enabled = set(enabled)
    if at is not None:
        if max_lookups is None:
            asked = listed.selectExpr("value AS key", "type", f"{_answering(enabled)} AS providers").where("providers IS NOT NULL")
        else:
            asked = lookup_budgets(listed, enabled, max_lookups).selectExpr("value AS key", "type", "array(provider) AS providers")
        # An indicator that is listed repeatedly has its answer as often.
        asked = asked.repartition("key").groupBy("key", "type", "providers").agg(F.count(F.lit(1)).cast("int").alias("copies"))
        answers = newest_asked(asked, rep_raw, at)
        rows = with_payload(answers, enabled).selectExpr("provider", "type", "key AS value", "payload", "copies")
        return rows.selectExpr("provider", "type", "value", "payload", "explode(array_repeat(0, copies)) AS _copy").drop("_copy")
    asked = eligible(listed, enabled) if max_lookups is None else lookup_budgets(listed, enabled, max_lookups).drop("lookup_no")
    answers = rep_raw.join(asked.withColumnRenamed("value", "key"), _ASKED)
    return with_payload(answers, enabled).selectExpr("provider", "type", "key AS value", "payload")


def enrich_provider(
    listed: DataFrame, rep_raw: DataFrame, provider: str, max_lookups: int | None = None, at: str | None = None
) -> DataFrame:
    """Answers of one provider."""
    return enrich(listed, rep_raw, [provider], max_lookups, at)


def merge_last(enriched: DataFrame) -> DataFrame:
    """One answer per value: that of the last provider in merge order."""
    order = lookup("provider", {p: i for i, p in enumerate(PROVIDERS)})
    last = enriched.groupBy("value").agg(F.expr(f"max_by(struct(provider, payload), {order}) AS _last"))
    return last.select("value", "_last.provider", "_last.payload")


def merge_all(enriched: DataFrame) -> DataFrame:
    """Every provider's answer per value as a map; a value has at most one per provider."""
    entries = "map_from_entries(array_sort(collect_list(struct(provider, payload)))) AS answers"
    return enriched.groupBy("value").agg(F.expr(entries))


def enabled_only(rep_raw: DataFrame, providers: Iterable[str]) -> DataFrame:
    """Snapshot rows of the providers that are configured: a filter, pushed to the snapshot's scan."""
    return rep_raw.where(F.col("provider").isin(sorted(set(providers))))
