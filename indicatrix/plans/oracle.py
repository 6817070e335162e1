"""The same results in plain SQL, written for DuckDB.

The statements restate the rules on their own terms: plain patterns for RE2,
one list per type, window functions for first occurrences.  They share only
data with the Spark side: the word lists and the derived inputs.
"""

from __future__ import annotations

from indicatrix.functions import constants as K
from indicatrix.plans import derived as D
from indicatrix.plans import queries as Q
from indicatrix.sinks.stix import ID_NAMESPACE
from indicatrix.sources import registry
from indicatrix.sources.cert import LIST_KEYS
from indicatrix.sources.feedfiles import CSV_FEEDS

ORACLE: dict[str, str] = {}

# --- fixed values: the plain patterns -------------------------------------------
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = (
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
    r"|\b(?:[0-9a-fA-F]{1,4}:){1,7}:"
    r"|\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b"
    r"|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b"
    r"|\b::(?:ffff:)?(?:\d{1,3}\.){3}\d{1,3}\b"
)
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+(?:[a-zA-Z]{2,})\b"
URL = r"""\b(?:https?|hxxps?|ftp)://[^\s"'<>]+"""
EMAIL = r"\b[a-zA-Z0-9._%+-]+(?:@|\[@\]|\[at\])[a-zA-Z0-9.-]+(?:\.|\[\.\]|\[dot\])[a-zA-Z]{2,}\b"
CVE = r"\bCVE-\d{4}-\d{4,7}\b"
MITRE = r"\b[TS]\d{4}(?:\.\d{3})?\b"
URL_STRICT = r"(?:https?|hxxps?|ftp)://(?:[\w\-]+(?:\.[\w\-]+)+)(?::\d+)?(?:/[^\s]*)?"
REFANG = [
    (r"hxxps://", "https://"),
    (r"hxxp://", "http://"),
    (r"\[://\]", "://"),
    (r"\[\.\]", "."),
    (r"\(\.\)", "."),
    (r"\{\.\}", "."),
    (r"\[@\]", "@"),
    (r"\[at\]", "@"),
    (r"\(at\)", "@"),
    (r"\[dot\]", "."),
    (r"\(dot\)", "."),
]
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def case(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else str(v)

    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def refang(x: str) -> str:
    for pattern, live in REFANG:
        x = f"regexp_replace({x}, {q(pattern)}, {q(live)}, 'gi')"
    return x


def defang(x: str) -> str:
    armed = f"replace(replace(replace({x}, 'https://', 'hxxps://'), 'http://', 'hxxp://'), 'ftp://', 'fxp://')"
    at = f"strpos({armed}, '://')"

    def bracket(part: str) -> str:
        return f"replace(replace({part}, '.', '[.]'), '@', '[@]')"

    return (
        f"CASE WHEN contains({x}, '://') THEN left({armed}, {at} + 2) || {bracket(f'substr({armed}, {at} + 3)')} "
        f"ELSE {bracket(armed)} END"
    )


def valid_ipv4(x: str) -> str:
    return f"regexp_matches({x}, '^{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}$')"


def _suffix(x: str, suffixes: list[str]) -> str:
    return f"regexp_matches({x}, '\\.(" + "|".join(suffixes) + ")$')"


def valid_domain(x: str) -> str:
    d = f"lower(trim({x}))"
    parts = f"string_split({d}, '.')"
    front = f"array_to_string(list_slice({parts}, 1, len({parts}) - 1), '')"
    return (
        f"CASE WHEN {_suffix(d, K.FILE_SUFFIXES)} THEN false WHEN NOT contains({d}, '.') THEN false "
        f"WHEN {d} IN {in_list(K.RESERVED_DOMAINS)} THEN false "
        f"WHEN len({parts}) >= 3 AND ({parts}[-2] || '.' || {parts}[-1]) IN {in_list(K.TWO_PART_TLDS)} THEN true "
        f"WHEN {parts}[-1] NOT IN {in_list(K.TLDS)} THEN false "
        f"WHEN regexp_matches(replace({front}, '-', ''), '^[0-9]+$') THEN false ELSE true END"
    )


def lite_domain(x: str) -> str:
    d = f"lower({x})"
    return (
        f"(contains({d}, '.') AND NOT {_suffix(d, K.LITE_FILE_SUFFIXES)} AND {d} NOT IN {in_list(K.RESERVED_DOMAINS)} "
        f"AND string_split({d}, '.')[-1] IN {in_list(K.LITE_TLDS)})"
    )


# --- shared steps -----------------------------------------------------------------
CORPUS = f"corpus AS ({D.for_duckdb(D.corpus(D.DUCKDB))})"
TEXTS = f"{CORPUS}, texts AS (SELECT *, {refang('text')} AS raw FROM corpus)"


def _lists(matches: str, name: str, source: str = "texts") -> str:
    return (
        f"{name} AS (SELECT source_ord, source, doc_id, unnest(m) AS value, unnest(range(len(m))) AS pos "
        f"FROM (SELECT source_ord, source, doc_id, {matches} AS m FROM {source}))"
    )


def _find(column: str, pattern: str, flags: str = "") -> str:
    return f"regexp_extract_all({column}, {q(pattern)}, 0{', ' + q(flags) if flags else ''})"


_HEX_RUNS = "list_filter(regexp_extract_all({c}, '[a-fA-F0-9]+'), lambda h: len(h) IN (32, 40, 64, 128))"
_HASH_TYPE = case("len(value)", K.HASH_LENGTHS)
_NETLOC = "regexp_extract(value, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_HOST = "lower(regexp_extract(value, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^:/?#]*)', 1))"
HITS = ", ".join([
    TEXTS,
    _lists(_find("raw", IPV4), "h_ipv4"),
    _lists(_find("raw", IPV6), "h_ipv6"),
    _lists(_find("raw", DOMAIN), "h_domain"),
    _lists(_find("raw", URL, "i"), "h_url"),
    _lists(_find("text", EMAIL, "i"), "h_email"),
    _lists(_find("raw", CVE, "i"), "h_cve"),
    _lists(_find("raw", MITRE), "h_mitre"),
    _lists(_HEX_RUNS.format(c="raw"), "h_hash"),
])


def _typed(type_: str, source: str, value: str = "value", derived: str = "false", where: str = "true") -> str:
    return (
        f"SELECT source_ord, source, doc_id, {type_} AS type, {derived} AS derived, pos, {value} AS value "
        f"FROM {source} WHERE {where}"
    )


PER_TYPE = {
    "ipv4": _typed("'ipv4'", "h_ipv4", where=valid_ipv4("value")),
    "ipv6": _typed("'ipv6'", "h_ipv6"),
    "domain": _typed("'domain'", "h_domain", where=valid_domain("value")),
    "derived": _typed(
        "'domain'",
        "h_url",
        value=_HOST,
        derived="true",
        where=f"{_HOST} <> '' AND NOT regexp_matches({_NETLOC}, '[\\[\\]]') AND {valid_domain(_HOST)}",
    ),
    "url": _typed("'url'", "h_url"),
    "email": _typed("'email'", "h_email", value=refang("value")),
    "cve": _typed("'cve'", "h_cve"),
    "mitre": _typed("'mitre'", "h_mitre"),
    "hash": _typed(_HASH_TYPE, "h_hash", value="lower(value)"),
}
INDICATORS = f"{HITS}, indicators AS ({' UNION ALL '.join(PER_TYPE.values())})"
_POSITION = (
    "CAST(CAST(CAST(derived AS INT) AS HUGEINT) * 10000000000000000000000000000000000000 "
    "+ CAST(source_ord AS HUGEINT) * 1000000000000000000000000000000 "
    "+ (CAST(doc_id AS HUGEINT) + 9223372036854775808) * 10000000000 + pos AS HUGEINT)"
)
FIRST = (
    f"{INDICATORS}, firsts AS (SELECT * EXCLUDE (rn), {case('type', K.TYPE_ORD)} AS type_ord, {_POSITION} AS ord "
    "FROM (SELECT *, row_number() OVER (PARTITION BY type, value ORDER BY derived, source_ord, doc_id, pos) AS rn "
    "FROM indicators) WHERE rn = 1)"
)


def on(steps: str, select: str) -> str:
    return f"WITH {steps} {select}"


# --- files ------------------------------------------------------------------------
ORACLE["scan_docs"] = "SELECT page_id, strlen(html) + 1 AS length, md5(html || chr(10)) AS text_md5 FROM pages"
ORACLE["scan_many_docs"] = (
    "SELECT row_number() OVER (ORDER BY input, folder) - 1 AS ord, input, strlen(body) + 1 AS length, "
    "md5(body || chr(10)) AS text_md5 FROM ("
    "SELECT 0 AS input, CAST(item_id AS VARCHAR) || '/' AS folder, text AS body FROM benchmark UNION ALL "
    "SELECT 2, CAST(page_id AS VARCHAR) || '/', html FROM pages)"
)
ORACLE["scan_size_guard"] = (
    f"SELECT page_id, strlen(html) + 1 AS length, strlen(html) + 1 <= {Q.SIZE_LIMIT} AS accepted FROM pages"
)
ORACLE["decode_lenient"] = "SELECT doc_id, md5(replace(text, chr(65533), '') || 'x(') AS text_md5 FROM documents"

# --- list feeds ----------------------------------------------------------------------
PAYLOADS = f"payloads AS ({D.for_duckdb(D.feed_payloads(D.DUCKDB))})"
FILES = (
    "payloads AS (SELECT feed, snapshot, string_agg(body, chr(10) ORDER BY key) AS body "
    f"FROM ({D.for_duckdb(D.feed_files(D.DUCKDB))}) GROUP BY feed, snapshot)"
)


def _records(source: str, line: str) -> str:
    """Lines joined to CSV records: one begins after an even number of quotes."""
    quotes = (
        f"coalesce(sum(len({line}) - len(replace({line}, '\"', ''))) "
        "OVER (PARTITION BY feed, snapshot ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    numbered = (
        "SELECT *, sum(CASE WHEN quotes % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY feed, snapshot ORDER BY i) AS rec "
        f"FROM (SELECT *, {quotes} AS quotes FROM {source})"
    )
    return (
        f"(SELECT feed, snapshot, min(i) AS i, string_agg({line}, chr(10) ORDER BY i) AS {line} "
        f"FROM ({numbered}) GROUP BY feed, snapshot, rec)"
    )


_STEPS = (
    "raw_lines AS (SELECT feed, snapshot, unnest(string_split(body, chr(10))) AS raw, "
    "unnest(range(len(string_split(body, chr(10))))) AS i FROM payloads), "
    "stripped AS (SELECT feed, snapshot, i, raw, trim(raw) AS line FROM raw_lines), "
    "clean AS (SELECT * FROM stripped WHERE line <> '' AND NOT starts_with(line, '#')), "
    "ips AS (SELECT feed, snapshot, i, trim(string_split(line, ';')[1]) AS value FROM clean "
    "WHERE NOT starts_with(line, ';'))"
)
LINES, FILE_LINES = f"{PAYLOADS}, {_STEPS}", f"{FILES}, {_STEPS}"


def _numbered(source: str, order: str = "i") -> str:
    return (
        f"SELECT feed, snapshot, row_number() OVER (PARTITION BY feed, snapshot ORDER BY {order}) - 1 AS ord, value "
        f"FROM {source}"
    )


def csv_column(line: str, index: int) -> str:
    cell = (
        f"regexp_extract({line}, '^(?:(?:\"(?:[^\"]|\"\")*\"|[^,\"]*),){{{index}}}(\"(?:[^\"]|\"\")*\"|[^,]*)', 1)"
    )
    return f"CASE WHEN starts_with({cell}, '\"') THEN replace({cell}[2:-2], '\"\"', '\"') ELSE {cell} END"


def csv_width(line: str) -> str:
    return f"len(string_split(regexp_replace({line}, '\"[^\"]*\"', '', 'g'), ','))"


def unquote(x: str) -> str:
    return f"trim({x}, '\"')"


ORACLE["feed_text_lines"] = on(FILE_LINES, _numbered("(SELECT feed, snapshot, i, line AS value FROM clean)"))
ORACLE["feed_ip_list"] = on(LINES, _numbered("(SELECT * FROM ips WHERE value <> '')"))
ORACLE["feed_csv_rows"] = on(
    FILE_LINES,
    f"""SELECT feed, snapshot, row_number() OVER (PARTITION BY feed, snapshot ORDER BY i) - 1 AS ord, w AS width,
    CASE WHEN w > 0 THEN {csv_column('line', 0)} END AS c0, CASE WHEN w > 1 THEN {csv_column('line', 1)} END AS c1,
    CASE WHEN w > 2 THEN {csv_column('line', 2)} END AS c2
    FROM (SELECT *, {csv_width('line')} AS w FROM {_records(f"(SELECT * FROM clean WHERE feed IN {in_list(CSV_FEEDS)})", 'line')})""",
)
_W = f"(SELECT *, {csv_width('line')} AS w FROM {_records('clean', 'line')})"


def _cells(index: int, value: str) -> str:
    return f"SELECT feed, snapshot, i * 10 + {index} AS i, {value} AS value FROM {_W}"


# feed -> rows (feed, snapshot, i, value) before numbering
_FEED_VALUES = {
    "urlhaus": f"SELECT * FROM ({_cells(0, unquote(csv_column('line', 2)))} WHERE w > 2) WHERE starts_with(value, 'http')",
    "malbazaar": "SELECT * FROM ("
    + " UNION ALL ".join(f"{_cells(i, f'trim({unquote(csv_column("line", i))})')} WHERE w > 2" for i in range(3))
    + ") WHERE len(value) IN (32, 40, 64)",
    "threatfox": f"SELECT * FROM ({_cells(0, f'trim({unquote(csv_column("line", 2))})')} WHERE w > 2) WHERE value <> ''",
    "feodo": "SELECT feed, snapshot, i, line AS value FROM clean",
    "sslbl": f"SELECT * FROM ({_cells(0, f'trim({unquote(csv_column("line", 1))})')} WHERE w > 1) WHERE value <> ''",
    "phishtank": f"""SELECT * FROM (SELECT feed, snapshot, r.i, trim(CASE WHEN u = 1 THEN {csv_column('raw', 1)} ELSE {csv_column('raw', 2)} END) AS value
        FROM (SELECT *, {csv_width('raw')} AS w FROM {_records('(SELECT * FROM raw_lines WHERE i > 0)', 'raw')}) r
        JOIN (SELECT feed, snapshot, CASE WHEN lower(trim({csv_column('raw', 2)})) = 'url' THEN 2 ELSE 1 END AS u
              FROM raw_lines WHERE i = 0) h USING (feed, snapshot) WHERE w > u) WHERE value <> ''""",
    "bambenek_c2": "SELECT * FROM (SELECT feed, snapshot, i, trim(string_split(line, ',')[1]) AS value FROM clean) WHERE value <> ''",
}
for _name in ("blocklist_de", "emerging_threats", "spamhaus", "cinsscore", "talos"):
    _FEED_VALUES[_name] = "SELECT * FROM ips WHERE value <> ''"
for _name in ("openphish", "cybercrime_tracker"):
    _FEED_VALUES[_name] = _FEED_VALUES["feodo"]
_WITH_RAW = ["urlhaus", "malbazaar", "threatfox", "sslbl", "phishtank", "bambenek_c2"]


def _parsed(names: list[str]) -> str:
    parts = [f"SELECT feed, snapshot, i, value FROM ({_FEED_VALUES[n]}) WHERE feed = {q(n)}" for n in names]
    parsed = " UNION ALL ".join(parts)
    with_raw = in_list([n for n in names if n in _WITH_RAW] or [""])
    return (
        f"parsed AS ({parsed}), feed_values AS (SELECT *, false AS fallback FROM ({_numbered('parsed')}) UNION ALL "
        f"SELECT *, true FROM ({_numbered('(SELECT feed, snapshot, i, raw AS value FROM stripped ANTI JOIN parsed USING (feed, snapshot) WHERE feed IN ' + with_raw + chr(32) + 'AND line <> ' + q('') + ')')}))"
    )


for _name, _feeds in Q.FEED_QUERIES.items():
    ORACLE[_name] = on(f"{LINES}, {_parsed(list(_feeds))}", "SELECT * FROM feed_values")
ALL_FEEDS = f"{LINES}, {_parsed(list(_FEED_VALUES))}"
ORACLE["feed_raw_fallback"] = on(f"{FILE_LINES}, {_parsed(list(_FEED_VALUES))}", "SELECT * FROM feed_values WHERE fallback")

# --- CERT feeds -------------------------------------------------------------------------
CERT = f"certs AS ({D.for_duckdb(D.cert_payloads())})"


RSS = (
    f"{CERT}, entries AS ({D.for_duckdb(D.cert_entries())}), "
    "rss_items AS (SELECT c.feed, c.snapshot, row_number() OVER (PARTITION BY c.feed, c.snapshot ORDER BY j) - 1 AS ord, "
    "title, link, description FROM certs c JOIN entries e ON e.o_orderkey = c.snapshot "
    "WHERE feed IN ('NL', 'FR', 'JP', 'EU') AND body LIKE '<%'), "
    "rss_lines AS (SELECT feed, snapshot, ord, concat_ws(' | ', title, link, description) AS value FROM rss_items)"
)
ORACLE["feed_rss"] = (
    "SELECT feed, o_orderkey % 7 AS snapshot, "
    "row_number() OVER (PARTITION BY feed, o_orderkey % 7 ORDER BY o_orderkey, j) - 1 AS ord, title, link, description "
    f"FROM ({D.for_duckdb(D.cert_entries())}), (VALUES ('NL'), ('FR')) AS f(feed) WHERE NOT ({D.CERT_MALFORMED})"
)
ORACLE["feed_rdf"] = on(RSS, "SELECT * FROM rss_items WHERE feed = 'JP'")
ORACLE["feed_items_text"] = on(RSS, "SELECT * FROM rss_lines WHERE feed = 'JP'")
_NO_ITEMS = "SELECT feed, snapshot, 0 AS ord, body AS value, true AS fallback FROM certs ANTI JOIN {lines} USING (feed, snapshot)"
_CERT_RSS = (
    "SELECT *, false AS fallback FROM rss_lines WHERE feed IN ('NL', 'FR', 'JP') UNION ALL "
    + _NO_ITEMS.format(lines="rss_lines")
    + " WHERE feed IN ('NL', 'FR', 'JP')"
)
ORACLE["feed_cert_rss"] = on(RSS, _CERT_RSS)


def _json(path: str) -> str:
    return f"nullif(json_extract_string(p, '$.{path}'), '')"


_FIRST_LIST = (
    "CASE " + " ".join(f"WHEN json_type(js, '$.{k}') = 'ARRAY' THEN json_extract(js, '$.{k}')" for k in LIST_KEYS) + " END"
)
EU = (
    f"{RSS}, eu AS (SELECT feed, snapshot, CASE WHEN json_valid(body) THEN body END AS js, body FROM certs WHERE feed = 'EU'), "
    "eu_nested AS (SELECT *, json_type(js) = 'ARRAY' AS listed, CASE WHEN json_type(js) = 'ARRAY' "
    f"THEN CAST(js AS JSON[]) ELSE CAST({_FIRST_LIST} AS JSON[]) END AS pubs FROM eu), "
    "eu_json AS (SELECT feed, snapshot, ord, CASE WHEN listed THEN "
    f"concat_ws(' | ', {_json('title')}, coalesce({_json('link')}, {_json('url')}), coalesce({_json('description')}, {_json('summary')})) "
    f"ELSE concat_ws(' | ', {_json('title')}, coalesce({_json('link')}, {_json('url')})) END AS value "
    "FROM (SELECT feed, snapshot, listed, unnest(pubs) AS p, unnest(range(len(pubs))) AS ord FROM eu_nested)), "
    "eu_lines AS (SELECT * FROM eu_json UNION ALL SELECT * FROM rss_lines WHERE feed = 'EU')"
)
_CERT_EU = (
    "SELECT *, false AS fallback FROM eu_lines UNION ALL " + _NO_ITEMS.format(lines="eu_lines") + " WHERE feed = 'EU'"
)
ORACLE["feed_cert_eu"] = on(EU, _CERT_EU)
_USOM = (
    "SELECT feed, snapshot, unnest(range(len(string_split(body, chr(10))))) AS ord, "
    "unnest(string_split(body, chr(10))) AS value, false AS fallback FROM certs WHERE feed = 'TR'"
)
ORACLE["feed_usom"] = on(CERT, _USOM)
_KEV = (
    "SELECT 'US' AS feed, o_orderkey AS snapshot, row_number() OVER (PARTITION BY o_orderkey ORDER BY j) - 1 AS ord, value, "
    f"false AS fallback FROM ({D.for_duckdb(D.kev_strings())})"
)
ORACLE["feed_kev"] = on(CERT, _KEV)
_FIELDS = "feed, snapshot, ord, value, fallback"
ALL_VALUES = (
    f"{ALL_FEEDS}, {EU}, cert_values AS (SELECT {_FIELDS} FROM ({_USOM}) UNION ALL SELECT {_FIELDS} FROM ({_KEV}) "
    f"UNION ALL SELECT {_FIELDS} FROM ({_CERT_EU}) UNION ALL SELECT {_FIELDS} FROM ({_CERT_RSS})), "
    "repository_values AS (SELECT 'repository' AS feed, CAST('0x' || substr(md5(url), 1, 15) AS BIGINT) AS snapshot, "
    "0 AS ord, body AS value, false AS fallback FROM "
    f"(SELECT url, arg_max(body, landed) AS body FROM ({D.for_duckdb(Q.LANDED_FILES)}) GROUP BY url))"
)
ORACLE["feed_union_all"] = on(
    ALL_VALUES,
    f"SELECT {_FIELDS} FROM feed_values UNION ALL SELECT {_FIELDS} FROM cert_values UNION ALL SELECT {_FIELDS} FROM repository_values",
)

# --- registry -----------------------------------------------------------------------------


def _values(rows: list[tuple], columns: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(q(c) for c in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


REGISTRY = _values(registry.DEFAULT_FEEDS, "key, name, url, format, type", "feeds")
PRESETS = _values(registry.PRESETS, "name, repo, branch, path, description", "presets")
NEW_FEEDS = f"new_feeds AS (SELECT name, arg_max(url, added) AS url FROM ({D.for_duckdb(Q.NEW_FEEDS)}) GROUP BY name)"
LANDED = f"landed AS (SELECT url, arg_max(body, landed) AS body FROM ({D.for_duckdb(Q.LANDED_FILES)}) GROUP BY url)"
_UPSERT = (
    f"{REGISTRY}, {NEW_FEEDS}, upserted AS (SELECT * FROM feeds WHERE key NOT IN (SELECT name FROM new_feeds) UNION ALL "
    "SELECT name, name, url, 'text', 'custom' FROM new_feeds)"
)
ORACLE["registry_list"] = on(
    f"{REGISTRY}, {PAYLOADS}, {CERT}, landed AS (SELECT feed FROM payloads UNION ALL SELECT feed FROM certs)",
    "SELECT key, name, url, format, type, (SELECT count(*) FROM landed WHERE feed = key) AS snapshots FROM feeds",
)
ORACLE["registry_upsert"] = on(_UPSERT, "SELECT * FROM upserted")
ORACLE["registry_summary"] = on(_UPSERT, "SELECT type, format, count(*) AS n FROM upserted GROUP BY ALL")
REQUESTED = f"requested AS ({D.for_duckdb(Q.REQUESTED_PRESETS)})"
ORACLE["preset_lookup"] = on(
    f"{PRESETS}, {REQUESTED}",
    "SELECT name, o_orderkey, repo, branch, path, description, 'https://raw.githubusercontent.com/' || repo || '/' "
    "|| branch || '/' || path AS url FROM requested JOIN presets USING (name)",
)
ORACLE["preset_list"] = on(
    f"{PRESETS}, {REQUESTED}",
    "SELECT name, repo, description, (SELECT nullif(count(*), 0) FROM requested r WHERE r.name = p.name) AS requests FROM presets p",
)
ORACLE["feed_repo_url"] = on(
    f"wanted AS ({D.for_duckdb(Q.REPO_PATHS)}), {LANDED}",
    "SELECT o_orderkey, url, body FROM (SELECT o_orderkey, 'https://raw.githubusercontent.com/' || repo || '/' || "
    "coalesce(branch, 'master') || '/' || coalesce(path, 'trails/static/malware/malware.txt') AS url FROM wanted) "
    "JOIN landed USING (url)",
)
ORACLE["feed_changes"] = on(
    f"""all_landed AS ({D.for_duckdb(Q.LANDED_FILES)}),
    kept AS (SELECT url, run, sha256(arg_max(body, landed)) AS digest, dense_rank() OVER (ORDER BY run) AS r FROM all_landed GROUP BY url, run),
    pairs AS (SELECT k.*, p.digest AS before FROM kept k LEFT JOIN kept p ON p.url = k.url AND p.r = k.r - 1)""",
    "SELECT run, url, CASE WHEN before IS NULL THEN 'new' WHEN before = digest THEN 'same' ELSE 'changed' END AS state, digest FROM pairs "
    "UNION ALL SELECT s.run, k.url, 'gone', k.digest FROM kept k JOIN (SELECT DISTINCT run, r FROM kept) s ON s.r = k.r + 1 "
    "WHERE NOT EXISTS (SELECT 1 FROM kept n WHERE n.url = k.url AND n.r = k.r + 1)",
)
ORACLE["corpus_union"] = on(
    ALL_VALUES,
    "SELECT 1 AS source_ord, 'documents' AS source, doc_id, md5(text) AS text_md5 FROM documents UNION ALL "
    "SELECT 2, 'pages', page_id, md5(url || chr(10) || html) FROM pages UNION ALL "
    f"SELECT {case('feed', Q.FEED_ORDS)}, feed, snapshot, md5(string_agg(value, chr(10) ORDER BY ord)) FROM "
    f"(SELECT {_FIELDS} FROM cert_values UNION ALL SELECT {_FIELDS} FROM feed_values UNION ALL SELECT {_FIELDS} FROM repository_values) "
    "GROUP BY feed, snapshot",
)

# --- normalisation and extraction ------------------------------------------------------------
ORACLE["refang"] = on(TEXTS, "SELECT source, doc_id, md5(raw) AS refanged_md5 FROM texts")
ORACLE["defang"] = on(INDICATORS, f"SELECT DISTINCT type, value, {defang('value')} AS defanged FROM indicators")
_CONFIDENCE = case("type", {t[1]: t[3] for t in K.TYPES})
_NOTE = case("type", {t[1]: t[4] for t in K.TYPES})


def _export(value: str, source: str) -> str:
    return f"SELECT type, {value} AS value, {_CONFIDENCE} AS confidence, {q(source)} AS source, {_NOTE} AS note FROM firsts"


ORACLE["defang_output"] = on(FIRST, _export(defang("value"), Q.SOURCE))
ORACLE["flatten_export"] = on(FIRST, _export("value", Q.SOURCE))
_ONE_TYPE = {
    "extract_ipv4": "ipv4",
    "extract_ipv6": "ipv6",
    "extract_domain": "domain",
    "extract_derived_domain": "derived",
    "extract_url": "url",
    "extract_email": "email",
    "extract_cve": "cve",
    "extract_mitre": "mitre",
    "extract_hashes": "hash",
}
for _name, _type in _ONE_TYPE.items():
    ORACLE[_name] = on(HITS, f"SELECT source, doc_id, type, pos, value FROM ({PER_TYPE[_type]})")
ORACLE["extract_all"] = on(INDICATORS, "SELECT * FROM indicators")


def _wide_list(type_: str) -> str:
    return (
        f"coalesce(string_agg(value, ' ' ORDER BY derived, pos) FILTER (type = {q(type_)}), '') AS {K.LIST_KEY[type_]}"
    )


ORACLE["extract_wide"] = on(
    f"{INDICATORS}, per_doc AS (SELECT source, doc_id, type, value, min(derived) AS derived, "
    "arg_min(pos, (CAST(derived AS INT) * 1000000000 + pos)) AS pos FROM indicators GROUP BY source, doc_id, type, value), "
    f"wide AS (SELECT source, doc_id, {', '.join(_wide_list(t) for t in K.ALL_TYPES)} FROM per_doc GROUP BY source, doc_id)",
    "SELECT c.source, c.doc_id, "
    + ", ".join(f"coalesce(w.{K.LIST_KEY[t]}, '') AS {K.LIST_KEY[t]}" for t in K.ALL_TYPES)
    + f", {q(Q.RUN_TS)} AS extracted_at FROM corpus c LEFT JOIN wide w USING (source, doc_id)",
)

# --- validation -----------------------------------------------------------------------------
_H = "[0-9a-fA-F]{1,4}"
_V6_BODY = "|".join(
    [f"({_H}:){{7}}{_H}", f"({_H}:){{1,7}}:", f":(:{_H}){{1,7}}", "::"]
    + [f"({_H}:){{1,{i}}}(:{_H}){{1,{7 - i}}}" for i in range(1, 7)]
    + [f"({_H}:){{6}}{OCTET}(\\.{OCTET}){{3}}", f"::({_H}:){{0,5}}{OCTET}(\\.{OCTET}){{3}}"]
    + [f"({_H}:){{1,{i}}}:({_H}:){{0,{5 - i}}}{OCTET}(\\.{OCTET}){{3}}" for i in range(1, 6)]
)
_HASH_NAME = case("len(trim(value))", {n: t.removeprefix("hash_") for n, t in K.HASH_LENGTHS.items()})
_CHECKS = {
    "validate_ipv4": valid_ipv4("value"),
    "validate_ipv6": f"regexp_matches(value, '^({_V6_BODY})(%[^%/]+)?$')",
    "classify_hash": f"CASE WHEN regexp_matches(lower(trim(value)), '^[a-f0-9]+$') THEN {_HASH_NAME} END",
    "validate_cve": r"regexp_matches(value, '^CVE-\d{4}-\d{4,7}$', 'i')",
    "domain_filter": valid_domain("value"),
    "validate_domain_basic": r"regexp_matches(value, '\.[a-zA-Z]{2,}$')",
    "validate_email": r"regexp_matches(value, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')",
    "validate_url": r"regexp_matches(value, '^(https?|ftp)://', 'i')",
}
_COUNTED = {
    "is_ipv4": ("h_ipv4", "validate_ipv4"), "is_ipv6": ("h_ipv6", "validate_ipv6"), "hash_type": ("h_hash", "classify_hash"),
    "is_cve": ("h_cve", "validate_cve"), "is_indicator_domain": ("h_domain", "domain_filter"),
    "is_domain_name": ("h_domain", "validate_domain_basic"), "is_email": ("h_email", "validate_email"), "is_url": ("h_url", "validate_url"),
}
ORACLE["validation_counts"] = on(
    HITS,
    "SELECT \"check\", valid, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", coalesce(CAST({_CHECKS[check]}{' IS NOT NULL' if name == 'hash_type' else ''} AS BOOLEAN), false) AS valid FROM {source}"
        for name, (source, check) in _COUNTED.items()
    )
    + ") GROUP BY ALL",
)
_SCALARS = {
    "hash_type": "classify_hash", "is_ipv4": "validate_ipv4", "is_ipv6": "validate_ipv6", "is_indicator_domain": "domain_filter",
    "is_domain_name": "validate_domain_basic", "is_cve": "validate_cve", "is_email": "validate_email", "is_url": "validate_url",
}
ORACLE["udf_scalars"] = on(
    f"v AS ({D.for_duckdb(D.candidates([shape for shapes in Q.CANDIDATES.values() for shape in shapes]))})",
    f"SELECT doc_id, value, {refang(chr(39) + 'at hxxp://' + chr(39) + ' || value || ' + chr(39) + '[.]com' + chr(39))} AS refang_out, "
    f"{_HOST.replace('(value,', '(u,')} AS url_host_out, {defang('value')} AS defang_out, "
    + ", ".join(f"{_CHECKS[check]} AS {name}_out" for name, check in _SCALARS.items())
    + " FROM (SELECT *, 'hxxps://' || value || ':80/x?y=1' AS u FROM v)",
)
_TABLES = {
    "ipv4_in": ("h_ipv4", "value", valid_ipv4("value")), "ipv6_in": ("h_ipv6", "value", "true"), "domain_in": ("h_domain", "value", valid_domain("value")),
    "url_in": ("h_url", "value", "true"), "email_in": ("h_email", "value", "true"), "cve_in": ("h_cve", "value", "true"),
    "mitre_in": ("h_mitre", "value", "true"), "hash_in": ("h_hash", "lower(value)", "true"),
}
ORACLE["udf_tables"] = on(
    HITS,
    " UNION ALL ".join(
        f"SELECT source, doc_id, '{name}' AS \"function\", pos, {value} AS value FROM {source} WHERE {valid}"
        for name, (source, value, valid) in _TABLES.items()
    ),
)
for _name, _check in _CHECKS.items():
    ORACLE[_name] = (
        f"SELECT doc_id, value, {_check} AS result FROM ({D.for_duckdb(D.candidates(Q.CANDIDATES[_name]))})"
    )


def _set(kind: str, body: str) -> None:
    ORACLE[f"xset_{kind}"] = on(CORPUS, body)


def _each(pattern: str, flags: str = "i") -> str:
    return f"(SELECT unnest({_find('text', pattern, flags)}) AS value FROM corpus)"


_set(
    "ip",
    f"SELECT DISTINCT 'ipv4' AS type, value FROM {_each(IPV4)} WHERE {valid_ipv4('value')} UNION ALL "
    f"SELECT DISTINCT 'ipv6', value FROM {_each(IPV6)}",
)
_set("domain", f"SELECT DISTINCT 'domain' AS type, lower(value) AS value FROM {_each(DOMAIN)} WHERE {lite_domain('value')}")
_set(
    "url",
    f"SELECT DISTINCT 'url' AS type, value FROM {_each(URL_STRICT)} WHERE regexp_matches(value, '^(https?|hxxps?|ftp)://')",
)
_set("email", f"SELECT DISTINCT 'email' AS type, value FROM {_each(EMAIL)}")
_set(
    "hash",
    f"SELECT DISTINCT {_HASH_TYPE} AS type, lower(value) AS value FROM "
    f"(SELECT unnest({_HEX_RUNS.format(c='text')}) AS value FROM corpus)",
)
_set("cve", f"SELECT DISTINCT 'cve' AS type, upper(value) AS value FROM {_each(CVE)}")

# --- duplicates, filters, counts ---------------------------------------------------------------
ORACLE["dedup_first"] = on(FIRST, "SELECT type, value, type_ord, derived, source_ord, doc_id, pos FROM firsts")
ORACLE["dedup_unordered"] = on(INDICATORS, "SELECT DISTINCT type, value FROM indicators")
_FILTERED = "('ipv4', 'ipv6', 'hash_md5', 'hash_sha1', 'hash_sha256', 'hash_sha512', 'cve')"
ORACLE["filter_types"] = on(FIRST, f"SELECT type, value FROM firsts WHERE type IN {_FILTERED}")
ORACLE["count_by_type"] = on(FIRST, "SELECT type, type_ord, count(*) AS n FROM firsts GROUP BY type, type_ord")
ORACLE["count_total"] = on(
    INDICATORS, "SELECT type, count(*) AS n FROM indicators GROUP BY type UNION ALL SELECT 'total', count(*) FROM indicators"
)
_ONLY_HASH = "FROM firsts WHERE starts_with(type, 'hash_')"
ORACLE["hash_family_counts"] = on(
    FIRST,
    f"SELECT 'hash' AS family, type, count(*) AS n, true AS present {_ONLY_HASH} GROUP BY type UNION ALL "
    f"SELECT 'hash', 'all', count(*), true {_ONLY_HASH}",
)
RANKED = f"{FIRST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord) AS rank, count(*) OVER (PARTITION BY type) AS n FROM firsts)"
ORACLE["report_top50"] = on(
    RANKED, "SELECT type, rank, value, n, greatest(n - 50, 0) AS more FROM ranked WHERE rank <= 50"
)
_PRIORITY = case("type", {t: i for i, t in enumerate(K.LOOKUP_PRIORITY)})
_KIND = case("type", K.LOOKUP_KIND)


def _budget(provider: str, where: str = "true", limit: str = "") -> str:
    return (
        f"SELECT {q(provider)} AS provider, row_number() OVER (ORDER BY {_PRIORITY}, ord) AS lookup_no, type, value, "
        f"{_KIND} AS kind FROM firsts WHERE type IN {in_list(K.PROVIDER_TYPES[provider])} AND {where} "
        f"{limit}"
    )


_NOT_IP = "type <> 'ipv4'"
ORACLE["lookup_budget"] = on(FIRST, _budget("virustotal", _NOT_IP, f"QUALIFY lookup_no <= {Q.LOOKUPS}"))

# --- export and sinks ------------------------------------------------------------------------
ORACLE["source_label"] = (
    "SELECT o_orderkey, CASE WHEN files > 3 THEN CAST(files AS VARCHAR) || ' dosya' "
    "WHEN files > 0 THEN array_to_string(list_transform(range(1, files + 1), lambda i: 'f' || i), ', ') "
    f"WHEN url <> '' THEN url WHEN cert <> '' THEN 'CERT-' || cert ELSE label END AS source FROM ({D.for_duckdb(Q.RUNS)})"
)


def _csv_cell(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


ORACLE["sink_csv"] = on(
    FIRST,
    f"SELECT 1 AS section, type_ord, 0 AS part, CAST(ord AS VARCHAR) AS ord, type || ',' || {_csv_cell('value')} || ',' || {_CONFIDENCE} || "
    f"',\"say \"\"whole\"\", all\",' || {_NOTE} AS line FROM firsts "
    "UNION ALL SELECT 0, 0, 0, '0', 'type,value,confidence,source,note'",
)


def _fixed(section: int, lines: list[str], source: str = "(SELECT count(*) AS total FROM firsts)") -> str:
    """``lines`` are SQL expressions over the totals row."""
    return (
        f"SELECT {section} AS section, 0 AS type_ord, 0 AS part, CAST(unnest(range({len(lines)})) AS VARCHAR) AS ord, "
        f"unnest([{', '.join(lines)}]) AS line FROM {source}"
    )


def _block(section: int, part: int, line: str, source: str, ord_: str = "0") -> str:
    return (
        f"SELECT {section} AS section, type_ord, {part} AS part, CAST({ord_} AS VARCHAR) AS ord, {line} AS line FROM {source}"
    )


_COUNTS = "(SELECT type, type_ord, count(*) AS n, greatest(count(*) - 50, 0) AS more FROM firsts GROUP BY type, type_ord)"
_JSON_VALUE = "CAST(to_json(value) AS VARCHAR)"


def _json_lines(tlp: str | None) -> list[str]:
    head = ["{", '  "metadata": {', f'    "source": "{Q.SOURCE}",']
    lines = [q(h) for h in head]
    lines.append("'    \"total_iocs\": ' || total" + (" || ','" if tlp else ""))
    if tlp:
        lines.append(q(f'    "tlp": "{tlp}"'))
    return [*lines, q("  },"), q('  "iocs": {')]


_TYPE_TABLE = "(SELECT unnest(" + str(K.ALL_TYPES) + ") AS t, unnest(" + str(list(K.TYPE_ORD.values())) + ") AS type_ord)"
_EXTENT = f"(SELECT t, k.type_ord, (SELECT count(*) FROM firsts WHERE type = t) AS n FROM {_TYPE_TABLE} k)"
_TAIL = ['    "metadata": {', f'      "extracted_at": "{Q.RUN_TS}"', "    }", "  }"]


def _json_document(tlp: str | None = None, closed: bool = True) -> list[str]:
    key = case("t", K.LIST_KEY)
    tail = [*_TAIL, "}"] if closed else _TAIL
    return [
        _fixed(0, _json_lines(tlp)),
        _block(1, 0, f"'    \"' || {key} || CASE WHEN n = 0 THEN '\": [],' ELSE '\": [' END", _EXTENT),
        _block(
            1, 1,
            f"'      ' || {_JSON_VALUE} || CASE WHEN ord = max(ord) OVER (PARTITION BY type) THEN '' ELSE ',' END",
            "firsts", "ord",
        ),
        _block(1, 2, "'    ],'", f"(SELECT * FROM {_EXTENT} WHERE n > 0)"),
        _fixed(2, [q(line) for line in tail]),
    ]


ORACLE["sink_json"] = on(FIRST, " UNION ALL ".join(_json_document()))
_MD_LABEL = case("type", K.MARKDOWN_LABELS)
_TXT_LABEL = case("type", K.TEXT_LABELS)
_MD_HEAD = [
    q(K.MARKDOWN_TITLE), "''", "'---'", "''", "'## Executive Summary'", q(f"- **Kaynak:** `{Q.SOURCE}`"),
    q(f"- **Tarih:** {Q.RUN_TS}"), "'- **Toplam IOC:** **' || total || '**'", "'- **Confidence:** High'", "''",
    "'## IOC Dağılımı'", "''", "'| IOC Türü | Adet |'", "'|----------|------|'",
]
ORACLE["report_markdown_lines"] = on(
    RANKED,
    " UNION ALL ".join([
        _fixed(0, _MD_HEAD),
        _block(1, 0, f"'| ' || {_MD_LABEL} || ' | ' || n || ' |'", _COUNTS),
        _fixed(2, ["''", "'## Detaylı IOC Listesi'", "''"]),
        _block(3, 0, f"'### ' || {_MD_LABEL} || ' (' || n || ' adet)'", _COUNTS),
        _block(3, 1, "'- `' || value || '`'", "ranked", "ord"),
        _block(3, 3, "''", _COUNTS),
        _fixed(4, [q(line) for line in ["---", "", "## Kullanım Notları", *K.MARKDOWN_NOTES]]),
    ]),
)
_HASH = "starts_with(type, 'hash_')"
_HAS_HASH = f"(SELECT 1 WHERE EXISTS (SELECT 1 FROM firsts WHERE {_HASH}))"
ORACLE["report_text_lines"] = on(
    FIRST,
    " UNION ALL ".join([
        _fixed(0, [q(line) for line in ["=" * 40, "  IOC Extraction Report", "=" * 40, f"Source: {Q.SOURCE}", f"Date: {Q.RUN_TS}", ""]]),
        _block(1, 0, f"'[' || {_TXT_LABEL} || '] (' || n || ' found)'", f"(SELECT * FROM {_COUNTS} WHERE NOT {_HASH})"),
        _block(1, 1, "'  - ' || value", f"(SELECT * FROM firsts WHERE NOT {_HASH})", "ord"),
        _block(1, 2, "''", f"(SELECT * FROM {_COUNTS} WHERE NOT {_HASH})"),
        _fixed(2, ["'[Hashes]'"], _HAS_HASH),
        _block(3, 0, f"'  ' || {_TXT_LABEL} || ' (' || n || ' found):'", f"(SELECT * FROM {_COUNTS} WHERE {_HASH})"),
        _block(3, 1, "'    - ' || value", f"(SELECT * FROM firsts WHERE {_HASH})", "ord"),
        _fixed(4, ["''"], _HAS_HASH),
        _fixed(5, ["'Total IOCs: ' || total"]),
    ]),
)
_STIX_TYPES = in_list(list(K.STIX_OBJECT_PATHS))


def _stix_json(confidence: int, tlp: str) -> str:
    digest = f"sha1(unhex('{ID_NAMESPACE}') || encode(type || '|' || value))"
    variant = f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    uid = (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || {variant} "
        f"|| substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )
    pattern = f"'[' || {case('type', K.STIX_OBJECT_PATHS)} || ' = ''' || value || ''']'"
    return (
        "CAST(json_object('type', 'indicator', 'spec_version', '2.1', 'id', 'indicator--' || "
        f"{uid}, 'created', '{Q.STIX_TS}', 'modified', '{Q.STIX_TS}', 'name', type || ' indicator: ' || value, "
        f"'pattern', {pattern}, 'pattern_type', 'stix', 'valid_from', '{Q.STIX_TS}', 'confidence', {confidence}, "
        f"'labels', ['malicious-activity'], 'object_marking_refs', [{q(K.TLP_MARKINGS[tlp])}]) AS VARCHAR)"
    )


ORACLE["stix_indicators"] = on(
    FIRST,
    f"SELECT type_ord, CAST(ord AS VARCHAR) AS ord, {_stix_json(50, 'TLP:RED')} AS line FROM firsts WHERE type IN {_STIX_TYPES}",
)
ORACLE["tlp_marking"] = (
    f"SELECT o_orderkey, tlp, {case('upper(tlp)', K.TLP_MARKINGS, q(K.TLP_MARKINGS['TLP:CLEAR']))} AS marking "
    f"FROM ({D.for_duckdb(Q.TLPS)})"
)
ORACLE["stix_bundle"] = on(
    FIRST,
    " UNION ALL ".join([
        _fixed(0, [q(line) for line in ["{", '  "type": "bundle",', f'  "id": "{Q.BUNDLE_ID}",', '  "objects": [']]),
        "SELECT 1, 0, 0, CAST(ord AS VARCHAR), '    ' || line || CASE WHEN row_number() OVER (ORDER BY type_ord DESC, ord DESC) = 1 "
        f"THEN '' ELSE ',' END FROM (SELECT type_ord, ord, {_stix_json(75, 'TLP:CLEAR')} AS line FROM firsts WHERE type IN {_STIX_TYPES})",
        _fixed(2, ["'  ]'"]),
        _fixed(3, ["'}'"]),
    ]).replace("SELECT 1, 0, 0,", "SELECT 1, type_ord, 0,"),
)

# --- reputation --------------------------------------------------------------------------------
REP = (
    f"rep_raw AS (SELECT * FROM ({D.for_duckdb(D.rep_raw(D.DUCKDB))}) "
    "QUALIFY row_number() OVER (PARTITION BY provider, kind, key ORDER BY landed DESC) = 1), "
    "rep_json AS (SELECT provider, kind, key, CASE WHEN json_valid(body) THEN body END AS js FROM rep_raw)"
)


def _ok(*paths: str) -> str:
    tests = ["json_type(js) = 'OBJECT'"]
    tests += [f"coalesce(json_type(js, '{p}'), 'OBJECT') = 'OBJECT'" for p in paths]
    return " AND ".join(tests)


def _get(path: str, default: str, type_: str = "VARCHAR") -> str:
    return f"CASE WHEN json_exists(js, '{path}') THEN CAST(json_extract_string(js, '{path}') AS {type_}) ELSE {default} END"


def _list(path: str) -> str:
    return f"CASE WHEN json_exists(js, '{path}') THEN CAST(json_extract(js, '{path}') AS VARCHAR[]) ELSE [] END"


_AT = "$.data.attributes"
_VT_OK = _ok("$.data", _AT, f"{_AT}.last_analysis_stats")
_VT = [(s, _get(f"{_AT}.last_analysis_stats.{s}", "0", "BIGINT")) for s in ("malicious", "suspicious", "harmless", "undetected")]
_VT_REP = ("reputation", _get(f"{_AT}.reputation", "0", "BIGINT"))
_PULSES = ("pulse_count", _get("$.pulse_info.count", "0", "BIGINT"))
_NA = "'N/A'"
REP_FIELDS = {
    ("virustotal", "ip"): (_VT_OK, [*_VT, ("country", _get(f"{_AT}.country", _NA)), ("as_owner", _get(f"{_AT}.as_owner", _NA)), _VT_REP]),
    ("virustotal", "hash"): (
        _VT_OK,
        [*_VT, ("type_description", _get(f"{_AT}.type_description", _NA)), _VT_REP, ("names", _list(f"{_AT}.names"))],
    ),
    ("virustotal", "domain"): (_VT_OK, [*_VT, _VT_REP, ("registrar", _get(f"{_AT}.registrar", _NA))]),
    ("otx", "ip"): (
        _ok("$.pulse_info"),
        [_PULSES, ("reputation", _get("$.reputation", "0", "BIGINT")), ("country", _get("$.country_code", _NA)), ("asn", _get("$.asn", _NA))],
    ),
    ("otx", "domain"): (
        _ok("$.pulse_info"),
        [_PULSES, ("alexa", _get("$.alexa", _NA)), ("whois", "coalesce(nullif(json_extract_string(js, '$.whois'), ''), 'N/A')")],
    ),
    ("otx", "hash"): (_ok("$.pulse_info"), [_PULSES]),
    ("abuseipdb", "ip"): (
        _ok("$.data"),
        [
            ("abuse_confidence_score", _get("$.data.abuseConfidenceScore", "0", "BIGINT")),
            ("total_reports", _get("$.data.totalReports", "0", "BIGINT")),
            ("country_code", _get("$.data.countryCode", _NA)),
            ("isp", _get("$.data.isp", _NA)),
            ("usage_type", _get("$.data.usageType", _NA)),
            ("is_public", _get("$.data.isPublic", "true", "BOOLEAN")),
        ],
    ),
    ("shodan", "ip"): (
        _ok(),
        [
            ("ports", _list("$.ports")), ("os", _get("$.os", _NA)), ("country_code", _get("$.country_code", _NA)),
            ("org", _get("$.org", _NA)), ("isp", _get("$.isp", _NA)), ("vulns", _list("$.vulns")),
        ],
    ),
    ("greynoise", "ip"): (
        _ok(),
        [
            ("noise", _get("$.noise", "false", "BOOLEAN")), ("riot", _get("$.riot", "false", "BOOLEAN")),
            ("classification", _get("$.classification", "'unknown'")), ("name", _get("$.name", _NA)), ("link", _get("$.link", "''")),
        ],
    ),
}


def _from(provider: str, kind: str) -> str:
    ok = REP_FIELDS[(provider, kind)][0]
    return f"FROM rep_json WHERE provider = '{provider}' AND kind = '{kind}' AND {ok}"


for _name, _key in Q.REP_QUERIES.items():
    _cols = [
        f"array_to_string({expr}, ',') AS {name}" if name in Q.LIST_FIELDS else f"{expr} AS {name}"
        for name, expr in REP_FIELDS[_key][1]
    ]
    ORACLE[_name] = on(REP, f"SELECT key, {', '.join(_cols)} {_from(*_key)}")


def _answers(providers: list[str]) -> str:
    parts = []
    for (provider, kind), (_, fields) in REP_FIELDS.items():
        if provider in providers:
            members = ", ".join(
                f"'{name}', " + (f"CAST({expr} AS BIGINT[])" if name == "ports" else expr) for name, expr in fields
            )
            body = f"CAST(json_object('{kind}', key, {members}) AS VARCHAR)"
            parts.append(f"SELECT '{provider}' AS provider, '{kind}' AS kind, key, {body} AS payload {_from(provider, kind)}")
    return " UNION ALL ".join(parts)


def _enriched(providers: list[str], where: str = "true") -> str:
    budgets = " UNION ALL ".join(f"SELECT * FROM ({_budget(p, where)})" for p in providers)
    return (
        f"{FIRST}, {REP}, budget AS ({budgets}), answers AS ({_answers(providers)}), "
        "enriched AS (SELECT a.provider, b.type, b.value, a.payload FROM budget b JOIN answers a "
        "ON a.provider = b.provider AND a.kind = b.kind AND a.key = b.value)"
    )


ORACLE["enrich_provider"] = on(_enriched(["virustotal"], _NOT_IP), "SELECT * FROM enriched")
ENRICHED = _enriched(K.PROVIDERS)
_MERGE_ORD = case("provider", {p: i for i, p in enumerate(K.PROVIDERS)})
_MERGED = (
    f"SELECT value, provider, payload FROM enriched QUALIFY row_number() OVER (PARTITION BY value ORDER BY {_MERGE_ORD} DESC) = 1"
)
ORACLE["enrich_merge_last"] = on(ENRICHED, _MERGED)
ORACLE["enrich_merge_all"] = on(
    ENRICHED,
    "SELECT value, "
    + ", ".join(f"max(payload) FILTER (provider = '{p}') AS {p}" for p in K.PROVIDERS)
    + " FROM enriched GROUP BY value",
)
ORACLE["sink_json_full"] = on(
    f"{ENRICHED}, merged AS ({_MERGED})",
    " UNION ALL ".join([
        *_json_document("TLP:AMBER", closed=False),
        _fixed(3, [q("  ,"), q('  "enrichment": {')]),
        f"SELECT 4, type_ord, 0, CAST(ord AS VARCHAR), '    ' || {_JSON_VALUE} || ': ' || payload || "
        "CASE WHEN row_number() OVER (ORDER BY type_ord DESC, ord DESC) = 1 THEN '' ELSE ',' END FROM merged JOIN "
        "(SELECT value, type_ord, ord FROM firsts QUALIFY row_number() OVER (PARTITION BY value ORDER BY type_ord, ord) = 1) "
        "USING (value)",
        _fixed(5, [q("  }")]),
        _fixed(6, [q("}")]),
    ]),
)
ORACLE["enrich_enabled_only"] = on(
    f"{REP}, keys AS (SELECT {case('c_custkey % 4', dict(enumerate(K.PROVIDERS[:4])))} AS provider, c_custkey % 4 <> 3 AS on_file FROM customer)",
    "SELECT provider, kind, key FROM rep_raw WHERE provider IN (SELECT provider FROM keys GROUP BY provider HAVING bool_or(on_file))",
)

# --- SQL functions, user types, streams ----------------------------------------------------------
ORACLE["udf_surface"] = on(
    HITS,
    f"SELECT source, doc_id, pos, value, {defang('value')} AS defanged, true AS valid FROM ({PER_TYPE['ipv4']})",
)
ORACLE["custom_types"] = on(
    f"{TEXTS}, {_lists(_find('raw', Q.WALLET['pattern']), 'h_file')}, {_lists(_find('raw', Q.VERSION['pattern']), 'h_version')}",
    "SELECT source, doc_id, 'order_file' AS type, pos, upper(value) AS value FROM h_file WHERE len(value) > 6 UNION ALL "
    "SELECT source, doc_id, 'version', pos, value FROM h_version",
)
ORACLE["stream_extract"] = on(
    INDICATORS, "SELECT doc_id, type, derived, pos, value FROM indicators WHERE source = 'documents'"
)
_EVENTS = (
    f"events_text AS (SELECT {Q.EVENT_TEXT} AS text, CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT) AS sec FROM events), "
    f"live AS (SELECT {refang('text')} AS raw, sec - sec % 604800 AS since FROM events_text)"
)
ORACLE["stream_dedup"] = on(
    _EVENTS,
    f"SELECT DISTINCT since, 'ipv4' AS type, value FROM (SELECT since, unnest({_find('raw', IPV4)}) AS value FROM live) WHERE {valid_ipv4('value')} UNION ALL "
    f"SELECT DISTINCT since, 'url', value FROM (SELECT since, unnest({_find('raw', URL, 'i')}) AS value FROM live) UNION ALL "
    f"SELECT DISTINCT since, 'domain', value FROM (SELECT since, unnest({_find('raw', DOMAIN)}) AS value FROM live) WHERE {valid_domain('value')}",
)
