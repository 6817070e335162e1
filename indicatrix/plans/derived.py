"""Inputs that Spark derives from the given tables.

The given text holds few kinds of indicators, and no feed or reputation
snapshot is given.  These statements build them from the rows of ``orders`` and
other tables, so they grow with the data.  The same statement runs in Spark and
in the engine that checks the results; only the SHA-256 function is named
differently.  Where a CASE branches on a key, it varies the shape of the row;
no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK, DUCKDB = "spark", "duckdb"
K = "CAST(o_orderkey AS STRING)"
C = "CAST(o_custkey AS STRING)"
NL = "chr(10)"


def _n(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def sha256(engine: str, arg: str) -> str:
    return f"sha2({arg}, 256)" if engine == SPARK else f"sha256({arg})"


# The address and names a report mentions; the reputation snapshots are keyed by them.
REPORT_IP = f"{_n('o_orderkey % 300')} || '.' || {_n('o_custkey % 256')} || '.7.9'"
REPORT_DOMAIN = f"'c' || {_n('o_custkey % 97')} || '.evil' || {_n('o_orderkey % 13')} || '.com'"


def report_text(engine: str) -> str:
    """The incident report of an order: every indicator type, much of it defanged."""
    sha = sha256(engine, K)
    return " || ".join([
        f"'beacon hxxps://c' || {_n('o_custkey % 97')} || '[.]evil' || {_n('o_orderkey % 13')} || '[.]com/p/' || {K}",
        f"' from ' || {_n('o_orderkey % 300')} || '[.]' || {_n('o_custkey % 256')} || '.7(.)9'",
        NL,
        f"'v6 2001:db8:0:0:0:0:0:' || {_n('o_orderkey % 9000')} || ' and fe80:' || {_n('o_custkey % 500')} || '::1'",
        f"' md5 ' || md5({K}) || ' sha1 ' || sha1({K}) || ' sha ' || {sha}",
        f"' sha512 ' || upper({sha}) || {sha256(engine, C)}",
        NL,
        f"'cve-' || {_n('2000 + o_orderkey % 25')} || '-' || {_n('1000 + o_orderkey % 9000')}",
        f"' T' || {_n('1000 + o_orderkey % 700')} || '.00' || {_n('o_orderkey % 10')} || ' S' || {_n('1000 + o_custkey % 90')}",
        f"' mail u' || {C} || '[at]evil' || {_n('o_orderkey % 13')} || '[dot]net, Admin@Mail.Evil.co.uk'",
        f"' file p' || {K} || '.exe v' || {_n('o_orderkey % 7')} || '.' || {_n('o_custkey % 11')} || '.com'",
        f"""CASE o_orderkey % 4
            WHEN 0 THEN ' resolver 8.8.8.8 via http://cdn.hot.com/a?b=1, seen'
            WHEN 1 THEN ' login http://user:pw@Host' || {_n('o_custkey % 50')} || '.Evil.CO.UK:8080/x. 1.2.3.4.5.6.7.8'
            WHEN 2 THEN ' odd ftp://files.evil' || {_n('o_custkey % 40')} || '.biz/p evil.com.' || {K} || ' ' || {K} || '.com'
            ELSE ' HXXP[://]cut.com hxxp://ok(dot)org/"q" {{.}} x@y{{.}}com 08.8.8.8 example.com www.example.com'
        END""",
    ])


def reports(engine: str) -> str:
    return f"SELECT o_orderkey AS doc_id, {report_text(engine)} AS text FROM @orders@"


def given_texts() -> str:
    """The texts of the tables as documents: prose, web pages and chats."""
    return f"""
        SELECT 1 AS source_ord, 'documents' AS source, doc_id, text FROM @documents@
        UNION ALL SELECT 2, 'pages', page_id, url || {NL} || html FROM @pages@
        UNION ALL SELECT 3, 'conversations', conv_id * 4294967296 + turn, text FROM @conversations@
    """


def corpus(engine: str) -> str:
    """All texts as documents: prose, web pages, chats and incident reports."""
    return f"{given_texts()} UNION ALL SELECT 4, 'reports', doc_id, text FROM ({reports(engine)}) r"


def _feed(name: str, body: str) -> str:
    return f"SELECT '{name}' AS feed, o_orderkey AS snapshot, {body} AS body FROM @orders@"


def _lines(*lines: str) -> str:
    return f" || {NL} || ".join(lines)


def _unparsed(every: int, body: str) -> str:
    """Some snapshots hold no record, so that their raw text counts."""
    raw = _lines(f"'# outage notice ' || {K}", "''", f"'mirror at  http://raw' || {K} || '.evil.com/x  '")
    return f"CASE WHEN o_orderkey % {every} = 0 THEN {raw} ELSE {body} END"


def feed_bodies(engine: str) -> dict[str, str]:
    """Body expression of each list feed over an order."""
    sha = sha256(engine, K)
    ip = f"{_n('o_orderkey % 256')} || '.' || {_n('o_custkey % 256')} || '.1.2'"
    addresses = _lines(
        "'# blocklist'", "''", f"'  ' || {ip} || '  '", f"'10.0.0.' || {_n('o_custkey % 256')}", f"'# ' || {K}"
    )
    urls = _lines("'#urls'", f"'https://phish' || {K} || '.com/login'", "'   '", f"' http://pay' || {C} || '.org/v '")
    return {
        "urlhaus": _unparsed(17, _lines(
            "'# id,dateadded,url'",
            "'\"id\",\"dateadded\",\"url\"'",
            f"'\"' || {K} || '\",\"2025-01-01\",\"http://evil' || {C} || '.com/a,b\",\"online\"'",
            f"'  \"' || {K} || '\",\"2025\",\"https://bad.org/q=\"\"' || {K} || '\"\"\",\"off\"  '",
            "'\"x\",\"y\"'",
            "''",
            f"{K} || ',2025,ftp://no.com/' || {K} || ',z'",
            f"'\"' || {K} || '\",\"two'",
            f"'lines, \"\"quoted\"\"\",\"http://brk' || {C} || '.evil.com/x\",\"on\"'",
        )),
        "malbazaar": _unparsed(19, _lines(
            "'# sha256,md5,sha1'",
            f"'\"' || {sha} || '\",\"' || md5({K}) || '\",\"' || sha1({K}) || '\",\"2025\"'",
            f"{sha} || ',' || md5({C})",
            f"'\"' || md5({C}) || '\",\" ' || {K} || ' \",'",
        )),
        "threatfox": _unparsed(23, _lines(
            "'# date,id,ioc'",
            f"'\"2025-01-01\",\"' || {K} || '\",\"http://c2' || {C} || '.com:4443/gate\",\"url\"'",
            f"'\"2025-01-01\",\"' || {K} || '\",\" ' || {ip} || ':443 \",\"ip:port\"'",
            f"'\"2025-01-01\",\"' || {K} || '\",\"\",\"none\"'",
            f"'2025-01-01,' || {K} || ',mal' || {K} || '.xyz,domain'",
        )),
        "feodo": _lines("'# c2'", f"{ip}", "'#'", f"' 172.16.0.' || {_n('o_custkey % 300')}"),
        "sslbl": _unparsed(29, _lines(
            "'# date,ip,port'", f"'\"2025-01-01\",\"' || {ip} || '\",\"443\"'", "'2025-01-02,,1'", "'alone'"
        )),
        "blocklist_de": addresses,
        "emerging_threats": addresses,
        "spamhaus": _lines(
            "'; DROP list'",
            f"{_n('o_orderkey % 256')} || '.10.16.0/20 ; SB' || {K}",
            "'   ; indented note'",
            f"'5.8.' || {_n('o_custkey % 256')} || '.0/24;SB' || {C}",
        ),
        "cinsscore": addresses,
        "talos": f"{ip}",
        "openphish": urls,
        "phishtank": _unparsed(31, f"""CASE WHEN o_orderkey % 2 = 0
            THEN {_lines("'phish_id, URL ,target'", f"{K} || ',https://bank' || {K} || '.com/login,\"A, B\"'", "''", f"{K} || ',https://two' || {K} || '.com/x,\"A,'", "'B\"'", f"{K} || ',,none'")}
            ELSE {_lines("'target,id,url'", f"'\"A, B\",1,https://mail' || {K} || '.net/v'", "'short,row'", f"'b,2,\" https://x' || {C} || '.org \"'")}
            END"""),
        "bambenek_c2": _unparsed(37, _lines(
            "'# domain,ip'", f"'c2-' || {K} || '.com,' || {ip} || ',Emotet'", "',no domain'", f"' bot' || {C} || '.net , x'"
        )).replace("'mirror at", "',mirror at").replace("'# outage notice ' || ", "'#' || "),
        "cybercrime_tracker": urls,
    }


def feed_payloads(engine: str, names: tuple[str, ...] = ()) -> str:
    """``feed, snapshot, body`` of the named list feeds, or of all."""
    bodies = feed_bodies(engine)
    return " UNION ALL ".join(_feed(name, bodies[name]) for name in names or bodies)


def _snapshot(feed: str) -> str:
    """The number of the large snapshot that a part of a list feed goes to."""
    raw = f"body LIKE '# outage notice%' OR {feed} = 'bambenek_c2' AND o_orderkey % 37 = 0"
    return f"CASE WHEN {raw} THEN 1000 + o_orderkey % 3 ELSE o_orderkey % 7 END"


def feed_keys(names: tuple[str, ...] = ()) -> tuple[str, str]:
    """As :func:`feed_files` in two steps: ``feed, snapshot, o_orderkey, o_custkey``, and a part's body over these."""
    bodies = feed_bodies(SPARK)
    bodies = {name: bodies[name] for name in names or bodies}
    keys = [
        f"SELECT '{name}' AS feed, {_snapshot(f"'{name}'")} AS snapshot, o_orderkey, o_custkey "
        f"FROM (SELECT o_orderkey, o_custkey, {body} AS body FROM @orders@) parts"
        for name, body in bodies.items()
    ]
    branches = " ".join(f"WHEN '{name}' THEN {body}" for name, body in bodies.items())
    return " UNION ALL ".join(keys), f"CASE feed {branches} END"


def feed_files(engine: str, names: tuple[str, ...] = ()) -> str:
    """``feed, snapshot, key, body``: parts of few large snapshots, in the order of ``key``; some hold raw text alone."""
    raw = "body LIKE '# outage notice%' OR feed = 'bambenek_c2' AND snapshot % 37 = 0"
    number = f"CASE WHEN {raw} THEN 1000 + snapshot % 3 ELSE snapshot % 7 END"
    return f"SELECT feed, {number} AS snapshot, snapshot AS key, body FROM ({feed_payloads(engine, names)}) parts"


def _item(title: str | None, link: str | None, description: str | None) -> tuple[str, tuple]:
    """An item as XML, and what is read from it."""
    out = "'<item>'"
    for tag, value in zip(("title", "link", "description"), (title, link, description)):
        if value is not None:
            out += f" || '<{tag}>' || {value} || '</{tag}>'"
    return out + " || '</item>'", (title, link, description)


# XML of the items of a feed, and the entry each gives, if any.
CERT_ITEMS = [
    _item(f"'CVE-2025-' || {_n('1000 + o_orderkey % 9000')} || ': critical'", f"'https://cert.evil.org/a/' || {K}", f"'Affects ' || {REPORT_IP}"),
    ("'<item/><item />'", None),
    _item(f"'Notice ' || {K}", None, f"'hash ' || md5({K})"),
    (f"'<!-- <item><title>withdrawn ' || {K} || '.com</title></item> -->'", None),
    _item(None, f"'https://cert.evil.org/b/' || {C}", None),
    (f"'<item id=\"7\"><title><![CDATA[cut </item> & ' || {K} || ' <b>]]></title><title>second</title></item>'", (f"'cut </item> & ' || {K} || ' <b>'", None, None)),
    ("'<item><title></title><description></description></item>'", None),
]
CERT_MALFORMED = "o_orderkey % 13 = 0"


def cert_entries() -> str:
    """``o_orderkey, j, title, link, description``: what the items of an order's XML feeds say."""
    rows = []
    for j, (_, entry) in enumerate(CERT_ITEMS):
        if entry is not None:
            fields = ", ".join(f"{value or 'CAST(NULL AS STRING)'} AS {name}" for value, name in zip(entry, ("title", "link", "description")))
            rows.append(f"SELECT o_orderkey, {j} AS j, {fields} FROM @orders@")
    return " UNION ALL ".join(rows)


def cert_keys(feeds: tuple[str, ...]) -> tuple[str, str]:
    """As :func:`cert_files` in two steps: ``feed, snapshot, o_orderkey, o_custkey, place``, and a part's body over these."""
    items = " || ".join(xml for xml, _ in CERT_ITEMS)
    number = f"CASE WHEN {CERT_MALFORMED} THEN 1000 + o_orderkey % 3 ELSE o_orderkey % 7 END"
    keys = []
    for feed in feeds:
        mine = f"SELECT '{feed}' AS feed, {number} AS snapshot, o_orderkey, o_custkey, 1 AS place FROM @orders@"
        keys += [mine, *[f"SELECT DISTINCT '{feed}', {number}, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), {i} FROM @orders@" for i in (0, 2)]]
    body = (
        "CASE place WHEN 0 THEN '<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>Feed</title>' "
        f"WHEN 1 THEN {items} || CASE WHEN {CERT_MALFORMED} THEN '<item><title>cut</item>' ELSE '' END ELSE '</channel></rss>' END"
    )
    return " UNION ALL ".join(keys), body


def cert_files(feeds: tuple[str, ...]) -> str:
    """``feed, snapshot, key, body``: parts of few large XML feed files, in the order of ``key``; some break within an item."""
    items = " || ".join(xml for xml, _ in CERT_ITEMS)
    number = f"CASE WHEN {CERT_MALFORMED} THEN 1000 + o_orderkey % 3 ELSE o_orderkey % 7 END"
    parts = []
    for feed in feeds:
        mine = f"SELECT '{feed}' AS feed, {number} AS snapshot"
        parts.append(f"{mine}, o_orderkey AS key, {items} || CASE WHEN {CERT_MALFORMED} THEN '<item><title>cut</item>' ELSE '' END AS body FROM @orders@")
        parts.append(f"SELECT DISTINCT '{feed}', {number}, CAST(-1 AS BIGINT), '<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>Feed</title>' FROM @orders@")
        parts.append(f"SELECT DISTINCT '{feed}', {number}, CAST(9223372036854775807 AS BIGINT), '</channel></rss>' FROM @orders@")
    return " UNION ALL ".join(parts)


# Catalogues of different shapes, and their strings by places in lists and names in objects.
_KEV = [f"'CVE-2021-' || {_n('1000 + o_orderkey % 9000')}", f"'https://kev.evil.com/' || {K}", f"'CVE-2022-' || {_n('1000 + o_custkey % 9000')}"]
KEV_SHAPES = [
    (
        f"'{{\"title\": \"KEV\", \"count\": 2, \"vulnerabilities\": [{{\"cveID\": \"' || {_KEV[0]} || '\", \"notes\": \"' || {_KEV[1]} || '\"}}, {{\"cveID\": \"' || {_KEV[2]} || '\"}}]}}'",
        ["'KEV'", *_KEV],
    ),
    (f"'[{{\"cveID\": \"' || {_KEV[0]} || '\"}}, \"' || {_KEV[1]} || '\", 7, null, [true, [\"' || {_KEV[2]} || '\"]]]'", _KEV),
    (
        f"'{{\"z\": \"last\", \"catalog\": {{\"more\": {{\"see\": \"line' || chr(92) || 'n' || {_KEV[1]} || '\"}}, \"entries\": [{{\"cveID\": \"' || {_KEV[0]} || '\"}}]}}, \"empty\": \"\"}}'",
        [_KEV[0], f"'line' || {NL} || {_KEV[1]}", "'last'"],
    ),
    (f"'no catalogue ' || {K}", []),
]


def kev_strings() -> str:
    """``o_orderkey, j, value``: the strings of an order's catalogue."""
    rows = [
        f"SELECT o_orderkey, {j} AS j, {value} AS value FROM @orders@ WHERE o_orderkey % {len(KEV_SHAPES)} = {i}"
        for i, (_, values) in enumerate(KEV_SHAPES)
        for j, value in enumerate(values)
    ]
    return " UNION ALL ".join(rows)


def cert_bodies() -> dict[str, str]:
    """Body expression of each CERT feed over an order."""
    items = " || ".join(xml for xml, _ in CERT_ITEMS)
    head = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || " + NL
    rss = f"{head} || '<rss version=\"2.0\"><channel><title>Feed</title>' || {items} || '</channel></rss>'"
    deep = f"'<rss version=\"2.0\"><channel><group><title>Group</title><list>' || {items} || '</list></group></channel></rss>'"
    namespace = "xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\""
    rdf = (
        f"{head} || '<rdf:RDF {namespace} xmlns=\"http://purl.org/rss/1.0/\">"
        f"<channel><title>Feed</title></channel>' || {items} || '</rdf:RDF>'"
    )
    named = items
    for tag in ("item", "title", "link", "description"):
        named = named.replace(f"<{tag}", f"<n:{tag}").replace(f"</{tag}>", f"</n:{tag}>")
    named = named.replace("cut </n:item>", "cut </item>")  # text, not a tag
    prefixed = f"'<rdf:RDF {namespace} xmlns:n=\"http://purl.org/rss/1.0/\">' || {named} || '</rdf:RDF>'"
    broken = f"'not xml <<< see CVE-2024-' || {_n('1000 + o_orderkey % 9000')}"
    rss_or_raw = f"CASE WHEN {CERT_MALFORMED} THEN {broken} WHEN o_orderkey % 5 = 0 THEN {deep} ELSE {rss} END"
    listed = (
        f"'[{{\"title\": \"RCE ' || {K} || '\", \"url\": \"https://cert.eu/' || {K} || '\", \"summary\": \"CVE-2025-0001 hits ' || {REPORT_IP} || '\"}},"
        f" {{\"title\": \"\", \"link\": \"https://cert.eu/l' || {C} || '\", \"url\": \"u\", \"description\": \"d\", \"summary\": \"s\"}}]'"
    )
    # Members that come first but hold no list are passed over.
    under = "CASE o_custkey % 4 WHEN 0 THEN 'items' WHEN 1 THEN 'publications' WHEN 2 THEN 'items\": \"none\", \"results' ELSE 'publications\": {\"title\": \"no list\"}, \"data' END"
    nested = (
        f"'{{\"' || {under} || '\": [{{\"title\": \"Ransom ' || {K} || '\", \"link\": \"https://cert.eu/p' || {K} || '\", \"summary\": \"unused\"}},"
        f" {{\"title\": \"Chain\", \"url\": \"https://cert.eu/q' || {C} || '\"}}]}}'"
    )
    eu = f"CASE o_orderkey % 4 WHEN 0 THEN {listed} WHEN 1 THEN {nested} WHEN 2 THEN {rss} ELSE 'raw CTI CVE-2025-' || {_n('1000 + o_orderkey % 9000')} END"
    kev = f"CASE o_orderkey % {len(KEV_SHAPES)} " + " ".join(f"WHEN {i} THEN {body}" for i, (body, _) in enumerate(KEV_SHAPES)) + " END"
    usom = _lines("'zararli' || " + K + " || '.com'", f"'http://kotu' || {C} || '.net/x'")
    return {"TR": usom, "US": kev, "EU": eu, "NL": rss_or_raw, "FR": rss_or_raw, "JP": f"CASE WHEN o_orderkey % 3 = 0 THEN {prefixed} ELSE {rdf} END"}


def cert_payloads(names: tuple[str, ...] = ()) -> str:
    """``feed, snapshot, body`` of the named CERT feeds, or of all."""
    bodies = cert_bodies()
    return " UNION ALL ".join(_feed(name, bodies[name]) for name in names or bodies)


def rep_raw(engine: str, provider: str | None = None, kind: str | None = None) -> str:
    """Reputation snapshot keyed by the addresses, names and digests of the reports.

    Answers vary: full, with absent fields, with explicit nulls, unreadable, missing.
    For some keys an older answer is there as well.
    """
    stats = "'\"last_analysis_stats\": {\"malicious\": ' || n || ', \"suspicious\": ' || (m % 5) || ', \"harmless\": 60}'"

    def vt(extra: str) -> str:
        full = f"'{{\"data\": {{\"attributes\": {{' || {stats} || ', ' || {extra} || '}}}}}}'"
        return (
            f"CASE m % 7 WHEN 0 THEN '{{\"data\": {{\"attributes\": {{}}}}}}' WHEN 1 THEN 'rate limited' "
            f"WHEN 2 THEN NULL WHEN 3 THEN '{{\"data\": null}}' ELSE {full} END"
        )

    def select(provider: str, kind: str, source: str, body: str) -> tuple[str, str, str]:
        asked = f"SELECT '{provider}' AS provider, '{kind}' AS kind, key"
        older = f"{asked}, 1 AS landed, '{{}}' AS body FROM ({source}) s WHERE m % 3 = 0"
        return provider, kind, f"{asked}, 2 AS landed, {body} AS body FROM ({source}) s UNION ALL {older}"

    def keyed(key: str, by: str = "1") -> str:
        return f"SELECT {key} AS key, CAST(count(*) AS STRING) AS n, max(o_orderkey) AS m FROM @orders@ GROUP BY {by}"

    ips, domains = keyed(REPORT_IP), keyed(REPORT_DOMAIN)
    # Spark groups by the number, so that no digest is shuffled and one shuffle serves all of them.
    by = "o_orderkey" if engine == SPARK else "1"
    digests = " UNION ALL ".join(keyed(h, by) for h in (f"md5({K})", f"sha1({K})", sha256(engine, K)))
    m = "CAST(m AS STRING)"
    otx = "CASE m %% 6 WHEN 0 THEN '{}' WHEN 1 THEN '[1]' ELSE '{\"pulse_info\": {\"count\": ' || n || '}' || %s || '}' END"
    parts = [
        select("virustotal", "ip", ips, vt(f"'\"country\": \"TR\", \"as_owner\": null, \"reputation\": ' || {m}")),
        select("virustotal", "domain", domains, vt("'\"registrar\": \"R' || n || '\", \"reputation\": -3'")),
        select("virustotal", "hash", digests, vt(f"'\"type_description\": \"PE\", \"names\": [\"a\",\"b' || {m} || '\",\"c\",\"d\",\"e\",\"f\"]'")),
        select("otx", "ip", ips, otx % "', \"reputation\": 1, \"country_code\": \"DE\", \"asn\": null'"),
        select("otx", "domain", domains, otx % "', \"alexa\": \"a' || n || '\", \"whois\": \"' || repeat('w' || n, 90) || '\"'"),
        select("otx", "hash", digests, otx % "''"),
        select("abuseipdb", "ip", ips, f"CASE m % 5 WHEN 0 THEN '{{\"data\": {{}}}}' WHEN 1 THEN '{{}}' ELSE '{{\"data\": {{\"abuseConfidenceScore\": 85, \"totalReports\": ' || n || ', \"countryCode\": \"CN\", \"isp\": null, \"isPublic\": false}}}}' END"),
        select("shodan", "ip", ips, f"CASE m % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN NULL ELSE '{{\"ports\": [22, ' || n || '], \"os\": null, \"org\": \"O' || {m} || '\", \"vulns\": [\"CVE-2020-1\", \"CVE-2021-2\"]}}' END"),
        select("greynoise", "ip", ips, "CASE m % 4 WHEN 0 THEN '{}' WHEN 1 THEN 'x' ELSE '{\"noise\": true, \"classification\": \"malicious\", \"name\": \"g' || n || '\", \"link\": \"https://g/' || n || '\"}' END"),
    ]
    return " UNION ALL ".join(sql for p, k, sql in parts if provider in (None, p) and kind in (None, k))


def candidates(shapes: list[str]) -> str:
    """One candidate value per order, its shape chosen by the key."""
    cases = " ".join(f"WHEN {i} THEN {shape}" for i, shape in enumerate(shapes))
    return f"SELECT o_orderkey AS doc_id, CASE o_orderkey % {len(shapes)} {cases} END AS value FROM @orders@"


_NAMES = ("orders", "documents", "pages", "conversations", "events", "customer")


def for_spark(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Run a derivation on the parquet files of the tables it names."""
    for name in _NAMES:
        statement = statement.replace(f"@{name}@", f"parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(statement)


def for_duckdb(statement: str) -> str:
    """The same derivation over views of the same names."""
    for name in _NAMES:
        statement = statement.replace(f"@{name}@", name)
    return statement
