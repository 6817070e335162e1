"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicatrix.functions import sqlfuncs
from indicatrix.functions import validate as V
from indicatrix.functions.constants import PROVIDERS
from indicatrix.functions.normalize import defang, refang
from indicatrix.operators import dedup, report
from indicatrix.operators import reputation as rep
from indicatrix.operators.extract import count_checks, extract_custom, extract_indicators, extract_wide, indicator_set, resolve_types
from indicatrix.plans import derived as D
from indicatrix.plans.tables import empty, emptying, freeing, scratch, stored, table
from indicatrix.sinks import csvfile, jsonfile, reports, stix
from indicatrix.sources import cert, documents, feedfiles, feeds, landings, registry
from indicatrix.sources.corpus import combine
from indicatrix.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TS = "2025-01-01 00:00:00 UTC"
STIX_TS = "2025-01-01T00:00:00.000Z"
SOURCE = "whole corpus"
BUNDLE_ID = "bundle--00000000-0000-4000-8000-000000000000"
LOOKUPS = 2000
SIZE_LIMIT = 2048


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs --------------------------------------------------------------
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out here: each test table is one row group, which one task would read.

    The library itself never redistributes texts. Reports are dealt out as the numbers they are made of.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    given = D.for_spark(spark, sf_dir, D.given_texts()).repartition(tasks, "source_ord", "doc_id")
    numbers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey", "o_custkey")
    reports = numbers.selectExpr("4 AS source_ord", "'reports' AS source", "o_orderkey AS doc_id", f"{D.report_text(D.SPARK)} AS text")
    return given.unionByName(reports)


def indicators(spark: SparkSession, sf_dir: str, types: list[str] | None = None, derived: bool | None = None) -> DataFrame:
    return extract_indicators(corpus(spark, sf_dir), types, derived=derived)


def listed(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    return dedup.first_seen(indicators(spark, sf_dir, types))


def stored_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplicated indicators, stored: for queries that pass over them repeatedly."""
    return stored(listed(spark, sf_dir), "indicators")


def feed_payloads(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return D.for_spark(spark, sf_dir, D.feed_payloads(D.SPARK, names))


def cert_payloads(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return D.for_spark(spark, sf_dir, D.cert_payloads(names))


def landed_answers(spark: SparkSession, sf_dir: str, provider: str | None = None, kind: str | None = None) -> DataFrame:
    """A reputation snapshot as it lands: columns in files, so keys and times are read without the answers."""
    path = scratch(spark, "answers")
    with freeing(spark):
        D.for_spark(spark, sf_dir, D.rep_raw(D.SPARK, provider, kind)).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def rep_raw(spark: SparkSession, sf_dir: str, provider: str | None = None, kind: str | None = None) -> DataFrame:
    return rep.newest(landed_answers(spark, sf_dir, provider, kind))


def ordered(rows: DataFrame) -> DataFrame:
    """Positions as text, which every engine prints alike."""
    return rows.withColumn("ord", F.col("ord").cast("string"))


# --- sources: files -------------------------------------------------------------
def land_pages(spark: SparkSession, sf_dir: str) -> str:
    """The web pages as one text file each, as a crawler would leave them.

    Pages are dealt out, and tasks move their files into place themselves: moving them one after another at
    the end, the driver would be the longest part of it.
    """
    path = scratch(spark, "pages")
    pages = table(spark, sf_dir, "pages").select("page_id", "html").repartition(8 * spark.sparkContext.defaultParallelism, "page_id")
    with freeing(spark):
        pages.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("page_id").text(path)
    return path


PAGE_ID = "CAST(regexp_extract(path, 'page_id=([0-9]+)', 1) AS BIGINT)"


@query
def scan_docs(spark, sf_dir):
    files = documents.scan_files(spark, land_pages(spark, sf_dir))
    return files.selectExpr(f"{PAGE_ID} AS page_id", "length", "md5(text) AS text_md5")


@query
def scan_many_docs(spark, sf_dir):
    pages = land_pages(spark, sf_dir)
    items = scratch(spark, "items")
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(items)
    files = documents.scan_many(spark, [items, pages + "-missing", pages])
    return files.select("ord", "input", "length", F.md5("text").alias("text_md5"))


@query
def scan_size_guard(spark, sf_dir):
    files = documents.list_files(spark, land_pages(spark, sf_dir), SIZE_LIMIT)
    return files.selectExpr(f"{PAGE_ID} AS page_id", "length", "accepted")


@query
def decode_lenient(spark, sf_dir):
    broken = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF78C328ED")))
    text = documents.decode_lenient(broken)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("text_md5"))


# --- sources: list feeds ----------------------------------------------------------
def land_feeds(spark: SparkSession, sf_dir: str, statement: str, body: str, *place: str, feed: str | None = None) -> str:
    """Feed files from parts in order: few large snapshots, as a collector would leave them.

    The numbers that parts are made of are dealt out and sorted, and each text is made where it is
    written. If all parts are of one ``feed``, it is named: by a constant column the writer would sort
    them again, without the order within a snapshot.
    """
    path = scratch(spark, "feeds")
    parts, folder, by = D.for_spark(spark, sf_dir, statement), path, ["feed", "snapshot"]
    if feed is not None:
        parts, folder, by = parts.drop("feed"), f"{path}/feed={feed}", ["snapshot"]
    parts = parts.repartition(8 * spark.sparkContext.defaultParallelism, *by)
    parts = parts.sortWithinPartitions(*by, *place, "o_orderkey", "o_custkey")
    if feed is not None:
        parts = parts.withColumn("feed", F.lit(feed))
    bodies = parts.selectExpr(*by, f"{body} AS body")
    with freeing(spark):
        bodies.write.partitionBy(*by).text(folder)
    return path


def land_group(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """The files of some list feeds."""
    return land_feeds(spark, sf_dir, *D.feed_keys(tuple(names)), feed=names[0] if len(names) == 1 else None)


#: List feeds that are landed and read together: those with quoted fields one by one, plain lists in groups.
FEED_GROUPS = [*[[name] for name in feedfiles.CSV_FEEDS], feedfiles.IP_FEEDS, [*feedfiles.LINE_FEEDS, "phishtank", "bambenek_c2"]]


def by_group(spark: SparkSession, sf_dir: str, groups: list[list[str]], parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is made of the lines of landed list feed files, group by group: the files of one are there at a time.

    ``parse`` reads the lines at once and stores what it makes of them.
    """
    parts = []
    for names in groups:
        path = land_group(spark, sf_dir, names)
        parts.append(parse(feedfiles.read_lines(spark, path)))
        empty(spark, path)
    return reduce(DataFrame.unionByName, parts)


@query
def feed_text_lines(spark, sf_dir):
    return by_group(spark, sf_dir, FEED_GROUPS, lambda lines: feedfiles.text_lines(lines, as_read=True))


@query
def feed_ip_list(spark, sf_dir):
    return feeds.explode_lines(feed_payloads(spark, sf_dir), feeds.ip_lines("body"))


@query
def feed_csv_rows(spark, sf_dir):
    return by_group(spark, sf_dir, [[name] for name in feedfiles.CSV_FEEDS], feedfiles.csv_table)


def _feed_query(name: str, *feed_names: str) -> None:
    def run(spark, sf_dir):
        return feeds.parse_feed(feed_payloads(spark, sf_dir, *feed_names), *feed_names)

    QUERIES[name] = run


FEED_QUERIES = {
    "feed_urlhaus": ("urlhaus",),
    "feed_malbazaar": ("malbazaar",),
    "feed_threatfox": ("threatfox",),
    "feed_feodo": ("feodo",),
    "feed_sslbl": ("sslbl",),
    "feed_ip_blocklists": ("blocklist_de", "emerging_threats", "cinsscore", "talos"),
    "feed_spamhaus": ("spamhaus",),
    "feed_openphish_cybercrime": ("openphish", "cybercrime_tracker"),
    "feed_bambenek": ("bambenek_c2",),
    "feed_phishtank": ("phishtank",),
}
for _name, _feeds in FEED_QUERIES.items():
    _feed_query(_name, *_feeds)


# --- sources: CERT feeds -----------------------------------------------------------
@query
def feed_rss(spark, sf_dir):
    return cert.read_items(spark, land_feeds(spark, sf_dir, *D.cert_keys(("NL", "FR")), "place"))


@query
def feed_rdf(spark, sf_dir):
    return cert.rss_table(cert_payloads(spark, sf_dir, "JP"))


@query
def feed_items_text(spark, sf_dir):
    return cert.rss_lines(cert_payloads(spark, sf_dir, "JP"))


@query
def feed_cert_rss(spark, sf_dir):
    return cert.rss_values(cert_payloads(spark, sf_dir, "NL", "FR", "JP"))


@query
def feed_cert_eu(spark, sf_dir):
    return cert.cert_eu_values(cert_payloads(spark, sf_dir, "EU"))


@query
def feed_usom(spark, sf_dir):
    return cert.raw_values(cert_payloads(spark, sf_dir, "TR"))


@query
def feed_kev(spark, sf_dir):
    return cert.kev_values(cert_payloads(spark, sf_dir, "US"))


@query
def feed_raw_fallback(spark, sf_dir):
    parts = []
    for names in FEED_GROUPS:
        # All values are found to know which snapshots have none; of what that takes, only the raw lines stay.
        with emptying(spark):
            path = land_group(spark, sf_dir, names)
            parsed = feedfiles.parse_files(lambda *some: feedfiles.read_lines(spark, path, *some), *names)
            parts.append(stored(parsed.where("fallback"), "fallback", stays=True))
    return reduce(DataFrame.unionByName, parts)


def feed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed_feeds = feeds.parse_all(feed_payloads(spark, sf_dir))
    landed = registry.repository_values(D.for_spark(spark, sf_dir, LANDED_FILES).drop("run"))
    return listed_feeds.unionByName(cert.cert_values(cert_payloads(spark, sf_dir))).unionByName(landed)


# Inputs of a run, in order: files, pages, CERT feeds, repositories, list feeds.
FEED_ORDS = {name: i for i, name in enumerate(["TR", "US", "EU", "NL", "FR", "JP", "repository", *feeds.FEEDS], start=3)}


@query
def feed_union_all(spark, sf_dir):
    return feed_values(spark, sf_dir)


# --- sources: registry ---------------------------------------------------------------
REQUESTED_PRESETS = (
    "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'maltrail' WHEN 1 THEN 'misp_warninglists' "
    "WHEN 2 THEN 'firehol' WHEN 3 THEN 'yaraify' WHEN 4 THEN 'threathunter' WHEN 5 THEN 'eset_apt' "
    "WHEN 6 THEN 'malpedia' ELSE 'unknown' || CAST(o_custkey AS STRING) END AS name FROM @orders@"
)
REPO_PATHS = (
    "SELECT o_orderkey, 'org' || CAST(o_custkey AS STRING) || '/iocs' AS repo, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'main' END AS branch, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'lists/' || CAST(o_orderkey % 50 AS STRING) || '.txt' END AS path FROM @orders@"
)
LANDED_FILES = (
    "SELECT 'https://raw.githubusercontent.com/org' || CAST(o_custkey AS STRING) || '/iocs/main/lists/' "
    "|| CAST(o_orderkey % 50 AS STRING) || '.txt' AS url, o_orderkey AS landed, o_orderkey % 5 AS run, "
    "'10.0.0.' || CAST(o_orderkey % 4 AS STRING) AS body FROM @orders@"
)
NEW_FEEDS = (
    "SELECT CASE c_custkey % 40 WHEN 0 THEN 'talos' WHEN 1 THEN 'openphish' "
    "ELSE 'custom' || CAST(c_custkey - c_custkey % 4 AS STRING) END AS name, 'https://feeds.evil.org/' || c_name AS url, "
    "(c_custkey * 7) % 1000003 AS added FROM @customer@"
)


@query
def registry_list(spark, sf_dir):
    landed = feed_payloads(spark, sf_dir).unionByName(cert_payloads(spark, sf_dir))
    counts = landed.groupBy(F.col("feed").alias("key")).agg(F.count("*").alias("snapshots"))
    known = registry.default_feeds(spark).join(counts, "key", "left")
    return known.withColumn("snapshots", F.coalesce("snapshots", F.lit(0)))


def _upserted(spark, sf_dir) -> DataFrame:
    new = registry.custom_feeds(D.for_spark(spark, sf_dir, NEW_FEEDS), "added")
    return registry.upsert(registry.default_feeds(spark), new, "added")


@query
def registry_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)


@query
def registry_summary(spark, sf_dir):
    return registry.summary(_upserted(spark, sf_dir))


@query
def preset_lookup(spark, sf_dir):
    requested = D.for_spark(spark, sf_dir, REQUESTED_PRESETS)
    return registry.find_presets(registry.presets(spark), requested)


@query
def preset_list(spark, sf_dir):
    asked = D.for_spark(spark, sf_dir, REQUESTED_PRESETS).groupBy("name").agg(F.count("*").alias("requests"))
    return registry.list_presets(registry.presets(spark)).join(asked, "name", "left")


@query
def feed_repo_url(spark, sf_dir):
    url = registry.raw_url("repo", "branch", "path")
    requested = D.for_spark(spark, sf_dir, REPO_PATHS).selectExpr("o_orderkey", f"{url} AS url")
    return registry.landed_contents(requested, D.for_spark(spark, sf_dir, LANDED_FILES).drop("run"))


@query
def feed_changes(spark, sf_dir):
    return landings.changes(D.for_spark(spark, sf_dir, LANDED_FILES))


@query
def corpus_union(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "doc_id", "text")
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("doc_id"), F.concat("url", F.lit("\n"), "html").alias("text")
    )
    landed = feeds.values_as_documents(feed_values(spark, sf_dir), FEED_ORDS)
    whole = combine(files, pages).unionByName(landed)
    return whole.select("source_ord", "source", "doc_id", F.md5("text").alias("text_md5"))


# --- normalisation ----------------------------------------------------------------------
def _refang(spark, sf_dir):
    return corpus(spark, sf_dir).selectExpr("source", "doc_id", f"md5({refang('text')}) AS refanged_md5")


QUERIES["refang"] = _refang


def _defang(spark, sf_dir):
    values = dedup.distinct_indicators(indicators(spark, sf_dir))
    return values.selectExpr("type", "value", f"{defang('value')} AS defanged")


QUERIES["defang"] = _defang


@query
def defang_output(spark, sf_dir):
    rows = report.defang_values(listed(spark, sf_dir))
    return report.flatten_export(rows, SOURCE).select(*csvfile.FIELDS)


# --- extraction ---------------------------------------------------------------------------
def _extract_query(name: str, types: list[str], derived: bool | None = None) -> None:
    def run(spark, sf_dir):
        rows = indicators(spark, sf_dir, types, derived)
        return rows.select("source", "doc_id", "type", "pos", "value")

    QUERIES[name] = run


EXTRACT_QUERIES = {
    "extract_ipv4": (["ipv4"], None),
    "extract_ipv6": (["ipv6"], None),
    "extract_domain": (["domain"], False),
    "extract_derived_domain": (["domain"], True),
    "extract_url": (["url"], None),
    "extract_email": (["email"], None),
    "extract_cve": (["cve"], None),
    "extract_mitre": (["mitre"], None),
    "extract_hashes": (["hash_md5", "hash_sha1", "hash_sha256", "hash_sha512"], None),
}
for _name, (_types, _derived) in EXTRACT_QUERIES.items():
    _extract_query(_name, _types, _derived)


@query
def extract_all(spark, sf_dir):
    return indicators(spark, sf_dir).select("source_ord", "source", "doc_id", "type", "derived", "pos", "value")


WIDE_LISTS = [
    "ipv4", "ipv6", "domains", "urls", "emails", "cves", "mitre_techniques",
    "hash_md5", "hash_sha1", "hash_sha256", "hash_sha512",
]


@query
def extract_wide_rows(spark, sf_dir):
    wide = extract_wide(corpus(spark, sf_dir), RUN_TS)
    lists = [f"array_join({name}, ' ') AS {name}" for name in WIDE_LISTS]
    return wide.selectExpr("source", "doc_id", *lists, "extracted_at")


QUERIES["extract_wide"] = QUERIES.pop("extract_wide_rows")


# --- validation -----------------------------------------------------------------------------
CANDIDATES = {
    "validate_ipv4": [
        "CAST(o_orderkey % 300 AS STRING) || '.' || CAST(o_custkey % 256 AS STRING) || '.7.9'",
        "'0' || CAST(o_custkey % 10 AS STRING) || '.1.2.3'",
        "'1.2.3.' || CAST(o_orderkey % 400 AS STRING)",
        "'1.2.3'",
        "'host' || CAST(o_orderkey AS STRING)",
        "'1.2.3.4.' || CAST(o_custkey % 256 AS STRING)",
    ],
    "validate_ipv6": [
        "'2001:db8::' || CAST(o_orderkey % 90000 AS STRING)",
        "'1:2:3:4:5:6:7:' || CAST(o_custkey % 12000 AS STRING)",
        "'::ffff:1.2.3.' || CAST(o_orderkey % 400 AS STRING)",
        "'fe80::1%eth' || CAST(o_custkey AS STRING)",
        "'1:2:3:4:5:6:7:8:' || CAST(o_custkey % 9 AS STRING)",
        "'::'",
        "'1::2::' || CAST(o_custkey % 9 AS STRING)",
        "'1:2:3:4:5:6:7::'",
        "':1:2:3:4:5:6:' || CAST(o_custkey % 9 AS STRING)",
        "'fe80::1%'",
        "'1:2:3:4:5:6:1.2.3.' || CAST(o_orderkey % 400 AS STRING)",
        "'fe80::' || CAST(o_orderkey % 9 AS STRING) || '%a%b'",
        "'not-ipv6-' || CAST(o_orderkey AS STRING)",
    ],
    "classify_hash": [
        "md5(CAST(o_orderkey AS STRING))",
        "' ' || upper(sha1(CAST(o_orderkey AS STRING))) || ' '",
        "md5(CAST(o_orderkey AS STRING)) || md5(CAST(o_custkey AS STRING))",
        "repeat(md5(CAST(o_orderkey AS STRING)), 4)",
        "'z' || substr(md5(CAST(o_orderkey AS STRING)), 2)",
        "substr(md5(CAST(o_orderkey AS STRING)), 2)",
        "''",
    ],
    "validate_cve": [
        "'CVE-2024-' || CAST(o_orderkey AS STRING)",
        "'cve-' || CAST(1990 + o_orderkey % 40 AS STRING) || '-' || CAST(1000 + o_custkey AS STRING)",
        "'CVE-' || CAST(o_orderkey AS STRING)",
        "' CVE-2024-1234'",
    ],
    "domain_filter": [
        "'evil' || CAST(o_orderkey AS STRING) || '.com'",
        "CAST(o_orderkey AS STRING) || '.' || CAST(o_custkey AS STRING) || '.net'",
        "'file' || CAST(o_orderkey AS STRING) || '.exe'",
        "'A' || CAST(o_orderkey AS STRING) || '.Co.Uk'",
        "CAST(o_orderkey AS STRING) || '.co.uk'",
        "CASE WHEN o_custkey % 2 = 0 THEN 'example.com' ELSE 'www.example.com' END",
        "'python.' || CAST(o_custkey % 9 AS STRING)",
        "'nodots' || CAST(o_orderkey AS STRING)",
        "'x' || CAST(o_orderkey AS STRING) || '.unknown'",
    ],
    "validate_domain_basic": [
        "'evil' || CAST(o_orderkey AS STRING) || '.com'",
        "'evil.c' || CAST(o_orderkey % 10 AS STRING)",
        "'evil.x'",
        "''",
        "'nodots' || CAST(o_orderkey AS STRING)",
    ],
    "validate_email": [
        "'u' || CAST(o_orderkey AS STRING) || '@evil.com'",
        "'u.x+' || CAST(o_orderkey AS STRING) || '@mail.evil' || CAST(o_custkey AS STRING) || '.org'",
        "'no-at-sign' || CAST(o_orderkey AS STRING)",
        "'a@b.' || CAST(o_custkey % 10 AS STRING)",
        "' a@b.com'",
    ],
    "validate_url": [
        "'http://evil' || CAST(o_orderkey AS STRING) || '.com'",
        "'HTTPS://evil' || CAST(o_orderkey AS STRING) || '.com'",
        "'ftp://f' || CAST(o_orderkey AS STRING)",
        "'hxxp://evil' || CAST(o_orderkey AS STRING) || '.com'",
        "'see http://evil.com'",
    ],
}
CHECKS = {
    "validate_ipv4": V.is_ipv4,
    "validate_ipv6": V.is_ipv6,
    "classify_hash": V.hash_type,
    "validate_cve": V.is_cve,
    "domain_filter": V.is_indicator_domain,
    "validate_domain_basic": V.is_domain_name,
    "validate_email": V.is_email,
    "validate_url": V.is_url,
}


def _check_query(name: str) -> None:
    def run(spark, sf_dir):
        rows = D.for_spark(spark, sf_dir, D.candidates(CANDIDATES[name]))
        return rows.selectExpr("doc_id", "value", f"{CHECKS[name]('value')} AS result")

    QUERIES[name] = run


for _name in CHECKS:
    _check_query(_name)

@query
def validation_counts(spark, sf_dir):
    return count_checks(corpus(spark, sf_dir))


SET_QUERIES = {f"xset_{kind}": kind for kind in ("ip", "domain", "url", "email", "hash", "cve")}


def _set_query(name: str, kind: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: indicator_set(corpus(spark, sf_dir), kind)


for _name, _kind in SET_QUERIES.items():
    _set_query(_name, _kind)


# --- duplicates, filters, counts ------------------------------------------------------------
@query
def dedup_first(spark, sf_dir):
    return dedup.unpack_position(listed(spark, sf_dir))


@query
def dedup_unordered(spark, sf_dir):
    return dedup.distinct_indicators(indicators(spark, sf_dir))


FILTER = " IP, hash,unknown,CVE"


@query
def filter_types(spark, sf_dir):
    return listed(spark, sf_dir, resolve_types(FILTER)).select("type", "value")


@query
def count_by_type(spark, sf_dir):
    return report.count_by_type(listed(spark, sf_dir))


@query
def count_total(spark, sf_dir):
    return report.count_total(indicators(spark, sf_dir))


@query
def hash_family_counts(spark, sf_dir):
    return report.hash_family_counts(listed(spark, sf_dir, resolve_types("hash")))


@query
def report_top50(spark, sf_dir):
    rows = stored_list(spark, sf_dir)
    top = report.top_per_type(rows).select("type", "rank", "value")
    more = report.overflow_per_type(rows).select("type", "n", "more")
    # One row per type.
    return top.join(F.broadcast(more), "type")


@query
def lookup_budget(spark, sf_dir):
    return rep.lookup_budget(listed(spark, sf_dir, resolve_types("domain,hash")), "virustotal", LOOKUPS)


# --- export ---------------------------------------------------------------------------------
@query
def flatten_export(spark, sf_dir):
    return report.flatten_export(listed(spark, sf_dir), SOURCE).select(*csvfile.FIELDS)


RUNS = (
    "SELECT o_orderkey, o_orderkey % 6 AS files, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'https://u' || "
    "CAST(o_custkey AS STRING) END AS url, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'TR' END AS cert, "
    "'soc' || CAST(o_custkey AS STRING) AS label FROM @orders@"
)


@query
def source_label(spark, sf_dir):
    files = "transform(filter(sequence(0L, files), i -> i > 0), i -> concat('f', i))"
    label = report.source_label(files, "url", "cert", "label")
    return D.for_spark(spark, sf_dir, RUNS).selectExpr("o_orderkey", f"{label} AS source")


# --- sinks ------------------------------------------------------------------------------------
@query
def sink_csv(spark, sf_dir):
    rows = report.flatten_export(listed(spark, sf_dir), 'say "whole", all')
    return ordered(csvfile.csv_document(rows))


@query
def sink_json(spark, sf_dir):
    return ordered(jsonfile.json_document(stored_list(spark, sf_dir), SOURCE, RUN_TS))


def _enriched(spark, sf_dir, rows: DataFrame) -> DataFrame:
    return rep.enrich(rows, landed_answers(spark, sf_dir), at="landed")


@query
def sink_json_full(spark, sf_dir):
    rows = stored_list(spark, sf_dir)
    merged = stored(rep.merge_last(_enriched(spark, sf_dir, rows)), "answers")
    return ordered(jsonfile.json_document(rows, SOURCE, RUN_TS, tlp="TLP:AMBER", enrichment=merged))


@query
def report_markdown_lines(spark, sf_dir):
    return ordered(reports.markdown_report(stored_list(spark, sf_dir), SOURCE, RUN_TS))


@query
def report_text_lines(spark, sf_dir):
    return ordered(reports.text_report(stored_list(spark, sf_dir), SOURCE, RUN_TS))


@query
def stix_indicators(spark, sf_dir):
    objects = stix.stix_objects(listed(spark, sf_dir), "Medium", "tlp:red", STIX_TS)
    return ordered(stix.stix_json(objects))


TLPS = (
    "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'TLP:CLEAR' WHEN 1 THEN 'tlp:green' WHEN 2 THEN 'Tlp:Amber' "
    "WHEN 3 THEN 'TLP:AMBER+STRICT' WHEN 4 THEN 'TLP:RED' WHEN 5 THEN 'WHITE' ELSE '' END AS tlp FROM @orders@"
)


@query
def tlp_marking(spark, sf_dir):
    return D.for_spark(spark, sf_dir, TLPS).selectExpr("*", f"{stix.tlp_marking('tlp')} AS marking")


@query
def stix_bundle(spark, sf_dir):
    objects = stix.stix_objects(stored_list(spark, sf_dir), "High", "TLP:CLEAR", STIX_TS)
    return ordered(stix.stix_bundle(objects, BUNDLE_ID))


# --- reputation -----------------------------------------------------------------------------
REP_QUERIES = {
    "rep_vt_ip": ("virustotal", "ip"),
    "rep_vt_hash": ("virustotal", "hash"),
    "rep_vt_domain": ("virustotal", "domain"),
    "rep_otx_ip": ("otx", "ip"),
    "rep_otx_domain": ("otx", "domain"),
    "rep_otx_hash": ("otx", "hash"),
    "rep_abuseipdb": ("abuseipdb", "ip"),
    "rep_shodan": ("shodan", "ip"),
    "rep_greynoise": ("greynoise", "ip"),
}
LIST_FIELDS = {"names", "ports", "vulns"}


def _rep_query(name: str, provider: str, kind: str) -> None:
    def run(spark, sf_dir):
        rows = rep.project_reputation(rep_raw(spark, sf_dir, provider, kind), provider, kind)
        return rows.selectExpr(
            *[f"array_join(CAST({c} AS ARRAY<STRING>), ',') AS {c}" if c in LIST_FIELDS else c for c in rows.columns]
        )

    QUERIES[name] = run


for _name, (_provider, _kind) in REP_QUERIES.items():
    _rep_query(_name, _provider, _kind)


@query
def enrich_provider(spark, sf_dir):
    rows = listed(spark, sf_dir, resolve_types("domain,hash"))
    return rep.enrich_provider(rows, landed_answers(spark, sf_dir, "virustotal"), "virustotal", at="landed")


@query
def enrich_merge_last(spark, sf_dir):
    return rep.merge_last(_enriched(spark, sf_dir, stored_list(spark, sf_dir)))


@query
def enrich_merge_all(spark, sf_dir):
    merged = rep.merge_all(_enriched(spark, sf_dir, stored_list(spark, sf_dir)))
    return merged.selectExpr("value", *[f"try_element_at(answers, '{p}') AS {p}" for p in PROVIDERS])


@query
def enrich_enabled_only(spark, sf_dir):
    # A provider is configured when a key for it is on file.
    keys = table(spark, sf_dir, "customer").select(
        F.element_at(F.array(*[F.lit(p) for p in PROVIDERS[:4]]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("provider"),
        F.when(F.col("c_custkey") % 4 != 3, F.concat(F.lit("key-"), "c_name")).otherwise(F.lit("")).alias("api_key"),
    )
    # One row per provider, of which there are five.
    on_file = [r.provider for r in keys.where("api_key <> ''").select("provider").distinct().collect()]
    return rep.enabled_only(rep_raw(spark, sf_dir), on_file).select("provider", "kind", "key")


# --- SQL functions, user types, streams ------------------------------------------------------
@query
def udf_surface(spark, sf_dir):
    sqlfuncs.register(spark)
    docs = corpus(spark, sf_dir)
    return spark.sql(
        "SELECT d.source, d.doc_id, m.pos, m.value, defang(m.value) AS defanged, is_ipv4(m.value) AS valid "
        "FROM (SELECT source, doc_id, refang(text) AS raw FROM {docs}) d, LATERAL ipv4_in(d.raw) m",
        docs=docs,
    )


@query
def udf_scalars(spark, sf_dir):
    """The scalar SQL functions on the candidates of all checks."""
    sqlfuncs.register(spark)
    shapes = [shape for shapes in CANDIDATES.values() for shape in shapes]
    values = D.for_spark(spark, sf_dir, D.candidates(shapes))
    columns = ", ".join(f"{name}(value) AS {name}_out" for name in sqlfuncs.SCALAR_FUNCTIONS if name not in ("refang", "url_host"))
    url = "concat('hxxps://', value, ':80/x?y=1')"
    return spark.sql(f"SELECT doc_id, value, refang(concat('at hxxp://', value, '[.]com')) AS refang_out, url_host({url}) AS url_host_out, {columns} FROM {{values}}", values=values)


@query
def udf_tables(spark, sf_dir):
    """The SQL functions that give the matches in a text, on all texts."""
    sqlfuncs.register(spark)
    docs = corpus(spark, sf_dir)
    parts = [
        f"SELECT d.source, d.doc_id, '{name}' AS function, m.pos, m.value FROM (SELECT source, doc_id, {'text' if name == 'email_in' else 'refang(text)'} AS raw FROM {{docs}}) d, LATERAL {name}(d.raw) m"
        for name in sqlfuncs.TABLE_FUNCTIONS
    ]
    return spark.sql(" UNION ALL ".join(parts), docs=docs)


WALLET = {"type": "order_file", "pattern": r"\bp\d+\.exe\b", "validator": "length(value) > 6", "normaliser": "upper(value)"}
VERSION = {"type": "version", "pattern": r"\bv\d+\.\d+\b"}


@query
def custom_types(spark, sf_dir):
    rows = extract_custom(corpus(spark, sf_dir), [WALLET, VERSION])
    return rows.select("source", "doc_id", "type", "pos", "value")


def _finished(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    out = scratch(spark, label)
    stream.write_available(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def landed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    # A stream takes a lone file only by a pattern; this one also matches a folder, whose files are then read.
    return stream.read_documents(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


@query
def stream_extract(spark, sf_dir):
    landed = landed_table(spark, sf_dir, "documents")
    docs = landed.select(F.lit(1).alias("source_ord"), F.lit("documents").alias("source"), "doc_id", "text")
    rows = stream.stream_extract(docs).select("doc_id", "type", "derived", "pos", "value")
    return _finished(spark, rows, "stream-extract")


EVENT_TEXT = (
    "'login from 10.' || CAST(user_id % 20 AS STRING) || '.0[.]' || CAST(event_id % 7 AS STRING) || ' via hxxp://' "
    "|| event_type || CAST(user_id % 9 AS STRING) || '[.]com/'"
)


@query
def stream_dedup(spark, sf_dir):
    landed = landed_table(spark, sf_dir, "events")
    docs = landed.select(
        F.lit(1).alias("source_ord"),
        F.lit("events").alias("source"),
        F.col("event_id").alias("doc_id"),
        "ts",
        F.expr(EVENT_TEXT).alias("text"),
    )
    rows = stream.stream_dedup(stream.stream_extract(docs), "ts", "7 days").selectExpr("unix_seconds(since) AS since", "type", "value")
    out = scratch(spark, "stream-dedup")
    stream.write_updates(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")
