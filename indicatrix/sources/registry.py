"""The feed registry and the repository presets, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicatrix.sources.landings import newest

FEED_SCHEMA = "key string, name string, url string, format string, type string"
PRESET_SCHEMA = "name string, repo string, branch string, path string, description string"

# --- fixed values: the host of raw files, and branch and path unless a request says so ---
RAW_HOST = "https://raw.githubusercontent.com"
DEFAULT_BRANCH = "master"
DEFAULT_PATH = "trails/static/malware/malware.txt"

# --- fixed values: default feeds (key, name, url, format, type) ---------------
DEFAULT_FEEDS = [
    ("TR", "USOM Malicious URL List", "https://www.usom.gov.tr/url-list.txt", "text", "cert"),
    (
        "US",
        "CISA Known Exploited Vulnerabilities",
        "https://www.cisa.gov/sites/default/files/feeds/known_exploited_vulnerabilities.json",
        "json",
        "cert",
    ),
    (
        "maltrail",
        "Maltrail Malware List",
        "https://raw.githubusercontent.com/stamparm/maltrail/master/trails/static/malware/malware.json",
        "text",
        "github",
    ),
    ("urlhaus", "abuse.ch URLhaus", "https://urlhaus.abuse.ch/downloads/csv_recent/", "csv", "abuse_ch"),
    ("malbazaar", "abuse.ch MalBazaar", "https://bazaar.abuse.ch/export/csv/recent/", "csv", "abuse_ch"),
    ("threatfox", "abuse.ch ThreatFox", "https://threatfox.abuse.ch/export/csv/recent/", "csv", "abuse_ch"),
    (
        "feodo",
        "abuse.ch Feodo Tracker",
        "https://feodotracker.abuse.ch/downloads/ipblocklist_recommended.txt",
        "text",
        "abuse_ch",
    ),
    ("sslbl", "abuse.ch SSL Blacklist", "https://sslbl.abuse.ch/blacklist/sslipblacklist.csv", "csv", "abuse_ch"),
    ("blocklist_de", "Blocklist.de", "https://lists.blocklist.de/lists/all.txt", "text", "ip_blocklist"),
    (
        "emerging_threats",
        "Emerging Threats",
        "https://rules.emergingthreats.net/blockrules/compromised-ips.txt",
        "text",
        "ip_blocklist",
    ),
    ("spamhaus", "Spamhaus DROP", "https://www.spamhaus.org/drop/drop.txt", "text", "ip_blocklist"),
    ("cinsscore", "Cinsscore", "https://cinsscore.com/list/ci-badguys.txt", "text", "ip_blocklist"),
    (
        "talos",
        "Talos Intelligence",
        "https://www.talosintelligence.com/documents/ip-blacklist",
        "text",
        "ip_blocklist",
    ),
    ("openphish", "OpenPhish", "https://openphish.com/feed.txt", "text", "phishing"),
    (
        "bambenek_c2",
        "Bambenek C2",
        "https://osint.bambenekconsulting.com/feeds/c2-dommasterlist.txt",
        "text",
        "phishing",
    ),
    ("NL", "NCSC-NL Security Advisories", "https://advisories.ncsc.nl/rss/advisories", "rss", "cert"),
    ("FR", "CERT-FR Security Advisories", "https://www.cert.ssi.gouv.fr/feed/", "rss", "cert"),
    ("JP", "JPCERT Threat Intelligence", "https://www.jpcert.or.jp/english/rss/jpcert-en.rdf", "rss", "cert"),
    ("EU", "CERT-EU CTI Reports", "https://cert.europa.eu/publications/latest-publications", "json", "cert"),
    ("phishtank", "PhishTank", "https://data.phishtank.com/data/online-valid.csv", "csv", "phishing"),
    ("cybercrime_tracker", "CyberCrime Tracker", "https://cybercrime-tracker.net/all.php", "text", "phishing"),
    ("misp_warninglists", "MISP Warning Lists", "https://github.com/MISP/misp-warninglists", "json", "github"),
    ("firehol", "Firehol IP Lists", "https://github.com/firehol/blocklist-ipsets", "text", "github"),
    ("yaraify", "YARAify", "https://github.com/abuse-ch/yaraify", "text", "github"),
    ("threathunter", "ThreatHunter Playbook", "https://github.com/OTRF/ThreatHunter-Playbook", "text", "github"),
    ("eset_apt", "ESET APT IOCs", "https://github.com/eset/malware-ioc", "text", "github"),
    ("malpedia", "Malpedia", "https://github.com/malpedia/malpedia", "text", "github"),
]

# --- fixed values: repository presets (name, repo, branch, path, description) --
PRESETS = [
    (
        "maltrail",
        "stamparm/maltrail",
        "master",
        "trails/static/malware/malware.txt",
        "Maltrail malware IOC listesi",
    ),
    (
        "misp_warninglists",
        "MISP/misp-warninglists",
        "main",
        "lists/disposable-email/list.json",
        "MISP false positive filtreleme listeleri",
    ),
    ("firehol", "firehol/blocklist-ipsets", "master", "firehol_level1.netset", "Firehol Level 1 IP blocklist"),
    ("yaraify", "abuse-ch/yaraify", "main", "README.md", "YARAify YARA rule ve hash repository"),
    ("threathunter", "OTRF/ThreatHunter-Playbook", "master", "README.md", "ThreatHunter Playbook ATT&CK TTP bilgisi"),
    ("eset_apt", "eset/malware-ioc", "master", "README.adoc", "ESET APT kampanya IOC'ları"),
    ("malpedia", "malpedia/malpedia", "main", "README.md", "Malpedia malware ailesi bilgisi"),
]


def default_feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_FEEDS, FEED_SCHEMA)


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, PRESET_SCHEMA)


def get_feed(feeds: DataFrame, key: str) -> DataFrame:
    """The registry row of one feed; none for an unknown key."""
    return feeds.where(F.col("key") == key)


def upsert(feeds: DataFrame, new: DataFrame, at: str | None = None) -> DataFrame:
    """Add feeds, replacing those with the same key.

    Of new rows with one key the one with the largest ``at`` counts, where the caller names such a column; of
    equal ones, or without it, the largest by name, URL, format and type. No order of rows decides.
    """
    columns = [c for c in feeds.columns if c != "key"]
    order = [] if at is None else [F.col(at).alias("_at")]
    last = new.groupBy("key").agg(F.max(F.struct(*order, *columns)).alias("_row"))
    last = last.select("key", *[F.col("_row")[c].alias(c) for c in columns])
    return feeds.join(last, "key", "left_anti").unionByName(last)


def custom_feeds(rows: DataFrame, *keep: str) -> DataFrame:
    """User feeds ``name, url`` in registry form: text format and custom family unless ``format`` or ``type`` say so."""

    def given(column: str, default: str) -> str:
        return f"coalesce({column}, '{default}') AS {column}" if column in rows.columns else f"'{default}' AS {column}"

    return rows.selectExpr("name AS key", "name", "url", given("format", "text"), given("type", "custom"), *keep)


def summary(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("type", "format").agg(F.expr("count(*) AS n"))


def raw_url(repo: str, branch: str, path: str) -> str:
    """URL of one file of a repository as SQL; branch and path have defaults."""
    return (
        f"concat_ws('/', '{RAW_HOST}', {repo}, coalesce({branch}, '{DEFAULT_BRANCH}'), "
        f"coalesce({path}, '{DEFAULT_PATH}'))"
    )


def find_presets(presets_: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested presets with their file URL; unknown names give no row."""
    # The preset table has a handful of rows, whatever is requested.
    found = requested.join(F.broadcast(presets_), "name")
    return found.withColumn("url", F.expr(raw_url("repo", "branch", "path")))


def list_presets(presets_: DataFrame) -> DataFrame:
    return presets_.select("name", "repo", "description")


def landed_contents(requested: DataFrame, landed: DataFrame) -> DataFrame:
    """The newest landed file (``url, landed, body``) for requested URLs; a file that did not land gives no row."""
    return requested.join(newest(landed, ["url"], wanted=requested).drop("landed"), "url")


def repository_values(landed: DataFrame) -> DataFrame:
    """Landed repository files (``url, landed, body``) as feed values: the newest file of a URL is a snapshot, known by the URL's digest."""
    lines = newest(landed, ["url"]).selectExpr(
        "'repository' AS feed", "CAST(conv(substr(md5(url), 1, 15), 16, 10) AS BIGINT) AS snapshot", "false AS fallback",
        "posexplode(split(body, '\\r\\n|\\n|\\r')) AS (ord, value)",
    )
    return lines.where("trim(value) <> ''")
