"""Landed feed snapshots -> values.

A snapshot is one file of a feed as a row ``(feed string, snapshot bigint,
body string)``; :func:`read_snapshots` makes them from a folder.  It is parsed within its row,
so the rule "no value found: take the raw text" needs neither a second scan nor
a join, and a feed that holds most of the data is still as many rows as it has
snapshots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicatrix.functions import patterns as P
from indicatrix.functions.normalize import in_list, literal, lookup, strip
from indicatrix.sources.documents import decode_lenient

_FIELD = literal(r',("(?:[^"]++|"")*+(?:"[^,]*+)?|[^,]*+)')
_QUOTED = literal(r'^"((?:[^"]++|"")*+)"?')
# Fields up to a line break; a quoted one holds line breaks.
_RECORD_FIELD = r'(?:"(?:[^"]++|"")*+"?[^,\n]*+|[^,\n]*+)'
_RECORD = literal(rf"{_RECORD_FIELD}(?:,{_RECORD_FIELD})*+")


# --- line level: SQL expressions over a body or a line --------------------------
def split_lines(body: str) -> str:
    """Spark compiles the pattern of ``split`` for every row, but for a single character: mostly that does."""
    rare = " OR ".join(f"contains({body}, {literal(ch)})" for ch in P.RARE_BREAKS)
    return f"CASE WHEN {rare} THEN split({body}, {literal(P.LINE_BREAK)}) ELSE split({body}, '\\n') END"


def raw_lines(body: str) -> str:
    """The lines of the text as they stand, blank ones left out."""
    return f"filter({split_lines(body)}, r -> {strip('r')} <> '')"


def data_lines(body: str) -> str:
    """Trimmed lines without blank and ``#`` comment lines."""
    return f"filter(transform({split_lines(body)}, l -> {strip('l')}), l -> l <> '' AND NOT startswith(l, '#'))"


def ip_lines(body: str) -> str:
    """Address lists: also without ``;`` comments, whole-line or trailing."""
    lines = f"filter({data_lines(body)}, l -> NOT startswith(l, ';'))"
    front = strip("substring_index(l, ';', 1)")
    return f"array_remove(transform({lines}, l -> {front}), '')"


def csv_fields(line: str) -> str:
    """The fields of one CSV record, quotes resolved; its size is the row width.

    Records without quotes, and those of which every field is quoted and holds none, are cut by plain
    searches, as is a quoted field without quotes inside; only others need the patterns.
    """
    inner = f"replace(regexp_extract(f, {_QUOTED}, 1), '\"\"', '\"')"
    text = f"concat({inner}, regexp_replace(f, {_QUOTED}, ''))"
    text = f"IF(locate('\"', f, 2) = length(f) AND length(f) > 1, substring(f, 2, length(f) - 2), {text})"
    fields = f"regexp_extract_all(concat(',', {line}), {_FIELD}, 1)"
    fields = f"transform({fields}, f -> CASE WHEN startswith(f, '\"') THEN {text} ELSE f END)"
    return (
        f"CASE WHEN NOT contains({line}, '\"') THEN split({line}, ',') "
        f"WHEN {_all_quoted(line)} THEN split({_within_quotes(line)}, '\",\"') ELSE {fields} END"
    )


def _within_quotes(line: str) -> str:
    return f"substring({line}, 2, length({line}) - 2)"


def _all_quoted(line: str) -> str:
    """Whether every field of a line is quoted and holds no quote."""
    ends = f"length({line}) > 1 AND startswith({line}, '\"') AND endswith({line}, '\"')"
    return f"{ends} AND NOT contains(replace({_within_quotes(line)}, '\",\"', ''), '\"')"


def _records(lines: str) -> str:
    """The CSV records of some lines; a quoted field may span several, where a line has quotes that are not plain."""
    several = f"regexp_extract_all(array_join(w, '\\n'), {_RECORD}, 0)"
    single = f"forall(w, l -> NOT contains(l, '\"') OR {_all_quoted('l')})"
    return f"array_remove(transform(array({lines}), w -> CASE WHEN {single} THEN w ELSE {several} END)[0], '')"


def csv_rows(body: str) -> str:
    return f"transform({_records(data_lines(body))}, l -> {csv_fields('l')})"


def _column(body: str, index: int) -> str:
    """One column of the rows that have it, surrounding quotes removed."""
    present = f"filter({csv_rows(body)}, row -> size(row) > {index})"
    return f"transform({present}, row -> btrim(row[{index}], '\"'))"


def _filled(values: str) -> str:
    return f"array_remove(transform({values}, x -> {strip('x')}), '')"


def read_snapshots(spark: SparkSession, root: str, *feeds: str) -> DataFrame:
    """Landed feed files ``root/feed=<key>/snapshot=<id>/<file>`` as payloads ``feed, snapshot, body``.

    ``feed`` and ``snapshot`` come from the path, so naming ``feeds`` prunes the listing; a file is a
    snapshot, decoded leniently. Only files the parsers ask for are read.
    """
    files = spark.read.format("binaryFile").option("basePath", root).load(root)
    if feeds:
        files = files.where(F.col("feed").isin(list(feeds)))
    return files.select(F.col("feed").cast("string"), F.col("snapshot").cast("bigint"), decode_lenient(F.col("content")).alias("body"))


# --- one parser per feed shape --------------------------------------------------
def _urlhaus(body: str) -> str:
    return f"filter({_column(body, 2)}, u -> startswith(u, 'http'))"


def _malbazaar(body: str) -> str:
    wide = f"filter({csv_rows(body)}, row -> size(row) > 2)"
    cells = f"flatten(transform({wide}, row -> slice(row, 1, 3)))"
    cell = strip("btrim(c, '\"')")
    return f"filter(transform({cells}, c -> {cell}), h -> length(h) IN (32, 40, 64))"


def _third_column(body: str) -> str:
    return _filled(_column(body, 2))


def _second_column(body: str) -> str:
    return _filled(_column(body, 1))


def _bambenek(body: str) -> str:
    return _filled(f"transform({data_lines(body)}, l -> substring_index(l, ',', 1))")


def _url_index(body: str) -> str:
    """Place of the ``url`` column in the header line, the second one by default."""
    name = f"lower({strip('n')})"
    place = f"array_position(transform({csv_fields('h')}, n -> {name}), 'url')"
    return f"transform(array(get({split_lines(body)}, 0)), h -> CAST(coalesce(nullif({place}, 0), 2) - 1 AS INT))[0]"


def _phishtank(body: str) -> str:
    """Reads ``_url_index``, which :func:`_staged` finds once per payload."""
    lines = f"filter({split_lines(body)}, (l, i) -> i > 0)"
    records = f"transform({_records(lines)}, l -> {csv_fields('l')})"
    wide = f"filter({records}, row -> size(row) > _url_index)"
    return _filled(f"transform({wide}, row -> get(row, _url_index))")


def _staged(payloads: DataFrame) -> DataFrame:
    """Non-empty payloads with what a parser needs once per payload, not once per line."""
    found = f"CASE WHEN feed = 'phishtank' THEN {_url_index('body')} END"
    return payloads.where("body <> ''").withColumn("_url_index", F.expr(found))


# feed -> (family, parser, whether the raw text is used when nothing parses)
FEEDS: dict[str, tuple[str, Callable[[str], str], bool]] = {
    "urlhaus": ("abuse_ch", _urlhaus, True),
    "malbazaar": ("abuse_ch", _malbazaar, True),
    "threatfox": ("abuse_ch", _third_column, True),
    "feodo": ("abuse_ch", data_lines, False),
    "sslbl": ("abuse_ch", _second_column, True),
    "blocklist_de": ("ip_blocklist", ip_lines, False),
    "emerging_threats": ("ip_blocklist", ip_lines, False),
    "spamhaus": ("ip_blocklist", ip_lines, False),
    "cinsscore": ("ip_blocklist", ip_lines, False),
    "talos": ("ip_blocklist", ip_lines, False),
    "openphish": ("phishing", data_lines, False),
    "phishtank": ("phishing", _phishtank, True),
    "bambenek_c2": ("phishing", _bambenek, True),
    "cybercrime_tracker": ("phishing", data_lines, False),
}


def explode_values(payloads: DataFrame, values: str, with_raw: str) -> DataFrame:
    """``feed, snapshot, fallback, ord, value`` from an array of values per payload.

    ``with_raw`` is the condition under which a payload without values counts
    with its raw text.
    """
    parsed = payloads.where("body <> ''").selectExpr("feed", "snapshot", "body", f"{values} AS _values")
    flagged = parsed.selectExpr("*", f"({with_raw}) AND coalesce(size(_values) <= 0, true) AS fallback")
    # The generator gets an expression: for a plain column Spark would add a
    # filter on its size and, pushing it down, parse every payload twice.
    chosen = f"CASE WHEN fallback THEN {raw_lines('body')} ELSE _values END"
    return flagged.selectExpr("feed", "snapshot", "fallback", f"posexplode({chosen}) AS (ord, value)")


def _parse(payloads: DataFrame, feeds: list[str]) -> DataFrame:
    branches = ""
    for parser in dict.fromkeys(FEEDS[name][1] for name in feeds):
        names = [name for name in feeds if FEEDS[name][1] is parser]
        branches += f" WHEN feed IN {in_list(names)} THEN {parser('body')}"
    with_raw = [name for name in feeds if FEEDS[name][2]]
    mine = _staged(payloads.where(F.col("feed").isin(feeds)))
    return explode_values(mine, f"CASE{branches} END", f"feed IN {in_list(with_raw)}" if with_raw else "false")


def parse_feed(payloads: DataFrame, *feeds: str) -> DataFrame:
    """The values of some feeds in a single pass.

    Each payload runs the parser of its own feed only; provenance is the
    ``feed`` column, so no header text is mixed into what is scanned later.
    """
    return _parse(payloads, list(feeds))


def parse_all(payloads: DataFrame, family: str | None = None) -> DataFrame:
    """The values of all list feeds, or of one family."""
    return _parse(payloads, [name for name, spec in FEEDS.items() if family in (None, spec[0])])


def explode_lines(payloads: DataFrame, lines: str) -> DataFrame:
    """``feed, snapshot, ord, value`` from an expression that gives lines."""
    return payloads.selectExpr("feed", "snapshot", f"posexplode({lines}) AS (ord, value)")


def csv_table(payloads: DataFrame) -> DataFrame:
    """CSV records of landed payloads: ``feed, snapshot, ord, width, c0, c1, c2``."""
    rows = payloads.selectExpr("feed", "snapshot", f"posexplode({csv_rows('body')}) AS (ord, _row)")
    fields = [f"get(_row, {i}) AS c{i}" for i in range(3)]
    return rows.selectExpr("feed", "snapshot", "ord", "size(_row) AS width", *fields)


def values_as_documents(values: DataFrame, source_ords: dict[str, int]) -> DataFrame:
    """Feed values in the document schema: one document per snapshot, its values in order on lines of their own.

    Every feed has its own ``source_ord``, so a snapshot id is a position within its feed.
    """
    text = "array_join(transform(array_sort(collect_list(struct(ord, value))), v -> v.value), '\n') AS text"
    docs = values.groupBy("feed", "snapshot").agg(F.expr(text))
    return docs.selectExpr(f"{lookup('feed', source_ords)} AS source_ord", "feed AS source", "snapshot AS doc_id", "text")
