"""Personal data by bootstrapped contextual extraction.

The base rules find identifiers by their shape. They are the seeds: the two words before each one are a
lexical pattern of its kind. Patterns and the identifiers seen behind them form a graph, also with
look-alikes that no base rule accepts (numbers without a plus sign, addresses written with "(at)").
A pattern is as good as the share of its instances that are good; a look-alike is as good as its
patterns make it. Scores are passed to and fro for a few rounds, and look-alikes behind patterns of
high confidence are added.

Everything is an expression of the engine. Texts are read once, in one pass; the graph has a row for
each identifier of a text, and every score is a sum that is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import Scratch, cut, whole
from indicatrix.llm.spans import SPAN, Rule, found, joined, ranked

_DIGITS = r"regexp_replace({m}, '[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> CAST(d AS INT) * (1 + i % 2)), 0,"
    " (s, d) -> s + IF(d > 9, d - 9, d)) % 10 = 0"
)

#: The base rules, in the order of their kinds. Fixed values.
BASE = [
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')"),
    Rule(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"{t} rlike r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'",
        r"{m} rlike r'^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}$'",
    ),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", r"{t} rlike r'[0-9](?:[\x20-]?[0-9]){{11}}'", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]
KINDS = [r.kind for r in BASE]
_BETWEEN = r"[().\x20/-]"  # the punctuation of a number
_PIECE = r"[0-9]++(?:[()./-]++[0-9]++)*+"  # of a number, without a space
#: Look-alikes: what could be an identifier if the words before it say so. A number is a whole run of pieces;
#: of a run with more digits than an identifier has, each piece is one.
LIKE = [
    Rule(
        "number",
        rf"(?<![A-Za-z0-9.@+])\(?(?=[0-9](?:{_BETWEEN}*+[0-9]){{6}})"
        rf"(?:(?!(?:{_BETWEEN}*+[0-9]){{20}}){_PIECE}(?![A-Za-z@])(?:{_BETWEEN}*+{_PIECE}(?![A-Za-z@]))*+|{_PIECE}[A-Za-z@]?+)",
        r"{t} rlike r'[0-9][0-9().\x20/-]{{5}}'",
        f"{{m}} rlike '[0-9]$' AND length({_DIGITS}) BETWEEN 7 AND 19",
    ),
    Rule("address", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "{t} rlike r'[(\\[]at[)\\]]'"),
]

STILL = 6  # decimal places of scores that no round changes any more
MIN_SEEDS = 3.0  # the weight of different good instances that a pattern needs
CONFIDENT = 0.6  # the least score of a pattern that is used, and of a look-alike that is added

_PLACED = "struct<start: int, rank: int, end: int>"
_MENTION = "struct<kind: string, start: int, end: int, instance: string, pattern: string>"


def _mentions(spans: str, kind: str) -> str:
    """Spans as mentions: an identifier without its punctuation, behind the last two words before it."""
    instance = "lower(regexp_replace(s.value, r'[^\\p{L}\\p{N}@]', ''))"
    pattern = "lower(s.before)"
    return f"transform({spans}, s -> named_struct('kind', {kind}, 'start', s.start, 'end', s.end, 'instance', {instance}, 'pattern', {pattern}))"


def read(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row, doc_id, base, mentions`` of every row: the base spans by kind, and all mentions with a pattern."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), whole(text).alias("text"))
    rows = rows.select("doc_id", "row", *[F.expr(found(r, "text")).alias(r.kind) for r in BASE + LIKE])
    base = ", ".join(ranked(r.kind, i) for i, r in enumerate(BASE))
    rows = rows.withColumn("base", F.expr(f"concat({base})"))
    seeds = [_mentions(r.kind, f"'{r.kind}'") for r in BASE]
    others = [_mentions(r.kind, "CAST(NULL AS STRING)") for r in LIKE]
    mentions = f"filter(concat({', '.join(seeds + others)}), m -> m.pattern <> '')"
    counts = [F.expr(f"CAST(size({r.kind}) AS BIGINT)").alias(f"n_{r.kind}") for r in BASE]
    return rows.select("row", "doc_id", "base", *counts, F.expr(mentions).alias("mentions"))


def confident_patterns(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``pattern, kind, score`` of ``edges(pattern, instance, kind)``, in rounds until the scores stand still.

    ``kind`` of an edge is null for look-alikes. A pattern's score for a kind is the weight of its good
    instances over the number of all its instances plus one; it counts from ``MIN_SEEDS`` on. A
    look-alike's score is the chance that one of its patterns is right; a seed's is one. Scores only grow,
    and the driver sees two numbers a round.
    """
    sizes = edges.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    seeds = edges.where("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("good", F.lit(1.0))
    links = edges.select("pattern", "instance").distinct()
    like = edges.where("kind IS NULL").select("pattern", "instance").distinct().join(seeds.select("instance").distinct(), "instance", "left_anti")
    sizes, seeds, links, like = (scratch.keep(t) for t in (sizes, seeds, links, like))
    good, before = seeds, None
    while True:
        weight = links.join(good, "instance").groupBy("pattern", "kind").agg(F.sum("good").alias("weight"))
        scored = weight.where(F.col("weight") >= MIN_SEEDS).join(sizes, "pattern")
        scored = scored.select("pattern", "kind", (F.col("weight") / (F.col("instances") + 1)).alias("score"))
        scored = scratch.keep(scored.where(F.col("score") >= CONFIDENT))
        state = scored.agg(F.count(F.lit(1)), F.sum(F.round("score", STILL).cast("decimal(38,6)"))).first()
        if state == before or not state[0]:
            return scored
        before = state
        reached = like.join(scored, "pattern").groupBy("instance", "kind")
        reached = reached.agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("good"))
        good = seeds.unionByName(scratch.keep(reached))


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row.

    Counts and ``base_sha256`` are of the base rules; ``spans`` has the added ones too, as
    ``kind:start:end`` in code points, ends exclusive. A look-alike that overlaps a base span is never
    added; one whose patterns speak for several kinds has the kind with the best score, then the first
    name. Null texts are empty; repeated rows each have their row, and their identifiers count once in
    the graph; other columns are not looked at; an empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(read(docs, text))
        mentions = rows.select("row", F.expr("inline(mentions)"))
        edges = mentions.select("pattern", "instance", "kind").distinct()
        patterns = confident_patterns(edges, scratch)
        hits = mentions.where("kind IS NULL").drop("kind").join(patterns, "pattern").join(rows.select("row", "base"), "row")
        hits = hits.where("NOT exists(base, b -> b.start < end AND start < b.end)")
        rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
        best = hits.groupBy("row", "start", "end").agg(F.max(F.struct(F.col("score"), F.expr(f"-({rank})").alias("order"))).alias("best"))
        added = best.groupBy("row").agg(F.collect_list(F.expr("named_struct('start', start, 'rank', CAST(-best.order AS INT), 'end', end)")).alias("added"))
        rows = rows.drop("mentions").join(added, "row", "left").withColumn("added", F.coalesce("added", F.expr(f"CAST(array() AS array<{_PLACED}>)")))
        counts = [f"n_{k}" for k in KINDS]
        return cut(
            rows.select(
                "doc_id",
                *counts,
                F.sha2(F.expr(joined("base", KINDS)), 256).alias("base_sha256"),
                F.expr(joined("concat(base, added)", KINDS)).alias("spans"),
                F.size("added").cast("bigint").alias("n_added"),
            )
        )
