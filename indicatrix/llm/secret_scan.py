"""Secrets by an incremental ledger of blobs.

Every version of every text is addressed by its content (SHA-256). The ledger has a row for each blob,
rule and rule version that was ever scanned, with what was found. A run scans only pairs of blob and
rule version that the ledger lacks, each blob once however many rows hold it, and joins the findings
back to all rows. Raising a rule's version scans all blobs again for that rule alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import cut, whole
from indicatrix.llm.spans import SPAN, Rule, found, joined, ranked

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"

#: The rules every scan has. Fixed values.
BASE = [
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]++", "{t} rlike r'" + _ASSIGN + r"[A-Za-z0-9+/_.=-]'", "length(regexp_extract({m}, r'^" + _ASSIGN + r"([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
    Rule("access", r"AKIA[A-Z0-9]++", "contains({t}, 'AKIA')", "length({m}) >= 20"),
    Rule("hex", r"(?:(?<![0-9a-f])|\G)[0-9a-f]++", "{t} rlike '(?<![0-9a-f])[0-9a-f]{{24}}'", "length({m}) >= 24"),
]
#: What this library adds: tokens with a prefix or a frame of their own.
ADDED = [
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", "contains({t}, 'eyJ')"),
    Rule("prefixed", r"(?<![A-Za-z0-9_])(?:gh[opsu]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)", "{t} rlike 'gh[opsu]_|xox[abprs]-|sk_live_'"),
    Rule("key_block", r"-----BEGIN [A-Z ]*?PRIVATE KEY-----", "contains({t}, 'PRIVATE KEY-----')"),
]
RULES = BASE + ADDED
LEDGER = f"blob string, rule string, version int, spans array<{SPAN}>"


def blobs(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``blob, text``, each blob once; copies are combined before the shuffle. A null text is empty.

    Texts that no rule's guard lets through hold nothing, so their blobs go without them.
    """
    rows = docs.select(F.sha2(whole(text), 256).alias("blob"), whole(text).alias("text"))
    may = " OR ".join(f"({rule.guard.format(t='text')})" for rule in rules) or "false"
    return rows.select("blob", F.expr(f"IF({may}, text, '') AS text")).groupBy("blob").agg(F.first("text").alias("text"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The ledger rows that ``ledger`` lacks for the texts of ``docs``: ``blob, rule, version, spans``.

    To go on, append them to the ledger. A blob that has nothing has rows too, with no spans.
    """
    held = blobs(docs, rules, text)
    if ledger is None:
        held = held.withColumn("seen", F.expr("CAST(array() AS array<string>)"))
    else:
        now = [f"{r.kind}@{r.version}" for r in rules]
        seen = ledger.select("blob", F.expr("concat(rule, '@', version)").alias("pair")).where(F.col("pair").isin(now))
        held = held.join(seen.groupBy("blob").agg(F.collect_set("pair").alias("seen")), "blob", "left")
        held = held.withColumn("seen", F.coalesce("seen", F.expr("CAST(array() AS array<string>)")))
    held = held.where(F.expr(f"size(seen) < {len(rules)}"))
    rows = ", ".join(
        f"IF(array_contains(seen, '{r.kind}@{r.version}'), NULL,"
        f" named_struct('rule', '{r.kind}', 'version', {r.version}, 'spans', {found(r, 'text')}))"
        for r in rules
    )
    return held.select("blob", F.expr(f"filter(array({rows}), r -> r IS NOT NULL)").alias("rows")).selectExpr("blob", "inline(rows)")


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """``ledger`` with the rows it lacks for the texts of ``docs``, which are scanned once and stored.

    The next run takes the result as its ledger: it scans new blobs, and known ones for rules with a
    version the ledger does not have. An empty table adds nothing.
    """
    new = cut(scan(docs, ledger, rules, text))
    return new if ledger is None else ledger.unionByName(new)


def findings(docs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``findings``: a map from the kind of a rule to its spans in that row's text.

    Only ledger rows of the rules' versions count; kinds without spans are left out. A column of the name
    ``findings`` is replaced.
    """
    current = ledger.join(F.broadcast(ledger.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")), ["rule", "version"])
    by_blob = current.where("size(spans) > 0").dropDuplicates(["blob", "rule"]).groupBy("blob")
    by_blob = cut(by_blob.agg(F.map_from_entries(F.collect_list(F.struct("rule", "spans"))).alias("findings")))
    key = "indicatrix_blob"
    rows = docs.drop("findings").withColumn(key, F.sha2(whole(text), 256)).join(by_blob.withColumnRenamed("blob", key), key, "left").drop(key)
    return rows.withColumn("findings", F.coalesce("findings", F.expr(f"CAST(map() AS map<string, array<{SPAN}>>)")))


def secret_spans(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row; places are code points, ends exclusive.

    Null texts are empty; repeated rows each have their row; other columns are not looked at; an empty
    table gives an empty result. ``base_sha256`` and the counts are of the base rules alone. What ``ledger``
    knows is not scanned again; see :func:`update` to keep what this run adds.
    """
    known = update(docs.select(F.col(text).alias("text")), ledger)
    rows = findings(docs.select("doc_id", F.col(text).alias("text")), known)
    kinds = [r.kind for r in RULES]

    def of(rules):
        each = (ranked(f"coalesce(findings['{r.kind}'], array())", kinds.index(r.kind)) for r in rules)
        return joined(f"concat({', '.join(each)})", kinds)

    counts = [F.expr(f"CAST(coalesce(size(findings['{r.kind}']), 0) AS BIGINT)").alias(f"n_{r.kind}") for r in BASE]
    return rows.select("doc_id", *counts, F.sha2(F.expr(of(BASE)), 256).alias("base_sha256"), F.expr(of(RULES)).alias("spans"))
