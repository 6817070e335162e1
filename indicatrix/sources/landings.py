"""What lands again and again: the newest landing of each key, and what changed between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicatrix.operators.numbering import overall
from indicatrix.plans.tables import checkpointed


def newest(landed: DataFrame, keys: list[str], at: str = "landed", wanted: DataFrame | None = None) -> DataFrame:
    """The rows of ``landed`` with the latest ``at`` of their ``keys``, one for each; a null ``at`` is the earliest.

    Of rows landed at the same time, the one with the largest hash of its other columns counts. Keys and
    times come first and alone, and are stored; ``wanted`` keys cut them. Only then are the other columns
    read, for the rows that stay, and nothing wide is grouped but ties.
    """
    # Dealt out by key once, for the counts, the times and the wanted keys.
    dealt = landed.select(*keys, at).repartition(*keys)
    if wanted is not None:
        dealt = dealt.join(wanted.select(*keys).distinct(), keys, "left_semi")
    per_time = dealt.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("_n"))
    latest = per_time.groupBy(*keys).agg(F.max(at).alias("_at"), F.coalesce(F.max_by("_n", at), F.max("_n")).alias("_n"))
    names = [f"_{key}" for key in keys]
    latest = checkpointed(latest.toDF(*names, "_at", "_n"), "latest")
    same = F.col(at).eqNullSafe(F.col("_at"))
    for key, name in zip(keys, names):
        # Wanted keys are not null; a plain join keeps rows dealt out by key for the next one.
        same &= F.col(key).eqNullSafe(F.col(name)) if wanted is None else F.col(key) == F.col(name)
    # One row for each key, unless some landed at the same time: those are few.
    alone = landed.join(latest.where("_n = 1"), same).select(*landed.columns)
    if latest.where("_n > 1").isEmpty():
        return alone
    ties = landed.join(latest.where("_n > 1"), same).select(*landed.columns)
    rest = [c for c in landed.columns if c not in keys]
    ties = ties.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row")).select(*keys, "_row.*")
    return alone.unionByName(ties)


def changes(landed: DataFrame, key: str = "url", run: str = "run", at: str = "landed", body: str = "body") -> DataFrame:
    """``run, key, state, digest``: what each run brought for each key, by the SHA-256 of its body.

    A key is ``new`` in a run if the run before had none, else ``same`` or ``changed``; it is ``gone`` in a
    run without it after one with it, and the digest is then the last one. Of several landings of a key in
    one run the newest counts. Null bodies count as empty; rows without key or run do not count. Only
    digests are grouped, by key; a run is a row among runs.
    """
    known = landed.where(F.col(key).isNotNull() & F.col(run).isNotNull())
    digest = F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("digest")
    digests = newest(known.select(key, run, at, digest), [key, run], at).select(key, run, "digest")
    runs = overall(known.select(run).distinct(), run, into="_run")
    rows = digests.join(runs, run)
    mine = Window.partitionBy(key).orderBy("_run")
    rows = rows.select("*", F.lag("_run").over(mine).alias("_back"), F.lag("digest").over(mine).alias("_before"), F.lead("_run").over(mine).alias("_next"))
    state = "CASE WHEN _back <=> _run - 1 THEN IF(_before = digest, 'same', 'changed') ELSE 'new' END AS state"
    brought = rows.selectExpr(run, key, state, "digest")
    left = rows.where("NOT _next <=> _run + 1").selectExpr(key, "digest", "_run + 1 AS _run").join(runs, "_run")
    return brought.unionByName(left.selectExpr(run, key, "'gone' AS state", "digest"))
