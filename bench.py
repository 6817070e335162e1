"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
Every query is computed in full into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from indicatrix.plans.queries import QUERIES, corpus

HEADLINE = [
    "refang",
    "extract_all",
    "extract_wide",
    "dedup_first",
    "flatten_export",
    "stix_indicators",
    "report_markdown_lines",
    "enrich_merge_last",
    "feed_union_all",
    "rep_vt_hash",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("indicatrix-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    size = corpus(spark, sf_dir).selectExpr("count(*) AS n", "sum(length(text)) AS chars").collect()[0]

    def timed(rows) -> float:
        start = time.perf_counter()
        rows(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    derive = timed(corpus)  # what every corpus query pays before it begins
    seconds = {name: timed(QUERIES[name]) for name in HEADLINE}

    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps({
            "metric": "total_seconds",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": float(match.group(1)) if match else None,
            "documents": size.n,
            "million_chars": round(size.chars / 1e6, 1),
            "derive_inputs": derive,
            "extract_million_chars_per_sec": round(size.chars / 1e6 / max(seconds["extract_all"] - derive, 0.001), 2),
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
