"""What is dealt out: numbers and keys rather than texts, and no group to one task."""

import os

import pytest
from pyspark.sql import functions as F

from indicatrix.operators import numbering, report
from indicatrix.operators import reputation as rep
from indicatrix.plans import derived as D
from indicatrix.plans import queries as Q
from indicatrix.plans.tables import emptying, stored
from indicatrix.sources import feedfiles, feeds


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joins_sort(spark):
    """No table is small enough to be sent around unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def orders(spark, tmp_path):
    folder = tmp_path / "tables"
    rows = spark.range(300).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").union(spark.sql("SELECT NULL, 3L UNION ALL SELECT 5L, 2L"))
    rows.write.parquet(f"{folder}/orders.parquet")
    spark.range(5).selectExpr("id AS doc_id", "'at 1.2.3.4' AS text").write.parquet(f"{folder}/documents.parquet")
    spark.range(5).selectExpr("id AS page_id", "'http://a.com' AS url", "'<p>' AS html").write.parquet(f"{folder}/pages.parquet")
    spark.range(5).selectExpr("id AS conv_id", "id AS turn", "'hi' AS text").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_groups_meet_numbers_where_their_rows_are(spark, joins_sort):
    """joined by sorting, all rows of a type or provider would go to one task."""
    rows = spark.range(500).selectExpr("IF(id % 50 = 0, 'ipv4', 'hash_md5') AS type", "'v' || id AS value", "CAST(id AS DECIMAL(38, 0)) AS ord")
    top = report.top_per_type(rows, 3)
    asked = rep.lookup_budget(rows, "virustotal", 12)
    assert "SortMergeJoin" not in plan(top) and "SortMergeJoin" not in plan(asked)
    assert sorted((r.type, r.rank, r.value) for r in top.collect()) == [("hash_md5", 1, "v1"), ("hash_md5", 2, "v2"), ("hash_md5", 3, "v3"), ("ipv4", 1, "v0"), ("ipv4", 2, "v50"), ("ipv4", 3, "v100")]
    assert sorted(r.lookup_no for r in asked.collect()) == list(range(1, 13))


def test_stored_rows_are_columns(spark):
    """a long path beside each line was as many bytes as it has letters."""
    rows = stored(spark.range(0, 20000, 1, 2).selectExpr("id", "repeat('/long/path', 20) AS file"), "rows")
    (first, *_) = [f.removeprefix("file:") for f in rows.inputFiles()]
    folder = os.path.dirname(first)
    assert sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)) < 20000 * 20
    assert rows.count() == 20000 and rows.select("file").distinct().count() == 1


def test_lines_are_numbered_as_read(spark, tmp_path):
    """the same places as by sorting, over files and splits, and no exchange with the lines."""
    for snapshot, n in ((1, 400), (2, 30)):
        folder = tmp_path / "feed=feodo" / f"snapshot={snapshot}"
        folder.mkdir(parents=True)
        for part in range(2):
            (folder / f"part-{part}.txt").write_text("".join(f"#c\n{part}.{i}\n\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = feedfiles.read_lines(spark, str(tmp_path))
        assert lines.select("split").distinct().count() > 3
        found = feedfiles.text_lines(lines, as_read=True)
        kept = feedfiles.text_lines(stored(lines, "lines"))
        assert found.count() == 860 and same(found, kept)
        assert not [line for line in plan(found).splitlines() if "Exchange" in line and "value" in line]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_lines_stay_where_they_are_read(spark, tmp_path):
    """neither the open state nor the places of records sort or deal out the lines; only records of several lines meet."""
    folder = tmp_path / "feed=urlhaus" / "snapshot=1"
    folder.mkdir(parents=True)
    (folder / "body.txt").write_text("".join(f'# c\n"{i}","a,b"\n"{i}","two\nlines"\n\n' for i in range(50)))
    rows = feedfiles.csv_table(feedfiles.read_lines(spark, str(tmp_path)))
    assert "Window" not in plan(rows) and "Sort" not in plan(rows)
    want = [(2 * i + j, 2, str(i), c) for i in range(50) for j, c in enumerate(("a,b", "two\nlines"))]
    assert sorted((r.ord, r.width, r.c0, r.c1) for r in rows.collect()) == want


def test_fallback_alone_numbers_no_values(spark, tmp_path):
    """raw lines have places of their own, so the values of other snapshots are not sorted for them."""
    for snapshot, text in ((1, "1,2,http://a.com\n1,2,http://b.com"), (2, "# none\n\nsee a.com \n1,2")):
        (tmp_path / "feed=urlhaus" / f"snapshot={snapshot}").mkdir(parents=True)
        (tmp_path / "feed=urlhaus" / f"snapshot={snapshot}" / "body.txt").write_text(text)
    (tmp_path / "feed=feodo" / "snapshot=3").mkdir(parents=True)
    (tmp_path / "feed=feodo" / "snapshot=3" / "body.txt").write_text("1.2.3.4")
    found = feedfiles.parse_files(lambda *names: feedfiles.read_lines(spark, str(tmp_path), *names))
    assert same(found, feedfiles.parse_files(stored(feedfiles.read_lines(spark, str(tmp_path)), "lines")))
    raw = found.where("fallback")
    assert any("feed-values" in f for f in found.inputFiles()) and not any("feed-values" in f for f in raw.inputFiles())
    assert sorted((r.snapshot, r.ord, r.value) for r in raw.collect()) == [(2, 0, "# none"), (2, 1, "see a.com "), (2, 2, "1,2")]
    assert sorted((r.snapshot, r.ord, r.value) for r in found.where("NOT fallback").collect()) == [(1, 0, "http://a.com"), (1, 1, "http://b.com"), (3, 0, "1.2.3.4")]


def test_blocks_can_be_left_out(spark):
    rows = spark.range(0, 9, 1, 1).selectExpr("1 AS g", "id DIV 3 AS b", "id", "id = 4 AS bad")
    found = numbering.along(rows, ["g"], ["b"], without="bad")
    assert sorted((r.id, r.ord) for r in found.collect()) == [(0, 0), (1, 1), (2, 2), (6, 3), (7, 4), (8, 5)]


def test_feed_parts_are_dealt_out_as_numbers(spark, orders):
    """the files hold the parts of the statement that the SQL uses, in its order."""
    keys, body = D.feed_keys()
    parts = D.for_spark(spark, orders, keys).selectExpr("feed", "snapshot", "o_orderkey AS key", f"{body} AS body")
    assert same(parts, D.for_spark(spark, orders, D.feed_files(D.SPARK)))
    keys, body = D.cert_keys(("NL", "FR"))
    parts = D.for_spark(spark, orders, keys).selectExpr("feed", "snapshot", f"{body} AS body")
    assert same(parts, D.for_spark(spark, orders, D.cert_files(("NL", "FR"))).drop("key"))


def test_reports_are_dealt_out_as_numbers(spark, orders):
    """the text of a report is made where it is read."""
    docs = Q.corpus(spark, orders)
    dealt = [line for line in plan(docs).splitlines() if "Exchange" in line]
    assert any("o_orderkey" in line for line in dealt) and same(docs, D.for_spark(spark, orders, D.corpus(D.SPARK)))


def test_digests_are_grouped_by_number(spark, orders):
    """Digests are made after the only shuffle; a number that comes twice counts twice."""
    rows = D.for_spark(spark, orders, D.rep_raw(D.SPARK, "otx", "hash"))
    dealt = [line for line in plan(rows).splitlines() if "Exchange" in line]
    assert dealt and not any("sha" in line or "md5" in line for line in dealt)
    assert same(rows, D.for_spark(spark, orders, D.rep_raw(D.SPARK, "otx", "hash").replace("GROUP BY o_orderkey", "GROUP BY 1")))


def test_feeds_are_done_in_groups(spark, orders, monkeypatch):
    """When feeds land, the files of those before are gone; F6: so is what was stored on the way."""
    import glob

    from indicatrix.plans import tables

    base = os.path.dirname(tables.scratch(spark, "x")).removeprefix("file:")
    before = set(glob.glob(f"{base}/*"))

    def there():
        return {os.path.basename(f).rsplit("-", 1)[0] for f in set(glob.glob(f"{base}/*")) - before if glob.glob(f"{f}/**/part-0000[1-9]*", recursive=True) or glob.glob(f"{f}/feed=*")}

    land, found = Q.land_feeds, []
    monkeypatch.setattr(Q, "land_feeds", lambda *args, **named: (found.append(there()), land(*args, **named))[1])
    assert sorted(name for names in Q.FEED_GROUPS for name in names) == sorted(feeds.FEEDS)
    monkeypatch.setattr(Q, "FEED_GROUPS", [["sslbl"], ["talos", "bambenek_c2"]])
    for query in ("feed_text_lines", "feed_raw_fallback"):
        rows = Q.QUERIES[query](spark, orders)
        found.append(there())
        assert len(found) == 3 and not any("feeds" in names for names in found)
        if query == "feed_raw_fallback":
            assert not any(names & {"feed-values", "csv-lines"} for names in found)
        assert rows.count() > 0
        found.clear()
        before |= set(glob.glob(f"{base}/*"))


def test_one_feed_lands_in_order(spark, tmp_path):
    """A feed that is landed alone has its parts in the order it has among others."""
    rows = spark.range(4000).selectExpr("CAST(pmod(hash(id), 2000) AS BIGINT) AS o_orderkey", "id % 997 AS o_custkey")
    rows.repartition(5).write.parquet(f"{tmp_path}/orders.parquet")

    def lines(names):
        files = spark.read.text(Q.land_group(spark, str(tmp_path), names), wholetext=True).where("feed = 'threatfox'")
        return {r.snapshot: r.value for r in files.collect()}

    alone, among = lines(["threatfox"]), lines(["threatfox", "talos"])
    assert len(alone) == 10 and alone == among


def test_kept_rows_outlive_their_block(spark):
    with emptying(spark):
        gone, kept = stored(spark.range(3), "gone"), stored(spark.range(4), "kept", stays=True)
        assert gone.count() == 3
    assert kept.count() == 4 and spark.read.parquet(os.path.dirname(gone.inputFiles()[0])).count() == 0


def test_stored_rows_leave_no_shuffle_files(spark):
    """what was dealt out for stored rows is not needed behind them."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = {i for i in range(20000) if tracker.containsShuffle(i)}
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not {i for i in range(20000) if tracker.containsShuffle(i)} - before
    assert rows.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_answers_are_dealt_out_by_key_alone(spark, joins_sort):
    """indicators and answers meet by key, and what is merged by value stays there."""
    listed = spark.createDataFrame([("domain", "b.com"), ("domain", "b.com"), ("ipv4", "8.8.8.8"), ("url", "http://a")], "type string, value string")
    body = '{"pulse_info": {"count": %d}}'
    rows = [("otx", "domain", "b.com", t, body % n) for t, n in ((1, 1), (None, 2), (3, 3))]
    rows += [("otx", "ip", "8.8.8.8", None, body % 4), ("greynoise", "ip", "8.8.8.8", 1, "{}"), ("otx", "ip", "b.com", 9, body % 5), (None, "ip", "8.8.8.8", 1, "{}")]
    schema = "provider string, kind string, key string, landed int, body string"
    answers = spark.createDataFrame(rows, schema)
    found = rep.enrich(listed, answers, at="landed")
    assert plan(rep.merge_all(found)).count("Exchange hashpartitioning") == 2
    want = sorted(map(tuple, rep.enrich(listed, rep.newest(answers)).collect()))
    assert sorted(map(tuple, found.collect())) == want and len(want) == 4  # as often as listed
    ties = answers.union(spark.createDataFrame([("otx", "domain", "b.com", 3, body % 7), ("otx", "ip", "8.8.8.8", None, body % 4)], schema))
    want = sorted(map(tuple, rep.enrich(listed, rep.newest(ties)).collect()))
    assert sorted(map(tuple, rep.enrich(listed, ties, at="landed").collect())) == want and len(want) == 4
    few = rep.enrich(listed.withColumn("ord", F.lit(1)), ties, ["otx"], 2, at="landed")
    assert {r.provider for r in few.collect()} == {"otx"}
