"""Duplicates, filters, reports, sinks, reputation."""

import csv
import json
import uuid

import pytest

from indicatrix.functions.constants import PROVIDERS
from indicatrix.operators import dedup, report
from indicatrix.operators import reputation as R
from indicatrix.operators.extract import extract_indicators
from indicatrix.plans.tables import scratch
from indicatrix.sinks import csvfile, jsonfile, lines, reports, stix
from indicatrix.sources import landings

TEXTS = [
    "b.com a.com http://c.com/x?\"q\" 9.9.9.9",
    "c.com 8.8.8.8 9.9.9.9 CVE-2024-1234 T1059 u@d.org " + "ab" * 16,
    "A.com a.com http://z.com/, 9.9.9.9",
]


@pytest.fixture(scope="module")
def found(docs):
    return extract_indicators(docs(*TEXTS)).cache()


@pytest.fixture(scope="module")
def listed(found):
    return dedup.first_seen(found).cache()


def values(rows, type_):
    return [r.value for r in rows.where(f"type = '{type_}'").orderBy("type_ord", "ord").collect()]


def test_first_seen_order(listed):
    # Direct matches of all documents come before domains derived from URLs.
    assert values(listed, "domain") == ["b.com", "a.com", "c.com", "d.org", "A.com", "z.com"]
    assert values(listed, "ipv4") == ["9.9.9.9", "8.8.8.8"]


def test_positions_round_trip(spark):
    rows = [("url", "x", True, 9999, 2**63 - 1, 2**31 - 1), ("url", "y", False, 0, -(2**63), 0)]
    df = spark.createDataFrame(rows, "type string, value string, derived boolean, source_ord int, doc_id bigint, pos int")
    back = dedup.unpack_position(dedup.first_seen(df))
    got = {(r.type, r.value, r.derived, r.source_ord, r.doc_id, r.pos) for r in back.collect()}
    assert got == set(rows)
    order = [r.value for r in dedup.with_position(df).orderBy("ord").collect()]
    assert order == ["y", "x"]


def test_first_seen_plan(docs):
    found = extract_indicators(docs(*TEXTS))
    plan = dedup.first_seen(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_hot_value_is_combined_before_the_shuffle(spark):
    rows = spark.range(200_000).selectExpr(
        "'ipv4' AS type", "CASE WHEN id % 3 = 0 THEN '8.8.8.8' ELSE concat('10.0.0.', id % 200) END AS value",
        "false AS derived", "1 AS source_ord", "id AS doc_id", "0 AS pos")
    out = dedup.unpack_position(dedup.first_seen(rows)).where("value = '8.8.8.8'").collect()
    assert [(r.doc_id, r.pos) for r in out] == [(0, 0)]


def test_distinct(found, listed):
    assert dedup.distinct_indicators(found).count() == listed.count()


def test_filter_and_counts(found, listed):
    assert {r.type for r in report.filter_types(listed, "ip,hash").collect()} == {"ipv4", "hash_md5"}
    assert report.filter_types(listed, "nonsense").count() == 0
    assert {r.type: r.n for r in report.count_total(listed).collect()}["total"] == listed.count()
    assert report.count_total(found).where("type = 'total'").collect()[0].n == found.count()
    assert {(r.type, r.n, r.present) for r in report.hash_family_counts(listed).collect()} == {
        ("hash_md5", 1, True), ("all", 1, True)}


def test_top_per_type(listed):
    top = report.top_per_type(listed, 2).where("type = 'domain'").orderBy("rank").collect()
    assert [r.value for r in top] == ["b.com", "a.com"]
    assert {r.type: r.more for r in report.overflow_per_type(listed, 2).collect()}["domain"] == 4


def test_top_list_of_any_length(spark):
    """No task sorts a type: rows are cut by a threshold, then dealt out by ranges."""
    rows = spark.range(60_000).selectExpr("IF(id % 6 = 0, 'a', 'b') AS type", "CAST(id * 7919 % 60000 AS DECIMAL(38, 0)) AS ord", "id AS value").repartition(6)
    order = {t: sorted(r.ord for r in rows.where(f"type = '{t}'").collect()) for t in "ab"}
    for k in (1, 50, 45_000, 10**6):
        top = report.top_per_type(rows, k)
        got = sorted((r.type, r["rank"], r.ord) for r in top.select("type", "rank", "ord").collect())
        assert got == [(t, i + 1, o) for t in "ab" for i, o in enumerate(order[t][:k])]
        plan = top._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
    assert report.top_per_type(rows.where("false"), 5).count() == 0


def test_flatten(listed):
    rows = {r.value: r for r in report.flatten_export(listed, "src").collect()}
    assert (rows["a.com"].confidence, rows["a.com"].note) == ("Medium", "Extracted domain indicator")
    assert rows["9.9.9.9"].confidence == "Low" and rows["T1059"].confidence == "High" and rows["T1059"].source == "src"


def test_source_label(spark):
    label = report.source_label("files", "url", "cert", "label")
    rows = [(["a", "b"], "", "", "l"), (list("abcd"), "", "", "l"), ([], "http://u", "TR", "l"), ([], "", "TR", "l"), ([], "", "", "l")]
    df = spark.createDataFrame(rows, "files array<string>, url string, cert string, label string")
    assert [r.out for r in df.selectExpr(f"{label} AS out").collect()] == ["a, b", "4 dosya", "http://u", "CERT-TR", "l"]


def read_parts(path):
    import glob

    parts = sorted(glob.glob(f"{path}/part-*"))
    return [open(p, encoding="utf-8", newline="").read() for p in parts]


def test_csv_file(spark, listed):
    path = scratch(spark, "csv")
    rows = report.flatten_export(listed, 'say "x", y')
    csvfile.write_csv(rows, path)
    text = "".join(read_parts(path))
    assert text.startswith("type,value,confidence,source,note\r\n") and text.count("\r\n") == listed.count() + 1
    read = list(csv.DictReader(text.splitlines()))
    assert [r["value"] for r in read if r["type"] == "domain"] == values(listed, "domain")
    assert {r["source"] for r in read} == {'say "x", y'}
    line = csvfile.csv_document(rows).where("line LIKE 'url,%z%'").collect()[0].line
    assert line == 'url,"http://z.com/,",Medium,"say ""x"", y",Extracted URL indicator'


def test_json_with_many_unsorted_answers(spark):
    """A thousand answers over several tasks, written, read back in name order and parsed."""
    texts = spark.range(1000).selectExpr("1 AS source_ord", "'t' AS source", "id AS doc_id", "concat('x', hash(id) & 4095, 'y', id, '.com 10.0.', id DIV 250, '.', id % 250) AS text")
    many = dedup.first_seen(extract_indicators(texts.repartition(7)))
    answers = many.where("type = 'domain'").selectExpr("value", "concat('{\"d\":\"', value, '\"}') AS payload").repartition(5)
    path = scratch(spark, "json")
    jsonfile.write_json(jsonfile.json_document(many, "s", "now", tlp="TLP:RED", enrichment=answers), path)
    data = json.loads("".join(read_parts(path)))
    assert len(data["enrichment"]) == answers.count() == 1000 and len(data["iocs"]["domains"]) == 1000


def test_json_document(spark, listed):
    answers = spark.createDataFrame([("9.9.9.9", '{"ip":"9.9.9.9"}'), ("a.com", '{"domain":"a.com"}')], "value string, payload string")
    for kwargs in ({}, {"tlp": "TLP:RED"}, {"tlp": "TLP:RED", "enrichment": answers}, {"enrichment": answers.limit(0)}):
        document = lines.document_lines(jsonfile.json_document(listed, 'a "b"', "now", **kwargs))
        path = scratch(spark, "json")
        lines.write_document(jsonfile.json_document(listed, 'a "b"', "now", **kwargs), path)
        text = "\n".join(r.line for r in document.collect())
        assert "".join(read_parts(path)).strip() == text
        data = json.loads(text)
        assert data["metadata"]["total_iocs"] == listed.count() and data["metadata"]["source"] == 'a "b"'
        assert data["iocs"]["domains"] == values(listed, "domain") and data["iocs"]["ipv6"] == []
        assert data["iocs"]["metadata"] == {"extracted_at": "now"}
        if not kwargs:
            assert text == json.dumps(data, indent=2, ensure_ascii=False)
        if kwargs.get("enrichment") is answers:
            assert data["enrichment"]["a.com"] == {"domain": "a.com"}
        else:
            assert "enrichment" not in data


def test_empty_documents(listed):
    none = listed.where("false")
    text = "\n".join(r.line for r in lines.document_lines(jsonfile.json_document(none, "s", "now")).collect())
    assert json.loads(text)["iocs"]["urls"] == []
    bundle = stix.stix_bundle(stix.stix_objects(none, "High", "x", "now"), "bundle--1")
    assert json.loads("\n".join(r.line for r in lines.document_lines(bundle).collect()))["objects"] == []
    md = [r.line for r in lines.document_lines(reports.markdown_report(none, "s", "now")).collect()]
    assert "- **Toplam IOC:** **0**" in md
    txt = [r.line for r in lines.document_lines(reports.text_report(none, "s", "now")).collect()]
    assert txt[-1] == "Total IOCs: 0" and "[Hashes]" not in txt


def test_markdown(listed):
    md = [r.line for r in lines.document_lines(reports.markdown_report(listed, "s", "now", top=2)).collect()]
    assert md[0].startswith("# ") and "| Domain Adları | 6 |" in md
    at = md.index("### Domain Adları (6 adet)")
    assert md[at + 1 : at + 5] == ["- `b.com`", "- `a.com`", "- ... ve 4 adet daha", ""]


def test_text(listed):
    txt = [r.line for r in lines.document_lines(reports.text_report(listed, "s", "now")).collect()]
    at = txt.index("[IPv4 Addresses] (2 found)")
    assert txt[at + 1 : at + 4] == ["  - 9.9.9.9", "  - 8.8.8.8", ""]
    at = txt.index("[Hashes]")
    assert txt[at + 1 :] == ["  MD5 (1 found):", "    - " + "ab" * 16, "", f"Total IOCs: {listed.count()}"]


def test_stix(listed):
    objects = stix.stix_objects(listed, "Low", "tlp:green", "2025-01-01T00:00:00.000Z")
    data = json.loads("\n".join(r.line for r in lines.document_lines(stix.stix_bundle(objects, "bundle--1")).collect()))
    assert data["type"] == "bundle" and len(data["objects"]) == listed.where("type NOT IN ('cve', 'mitre')").count()
    by_name = {o["name"]: o for o in data["objects"]}
    ip = by_name["ipv4 indicator: 9.9.9.9"]
    assert ip["pattern"] == "[ipv4-addr:value = '9.9.9.9']" and ip["confidence"] == 25
    assert ip["object_marking_refs"] == ["marking-definition--34098fce-860f-48ae-8e50-ebd3cc5e41da"]
    assert ip["id"] == "indicator--" + str(uuid.uuid5(uuid.UUID(stix.ID_NAMESPACE), "ipv4|9.9.9.9"))
    random = stix.stix_objects(listed, "Low", "x", "now", random_ids=True).selectExpr("object.id AS id").collect()
    assert len({r.id for r in random}) == len(data["objects"])


BODIES = [
    ("virustotal", "ip", "9.9.9.9", '{"data":{"attributes":{"last_analysis_stats":{"malicious":3},"country":null}}}'),
    ("virustotal", "ip", "8.8.8.8", "rate limited"),
    ("virustotal", "domain", "b.com", '{"data":{"attributes":{}}}'),
    ("virustotal", "domain", "a.com", '{"data":null}'),
    ("virustotal", "hash", "ab" * 16, '{"data":{"attributes":{"names":["1","2","3","4","5","6"]}}}'),
    ("otx", "domain", "b.com", '{"pulse_info":{"count":2},"whois":"' + "w" * 300 + '"}'),
    ("otx", "ip", "9.9.9.9", "{}"),
    ("abuseipdb", "ip", "9.9.9.9", '{"data":{"abuseConfidenceScore":85,"isPublic":false}}'),
    ("shodan", "ip", "9.9.9.9", '{"ports":[22,80],"vulns":["CVE-1"],"os":null}'),
    ("greynoise", "ip", "9.9.9.9", '{"noise":true}'),
]


@pytest.fixture(scope="module")
def rep_raw(spark):
    return spark.createDataFrame(BODIES, "provider string, kind string, key string, body string")


def test_projections(rep_raw):
    vt = R.project_reputation(rep_raw, "virustotal", "ip").collect()
    assert [(r.key, r.malicious, r.harmless, r.country, r.as_owner) for r in vt] == [("9.9.9.9", 3, 0, None, "N/A")]
    assert R.project_reputation(rep_raw, "virustotal", "hash").collect()[0].names == list("123456")
    assert R.project_reputation(rep_raw, "virustotal", "hash", max_names=5).collect()[0].names == list("12345")
    assert [r.key for r in R.project_reputation(rep_raw, "virustotal", "domain").collect()] == ["b.com"]
    assert len(R.project_reputation(rep_raw, "otx", "domain", max_whois=200).collect()[0].whois) == 200
    shodan = R.project_reputation(rep_raw, "shodan", "ip").collect()[0]
    assert (shodan.ports, shodan.vulns, shodan.os, shodan.org) == ([22, 80], ["CVE-1"], None, "N/A")
    grey = R.project_reputation(rep_raw, "greynoise", "ip").collect()[0]
    assert (grey.noise, grey.riot, grey.classification, grey.link) == (True, False, "unknown", "")
    abuse = R.project_reputation(rep_raw, "abuseipdb", "ip").collect()[0]
    assert (abuse.abuse_confidence_score, abuse.total_reports, abuse.is_public) == (85, 0, False)


def test_answer_is_parsed_once(rep_raw):
    plan = R.project_reputation(rep_raw, "virustotal", "hash")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_budget(listed):
    rows = R.lookup_budget(listed, "virustotal", 4).orderBy("lookup_no").collect()
    assert [r.value for r in rows] == ["9.9.9.9", "8.8.8.8", "b.com", "a.com"]
    assert [r.kind for r in rows] == ["ip", "ip", "domain", "domain"]
    assert R.lookup_budget(listed, "shodan", 10).count() == 2
    assert R.lookup_budget(listed, "otx", 0).count() == 0


def test_budget_has_no_single_task(listed):
    plan = R.lookup_budget(listed, "virustotal", 4)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    both = R.lookup_budgets(listed, ["otx", "virustotal"], 2).collect()
    assert sorted((r.provider, r.lookup_no) for r in both) == [("otx", 1), ("otx", 2), ("virustotal", 1), ("virustotal", 2)]


def test_failed_lookups_cost_budget(listed, rep_raw):
    rows = R.enrich_provider(listed, rep_raw, "virustotal", 3).collect()
    assert {r.value for r in rows} == {"9.9.9.9", "b.com"}


def test_merge(listed, rep_raw):
    found = R.enrich(listed, rep_raw, max_lookups=100)
    last = {r.value: r for r in R.merge_last(found).collect()}
    assert last["9.9.9.9"].provider == "greynoise" and last["b.com"].provider == "otx"
    assert json.loads(last["9.9.9.9"].payload) == {
        "ip": "9.9.9.9", "noise": True, "riot": False, "classification": "unknown", "name": "N/A", "link": ""}
    both = {r.value: r.answers for r in R.merge_all(found).collect()}
    assert set(both["9.9.9.9"]) == set(PROVIDERS) and set(both["b.com"]) == {"virustotal", "otx"}
    some = R.enrich(listed, rep_raw, ["otx"], 100)
    assert {r.provider for r in some.collect()} == {"otx"}
    assert R.enrich(listed, rep_raw, [], 100).count() == 0


def test_snapshot_is_parsed_behind_the_join(listed, rep_raw):
    plan = R.enrich(listed, rep_raw, max_lookups=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.index("parseJson") < plan.index("Join Inner")


def test_enabled_only(rep_raw):
    assert {r.provider for r in R.enabled_only(rep_raw, ["otx"]).collect()} == {"otx"}
    assert R.enabled_only(rep_raw, []).count() == 0


def test_newest_answer_counts(spark, listed):
    answers = [("otx", "domain", "b.com", 1, '{"pulse_info": {"count": 1}}'), ("otx", "domain", "b.com", 3, '{"pulse_info": {"count": 3}}'), ("otx", "domain", "b.com", 2, None)]
    rep = spark.createDataFrame(answers, "provider string, kind string, key string, landed int, body string")
    found = R.merge_all(R.enrich(listed, R.newest(rep))).collect()
    assert len(found) == 1 and json.loads(found[0].answers["otx"])["pulse_count"] == 3
    same = R.merge_all(R.enrich(listed, rep, at="landed")).collect()
    assert [r.asDict() for r in same] == [r.asDict() for r in found]


def test_answers_are_read_last(spark, listed, tmp_path):
    """Keys and times are read alone, and no answer is sorted or grouped before it is chosen."""
    rows = [("otx", "domain", f"{c}.com", t, '{"pulse_info": {"count": 1}}') for c in "abc" for t in (1, 2)]
    spark.createDataFrame(rows, "provider string, kind string, key string, landed int, body string").write.parquet(str(tmp_path / "r"))
    found = R.enrich(listed, spark.read.parquet(str(tmp_path / "r")), at="landed")
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(reads) == 1 and "max_by" not in plan and "Window" not in plan  # the answers, once


def test_newest_of_equal_times(spark):
    rows = [("a", 2, "x"), ("a", 2, "y"), ("a", 1, "z"), ("b", None, "p"), ("b", None, "p"), ("c", None, "q"), ("c", 0, "r"), (None, 1, "n")]
    landed = spark.createDataFrame(rows, "url string, landed int, body string").repartition(5)
    got = {r.url: r.body for r in landings.newest(landed, ["url"]).collect()}
    assert len(got) == 4 and got["a"] in ("x", "y") and (got["b"], got["c"], got[None]) == ("p", "r", "n")
    again = {r.url: r.body for r in landings.newest(landed.repartition(2), ["url"]).collect()}
    assert again == got
    only = landings.newest(landed, ["url"], wanted=spark.createDataFrame([("c",), ("c",), ("d",)], "url string"))
    assert [tuple(r) for r in only.collect()] == [("c", 0, "r")]
    assert landings.newest(landed.where("false"), ["url"]).count() == 0


def test_changes_between_runs(spark):
    rows = [("u", 10, 1, "a"), ("u", 20, 2, "a"), ("u", 30, 3, "b"), ("u", 30, 9, "c"), ("v", 10, 1, "x"), ("v", 30, 3, "x"), ("w", 20, 1, None), (None, 10, 1, "n")]
    landed = spark.createDataFrame(rows, "url string, run int, landed int, body string").repartition(3)
    got = sorted((r.run, r.url, r.state) for r in landings.changes(landed).collect())
    assert got == [(10, "u", "new"), (10, "v", "new"), (20, "u", "same"), (20, "v", "gone"), (20, "w", "new"), (30, "u", "changed"), (30, "v", "new"), (30, "w", "gone")]
    assert landings.changes(landed.where("false")).count() == 0


def test_long_values_stay_whole(spark):
    body = json.dumps({"pulse_info": {}, "whois": "w" * 5000})
    rep = spark.createDataFrame([("otx", "domain", "b.com", body)], "provider string, kind string, key string, body string")
    assert len(R.project_reputation(rep, "otx", "domain").first().whois) == 5000
    assert len(R.project_reputation(rep, "otx", "domain", max_whois=200).first().whois) == 200
