"""The pipeline, stage by stage, against plain Python."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from indicatrix.llm import byte_bpe
from indicatrix.llm.queries import QUERIES
from tests.llm import test_decontamination, test_parity_join

FOLDER = "/root/testdata/sf0.01"


def expected(docs, items):
    """doc_id -> text of what stays before the last stage."""
    docs = {d: t for d, t in docs.items() if any(c.isalpha() for c in t or "")}
    last = {t: d for d, t in sorted(docs.items())}
    docs = {d: t for t, d in last.items()}
    docs = {d: docs[d] for d, _, least in test_parity_join.brute(sorted(docs.items())) if d == least}
    held = {d for d, _ in test_decontamination.brute(docs.items(), items)}
    return {d: t for d, t in docs.items() if d not in held}


def test_run(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    want = expected({r.doc_id: r.text for r in table}, items)
    assert 500 < len(want) < 950
    got = {r.doc_id: r for r in QUERIES["pipeline"](spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(corpus_pipeline.RANKS), special_tokens={})
    for doc_id, row in got.items():
        assert row.ids == theirs.encode_ordinary(want[doc_id]) and row.n_tokens == len(row.ids)
        assert row.decoded_sha256 == hashlib.sha256(want[doc_id].encode()).hexdigest()


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_text = " ".join(f"w{i}" for i in range(20_000))
    rows = [(None, None, None, None, None), (None, "a b c d e f", "en", None, 1), (1, "", "en", "s", 0), (2, "123", None, "s", 3), (3, long_text, "en", "s", 3), (4, long_text + " x", "en", "s", 3), (4, long_text + " x", "en", "s", 3)]
    for data, left in ((rows, 2), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
            assert name == "tokens" or docs.columns == columns
        assert docs.count() == left


CLASHES = ["row", "kept_id", "kept", "indicatrix_id", "indicatrix_digest", "indicatrix_language", "component_id", "class", "size", "ids", "lang_pred"]


def test_stages_know_rows_by_number(spark):
    """Rows without an id or of one id are judged one by one; other columns stay as they are, whatever their names."""
    item = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").collect()][0]
    base = [f"word{i}" for i in range(60)]
    near = [" ".join(base + tail) for tail in (["a"], ["b"], ["c"])]
    texts = [(None, near[0]), (None, near[1]), (9, near[2]), (9, "quite another text about the sea and the sky"), (None, f"see {item} there"), (None, "a clean text of a few words more"), (None, "the same"), (None, "the same"), (7, "the same")]
    columns = ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame([(d, t, "en", "s", 1, *CLASHES) for d, t in texts], f"doc_id long, text string, lang string, source string, n_chars long, {columns}").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    rows = docs.collect()
    assert all([r[c] for c in CLASHES] == CLASHES for r in rows)
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, "a clean text of a few words more"), (7, "the same"), (9, "quite another text about the sea and the sky"), (9, near[2])]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and last.count() == 4
