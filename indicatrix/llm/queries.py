"""The registered queries of this subpackage, and the SQL that restates those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicatrix.llm import (
    byte_bpe,
    chat_format,
    decontamination,
    exact_dedup,
    language_id,
    parity_join,
    periodic_runs,
    personal_data,
    secret_scan,
    spelling,
    substring_dedup,
    token_counts,
    toxicity,
)
from indicatrix.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_personal_data(spark, sf_dir):
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


@query
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row")


ORACLE["op2_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op3_toxicity(spark, sf_dir):
    """The expected severity of every document, by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).select("doc_id", "toxicity.severity", "toxicity.toxic", "toxicity.chances")


@query
def op4_language_id(spark, sf_dir):
    named = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return named.select("doc_id", language_id.held_out().alias("held_out"), "language.lang_pred", "language.score")


@query
def op5_secret_scan(spark, sf_dir):
    """A second run over all documents, since when one rule has a new version: the others are in the ledger."""
    docs, rules = table(spark, sf_dir, "documents"), secret_scan.RULES
    earlier = [*rules[:-1], rules[-1]._replace(version=rules[-1].version - 1)]
    return secret_scan.secret_spans(docs, secret_scan.update(docs, rules=earlier))


HARD_CHAT = r"\### Assistant: </turn> ok"


@query
def op6_chat_format(spark, sf_dir):
    """All conversations, and one whose texts look like templates."""
    hard = spark.createDataFrame([(-7, 0, "user", HARD_CHAT), (-7, 1, "assistant", HARD_CHAT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest_chats(chat_format.format_chats(turns.unionByName(hard)))


ORACLE["op6_chat_format"] = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{HARD_CHAT}'), (-7, 1, 'assistant', '{HARD_CHAT}'))),
t AS (SELECT *, length(role) + length(text) + 13
             + length(regexp_replace(role || text, '[^\\\\|]', '', 'g')) AS laid FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(laid) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op7_decontamination(spark, sf_dir):
    """Every document that holds an item of the benchmark, once for each item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@query
def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES).select("doc_id", "n_tokens")


@query
def op9_parity_join(spark, sf_dir):
    return parity_join.parity_join(table(spark, sf_dir, "documents"))


@query
def op10_byte_bpe(spark, sf_dir):
    """The ids of every text, and the bytes they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).selectExpr(
        "doc_id",
        "CAST(size(ids) AS BIGINT) AS n_tokens",
        "sha2(array_join(ids, ','), 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
    )


@query
def op11_periodic_runs(spark, sf_dir):
    """The runs of all documents, in a tenth of which the words from some place on are made periodic."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "crc32(CAST(doc_id AS STRING)) AS h")
    parts = r"IF(h % 10 = 0, regexp_extract_all(text, r'([^\x20\x09-\x0D]+)', 1), NULL)"
    docs = docs.selectExpr("doc_id", "text", "h DIV 10 AS g", f"{parts} AS parts").selectExpr("*", "size(parts) AS n")
    docs = docs.selectExpr("*", "IF(n > 0, g % n, NULL) AS a").selectExpr("*", "IF(n > 0, 1 + (n - a) DIV (3 + g % 8), NULL) AS p")
    planted = "array_join(transform(parts, (w, i) -> IF(i < a, w, parts[CAST(a + (i - a) % p AS INT)])), ' ')"
    docs = docs.selectExpr("doc_id", f"IF(n > 0, {planted}, text) AS text")
    longest = "array_max(transform(runs, r -> named_struct('length', r.length, 'back', -r.start, 'short', -r.period)))"
    rows = periodic_runs.periodic_runs(docs).withColumn("longest", F.expr(longest))
    return rows.selectExpr(
        "doc_id",
        "CAST(size(runs) AS BIGINT) AS n_runs",
        "-longest.back AS start",
        "longest.length AS length",
        "-longest.short AS period",
        "1000 * longest.length DIV -longest.short AS exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )


# CRC-32 of a text's UTF-8 bytes: a table of 256 remainders by rule, then a step for each byte.
_CRC_TABLE = (
    "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: "
    "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"
)


def _crc32(text: str) -> str:
    """The CRC-32 of a text beside a column ``crc`` with the table."""
    octets = f"list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, o: xor(c >> 8, crc[1 + (xor(c, o) & 255)])))"


ORACLE["op11_periodic_runs"] = rf"""
WITH t AS ({_CRC_TABLE}),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents, t),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END)
             ELSE w END AS w FROM f),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM v),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM v LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op12_spelling_variants(spark, sf_dir):
    """The words of all documents, of which some lack a letter, with the forms they are variants of."""
    runs = r"regexp_extract_all(text, r'([A-Za-z\x{C0}-\x{FF}]{6,}+)', 1)"  # shorter ones are never listed
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"explode({runs}) AS run")
    docs = docs.selectExpr("doc_id", "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run")
    docs = docs.selectExpr("run", "crc32(concat(doc_id, ':', run)) AS h").selectExpr("run", "h", "CAST(h % length(run) AS INT) AS at")
    return spelling.variants(docs.selectExpr("IF(h % 199 = 0, concat(left(run, at), substring(run, at + 2)), run) AS word"))


ORACLE["op12_spelling_variants"] = rf"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
lower_runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM found),
counted AS (SELECT doc_id, run, count(*) AS n FROM lower_runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM counted, t),
planted AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM planted WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM places),
near AS (
    SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT DISTINCT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
         QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
                 CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


@query
def op13_substring_dedup(spark, sf_dir):
    """Every document without the passages that one with a smaller id has too."""
    rows = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op13_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
earliest AS (SELECT words, min(doc_id) AS least FROM win GROUP BY words HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM win JOIN earliest USING (words), range(13) AS r(k) WHERE doc_id > least),
removed AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS text
         FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.place = i)
         GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
