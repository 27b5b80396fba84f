"""Registered queries of this subpackage and their SQL.

A query reads whole tables, applies one operator with production parameters
and keeps the columns its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.llm import (decontam, infilling, kneser_ney, mixing, near_dups, packing, quality, secret_scan, sharding,
                          tool_calls, toxicity, vectors, whitening)
from hostloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_SQL = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
             r"'[^\x20\x09-\x0D]+')")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op1_token_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


@query(f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT p.b, r.b FROM reach r JOIN pairs p ON p.a = r.a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(any_value(l.n), 0) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id LEFT JOIN links l ON l.a = v.vec_id GROUP BY v.vec_id
""")
def op2_embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op3_site_quality(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                          F.col("source"), F.col("lang"))


@query()
def op4_temperature_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] or 0
    return mixing.stream(docs, mixing.Mix(budget=words, entropy=0.9, repeats=2.0))


@query("""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations),
calls AS (SELECT * FROM m WHERE kind = 'call'), results AS (SELECT * FROM m WHERE kind = 'result'),
level AS (
  SELECT conv_id, turn, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM level l JOIN calls c
    ON c.conv_id = l.conv_id AND c.turn = l.turn + 2),
rows AS (
  SELECT c.conv_id, c.turn, c.kind, 'call-' || c.turn AS call_id, l.level, r.turn AS other_turn,
    CASE WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    '{"role":"assistant","tool_calls":[{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn
      || '},"id":"call-' || c.turn || '","name":"reply"}]}' AS json
  FROM calls c JOIN level l USING (conv_id, turn)
  LEFT JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
  UNION ALL
  SELECT r.conv_id, r.turn, r.kind, 'call-' || (r.turn - 1), l.level, c.turn,
    CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END,
    '{"content":' || to_json(r.text) || ',"role":"tool","tool_call_id":"call-' || (r.turn - 1) || '"}'
  FROM results r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1
  LEFT JOIN level l ON l.conv_id = c.conv_id AND l.turn = c.turn
  UNION ALL
  SELECT conv_id, turn, kind, NULL, NULL, NULL, 'message',
    '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' FROM m WHERE kind = 'message')
SELECT *, true AS valid, '' AS errors FROM rows
""")
def op5_tool_call_linking(spark, sf_dir):
    # the table has plain turns: a user's turn is taken as a call of the tool that replies, after the one before
    turns = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    calls = turns.filter("role = 'user'").select(
        "conv_id", "turn", name.alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn")).alias("arguments"),
        F.array(F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string"))).alias("after"))
    results = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("text").alias("content"))
    rest = turns.filter("role is null or role not in ('user', 'assistant')").select(
        "conv_id", "turn", "role", F.col("text").alias("content"))
    schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
    return tool_calls.linked(calls, results, rest, schemas)


@query()
def op6_kneser_ney(spark, sf_dir):
    return kneser_ney.scores(table(spark, sf_dir, "documents"))


@query()
def op7_secret_randomness(spark, sf_dir):
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(secret_scan.spelled("base"), 256).alias("base_sha256"),
                        secret_scan.spelled("spans").alias("spans"), "n_random")


@query(f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT e.b, r.b FROM reach r JOIN edges e ON e.a = r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
""")
def op8_minhash_near_dedup(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), near_dups.Banding(size=3, percent=85, rows=4))


@query()
def op9_benchmark_leaks(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_toxicity(spark, sf_dir):
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# the network of sharding.py round by round: a row that ends outside starts over from where it is
@query("""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS row
  FROM documents),
size AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM t),
sides AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM size),
walk AS (
  SELECT row, 0 AS j, row % a AS l, row // a AS r FROM t, sides
  UNION ALL
  SELECT row, CASE WHEN j < 8 THEN j + 1 ELSE 1 END,
    CASE WHEN j < 8 THEN r ELSE (r * a + l) // a END,
    CASE WHEN j < 8 THEN (l + CAST('0x' || substr(md5('0:' || j || ':' || r), 1, 15) AS BIGINT) % side) % side
      ELSE ((r * a + l) % a + CAST('0x' || substr(md5('0:0:' || ((r * a + l) // a)), 1, 15) AS BIGINT) % a) % a END
  FROM (SELECT w.*, s.*, CASE WHEN j % 2 = 0 THEN a ELSE b END AS side FROM walk w, sides s)
  WHERE j < 8 OR r * a + l >= n),
placed AS (SELECT row, r * a + l AS p FROM walk, sides WHERE j = 8 AND r * a + l < n),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs),
bytes AS (SELECT row, list_transform(regexp_extract_all(hex(text), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM t),
sums AS (SELECT row, xor(4294967295, list_reduce(list_prepend(4294967295, b),
  lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8))) AS crc FROM bytes, bits)
SELECT doc_id, strlen(text) + 8 AS size, crc AS text_crc32, 'rows' AS law, CAST(p % 24 AS INTEGER) AS shard, p // 24 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM t JOIN placed USING (row) JOIN sums USING (row)
""")
def op11_feistel_sharding(spark, sf_dir):
    placed = sharding.sharded(table(spark, sf_dir, "documents"), sharding.Shuffle(shards=24), columns=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.ROWS_LAW).alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^
]*
|[^
]+') AS units,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
  greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
  array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
""")
def op12_fill_in_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infilling.infilled(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infilling.rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query()
def op13_embedding_whitening(spark, sf_dir):
    return whitening.components_of(table(spark, sf_dir, "embeddings"), components=8)
