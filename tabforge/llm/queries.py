"""Queries over the whole tables, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bm25_pack, hilbert, html_lstm, importance_resampling, license_scan, line_rules,
               merkle_manifest, ngram_join, reply_trees, sentencepiece_unigram, topk, toxicity, url_filter)
from .common import read


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(read(spark, sf_dir, "documents"), shards=8)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_unigram.round_trip(read(spark, sf_dir, "documents"))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extract_pages(read(spark, sf_dir, "pages"))


def op5_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_pack.pack_documents(read(spark, sf_dir, "documents"), window=2048)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(text).alias("text"))
        for k, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return reply_trees.format_conversations(rows.unionByName(extra))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.filter_pages(read(spark, sf_dir, "pages"), rules)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.document_manifest(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_hilbert_shards, op2_ngram_jaccard_join, op3_sentencepiece, op4_html_blocks, op5_bm25_packing,
    op6_top_k, op7_line_rules, op8_reply_trees, op9_url_filter, op10_toxicity,
    op11_license_scan, op12_merkle_manifest, op13_importance_resampling,
)}

_OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

_OP9_SQL = r"""
WITH rules(verdict, r_host, r_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages)
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
QUALIFY row_number() OVER (PARTITION BY page_id
  ORDER BY length(r_host) + length(r_path) DESC NULLS LAST, length(r_host) DESC, verdict DESC) = 1
"""

# Turns, loss text and lengths follow from the rows alone: a control string
# start and a backslash cost one more character each when escaped.
_OP8_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(replace(x, '\', '\\'),
      '<(/?s>|/?<SYS>>|</?SYS>>)|\[(/?INST\])|<\||\|>', '\\\0', 'g')) AS n
  FROM (SELECT *, unnest([role, text]) AS x FROM r)),
n AS (SELECT conv_id, turn, role, sum(n) AS n FROM e GROUP BY ALL)
SELECT r.conv_id, count(*) AS n_turns,
  sha256(string_agg(r.role || chr(10) || text || chr(10), '' ORDER BY r.turn, r.role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (r.role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY r.turn, r.role, text) FILTER (r.role = 'assistant'), '')) AS loss_sha256,
  sum(n.n + 10)::BIGINT AS formatted_chars
FROM r JOIN n USING (conv_id, turn, role) GROUP BY r.conv_id
"""

_OP2_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT a, b FROM l UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles,
  least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

# The words of a lower-cased text, as the Spark side cuts them.
_WORDS_SQL = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# Unsigned CRC-32 of the UTF-8 bytes of an expression; needs the table crc(tb).
_CRC_TABLE_SQL = """crc AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i)))"""
_CRC_SQL = """xor(list_reduce([4294967295] || list_transform(range(octet_length(encode({0}))),
  lambda j: ('0x' || substr(hex(encode({0})), 2 * j + 1, 2))::BIGINT),
  lambda c, b: xor(c >> 8, tb[xor(c & 255, b) + 1])), 4294967295)"""


def _op11_sql() -> str:
    rows = ",\n  ".join(
        f"({i}, '{t.label}', {str(t.base).upper()}, {t.k}, {t.need}, {t.slack}, {t.words!r})"
        for i, t in enumerate(license_scan.TEMPLATES))
    return f"""
WITH tpl(template, label, base, k, need, slack, tw) AS (VALUES
  {rows}),
w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
tg AS (SELECT template, k, t, tw[t + 1:t + k] AS g FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS t FROM tpl)),
dg AS (SELECT r, k, p, w[p + 1:p + k] AS g FROM (
  SELECT r, w, k, unnest(range(0, greatest(0, len(w) - k + 1))) AS p FROM w, (VALUES (2), (4)) ks(k))),
v AS (SELECT r, template, t, p, p - t AS d, k FROM dg JOIN tg USING (k, g)),
n AS (SELECT v.*, CASE WHEN d - lag(d) OVER o <= slack THEN 0 ELSE 1 END AS new
      FROM v JOIN tpl USING (template) WINDOW o AS (PARTITION BY r, template ORDER BY d, p)),
u AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY d, p ROWS UNBOUNDED PRECEDING) AS run FROM n),
c AS (SELECT r, template, run, min(p) AS first_word,
        len(list_distinct(flatten(list(range(t, t + k))))) AS covered FROM u GROUP BY ALL),
s AS (SELECT r, label, base, first_word, covered / len(tw) AS share FROM c JOIN tpl USING (template)
      WHERE covered * 100 >= need * len(tw))
SELECT any_value(doc_id) AS doc_id, len(any_value(w.w)) AS n_words, count(*) FILTER (base) AS n_base,
  min(first_word) FILTER (base) AS first_word, max(first_word) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(share), 0)::DOUBLE AS score
FROM w LEFT JOIN s USING (r) GROUP BY w.r
"""


_FIELD_SQL = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF_SQL = "sha256(concat({}))".format(", ".join(
    _FIELD_SQL.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")))

_OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE_SQL},
x AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS k, {_LEAF_SQL.format(n="n_chars")} AS leaf,
        CASE WHEN {_CRC_SQL.format("doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF_SQL.format(n="(n_chars + 1)")}
        ELSE {_LEAF_SQL.format(n="n_chars")} END AS now FROM documents, crc),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY k) AS m FROM x),
lv(k, l, i, m, h) AS (
  SELECT k, 0::BIGINT, i, m, leaf FROM d UNION ALL
  SELECT k, l + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE m > 1
  GROUP BY k, l, i // 2, (m + 1) // 2),
sub AS (SELECT k, h, l AS height, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS m FROM lv WHERE m = 1),
tv(l, i, m, h) AS (
  SELECT 0::BIGINT, i, m, h FROM sub UNION ALL
  SELECT l + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tv WHERE m > 1
  GROUP BY l, i // 2, (m + 1) // 2),
root AS (SELECT h AS root, l AS height FROM tv WHERE m = 1),
step AS (
  SELECT r, t.l, (d.i >> t.l) & 1 AS slot, coalesce(lv.h, '') AS sib FROM d JOIN sub USING (k), range(0, 64) t(l)
  LEFT JOIN lv ON lv.k = d.k AND lv.l = t.l AND lv.i = xor(d.i >> t.l, 1) WHERE t.l < height
  UNION ALL
  SELECT r, sub.height + t.l, (sub.i >> t.l) & 1, coalesce(tv.h, '') FROM d JOIN sub USING (k), root, range(0, 64) t(l)
  LEFT JOIN tv ON tv.l = t.l AND tv.i = xor(sub.i >> t.l, 1) WHERE t.l < root.height),
fold(r, l, h) AS (
  SELECT r, 0::BIGINT, now FROM d UNION ALL
  SELECT r, l + 1, sha256(CASE WHEN slot = 1 THEN sib || h ELSE h || sib END) FROM fold JOIN step USING (r, l)),
proof AS (SELECT r, string_agg(sib, '' ORDER BY l) AS p FROM step GROUP BY r),
last AS (SELECT r, arg_max(h, l) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM d JOIN sub USING (k) JOIN last USING (r) LEFT JOIN proof USING (r), root
"""

_OP13_SQL = f"""
WITH {_CRC_TABLE_SQL},
dw AS (SELECT r, unnest(w) AS word FROM (SELECT row_number() OVER () AS r, {_WORDS_SQL} AS w FROM documents)),
bw AS (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark),
b AS (SELECT word, {_CRC_SQL.format("word")} % 10000 AS bucket
      FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
      FROM s FULL JOIN t USING (bucket)),
d AS (SELECT row_number() OVER () AS r, doc_id, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents),
f AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY r),
c AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score
      FROM d LEFT JOIN f USING (r)),
o AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place,
        count(*) FILTER (n_features >= 20) OVER () AS able FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM o
"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": _OP2_SQL,
    "op6_top_k": _OP6_SQL,
    "op8_reply_trees": _OP8_SQL,
    "op9_url_filter": _OP9_SQL,
    "op11_license_scan": _op11_sql(),
    "op12_merkle_manifest": _OP12_SQL,
    "op13_importance_resampling": _OP13_SQL,
}
