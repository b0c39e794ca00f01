"""The registered queries of the operators, and SQL for those that SQL can express.

Each query applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakerules.llm import (align, dedup, jaccard, langid, lm, mixing, pieces, quality, repair, sharding, tokens,
                           toxicity, urls)
from lakerules.llm._common import new_path, text_or_empty
from lakerules.session import ship_package

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=~langid.held_out(F.col("doc_id")))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_piece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every text, in digest: the ids themselves are the operator's."""
    found = pieces.sample_segmentations(table(spark, sf_dir, "documents"), decoded=True)
    return found.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "log_prob", "inclusion",
                        F.xxhash64("ids").alias("ids_hash"),
                        (F.xxhash64("text") == F.col("text_hash")).alias("round_trip"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every text, counted within its document."""
    return tokens.attribute(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("doc_id")
    scored = lm.score_texts(table(spark, sf_dir, "documents"), learn=~lm.held_out(out))
    return scored.select("doc_id", lm.held_out(out).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out(F.col("doc_id")))
    found = toxicity.judge(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written whole; the columns are read from what was written."""
    docs = table(spark, sf_dir, "documents")
    shards = sharding.write_shards(docs, new_path(spark, "shards"))
    text = F.col("text")
    return shards.select("doc_id", sharding.record_size(text).alias("size"),
                         F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.with_every_conversation(repair.repair(repair.damage(turns)).digests(), turns)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixture": op1_mixture,
    "op2_language": op2_language,
    "op3_piece_samples": op3_piece_samples,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_language_model": op6_language_model,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_sharding": op11_sharding,
    "op12_repair": op12_repair,
    "op13_alignment": op13_alignment,
}

ORACLE = {
    "op1_mixture": r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
q AS (SELECT doc_id AS id, CASE WHEN max(quality) >= 1 THEN 2.0 ELSE 0.5 END AS w FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln(u) / coalesce(q.w, 1.0) AS es_key FROM d LEFT JOIN q ON d.doc_id = q.id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS lim FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(lim::DOUBLE) OVER (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT *, first_value(CASE WHEN lev * w < lim THEN lev END IGNORE NULLS)
               OVER (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT source, source_size, least(lim::DOUBLE, coalesce(level * w, lim::DOUBLE)) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs,
             CAST(floor(e.target - e.epochs * e.source_size + 0.5) AS BIGINT)
             - sum(k.size) OVER (PARTITION BY k.source ORDER BY k.es_key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + k.size AS rest
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, CAST(epochs AS BIGINT) AS epochs,
       CAST(epochs * size + greatest(0, least(size, rest)) AS BIGINT) AS taken
FROM r""",
    "op9_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n""",
    "op12_repair": r"""
WITH RECURSIVE
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
f AS (SELECT *, xor(list_reduce(
               list_transform(range(0, 8 * len(s)), lambda i: (unicode(s[i // 8 + 1]) >> CAST(i % 8 AS INTEGER)) & 1),
               lambda h, b: xor(h >> 1, CASE WHEN xor(h, b) & 1 = 1 THEN 3988292384 ELSE 0 END),
               CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault FROM c),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM f WHERE fault <> 0),
o AS (SELECT *, sha256(len(role) || ':' || role || text) AS k FROM d),
n AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, k ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS open_ended FROM o),
m AS (SELECT *, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM n),
t AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
             count(*) FILTER (NOT blank AND NOT again AND open_ended) AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
ins(a, b, audit, body, price) AS (VALUES (0, 0, '', '', 0), (3, 3, '', '', 0), (5, 5, '', '', 0), (2, 2, '', '', 0),
  (0, 5, 'I', chr(10) || 'user:', 3), (3, 5, 'I', chr(10) || 'user:', 3), (2, 5, 'I', chr(10) || 'user:', 3),
  (5, 2, 'I', chr(10) || 'assistant:', 3), (0, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6),
  (3, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6)),
sh(a, sym, b) AS (VALUES (0, 's', 3), (0, 'u', 5), (3, 'u', 5), (2, 'u', 5), (5, 'a', 2)),
edits AS (
  SELECT conv_id, i, a AS st, a AS nxt, 4 AS price, 'D' AS audit, '' AS body FROM n, (VALUES (0), (3), (5), (2)) AS x(a)
  UNION ALL
  SELECT conv_id, i, ins.a, sh.b, ins.price + CASE WHEN open_ended THEN 3 ELSE 0 END, ins.audit || 'K',
         ins.body || chr(10) || role || ':' || text
  FROM n, ins, sh WHERE NOT blank AND NOT again AND sh.a = ins.b AND sh.sym = initial
  UNION ALL
  SELECT conv_id, i, ins.a, sh.b, ins.price + 3 + CASE WHEN open_ended THEN 3 ELSE 0 END, ins.audit || 'R',
         ins.body || chr(10) || CASE sh.sym WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text
  FROM n, ins, sh WHERE NOT blank AND NOT again AND sh.a = ins.b AND sh.sym IN ('u', 'a')),
p AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, 0 AS cost, '' AS audit, '' AS body FROM conversations
      UNION ALL
      SELECT conv_id, i, st, cost, audit, body FROM (
        SELECT p.conv_id, e.i, e.nxt AS st, p.cost + e.price AS cost, p.audit || e.audit AS audit, p.body || e.body AS body,
               row_number() OVER (PARTITION BY p.conv_id, e.nxt ORDER BY p.cost + e.price, p.audit || e.audit) AS rn
        FROM p JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.st = p.st) WHERE rn = 1),
w AS (SELECT p.conv_id, p.cost + ins.price AS cost, p.audit || ins.audit AS audit, p.body || ins.body AS body,
             row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + ins.price, p.audit || ins.audit) AS rn
      FROM p JOIN ins ON ins.a = p.st AND ins.b IN (0, 2) LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id
      WHERE p.i = coalesce(t.n, 0))
SELECT w.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(w.cost AS BIGINT) AS cost, w.audit,
       sha256(substr(w.body, 2)) AS repaired_sha256
FROM w LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id WHERE rn = 1""",
}
