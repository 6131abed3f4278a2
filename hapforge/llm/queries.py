"""The queries of this subpackage and, where SQL can express them, DuckDB statements for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapforge.llm import exact_dedup, fingerprints, masked_lm, mixing, near_dup, packing, preferences, quality, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX = {"repeat_limit": 2.0, "budget_share": 1.0}


@_query(
    "op1_mixing",
    f"""
WITH RECURSIVE units AS (
  SELECT doc_id, source, CAST(SUM(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_tokens,
         coalesce('s' || source, 'n') AS src
  FROM documents GROUP BY doc_id, source),
shares AS (SELECT src, CAST(SUM(n_tokens) AS DOUBLE) AS tokens, COUNT(*) AS docs FROM units GROUP BY src),
live AS (SELECT tokens / (SELECT SUM(tokens) FROM shares) AS p FROM shares WHERE tokens > 0),
least_p AS (SELECT MIN(p) AS p FROM live),
halved AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1,
         CASE WHEN pow((SELECT p FROM least_p), (lo + hi) / 2 - 1) / (SELECT SUM(pow(l.p, (h.lo + h.hi) / 2)) FROM live l) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow((SELECT p FROM least_p), (lo + hi) / 2 - 1) / (SELECT SUM(pow(l.p, (h.lo + h.hi) / 2)) FROM live l) > 2.0 THEN hi ELSE (lo + hi) / 2 END
  FROM halved h WHERE step < {mixing.HALVINGS}),
exponent AS (SELECT hi AS t FROM halved WHERE step = {mixing.HALVINGS}),
epochs AS (
  SELECT src, tokens, greatest(1, docs // {mixing.BLOCK_ROWS}) AS blocks,
         CASE WHEN tokens > 0 THEN round(pow(tokens / (SELECT SUM(tokens) FROM shares), (SELECT t FROM exponent) - 1) / (SELECT SUM(pow(p, (SELECT t FROM exponent))) FROM live), 6) ELSE 1.0 END AS e
  FROM shares),
plan AS (SELECT src, blocks, CAST(floor(e) AS BIGINT) AS whole, CAST(floor((e - floor(e)) * tokens) AS BIGINT) AS rest FROM epochs),
placed AS (
  SELECT u.*, p.whole, p.rest, ('0x' || substr(md5('{mixing.SEED}|' || doc_id || '|' || u.src), 1, 8))::BIGINT % p.blocks AS block
  FROM units u JOIN plan p ON u.src = p.src),
turns AS (SELECT *, unnest(range(whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM placed),
blocks AS (
  SELECT src, block, epoch, whole, rest, SUM(n_tokens) AS tokens, md5('{mixing.SEED}|' || epoch || '|' || src || '|' || block) AS key
  FROM turns GROUP BY src, block, epoch, whole, rest),
ordered AS (
  SELECT src, block, epoch, row_number() OVER (PARTITION BY src, epoch ORDER BY key, block) - 1 AS block_rank,
         CASE WHEN epoch >= whole THEN rest - coalesce(SUM(tokens) OVER (PARTITION BY src, epoch ORDER BY key, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS room
  FROM blocks),
drawn AS (
  SELECT t.doc_id, t.source, t.n_tokens, t.epoch, o.block_rank, o.room,
         row_number() OVER w AS place, SUM(t.n_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM turns t JOIN ordered o ON t.src = o.src AND t.block = o.block AND t.epoch = o.epoch
  WINDOW w AS (PARTITION BY t.src, t.block, t.epoch ORDER BY md5('{mixing.SEED}|' || t.epoch || '|' || t.doc_id || '|' || t.src), t.doc_id))
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(block_rank AS BIGINT) AS block_rank, CAST(place AS BIGINT) AS place
FROM drawn WHERE room IS NULL OR (room > 0 AND run <= room)
""",
)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_table(spark, sf_dir, "documents"), **MIX)


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@_query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    marked = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    labelled = pages.select("page_id", "url").join(marked, "page_id").select("url", "bad")
    return url_rules.judge_urls(pages, labelled, RULES)


@_query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_sensitivity(_table(spark, sf_dir, "documents"))


@_query("op5_near_dup")
def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


@_query("op6_masked_lm")
def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.masked_lm_scores(_table(spark, sf_dir, "documents"))


@_query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_TURN_SQL = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"


def _completion_sql(turns: str) -> str:
    """(conv_id, said, mask) of the turns after the prompt."""
    return f"""(SELECT conv_id, string_agg({_TURN_SQL}, '' ORDER BY i) AS said,
    string_agg(CASE WHEN role = 'assistant' THEN CAST(before + 5 + length(role) AS VARCHAR) || '-' || CAST(before + 13 + length(role) + length(text) AS VARCHAR) END, ',' ORDER BY i) AS mask
  FROM (SELECT r.*, coalesce(SUM(13 + length(role) + length(text)) OVER (PARTITION BY r.conv_id ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM {turns} r JOIN p USING (conv_id) WHERE r.i > p.shared) q GROUP BY conv_id)"""


@_query(
    "op8_preferences",
    f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
a AS (SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS nth, COUNT(*) OVER (PARTITION BY conv_id) AS answers FROM n WHERE role = 'assistant'),
z AS (SELECT conv_id, MAX(i) AS last FROM n GROUP BY conv_id),
c AS (SELECT z.conv_id, a.i IS NOT NULL AS parts, coalesce(a.i, z.last + 1) AS at FROM z LEFT JOIN a ON a.conv_id = z.conv_id AND a.nth = z.conv_id % a.answers),
r AS (
  SELECT n.conv_id, n.i, n.role, n.text FROM n JOIN c USING (conv_id) WHERE n.i < c.at
  UNION ALL
  SELECT c.conv_id, c.at + n.i - o.at, n.role, n.text FROM c JOIN c o ON o.conv_id = xor(c.conv_id, 1) JOIN n ON n.conv_id = o.conv_id AND n.i >= o.at WHERE c.parts AND o.parts),
b AS (
  SELECT coalesce(n.conv_id, r.conv_id) AS conv_id, coalesce(n.i, r.i) AS i, coalesce(n.role = r.role AND n.text = r.text, FALSE) AS same
  FROM n FULL JOIN r ON n.conv_id = r.conv_id AND n.i = r.i),
p AS (SELECT conv_id, coalesce(MIN(CASE WHEN NOT same THEN i END) - 1, MAX(i)) AS shared FROM b GROUP BY conv_id)
SELECT p.conv_id, CAST(p.shared AS BIGINT) AS n_prompt_turns, coalesce(h.said, '') AS prompt, coalesce(x.said, '') AS chosen_completion, coalesce(y.said, '') AS rejected_completion,
  coalesce(x.mask, '') AS chosen_mask, coalesce(y.mask, '') AS rejected_mask
FROM p
LEFT JOIN (SELECT n.conv_id, string_agg({_TURN_SQL}, '' ORDER BY i) AS said FROM n JOIN p USING (conv_id) WHERE n.i <= p.shared GROUP BY 1) h ON h.conv_id = p.conv_id
LEFT JOIN {_completion_sql('n')} x ON x.conv_id = p.conv_id
LEFT JOIN {_completion_sql('r')} y ON y.conv_id = p.conv_id
""",
)
def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.preference_rows(_table(spark, sf_dir, "conversations"))
    for side in ("chosen_mask", "rejected_mask"):
        out = out.withColumn(side, F.array_join(F.transform(side, lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.end.cast("string"))), ","))
    return out


@_query(
    "op9_exact_dedup",
    """
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size, doc_id = MAX(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


@_query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))
