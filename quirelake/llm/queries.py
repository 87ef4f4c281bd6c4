"""Queries of the operators of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import chat, decontamination, html, inverted, maxent, neardup, packing, quality, secrets, substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the rows whose id is divisible by 50, among all rows."""
    return inverted.neighbours(table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their scores; all others are rejected."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_html": op3_html,
    "op4_neighbours": op4_neighbours,
    "op5_chat": op5_chat,
    "op6_substrings": op6_substrings,
    "op7_lm_scores": op7_lm_scores,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
}

_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+')"

OP6_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT row_no, doc_id, words, unnest(range(0, len(words) - {substrings.WIDTH} + 1)) AS p FROM docs WHERE len(words) >= {substrings.WIDTH}),
windows AS (SELECT row_no, doc_id, p, hash(list_slice(words, p + 1, p + {substrings.WIDTH})) AS w FROM starts),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT row_no, doc_id, p, lag(p) OVER (PARTITION BY row_no ORDER BY p) AS before FROM windows SEMI JOIN again USING (w)),
islands AS (SELECT row_no, doc_id, p, sum(CASE WHEN before IS NULL OR p - before > {substrings.WIDTH} THEN 1 ELSE 0 END) OVER (PARTITION BY row_no ORDER BY p) AS island FROM hits)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) + {substrings.WIDTH} AS BIGINT) AS end_word, count(*) AS n_windows
FROM islands GROUP BY row_no, doc_id, island
"""

#: Equal weights, so v is the level to which every queue has been served.
OP1_SQL = f"""
WITH counted AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n FROM documents WHERE text IS NOT NULL),
queued AS (
  SELECT doc_id, source, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) - n AS first
  FROM counted WHERE n > 0),
totals AS (
  SELECT source, CAST(sum(n) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM queued GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY total, i) AS k, count(*) OVER () AS sources FROM totals),
phases AS (
  SELECT k, coalesce(sum(total) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dry,
    sources - k + 1 AS live, coalesce(lag(total) OVER (ORDER BY k), 0) AS level FROM ranked),
begun AS (SELECT k, dry, live, dry + live * level AS begin FROM phases),
edges AS (
  SELECT w, least(w * {packing.WINDOW}, (SELECT sum(total) FROM totals)) AS g
  FROM range(0, (SELECT CAST(ceil(sum(total) / {packing.WINDOW}.0) AS BIGINT) + 1 FROM totals)) t(w)),
placed AS (SELECT w, g, max(k) AS k FROM edges JOIN begun ON begin <= g GROUP BY w, g),
served AS (
  SELECT w, r.i, r.source, sum(CASE WHEN r.k < p.k THEN r.total ELSE 0 END) OVER s
    + (sum(CASE WHEN r.k < p.k THEN 0 ELSE 1 END) OVER s * (p.g - b.dry)) // b.live AS upto
  FROM placed p JOIN begun b ON b.k = p.k CROSS JOIN ranked r WINDOW s AS (PARTITION BY w ORDER BY r.i)),
own AS (SELECT w, i, source, upto - coalesce(lag(upto) OVER (PARTITION BY w ORDER BY i), 0) AS edge, coalesce(lag(upto) OVER (PARTITION BY w ORDER BY i), 0) AS before FROM served),
slots AS (
  SELECT w, source, edge, lead(edge) OVER q AS next_edge, lead(before) OVER q - before AS ahead FROM own WINDOW q AS (PARTITION BY i ORDER BY w))
SELECT CAST(w AS BIGINT) AS window_id, CAST(ahead + greatest(first, edge) - edge AS BIGINT) AS window_start, doc_id, d.source,
  CAST(greatest(first, edge) - first AS BIGINT) AS doc_start, CAST(least(first + n, next_edge) - greatest(first, edge) AS BIGINT) AS n_tokens
FROM queued d JOIN slots s ON d.source IS NOT DISTINCT FROM s.source AND first < next_edge AND first + n > edge
WHERE next_edge > edge
"""

OP5_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
ordered AS (
  SELECT *, row_number() OVER q - 1 AS nth, lag(turn) OVER q AS last_turn, coalesce(lag(role) OVER q, 'start') AS last_role,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM turns WINDOW q AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
judged AS (
  SELECT *, CASE
    WHEN conv_id IS NULL THEN 'no conversation'
    WHEN turn IS NULL THEN 'no turn'
    WHEN last_turn = turn THEN 'turn ' || turn || ': occurs twice'
    WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 'turn ' || turn || ': unknown role'
    WHEN text IS NULL THEN 'turn ' || turn || ': no text'
    WHEN last_role || '>' || role NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
      THEN 'turn ' || turn || ': ' || role || ' after ' || last_role
    WHEN nth = turns - 1 AND role <> 'assistant' THEN 'turn ' || turn || ': ends with ' || role END AS fault
  FROM ordered),
faults AS (SELECT conv_id, arg_min(fault, nth) AS error FROM judged WHERE fault IS NOT NULL GROUP BY conv_id),
segments AS (
  SELECT j.*, k FROM judged j, range(0, 3) t(k) WHERE NOT EXISTS (SELECT 1 FROM faults f WHERE f.conv_id IS NOT DISTINCT FROM j.conv_id))
SELECT conv_id, CAST(3 * nth + k AS BIGINT) AS position, turn, role,
  CASE k WHEN 0 THEN '<|im_start|>' || role || chr(10) WHEN 1 THEN text ELSE '<|im_end|>' || chr(10) END AS text,
  role = 'assistant' AND k > 0 AS loss, CAST(NULL AS VARCHAR) AS error
FROM segments
UNION ALL
SELECT conv_id, 0, -1, NULL, NULL, false, error FROM faults
"""

ORACLES: dict[str, str] = {
    "op1_packing": OP1_SQL,
    "op5_chat": OP5_SQL,
    "op6_substrings": OP6_SQL,
}
