"""The queries of this subpackage over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenweft.llm import classifier, language_model, near_join, order_minhash, packing, quality_rules, replay, store, tool_calls, toxicity
from tokenweft.llm._common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"))


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(read(spark, sf_dir, "documents"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(read(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.conversation_schemas(spark))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(read(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stored_digest(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_language_model, op3_near_join, op4_tool_calls, op5_order_minhash, op6_rules, op7_packing, op8_store, op9_toxicity, op10_merge_replay)}


#: The whole of op4_tool_calls for a second engine: calls and results of the turns, levels by recursion, the two schemas' checks, canonical JSON.
OP4_SQL = r"""WITH RECURSIVE
turns AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, CASE WHEN turn >= 2 THEN 'call_' || (turn - 2) END AS parent_id,
    CASE role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'configure' ELSE 'role:' || role END AS tool,
    coalesce(text, '') AS said,
    '{"n_chars":' || length(coalesce(text, '')) || ',"prompt":' || to_json(coalesce(text, ''))::VARCHAR || coalesce(',"turn":' || turn, '') || '}' AS arguments
  FROM turns WHERE role <> 'assistant' OR (role IS NULL AND (conv_id IS NOT NULL OR turn IS NOT NULL OR text IS NOT NULL))
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn NULLS LAST, tool NULLS FIRST, arguments, parent_id NULLS FIRST) AS again FROM calls),
firsts AS (SELECT * FROM numbered WHERE again = 1 AND call_id IS NOT NULL AND conv_id IS NOT NULL),
up AS (SELECT f.conv_id, f.call_id, p.call_id AS up FROM firsts f LEFT JOIN firsts p ON p.conv_id = f.conv_id AND p.call_id = f.parent_id),
levels AS (SELECT conv_id, call_id, 0::BIGINT AS level FROM up WHERE up IS NULL
  UNION ALL SELECT u.conv_id, u.call_id, l.level + 1 FROM up u JOIN levels l ON u.conv_id = l.conv_id AND u.up = l.call_id),
results AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, count(*) AS n_results,
    first(turn ORDER BY turn NULLS LAST, text NULLS FIRST) AS result_turn, first(text ORDER BY turn NULLS LAST, text NULLS FIRST) AS content
  FROM turns WHERE role = 'assistant' GROUP BY ALL),
joined AS (
  SELECT n.conv_id, n.call_id, n.turn, n.tool, n.arguments, n.parent_id, n.said, n.again, r.n_results, r.result_turn, r.content, r.conv_id IS NOT NULL AS answered, false AS orphan
  FROM numbered n LEFT JOIN results r ON r.conv_id = n.conv_id AND r.call_id = n.call_id AND n.again = 1
  UNION ALL
  SELECT r.conv_id, r.call_id, NULL, NULL, NULL, NULL, NULL, NULL, r.n_results, r.result_turn, r.content, true, true
  FROM results r WHERE NOT EXISTS (SELECT 1 FROM numbered n WHERE n.again = 1 AND n.conv_id = r.conv_id AND n.call_id = r.call_id)
),
placed AS (SELECT j.*, l.level AS own_level FROM joined j LEFT JOIN levels l ON j.again = 1 AND l.conv_id = j.conv_id AND l.call_id = j.call_id),
judged AS (
  SELECT *, CASE WHEN orphan THEN '' WHEN tool = 'reply' THEN concat_ws(',', CASE WHEN turn IS NULL THEN 'missing:turn' END, CASE WHEN length(said) > 400 THEN 'too_long:prompt' END)
    WHEN tool = 'configure' THEN concat_ws(',', 'missing:policy', CASE WHEN length(said) > 300 THEN 'too_long:prompt' END) ELSE 'unknown_tool' END AS reasons,
    CASE WHEN orphan THEN 'orphan_result' WHEN again > 1 THEN 'duplicate_id' WHEN again = 1 AND conv_id IS NOT NULL AND call_id IS NOT NULL AND own_level IS NULL THEN 'cycle'
      WHEN answered THEN 'linked' ELSE 'unanswered' END AS status
  FROM placed
)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY own_level NULLS LAST, turn NULLS LAST, call_id NULLS LAST, tool NULLS FIRST, arguments NULLS FIRST) AS position,
  own_level AS level, status, tool, CASE WHEN NOT orphan THEN reasons = '' END AS valid, reasons, coalesce(n_results, 0) AS n_results, turn AS call_turn, result_turn,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"name":' || coalesce(to_json(tool)::VARCHAR, 'null')
    || ',"parent":' || coalesce(to_json(parent_id)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS canonical
FROM judged"""


def oracle_sql() -> dict[str, str]:
    """The other operators are models, similarity classes, hashes and tokenizers beyond SQL; tests hold them against brute force."""
    return {"op4_tool_calls": OP4_SQL}
