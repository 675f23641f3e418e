"""Queries over gates and reviews: leaks, verdicts, statuses, checkpoints, groups of samples, weakness contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, memory, questions, rollout, suite, weakness
from ..sources.durable import durable
from .base import ORACLES, query, table
from .graph_queries import turns_of
from .memory_queries import memory_of


@query(
    "q4_artifact_leaks",
    """SELECT lang AS record_id, doc_id AS question_id, 'a.gold_answer' AS path, 'gold_answer' AS key FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT lang, doc_id, 'b[1].reward', 'reward' FROM documents WHERE doc_id % 4 = 0""",
)
def artifact_leaks(spark, sf_dir):
    """All documents as questions whose metadata hold their texts, and some of them forbidden keys."""
    d = table(spark, sf_dir, "documents")
    inner = F.struct(F.when(F.col("doc_id") % 3 == 0, F.lit("x")).alias("gold_answer"), F.col("text").alias("note"))
    second = F.struct(F.lit(1).alias("seen"), F.when(F.col("doc_id") % 4 == 0, F.lit(0.5)).alias("reward"))
    meta = F.to_json(F.struct(inner.alias("a"), F.array(F.struct(F.lit(0).alias("seen"), F.lit(None).cast("double").alias("reward")), second).alias("b")))
    return questions.artifact_leaks(d.select(F.col("lang").alias("record_id"), F.col("doc_id").alias("question_id"), meta.alias("metadata")))


@query(
    "q6_verdict_summary",
    """WITH t AS (SELECT o_custkey, o_orderpriority AS type, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' OR o_orderstatus = 'P') AS ok FROM orders GROUP BY ALL)
    SELECT o_custkey AS record_id, sum(n)::BIGINT AS candidates, sum(ok)::BIGINT AS accepted, sum(n - ok)::BIGINT AS rejected, coalesce(string_agg(type || '=' || ok::VARCHAR, ',' ORDER BY type) FILTER (ok > 0), '') AS question_types FROM t GROUP BY o_custkey""",
)
def verdict_summary(spark, sf_dir):
    """Orders as questions of their customer; their status is the verdict, and a question to revise is accepted."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("question_type"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'P' THEN 'revise' ELSE 'reject' END").alias("verdict"))
    judged = questions.apply_verdicts(o.drop("verdict"), o, accept_revise=True)
    out = questions.verdict_summary(judged)
    return out.withColumn("question_types", F.array_join(F.transform("question_types", lambda t: F.concat(t["type"], F.lit("="), t["n"].cast("string"))), ","))


_PARTS = "CASE WHEN value < 3 AND user_id % 3 = 0 THEN 'failed' WHEN user_id % 7 = 0 AND event_id % 9 = 0 THEN 'running' WHEN user_id % 5 = 0 THEN 'partial' WHEN user_id % 2 = 0 THEN 'succeeded' WHEN user_id % 11 = 0 THEN 'failed' ELSE 'pending' END"
_ACTORS = "CASE WHEN user_id % 4 = 0 THEN 'none' WHEN user_id % 4 = 1 THEN 'ok' WHEN user_id % 4 = 2 AND event_id % 2 = 0 THEN 'ok' ELSE 'failed' END"


@query(
    "z2_statuses_by_kind",
    f"""WITH r AS (SELECT user_id, {_PARTS} AS s, {_ACTORS} AS a FROM events)
    SELECT user_id, CASE WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'running') THEN 'running' WHEN bool_and(s = 'succeeded') THEN 'succeeded' WHEN bool_or(s = 'partial') THEN 'partial' ELSE 'pending' END AS round,
      CASE WHEN bool_and(s = 'succeeded') THEN 'succeeded' WHEN bool_and(s = 'failed') THEN 'failed' ELSE 'partial' END AS suite,
      CASE WHEN bool_and(a = 'ok') THEN 'ok' WHEN bool_or(a = 'ok') THEN 'partial' WHEN bool_and(a = 'none') THEN 'skipped' ELSE 'failed' END AS actor FROM r GROUP BY user_id""",
)
def statuses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda kind, sql: suite.rollup_status(e.select("user_id", F.expr(sql).alias("status")), "user_id", kind).withColumnRenamed("status", kind)
    return of("round", _PARTS).join(of("suite", _PARTS), "user_id").join(of("actor", _ACTORS), "user_id")


@query(
    "l10_checkpoint_issues",
    """WITH c AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS updated, o_orderkey % 3 = 0 AS is_local, o_orderkey % 5 <> 0 AS has_model, o_orderkey % 7 <> 0 AS has_path, o_custkey % 4 = 0 AS lost FROM orders)
    SELECT id AS checkpoint_id, 'duplicate_checkpoint_id' AS code, 'error' AS severity FROM c WHERE id % 13 = 0
    UNION ALL SELECT id, 'missing_path', 'error' FROM c, (SELECT unnest([0, 1]) AS twice) WHERE updated AND NOT has_path AND (twice = 0 OR id % 13 = 0)
    UNION ALL SELECT id, 'missing_' || part || '_for_updated_checkpoint', 'error' FROM c, (SELECT unnest([0, 1]) AS twice), (SELECT unnest(['model', 'tokenizer', 'optimizer']) AS part) WHERE updated AND is_local AND (twice = 0 OR id % 13 = 0) AND (part = 'optimizer' OR (part = 'model' AND NOT has_model))
    UNION ALL SELECT id, 'model_path_not_found', 'error' FROM c, (SELECT unnest([0, 1]) AS twice) WHERE is_local AND has_model AND lost AND (twice = 0 OR id % 13 = 0)
    UNION ALL SELECT id, 'tokenizer_path_not_found', 'warning' FROM c, (SELECT unnest([0, 1]) AS twice) WHERE is_local AND (twice = 0 OR id % 13 = 0)""",
)
def checkpoint_issues(spark, sf_dir):
    """Orders as checkpoints, one in thirteen listed twice; a customer's folder is the model's."""
    o = table(spark, sf_dir, "orders")
    key, folder = F.col("o_orderkey"), F.concat(F.lit("/models/"), F.col("o_custkey").cast("string"))
    c = o.select(
        key.alias("checkpoint_id"), (key % 2 == 0).alias("updated"), F.when(key % 3 == 0, "local_hf").otherwise("remote").alias("backend"), F.when(key % 7 != 0, "/checkpoints").alias("checkpoint_path"),
        F.when(key % 5 != 0, folder).alias("model_path"), F.lit("/nowhere").alias("tokenizer_path"), F.lit("").alias("optimizer_path"),
    )
    paths = o.where("o_custkey % 4 <> 0").select(folder.alias("path")).distinct().unionByName(spark.range(1).select(F.lit("/checkpoints").alias("path")))
    return audit.checkpoint_issues(c.unionByName(c.where("checkpoint_id % 13 = 0")), paths)


@query(
    "a9_group_issues",
    """WITH s AS (SELECT DISTINCT l_orderkey AS g, l_orderkey::VARCHAR || '_' || l_linenumber::VARCHAR AS id, l_linenumber AS n, l_orderkey % 11 = 0 AS mixed FROM lineitem)
    SELECT 'duplicate_sample_id' AS code, id AS path FROM s WHERE n = 1 AND g % 5 = 0
    UNION ALL SELECT 'group_record_mismatch', g::VARCHAR FROM s WHERE mixed GROUP BY g HAVING min(n) <> max(n)
    UNION ALL SELECT 'reward_without_sample', id || 'x' FROM s WHERE n = 2
    UNION ALL SELECT 'duplicate_advantage_sample_id', id FROM s WHERE n = 3
    UNION ALL SELECT 'advantage_without_reward', id FROM s, (SELECT unnest([1, 2]) AS k) WHERE n = 3 AND g % 3 = 0 AND g IN (SELECT g FROM s WHERE NOT (n = 3 AND g % 3 = 0))
    UNION ALL SELECT 'advantage_role_mismatch', id FROM s WHERE n = 4""",
)
def group_issues(spark, sf_dir):
    """Lines of orders as samples of a group, with planted faults."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    sid = F.concat_ws("_", "l_orderkey", "l_linenumber")
    record = F.when(F.col("l_orderkey") % 11 == 0, F.col("l_linenumber")).otherwise(F.lit(0)).cast("string")
    s = durable(line.select(F.col("l_orderkey").cast("string").alias("group_id"), sid.alias("sample_id"), record.alias("record_id"), F.lit("memory_builder").alias("role"), F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("g")))
    lost = F.when(F.col("n") == 2, F.concat("sample_id", F.lit("x"))).otherwise(F.col("sample_id")).alias("sample_id")
    given = s.where("NOT (n = 3 AND g % 3 = 0)").select("group_id", lost)
    a = s.select("group_id", lost, F.when(F.col("n") == 4, "question_agent").otherwise("memory_builder").alias("role"), "n")
    return rollout.group_issues(s.unionByName(s.where("n = 1 AND g % 5 = 0")), given, a.unionByName(a.where("n = 3")).drop("n"))


@query(
    "b3_question_contexts",
    """WITH b AS (SELECT o_custkey, o_orderkey, o_orderpriority AS kind, floor(o_totalprice / 50000) AS severity, o_orderkey % 3 AS frequency FROM orders WHERE o_orderstatus <> 'F'),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY severity DESC, frequency DESC, o_orderkey) AS rank FROM b)
    SELECT o_custkey::VARCHAR AS record_id, rank::INT AS rank, kind AS failure_type, 'n' || o_orderkey::VARCHAR AS missing, 'failure_type,missing_oracle_node_ids,question_type,related_session_ids' AS keys FROM r WHERE rank <= 3""",
)
def question_contexts(spark, sf_dir):
    """Orders as weaknesses of their customer; the three gravest open ones, read back from the contexts."""
    o = table(spark, sf_dir, "orders")
    book = o.select(
        F.col("o_custkey").cast("string").alias("record_id"), F.col("o_orderpriority").alias("failure_type"), F.lit("other").alias("question_type"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("severity"),
        (F.col("o_orderkey") % 3).cast("int").alias("frequency"), F.when(F.col("o_orderstatus") == "F", "mastered").otherwise("active").alias("status"), F.array(F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))).alias("missing_oracle_node_ids"),
        F.array(F.lit("s")).alias("related_session_ids"), F.array(F.lit("secret")).alias("related_memory_ids"), F.col("o_orderkey").alias("entry_ord"),
    )
    out = weakness.question_agent_context(book, 3)
    entries = F.from_json(F.get_json_object("context", "$.active_weaknesses"), "array<struct<failure_type:string,missing_oracle_node_ids:array<string>>>")
    each = out.select("record_id", "context", F.posexplode(entries).alias("pos", "e"))
    keys = F.array_join(F.array_sort(F.json_object_keys(F.get_json_object("context", "$.active_weaknesses[0]"))), ",")
    return each.select("record_id", (F.col("pos") + 1).alias("rank"), "e.failure_type", F.col("e.missing_oracle_node_ids")[0].alias("missing"), keys.alias("keys"))


@query(
    "m13_build_summary",
    f"""WITH p AS ({ORACLES['m12_memory_stats']}), ok AS (SELECT * FROM p WHERE right(record_id, 1) <> '3')
    SELECT count(*) AS records, sum(nodes)::BIGINT AS nodes, sum(edges)::BIGINT AS edges, sum(events)::BIGINT AS retained_turns, sum(turns)::BIGINT AS turns, count(*) FILTER (nodes = 0) AS empty_records,
      (SELECT count(*) FROM p WHERE right(record_id, 1) = '3') AS failed_records FROM ok""",
)
def build_summary(spark, sf_dir):
    """Totals where the builds of some records have failed."""
    t = turns_of(spark, sf_dir)
    nodes, edges, _ = memory_of(spark, sf_dir)
    failed = t.where(F.col("record_id").endswith("3")).select("record_id").distinct()
    out = memory.memory_build_summary(memory.memory_stats(nodes, edges, t), failed)
    return out.select("records", "nodes", "edges", "retained_turns", "turns", "empty_records", "failed_records")
