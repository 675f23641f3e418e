"""Queries over orders and their lines as questions, samples and replay rows, and over turns that repeat themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, graph, replay, rewards, rollout, splits, suite
from . import sqlparts as S
from .base import query, table
from .graph_queries import turns_of
from .memory_queries import _COMPONENTS, _NAMES, _TOTAL, scored_memory_of

_SAYS = "CASE WHEN event_ord % 3 = 0 THEN 'Noted,  thank YOU.' WHEN event_ord % 7 = 0 THEN 'noted, thank you.' ELSE text END"
_REPEATED = S.FACTS.replace("turns AS (", "turns0 AS (", 1).replace("facts0 AS (", f"turns AS (SELECT * REPLACE ({_SAYS} AS text) FROM turns0), facts0 AS (", 1)
_VERDICT = "CASE rank % 4 WHEN 0 THEN 'supersede' WHEN 1 THEN 'refine' WHEN 2 THEN 'unrelated' ELSE 'contradict' END"


def _repeated_facts(spark, sf_dir):
    return graph.heuristic_facts(turns_of(spark, sf_dir).withColumn("text", F.expr(_SAYS)))


@query("g8_repeated_facts", f"WITH {_REPEATED}, {S.RELATIONS} SELECT record_id, new_fact, old_fact, rank, 'duplicate' AS relation, 0.6 AS confidence FROM relations")
def repeated_facts(spark, sf_dir):
    """Turns of which two in five say the same, in other cases and spaces."""
    return graph.fact_relations(_repeated_facts(spark, sf_dir)).select("record_id", "new_fact", "old_fact", "rank", "relation", "confidence")


@query(
    "g9_judged_relations",
    f"""WITH {_REPEATED}, {S.RELATIONS}, v AS (SELECT *, {_VERDICT} AS relation FROM relations)
    SELECT record_id, new_fact AS source, old_fact AS target, CASE relation WHEN 'supersede' THEN 'SUPERSEDES' WHEN 'refine' THEN 'COMPLEMENTS' ELSE 'CONTRADICTS' END AS edge_type, 0.9 AS confidence, 'edge' AS part FROM v WHERE relation <> 'unrelated'
    UNION ALL SELECT DISTINCT record_id, old_fact, NULL, 'stale', NULL, 'node' FROM v WHERE relation = 'supersede'""",
)
def judged_relations(spark, sf_dir):
    """Verdicts from outside on each pair of repeated facts: typed edges, and facts that are stale."""
    facts = _repeated_facts(spark, sf_dir)
    pairs = graph.fact_relations(facts)
    verdicts = pairs.select("record_id", "new_fact", "old_fact", F.expr(_VERDICT).alias("relation"), F.lit(0.9).alias("confidence"))
    edges = graph.oracle_edges(turns_of(spark, sf_dir).withColumn("text", F.expr(_SAYS)), facts, verdicts).where("edge_type in ('SUPERSEDES', 'COMPLEMENTS', 'CONTRADICTS', 'DUPLICATE_OF')")
    stale = graph.stale_facts(graph.fact_relations(facts, verdicts))
    return edges.select("record_id", "source", "target", "edge_type", "confidence", F.lit("edge").alias("part")).unionByName(stale.select("record_id", F.col("node_id").alias("source"), F.lit(None).cast("string").alias("target"), F.col("status").alias("edge_type"), F.lit(None).cast("double").alias("confidence"), F.lit("node").alias("part")))


@query(
    "v14_v15_question_rewards",
    """WITH q AS (SELECT o_custkey AS record_id, o_orderpriority AS kind, o_orderkey AS k, o_orderkey % 3 <> 0 AS ok, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 10 / 10.0::DOUBLE END AS correctness FROM orders),
    p AS (SELECT record_id, avg(ok::INT) AS oracle_validity, coalesce(avg(1 - coalesce(correctness, 0)) FILTER (ok), 0) AS adversarial_success, count(DISTINCT k % 4) FILTER (ok) AS covered, count(DISTINCT kind) AS types, count(DISTINCT k % 6) AS sessions, count(*) AS nodes FROM q GROUP BY 1),
    r AS (SELECT *, covered / nodes AS coverage_gain, least(1.0, (types / 5.0::DOUBLE + least(sessions / 3.0::DOUBLE, 1.0)) / 2) AS diversity FROM p)
    SELECT record_id, round(oracle_validity, 9) AS oracle_validity, round(adversarial_success, 9) AS adversarial_success, round(coverage_gain, 9) AS coverage_gain, round(diversity, 9) AS diversity,
      round(least(1.0, greatest(0.0, 0.35 * oracle_validity + 0.25 * adversarial_success + 0.15 * coverage_gain + 0.15 * 0.5 + 0.10 * diversity)), 9) AS total_reward FROM r""",
)
def question_rewards(spark, sf_dir):
    """Orders as questions of their customer, whose oracle graph has a node per order; one in five has no score."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("question_type"))
    k = F.col("question_id")
    cite = lambda m: F.array(F.concat(F.lit("n"), (k % m).cast("string")))
    q = o.withColumns({"supporting_node_ids": cite(4), "supporting_session_ids": cite(6)})
    verdicts = o.select("record_id", "question_id", F.when(k % 3 != 0, "accept").otherwise("reject").alias("verdict"))
    items = o.where(k % 5 != 0).select("record_id", "question_id", (k % 10 / 10).alias("correctness"))
    out = rewards.question_rewards(q, verdicts, items, o.select("record_id", k.alias("node_id")))
    return out.select("record_id", *[F.round(c, 9).alias(c) for c in ("oracle_validity", "adversarial_success", "coverage_gain", "diversity", "total_reward")])


_LINES = "SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()


@query(
    "a8_a13_update_items",
    f"""WITH l AS ({_LINES}), a AS (SELECT *, (n + k) % 4 <> 0 AS sel, (k * 7 + n * 3) % 100 / 10.0::DOUBLE AS reward FROM l)
    SELECT k % 50 AS batch, count(DISTINCT k) AS groups, count(*) AS samples, count(*) FILTER (sel) AS selected, round(avg(reward), 8) AS reward_mean, round(stddev_pop(reward), 8) AS reward_std,
      count(*) FILTER (sel AND n <> 2) AS matched, count(*) FILTER (sel AND n = 2) AS unmatched FROM a GROUP BY 1""",
)
def update_items(spark, sf_dir):
    """Lines as samples of their order's group; the second line's prompt is lost."""
    a = _lines(spark, sf_dir).select((F.col("k") % 50).alias("batch"), F.col("k").alias("group_id"), F.concat_ws("_", "k", "n").alias("sample_id"), "n", ((F.col("n") + F.col("k")) % 4 != 0).alias("selected_for_update"), ((F.col("k") * 7 + F.col("n") * 3) % 100 / 10).alias("reward"))
    samples = a.where("n <> 2").select("sample_id", F.lit("p").alias("prompt"), F.lit("r").alias("response"))
    matched, lost = rollout.update_items(a, samples)
    stats = rollout.batch_stats(a, "batch").withColumns({c: F.round(c, 8) for c in ("reward_mean", "reward_std")})
    sides = matched.select("batch", F.lit(1).alias("m"), F.lit(0).alias("u")).unionByName(lost.select("batch", F.lit(0).alias("m"), F.lit(1).alias("u"))).groupBy("batch").agg(F.sum("m").alias("matched"), F.sum("u").alias("unmatched"))
    return stats.hint("merge").join(sides.hint("merge"), "batch", "left").na.fill(0, ["matched", "unmatched"])


def _replay_lines(spark, sf_dir):
    line = _lines(spark, sf_dir)
    k, n = F.col("k"), F.col("n")
    rows = line.select(
        k.alias("record_id"), (n % 3).alias("round_id"), F.lit(0).alias("step_id"), F.lit(None).cast("string").alias("memory_builder_checkpoint_id"), F.lit("").alias("question_agent_checkpoint_id"), (k * 10 + n).alias("ingest_ord"),
        F.when(n != 5, (k + n) % 10 / 10).alias("memory_reward"), ((k + n) % 6 != 0).alias("no_leakage_passed"), F.when(n % 4 != 0, F.concat_ws("/", F.lit("/p"), "k", "n")).alias("memory_reward_report_path"), "n",
    )
    return replay.replay_items(rows, line.where("k % 3 = 0").select(k.alias("record_id")))


_R = f"l AS ({_LINES}), i AS (SELECT *, CASE WHEN n <> 5 THEN (k + n) % 10 / 10.0::DOUBLE END AS reward, (k + n) % 6 <> 0 AS safe FROM l)"


@query(
    "x4_x6_aggregate_replay",
    f"""WITH {_R}, s AS (SELECT *, k::VARCHAR || ':' || (n % 3)::VARCHAR || ':0:none:none' AS key FROM i WHERE k % 4 <> 0 AND k IN (SELECT o_orderkey FROM orders)),
    t AS (SELECT 'train' AS split, key, min(k * 10 + n) AS ord, count(*) AS n FROM s WHERE safe AND reward IS NOT NULL GROUP BY key UNION ALL SELECT 'dev', key, min(k * 10 + n), count(*) FROM s WHERE safe GROUP BY key)
    SELECT split, count(*) AS num_replay_items, count(*) FILTER (split = 'train') AS num_train_items, count(*) FILTER (split = 'dev') AS num_eval_only_items, count(*) AS no_leakage_pass_count, sum(n - 1)::BIGINT AS num_duplicates_removed,
      (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0) AS num_source_records, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0) AS num_skipped_records,
      (SELECT string_agg(key, ',' ORDER BY ord) FROM (SELECT key, ord FROM t u WHERE u.n > 1 AND u.split = t.split ORDER BY ord LIMIT 10)) AS duplicate_keys FROM t GROUP BY split""",
)
def aggregate_replay(spark, sf_dir):
    """Lines as replay rows of their order, whose rounds repeat; orders that failed stay out."""
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 4 != 0, "succeeded").otherwise("failed").alias("status"))
    of = lambda split: replay.aggregate_replay(_replay_lines(spark, sf_dir), records, split)[1].withColumn("split", F.lit(split))
    return of("train").unionByName(of("dev")).withColumn("duplicate_keys", F.array_join("duplicate_keys", ","))


@query(
    "x7_replay_stage",
    f"""WITH {_R}, s AS (SELECT * FROM i WHERE k % 10 <> 0 AND (k % 11 <> 0 OR n = 5)),
    p AS (SELECT o_orderkey AS record_id, count(s.k) AS num_replay_items, count(reward) AS num_selected_for_training, count(*) FILTER (reward < 0.5) AS num_low_memory_reward, count(s.k) FILTER (s.k % 3 = 0) AS num_weakness_updated, count(*) FILTER (reward IS NOT NULL AND NOT safe) AS unsafe,
      count(*) FILTER (reward IS NOT NULL AND n % 4 <> 0 AND n % 2 = 1) AS missing_reports FROM orders LEFT JOIN s ON s.k = o_orderkey GROUP BY 1)
    SELECT * EXCLUDE (unsafe), CASE WHEN num_replay_items = 0 THEN 'no_items' WHEN num_selected_for_training = 0 THEN 'none_selected' WHEN unsafe > 0 THEN 'leakage' END AS error,
      CASE WHEN num_replay_items > 0 AND num_selected_for_training > 0 AND unsafe = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM p""",
)
def replay_stage(spark, sf_dir):
    """Orders as records before training; some have no rows, some none that is selected, and odd lines' reports are lost."""
    items = _replay_lines(spark, sf_dir).where("record_id % 10 <> 0 and (record_id % 11 <> 0 or n = 5)")
    paths = _lines(spark, sf_dir).where("n % 2 = 0").select(F.concat_ws("/", F.lit("/p"), "k", "n").alias("path"))
    return replay.replay_stage(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id")), items, paths)


_STAGE = "CASE doc_id % 5 WHEN 0 THEN 'memory_builder_input' WHEN 1 THEN 'question_agent_training_input' WHEN 2 THEN 'answerer_input' WHEN 3 THEN 'trainer_batch' ELSE 'other' END"


@query(
    "l4_stage_audit",
    f"""WITH d AS (SELECT doc_id, {_STAGE} AS stage FROM documents), i AS (
      SELECT doc_id, stage, '__unreadable_json__' AS field FROM d WHERE doc_id % 7 = 0
      UNION ALL SELECT doc_id, stage, 'gold_answer' FROM d WHERE doc_id % 7 <> 0 AND doc_id % 3 = 0 AND stage IN ('memory_builder_input', 'answerer_input', 'trainer_batch')
      UNION ALL SELECT doc_id, stage, 'test_label' FROM d WHERE doc_id % 7 <> 0 AND doc_id % 4 = 0 AND stage IN ('memory_builder_input', 'question_agent_training_input', 'trainer_batch'))
    SELECT e.experiment, e.scanned_files, coalesce(issues, 0) AS issues, coalesce(bad_files, 0) AS bad_files, CASE WHEN issues > 0 THEN 'failed' ELSE 'passed' END AS status, fields
    FROM (SELECT doc_id % 100 AS experiment, count(*) AS scanned_files FROM documents GROUP BY 1) e
    LEFT JOIN (SELECT doc_id % 100 AS experiment, count(*) AS issues, count(DISTINCT doc_id) AS bad_files, sum(CASE field WHEN 'gold_answer' THEN 1 WHEN 'test_label' THEN 100 ELSE 10000 END)::BIGINT AS fields FROM i GROUP BY 1) r USING (experiment)""",
)
def stage_audit(spark, sf_dir):
    """Documents as inputs of stages, their whole texts inside JSON with forbidden fields in objects of lists."""
    d = table(spark, sf_dir, "documents")
    gold = F.struct(F.when(F.col("doc_id") % 3 == 0, F.lit(1)).alias("gold_answer"), F.col("text").alias("note"))
    label = F.struct(F.array(F.struct(F.when(F.col("doc_id") % 4 == 0, F.lit("")).alias("test_label"))).alias("in"), F.col("text").alias("gold"))
    body = F.when(F.col("doc_id") % 7 != 0, F.to_json(F.struct(F.array(gold).alias("a"), label.alias("b"))))
    a = d.select((F.col("doc_id") % 100).alias("experiment"), F.col("doc_id").cast("string").alias("path"), F.expr(_STAGE).alias("stage"), F.lit("train").alias("split"), F.when(F.col("doc_id") % 14 == 0, "{gold_answer").otherwise(body).alias("json"))
    issues = audit.stage_audit(a)
    weight = F.when(F.col("field") == "gold_answer", 1).when(F.col("field") == "test_label", 100).otherwise(10000)
    return audit.audit_report(a, issues).join(issues.groupBy("experiment").agg(F.sum(weight).alias("fields")).hint("merge"), "experiment", "left")


@query(
    "l6_k9_batch_gate",
    """SELECT o_orderkey AS batch_id, o_orderkey % 4 < 2 AS update_allowed, concat_ws('|', CASE WHEN o_orderkey % 4 >= 2 THEN 'not_train_split' END, CASE WHEN o_orderkey % 5 = 0 THEN 'manifest_failed' END, CASE WHEN o_orderkey % 6 = 0 THEN 'leakage' END, CASE WHEN n IS NULL OR o_orderkey % 9 = 0 THEN 'empty' END) AS reasons
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def batch_gate(spark, sf_dir):
    """Orders as update batches of their lines."""
    n = table(spark, sf_dir, "lineitem").where("l_orderkey % 9 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    b = table(spark, sf_dir, "orders").select("o_orderkey").hint("merge").join(n.hint("merge"), "o_orderkey", "left").na.fill(0, ["items"])
    k = F.col("o_orderkey")
    b = b.select(k.alias("batch_id"), F.when(k % 4 < 2, "train").when(k % 4 == 2, "dev").otherwise("test").alias("split"), (k % 5 != 0).alias("manifest_passed"), (k % 6 == 0).cast("int").alias("violations"), "items")
    return splits.with_policy(audit.batch_gate(b)).select("batch_id", "update_allowed", F.array_join("reasons", "|").alias("reasons"))


_STATS = """SELECT o_custkey AS suite, CASE o_orderkey % 4 WHEN 0 THEN 'no_llm_memory' WHEN 1 THEN 'final_checkpoint' WHEN 2 THEN 'initial_checkpoint' ELSE 'odd' END AS method, avg(o_totalprice::DOUBLE / 70000) AS m, stddev_samp(o_totalprice::DOUBLE / 70000) AS sd, count(*) AS n FROM orders GROUP BY 1, 2"""


def _stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("suite"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'no_llm_memory' WHEN 1 THEN 'final_checkpoint' WHEN 2 THEN 'initial_checkpoint' ELSE 'odd' END").alias("method"), (F.col("o_totalprice").cast("double") / 70000).alias("v"))
    per = o.groupBy("suite", "method").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count(F.lit(1)).alias("count"))
    metric = F.explode(F.array(*[F.lit(m) for m in ("test_memory_reward_mean", "test_no_leakage_pass_rate")])).alias("metric")
    return per.select("suite", "method", "mean", "std", "count", (F.col("std") / F.sqrt("count")).alias("stderr"), metric)


@query(
    "p20_suite_report",
    f"""SELECT suite, CASE method WHEN 'no_llm_memory' THEN 1 WHEN 'initial_checkpoint' THEN 2 ELSE 3 END AS place, CASE method WHEN 'no_llm_memory' THEN 'No-LLM Memory' WHEN 'initial_checkpoint' THEN 'Initial Model' ELSE 'Final Model' END AS name,
      CASE WHEN sd IS NULL OR sd = 0 THEN printf('%.4f', m) ELSE printf('%.4f', m) || ' ± ' || printf('%.4f', sd) END AS memory_reward, 'N/A' AS question_reward, printf('%.4f', m) AS no_leakage, n AS seeds, CASE method WHEN 'no_llm_memory' THEN 'baseline' WHEN 'initial_checkpoint' THEN 'before training' ELSE 'trained' END AS notes
      FROM (SELECT suite, method, round(m, 9) AS m, round(sd, 9) AS sd, n FROM ({_STATS})) WHERE method <> 'odd'""",
)
def suite_report(spark, sf_dir):
    """Customers as suites, four methods by order, one of them unknown to the report. Statistics are rounded to nine
    decimals before they are written: the last bits of a mean depend on the order of its sum, and a mean that is halfway
    between two texts would go by them."""
    rounded = _stats(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("mean", "std")})
    return suite.suite_report(rounded, ["suite"]).drop("method")


@query(
    "z11_bar_chart",
    f"SELECT suite, method, CASE method WHEN 'no_llm_memory' THEN 1 WHEN 'initial_checkpoint' THEN 2 ELSE 3 END AS place, round(m, 8) AS test_memory_reward_mean, round(sd / sqrt(n), 8) AS test_memory_reward_stderr, NULL::DOUBLE AS test_question_reward_mean, NULL::DOUBLE AS test_question_reward_stderr FROM ({_STATS}) WHERE method <> 'odd'",
)
def bar_chart(spark, sf_dir):
    return suite.bar_chart(_stats(spark, sf_dir), ["suite"]).withColumns({c: F.round(c, 8) for c in ("test_memory_reward_mean", "test_memory_reward_stderr")})


@query(
    "z11_z13_curves_and_runs",
    """WITH p AS (SELECT o_custkey AS run_id, o_custkey % 7 AS seed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderkey AS round_id, round(o_totalprice::DOUBLE, 2) AS reward FROM orders WHERE o_custkey % 4 <> 0)
    SELECT run_id, seed, place, round_id, reward, false AS pending FROM p UNION ALL SELECT DISTINCT o_custkey, o_custkey % 7, NULL, NULL, NULL, true FROM orders WHERE o_custkey % 4 = 0""",
)
def curves_and_runs(spark, sf_dir):
    """Customers as runs and orders as rounds: the curves of runs that succeeded, and the runs that are still to do."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("round_id"), F.col("o_totalprice").cast("double").alias("train_memory_reward_mean"))
    runs = o.select("run_id").distinct().select("run_id", (F.col("run_id") % 7).alias("seed"), F.when(F.col("run_id") % 4 != 0, "succeeded").otherwise("failed").alias("status"))
    points = suite.curve_points(o, runs).select("run_id", "seed", "place", "round_id", F.round("train_memory_reward_mean", 2).alias("reward"), F.lit(False).alias("pending"))
    left = suite.pending_runs(runs.select("run_id", "seed"), runs, "run_id")
    return points.unionByName(left.select("run_id", "seed", F.lit(None).cast("int").alias("place"), F.lit(None).cast("bigint").alias("round_id"), F.lit(None).cast("double").alias("reward"), F.lit(True).alias("pending")))


_FAILED = "concat_ws('|', CASE WHEN non_redundancy < 0.65 THEN 'redundancy_noise' END, CASE WHEN compression_balance <= 0.25 AND oracle_coverage < 0.45 THEN 'over_compression' END, CASE WHEN abstraction_quality < 0.5 THEN 'wrong_abstraction' END, CASE WHEN format_safety < 1 THEN 'format_safety_error' END)"


@query(
    "v10_v13_unsafe_memories",
    f"WITH {_COMPONENTS}, u AS (SELECT * REPLACE (CASE WHEN right(record_id, 1) IN ('3', '8') THEN 0.0::DOUBLE ELSE 1.0 END AS format_safety) FROM comp) SELECT record_id, {', '.join(f'round({c}, 9) AS {c}' for c in _NAMES)}, round(greatest(0, least(1, {_TOTAL})), 9) AS total_reward, {_FAILED} AS failures FROM u",
)
def unsafe_memories(spark, sf_dir):
    """Rewards where two records in ten have validation issues."""
    items, nodes, summaries = scored_memory_of(spark, sf_dir)
    records = turns_of(spark, sf_dir).select("record_id").distinct()
    out = rewards.memory_rewards(rewards.memory_components(items, nodes, summaries, records, records.where(F.col("record_id").rlike("[38]$"))))
    return out.select("record_id", *[F.round(c, 9).alias(c) for c in [*_NAMES, "total_reward"]], F.array_join("global_failures", "|").alias("failures"))
