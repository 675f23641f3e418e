"""Queries over inspections: rounds, steps, rollouts, alignment, releases, splits, books, returns, with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inspection, rollout, splits, weakness
from .base import query, table


@query(
    "l7_inspect_rounds",
    """WITH o AS (SELECT o_custkey AS run_id, o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice::DOUBLE / 250000 END AS rate,
      'c' || (o_orderkey % 4)::VARCHAR AS inp, CASE WHEN o_orderkey % 3 <> 0 THEN 'c' || (o_orderkey % 2)::VARCHAR END AS sel FROM orders),
    w AS (SELECT *, row_number() OVER r AS n, lag(coalesce(sel, inp)) OVER r AS before FROM o WINDOW r AS (PARTITION BY run_id ORDER BY k))
    SELECT run_id, k AS round_id, 'warning' AS severity, 'checkpoint_inconsistency' AS code, 'memory_builder' AS what FROM w WHERE n > 1 AND before IS DISTINCT FROM inp
    UNION ALL SELECT run_id, k, 'error', 'leakage_risk', 'train_no_leakage_pass_rate' FROM o WHERE NOT isnan(rate) AND rate < 0.8
    UNION ALL SELECT run_id, k, 'error', 'invalid_metric', 'train_no_leakage_pass_rate' FROM o WHERE isnan(rate) OR rate > 1
    UNION ALL SELECT run_id, k, 'error', code, 'dev_no_leakage_pass_rate' FROM o, (SELECT unnest(['leakage_risk', 'invalid_metric']) AS code) WHERE k % 19 = 0
    UNION ALL SELECT run_id, k, 'error', 'invalid_metric', 'train_memory_reward_mean' FROM o WHERE k % 23 = 0
    UNION ALL SELECT run_id, k, 'error', 'missing_artifact', 'train_rollout_manifest' FROM o WHERE k % 2 = 0 AND k % 7 = 0
    UNION ALL SELECT run_id, k, 'error', 'missing_artifact', 'trainer_step_manifest' FROM o WHERE k % 3 = 0 AND k % 11 = 0
    UNION ALL SELECT run_id, k, 'error', 'missing_artifact', 'dev_rollout_manifest' FROM o WHERE k % 13 = 0
    UNION ALL SELECT run_id, k, 'warning', 'missing_artifact', 'checkpoint_selection' FROM o WHERE k % 4 = 0 AND k % 5 <> 0
    UNION ALL SELECT run_id, k, 'warning', 'missing_artifact', 'round_plan' FROM o WHERE k % 6 = 0
    UNION ALL SELECT run_id, k, 'warning', 'missing_artifact', 'round_summary' FROM o WHERE k % 9 = 0
    UNION ALL SELECT run_id, k, 'warning', 'validation_error', 'train_rollout_manifest' FROM o WHERE k % 2 = 0 AND k % 7 = 0
    UNION ALL SELECT run_id, k, 'error', 'split_policy_violation', 'train_rollout_manifest' FROM o WHERE k % 2 = 0 AND k % 7 <> 0 AND k % 5 = 0
    UNION ALL SELECT run_id, k, 'warning', 'validation_error', 'trainer_step_manifest' FROM o WHERE k % 3 = 0 AND (k % 8 = 0 OR k % 11 = 0)
    UNION ALL SELECT run_id, k, 'warning', 'validation_error', 'dev_rollout_manifest' FROM o WHERE k % 13 = 0
    UNION ALL SELECT run_id, k, 'error', 'split_policy_violation', 'dev_rollout_manifest' FROM o WHERE k % 13 <> 0 AND k % 10 = 0""",
)
def inspect_rounds(spark, sf_dir):
    """Orders as rounds of their customer's run."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    at = lambda name, test=None: F.when(F.lit(True) if test is None else F.expr(test), F.concat(F.lit("/r/"), F.col("k").cast("string"), F.lit(f"/{name}")))
    rounds = o.select(
        F.col("o_custkey").alias("run_id"), F.col("k").alias("round_id"), F.concat(F.lit("/r/"), F.col("k").cast("string")).alias("output_dir"), at("t", "k % 2 = 0").alias("train_rollout_manifest_path"), at("s", "k % 3 = 0").alias("trainer_step_manifest_path"),
        at("d").alias("dev_rollout_manifest_path"), F.coalesce(at("c", "k % 5 <> 0"), F.lit("")).alias("checkpoint_selection_path"), F.expr("if(k % 17 = 0, double('nan'), double(o_totalprice) / 250000)").alias("train_no_leakage_pass_rate"),
        F.expr("if(k % 19 = 0, -0.1D, null)").alias("dev_no_leakage_pass_rate"), F.expr("if(k % 23 = 0, double('inf'), 0.5D)").alias("train_memory_reward_mean"),
        F.expr("concat('c', k % 4)").alias("input_memory_builder_checkpoint_id"), F.expr("if(k % 3 <> 0, concat('c', k % 2), null)").alias("selected_memory_builder_checkpoint_id"),
    )
    there = {"t": "k % 7 <> 0", "s": "k % 11 <> 0", "d": "k % 13 <> 0", "c": "k % 4 <> 0", "round_plan.json": "k % 6 <> 0", "round_summary.json": "k % 9 <> 0"}
    paths = o.select(F.explode(F.array_compact(F.array(*[at(n, t) for n, t in there.items()]))).alias("path"))
    tell = {"t": "if(k % 5 = 0, 'dev', 'train')", "s": "if(k % 8 = 0, null, 'train')", "d": "if(k % 10 = 0, 'test', 'dev')"}
    read = o.select(F.explode(F.array(*[F.struct(at(n, there[n]).alias("path"), F.expr(s).alias("split")) for n, s in tell.items()])).alias("m")).select("m.*").where("path is not null")
    return inspection.inspect_rounds(rounds, paths, read)


@query(
    "l7b_inspect_steps",
    """WITH a AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem)
    SELECT o_orderkey AS step_id, 'error' AS severity, 'invalid_metric' AS code, 'kl' AS what FROM orders WHERE o_orderkey % 29 = 0
    UNION ALL SELECT k, 'error', 'leakage_risk', 'a' || n::VARCHAR FROM a WHERE n % 4 = 0 OR n = 7
    UNION ALL SELECT k, 'error', 'invalid_metric', 'a' || n::VARCHAR || '.loss' FROM a WHERE (k + n) % 13 = 0
    UNION ALL SELECT k, 'error', 'invalid_metric', 'a' || n::VARCHAR || '.grad_norm' FROM a WHERE (k + n) % 17 = 0
    UNION ALL SELECT o_orderkey, 'warning', 'unexpected_state', 'no_update' FROM orders WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM a WHERE k = o_orderkey AND (k + n) % 3 = 0)
    UNION ALL SELECT k, 'error', 'leakage_risk', 'a' || n::VARCHAR || '.weights_written' FROM a WHERE k % 3 <> 0 AND (k + n) % 3 = 0 AND n % 2 = 1 AND k % 2 = 0 AND k IN (SELECT o_orderkey FROM orders)""",
)
def inspect_steps(spark, sf_dir):
    """Orders as trainer steps, their lines as actors."""
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_id"), F.expr("element_at(array('train', 'dev', 'test'), int(o_orderkey % 3) + 1)").alias("split"), F.expr("map('kl', if(o_orderkey % 29 = 0, double('-inf'), 0.1D), 'loss', 1D)").alias("metrics"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    path = F.concat_ws("/", F.lit("/c"), "k", "n")
    actors = line.select(
        F.col("k").alias("step_id"), F.expr("concat('a', n)").alias("actor_role"), F.expr("if((k + n) % 3 = 0, 'succeeded', 'failed')").alias("status"), F.expr("if(n = 7, null, n % 4 <> 0)").alias("no_leakage_passed"),
        F.when(F.col("n") % 2 == 1, path).alias("written_checkpoint_path"), F.expr("if((k + n) % 13 = 0, double('nan'), 0.3D)").alias("loss"), F.expr("if((k + n) % 17 = 0, double('inf'), 0.3D)").alias("grad_norm"),
    )
    return inspection.inspect_steps(steps, actors, line.select(path.alias("path"), (F.col("k") % 2 == 0).alias("weights_written")))


@query(
    "l7b_inspect_runs",
    """WITH c AS (SELECT c_custkey AS c FROM customer), live AS (SELECT * FROM c WHERE c % 10 <> 0), r AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT c FROM live)),
    agg AS (SELECT * FROM live WHERE c % 5 <> 4), act AS (SELECT * FROM agg WHERE c % 2 = 0 AND c % 8 <> 2)
    SELECT c AS run_id, 'error' AS severity, 'missing_artifact' AS code, 'manifest' AS what FROM c WHERE c % 10 = 0
    UNION ALL SELECT c, 'error', 'missing_artifact', 'records' FROM live WHERE c % 4 = 3
    UNION ALL SELECT c, 'error', 'missing_artifact', 'record.' || k::VARCHAR FROM r WHERE c % 4 <> 3 AND k % 3 = 0
    UNION ALL SELECT c, 'error', 'missing_artifact', 'report.' || k::VARCHAR FROM r WHERE k % 2 = 0 AND k % 5 = 0
    UNION ALL SELECT c, 'error', 'missing_artifact', 'aggregate' FROM live WHERE c % 5 = 4
    UNION ALL SELECT c, 'error', 'missing_artifact', 'replay_buffer' FROM agg WHERE c % 6 = 0
    UNION ALL SELECT c, 'error', 'missing_artifact', 'actor_batches' FROM agg WHERE c % 2 = 0 AND c % 8 = 2
    UNION ALL SELECT c, 'error', 'missing_artifact', 'memory_builder.batch_manifest' FROM act WHERE c % 12 = 0
    UNION ALL SELECT c, 'error', 'missing_artifact', 'question_agent.update_batch' FROM act WHERE c % 14 = 0
    UNION ALL SELECT c, 'error', 'invalid_reward', k::VARCHAR || '.memory_reward_mean' FROM r WHERE k % 13 = 0 OR k % 17 = 0
    UNION ALL SELECT DISTINCT c, 'error', 'leakage_risk', 'records' FROM r WHERE k % 2 = 0 AND k % 11 = 0
    UNION ALL SELECT c, 'error', 'leakage_risk', 'question_agent.batch_manifest' FROM act WHERE c % 9 = 0""",
)
def inspect_runs(spark, sf_dir):
    """Customers as runs, their orders as records."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.concat(F.lit("/u/"), F.col("c_custkey").cast("string")).alias("run_dir"))
    chosen = o.groupBy(F.col("run_id").alias("c")).agg(F.collect_list(F.col("k").cast("string")).alias("selected_record_ids"))
    runs = c.hint("merge").join(chosen.hint("merge"), "c", "left").select(F.col("c").alias("run_id"), "run_dir", F.expr("if(c % 2 = 0, 'train', 'dev')").alias("split"), "selected_record_ids")
    report = F.concat(F.lit("/rep/"), F.col("k").cast("string"))
    records = o.select("run_id", F.col("k").cast("string").alias("record_id"), F.expr("if(k % 2 = 0, 'succeeded', 'failed')").alias("status"), report.alias("final_report_path"), (F.col("k") % 11 != 0).alias("no_leakage_passed"), F.expr("if(k % 13 = 0, 2e6D, if(k % 17 = 0, double('nan'), 1D))").alias("memory_reward_mean"))
    act = "c % 5 <> 4 and c % 8 <> 2"
    there = {
        "multi_case_rollout_manifest.json": "c % 10 <> 0", "records": "c % 4 <> 3", "aggregate": "c % 5 <> 4", "aggregate/replay_buffer.jsonl": "c % 5 <> 4 and c % 6 <> 0", "aggregate/aggregated_replay_manifest.json": "c % 5 <> 4",
        "aggregate/actor_batches": act, "aggregate/actor_batches/memory_builder.update_batch.json": act, "aggregate/actor_batches/memory_builder.batch_manifest.json": f"{act} and c % 12 <> 0",
        "aggregate/actor_batches/question_agent.update_batch.json": f"{act} and c % 14 <> 0", "aggregate/actor_batches/question_agent.batch_manifest.json": act,
    }
    paths = c.select(F.explode(F.array_compact(F.array(*[F.when(F.expr(t), F.concat("run_dir", F.lit(f"/{n}"))) for n, t in there.items()]))).alias("path"))
    folders = o.where("k % 3 <> 0 and run_id % 4 <> 3").select(F.concat(F.lit("/u/"), F.col("run_id").cast("string"), F.lit("/records/"), F.col("k").cast("string")).alias("path"))
    paths = paths.unionByName(folders).unionByName(o.where("k % 5 <> 0").select(report.alias("path")))
    batches = c.select(F.concat("run_dir", F.lit("/aggregate/actor_batches/question_agent.batch_manifest.json")).alias("path"), F.expr("c % 9 <> 0").alias("no_leakage_passed"))
    return inspection.inspect_runs(runs, records, paths, batches, strict=True)


@query(
    "l8_inspect_alignment",
    """WITH c AS (SELECT c_custkey AS c FROM customer), live AS (SELECT * FROM c WHERE c % 10 <> 0), l AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT c FROM live)), r AS (SELECT * FROM l WHERE k % 7 <> 0 AND k % 11 <> 0)
    SELECT c AS rollout_id, NULL AS record_id, 'error' AS severity, 'missing_manifest' AS code, NULL AS what FROM c WHERE c % 10 = 0
    UNION ALL SELECT c, NULL, 'warning', 'missing_summary', NULL FROM live WHERE c % 3 = 0
    UNION ALL SELECT c, NULL, 'error', 'invalid_manifest_line', k::VARCHAR FROM l WHERE k % 7 = 0 OR k % 11 = 0
    UNION ALL SELECT c, 'r' || k::VARCHAR, 'error', 'missing_groups_dir', NULL FROM r WHERE c % 4 = 0
    UNION ALL SELECT c, 'r' || k::VARCHAR, 'warning', 'missing_memory_group', NULL FROM r WHERE c % 4 <> 0 AND k % 2 = 1
    UNION ALL SELECT c, 'r' || k::VARCHAR, 'warning', 'missing_question_group', NULL FROM r WHERE c % 4 <> 0 AND k % 5 = 0
    UNION ALL SELECT c, 'r' || k::VARCHAR, 'error', 'unsafe_actor_batch', 'memory_builder: ' || CASE WHEN k % 2 = 0 THEN '' ELSE 'batch.prompt[0].gold_answer, ' END || 'batch.response.raw_history' FROM r WHERE c % 4 <> 0 AND k % 3 = 0""",
)
def inspect_alignment(spark, sf_dir):
    """Customers as rollouts, their orders as records; forbidden fields stand in arrays and inside strings of JSON."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rollout_id"), F.col("o_orderkey").alias("k"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rollout_id"))
    lines = o.select("rollout_id", F.col("k").alias("line_num"), F.when(F.col("k") % 7 == 0, "no object").when(F.col("k") % 11 == 0, "[1]").otherwise(F.to_json(F.struct("record_id"))).alias("line"))
    there = {"manifest.jsonl": 10, "summary.json": 3, "groups": 4}
    paths = c.select("rollout_id", F.explode(F.array_compact(F.array(*[F.when(F.col("rollout_id") % m != 0, F.lit(n)) for n, m in there.items()]))).alias("path"))
    group = lambda kind: F.concat(F.lit("groups/"), "record_id", F.lit(f".{kind}_group.json"))
    groups = o.select("rollout_id", F.explode(F.array_compact(F.array(F.when(F.col("k") % 2 == 0, group("memory")), F.when(F.col("k") % 5 != 0, group("question"))))).alias("path"))
    gold = F.to_json(F.struct(F.when(F.col("k") % 2 == 1, F.lit("x")).alias("gold_answer")), {"ignoreNullFields": "false"})
    body = F.concat(F.lit('{"prompt": ['), gold, F.lit('], "response": "{\\"raw_history\\": [1]}", "seen": 1}'))
    batches = o.select("rollout_id", "record_id", F.lit("memory_builder").alias("role"), F.when(F.col("k") % 3 == 0, body).otherwise('{"prompt": "raw_history", "reward_report": null}').alias("json"))
    return inspection.inspect_alignment(c, lines, paths.unionByName(groups), batches)


@query(
    "l9_verify_release",
    """WITH c AS (SELECT c_custkey AS c FROM customer), r AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS f FROM orders GROUP BY 1),
    m AS (SELECT c, coalesce(n, 0) AS n, coalesce(f, 0) AS f, coalesce(n, 0) + (c % 7 = 0)::INT AS req, greatest(coalesce(f, 0) - (c % 4 = 0)::INT, 0) AS told FROM c LEFT JOIN r USING (c) WHERE c % 11 <> 0)
    SELECT c AS release_id, 'error' AS severity, 'missing_file' AS code, name AS what FROM c, (SELECT unnest(['README.md', 'reproduce.sh', 'suite_config.resolved.json', 'suite_manifest.json', 'aggregate_metrics.json', 'environment_report.json', 'artifact_manifest.json', 'checksums.sha256']) AS name, unnest(range(8)) AS i) WHERE c % (i + 2) = 0
    UNION ALL SELECT c, 'error', 'suite_id_mismatch', 's' || c::VARCHAR || '/x' FROM m WHERE c % 5 = 0
    UNION ALL SELECT c, 'error', 'seed_count_mismatch', n::VARCHAR || '/' || req::VARCHAR FROM m WHERE n <> req
    UNION ALL SELECT c, 'error', 'failed_count_mismatch', f::VARCHAR || '/' || told::VARCHAR FROM m WHERE f > 0 AND f <> told
    UNION ALL SELECT c, 'warning', 'disabled', 'final_test_eval' FROM c WHERE c % 2 = 1
    UNION ALL SELECT c, 'warning', 'disabled', 'strict_no_leakage' FROM c WHERE c % 3 = 2""",
)
def verify_release(spark, sf_dir):
    """Customers as releases, their orders as runs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("release_id"))
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_custkey").alias("release_id"), F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("succeeded").alias("status"))
    files = c.select("release_id", F.explode(F.array_compact(F.array(*[F.when(F.col("release_id") % (i + 2) != 0, F.lit(n)) for i, n in enumerate(inspection.RELEASE_FILES)]))).alias("name"))
    manifests = c.where("release_id % 11 <> 0").select("release_id", F.expr("concat('s', release_id)").alias("suite_id"))
    n = runs.groupBy("release_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("f"))
    told = c.hint("merge").join(n.hint("merge"), "release_id", "left").na.fill(0)
    metrics = told.select("release_id", F.expr("if(release_id % 5 = 0, 'x', concat('s', release_id))").alias("suite_id"), F.expr("n + int(release_id % 7 = 0)").alias("num_seeds_requested"), F.expr("greatest(f - int(release_id % 4 = 0), 0)").alias("num_seeds_failed"))
    return inspection.verify_release(files, manifests, runs, metrics, c.select("release_id", F.expr("release_id % 2 = 0").alias("final_test_eval"), F.expr("if(release_id % 3 = 0, null, release_id % 3 = 1)").alias("strict_no_leakage")))


_SPLIT = "CASE o_orderkey % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END"


@query(
    "k4_split_fingerprint",
    f"""WITH l AS (SELECT {_SPLIT} AS split, {_SPLIT} || ':r' || o_orderkey::VARCHAR AS line FROM orders),
    a AS (SELECT substr(sha1(line), 1, 5) AS b, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY 1),
    d AS (SELECT substr(b, 1, 2) AS b, sha256(string_agg(b || h, chr(10) ORDER BY b || h)) AS h FROM a GROUP BY 1)
    SELECT (SELECT count(*) FROM l WHERE split = 'train') AS train, (SELECT count(*) FROM l WHERE split = 'dev') AS dev, (SELECT count(*) FROM l WHERE split = 'test') AS test, substr(sha256(string_agg(b || h, chr(10) ORDER BY b || h)), 1, 16) AS fingerprint FROM d""",
)
def split_fingerprint(spark, sf_dir):
    """All orders as records of three splits."""
    return splits.split_fingerprint(_orders_split(spark, sf_dir))


def _orders_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.expr("concat('r', o_orderkey)").alias("record_id"), F.expr(_SPLIT).alias("split"), "o_orderkey", "o_custkey")


@query(
    "k5_validate_split",
    """SELECT 'warning' AS severity, 'missing_oracle_graph' AS code, 'r' || o_orderkey::VARCHAR AS record_id FROM orders, (SELECT unnest([0, 1, 2]) AS t) WHERE o_orderkey % 3 = 0 AND (t = 0 OR o_orderkey % 13 = 0)
    UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'warning' ELSE 'error' END, 'oracle_graph_record_id_mismatch', 'r' || o_orderkey::VARCHAR FROM orders, (SELECT unnest([0, 1, 2]) AS t) WHERE o_orderkey % 3 <> 0 AND (t = 0 OR o_orderkey % 13 = 0) AND (o_orderkey % 2 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0)
    UNION ALL SELECT 'error', 'duplicate_record_id', 'r' || o_orderkey::VARCHAR FROM orders, (SELECT unnest([1, 2]) AS t) WHERE o_orderkey % 13 = 0""",
)
def validate_split(spark, sf_dir):
    """Orders as records, one in thirteen listed three times; graphs are missing, name another record or none, or cannot
    be read."""
    s = _orders_split(spark, sf_dir)
    told = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'other' ELSE record_id END")
    graphs = s.where("o_orderkey % 3 <> 0").select("record_id", told.alias("graph_record_id"), (F.col("o_orderkey") % 2 != 0).alias("readable"))
    again = s.where("o_orderkey % 13 = 0")
    return splits.validate_split(s.unionByName(again).unionByName(again), graphs, missing="warning")


@query(
    "k5_split_records",
    f"""SELECT 'r' || o_orderkey::VARCHAR AS record_id, {_SPLIT} AS split, o_orderkey % 3 <> 0 AS has_oracle_graph, coalesce(trim(c_name) <> '' AND o_orderkey % 4 <> 0, false) AS has_benchmark_question, coalesce(o_orderkey % 2 = 0 AND o_orderkey % 9 <> 0, false) AS has_benchmark_answer
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def split_records(spark, sf_dir):
    """Orders as records whose question is their customer's name."""
    s = _orders_split(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    records = s.hint("merge").join(c.hint("merge"), "o_custkey", "left").select("record_id", F.expr("if(o_orderkey % 4 = 0, ' ', c_name)").alias("question"), F.expr("if(o_orderkey % 2 = 0, if(o_orderkey % 9 = 0, '', 'yes'), null)").alias("answer"))
    return splits.split_records(s.select("record_id", "split"), records, s.where("o_orderkey % 3 <> 0"))


_BOOK = """SELECT o_custkey::VARCHAR AS record_id, 'w' || o_orderkey::VARCHAR AS weakness_id, o_orderpriority AS failure_type, o_orderkey % 4 + 1 AS frequency, o_orderkey % 6 AS last_seen_round, CASE WHEN o_orderstatus = 'F' THEN 'mastered' ELSE 'active' END AS status, o_orderkey AS k FROM orders"""


def _book(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "string(o_custkey) AS record_id", "concat('w', o_orderkey) AS weakness_id", "o_orderpriority AS failure_type", "int(o_orderkey % 4 + 1) AS frequency", "int(o_orderkey % 6) AS last_seen_round",
        "if(o_orderstatus = 'F', 'mastered', 'active') AS status", "o_orderkey AS k",
    )


@query(
    "b4_book_summary",
    f"""WITH b AS ({_BOOK}), t AS (SELECT record_id, failure_type, count(*) AS n FROM b WHERE status = 'active' GROUP BY ALL)
    SELECT record_id, max(last_seen_round)::INT AS updated_round, count(*) FILTER (status = 'active') AS active_count, count(*) FILTER (status = 'mastered') AS mastered_count,
      coalesce((SELECT string_agg(failure_type || '=' || n::VARCHAR, ',' ORDER BY failure_type) FROM t WHERE t.record_id = b.record_id), '') AS top_failure_types FROM b GROUP BY record_id""",
)
def book_summary(spark, sf_dir):
    """Orders as weaknesses of their customer; those of closed orders are mastered."""
    out = weakness.book_summary(_book(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("top_failure_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return out.withColumn("top_failure_types", F.array_join(entries, ","))


@query(
    "b2_b5_book_changes",
    f"""WITH b AS ({_BOOK})
    SELECT record_id, weakness_id, CASE WHEN k % 5 = 0 THEN 'added' WHEN status = 'active' AND k % 3 = 0 THEN 'mastered' ELSE 'updated' END AS change FROM b
    WHERE k % 5 = 0 OR (status = 'active' AND k % 3 = 0) OR k % 7 = 0""",
)
def book_changes(spark, sf_dir):
    """A round later: some entries are new, some seen again, some of the active ones mastered."""
    book = _book(spark, sf_dir)
    later = book.withColumn("frequency", F.col("frequency") + F.when(F.col("k") % 7 == 0, 1).otherwise(0))
    mastered = weakness.mark_mastered(later, book.where("k % 3 = 0").select("weakness_id"), 9)
    return weakness.weakness_delta(book.where("k % 5 <> 0"), mastered)


@query(
    "a11_returns",
    """WITH g AS (SELECT l_orderkey AS batch, list(l_quantity::DOUBLE ORDER BY l_linenumber, l_quantity, l_extendedprice) AS q, list(l_quantity::DOUBLE + l_extendedprice::DOUBLE ORDER BY l_linenumber, l_quantity, l_extendedprice) AS s FROM lineitem GROUP BY 1)
    SELECT o_custkey AS batch, o_orderkey AS row_id, array_to_string(list_transform(list_concat(q, list_resize([]::DOUBLE[], m - len(q), 0.0)), lambda x: round(x, 2)::DECIMAL(18, 2)::VARCHAR), ',') AS advantages,
      array_to_string(list_transform(list_concat(s, list_resize([]::DOUBLE[], m - len(s), 0.0)), lambda x: round(x, 2)::DECIMAL(18, 2)::VARCHAR), ',') AS both_sums FROM (SELECT o_custkey, o_orderkey, q, s, max(len(q)) OVER (PARTITION BY o_custkey) AS m FROM orders JOIN g ON batch = o_orderkey)""",
)
def returns(spark, sf_dir):
    """Orders as samples whose tokens are their lines, padded to the longest order of their customer."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p")))).alias("t"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").hint("merge").join(line.hint("merge"), "o_orderkey")
    rows = rows.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("row_id"), F.transform("t", lambda x: x["q"]).alias("token_advantages"), F.transform("t", lambda x: x["p"]).alias("token_rewards"))
    plain = rollout.with_returns(rows).withColumnRenamed("returns", "advantages").drop("returns_strategy")
    both = rollout.with_returns(plain, "rewards_plus_advantages").withColumnRenamed("returns", "both_sums")
    for c in ("advantages", "both_sums"):
        both = rollout.pad_rows(both, "batch", c, 0.0)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 2).cast("decimal(18,2)").cast("string")), ",").alias(c)
    return both.select("batch", "row_id", text("advantages"), text("both_sums"))


@query(
    "a14_step_metrics",
    """WITH l AS (SELECT l_orderkey AS k, CASE min(l_linenumber) OVER w WHEN l_linenumber THEN 'memory_builder' ELSE 'question_agent' END AS actor_role, l_returnflag AS f, l_quantity::DOUBLE AS loss, CASE WHEN l_suppkey % 3 <> 0 THEN l_discount::DOUBLE END AS kl FROM lineitem WHERE l_orderkey % 4 <> 0 WINDOW w AS (PARTITION BY l_orderkey)),
    r AS (SELECT *, CASE f WHEN 'N' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status FROM l)
    SELECT o_orderkey AS step_id, CASE WHEN count(r.k) = 0 THEN 'pending' WHEN min(status) = max(status) THEN max(status) ELSE 'partial' END AS status, count(r.k) AS num_actors_requested, count(*) FILTER (status = 'succeeded') AS num_actors_succeeded, count(*) FILTER (status = 'failed') AS num_actors_failed, count(*) FILTER (status = 'skipped') AS num_actors_skipped,
      round(avg(loss) FILTER (status = 'succeeded'), 6) AS mean_loss, min(loss) FILTER (status = 'succeeded') AS min_loss, max(loss) FILTER (status = 'succeeded') AS max_loss, round(avg(kl) FILTER (status = 'succeeded'), 6) AS mean_approx_kl, max(loss) FILTER (status = 'succeeded' AND actor_role = 'question_agent') AS question_agent_loss
    FROM orders LEFT JOIN r ON r.k = o_orderkey GROUP BY o_orderkey""",
)
def step_metrics(spark, sf_dir):
    """Orders as trainer steps, their lines as reports of actors; a quarter of the orders has none."""
    from pyspark.sql import Window

    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))
    status = F.expr("CASE l_returnflag WHEN 'N' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'skipped' END")
    reports = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").select(
        F.col("l_orderkey").alias("step_id"), F.when(F.col("l_linenumber") == first, "memory_builder").otherwise("question_agent").alias("actor_role"), status.alias("status"),
        F.col("l_quantity").cast("double").alias("loss"), F.expr("if(l_suppkey % 3 <> 0, double(l_discount), null)").alias("approx_kl"), F.lit(None).cast("double").alias("reward_mean"),
    )
    out = rollout.trainer_step_metrics(reports, "step_id", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_id")))
    keep = ["step_id", "status", *[f"num_actors_{s}" for s in ("requested", "succeeded", "failed", "skipped")], "min_loss", "max_loss", "question_agent_loss"]
    return out.select(*keep, F.round("mean_loss", 6).alias("mean_loss"), F.round("mean_approx_kl", 6).alias("mean_approx_kl"))
