"""Queries over events, customers, orders and documents: scalar functions, rollouts, splits, replay, suites, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit, questions, replay, rollout, splits, suite, walks, weakness
from ..sources import artifacts
from ..sources.durable import durable
from ..streaming import streams
from . import sqlparts as S
from .base import query, table
from .graph_queries import graph_of
from .memory_queries import items_of


@query(
    "p1_p3_p5_text_functions",
    f"""SELECT doc_id, sha1({S.norm('text')}) AS norm_hash, sha1({S.canon('text')}) AS canon, sha1({S.rnorm('text')}) AS reward_hash, {S.sid('doc', 'doc_id', 'lang', 'NULL')} AS stable_id,
    len({S.words(S.norm('text'))})::INT AS n_ws, len({S.words(S.rnorm('text'))})::INT AS n_reward FROM documents""",
)
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha1(C.normalize_text("text").cast("binary")).alias("norm_hash"), F.sha1(C.canonicalize_name("text").cast("binary")).alias("canon"), F.sha1(C.normalize_for_reward("text").cast("binary")).alias("reward_hash"),
        C.stable_id("doc", "doc_id", "lang", F.lit(None)).alias("stable_id"), F.size(C.tokens_ws("text")).alias("n_ws"), F.size(C.tokens_reward("text")).alias("n_reward"),
    )


@query("p2_whole_canonical_names", f"SELECT doc_id, sha1({S.canon('text')}) AS canon_hash FROM documents")
def whole_canonical_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(C.canonicalize_name("text").cast("binary")).alias("canon_hash"))


_PAIRS = f"""WITH t AS (SELECT conv_id, turn, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
n AS (SELECT *, {S.rnorm('p')} AS pn, {S.rnorm('e')} AS en FROM t WHERE e IS NOT NULL)"""


@query(
    "p6_p8_answer_scores",
    f"{_PAIRS} SELECT conv_id, turn, round({S.f1(S.words('pn'), S.words('en'))}, 9) AS f1, round({S.jaccard(S.words('pn'), S.words('en'))}, 9) AS jaccard, round({S.correctness('p', 'e', 'pn', 'en')}, 9) AS correctness FROM n",
)
def answer_scores(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("e", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("e is not null")
    return rows.select("conv_id", "turn", F.round(C.token_f1("text", "e"), 9).alias("f1"), F.round(C.token_jaccard("text", "e"), 9).alias("jaccard"), F.round(C.answer_correctness("text", "e"), 9).alias("correctness"))


@query(
    "p9_p10_p12_numbers",
    "SELECT event_id, greatest(0, least(1, value / 100)) AS clamped, greatest(1, least(5, round_even(value / 20, 0)))::INT AS score, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS finite FROM events",
)
def numbers(spark, sf_dir):
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", C.clamp(F.col("value") / 100).alias("clamped"), C.score_1_5(F.col("value") / 20, 3).alias("score"), C.finite_or_null(odd).alias("finite"))


@query(
    "p4_p13_ids",
    """SELECT o_orderkey, 'weak_' || substr(sha256(o_custkey::VARCHAR || ':' || o_orderkey::VARCHAR || ':missing_fact:' || array_to_string(list_sort([o_orderstatus, o_orderpriority]), '|')), 1, 8) AS weakness_id,
    concat_ws(':', 'builder', o_orderstatus, printf('round%03d', o_orderkey % 100), printf('step%03d', o_custkey % 1000), CASE WHEN o_orderkey % 2 = 0 THEN 'none' ELSE substr(sha256(o_orderpriority), 1, 8) END) AS checkpoint_id FROM orders""",
)
def ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority"))
    return o.select(
        "o_orderkey", C.weakness_id(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("missing_fact"), F.array("o_orderstatus", "o_orderpriority")).alias("weakness_id"),
        C.checkpoint_id(F.lit("builder"), "o_orderstatus", (F.col("o_orderkey") % 100).cast("int"), (F.col("o_custkey") % 1000).cast("int"), source).alias("checkpoint_id"),
    )


def rewards_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("group_id"), F.col("event_id").alias("sample_id"), F.col("value").alias("reward"))


_REWARDS = "r AS (SELECT user_id::VARCHAR || '/' || event_type AS group_id, event_id AS sample_id, value AS reward FROM events)"


@query(
    "a4_a5_advantages",
    f"""WITH {_REWARDS}, g AS (SELECT *, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS s, count(*) OVER w AS n, row_number() OVER (PARTITION BY group_id ORDER BY reward DESC, sample_id)::INT AS rank_in_group FROM r WINDOW w AS (PARTITION BY group_id))
    SELECT group_id, sample_id, round(CASE WHEN n < 2 OR s <= 1e-6 THEN 0.0 ELSE (reward - m) / s END, 8) AS advantage, NOT (n < 2 OR s <= 1e-6) AS selected_for_update, rank_in_group FROM g""",
)
def advantages(spark, sf_dir):
    return rollout.advantages(rewards_of(spark, sf_dir)).select("group_id", "sample_id", F.round("advantage", 8).alias("advantage"), "selected_for_update", "rank_in_group")


@query(
    "a6_a7_group_summary",
    f"WITH {_REWARDS} SELECT group_id, count(reward) AS n, round(avg(reward), 9) AS mean, round(stddev_pop(reward), 9) AS std, min(reward) AS min, max(reward) AS max, CASE WHEN count(reward) < 2 THEN 'too_few' WHEN stddev_pop(reward) <= 1e-6 THEN 'zero_variance' ELSE 'ok' END AS status FROM r GROUP BY group_id",
)
def group_summary(spark, sf_dir):
    return rollout.group_summary(rewards_of(spark, sf_dir)).select("group_id", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "min", "max", "status")


@query(
    "a1_a3_marginal_rewards",
    """WITH m AS (SELECT user_id AS u, event_id AS s, value AS v FROM events WHERE event_type = 'click'), q AS (SELECT user_id AS u, event_id AS s, value AS v FROM events WHERE event_type = 'view'),
    c AS (SELECT m.u::VARCHAR AS record_id, m.s AS ms, q.s AS qs, (m.v + q.v) / 1000 AS mr, 1 - (m.v + q.v) / 1000 AS qr FROM m JOIN q ON m.u = q.u)
    SELECT record_id, 'memory_builder' AS role, ms AS sample_id, round(avg(mr), 9) AS reward FROM c GROUP BY ALL UNION ALL SELECT record_id, 'question_agent', qs, round(avg(qr), 9) FROM c GROUP BY ALL""",
)
def marginals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    record = F.col("user_id").cast("string").alias("record_id")
    m = e.where("event_type = 'click'").select(record, F.col("event_id").alias("memory_sample_id"), F.col("value").alias("mv"))
    q = e.where("event_type = 'view'").select(record, F.col("event_id").alias("question_sample_id"), F.col("value").alias("qv"), F.lit(1).alias("accepted_question_count"))
    cells = rollout.pair_cells(m, q).join(m.select("memory_sample_id", "mv"), "memory_sample_id").join(q.select("question_sample_id", "qv"), "question_sample_id")
    total = (F.col("mv") + F.col("qv")) / 1000
    cells = cells.withColumns({"status": F.lit("ok"), "memory_reward": total, "question_reward": 1 - total})
    return rollout.marginal_rewards(cells).select("record_id", "role", "sample_id", F.round("reward", 9).alias("reward"))


_IDS = "list_concat([1], list_concat([ascii(x) % 256 FOR x IN string_split(role, '')], [ascii(x) % 256 FOR x IN string_split(text, '')]))"


@query(
    "a10_token_rows",
    f"""SELECT conv_id, turn, length(role) + 1 + length(text) AS n, sha1(array_to_string({_IDS}, ',')) AS ids_hash, (length(text))::BIGINT AS n_loss,
    sha1(array_to_string(range(length(role) + 1 + length(text)), ',')) AS positions_hash, round(length(text) * (1.0 / length(text)), 9) AS reward_sum FROM conversations WHERE trim(text) <> ''""",
)
def token_rows(spark, sf_dir):
    """Whole prompts and responses: hashes of ids and positions, tokens under the mask, and what rewards sum up to."""
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("prompt"), F.col("text").alias("response"), F.lit(1.0).alias("reward"), F.lit(0.5).alias("advantage"))
    out = rollout.token_rows(items)
    total = lambda c, zero: F.aggregate(c, F.lit(zero).cast("double"), lambda a, x: a + x)
    hashed = lambda c: F.sha1(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"))
    return out.select(
        "conv_id", "turn", F.size("input_ids").cast("bigint").alias("n"), hashed("input_ids").alias("ids_hash"), total("loss_mask", 0).cast("bigint").alias("n_loss"),
        hashed("position_ids").alias("positions_hash"), F.round(total("token_rewards", 0), 9).alias("reward_sum"),
    )


@query(
    "a10_whole_token_rows",
    """SELECT conv_id, turn, length(role) + 1 + length(text) AS n, (1 + list_sum([ascii(x) % 256 FOR x IN string_split(role, '')]) + list_sum([ascii(x) % 256 FOR x IN string_split(text, '')]))::BIGINT AS id_sum FROM conversations WHERE trim(text) <> ''""",
)
def whole_token_rows(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("prompt"), F.col("text").alias("response"), F.lit(1.0).alias("reward"), F.lit(0.5).alias("advantage"))
    out = rollout.token_rows(items)
    return out.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("n"), F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


_HASH = "sha256('42:' || record_id)"


@query(
    "k1_random_split",
    f"""WITH c AS (SELECT 'c' || c_custkey::VARCHAR AS record_id FROM customer), o AS (SELECT record_id, row_number() OVER (ORDER BY {_HASH}, record_id) - 1 AS p, count(*) OVER () AS n FROM c)
    SELECT record_id, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM o""",
)
def random_split(spark, sf_dir):
    return splits.random_split(_records(spark, sf_dir))


def _records(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"))


@query(
    "k7_round_records",
    f"""WITH c AS (SELECT 'c' || c_custkey::VARCHAR AS record_id FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT record_id, row_number() OVER (ORDER BY {_HASH}, record_id) - 1 AS p, count(*) OVER () AS n FROM c)
    SELECT record_id, (p - 120 + 4 * n) % n AS place FROM o WHERE (p - 120 + 4 * n) % n < 40""",
)
def round_records(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), F.lit("train").alias("split"))
    return splits.round_records(rows, "train", 3, 40)


@query(
    "k2_explicit_split",
    """WITH l AS (SELECT c_custkey AS record_id, 'train' AS split, 1 AS p FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'dev', 2 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'test', 3 FROM customer WHERE c_custkey % 7 = 0)
    SELECT record_id, arg_max(split, p) AS split FROM l GROUP BY record_id""",
)
def explicit_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"))
    each = F.explode(F.array_compact(F.array(*[F.when(F.col("record_id") % m == 0, F.lit(s)) for s, m in (("train", 3), ("dev", 5), ("test", 7))])))
    return splits.explicit_split(c, c.select("record_id", each.alias("split")))[0]


@query(
    "k8_carry_forward",
    """WITH r AS (SELECT o_custkey AS actor, o_orderkey AS round_id, CASE WHEN o_orderstatus = 'F' THEN 'ckpt' || o_orderkey::VARCHAR END AS selected FROM orders)
    SELECT actor, round_id, coalesce(last_value(selected IGNORE NULLS) OVER (PARTITION BY actor ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'initial') AS input_checkpoint FROM r""",
)
def carry(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("actor"), F.col("o_orderkey").alias("round_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ckpt"), F.col("o_orderkey").cast("string"))).alias("selected"))
    return splits.carry_forward(rows).select("actor", "round_id", "input_checkpoint")


def _replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("record_id"), F.hour("ts").alias("round_id"), F.lit(None).cast("int").alias("step_id"), F.col("event_type").alias("memory_builder_checkpoint_id"), F.lit("").alias("question_agent_checkpoint_id"),
        F.when(F.col("event_id") % 11 != 0, F.col("value") / 100).alias("memory_reward"), (F.col("event_id") % 5 != 0).alias("no_leakage_passed"), F.col("event_id").alias("ingest_ord"), "ts",
    )


_REPLAY = """rp AS (SELECT 'r' || user_id::VARCHAR AS record_id, hour(ts) AS round_id, event_type AS mc, CASE WHEN event_id % 11 <> 0 THEN value / 100 END AS memory_reward, event_id % 5 <> 0 AS safe, event_id AS ingest_ord,
  concat_ws(':', 'r' || user_id::VARCHAR, hour(ts)::VARCHAR, 'none', event_type, 'none') AS replay_key FROM events)"""


@query("x2_x4_dedup_replay", f"WITH {_REPLAY} SELECT replay_key, min(ingest_ord) AS ingest_ord FROM rp GROUP BY ALL")
def dedup_replay(spark, sf_dir):
    return replay.dedup_replay(replay.replay_items(_replay(spark, sf_dir)))[0].select("replay_key", "ingest_ord")


@query(
    "x1_x7_check_replay",
    f"WITH {_REPLAY} SELECT record_id, count(*) AS rows, count(memory_reward) AS selected, count(memory_reward) FILTER (safe) AS selected_safe, count(*) FILTER (memory_reward < 0.5) AS low_memory_reward, 0::BIGINT AS weakness_updated, count(*) FILTER (memory_reward IS NULL) AS missing_memory_reward FROM rp GROUP BY ALL",
)
def check_replay(spark, sf_dir):
    return replay.check_replay(replay.replay_items(_replay(spark, sf_dir)))


@query(
    "x3_x6_replay_manifest",
    f"""WITH {_REPLAY}, ok AS (SELECT DISTINCT record_id FROM rp WHERE memory_reward > 1), t AS (SELECT * FROM rp WHERE safe AND memory_reward IS NOT NULL AND record_id IN (SELECT record_id FROM ok))
    SELECT count(*) AS rows, count(*) AS safe, count(*) AS selected, count(DISTINCT replay_key) AS kept, count(*) - count(DISTINCT replay_key) AS duplicates_removed FROM t""",
)
def manifest(spark, sf_dir):
    items = replay.replay_items(_replay(spark, sf_dir))
    train = replay.filter_replay(items, "train", items.where("memory_reward > 1"))
    return replay.replay_manifest(train, replay.dedup_replay(train)[0])


def _long(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wide = e.groupBy((F.col("user_id") % 5).alias("seed"), F.lit("succeeded").alias("status")).agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(n) for k, n in (("click", "score"), ("view", "baseline_score"), ("error", "ablation_score"))])
    return suite.seed_metrics_long(wide, ["score", "baseline_score", "ablation_score"])


_LONG = """lg AS (SELECT user_id % 5 AS seed, CASE event_type WHEN 'click' THEN 'final' WHEN 'view' THEN 'baseline' ELSE 'ablation' END AS method, 'score' AS metric, avg(value) AS value FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL)"""


@query(
    "z3_z4_suite_stats",
    f"WITH {_LONG} SELECT method, metric, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(stddev_samp(value) / sqrt(count(*)), 9) AS stderr, round(median(value), 9) AS median FROM lg GROUP BY ALL",
)
def suite_stats(spark, sf_dir):
    return suite.suite_stats(_long(spark, sf_dir)).select("method", "metric", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "stderr", "median")])


_DELTAS = f"{_LONG}, dl AS (SELECT a.seed, a.metric, b.method AS baseline, a.value - b.value AS delta FROM lg a JOIN lg b ON a.seed = b.seed AND a.metric = b.metric AND a.method = 'final' AND b.method <> 'final')"


@query("z5_z7_paired_t", f"WITH {_DELTAS} SELECT metric, baseline, count(*) AS n, round(avg(delta), 9) AS mean_delta, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 8) AS t FROM dl GROUP BY ALL")
def paired_t(spark, sf_dir):
    return suite.t_statistic(suite.paired_deltas(_long(spark, sf_dir), "final")).select("metric", "baseline", "n", F.round("mean_delta", 9).alias("mean_delta"), F.round("t", 8).alias("t"))


@query(
    "z7_p_values",
    f"""WITH {_DELTAS}, s AS (SELECT metric, baseline, count(*) AS n, abs(avg(delta) / (stddev_samp(delta) / sqrt(count(*)))) AS t FROM dl GROUP BY ALL HAVING count(*) > 1 AND stddev_samp(delta) > 0),
    g AS (SELECT s.*, i, (n - 1)::DOUBLE AS df, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM s, range(0, 4001) r(i))
    SELECT metric, baseline, n, round(1 - 2 * sum(w * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2) * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())) * max(t) / 4000 / 3, 6) AS p_value FROM g GROUP BY ALL""",
)
def p_values(spark, sf_dir):
    """Two-sided p-values of paired deltas; the SQL integrates the density by Simpson's rule."""
    return suite.t_statistic(suite.paired_deltas(_long(spark, sf_dir), "final")).where("p_value is not null").select("metric", "baseline", "n", F.round("p_value", 6).alias("p_value"))


@query(
    "z6_bootstrap",
    f"""WITH {_DELTAS}, p AS (SELECT *, row_number() OVER (PARTITION BY metric, baseline ORDER BY seed) - 1 AS pos, count(*) OVER (PARTITION BY metric, baseline) AS n FROM dl),
    d AS (SELECT metric, baseline, rep, least(floor({S.unit("'42'", 'metric', 'baseline', 'rep', 'pos')} * n), n - 1)::BIGINT AS at FROM p, range(1, 1001) t(rep)),
    m AS (SELECT d.metric, d.baseline, d.rep, avg(p.delta) AS m FROM d JOIN p ON p.metric = d.metric AND p.baseline = d.baseline AND p.pos = d.at GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric, baseline ORDER BY m, rep) - 1 AS rn FROM m)
    SELECT metric, baseline, round(max(m) FILTER (rn = 25), 8) AS low, round(max(m) FILTER (rn = 974), 8) AS high FROM r GROUP BY ALL""",
)
def bootstrap(spark, sf_dir):
    return suite.bootstrap_ci(suite.paired_deltas(_long(spark, sf_dir), "final")).select("metric", "baseline", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query("z1_run_metrics", "SELECT event_type AS split, count(*) AS runs, count(*) FILTER (value >= 10) AS succeeded, count(*) FILTER (value < 10) AS failed, round(avg((value < 200)::INT), 9) AS pass_rate, round(avg(value) FILTER (value >= 10), 9) AS reward_mean, min(value) FILTER (value >= 10) AS reward_min, max(value) FILTER (value >= 10) AS reward_max FROM events GROUP BY ALL")
def run_metrics(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), F.when(F.col("value") >= 10, "succeeded").otherwise("failed").alias("status"), (F.col("value") < 200).alias("passed"), F.col("value").alias("reward"))
    return suite.run_metrics(runs).withColumn("pass_rate", F.round("pass_rate", 9)).withColumn("reward_mean", F.round("reward_mean", 9))


@query(
    "z8_early_stop",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, rn, value AS best, event_id AS best_round, 0::BIGINT AS since FROM o WHERE rn = 1 UNION ALL
      SELECT o.user_id, o.rn, CASE WHEN o.value > f.best + 5 THEN o.value ELSE f.best END, CASE WHEN o.value > f.best + 5 THEN o.event_id ELSE f.best_round END, CASE WHEN o.value > f.best + 5 THEN 0 ELSE f.since + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id, best, best_round, since, since >= 10 AS stop FROM f QUALIFY rn = max(rn) OVER (PARTITION BY user_id)""",
)
def early_stop(spark, sf_dir):
    return suite.early_stop(table(spark, sf_dir, "events").withColumnRenamed("event_id", "round_id"), "user_id", "value", 10, 5.0)


_STATUS = "CASE WHEN event_id % 41 = 0 THEN 'running' WHEN user_id % 4 = 0 THEN 'pending' WHEN user_id % 4 = 1 THEN 'failed' WHEN user_id % 4 = 2 THEN 'succeeded' WHEN value < 60 THEN 'failed' ELSE 'succeeded' END"


@query(
    "z2_rollup_status",
    f"""WITH r AS (SELECT user_id, {_STATUS} AS status FROM events)
    SELECT user_id, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_and(status = 'failed') THEN 'failed'
      WHEN bool_and(status = 'pending') THEN 'pending' ELSE 'partial' END AS status FROM r GROUP BY user_id""",
)
def rollup_status(spark, sf_dir):
    return suite.rollup_status(table(spark, sf_dir, "events").select("user_id", F.expr(_STATUS).alias("status")), "user_id")


@query(
    "z10_select_checkpoints",
    """WITH s AS (SELECT o_orderkey AS round_id, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'succeeded' END AS status, o_totalprice / 1e6 AS train FROM orders),
    d AS (SELECT l_orderkey AS round_id, count(*) - 1 AS records, CASE WHEN l_orderkey % 13 = 0 THEN 'failed' WHEN l_orderkey % 5 = 0 THEN 'partial' ELSE 'succeeded' END AS dev_status,
      avg(l_quantity) / 25 AS pass_rate, sum(l_extendedprice) / 1e6 AS dev FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey),
    r AS (SELECT s.round_id, CASE WHEN status <> 'succeeded' THEN 'no_successful_checkpoint' WHEN dev_status IS NULL THEN 'latest_successful_no_dev' WHEN dev_status = 'failed' THEN 'dev_status'
      WHEN records = 0 THEN 'latest_successful_empty_dev' WHEN pass_rate < 0.8 THEN 'low_pass_rate' WHEN train - dev > 0.02 THEN 'regression' ELSE 'latest_successful_with_dev_gate' END AS reason FROM s LEFT JOIN d USING (round_id))
    SELECT round_id, reason, starts_with(reason, 'latest_successful') AS selected FROM r""",
)
def select_checkpoints(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("round_id"), F.lit("memory_builder").alias("actor"), F.when(F.col("o_orderkey") % 9 == 0, "failed").otherwise("succeeded").alias("status"), F.concat(F.lit("c"), "o_orderkey").alias("checkpoint_id"), (F.col("o_totalprice") / 1e6).alias("train_reward"))
    status = F.when(F.col("l_orderkey") % 13 == 0, "failed").when(F.col("l_orderkey") % 5 == 0, "partial").otherwise("succeeded")
    dev = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").groupBy("l_orderkey").agg((F.count(F.lit(1)) - 1).alias("records"), (F.avg("l_quantity") / 25).alias("pass_rate"), (F.sum("l_extendedprice") / 1e6).alias("dev_reward"))
    return suite.select_checkpoints(steps, dev.select(F.col("l_orderkey").alias("round_id"), status.alias("dev_status"), "records", "pass_rate", "dev_reward")).select("round_id", "reason", "selected")


_JUDGED = """t AS (SELECT lang AS record_id, source AS tid, list(DISTINCT (doc_id % 3)::VARCHAR) AS s FROM documents WHERE source IS NOT NULL AND doc_id % 7 <> 0 GROUP BY ALL),
q AS (SELECT lang AS record_id, doc_id AS question_id, CASE WHEN doc_id % 5 = 0 THEN 'What information ' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN '?' ELSE '' END AS question,
  CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN 'x' ELSE 'an answer' END AS answer, source AS tid, doc_id % 11 = 0 AS extra, doc_id % 6 <> 0 AS noded FROM documents),
f AS (SELECT q.record_id, question_id, regexp_replace(question, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g') AS q, coalesce(length(regexp_replace(answer, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')), 0) AS a,
  q.tid IS NOT NULL OR extra AS traced, (q.tid IS NULL OR extra OR t.s IS NULL) AS lost, coalesce(len(t.s), 0) >= 2 AS many, noded, contains(lower(question), 'what information') OR contains(lower(question), 'what is mentioned') OR contains(lower(question), 'this graph trajectory') OR contains(lower(question), 'what does the trajectory') AS generic
  FROM q LEFT JOIN t ON t.record_id = q.record_id AND t.tid = q.tid),
g AS (SELECT *, (CASE WHEN traced AND a > 0 THEN 4 ELSE 2 END + CASE WHEN noded AND NOT lost THEN 4 ELSE 2 END + CASE WHEN generic THEN 4 ELSE 8 END + CASE WHEN many THEN 8 ELSE 4 END
  + CASE WHEN ends_with(q, '?') AND len(string_split_regex(q, '[ \\t\\n\\x0b\\f\\r]+')) >= 5 THEN 4 ELSE 3 END) AS total FROM f),
j AS (SELECT record_id, question_id, (CASE WHEN generic THEN least(2, round(total / 7.0)) ELSE round(total / 7.0) END)::INT AS overall,
  concat_ws('|', CASE WHEN lost THEN 'cited_trajectories_missing' END, CASE WHEN NOT noded THEN 'cited_nodes_missing' END, CASE WHEN generic THEN 'generic_template' END, CASE WHEN a > 220 THEN 'answer_too_long' END,
  CASE WHEN a < 2 THEN 'answer_too_short' END, CASE WHEN NOT many THEN 'weak_multi_session_use' END) AS issues FROM g)"""


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.where("source is not null and doc_id % 7 <> 0").groupBy(F.col("lang").alias("record_id"), F.col("source").alias("trajectory_id")).agg(F.collect_set((F.col("doc_id") % 3).cast("string")).alias("session_ids"))
    asked = docs.select(
        F.col("lang").alias("record_id"),
        F.col("doc_id").alias("question_id"),
        F.concat(F.when(F.col("doc_id") % 5 == 0, "What information ").otherwise(""), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "?").otherwise("")).alias("question"),
        F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, "x").otherwise("an answer").alias("answer"),
        F.array("source", F.when(F.col("doc_id") % 11 == 0, "nowhere")).alias("supporting_trajectory_ids"),
        F.when(F.col("doc_id") % 6 != 0, F.array(F.lit("n"))).alias("supporting_node_ids"),
    )
    return questions.judge_questions(asked, known), asked


@query("q7_judge_questions", f"WITH {_JUDGED} SELECT record_id, question_id, overall, CASE WHEN overall >= 4 THEN 'accept' WHEN overall = 3 THEN 'revise' ELSE 'reject' END AS verdict, issues FROM j")
def judge_questions(spark, sf_dir):
    return _judged(spark, sf_dir)[0].select("record_id", "question_id", "overall", "verdict", F.array_join("issues", "|").alias("issues"))


@query(
    "q8_q9_judgment_summary",
    f"""WITH {_JUDGED}, k AS (SELECT record_id, question_id, CASE WHEN question_id % 10 = 3 THEN 1 ELSE overall END AS overall,
      CASE WHEN question_id % 10 = 3 THEN 'reject' WHEN overall >= 4 THEN 'accept' WHEN overall = 3 THEN 'revise' ELSE 'reject' END AS verdict FROM j)
    SELECT record_id, count(*) AS questions, round(avg(overall), 3) AS mean_overall, count(*) FILTER (verdict = 'accept') AS accepted, count(*) FILTER (verdict = 'revise') AS revise, count(*) FILTER (verdict = 'reject') AS rejected FROM k GROUP BY record_id""",
)
def judgment_summary(spark, sf_dir):
    """A tenth of the judgments is lost, the others come with scores out of range and unknown verdicts."""
    judged, asked = _judged(spark, sf_dir)
    shaken = judged.where("question_id % 10 <> 3").withColumn("verdict", F.lit(" unsure ")).withColumn("clarity", F.col("clarity") * 9.5)
    out = questions.judgment_summary(questions.normalize_judgments(shaken, asked))
    return out.select("record_id", "questions", "mean_overall", "accepted", "revise", "rejected")


@query("s14_parse_reply", "SELECT doc_id, doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE sha1(coalesce(text, '')) END AS text_hash FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 4 = 3")
def parse_reply(spark, sf_dir):
    """Whole texts inside JSON, plain, fenced, inside prose, and replies that hold none."""
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    reply = F.when(F.col("doc_id") % 4 == 0, body).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Sure: "), body, F.lit(" as asked."))).otherwise("no object here")
    parsed = table(spark, sf_dir, "documents").select("doc_id", artifacts.parse_reply(reply).alias("v"))
    return parsed.select("doc_id", F.try_variant_get("v", "$.id", "bigint").alias("id"), F.sha1(F.try_variant_get("v", "$.text", "string").cast("binary")).alias("text_hash"))


@query("l1_find_keys", "SELECT event_id AS row_id, 'k' AS path, 'k' AS key FROM events")
def find_keys(spark, sf_dir):
    return audit.find_keys(table(spark, sf_dir, "events"), "event_id", "props", ["k", "answer"])


@query(
    "l10_latest_checkpoints",
    "SELECT o_custkey AS actor_role, o_orderkey AS checkpoint_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("actor_role"), F.col("o_orderkey").alias("checkpoint_id"), F.col("o_orderdate").alias("round_id"), F.lit(0).alias("step_id"), F.lit(True).alias("updated"))
    return audit.latest_checkpoints(o).select("actor_role", "checkpoint_id")


@query("t5_window_activity", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def activity(spark, sf_dir):
    """The batch form of the windowed stream; the stream gives the same rows."""
    return streams.stream_activity(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query(
    "t5_session_activity",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
)
def sessions(spark, sf_dir):
    return streams.session_activity(table(spark, sf_dir, "events"))


def walks_of(spark, sf_dir):
    from ..operators.access import infer_sessions

    n, e = graph_of(spark, sf_dir)
    n, e = durable(n), durable(e.drop("edge_key", "confidence"))
    s = durable(infer_sessions(n, e, mode="walk"))
    return n, s, walks.accepted_walks(n, e, s, num_walks=8, length=5, max_next=1)


_WEIGHT = f"(CASE next_type {' '.join(f"WHEN '{k}' THEN {w}" for k, w in walks.NODE_WEIGHTS.items())} ELSE 1.0 END)::DOUBLE * (CASE edge_type {' '.join(f"WHEN '{k}' THEN {w}" for k, w in walks.EDGE_FACTORS.items())} ELSE 1.0 END)::DOUBLE"
_STEPS = ", ".join(
    f"""w{k} AS MATERIALIZED (SELECT w.record_id, attempt, a.next_id AS node_id, w.node_id AS prev_id, CASE WHEN edge_type = 'NEXT' THEN run + 1 ELSE 0 END AS run FROM w{k - 1} w JOIN adj a ON a.record_id = w.record_id AND a.node_id = w.node_id
    WHERE (prev_id IS NULL OR next_id <> prev_id) AND (edge_type <> 'NEXT' OR run < 1) QUALIFY row_number() OVER (PARTITION BY w.record_id, attempt ORDER BY -ln({S.unit("42", "w.record_id", "attempt", str(k), "edge_ord", "traversal")}) / weight, edge_ord, traversal) = 1)"""
    for k in range(1, 5)
)
#: All 240 attempts of every record, step by step, and the first 8 good and different walks.
_WALKS = f"""WITH RECURSIVE {S.GRAPH}, wflow AS (SELECT DISTINCT record_id, source, target FROM edges WHERE edge_type IN ('EXTRACTED_AS', 'SUPPORTS', 'MENTIONS', 'FACT_SUBJECT', 'FACT_OBJECT')
    UNION SELECT record_id, source_event_id, node_id FROM nodes WHERE node_type = 'fact'),
  reach AS (SELECT record_id, node_id, session_id FROM nodes WHERE node_type IN ('session', 'event') UNION SELECT f.record_id, f.target, r.session_id FROM reach r JOIN wflow f ON f.record_id = r.record_id AND f.source = r.node_id),
  hubs AS (SELECT record_id, node_id FROM nodes WHERE node_type = 'entity' AND lower({S.norm("name")}) IN ('user', 'assistant', 'speaker', 'unknown')),
  known AS (SELECT e.record_id, e.source, e.target, e.edge_type, e.edge_ord, a.node_type AS source_type, b.node_type AS target_type FROM edges e JOIN nodes a ON a.record_id = e.record_id AND a.node_id = e.source JOIN nodes b ON b.record_id = e.record_id AND b.node_id = e.target
    WHERE NOT (edge_type IN ('FACT_SUBJECT', 'FACT_OBJECT', 'MENTIONS') AND EXISTS (SELECT 1 FROM hubs h WHERE h.record_id = e.record_id AND (h.node_id = e.source OR h.node_id = e.target)))),
  adj AS MATERIALIZED (SELECT *, {_WEIGHT} AS weight FROM (SELECT record_id, source AS node_id, target AS next_id, target_type AS next_type, edge_type, 'out' AS traversal, edge_ord FROM known
    UNION ALL SELECT record_id, target, source, source_type, edge_type, 'in', edge_ord FROM known)),
  linked AS (SELECT record_id, node_id, (node_type IN ('fact', 'abstract_memory'))::INT AS good FROM nodes WHERE (record_id, node_id) IN (SELECT (record_id, node_id) FROM adj)),
  starts AS MATERIALIZED (SELECT record_id, node_id, row_number() OVER (PARTITION BY record_id ORDER BY node_id) - 1 AS pos, count(*) OVER (PARTITION BY record_id) AS n FROM (SELECT *, max(good) OVER (PARTITION BY record_id) AS best FROM linked) WHERE good = best),
  tries AS (SELECT record_id, attempt, least(floor({S.unit("42", "record_id", "attempt")} * n), n - 1)::BIGINT AS pos FROM (SELECT DISTINCT record_id, n FROM starts), (SELECT unnest(range(1, 241)) AS attempt)),
  w0 AS MATERIALIZED (SELECT record_id, attempt, node_id, NULL::VARCHAR AS prev_id, 0 AS run FROM tries JOIN starts USING (record_id, pos)), {_STEPS},
  steps AS MATERIALIZED ({" UNION ALL ".join(f"SELECT record_id, attempt, {k} AS step, node_id FROM w{k}" for k in range(5))}),
  good AS (SELECT record_id, attempt, string_agg(node_id, '|' ORDER BY step) AS node_ids, count(*)::INT AS n_nodes FROM steps JOIN nodes USING (record_id, node_id) GROUP BY ALL
    HAVING count(*) >= 2 AND bool_or(node_type IN ('fact', 'abstract_memory')) AND count(*) FILTER (node_type IN ('topic', 'session')) / count(*) <= 0.35),
  fresh AS (SELECT record_id, node_ids, n_nodes, min(attempt) AS attempt FROM good GROUP BY ALL),
  walks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY attempt) AS rn FROM fresh QUALIFY rn <= 8),
  touched AS (SELECT record_id, attempt, string_agg(DISTINCT session_id, '|' ORDER BY session_id) AS session_ids FROM steps JOIN reach USING (record_id, node_id) GROUP BY ALL)"""


@query(
    "w11_w12_walks",
    f"{_WALKS} SELECT record_id, 'traj_' || lpad(rn::VARCHAR, 4, '0') AS trajectory_id, node_ids, coalesce(session_ids, '') AS session_ids, n_nodes FROM walks LEFT JOIN touched USING (record_id, attempt)",
)
def accepted_walks(spark, sf_dir):
    _, _, accepted = walks_of(spark, sf_dir)
    return accepted.select("record_id", "trajectory_id", F.array_join("node_ids", "|").alias("node_ids"), F.array_join("session_ids", "|").alias("session_ids"), "n_nodes")


_CANDIDATES = f"""{_WALKS},
  ranked_nodes AS (SELECT w.record_id, w.rn, n.node_id, {S.norm('coalesce(f.fact_text, b.summary)')} AS label, row_number() OVER (PARTITION BY w.record_id, w.rn ORDER BY n.node_type = 'fact' DESC, s.step) AS place
    FROM walks w JOIN steps s ON s.record_id = w.record_id AND s.attempt = w.attempt JOIN nodes n ON n.record_id = s.record_id AND n.node_id = s.node_id
    LEFT JOIN facts f ON f.record_id = s.record_id AND f.fact_id = s.node_id LEFT JOIN abstracts b ON b.record_id = s.record_id AND b.node_id = s.node_id WHERE w.rn <= 5 AND n.node_type IN ('fact', 'abstract_memory')),
  candidates AS (SELECT * FROM ranked_nodes WHERE place = 1)"""


@query(
    "q1_q2_placeholder_questions",
    f"""{_CANDIDATES} SELECT record_id, {S.sid('question', 'record_id', "'no_llm_' || (rn - 1)::VARCHAR")} AS question_id, sha1(label) AS answer_hash, 'traj_' || lpad(rn::VARCHAR, 4, '0') AS trajectory_id, node_id,
      coalesce((SELECT string_agg(DISTINCT session_id, '|' ORDER BY session_id) FROM reach r WHERE r.record_id = c.record_id AND r.node_id = c.node_id), '') AS session_ids FROM candidates c""",
)
def placeholder_questions(spark, sf_dir):
    """The first five walks of each record as questions over their best evidence."""
    n, s, accepted = walks_of(spark, sf_dir)
    q = questions.placeholder_questions(accepted, walks.node_labels(n), s)
    only = lambda c: F.col(c)[0]
    return q.select("record_id", "question_id", F.sha1(F.col("answer").cast("binary")).alias("answer_hash"), only("supporting_trajectory_ids").alias("trajectory_id"), only("supporting_node_ids").alias("node_id"), F.array_join("supporting_session_ids", "|").alias("session_ids"))


@query("q2_q6_question_gate", f"{_CANDIDATES} SELECT record_id, 'accepted' AS status, count(*) AS n FROM candidates WHERE label <> '' GROUP BY record_id")
def question_gate(spark, sf_dir):
    n, s, accepted = walks_of(spark, sf_dir)
    accepted = durable(accepted)
    labels = durable(walks.node_labels(n).select("record_id", "node_id", "node_type", "label"))
    q = durable(questions.placeholder_questions(accepted, labels, s))
    gate = questions.oracle_validity(q, accepted, labels, s, allow_placeholder=True, min_sessions=0)
    return questions.apply_verdicts(q, gate).groupBy("record_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("b1_b4_weakness_book")
def weakness_book(spark, sf_dir):
    items = items_of(spark, sf_dir).withColumnsRenamed({"supporting_node_ids": "supporting_oracle_node_ids", "supporting_session_ids": "related_session_ids", "event_ord": "item_ord"})
    book = weakness.update_weaknesses(spark.createDataFrame([], weakness.BOOK), items, 1)
    return weakness.weakness_summary(book)
