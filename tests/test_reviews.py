"""Gates and reviews on small fixtures; replay and windows as streams that are stopped and started again."""

import json

from pyspark.sql import functions as F

from memengine.operators import audit, memory, questions, rewards, rollout, suite, weakness
from memengine.streaming import streams


def test_leaking_questions_are_rejected(spark):
    labels = spark.createDataFrame([("r", "f1", "fact", "User has a Business degree")], "record_id string, node_id string, node_type string, label string")
    walks = spark.createDataFrame([("r", "t1", ["f1"])], "record_id string, trajectory_id string, node_ids array<string>")
    sessions = spark.createDataFrame([("r", "f1", "s")], "record_id string, node_id string, session_id string")
    metas = ['{"a": [{"gold_answer": "x"}]}', '{"note": "gold_answer"}', None, "no json gold_answer", '{"reward": null}']
    q = spark.createDataFrame([("r", f"q{i}", "What degree?", "Business degree", "", "llm", ["t1"], ["f1"], m) for i, m in enumerate(metas)], "record_id string, question_id string, question string, answer string, reason string, mode string, supporting_trajectory_ids array<string>, supporting_node_ids array<string>, metadata string")
    leaks = questions.artifact_leaks(q)
    assert sorted(map(tuple, leaks.collect())) == [("r", "q0", "a[0].gold_answer", "gold_answer"), ("r", "q4", "reward", "reward")]
    got = {r.question_id: (r.verdict, r.leakage_risk, r.issues, r.grounding) for r in questions.oracle_validity(q, walks, labels, sessions, leaks=leaks).collect()}
    assert got["q0"] == got["q4"] == ("reject", 1.0, ["artifact_leakage"], 0.0) and got["q1"] == got["q2"] == got["q3"] == ("accept", 0.0, [], 1.0)
    assert {r.verdict for r in questions.oracle_validity(q, walks, labels, sessions).collect()} == {"accept"}


def test_statuses_of_each_kind(spark):
    parts = {"a": ["failed", "running"], "b": ["succeeded"] * 2, "c": ["partial", "pending"], "d": ["pending", "succeeded"], "e": ["failed"] * 2, "f": ["ok", "none"], "g": ["none"] * 2, "h": ["none", "failed"], "i": ["ok"]}
    df = spark.createDataFrame([(k, s) for k, ss in parts.items() for s in ss], "k string, status string")
    of = lambda kind: "".join(r.status[0] for r in suite.rollup_status(df.where("k < 'f'" if kind != "actor" else "k >= 'f'"), "k", kind).orderBy("k").collect())
    assert (of("record"), of("round"), of("suite"), of("actor")) == ("rsppf", "fsppf", "pspp" + "f", "psfo")


def test_checkpoints_and_groups(spark):
    c = spark.createDataFrame([("c1", "m", True, "local_hf", "/p", "/gone", None, "", 1, 1), ("c1", "m", False, "local_hf", "/p", "/m", "/t", "/o", 1, 1), ("c2", "m", True, "remote", None, None, None, None, 1, 0)], "checkpoint_id string, actor_role string, updated boolean, backend string, checkpoint_path string, model_path string, tokenizer_path string, optimizer_path string, round_id int, step_id int")
    paths = spark.createDataFrame([("/p",), ("/m",)], "path string")
    assert sorted(map(tuple, audit.checkpoint_issues(c, paths).collect())) == [
        ("c1", "duplicate_checkpoint_id", "error"), ("c1", "missing_optimizer_for_updated_checkpoint", "error"), ("c1", "missing_tokenizer_for_updated_checkpoint", "error"),
        ("c1", "model_path_not_found", "error"), ("c1", "optimizer_path_not_found", "warning"), ("c1", "tokenizer_path_not_found", "warning"), ("c2", "missing_path", "error"),
    ]
    assert audit.checkpoint_issues(c.select("checkpoint_id", "updated", "checkpoint_path")).count() == 2
    ties = c.limit(0).unionByName(c.where("checkpoint_id = 'c2'")).withColumn("source_batch_id", F.explode(F.array(F.lit(None).cast("string"), F.lit("b"))))
    assert [r.source_batch_id for r in audit.latest_checkpoints(ties).collect()] == ["b"]
    samples = spark.createDataFrame([("g", "s1", "r", "x"), ("g", "s2", "r", "y"), ("h", "s3", "r", "x")], "group_id string, sample_id string, record_id string, role string")
    given = spark.createDataFrame([("g", "s1", "r"), ("g", "s9", "r"), ("h", "s1", "r"), ("h", "s3", "other"), ("empty", "s5", "r")], "group_id string, sample_id string, record_id string")
    found = sorted(map(tuple, rollout.group_issues(samples, given, given.limit(1)).collect()))
    assert found == [("duplicate_reward_sample_id", "s1"), ("group_role_mismatch", "g"), ("reward_record_mismatch", "s3"), ("reward_without_sample", "s1"), ("reward_without_sample", "s9")]
    assert rollout.group_issues(samples.limit(0), given.limit(0)).count() == 0


def test_verdicts_contexts_and_totals(spark):
    judged = spark.createDataFrame([("r", "fact", "accepted"), ("r", None, "accepted"), ("r", "fact", "rejected"), ("s", "fact", "needs_revision")], "record_id string, question_type string, status string")
    assert sorted((r.record_id, r.candidates, r.accepted, r.rejected, [tuple(t) for t in r.question_types]) for r in questions.verdict_summary(judged).collect()) == [("r", 3, 2, 1, [("fact", 1), ("other", 1)]), ("s", 1, 0, 1, [])]
    book = spark.createDataFrame([("w1", "r", "q", "fact", "missed", 0.5, 1, 1, 1, "active", ["n1"], ["s"], ["m"], 1), ("w2", "r", "q", "fact", "wrong", 0.9, 1, 1, 1, "active", [], [], [], 2), ("w3", "s", "q", "fact", "wrong", 0.9, 1, 1, 1, "mastered", [], [], [], 1)], weakness.BOOK)
    got = {r.record_id: json.loads(r.context)["active_weaknesses"] for r in weakness.question_agent_context(book, oracle_ids=False).collect()}
    assert got == {"r": [{"failure_type": "wrong", "question_type": "fact", "related_session_ids": []}, {"failure_type": "missed", "question_type": "fact", "related_session_ids": ["s"]}]}
    assert "missing_oracle_node_ids" in weakness.question_agent_context(book, 1).first().context
    stats = spark.createDataFrame([("r", 3, 2, 1, 1, 9), ("s", 0, 0, 0, 0, 4), ("t", 5, 5, 5, 5, 5)], "record_id string, nodes long, edges long, events long, sessions long, turns long")
    failed = spark.createDataFrame([("t",), ("u",), ("u",)], "record_id string")
    total = memory.memory_build_summary(stats, failed).first()
    assert (total.records, total.nodes, total.retained_turns, total.turns, total.empty_records, total.failed_records) == (2, 3, 1, 13, 1, 2)
    assert memory.memory_build_summary(stats.limit(0)).first().nodes == 0 and memory.memory_build_summary(stats).first().failed_records == 0


def test_unsafe_records_lose_their_format_score(spark):
    items = spark.createDataFrame([], "record_id string, question_id string, correctness double, evidence_support double, citation_quality double, answer_status string, oracle_coverage double, item_reward double, supporting_memory_ids array<string>")
    nodes = spark.createDataFrame([], "record_id string, node_id string, node_type string, status string, content string, confidence double, abstraction_level int, source_session_ids array<string>, source_turn_ids array<string>, source_event_ids array<string>")
    texts = spark.createDataFrame([], "record_id string, user_profile string, stable_preferences string, active_plans string, recent_changes string, cross_session_abstractions string")
    records = spark.createDataFrame([("a",), ("b",)], "record_id string")
    got = rewards.memory_components(items, nodes, texts, records, records.where("record_id = 'a'").unionAll(records.where("record_id = 'a'")))
    assert {r.record_id: r.format_safety for r in got.collect()} == {"a": 0.0, "b": 1.0}


def run(stream, folder):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()


def test_replay_as_a_stream(spark, tmp_path):
    schema = "record_id string, round_id int, step_id int, memory_builder_checkpoint_id string, question_agent_checkpoint_id string, ts timestamp, reward double"
    rows = [("r", 1, 1, "m", None, "2024-01-01 00:00:00", 0.5), ("r", 1, 1, "m", "", "2024-01-01 00:10:00", 0.6), ("r", 1, 2, "m", None, "2024-01-01 00:20:00", 0.7), ("s", 1, 1, "m", "q", "2024-01-01 00:30:00", 0.8)]
    write = lambda part: spark.createDataFrame(part, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    items = lambda: streams.stream_replay(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    write(rows[:2])
    run(items(), tmp_path)
    # the same rows are delivered again, with new ones, and the stream is started anew from its checkpoint
    write(rows)
    run(items(), tmp_path)
    write(rows[2:])
    run(items(), tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.replay_key for r in out.collect()) == ["r:1:1:m:none", "r:1:2:m:none", "s:1:1:m:q"]


def test_windows_as_a_stream(spark, tmp_path):
    events = spark.range(400).select((F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 90).alias("ts"), F.col("id").cast("double").alias("value"))
    for k in range(2):
        events.where(f"floor(value / 200) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(streams.stream_activity(source()), tmp_path / "w")
    run(streams.session_activity(source(), gap="5 minutes"), tmp_path / "s")
    batch, seen = streams.stream_activity(events), spark.read.parquet(str(tmp_path / "w/out"))
    # windows that end before the watermark have been closed, each equal to the batch
    closed = batch.where(F.col("start") + F.expr("INTERVAL 3 HOURS") <= F.lit(events.agg(F.max("ts")).first()[0]))
    assert closed.count() > 10 and sorted(map(tuple, seen.collect())) == sorted(map(tuple, closed.collect()))
    got, want = {tuple(r) for r in spark.read.parquet(str(tmp_path / "s/out")).collect()}, {tuple(r) for r in streams.session_activity(events, gap="5 minutes").collect()}
    assert got and got <= want
