"""Inspections of runs, splits, books and returns on small fixtures."""

import hashlib

import pytest

from memengine.operators import audit, inspection, rollout, splits, suite, walks, weakness


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_rounds(spark):
    nan, inf = float("nan"), float("inf")
    schema = "run_id string, round_id int, output_dir string, train_rollout_manifest_path string, dev_rollout_manifest_path string, train_no_leakage_pass_rate double, dev_memory_reward_mean double, input_question_agent_checkpoint_id string, selected_question_agent_checkpoint_id string"
    r = spark.createDataFrame([
        ("a", 0, "/a/0", "/a/0/t", "/a/0/d", 0.8, 1.0, "init", "c1"), ("a", 1, "/a/1", "", None, 0.79, nan, "c1", None), ("a", 2, "/a/2", None, None, nan, -inf, "c1", "c2"), ("a", 3, "/a/3", None, None, 1.01, None, "c1", None),
        ("b", 7, None, "/b/t", None, None, 0.0, "any", None),
    ], schema)
    got = rows(inspection.inspect_rounds(r), "run_id", "round_id", "code", "what")
    rate, dev = "train_no_leakage_pass_rate", "dev_memory_reward_mean"
    assert got == sorted([("a", 1, "leakage_risk", rate), ("a", 1, "invalid_metric", dev), ("a", 2, "invalid_metric", rate), ("a", 2, "invalid_metric", dev), ("a", 3, "invalid_metric", rate), ("a", 3, "checkpoint_inconsistency", "question_agent")], key=str)
    there = spark.createDataFrame([(p,) for p in ("/a/0/t", "/a/0/round_plan.json", "/a/1/round_summary.json", "/a/2/round_plan.json", "/a/2/round_summary.json", "/a/3/round_plan.json", "/a/3/round_summary.json", "/b/t")], "path string")
    split = spark.createDataFrame([("/a/0/t", "train"), ("/a/0/d", "test"), ("/b/t", None)], "path string, split string")
    more = inspection.inspect_rounds(r, there, split).where("code not in ('leakage_risk', 'invalid_metric', 'checkpoint_inconsistency')")
    assert rows(more, "run_id", "round_id", "severity", "code", "what") == sorted([
        ("a", 0, "warning", "missing_artifact", "round_summary"), ("a", 0, "error", "missing_artifact", "dev_rollout_manifest"), ("a", 0, "error", "split_policy_violation", "dev_rollout_manifest"), ("a", 1, "warning", "missing_artifact", "round_plan"),
        ("b", 7, "warning", "validation_error", "train_rollout_manifest"),
    ], key=str)
    assert inspection.inspect_rounds(r.limit(0), there, split).count() == 0


def test_steps(spark):
    steps = spark.createDataFrame([("s1", "train", {"kl": float("inf"), "ok": 1.0}), ("s2", "train", None), ("s3", "dev", {})], "step_id string, split string, metrics map<string,double>")
    actors = spark.createDataFrame([("s1", "m", "succeeded", True, "/c1", 0.1), ("s2", "m", "failed", None, "/c2", float("nan")), ("s3", "m", "succeeded", True, "/c3", None), ("s3", "q", "skipped", True, "/c3", None), ("s3", "r", "succeeded", True, "/c4", None)], "step_id string, actor_role string, status string, no_leakage_passed boolean, written_checkpoint_path string, loss double")
    wrote = spark.createDataFrame([("/c1", True), ("/c3", True), ("/c4", False)], "path string, weights_written boolean")
    assert rows(inspection.inspect_steps(steps, actors, wrote), "step_id", "code", "what") == [("s1", "invalid_metric", "kl"), ("s2", "invalid_metric", "m.loss"), ("s2", "leakage_risk", "m"), ("s2", "unexpected_state", "no_update"), ("s3", "leakage_risk", "m.weights_written")]
    bare = inspection.inspect_steps(steps.select("step_id", "split"), actors.select("step_id", "actor_role", "status"))
    assert rows(bare.where("code <> 'leakage_risk'"), "step_id", "code") == [("s2", "unexpected_state")]


def test_runs(spark):
    runs = spark.createDataFrame([("a", "/a", "train", ["x", "y"]), ("b", "/b", "dev", None), ("c", "/c", "dev", ["x"])], "run_id string, run_dir string, split string, selected_record_ids array<string>")
    nan = float("nan")
    records = spark.createDataFrame([("a", "x", "succeeded", "/rep", True, nan, 1.0), ("a", "y", "failed", "/none", False, None, 1e6), ("b", "x", "succeeded", "", None, 0.0, 0.0), ("c", "x", "succeeded", "/none", False, nan, nan)], "run_id string, record_id string, status string, final_report_path string, no_leakage_passed boolean, memory_reward_mean double, question_reward_mean double")
    act = "/a/aggregate/actor_batches"
    paths = ["/a/multi_case_rollout_manifest.json", "/a/records", "/a/records/x", "/a/aggregate", "/a/aggregate/replay_buffer.jsonl", act, f"{act}/memory_builder.update_batch.json", f"{act}/memory_builder.batch_manifest.json", f"{act}/question_agent.batch_manifest.json", "/b/multi_case_rollout_manifest.json"]
    there = spark.createDataFrame([(p,) for p in paths], "path string")
    passed = spark.createDataFrame([(f"{act}/memory_builder.batch_manifest.json", True), (f"{act}/question_agent.batch_manifest.json", None)], "path string, no_leakage_passed boolean")
    want = [
        ("a", "invalid_reward", "x.memory_reward_mean"), ("a", "invalid_reward", "y.question_reward_mean"), ("a", "leakage_risk", "question_agent.batch_manifest"), ("a", "missing_artifact", "question_agent.update_batch"), ("a", "missing_artifact", "record.y"),
        ("a", "missing_artifact", "replay_manifest"), ("a", "missing_artifact", "report.x"), ("b", "missing_artifact", "aggregate"), ("b", "missing_artifact", "records"), ("c", "missing_artifact", "manifest"),
    ]
    assert rows(inspection.inspect_runs(runs, records, there, passed), "run_id", "code", "what") == want
    strict = inspection.inspect_runs(runs, records, there, passed, strict=True)
    assert set(rows(strict, "run_id", "code", "what")) - set(want) == {("b", "leakage_risk", "records")}


def test_alignment(spark):
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "rollout_id string")
    lines = spark.createDataFrame([("a", 1, '{"record_id": "x"}'), ("a", 2, "{broken"), ("a", 3, '{"other": 1}'), ("b", 1, ' {"record_id": "x"}\n'), ("c", 1, "lost")], "rollout_id string, line_num int, line string")
    there = spark.createDataFrame([("a", p) for p in ("manifest.jsonl", "groups", "groups/x.memory_group.json", "groups/x.question_group.json", "groups/None.memory_group.json")] + [("b", "manifest.jsonl"), ("b", "summary.json")], "rollout_id string, path string")
    batches = spark.createDataFrame([("a", "x", "memory_builder", '{"p": "[{\\"raw_history\\": 0}]", "gold_answer": null}'), ("a", "x", "question_agent", '{"a": {"expected_answer": ""}, "gold_answer": [1]}'), ("a", "z", "memory_builder", '{"gold_answer": 1}'), ("b", "x", "memory_builder", '{"gold_answer": 1}')], "rollout_id string, record_id string, role string, json string")
    assert rows(inspection.inspect_alignment(r, lines, there, batches), "rollout_id", "record_id", "code", "what") == sorted([
        ("a", None, "missing_summary", None), ("a", None, "invalid_manifest_line", "2"), ("a", "None", "missing_question_group", None), ("a", "x", "unsafe_actor_batch", "memory_builder: batch.p[0].raw_history"),
        ("a", "x", "unsafe_actor_batch", "question_agent: batch.a.expected_answer, batch.gold_answer"), ("b", "x", "missing_groups_dir", None), ("c", None, "missing_manifest", None),
    ], key=str)


def test_releases(spark):
    files = spark.createDataFrame([("a", n) for n in inspection.RELEASE_FILES] + [("b", "README.md")], "release_id string, name string")
    manifests = spark.createDataFrame([("a", "s"), ("b", None)], "release_id string, suite_id string")
    runs = spark.createDataFrame([("a", "failed"), ("a", "succeeded"), ("a", "failed")], "release_id string, status string")
    told = spark.createDataFrame([("a", "t", 3, 1), ("b", None, None, 4)], "release_id string, suite_id string, num_seeds_requested int, num_seeds_failed int")
    got = inspection.verify_release(files, manifests, runs, told, spark.createDataFrame([("a", False, None)], "release_id string, final_test_eval boolean, strict_no_leakage boolean"))
    assert rows(got.where("code <> 'missing_file'"), "release_id", "code", "what") == [("a", "disabled", "final_test_eval"), ("a", "failed_count_mismatch", "2/1"), ("a", "suite_id_mismatch", "s/t")]
    assert got.where("code = 'missing_file'").groupBy("release_id").count().collect()[0][:] == ("b", 7)


def test_fingerprints(spark, monkeypatch):
    ids = [("train", f"r{i}") for i in range(40)] + [("dev", "é"), ("test", "z"), ("dev", "r1"), ("dev", "r1")]
    s = spark.createDataFrame(ids, "split string, record_id string")
    text = "\n".join(f"{a}:{b}" for a, b in sorted(ids)) + "\n"
    whole = splits.split_fingerprint(s, whole=True).first()
    assert (whole.train, whole.dev, whole.test, whole.fingerprint) == (40, 3, 1, hashlib.sha256(text.encode()).hexdigest()[:16])
    tree = splits.split_fingerprint(s).first()
    assert tree[:3] == whole[:3] and tree == splits.split_fingerprint(s.repartition(5)).first()
    assert tree.fingerprint != splits.split_fingerprint(s.where("record_id <> 'z'")).first().fingerprint
    assert splits.split_fingerprint(s.limit(0)).first().fingerprint == hashlib.sha256(b"").hexdigest()[:16]
    assert splits.split_fingerprint(s.limit(0), whole=True).first().fingerprint == hashlib.sha256(b"\n").hexdigest()[:16]
    monkeypatch.setattr(splits, "WHOLE_RECORDS", 43)
    with pytest.raises(ValueError, match="tree"):
        splits.split_fingerprint(s, whole=True)


def test_split_of_graphs(spark):
    s = spark.createDataFrame([("a", "train"), ("a", "dev"), ("b", "dev"), ("c", "test"), ("d", "test"), ("e", "test")], "record_id string, split string")
    g = spark.createDataFrame([("a", "a", True), ("b", "x", True), ("c", None, True), ("d", "d", False)], "record_id string, graph_record_id string, readable boolean")
    mismatch = "oracle_graph_record_id_mismatch"
    assert rows(splits.validate_split(s, g), "record_id", "severity", "code") == [("a", "error", "duplicate_record_id"), ("b", "error", mismatch), ("c", "error", mismatch), ("d", "warning", mismatch), ("e", "error", "missing_oracle_graph")]
    assert splits.validate_split(s, g.drop("readable"), missing="warning").where("severity = 'warning'").count() == 1
    told = spark.createDataFrame([("a", " q ", None), ("b", " ", "x"), ("b", None, "x")], "record_id string, question string, answer string")
    assert rows(splits.split_records(s.where("record_id < 'd'"), told, g), "record_id", "split", "has_oracle_graph", "has_benchmark_question", "has_benchmark_answer") == [("a", "dev", True, True, False), ("a", "train", True, True, False), ("b", "dev", True, False, True), ("c", "test", True, False, False)]


def test_books_tell(spark):
    b = spark.createDataFrame([("r", "missing_fact", "active", 2), ("r", "missing_fact", "active", 1), ("r", "temporal_error", "mastered", 4), ("s", None, "mastered", 0)], "record_id string, failure_type string, status string, last_seen_round int")
    got = {r.record_id: (r.updated_round, r.active_count, r.mastered_count, r.top_failure_types) for r in weakness.book_summary(b).collect()}
    assert got == {"r": (4, 2, 1, {"missing_fact": 2}), "s": (0, 0, 1, {})}
    texts = {r.failure_type: (r.short_summary, r.recommended_focus) for r in weakness.described(b).collect()}
    assert texts["temporal_error"] == ("Memory has temporal ordering error", "Generate temporal reasoning questions") and texts[None] == ("Memory weakness detected", "Address memory weakness")


def test_returns_and_step_metrics(spark):
    t = spark.createDataFrame([(1, [1, 2], [0.5, -1.0], [1.0, 2.0]), (2, [1], [], [])], "id int, input_ids array<int>, token_advantages array<double>, token_rewards array<double>")
    of = lambda df: [(r.returns, r.returns_strategy) for r in df.orderBy("id").collect()]
    assert of(rollout.with_returns(t)) == [([0.5, -1.0], "advantages_as_returns"), ([], "advantages_as_returns")]
    assert of(rollout.with_returns(t, "rewards_plus_advantages")) == [([1.5, 1.0], "rewards_plus_advantages"), ([], "rewards_plus_advantages")]
    assert of(rollout.with_returns(t.drop("token_rewards"), "rewards_plus_advantages"))[0] == ([0.5, -1.0], "advantages_as_returns")
    assert of(rollout.with_returns(t.drop("token_advantages"))) == [([0.0, 0.0], "zero_returns"), ([0.0], "zero_returns")]
    with pytest.raises(ValueError):
        rollout.with_returns(t, "other")
    m, q = "memory_builder", "question_agent"
    rep = spark.createDataFrame([("a", m, "succeeded", 1.0, None, 0.5), ("a", q, "succeeded", 3.0, 0.2, None), ("b", m, "skipped", 9.0, 9.0, 9.0), ("b", q, "skipped", None, None, None), ("c", m, "failed", 9.0, None, None), ("c", q, "succeeded", None, 0.4, 1.0), ("d", q, "failed", None, None, None), ("e", m, "odd", 1.0, None, None)], "step_id string, actor_role string, status string, loss double, approx_kl double, reward_mean double")
    got = {r.step_id: r for r in rollout.trainer_step_metrics(rep, steps=spark.createDataFrame([(x,) for x in "abcdef"], "step_id string")).collect()}
    assert [got[k].status for k in "abcdef"] == ["succeeded", "skipped", "partial", "failed", "partial", "pending"]
    assert (got["a"].mean_loss, got["a"].min_loss, got["a"].max_loss, got["a"].mean_approx_kl, got["a"].mean_reward, got["a"].question_agent_loss) == (2.0, 1.0, 3.0, 0.2, 0.5, 3.0)
    assert got["b"].mean_loss is None and got["c"].memory_builder_loss is None and got["c"].mean_reward == 1.0 and (got["c"].num_actors_requested, got["c"].num_actors_failed, got["f"].num_actors_requested) == (2, 1, 0)


def test_labels_of_nodes(spark):
    rows_ = [("event", "", "a  b", None, None), ("fact", None, "so it ends...", None, None), ("fact", None, "x" * 12, None, None), ("topic", None, None, "n" * 12, None), ("session", None, None, None, "s1"), ("other", None, "t", None, None)]
    n = spark.createDataFrame([("r", f"n{i}", k, sp, t, nm, se, None, None, None, None) for i, (k, sp, t, nm, se) in enumerate(rows_)], "record_id string, node_id string, node_type string, speaker string, text string, name string, session_id string, subject string, predicate string, object string, summary string")
    got = {r.node_id: (r.label, r.truncated, r.label_source) for r in walks.node_labels(n, 13, {"topic": 6, "other": 0}).collect()}
    assert got == {
        "n0": ("unknown: a b", False, "speaker:text"), "n1": ("so it ends...", False, "text"), "n2": ("x" * 12, False, "text"), "n3": ("nnn...", True, "name"), "n4": ("s1", False, "session_id"),
        "n5": ('{"record_id":"r","node_id":"n5","node_type":"other","text":"t"}', False, "node"),
    }


def test_stage_audit(spark):
    a = spark.createDataFrame([
        ("e", "f1", "memory_builder_input", '{"x": [{"gold_answer": null}, {"gold_answer": 1}], "raw_history": []}'), ("e", "f2", "answerer_input", '{"raw_history": [], "test_label": 1}'), ("e", "f3", "trainer_batch", "{broken"), ("e", "f4", "trainer_batch", None),
        ("e", "f5", "elsewhere", '{"gold_answer": 1}'), ("g", "f6", "question_agent_training_input", '{"gold_answer": 1, "note": "test_label"}'),
    ], "experiment string, path string, stage string, json string").selectExpr("*", "'train' AS split")
    issues = audit.stage_audit(a)
    assert rows(issues, "path", "field") == [("f1", "gold_answer"), ("f2", "raw_history"), ("f3", "__unreadable_json__"), ("f4", "__unreadable_json__")]
    assert {r.experiment: (r.scanned_files, r.issues, r.bad_files, r.status) for r in audit.audit_report(a, issues).collect()} == {"e": (5, 4, 4, "failed"), "g": (1, 0, 0, "passed")}


def test_reports_of_suites(spark):
    s = spark.createDataFrame([("final_checkpoint", "test_memory_reward_mean", 0.5, 0.25, 4, 0.125), ("final_checkpoint", "test_no_leakage_pass_rate", 1.0, 0.5, 4, 0.25), ("no_llm_memory", "test_memory_reward_mean", 0.1, 0.0, 2, 0.0), ("no_llm_memory", "test_question_reward_mean", 0.2, None, 1, None), ("odd", "test_memory_reward_mean", 1.0, 1.0, 1, 1.0), ("initial_checkpoint", "test_question_reward_mean", None, None, 0, None)], "method string, metric string, mean double, std double, count int, stderr double")
    assert [r[:] for r in suite.suite_report(s, names={"final_checkpoint": "Mine"}).orderBy("place").select("place", "name", "memory_reward", "question_reward", "no_leakage", "seeds", "notes").collect()] == [
        (1, "No-LLM Memory", "0.1000", "0.2000", "N/A", 2, "baseline"), (2, "Initial Model", "N/A", "N/A", "N/A", 0, "before training"), (3, "Mine", "0.5000 ± 0.2500", "N/A", "1.0000", 4, "trained"),
    ]
    assert [r[:] for r in suite.bar_chart(s).orderBy("place").select("method", *suite.BAR_METRICS, "test_memory_reward_stderr").collect()] == [("no_llm_memory", 0.1, 0.2, 0.0), ("initial_checkpoint", None, None, None), ("final_checkpoint", 0.5, None, 0.125)]
    runs = spark.createDataFrame([("a", 1, "succeeded"), ("b", 2, "failed")], "run_id string, seed int, status string")
    r = spark.createDataFrame([("a", 2, 0.2), ("a", 0, None), ("b", 0, 0.3)], "run_id string, round_id int, dev_memory_reward_mean double")
    assert rows(suite.curve_points(r, runs), "run_id", "seed", "place", "round_id", "dev_memory_reward_mean", "train_memory_reward_mean") == [("a", 1, 0, 0, None, None), ("a", 1, 1, 2, 0.2, None)]
