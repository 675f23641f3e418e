"""Exports, payloads, artifacts of jobs and reports on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from memengine.operators import access, payloads, splits, suite
from memengine.sources import artifacts, exports, jobs

NODES = "record_id string, node_id string, node_type string, session_id string, text string, name string, aliases array<string>"
EDGES = "record_id string, source string, target string, edge_key int, edge_type string, edge_ord long"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a/b?c", f"n{i:03}", "fact" if i % 2 else "event", "s" if i % 3 else None, f'text "{i}"\n', None, ["x", "y"] if i == 1 else None) for i in range(60)]
    nodes += [("r", "only", "entity", None, "", "Ann", [])]
    edges = [("a/b?c", f"n{i:03}", f"n{i + 1:03}", i % 2, "NEXT" if i % 2 else "EXTRACTED_AS", i) for i in range(59)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


@pytest.mark.parametrize("part_rows", [10, 1000])
def test_written_graphs_are_read_back(spark, graph, tmp_path, part_rows):
    nodes, edges = graph
    path = str(tmp_path / "out")
    exports.write_graphs(nodes, edges, path, part_rows)
    parts = exports.graph_documents(nodes, edges, part_rows)
    assert (parts.where("record_id = 'r'").count(), parts.where("record_id <> 'r'").count() > 1) == (1, part_rows == 10)
    assert all(set(json.loads(r.json)) == {"graph", "nodes", "edges"} for r in parts.collect())
    n, e, findings = artifacts.read_graphs(spark, f"{path}/graphs/*/*")
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    fields = ("record_id", "node_id", "node_type", "session_id", "text", "name")
    assert rows(n, *fields) == rows(nodes, *fields) and findings.count() == 0
    assert rows(e, "record_id", "source", "target", "edge_type", "edge_key") == rows(edges, "record_id", "source", "target", "edge_type", F.col("edge_key").cast("string"))
    assert n.where("node_id = 'n001'").first().attributes == {"aliases": '["x","y"]'} and e.where("source = 'n007'").first().attributes == {"edge_ord": "7"}
    pack, links, _ = artifacts.read_graphs(spark, f"{path}/evidence_packs/*/*")
    assert pack.count() == 60 and links.count() == 59 and pack.where("record_id = 'r'").count() == 0


def test_no_graph_no_document(graph):
    nodes, edges = graph
    assert exports.graph_documents(nodes.limit(0), edges.limit(0)).count() == 0
    alone = json.loads(exports.graph_documents(nodes.where("record_id = 'r'"), edges.limit(0)).first().json)
    assert alone["edges"] == [] and alone["nodes"][0]["id"] == "only" and "session_id" not in alone["nodes"][0]


def test_metrics_in_two_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345, None, "a,b"), (2, float("nan"), 2.0, None), (3, None, -0.00001, "")], "round_id int, x double, y float, name string")
    assert [tuple(r) for r in exports.metric_texts(df).orderBy("round_id").collect()] == [("1", "0.1235", "", "a,b"), ("2", "", "2.0000", ""), ("3", "", "-0.0000", "")]
    exports.write_metrics(df.coalesce(1), str(tmp_path / "csv"))
    (csv,) = (tmp_path / "csv").glob("*.csv")
    assert csv.read_text().splitlines() == ["round_id,x,y,name", '1,0.1235,,"a,b"', "2,,2.0000,", "3,,-0.0000,"]
    exports.write_metrics(df.drop("x").coalesce(1), str(tmp_path / "jsonl"), "jsonl")
    (lines,) = (tmp_path / "jsonl").glob("*.json")
    assert json.loads(lines.read_text().splitlines()[1]) == {"round_id": 2, "y": 2.0, "name": None}
    with pytest.raises(ValueError):
        exports.write_metrics(df, str(tmp_path / "xml"), "xml")


def test_planted_faults_of_a_release(spark, tmp_path):
    folder = tmp_path / "release"
    (folder / "sub dir").mkdir(parents=True)
    for name, text in (("a.json", "{}"), ("sub dir/b ä.txt", "text\n"), ("empty", "")):
        (folder / name).write_text(text)
    assert [(r.path, r.code) for r in exports.verify_release(spark, str(folder)).collect()] == [("checksums.sha256", "missing")]
    files = exports.checksum_manifest(spark, str(folder))
    assert {r.path: r.sha256 for r in files.collect()} == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in (("a.json", "{}"), ("sub dir/b ä.txt", "text\n"), ("empty", ""))}
    lines = [r.value for r in exports.checksum_lines(files).collect()]
    (folder / "checksums.sha256").write_text("\n".join(lines) + "\n\n")
    assert exports.verify_release(spark, str(folder)).count() == 0
    (folder / "a.json").write_text("[]")
    (folder / "empty").unlink()
    (folder / "new").write_text("x")
    (folder / "checksums.sha256").write_text("\n".join(lines) + "\nonly-one-word\n00  _SUCCESS\n")
    faults = {(r.path, r.code) for r in exports.verify_release(spark, str(folder)).collect()}
    assert faults == {("a.json", "mismatch"), ("empty", "missing"), ("new", "unlisted"), ("only-one-word", "bad_line"), ("_SUCCESS", "unread")}


def test_jobs_and_answers_in_every_layout(spark, tmp_path):
    answer = {"question_id": "q", "prediction": "p", "answer_status": "answered", "confidence": 0.5, "supporting_memory_ids": ["m"]}
    texts = {
        "r 1": {"answers": [answer, "no object"], "question_items": [answer]}, "r2": [answer | {"record_id": "other"}], "r+3": {"question_items": [{"question_id": "q", "correctness": 0.75}]},
        "r4": {"nothing": []}, "r5": {"answers": "text", "question_items": [answer]},
    }
    for record, report in texts.items():
        (tmp_path / record).mkdir()
        (tmp_path / record / "answers.json").write_text(json.dumps(report))
    (tmp_path / "r2" / "current_memory.json").write_text("{}")
    (tmp_path / "r6").mkdir()
    (tmp_path / "r6" / "answers.json").write_text("{broken")
    files = jobs.job_files(spark, str(tmp_path))
    assert {r.record_id for r in files.collect()} == {*texts, "r6"}
    records = spark.createDataFrame([(r,) for r in [*texts, "r6", "r7"]], "record_id string")
    rows = {r.record_id: r for r in jobs.reward_jobs(records, files, records.where("record_id <> 'r4'"), 2, 1).collect()}
    assert rows["r2"].job_id == "r2_round2_step1" and rows["r2"].missing == ["question_set", "trainer_adapter_report", "weakness_book"] and rows["r2"].error is None
    assert rows["r4"].error == "oracle graph not found: r4" and len(rows["r7"].missing) == 5
    out = sorted(map(tuple, jobs.answer_rows(jobs.reward_jobs(records, files, records)).collect()))
    assert out == [
        ("other", "q", "p", "answered", 0.5, ["m"], "list"), ("r 1", "q", "p", "answered", 0.5, ["m"], "answers"), ("r+3", "q", "", None, 0.75, [], "question_items"),
    ]


def test_records_are_found_in_names(spark):
    files = spark.createDataFrame([("file:/run/traces/a.b.grpo_trace.json",), ("/run/groups/c.memory_group.json",), ("/run/groups/c.question_group.json",), ("x.json",), (None,)], "path string")
    manifest = spark.createDataFrame([("c",), ("d",), ("d",), (None,)], "record_id string")
    found = {r.record_id: r.sources for r in jobs.discover_records(manifest, files).collect()}
    assert found == {"a.b": ["traces"], "c": ["groups", "manifest"], "d": ["manifest"]}
    with pytest.raises(ValueError):
        jobs.discover_records()


def test_histories_keep_order_and_times(spark):
    turns = spark.createDataFrame(
        [("r", "s2", 2, 0, 3, "e3", "user", 'a "quote"', None), ("r", "s1", 1, 1, 2, "e2", "assistant", "", " "), ("r", "s1", 1, 0, 1, "e1", "user", "first", None), ("r", "s1", 1, 2, 4, "e4", "user", "x", "2024")],
        "record_id string, session_id string, session_ord int, turn_id int, event_ord int, event_id string, speaker string, text string, ts_raw string",
    )
    payload = json.loads(payloads.history_payload(turns).first().payload)
    assert [(s["session_id"], s["timestamp"], [t["event_id"] for t in s["turns"]]) for s in payload["sessions"]] == [("s1", "2024", ["e1", "e2", "e4"]), ("s2", "", ["e3"])]
    assert payload["sessions"][1]["turns"] == [{"event_id": "e3", "turn_id": 0, "speaker": "user", "text": 'a "quote"'}] and payload["sessions"][0]["turns"][2]["timestamp"] == "2024"
    samples = payloads.memory_policy_samples(turns, spark.createDataFrame([], "record_id string, sample_index int, node_id string, node_type string, content string, confidence double, source_session_ids array<string>, source_turn_ids array<string>, source_event_ids array<string>, node_ord int"), ['{"max":1}'], 1, 2).collect()
    assert [(s.sample_id, s.group_id, s.response) for s in samples] == [("r:memory:0", "round1_step2_r_memory", '{"memory_nodes":[]}')]
    prompt = json.loads(samples[0].prompt)
    assert prompt["history"] == payload and prompt["builder_config"] == {"max": 1} and list(prompt)[:2] == ["task", "constraints"]


def test_answer_and_judge_payloads(spark):
    q = spark.createDataFrame([("r", f"q{i}", f"ask {i}", "secret", ["t2", "gone", "t1"] if i == 0 else None) for i in range(5)], "record_id string, question_id string, question string, answer string, supporting_trajectory_ids array<string>")
    hits = spark.createDataFrame([("r", "q0", 2, "m2", "fact", "two"), ("r", "q0", 1, "m1", "fact", "one"), ("r", "q0", 9, "summary_active_plans", "summary", "plans")], "record_id string, question_id string, rank int, memory_id string, memory_type string, content string")
    memory = spark.createDataFrame([("r", "m1", ["s"], ["0"], ["e"])], "record_id string, node_id string, source_session_ids array<string>, source_turn_ids array<string>, source_event_ids array<string>")
    texts = spark.createDataFrame([], "record_id string, user_profile string, stable_preferences string, active_plans string, recent_changes string, cross_session_abstractions string")
    got = {r.question_id: json.loads(r.payload) for r in payloads.answer_payload(q, hits, memory, texts).collect()}
    assert len(got) == 5 and got["q1"]["retrieved_memory"] == [] and set(got["q1"]["memory_summaries"].values()) == {""} and "secret" not in json.dumps(got)
    assert [(m["memory_id"], m["source_session_ids"]) for m in got["q0"]["retrieved_memory"]] == [("m1", ["s"]), ("m2", []), ("summary_active_plans", [])]
    walks = spark.createDataFrame([("r", "t1", "long " * 4, ["s"]), ("r", "t2", None, [])], "record_id string, trajectory_id string, text string, session_ids array<string>")
    batches = {r.batch: (r.questions, json.loads(r.payload)["questions"]) for r in payloads.judge_payload(q, walks, batch_size=2, max_chars=9).collect()}
    assert {b: n for b, (n, _) in batches.items()} == {0: 2, 1: 2, 2: 1}
    first, second = batches[0][1]
    assert first["missing_trajectory_ids"] == ["gone"] and [(t["trajectory_id"], t["text"]) for t in first["evidence_trajectories"]] == [("t2", ""), ("t1", "long l...")]
    assert second["question_id"] == "q1" and second["supporting_trajectory_ids"] == [] and second["question_type"] == "other"
    assert spark.range(1).select(payloads.compact_text(F.lit("ab   cdef"), 6)).first()[0] == "ab..."


def test_look_ups(spark, graph):
    nodes, edges = graph
    wanted = spark.createDataFrame([("a/b?c", "n001"), ("r", "n001"), (None, "n001")], "record_id string, node_id string")
    assert sorted((str(r.record_id), r.found, r.node_type) for r in access.look_up(nodes, wanted).collect()) == [("None", False, None), ("a/b?c", True, "fact"), ("r", False, None)]
    assert access.look_up(nodes, wanted.limit(1), strict=True).count() == 1
    with pytest.raises(Exception, match="not in the table"):
        access.look_up(nodes, wanted, strict=True).collect()
    assert access.edges_where(edges, source="n001", key="1").count() == 1 and access.edges_where(edges, source="n001", key=0).count() == 0 and access.edges_where(edges).count() == 59
    assert access.nodes_where(nodes, "only", "fact").count() == 0 and access.nodes_where(nodes, node_type="event").count() == 30


def test_reports(spark):
    e = spark.createDataFrame([("x", "succeeded", 3, 2), ("y", "failed", 3, 1), ("z", "succeeded", 3, 3)], "experiment_id string, status string, rounds_requested int, rounds_completed int")
    r = spark.createDataFrame([("x", 2, "succeeded", 0.5, ["w"]), ("x", 1, "partial", 0.5, None), ("x", 3, "failed", float("nan"), []), ("y", 1, "failed", None, ["a", "b"])], "experiment_id string, round_id int, status string, dev_memory_reward_mean double, warnings array<string>").withColumn("errors", F.lit(None).cast("array<string>"))
    assert sorted(map(tuple, suite.experiment_metrics(e, r).collect())) == [("x", 1, 1, 1, 0.5, 1, True), ("y", 0, 1, 0, None, None, False), ("z", 0, 0, 0, None, None, False)]
    assert sorted((m.round_id, m.num_warnings, m.num_errors, m.train_memory_reward_mean) for m in suite.round_metrics(r).collect()) == [(1, 0, 0, None), (1, 2, 0, None), (2, 1, 0, None), (3, 0, 0, None)]
    evals = spark.createDataFrame([("final", None, "test", "succeeded", 3.0), ("baseline", "zz", "test", "succeeded", 2.0), ("baseline", None, "test", "failed", None), ("baseline", "aa", "dev", "succeeded", 9.0)], "kind string, name string, split string, status string, test_memory_reward_mean double")
    evals = evals.withColumns({"test_question_reward_mean": F.lit(0.0), "test_no_leakage_pass_rate": F.lit(1.0)})
    assert [(m.place, m.method, m.test_memory_reward_mean) for m in suite.method_comparison(evals).orderBy("place").collect()] == [(1, "unknown", None), (2, "zz", 2.0), (3, "final_checkpoint", 3.0)]
    listed = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "dev"), ("b", "test"), ("c", "dev")], "record_id string, split string")
    counts, twice = splits.inspect_split(listed, spark.createDataFrame([("ERROR",), ("error",), ("odd",)], "severity string"))
    assert {c.severity: c.issues for c in counts.collect()} == {"error": 2, "warning": 0, "info": 0}
    assert sorted(map(tuple, twice.collect())) == [("a", 2, ["train"]), ("b", 2, ["dev", "test"])]
