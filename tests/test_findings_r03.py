"""What the findings of round 3 named."""

import math
import random

from pyspark.sql import functions as F

from memengine.functions import columns as C
from memengine.operators import access, audit, graph, inspection, memory, retrieval, rewards, rollout, suite, walks
from memengine.plans import graph_queries, memory_queries


def test_report_cells_go_by_the_binary_value(spark):
    means = [7.00395, 0.03125, 0.09375, 2.00005, 1234567.5, 0.00005, -1.25, math.nan]
    rows = [(str(i), "test_memory_reward_mean", m, None) for i, m in enumerate(means)]
    got = suite.report_table(spark.createDataFrame(rows, "method string, metric string, mean double, std double"))
    assert {r.method: r.cell for r in got.collect() if r.cell != "NaN"} == {str(i): f"{m:.4f}" for i, m in enumerate(means) if not math.isnan(m)}


def test_normalizations_take_one_pass(spark):
    for c in (C.normalize_text("t"), C.normalize_for_reward("t"), C.canonicalize_name("t")):
        assert str(c).lower().count("regexp_replace") == 1
    odd = ["  a\x1c\x85b  c ", "Don't__STOP—now　 ", " ", "--İx\U00010400 9½--", "a \t b", "_x_", "一\ta", ""]
    got = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", C.normalize_text("t"), C.normalize_for_reward("t"), C.canonicalize_name("t"), C.tokens_ws("t")).sort("i").collect()
    assert [r[1] for r in got] == ["a b c", "Don't__STOP—now", "", "--İx\U00010400 9½--", "a b", "_x_", "一 a", ""]
    assert [r[2] for r in got] == ["a b c", "don t__stop now", "", "i x\U00010428 9½", "a b", "_x_", "一 a", ""]
    assert [r[3] for r in got] == ["a_b_c", "don_t_stop_now", "unknown", "i_x_9", "a_b", "x", "一_a", "unknown"]
    assert got[4][4] == ["a", "b"]


def test_paths_of_many_checkpoints(spark):
    rows = [(i, True, "local_hf", "/all", f"/m{i % 50}", "/nowhere", "/o") for i in range(400)]
    c = spark.createDataFrame(rows, "checkpoint_id long, updated boolean, backend string, checkpoint_path string, model_path string, tokenizer_path string, optimizer_path string")
    paths = spark.createDataFrame([(p,) for p in ["/all", "/o", *[f"/m{i}" for i in range(0, 50, 2)]]], "path string")
    want = sorted([(i, "tokenizer_path_not_found", "warning") for i in range(400)] + [(i, "model_path_not_found", "error") for i in range(400) if i % 50 % 2])
    for often in (100, 3, 100_000):
        assert sorted(map(tuple, audit.checkpoint_issues(c, paths, often).collect())) == want


def test_near_copies_meet_on_few_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [rng.sample(words, rng.choice([1, 2, 3, 6, 7, 8, 13, 20, 40, 90])) for _ in range(120)]
    for t in texts[:60]:
        k = max(1, len(t) // 12)
        texts.append(t[k if rng.random() < 0.5 else 0 :] + rng.sample(words, rng.randint(0, k)))
    sets = list({frozenset(t) for t in texts if t})
    rows = [("r", f"{i:04}", 1, sorted(x)) for i, x in enumerate(sets)]
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    assert len(near) > 20
    got: dict[int, set[int]] = {}
    for r in rewards.part_signatures(spark.createDataFrame(rows, "record_id string, set_id string, copies long, tokens array<string>"), 0.85).collect():
        got.setdefault(r.sig, set()).add(int(r.set_id))
    pairs = {(i, j) for ids in got.values() for i in ids for j in ids if i < j}
    assert near <= pairs and len(pairs) < len(sets) ** 2 / 8
    memory = spark.createDataFrame([("r", f"{i:04}", "active", " ".join(x)) for i, x in enumerate(sets)], "record_id string, node_id string, status string, content string")
    n = len(sets)
    assert abs(rewards.non_redundancy(memory).first().non_redundancy - (1 - len(near) / (n * (n - 1) / 2))) < 1e-12


def test_scores_work_texts_out_once(spark):
    assert str(C.answer_correctness("p", "e")).lower().count("regexp_replace") == 2
    assert str(C.token_f1("p", "e")).lower().count("regexp_replace") == 2
    rows = [("a b c", "a b d", 2 / 3), ("A, b", "a b", 1.0), ("the answer is long", "answer is lo", 0.75), ("", "x", 0.0), ("!", "x", 0.0), ("x", "!", 0.0), (None, "x", 0.0)]
    got = spark.createDataFrame([(i, p, e) for i, (p, e, _) in enumerate(rows)], "i int, p string, e string").sort("i").select(C.answer_correctness("p", "e").alias("s")).collect()
    assert all(abs(g.s - r[2]) < 1e-12 for g, r in zip(got, rows, strict=True))


def _times(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{name}(")


def test_shared_steps_work_texts_out_once(spark):
    """A turn's text was normalized 13 times in the plan of memory nodes, and each pair's overlap was found twice."""
    said = [("user", "I like green tea in the morning hours"), ("assistant", "Green tea\nis fine"), ("assistant", " \u00a0\n"), ("user", "I plan to  visit\tOslo in the next summer")]
    turns = spark.createDataFrame([("r", "s", 1, i, i, f"e{i}", who, text) for i, (who, text) in enumerate(said)], "record_id string, session_id string, session_ord int, turn_id int, event_ord int, event_id string, speaker string, text string")
    nodes = memory.memory_nodes(memory.retained_turns(turns))
    assert _times(nodes, "regexp_replace") == 3
    q = memory_queries.questions_from(graph.heuristic_facts(turns))
    assert _times(q, "regexp_replace") == 1 and [r.answer for r in q.collect()] == ["Green tea is fine"]
    got = retrieval.retrieve(q, nodes)
    assert _times(got, "array_intersect") == 1
    assert [(r["rank"], round(r.score, 6)) for r in got.sort("rank").limit(2).collect()] == [(1, round(0.25 * 1.15 * 0.55, 6)), (2, round(0.25 * 0.9 * 0.6, 6))]
    assert not retrieval.retrieve(q, nodes, min_score=0.5).count()


def test_group_issues_meet_once(spark):
    """Each rule shuffled its tables anew; a null id or group names no row of another table."""
    kinds = "group_id string, sample_id string, record_id string, role string"
    samples = spark.createDataFrame([("g", "a", "r", "m"), ("g", "b", "x", "m"), ("g", None, "r", "m"), ("h", "a", "r", "m")], kinds)
    given = spark.createDataFrame([("g", "a"), ("g", "c"), ("g", None), ("k", "z"), (None, "z")], "group_id string, sample_id string")
    adv = spark.createDataFrame([("g", "a", "r", "q"), ("g", "b", "r", "m"), ("g", "b", "x", "m"), ("h", "a", "r", "m")], kinds)
    found = rollout.group_issues(samples, given, adv)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    want = [
        ("duplicate_sample_id", "a"), ("duplicate_reward_sample_id", "z"), ("duplicate_advantage_sample_id", "a"), ("duplicate_advantage_sample_id", "b"), ("group_record_mismatch", "g"),
        ("reward_without_sample", "c"), ("reward_without_sample", None), ("advantage_without_reward", "b"), ("advantage_without_reward", "b"), ("advantage_role_mismatch", "a"), ("advantage_record_mismatch", "b"),
    ]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_walks_read_a_graph_once(spark, tmp_path):
    """Turns were worked out anew for each part of a graph, the adjacency held twelve joins, and a label's text
    was normalized up to three times."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"On day {t} I saw place {c}") for c in range(4) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    nodes, edges = graph_queries.graph_of(spark, str(tmp_path))
    assert _times(nodes, "sha1") < 8 and _times(edges, "regexp_replace") == 1
    adj = walks.adjacency(nodes, edges)
    assert adj._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4
    ends = {(r.node_id, r.next_id, r.edge_ord, r.traversal) for r in adj.collect()}
    hubs = {r.node_id for r in access.generic_entities(nodes).collect()}
    kept = [e for e in edges.collect() if not (hubs & {e.source, e.target} and e.edge_type in ("FACT_SUBJECT", "FACT_OBJECT", "MENTIONS"))]
    assert len(hubs) == 2 and ends == {x for e in kept for x in ((e.source, e.target, e.edge_ord, "out"), (e.target, e.source, e.edge_ord, "in"))}
    assert adj.count() == 2 * len(kept) and walks.adjacency(nodes, edges, directed=True).count() == len(kept)
    assert str(C.clip("t", 5)).count("regexp_replace") == 1
    got = spark.createDataFrame([("a  b",), ("abcdefgh",), ("abc  defg",), (None,)], "t string").select(C.clip("t", 5).alias("c")).collect()
    assert [r.c for r in got] == ["a b", "ab...", "ab...", ""]


def test_alignment_parses_a_text_once(spark):
    """A manifest line was parsed for each rule, and a batch's JSON worked out for each forbidden name."""
    lines = [("a", 1, '{"record_id": "x"}'), ("a", 2, ' {"record_id": "y"} '), ("a", 3, "no"), ("a", 4, "[1]"), ("a", 5, None), ("a", 6, "{}"), ("b", 1, '{"record_id": "x"}'), ("c", 1, '{"record_id": "x"}'), (None, 1, "no")]
    paths = [("a", "manifest.jsonl"), ("a", "groups"), ("a", "groups"), ("a", "groups/x.memory_group.json"), ("a", "groups/x.question_group.json"), ("c", "manifest.jsonl"), ("c", "summary.json"), (None, "groups")]
    deep = ['{"p": "\\n [{\\"raw_history\\": 1}]", "q": "raw_history"}', '"{\\"gold_answer\\": [0]}"', '{"p": "\\u007b\\"gold_answer\\": 1}", "gold_answer": null}', "raw_history", '["raw_history", {"a": {"reward_report": {"gold_answer": 2}}}]', None]
    batches = [("a", "x", f"r{i}", t) for i, t in enumerate(deep)] + [("a", "z", "r", deep[0]), ("c", "x", "r", deep[0])]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    rollouts = frame([("a",), ("a",), ("b",), ("c",), (None,)], "rollout_id string")
    got = inspection.inspect_alignment(rollouts, frame(lines, "rollout_id string, line_num int, line string"), frame(paths, "rollout_id string, path string"), frame(batches, "rollout_id string, record_id string, role string, json string"))
    want = [
        ("b", None, "missing_manifest", None), (None, None, "missing_manifest", None), ("a", None, "missing_summary", None), ("a", None, "invalid_manifest_line", "3"), ("a", None, "invalid_manifest_line", "4"), ("a", None, "invalid_manifest_line", "5"),
        ("c", "x", "missing_groups_dir", None), *[("a", r, f"missing_{k}_group", None) for r in ("y", "None") for k in ("memory", "question")],
        ("a", "x", "unsafe_actor_batch", "r0: batch.p[0].raw_history"), ("a", "x", "unsafe_actor_batch", "r1: batch.gold_answer"), ("a", "x", "unsafe_actor_batch", "r2: batch.p.gold_answer"), ("a", "x", "unsafe_actor_batch", "r4: batch.[1].a.reward_report, batch.[1].a.reward_report.gold_answer"),
    ]
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(((r.rollout_id, r.record_id, r.code, r.what) for r in got.collect()), key=key) == sorted(want, key=key)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_runs_look_their_paths_up_once(spark):
    """Every rule looked all paths up anew, and a task of the union held all of their sorts."""
    runs = [(1, "/a", "train", ["x", "y", None]), (2, "/b", "dev", None), (3, "/c", "train", ["x"]), (4, None, "train", ["x"]), (5, "/e", None, [])]
    whole = ["/multi_case_rollout_manifest.json", "/records", "/aggregate", "/aggregate/replay_buffer.jsonl", "/aggregate/aggregated_replay_manifest.json"]
    more = [f"/aggregate/actor_batches{f}" for f in ("", "/memory_builder.update_batch.json", "/memory_builder.batch_manifest.json", "/question_agent.batch_manifest.json")]
    paths = [f"/a{p}" for p in whole + more] + ["/a/records/x", "/a/records/x", "/b/multi_case_rollout_manifest.json", "/b/records", "/c/records", "/e/multi_case_rollout_manifest.json", "/e/aggregate", "/r1"]
    records = [(1, "x", "succeeded", "/r1", True, 2e6), (1, "y", "succeeded", "/r2", None, 0.0), (1, "z", "failed", "/r3", None, math.nan), (3, "x", "succeeded", "/r4", False, 2e6), (9, "x", "succeeded", "/r5", False, 2e6), (2, "x", "succeeded", "", True, 1.0)]
    unsafe = [("/a/aggregate/actor_batches/memory_builder.batch_manifest.json", None), ("/a/aggregate/actor_batches/question_agent.batch_manifest.json", True), ("/c/aggregate/actor_batches/memory_builder.batch_manifest.json", False)]
    got = inspection.inspect_runs(
        spark.createDataFrame(runs, "run_id long, run_dir string, split string, selected_record_ids array<string>"),
        spark.createDataFrame(records, "run_id long, record_id string, status string, final_report_path string, no_leakage_passed boolean, memory_reward_mean double"),
        spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(unsafe, "path string, no_leakage_passed boolean"), strict=True,
    )
    want = [(1, "missing_artifact", w) for w in ("record.y", None, "question_agent.update_batch", "report.y")] + [(2, "missing_artifact", "aggregate"), (3, "missing_artifact", "manifest"), (4, "missing_artifact", "manifest")]
    want += [(5, "missing_artifact", w) for w in ("records", "replay_buffer", "replay_manifest")] + [(1, "invalid_reward", f"{r}.memory_reward_mean") for r in "xz"] + [(1, "leakage_risk", "records"), (1, "leakage_risk", "memory_builder.batch_manifest")]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.run_id, r.code, r.what) for r in got.collect()), key=key) == sorted(want, key=key)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") < 8
