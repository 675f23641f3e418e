"""Small fixtures: expected outcomes of the memory engine's operators."""


import pytest
from pyspark.sql import functions as F

from memengine.functions import columns as C
from memengine.operators import access, audit, graph, memory, questions, replay, retrieval, rewards, rollout, splits, suite, walks, weakness
from memengine.sources import turns as sources
from memengine.sources.durable import durable

TURNS = "record_id string, session_id string, session_ord int, turn_id int, event_ord int, event_id string, speaker string, text string, ts_raw string"


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        ("r", "s1", 1, 0, 1, "e1", "user", "I really prefer green tea in the morning", "2024-01-01"),
        ("r", "s1", 1, 1, 2, "e2", "assistant", "Green tea it is, noted for the morning", "2024-01-01"),
        ("r", "s1", 1, 2, 3, "e3", "user", "My plan is to visit Kyoto next spring", "2024-01-02"),
        ("r", "s2", 2, 0, 4, "e4", "user", "I really prefer green tea in the morning", None),
    ]
    return spark.createDataFrame(rows, TURNS)


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_scalar_functions(spark):
    r = one(
        spark,
        norm=C.normalize_text(F.lit("  a  b\n")),
        canon=C.canonicalize_name(F.lit("--Hello, World--")),
        none=C.canonicalize_name(F.lit("!!")),
        f1=C.token_f1(F.lit("a b"), F.lit("b c")),
        both=C.token_f1(F.lit(""), F.lit("")),
        jac=C.token_jaccard(F.lit("a b!"), F.lit("A b")),
        exact=C.answer_correctness(F.lit("Yes!"), F.lit("yes")),
        inside=C.answer_correctness(F.lit("the answer is green tea today"), F.lit("answer is green")),
        lost=C.answer_correctness(F.lit(""), F.lit("x")),
        score=C.score_1_5(F.lit("2.5"), 3),
        bad=C.score_1_5(F.lit("x"), 3),
        nan=C.finite_or_null(F.lit(float("nan"))),
        a=C.weakness_id(F.lit("r"), F.lit("q"), F.lit("t"), F.array(F.lit("x"), F.lit("y"))),
        b=C.weakness_id(F.lit("r"), F.lit("q"), F.lit("t"), F.array(F.lit("y"), F.lit("x"))),
    )
    assert (r.norm, r.canon, r.none, r.f1, r.both, r.jac, r.exact, r.inside, r.lost) == ("a b", "hello_world", "unknown", 0.5, 1.0, 1.0, 1.0, 0.75, 0.0)
    assert (r.score, r.bad, r.nan) == (2, 3, None) and r.a == r.b


def test_sql_functions(spark):
    C.register_sql(spark)
    row = spark.sql("SELECT normalize_text('  a  b ') AS n, token_jaccard('a b', 'b c') AS j, token_jaccard('', '') AS e, clamp01(3.0D) AS c").first()
    assert row.n == "a b" and abs(row.j - 1 / 3) < 1e-12 and row.e == 1.0 and row.c == 1.0


def test_graph_counts_and_relations(turns):
    nodes, edges = graph.oracle_nodes(turns), graph.oracle_edges(turns)
    kinds = {r.node_type: r["count"] for r in nodes.groupBy("node_type").count().collect()}
    assert kinds == {"session": 2, "event": 4, "topic": 2, "entity": 5, "fact": 4, "abstract_memory": 1}
    types = {r.edge_type: r["count"] for r in edges.groupBy("edge_type").count().collect()}
    assert types["NEXT"] == 3 and types["DUPLICATE_OF"] == 1 and types["SUPPORTS"] == 4
    assert access.graph_integrity(nodes, edges).count() == 0
    assert access.graph_integrity(nodes.where("node_type <> 'session'"), edges).where("code = 'unknown_target'").count() == 4


def test_sessions_do_not_depend_on_row_order(turns):
    nodes, edges = graph.oracle_nodes(turns), graph.oracle_edges(turns)
    a = {tuple(r) for r in access.infer_sessions(nodes, edges).collect()}
    b = {tuple(r) for r in access.infer_sessions(nodes.orderBy(F.desc("node_id")).repartition(3), edges.repartition(5)).collect()}
    assert a == b and {s for _, _, s in a} == {"s1", "s2"}


def test_memory_rules(turns):
    kept = memory.retained_turns(turns)
    assert [r.event_id for r in kept.orderBy("kept_ord").collect()] == ["e1", "e3", "e4"]
    nodes = memory.memory_nodes(kept)
    assert {r.node_type: r["count"] for r in nodes.groupBy("node_type").count().collect()} == {"event": 3, "fact": 3, "summary": 1, "abstract": 1}
    s = memory.memory_summaries(nodes).first()
    assert s.stable_preferences and s.active_plans and "2 sessions and 3 retained" in s.recent_changes
    assert memory.validate_memory(nodes, memory.memory_edges(kept)).count() == 0
    assert memory.retained_turns(turns, memory.MemoryConfig(max_event_nodes=1)).count() == 1
    assert memory.memory_nodes(memory.retained_turns(turns.where("false"))).count() == 0


def test_retrieval_and_rewards(spark, turns):
    nodes = memory.memory_nodes(memory.retained_turns(turns))
    q = spark.createDataFrame([("r", "q1", "prefer green tea", "I really prefer green tea in the morning", "other", ["x"], ["s1", "s2"])], "record_id string, question_id string, question string, answer string, question_type string, supporting_node_ids array<string>, supporting_session_ids array<string>")
    got = retrieval.retrieve(q, nodes, k=2)
    assert [r["rank"] for r in got.orderBy("rank").collect()] == [1, 2] and got.where("score > 0").count() == 2
    gone = retrieval.retrieve(q, nodes.withColumn("status", F.lit("archived")), k=2)
    assert gone.count() == 0
    assert retrieval.baseline_answers(q, gone).first().answer_status == "insufficient_evidence"
    nodes, got = durable(nodes), durable(got)
    oracle = durable(graph.oracle_nodes(turns))
    items = rewards.question_items(q, retrieval.baseline_answers(q, got), oracle, nodes, memory.memory_summaries(nodes))
    row = items.first()
    assert row.correctness == 0.75 and row.citation_quality == 1.0 and row.oracle_coverage == 0.0
    assert "missing_fact" not in row.failure_types
    assert abs(sum(rewards.MEMORY_WEIGHTS.values()) - 1) < 1e-12
    none = rewards.question_items(q, retrieval.baseline_answers(q, got).where("false"), oracle, nodes, memory.memory_summaries(nodes)).first()
    assert none.correctness == 0 and "answerer_insufficient_evidence" in none.failure_types and "missing_multi_session_link" in none.failure_types


def test_non_redundancy_brute_force(spark):
    texts = ["a b c d e f g", "a b c d e f g", "a b c d e f h", "a b c d e f g x", "", "", "p q r"]
    df = spark.createDataFrame([("r", str(i), "active", t) for i, t in enumerate(texts)], "record_id string, node_id string, status string, content string")
    sets = [set(t.split()) for t in texts]
    dup = sum((1 if not (a | b) else len(a & b) / len(a | b)) >= 0.85 for i, a in enumerate(sets) for b in sets[i + 1 :])
    assert abs(rewards.non_redundancy(df).first().non_redundancy - (1 - dup / 21)) < 1e-12


def test_weakness_fold_merges(spark):
    item = lambda q, nodes, c: {"record_id": "r", "question_id": q, "question_type": "t", "correctness": c, "failure_types": ["missing_fact"], "supporting_oracle_node_ids": nodes, "related_session_ids": ["s"], "supporting_memory_ids": []}
    book = weakness.fold([], [item("q1", ["a", "b"], 0.5), item("q2", ["b", "c"], 0.0), item("q3", ["z"], 1.0)], 1)
    assert [w["frequency"] for w in book] == [2, 1] and book[0]["severity"] == 1.0 and book[0]["missing_oracle_node_ids"] == ["a", "b", "c"]
    assert len(weakness.fold(book, [item("q9", ["c"], 0.2)], 2)) == 2


def test_advantages_sum_to_zero(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 3.0), ("g", 3, 3.0), ("h", 4, 2.0), ("k", 5, 1.0), ("k", 6, 1.0)], "group_id string, sample_id int, reward double")
    rows = rollout.advantages(df).collect()
    assert abs(sum(r.advantage for r in rows if r.group_id == "g")) < 1e-9
    assert all(r.advantage == 0 and not r.selected_for_update for r in rows if r.group_id != "g")
    assert {r.group_id: r.status for r in rollout.group_summary(df).collect()} == {"g": "ok", "h": "too_few", "k": "zero_variance"}


def test_splits(spark):
    ids = spark.createDataFrame([(f"r{i}",) for i in range(50)], "record_id string")
    s = splits.random_split(ids)
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 40, "dev": 5, "test": 5}
    assert splits.split_fingerprint(s).first() == splits.split_fingerprint(s.repartition(7)).first()
    rounds = [set(r.record_id for r in splits.round_records(s, "train", k, 15).collect()) for k in range(3)]
    assert all(len(r) == 15 for r in rounds) and not rounds[0] & rounds[1] and rounds[0] & rounds[2]


def test_walk_constraints(turns):
    nodes, edges = durable(graph.oracle_nodes(turns)), durable(graph.oracle_edges(turns))
    sessions = durable(access.infer_sessions(nodes, edges, mode="walk"))
    steps = walks.random_walks(nodes, edges, attempts=20, length=4)
    by = {}
    for r in steps.orderBy("attempt", "step").collect():
        by.setdefault(r.attempt, []).append(r.node_id)
    assert all(a != b for w in by.values() for a, b in zip(w, w[2:]))
    accepted = durable(walks.accept_walks(steps, nodes, sessions, num_walks=5))
    rows = accepted.collect()
    assert rows and len({tuple(r.node_ids) for r in rows}) == len(rows) and all(r.n_nodes >= 2 for r in rows)
    labels = walks.node_labels(nodes)
    q = durable(questions.placeholder_questions(accepted, labels, sessions))
    ok = questions.oracle_validity(q, accepted, labels, sessions, allow_placeholder=True)
    assert {r.verdict for r in ok.collect()} == {"accept"}
    assert {r.verdict for r in questions.oracle_validity(q, accepted, labels, sessions).collect()} == {"reject"}
    lost = questions.oracle_validity(q.withColumn("supporting_node_ids", F.array(F.lit("nope"))), accepted, labels, sessions, allow_placeholder=True).first()
    assert lost.verdict == "reject" and "node_not_found_in_graph" in lost.issues and lost.citation_validity == 0.0


def test_registered_walks_equal_brute_force(spark, turns, monkeypatch):
    import hashlib
    import math

    from memengine.plans import table_queries

    nodes, edges = durable(graph.oracle_nodes(turns)), durable(graph.oracle_edges(turns))
    monkeypatch.setattr(table_queries, "graph_of", lambda spark, sf_dir: (nodes, edges))
    n, sessions, accepted = table_queries.walks_of(spark, "")
    steps = walks.random_walks(nodes, edges, attempts=240, length=5, max_next=1)
    unit = lambda *keys: (int(hashlib.sha256(":".join(map(str, keys)).encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1)
    adj, kind = {}, {r.node_id: r.node_type for r in n.collect()}
    for r in walks.adjacency(nodes, edges).collect():
        adj.setdefault(r.node_id, []).append(r)
    starts = [x for x in sorted(adj) if kind[x] in ("fact", "abstract_memory")] or sorted(adj)
    drawn, first = {}, []
    for attempt in range(1, 241):
        at, prev, run = starts[min(int(unit(42, "r", attempt) * len(starts)), len(starts) - 1)], None, 0
        walk = [at]
        for k in range(1, 5):
            options = [(-math.log(unit(42, "r", attempt, k, o.edge_ord, o.traversal)) / o.weight, o.edge_ord, o.traversal, o.next_id, o.edge_type) for o in adj.get(at, []) if o.next_id != prev and (o.edge_type != "NEXT" or run < 1)]
            if not options:
                break
            best = min(options)
            at, prev, run = best[3], at, run + 1 if best[4] == "NEXT" else 0
            walk.append(at)
        drawn[attempt] = walk
        types = [kind[x] for x in walk]
        if len(walk) >= 2 and {"fact", "abstract_memory"} & set(types) and sum(t in ("topic", "session") for t in types) / len(walk) <= 0.35 and walk not in first:
            first.append(walk)
    got = {}
    for r in steps.orderBy("attempt", "step").collect():
        got.setdefault(r.attempt, []).append(r.node_id)
    assert got == drawn
    assert [r.node_ids for r in accepted.orderBy("trajectory_id").collect()] == first[:8]
    assert sorted(accepted.collect()) == sorted(walks.accept_walks(steps, n, sessions).collect())
    for wanted, tries in ((1, 240), (30, 240), (200, 7), (8, 24)):
        some = walks.accepted_walks(nodes, edges, sessions, num_walks=wanted, attempts=tries, max_next=1)
        assert sorted(some.collect()) == sorted(walks.accept_walks(steps.where(F.col("attempt") <= tries), n, sessions, num_walks=wanted).collect())
    assert walks.accepted_walks(nodes.limit(0), edges, sessions).count() == 0


def test_token_rows_whole_and_cut(spark):
    df = spark.createDataFrame([("ab", "c" * 90 + "d", 1.0, 0.5), ("x", " ", 1.0, 0.5)], "prompt string, response string, reward double, advantage double")
    whole = rollout.token_rows(df).collect()
    assert [r.input_ids for r in whole] == [[1, 97, 98, *[99] * 90, 100]]
    assert rollout.token_rows(df, 2, 3).first().input_ids == [1, 97, 99, 99, 99]
    assert rollout.token_rows(df, 2, 3, "left").first().input_ids == [97, 98, 99, 99, 100]
    with pytest.raises(Exception, match="exceeds its limit"):
        rollout.token_rows(df, None, 3, "error").collect()


def test_canonical_names_of_whole_texts(spark, tmp_path):
    import hashlib

    from memengine.plans import table_queries

    spark.createDataFrame([(1, "a" * 60 + " End"), (2, "a" * 60 + " Other"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.canon_hash for r in table_queries.whole_canonical_names(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha1(t.encode()).hexdigest() for i, t in ((1, "a" * 60 + "_end"), (2, "a" * 60 + "_other"), (3, "unknown"))}


def test_find_keys(spark):
    df = spark.createDataFrame([(1, '{"graph": {"question": "x", "n": [{"gold_answer": 1}]}, "edges": [{"target": "a"}], "target": 2}'), (2, "not json question")], "id int, j string")
    found = {(r.row_id, r.path) for r in audit.find_keys(df, "id", "j", ["question", "gold_answer", "target"], edge_targets=True).collect()}
    assert found == {(1, "graph.question"), (1, "graph.n[0].gold_answer"), (1, "target")}


def test_read_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"question_id": "q7", "query": "why", "sessions": [{"session_id": "s", "turns": [{"role": "user", "content": "hello"}, {"role": "user", "content": ""}, {"from": "bot", "text": "hi"}]}]}]}')
    rec = sources.read_records(spark, str(tmp_path / "a.json"))
    assert rec.select("record_id", "question").first() == ("q7", "why")
    rows = sources.explode_turns(sources.explode_sessions(rec)).orderBy("turn_id").collect()
    assert [(r.turn_id, r.speaker, r.text) for r in rows] == [(0, "user", "hello"), (2, "bot", "hi")]


def test_replay_and_suite(spark):
    df = spark.createDataFrame([("r", 1, None, "a", "", 0.2, True, 1), ("r", 1, None, "a", None, None, True, 2), ("s", 1, 2, "a", "", 0.9, False, 3)], "record_id string, round_id int, step_id int, memory_builder_checkpoint_id string, question_agent_checkpoint_id string, memory_reward double, no_leakage_passed boolean, ingest_ord int")
    items = replay.replay_items(df)
    first, twice = replay.dedup_replay(items)
    assert first.count() == 2 and twice.first().n == 2
    rounds = spark.createDataFrame([("x", i, v) for i, v in enumerate([1.0, 1.05, 1.3, 1.2, 1.25])], "k string, round_id int, v double")
    r = suite.early_stop(rounds, "k", "v", 2, 0.1).first()
    assert (r.best, r.best_round, r.since, r.stop) == (1.3, 2, 2, True)


def test_registered_names_have_unique_columns():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40


def test_escaped_and_deep_keys_are_found(spark):
    deep = "[" * 40 + '{"answer": 1}' + "]" * 40
    df = spark.createDataFrame([(1, '{"a": {"answer": 2}}'), (2, '{"a": {"\\u0061nswer": 2}}'), (3, deep), (4, '{"b": 1}')], "id int, j string")
    found = sorted((r.row_id, r.path[-6:]) for r in audit.find_keys(df, "id", "j", ["answer"]).collect())
    assert found == [(1, "answer"), (2, "answer"), (3, "answer")]


def test_forbidden_keys_are_removed(spark, tmp_path):
    from memengine.sources import artifacts

    (tmp_path / "a.json").write_text('{"record_id": "r", "answer": 1, "nodes": [{"node_id": "n", "gold_answer": "x"}], "edges": [{"source": "n", "target": "n", "edge_type": "NEXT"}]}')
    nodes, edges, findings = artifacts.read_graphs(spark, str(tmp_path), strict=False, sanitize=True)
    assert [r.path for r in findings.collect()] == ["answer", "nodes[0].gold_answer"]
    assert [(r.record_id, r.node_id) for r in nodes.collect()] == [("r", "n")] and [r.target for r in edges.collect()] == ["n"]
    assert artifacts.read_graphs(spark, str(tmp_path))[0].count() == 0


def test_sessions_travel_to_a_fixed_point(spark):
    nodes = spark.createDataFrame([("r", "e", "event", "s1", None), ("r", "f", "fact", None, "e"), ("r", "a", "abstract_memory", None, None), ("r", "b", "abstract_memory", None, None), ("r", "t", "topic", None, None)], "record_id string, node_id string, node_type string, session_id string, source_event_id string")
    edges = spark.createDataFrame([("r", "f", "a", "SUPPORTS"), ("r", "a", "b", "SUPPORTS"), ("r", "b", "t", "BELONGS_TO_TOPIC"), ("r", "b", "a", "SUPPORTS")], "record_id string, source string, target string, edge_type string")
    assert {r.node_id for r in access.infer_sessions(nodes, edges).collect()} == {"e", "f", "a", "b", "t"}


def test_json_lines_and_id_lists(spark, tmp_path):
    from memengine.sources import artifacts

    path = str(tmp_path / "replay")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, tag string")
    artifacts.append_json_lines(rows, path)
    artifacts.append_json_lines(rows.where("id = 2").withColumn("id", F.lit(3)), path)
    (tmp_path / "replay" / "more.json").write_text('\n{"id": 4, "tag": "d"}\nbroken\n')
    got = artifacts.read_json_lines(spark, path, "id bigint, tag string")
    assert sorted((r.id, r.tag) for r in got.collect()) == [(1, "a"), (2, None), (3, None), (4, "d")]
    with pytest.raises(Exception, match="not a record"):
        artifacts.read_json_lines(spark, path, "id bigint, tag string", strict=True).collect()
    (tmp_path / "ids.txt").write_text("b\n# no\n\n a \nb\n")
    ids = artifacts.read_id_list(spark, str(tmp_path / "ids.txt"))
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string")
    assert sorted(r[0] for r in artifacts.chosen_records(records, ids).collect()) == ["a", "b"]
    assert [r[0] for r in artifacts.chosen_records(records, max_records=1).collect()] == ["a"]
