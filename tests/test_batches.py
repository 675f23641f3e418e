"""Batches of actors in every layout, against plain Python; forbidden keys inside strings and at fixed places."""

import json

from memengine.operators import audit, batches

ITEM = {"group_id": "g", "role": "memory_builder", "x": 1}
BATCHES = [
    ("r1", 0, {"actor_role": "memory_builder", "items": [ITEM, {"role": "question_agent"}, {"selected_for_update": False}]}),
    ("r2", 0, {"role": "memory_builder", "batch_id": "b7", "samples": [{"group_id": ""}, {"group_id": "k", "role": "memory_builder"}]}),
    ("r3", 0, {"groups": [{"group_id": "h", "samples": [{"selected_for_update": True}, {"role": "question_agent"}]}, {"group_id": "empty"}], "items": [ITEM]}),
    ("r4", 0, {"actor_role": "question_agent", "items": [ITEM]}),
    ("r5", 0, {"items": "no list", "groups": {}}),
    ("r1", 1, {"items": [ITEM, ITEM]}),
]


def table(spark, rows=BATCHES):
    return spark.createDataFrame([(r, o, json.dumps(b)) for r, o, b in rows] + [("r6", 0, "no json"), ("r7", 0, None), ("r8", 0, "[1]")], "record_id string, batch_ord int, batch string")


def test_three_layouts_in_one_table(spark):
    merged = batches.merged_samples(table(spark), "memory_builder")
    got = sorted((r.record_id, r.batch_ord, r.layout, r.entry, r.place, r.group_id, r.selected, r["sample"] is None) for r in merged.collect())
    assert [g for g in got if g[2] == "items"] == [
        ("r1", 0, "items", 0, None, "r1_g", True, False), ("r1", 0, "items", 2, None, "r1_", False, False),
        ("r1", 1, "items", 0, None, "r1_g", True, False), ("r1", 1, "items", 1, None, "r1_g", True, False), ("r3", 0, "items", 0, None, "r3_g", True, False),
    ]
    assert [g[5] for g in got if g[2] == "samples"] == ["r2_b7", "r2_k"]
    assert sorted(g[3:] for g in got if g[2] == "groups" and g[4] is not None) == [(0, 0, "r3_h", True, False), (0, 1, "r3_h", False, False)]
    assert [g[3:] for g in got if g[2] == "groups" and g[4] is None] == [(1, None, "r3_empty", False, True)]
    assert batches.merge_totals(merged).first() == (2, 9, 7)
    assert batches.unmerged(table(spark), merged, "memory_builder").count() == 0
    assert [tuple(r) for r in batches.unmerged(table(spark), merged.where("record_id <> 'r2'").unionByName(merged.where("record_id = 'r3'")), "memory_builder").orderBy("record_id").collect()] == [("r2", 0, 2, 0), ("r3", 0, 3, 6)]
    nothing = batches.merged_samples(table(spark).limit(0), "memory_builder")
    assert nothing.count() == 0 and batches.merge_totals(nothing).first() == (0, 0, 0)


def test_keys_at_fixed_places(spark):
    bad = {
        "oracle_graph": None,
        "items": [{"question_type": 1, "metadata": {"reward_report": {}, "deep": {"oracle_node": 1}}}, {"metadata": "text"}],
        "groups": [{"benchmark_answer": "", "samples": [{"test_label": 1, "context": {"oracle_edge": []}}, {"oracle_node": 0}]}],
    }
    rows = table(spark, [("r", 0, bad)])
    found = lambda role: sorted(r.path for r in batches.batch_violations(rows, role).collect())
    assert found("memory_builder") == ["batch.oracle_graph", "groups[0].benchmark_answer", "groups[0].samples[0].context.oracle_edge", "groups[0].samples[1].oracle_node", "items[0].metadata.reward_report", "items[0].question_type"]
    assert found("question_agent") == found("another") == ["groups[0].benchmark_answer", "groups[0].samples[0].test_label"]


def test_json_inside_strings(spark):
    inner = json.dumps([{"a": json.dumps({"answer": 1})}, "answer", "{broken answer"])
    docs = [("x", json.dumps({"p": {"text": inner}, "q": "\"answer\""})), ("y", json.dumps(json.dumps({"answer": {"answer": 2}}))), ("z", "answer"), ("n", None)]
    df = spark.createDataFrame(docs, "id string, j string")
    found = lambda nested: sorted((r.row_id, r.path) for r in audit.find_keys(df, "id", "j", ["answer"], nested_json=nested).collect())
    assert found(True) == [("x", "p.text[0].a.answer"), ("y", "answer"), ("y", "answer.answer")] and found(False) == []
