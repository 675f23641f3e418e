"""Replay buffers of many records on small fixtures."""

import pytest

from memengine.operators import replay

ITEMS = "record_id string, round_id int, step_id int, memory_builder_checkpoint_id string, question_agent_checkpoint_id string, ingest_ord int, memory_reward double, no_leakage_passed boolean, selected_for_training boolean, diagnostic_tags array<string>, memory_reward_report_path string"


def items(spark):
    rows = [
        ("a", 1, 0, "m", None, 1, 0.5, True, True, ["low_memory_reward"], "/p1"), ("a", 1, 0, "m", "", 2, 0.9, True, True, [], "/p2"), ("a", 2, 0, "m", None, 3, 0.9, False, True, [], None),
        ("b", 1, 0, None, None, 4, None, True, False, ["weakness_updated"], "/p9"), ("c", 1, 0, None, None, 5, 0.1, True, True, None, ""), ("d", 1, 0, None, None, 6, 0.1, True, True, None, "/p1"),
    ]
    return spark.createDataFrame(rows, ITEMS)


def test_aggregate_of_records(spark):
    records = spark.createDataFrame([("a", "succeeded"), ("b", "succeeded"), ("c", "failed"), ("e", None)], "record_id string, status string")
    kept, m = replay.aggregate_replay(items(spark), records, "train")
    assert [r.ingest_ord for r in kept.collect()] == [1]
    want = {"num_replay_items": 1, "num_train_items": 1, "num_eval_only_items": 0, "no_leakage_pass_count": 1, "num_duplicates_removed": 1, "num_source_records": 2, "num_skipped_records": 2, "duplicate_keys": ["a:1:0:m:none"]}
    assert m.first().asDict() == want
    kept, m = replay.aggregate_replay(items(spark), records, "dev")
    assert sorted(r.ingest_ord for r in kept.collect()) == [1, 4] and (m.first().num_eval_only_items, m.first().num_train_items) == (2, 0)
    with pytest.raises(ValueError, match="a:1:0:m:none"):
        replay.aggregate_replay(items(spark), records, "train", strict=True)
    empty = replay.aggregate_replay(items(spark).limit(0), records, "train", strict=True)[1].first()
    assert (empty.num_replay_items, empty.num_duplicates_removed, empty.num_source_records, empty.duplicate_keys) == (0, 0, 2, [])
    assert replay.replay_manifest(items(spark), kept).first()[:] == (6, 5, 5, 2, 4)


def test_stage_before_training(spark):
    records = spark.createDataFrame([(x,) for x in "abcdf"], "record_id string")
    paths = spark.createDataFrame([("/p2",)], "path string")
    got = {r.record_id: r for r in replay.replay_stage(records, items(spark), paths).collect()}
    assert {k: (r.status, r.error, r.num_replay_items, r.missing_reports) for k, r in got.items()} == {"a": ("failed", "leakage", 3, 1), "b": ("failed", "none_selected", 1, 0), "c": ("succeeded", None, 1, 0), "d": ("succeeded", None, 1, 1), "f": ("failed", "no_items", 0, 0)}
    assert (got["a"].num_low_memory_reward, got["b"].num_weakness_updated) == (1, 1)
    free = replay.replay_stage(records, items(spark), paths, require_memory_reward=False)
    assert free.where("record_id = 'b'").first().status == "succeeded"
