"""Repaired proposals, mergeable summaries and p-values."""

import itertools
import json

from pyspark.sql import functions as F

from memengine.operators import incremental, proposals, suite


def test_proposals_are_repaired(spark):
    entity = {"surface": " Ann  Lee ", "canonical_name": None, "entity_type": "person", "confidence": 7}
    facts = [{"subject": "ann lee", "predicate": "loves", "object": "tea", "text": " a \n b "}, {"subject": "x", "object": "", "text": "t"}, {"object": "y", "text": "t"}, {"subject": "x", "object": "y", "text": None}, None]
    rows = [(1, json.dumps({"importance": -3, "entities": [entity, {"entity_type": "robot", "canonical_name": "Tea"}, {"surface": " "}, None], "facts": facts})), (2, "no json"), (3, None), (4, "[1]"), (5, json.dumps({"memory_worthy": False, "importance": 4, "topic": "t", "reason": "r", "entities": None}))]
    out = {r["k"]: r for r in proposals.tied_facts(proposals.sanitize_event_analyses(spark.createDataFrame(rows, "k int, raw string"))).collect()}
    one = out[1]
    assert (one["valid"], one["importance"], one["memory_worthy"], one["event_category"], one["reason"]) == (True, 1, True, "general", "")
    assert [tuple(e) for e in one["entities"]] == [("Ann Lee", "Ann Lee", "person", 1.0), ("Tea", "Tea", "other", 0.8)]
    assert [(f["subject"], f["predicate"], f["object"], f["text"], f["confidence"]) for f in one["facts"]] == [("Ann Lee", "other", "Tea", "a b", 0.8)]
    assert one["tied"] == 2
    for k in (2, 3, 4):
        assert (out[k]["valid"], out[k]["importance"], out[k]["entities"], out[k]["facts"]) == (False, 3, [], [])
    assert (out[5]["memory_worthy"], out[5]["importance"], out[5]["topic"], out[5]["reason"]) == (False, 4, "t", "r")


def test_summaries_merge_in_any_order(spark):
    rows = [("a", 1.0, ["x", "y"]), ("a", None, []), ("b", 2.0, ["x"]), ("a", 4.0, ["x"]), ("b", None, None), ("c", None, [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, v double, failure_types array<string>")
    parts = [incremental.batch_totals(df.where(F.col("i") % 3 == m), ["k"], ["v"]) for m in range(3)]
    due = {"a": (3, 2.5, {"x": 2, "y": 1}), "b": (2, 2.0, {"x": 1}), "c": (1, None, {})}
    for order in itertools.islice(itertools.permutations(parts), 0, None, 2):
        merged = incremental.merged_totals(incremental.merged_totals(*order[:2], keys=["k"]), order[2], keys=["k"])
        assert {r["k"]: (r["n"], r["average_v"], r["failures"]) for r in incremental.averages(merged, ["v"]).collect()} == due
    assert incremental.merged_totals(incremental.batch_totals(df.where("false"), ["k"], ["v"]), keys=["k"]).count() == 0


def test_p_values_of_known_tables(spark):
    known = [(12.706204736432095, 1, 0.05), (2.262157162740992, 9, 0.05), (3.169272672616872, 10, 0.01), (0.0, 5, 1.0), (2.0, 10, 0.07338803477074095)]
    df = spark.createDataFrame([(t, float(n), p) for t, n, p in known], "t double, n double, due double")
    got = df.select(F.abs(suite.incomplete_beta(F.col("n") / 2, 0.5, F.col("n") / (F.col("n") + F.col("t") * F.col("t"))) - F.col("due")).alias("e")).collect()
    assert max(r["e"] for r in got) < 1e-9
    flat = spark.createDataFrame([("m", "b", 1.0), ("m", "b", 1.0), ("one", "b", 2.0)], "metric string, baseline string, delta double")
    assert [r["p_value"] for r in suite.t_statistic(flat).collect()] == [None, None]
