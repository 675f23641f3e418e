"""Memory and summaries that grow step by step equal those built at once."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from memengine.operators import memory, weakness
from memengine.operators.incremental import MemoryTable
from memengine.sources.turns import turns_from_conversations
from memengine.streaming import stateful
from memengine.streaming.streams import stream_turns

TEXTS = ["I like long walks on the beach at night", "solve this now please for me", "short", "I will go to the plan meeting tomorrow morning", None, "My brother lives in a town far away from here", "Translate the following sentence for me and keep every one of its words please"]


def conversations(spark, n=14, seed=3):
    draw = random.Random(seed)
    rows = [(c, t, draw.choice(["user", "user", "assistant", None, "human"]), draw.choice(TEXTS)) for c in range(n) for t in range(draw.randint(1, 9))]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


NODE = ("record_id", "node_id", "node_type", "content", "source_session_ids", "source_event_ids", "node_ord")


def test_slices_equal_one_build(spark, tmp_path):
    turns = turns_from_conversations(conversations(spark)).cache()
    table = MemoryTable(spark, str(tmp_path / "m"))
    assert table.version() == 0 and table.nodes().isEmpty()
    for k in range(1, 5):
        assert table.apply(turns.where(F.col("session_ord") == k)) == k
        kept = memory.retained_turns(turns.where(F.col("session_ord") <= k))
        assert rows_of(table.nodes(), *NODE) == rows_of(memory.memory_nodes(kept), *NODE)
        assert rows_of(table.edges(), "source", "target", "edge_type") == rows_of(memory.memory_edges(kept), "source", "target", "edge_type")
    steps = {r[0]: r[1] for r in table.records().select("record_id", "build_step").collect()}
    assert steps == {r[0]: r[1] for r in turns.groupBy("record_id").agg(F.countDistinct("session_id")).collect()}
    # earlier versions stay as they were
    first = memory.memory_nodes(memory.retained_turns(turns.where("session_ord = 1")))
    assert rows_of(table.nodes(1), *NODE) == rows_of(first, *NODE)
    kept = memory.memory_summaries(memory.memory_nodes(memory.retained_turns(turns)), turns.select("record_id").distinct())
    assert rows_of(table.summaries(), "record_id", "recent_changes", "stable_preferences", "active_plans") == rows_of(kept, "record_id", "recent_changes", "stable_preferences", "active_plans")


def test_slice_that_comes_twice_or_in_parts(spark, tmp_path):
    turns = turns_from_conversations(conversations(spark, 3, 5)).cache()
    table = MemoryTable(spark, str(tmp_path / "m"), by="turn")
    for part in ("turn_id < 3", "turn_id < 3", "turn_id between 2 and 5", "turn_id > 4"):
        table.apply(turns.where(part))
    kept = memory.retained_turns(turns)
    columns = [c for c in NODE if c not in ("node_ord", "source_event_ids")]
    got = table.nodes()
    assert rows_of(got, *columns) == rows_of(memory.memory_nodes(kept), *columns)
    assert rows_of(table.edges().where("edge_type = 'DERIVED_FROM'"), "source", "target") == rows_of(memory.memory_edges(kept).where("edge_type = 'DERIVED_FROM'"), "source", "target")
    # of the turns that came twice only those that memory left out count again
    twice = turns.where("turn_id < 3").join(kept.select("event_id"), "event_id", "left_anti").count() + turns.where("turn_id = 2 or turn_id = 5").join(kept.select("event_id"), "event_id", "left_anti").count()
    assert table.records().agg(F.sum("build_step")).first()[0] == turns.count() + twice


def test_slice_that_died_is_applied_again(spark, tmp_path):
    turns = turns_from_conversations(conversations(spark, 6)).cache()
    table = MemoryTable(spark, str(tmp_path / "m"))
    table.apply(turns.where("session_ord = 1"))
    table.apply(turns.where("session_ord = 2"))
    whole = rows_of(table.nodes(), *NODE)
    shutil.rmtree(tmp_path / "m" / "records" / "version=2")
    assert table.version() == 1
    assert table.apply(turns.where("session_ord = 2")) == 2
    assert rows_of(table.nodes(), *NODE) == whole


def test_limit_on_events_and_bad_slices(spark, tmp_path):
    turns = turns_from_conversations(conversations(spark, 8)).cache()
    cfg = memory.MemoryConfig(max_event_nodes=3)
    table = MemoryTable(spark, str(tmp_path / "m"), cfg)
    for k in range(1, 5):
        table.apply(turns.where(F.col("session_ord") == k))
    assert rows_of(table.nodes(), *NODE) == rows_of(memory.memory_nodes(memory.retained_turns(turns, cfg)), *NODE)
    with pytest.raises(ValueError):
        MemoryTable(spark, str(tmp_path / "x"), by="word").apply(turns)


def run(stream, where, name):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(where / f"{name}-checkpoint")).option("path", str(where / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and not q.isActive


def test_memory_stream_equals_batch(spark, tmp_path):
    rows = conversations(spark, 9, 11).cache()
    parts = rows.randomSplit([0.4, 0.3, 0.3], seed=1)
    files = tmp_path / "in"
    parts[0].coalesce(1).write.mode("append").parquet(str(files))
    parts[1].coalesce(1).write.mode("append").parquet(str(files))
    run(stateful.stream_memory(stream_turns(spark, str(files), 1)), tmp_path, "out")
    # a restart from the checkpoint; one part comes a second time
    parts[0].coalesce(1).write.mode("append").parquet(str(files))
    parts[2].coalesce(1).write.mode("append").parquet(str(files))
    run(stateful.stream_memory(stream_turns(spark, str(files), 1)), tmp_path, "out")
    changes = spark.read.parquet(str(tmp_path / "out")).cache()
    turns = turns_from_conversations(rows).withColumn("event_ord", F.row_number().over(memory.Window.partitionBy("record_id").orderBy("session_id", "turn_id")))
    kept = memory.retained_turns(turns)
    due = memory.memory_nodes(kept).select("record_id", "node_id", "node_type", "content", F.col("source_session_ids")[0].alias("session_id"), F.col("source_event_ids").alias("event_ids"))
    columns = ("record_id", "node_id", "node_type", "content", "session_id", "event_ids")
    assert rows_of(stateful.folded_nodes(changes), *columns) == rows_of(due, *columns)
    assert rows_of(stateful.folded_edges(changes), "source", "target") == rows_of(memory.memory_edges(kept), "source", "target")
    steps = {r[0]: r[1] for r in changes.groupBy("record_id").agg(F.max("build_step")).collect()}
    sessions = {r[0]: r[1] for r in turns.groupBy("record_id").agg(F.countDistinct("session_id")).collect()}
    assert all(steps[k] == sessions[k] for k in steps)


ITEMS = "record_id string, " + stateful.ITEM + ", round_end timestamp"


def test_weakness_stream_equals_rounds_in_batch(spark, tmp_path):
    draw, rounds = random.Random(4), 3
    kinds = ["missing_fact", "wrong_fact", "temporal_error"]
    at = lambda r: datetime.datetime(2024, 1, 1 + r)
    items = [(f"r{k}", f"q{draw.randint(0, 3)}", "other", draw.choice([0.0, 0.25, 0.5]), draw.sample(kinds, draw.randint(0, 2)), [f"n{draw.randint(0, 3)}"], ["s1"], [f"m{i}"], i, r, at(r)) for r in range(1, rounds + 1) for k in range(2) for i in range(5)]
    files = tmp_path / "in"
    draw.shuffle(items)
    for part in (items[:12], items[12:20], items[20:]):
        early = [x for x in part if x[9] < 3]
        spark.createDataFrame(early or part, ITEMS).coalesce(1).write.mode("append").parquet(str(files))
    # the last round, and one item far later that moves the watermark past it
    spark.createDataFrame([x for x in items if x[9] == 3], ITEMS).coalesce(1).write.mode("append").parquet(str(files))
    run(stateful.stream_weaknesses(spark.readStream.schema(ITEMS).parquet(str(files))), tmp_path, "deltas")
    spark.createDataFrame([("far", "q", "other", 0.0, [], [], [], [], 0, 9, at(20))], ITEMS).coalesce(1).write.mode("append").parquet(str(files))
    run(stateful.stream_weaknesses(spark.readStream.schema(ITEMS).parquet(str(files))), tmp_path, "deltas")
    book = spark.createDataFrame([], weakness.BOOK)
    for r in range(1, rounds + 1):
        book = weakness.update_weaknesses(book, spark.createDataFrame([x for x in items if x[9] == r], ITEMS), r)
    got = stateful.current_book(spark.read.parquet(str(tmp_path / "deltas")))
    assert rows_of(got, *weakness.FIELDS) == rows_of(book, *weakness.FIELDS)
    assert spark.read.parquet(str(tmp_path / "deltas")).where("change = 'updated'").count() > 0
