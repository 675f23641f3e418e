"""Replay buffers: keys, filters, deduplication, counts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import coalesce_truthy


def replay_key():
    """``record:round:step:memory checkpoint:question checkpoint``; what is missing reads ``none``."""
    part = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("none"))
    return F.concat_ws(":", part("record_id"), part("round_id"), part("step_id"), part("memory_builder_checkpoint_id"), part("question_agent_checkpoint_id"))


def replay_items(rewards: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Tags and selection of reward results."""
    rows = rewards
    if deltas is not None:
        rows = rows.join(deltas.select("record_id").distinct().withColumn("weak", F.lit(True)), "record_id", "left")
    else:
        rows = rows.withColumn("weak", F.lit(None).cast("boolean"))
    tags = F.array_compact(F.array(F.when(F.col("memory_reward") < 0.5, F.lit("low_memory_reward")), F.when(F.col("weak"), F.lit("weakness_updated")), F.when(F.col("memory_reward").isNull(), F.lit("missing_memory_reward"))))
    return rows.withColumn("diagnostic_tags", tags).withColumn("selected_for_training", F.col("memory_reward").isNotNull()).drop("weak")


def filter_replay(items: DataFrame, split: str, succeeded: DataFrame) -> DataFrame:
    """Train keeps safe, selected rows of records that succeeded; other splits keep safe rows for evaluation."""
    safe = items.where("no_leakage_passed")
    if split == "train":
        return safe.where("selected_for_training").join(succeeded.select("record_id").distinct(), "record_id", "left_semi").withColumn("eval_only", F.lit(False))
    return safe.withColumn("selected_for_training", F.lit(False)).withColumn("eval_only", F.lit(True))


def dedup_replay(items: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The first row of each key by ingestion; and the repeated keys with their counts. ``strict`` fails where a key
    stands twice."""
    keyed = items.withColumn("replay_key", replay_key())
    first = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("replay_key").orderBy("ingest_ord"))).where("rn = 1").drop("rn")
    twice = keyed.groupBy("replay_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if strict and (some := [r.replay_key for r in twice.select("replay_key").limit(5).collect()]):
        raise ValueError(f"duplicate replay keys: {', '.join(sorted(some))}")
    return first, twice


def aggregate_replay(items: DataFrame, records: DataFrame, split: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The buffer of many records' items on a split, and its manifest in one row.

    records (record_id, status). Items of records that did not succeed stay out, the rest goes by ``filter_replay`` and
    ``dedup_replay``. The manifest counts records that succeeded or were skipped, rows for training and for evaluation
    only, rows that passed the leakage check and repeats removed, and names the first ten repeated keys by ingestion."""
    done = records.where("status = 'succeeded'").select("record_id")
    own = items.hint("merge").join(done.distinct().hint("merge"), "record_id", "left_semi")
    kept, twice = dedup_replay(filter_replay(own, split, done), strict)
    repeated = kept.hint("merge").join(twice.hint("merge"), "replay_key")
    first = repeated.select("ingest_ord", "replay_key").orderBy("ingest_ord", "replay_key").limit(10)
    counts = {"num_replay_items": F.lit(1), "num_train_items": (~F.col("eval_only")).cast("int"), "num_eval_only_items": F.col("eval_only").cast("int"), "no_leakage_pass_count": F.coalesce("no_leakage_passed", F.lit(False)).cast("int")}
    ok = F.coalesce(F.col("status") == "succeeded", F.lit(False)).cast("int")
    parts = [
        kept.agg(*[F.sum(c).alias(n) for n, c in counts.items()]),
        twice.agg(F.sum(F.col("n") - 1).alias("num_duplicates_removed")),
        records.agg(F.sum(ok).alias("num_source_records"), F.sum(1 - ok).alias("num_skipped_records")),
        first.agg(F.transform(F.array_sort(F.collect_list(F.struct("ingest_ord", "replay_key"))), lambda x: x["replay_key"]).alias("duplicate_keys")),
    ]
    one = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    names = [*counts, "num_duplicates_removed", "num_source_records", "num_skipped_records"]
    return kept, one.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.first("duplicate_keys", ignorenulls=True).alias("duplicate_keys"))


def sample_replay(items: DataFrame, n: int, tag: str | None = None) -> DataFrame:
    """The first ``n`` by ingestion."""
    rows = items if tag is None else items.where(F.array_contains("diagnostic_tags", tag))
    return rows.orderBy("ingest_ord").limit(n)


def replay_manifest(items: DataFrame, kept: DataFrame) -> DataFrame:
    """Totals before and after deduplication."""
    flags = [F.coalesce(c, F.lit(False)).cast("int").alias(n) for c, n in (("no_leakage_passed", "safe"), ("selected_for_training", "selected"))]
    each = items.select(F.lit(1).alias("rows"), *flags, F.lit(0).alias("kept")).unionAll(kept.select(F.lit(0), F.lit(0), F.lit(0), F.lit(1)))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "safe", "selected", "kept")]
    return each.agg(*sums).withColumn("duplicates_removed", F.col("rows") - F.col("kept"))


def check_replay(items: DataFrame) -> DataFrame:
    """Per record rows, selected and safe rows, and rows by tag."""
    return items.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("selected_for_training").alias("selected"),
        F.count_if(F.col("selected_for_training") & F.col("no_leakage_passed")).alias("selected_safe"),
        *[F.count_if(F.array_contains("diagnostic_tags", t)).alias(t) for t in ("low_memory_reward", "weakness_updated", "missing_memory_reward")],
    )


def replay_stage(records: DataFrame, items: DataFrame, paths: DataFrame, require_memory_reward: bool = True) -> DataFrame:
    """Per record of ``records`` whether training may start: (record_id, status, error, counts, missing_reports).

    ``error`` is ``no_items``, ``none_selected`` (if a memory reward is required) or ``leakage`` (a selected row that has
    not passed), in this order, else null. ``missing_reports`` counts the reports that selected rows name and ``paths``
    (path) lacks; they do not stop a record."""
    tagged = lambda t: F.count_if(F.array_contains("diagnostic_tags", t))
    chosen, safe = F.coalesce("selected_for_training", F.lit(False)), F.coalesce("no_leakage_passed", F.lit(False))
    per = items.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("num_replay_items"), F.count_if(chosen).alias("num_selected_for_training"), tagged("low_memory_reward").alias("num_low_memory_reward"),
        tagged("weakness_updated").alias("num_weakness_updated"), F.count_if(chosen & ~safe).alias("unsafe"),
    )
    named = items.where(chosen).select("record_id", F.nullif("memory_reward_report_path", F.lit("")).alias("path")).where("path is not null")
    lost = named.hint("merge").join(paths.select("path").distinct().hint("merge"), "path", "left_anti").groupBy("record_id").agg(F.count(F.lit(1)).alias("missing_reports"))
    out = records.select("record_id").distinct()
    for part in (per, lost):
        out = out.hint("merge").join(part.hint("merge"), "record_id", "left")
    out = out.na.fill(0)
    error = F.when(F.col("num_replay_items") == 0, "no_items").when((F.col("num_selected_for_training") == 0) & F.lit(require_memory_reward), "none_selected").when(F.col("unsafe") > 0, "leakage")
    return out.withColumns({"error": error, "status": F.when(error.isNull(), "succeeded").otherwise("failed")}).drop("unsafe")


def first_truthy(*names):
    return coalesce_truthy(*names)
