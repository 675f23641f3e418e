"""Leakage audits over JSON columns, gates, checkpoint checks."""

from __future__ import annotations

import functools
import json
import operator
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import once
from ..sources.durable import durable


def find_keys(df: DataFrame, row_id: str, json_col: str, keys: list[str], edge_targets: bool = False, allow_null: bool = False, loose: bool = False, nested_json: bool = False) -> DataFrame:
    """L1, L2: (row_id, path, key) of every forbidden key at any depth, level by level without Python code.

    ``edge_targets`` lets ``target`` stand directly below ``edges``; ``allow_null`` passes null values; ``loose``
    compares keys without case and punctuation; ``nested_json`` reads on inside strings that hold an object or an
    array, below the path of the string. Rows whose text holds none of the names are left out first, unless it holds a
    backslash, with which a name can be written in another way. Each level is written, so none is read twice."""
    norm = (lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")) if loose else (lambda c: c)
    wanted = [k.lower().replace("_", "").replace("-", "") if loose else k for k in keys]
    # each text is worked out and parsed once a row, however the planner moves the conditions
    rows = df if loose else df.where(once(F.col(json_col), lambda t: functools.reduce(operator.or_, [F.contains(t, F.lit(k)) for k in ["\\", *keys]])))

    def inner(v):
        """``v`` where it has a next level, else null."""
        nests = lambda x: F.when(F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"), x)
        if not nested_json:
            return once(v, nests)
        text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
        return once(v, lambda x: F.coalesce(nests(x), once(F.try_parse_json(text(x)), nests)))

    spark, out = df.sparkSession, None
    level = rows.select(F.col(row_id).alias("row_id"), F.lit("").alias("path"), inner(F.try_parse_json(json_col)).alias("v"))
    while True:
        each = level.withColumnRenamed("path", "parent").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        here = F.when(F.col("key").isNull(), F.concat("parent", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("parent", F.when(F.col("parent") == "", "").otherwise("."), "key"))
        hit = F.coalesce(norm(F.col("key")).isin(*wanted), F.lit(False))
        if edge_targets:
            hit = hit & ~((F.col("key") == "target") & F.col("parent").rlike(r"(^|\.)edges\[\d+\]$"))
        if allow_null:
            hit = hit & ~F.is_variant_null("value")
        met = F.array(F.struct(here.alias("path"), "key", hit.alias("hit"), inner(F.col("value")).alias("v")))
        each = durable(each.select("row_id", F.inline(F.filter(met, lambda m: m["hit"] | m["v"].isNotNull()))))
        found = each.where("hit").select("row_id", "path", "key")
        out = found if out is None else out.unionByName(found)
        level = each.where("v is not null").select("row_id", "path", "v")
        if level.isEmpty():
            return out


def remove_keys(df: DataFrame, json_col: str, keys: list[str], edge_targets: bool = False) -> DataFrame:
    """L3: ``json_col`` without forbidden keys, and ``removed_paths``, in the order they were met; a text that is no JSON
    stays as it is. ``edge_targets`` lets ``target`` stand directly below ``edges``."""
    wanted = frozenset(keys)

    def clean(value, path, removed):
        if isinstance(value, list):
            return [clean(v, f"{path}[{i}]", removed) for i, v in enumerate(value)]
        if not isinstance(value, dict):
            return value
        at = {k: f"{path}.{k}" if path else k for k in value}
        gone = [k for k in value if k in wanted and not (edge_targets and k == "target" and re.search(r"(^|\.)edges\[\d+\]$", path))]
        removed += [at[k] for k in gone]
        return {k: clean(v, at[k], removed) for k, v in value.items() if k not in gone}

    @F.pandas_udf("struct<json:string,removed:array<string>>")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            removed: list[str] = []
            try:
                t = json.dumps(clean(json.loads(t), "", removed), ensure_ascii=False) if t is not None else None
            except ValueError:
                removed = []
            out.append((t, removed))
        return pd.DataFrame(out, columns=["json", "removed"])

    done = df.withColumn("cleaned_", cleaned(F.col(json_col)))
    return done.withColumn(json_col, F.col("cleaned_.json")).withColumn("removed_paths", F.col("cleaned_.removed")).drop("cleaned_")


def leakage_report(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """L4: pass or fail of each stage."""
    per = artifacts.join(findings.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")), "row_id", "left")
    return per.groupBy("stage").agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"), F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("failed")).withColumn("passed", F.col("violations") == 0)


#: What no input of a stage may hold.
STAGE_FORBIDDEN = {
    "memory_builder_input": ["oracle_graph", "benchmark_target_question", "benchmark_question", "benchmark_answer", "gold_answer", "test_label", "generated_training_question", "reward_report"],
    "question_agent_training_input": ["benchmark_target_question", "benchmark_question", "benchmark_answer", "test_label"],
    "answerer_input": ["raw_history", "oracle_graph", "benchmark_answer", "gold_answer"],
    "trainer_batch": ["benchmark_target_question", "benchmark_question", "benchmark_answer", "gold_answer", "test_label"],
}


def stage_audit(artifacts: DataFrame) -> DataFrame:
    """L4: (experiment, path, stage, split, field) of forbidden fields in ``artifacts`` (experiment, path, stage, split,
    json): each field of the stage's set once, at whatever depth it stands and with any value; ``__unreadable_json__``
    for a text that is null or no JSON. Stages without a set have no forbidden field. Texts are read once for all
    stages."""
    keys = sorted({k for ks in STAGE_FORBIDDEN.values() for k in ks})
    rows = artifacts.withColumn("_id", F.struct("experiment", "path", "stage", "split"))
    found = find_keys(rows, "_id", "json", keys).select("row_id.*", "key").distinct()
    sets = F.create_map(*[x for stage, ks in STAGE_FORBIDDEN.items() for x in (F.lit(stage), F.array(*[F.lit(k) for k in ks]))])
    field = found.where(F.array_contains(sets[F.col("stage")], F.col("key"))).withColumnRenamed("key", "field")
    lost = artifacts.where(F.try_parse_json("json").isNull()).select("experiment", "path", "stage", "split", F.lit("__unreadable_json__").alias("field"))
    return field.unionByName(lost)


def audit_report(artifacts: DataFrame, issues: DataFrame) -> DataFrame:
    """L4: per experiment files scanned, issues, files with an issue and ``passed`` or ``failed``."""
    per = issues.groupBy("experiment").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("path").alias("bad_files"))
    out = artifacts.groupBy("experiment").agg(F.count(F.lit(1)).alias("scanned_files")).hint("merge").join(per.hint("merge"), "experiment", "left").na.fill(0, ["issues", "bad_files"])
    return out.withColumn("status", F.when(F.col("issues") > 0, "failed").otherwise("passed"))


def batch_gate(batches: DataFrame) -> DataFrame:
    """Reasons against training on a batch."""
    rules = [(F.col("split") != "train", "not_train_split"), (~F.col("manifest_passed"), "manifest_failed"), (F.col("violations") > 0, "leakage"), (F.col("items") == 0, "empty")]
    return batches.withColumn("reasons", F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules])))


#: What an updated checkpoint of the local backend must have, and how grave it is if the path leads nowhere.
CHECKPOINT_PARTS = {"model": "error", "tokenizer": "warning", "optimizer": "warning"}


def checkpoint_issues(checkpoints: DataFrame, paths: DataFrame | None = None, often: int = 100_000) -> DataFrame:
    """(checkpoint_id, code, severity): ids that stand several times, and for each checkpoint paths that are
    missing. ``paths`` (path) lists what exists; without it only empty paths are found. Of the backend ``local_hf`` an
    updated checkpoint needs a model, a tokenizer and an optimizer. Columns that the table lacks count as empty. Paths that
    more than ``often`` checkpoints name are looked up once each and handed to all tasks (there is one at most in
    ``often`` rows), as their rows would all meet in one."""
    held = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in checkpoints.columns else F.lit(None).cast("string")
    local = F.coalesce(held("backend"), F.lit("")) == "local_hf"
    part_paths = [f"{p}_path" for p in CHECKPOINT_PARTS]
    rows = checkpoints.select("checkpoint_id", F.coalesce("updated", F.lit(False)).alias("updated"), local.alias("local"), *[held(c).alias(c) for c in ("checkpoint_path", *part_paths)])
    twice = rows.groupBy("checkpoint_id").count().where("count > 1").select("checkpoint_id", F.lit("duplicate_checkpoint_id").alias("code"), F.lit("error").alias("severity"))
    issue = lambda test, code, severity: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    rules = [issue(F.col("updated") & F.col("checkpoint_path").isNull(), "missing_path", "error")]
    rules += [issue(F.col("local") & F.col("updated") & F.col(f"{p}_path").isNull(), f"missing_{p}_for_updated_checkpoint", "error") for p in CHECKPOINT_PARTS]
    found = rows.select("checkpoint_id", F.explode(F.array_compact(F.array(*rules))).alias("i")).select("checkpoint_id", "i.code", "i.severity")
    out = twice.unionByName(found)
    if paths is None:
        return out
    named = [F.struct(F.lit("checkpoint").alias("part"), F.lit("error").alias("severity"), F.col("checkpoint_path").alias("path"))]
    named += [F.struct(F.lit(p).alias("part"), F.lit(s).alias("severity"), F.when(F.col("local"), F.col(f"{p}_path")).alias("path")) for p, s in CHECKPOINT_PARTS.items()]
    each = rows.select("checkpoint_id", F.explode(F.array(*named)).alias("p")).select("checkpoint_id", "p.*").where("path is not null")
    listed = paths.select("path").distinct()
    shared = each.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select("path")
    shared = durable(shared.hint("merge").join(listed.withColumn("there", F.lit(True)).hint("merge"), "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("there")))
    marked = each.join(F.broadcast(shared), "path", "left")
    rare = marked.where("there is null").drop("there")
    lost = rare.hint("merge").join(listed.hint("merge"), "path", "left_anti").unionByName(marked.where("not there").drop("there"))
    return out.unionByName(lost.select("checkpoint_id", F.concat("part", F.lit("_path_not_found")).alias("code"), "severity"))


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The newest of each actor: by round, step, whether it was updated, source batch, path and id."""
    ties = [F.coalesce(F.col(c), F.lit("")) for c in ("source_batch_id", "checkpoint_path") if c in checkpoints.columns]
    keys = [F.col("round_id"), F.col("step_id"), F.col("updated"), *ties, F.col("checkpoint_id")]
    order = Window.partitionBy("actor_role").orderBy(*[k.desc() for k in keys])
    return checkpoints.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
