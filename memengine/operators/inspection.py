"""Inspections of runs: rounds, trainer steps, rollouts, their alignment, and releases.

Every function takes tables of many runs at once and returns one row per issue. What exists on storage enters as a table
of paths; columns that a table lacks count as null."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import once
from ..sources.durable import durable
from .audit import find_keys

#: The measures of a round and of an actor that must be finite.
ROUND_REWARDS = ("train_memory_reward_mean", "train_question_reward_mean", "dev_memory_reward_mean", "dev_question_reward_mean")
ROUND_RATES = ("train_no_leakage_pass_rate", "dev_no_leakage_pass_rate")
ACTOR_METRICS = ("reward_mean", "advantage_mean", "loss", "approx_kl", "clip_fraction", "entropy", "learning_rate", "grad_norm", "update_seconds")
ACTORS = ("memory_builder", "question_agent")
#: Manifests of a round, the split that each must stand on, and how grave it is if one is missing.
ROUND_MANIFESTS = (("train_rollout_manifest", "train", "error"), ("trainer_step_manifest", "train", "error"), ("dev_rollout_manifest", "dev", "error"), ("checkpoint_selection", None, "warning"))
#: Fields that no actor may see in an update batch.
BATCH_FORBIDDEN = [
    "oracle_graph", "supporting_node_ids", "oracle_supporting_node_ids", "supporting_trajectory_ids", "gold_answer", "benchmark_answer",
    "benchmark_question", "raw_history", "answer_reports", "reward_report", "validity_reports", "expected_answer",
]
#: What a release must hold.
RELEASE_FILES = ("README.md", "reproduce.sh", "suite_config.resolved.json", "suite_manifest.json", "aggregate_metrics.json", "environment_report.json", "artifact_manifest.json", "checksums.sha256")


def _col(df: DataFrame, name: str, kind: str):
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _filled(df: DataFrame, name: str):
    """A text column, null where empty."""
    return F.nullif(_col(df, name, "string"), F.lit(""))


def _issue(severity: str, code: str, what, test):
    what = F.lit(what) if isinstance(what, str) else what
    return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), what.cast("string").alias("what")))


def _found(df: DataFrame, keys: list[str], rules: list) -> DataFrame:
    """A row for each rule that holds."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("i")).select(*keys, "i.*")


def _infinite(c):
    return F.isnan(c) | (F.abs(c) == float("inf"))


def _lacking(expected: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of ``expected`` whose ``path`` is not listed, unless their ``parent`` (where given) isn't either: what lies in
    a missing folder is no issue of its own."""
    listed = paths.select("path").distinct()
    lost = expected.hint("merge").join(listed.hint("merge"), "path", "left_anti")
    if "parent" not in expected.columns:
        return lost
    return lost.where("parent is null").unionByName(lost.hint("merge").join(listed.select(F.col("path").alias("parent")).hint("merge"), "parent", "left_semi"))


def inspect_rounds(rounds: DataFrame, artifacts: DataFrame | None = None, manifests: DataFrame | None = None, min_pass: float = 0.8) -> DataFrame:
    """(run_id, round_id, severity, code, what) of co-training rounds.

    ``leakage_risk``: a pass rate under ``min_pass``. ``checkpoint_inconsistency``: an actor does not start from what
    the round before selected or, if that selected none, started from. ``invalid_metric``: a measure that is not finite
    or a rate outside 0 to 1. With ``artifacts`` (path): ``missing_artifact`` for the plan and summary in ``output_dir``
    and for each manifest that the round names. With ``manifests`` (path, split): ``split_policy_violation`` for a
    manifest on another split than its own, ``validation_error`` for one that could not be read (no row, or a null
    split)."""
    keys = ["run_id", "round_id"]
    order = Window.partitionBy("run_id").orderBy("round_id")
    rows, rules = rounds, []
    for a in ACTORS:
        started = _filled(rounds, f"input_{a}_checkpoint_id")
        left = F.coalesce(_filled(rounds, f"selected_{a}_checkpoint_id"), started)
        rows = rows.withColumn(f"_{a}", (F.lag(F.lit(1)).over(order) == 1) & ~F.lag(left).over(order).eqNullSafe(started))
        rules.append(_issue("warning", "checkpoint_inconsistency", a, F.col(f"_{a}")))
    for c in ROUND_RATES:
        v = _col(rounds, c, "double")
        rules += [_issue("error", "leakage_risk", c, v < min_pass), _issue("error", "invalid_metric", c, _infinite(v) | (v < 0) | (v > 1))]
    rules += [_issue("error", "invalid_metric", c, _infinite(_col(rounds, c, "double"))) for c in ROUND_REWARDS]
    found = _found(rows, keys, rules)
    named = [F.struct(F.lit(k).alias("what"), F.lit(s).cast("string").alias("want"), F.lit(g).alias("severity"), _filled(rounds, f"{k}_path").alias("path")) for k, s, g in ROUND_MANIFESTS]
    if artifacts is not None:
        folder = _filled(rounds, "output_dir")
        own = [F.struct(F.lit(k).alias("what"), F.lit(None).cast("string").alias("want"), F.lit("warning").alias("severity"), F.concat(folder, F.lit(f"/{k}.json")).alias("path")) for k in ("round_plan", "round_summary")]
        expected = rounds.select(*keys, F.explode(F.array(*own, *named)).alias("e")).select(*keys, "e.*").where("path is not null")
        found = found.unionByName(_lacking(expected, artifacts).select(*keys, "severity", F.lit("missing_artifact").alias("code"), "what"))
    if manifests is not None:
        read = rounds.select(*keys, F.explode(F.array(*named)).alias("e")).select(*keys, "e.what", "e.want", "e.path").where("path is not null and want is not null")
        read = read.hint("merge").join(manifests.groupBy("path").agg(F.max("split").alias("split")).hint("merge"), "path", "left")
        found = found.unionByName(_found(read, keys, [_issue("warning", "validation_error", F.col("what"), F.col("split").isNull()), _issue("error", "split_policy_violation", F.col("what"), F.col("split") != F.col("want"))]))
    return found


def inspect_steps(steps: DataFrame, actors: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """(step_id, severity, code, what) of trainer steps.

    steps (step_id, split, metrics map of doubles); actors (step_id, actor_role, status, no_leakage_passed,
    written_checkpoint_path and ``ACTOR_METRICS``); checkpoints (path, weights_written). ``leakage_risk``: an actor that
    has not passed its leakage check (null: not passed), or weights written on another split than train.
    ``invalid_metric``: a measure of the step or of an actor that is not finite. ``unexpected_state``: a step on train
    without an actor that succeeded."""
    key = ["step_id"]
    held = F.map_entries("metrics") if "metrics" in steps.columns else F.lit(None).cast("array<struct<key:string,value:double>>")
    odd = steps.select("step_id", F.explode(F.filter(held, lambda m: _infinite(m["value"]))).alias("m")).select("step_id", F.lit("error").alias("severity"), F.lit("invalid_metric").alias("code"), F.col("m.key").alias("what"))
    role = F.col("actor_role")
    rules = [_issue("error", "leakage_risk", role, ~F.coalesce(_col(actors, "no_leakage_passed", "boolean"), F.lit(False)))]
    rules += [_issue("error", "invalid_metric", F.concat_ws(".", role, F.lit(c)), _infinite(_col(actors, c, "double"))) for c in ACTOR_METRICS]
    out = odd.unionByName(_found(actors, key, rules))
    done = actors.where("status = 'succeeded'")
    trained = steps.where("split = 'train'").select("step_id")
    idle = trained.hint("merge").join(done.select("step_id").distinct().hint("merge"), "step_id", "left_anti")
    out = out.unionByName(idle.select("step_id", F.lit("warning").alias("severity"), F.lit("unexpected_state").alias("code"), F.lit("no_update").alias("what")))
    if checkpoints is None:
        return out
    wrote = done.select("step_id", "actor_role", _filled(done, "written_checkpoint_path").alias("path")).where("path is not null")
    wrote = wrote.hint("merge").join(steps.where("not (split <=> 'train')").select("step_id").hint("merge"), "step_id")
    wrote = wrote.hint("merge").join(checkpoints.where("weights_written").select("path").distinct().hint("merge"), "path", "left_semi")
    return out.unionByName(wrote.select("step_id", F.lit("error").alias("severity"), F.lit("leakage_risk").alias("code"), F.concat("actor_role", F.lit(".weights_written")).alias("what")))


def inspect_runs(runs: DataFrame, records: DataFrame, artifacts: DataFrame, batch_manifests: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(run_id, severity, code, what) of rollouts over many records.

    runs (run_id, run_dir, split, selected_record_ids); records (run_id, record_id, status, final_report_path,
    no_leakage_passed, memory_reward_mean, question_reward_mean); artifacts (path) lists files and folders;
    batch_manifests (path, no_leakage_passed). A run without its manifest has no further issue. ``missing_artifact``: a
    selected record's folder, a report of a record that succeeded, the replay buffer and its manifest, on train also each
    actor's batch and manifest; what lies in a missing folder is not listed beside it. ``leakage_risk``: an actor's
    manifest that has not passed; if ``strict``, a run in which not all records that succeeded passed.
    ``invalid_reward``: a mean outside -1e6 to 1e6 or not a number. ``passed`` runs are those without a row."""
    at = lambda *parts: F.concat(F.col("run_dir"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    slot = lambda what, path, parent=None: F.struct((F.lit(what) if isinstance(what, str) else what).alias("what"), path.alias("path"), (F.lit(None) if parent is None else parent).cast("string").alias("parent"))
    batches, both = at("/aggregate/actor_batches"), [f"{a}.{k}" for a in ACTORS for k in ("update_batch", "batch_manifest")]
    common = [slot("records", at("/records")), slot("aggregate", at("/aggregate"))]
    common += [slot(k, at(f"/aggregate/{f}"), at("/aggregate")) for k, f in (("replay_buffer", "replay_buffer.jsonl"), ("replay_manifest", "aggregated_replay_manifest.json"))]
    trained = [slot("actor_batches", batches, at("/aggregate"))] + [slot(b, at(f"/aggregate/actor_batches/{b}.json"), batches) for b in both]
    none = F.array().cast("array<struct<what:string,path:string,parent:string>>")
    chosen = F.transform("selected_record_ids", lambda r: slot(F.concat(F.lit("record."), r), at("/records/", r), at("/records")))
    parts = {"manifest": F.array(slot("manifest", at("/multi_case_rollout_manifest.json"))), "common": F.array(*common), "trained": F.when(F.col("split") == "train", F.array(*trained)), "record": chosen}
    of_kind = lambda k: lambda e: F.struct(F.lit(k).alias("kind"), e["what"].alias("what"), e["path"].alias("path"), e["parent"].alias("parent"))
    every = [F.transform(F.coalesce(x, none), of_kind(k)) for k, x in parts.items()]
    slots = runs.select("run_id", F.explode(F.concat(*every)).alias("e")).select("run_id", "e.*")
    ok = records.where("status = 'succeeded'")
    reports = ok.select("run_id", F.lit("report").alias("kind"), F.concat(F.lit("report."), "record_id").alias("what"), _filled(ok, "final_report_path").alias("path"), F.lit(None).cast("string").alias("parent")).where("path is not null")
    # every path of every run is looked up in one join; what is not there, and what later rules ask for, is written
    listed = artifacts.select("path").distinct().withColumn("there", F.lit(True))
    met = slots.unionByName(reports).hint("merge").join(listed.hint("merge"), "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    batch = (F.col("kind") == "trained") & F.col("what").endswith("batch_manifest")
    met = durable(met.where(~F.col("there") | (F.col("kind") == "manifest") | batch))
    state = durable(met.where("kind = 'manifest' and run_id is not null").groupBy("run_id").agg(F.bool_and("there").alias("live")))
    live = state.where("live").select("run_id").hint("merge")
    # a report counts only for a run of the table, as do records below; what lies in a missing folder is not listed
    lost = met.where("not there and kind <> 'manifest'").hint("merge").join(state.hint("merge"), "run_id", "left").where("coalesce(live, kind <> 'report')")
    folders = met.where("not there").select(F.col("path").alias("parent"))
    inside = lost.where("parent is not null").hint("merge").join(folders.hint("merge"), "parent", "left_anti")
    gone = met.where("not there and kind = 'manifest'").select("run_id", "what").unionByName(lost.where("parent is null").select("run_id", "what")).unionByName(inside.select("run_id", "what"))
    out = gone.select("run_id", F.lit("error").alias("severity"), F.lit("missing_artifact").alias("code"), "what")
    wrong = lambda c: ~((_col(records, c, "double") > -1e6) & (_col(records, c, "double") < 1e6))
    means = _found(records, ["run_id"], [_issue("error", "invalid_reward", F.concat_ws(".", "record_id", F.lit(c)), wrong(c)) for c in ("memory_reward_mean", "question_reward_mean")])
    out = out.unionByName(means.hint("merge").join(live, "run_id", "left_semi"))
    if strict:
        failed = ok.where(~F.coalesce("no_leakage_passed", F.lit(False))).select("run_id").distinct().hint("merge").join(live, "run_id", "left_semi")
        out = out.unionByName(failed.select("run_id", F.lit("error").alias("severity"), F.lit("leakage_risk").alias("code"), F.lit("records").alias("what")))
    if batch_manifests is not None:
        unsafe = batch_manifests.where(~F.coalesce("no_leakage_passed", F.lit(False))).select("path").distinct()
        held = met.where(batch & F.col("there")).hint("merge").join(state.hint("merge"), "run_id", "left").where("coalesce(live, true)")
        held = held.hint("merge").join(unsafe.hint("merge"), "path", "left_semi")
        out = out.unionByName(held.select("run_id", F.lit("error").alias("severity"), F.lit("leakage_risk").alias("code"), "what"))
    return out


def inspect_alignment(rollouts: DataFrame, lines: DataFrame, artifacts: DataFrame, batches: DataFrame) -> DataFrame:
    """(rollout_id, record_id, severity, code, what) of rollout folders.

    rollouts (rollout_id); lines (rollout_id, line_num, line) of the manifests, a JSON object each; artifacts (rollout_id,
    path) relative to the folder, files and folders; batches (rollout_id, record_id, role, json). A rollout without
    manifest has no further issue. A line that is no JSON object is an issue, a record whose memory or question group
    is missing another; a batch that holds a forbidden field with a value at any depth, also inside JSON strings, is
    unsafe, with its paths in ``what``."""
    plain = lambda df, severity, code, what=F.lit(None), record=F.lit(None): df.select("rollout_id", record.cast("string").alias("record_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), what.cast("string").alias("what"))
    held = {"manifest": "manifest.jsonl", "summary": "summary.json", "groups": "groups"}
    has = artifacts.where(F.col("path").isin(*held.values())).groupBy("rollout_id").agg(*[F.bool_or(F.col("path") == p).alias(k) for k, p in held.items()])
    each = durable(rollouts.select("rollout_id").distinct().hint("merge").join(has.hint("merge"), "rollout_id", "left").na.fill(False, list(held)))
    live = each.where("manifest")
    out = [plain(each.where("not manifest"), "error", "missing_manifest"), plain(live.where("not summary"), "warning", "missing_summary")]
    # lines are joined and parsed once and written
    read = once(F.try_parse_json(F.trim("line")), lambda v: F.struct(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("_ok"), F.try_variant_get(v, "$.record_id", "string").alias("record_id")))
    rows = lines.select("rollout_id", "line_num", read.alias("r")).hint("merge").join(live.select("rollout_id", "groups").hint("merge"), "rollout_id")
    rows = durable(rows.select("rollout_id", "line_num", "groups", "r.*"))
    out.append(plain(rows.where("not _ok"), "error", "invalid_manifest_line", F.col("line_num")))
    named = rows.where("_ok").select("rollout_id", "groups", F.coalesce("record_id", F.lit("None")).alias("record_id"))
    out.append(plain(named.where("not groups"), "error", "missing_groups_dir", record=F.col("record_id")))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit("groups/"), "record_id", F.lit(f".{k}_group.json")).alias("path")) for k in ("memory", "question")])
    named = named.where("groups")
    grouped = named.select("rollout_id", "record_id", F.explode(kinds).alias("e")).select("rollout_id", "record_id", "e.*")
    lost = grouped.hint("merge").join(artifacts.select("rollout_id", "path").hint("merge"), ["rollout_id", "path"], "left_anti")
    out.append(lost.select("rollout_id", "record_id", F.lit("warning").alias("severity"), F.concat(F.lit("missing_"), "k", F.lit("_group")).alias("code"), F.lit(None).cast("string").alias("what")))
    # only batches of records that a rollout with groups names are read
    held = batches.hint("merge").join(named.select("rollout_id", "record_id").hint("merge"), ["rollout_id", "record_id"], "left_semi")
    held = held.withColumn("_id", F.struct("rollout_id", F.col("record_id").cast("string").alias("record_id"), F.col("role").cast("string").alias("role")))
    unsafe = find_keys(held, "_id", "json", BATCH_FORBIDDEN, allow_null=True, nested_json=True)
    per = unsafe.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("batch."), "path"))), ", ").alias("paths"))
    out.append(per.select(F.col("row_id").alias("b"), "paths").select(F.col("b.rollout_id").cast(rollouts.schema["rollout_id"].dataType).alias("rollout_id"), "b.record_id", F.lit("error").alias("severity"), F.lit("unsafe_actor_batch").alias("code"), F.concat_ws(": ", "b.role", "paths").alias("what")))
    return functools.reduce(DataFrame.unionByName, out)


def verify_release(files: DataFrame, manifests: DataFrame, runs: DataFrame, metrics: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """(release_id, severity, code, what) of releases.

    files (release_id, name); manifests (release_id, suite_id); runs (release_id, status), the runs of a manifest;
    metrics (release_id, suite_id, num_seeds_requested, num_seeds_failed), null counts being 0; configs (release_id,
    final_test_eval, strict_no_leakage). ``missing_file``: a required file. Where both manifest and metrics exist:
    ``suite_id_mismatch``, ``seed_count_mismatch`` (runs against seeds requested), ``failed_count_mismatch`` (failed runs
    that the metrics count otherwise). Settings that are off are warnings: the test split was not evaluated, or leakage
    was not audited strictly."""
    have = files.groupBy("release_id").agg(*[F.bool_or(F.col("name") == n).alias(f"f{i}") for i, n in enumerate(RELEASE_FILES)])
    ids = manifests.select("release_id").union(metrics.select("release_id")).union(files.select("release_id")).distinct()
    out = _found(ids.hint("merge").join(have.hint("merge"), "release_id", "left"), ["release_id"], [_issue("error", "missing_file", n, ~F.coalesce(f"f{i}", F.lit(False))) for i, n in enumerate(RELEASE_FILES)])
    counted = runs.groupBy("release_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"))
    told = metrics.select("release_id", F.col("suite_id").alias("told_id"), F.coalesce("num_seeds_requested", F.lit(0)).alias("requested"), F.coalesce("num_seeds_failed", F.lit(0)).alias("told_failed"))
    both = manifests.select("release_id", "suite_id").hint("merge").join(told.hint("merge"), "release_id").hint("merge").join(counted.hint("merge"), "release_id", "left").na.fill(0, ["runs", "failed"])
    pair = lambda a, b: F.concat_ws("/", F.coalesce(F.col(a).cast("string"), F.lit("")), F.coalesce(F.col(b).cast("string"), F.lit("")))
    rules = [
        _issue("error", "suite_id_mismatch", pair("suite_id", "told_id"), ~F.col("suite_id").eqNullSafe(F.col("told_id"))),
        _issue("error", "seed_count_mismatch", pair("runs", "requested"), F.col("runs") != F.col("requested")),
        _issue("error", "failed_count_mismatch", pair("failed", "told_failed"), (F.col("failed") > 0) & (F.col("failed") != F.col("told_failed"))),
    ]
    out = out.unionByName(_found(both, ["release_id"], rules))
    if configs is None:
        return out
    off = lambda c: ~F.coalesce(_col(configs, c, "boolean"), F.lit(True))
    return out.unionByName(_found(configs, ["release_id"], [_issue("warning", "disabled", c, off(c)) for c in ("final_test_eval", "strict_no_leakage")]))
