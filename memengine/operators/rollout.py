"""Reward matrices, group-relative advantages and training rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable
from . import retrieval, rewards

EPS = 1e-6


def pair_cells(memory_samples: DataFrame, question_samples: DataFrame) -> DataFrame:
    """A1: every memory sample of a record with every question sample of it; no questions accepted: rejected."""
    cells = memory_samples.select("record_id", "memory_sample_id").join(question_samples.select("record_id", "question_sample_id", "accepted_question_count"), "record_id")
    return cells.withColumn("status", F.when(F.col("accepted_question_count") > 0, "pending").otherwise("rejected"))


def marginal_rewards(cells: DataFrame) -> DataFrame:
    """A3: (record_id, role, sample_id, reward): means over ok cells, 0 without any."""
    ok = F.col("status") == "ok"
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    m = cells.groupBy("record_id", F.lit("memory_builder").alias("role"), F.col("memory_sample_id").alias("sample_id")).agg(mean("memory_reward").alias("reward"))
    q = cells.groupBy("record_id", F.lit("question_agent").alias("role"), F.col("question_sample_id").alias("sample_id")).agg(F.when(F.max("accepted_question_count") > 0, mean("question_reward")).otherwise(0.0).alias("reward"))
    return m.unionByName(q)


def advantages(rewards: DataFrame, group: str = "group_id", reward: str = "reward", order: str = "sample_id", normalize: bool = True, eps: float = EPS) -> DataFrame:
    """A4, A5: (r - mean) over the population deviation of the group; 0 in groups of one or without spread, which are
    not selected. ``rank_in_group`` from the largest reward, ties by ``order``."""
    w = Window.partitionBy(group)
    out = rewards.withColumns({"group_mean": F.avg(reward).over(w), "group_std": F.stddev_pop(reward).over(w), "group_n": F.count(F.lit(1)).over(w)})
    flat = (F.col("group_n") < 2) | (F.col("group_std") <= eps)
    diff = F.col(reward) - F.col("group_mean")
    value = F.when(F.col("group_n") < 2, 0.0).when(F.col("group_std") <= eps, 0.0).otherwise(diff / F.col("group_std")) if normalize else F.when(F.col("group_n") < 2, 0.0).otherwise(diff)
    return out.withColumns({"advantage": value, "selected_for_update": ~flat, "rank_in_group": F.row_number().over(w.orderBy(F.desc(reward), order))})


def group_summary(rewards: DataFrame, group: str = "group_id", reward: str = "reward", eps: float = EPS) -> DataFrame:
    """Count, mean, deviation, extremes and status of each group."""
    std = F.stddev_pop(reward)
    n = F.count(reward)
    return rewards.groupBy(group).agg(
        n.alias("n"), F.avg(reward).alias("mean"), std.alias("std"), F.min(reward).alias("min"), F.max(reward).alias("max"),
        F.when(n == 0, "all_failed").when(n < 2, "too_few").when(std <= eps, "zero_variance").otherwise("ok").alias("status"),
    )


def update_items(adv: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected advantages with their prompt and response; and those whose sample is missing."""
    chosen = adv.where("selected_for_update")
    return chosen.join(samples.select("sample_id", "prompt", "response"), "sample_id"), chosen.join(samples, "sample_id", "left_anti")


def group_issues(samples: DataFrame, rewards: DataFrame, advantages: DataFrame | None = None) -> DataFrame:
    """(code, path): ids that stand several times in a table, groups over several records or roles, rewards
    without a sample of their group, advantages without a reward of theirs, and rewards or advantages that give another
    record or role than the samples of their group. A group without samples (rewards) lets its rewards (advantages)
    pass. Columns ``group_id``, ``record_id`` and ``role`` are compared where both tables have them."""
    tables = {"sample": samples, "reward": rewards} | ({} if advantages is None else {"advantage": advantages})
    grouped = [c for c in ("record_id", "role") if c in samples.columns]
    names, keyed = list(tables), all("group_id" in t.columns for t in tables.values())
    own = lambda t, c: F.col(c) if c in t.columns else F.lit(None).cast(samples.schema[c].dataType).alias(c)
    rows = [t.select("sample_id", F.lit(i).alias("_t"), *([own(t, c) for c in ("group_id", *grouped)] if keyed else [])) for i, t in enumerate(tables.values())]
    rows = functools.reduce(DataFrame.unionByName, rows)
    of = lambda i: F.col("_t") == i
    issue = lambda test, code, path: F.when(test, F.struct(F.lit(code).alias("code"), F.col(path).cast(kind).alias("path")))
    listed = lambda df, rules: df.select(F.explode(F.array_compact(F.array(*rules))).alias("i")).select("i.*")
    kind = rows.schema["sample_id"].dataType
    if "group_id" in samples.columns:
        kind = samples.select("group_id").union(rows.select("sample_id")).schema[0].dataType
    counts = rows.groupBy("sample_id").agg(*[F.count_if(of(i)).alias(f"n{i}") for i in range(len(names))])
    found = [listed(counts, [issue(F.col(f"n{i}") > 1, f"duplicate_{'' if n == 'sample' else n + '_'}sample_id", "sample_id") for i, n in enumerate(names)])]
    if keyed:
        # all rows of a group meet once, sorted by sample; every rule is read off there
        group, same = Window.partitionBy("group_id"), Window.partitionBy("group_id", "sample_id")
        at = {f"_s{i}": F.max(of(i)).over(same) for i in range(len(names) - 1)} | {f"_g{i}": F.max(of(i)).over(group) for i in range(len(names) - 1)}
        at |= {f"_{m}_{c}": getattr(F, m)(F.when(of(0), F.col(c))).over(group) for c in grouped for m in ("min", "max")}
        met = rows.withColumns(at | {"_n": F.row_number().over(group.orderBy("sample_id"))})
        placed = F.col("group_id").isNotNull()
        rules = [issue((F.col("_n") == 1) & (F.col(f"_min_{c}") != F.col(f"_max_{c}")), f"group_{c.removesuffix('_id')}_mismatch", "group_id") for c in grouped]
        for i, (above, name) in enumerate(zip(names, names[1:])):
            held = F.col(f"_s{i}") & F.col("sample_id").isNotNull()
            rules.append(issue(of(i + 1) & placed & F.col(f"_g{i}") & ~held, f"{name}_without_{above}", "sample_id"))
            rules += [issue(of(i + 1) & placed & (F.col(c) != F.col(f"_min_{c}")), f"{name}_{c.removesuffix('_id')}_mismatch", "sample_id") for c in grouped if c in tables[name].columns]
        return found[0].unionByName(listed(met, rules))
    pick = lambda df, code, path: df.select(F.lit(code).alias("code"), F.col(path).alias("path"))
    for c in grouped:
        per = samples.groupBy("group_id").agg(F.min(c).alias("a"), F.max(c).alias("b")).where("a <> b")
        found.append(pick(per, f"group_{c.removesuffix('_id')}_mismatch", "group_id"))
    for above, name in zip(names, names[1:]):
        held, t = tables[above], tables[name]
        same_group = "group_id" in held.columns and "group_id" in t.columns
        on = ["group_id", "sample_id"] if same_group else ["sample_id"]
        lost = t.hint("merge").join(held.select(*on).distinct().hint("merge"), on, "left_anti")
        if same_group:
            lost = lost.hint("merge").join(held.select("group_id").distinct().hint("merge"), "group_id", "left_semi")
        found.append(pick(lost, f"{name}_without_{above}", "sample_id"))
    for name in names[1:]:
        t = tables[name]
        for c in grouped:
            if c in t.columns and "group_id" in t.columns:
                whole = samples.groupBy("group_id").agg(F.min(c).alias("want"))
                other = t.hint("merge").join(whole.hint("merge"), "group_id").where(F.col(c) != F.col("want"))
                found.append(pick(other, f"{name}_{c.removesuffix('_id')}_mismatch", "sample_id"))
    return functools.reduce(DataFrame.unionByName, found)


def token_rows(items: DataFrame, max_prompt: int | None = None, max_response: int | None = None, truncation: str = "right") -> DataFrame:
    """A10: character ids with a start id, masks, and reward and advantage spread over the response. Texts too long
    are cut on the given side, or dropped into an error with ``error``; without a limit nothing is cut. Blank responses
    go."""
    ids = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x) % 256)

    def cut(arr, n):
        if n is None:
            return arr
        if truncation == "error":
            return F.when(F.size(arr) > n, F.raise_error(F.lit("text exceeds its limit"))).otherwise(arr)
        return F.when(F.size(arr) > n, F.slice(arr, F.size(arr) - n + 1, n) if truncation == "left" else F.slice(arr, 1, n)).otherwise(arr)

    rows = items.where("trim(response) <> ''").withColumn("prompt_ids", cut(F.concat(F.array(F.lit(1)), ids("prompt")), max_prompt)).withColumn("response_ids", cut(ids("response"), max_response))
    n, m = F.size("prompt_ids"), F.size("response_ids")
    rows = rows.withColumns({"input_ids": F.concat("prompt_ids", "response_ids"), "loss_mask": F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), m)), "position_ids": F.sequence(F.lit(0), n + m - 1)})
    return rows.withColumns({"token_rewards": F.array_repeat(F.col("reward") / m, m), "token_advantages": F.array_repeat(F.col("advantage") / m, m)})


def pad_rows(rows: DataFrame, batch: str, column: str = "input_ids", pad: int = 0) -> DataFrame:
    """Right-padded to the longest row of the batch."""
    most = F.max(F.size(column)).over(Window.partitionBy(batch))
    return rows.withColumn(column, F.concat(column, F.array_repeat(F.lit(pad), (most - F.size(column)).cast("int"))))


def with_returns(rows: DataFrame, strategy: str = "advantages_as_returns") -> DataFrame:
    """``returns`` of each token and the ``returns_strategy`` that gave them: the advantages, or rewards plus
    advantages (``rewards_plus_advantages``; without rewards the advantages alone); without advantages zeros, one per
    input id."""
    if strategy not in ("advantages_as_returns", "rewards_plus_advantages"):
        raise ValueError(f"unknown returns strategy: {strategy}")
    if "token_advantages" not in rows.columns:
        return rows.withColumns({"returns": F.array_repeat(F.lit(0.0), F.size("input_ids")), "returns_strategy": F.lit("zero_returns")})
    if strategy == "rewards_plus_advantages" and "token_rewards" in rows.columns:
        return rows.withColumns({"returns": F.zip_with("token_rewards", "token_advantages", lambda r, a: r + a), "returns_strategy": F.lit(strategy)})
    return rows.withColumns({"returns": F.col("token_advantages"), "returns_strategy": F.lit("advantages_as_returns")})


def batch_stats(items: DataFrame, key: str) -> DataFrame:
    """A13."""
    return items.groupBy(key).agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("samples"), F.count_if("selected_for_update").alias("selected"), F.avg("reward").alias("reward_mean"), F.stddev_pop("reward").alias("reward_std"))


def trainer_metrics(steps: DataFrame) -> DataFrame:
    """Mean, least and largest of each metric per actor."""
    return steps.groupBy("actor", "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def trainer_step_metrics(reports: DataFrame, key: str = "step_id", steps: DataFrame | None = None) -> DataFrame:
    """Per step its status, how many actors were requested, succeeded, failed and skipped, and over those that
    succeeded mean, least and largest loss, mean divergence and reward, and each actor's own. Nulls are left out; a
    measure that no actor has is null. Status: that of all actors if they agree on succeeded, skipped or failed,
    ``partial`` if not, ``pending`` for a step of ``steps`` without a report."""
    ok = F.col("status") == "succeeded"
    of = lambda c: F.when(ok, F.col(c))
    own = [F.max(F.when(ok & (F.col("actor_role") == r), F.col(c))).alias(f"{r}_{c}") for r in ("memory_builder", "question_agent") for c in ("loss", "reward_mean", "approx_kl")]
    agreed = [F.when(F.count_if(F.col("status") == s) == F.count(F.lit(1)), s) for s in ("succeeded", "skipped", "failed")]
    counts = [F.count(F.lit(1)).alias("num_actors_requested"), *[F.count_if(F.col("status") == s).alias(f"num_actors_{s}") for s in ("succeeded", "failed", "skipped")]]
    means = [F.avg(of("loss")).alias("mean_loss"), F.min(of("loss")).alias("min_loss"), F.max(of("loss")).alias("max_loss"), F.avg(of("approx_kl")).alias("mean_approx_kl"), F.avg(of("reward_mean")).alias("mean_reward")]
    out = reports.groupBy(key).agg(F.coalesce(*agreed, F.lit("partial")).alias("status"), *counts, *means, *own)
    if steps is None:
        return out
    whole = steps.select(key).distinct().hint("merge").join(out.hint("merge"), key, "left")
    return whole.na.fill("pending", ["status"]).na.fill(0, [f"num_actors_{s}" for s in ("requested", "succeeded", "failed", "skipped")])


def score_cells(cells: DataFrame, memory: DataFrame, summaries: DataFrame, questions: DataFrame, oracle: DataFrame) -> DataFrame:
    """A2: every cell of A1 scored in one plan: (record_id, memory_sample_id, question_sample_id,
    accepted_question_count, status, memory_reward, question_reward).

    ``memory`` and ``summaries`` carry a ``memory_sample_id``, ``questions`` a ``question_sample_id``, ``oracle`` none. A
    question is retrieved for, answered and judged once per memory sample of its record: those steps see a memory sample
    as a record, and a question belongs to one question sample only. What a cell's reward sums up is put together from
    these. Cells without accepted questions stay rejected, without rewards."""
    live = cells.where("accepted_question_count > 0").select("record_id", "memory_sample_id", "question_sample_id")
    samples = live.select("record_id", "memory_sample_id").distinct()
    as_record = lambda df: df.drop("record_id", "sample_id").withColumnRenamed("memory_sample_id", "record_id")
    used = lambda df: df.join(samples.hint("shuffle_hash"), ["record_id", "memory_sample_id"], "left_semi")
    nodes, texts = durable(as_record(used(memory))), durable(as_record(used(summaries)))
    full = F.concat_ws("|", "question_sample_id", "question_id").alias("question_id")
    asked = questions.join(live.hint("merge"), ["record_id", "question_sample_id"])
    asked = durable(asked.select(F.col("memory_sample_id").alias("record_id"), full, *[c for c in questions.columns if c not in ("record_id", "question_sample_id", "question_id")], "question_sample_id"))
    truth = durable(as_record(oracle.select("record_id", "node_id", "node_type", "text").join(samples.hint("merge"), "record_id")))
    answers = durable(retrieval.baseline_answers(asked, retrieval.retrieve(asked, nodes)))
    items = durable(rewards.question_items(asked.drop("question_sample_id"), answers, truth, nodes, texts))
    # a cell takes the place of the record from here on
    cell = F.concat_ws("|", "memory_sample_id", "question_sample_id")
    of_memory = live.select(F.col("memory_sample_id").alias("record_id"), cell.alias("cell"))
    in_cells = lambda df: df.join(of_memory.hint("merge"), "record_id").drop("record_id").withColumnRenamed("cell", "record_id")
    by_question = lambda df: df.withColumn("record_id", F.concat_ws("|", "record_id", F.substring_index("question_id", "|", 1)))
    judged = by_question(items)
    components = rewards.components(judged, in_cells(durable(rewards.memory_parts(nodes, texts))), live.select(cell.alias("record_id")))
    memory_reward = rewards.memory_rewards(components).select("record_id", F.col("total_reward").alias("memory_reward"))
    verdicts = judged.select("record_id", "question_id", F.lit("accept").alias("verdict"))
    question_reward = rewards.question_rewards(by_question(asked), verdicts, judged, in_cells(truth.select("record_id"))).select("record_id", F.col("total_reward").alias("question_reward"))
    both = memory_reward.hint("merge").join(question_reward.hint("merge"), "record_id", "left")
    keyed = cells.withColumn("_cell", cell).hint("merge").join(both.withColumnRenamed("record_id", "_cell").hint("merge"), "_cell", "left")
    return keyed.select("record_id", "memory_sample_id", "question_sample_id", "accepted_question_count", F.when(F.col("memory_reward").isNotNull(), "ok").otherwise(F.col("status")).alias("status"), "memory_reward", "question_reward")
