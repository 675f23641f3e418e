"""Run, round and multi-seed analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import unit_hash


def run_metrics(record_runs: DataFrame, key: str = "split") -> DataFrame:
    """Z1."""
    ok = F.col("status") == "succeeded"
    r = F.when(ok, F.col("reward"))
    return record_runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.avg(r).alias("reward_mean"), F.min(r).alias("reward_min"), F.max(r).alias("reward_max"),
    )


def rollup_status(runs: DataFrame, key: str, kind: str = "record") -> DataFrame:
    """The status of a whole from its parts, by the rules of its kind.

    ``record``: running if any part is; succeeded, failed or pending if all are; else partial. ``round``: failed if any
    is, then running, succeeded if all are, partial if any is, else pending. ``suite``: succeeded or failed if all are,
    else partial. ``actor``: parts read ok, failed or none (there was nothing to do): ok if all are, partial if some
    are, skipped if all had nothing to do, else failed."""
    every = lambda x: F.bool_and(F.col("status") == x)
    some = lambda x: F.bool_or(F.col("status") == x)
    ladders = {
        "record": ([(some, "running"), (every, "succeeded"), (every, "failed"), (every, "pending")], "partial"),
        "round": ([(some, "failed"), (some, "running"), (every, "succeeded"), (some, "partial")], "pending"),
        "suite": ([(every, "succeeded"), (every, "failed")], "partial"),
    }
    if kind == "actor":
        status = F.when(every("ok"), "ok").when(some("ok"), "partial").when(every("none"), "skipped").otherwise("failed")
    else:
        steps, last = ladders[kind]
        (test, first), *rest = steps
        status = F.when(test(first), first)
        for test, x in rest:
            status = status.when(test(x), x)
        status = status.otherwise(last)
    return runs.groupBy(key).agg(status.alias("status"))


def seed_metrics_long(wide: DataFrame, metrics: list[str], methods: tuple[str, ...] = ("baseline", "ablation")) -> DataFrame:
    """Z3: one row per seed, method and metric; a known prefix names the method, no prefix the final one."""
    long = wide.unpivot(["seed", "status"], metrics, "name", "value")
    prefix = F.regexp_extract("name", f"^({'|'.join(methods)})_(.*)$", 1)
    rest = F.regexp_extract("name", f"^({'|'.join(methods)})_(.*)$", 2)
    return long.select("seed", "status", F.when(prefix == "", "final").otherwise(prefix).alias("method"), F.when(prefix == "", F.col("name")).otherwise(rest).alias("metric"), "value")


def suite_stats(long: DataFrame) -> DataFrame:
    """Statistics over succeeded seeds; the deviation of a single value is 0."""
    sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    n = F.count("value")
    return long.where("status = 'succeeded' and value is not null").groupBy("method", "metric").agg(
        n.alias("n"), F.avg("value").alias("mean"), sd.alias("std"), (sd / F.sqrt(n)).alias("stderr"), F.min("value").alias("min"), F.max("value").alias("max"), F.median("value").alias("median")
    )


def paired_deltas(long: DataFrame, primary: str) -> DataFrame:
    """Primary minus baseline of the same seed and metric."""
    ok = long.where("status = 'succeeded' and value is not null")
    a = ok.where(F.col("method") == primary).select("seed", "metric", F.col("value").alias("a"))
    b = ok.where(F.col("method") != primary).select("seed", "metric", F.col("method").alias("baseline"), F.col("value").alias("b"))
    return a.join(b, ["seed", "metric"]).select("seed", "metric", "baseline", (F.col("a") - F.col("b")).alias("delta"))


def bootstrap_ci(deltas: DataFrame, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Interval of the mean delta by resampling, for three pairs or more. Each draw is a hashed position, so a
    replicate is an equi-join and an average."""
    key = ["metric", "baseline"]
    w = Window.partitionBy(*key)
    rows = deltas.withColumns({"pos": F.row_number().over(w.orderBy("seed")) - 1, "n": F.count(F.lit(1)).over(w)}).where("n >= 3")
    draws = rows.select(*key, "n", F.col("pos").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("rep"))
    at = F.least(F.floor(unit_hash(F.lit(seed), "metric", "baseline", "rep", "slot") * F.col("n")), F.col("n") - 1)
    means = draws.withColumn("pos", at).hint("merge").join(rows.select(*key, "pos", "delta").hint("merge"), [*key, "pos"]).groupBy(*key, "rep").agg(F.avg("delta").alias("m"))
    ranked = means.withColumn("rn", F.row_number().over(w.orderBy("m", "rep")) - 1)
    low, high = (int(round(p * (resamples - 1))) for p in ((1 - level) / 2, 1 - (1 - level) / 2))
    return ranked.groupBy(*key).agg(F.max(F.when(F.col("rn") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("rn") == high, F.col("m"))).alias("high"))


def incomplete_beta(a, b, x):
    """The regularized incomplete beta function as a column expression, by its continued fraction (modified Lentz), on
    the side of the mean where that converges fast; good to some 1e-11 for the a and b of t tests."""
    tiny, steps = F.lit(1e-300), 400
    a, b, x = (F.lit(v).cast("double") if isinstance(v, int | float) else v.cast("double") for v in (a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1 - x).otherwise(x)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(acc, i):
        m = F.floor(i / 2).cast("double")
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        numerator = F.when(i % 2 == 0, even).otherwise(odd)
        d = 1 / safe(1 + numerator * acc["d"])
        c = safe(1 + numerator / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    first = 1 / safe(1 - (p + q) * y / (p + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    h = F.aggregate(F.sequence(F.lit(2), F.lit(steps)), start, step)["h"]
    value = F.exp(p * F.log(y) + q * F.log(1 - y) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) * h / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(flip, 1 - value).otherwise(value))


def _log_gamma(z):
    """Stirling's series after a shift by eight, good to 1e-12 for z > 0."""
    shift = 8
    w = z + shift
    series = sum((F.lit(c) / F.pow(w, F.lit(2 * k + 1)) for k, c in enumerate((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360))), F.lit(0.0))
    product = z
    for k in range(1, shift):
        product = product * (z + k)
    return (w - 0.5) * F.log(w) - w + 0.9189385332046727 + series - F.log(product)


def t_statistic(deltas: DataFrame) -> DataFrame:
    """One-sample t of the mean delta and its two-sided p-value; null without spread or with fewer than two pairs."""
    sd, n = F.stddev_samp("delta"), F.count("delta")
    out = deltas.groupBy("metric", "baseline").agg(n.alias("n"), F.avg("delta").alias("mean_delta"), F.when((n > 1) & (sd > 0), F.avg("delta") / (sd / F.sqrt(n))).alias("t"))
    df = F.col("n") - 1
    p = incomplete_beta(df / 2, 0.5, df / (df + F.col("t") * F.col("t")))
    return out.withColumn("p_value", F.when(F.col("t").isNotNull(), p))


def early_stop(rounds: DataFrame, key: str, metric: str, patience: int, min_delta: float) -> DataFrame:
    """Best value so far and rounds since it improved by more than ``min_delta``; a smaller gain doesn't move it."""
    ordered = rounds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("round_id", F.col(metric).alias("v")))).alias("r"))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(-1).cast("long").alias("best_round"), F.lit(0).cast("long").alias("since"))

    def step(acc, x):
        better = x["v"] > acc["best"] + min_delta
        return F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), F.when(better, x["round_id"].cast("long")).otherwise(acc["best_round"]).alias("best_round"), F.when(better, F.lit(0).cast("long")).otherwise(acc["since"] + 1).alias("since"))

    folded = ordered.select(key, F.aggregate("r", start, step).alias("s"))
    return folded.select(key, "s.best", "s.best_round", "s.since", (F.col("s.since") >= patience).alias("stop"))


def select_checkpoints(steps: DataFrame, dev: DataFrame, min_pass: float = 0.8, max_regression: float = 0.02) -> DataFrame:
    """The checkpoint of each round that goes on, and why or why not.

    ``steps`` (round_id, actor, status, checkpoint_id, train_reward), one row per round and actor; ``dev`` (round_id,
    dev_status, records, pass_rate, dev_reward), one row per round at most. Without a dev run, or with one of no
    records, every successful checkpoint goes on; else the dev run must have succeeded at least in part, pass the
    leakage gate, and not fall behind the training reward."""
    rows = steps.join(dev, "round_id", "left")
    reason = (
        F.when((F.col("status") != "succeeded") | (F.coalesce("checkpoint_id", F.lit("")) == ""), "no_successful_checkpoint")
        .when(F.col("dev_status").isNull(), "latest_successful_no_dev")
        .when(~F.col("dev_status").isin("succeeded", "partial"), "dev_status")
        .when(F.col("records") == 0, "latest_successful_empty_dev")
        .when(F.coalesce("pass_rate", F.lit(0.0)) < min_pass, "low_pass_rate")
        .when(F.col("train_reward") - F.col("dev_reward") > max_regression, "regression")
        .otherwise("latest_successful_with_dev_gate")
    )
    out = rows.select("round_id", "actor", "checkpoint_id", F.coalesce(reason, F.lit("no_successful_checkpoint")).alias("reason"))
    return out.withColumn("selected", F.col("reason").startswith("latest_successful"))


def learning_curves(rounds: DataFrame, key: str, metric: str) -> DataFrame:
    """The values of each seed in order of rounds."""
    return rounds.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("round_id", F.col(metric).alias("v")))), lambda x: x["v"]).alias("curve"))


#: The measures of a learning curve.
CURVE_METRICS = ("train_memory_reward_mean", "train_question_reward_mean", "dev_memory_reward_mean", "dev_question_reward_mean")
#: Methods of a report in its order, and the note beside each.
REPORT_METHODS = {"no_llm_memory": "baseline", "initial_checkpoint": "before training", "final_checkpoint": "trained"}
METHOD_NAMES = {"no_llm_memory": "No-LLM Memory", "initial_checkpoint": "Initial Model", "final_checkpoint": "Final Model"}
BAR_METRICS = ("test_memory_reward_mean", "test_question_reward_mean")


def curve_points(rounds: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, seed, place, round_id, ``CURVE_METRICS``) of the runs (key, seed, status) that succeeded: one row a
    point, ``place`` from 0 in order of rounds, so no row holds a curve. Measures that ``rounds`` lacks are null."""
    done = runs.where("status = 'succeeded'").select(key, "seed")
    place = F.row_number().over(Window.partitionBy(key).orderBy("round_id")) - 1
    measures = [(F.col(m) if m in rounds.columns else F.lit(None)).cast("double").alias(m) for m in CURVE_METRICS]
    return rounds.select(key, "round_id", *measures).hint("merge").join(done.hint("merge"), key).select(key, "seed", place.alias("place"), "round_id", *CURVE_METRICS)


def _four(c):
    """``c`` with four decimals, as the exact binary value rounds, halves to even: 7.00395 is a little less than it reads.
    Both halves of its digits have exact products with 10000, so the sign of what is left beside k + 0.5 is exact."""
    size = F.abs(c)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    k = F.floor(size * 10000)
    rest = (high * 10000 - (k + 0.5)) + (size - high) * 10000
    n = k + F.when((rest > 0) | ((rest == 0) & (k % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(c.cast("string").startswith("-"), "-").otherwise(""), F.format_string("%d.%04d", F.floor(n / 10000), n % 10000))
    return F.when(size < 1e11, text).otherwise(F.format_string("%.4f", c))


def _cell(mean, std):
    return F.when(mean.isNull(), "N/A").when(std.isNull() | (std == 0), _four(mean)).otherwise(F.concat(_four(mean), F.lit(" ± "), _four(std)))


def report_table(stats: DataFrame) -> DataFrame:
    """P20: ``mean ± std`` with four decimals; the mean alone without a spread, ``N/A`` without a mean."""
    return stats.select("method", "metric", _cell(F.col("mean"), F.col("std")).alias("cell"))


def _by_method(stats: DataFrame, by: list[str], values: list) -> DataFrame:
    """A row for each known method, with its place in the report."""
    place = F.array_position(F.array(*[F.lit(m) for m in REPORT_METHODS]), F.col("method"))
    return stats.where(F.col("method").isin(*REPORT_METHODS)).groupBy(*by, "method").agg(*values).withColumn("place", place)


def suite_report(stats: DataFrame, by: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """P20: the table of results, one row for each method of ``REPORT_METHODS`` that ``stats`` (method, metric, mean, std,
    count; and ``by``, the columns that tell suites apart) holds: place, name, cells of memory reward, question reward and
    the leakage pass rate (no spread), seeds and a note. ``names`` sets other display names."""
    of = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    cells = [_cell(of(m, "mean"), of(m, "std")).alias(n) for m, n in zip(BAR_METRICS, ("memory_reward", "question_reward"), strict=True)]
    cells += [_cell(of("test_no_leakage_pass_rate", "mean"), F.lit(None)).alias("no_leakage"), F.coalesce(of(BAR_METRICS[0], "count"), F.lit(0)).alias("seeds")]
    told = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("method")]
    return _by_method(stats, by or [], cells).withColumns({"name": told(METHOD_NAMES | (names or {})), "notes": told(REPORT_METHODS)})


def bar_chart(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and standard error (``stderr``) of both rewards on the test split for each known method, in place order."""
    bars = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(n) for m in BAR_METRICS for c, n in (("mean", m), ("stderr", m.replace("_mean", "_stderr")))]
    return _by_method(stats, by or [], bars)


def pending_runs(planned: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Planned runs that have not succeeded; all of them when forced."""
    return planned if force else planned.join(done.where("status = 'succeeded'").select(key).distinct(), key, "left_anti")


#: The columns of a round's metrics.
ROUND_METRICS = (
    "train_memory_reward_mean", "train_question_reward_mean", "dev_memory_reward_mean", "dev_question_reward_mean", "train_no_leakage_pass_rate", "dev_no_leakage_pass_rate",
    "input_memory_builder_checkpoint_id", "input_question_agent_checkpoint_id", "selected_memory_builder_checkpoint_id", "selected_question_agent_checkpoint_id",
)
TEST_METRICS = ("test_memory_reward_mean", "test_question_reward_mean", "test_no_leakage_pass_rate")


def experiment_metrics(experiments: DataFrame, rounds: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Per experiment its rounds by status, the best reward on dev and its round (of equal ones the earliest), and
    whether it stopped early: fewer rounds done than asked for, without having failed. ``experiments`` holds (key,
    status, rounds_requested, rounds_completed); one without rounds has zeros and nulls."""
    n = lambda status: F.count_if(F.col("status") == status).alias(f"num_rounds_{status}")
    reward = F.when(~F.isnan("dev_memory_reward_mean"), F.col("dev_memory_reward_mean"))
    best = F.max(F.when(reward.isNotNull(), F.struct(reward.alias("reward"), (-F.col("round_id")).alias("place")))).alias("best")
    per = rounds.groupBy(key).agg(n("succeeded"), n("failed"), n("partial"), best)
    rows = experiments.join(per.hint("merge"), key, "left")
    count = lambda status: F.coalesce(f"num_rounds_{status}", F.lit(0)).alias(f"num_rounds_{status}")
    early = (F.col("rounds_completed") < F.col("rounds_requested")) & (F.col("status") != "failed")
    return rows.select(
        key, *[count(s) for s in ("succeeded", "failed", "partial")], F.col("best.reward").alias("best_dev_memory_reward_mean"), (-F.col("best.place")).alias("best_dev_round_id"),
        early.alias("early_stopped"),
    )


def round_metrics(rounds: DataFrame) -> DataFrame:
    """A row per round: id, status, ``ROUND_METRICS`` (null where the reports lack them), and how many warnings and
    errors it has."""
    held = lambda c: F.col(c) if c in rounds.columns else F.lit(None).cast("string" if c.endswith("_id") else "double").alias(c)
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return rounds.select("round_id", "status", *[held(c) for c in ROUND_METRICS], count("warnings").alias("num_warnings"), count("errors").alias("num_errors"))


def method_comparison(evaluations: DataFrame) -> DataFrame:
    """(place, method, status, test metrics) of evaluations on the test split: baselines by name, ``unknown``
    where they have none, then the final checkpoint. ``evaluations`` holds (kind, name, split, status, metrics), kind
    ``final`` or ``baseline``; other splits' rows go. Few rows by nature: one per method."""
    rows = evaluations.where("split = 'test'")
    final = F.col("kind") == "final"
    method = F.when(final, "final_checkpoint").otherwise(F.coalesce("name", F.lit("unknown")))
    order = Window.orderBy("last", "method", "status", *TEST_METRICS)
    named = rows.select(final.cast("int").alias("last"), method.alias("method"), "status", *TEST_METRICS)
    return named.select((F.row_number().over(order)).alias("place"), "method", "status", *TEST_METRICS)
