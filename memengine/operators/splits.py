"""Dataset splits, their fingerprints and round schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "dev", "test")
#: What a split may do.
POLICY = [("train", True, True), ("dev", False, True), ("test", False, True)]


def _shuffled(records: DataFrame, seed: int, *part: str):
    """Ordinal from 0 by a hash of seed and id: first inside a bucket of the hash, then after all smaller buckets, so
    no task orders all records."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), "record_id").cast("binary"), 256)
    rows = records.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*part, "_b").count()
    before = Window.partitionBy(*part).orderBy("_b") if part else Window.orderBy("_b")
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_before", F.sum("count").over(before) - F.col("count")).withColumn("n", F.sum("count").over(whole)).drop("count")
    ordered = rows.join(F.broadcast(sizes) if not part else sizes.hint("merge"), [*part, "_b"])
    return ordered.withColumn("ord", F.col("_before") + F.row_number().over(Window.partitionBy(*part, "_b").orderBy("_h", "record_id")) - 1).drop("_h", "_b", "_before")


def random_split(records: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """K1: int(n * ratio) records each for train and dev, the rest for test, in hashed order."""
    rows = _shuffled(records.select("record_id"), seed)
    a, b = F.floor(F.col("n") * ratios[0] + 1e-9), F.floor(F.col("n") * ratios[1] + 1e-9)
    return rows.select("record_id", F.when(F.col("ord") < a, "train").when(F.col("ord") < a + b, "dev").otherwise("test").alias("split"))


def explicit_split(records: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K2: the last split that names a record wins; issues for repeats inside and across lists and unknown ids."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    known = lists.hint("merge").join(records.select("record_id").distinct().hint("merge"), "record_id", "left_semi")
    split = known.groupBy("record_id").agg(F.max_by("split", rank).alias("split"))
    twice = lists.groupBy("record_id", "split").count().where("count > 1").select(F.lit("duplicate_in_split").alias("code"), "record_id")
    across = lists.groupBy("record_id").agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit("duplicate_across_splits").alias("code"), "record_id")
    lost = lists.hint("merge").join(records.select("record_id").hint("merge"), "record_id", "left_anti").select(F.lit("unknown_record").alias("code"), "record_id").distinct()
    return split, twice.unionByName(across).unionByName(lost)


#: Hex digits of a line's hash that name its bucket, level by level: 2**20 buckets, 256, one.
BUCKET_DIGITS = (5, 2, 0)
#: The most records whose lines one task hashes as a single text.
WHOLE_RECORDS = 1_000_000


def split_fingerprint(splits: DataFrame, whole: bool = False) -> DataFrame:
    """K4: counts per split and a drift hash of 16 hex digits; a record that is listed twice counts twice.

    The hash is a tree: sorted lines ``split:id`` of a bucket are hashed, then the buckets' hashes of each higher one, so
    no task holds all records and the number of tasks does not depend on them. ``whole`` gives the SHA-256 of all sorted
    lines as one text instead, which other tools can recompute; one task holds the lines then, so it refuses more than
    ``WHOLE_RECORDS`` of them."""
    line = F.concat_ws(":", "split", "record_id")
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    digest = lambda lines, end="": F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), F.lit(end)).cast("binary"), 256)
    if whole:
        n = splits.limit(WHOLE_RECORDS + 1).count()
        if n > WHOLE_RECORDS:
            raise ValueError(f"more than {WHOLE_RECORDS} records: take the tree's hash")
        return splits.agg(*counts, F.substring(digest(line, "\n"), 1, 16).alias("fingerprint"))
    level = splits.select("split", line.alias("line"), F.sha1(line.cast("binary")).alias("b"))
    for digits in BUCKET_DIGITS:
        of = level.withColumn("b", F.substring("b", 1, digits))
        sums = counts if "split" in level.columns else [F.sum(s).alias(s) for s in SPLITS]
        level = of.groupBy("b").agg(digest("line").alias("h"), *sums).withColumn("line", F.concat("b", "h"))
    # no records: no bucket, the hash of nothing
    return level.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SPLITS], F.substring(F.coalesce(F.max("h"), F.sha2(F.lit("").cast("binary"), 256)), 1, 16).alias("fingerprint"))


def split_issues(splits: DataFrame) -> DataFrame:
    """K3: empty splits and fewer than three records."""
    per = splits.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    rules = [(F.col(s) == 0, f"empty_{s}") for s in SPLITS] + [(F.col("n") < 3, "few_records")]
    return per.select(F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules]))).alias("code"))


def split_records(splits: DataFrame, records: DataFrame, graphs: DataFrame) -> DataFrame:
    """K5: each record of a split with what exists for it: ``has_oracle_graph``, and ``has_benchmark_question`` and
    ``has_benchmark_answer``, true where the records' ``question`` and ``answer`` hold more than blanks. Repeated records
    and graphs do no harm."""
    filled = lambda c: F.coalesce(F.bool_or(F.trim(F.col(c).cast("string")) != ""), F.lit(False)) if c in records.columns else F.lit(False)
    told = records.groupBy("record_id").agg(filled("question").alias("has_benchmark_question"), filled("answer").alias("has_benchmark_answer"))
    drawn = graphs.select("record_id").distinct().withColumn("has_oracle_graph", F.lit(True))
    out = splits.hint("merge").join(told.hint("merge"), "record_id", "left").hint("merge").join(drawn.hint("merge"), "record_id", "left")
    return out.na.fill(False, ["has_benchmark_question", "has_benchmark_answer", "has_oracle_graph"])


def validate_split(splits: DataFrame, graphs: DataFrame, missing: str = "error") -> DataFrame:
    """K5: (severity, code, record_id) of a split's records, one row per listing.

    graphs (record_id, graph_record_id): whose file it is and which record the graph inside names; null where the file
    names none, and with ``readable`` false where it could not be read. ``missing_oracle_graph`` has the severity
    ``missing``, ``oracle_graph_record_id_mismatch`` is an error, or a warning for an unreadable file;
    ``duplicate_record_id`` stands once for each listing after a record's first. Of several graphs of a record any that
    fits will do."""
    can = F.coalesce("readable", F.lit(True)) if "readable" in graphs.columns else F.lit(True)
    fits = F.bool_or(can & F.col("record_id").eqNullSafe(F.col("graph_record_id")))
    held = graphs.groupBy("record_id").agg(fits.alias("fits"), F.bool_or(can).alias("read"))
    rows = splits.select("record_id").hint("merge").join(held.hint("merge"), "record_id", "left")
    issue = lambda df, severity, code: df.select(severity.alias("severity"), F.lit(code).alias("code"), "record_id")
    lost = issue(rows.where("fits is null"), F.lit(missing), "missing_oracle_graph")
    other = issue(rows.where("not fits"), F.when(F.col("read"), "error").otherwise("warning"), "oracle_graph_record_id_mismatch")
    again = splits.groupBy("record_id").agg((F.count(F.lit(1)) - 1).cast("int").alias("n")).where("n > 0")
    return lost.unionByName(other).unionByName(issue(again.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("n")))), F.lit("error"), "duplicate_record_id"))


def round_records(splits: DataFrame, split: str, round_id: int, k: int, seed: int = 42, policy: str = "window") -> DataFrame:
    """K7: ``fixed`` gives the first k in hashed order every round, ``window`` the k from round * k on, wrapping."""
    rows = _shuffled(splits.where(F.col("split") == split).select("record_id"), seed)
    start = 0 if policy == "fixed" else round_id * k
    return rows.where(F.pmod(F.col("ord") - start, F.col("n")) < k).select("record_id", F.pmod(F.col("ord") - start, F.col("n")).alias("place"))


def carry_forward(rounds: DataFrame, initial: str = "initial") -> DataFrame:
    """K8: the checkpoint each round starts from: the last one selected before it."""
    w = Window.partitionBy("actor").orderBy("round_id").rowsBetween(Window.unboundedPreceding, -1)
    return rounds.withColumn("input_checkpoint", F.coalesce(F.last("selected", ignorenulls=True).over(w), F.lit(initial)))


def with_policy(df: DataFrame) -> DataFrame:
    """K9: whether a row's split may update models."""
    rule = F.create_map(*[F.lit(x) for s, u, _ in POLICY for x in (s, u)])
    return df.withColumn("update_allowed", F.coalesce(rule[F.col("split")], F.lit(False)))


def inspect_split(splits: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6: (severity, issues) for error, warning and info, zeros included; and (record_id, n, splits) of records that
    are listed more than once, with the splits they stand in: more than one is a leak between splits."""
    per = issues.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    all_three = splits.sparkSession.createDataFrame([("error",), ("warning",), ("info",)], "severity string")
    counts = all_three.join(F.broadcast(per.where(F.col("severity").isin("error", "warning", "info"))), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("issues"))
    twice = splits.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("split")).alias("splits")).where("n > 1")
    return counts, twice
