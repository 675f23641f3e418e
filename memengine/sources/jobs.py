"""Records and artifacts of jobs, found in whatever layout they were left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a rollout names its records.
TRACE_NAME = r"([^/]+)\.grpo_trace\.json$"
GROUP_NAME = r"([^/]+)\.(?:memory|question)_group\.json$"

#: A job's optional artifacts and the names of their files.
ARTIFACTS = {
    "current_memory": "current_memory.json",
    "question_set": "questions.json",
    "answer_report": "answers.json",
    "trainer_adapter_report": "trainer_adapter_report.json",
    "weakness_book": "weakness_book.json",
}


def discover_records(manifest: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(record_id, sources) of records that a manifest (``record_id``) or the names of trace and group files
    (``path``) give; ``sources`` names which, sorted. Any of them may be absent; nulls go."""
    found = []
    if manifest is not None:
        found.append(manifest.select("record_id", F.lit("manifest").alias("source")))
    if files is not None:
        for name, pattern in (("traces", TRACE_NAME), ("groups", GROUP_NAME)):
            found.append(files.select(F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).alias("record_id"), F.lit(name).alias("source")))
    if not found:
        raise ValueError("neither a manifest nor files")
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.where("record_id is not null").groupBy("record_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def job_files(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, name, json) of all ``folder``/<record>/<name>.json files, whole."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(F.url_decode(F.replace(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B"))).alias("record_id"), F.regexp_extract(path, r"([^/]+)$", 1).alias("name"), F.col("value").alias("json"))


def reward_jobs(jobs: DataFrame, files: DataFrame, graphs: DataFrame, round_id: int = 0, step_id: int = 0) -> DataFrame:
    """A row per job: ``job_id``, the text of each artifact or null, ``missing`` (optional artifacts that the job
    lacks) and ``error``, set where its graph is missing, without which it cannot run. Of two files with a name the
    first in text order counts."""
    known = files.where(F.col("name").isin(*ARTIFACTS.values()))
    per = known.groupBy("record_id").agg(*[F.min(F.when(F.col("name") == n, F.col("json"))).alias(a) for a, n in ARTIFACTS.items()])
    has = graphs.select("record_id").distinct().withColumn("has_graph", F.lit(True))
    rows = jobs.select("record_id").distinct().join(per.hint("merge"), "record_id", "left").join(has.hint("merge"), "record_id", "left")
    lacking = F.array_compact(F.array(*[F.when(F.col(a).isNull(), F.lit(a)) for a in ARTIFACTS]))
    job_id = F.concat(F.col("record_id"), F.lit(f"_round{round_id}_step{step_id}"))
    error = F.when(F.col("has_graph").isNull(), F.concat(F.lit("oracle graph not found: "), "record_id"))
    return rows.select(job_id.alias("job_id"), "record_id", *ARTIFACTS, lacking.alias("missing"), error.alias("error"))


def answer_rows(reports: DataFrame, json_col: str = "answer_report") -> DataFrame:
    """(record_id, question_id, prediction, answer_status, confidence, supporting_memory_ids, layout) of answer
    reports in three layouts: an object with ``answers``, a bare list, or an object with ``question_items`` as a reward
    report has them, whose ``correctness`` stands in for confidence. The first that fits counts. An answer that names
    no record belongs to the report's. Other texts, and members that are no objects, give no rows."""
    v = F.col("v")
    many = lambda path: F.try_variant_get(v, path, "array<variant>")
    rows = reports.select("record_id", F.try_parse_json(json_col).alias("v")).where("v is not null")
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    has = lambda key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    layout = F.when(~is_list & has("answers"), "answers").when(is_list, "list").when(has("question_items"), "question_items")
    members = F.when(F.col("layout") == "answers", many("$.answers")).when(F.col("layout") == "list", many("$")).when(F.col("layout") == "question_items", many("$.question_items"))
    each = rows.withColumn("layout", layout).select("record_id", "layout", F.posexplode(members).alias("pos", "m"))
    get = lambda key, kind="string": F.try_variant_get("m", f"$.{key}", kind)
    trust = F.when(F.col("layout") == "question_items", get("correctness", "double")).otherwise(get("confidence", "double"))
    return each.where(F.schema_of_variant("m").startswith("OBJECT")).select(
        F.coalesce(get("record_id"), "record_id").alias("record_id"), get("question_id").alias("question_id"), F.coalesce(get("prediction"), F.lit("")).alias("prediction"),
        get("answer_status").alias("answer_status"), F.coalesce(trust, F.lit(0.0)).alias("confidence"),
        F.coalesce(get("supporting_memory_ids", "array<string>"), F.array().cast("array<string>")).alias("supporting_memory_ids"), "layout",
    )
