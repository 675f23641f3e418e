"""Lexical retrieval over current memory and baseline answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import has_text, tokens_ws
from .memory import SUMMARY_KEYS

#: Weight of a memory node by its type.
TYPE_WEIGHTS = {"fact": 1.15, "abstract": 1.10, "summary": 0.95, "preference": 1.20, "plan": 1.15, "event": 0.90, "entity": 0.75, "other": 0.70}


def score_memory(questions: DataFrame, memory: DataFrame) -> DataFrame:
    """The score of every question with every memory node of its record that is not archived."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])[F.col("node_type")], F.lit(1.0))
    low = F.lower("content")
    weight = weight * F.when((F.col("node_type") == "preference") & low.rlike("prefer|like|favorite"), 1.1).when((F.col("node_type") == "plan") & low.rlike("plan|will|going to"), 1.1).otherwise(1.0)
    q = questions.select("record_id", "question_id", "question").where(has_text("question")).select("record_id", "question_id", tokens_ws("question").alias("q_tokens"))
    m = memory.where("status <> 'archived'").select("record_id", "node_id", "node_type", "content", "source_session_ids", "node_ord", tokens_ws("content").alias("m_tokens"), weight.alias("w"), F.coalesce("confidence", F.lit(0.8)).alias("c"))
    # the second array is made a set for each pair, so the shorter one stands there
    ratio = F.size(F.array_intersect("m_tokens", "q_tokens")) / F.size("q_tokens")
    score = F.least(F.lit(1.0), ratio * F.col("w") * F.col("c"))
    return q.join(m, "record_id").select("record_id", "question_id", "node_id", "node_type", "content", "source_session_ids", "node_ord", score.alias("score"))


def retrieve(questions: DataFrame, memory: DataFrame, k: int = 8, min_score: float = 0.0, summaries: DataFrame | None = None, diversify: bool = False) -> DataFrame:
    """The best ``k`` nodes per question (ties in node order), then the summaries at 0.5."""
    order = Window.partitionBy("record_id", "question_id").orderBy(F.desc("score"), "node_ord")
    # what scores too little comes last, so it can go after ranking; before, Spark would work each score out twice
    ranked = score_memory(questions, memory).withColumn("rank", F.row_number().over(order)).where(F.col("score") >= min_score)
    if diversify:
        # one session only among the first k: the best node of another session takes the last place
        whole = Window.partitionBy("record_id", "question_id")
        sess = F.coalesce(F.col("source_session_ids")[0], F.lit(""))
        top = F.collect_set(F.when(F.col("rank") <= k, sess)).over(whole)
        other = F.min(F.when((F.col("rank") > k) & ~F.array_contains("top", F.col("sess")), F.col("rank"))).over(whole)
        ranked = ranked.withColumn("sess", sess).withColumn("top", top).withColumn("other", F.when(F.size("top") == 1, other))
        use = F.when(F.col("other").isNull(), F.col("rank") <= k).otherwise((F.col("rank") < k) | (F.col("rank") == F.col("other")))
        ranked = ranked.where(use).withColumn("rank", F.least("rank", F.lit(k))).drop("sess", "top", "other")
    else:
        ranked = ranked.where(F.col("rank") <= k)
    hits = ranked.select("record_id", "question_id", "rank", F.col("node_id").alias("memory_id"), F.col("node_type").alias("memory_type"), "content", "score")
    if summaries is None:
        return hits
    each = summaries.select("record_id", F.posexplode(F.array(*[F.struct(F.lit(s).alias("key"), F.col(s).alias("value")) for s in SUMMARY_KEYS])).alias("pos", "s")).where("trim(s.value) <> ''")
    extra = questions.where(F.size(tokens_ws("question")) > 0).hint("merge").join(each.hint("merge"), "record_id")
    extra = extra.select("record_id", "question_id", (F.lit(k) + 1 + F.col("pos")).alias("rank"), F.concat(F.lit("summary_"), "s.key").alias("memory_id"), F.lit("summary").alias("memory_type"), F.concat("s.key", F.lit(": "), "s.value").alias("content"), F.lit(0.5).alias("score"))
    return hits.unionByName(extra)


def baseline_answers(questions: DataFrame, retrieved: DataFrame, max_chars: int = 500) -> DataFrame:
    """The top evidence as the answer, citing the first three; a question without evidence is insufficient."""
    first = Window.partitionBy("record_id", "question_id").orderBy("rank")
    top = retrieved.withColumn("n", F.row_number().over(first)).where("n <= 3")
    per = top.groupBy("record_id", "question_id").agg(
        F.min_by("content", "n").alias("best"), F.min_by("score", "n").alias("confidence"), F.array_sort(F.collect_list(F.struct("n", "memory_id", "content"))).alias("e")
    )
    cut = F.when((F.length("best") > max_chars) & F.lit(max_chars > 0), F.concat(F.rtrim(F.substring("best", 1, max_chars)), F.lit("..."))).otherwise(F.col("best"))
    out = questions.select("record_id", "question_id").join(per, ["record_id", "question_id"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "record_id",
        "question_id",
        F.coalesce(cut, F.lit("")).alias("prediction"),
        F.when(F.col("best").isNull(), F.lit("insufficient_evidence")).otherwise(F.lit("answered")).alias("answer_status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.transform("e", lambda x: x["memory_id"]), none).alias("supporting_memory_ids"),
        F.coalesce(F.transform("e", lambda x: x["content"]), none).alias("evidence_contents"),
    )


def validate_answers(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A legal status, text and citations when answered, citations inside what was retrieved; else invalid."""
    allowed = retrieved.groupBy("record_id", "question_id").agg(F.collect_set("memory_id").alias("allowed"))
    rows = answers.join(allowed, ["record_id", "question_id"], "left")
    cited = F.coalesce("supporting_memory_ids", F.array().cast("array<string>"))
    bad = (
        ~F.coalesce(F.col("answer_status"), F.lit("")).isin("answered", "insufficient_evidence", "invalid_output")
        | ((F.col("answer_status") == "answered") & ((F.coalesce("prediction", F.lit("")) == "") | (F.size(cited) == 0)))
        | (F.size(F.array_except(cited, F.coalesce("allowed", F.array().cast("array<string>")))) > 0)
    )
    return rows.withColumn("answer_status", F.when(bad, F.lit("invalid_output")).otherwise(F.col("answer_status"))).drop("allowed")


def answer_summary(answers: DataFrame) -> DataFrame:
    """R7."""
    return answers.groupBy("record_id", "answer_status").agg(F.count(F.lit(1)).alias("n"))
