"""What models get to read: requests and questions without secrets, nested payloads as JSON, samples of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import SUMMARY_KEYS

#: The fields of a question that an actor may see.
POLICY_FIELDS = ("question_id", "record_id", "question", "answer", "question_type", "status", "supporting_session_ids", "reason")

MEMORY_TASK = ("Write a compact memory of the conversation below.", ("Use the history alone: neither test questions nor their answers.", "Keep facts, preferences, plans, changes and what they add up to."))
QUESTION_TASK = ("Write varied questions that the walks below can answer.", ("Use the walks alone: neither test questions nor their answers.", "Cover as many kinds of question as the walks allow."))


def _ordered(*fields: str | Column, order: str | tuple[str, ...]) -> Column:
    """The structs of ``fields`` of a group, in the order of ``order``."""
    by = (order,) if isinstance(order, str) else order
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(b).alias(f"_{i}") for i, b in enumerate(by)], F.struct(*fields).alias("x"))))
    return F.transform(listed, lambda e: e["x"])


def answer_requests(questions: DataFrame) -> DataFrame:
    """What an answerer sees of a question: no answer, no ids of evidence, no reason."""
    return questions.select("record_id", "question_id", "question")


def policy_safe_questions(questions: DataFrame) -> DataFrame:
    """The fields of questions that may enter an actor's training; those that the table lacks are left out."""
    return questions.select(*[c for c in POLICY_FIELDS if c in questions.columns])


def history_payload(turns: DataFrame) -> DataFrame:
    """(record_id, payload): a record's history as ``record_id`` and ``sessions`` with their ``turns``, all in
    order. A session's time is that of its first turn that has one, else empty; a turn without a time has no such key."""
    time = F.nullif(F.trim(F.coalesce("ts_raw", F.lit(""))), F.lit("")).alias("timestamp")
    rows = turns.withColumn("timestamp", time)
    of_session = _ordered("event_id", "turn_id", "speaker", "text", "timestamp", order="event_ord")
    first = F.coalesce(F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("event_ord"))), F.lit(""))
    sessions = rows.groupBy("record_id", "session_ord", "session_id").agg(first.alias("timestamp"), of_session.alias("turns"))
    whole = sessions.groupBy("record_id").agg(_ordered("session_id", "timestamp", "turns", order=("session_ord", "session_id")).alias("sessions"))
    return whole.select("record_id", F.to_json(F.struct("record_id", "sessions")).alias("payload"))


def answer_payload(questions: DataFrame, retrieved: DataFrame, memory: DataFrame, summaries: DataFrame) -> DataFrame:
    """(record_id, question_id, payload): the request, five summary texts (empty where there is none) and the
    retrieved memories by rank with their provenance; a summary among them has none. ``retrieved`` is R2's output."""
    sources = ("source_session_ids", "source_turn_ids", "source_event_ids")
    origin = memory.select("record_id", F.col("node_id").alias("memory_id"), *sources).dropDuplicates(["record_id", "memory_id"])
    none = F.array().cast("array<string>")
    hits = retrieved.join(origin.hint("merge"), ["record_id", "memory_id"], "left")
    lists = hits.groupBy("record_id", "question_id").agg(_ordered("memory_id", "memory_type", "content", *[F.coalesce(c, none).alias(c) for c in sources], order="rank").alias("retrieved_memory"))
    texts = summaries.select("record_id", *SUMMARY_KEYS)
    rows = answer_requests(questions).join(lists.hint("merge"), ["record_id", "question_id"], "left").join(texts.hint("merge"), "record_id", "left")
    found = F.when(F.col("retrieved_memory").isNull(), F.from_json(F.lit("[]"), lists.schema["retrieved_memory"].dataType)).otherwise(F.col("retrieved_memory"))
    body = F.struct("record_id", "question_id", "question", F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in SUMMARY_KEYS]).alias("memory_summaries"), found.alias("retrieved_memory"))
    return rows.select("record_id", "question_id", F.to_json(body).alias("payload"))


def compact_text(text: Column | str, max_chars: int = 4000) -> Column:
    """``text`` cut to ``max_chars`` with three dots at its end; 0 cuts nothing, null is empty."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if max_chars <= 0:
        return text
    cut = F.concat(F.regexp_replace(F.substring(text, 1, max(max_chars - 3, 0)), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def judge_payload(questions: DataFrame, trajectories: DataFrame, batch_size: int = 8, max_chars: int = 4000, order: str = "question_id") -> DataFrame:
    """(record_id, batch, questions, payload): the questions of a record in batches of ``batch_size``, by
    ``order``, each with the walks it cites (record_id, trajectory_id, text, session_ids), in the order cited, and the
    ids of walks that are not there."""
    cited = F.coalesce("supporting_trajectory_ids", F.array().cast("array<string>"))
    rows = questions.withColumn("_ids", cited)
    each = rows.select("record_id", "question_id", F.posexplode("_ids").alias("pos", "trajectory_id"))
    known = trajectories.select("record_id", "trajectory_id", "session_ids", compact_text("text", max_chars).alias("text"), F.lit(True).alias("known")).dropDuplicates(["record_id", "trajectory_id"])
    met = each.hint("merge").join(known.hint("merge"), ["record_id", "trajectory_id"], "left")
    evidence = met.groupBy("record_id", "question_id").agg(_ordered("trajectory_id", "session_ids", "text", "known", order="pos").alias("_met"))
    full = rows.hint("merge").join(evidence.hint("merge"), ["record_id", "question_id"], "left")
    shown = F.transform(F.filter("_met", lambda e: e["known"]), lambda e: F.struct(e["trajectory_id"].alias("trajectory_id"), e["session_ids"].alias("session_ids"), e["text"].alias("text")))
    missing = F.transform(F.filter("_met", lambda e: e["known"].isNull()), lambda e: e["trajectory_id"])
    empty = F.array().cast("array<string>")
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default)).alias(c) if c in questions.columns else F.lit(default).alias(c)
    nodes = F.coalesce("supporting_node_ids", empty) if "supporting_node_ids" in questions.columns else empty
    fields = [
        "question_id", text("question"), text("answer"), text("question_type", "other"), F.col("_ids").alias("supporting_trajectory_ids"), nodes.alias("supporting_node_ids"),
        text("reason").alias("generator_reason"), F.coalesce(missing, empty).alias("missing_trajectory_ids"), shown.alias("evidence_trajectories"),
    ]
    w = Window.partitionBy("record_id").orderBy(order, "question_id")
    ranked = full.withColumn("_rn", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("_rn") / batch_size).cast("int"))
    per = ranked.groupBy("record_id", "batch").agg(F.count(F.lit(1)).alias("n"), _ordered(*fields, order="_rn").alias("questions"))
    return per.select("record_id", "batch", F.col("n").alias("questions"), F.to_json(F.struct("record_id", "questions")).alias("payload"))


def _samples(record_configs: DataFrame, kind: str, round_id: int, step_id: int) -> DataFrame:
    ids = {
        "sample_id": F.concat("record_id", F.lit(f":{kind}:"), F.col("sample_index").cast("string")),
        "group_id": F.concat(F.lit(f"round{round_id}_step{step_id}_"), F.col("record_id"), F.lit(f"_{kind}")),
    }
    return record_configs.withColumns(ids)


def _with_configs(records: DataFrame, configs: list[str]) -> DataFrame:
    """Every record with every configuration (JSON texts, a short list)."""
    return records.select("*", F.posexplode(F.array(*[F.lit(c) for c in configs])).alias("sample_index", "config"))


def _prompt(task: tuple[str, tuple[str, ...]], **parts: str) -> Column:
    """A prompt as JSON text; ``parts`` name columns that hold JSON themselves and go in as they are."""
    head = F.to_json(F.struct(F.lit(task[0]).alias("task"), F.array(*[F.lit(c) for c in task[1]]).alias("constraints")))
    inner = [F.concat(F.lit(f',"{name}":'), F.coalesce(F.col(c), F.lit("null"))) for name, c in parts.items()]
    return F.concat(F.regexp_replace(head, r"\}$", ""), *inner, F.lit("}"))


def memory_policy_samples(turns: DataFrame, memory: DataFrame, configs: list[str], round_id: int = 0, step_id: int = 0) -> DataFrame:
    """(sample_id, group_id, record_id, role, status, prompt, response): a sample per record and configuration.
    ``memory`` holds the nodes of all builds, with ``sample_index`` (M9); a build that kept nothing responds with an
    empty list, and is accepted like the others."""
    kept = _ordered("node_id", "node_type", "content", "confidence", "source_session_ids", "source_turn_ids", "source_event_ids", order=("node_ord", "node_id"))
    built = memory.groupBy("record_id", "sample_index").agg(F.to_json(kept).alias("nodes"))
    rows = _with_configs(history_payload(turns), configs).hint("merge").join(built.hint("merge"), ["record_id", "sample_index"], "left")
    response = F.concat(F.lit('{"memory_nodes":'), F.coalesce("nodes", F.lit("[]")), F.lit("}"))
    out = _samples(rows, "memory", round_id, step_id).withColumns({"prompt": _prompt(MEMORY_TASK, history="payload", builder_config="config"), "response": response})
    return out.select("sample_id", "group_id", "record_id", F.lit("memory_builder").alias("role"), F.lit("accepted").alias("status"), "prompt", "response")


def question_policy_samples(walks: DataFrame, candidates: DataFrame, configs: list[str], round_id: int = 0, step_id: int = 0) -> DataFrame:
    """The same for question sets, with ``accepted`` and ``rejected`` counts. ``walks`` (record_id,
    trajectory_id, text) goes into the prompt; ``candidates`` are questions with ``sample_index`` and a boolean
    ``accepted``. A set is accepted if a question is, rejected if none of its candidates is, failed without any."""
    listed = walks.groupBy("record_id").agg(F.to_json(_ordered("trajectory_id", "text", order="trajectory_id")).alias("walks"))
    safe = [c for c in POLICY_FIELDS if c in candidates.columns]
    ok = F.coalesce("accepted", F.lit(False))
    sets = candidates.groupBy("record_id", "sample_index").agg(
        F.count_if(ok).alias("n_accepted"), F.count_if(~ok).alias("n_rejected"), F.to_json(_ordered(*safe, order="question_id")).alias("response"),
    )
    rows = _with_configs(listed, configs).hint("merge").join(sets.hint("merge"), ["record_id", "sample_index"], "left").na.fill(0, ["n_accepted", "n_rejected"])
    status = F.when(F.col("n_accepted") > 0, "accepted").when(F.col("n_rejected") > 0, "rejected").otherwise("failed")
    out = _samples(rows, "question", round_id, step_id).withColumns({"prompt": _prompt(QUESTION_TASK, walks="walks", generation_config="config"), "response": F.coalesce("response", F.lit("[]"))})
    return out.select("sample_id", "group_id", "record_id", F.lit("question_agent").alias("role"), status.alias("status"), "n_accepted", "n_rejected", "prompt", "response")
