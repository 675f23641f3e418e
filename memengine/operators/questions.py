"""Questions from walks, and the gates they pass."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normalize_text, stable_id, tokens_ws
from .audit import find_keys

#: Fixed values.
PLACEHOLDER = "What user information is supported by the cited evidence?"
PLACEHOLDER_REASON = "Generated in no-LLM mode for pipeline testing."
PLACEHOLDER_MARKERS = "what user information is supported by the cited evidence|what information is supported by this graph trajectory|generated in no-llm mode"
KEY = ["record_id", "question_id"]

#: Keys that a question must hold nowhere.
ARTIFACT_KEYS = ("benchmark_question", "target_question", "gold_answer", "benchmark_answer", "question_type_from_benchmark", "oracle_gold_answer", "reward", "eval_result")


def artifact_leaks(questions: DataFrame, json_col: str = "metadata") -> DataFrame:
    """Q4: (record_id, question_id, path, key) of forbidden keys at any depth of a question's ``json_col``."""
    found = find_keys(questions.select(F.struct(*KEY).alias("id"), json_col), "id", json_col, list(ARTIFACT_KEYS))
    return found.select(*[F.col(f"row_id.{k}").alias(k) for k in KEY], "path", "key")


def best_evidence(walks: DataFrame, labels: DataFrame, label_needed: bool = False) -> DataFrame:
    """Q1: per walk the fact, else abstract, else event, else any node that comes first."""
    each = walks.select("record_id", "trajectory_id", F.posexplode("node_ids").alias("step", "node_id")).hint("merge").join(labels.hint("merge"), ["record_id", "node_id"])
    if label_needed:
        each = each.where("label <> ''")
    priority = F.when(F.col("node_type") == "fact", 3).when(F.col("node_type") == "abstract_memory", 2).when(F.col("node_type") == "event", 1).otherwise(0)
    return each.groupBy("record_id", "trajectory_id").agg(F.max_by(F.struct("node_id", "node_type", "label"), F.struct(priority.alias("p"), (-F.col("step")).alias("s"))).alias("b")).select("record_id", "trajectory_id", "b.*")


def placeholder_questions(walks: DataFrame, labels: DataFrame, sessions: DataFrame, n: int = 5) -> DataFrame:
    """Q2: a candidate question for each of the first ``n`` walks of a record."""
    order = Window.partitionBy("record_id").orderBy("trajectory_id")
    first = walks.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") < n)
    best = best_evidence(first, labels).hint("merge").join(first.select("record_id", "trajectory_id", "i").hint("merge"), ["record_id", "trajectory_id"])
    of_node = sessions.groupBy("record_id", "node_id").agg(F.array_sort(F.collect_set("session_id")).alias("supporting_session_ids"))
    rows = best.hint("merge").join(of_node.hint("merge"), ["record_id", "node_id"], "left")
    return rows.select(
        "record_id",
        stable_id("question", "record_id", F.concat(F.lit("no_llm_"), F.col("i").cast("string"))).alias("question_id"),
        F.lit(PLACEHOLDER).alias("question"),
        F.col("label").alias("answer"),
        F.lit("other").alias("question_type"),
        F.lit("candidate").alias("status"),
        F.array("trajectory_id").alias("supporting_trajectory_ids"),
        F.array("node_id").alias("supporting_node_ids"),
        F.coalesce("supporting_session_ids", F.array().cast("array<string>")).alias("supporting_session_ids"),
        F.lit(PLACEHOLDER_REASON).alias("reason"),
        F.lit("no_llm").alias("mode"),
    )


def oracle_validity(questions: DataFrame, walks: DataFrame, labels: DataFrame, sessions: DataFrame, allow_placeholder: bool = False, min_sessions: int = 0, min_overlap: float = 0.6, leaks: DataFrame | None = None) -> DataFrame:
    """Q4, Q5: (record_id, question_id, verdict, grounding, answerability, citation_validity, leakage_risk, issues).
    Citations are joined row by row; issues come in rule order as codes. Questions in ``leaks`` (see ``artifact_leaks``)
    are rejected first of all."""
    empty = F.array().cast("array<string>")
    q = questions.withColumns({c: F.coalesce(c, empty) for c in ("supporting_trajectory_ids", "supporting_node_ids")})
    cited_walks = q.select(*KEY, F.explode("supporting_trajectory_ids").alias("trajectory_id"))
    found = cited_walks.hint("merge").join(walks.select("record_id", "trajectory_id", "node_ids").hint("merge"), ["record_id", "trajectory_id"], "left")
    on_walk = found.groupBy(*KEY).agg(F.count_if(F.col("node_ids").isNull()).alias("lost_walks"))
    walk_nodes = found.select(*KEY, F.explode("node_ids").alias("node_id")).distinct().withColumn("on_walk", F.lit(True))
    cited = q.select(*KEY, F.posexplode("supporting_node_ids").alias("pos", "node_id"))
    rows = cited.hint("merge").join(walk_nodes.hint("merge"), [*KEY, "node_id"], "left").hint("merge").join(labels.select("record_id", "node_id", "node_type", "label").hint("merge"), ["record_id", "node_id"], "left")
    evidence = F.col("on_walk") & F.col("node_type").isin("fact", "abstract_memory", "event") & (F.col("label") != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", F.lit("")).alias("label")))), lambda x: x["label"]), " ")
    nodes = rows.groupBy(*KEY).agg(F.count_if(F.col("on_walk").isNull()).alias("off_walk"), F.count_if(F.col("node_type").isNull()).alias("unknown"), F.max(F.coalesce(evidence, F.lit(False))).alias("evidence"), text.alias("evidence_text"))
    seen = cited.hint("merge").join(sessions.hint("merge"), ["record_id", "node_id"]).groupBy(*KEY).agg(F.countDistinct("session_id").alias("n_sessions"))
    if leaks is None:
        marked = q.withColumn("leaked", F.lit(False))
    else:
        marked = q.hint("merge").join(leaks.select(*KEY).distinct().withColumn("leaked", F.lit(True)).hint("merge"), KEY, "left")
    all_ = marked.hint("merge").join(on_walk.hint("merge"), KEY, "left").hint("merge").join(nodes.hint("merge"), KEY, "left").hint("merge").join(seen.hint("merge"), KEY, "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    placeholder = F.lower("question").rlike(PLACEHOLDER_MARKERS) | F.lower(F.coalesce("reason", F.lit(""))).rlike(PLACEHOLDER_MARKERS) | (F.coalesce("mode", F.lit("")) == "no_llm")
    rules = [
        (F.coalesce("leaked", F.lit(False)), "artifact_leakage"),
        (blank("question"), "empty_question"),
        (blank("answer"), "empty_answer"),
        (F.size("supporting_trajectory_ids") == 0, "no_trajectory_ids"),
        (F.size("supporting_node_ids") == 0, "no_node_ids"),
        (placeholder & F.lit(not allow_placeholder), "placeholder"),
        (n("lost_walks") > 0, "trajectory_not_found"),
        (n("off_walk") > 0, "node_not_found_in_trajectories"),
        (n("unknown") > 0, "node_not_found_in_graph"),
        (~F.coalesce("evidence", F.lit(False)), "no_evidence"),
        (n("n_sessions") < min_sessions, "too_few_sessions"),
    ]
    hard = F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules]))
    out = all_.withColumn("hard", hard)
    answer, body = normalize_text("answer"), normalize_text("evidence_text")
    a, b = tokens_ws("answer"), tokens_ws("evidence_text")
    ratio = F.when(F.size(a) == 0, 0.0).when(F.contains(body, answer), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    out = out.withColumn("grounding", F.when(F.size("hard") > 0, 0.0).otherwise(ratio))
    weak = (F.size("hard") == 0) & (F.col("grounding") < min_overlap)
    issues = F.concat("hard", F.when(weak, F.array(F.lit("not_grounded"))).otherwise(empty))
    missing = F.exists("hard", lambda x: F.contains(x, F.lit("not_found")))
    return out.select(
        *KEY,
        F.when(F.size("hard") > 0, "reject").when(weak, "revise").otherwise("accept").alias("verdict"),
        "grounding",
        F.when(F.size(issues) == 0, 1.0).otherwise(0.5).alias("answerability"),
        F.when(missing, 0.0).otherwise(1.0).alias("citation_validity"),
        F.when(F.col("leaked"), 1.0).otherwise(0.0).alias("leakage_risk"),
        issues.alias("issues"),
    )


def apply_verdicts(questions: DataFrame, reports: DataFrame, accept_revise: bool = False) -> DataFrame:
    """Q6: questions with their new status."""
    ok = F.col("verdict") == "accept"
    if accept_revise:
        ok = ok | (F.col("verdict") == "revise")
    status = F.when(ok, "accepted").when(F.col("verdict") == "revise", "needs_revision").otherwise("rejected")
    return questions.drop("status").join(reports.select(*KEY, "verdict"), KEY, "left").withColumn("status", status)


def verdict_summary(judged: DataFrame) -> DataFrame:
    """Q6: per record of ``apply_verdicts``: candidates, accepted, rejected (all the others), and accepted questions by
    type as a sorted list of (type, n)."""
    kind = F.coalesce("question_type", F.lit("other")).alias("question_type")
    per = judged.groupBy("record_id", kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "accepted").alias("ok"))
    types = F.array_sort(F.collect_list(F.when(F.col("ok") > 0, F.struct(F.col("question_type").alias("type"), F.col("ok").alias("n")))))
    return per.groupBy("record_id").agg(F.sum("n").alias("candidates"), F.sum("ok").alias("accepted"), (F.sum("n") - F.sum("ok")).alias("rejected"), types.alias("question_types"))


def normalize_questions(replies: DataFrame) -> DataFrame:
    """Q3: external replies (record_id, ord, question, answer, question_type, ids...) with defaults; blanks dropped."""
    empty = F.array().cast("array<string>")
    rows = replies.where((normalize_text("question") != "") & (normalize_text("answer") != ""))
    ident = F.coalesce(F.nullif("question_id", F.lit("")), stable_id("question", "record_id", "question", F.col("ord").cast("string")))
    lists = {c: F.coalesce(c, empty) for c in ("supporting_trajectory_ids", "supporting_node_ids", "supporting_session_ids") if c in replies.columns}
    return rows.withColumns({"question_id": ident, "question": normalize_text("question"), "answer": normalize_text("answer"), "question_type": F.coalesce(F.nullif("question_type", F.lit("")), F.lit("other")), **lists})


#: Sub-scores, issues and verdicts of a judgment, and phrases of template questions.
SUB_SCORES = ("answerability", "evidence_grounding", "specificity", "memory_value", "reasoning_depth", "clarity", "multi_session_value")
LEGAL_ISSUES = (
    "unsupported_answer", "vague_question", "generic_template", "trivial_copy", "answer_too_long", "answer_too_short", "ambiguous_reference",
    "depends_on_outside_knowledge", "mostly_assistant_advice", "weak_multi_session_use", "cited_nodes_missing", "cited_trajectories_missing",
)
VERDICTS = ("accept", "revise", "reject")
GENERIC_PHRASES = ("what information is supported", "this graph trajectory", "what does the trajectory", "what is mentioned", "what information")


def _mean_score():
    """The rounded mean of the sub-scores; seven whole numbers never have a mean halfway."""
    return F.round(sum((F.col(s) for s in SUB_SCORES), F.lit(0)) / len(SUB_SCORES)).cast("int")


def _verdict(score):
    return F.when(score >= 4, "accept").when(score == 3, "revise").otherwise("reject")


def judge_questions(questions: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Q7: rule-based judgments of questions (record_id, question_id, question, answer, supporting_trajectory_ids,
    supporting_node_ids) by trajectories (record_id, trajectory_id, session_ids): seven sub-scores, issues, verdict."""
    none = F.array().cast("array<string>")
    ids = F.filter(F.coalesce("supporting_trajectory_ids", none), lambda x: x.isNotNull())
    cited = questions.select(*KEY, F.explode(F.array_distinct(ids)).alias("trajectory_id"))
    known = trajectories.select("record_id", "trajectory_id", F.col("session_ids").cast("array<string>").alias("session_ids"))
    met = cited.join(known.hint("merge"), ["record_id", "trajectory_id"], "left")
    met = met.groupBy(*KEY).agg(F.bool_or(F.col("session_ids").isNull()).alias("lost"), F.size(F.array_distinct(F.flatten(F.collect_list("session_ids")))).alias("sessions"))
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    rows = questions.join(met.hint("merge"), KEY, "left").select(
        *KEY,
        strip("question").alias("q"),
        F.length(strip("answer")).alias("a"),
        (F.size(ids) > 0).alias("traced"),
        F.coalesce("lost", F.lit(True)).alias("lost"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
        (F.size(F.filter(F.coalesce("supporting_node_ids", none), lambda x: x.isNotNull())) > 0).alias("noded"),
    )
    generic = functools.reduce(operator.or_, [F.contains(F.lower("q"), F.lit(p)) for p in GENERIC_PHRASES])
    rows = rows.withColumn("generic", generic).withColumn("many", F.col("sessions") >= 2)
    flags = {"cited_trajectories_missing": "lost", "cited_nodes_missing": "not noded", "generic_template": "generic", "answer_too_long": "a > 220", "answer_too_short": "a < 2", "weak_multi_session_use": "not many"}
    worth = {
        "answerability": ("traced and a > 0", 2), "evidence_grounding": ("noded and not lost", 2), "specificity": ("not generic", 2), "memory_value": ("not generic", 2),
        "reasoning_depth": ("many", 2), "clarity": (r"endswith(q, '?') and size(split(q, '\\s+')) >= 5", 3), "multi_session_value": ("many", 2),
    }
    rows = rows.withColumns({k: F.when(F.expr(good), 4).otherwise(bad) for k, (good, bad) in worth.items()})
    rows = rows.withColumn("overall", F.when(F.col("generic"), F.least(_mean_score(), F.lit(2))).otherwise(_mean_score()))
    issues = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(k)) for k, test in flags.items()]))
    return rows.select(*KEY, *SUB_SCORES, "overall", _verdict(F.col("overall")).alias("verdict"), issues.alias("issues"))


def normalize_judgments(judgments: DataFrame, questions: DataFrame) -> DataFrame:
    """Q8: one row per question: scores rounded half to even into 1 to 5 (1 where absent), an absent overall score is
    their mean, an unknown verdict follows it, legal issues only, sorted; a question without judgment cites nothing."""
    rows = questions.select(*KEY).join(judgments.withColumn("judged", F.lit(True)).hint("merge"), KEY, "left")
    score = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.col(c).cast("double")).cast("int")))
    rows = rows.withColumns({s: F.when(F.col(s).isNull(), 1).otherwise(score(s)) for s in SUB_SCORES})
    rows = rows.withColumn("overall", F.when(F.col("overall").isNull(), _mean_score()).otherwise(score("overall")))
    verdict = F.lower(F.trim(F.col("verdict")))
    issues = F.array_intersect(F.coalesce("issues", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in LEGAL_ISSUES]))
    issues = F.when(F.col("judged").isNull(), F.array_union(issues, F.array(F.lit("cited_trajectories_missing")))).otherwise(issues)
    return rows.select(*KEY, *SUB_SCORES, "overall", F.when(verdict.isin(*VERDICTS), verdict).otherwise(_verdict(F.col("overall"))).alias("verdict"), F.array_sort(issues).alias("issues"))


def judgment_summary(judgments: DataFrame, accept_at: float = 4.0) -> DataFrame:
    """Q9: per record the mean overall score to three decimals, counts by verdict, accepted ids, and issues with their
    counts. Ids and issues of a record's questions come as one sorted text each."""
    yes = (F.col("verdict") == "accept") & (F.col("overall") >= accept_at)
    base = judgments.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg("overall"), 3).alias("mean_overall"),
        F.count_if(yes).alias("accepted"),
        F.count_if(F.col("verdict") == "revise").alias("revise"),
        F.count_if(F.col("verdict") == "reject").alias("rejected"),
        F.array_join(F.array_sort(F.collect_list(F.when(yes, F.col("question_id").cast("string")))), "|").alias("accepted_ids"),
    )
    counts = judgments.select("record_id", F.explode("issues").alias("issue")).groupBy("record_id", "issue").count()
    text = counts.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "issue", F.col("count").cast("string")))), "|").alias("issues"))
    return base.join(text.hint("merge"), "record_id", "left")
