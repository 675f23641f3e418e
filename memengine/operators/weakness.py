"""Weakness books: recurring failures of a record, folded in order."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts by failure class.
SUMMARIES = {
    "missing_fact": "Memory missing required fact",
    "wrong_fact": "Memory contains wrong or outdated fact",
    "missing_abstraction": "Memory missing higher-level abstraction",
    "missing_multi_session_link": "Memory failed to connect multi-session information",
    "temporal_error": "Memory has temporal ordering error",
    "contradiction_update_error": "Memory failed to handle contradictory update",
    "over_compression": "Memory compressed away necessary details",
    "redundancy_noise": "Memory contains redundant information",
    "unsupported_answer": "Answerer guessed without memory support",
}
FOCUSES = {
    "missing_fact": "Generate questions requiring this specific fact",
    "missing_abstraction": "Generate questions requiring abstraction",
    "missing_multi_session_link": "Generate questions connecting multiple sessions",
    "temporal_error": "Generate temporal reasoning questions",
    "contradiction_update_error": "Generate update-sensitive questions",
    "over_compression": "Avoid over-aggressive compression",
    "redundancy_noise": "Remove redundant memory nodes",
}
BOOK = (
    "weakness_id string, record_id string, question_id string, question_type string, failure_type string, severity double, frequency int, "
    "first_seen_round int, last_seen_round int, status string, missing_oracle_node_ids array<string>, related_session_ids array<string>, related_memory_ids array<string>, entry_ord int"
)
FIELDS = [f.strip().split(" ")[0] for f in BOOK.split(",")]


def weakness_text(failure: str = "failure_type"):
    """(summary, recommended focus) columns."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col(failure)]
    return F.coalesce(table(SUMMARIES), F.lit("Memory weakness detected")), F.coalesce(table(FOCUSES), F.lit("Address memory weakness"))


def fold(book: list[dict], items: list[dict], round_id: int) -> list[dict]:
    """B1 for one record: the entries after the failures of ``items``, in order. An entry matches by id, else the
    first active one of the same class and question, or of the same class with a node in common."""
    by_id = {w["weakness_id"]: w for w in book}
    for item in items:
        nodes = list(item["supporting_oracle_node_ids"])
        for kind in item["failure_types"]:
            raw = f"{item['record_id']}:{item['question_id']}:{kind}:{'|'.join(sorted(nodes))}"
            ident = "weak_" + hashlib.sha256(raw.encode()).hexdigest()[:8]
            hit = by_id.get(ident)
            if hit is None:
                same = (w for w in book if w["status"] == "active" and w["failure_type"] == kind)
                hit = next((w for w in same if w["question_id"] == item["question_id"] or not set(nodes).isdisjoint(w["missing_oracle_node_ids"])), None)
            now = 1.0 - item["correctness"]
            if hit is None:
                hit = dict(zip(FIELDS, (ident, item["record_id"], item["question_id"], item["question_type"], kind, now, 1, round_id, round_id, "active", nodes, list(item["related_session_ids"]), list(item["supporting_memory_ids"]), len(book)), strict=True))
                book.append(hit)
                by_id[ident] = hit
                continue
            hit["frequency"] += 1
            hit["last_seen_round"] = round_id
            hit["severity"] = max(0.8 * hit["severity"] + 0.2 * now, now)
            for field, more in (("missing_oracle_node_ids", nodes), ("related_session_ids", item["related_session_ids"]), ("related_memory_ids", item["supporting_memory_ids"])):
                hit[field] = sorted({*hit[field], *more})
    return book


def update_weaknesses(book: DataFrame, items: DataFrame, round_id: int) -> DataFrame:
    """B1: books of all records after a round. A record's fold depends on its own rows only, so records spread over
    tasks; a record's book is small."""

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        entries = old.sort_values("entry_ord").to_dict("records")
        for e in entries:
            for c in ("missing_oracle_node_ids", "related_session_ids", "related_memory_ids"):
                e[c] = list(e[c])
        return pd.DataFrame(fold(entries, new.sort_values("item_ord").to_dict("records"), round_id), columns=FIELDS)

    keep = [c for c in ("record_id", "question_id", "question_type", "correctness", "failure_types", "supporting_oracle_node_ids", "related_session_ids", "supporting_memory_ids", "item_ord")]
    return book.select(*FIELDS).groupBy("record_id").cogroup(items.select(*keep).groupBy("record_id")).applyInPandas(run, BOOK)


def mark_mastered(book: DataFrame, ids: DataFrame, round_id: int, by: str = "weakness_id") -> DataFrame:
    """B2: active entries whose ``by`` is in ``ids`` are mastered."""
    hit = book.join(ids.select(by).distinct().withColumn("hit", F.lit(True)), by, "left")
    now = F.coalesce("hit", F.lit(False)) & (F.col("status") == "active")
    return hit.withColumn("last_seen_round", F.when(now, round_id).otherwise(F.col("last_seen_round"))).withColumn("status", F.when(now, "mastered").otherwise(F.col("status"))).select(*book.columns)


def active_weaknesses(book: DataFrame, n: int | None = None, failure_type: str | None = None) -> DataFrame:
    """Active entries of a record, the gravest and most frequent first."""
    rows = book.where("status = 'active'")
    rows = rows if failure_type is None else rows.where(F.col("failure_type") == failure_type)
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("severity"), F.desc("frequency"), "entry_ord"))
    rows = rows.withColumn("rank", rank)
    return rows if n is None else rows.where(F.col("rank") <= n)


def question_agent_context(book: DataFrame, n: int = 10, oracle_ids: bool = True) -> DataFrame:
    """(record_id, context): the ``n`` gravest active entries of a record as JSON, what a question maker needs of
    each and nothing else; ``oracle_ids`` adds the ids of the nodes that were missed. Fields that the book lacks are
    left out; a record without active entries has no row."""
    fields = ["failure_type", "question_type", "related_session_ids", "recommended_focus"] + (["missing_oracle_node_ids"] if oracle_ids else [])
    top = active_weaknesses(book, n)
    entry = F.struct(*[c for c in fields if c in book.columns])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"])
    per = top.groupBy("record_id").agg(listed.alias("active_weaknesses"))
    return per.select("record_id", F.to_json(F.struct("active_weaknesses")).alias("context"))


def weakness_summary(book: DataFrame) -> DataFrame:
    """Per record and failure class, counts of active and mastered entries."""
    return book.groupBy("record_id", "failure_type").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "mastered").alias("mastered"), F.sum("frequency").alias("frequency"))


def described(book: DataFrame) -> DataFrame:
    """The book with what an entry says to people, ``short_summary``, and to the question maker,
    ``recommended_focus``; both follow from its failure class, so books do not carry them."""
    summary, focus = weakness_text()
    return book.withColumns({"short_summary": summary, "recommended_focus": focus})


def book_summary(book: DataFrame) -> DataFrame:
    """Per record the newest round, counts of active and mastered entries and ``top_failure_types``, the active
    entries of each failure class as a map."""
    per = book.groupBy("record_id", "failure_type").agg(F.count_if(F.col("status") == "active").alias("a"), F.count_if(F.col("status") == "mastered").alias("m"), F.max("last_seen_round").alias("r"))
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("a") > 0) & F.col("failure_type").isNotNull(), F.struct("failure_type", "a")))))
    return per.groupBy("record_id").agg(F.max("r").alias("updated_round"), F.sum("a").alias("active_count"), F.sum("m").alias("mastered_count"), kinds.alias("top_failure_types"))


def weakness_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two books."""
    a = old.select("weakness_id", F.col("frequency").alias("f0"), F.col("last_seen_round").alias("r0"), F.col("status").alias("s0"))
    both = new.select("weakness_id", "record_id", "frequency", "last_seen_round", "status").join(a, "weakness_id", "left")
    change = (
        F.when(F.col("s0").isNull(), "added")
        .when((F.col("status") == "mastered") & (F.col("s0") != "mastered"), "mastered")
        .when((F.col("frequency") != F.col("f0")) | (F.col("last_seen_round") != F.col("r0")), "updated")
    )
    return both.withColumn("change", change).where("change is not null").select("record_id", "weakness_id", "change")
