"""Current memory of all records at once, from raw turns only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normalize_text, once, stable_id

#: Fixed values.
USERS, ASSISTANTS = ("user", "human"), ("assistant", "ai", "system")
TASK_MARKERS = "solve this|calculate|translate|write code|debug this"
PREFERENCE_MARKERS, PLAN_MARKERS = "like|prefer|favorite", "plan|will|going to|need to"
SUMMARY_KEYS = ("user_profile", "stable_preferences", "active_plans", "recent_changes", "cross_session_abstractions")
NODE_TYPES = ("event", "fact", "summary", "abstract", "preference", "plan", "entity", "other")


@dataclass(frozen=True)
class MemoryConfig:
    min_user_text_chars: int = 20
    include_assistant_turns: bool = False
    max_event_nodes: int | None = None


def enters_memory(cfg: MemoryConfig = MemoryConfig()):
    """M2: whether a turn enters memory, but for the limit on events."""
    who = F.lower("speaker")
    keep = who.isin(*USERS)
    if cfg.include_assistant_turns:
        keep = keep | who.isin(*ASSISTANTS)
    fits = lambda clean: (F.length(clean) >= cfg.min_user_text_chars) & ~((F.length(clean) < 50) & F.lower(clean).rlike(TASK_MARKERS))
    return keep & once(normalize_text("text"), fits)


def retained_turns(turns: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """M2, M3: turns that enter memory, with their ordinal in the record."""
    rows = turns.where(enters_memory(cfg)).withColumn("kept_ord", F.row_number().over(Window.partitionBy("record_id").orderBy("event_ord")))
    return rows if cfg.max_event_nodes is None else rows.where(F.col("kept_ord") <= cfg.max_event_nodes)


def _node(kind, ident, content, confidence, level, order, turn=None, events=None):
    none = F.array().cast("array<string>")
    return F.struct(
        ident.alias("node_id"),
        F.lit(kind).alias("node_type"),
        content.alias("content"),
        F.lit("active").alias("status"),
        F.lit(confidence).alias("confidence"),
        F.lit(level).alias("abstraction_level"),
        F.array("session_id").alias("source_session_ids"),
        (none if turn is None else F.array(turn.cast("string"))).alias("source_turn_ids"),
        (none if events is None else events).alias("source_event_ids"),
        order.alias("node_ord"),
    )


def _both(df, *nodes):
    """The nodes of each row, which is read once."""
    keys = [c for c in ("sample_id",) if c in df.columns] + ["record_id"]
    return df.select(*keys, F.explode(F.array(*nodes)).alias("n")).select(*keys, "n.*")


def _sessions(kept: DataFrame) -> DataFrame:
    """Sessions with two retained turns or more; their events in order."""
    keys = [c for c in ("sample_id",) if c in kept.columns] + ["record_id", "session_id"]
    grouped = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("kept_ord").alias("last_ord"), F.transform(F.array_sort(F.collect_list(F.struct("kept_ord", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    return grouped.where("n >= 2")


def turn_ids():
    """Ids of a retained turn's event and fact."""
    return stable_id("mem_evt", "record_id", "event_id"), stable_id("mem_fact", "record_id", "event_id", F.substring("text", 1, 128))


def turn_nodes(kept: DataFrame) -> DataFrame:
    """M4: event and fact of each retained turn."""
    event, fact = turn_ids()
    at = F.col("kept_ord").cast("long") * 4
    said = _node("event", event, F.concat("speaker", F.lit(" said: "), "text"), 0.6, 0, at, F.col("turn_id"), F.array("event_id"))
    return _both(kept, said, _node("fact", fact, F.concat(F.lit("The user mentioned: "), normalize_text("text")), 0.55, 1, at + 1, F.col("turn_id"), F.array("event_id")))


def session_nodes(many: DataFrame) -> DataFrame:
    """M6: summary and abstract of sessions (n, last_ord, event_ids) with two retained turns or more."""
    end = F.col("last_ord").cast("long") * 4
    summary = F.concat(F.lit("Session "), "session_id", F.lit(" contains "), F.col("n").cast("string"), F.lit(" user-provided pieces of information."))
    top = _node("summary", stable_id("mem_summary", "record_id", "session_id"), summary, 0.5, 1, end + 2)
    return _both(many, top, _node("abstract", stable_id("mem_abs", "record_id", "session_id", "n"), F.lit("The user shared multiple pieces of information in this session."), 0.45, 2, end + 3, None, F.col("event_ids")))


def memory_nodes(kept: DataFrame) -> DataFrame:
    """M4-M7: event and fact per retained turn, summary and abstract per session with two of them."""
    return turn_nodes(kept).unionByName(session_nodes(_sessions(kept)))


def memory_edges(kept: DataFrame) -> DataFrame:
    """M5, M7: a fact is derived from its event; a session's abstract covers its first five facts."""
    keys = [c for c in ("sample_id",) if c in kept.columns] + ["record_id"]
    event, fact = turn_ids()
    derived = kept.select(*keys, fact.alias("source"), event.alias("target"), F.lit("DERIVED_FROM").alias("edge_type"), F.lit(0.6).alias("confidence"))
    first = kept.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "session_id").orderBy("kept_ord"))).where("rn <= 5")
    tops = _sessions(kept).select(*keys, "session_id", stable_id("mem_abs", "record_id", "session_id", "n").alias("source"))
    covers = first.select(*keys, "session_id", fact.alias("target")).join(tops, [*keys, "session_id"])
    return derived.unionByName(covers.select(*keys, "source", "target", F.lit("ABSTRACTS").alias("edge_type"), F.lit(0.45).alias("confidence")))


def memory_summaries(nodes: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """M8: the five summary texts per record; empty where nothing is to say. ``records`` adds records without nodes."""
    keys = [c for c in ("sample_id",) if c in nodes.columns] + ["record_id"]
    low = F.lower("content")
    each = nodes.select(*keys, F.explode("source_session_ids").alias("s"), (F.col("node_type") == "event").cast("int").alias("e"), low.rlike(PREFERENCE_MARKERS).alias("p"), low.rlike(PLAN_MARKERS).alias("w"))
    per = each.groupBy(*keys).agg(F.countDistinct("s").alias("sessions"), F.sum("e").alias("events"), F.max("p").alias("p"), F.max("w").alias("w"))
    if records is not None:
        per = records.join(per, keys, "left")
    text = lambda cond, t: F.when(cond, F.lit(t)).otherwise(F.lit(""))
    changes = F.concat(F.lit("The user provided information across "), F.coalesce("sessions", F.lit(0)).cast("string"), F.lit(" sessions and "), F.coalesce("events", F.lit(0)).cast("string"), F.lit(" retained user turns."))
    return per.select(
        *keys,
        F.lit("").alias("user_profile"),
        text(F.col("p"), "The user has expressed preferences in the conversation.").alias("stable_preferences"),
        text(F.col("w"), "The user has mentioned plans or intentions.").alias("active_plans"),
        changes.alias("recent_changes"),
        F.lit("").alias("cross_session_abstractions"),
    )


def with_build_step(summaries: DataFrame, turns: DataFrame, by: str = "session") -> DataFrame:
    """One build step per slice of the history (session or turn)."""
    steps = turns.groupBy("record_id").agg((F.countDistinct("session_id") if by == "session" else F.count(F.lit(1))).alias("build_step"))
    return summaries.join(steps, "record_id", "left")


def build_variants(turns: DataFrame, configs: list[MemoryConfig]) -> DataFrame:
    """M9: nodes of several builds in one table, keyed by ``sample_id``; the list of configurations is short."""
    out = None
    for k, cfg in enumerate(configs):
        part = memory_nodes(retained_turns(turns, cfg).withColumn("sample_id", F.concat("record_id", F.lit(f":memory:{k}"))))
        out = part if out is None else out.unionByName(part)
    return out


def validate_memory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, code, path) of every broken rule."""
    empty = lambda c: F.size(c) == 0
    rules = [
        ("bad_type", ~F.col("node_type").isin(*NODE_TYPES)),
        ("confidence_range", ~F.col("confidence").between(0, 1)),
        ("level_range", ~F.col("abstraction_level").between(0, 5)),
        ("missing_provenance", (F.col("status") == "active") & (F.col("node_type") != "summary") & empty("source_session_ids") & empty("source_turn_ids") & empty("source_event_ids")),
        ("abstract_level", (F.col("node_type") == "abstract") & (F.col("abstraction_level") < 2)),
    ]
    faults = nodes.select("record_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in rules]))).alias("code"), F.col("node_id").alias("path"))
    twice = nodes.groupBy("record_id", F.col("node_id").alias("path")).count().where("count > 1").select("record_id", F.lit("duplicate_node_id").alias("code"), "path")
    out = faults.unionByName(twice)
    known = nodes.select("record_id", "node_id").distinct()
    for end in ("source", "target"):
        lost = edges.join(known.withColumnRenamed("node_id", end), ["record_id", end], "left_anti")
        out = out.unionByName(lost.select("record_id", F.lit(f"unknown_{end}").alias("code"), F.concat_ws("->", "source", "target").alias("path")))
    return out


def memory_stats(nodes: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Per record; records without memory appear with zeros."""
    n = nodes.groupBy("record_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "event").alias("events"), F.countDistinct(F.col("source_session_ids")[0]).alias("sessions"))
    e = edges.groupBy("record_id").agg(F.count(F.lit(1)).alias("edges"))
    out = turns.groupBy("record_id").agg(F.count(F.lit(1)).alias("turns")).join(n, "record_id", "left").join(e, "record_id", "left")
    return out.na.fill(0)


def memory_build_summary(stats: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Totals over records (M12) and those in ``failed`` (record_id), which count as failed and add nothing to
    the totals, whether they have stats or not. An event node stands for a retained turn."""
    ok = stats if failed is None else stats.join(failed.select("record_id").hint("merge"), "record_id", "left_anti")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    totals = ok.agg(F.count(F.lit(1)).alias("records"), *[count(c) for c in ("nodes", "edges", "events", "sessions", "turns")], F.count_if(F.col("nodes") == 0).alias("empty_records"))
    lost = totals.sparkSession.range(1).select(F.lit(0).cast("long").alias("n")) if failed is None else failed.agg(F.countDistinct("record_id").alias("n"))
    # one row each
    return totals.withColumn("k", F.lit(0)).join(F.broadcast(lost.withColumn("k", F.lit(0))), "k").drop("k").withColumnsRenamed({"n": "failed_records"}).withColumn("retained_turns", F.col("events"))
