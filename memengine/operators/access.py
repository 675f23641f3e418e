"""Checks and look-ups on oracle graphs: integrity, sessions of nodes, neighbours, evidence text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_text
from ..sources.durable import durable

#: Edge types along which sessions travel, by the kind of node they reach.
SESSION_EDGES = {"fact": ("EXTRACTED_AS",), "abstract_memory": ("SUPPORTS",), "entity": ("MENTIONS", "FACT_SUBJECT", "FACT_OBJECT"), "topic": ("BELONGS_TO_TOPIC",)}


def graph_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, code, path) of every fault: missing fields, repeated ids, unknown ends."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    kinds = [("missing_node_id", blank("node_id")), ("missing_node_type", blank("node_type")), ("missing_record_id", blank("record_id"))]
    missing = nodes.select("record_id", F.col("node_id").alias("path"), F.explode(F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in kinds]))).alias("code"))
    twice = nodes.where(~blank("node_id")).groupBy("record_id", F.col("node_id").alias("path")).count().where("count > 1").select("record_id", "path", F.lit("duplicate_node_id").alias("code"))
    fields = [("edge_missing_source", blank("source")), ("edge_missing_target", blank("target")), ("edge_missing_type", blank("edge_type"))]
    parts = edges.select("record_id", F.concat_ws("->", "source", "target").alias("path"), F.explode(F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in fields]))).alias("code"))
    known = nodes.select("record_id", "node_id").distinct()
    out = missing.unionByName(twice).unionByName(parts)
    for end in ("source", "target"):
        lost = edges.where(~blank(end)).join(known.withColumnRenamed("node_id", end), ["record_id", end], "left_anti")
        out = out.unionByName(lost.select("record_id", F.concat_ws("->", "source", "target").alias("path"), F.lit(f"unknown_{end}").alias("code")))
    return out.select("record_id", "code", "path")


def infer_sessions(nodes: DataFrame, edges: DataFrame, mode: str = "graph") -> DataFrame:
    """(record_id, node_id, session_id). Sessions start at session and event nodes and travel over evidence
    edges until a round reaches nothing new; each round is written. ``walk`` leaves topics out and asks for no kind of target."""
    seed = nodes.where("node_type in ('session', 'event') and session_id is not null").select("record_id", "node_id", "session_id")
    kinds = nodes.select("record_id", "node_id", "node_type")
    by_source = nodes.where("node_type = 'fact' and source_event_id is not null").select("record_id", F.col("source_event_id").alias("source"), F.col("node_id").alias("target"), F.lit("fact").alias("node_type"))
    if mode == "walk":
        all_kinds = [e for k, v in SESSION_EDGES.items() if k != "topic" for e in v]
        flow = edges.where(F.col("edge_type").isin(*all_kinds)).join(kinds.withColumnRenamed("node_id", "target"), ["record_id", "target"]).select("record_id", "source", "target", "node_type")
    else:
        typed = edges.join(kinds.withColumnRenamed("node_id", "target"), ["record_id", "target"])
        ok = F.lit(False)
        for kind, types in SESSION_EDGES.items():
            ok = ok | ((F.col("node_type") == kind) & F.col("edge_type").isin(*types))
        flow = typed.where(ok).select("record_id", "source", "target", "node_type")
    flow = flow.unionByName(by_source).distinct()

    def step(have):
        return have.withColumnRenamed("node_id", "source").join(flow, ["record_id", "source"]).select("record_id", F.col("target").alias("node_id"), "session_id")

    flow = durable(flow)
    out = new = durable(seed.distinct())
    while True:
        new = durable(step(new).distinct().join(out, ["record_id", "node_id", "session_id"], "left_anti"))
        if new.isEmpty():
            return out
        out = out.unionByName(new)


def neighbors(edges: DataFrame, nodes: DataFrame, ids: DataFrame, direction: str = "both", types: tuple[str, ...] | None = None) -> DataFrame:
    """(record_id, node_id, neighbor_id) of ``ids`` (record_id, node_id), existing nodes only, each once."""
    use = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    parts = []
    if direction in ("out", "both"):
        parts.append(use.select("record_id", F.col("source").alias("node_id"), F.col("target").alias("neighbor_id")))
    if direction in ("in", "both"):
        parts.append(use.select("record_id", F.col("target").alias("node_id"), F.col("source").alias("neighbor_id")))
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    known = nodes.select("record_id", F.col("node_id").alias("neighbor_id"))
    return pairs.join(ids, ["record_id", "node_id"], "left_semi").join(known, ["record_id", "neighbor_id"], "left_semi").select("record_id", "node_id", "neighbor_id").distinct()


def nodes_for_session(sessions: DataFrame) -> DataFrame:
    """Nodes of each session."""
    return sessions.groupBy("record_id", "session_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def sessions_for_nodes(sessions: DataFrame) -> DataFrame:
    """Sessions of each node, sorted."""
    return sessions.groupBy("record_id", "node_id").agg(F.array_sort(F.collect_set("session_id")).alias("session_ids"))


def evidence_context(sets: DataFrame, nodes: DataFrame, edges: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One text per set (record_id, set_id, ord, node_id): a block per node with the fields of its kind, then the
    edges between nodes of the set."""
    field = lambda label, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    shown = [("Session", "session_id"), ("Speaker", "speaker"), ("Text", "text"), ("Name", "name"), ("Subject", "subject"), ("Object", "object"), ("Summary", "summary")]
    block = F.concat_ws("\n", F.concat(F.lit("["), "node_type", F.lit("] "), "node_id"), *[field(a, b) for a, b in shown])
    texts = sets.hint("merge").join(nodes.hint("merge"), ["record_id", "node_id"]).groupBy("record_id", "set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    a = sets.select("record_id", "set_id", F.col("node_id").alias("source"))
    b = sets.select("record_id", "set_id", F.col("node_id").alias("target"))
    inside = edges.hint("merge").join(a.hint("merge"), ["record_id", "source"]).hint("merge").join(b.hint("merge"), ["record_id", "set_id", "target"])
    line = F.concat_ws(" ", "source", F.concat(F.lit("-["), "edge_type", F.lit("]->")), "target")
    lines = inside.groupBy("record_id", "set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    text = F.concat_ws("\n\n", "body", "lines")
    out = texts.hint("merge").join(lines.hint("merge"), ["record_id", "set_id"], "left").select("record_id", "set_id", text.alias("context"))
    return out if max_chars is None else out.withColumn("context", F.substring("context", 1, max_chars))


def generic_entities(nodes: DataFrame) -> DataFrame:
    """Entities that stand for a speaker and connect everything with everything."""
    return nodes.where((F.col("node_type") == "entity") & F.lower(normalize_text("name")).isin("user", "assistant", "speaker", "unknown")).select("record_id", "node_id")


def nodes_where(nodes: DataFrame, node_id: str | None = None, node_type: str | None = None) -> DataFrame:
    """The nodes of all records with an id, of a type, or both; without either all of them."""
    for name, wanted in (("node_id", node_id), ("node_type", node_type)):
        nodes = nodes if wanted is None else nodes.where(F.col(name) == wanted)
    return nodes


def edges_where(edges: DataFrame, source: str | None = None, target: str | None = None, key: int | str | None = None, edge_type: str | None = None) -> DataFrame:
    """The edges of all records that fit every given end, key (compared as text) and type."""
    for name, wanted in (("source", source), ("target", target), ("edge_type", edge_type)):
        edges = edges if wanted is None else edges.where(F.col(name) == wanted)
    return edges if key is None else edges.where(F.col("edge_key").cast("string") == str(key))


def look_up(table: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("record_id", "node_id"), strict: bool = False) -> DataFrame:
    """A row for each of ``wanted`` (the columns ``keys``), with what ``table`` holds under its key and ``found``.
    What is not there has nulls, or with ``strict`` fails the query. Keys are compared as text; one that stands several
    times in ``table``, as a node that was read twice, gives a row each time."""
    text = lambda df: df.withColumns({f"_{k}": F.col(k).cast("string") for k in keys})
    asked = text(wanted.select(*keys))
    held = text(table).drop(*keys).withColumn("found", F.lit(True))
    out = asked.hint("merge").join(held.hint("merge"), [f"_{k}" for k in keys], "left").drop(*[f"_{k}" for k in keys])
    found = F.coalesce("found", F.lit(False))
    if strict:
        found = F.when(found, True).otherwise(F.raise_error(F.concat(F.lit("not in the table: "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return out.withColumn("found", found)
