"""Constrained weighted random walks over the oracle graphs of all records at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, normalize_text, unit_hash
from ..sources.durable import durable
from .access import generic_entities

#: How informative a next node is, and how edge types change that.
NODE_WEIGHTS = {"fact": 6.0, "abstract_memory": 5.0, "event": 2.4, "entity": 1.6, "topic": 0.7, "session": 0.2}
EDGE_FACTORS = {"EXTRACTED_AS": 2.0, "SUPPORTS": 2.0, "FACT_SUBJECT": 2.0, "FACT_OBJECT": 2.0, "BELONGS_TO": 0.5, "BELONGS_TO_TOPIC": 0.5, "ABSTRACTS": 0.5, "NEXT": 0.55}
MAX_STRUCTURAL = 0.35


def _map(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def adjacency(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """(record_id, node_id, next_id, edge_type, traversal, edge_ord, weight). Edges to unknown nodes and
    bridges over speaker entities are gone, weights are worked out, so a step is one join."""
    hubs = generic_entities(nodes).distinct().withColumn("hub", F.lit(True))
    kinds = nodes.select("record_id", "node_id", "node_type").hint("merge").join(hubs.hint("merge"), ["record_id", "node_id"], "left")
    known = edges
    for end in ("source", "target"):
        known = known.hint("merge").join(kinds.select("record_id", F.col("node_id").alias(end), F.col("node_type").alias(f"{end}_type"), F.col("hub").alias(f"{end}_hub")).hint("merge"), ["record_id", end])
    bridge = F.col("edge_type").isin("FACT_SUBJECT", "FACT_OBJECT", "MENTIONS")
    kept = known.where(~bridge | (bridge & F.col("source_hub").isNull() & F.col("target_hub").isNull()))
    way = lambda a, b, name: F.struct(F.col(a).alias("node_id"), F.col(b).alias("next_id"), F.col(f"{b}_type").alias("next_type"), F.lit(name).alias("traversal"))
    ways = [way("source", "target", "out")] + ([] if directed else [way("target", "source", "in")])
    out = kept.select("record_id", "edge_type", "edge_ord", F.explode(F.array(*ways)).alias("w")).select("record_id", "w.node_id", "w.next_id", "w.next_type", "edge_type", "w.traversal", "edge_ord")
    weight = F.coalesce(_map(NODE_WEIGHTS)[F.col("next_type")], F.lit(1.0)) * F.coalesce(_map(EDGE_FACTORS)[F.col("edge_type")], F.lit(1.0))
    return out.withColumn("weight", weight)


def walk_starts(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(record_id, pos, node_id, n): facts and abstracts with neighbours, all nodes with neighbours where a record
    has none; ``n`` is how many the record has."""
    linked = nodes.hint("merge").join(adj.select("record_id", "node_id").distinct().hint("merge"), ["record_id", "node_id"], "left_semi").select("record_id", "node_id", F.col("node_type").isin("abstract_memory", "fact").cast("int").alias("good"))
    whole = Window.partitionBy("record_id")
    best = linked.withColumn("best", F.max("good").over(whole)).where("good = best")
    return best.select("record_id", "node_id", (F.row_number().over(whole.orderBy("node_id")) - 1).alias("pos"), F.count(F.lit(1)).over(whole).alias("n"))


def _walk(adj: DataFrame, starts: DataFrame, first: int, last: int, length: int, seed: int, max_next: int) -> DataFrame:
    """The attempts ``first`` to ``last`` of the records of ``starts``; each step's frontier is written out."""
    tries = starts.where("pos = 0").select("record_id", "n", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("attempt"))
    pick = F.least(F.floor(unit_hash(F.lit(seed), "record_id", "attempt") * F.col("n")), F.col("n") - 1)
    at = tries.withColumn("pos", pick).hint("merge").join(starts.select("record_id", "pos", "node_id").hint("merge"), ["record_id", "pos"])
    at = durable(at.select("record_id", "attempt", "node_id", F.lit(None).cast("string").alias("prev_id"), F.lit(0).alias("run")))
    out = at.select("record_id", "attempt", F.lit(0).alias("step"), "node_id", F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("string").alias("traversal"))
    for k in range(1, length):
        options = at.hint("merge").join(adj.hint("merge"), ["record_id", "node_id"]).where("prev_id is null or next_id <> prev_id")
        if max_next >= 0:
            options = options.where((F.col("edge_type") != "NEXT") | (F.col("run") < max_next))
        race = -F.log(unit_hash(F.lit(seed), "record_id", "attempt", F.lit(k), "edge_ord", "traversal")) / F.col("weight")
        best = options.groupBy("record_id", "attempt").agg(F.min(F.struct(race.alias("race"), "edge_ord", "traversal", "next_id", "edge_type", "node_id", "run")).alias("b"))
        at = durable(best.select("record_id", "attempt", F.col("b.next_id").alias("node_id"), F.col("b.node_id").alias("prev_id"), F.when(F.col("b.edge_type") == "NEXT", F.col("b.run") + 1).otherwise(F.lit(0)).alias("run"), "b.edge_type", "b.traversal"))
        out = out.unionByName(at.select("record_id", "attempt", F.lit(k).alias("step"), "node_id", "edge_type", "traversal"))
        at = at.select("record_id", "attempt", "node_id", "prev_id", "run")
    return out


def random_walks(nodes: DataFrame, edges: DataFrame, attempts: int = 30, length: int = 5, seed: int = 42, max_next: int = -1) -> DataFrame:
    """(record_id, attempt, step, node_id, edge_type, traversal) of every attempt. A walk starts at a fact
    or abstract with neighbours (at any node with neighbours where a record has none) and takes each step by an
    exponential race over hashed draws: the same walk on every run and partitioning. The adjacency and each
    step's frontier are written out, as later steps read them again."""
    adj = durable(adjacency(nodes, edges))
    return _walk(adj, durable(walk_starts(nodes, adj)), 1, attempts, length, seed, max_next)


def _about(nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(record_id, node_id, node_type, session_ids) of all nodes, so that a step of a walk is looked up once."""
    of_node = sessions.groupBy("record_id", "node_id").agg(F.collect_set("session_id").alias("session_ids"))
    return nodes.select("record_id", "node_id", "node_type").hint("merge").join(of_node.hint("merge"), ["record_id", "node_id"], "left")


def _good_walks(steps: DataFrame, about: DataFrame, min_nodes: int, min_sessions: int) -> DataFrame:
    typed = steps.hint("merge").join(about.hint("merge"), ["record_id", "node_id"])
    walks = typed.groupBy("record_id", "attempt").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("step", "node_id"))), lambda x: x["node_id"]).alias("node_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("session_ids")))).alias("session_ids"),
        F.max(F.col("node_type").isin("fact", "abstract_memory").cast("int")).alias("evidence"),
        F.size(F.collect_set(F.when(F.col("node_type").isin("topic", "session"), F.col("step")))).alias("structural"),
    )
    good = (F.col("n_nodes") >= min_nodes) & (F.col("evidence") == 1) & (F.size("session_ids") >= min_sessions) & (F.col("structural") / F.col("n_nodes") <= MAX_STRUCTURAL)
    return walks.withColumn("n_nodes", F.size("node_ids")).where(good).select("record_id", "node_ids", "session_ids", "n_nodes", "attempt")


def _first_walks(good: DataFrame, num_walks: int) -> DataFrame:
    """The first attempt of each sequence of nodes, the first ``num_walks`` of a record, with their place ``rn``."""
    first = good.groupBy("record_id", "node_ids", "session_ids", "n_nodes").agg(F.min("attempt").alias("attempt"))
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("record_id").orderBy("attempt"))).where(F.col("rn") <= num_walks)


def _numbered(ranked: DataFrame) -> DataFrame:
    return ranked.select("record_id", F.format_string("traj_%04d", "rn").alias("trajectory_id"), "attempt", "node_ids", "session_ids", "n_nodes")


def accept_walks(steps: DataFrame, nodes: DataFrame, sessions: DataFrame, num_walks: int = 8, min_nodes: int = 2, min_sessions: int = 0) -> DataFrame:
    """The first ``num_walks`` attempts per record with an evidence node, few structural nodes, enough sessions
    and a new sequence of nodes; numbered traj_0001 on. Columns: node_ids, session_ids, n_nodes."""
    return _numbered(_first_walks(_good_walks(steps, _about(nodes, sessions), min_nodes, min_sessions), num_walks))


def accepted_walks(nodes: DataFrame, edges: DataFrame, sessions: DataFrame, num_walks: int = 8, attempts: int | None = None, length: int = 5, seed: int = 42, max_next: int = -1, min_nodes: int = 2, min_sessions: int = 0) -> DataFrame:
    """What ``accept_walks`` gives of ``attempts`` walks (30 for each wanted one), walked in waves: records that
    have their ``num_walks`` leave, and the others' next wave is four times as long, so a record walks about as often as
    it needs and the number of waves grows with the logarithm of ``attempts``."""
    attempts = 30 * num_walks if attempts is None else attempts
    adj = durable(adjacency(nodes, edges))
    starts = durable(walk_starts(nodes, adj))
    about = durable(_about(nodes, sessions))
    kept, first, size = None, 1, 3 * num_walks
    while True:
        last = min(attempts, first + size - 1)
        good = _good_walks(_walk(adj, starts, first, last, length, seed, max_next), about, min_nodes, min_sessions)
        kept = durable(_first_walks(good if kept is None else kept.drop("rn").unionByName(good), num_walks))
        if last == attempts:
            return _numbered(kept)
        full = kept.where(F.col("rn") == num_walks).select("record_id")
        starts = durable(starts.hint("merge").join(full.hint("merge"), "record_id", "left_anti"))
        if starts.isEmpty():
            return _numbered(kept)
        first, size = last + 1, 4 * size


#: Which field of a node its label is made of.
LABEL_SOURCES = {"event": "speaker:text", "fact": "text", "abstract_memory": "summary", "entity": "name", "topic": "name", "session": "session_id"}


def node_labels(nodes: DataFrame, limit: int = 300, limits: dict[str, int] | None = None) -> DataFrame:
    """(record_id, node_id, node_type, label, truncated, label_source). ``limits`` sets other limits for node types;
    zero or less cuts nothing. Nodes of other types are labelled by all their fields as JSON, from ``node``."""
    raw = (
        F.when(F.col("node_type") == "event", F.concat(F.coalesce(F.nullif("speaker", F.lit("")), F.lit("unknown")), F.lit(": "), F.coalesce("text", F.lit(""))))
        .when(F.col("node_type") == "fact", F.coalesce(F.nullif("text", F.lit("")), F.concat_ws(" ", "subject", "predicate", "object")))
        .when(F.col("node_type") == "abstract_memory", F.coalesce("summary", F.lit("")))
        .when(F.col("node_type").isin("entity", "topic"), F.coalesce("name", F.lit("")))
        .when(F.col("node_type") == "session", F.coalesce("session_id", F.lit("")))
        .otherwise(F.to_json(F.struct(*nodes.columns)))
    )
    label, most = clip(raw, limit), F.lit(limit)
    for kind, own in (limits or {}).items():
        here = F.col("node_type") == kind
        label, most = F.when(here, clip(raw, own)).otherwise(label), F.when(here, F.lit(own)).otherwise(most)
    cut = (most > 0) & (F.length(normalize_text(raw)) > most)
    return nodes.select("record_id", "node_id", "node_type", label.alias("label"), cut.alias("truncated"), F.coalesce(_map(LABEL_SOURCES)[F.col("node_type")], F.lit("node")).alias("label_source"))


def walk_text(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """One line per walk, nodes and arrows in turn."""
    arrow = F.when(F.col("traversal") == "out", "->").otherwise("<-")
    part = F.concat(F.when(F.col("step") > 0, F.concat(arrow, F.lit(" "), "edge_type", F.lit(" "), arrow, F.lit(" "))).otherwise(F.lit("")), F.lit("["), "node_type", F.lit("] "), "label")
    rows = steps.join(labels, ["record_id", "node_id"]).withColumn("part", part)
    return rows.groupBy("record_id", "attempt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "part"))), lambda x: x["part"]), " ").alias("text"))
