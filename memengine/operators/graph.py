"""Oracle graphs of all records at once: typed nodes and edges from turns (deterministic analysis)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonicalize_name, normalize_text, stable_id

#: Fixed values.
TOPIC = "general_conversation"
OBJECT_CHARS, FACT_CHARS, RECENT_FACTS, SHOWN_FACTS, SUPPORTS = 160, 220, 8, 50, 5
EVIDENCE_NODES = ("fact", "event", "abstract_memory", "topic")
EVIDENCE_EDGES = ("EXTRACTED_AS", "SUPPORTS", "SUPERSEDES", "BELONGS_TO_TOPIC", "NEXT")
RELATION_EDGES = {"duplicate": "DUPLICATE_OF", "complement": "COMPLEMENTS", "refine": "COMPLEMENTS", "contradict": "CONTRADICTS", "supersede": "SUPERSEDES"}


def heuristic_facts(turns: DataFrame) -> DataFrame:
    """One ``said`` fact per turn, with ids of the nodes that its edges need."""
    text = normalize_text("text")
    subject = F.when(F.lower("speaker").isin("user", "human"), F.lit("user")).otherwise(F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit("speaker")))
    rows = turns.select("*", subject.alias("subject"), text.alias("clean"))
    rows = rows.withColumn("object", F.substring("clean", 1, OBJECT_CHARS)).withColumn("fact_text", F.concat("subject", F.lit(" said: "), F.substring("clean", 1, FACT_CHARS)))
    return rows.withColumns(
        {
            "fact_id": stable_id("fact", "record_id", "event_id", "subject", F.lit("said"), "object", "fact_text"),
            "session_node": stable_id("sess", "record_id", "session_id"),
            "topic_id": stable_id("topic", "record_id", F.lit(TOPIC)),
            "subject_id": stable_id("ent", canonicalize_name("subject")),
            "object_id": stable_id("ent", canonicalize_name("object")),
        }
    )


def entity_nodes(facts: DataFrame) -> DataFrame:
    """Mentions, subjects and objects resolved by canonical name; the first name and type win."""
    parts = facts.select(
        "record_id",
        F.explode(
            F.array(
                F.struct(F.col("subject_id").alias("id"), F.col("subject").alias("surface"), F.lit("person").alias("kind"), (F.col("event_ord") * 3).alias("ord")),
                F.struct(F.col("object_id").alias("id"), F.col("object").alias("surface"), F.lit("other").alias("kind"), (F.col("event_ord") * 3 + 2).alias("ord")),
            )
        ).alias("m"),
    ).select("record_id", "m.*")
    return parts.groupBy("record_id", F.col("id").alias("node_id")).agg(
        F.min_by(normalize_text("surface"), "ord").alias("name"),
        F.min_by("kind", "ord").alias("entity_type"),
        F.array_sort(F.collect_set("surface")).alias("aliases"),
        F.lit(0.5).alias("confidence"),
        F.min("ord").alias("first_ord"),
    )


def abstracts(facts: DataFrame) -> DataFrame:
    """One abstract per topic with two facts or more."""
    order = Window.partitionBy("record_id", "topic_id").orderBy("event_ord")
    ranked = facts.select("record_id", "topic_id", "fact_id", F.row_number().over(order).alias("rn")).where(F.col("rn") <= SHOWN_FACTS)
    per = ranked.groupBy("record_id", "topic_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= SUPPORTS, F.struct("rn", "fact_id")))), lambda x: x["fact_id"]).alias("supports"))
    summary = F.concat(F.lit("This topic contains "), F.col("n").cast("string"), F.lit(f" memory-worthy facts about {TOPIC}."))
    return per.where("n >= 2").withColumn("summary", summary).withColumn("node_id", stable_id("abs", "record_id", "topic_id", "summary"))


def oracle_nodes(turns: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The wide node table."""
    facts = heuristic_facts(turns) if facts is None else facts
    none = F.lit(None)

    def shaped(df, kind, **cols):
        names = ("session_id", "turn_id", "speaker", "text", "ts_raw", "name", "entity_type", "subject", "predicate", "object", "source_event_id", "summary", "confidence", "status")
        kinds = {"turn_id": "int", "confidence": "double"}
        return df.select("record_id", cols.pop("id"), F.lit(kind).alias("node_type"), *[cols.get(n, none).cast(kinds.get(n, "string")).alias(n) for n in names])

    col = F.col
    sessions = facts.groupBy("record_id", col("session_node").alias("node_id")).agg(F.first("session_id").alias("session_id"), F.min_by("ts_raw", "event_ord").alias("ts_raw"))
    events = facts.select("record_id", col("event_id").alias("node_id"), "session_id", "turn_id", "speaker", "text", "ts_raw")
    records = facts.select("record_id", "topic_id").distinct()
    roots = records.select("record_id", stable_id("topic", "record_id", F.lit("root")).alias("node_id"), F.concat(F.lit("record:"), "record_id").alias("name"))
    topics = records.select("record_id", col("topic_id").alias("node_id"), F.lit(TOPIC).alias("name"))
    out = [
        shaped(sessions, "session", id=col("node_id"), session_id=col("session_id"), ts_raw=F.coalesce("ts_raw", F.lit(""))),
        shaped(events, "event", id=col("node_id"), session_id=col("session_id"), turn_id=col("turn_id"), speaker=col("speaker"), text=col("text"), ts_raw=F.coalesce("ts_raw", F.lit(""))),
        shaped(roots, "topic", id=col("node_id"), name=col("name")),
        shaped(topics, "topic", id=col("node_id"), name=col("name")),
        shaped(entity_nodes(facts), "entity", id=col("node_id"), name=col("name"), entity_type=col("entity_type"), confidence=col("confidence")),
        shaped(facts.select("*", col("fact_id").alias("node_id")), "fact", id=col("node_id"), text=col("fact_text"), subject=col("subject"), predicate=F.lit("said"), object=col("object"), source_event_id=col("event_id"), confidence=F.lit(0.5), status=F.lit("active")),
        shaped(abstracts(facts), "abstract_memory", id=col("node_id"), summary=col("summary"), confidence=F.lit(0.5), status=F.lit("active")),
    ]
    nodes = out[0]
    for o in out[1:]:
        nodes = nodes.unionByName(o)
    return nodes


def fact_relations(facts: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Each fact against the last facts of its subject in the record: (record_id, new_fact, old_fact, rank,
    relation, confidence). With ``external`` (record_id, new_fact, old_fact, relation, confidence) its verdicts hold."""
    order = Window.partitionBy("record_id", "subject").orderBy("event_ord").rowsBetween(-RECENT_FACTS, -1)
    same = F.lower(normalize_text("object"))
    rows = facts.select("record_id", "event_ord", "subject", F.col("fact_id").alias("new_fact"), same.alias("key"))
    seen = rows.withColumn("old", F.collect_list(F.struct("event_ord", F.col("new_fact").alias("old_fact"), F.col("key").alias("old_key"))).over(order))
    pairs = seen.select("record_id", "event_ord", "new_fact", "key", F.posexplode("old").alias("rank", "o")).select("record_id", "event_ord", "new_fact", "key", "rank", "o.old_fact", "o.old_key")
    if external is None:
        return pairs.where("key = old_key").select("record_id", "event_ord", "new_fact", "old_fact", "rank", F.lit("duplicate").alias("relation"), F.lit(0.6).alias("confidence"))
    return pairs.hint("merge").join(external.hint("merge"), ["record_id", "new_fact", "old_fact"]).where("relation <> 'unrelated'").select("record_id", "event_ord", "new_fact", "old_fact", "rank", "relation", "confidence")


def oracle_edges(turns: DataFrame, facts: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """All edges, with the ordinal among parallel edges."""
    facts = heuristic_facts(turns) if facts is None else facts
    prev = F.lag("event_id").over(Window.partitionBy("record_id").orderBy("event_ord"))
    steps = [
        ("event_id", "session_node", "BELONGS_TO", None),
        ("prev_id", "event_id", "NEXT", None),
        ("event_id", "topic_id", "BELONGS_TO_TOPIC", None),
        ("event_id", "subject_id", "MENTIONS", 0.5),
        ("event_id", "fact_id", "EXTRACTED_AS", 0.5),
        ("fact_id", "subject_id", "FACT_SUBJECT", None),
        ("fact_id", "object_id", "FACT_OBJECT", None),
        ("fact_id", "topic_id", "BELONGS_TO_TOPIC", None),
    ]
    each = F.array(*[F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(kind).alias("edge_type"), F.lit(conf).cast("double").alias("confidence"), (F.col("event_ord").cast("long") * 100 + k).alias("edge_ord")) for k, (s, t, kind, conf) in enumerate(steps)])
    base = facts.withColumn("prev_id", prev).select("record_id", F.explode(each).alias("e")).select("record_id", "e.*").where("source is not null")
    kinds = F.create_map(*[F.lit(x) for kv in RELATION_EDGES.items() for x in kv])
    relations = fact_relations(facts, external).select("record_id", F.col("new_fact").alias("source"), F.col("old_fact").alias("target"), kinds[F.col("relation")].alias("edge_type"), F.col("confidence").cast("double"), (F.col("event_ord").cast("long") * 100 + 10 + F.col("rank")).alias("edge_ord"))
    tops = abstracts(facts)
    high = F.lit(1 << 40)
    up = tops.select("record_id", F.col("node_id").alias("source"), F.col("topic_id").alias("target"), F.lit("ABSTRACTS").alias("edge_type"), F.lit(None).cast("double").alias("confidence"), high.alias("edge_ord"))
    down = tops.select("record_id", "node_id", F.posexplode("supports").alias("k", "fact_id")).select("record_id", F.col("fact_id").alias("source"), F.col("node_id").alias("target"), F.lit("SUPPORTS").alias("edge_type"), F.lit(0.5).alias("confidence"), (high + 1 + F.col("k")).alias("edge_ord"))
    edges = base.unionByName(relations).unionByName(up).unionByName(down)
    key = F.row_number().over(Window.partitionBy("record_id", "source", "target").orderBy("edge_ord")) - 1
    return edges.withColumn("edge_key", key)


def stale_facts(relations: DataFrame) -> DataFrame:
    """Facts that a later fact supersedes."""
    return relations.where("relation = 'supersede'").select("record_id", F.col("old_fact").alias("node_id"), F.lit("stale").alias("status")).distinct()


def sanitize_abstracts(proposals: DataFrame, shown: DataFrame) -> DataFrame:
    """The first three proposals of a topic, supports inside the shown facts only, none without support.

    proposals (record_id, topic_id, ord, summary, scope, confidence, supporting_fact_ids); shown (record_id, topic_id,
    fact_id)."""
    first = proposals.withColumn("rn", F.row_number().over(Window.partitionBy("record_id", "topic_id").orderBy("ord"))).where("rn <= 3")
    each = first.select("*", F.posexplode("supporting_fact_ids").alias("k", "fact_id"))
    kept = each.hint("merge").join(shown.distinct().hint("merge"), ["record_id", "topic_id", "fact_id"], "left_semi")
    return kept.groupBy("record_id", "topic_id", "ord", "summary", "scope", "confidence").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "fact_id"))), lambda x: x["fact_id"]).alias("supporting_fact_ids"))


def evidence_pack(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P18."""
    return nodes.where(F.col("node_type").isin(*EVIDENCE_NODES)), edges.where(F.col("edge_type").isin(*EVIDENCE_EDGES))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by kind, per record."""
    n = nodes.groupBy("record_id", F.lit("node").alias("part"), F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("record_id", F.lit("edge").alias("part"), F.col("edge_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(e)
