"""Queries over oracle graphs built from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, graph
from ..sources.durable import durable
from ..sources.turns import turns_from_conversations
from . import sqlparts as S
from .base import query, table


def turns_of(spark, sf_dir):
    return turns_from_conversations(table(spark, sf_dir, "conversations"))


def facts_of(spark, sf_dir):
    return graph.heuristic_facts(turns_of(spark, sf_dir))


def graph_of(spark, sf_dir):
    """Nodes and edges; their many parts read facts that are worked out and written once."""
    f = durable(facts_of(spark, sf_dir).drop("clean", "session_ord"))
    return graph.oracle_nodes(f, f), graph.oracle_edges(f, f)


@query("s6_m1_turns", f"WITH {S.TURNS} SELECT record_id, session_id, session_ord, turn_id, event_ord, event_id, speaker, text FROM turns")
def turns(spark, sf_dir):
    return turns_of(spark, sf_dir).drop("ts_raw")


NODE_COLUMNS = "record_id, node_id, node_type, session_id, speaker, text, name, entity_type, subject, object, source_event_id, summary"


@query("g1_g6_g10_oracle_nodes", f"WITH {S.NODES} SELECT {NODE_COLUMNS} FROM nodes")
def nodes(spark, sf_dir):
    return graph_of(spark, sf_dir)[0].select(*NODE_COLUMNS.split(", "))


@query("g2_g7_g9_g12_oracle_edges", f"WITH {S.GRAPH} SELECT record_id, source, target, edge_key, edge_ord, edge_type FROM edges")
def edges(spark, sf_dir):
    return graph_of(spark, sf_dir)[1].select("record_id", "source", "target", "edge_key", "edge_ord", "edge_type")


@query("g5_entity_aliases", f"WITH {S.NODES} SELECT record_id, node_id, name, entity_type, aliases FROM entities")
def entities(spark, sf_dir):
    return graph.entity_nodes(facts_of(spark, sf_dir)).select("record_id", "node_id", "name", "entity_type", F.array_join("aliases", "|").alias("aliases"))


@query("g8_fact_relations", f"WITH {S.FACTS}, {S.RELATIONS} SELECT record_id, new_fact, old_fact, rank FROM relations")
def relations(spark, sf_dir):
    return graph.fact_relations(facts_of(spark, sf_dir)).select("record_id", "new_fact", "old_fact", "rank")


@query(
    "g13_graph_summary",
    f"WITH {S.GRAPH} SELECT record_id, 'node' AS part, node_type AS kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT record_id, 'edge', edge_type, count(*) FROM edges GROUP BY ALL",
)
def summary(spark, sf_dir):
    return graph.graph_summary(*graph_of(spark, sf_dir))


@query(
    "p18_evidence_pack",
    f"""WITH {S.GRAPH} SELECT record_id, sum(n)::BIGINT AS n_nodes, sum(e)::BIGINT AS n_edges FROM (
      SELECT record_id, 1 AS n, 0 AS e FROM nodes WHERE node_type IN ('fact', 'event', 'abstract_memory', 'topic')
      UNION ALL SELECT record_id, 0, 1 FROM edges WHERE edge_type IN ('EXTRACTED_AS', 'SUPPORTS', 'SUPERSEDES', 'BELONGS_TO_TOPIC', 'NEXT')) GROUP BY record_id""",
)
def evidence_pack(spark, sf_dir):
    n, e = graph.evidence_pack(*graph_of(spark, sf_dir))
    both = n.select("record_id", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(e.select("record_id", F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.groupBy("record_id").agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"))


@query(
    "w1_graph_integrity",
    f"""WITH {S.GRAPH}, left_nodes AS (SELECT * FROM nodes WHERE node_type <> 'topic' UNION ALL SELECT * FROM nodes WHERE node_type = 'session')
    SELECT record_id, 'duplicate_node_id' AS code, node_id AS path FROM left_nodes GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT record_id, 'unknown_target', source || '->' || target FROM edges e WHERE NOT EXISTS (SELECT 1 FROM left_nodes n WHERE n.record_id = e.record_id AND n.node_id = e.target)
    UNION ALL SELECT record_id, 'unknown_source', source || '->' || target FROM edges e WHERE NOT EXISTS (SELECT 1 FROM left_nodes n WHERE n.record_id = e.record_id AND n.node_id = e.source)""",
)
def integrity(spark, sf_dir):
    """Of graphs broken on purpose: topics gone, sessions twice."""
    n, e = graph_of(spark, sf_dir)
    return access.graph_integrity(n.where("node_type <> 'topic'").unionByName(n.where("node_type = 'session'")), e)


_FLOW = f"""{S.GRAPH},
flow AS (SELECT DISTINCT e.record_id, e.source, e.target FROM edges e JOIN nodes n ON n.record_id = e.record_id AND n.node_id = e.target
  WHERE (n.node_type = 'fact' AND edge_type = 'EXTRACTED_AS') OR (n.node_type = 'abstract_memory' AND edge_type = 'SUPPORTS')
    OR (n.node_type = 'entity' AND edge_type IN ('MENTIONS', 'FACT_SUBJECT', 'FACT_OBJECT')) OR (n.node_type = 'topic' AND edge_type = 'BELONGS_TO_TOPIC')
  UNION SELECT record_id, source_event_id, node_id FROM nodes WHERE node_type = 'fact'),
seed AS (SELECT record_id, node_id, session_id FROM nodes WHERE node_type IN ('session', 'event'))"""


@query(
    "w2_infer_sessions",
    f"""WITH RECURSIVE {_FLOW}, reach AS (SELECT record_id, node_id, session_id FROM seed UNION
      SELECT f.record_id, f.target, r.session_id FROM reach r JOIN flow f ON f.record_id = r.record_id AND f.source = r.node_id)
    SELECT record_id, node_id, session_id FROM reach""",
)
def sessions(spark, sf_dir):
    return access.infer_sessions(*graph_of(spark, sf_dir))


@query(
    "w3_walk_sessions",
    f"""WITH RECURSIVE {_FLOW}, wflow AS (SELECT DISTINCT record_id, source, target FROM edges WHERE edge_type IN ('EXTRACTED_AS', 'SUPPORTS', 'MENTIONS', 'FACT_SUBJECT', 'FACT_OBJECT')
      UNION SELECT record_id, source_event_id, node_id FROM nodes WHERE node_type = 'fact'),
    reach AS (SELECT record_id, node_id, session_id FROM seed UNION SELECT f.record_id, f.target, r.session_id FROM reach r JOIN wflow f ON f.record_id = r.record_id AND f.source = r.node_id)
    SELECT record_id, node_id, array_to_string(list_sort(list(session_id)), '|') AS session_ids FROM reach GROUP BY ALL""",
)
def walk_sessions(spark, sf_dir):
    out = access.sessions_for_nodes(access.infer_sessions(*graph_of(spark, sf_dir), mode="walk"))
    return out.select("record_id", "node_id", F.array_join("session_ids", "|").alias("session_ids"))


@query(
    "w4_neighbors",
    f"""WITH {S.GRAPH}, ids AS (SELECT record_id, node_id FROM nodes WHERE node_type = 'fact'),
    pairs AS (SELECT record_id, source AS node_id, target AS neighbor_id FROM edges WHERE edge_type IN ('EXTRACTED_AS', 'FACT_SUBJECT', 'SUPPORTS')
      UNION SELECT record_id, target, source FROM edges WHERE edge_type IN ('EXTRACTED_AS', 'FACT_SUBJECT', 'SUPPORTS'))
    SELECT DISTINCT p.* FROM pairs p JOIN ids USING (record_id, node_id)""",
)
def neighbors(spark, sf_dir):
    n, e = graph_of(spark, sf_dir)
    return access.neighbors(e, n, n.where("node_type = 'fact'").select("record_id", "node_id"), types=("EXTRACTED_AS", "FACT_SUBJECT", "SUPPORTS"))


@query(
    "w5_session_nodes",
    f"""WITH RECURSIVE {_FLOW}, reach AS (SELECT record_id, node_id, session_id FROM seed UNION
      SELECT f.record_id, f.target, r.session_id FROM reach r JOIN flow f ON f.record_id = r.record_id AND f.source = r.node_id)
    SELECT record_id, session_id, count(*) AS n_nodes, sha1(array_to_string(list_sort(list(node_id)), '|')) AS nodes_hash FROM reach GROUP BY ALL""",
)
def session_nodes(spark, sf_dir):
    out = access.nodes_for_session(access.infer_sessions(*graph_of(spark, sf_dir)))
    return out.select("record_id", "session_id", "n_nodes", F.sha1(F.array_join("node_ids", "|").cast("binary")).alias("nodes_hash"))


@query(
    "w7_evidence_context",
    f"""WITH {S.GRAPH}, sets AS (SELECT record_id, session_id AS set_id, event_ord * 2 AS ord, event_id AS node_id FROM facts UNION ALL SELECT record_id, session_id, event_ord * 2 + 1, fact_id FROM facts),
    blocks AS (SELECT s.record_id, s.set_id, s.ord, concat_ws(chr(10), '[' || n.node_type || '] ' || n.node_id, 'Session: ' || nullif(n.session_id, ''), 'Speaker: ' || nullif(n.speaker, ''),
      'Text: ' || nullif(n.text, ''), 'Name: ' || nullif(n.name, ''), 'Subject: ' || nullif(n.subject, ''), 'Object: ' || nullif(n.object, ''), 'Summary: ' || nullif(n.summary, '')) AS b
      FROM sets s JOIN nodes n ON n.record_id = s.record_id AND n.node_id = s.node_id),
    body AS (SELECT record_id, set_id, string_agg(b, chr(10) || chr(10) ORDER BY ord) AS body FROM blocks GROUP BY ALL),
    lines AS (SELECT a.record_id, a.set_id, string_agg(e.source || ' -[' || e.edge_type || ']-> ' || e.target, chr(10) ORDER BY e.edge_ord) AS lines FROM edges e
      JOIN sets a ON a.record_id = e.record_id AND a.node_id = e.source JOIN sets b ON b.record_id = e.record_id AND b.node_id = e.target AND b.set_id = a.set_id GROUP BY ALL)
    SELECT record_id, set_id, concat_ws(chr(10) || chr(10), body, lines) AS context FROM body LEFT JOIN lines USING (record_id, set_id)""",
)
def context(spark, sf_dir):
    f = facts_of(spark, sf_dir)
    n, e = graph_of(spark, sf_dir)
    sets = f.select("record_id", F.col("session_id").alias("set_id"), F.posexplode(F.array("event_id", "fact_id")).alias("k", "node_id"), "event_ord")
    return access.evidence_context(sets.select("record_id", "set_id", (F.col("event_ord") * 2 + F.col("k")).alias("ord"), "node_id"), n, e)
