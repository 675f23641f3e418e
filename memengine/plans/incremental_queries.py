"""Queries over memory and summaries that are kept up step by step."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.incremental import MemoryTable, averages, batch_totals, merged_totals
from ..operators.proposals import sanitize_event_analyses, tied_facts
from ..sources.durable import shared_folder
from ..streaming.stateful import CHANGES, folded_nodes, stream_memory
from ..streaming.streams import stream_turns
from . import sqlparts as S
from .base import query, table
from .graph_queries import turns_of


def grown_memory(spark, sf_dir) -> MemoryTable:
    """Memory of all records, grown by one session of each record at a time."""
    folder = f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}"
    turns_of(spark, sf_dir).write.partitionBy("session_ord").parquet(f"{folder}/turns")
    turns = spark.read.parquet(f"{folder}/turns")
    memory = MemoryTable(spark, folder)
    for (session,) in turns.select("session_ord").distinct().orderBy("session_ord").collect():
        memory.apply(turns.where(F.col("session_ord") == session))
    return memory


@query(
    "m10_incremental_memory",
    f"""WITH {S.MEMORY}, o AS (SELECT DISTINCT record_id, session_id, session_ord FROM turns)
    SELECT record_id, node_id, node_type, content, session_id, turn_ids, event_ids, node_ord, session_ord::INT AS version FROM memory JOIN o USING (record_id, session_id)""",
)
def incremental_memory(spark, sf_dir):
    """Every node of the memory grown session by session, and the build step that made it."""
    return grown_memory(spark, sf_dir).nodes().select(
        "record_id", "node_id", "node_type", "content", F.col("source_session_ids")[0].alias("session_id"),
        F.array_join("source_turn_ids", "|").alias("turn_ids"), F.array_join("source_event_ids", "|").alias("event_ids"), "node_ord", "version",
    )


@query(
    "m10_memory_state",
    f"""WITH {S.MEMORY}, {S.SUMMARIES}, steps AS (SELECT record_id, count(DISTINCT session_id) AS build_step FROM turns GROUP BY record_id)
    SELECT record_id, build_step, coalesce(recent_changes, 'The user provided information across 0 sessions and 0 retained user turns.') AS recent_changes,
      coalesce(stable_preferences, '') AS stable_preferences, coalesce(active_plans, '') AS active_plans FROM steps LEFT JOIN summaries USING (record_id)""",
)
def memory_state(spark, sf_dir):
    """Build step and summary texts of every record, from the state after the last slice."""
    memory = grown_memory(spark, sf_dir)
    return memory.records().select("record_id", "build_step").join(memory.summaries(), "record_id").select("record_id", "build_step", "recent_changes", "stable_preferences", "active_plans")


@query(
    "t1_t2_streamed_memory",
    f"WITH {S.MEMORY} SELECT record_id, node_id, node_type, content, session_id, event_ids FROM memory",
)
def streamed_memory(spark, sf_dir):
    """All conversations as a stream of files, folded into memory by state; what stands at its end is the memory."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a pattern, as the table may be one file
    changes = stream_memory(stream_turns(spark, f"{sf_dir}/conversations.parque[t]"))
    stream = changes.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/changes").trigger(availableNow=True).start()
    stream.awaitTermination()
    nodes = folded_nodes(spark.read.schema(CHANGES).parquet(f"{where}/changes"))
    return nodes.withColumn("event_ids", F.array_join("event_ids", "|"))


@query(
    "v17_merged_summary",
    """WITH f AS (SELECT event_type, event_type || '_' || (event_id % 3)::VARCHAR AS kind, count(*) AS c FROM events WHERE event_id % 4 <> 0 GROUP BY ALL)
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS average_value, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS average_some,
      (SELECT string_agg(kind || '=' || c::VARCHAR, ',' ORDER BY kind) FROM f WHERE f.event_type = events.event_type) AS failures FROM events GROUP BY event_type""",
)
def merged_summary(spark, sf_dir):
    """Events as judged rows that come in three batches, each summed up alone; their merge is one pass over all."""
    kind = F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string"))
    rows = table(spark, sf_dir, "events").select(
        "event_type", "event_id", "value", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("some"),
        F.when(F.col("event_id") % 4 != 0, F.array(kind)).otherwise(F.array().cast("array<string>")).alias("failure_types"),
    )
    batches = [batch_totals(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), ["event_type"], ["value", "some"]) for k in range(3)]
    first = merged_totals(batches[2], batches[0], keys=["event_type"])
    out = averages(merged_totals(first, batches[1], keys=["event_type"]), ["value", "some"])
    failures = F.array_join(F.transform(F.map_entries("failures"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("event_type", "n", F.round("average_value", 6).alias("average_value"), F.round("average_some", 6).alias("average_some"), failures.alias("failures"))


@query(
    "p16_sanitized_proposals",
    f"""WITH p AS (SELECT doc_id, {S.norm('text')} AS clean, text, lang, source FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, true AS valid, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'general' END AS event_category, (CASE WHEN doc_id % 5 = 0 THEN 5 ELSE 3 END)::INT AS importance,
      CASE WHEN trim(source) = '' OR source IS NULL THEN 0 ELSE 1 END::INT AS n_entities, CASE WHEN doc_id % 2 = 0 THEN 'person' ELSE 'other' END AS entity_type,
      CASE WHEN doc_id % 4 = 0 OR text = '' THEN 0 ELSE 1 END::INT AS n_facts, CASE WHEN doc_id % 4 = 0 OR text = '' THEN NULL ELSE sha1(clean) END AS fact_hash,
      CASE WHEN doc_id % 4 = 0 OR text = '' THEN 0 ELSE 1 END::INT AS tied FROM p""",
)
def sanitized_proposals(spark, sf_dir):
    """Proposals made of all documents as JSON, with gaps and values that are not allowed."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    when = lambda n, c: F.when(F.col("doc_id") % n == 0, c)
    entity = F.struct(F.concat(F.lit("  "), "source", F.lit("\n")).alias("surface"), F.when(F.col("doc_id") % 2 == 0, "person").otherwise("robot").alias("entity_type"))
    fact = F.struct(F.upper("source").alias("subject"), F.lit("said").alias("predicate"), F.when(F.col("doc_id") % 4 != 0, F.lit("a text")).alias("object"), "text")
    raw = F.to_json(F.struct(when(3, F.col("lang")).alias("event_category"), when(5, F.lit(9)).alias("importance"), F.array(entity).alias("entities"), F.array(fact).alias("facts")))
    out = tied_facts(sanitize_event_analyses(docs.select("doc_id", raw.alias("raw"))))
    return out.select(
        "doc_id", "valid", "event_category", "importance", F.size("entities").alias("n_entities"), F.coalesce(F.try_element_at("entities", F.lit(1))["entity_type"], F.lit("other")).alias("entity_type"),
        F.size("facts").alias("n_facts"), F.sha1(F.try_element_at("facts", F.lit(1))["text"].cast("binary")).alias("fact_hash"), "tied",
    )
