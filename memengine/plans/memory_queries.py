"""Queries over current memory: building, retrieval, answers, rewards, weaknesses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import has_text
from ..operators import graph, memory, retrieval, rewards, rollout
from ..sources.durable import durable
from . import sqlparts as S
from .base import query, table
from .graph_queries import turns_of


def memory_of(spark, sf_dir):
    kept = memory.retained_turns(turns_of(spark, sf_dir))
    nodes = memory.memory_nodes(kept)
    return nodes, memory.memory_edges(kept), memory.memory_summaries(nodes)


def questions_of(spark, sf_dir):
    return questions_from(graph.heuristic_facts(turns_of(spark, sf_dir)))


def questions_from(facts):
    """Every assistant turn as a question about itself: its first twelve words ask, the whole turn is expected."""
    rows = facts.where((F.lower("speaker") == "assistant") & has_text("text")).withColumnRenamed("clean", "answer")
    return rows.select(
        "record_id",
        F.concat(F.lit("q_"), "event_id").alias("question_id"),
        F.array_join(F.slice(F.split("answer", " "), 1, 12), " ").alias("question"),
        "answer",
        F.when(F.col("session_ord") % 2 == 0, F.lit("temporal")).otherwise(F.lit("other")).alias("question_type"),
        F.array("fact_id").alias("supporting_node_ids"),
        F.array("session_id").alias("supporting_session_ids"),
        "event_ord",
    )


def answers_of(spark, sf_dir):
    q = questions_of(spark, sf_dir)
    return q, retrieval.baseline_answers(q, retrieval.retrieve(q, memory_of(spark, sf_dir)[0]))


def scored_memory_of(spark, sf_dir):
    """Scored question items, memory nodes and summaries, each worked out once."""
    turns = durable(turns_of(spark, sf_dir))
    facts = durable(graph.heuristic_facts(turns))
    nodes = durable(memory.memory_nodes(durable(memory.retained_turns(turns))))
    summaries, q = durable(memory.memory_summaries(nodes)), durable(questions_from(facts))
    a = durable(retrieval.baseline_answers(q, retrieval.retrieve(q, nodes)))
    return durable(rewards.question_items(q, a, graph.oracle_nodes(turns, facts), nodes, summaries)), nodes, summaries


def items_of(spark, sf_dir):
    return scored_memory_of(spark, sf_dir)[0]


@query("m2_m3_retained_turns", f"WITH {S.KEPT} SELECT record_id, event_id, kept_ord FROM kept WHERE kept_ord <= 6")
def retained(spark, sf_dir):
    return memory.retained_turns(turns_of(spark, sf_dir), memory.MemoryConfig(max_event_nodes=6)).select("record_id", "event_id", "kept_ord")


@query("m4_m7_memory_nodes", f"WITH {S.MEMORY} SELECT record_id, node_id, node_type, content, confidence, level, session_id, turn_ids, event_ids, node_ord FROM memory")
def memory_nodes(spark, sf_dir):
    return memory_of(spark, sf_dir)[0].select(
        "record_id", "node_id", "node_type", "content", "confidence", F.col("abstraction_level").alias("level"), F.col("source_session_ids")[0].alias("session_id"),
        F.array_join("source_turn_ids", "|").alias("turn_ids"), F.array_join("source_event_ids", "|").alias("event_ids"), "node_ord",
    )


@query(
    "m5_m7_memory_edges",
    f"""WITH {S.MEMORY}, ordered AS (SELECT *, row_number() OVER (PARTITION BY record_id, session_id ORDER BY kept_ord) AS rn FROM kept)
    SELECT record_id, {S.sid('mem_fact', 'record_id', 'event_id', 'substr(text, 1, 128)')} AS source, {S.sid('mem_evt', 'record_id', 'event_id')} AS target, 'DERIVED_FROM' AS edge_type FROM kept
    UNION ALL SELECT o.record_id, {S.sid('mem_abs', 'o.record_id', 'o.session_id', 'm.n')}, {S.sid('mem_fact', 'o.record_id', 'o.event_id', 'substr(o.text, 1, 128)')}, 'ABSTRACTS' FROM ordered o JOIN many m USING (record_id, session_id) WHERE rn <= 5""",
)
def memory_edges(spark, sf_dir):
    return memory_of(spark, sf_dir)[1].select("record_id", "source", "target", "edge_type")


@query("m8_memory_summaries", f"WITH {S.MEMORY}, {S.SUMMARIES} SELECT * FROM summaries")
def memory_summaries(spark, sf_dir):
    return memory_of(spark, sf_dir)[2]


_VARIANTS = [memory.MemoryConfig(20), memory.MemoryConfig(80), memory.MemoryConfig(20, max_event_nodes=3)]


@query(
    "m9_memory_variants",
    f"""WITH {S.KEPT}, v AS (
      SELECT record_id || ':memory:0' AS sample_id, record_id, session_id FROM kept UNION ALL SELECT record_id || ':memory:1', record_id, session_id FROM kept WHERE length(clean) >= 80
      UNION ALL SELECT record_id || ':memory:2', record_id, session_id FROM kept WHERE kept_ord <= 3),
    s AS (SELECT sample_id, record_id, session_id, count(*) AS n FROM v GROUP BY ALL)
    SELECT sample_id, record_id, (sum(n * 2) + sum(CASE WHEN n >= 2 THEN 2 ELSE 0 END))::BIGINT AS nodes FROM s GROUP BY ALL""",
)
def memory_variants(spark, sf_dir):
    return memory.build_variants(turns_of(spark, sf_dir), _VARIANTS).groupBy("sample_id", "record_id").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    "m11_validate_memory",
    f"""WITH {S.MEMORY}, broken AS (SELECT * FROM memory WHERE node_type <> 'event'),
    facts_ AS (SELECT record_id, {S.sid('mem_fact', 'record_id', 'event_id', 'substr(text, 1, 128)')} AS source, {S.sid('mem_evt', 'record_id', 'event_id')} AS target FROM kept)
    SELECT record_id, 'abstract_level' AS code, node_id AS path FROM broken WHERE node_type = 'abstract' UNION ALL SELECT record_id, 'unknown_target', source || '->' || target FROM facts_""",
)
def validate(spark, sf_dir):
    """Of memories broken on purpose: events gone, abstracts too low."""
    nodes, edges, _ = memory_of(spark, sf_dir)
    return memory.validate_memory(nodes.where("node_type <> 'event'").withColumn("abstraction_level", F.least("abstraction_level", F.lit(1))), edges)


@query(
    "m12_memory_stats",
    f"""WITH {S.MEMORY}, o AS (SELECT *, row_number() OVER (PARTITION BY record_id, session_id ORDER BY kept_ord) AS rn FROM kept),
    e AS (SELECT record_id, sum(1 + CASE WHEN rn <= 5 AND (record_id, session_id) IN (SELECT (record_id, session_id) FROM many) THEN 1 ELSE 0 END) AS edges FROM o GROUP BY ALL),
    n AS (SELECT record_id, count(*) AS nodes, count(*) FILTER (node_type = 'event') AS events, count(DISTINCT session_id) AS sessions FROM memory GROUP BY ALL)
    SELECT record_id, count(*) AS turns, coalesce(max(nodes), 0) AS nodes, coalesce(max(events), 0) AS events, coalesce(max(sessions), 0) AS sessions, coalesce(max(edges), 0)::BIGINT AS edges
    FROM turns LEFT JOIN n USING (record_id) LEFT JOIN e USING (record_id) GROUP BY record_id""",
)
def stats(spark, sf_dir):
    nodes, edges, _ = memory_of(spark, sf_dir)
    return memory.memory_stats(nodes, edges, turns_of(spark, sf_dir))


@query("r1_r2_retrieve", f"WITH {S.RETRIEVAL} SELECT record_id, question_id, rank, node_id AS memory_id, round(score, 9) AS score FROM retrieved")
def retrieve(spark, sf_dir):
    out = retrieval.retrieve(questions_of(spark, sf_dir), memory_of(spark, sf_dir)[0])
    return out.select("record_id", "question_id", "rank", "memory_id", F.round("score", 9).alias("score"))


@query(
    "r3_retrieve_with_summaries",
    f"""WITH {S.RETRIEVAL}, pieces AS (SELECT record_id, 10 AS pos, 'stable_preferences' AS key, stable_preferences AS v FROM summaries UNION ALL SELECT record_id, 11, 'active_plans', active_plans FROM summaries UNION ALL SELECT record_id, 12, 'recent_changes', recent_changes FROM summaries)
    SELECT record_id, question_id, rank, node_id AS memory_id, sha1(content) AS content_hash FROM retrieved UNION ALL
    SELECT record_id, question_id, pos, 'summary_' || key, sha1(key || ': ' || v) FROM questions JOIN pieces USING (record_id) WHERE v <> ''""",
)
def retrieve_summaries(spark, sf_dir):
    nodes, _, summaries = memory_of(spark, sf_dir)
    out = retrieval.retrieve(questions_of(spark, sf_dir), nodes, summaries=summaries)
    return out.select("record_id", "question_id", "rank", "memory_id", F.sha1(F.col("content").cast("binary")).alias("content_hash"))


@query("r5_baseline_answers", f"WITH {S.ANSWERED} SELECT record_id, question_id, prediction, answer_status, round(confidence, 9) AS confidence, coalesce(array_to_string(ids, '|'), '') AS cited FROM answers")
def answers(spark, sf_dir):
    out = answers_of(spark, sf_dir)[1]
    return out.select("record_id", "question_id", "prediction", "answer_status", F.round("confidence", 9).alias("confidence"), F.array_join("supporting_memory_ids", "|").alias("cited"))


@query(
    "r6_r7_validate_answers",
    f"""WITH {S.ANSWERED}, bad AS (SELECT record_id, CASE WHEN event_ord % 3 = 0 THEN 'invalid_output' ELSE answer_status END AS answer_status FROM answers) SELECT record_id, answer_status, count(*) AS n FROM bad GROUP BY ALL""",
)
def checked_answers(spark, sf_dir):
    """Every third answer cites what was not retrieved."""
    q = questions_of(spark, sf_dir)
    got = retrieval.retrieve(q, memory_of(spark, sf_dir)[0])
    a = retrieval.baseline_answers(q, got).join(q.select("record_id", "question_id", "event_ord"), ["record_id", "question_id"])
    wrong = F.when(F.col("event_ord") % 3 == 0, F.array(F.lit("mem_none"))).otherwise(F.col("supporting_memory_ids"))
    return retrieval.answer_summary(retrieval.validate_answers(a.withColumn("supporting_memory_ids", wrong), got))


_ITEM = "record_id, question_id, round(correctness, 9) AS correctness, round(evidence_support, 9) AS evidence_support, round(citation_quality, 9) AS citation_quality, round(oracle_coverage, 9) AS oracle_coverage"


@query("v1_v4_question_items", f"WITH {S.SCORED_ITEMS} SELECT {_ITEM} FROM items")
def items(spark, sf_dir):
    return items_of(spark, sf_dir).select("record_id", "question_id", *[F.round(c, 9).alias(c) for c in ("correctness", "evidence_support", "citation_quality", "oracle_coverage")])


_FAILURES = """concat_ws('|', CASE WHEN answer_status = 'insufficient_evidence' THEN 'answerer_insufficient_evidence' END, CASE WHEN correctness < 0.5 AND oracle_coverage < 0.5 THEN 'missing_fact' END,
  CASE WHEN correctness < 0.5 AND oracle_coverage >= 0.7 THEN 'wrong_fact' END, CASE WHEN session_ord % 2 = 0 AND correctness < 0.7 THEN 'temporal_error' END, CASE WHEN evidence_support < 0.3 AND correctness >= 0.7 THEN 'unsupported_answer' END)"""


@query("v12_failure_types", f"WITH {S.SCORED_ITEMS} SELECT i.record_id, i.question_id, {_FAILURES} AS failures FROM items i JOIN (SELECT DISTINCT record_id, session_id, session_ord FROM turns) t USING (record_id, session_id)")
def failures(spark, sf_dir):
    return items_of(spark, sf_dir).select("record_id", "question_id", F.array_join("failure_types", "|").alias("failures"))


_COMPONENTS = f"""{S.SCORED_ITEMS},
recs AS (SELECT DISTINCT record_id FROM turns),
asked AS (SELECT record_id, avg(0.55 * correctness + 0.25 * evidence_support + 0.10 * citation_quality + 0.10 * CASE WHEN answer_status = 'answered' THEN 1.0 ELSE 0.0 END) AS answer_utility, avg(oracle_coverage) AS oracle_coverage FROM items GROUP BY ALL),
mt AS (SELECT record_id, node_id, {S.words(S.rnorm('content'))} AS b FROM memory),
red AS (SELECT a.record_id, count(*) FILTER ({S.jaccard('a.b', 'b.b')} >= 0.85) AS dup FROM mt a JOIN mt b ON a.record_id = b.record_id AND a.node_id < b.node_id GROUP BY ALL),
cnt AS (SELECT record_id, count(*) AS n, count(*) FILTER (node_type IN ('abstract', 'summary')) AS na, count(*) FILTER (node_type = 'fact') AS nf FROM memory GROUP BY ALL),
comp0 AS (SELECT record_id, coalesce(answer_utility, 0.0) AS answer_utility, coalesce(a.oracle_coverage, 0.0) AS oracle_coverage, CASE WHEN n IS NULL THEN 1.0 ELSE 0.7 END::DOUBLE AS groundedness,
  CASE WHEN coalesce(n, 0) < 2 THEN 1.0 ELSE 1 - coalesce(dup, 0)::DOUBLE / (n * (n - 1) / 2) END AS non_redundancy,
  0.40 * CASE WHEN coalesce(na, 0) > 0 THEN 0.8 ELSE 0.5 END + 0.30 * CASE WHEN coalesce(nf, 0) > 0 THEN 0.8 ELSE 0.6 END + 0.30 * CASE WHEN coalesce(na, 0) > 0 THEN 1.0 ELSE 0.5 END AS abstraction_quality, 1.0::DOUBLE AS format_safety
  FROM recs LEFT JOIN asked a USING (record_id) LEFT JOIN red USING (record_id) LEFT JOIN cnt USING (record_id)),
comp AS (SELECT *, CASE WHEN oracle_coverage < 0.45 THEN 0.2 WHEN 1 - non_redundancy > 0.35 THEN 0.4 ELSE greatest(0.0, least(1.0, 0.5 + oracle_coverage - 0.5 * (1 - non_redundancy))) END AS compression_balance FROM comp0)"""
_TOTAL = " + ".join(f"{w} * {c}" for c, w in rewards.MEMORY_WEIGHTS.items())
_NAMES = list(rewards.MEMORY_WEIGHTS)


def components_of(spark, sf_dir):
    items, nodes, summaries = scored_memory_of(spark, sf_dir)
    records = turns_of(spark, sf_dir).select("record_id").distinct()
    return rewards.memory_components(items, nodes, summaries, records)


@query("v5_v11_memory_rewards", f"WITH {_COMPONENTS} SELECT record_id, {', '.join(f'round({c}, 9) AS {c}' for c in _NAMES)}, round(greatest(0, least(1, {_TOTAL})), 9) AS total_reward FROM comp")
def memory_rewards(spark, sf_dir):
    return rewards.memory_rewards(components_of(spark, sf_dir)).select("record_id", *[F.round(c, 9).alias(c) for c in [*_NAMES, "total_reward"]])


@query("v7_non_redundancy_documents", f"""WITH d AS (SELECT lang AS record_id, doc_id, {S.words(S.rnorm('text'))} AS b FROM documents),
p AS (SELECT a.record_id, count(*) FILTER ({S.jaccard('a.b', 'b.b')} >= 0.85) AS dup FROM d a JOIN d b ON a.record_id = b.record_id AND a.doc_id < b.doc_id AND least(len(a.b), len(b.b)) >= 0.85 * greatest(len(a.b), len(b.b)) GROUP BY ALL),
c AS (SELECT record_id, count(*) AS n FROM d GROUP BY ALL) SELECT record_id, round(1 - coalesce(dup, 0)::DOUBLE / (n * (n - 1) / 2), 9) AS non_redundancy FROM c LEFT JOIN p USING (record_id)""")
def redundancy_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("record_id"), F.col("doc_id").cast("string").alias("node_id"), F.lit("active").alias("status"), F.col("text").alias("content"))
    return rewards.non_redundancy(docs).select("record_id", F.round("non_redundancy", 9).alias("non_redundancy"))


@query("v16_round_summary", f"WITH {_COMPONENTS}, r AS (SELECT *, {_TOTAL} AS t FROM comp) SELECT count(*) AS records, count(*) FILTER (answer_utility > 0) AS ok, count(*) FILTER (answer_utility = 0) AS skipped, 0::BIGINT AS failed, round(avg(t) FILTER (answer_utility > 0), 9) AS memory_reward_mean FROM r")
def round_summary(spark, sf_dir):
    r = rewards.memory_rewards(components_of(spark, sf_dir)).withColumn("status", F.when(F.col("answer_utility") > 0, "ok").otherwise("skipped"))
    r = r.withColumnRenamed("total_reward", "memory_reward").withColumn("question_reward", F.lit(None).cast("double"))
    return rewards.round_summary(r).select("records", "ok", "skipped", "failed", F.round("memory_reward_mean", 9).alias("memory_reward_mean"))


def _cells(sql: str) -> str:
    """The SQL of a record's rewards, for cells: each cell sees the turns of its record as a record of its own, its
    memory sample says how long a retained text is at least, its question sample which turns ask."""
    named = S.TURNS.replace("turns AS (", "turns0 AS (", 1)
    cells = """, turns AS (SELECT t.* REPLACE (t.record_id || ':m' || m || '|' || t.record_id || ':q' || q AS record_id) FROM turns0 t, (VALUES (0), (1)) AS ms(m), (VALUES (0), (1)) AS qs(q))"""
    sql = sql.replace(S.TURNS, named + cells)
    sql = sql.replace("length(clean) >= 20", "length(clean) >= CASE WHEN contains(record_id, ':m1|') THEN 80 ELSE 20 END")
    return sql.replace("WHERE lower(speaker) = 'assistant'", "WHERE lower(speaker) = 'assistant' AND event_ord % 2 = CASE WHEN record_id LIKE '%:q1' THEN 1 ELSE 0 END")


def scored_cells_of(spark, sf_dir):
    """Two memories of each record (texts of 20 and of 80 characters are retained) with two sets of questions."""
    turns = durable(turns_of(spark, sf_dir))
    facts = durable(graph.heuristic_facts(turns))
    samples = [memory.MemoryConfig(20), memory.MemoryConfig(80)]
    name = lambda kind, k: F.concat("record_id", F.lit(f":{kind}{k}"))
    nodes, texts = None, None
    for k, cfg in enumerate(samples):
        mine = durable(memory.memory_nodes(memory.retained_turns(turns, cfg)))
        own, said = (df.withColumn("memory_sample_id", name("m", k)) for df in (mine, memory.memory_summaries(mine)))
        nodes, texts = (own, said) if nodes is None else (nodes.unionByName(own), texts.unionByName(said))
    q = questions_from(facts)
    q = durable(q.withColumn("question_sample_id", F.concat("record_id", F.lit(":q"), (F.col("event_ord") % 2).cast("string"))))
    records = turns.select("record_id").distinct()
    memories = records.select("record_id", F.explode(F.array(name("m", 0), name("m", 1))).alias("memory_sample_id"))
    sets = records.select("record_id", F.explode(F.array(name("q", 0), name("q", 1))).alias("question_sample_id"))
    asked = sets.join(q.groupBy("question_sample_id").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "question_sample_id", "left")
    asked = durable(asked.select("record_id", "question_sample_id", F.coalesce("n", F.lit(0)).alias("accepted_question_count")))
    return rollout.score_cells(durable(rollout.pair_cells(durable(memories), asked)), nodes, durable(texts), q, graph.oracle_nodes(turns, facts))


_CELL_REWARDS = f"""WITH {_cells(_COMPONENTS)}, asked_n AS (SELECT record_id, count(*) AS n FROM questions GROUP BY ALL),
  c AS (SELECT record_id AS cell, split_part(record_id, ':m', 1) AS record_id, split_part(record_id, '|', 1) AS memory_sample_id, split_part(record_id, '|', 2) AS question_sample_id, coalesce(n, 0) AS n, greatest(0, least(1, {_TOTAL})) AS r FROM comp LEFT JOIN asked_n USING (record_id))"""


@query(
    "a2_cell_scores",
    f"{_CELL_REWARDS} SELECT record_id, memory_sample_id, question_sample_id, n AS accepted_question_count, CASE WHEN n > 0 THEN 'ok' ELSE 'rejected' END AS status, CASE WHEN n > 0 THEN round(r, 9) END AS memory_reward FROM c",
)
def cell_scores(spark, sf_dir):
    return scored_cells_of(spark, sf_dir).select("record_id", "memory_sample_id", "question_sample_id", "accepted_question_count", "status", F.round("memory_reward", 9).alias("memory_reward"))


@query(
    "a2_a3_cell_marginals",
    f"{_CELL_REWARDS} SELECT record_id, memory_sample_id AS sample_id, round(coalesce(avg(r) FILTER (n > 0), 0), 8) AS reward FROM c GROUP BY ALL",
)
def cell_marginals(spark, sf_dir):
    """Marginal rewards of the memory samples, from scored cells."""
    out = rollout.marginal_rewards(scored_cells_of(spark, sf_dir))
    return out.where("role = 'memory_builder'").select("record_id", "sample_id", F.round("reward", 8).alias("reward"))


FLAGSHIP = "v5_v11_memory_rewards"
