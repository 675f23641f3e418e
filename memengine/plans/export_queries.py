"""Queries over exports, payloads, batches of actors, artifacts of jobs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, audit, batches, memory, payloads, retrieval, splits, suite
from ..sources import exports, jobs
from ..sources.durable import durable
from . import sqlparts as S
from .base import query, table
from .graph_queries import graph_of, turns_of
from .memory_queries import memory_of, questions_of


def _sha1(c):
    return F.sha1(F.coalesce(F.col(c), F.lit("")).cast("binary"))


@query(
    "s11_exported_nodes",
    f"WITH {S.GRAPH} SELECT record_id, node_id, node_type, coalesce(session_id, '') AS session_id, sha1(coalesce(text, '')) AS text_hash, coalesce(name, '') AS name FROM nodes",
)
def exported_nodes(spark, sf_dir):
    """Nodes read back from the objects that are written for each record."""
    docs = exports.graph_documents(*graph_of(spark, sf_dir), part_rows=40)
    x = F.explode(F.from_json("json", "nodes array<struct<id:string,node_type:string,session_id:string,text:string,name:string>>")["nodes"]).alias("x")
    return docs.select("record_id", x).select(
        "record_id", F.col("x.id").alias("node_id"), "x.node_type", F.coalesce("x.session_id", F.lit("")).alias("session_id"), F.sha1(F.coalesce("x.text", F.lit("")).cast("binary")).alias("text_hash"),
        F.coalesce("x.name", F.lit("")).alias("name"),
    )


@query("s11_exported_edges", f"WITH {S.GRAPH} SELECT record_id, source, target, edge_key, edge_type, edge_ord FROM edges")
def exported_edges(spark, sf_dir):
    docs = exports.graph_documents(*graph_of(spark, sf_dir), part_rows=40)
    x = F.explode(F.from_json("json", "edges array<struct<source:string,target:string,key:int,edge_type:string,edge_ord:bigint>>")["edges"]).alias("x")
    return docs.select("record_id", x).select("record_id", "x.source", "x.target", F.col("x.key").alias("edge_key"), "x.edge_type", "x.edge_ord")


@query(
    "s12_metric_texts",
    """SELECT event_type, n::VARCHAR AS n, CASE WHEN mean IS NULL THEN '' ELSE printf('%.4f', mean) END AS mean FROM (
      SELECT event_type, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN avg(value) END AS mean FROM events GROUP BY event_type)""",
)
def metric_texts(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) % 2 == 0, F.avg("value")).alias("mean"))
    return exports.metric_texts(per)


@query(
    "s13_verified_checksums",
    """WITH d AS (SELECT doc_id, 'docs/' || doc_id::VARCHAR || '.txt' AS path, sha256(coalesce(text, '')) AS h FROM documents)
    SELECT path, CASE WHEN doc_id % 11 = 1 THEN 'missing' ELSE 'mismatch' END AS code, CASE WHEN doc_id % 11 = 1 THEN h ELSE sha256(h) END AS expected, CASE WHEN doc_id % 11 = 1 THEN NULL ELSE h END AS actual FROM d WHERE doc_id % 11 IN (1, 2)
    UNION ALL SELECT path, 'unlisted', NULL, h FROM d WHERE doc_id % 11 = 3
    UNION ALL SELECT h, 'bad_line', NULL, NULL FROM d WHERE doc_id % 11 = 4
    UNION ALL SELECT path, 'unlisted', NULL, h FROM d WHERE doc_id % 11 = 4""",
)
def verified_checksums(spark, sf_dir):
    """All documents as files, against checksum lines with planted faults."""
    kind = F.col("doc_id") % 11
    files = durable(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256")))
    listed = F.when(kind == 2, F.sha2(F.col("sha256").cast("binary"), 256)).otherwise(F.col("sha256"))
    line = F.when(kind == 4, F.concat(F.lit("  "), "sha256", F.lit(" "))).otherwise(F.concat_ws("  ", listed, "path"))
    return exports.verify_checksums(files.where(kind != 3).select(line.alias("value")), files.where(kind != 1))


@query(
    "s15_discovered_records",
    """SELECT record_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM (
      SELECT 'r' || doc_id::VARCHAR AS record_id, 'manifest' AS source FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT 'r' || doc_id::VARCHAR, 'traces' FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT 'r' || doc_id::VARCHAR, 'groups' FROM documents WHERE doc_id % 5 < 2) GROUP BY record_id""",
)
def discovered_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("r"))
    name = lambda folder, end: F.concat(F.lit(folder), "r", F.lit(end)).alias("path")
    files = d.where("doc_id % 2 = 0").select(name("/run/traces/", ".grpo_trace.json"))
    files = files.unionByName(d.where("doc_id % 5 = 0").select(name("/run/groups/", ".memory_group.json"))).unionByName(d.where("doc_id % 5 = 1").select(name("/run/groups/", ".question_group.json")))
    files = files.unionByName(d.select(name("/run/other/", ".json")))
    found = jobs.discover_records(d.where("doc_id % 3 = 0").select(F.col("r").alias("record_id")), files)
    return found.select("record_id", F.array_join("sources", ",").alias("sources"))


def _reports(spark, sf_dir):
    """All conversations' turns as answers, in one of three layouts a conversation."""
    t = table(spark, sf_dir, "conversations")
    answer = F.struct(F.concat_ws("_", "conv_id", "turn").alias("question_id"), F.col("text").alias("prediction"), F.lit("answered").alias("answer_status"), F.lit(0.5).alias("confidence"), F.lit(0.25).alias("correctness"), F.array(F.col("role")).alias("supporting_memory_ids"))
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(answer)).alias("a"))
    kind = F.col("conv_id") % 4
    text = F.when(kind == 0, F.to_json(F.struct(F.col("a").alias("answers")))).when(kind == 1, F.to_json("a")).when(kind == 2, F.to_json(F.struct(F.col("a").alias("question_items")))).otherwise(F.to_json(F.struct(F.col("a").alias("others"))))
    return per.select(F.col("conv_id").cast("string").alias("record_id"), text.alias("answer_report"))


@query(
    "s16_answer_rows",
    """SELECT conv_id::VARCHAR AS record_id, conv_id::VARCHAR || '_' || turn::VARCHAR AS question_id, sha1(coalesce(text, '')) AS prediction_hash, CASE WHEN conv_id % 4 = 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence,
    role AS cited, CASE conv_id % 4 WHEN 0 THEN 'answers' WHEN 1 THEN 'list' ELSE 'question_items' END AS layout FROM conversations WHERE conv_id % 4 <> 3""",
)
def answer_rows(spark, sf_dir):
    out = jobs.answer_rows(_reports(spark, sf_dir))
    return out.select("record_id", "question_id", _sha1("prediction").alias("prediction_hash"), "confidence", F.array_join("supporting_memory_ids", ",").alias("cited"), "layout")


@query(
    "s16_reward_jobs",
    """SELECT 'r' || doc_id::VARCHAR || '_round2_step1' AS job_id, CASE WHEN doc_id % 2 = 0 THEN sha1(coalesce(text, '')) ELSE sha1('') END AS memory_hash,
      concat_ws(',', CASE WHEN doc_id % 2 <> 0 THEN 'current_memory' END, 'question_set', CASE WHEN doc_id % 3 <> 0 THEN 'answer_report' END, 'trainer_adapter_report', 'weakness_book') AS missing,
      CASE WHEN doc_id % 7 = 0 THEN 'oracle graph not found: r' || doc_id::VARCHAR ELSE '' END AS error FROM documents""",
)
def reward_jobs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), F.coalesce("text", F.lit("")).alias("json"))
    named = lambda rows, name: rows.select("record_id", F.lit(name).alias("name"), "json")
    files = named(d.where("doc_id % 2 = 0"), "current_memory.json").unionByName(named(d.where("doc_id % 3 = 0"), "answers.json")).unionByName(named(d, "notes.json"))
    out = jobs.reward_jobs(d, files, d.where("doc_id % 7 <> 0"), 2, 1)
    return out.select("job_id", _sha1("current_memory").alias("memory_hash"), F.array_join("missing", ",").alias("missing"), F.coalesce("error", F.lit("")).alias("error"))


@query(
    "p21_history_payload",
    f"""WITH {S.TURNS} SELECT record_id, session_id, (session_ord - 1)::INT AS session_pos, (row_number() OVER (PARTITION BY record_id, session_id ORDER BY event_ord) - 1)::INT AS turn_pos, event_id, turn_id, speaker, sha1(text) AS text_hash FROM turns""",
)
def history_payload(spark, sf_dir):
    """Turns read back from the payloads, by their places in them."""
    schema = "sessions array<struct<session_id:string,turns:array<struct<event_id:string,turn_id:int,speaker:string,text:string>>>>"
    sessions = payloads.history_payload(turns_of(spark, sf_dir)).select("record_id", F.posexplode(F.from_json("payload", schema)["sessions"]).alias("session_pos", "s"))
    each = sessions.select("record_id", "s.session_id", "session_pos", F.posexplode("s.turns").alias("turn_pos", "t"))
    return each.select("record_id", "session_id", "session_pos", "turn_pos", "t.event_id", "t.turn_id", "t.speaker", F.sha1(F.col("t.text").cast("binary")).alias("text_hash"))


@query(
    "p15_p21_answer_payload",
    f"""WITH {S.RETRIEVAL}, hits AS (SELECT record_id, question_id, string_agg(node_id, '|' ORDER BY rank) AS ids, string_agg(m.session_id, '|' ORDER BY rank) AS sessions FROM retrieved JOIN (SELECT record_id, node_id, session_id FROM memory) m USING (record_id, node_id) GROUP BY ALL)
    SELECT q.record_id, q.question_id, q.question, coalesce(recent_changes, '') AS recent_changes, coalesce(ids, '') AS memory_ids, coalesce(sessions, '') AS sessions, 'memory_summaries,question,question_id,record_id,retrieved_memory' AS keys
    FROM questions q LEFT JOIN hits USING (record_id, question_id) LEFT JOIN summaries USING (record_id)""",
)
def answer_payload(spark, sf_dir):
    nodes = durable(memory_of(spark, sf_dir)[0])
    q = durable(questions_of(spark, sf_dir))
    out = payloads.answer_payload(q, retrieval.retrieve(q, nodes), nodes, memory.memory_summaries(nodes))
    body = F.from_json("payload", "question string, memory_summaries map<string,string>, retrieved_memory array<struct<memory_id:string,source_session_ids:array<string>>>").alias("p")
    keys = F.array_join(F.array_sort(F.json_object_keys("payload")), ",").alias("keys")
    joined = lambda f: F.array_join(F.transform("p.retrieved_memory", f), "|")
    return out.select("record_id", "question_id", keys, body).select(
        "record_id", "question_id", "p.question", F.col("p.memory_summaries")["recent_changes"].alias("recent_changes"), joined(lambda m: m["memory_id"]).alias("memory_ids"), joined(lambda m: m["source_session_ids"][0]).alias("sessions"), "keys"
    )


@query(
    "p21_judge_payload",
    """WITH q AS (SELECT doc_id, doc_id // 20 AS record_id, (row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1) // 8 AS batch FROM (SELECT DISTINCT doc_id FROM documents)),
    w AS (SELECT doc_id, CASE WHEN length(text) > 4000 THEN regexp_replace(substr(text, 1, 3997), '[ \\t-\\r]+$', '') || '...' ELSE coalesce(text, '') END AS text FROM (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id % 7 <> 0 GROUP BY doc_id))
    SELECT q.record_id::VARCHAR AS record_id, batch::INT AS batch, q.doc_id::VARCHAR AS question_id, CASE WHEN q.doc_id % 7 = 0 THEN 't' || q.doc_id::VARCHAR ELSE '' END AS missing, coalesce(sha1(w.text), '') AS text_hash FROM q LEFT JOIN w USING (doc_id)""",
)
def judge_payload(spark, sf_dir):
    """All documents as walks that a question each cites, read back from the payloads; one in seven is not there."""
    d = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    d = durable(d.select("doc_id", F.floor(F.col("doc_id") / 20).cast("string").alias("record_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("trajectory_id"), "text", F.array(F.lit("s1")).alias("session_ids")))
    q = d.select("record_id", F.col("doc_id").cast("string").alias("question_id"), "doc_id", F.array("trajectory_id").alias("supporting_trajectory_ids"))
    out = payloads.judge_payload(q, d.where("doc_id % 7 <> 0"), order="doc_id")
    schema = "questions array<struct<question_id:string,missing_trajectory_ids:array<string>,evidence_trajectories:array<struct<text:string>>>>"
    each = out.select("record_id", "batch", F.explode(F.from_json("payload", schema)["questions"]).alias("q"))
    text = F.try_element_at("q.evidence_trajectories", F.lit(1))["text"]
    return each.select("record_id", "batch", "q.question_id", F.array_join("q.missing_trajectory_ids", ",").alias("missing"), F.coalesce(F.sha1(text.cast("binary")), F.lit("")).alias("text_hash"))


@query(
    "a1b_memory_samples",
    f"""WITH {S.MEMORY}, c AS (SELECT unnest([0, 1]) AS k), r AS (SELECT record_id, count(*) AS turns FROM turns GROUP BY ALL), n AS (SELECT record_id, count(*) AS n FROM memory GROUP BY ALL)
    SELECT record_id || ':memory:' || k::VARCHAR AS sample_id, 'round3_step0_' || record_id || '_memory' AS group_id, 'accepted' AS status, turns, CASE WHEN k = 0 THEN coalesce(n, 0) ELSE 0 END AS nodes, '{{"k":' || k::VARCHAR || '}}' AS config
    FROM r CROSS JOIN c LEFT JOIN n USING (record_id)""",
)
def memory_samples(spark, sf_dir):
    """Two builds a record, of which the second keeps nothing; turns, nodes and configuration read back."""
    nodes = memory_of(spark, sf_dir)[0].withColumn("sample_index", F.lit(0))
    out = payloads.memory_policy_samples(turns_of(spark, sf_dir), nodes, ['{"k":0}', '{"k":1}'], round_id=3)
    turns = F.aggregate(F.from_json("prompt", "history struct<sessions:array<struct<turns:array<struct<event_id:string>>>>>")["history"]["sessions"], F.lit(0), lambda n, s: n + F.size(s["turns"]))
    return out.select("sample_id", "group_id", "status", turns.cast("long").alias("turns"), F.json_array_length(F.get_json_object("response", "$.memory_nodes")).cast("long").alias("nodes"), F.get_json_object("prompt", "$.builder_config").alias("config"))


@query(
    "a1b_question_samples",
    """WITH r AS (SELECT DISTINCT o_custkey FROM orders), c AS (SELECT o_custkey, o_orderkey % 3 AS k, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY ALL), s AS (SELECT unnest([0, 1, 2]) AS k)
    SELECT o_custkey::VARCHAR || ':question:' || k::VARCHAR AS sample_id, CASE WHEN coalesce(a, 0) > 0 THEN 'accepted' WHEN coalesce(b, 0) > 0 THEN 'rejected' ELSE 'failed' END AS status, coalesce(a, 0) AS n_accepted, coalesce(b, 0) AS n_rejected, coalesce(a, 0) + coalesce(b, 0) AS listed
    FROM r CROSS JOIN s LEFT JOIN c USING (o_custkey, k)""",
)
def question_samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    record = F.col("o_custkey").cast("string").alias("record_id")
    walks = o.select(record, F.col("o_orderkey").cast("string").alias("trajectory_id"), F.col("o_orderpriority").alias("text"))
    asked = o.select(record, (F.col("o_orderkey") % 3).cast("int").alias("sample_index"), F.col("o_orderkey").cast("string").alias("question_id"), F.col("o_orderpriority").alias("question"), (F.col("o_orderstatus") == "F").alias("accepted"))
    out = payloads.question_policy_samples(walks, asked, ["{}", "{}", "{}"])
    return out.select("sample_id", "status", "n_accepted", "n_rejected", F.json_array_length("response").cast("long").alias("listed"))


def _batches(spark, sf_dir):
    """All orders as batches of their lines, in three layouts; one in ten is another role's."""
    line = F.struct("l_linenumber", F.col("l_returnflag").alias("group_id"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(False)).alias("selected_for_update"), F.when(F.col("l_linenumber") == 3, F.lit(1)).alias("question_type"))
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    kind, role = F.col("l_orderkey") % 3, F.when(F.col("l_orderkey") % 10 == 0, F.lit("question_agent")).otherwise(F.lit("memory_builder")).alias("actor_role")
    text = F.when(kind == 0, F.to_json(F.struct(role, F.col("x").alias("items")))).when(kind == 1, F.to_json(F.struct(role, F.col("x").alias("samples"))))
    text = text.otherwise(F.to_json(F.struct(role, F.array(F.struct(F.lit("g").alias("group_id"), F.col("x").alias("samples"))).alias("groups"))))
    return per.select(F.col("l_orderkey").cast("string").alias("record_id"), F.lit(0).alias("batch_ord"), text.alias("batch"))


@query(
    "a12_merged_batches",
    """SELECT l_orderkey::VARCHAR AS record_id, CASE l_orderkey % 3 WHEN 0 THEN 'items' WHEN 1 THEN 'samples' ELSE 'groups' END AS layout, l_orderkey::VARCHAR || '_' || CASE WHEN l_orderkey % 3 = 2 THEN 'g' ELSE l_returnflag END AS group_id,
    l_orderkey % 3 <> 2 AND l_linenumber % 2 <> 0 AS selected, l_linenumber::INT AS line FROM lineitem WHERE l_orderkey % 10 <> 0""",
)
def merged_batches(spark, sf_dir):
    out = batches.merged_samples(_batches(spark, sf_dir), "memory_builder")
    return out.select("record_id", "layout", "group_id", "selected", F.get_json_object("sample", "$.l_linenumber").cast("int").alias("line"))


@query("a12_unmerged", "SELECT l_orderkey::VARCHAR AS record_id, count(*) AS listed, 0::BIGINT AS merged FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_orderkey % 7 = 0 GROUP BY ALL")
def unmerged(spark, sf_dir):
    """Batches whose samples a faulty merge has lost."""
    b = durable(_batches(spark, sf_dir))
    merged = batches.merged_samples(b, "memory_builder").where("record_id % 7 <> 0")
    return batches.unmerged(b, merged, "memory_builder").select("record_id", "listed", "merged")


@query(
    "l5_batch_violations",
    """SELECT l_orderkey::VARCHAR AS row_id, CASE WHEN l_orderkey % 3 = 0 THEN 'items[' || i::VARCHAR || '].question_type' ELSE 'groups[0].samples[' || i::VARCHAR || '].question_type' END AS path, 'question_type' AS key
    FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM lineitem) WHERE l_linenumber = 3 AND l_orderkey % 3 <> 1""",
)
def batch_violations(spark, sf_dir):
    return batches.batch_violations(_batches(spark, sf_dir), "memory_builder")


@query(
    "l2_keys_in_strings",
    """SELECT doc_id AS row_id, CASE WHEN doc_id % 2 = 0 THEN 'a[0].answer' ELSE 'a[0].b.answer' END AS path, 'answer' AS key FROM documents WHERE doc_id % 3 <> 0
    UNION ALL SELECT doc_id, 'c.gold_answer', 'gold_answer' FROM documents WHERE doc_id % 5 = 0""",
)
def keys_in_strings(spark, sf_dir):
    """Texts of all documents as JSON with keys inside strings inside JSON; the texts themselves hold no key."""
    d = table(spark, sf_dir, "documents")
    hidden = F.when(F.col("doc_id") % 3 != 0, F.lit(1))
    deep = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(hidden.alias("answer"), F.col("text").alias("t")))).otherwise(F.to_json(F.struct(F.to_json(F.struct(hidden.alias("answer"), F.col("text").alias("t"))).alias("b"))))
    raw = F.to_json(F.struct(F.array(deep).alias("a"), F.struct(F.when(F.col("doc_id") % 5 == 0, "x").alias("gold_answer")).alias("c")))
    return audit.find_keys(d.select("doc_id", raw.alias("j")), "doc_id", "j", ["answer", "gold_answer"], nested_json=True)


@query(
    "w6_node_look_ups",
    f"""WITH {S.GRAPH}, wanted AS (SELECT DISTINCT record_id, source_event_id AS node_id FROM nodes WHERE node_type = 'fact' UNION ALL SELECT DISTINCT record_id, 'nowhere' FROM nodes)
    SELECT w.record_id, w.node_id, n.node_id IS NOT NULL AS found, coalesce(n.node_type, '') AS node_type, sha1(coalesce(n.text, '')) AS text_hash FROM wanted w LEFT JOIN nodes n ON n.record_id = w.record_id AND n.node_id = w.node_id""",
)
def node_look_ups(spark, sf_dir):
    n = durable(graph_of(spark, sf_dir)[0])
    wanted = access.nodes_where(n, node_type="fact").select("record_id", F.col("source_event_id").alias("node_id")).distinct().unionByName(n.select("record_id", F.lit("nowhere").alias("node_id")).distinct())
    out = access.look_up(n, wanted)
    return out.select("record_id", "node_id", "found", F.coalesce("node_type", F.lit("")).alias("node_type"), _sha1("text").alias("text_hash"))


@query(
    "w6_edge_look_ups",
    f"""WITH {S.GRAPH} SELECT e.record_id, e.source, e.target, k.edge_key, x.edge_type IS NOT NULL AS found, coalesce(x.edge_type, '') AS edge_type FROM edges e CROSS JOIN (SELECT unnest([0, 7]) AS edge_key) k
    LEFT JOIN edges x ON x.record_id = e.record_id AND x.source = e.source AND x.target = e.target AND x.edge_key = k.edge_key WHERE e.edge_type = 'MENTIONS'""",
)
def edge_look_ups(spark, sf_dir):
    e = durable(graph_of(spark, sf_dir)[1])
    wanted = access.edges_where(e, edge_type="MENTIONS").select("record_id", "source", "target", F.explode(F.array(F.lit(0), F.lit(7))).alias("edge_key"))
    out = access.look_up(e, wanted, ("record_id", "source", "target", "edge_key"))
    return out.select("record_id", "source", "target", "edge_key", "found", F.coalesce("edge_type", F.lit("")).alias("edge_type"))


_SPLITS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM documents UNION ALL SELECT doc_id, 'train' FROM documents WHERE doc_id % 5 = 0"


@query("k6_repeated_records", f"SELECT doc_id AS record_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM ({_SPLITS}) GROUP BY doc_id HAVING count(*) > 1")
def repeated_records(spark, sf_dir):
    return _inspected(spark, sf_dir)[1].select("record_id", "n", F.array_join("splits", ",").alias("splits"))


@query("k6_issues_by_severity", "SELECT s AS severity, (SELECT count(*) FROM documents WHERE CASE doc_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'other' END = s) AS issues FROM (SELECT unnest(['error', 'warning', 'info']) AS s)")
def issues_by_severity(spark, sf_dir):
    return _inspected(spark, sf_dir)[0]


def _inspected(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"))
    kind = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("record_id") % len(names) + 1).cast("int"))
    rows = d.withColumn("split", kind("train", "dev", "test")).unionByName(d.where("record_id % 5 = 0").withColumn("split", F.lit("train")))
    return splits.inspect_split(rows, d.withColumn("severity", kind("ERROR", "warning", "other", "other")))


def _rounds(spark, sf_dir):
    """Orders as rounds of the experiment of their customer."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("partial")
    reward = F.when(F.col("o_orderkey") % 4 != 0, F.floor(F.col("o_totalprice") / 20000).cast("double"))
    return o.select(F.col("o_custkey").alias("experiment_id"), F.col("o_orderkey").alias("round_id"), status.alias("status"), reward.alias("dev_memory_reward_mean"), F.split("o_orderpriority", "-").alias("warnings"), F.lit(None).cast("array<string>").alias("errors"))


_ROUNDS = "SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'partial' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice / 20000)::DOUBLE END AS reward FROM orders"


@query(
    "z9_experiment_metrics",
    f"""SELECT c_custkey AS experiment_id, count(*) FILTER (r.status = 'succeeded') AS num_rounds_succeeded, count(*) FILTER (r.status = 'failed') AS num_rounds_failed, count(*) FILTER (r.status = 'partial') AS num_rounds_partial,
    max(reward) AS best_dev_memory_reward_mean, arg_max(o_orderkey, struct_pack(a := reward, b := -o_orderkey)) FILTER (reward IS NOT NULL) AS best_dev_round_id, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS early_stopped
    FROM customer LEFT JOIN ({_ROUNDS}) r ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def experiment_metrics(spark, sf_dir):
    key = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(key.alias("experiment_id"), F.when(key % 5 == 0, "failed").otherwise("succeeded").alias("status"), F.lit(3).alias("rounds_requested"), F.when(key % 3 == 0, 3).otherwise(2).alias("rounds_completed"))
    return suite.experiment_metrics(e, _rounds(spark, sf_dir))


@query(
    "z12_round_metrics",
    f"""SELECT o_orderkey AS round_id, status, reward AS dev_memory_reward_mean, NULL::DOUBLE AS train_memory_reward_mean, len(string_split(o_orderpriority, '-'))::INT AS num_warnings, 0::INT AS num_errors
    FROM ({_ROUNDS}) JOIN (SELECT o_orderkey, o_orderpriority FROM orders) USING (o_orderkey)""",
)
def round_metrics(spark, sf_dir):
    return suite.round_metrics(_rounds(spark, sf_dir)).select("round_id", "status", "dev_memory_reward_mean", "train_memory_reward_mean", "num_warnings", "num_errors")


@query(
    "z14_method_comparison",
    """WITH e AS (SELECT event_type, round(avg(value), 6) AS m, count(*) AS n FROM events GROUP BY event_type), f AS (SELECT round(avg(value), 6) AS m FROM events)
    SELECT (row_number() OVER (ORDER BY event_type))::INT AS place, event_type AS method, m AS test_memory_reward_mean FROM e UNION ALL SELECT (SELECT count(*) FROM e)::INT + 1, 'final_checkpoint', m FROM f""",
)
def method_comparison(spark, sf_dir):
    """Each type of event as a baseline, all events as the final checkpoint; their dev rows do not count."""
    v = table(spark, sf_dir, "events")
    mean = F.round(F.avg("value"), 6).alias("test_memory_reward_mean")
    per = v.groupBy(F.col("event_type").alias("name")).agg(mean).select(F.lit("baseline").alias("kind"), "name", "test_memory_reward_mean")
    rows = per.unionByName(v.agg(mean).select(F.lit("final").alias("kind"), F.lit(None).cast("string").alias("name"), "test_memory_reward_mean"))
    rows = rows.withColumns({"status": F.lit("succeeded"), "test_question_reward_mean": F.lit(None).cast("double"), "test_no_leakage_pass_rate": F.lit(1.0)})
    both = rows.withColumn("split", F.explode(F.array(F.lit("test"), F.lit("dev"))))
    return suite.method_comparison(both).select("place", "method", "test_memory_reward_mean")
