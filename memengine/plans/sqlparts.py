"""DuckDB SQL that the oracles share: expressions, and common table expressions for each intermediate table."""

from __future__ import annotations

SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{SPACES}]+', ' ', 'g'))"


def canon(x: str) -> str:
    under = rf"regexp_replace(lower({norm(x)}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '_', 'g')"
    return f"coalesce(nullif(trim({under}, '_'), ''), 'unknown')"


def rnorm(x: str) -> str:
    return norm(rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_{SPACES}]', ' ', 'g')")


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def f1(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"""CASE WHEN len({b}) = 0 THEN CASE WHEN len({a}) = 0 THEN 1.0::DOUBLE ELSE 0.0 END WHEN len({a}) = 0 OR {both} = 0 THEN 0.0
      ELSE 2 * ({both}::DOUBLE / len({a})) * ({both}::DOUBLE / len({b})) / ({both}::DOUBLE / len({a}) + {both}::DOUBLE / len({b})) END"""


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def correctness(p: str, e: str, pn: str, en: str) -> str:
    """``pn`` and ``en``: the normalized forms as columns."""
    return f"""CASE WHEN coalesce({e}, '') = '' OR coalesce({p}, '') = '' THEN 0.0::DOUBLE WHEN {pn} = {en} THEN 1.0
      WHEN length({en}) >= 10 AND (contains({pn}, {en}) OR contains({en}, {pn})) THEN 0.75 ELSE {f1(words(pn), words(en))} END"""


def sid(prefix: str, *parts: str) -> str:
    joined = " || '||' || ".join(f"coalesce(({p})::VARCHAR, 'None')" for p in parts)
    return f"'{prefix}_' || substr(sha1({joined}), 1, 16)"


def unit(*keys: str) -> str:
    joined = " || ':' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"((('0x' || substr(sha256({joined}), 1, 12))::BIGINT + 1) / {float(16**12 + 1)!r})"


TURNS = """turns AS (
  SELECT 'rec_' || (conv_id // 4)::VARCHAR AS record_id, 's' || conv_id::VARCHAR AS session_id, conv_id,
    dense_rank() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id)::INT AS session_ord, turn::INT AS turn_id,
    row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id, turn)::INT AS event_ord,
    'evt_' || conv_id::VARCHAR || '_' || turn::VARCHAR AS event_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
  FROM conversations)"""

FACTS = f"""{TURNS},
facts0 AS (SELECT *, CASE WHEN lower(speaker) IN ('user', 'human') THEN 'user' ELSE coalesce(nullif(speaker, ''), 'speaker') END AS subject, {norm('text')} AS clean FROM turns),
facts1 AS (SELECT *, substr(clean, 1, 160) AS object, subject || ' said: ' || substr(clean, 1, 220) AS fact_text FROM facts0),
facts AS (SELECT *, {sid('fact', 'record_id', 'event_id', 'subject', "'said'", 'object', 'fact_text')} AS fact_id,
  {sid('sess', 'record_id', 'session_id')} AS session_node, {sid('topic', 'record_id', "'general_conversation'")} AS topic_id,
  {sid('ent', canon('subject'))} AS subject_id, {sid('ent', canon('object'))} AS object_id FROM facts1)"""

ABSTRACTS = f"""ranked AS (SELECT record_id, topic_id, fact_id, row_number() OVER (PARTITION BY record_id, topic_id ORDER BY event_ord) AS rn FROM facts),
abstracts0 AS (SELECT record_id, topic_id, count(*) AS n FROM ranked WHERE rn <= 50 GROUP BY ALL HAVING count(*) >= 2),
abstracts1 AS (SELECT *, 'This topic contains ' || n::VARCHAR || ' memory-worthy facts about general_conversation.' AS summary FROM abstracts0),
abstracts AS (SELECT *, {sid('abs', 'record_id', 'topic_id', 'summary')} AS node_id FROM abstracts1)"""

NODES = f"""{FACTS}, {ABSTRACTS},
mentions AS (SELECT record_id, subject_id AS id, subject AS surface, 'person' AS kind, event_ord * 3 AS ord FROM facts
  UNION ALL SELECT record_id, object_id, object, 'other', event_ord * 3 + 2 FROM facts),
entities AS (SELECT record_id, id AS node_id, arg_min({norm('surface')}, ord) AS name, arg_min(kind, ord) AS entity_type, array_to_string(list_sort(list_distinct(list(surface))), '|') AS aliases FROM mentions GROUP BY ALL),
nodes AS (
  SELECT DISTINCT record_id, session_node AS node_id, 'session' AS node_type, session_id, NULL AS speaker, NULL AS text, NULL AS name, NULL AS entity_type, NULL AS subject, NULL AS object, NULL AS source_event_id, NULL AS summary FROM facts
  UNION ALL SELECT record_id, event_id, 'event', session_id, speaker, text, NULL, NULL, NULL, NULL, NULL, NULL FROM facts
  UNION ALL SELECT DISTINCT record_id, {sid('topic', 'record_id', "'root'")}, 'topic', NULL, NULL, NULL, 'record:' || record_id, NULL, NULL, NULL, NULL, NULL FROM facts
  UNION ALL SELECT DISTINCT record_id, topic_id, 'topic', NULL, NULL, NULL, 'general_conversation', NULL, NULL, NULL, NULL, NULL FROM facts
  UNION ALL SELECT record_id, node_id, 'entity', NULL, NULL, NULL, name, entity_type, NULL, NULL, NULL, NULL FROM entities
  UNION ALL SELECT record_id, fact_id, 'fact', NULL, NULL, fact_text, NULL, NULL, subject, object, event_id, NULL FROM facts
  UNION ALL SELECT record_id, node_id, 'abstract_memory', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, summary FROM abstracts)"""

RELATIONS = f"""rel0 AS (SELECT record_id, subject, event_ord, fact_id, lower({norm('object')}) AS key, row_number() OVER (PARTITION BY record_id, subject ORDER BY event_ord) AS pos FROM facts),
relations AS (SELECT a.record_id, a.event_ord, a.fact_id AS new_fact, b.fact_id AS old_fact, (b.pos - greatest(a.pos - 8, 1))::INT AS rank
  FROM rel0 a JOIN rel0 b ON a.record_id = b.record_id AND a.subject = b.subject AND b.pos BETWEEN a.pos - 8 AND a.pos - 1 WHERE a.key = b.key)"""

EDGES = f"""{RELATIONS},
facts_prev AS (SELECT *, lag(event_id) OVER (PARTITION BY record_id ORDER BY event_ord) AS prev_id FROM facts),
edges0 AS (
  SELECT record_id, event_id AS source, session_node AS target, 'BELONGS_TO' AS edge_type, event_ord::BIGINT * 100 AS edge_ord FROM facts_prev
  UNION ALL SELECT record_id, prev_id, event_id, 'NEXT', event_ord * 100 + 1 FROM facts_prev WHERE prev_id IS NOT NULL
  UNION ALL SELECT record_id, event_id, topic_id, 'BELONGS_TO_TOPIC', event_ord * 100 + 2 FROM facts_prev
  UNION ALL SELECT record_id, event_id, subject_id, 'MENTIONS', event_ord * 100 + 3 FROM facts_prev
  UNION ALL SELECT record_id, event_id, fact_id, 'EXTRACTED_AS', event_ord * 100 + 4 FROM facts_prev
  UNION ALL SELECT record_id, fact_id, subject_id, 'FACT_SUBJECT', event_ord * 100 + 5 FROM facts_prev
  UNION ALL SELECT record_id, fact_id, object_id, 'FACT_OBJECT', event_ord * 100 + 6 FROM facts_prev
  UNION ALL SELECT record_id, fact_id, topic_id, 'BELONGS_TO_TOPIC', event_ord * 100 + 7 FROM facts_prev
  UNION ALL SELECT record_id, new_fact, old_fact, 'DUPLICATE_OF', event_ord * 100 + 10 + rank FROM relations
  UNION ALL SELECT record_id, node_id, topic_id, 'ABSTRACTS', 1099511627776 FROM abstracts
  UNION ALL SELECT a.record_id, r.fact_id, a.node_id, 'SUPPORTS', 1099511627776 + r.rn FROM abstracts a JOIN ranked r ON r.record_id = a.record_id AND r.topic_id = a.topic_id AND r.rn <= 5),
edges AS (SELECT *, (row_number() OVER (PARTITION BY record_id, source, target ORDER BY edge_ord) - 1)::INT AS edge_key FROM edges0)"""

GRAPH = f"{NODES}, {EDGES}"

KEPT = f"""{TURNS},
kept0 AS (SELECT *, {norm('text')} AS clean FROM turns),
kept AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY event_ord) AS kept_ord FROM kept0
  WHERE lower(speaker) IN ('user', 'human') AND length(clean) >= 20 AND NOT (length(clean) < 50 AND regexp_matches(lower(clean), 'solve this|calculate|translate|write code|debug this')))"""

MEMORY = f"""{KEPT},
many AS (SELECT record_id, session_id, count(*) AS n, max(kept_ord) AS last_ord, array_to_string(list(event_id ORDER BY kept_ord), '|') AS event_ids FROM kept GROUP BY ALL HAVING count(*) >= 2),
memory AS (
  SELECT record_id, {sid('mem_evt', 'record_id', 'event_id')} AS node_id, 'event' AS node_type, speaker || ' said: ' || text AS content, 0.6::DOUBLE AS confidence, 0 AS level, session_id, turn_id::VARCHAR AS turn_ids, event_id AS event_ids, kept_ord * 4 AS node_ord FROM kept
  UNION ALL SELECT record_id, {sid('mem_fact', 'record_id', 'event_id', 'substr(text, 1, 128)')}, 'fact', 'The user mentioned: ' || clean, 0.55, 1, session_id, turn_id::VARCHAR, event_id, kept_ord * 4 + 1 FROM kept
  UNION ALL SELECT record_id, {sid('mem_summary', 'record_id', 'session_id')}, 'summary', 'Session ' || session_id || ' contains ' || n::VARCHAR || ' user-provided pieces of information.', 0.5, 1, session_id, '', '', last_ord * 4 + 2 FROM many
  UNION ALL SELECT record_id, {sid('mem_abs', 'record_id', 'session_id', 'n')}, 'abstract', 'The user shared multiple pieces of information in this session.', 0.45, 2, session_id, '', event_ids, last_ord * 4 + 3 FROM many)"""

SUMMARIES = """summaries AS (SELECT record_id, '' AS user_profile,
  CASE WHEN bool_or(regexp_matches(lower(content), 'like|prefer|favorite')) THEN 'The user has expressed preferences in the conversation.' ELSE '' END AS stable_preferences,
  CASE WHEN bool_or(regexp_matches(lower(content), 'plan|will|going to|need to')) THEN 'The user has mentioned plans or intentions.' ELSE '' END AS active_plans,
  'The user provided information across ' || count(DISTINCT session_id)::VARCHAR || ' sessions and ' || count(*) FILTER (node_type = 'event')::VARCHAR || ' retained user turns.' AS recent_changes,
  '' AS cross_session_abstractions FROM memory GROUP BY record_id)"""

QUESTIONS = f"""questions0 AS (SELECT record_id, 'q_' || event_id AS question_id, session_id, event_id, event_ord, {norm('text')} AS answer FROM turns WHERE lower(speaker) = 'assistant'),
questions AS (SELECT *, array_to_string(list_slice(string_split(answer, ' '), 1, 12), ' ') AS question FROM questions0 WHERE answer <> '')"""

SCORED = f"""q_tok AS (SELECT record_id, question_id, {words(norm('question'))} AS qt FROM questions),
m_tok AS (SELECT *, {words(norm('content'))} AS mt, CASE node_type WHEN 'fact' THEN 1.15 WHEN 'abstract' THEN 1.10 WHEN 'summary' THEN 0.95 ELSE 0.90 END::DOUBLE AS w FROM memory),
scored AS (SELECT q.record_id, q.question_id, m.node_id, m.node_type, m.content, m.node_ord, least(1.0, len(list_intersect(qt, mt))::DOUBLE / len(qt) * w * m.confidence) AS score FROM q_tok q JOIN m_tok m USING (record_id) WHERE len(qt) > 0),
retrieved AS (SELECT *, row_number() OVER (PARTITION BY record_id, question_id ORDER BY score DESC, node_ord) AS rank FROM scored QUALIFY rank <= 8)"""

ANSWERS = """top3 AS (SELECT record_id, question_id, arg_min(content, rank) AS best, arg_min(score, rank) AS confidence, list(node_id ORDER BY rank) AS ids, string_agg(content, ' ' ORDER BY rank) AS evidence FROM retrieved WHERE rank <= 3 GROUP BY ALL),
answers AS (SELECT q.*, coalesce(CASE WHEN length(best) > 500 THEN rtrim(substr(best, 1, 500)) || '...' ELSE best END, '') AS prediction, CASE WHEN best IS NULL THEN 'insufficient_evidence' ELSE 'answered' END AS answer_status,
  coalesce(confidence, 0.0) AS confidence, ids, coalesce(evidence, '') AS evidence, ids IS NOT NULL AS has_evidence FROM questions q LEFT JOIN top3 USING (record_id, question_id))"""

RETRIEVAL = f"{MEMORY}, {SUMMARIES}, {QUESTIONS}, {SCORED}"
ANSWERED = f"{RETRIEVAL}, {ANSWERS}"

#: Facts cited by each question: the one of its own turn. Coverage compares it to every memory text of the record.
ITEMS = f"""fx AS (SELECT t.record_id, t.event_id, CASE WHEN lower(speaker) IN ('user', 'human') THEN 'user' ELSE coalesce(nullif(speaker, ''), 'speaker') END AS subject, {norm('text')} AS clean FROM turns t),
oracle_text AS (SELECT q.record_id, q.question_id, {rnorm("f.subject || ' said: ' || substr(f.clean, 1, 220)")} AS o FROM questions q JOIN fx f ON f.record_id = q.record_id AND f.event_id = q.event_id),
texts0 AS (SELECT record_id, content AS t FROM memory UNION ALL SELECT record_id, recent_changes FROM summaries UNION ALL SELECT record_id, stable_preferences FROM summaries WHERE stable_preferences <> '' UNION ALL SELECT record_id, active_plans FROM summaries WHERE active_plans <> ''),
texts AS (SELECT record_id, {words(rnorm('t'))} AS b FROM texts0),
cover AS (SELECT o.record_id, o.question_id, max({f1(words('o.o'), 't.b')}) AS c FROM oracle_text o JOIN texts t USING (record_id) GROUP BY ALL),
item0 AS (SELECT a.*, {rnorm('prediction')} AS pn, {rnorm('answer')} AS en, {rnorm('evidence')} AS evn, coalesce(c.c, 0.0) AS oracle_coverage FROM answers a LEFT JOIN cover c USING (record_id, question_id)),
items AS (SELECT *, {correctness('prediction', 'answer', 'pn', 'en')} AS correctness, CASE WHEN NOT has_evidence THEN 0.0 ELSE {f1(words('evn'), words('en'))} END AS evidence_support,
  CASE WHEN answer_status = 'answered' THEN 1.0 ELSE 1.0 END::DOUBLE AS citation_quality FROM item0)"""
SCORED_ITEMS = f"{ANSWERED}, {ITEMS}"
