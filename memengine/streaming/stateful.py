"""Stateful streams: memory that grows turn by turn, weaknesses that are folded as judgements arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import normalize_text
from ..operators.incremental import COVERED
from ..operators.memory import MemoryConfig, enters_memory, turn_ids
from ..operators.weakness import FIELDS, fold

#: Changes of a memory's nodes and edges. ``seq`` orders the changes of a record; an edge has no node type.
CHANGES = "record_id string, seq bigint, op string, kind string, id string, target string, node_type string, content string, session_id string, event_ids array<string>, build_step bigint"

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _stable(prefix: str, *parts) -> str:
    """P3, for ids that depend on state."""
    return f"{prefix}_{hashlib.sha1('||'.join(map(str, parts)).encode()).hexdigest()[:16]}"


class MemoryProcessor(StatefulProcessor):
    """Per record: a counter of changes and build steps, and of each session the turns that it retains.

    Turns come in any order and any number of times. Events and facts are final; a session's summary and abstract change
    with every turn of it, so what they were is taken back before what they are is added."""

    def __init__(self, limit: int | None = None):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "seq bigint, kept bigint, build_step bigint")
        self.sessions = handle.getMapState("sessions", "session_id string", "turns array<bigint>, events array<string>, facts array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (record_id,) = key
        seq, kept, step = self.record.get() if self.record.exists() else (0, 0, 0)
        out = []

        def change(op, kind, ident, target=None, node_type=None, content=None, session=None, events=()):
            nonlocal seq
            seq += 1
            out.append((record_id, seq, op, kind, ident, target, node_type, content, session, list(events), step))

        new = pd.concat(list(rows)).sort_values(["session_id", "turn_id", "event_id"])
        for session, turns in new.groupby("session_id", sort=True):
            before = self.sessions.getValue((session,)) if self.sessions.containsKey((session,)) else None
            held = list(zip(*before, strict=True)) if before else []
            was, seen = list(held), {e for _, e, _ in held}
            if before is None:
                step += 1
            for r in turns.itertuples(index=False):
                if r.event_id in seen or not r.enters or (self.limit is not None and kept >= self.limit):
                    continue
                kept += 1
                seen.add(r.event_id)
                held.append((int(r.turn_id), r.event_id, r.fact_node))
                change("add", "node", r.event_node, None, "event", f"{r.speaker} said: {r.text}", session, [r.event_id])
                change("add", "node", r.fact_node, None, "fact", f"The user mentioned: {r.clean}", session, [r.event_id])
                change("add", "edge", r.fact_node, r.event_node)
            held.sort()
            if held != was:
                for op, turns_ in (("remove", was), ("add", held)):
                    if len(turns_) >= 2:
                        n, events, facts = len(turns_), [e for _, e, _ in turns_], [f for _, _, f in turns_[:COVERED]]
                        top = _stable("mem_abs", record_id, session, n)
                        change(op, "node", _stable("mem_summary", record_id, session), None, "summary", f"Session {session} contains {n} user-provided pieces of information.", session)
                        change(op, "node", top, None, "abstract", "The user shared multiple pieces of information in this session.", session, events)
                        for f in facts:
                            change(op, "edge", top, f)
            if held != was or before is None:
                self.sessions.updateValue((session,), ([t for t, _, _ in held], [e for _, e, _ in held], [f for _, _, f in held]))
        self.record.update((seq, kept, step))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def stream_memory(turns: DataFrame, sessions_per_record: int = 4, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """The changes (``CHANGES``) of every record's memory as turns (conv_id, turn, role, text) arrive.

    Whatever the turns' order, number of deliveries and cut into batches, ``folded_nodes`` of all changes is the
    memory that a batch build over the turns gives (limits on events aside, which hold in order of arrival). Texts and
    ids are made by Spark; Python sees only what it has to remember."""
    turns.sparkSession.conf.set(*STATE_STORE)
    rows = turns.select(
        F.concat(F.lit("rec_"), F.floor(F.col("conv_id") / sessions_per_record).cast("string")).alias("record_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("turn").cast("bigint").alias("turn_id"),
        F.concat_ws("_", F.lit("evt"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    event, fact = turn_ids()
    ready = rows.select("record_id", "session_id", "turn_id", "event_id", "speaker", "text", normalize_text("text").alias("clean"), event.alias("event_node"), fact.alias("fact_node"), enters_memory(cfg).alias("enters"))
    return ready.groupBy("record_id").transformWithStateInPandas(statefulProcessor=MemoryProcessor(cfg.max_event_nodes), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def folded_nodes(changes: DataFrame) -> DataFrame:
    """The nodes that stand after all changes."""
    rest = ["seq", "op", "node_type", "content", "session_id", "event_ids"]
    last = changes.where("kind = 'node'").groupBy("record_id", "id").agg(F.max_by(F.struct(*rest), "seq").alias("c"))
    return last.where("c.op = 'add'").select("record_id", F.col("id").alias("node_id"), "c.node_type", "c.content", "c.session_id", "c.event_ids")


def folded_edges(changes: DataFrame) -> DataFrame:
    """The edges that stand after all changes."""
    last = changes.where("kind = 'edge'").groupBy("record_id", "id", "target").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'add'").select("record_id", F.col("id").alias("source"), "target")


ITEM = (
    "question_id string, question_type string, correctness double, failure_types array<string>, supporting_oracle_node_ids array<string>, "
    "related_session_ids array<string>, supporting_memory_ids array<string>, item_ord bigint, round_id int"
)
ENTRY = (
    "weakness_id string, record_id string, question_id string, question_type string, failure_type string, severity double, frequency int, "
    "first_seen_round int, last_seen_round int, status string, missing_oracle_node_ids array<string>, related_session_ids array<string>, related_memory_ids array<string>, entry_ord int"
)
#: What a fold changed: the entry as it is now, and whether it is new.
DELTAS = ENTRY + ", change string"
_ITEM = [c.strip().split(" ")[0] for c in ITEM.split(",")]


def _plain(values) -> tuple:
    """Values as the state store takes them: no numpy."""
    return tuple(v.tolist() if hasattr(v, "tolist") else list(v) if isinstance(v, list | tuple) else v for v in values)


class WeaknessProcessor(StatefulProcessor):
    """Per record: the book, and the items of rounds that are not over. A timer at the event time of a round's end folds
    its items in their order, whatever the order they came in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getListState("book", ENTRY)
        self.waiting = handle.getListState("waiting", ITEM + ", ends_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.assign(ends_ms=pdf["round_end"].astype("datetime64[ms]").astype("int64"))
            self.waiting.appendList([_plain(r) for r in pdf[[*_ITEM, "ends_ms"]].itertuples(index=False, name=None)])
            for ms in pdf["ends_ms"].unique():
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame(columns=[*FIELDS, "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        names = [*_ITEM, "ends_ms"]
        waiting = [dict(zip(names, _plain(r), strict=True)) for r in self.waiting.get()]
        due, later = [w for w in waiting if w["ends_ms"] <= now], [w for w in waiting if w["ends_ms"] > now]
        book = [dict(zip(FIELDS, _plain(r), strict=True)) for r in self.book.get()]
        before = {e["weakness_id"]: (e["frequency"], e["last_seen_round"]) for e in book}
        due.sort(key=lambda w: (w["round_id"], w["item_ord"]))
        for w in due:
            fold(book, [{**w, "record_id": key[0]}], w["round_id"])
        for state, kept, columns in ((self.book, book, FIELDS), (self.waiting, later, names)):
            if kept:
                state.put([_plain(e[c] for c in columns) for e in kept])
            else:
                state.clear()
        changed = [{**e, "change": "updated" if e["weakness_id"] in before else "added"} for e in book if before.get(e["weakness_id"]) != (e["frequency"], e["last_seen_round"])]
        yield pd.DataFrame(changed, columns=[*FIELDS, "change"])

    def close(self) -> None:
        pass


def stream_weaknesses(items: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """T4: what each round changes in the books, as judged items (record_id, ``ITEM``, round_end) arrive. A round is
    folded once the watermark, ``delay`` behind the latest ``round_end``, has passed its end."""
    items.sparkSession.conf.set(*STATE_STORE)
    rows = items.select("record_id", *_ITEM, "round_end").withWatermark("round_end", delay)
    return rows.groupBy("record_id").transformWithStateInPandas(statefulProcessor=WeaknessProcessor(), outputStructType=DELTAS, outputMode="Append", timeMode="EventTime")


def current_book(deltas: DataFrame) -> DataFrame:
    """The books that all changes together come to."""
    rest = [c for c in FIELDS if c not in ("weakness_id", "record_id")]
    last = deltas.groupBy("record_id", "weakness_id").agg(F.max_by(F.struct(*rest), F.struct("last_seen_round", "frequency")).alias("e"))
    return last.select("weakness_id", "record_id", "e.*").select(*FIELDS)
