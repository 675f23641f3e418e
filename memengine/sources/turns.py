"""Conversation turns: from the native table, and from loosely shaped JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import coalesce_truthy

#: The names under which records, sessions, turns and their fields may appear.
ID_KEYS = ("id", "question_id", "sample_id")
QUESTION_KEYS = ("question", "query")
ANSWER_KEYS = ("answer", "gold_answer", "target")
TYPE_KEYS = ("question_type", "type", "category")
SESSION_KEYS = ("haystack_sessions", "sessions", "history", "histories", "conversation_sessions", "conversations")
MESSAGE_KEYS = ("messages", "conversation", "dialogue", "chat_history")
TURN_KEYS = ("messages", "conversation", "dialogue", "turns", "chat", "history")
SPEAKER_KEYS = ("role", "speaker", "from", "author")
TEXT_KEYS = ("content", "text", "message", "utterance")
TIME_KEYS = ("timestamp", "time", "date", "created_at", "datetime")


def turns_from_conversations(df: DataFrame, sessions_per_record: int = 4) -> DataFrame:
    """(conv_id, turn, role, text) as turns; a record is a run of conversations, a conversation a session."""
    rows = df.select(
        F.concat(F.lit("rec_"), F.floor(F.col("conv_id") / sessions_per_record).cast("string")).alias("record_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        "conv_id",
        F.col("turn").cast("int").alias("turn_id"),
        F.concat_ws("_", F.lit("evt"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("record_id").orderBy("conv_id", "turn_id", "event_id")
    by_session = Window.partitionBy("record_id").orderBy("conv_id")
    return rows.select(
        "record_id",
        "session_id",
        F.dense_rank().over(by_session).alias("session_ord"),
        "turn_id",
        F.row_number().over(order).alias("event_ord"),
        "event_id",
        "speaker",
        "text",
        F.lit(None).cast("string").alias("ts_raw"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, source_index, doc, question, answer, question_type) of JSON files whose root is a list,
    ``{"data": [...]}`` or an object of records."""
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("root"), F.input_file_name().alias("file"))
    docs = docs.select("file", F.coalesce(F.try_variant_get("root", "$.data", "variant"), F.col("root")).alias("root"))
    rows = docs.lateralJoin(spark.tvf.variant_explode(F.col("root").outer()))

    def pick(keys):
        return _picked("value", keys)

    order = Window.partitionBy("file").orderBy("pos")
    indexed = rows.withColumn("source_index", F.row_number().over(order) - 1)
    return indexed.select(
        F.coalesce(pick(ID_KEYS), F.format_string("record_%05d", "source_index")).alias("record_id"),
        "source_index",
        F.col("value").alias("doc"),
        pick(QUESTION_KEYS).alias("question"),
        pick(ANSWER_KEYS).alias("answer"),
        pick(TYPE_KEYS).alias("question_type"),
    )


def _first_list(keys, col: str):
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(col, f"$.{k}", "variant")).startswith("ARRAY"), F.try_variant_get(col, f"$.{k}", "variant")) for k in keys])


def _kind(c):
    """OBJECT, ARRAY, STRING, .. of a variant."""
    return F.regexp_extract(F.schema_of_variant(c), "^[A-Z]+", 0)


def _exploded(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row (pos, value) per element of the variant list in ``column``."""
    items = F.try_variant_get(column, "$", "array<variant>")
    return df.select(*keep, F.posexplode(items).alias("pos", "value"))


def _picked(column: str, keys):
    return coalesce_truthy(*[F.try_variant_get(column, f"$.{k}", "string") for k in keys])


def explode_sessions(records: DataFrame) -> DataFrame:
    """S3: one row per session. A record without a list of sessions but with a list of messages is one session,
    ``session_0000``; a session without an id is called by its place."""
    lists = records.select("record_id", _first_list(SESSION_KEYS, "doc").alias("sessions"), _first_list(MESSAGE_KEYS, "doc").alias("messages"))
    many = _exploded(lists.where("sessions is not null"), "sessions", "record_id")
    one = lists.where("sessions is null and messages is not null").select("record_id", F.lit(0).alias("pos"), F.col("messages").alias("value"), F.lit("session_0000").alias("own"))
    rows = many.withColumn("own", F.lit(None).cast("string")).unionByName(one).withColumnRenamed("value", "session")
    return rows.select(
        "record_id",
        F.coalesce("own", _picked("session", ("session_id", "id")), F.concat("record_id", F.format_string("_sess_%04d", "pos"))).alias("session_id"),
        (F.col("pos") + 1).alias("session_ord"),
        "session",
        _picked("session", TIME_KEYS).alias("session_ts"),
    )


def explode_turns(sessions: DataFrame) -> DataFrame:
    """Turns of a session that is a list, a text (one turn), an object with a list of turns, or an object with
    what the user and the assistant said. Empty texts go; turn_id keeps its place. A turn that is neither text nor
    object is a turn of an unknown speaker; parts of a text are joined by line breaks."""
    kind = _kind("session")
    said = F.array(*[F.struct(F.lit(who).alias("who"), _picked("session", (who,)).alias("text")) for who in ("user", "assistant")])
    pair = F.filter(said, lambda x: x["text"].isNotNull())
    shaped = sessions.withColumn("turns", F.when(kind == "ARRAY", F.col("session")).when(kind == "OBJECT", _first_list(TURN_KEYS, "session")))
    shaped = shaped.withColumn("said", F.when(kind == "STRING", F.array(F.struct(F.lit("unknown").alias("who"), F.try_variant_get("session", "$", "string").alias("text")))).when((kind == "OBJECT") & F.col("turns").isNull(), pair))
    keep = ("record_id", "session_id", "session_ord", "session_ts")
    listed = _exploded(shaped.where("turns is not null"), "turns", *keep)
    object_ = _kind("value") == "OBJECT"
    parts = F.array_join(F.try_variant_get("value", "$.content", "array<string>"), "\n")
    text = F.when(object_, F.coalesce(F.nullif(parts, F.lit("")), _picked("value", TEXT_KEYS))).otherwise(F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")))
    listed = listed.select(*keep, "pos", F.when(object_, _picked("value", SPEAKER_KEYS)).alias("speaker"), text.alias("text"), F.when(object_, _picked("value", TIME_KEYS)).alias("ts"))
    spoken = shaped.where("turns is null").select(*keep, F.posexplode("said").alias("pos", "s")).select(*keep, "pos", F.col("s.who").alias("speaker"), "s.text", F.lit(None).cast("string").alias("ts"))
    rows = listed.unionByName(spoken).where("text is not null and trim(text) <> ''")
    order = Window.partitionBy("record_id").orderBy("session_ord", "turn_id")
    turns = rows.select("record_id", "session_id", "session_ord", F.col("pos").cast("int").alias("turn_id"), F.coalesce("speaker", F.lit("unknown")).alias("speaker"), "text", F.coalesce("ts", "session_ts").alias("ts_raw"))
    return turns.withColumn("event_ord", F.row_number().over(order)).withColumn("event_id", F.concat_ws("_", "session_id", F.col("turn_id").cast("string")))


def safe_history(turns: DataFrame) -> DataFrame:
    """What a memory builder may see."""
    return turns.select("record_id", "session_id", "session_ord", "turn_id", "event_ord", "event_id", "speaker", "text", "ts_raw")
