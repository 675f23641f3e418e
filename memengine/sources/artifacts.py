"""Graph artifacts in JSON files, and JSON objects in the replies of language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from ..operators.audit import find_keys, remove_keys

#: Keys that a graph for question makers must not hold.
FORBIDDEN_KEYS = ("question", "question_type", "answer", "gold_answer", "target", "answer_session_ids", "haystack", "has_answer")


def parse_reply(text: Column | str) -> Column:
    """The JSON of a reply as a variant: code fences go, and where the rest is no JSON, what stands from the first
    to the last brace is read. Null where there is none."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(inner, F.lit(""))))


def read_graphs(spark: SparkSession, path: str, strict: bool = True, sanitize: bool = False, keys: tuple[str, ...] = FORBIDDEN_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, findings) of JSON files, one graph each. ``strict`` leaves out graphs with a forbidden key,
    ``sanitize`` removes such keys instead; ``findings`` (file, path) lists them. A ``target`` of an edge is no finding. ``attributes`` keeps
    what nodes and edges hold beside the columns, nested values as JSON."""
    if strict and sanitize:
        raise ValueError("strict and sanitize exclude each other")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    if sanitize:
        files = remove_keys(files, "json", list(keys), edge_targets=True)
        findings = files.select("file", F.explode("removed_paths").alias("path"))
    else:
        findings = find_keys(files, "file", "json", list(keys), edge_targets=True).select(F.col("row_id").alias("file"), "path")
    if strict:
        files = files.join(findings.select("file").distinct().hint("merge"), "file", "left_anti")
    graph = files.select("file", F.from_json("json", "record_id string, graph map<string,string>, nodes array<map<string,string>>, edges array<map<string,string>>").alias("g"))
    record = F.coalesce("g.record_id", F.col("g.graph")["record_id"], "file").alias("record_id")
    field = lambda c: F.col("x")[c].alias(c)
    rest = lambda known: F.map_filter("x", lambda k, _: ~k.isin(*known)).alias("attributes")
    node_fields = ("node_type", "session_id", "text", "name", "source_event_id")
    node_id = F.coalesce(F.col("x")["node_id"], F.col("x")["id"]).alias("node_id")
    nodes = graph.select(record, F.explode("g.nodes").alias("x")).select("record_id", node_id, *[field(c) for c in node_fields], rest(("node_id", "id", *node_fields)))
    edge_fields = ("source", "target", "edge_type")
    key = F.coalesce(F.col("x")["key"], F.lit("0")).alias("edge_key")
    edges = graph.select(record, F.posexplode("g.edges").alias("edge_ord", "x")).select("record_id", *[field(c) for c in edge_fields], key, "edge_ord", rest((*edge_fields, "key")))
    return nodes, edges, findings


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON-lines files; blank lines go. A line that is no object of ``schema`` is left out, or with
    ``strict`` fails the read."""
    kind = StructType.fromDDL(schema).add("_bad", "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", kind, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if strict:
        rows = rows.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("not a record: "), "value"))).otherwise(F.col("r")))
        return rows.select("r.*").drop("_bad")
    return rows.where(~bad).select("r.*").drop("_bad")


def append_json_lines(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON-lines files; what stands there stays."""
    df.write.mode("append").json(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(record_id) of text files with one id a line; blank lines, comments (#) and repeats go."""
    ids = spark.read.text(path).select(F.trim("value").alias("record_id"))
    return ids.where((F.col("record_id") != "") & ~F.col("record_id").startswith("#")).distinct()


def chosen_records(records: DataFrame, ids: DataFrame | None = None, max_records: int | None = None) -> DataFrame:
    """``records`` with an id of ``ids``, and of those the first ``max_records`` by id where a limit is asked for."""
    out = records if ids is None else records.join(ids.select("record_id").distinct().hint("merge"), "record_id", "left_semi")
    return out if max_records is None else out.orderBy("record_id").limit(max_records)
