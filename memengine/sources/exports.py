"""What leaves the engine: graph files, tables of metrics, checksums of released files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators.graph import evidence_pack

#: Fixed value: a line of a checksum file.
CHECKSUM_LINE = r"^(\S+)\s+(.+)$"
#: Names that Spark's sources take for their own.
HIDDEN = r"(^|/)[._][^/]*(/|$)"


def graph_documents(nodes: DataFrame, edges: DataFrame, part_rows: int = 20_000) -> DataFrame:
    """(record_id, part, json): a record's graph as an object with ``graph``, ``nodes`` and ``edges``, as S7 reads
    it, in the order of edges and ids. A record of more than about ``part_rows`` nodes and edges is dealt to several
    parts, each an object that S7 can read, so that no row outgrows a task; together they hold every node and edge once.
    Columns that are null in a node or edge are left out of it."""
    node = F.struct(F.col("node_id").alias("id"), *[c for c in nodes.columns if c not in ("record_id", "node_id", "id")])
    key = F.col("edge_key") if "edge_key" in edges.columns else F.lit(0)
    edge = F.struct("source", "target", key.alias("key"), *[c for c in edges.columns if c not in ("record_id", "source", "target", "edge_key", "key")])
    order = F.col("edge_ord") if "edge_ord" in edges.columns else F.lit(0)
    rows = nodes.select("record_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), F.to_json(node).alias("x")).unionByName(
        edges.select("record_id", F.lit(1).alias("kind"), order.cast("long").alias("ord"), F.to_json(edge).alias("x"))
    )
    sizes = rows.groupBy("record_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    # a merge join, so that a record with many rows can be split where it is skewed
    dealt = rows.join(sizes.hint("merge"), "record_id").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    per = dealt.groupBy("record_id", "part").agg(F.array_sort(F.collect_list(F.struct("kind", "ord", "x"))).alias("xs"))
    listed = lambda kind: F.array_join(F.transform(F.filter("xs", lambda e: e["kind"] == kind), lambda e: e["x"]), ",")
    head = F.to_json(F.struct(F.struct("record_id", "part").alias("graph")))
    body = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"nodes":['), listed(0), F.lit('],"edges":['), listed(1), F.lit("]}"))
    return per.withColumn("head", head).select("record_id", "part", body.alias("json"))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str, part_rows: int = 20_000) -> None:
    """Graphs below ``path``/graphs and evidence packs below ``path``/evidence_packs, a file for each part of a
    record; ``read_graphs`` on ``.../*/*`` gives the tables back."""
    for folder, (n, e) in {"graphs": (nodes, edges), "evidence_packs": evidence_pack(nodes, edges)}.items():
        docs = graph_documents(n, e, part_rows)
        # an id may hold what no folder's name can: the folder is called by its hash, the id stands in the file
        named = docs.select(F.sha1(F.col("record_id").cast("binary")).alias("record"), "part", F.col("json").alias("value"))
        named.write.mode("errorifexists").partitionBy("record", "part").text(f"{path}/{folder}")


def metric_texts(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every column as the text that stands in a CSV file: fractions with four decimals, nulls and NaN empty."""

    def text(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType | FloatType):
            shown = F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f"%.{digits}f", c.cast("double")))
        else:
            shown = c.cast("string")
        return F.coalesce(shown, F.lit("")).alias(field.name)

    return df.select(*[text(f) for f in df.schema.fields])


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """``csv`` with a header (see ``metric_texts``) or ``jsonl``, in which nulls stay."""
    if fmt == "csv":
        metric_texts(df).write.option("header", True).option("emptyValue", "").csv(path)
    elif fmt == "jsonl":
        df.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown format {fmt}: csv or jsonl")


def _hadoop_path(spark: SparkSession, path: str):
    """The file system and the full path of ``path``."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(file)


def _empty_files(system, root) -> list[str]:
    """Files of no bytes below ``root``, which Spark's sources pass over; only their names come to the driver."""
    out, files = [], system.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0:
            out.append(f.getPath().toString())
    return out


def checksum_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of all files below ``folder``, paths relative to it; a file is hashed where it is read, up to
    the 2 GB that a row holds. Left out are the checksum file itself and names that begin with ``_`` or ``.``, which
    Spark takes for its own."""
    system, root = _hadoop_path(spark, folder)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("sha256"))
    empty = spark.createDataFrame([(p,) for p in _empty_files(system, root)], "path string").select("path", F.sha2(F.lit(b""), 256).alias("sha256"))
    start = len(root.toString().rstrip("/")) + 2
    files = read.unionByName(empty).select(F.expr(f"substring(path, {start})").alias("path"), "sha256")
    return files.where("path <> 'checksums.sha256'").where(~F.col("path").rlike(HIDDEN))


def checksum_lines(files: DataFrame) -> DataFrame:
    """The lines of a checksum file, by path; write them with one sort."""
    return files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def verify_checksums(lines: DataFrame, actual: DataFrame, value: str = "value") -> DataFrame:
    """(path, code, expected, actual) of what ``lines`` (text) and ``actual`` (path, sha256) do not agree on:
    ``bad_line`` (the line stands in ``path``), ``missing`` file, ``mismatch``, ``unlisted`` file, and ``unread`` for a listed name
    that ``checksum_manifest`` leaves out. Blank lines go. A path listed twice is held against its file both times."""
    text: Column = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    rows = lines.select(text.alias("line")).where("line <> ''")
    parts = rows.select("line", F.regexp_extract("line", CHECKSUM_LINE, 1).alias("expected"), F.regexp_extract("line", CHECKSUM_LINE, 2).alias("path"))
    bad = parts.where("path = ''").select(F.col("line").alias("path"), F.lit("bad_line").alias("code"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    listed = parts.where("path <> ''").select("path", "expected")
    both = listed.join(actual.select("path", F.col("sha256").alias("actual")).hint("merge"), "path", "full_outer")
    code = F.when(F.col("expected").isNull(), "unlisted").when(F.col("actual").isNull() & F.col("path").rlike(HIDDEN), "unread").when(F.col("actual").isNull(), "missing").when(F.col("expected") != F.col("actual"), "mismatch")
    return both.select("path", code.alias("code"), "expected", "actual").where("code is not null").unionByName(bad)


def verify_release(spark: SparkSession, folder: str) -> DataFrame:
    """A release folder against its ``checksums.sha256``; without that file one row says so."""
    actual = checksum_manifest(spark, folder)
    name = f"{folder.rstrip('/')}/checksums.sha256"
    system, file = _hadoop_path(spark, name)
    if not system.exists(file):
        return spark.createDataFrame([("checksums.sha256", "missing", None, None)], "path string, code string, expected string, actual string")
    return verify_checksums(spark.read.text(name), actual)
