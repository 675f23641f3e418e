"""Helpers that the training-data operators share: tables, durable intermediates, names."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Spark's setting to remove shuffle files at the end of a query.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's bound on the bytes of a batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only for a local master that names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="memengine-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def saved(df: DataFrame, label: str, rows: int = 0) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage, survives lost
    executors, and gives the optimizer true sizes. What was shuffled for it is removed once it is written.

    ``rows`` bounds the rows of a file: a writer and a reader hold up to thousands of rows of a file at once, so tables
    of large rows need it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", rows).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Removes tables made by ``saved`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.startswith(shared_dir(spark).replace("file://", "file:")) or folder.startswith(shared_dir(spark)):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` with dense numbers from 1. A task sees the number of rows of each partition, the driver their sum; all of
    it stays in the JVM, as Python workers started for a small table would stay in the executors' memory."""
    first = saved(df.select("*", F.monotonically_increasing_id().alias("_at")), label)
    part = F.shiftright("_at", 33)
    sizes = first.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    base = saved(sizes.select("p", "n", (F.sum("n").over(Window.orderBy("p")) - F.col("n") + 1).alias("base")), f"{label}-starts")
    if (base.agg(F.sum("n")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more than 2**31 numbers")
    return first.join(F.broadcast(base.drop("n")), part == F.col("p")).select(*df.columns, (F.col("base") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of results that are written by now and referenced no more."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(column: str, modulus: int):
    """crc32 of the id's decimal text modulo ``modulus``; the text of a null id is empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def given_back() -> None:
    """Gives memory that this Python worker has freed back to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """A function of batches for ``mapInArrow`` that keeps no memory after its task: Spark keeps Python workers for
    later stages, and what an idle one holds is missing there."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _MEMOS.clear()
            given_back()

    return tidied


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` that is tidy, with batches of bounded bytes unless the session sets a bound itself: a batch stands
    in the memory of the executor and of the Python worker, however long its texts are."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "8m")
    return df.mapInArrow(tidy(run), schema)


def with_arrays(df: DataFrame, column: str, names_types: list[tuple[str, str]], compute, drop: bool = False) -> DataFrame:
    """Appends columns that ``compute(pyarrow.Array of column) -> list of pyarrow.Array`` gives, batch by batch.

    The other columns pass through as they are; ``drop`` leaves ``column`` out of the result."""
    names = [c for c in df.columns if not (drop and c == column)]
    schema = "struct<" + ",".join(f"`{n}`:{t}" for n, t in names_types) + ">"
    from pyspark.sql.types import StructType

    kept = StructType([f for f in df.schema.fields if f.name in names])
    added = StructType.fromDDL(schema[7:-1]) if names_types else StructType([])
    full = StructType(kept.fields + added.fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            new = compute(batch.column(batch.schema.get_field_index(column)))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(columns + list(new), names=[*names, *[n for n, _ in names_types]])
            del batch, new, columns  # before the next batch comes

    return mapped(df, run, full)


class Memo(dict):
    """Results by key (bytes or text), of a bounded size: keys that would outgrow it push out all that isn't needed now."""

    BYTES = 48 << 20
    ENTRY = 150

    def __init__(self):
        super().__init__()
        self.held = 0

    def room_for(self, keys: set) -> list:
        """Makes room for ``keys``, forgets none of them, and returns those that are not known."""
        new = [k for k in keys if k not in self]
        more = self._size(new)
        if self.held + more > self.BYTES:
            kept = {k: self[k] for k in keys if k in self}
            self.clear()
            self.update(kept)
            self.held = self._size(kept)
        self.held += more
        return new

    def _size(self, keys) -> int:
        return sum(map(len, keys)) + self.ENTRY * len(keys)


_MEMOS: dict[tuple, Memo] = {}


def memo(*key) -> Memo:
    """The memo of that name. A Python worker holds one at a time, and none after a task."""
    if key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[key] = Memo()
    return _MEMOS[key]
