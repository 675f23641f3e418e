"""Two-pass external shuffle with plain DataFrame functions.

Pass one scatters the rows uniformly into buckets of a bounded size by a seeded hash of the whole row (the
exchange is the external scatter). Pass two gathers each bucket, which fits in a task's memory, and orders it by
``shuffle`` with a seed, which is Spark's Fisher-Yates. Buckets follow each other in the order of their number, so
every row has one place in a uniform random order of all rows, and shards are equal ranges of that order. The seed
fixes buckets for good; the order inside a bucket is drawn per task, so it also depends on the partitioning.

Defined results:
* null in any column, also in the id: such a row is scattered by its other columns and keeps its nulls;
* repeated rows: a row value found more often than half a bucket holds is dealt to all buckets in turn, so no
  bucket outgrows its bound; all copies stay in the result;
* very long texts: a bucket is bounded in rows and, on average, in bytes; one row is never split;
* empty table: no rows, same columns; fewer rows than shards: the first shards hold one row each;
* columns of the input that clash with the added names stay, the added names get underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, table

BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 16_384
SHARDS = 16
SEED = 20_24


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of the strings of a row, and eight for every other column."""
    sizes = [F.coalesce(F.octet_length(df[c]), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    out = F.lit(0).cast("long")
    for s in sizes:
        out = out + s
    return out


def scattered(df: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame, str, str]:
    """Pass one: ``df`` with its row hash and its bucket, (bucket, n) with the rows of each bucket, and the names of
    the two added columns. ``df`` is a table that reads the same each time, such as files."""
    key, bucket, serial = fresh(df, "row_hash"), fresh(df, "bucket"), fresh(df, "row_serial")
    hashed = df.withColumn(key, F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]))
    # one narrow row per row value: all that is counted comes from here
    classes = saved(hashed.groupBy(F.col(key).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("b")), "shuffle-hashes")
    total = classes.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    n_buckets = max(1, -(-(total["n"] or 0) // bucket_rows), -(-(total["b"] or 0) // bucket_bytes))
    # at most 2 * rows / bucket_rows values are that frequent
    often = classes.where(F.col("n") > bucket_rows // 2).select(F.col("hash").alias("often_hash"))
    place = lambda h, spread: F.pmod(F.xxhash64(F.lit(seed + 1), h, spread), F.lit(n_buckets))
    if often.isEmpty():
        rows = hashed.withColumn(bucket, place(F.col(key), F.lit(0).cast("long")))
        sizes = classes.groupBy(place(F.col("hash"), F.lit(0).cast("long")).alias(bucket)).agg(F.sum("n").alias("n"))
        return rows, sizes, key, bucket
    # rows are numbered as they are read, before any exchange, so each reading deals them alike
    numbered = hashed.withColumn(serial, F.monotonically_increasing_id())
    numbered = numbered.join(often.hint("shuffle_merge") if n_buckets > 100_000 else F.broadcast(often), F.col(key) == F.col("often_hash"), "left")
    spread = F.when(F.col("often_hash").isNotNull(), F.col(serial)).otherwise(F.lit(0).cast("long"))
    rows = numbered.withColumn(bucket, place(F.col(key), spread)).drop("often_hash", serial)
    return rows, rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), key, bucket


def external_shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows of ``df`` in a seeded random order, dealt to ``shards`` shards whose row counts differ by one at most.

    Adds ``bucket``, ``position`` (in the order of all rows), ``shard`` and ``slot`` (gapless from 0 in a shard)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, sizes, key, bucket = scattered(df, seed, bucket_bytes, bucket_rows)
    position, shard, slot = (fresh(df, c) for c in ("position", "shard", "slot"))
    # where each bucket starts: one number per bucket, summed over blocks of buckets and then inside a block
    sizes = sizes.withColumn("block", F.floor(F.col(bucket) / 4096))
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("block_n"))
    firsts = blocks.select("block", (F.expr("sum(block_n) OVER (ORDER BY block)") - F.col("block_n")).alias("before"), F.expr("sum(block_n) OVER ()").alias("total"))
    starts = sizes.join(firsts.hint("shuffle_hash"), "block").select(
        F.col(bucket).alias("start_bucket"),
        (F.col("before") + F.expr(f"sum(n) OVER (PARTITION BY block ORDER BY `{bucket}`)") - F.col("n")).alias("start"),
        "total",
    )
    record = F.struct(F.col(key), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    gathered = rows.groupBy(bucket).agg(F.collect_list(record).alias("rows"))
    # the order of collect_list depends on the exchange; the draw starts from the order of the row hashes
    by_hash = F.array_sort("rows", lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))
    drawn = gathered.join(starts.hint("shuffle_hash"), F.col(bucket) == F.col("start_bucket")).select(
        bucket, "start", "total", F.posexplode(F.shuffle(by_hash, F.lit(seed))).alias("at", "record")
    )
    place = drawn.withColumn(position, F.col("start") + F.col("at"))
    base, rest = F.floor(F.col("total") / shards), F.col("total") % shards
    cut = rest * (base + 1)
    some = F.greatest(base, F.lit(1))
    early = F.col(position) < cut
    return place.select(
        "record.row.*",
        F.col(bucket),
        F.col(position),
        F.when(early, F.floor(F.col(position) / (base + 1))).otherwise(rest + F.floor((F.col(position) - cut) / some)).cast("int").alias(shard),
        F.when(early, F.col(position) % (base + 1)).otherwise((F.col(position) - cut) % some).cast("long").alias(slot),
    )


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard; the files of a shard hold disjoint, ascending ranges of slots."""
    df.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard counts at most one apart. A null text has size 1 and the checksum of no bytes."""
    out = external_shuffle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
