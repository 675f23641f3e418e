"""Near-duplicate documents by min-max hashing.

One pass makes, per document, the set of its word shingles as 64-bit hashes and, for each of ``PERMUTATIONS`` hash
functions, both the smallest and the largest value: two signature entries for one evaluation. Bands of ``ROWS``
entries (minima or maxima) propose candidates, and every link is confirmed on the full sets.

Equal word sequences are one class from the start; what follows works on classes. Inside a bucket no set of all pairs
is made:
1. every class is compared to the bucket's hub, the class that shares the most buckets with others; links are
   confirmed on full sets and components formed;
2. in buckets that still hold several components, the full sets of the rows outside the largest component meet all
   other rows in blocks of bounded size. A task returns one link for two components that it joins, not the pairs.
A pair at exactly the threshold shares no band with probability (1 - 0.8**4)**32, about 5e-8.

Defined results:
* null or empty text, or a text of white space: empty set, linked with nothing, its own component, kept;
* fewer words than a shingle has: the whole sequence is the one shingle;
* a row without an id is linked with nothing, has a null component and is kept;
* rows that repeat an id are one document, also with several texts: each text's links count, all rows of the id get one
  component; ``duplicate_rows`` instead decides by text;
* texts are read whole; of equal texts the smallest id leads; an empty table gives no rows;
* columns besides id and text are not looked at, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, given_back, mapped, memo, saved, table, with_arrays
from .components import components

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Rows that meet in one task, on either side.
BLOCK = 512
#: Numbers from here on name the further classes of an id that has several texts.
EXTRA = 1 << 62
#: Ids of at most this many candidates travel to all tasks (8 bytes each); more are matched by an exchange.
BROADCAST_IDS = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def shingles(text: str | None, width: int) -> tuple[np.ndarray, bytes]:
    """Sorted distinct shingle hashes of a text, and a digest of its word sequence."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64), b""
    known = memo("words")
    for w in known.room_for(set(words)):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    mixed = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : len(words) - k + 1 + i]) * _MIX[i % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
    return _distinct(mixed), xxhash.xxh3_128_digest(b" ".join(words))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima, then maxima, of the upper halves of a * x + b for each non-empty set."""
    out = np.zeros((len(sets), 2 * PERMUTATIONS), np.uint32)
    a, b = _coefficients()
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        at = np.cumsum([0] + [len(s) for s in sets[start : end - 1]])
        for i in range(PERMUTATIONS):
            v = x * a[i]
            v += b[i]
            out[start:end, i] = np.minimum.reduceat(v, at) >> np.uint64(32)
            out[start:end, PERMUTATIONS + i] = np.maximum.reduceat(v, at) >> np.uint64(32)
        start = end
    return out


def with_signatures(df: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``words_key`` (null for an empty set), ``n_shingles`` and ``signature``."""

    def compute(column):
        keys, sizes, signs, waiting, held = [], [], [], [], 0

        def settle():
            if waiting:
                signs.extend(row.tobytes() for row in signatures(waiting))
                waiting.clear()

        where = []
        for t in column:
            s, key = shingles(t.as_py(), width)
            sizes.append(len(s))
            keys.append(key or None)
            if len(s):
                where.append(len(sizes) - 1)
                waiting.append(s)
                held += len(s)
                if held > 1 << 19:
                    settle()
                    held = 0
        settle()
        full: list[bytes | None] = [None] * len(sizes)
        for i, s in zip(where, signs, strict=True):
            full[i] = s
        return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(full, pa.binary())]

    return with_arrays(df, text, [("words_key", "binary"), ("n_shingles", "bigint"), ("signature", "binary")], compute, drop=True)


def classified(marked: DataFrame) -> DataFrame:
    """(node, rep, words_key, n_shingles, signature): one row per distinct word sequence. ``rep`` is its smallest id,
    and so is ``node``, but for further texts of one id."""
    rows = marked.where("words_key is not null and doc_id is not null")
    classes = rows.groupBy("words_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    classes = saved(classes, "minhash-classes")
    again = saved(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("words_key").alias("first_key")).where("n > 1").select("rep", "first_key"), "minhash-again")
    if again.isEmpty():
        return classes.select(F.col("rep").alias("node"), "*")
    further = F.lit(EXTRA).bitwiseOR(F.xxhash64("words_key").bitwiseAND(F.lit(EXTRA - 1)))
    node = F.when(F.col("first_key").isNull() | (F.col("first_key") == F.col("words_key")), F.col("rep")).otherwise(further)
    return saved(classes.join(again.hint("merge"), "rep", "left").select(node.alias("node"), *classes.columns), "minhash-nodes")


def full_sets(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, set): the shingle hashes of each class, as bytes, from one of its rows; written."""
    few = classes.count() <= BROADCAST_IDS
    ids = classes.select("node", F.col("rep").alias("doc_id"), "words_key")
    texts = docs.where("doc_id is not null").join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id").select("node", "words_key", "text")

    def run(batches):
        for batch in batches:
            keep, sets = [], []
            for i, (key, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                hashes, own = shingles(text.as_py(), width)
                if own == key:  # an id may have other texts
                    keep.append(i)
                    sets.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], names=["node", "set"])

    return saved(mapped(texts, run, "node bigint, set binary").dropDuplicates(["node"]), "minhash-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")).hint("merge"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(_distinct(np.concatenate((x, y))))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return saved(mapped(both.select("a", "b", "set_a", "set_b"), run, "a bigint, b bigint"), "minhash-links")


def _joining(percent: int):
    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links between rows of different components, one for any two that meet here and become one."""
        try:
            return linked(left, right)
        finally:
            if max(len(left), len(right)) >= BLOCK // 2:
                given_back()

    def linked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            left, right = left.sort_values("node"), right.sort_values("node")
            held = [np.frombuffer(x, np.uint64) for x in right["set"]]
            sizes = np.array([len(x) for x in held])
            values, flat = np.unique(np.concatenate(held), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            names, label = np.unique(np.concatenate((left["component"], right["component"])), return_inverse=True)
            mine, theirs, nodes = label[: len(left)], label[len(left) :], right["node"].to_numpy()
            marked = np.zeros(len(values), bool)
            for k, (i, x) in enumerate(zip(left["node"], left["set"], strict=True)):
                if (theirs == mine[k]).all():
                    continue
                x = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                at = at[values[at] == x]
                marked[at] = True
                common = np.add.reduceat(marked[flat].astype(np.int64), starts)
                marked[at] = False
                near = np.nonzero((theirs != mine[k]) & (100 * common >= percent * (len(x) + sizes - common)))[0]
                for j in near.tolist():
                    if theirs[j] != mine[k]:
                        out.append((int(min(i, nodes[j])), int(max(i, nodes[j]))))
                        old, new = theirs[j], mine[k]
                        theirs[theirs == old] = new
                        mine[mine == old] = new
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def linked_outside(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components still apart inside one bucket: the rows outside a bucket's largest
    component meet all rows of the bucket in blocks, with their full sets."""
    large = buckets.where("members > 2").select("band", "node")
    labelled = large.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("main_n"))
    mixed = saved(mixed.where("components > 1").drop("components"), "minhash-mixed")
    # what stands together in several bands is compared in one of them: the same members have the same hash
    alike = labelled.join(mixed.select("band").hint("merge"), "band", "left_semi").groupBy("band").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.count(F.lit(1)).alias("n"))
    once = saved(alike.groupBy("mark", "n").agg(F.min("band").alias("band")).select("band"), "minhash-once")
    mixed = mixed.join(once.hint("merge"), "band", "left_semi")
    rows = saved(labelled.join(mixed.hint("merge"), "band"), "minhash-rows")
    out_n = F.col("members") - F.col("main_n")
    slots = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(n / BLOCK) - 1)
    inside = rows.select("band", "node", "component", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)).alias("block"), F.explode(slots(out_n)).alias("outer"))
    outside = rows.where("component <> main").select("band", "node", "component", F.explode(slots(F.col("members"))).alias("block"), F.pmod(F.xxhash64("node"), F.ceil(out_n / BLOCK)).alias("outer"))
    group = ["band", "block", "outer"]
    # the same table stands on both sides: new column identities keep the two apart
    left = outside.join(sets.hint("merge"), "node")
    right = inside.join(sets.toDF("node", "set").hint("merge"), "node").toDF("node", "band", "component", "block", "outer", "set")
    links = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(_joining(percent), "a bigint, b bigint")
    return saved(links.distinct(), "minhash-links")


def class_links(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes that connect what near-duplicates connect."""
    keys = [F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)]
    bands = classes.select("node", "n_shingles", F.explode(F.array(*keys)).alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = saved(bands.join(shared.hint("merge"), "band"), "minhash-bands")
    fame = saved(met.groupBy("node").agg(F.sum("members").alias("fame")), "minhash-fame")
    buckets = saved(met.join(fame.hint("merge"), "node"), "minhash-buckets")
    sets = full_sets(classes.join(fame.select("node").hint("merge"), "node", "left_semi"), docs, width)
    hubs = buckets.groupBy("band").agg(F.max(F.struct("fame", (-F.col("node")).alias("low"), "n_shingles")).alias("hub"))
    near = (F.col("node") != -F.col("hub.low")) & (100 * F.least("n_shingles", "hub.n_shingles") >= percent * F.greatest("n_shingles", "hub.n_shingles"))
    pairs = buckets.join(hubs.hint("merge"), "band").where(near).select((-F.col("hub.low")).alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(pairs, sets, percent)
    more = linked_outside(buckets, components(links), sets, percent)
    out = saved(links.unionByName(more), "minhash-all")
    dropped(met, fame, buckets, sets, links, more)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    marked = saved(with_signatures(docs, width), "minhash-signatures")
    classes = classified(marked)
    edges = class_links(classes, docs, width, percent)
    reps = classes.select("words_key", "rep")
    further = saved(classes.where(F.col("node") >= EXTRA).where("node <> rep").select("node", F.col("rep").alias("id")), "minhash-further")
    if not further.isEmpty():
        for end in ("a", "b"):
            edges = edges.join(further.withColumnRenamed("node", end).hint("merge"), end, "left").withColumn(end, F.coalesce("id", end)).drop("id")
    # the texts of one id share its component
    good = marked.where("words_key is not null and doc_id is not null").select("doc_id", "words_key")
    several = good.groupBy("doc_id").agg(F.min(F.xxhash64("words_key")).alias("low"), F.max(F.xxhash64("words_key")).alias("high")).where("low <> high").select("doc_id")
    several = saved(several, "minhash-several")
    if not several.isEmpty():
        own = good.join(several.hint("merge"), "doc_id", "left_semi").distinct().join(reps.hint("merge"), "words_key")
        edges = edges.select("a", "b").unionByName(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges)
    named = reps.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("words_key", F.coalesce("component", "rep").alias("class_component"))
    out = marked.select("doc_id", "words_key", "n_shingles").join(named.hint("merge"), "words_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def words_keys(docs: DataFrame, text: str = "text", name: str = "words_key") -> DataFrame:
    """``docs`` with a digest of the word sequence of ``text``, null without words."""

    def compute(column):
        keys = []
        for t in column:  # the words of one text at a time
            words = (t.as_py() or "").encode("utf-8", "replace").translate(_LOWER).split()
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
        return [pa.array(keys, pa.binary())]

    return with_arrays(docs, text, [(name, "binary")], compute)


def duplicate_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, words_key) of the rows of ``docs`` (doc_id, text) that go when one text of each group of
    near-duplicates stays, under its smallest id; and of those that stay and stand there several times; written."""
    docs = docs.select("doc_id", "text")
    marked = saved(with_signatures(docs, width), "minhash-signatures")
    classes = classified(marked)
    labels = components(class_links(classes, docs, width, percent))
    stays = classes.join(labels.hint("merge"), "node", "left").select("words_key", "rep", "node", F.coalesce("component", "node").alias("lead"))
    if not classes.where("node <> rep").isEmpty():  # a further text of an id has a high number, but may lead by its id
        leads = stays.groupBy("lead").agg(F.min_by("node", F.struct("rep", "node")).alias("first"))
        stays = stays.join(leads.hint("merge"), "lead").select("words_key", "rep", "node", F.col("first").alias("lead"))
    stays = stays.withColumn("leads", F.col("node") == F.col("lead"))
    rows = marked.where("words_key is not null and doc_id is not null").select("doc_id", "words_key")
    gone = rows.join(stays.hint("merge"), "words_key").where(~F.col("leads") | (F.col("doc_id") != F.col("rep")))
    gone = saved(gone.select("doc_id", "words_key").distinct(), "minhash-gone")
    again = rows.groupBy("doc_id", "words_key").count().where("count > 1").drop("count")
    return gone, saved(again.join(gone.hint("merge"), ["doc_id", "words_key"], "left_anti"), "minhash-repeated")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
