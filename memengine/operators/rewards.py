"""Scores of memories and question sets, and classes of failures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..functions.columns import answer_correctness, clamp, has_words, token_f1, tokens_reward
from ..sources.durable import durable

#: Weights of the components.
MEMORY_WEIGHTS = {"answer_utility": 0.25, "oracle_coverage": 0.20, "groundedness": 0.15, "non_redundancy": 0.15, "compression_balance": 0.10, "abstraction_quality": 0.10, "format_safety": 0.05}
QUESTION_WEIGHTS = {"oracle_validity": 0.35, "adversarial_success": 0.25, "coverage_gain": 0.15, "diagnostic_value": 0.15, "diversity": 0.10}
KEY = ["record_id", "question_id"]
#: Token sets of a record up to which they meet by signatures, and of a chunk of a larger record.
WHOLE_SETS, CHUNK_SETS = 2048, 8192


def question_answer_pairs(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """V1: every question; one without an answer counts as unanswered for lack of evidence."""
    none = F.array().cast("array<string>")
    out = questions.join(answers, KEY, "left")
    return out.withColumns(
        {
            "prediction": F.coalesce("prediction", F.lit("")),
            "answer_status": F.coalesce("answer_status", F.lit("insufficient_evidence")),
            "supporting_memory_ids": F.coalesce("supporting_memory_ids", none),
            "evidence_contents": F.coalesce("evidence_contents", none),
        }
    )


def citation_quality(pairs: DataFrame, memory: DataFrame) -> DataFrame:
    """V3: adds ``citation_quality``; legal citations are the memory's nodes and its summaries."""
    cited = pairs.select(*KEY, F.explode("supporting_memory_ids").alias("node_id")).where("node_id not like 'summary\\\\_%'")
    bad = cited.hint("merge").join(memory.select("record_id", "node_id").distinct().hint("merge"), ["record_id", "node_id"], "left_anti").select(*KEY).distinct().withColumn("invalid", F.lit(True))
    n_cited, n_evidence = F.size("supporting_memory_ids"), F.size("evidence_contents")
    ids = F.coalesce("evidence_ids", "supporting_memory_ids") if "evidence_ids" in pairs.columns else F.col("supporting_memory_ids")
    same = F.array_sort(F.array_distinct("supporting_memory_ids")) == F.array_sort(F.array_distinct(ids))
    score = (
        F.when(F.col("answer_status") != "answered", F.when((F.col("answer_status") == "insufficient_evidence") & (n_evidence == 0), 1.0).otherwise(0.5))
        .when(F.col("invalid"), 0.0)
        .when((n_cited > 0) & (n_evidence > 0), F.when(same, 1.0).otherwise(0.7))
        .when((n_cited == 0) & (n_evidence > 0), 0.5)
        .otherwise(0.8)
    )
    return pairs.hint("merge").join(bad.hint("merge"), KEY, "left").withColumn("citation_quality", score).drop("invalid")


def oracle_coverage(questions: DataFrame, nodes: DataFrame, memory: DataFrame, summaries: DataFrame) -> DataFrame:
    """V4: (record_id, question_id, oracle_coverage): per cited oracle node the best F1 with any memory text, averaged.

    F1 is above zero only where a token is shared, so texts meet on their tokens, not pairwise; zeros come back after.
    A citation list that is empty scores 1, one without a known node or without memory 0."""
    return _coverage(questions, durable(cited_nodes(questions, nodes)), memory, summaries)


def cited_nodes(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(record_id, question_id, node_id, node_type, text) of the oracle nodes that questions cite."""
    cited = questions.select(*KEY, F.explode("supporting_node_ids").alias("node_id"))
    known = nodes.select("record_id", "node_id", "node_type", F.coalesce("text", F.lit("")).alias("text"))
    return cited.hint("merge").join(known.hint("merge"), ["record_id", "node_id"])


def _coverage(questions: DataFrame, texts: DataFrame, memory: DataFrame, summaries: DataFrame) -> DataFrame:
    # Spark works a column out again for a condition on it, as it puts before an inner explode; hence the outer ones, and
    # blank texts found without their tokens
    oracle = texts.select("record_id", "node_id", "text").distinct().select("record_id", "node_id", tokens_reward("text").alias("a"))
    mem = memory.where("status = 'active'").select("record_id", F.col("content").alias("t"), F.col("node_id").alias("mid"))
    for c in [c for c in summaries.columns if c not in ("record_id", "sample_id", "build_step")]:
        mem = mem.unionByName(summaries.where(F.col(c) != "").select("record_id", F.col(c).alias("t"), F.lit(f"summary_{c}").alias("mid")))
    left = oracle.select("record_id", "node_id", F.size("a").alias("na"), F.explode_outer("a").alias("token")).where("token is not null")
    held = mem.select("record_id", "mid", tokens_reward("t").alias("b"))
    right = held.select("record_id", "mid", F.size("b").alias("nb"), F.explode_outer("b").alias("token")).where("token is not null")
    shared = left.hint("merge").join(right.hint("merge"), ["record_id", "token"]).groupBy("record_id", "node_id", "mid", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    p, r = F.col("c") / F.col("na"), F.col("c") / F.col("nb")
    best = shared.groupBy("record_id", "node_id").agg(F.max(2 * p * r / (p + r)).alias("best"))
    # two empty texts agree fully, as the score of two empty token sets is 1
    blank = mem.where(~has_words("t")).select("record_id").distinct().withColumn("blank", F.lit(1.0))
    some = mem.select("record_id").distinct().withColumn("some", F.lit(True))
    per = texts.select(*KEY, "node_id", (~has_words("text")).alias("empty")).hint("merge").join(best.hint("merge"), ["record_id", "node_id"], "left").hint("merge").join(blank.hint("merge"), "record_id", "left")
    score = F.coalesce("best", F.when(F.col("empty"), F.col("blank")), F.lit(0.0))
    mean = per.groupBy(*KEY).agg(F.avg(score).alias("m"))
    out = questions.select(*KEY, F.size("supporting_node_ids").alias("n")).hint("merge").join(mean.hint("merge"), KEY, "left").hint("merge").join(some.hint("merge"), "record_id", "left")
    return out.select(*KEY, F.when(F.col("n") <= 0, 1.0).when(F.col("some").isNull(), 0.0).otherwise(F.coalesce("m", F.lit(0.0))).alias("oracle_coverage"))


def classify_failures(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``failure_types`` in rule order."""
    return _classified(items, cited_nodes(items, nodes))


def _classified(items: DataFrame, cited: DataFrame) -> DataFrame:
    abstract = cited.where("node_type in ('abstract_memory', 'topic')").select(*KEY).distinct().withColumn("abstract", F.lit(True))
    c, o = F.col("correctness"), F.col("oracle_coverage")
    low = (c < 0.5) & (o < 0.5)
    rules = [
        (F.col("answer_status") == "insufficient_evidence", "answerer_insufficient_evidence"),
        (low & F.col("abstract").isNotNull(), "missing_abstraction"),
        (low & F.col("abstract").isNull(), "missing_fact"),
        ((c < 0.5) & (o >= 0.7), "wrong_fact"),
        ((F.size(F.array_distinct("supporting_session_ids")) > 1) & (c < 0.7), "missing_multi_session_link"),
        ((F.col("question_type") == "temporal") & (c < 0.7), "temporal_error"),
        ((F.col("question_type") == "contradiction_update") & (c < 0.7), "contradiction_update_error"),
        ((F.col("evidence_support") < 0.3) & (c >= 0.7), "unsupported_answer"),
    ]
    return items.hint("merge").join(abstract.hint("merge"), KEY, "left").withColumn("failure_types", F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in rules]))).drop("abstract")


def question_items(questions: DataFrame, answers: DataFrame, nodes: DataFrame, memory: DataFrame, summaries: DataFrame) -> DataFrame:
    """One scored row per question."""
    pairs = citation_quality(question_answer_pairs(questions, answers), memory)
    support = F.when((F.coalesce("answer", F.lit("")) == "") | (F.size("evidence_contents") == 0), 0.0).otherwise(token_f1(F.array_join("evidence_contents", " "), "answer"))
    rows = pairs.withColumn("correctness", answer_correctness("prediction", "answer")).withColumn("evidence_support", support)
    cited = durable(cited_nodes(questions, nodes))
    rows = rows.hint("merge").join(_coverage(questions, cited, memory, summaries).hint("merge"), KEY)
    return _classified(rows, cited)


def part_signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """(sig, record_id, set_id, copies, size) of token sets (record_id, set_id, copies, tokens), such that two different
    sets of a record with a Jaccard similarity at the threshold or above have a ``sig`` in common.

    Such sets differ by d = (1 - t) / (1 + t) * (|a| + |b|) tokens at most. Tokens are dealt into d + 1 parts or more by
    their hash, so a part at least holds the same tokens of both; its tokens' hashes, summed up, are its signature. Sets
    meet in groups of sizes: a size class is wider than the threshold lets sizes differ, and a set joins its own class
    and the next. Empty parts count only for a set that has so many that all equal parts may be empty ones."""
    base = 1.003 / threshold

    def run(batches):
        for batch in batches:
            out = {"at": [], "sig": []}
            for i, (h, record) in enumerate(zip(batch["h"], batch["record"])):
                h = np.asarray(h, dtype=np.int64).view(np.uint64)
                own = int(np.floor(np.log(len(h)) / np.log(base)))
                for g in (own, own + 1):
                    d = int((1 - threshold) / (1 + threshold) * 2 * np.ceil(base ** (g + 1) + 1e-9) + 1e-9)
                    if d == 0:
                        continue
                    parts = d + 2 + -(-d // 20)
                    at = (h % np.uint64(parts)).astype(np.int64)
                    total = np.zeros(parts, dtype=np.uint64)
                    np.add.at(total, at, h)
                    full = np.bincount(at, minlength=parts) > 0
                    used = np.flatnonzero(full) if (~full).sum() < parts - d else np.arange(parts)
                    key = (total[used] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + used.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(g) * np.uint64(0x165667B19E3779F9) + np.asarray([record], dtype=np.int64).view(np.uint64)
                    out["sig"].append(key.view(np.int64))
                    out["at"].append(np.full(len(used), i))
            if out["at"]:
                rows = batch.iloc[np.concatenate(out["at"])][["record_id", "set_id", "copies", "size"]]
                yield rows.assign(sig=np.concatenate(out["sig"]))

    keyed = sets.select("record_id", "set_id", "copies", F.size("tokens").alias("size"), F.xxhash64("record_id").alias("record"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    kinds = sets.select("record_id", "set_id", "copies").schema
    schema = StructType([*[StructField(f.name, f.dataType) for f in kinds], StructField("size", IntegerType()), StructField("sig", LongType())])
    return keyed.mapInPandas(run, schema)


def parity_sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """(record_id, set_id, copies, size, g, bits) of token sets that have a token. Each token falls on a bit; a bit tells
    whether an odd number did, so two sketches differ in no more bits than their sets differ in tokens. ``g`` is the size
    class, as of ``part_signatures``; a class has about as many bits as its largest set has tokens, a power of two."""
    base = 1.003 / threshold

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                h = part.column("h")
                size = np.diff(h.offsets.to_numpy()).astype(np.int64)
                g = np.floor(np.log(size) / np.log(base)).astype(np.int64)
                width = np.left_shift(1, np.maximum(7, np.ceil(np.log2(base ** (g + 1.0)))).astype(np.int64))
                first = np.cumsum(width) - width
                owner = np.repeat(np.arange(len(size)), size)
                at = h.flatten().to_numpy() & (width[owner] - 1)
                odd = (np.bincount(first[owner] + at, minlength=int(width.sum())) & 1).astype(np.uint8)
                ends = np.concatenate(([0], np.cumsum(width // 8))).astype(np.int32)
                bits = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.packbits(odd))])
                own = [part.column(c) for c in ("record_id", "set_id", "copies")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(g), bits], names=["record_id", "set_id", "copies", "size", "g", "bits"])

    keyed = sets.select("record_id", "set_id", "copies", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    schema = StructType([*keyed.drop("h").schema.fields, *[StructField(c, LongType()) for c in ("size", "g")], StructField("bits", BinaryType())])
    return keyed.mapInArrow(run, schema)


def _side(table: pa.Table, side: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of one side of a block by size, their sizes, and their sketches as words."""
    table = table.filter(pc.equal(table.column("side"), side)).sort_by([("size", "ascending"), ("set_id", "ascending")]).combine_chunks()
    return table, table.column("size").to_numpy(), np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(table.num_rows, -1)


def _alike(x: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_size: np.ndarray, threshold: float, own: bool):
    """(i, js): the rows of ``y`` that row i of ``x`` can reach the threshold with, by sizes and sketches; of one block
    with itself (``own``) those after i. Rows are in the order of sizes."""
    words = min(x.shape[1], y.shape[1])
    # halves of a sketch laid over each other are the sketch of half its width
    x, y = (np.bitwise_xor.reduce(z.reshape(len(z), -1, words), axis=1) for z in (x, y))
    y, count, apart = np.ascontiguousarray(y.T), np.uint16 if words < 1000 else np.uint32, (1 - threshold) / (1 + threshold)
    step = max(1, (1 << 17) // max(1, y.shape[1]))
    for s in range(0, len(x), step):
        mine, size = x[s : s + step], x_size[s : s + step]
        lo, hi = np.searchsorted(y_size, threshold * size[0] - 1e-9), np.searchsorted(y_size, (size[-1] + 1e-9) / threshold, side="right")
        lo = max(lo, s + 1) if own else lo
        if hi <= lo:
            continue
        off = np.zeros((len(mine), hi - lo), count)
        for w in range(words):
            off += np.bitwise_count(mine[:, w, None] ^ y[w, lo:hi])
        r, c = np.nonzero(off <= int(apart * (size[-1] + y_size[hi - 1]) + 1e-9))
        a, b, j = size[r], y_size[lo + c], lo + c
        good = (off[r, c] <= apart * (a + b) + 1e-9) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
        good &= (j > s + r) if own else True
        r, j = r[good], j[good]
        for i, js in zip(np.unique(r), np.split(j, np.flatnonzero(np.diff(r)) + 1)):
            yield s + i, js


BLOCK = ["record_id", "ga", "ca", "gb", "cb"]


def _sides(key, table: pa.Table) -> tuple[tuple, tuple, bool]:
    own = key[1] == key[3] and key[2] == key[4]
    left = _side(table, 0)
    return left, left if own else _side(table, 1), own


def sketch_blocks(sketches: DataFrame) -> DataFrame:
    """``BLOCK``, side and the columns of ``sketches``: sets of a size class are dealt into chunks by hash, and every two
    chunks that may hold sets of fitting sizes are a block, of at most about twice ``CHUNK_SETS`` sets."""
    by = Window.partitionBy("record_id").orderBy("g")
    sizes = sketches.groupBy("record_id", "g").agg(F.ceil(F.count(F.lit(1)) / CHUNK_SETS).alias("k"))
    beside = lambda f, at: F.when(f("g").over(by) == F.col("g") + at, f("k").over(by)).otherwise(0)
    sizes = sizes.select("record_id", "g", "k", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    # a row a record and size class, of records of over WHOLE_SETS sets only
    dealt = sketches.join(F.broadcast(durable(sizes, clean=True)), ["record_id", "g"]).withColumn("c", F.pmod(F.xxhash64("set_id"), F.col("k")))
    block = lambda ga, ca, gb, cb, side: F.struct(ga.alias("ga"), ca.alias("ca"), gb.alias("gb"), cb.alias("cb"), side.cast("int").alias("side"))
    of = lambda k, f: F.when(F.col(k) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(k) - 1), f)).otherwise(F.array())
    g, c = F.col("g"), F.col("c")
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: block(g, F.least(c, i), g, F.greatest(c, i), c > i))
    below, above = of("below", lambda i: block(g - 1, i, g, c, F.lit(1))), of("above", lambda i: block(g, c, g + 1, i, F.lit(0)))
    return dealt.select("record_id", F.explode(F.concat(own, below, above)).alias("at"), "set_id", "copies", "size", "bits").select("record_id", "at.*", "set_id", "copies", "size", "bits")


def near_in_blocks(full: DataFrame, threshold: float) -> DataFrame:
    """(record_id, near): pairs of nodes in different sets at the threshold or above, of records of any size.

    Sketches meet in blocks, where what sizes and sketches can't rule out is found. The sets concerned come to their
    blocks a second time, with their tokens, and are compared in full. No set of pairs is written or shuffled, and a
    task holds one block. The comparisons of sketches are as many as pairs of fitting sizes, some nanoseconds each."""
    blocks = sketch_blocks(durable(parity_sketches(full, threshold), clean=True))

    def concerned(key, table):
        (left, a, x), (right, b, y), own = _sides([k.as_py() for k in key], table)
        hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for i, js in _alike(x, a, y, b, threshold, own):
            hit_a[i] = hit_b[js] = True
        parts = [left.filter(hit_a | hit_b)] if own else [left.filter(hit_a), right.filter(hit_b)]
        return pa.concat_tables(parts).select(names)

    def count(key, table):
        (left, a, x), (right, b, y), own = _sides([k.as_py() for k in key], table)
        tokens = pa.chunked_array([*left.column("tokens").chunks, *([] if own else right.column("tokens").chunks)]).combine_chunks()
        codes = tokens.flatten().dictionary_encode().indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(np.concatenate((a, b)) if not own else a)))
        starts = ends[:-1] if own else ends[len(a) : -1]
        ca, cb, mark, near = left.column("copies").to_numpy(), right.column("copies").to_numpy(), np.zeros(int(codes.max(initial=0)) + 1, np.int32), 0
        for i, js in _alike(x, a, y, b, threshold, own):
            mine, n = codes[ends[i] : ends[i + 1]], b[js]
            first = np.cumsum(n) - n
            mark[mine] = 1
            both = np.add.reduceat(mark[codes[np.arange(n.sum()) + np.repeat(starts[js] - first, n)]], first)
            mark[mine] = 0
            near += int(ca[i]) * int(cb[js][both / (a[i] + n - both) >= threshold].sum())
        return pa.table({"record_id": pa.array([key[0].as_py()], left.schema.field("record_id").type), "near": pa.array([near], pa.int64())})

    names = blocks.columns
    found = durable(blocks.groupBy(*BLOCK).applyInArrow(concerned, blocks.schema), clean=True)
    told = found.hint("merge").join(full.select("set_id", "tokens").hint("merge"), "set_id")
    return told.groupBy(*BLOCK).applyInArrow(count, StructType([blocks.schema["record_id"], StructField("near", LongType())]))


def near_by_signatures(full: DataFrame, threshold: float) -> DataFrame:
    """(record_id, ca, cb): as ``near_in_blocks``, a row per pair of sets, for records of few sets: they meet where a part
    of their tokens is the same (``part_signatures``), some five tokens at a time, and are compared in full."""
    signed = durable(part_signatures(full, threshold), clean=True)
    of = lambda x: signed.select("sig", "record_id", F.col("set_id").alias(x), F.col("copies").alias(f"c{x}"), F.col("size").alias(f"s{x}"))
    fits = (F.col("a") < F.col("b")) & (F.least("sa", "sb") >= threshold * F.greatest("sa", "sb") - 1e-9)
    meet = durable(of("a").hint("merge").join(of("b").hint("merge"), ["sig", "record_id"]).where(fits).select("record_id", "a", "b", "ca", "cb").distinct(), clean=True)
    ta, tb = full.select("record_id", F.col("set_id").alias("a"), F.col("tokens").alias("ta")), full.select("record_id", F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return meet.hint("merge").join(ta.hint("merge"), ["record_id", "a"]).hint("merge").join(tb.hint("merge"), ["record_id", "b"]).where(both / (F.size("ta") + F.size("tb") - both) >= threshold).select("record_id", "ca", "cb")


def non_redundancy(memory: DataFrame, threshold: float = 0.85) -> DataFrame:
    """V7: per record, 1 minus the share of pairs of active nodes with token Jaccard at the threshold or above.

    Equal token sets are counted by group size. Different sets of a record of few sets meet by signatures, where sets
    that meet by chance are few as well; those of larger records meet in blocks."""
    active = memory.where("status = 'active'").select("record_id", F.array_sort(tokens_reward("content")).alias("tokens"))
    # numbers are given once, as the table is written
    sets = durable(active.groupBy("record_id", "tokens").agg(F.count(F.lit(1)).alias("copies")).withColumn("set_id", F.monotonically_increasing_id()), clean=True)
    totals = sets.groupBy("record_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * (F.col("copies") - 1) / 2).alias("same"))
    full = sets.where((F.size("tokens") > 0) & F.col("record_id").isNotNull())
    # a row for WHOLE_SETS sets at most
    large = durable(full.groupBy("record_id").count().where(F.col("count") > WHOLE_SETS).select("record_id"), clean=True)
    if large.isEmpty():
        near = near_by_signatures(full, threshold).select("record_id", (F.col("ca") * F.col("cb")).alias("near"))
    else:
        near = near_by_signatures(full.join(F.broadcast(large), "record_id", "left_anti"), threshold).select("record_id", (F.col("ca") * F.col("cb")).alias("near"))
        near = near.unionByName(near_in_blocks(full.join(F.broadcast(large), "record_id", "left_semi"), threshold))
    near = near.groupBy("record_id").agg(F.sum("near").alias("near"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    out = totals.hint("merge").join(near.hint("merge"), "record_id", "left")
    return out.select("record_id", F.when(F.col("n") < 2, 1.0).otherwise(1 - (F.col("same") + F.coalesce("near", F.lit(0))) / pairs).alias("non_redundancy"))


def memory_parts(memory: DataFrame, summaries: DataFrame) -> DataFrame:
    """What ``components`` needs to know of the memory of a record."""
    sourced = (F.size("source_session_ids") > 0) | (F.size("source_turn_ids") > 0) | (F.size("source_event_ids") > 0)
    active = memory.where("status = 'active'")
    abstract = F.col("node_type").isin("abstract", "abstract_memory", "summary")
    per = active.groupBy("record_id").agg(
        F.avg(F.when(F.col("node_type") != "summary", F.when(sourced, 0.7).otherwise(0.3))).alias("groundedness"),
        F.count_if(abstract).alias("n_abstract"),
        F.count_if(abstract & sourced).alias("n_sourced"),
        F.count_if(F.col("node_type") == "fact").alias("n_fact"),
    )
    said = summaries.select("record_id", F.greatest(*[F.length(c) for c in summaries.columns if c not in ("record_id", "sample_id", "build_step")]).alias("said"))
    return per.hint("merge").join(non_redundancy(memory).hint("merge"), "record_id", "left").hint("merge").join(said.hint("merge"), "record_id", "full")


def memory_components(items: DataFrame, memory: DataFrame, summaries: DataFrame, records: DataFrame, unsafe: DataFrame | None = None) -> DataFrame:
    """The seven component scores per record of ``records``; ``unsafe`` lists records with validation issues."""
    return components(items, memory_parts(memory, summaries), records, unsafe)


def components(items: DataFrame, parts: DataFrame, records: DataFrame, unsafe: DataFrame | None = None) -> DataFrame:
    """``memory_components`` from ``memory_parts``, which several records may share."""
    answered = F.when(F.col("answer_status") == "answered", 1.0).otherwise(0.0)
    utility = 0.55 * F.col("correctness") + 0.25 * F.col("evidence_support") + 0.10 * F.col("citation_quality") + 0.10 * answered
    asked = items.groupBy("record_id").agg(F.avg(utility).alias("answer_utility"), F.avg("oracle_coverage").alias("oracle_coverage"))
    rows = records.join(asked, "record_id", "left").join(parts.hint("merge"), "record_id", "left")
    if unsafe is not None:
        rows = rows.join(unsafe.select("record_id").distinct().withColumn("unsafe", F.lit(True)), "record_id", "left")
    else:
        rows = rows.withColumn("unsafe", F.lit(None).cast("boolean"))
    rows = rows.withColumns(
        {
            "answer_utility": F.coalesce("answer_utility", F.lit(0.0)),
            "oracle_coverage": F.coalesce("oracle_coverage", F.lit(0.0)),
            "groundedness": F.coalesce("groundedness", F.lit(1.0)),
            "non_redundancy": F.coalesce("non_redundancy", F.lit(1.0)),
        }
    )
    lost = 1 - F.col("non_redundancy")
    balance = F.when(F.col("oracle_coverage") < 0.45, 0.2).when(lost > 0.35, 0.4).otherwise(clamp(0.5 + F.col("oracle_coverage") - 0.5 * lost))
    n = F.coalesce("n_abstract", F.lit(0))
    quality = 0.40 * F.when(n > 0, 0.8).otherwise(0.5) + 0.30 * F.when((F.coalesce("said", F.lit(0)) > 0) & (F.coalesce("n_fact", F.lit(0)) > 0), 0.8).otherwise(0.6) + 0.30 * F.when(n > 0, F.col("n_sourced") / n).otherwise(0.5)
    return rows.select(
        "record_id", "answer_utility", "oracle_coverage", "groundedness", "non_redundancy", balance.alias("compression_balance"), quality.alias("abstraction_quality"), F.when(F.col("unsafe"), 0.0).otherwise(1.0).alias("format_safety")
    )


def memory_rewards(components: DataFrame) -> DataFrame:
    """The total, and failures of the memory as a whole."""
    total = sum((F.col(c) * w for c, w in MEMORY_WEIGHTS.items()), F.lit(0.0))
    rules = [
        (F.col("non_redundancy") < 0.65, "redundancy_noise"),
        ((F.col("compression_balance") <= 0.25) & (F.col("oracle_coverage") < 0.45), "over_compression"),
        (F.col("abstraction_quality") < 0.5, "wrong_abstraction"),
        (F.col("format_safety") < 1.0, "format_safety_error"),
    ]
    return components.withColumn("total_reward", clamp(total)).withColumn("global_failures", F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in rules])))


def component_rows(components: DataFrame) -> DataFrame:
    """Long form (record_id, name, score, weight, weighted_score)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("score"), F.lit(w).alias("weight")) for c, w in MEMORY_WEIGHTS.items()]))
    return components.select("record_id", each.alias("c")).select("record_id", "c.*", (F.col("c.score") * F.col("c.weight")).alias("weighted_score"))


def question_rewards(questions: DataFrame, verdicts: DataFrame, items: DataFrame, nodes: DataFrame) -> DataFrame:
    """The question set of a record. Diversity is clamped to 1."""
    rows = questions.select(*KEY, "question_type", "supporting_node_ids", "supporting_session_ids").join(verdicts.select(*KEY, "verdict"), KEY, "left").join(items.select(*KEY, "correctness"), KEY, "left")
    ok = F.coalesce(F.col("verdict") == "accept", F.lit(False))
    per = rows.groupBy("record_id").agg(
        F.avg(ok.cast("double")).alias("oracle_validity"),
        F.coalesce(F.avg(F.when(ok, 1 - F.coalesce("correctness", F.lit(0.0)))), F.lit(0.0)).alias("adversarial_success"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(ok, F.col("supporting_node_ids")))))).alias("covered"),
        F.countDistinct("question_type").alias("types"),
        F.size(F.array_distinct(F.flatten(F.collect_list("supporting_session_ids")))).alias("sessions"),
    )
    counts = nodes.groupBy("record_id").agg(F.count(F.lit(1)).alias("nodes"))
    out = per.join(counts, "record_id", "left")
    out = out.select(
        "record_id",
        "oracle_validity",
        "adversarial_success",
        F.coalesce(F.col("covered") / F.col("nodes"), F.lit(0.0)).alias("coverage_gain"),
        F.lit(0.5).alias("diagnostic_value"),
        clamp((F.col("types") / 5.0 + F.least(F.col("sessions") / 3.0, F.lit(1.0))) / 2.0).alias("diversity"),
    )
    return out.withColumn("total_reward", clamp(sum((F.col(c) * w for c, w in QUESTION_WEIGHTS.items()), F.lit(0.0))))


def round_summary(rewards: DataFrame, status: str = "status") -> DataFrame:
    """Means over ok records (a null reward adds nothing) and counts by status, in one pass."""
    ok = F.col(status) == "ok"
    n = F.count_if(ok)
    return rewards.agg(
        F.count(F.lit(1)).alias("records"),
        n.alias("ok"),
        F.count_if(F.col(status) == "skipped").alias("skipped"),
        F.count_if(F.col(status) == "failed").alias("failed"),
        F.when(n > 0, F.coalesce(F.sum(F.when(ok, F.col("memory_reward"))), F.lit(0.0)) / n).alias("memory_reward_mean"),
        F.when(n > 0, F.coalesce(F.sum(F.when(ok, F.col("question_reward"))), F.lit(0.0)) / n).alias("question_reward_mean"),
    )
