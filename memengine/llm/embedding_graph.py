"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Vectors go to the shards of their ``overlap`` nearest centroids, which are fitted on a bounded sample; shards over
   ``SHARD_ROWS`` are split again in the same way by centroids of their own, level by level. The shard of the nearest
   centroids is a vector's home.
2. A task builds its shard's graph: each vector's nearest candidates, pruned so that no kept neighbour is much closer
   to a candidate than the vector itself (robust pruning), plus the reverse edges. A shard holds so few rows that its
   candidates come from a matrix product; the search below is what carries across shards.
3. The adjacency lists of all shards are united. A search task has a shard's vectors, those that its residents' edges
   of at most twice the range's angle lead to, and all their united lists. Every resident is a query once, at home: it descends greedily from
   the medoid, and from its own place, keeps the nearest of what it meets, and expands every node within the range.
4. What is in range is verified by cosine in double precision. A task returns counts of links and, for each node it has
   linked, one edge to the smallest node of its part of the component, so no set of pairs is ever written.
5. Recall is audited by brute force against all vectors on two bounded samples, one of all vectors and one of those
   with links. While the lower one is under ``WANTED_RECALL``, everything is done again with more overlap; one under
   ``LEAST_RECALL`` at the end fails. It comes with each row, null where the samples have no link to find.

Vectors of one direction (to 12 digits) are one node with a count.

A vector is written once, as it is given; shards and places hold numbers of nodes, and vectors are joined to them where
a task needs them. Of many nodes, shards are worked on in waves, so that what is shuffled at once is a part of all.

Defined results:
* null, zero, empty or non-finite vectors, and null components: linked with nothing, own component, kept;
* vectors of different lengths are never linked; a null id: linked with nothing, null component, kept;
* rows that repeat an id: each row is a vector and gets a row; the vectors of an id share its component;
* ties between neighbours go to the smaller id; an empty table gives no rows;
* columns besides id and vector are not looked at, so none can clash.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, numbered, saved, table
from .components import components

SAMPLE_PER_CENTROID = 8
MAX_CENTROIDS = 1024
SHARD_TARGET = 1000
SHARD_ROWS = 2000
FAN_OUT = 64
CHUNK_ROWS = 20_000
OVERLAPS = (2, 4, 8)
CANDIDATES = 48
DEGREE = 24
ALPHA = 1.2
BEAM = 8
AUDIT = 256
#: Nodes of which the shards make a wave; most waves.
WAVE_NODES = 250_000
MOST_WAVES = 8
WANTED_RECALL = 0.97
LEAST_RECALL = 0.9


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(vectors) -> np.ndarray:
    """Unit rows of vectors of one length that are kept as bytes: of doubles, or of floats and one byte more."""
    vectors = list(vectors)
    flat = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)
    x = np.ascontiguousarray(flat[:, :-1]).view(np.float32) if flat.shape[1] % 4 else flat.view(np.float64)
    return _unit(x.astype(np.float64))


def length(vector: bytes) -> int:
    return len(vector) // 4 if len(vector) % 4 else len(vector) // 8


def keyed_vectors(df: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """(vec_id, key, vec): a hash of the vector's direction, and the vector as bytes that ``matrix`` reads; both null
    where the vector can't be used."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            starts = column.offsets.to_numpy().astype(np.int64)
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(starts))
            kind, end = (np.float32, b"\0") if pa.types.is_float32(column.values.type) else (np.float64, b"")
            values = column.values.cast(pa.from_numpy_dtype(kind)).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            keys, vectors = np.full(len(sizes), None, object), np.full(len(sizes), None, object)
            for n in np.unique(sizes[sizes > 0]):
                at = np.nonzero(sizes == n)[0]
                x = values[starts[at][:, None] + np.arange(n)]
                good = np.isfinite(x).all(1)
                good[good] = (x[good] != 0).any(1)
                at, x = at[good], x[good]
                # + 0.0 makes minus zero plain zero
                keys[at] = [xxhash.xxh3_128_digest(r.tobytes()) for r in np.round(_unit(x.astype(np.float64)), 12) + 0.0]
                vectors[at] = [r.tobytes() + end for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "key", "vec"])

    return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vec)).mapInArrow(run, "vec_id bigint, key binary, vec binary")


def lloyd(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` unit centroids of unit vectors, by a few steps from a seeded draw."""
    c = x[np.random.default_rng(11).permutation(len(x))[:k]]
    for _ in range(5):
        total = np.zeros_like(c)
        np.add.at(total, np.argmax(x @ c.T, 1), x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def centroids(nodes: DataFrame, n: int, overlap: int) -> dict[int, np.ndarray]:
    """Unit centroids for each vector length, fitted on a sample of bounded size."""
    k_all = int(min(MAX_CENTROIDS, max(1, -(-n * overlap // SHARD_TARGET))))
    want = SAMPLE_PER_CENTROID * k_all
    share = min(1.0, 1.5 * want / max(1, n))
    rows = nodes.where(F.pmod(F.xxhash64("first_id", F.lit("centroids")), F.lit(1 << 30)) < int(share * (1 << 30))).select("first_id", "node", "vec").limit(2 * want + 64).toArrow()
    by_length: dict[int, list] = {}
    for _, _, u in sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True)):
        by_length.setdefault(length(u), []).append(u)
    return {n_: lloyd(matrix(us), max(1, min(len(us), round(k_all * len(us) / rows.num_rows)))) for n_, us in by_length.items()}


def nearest(x: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    """The ``overlap`` nearest centroids of each row, the nearest first."""
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]


SHARDS = "shard string, node int, own boolean"


def sharded(nodes: DataFrame, centers: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """``SHARDS``: each node once per shard it belongs to; ``own`` marks its home."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            lengths = np.array([length(u.as_buffer()) for u in vectors], np.int64)
            shard, pick, own = [], [], []
            for n in np.unique(lengths):
                at = np.nonzero(lengths == n)[0]
                if n in centers:
                    near = nearest(matrix(vectors.take(pa.array(at)).to_pylist()), centers[n], overlap)
                else:  # a length the sample doesn't have
                    near = np.zeros((len(at), 1), np.int64)
                shard += [f"{n}:{s}" for s in near.ravel()]
                pick.append(np.repeat(at, near.shape[1]))
                own.append(np.tile(np.arange(near.shape[1]) == 0, len(at)))
            take = pa.array(np.concatenate(pick) if pick else np.zeros(0, np.int64))
            columns = [pa.array(shard, pa.string()), batch.column(0).take(take), pa.array(np.concatenate(own) if own else np.zeros(0, bool))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "node", "own"])

    first = saved(nodes.select("node", "vec").mapInArrow(run, SHARDS), "graph-shards")
    return split_again(first, nodes, overlap)


def _parting(x: np.ndarray, k: int, overlap: int) -> np.ndarray:
    """At most ``k`` unit centroids of a sample, none of them among the nearest of most of it."""
    c = lloyd(x, k)
    while len(c) > overlap + 1:
        drawn = np.bincount(nearest(x, c, overlap).ravel(), minlength=len(c))
        if drawn.max() <= 0.7 * len(x):
            break
        c = np.delete(c, drawn.argmax(), 0)
    return c


def split_again(shards: DataFrame, nodes: DataFrame, overlap: int) -> DataFrame:
    """Splits shards over ``SHARD_ROWS`` by centroids of their own, until none is left that gets smaller by it."""
    lasting = max(SHARD_ROWS, 500 * overlap)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first_id", "node"])
        c = _parting(matrix(frame["vec"]), int(frame["k"].iloc[0]), overlap)
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "n": frame["n"].iloc[:1], "centers": [c.tolist()]})

    def deal(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("shard", "node", "own", "parent_n")})
        near = nearest(matrix(rows["vec"]), np.stack([np.asarray(r, float) for r in model["centers"].iloc[0]]), overlap)
        at = np.repeat(np.arange(len(rows)), near.shape[1])
        out = rows.iloc[at][["shard", "node", "own", "n"]].rename(columns={"n": "parent_n"})
        return out.assign(shard=[f"{s}/{i}" for s, i in zip(out["shard"], near.ravel(), strict=True)], own=out["own"].to_numpy() & np.tile(np.arange(near.shape[1]) == 0, len(rows)))

    done, now, level = None, shards.withColumn("parent_n", F.lit(None).cast("bigint")), 0
    while True:
        sizes = saved(now.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("parent_n").alias("parent_n")), "graph-sizes")
        big = sizes.where((F.col("n") > lasting) & (F.col("parent_n").isNull() | (F.col("n") < F.col("parent_n")))).select("shard", "n")
        if big.isEmpty():
            small = now.drop("parent_n")
            return small if done is None else done.unionByName(small)
        level += 1
        small = now.join(big.hint("merge"), "shard", "left_anti").drop("parent_n")
        done = small if done is None else done.unionByName(small)
        chunks = F.floor((F.col("n") - 1) / CHUNK_ROWS) + 1
        wanted = F.greatest(F.lit(overlap + 1), F.ceil(F.col("n") * overlap / SHARD_TARGET))
        rows = now.drop("parent_n").join(big.hint("merge"), "shard").withColumn("k", F.least(F.lit(FAN_OUT), wanted).cast("int"))
        rows = with_vectors(rows, nodes)
        share = F.least(F.lit(1.0), 3.0 * SAMPLE_PER_CENTROID * F.col("k") / F.col("n"))
        sample = rows.where(F.pmod(F.xxhash64("first_id", F.lit(level)), F.lit(1 << 30)) < share * (1 << 30))
        centers = sample.groupBy("shard").applyInPandas(fit, "shard string, n bigint, centers array<array<double>>")
        centers = saved(centers, "graph-centers").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
        rows = rows.drop("first_id").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), chunks))
        now = saved(rows.groupBy("shard", "chunk").cogroup(centers.groupBy("shard", "chunk")).applyInPandas(deal, f"{SHARDS}, parent_n bigint"), "graph-shards")


def with_vectors(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.hint("merge").join(nodes.select("node", "first_id", "vec").hint("merge"), "node")


def in_waves(shards: DataFrame, waves: int, work, label: str) -> DataFrame:
    """``work`` of the rows of all shards, written wave by wave: what is shuffled for one is gone before the next."""
    part = lambda i: shards.where(F.pmod(F.xxhash64("shard", F.lit("wave")), F.lit(waves)) == i)
    return functools.reduce(DataFrame.unionByName, [saved(work(part(i)), label) for i in range(waves)])


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of all edges of one shard's unit vectors, in order: robustly pruned candidates, and the reverse edges."""
    n = len(x)
    near = min(CANDIDATES, n - 1)
    if near < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, cols = [], []
    for s in range(0, n, 256):
        sims = x[s : s + 256] @ x.T
        here = np.arange(len(sims))
        sims[here, s + here] = -2
        top = np.sort(np.argpartition(-sims, near - 1, axis=1)[:, :near], 1)
        value = np.take_along_axis(sims, top, 1)
        by = np.argsort(-value, axis=1, kind="stable")
        top, value = np.take_along_axis(top, by, 1), np.take_along_axis(value, by, 1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * value))
        mine = x[top]
        between = ALPHA * np.sqrt(np.maximum(0, 2 - 2 * (mine @ mine.transpose(0, 2, 1))))
        alive, kept = np.ones(top.shape, bool), np.zeros(top.shape, bool)
        for r in range(near):
            kept[:, r] = alive[:, r] & (kept.sum(1) < DEGREE)
            alive[:, r + 1 :] &= ~kept[:, r, None] | (between[:, r, r + 1 :] > dist[:, r + 1 :])
        at, r = np.nonzero(kept)
        rows.append(s + at)
        cols.append(top[at, r])
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    both = np.unique(np.concatenate((rows * n + cols, cols * n + rows)))
    return both // n, both % n


def shard_graphs(shards: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """(node, near, close): each node's neighbours in each of its shards, and which of them lie within twice the angle
    of the range: no other edge can extend a link beyond a shard."""
    bridge = float(np.cos(min(np.pi, 2 * np.arccos(cosine))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # rows come in any order; sorted, a repeated task does the same
        frame = frame.sort_values(["first_id", "node"])
        ids, x = frame["node"].to_numpy(), matrix(frame["vec"])
        a, b = build_graph(x)
        parts = range(0, len(a), 1 << 15)
        sim = np.concatenate([np.einsum("nd,nd->n", x[a[k : k + (1 << 15)]], x[b[k : k + (1 << 15)]]) for k in parts] or [np.zeros(0)])
        split = lambda keep: np.split(ids[b[keep]], np.searchsorted(a[keep], np.arange(1, len(ids))))
        return pd.DataFrame({"node": ids, "near": split(slice(None)), "close": split(sim >= bridge - 1e-9)})

    return with_vectors(shards.select("shard", "node"), nodes).groupBy("shard").applyInPandas(run, "node int, near array<int>, close array<int>")


def reached(x: np.ndarray, queries: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, cosine: float):
    """For blocks of ``queries`` (numbers of rows of ``x``) which rows within the range a search meets. The neighbours
    of row i are ``ends[starts[i]:starts[i] + sizes[i]]``."""
    medoid = int(np.argmax(x @ x.mean(0)))
    beam = min(BEAM, len(x))
    for s in range(0, len(queries), 256):
        mine = queries[s : s + 256]
        here = np.arange(len(mine))
        sims = x[mine] @ x.T
        seen, expanded = np.zeros(sims.shape, bool), np.zeros(sims.shape, bool)
        seen[:, medoid] = True
        seen[here, mine] = True
        # greedy descent from the medoid, all queries in step
        at, walking = np.full(len(mine), medoid), np.ones(len(mine), bool)
        while walking.any():
            rows = here[walking]
            n = sizes[at[rows]]
            who, to = np.repeat(rows, n), ends[_runs(starts[at[rows]], n)]
            seen[who, to] = True
            expanded[rows, at[rows]] = True
            best = np.full(len(mine), -2.0)
            np.maximum.at(best, who, sims[who, to])
            better = walking & (best > sims[here, at])
            hit = better[who] & (sims[who, to] == best[who])
            at[who[hit]] = to[hit]
            walking = better
        # the nearest of what was met, and all in range, until all of them are expanded
        while True:
            met = np.where(seen, sims, -2.0)
            bar = np.minimum(np.partition(met, sims.shape[1] - beam, axis=1)[:, sims.shape[1] - beam], cosine)
            rows, cols = np.nonzero(seen & ~expanded & (met >= bar[:, None]))
            if not len(rows):
                break
            expanded[rows, cols] = True
            for k in range(0, len(rows), 1 << 15):
                r, c = rows[k : k + (1 << 15)], cols[k : k + (1 << 15)]
                seen[np.repeat(r, sizes[c]), ends[_runs(starts[c], sizes[c])]] = True
        seen &= sims >= cosine
        seen[here, mine] = False
        yield mine, seen


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, .. of every i, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def search(places: DataFrame, cosine: float) -> DataFrame:
    """(kind, x, y): the number of vectors linked to a node ('count', node, n), and edges between first ids that
    connect what is linked ('link')."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first_id", "node"])
        nodes, first, copies = (frame[c].to_numpy() for c in ("node", "first_id", "copies"))
        x, m = matrix(frame["vec"]), len(frame)
        flat = np.concatenate(frame["near"].to_list())
        owner = np.repeat(np.arange(m), [len(a) for a in frame["near"]])
        by = np.argsort(nodes)
        spot = np.minimum(np.searchsorted(nodes, flat, sorter=by), m - 1)
        there = nodes[by[spot]] == flat
        owner, to = owner[there], by[spot[there]]
        sizes = np.bincount(owner, minlength=m)
        blocks = list(reached(x, np.nonzero(frame["own"].to_numpy())[0], np.cumsum(sizes) - sizes, sizes, to, cosine))
        out = [pd.DataFrame({"kind": "count", "x": nodes[mine], "y": hit @ copies}) for mine, hit in blocks]
        # rows are in the order of first ids, so the least number of a component is its smallest first id
        label = np.arange(m)
        while True:
            before = label.copy()
            for mine, hit in blocks:
                low = np.minimum(label[mine], np.where(hit, label, m).min(1))
                label[mine] = low
                label = np.minimum(label, np.where(hit, low[:, None], m).min(0))
            label = label[label]
            if (label == before).all():
                break
        moved = np.nonzero(label != np.arange(m))[0]
        out.append(pd.DataFrame({"kind": "link", "x": first[moved], "y": first[label[moved]]}))
        return pd.concat(out)

    return places.groupBy("shard").applyInPandas(run, "kind string, x bigint, y bigint")


def link_counts(nodes: DataFrame, n: int, cosine: float, overlap: int) -> DataFrame:
    """What ``search`` finds over the united graph, written."""
    waves = min(MOST_WAVES, -(-n // WAVE_NODES)) or 1
    shards = sharded(nodes, centroids(nodes, n, overlap), overlap)
    lists = in_waves(shards, waves, lambda part: shard_graphs(part, nodes, cosine), "graph-lists")
    united = lists.groupBy("node").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close")])
    united = saved(united, "graph-united")
    dropped(lists)
    home = shards.where("own").select("shard", "node")
    beyond = home.join(united.select("node", "close").hint("merge"), "node").select("shard", F.explode("close").alias("node"), F.lit(False).alias("own"))
    places = saved(shards.select("shard", "node", "own").unionByName(beyond).groupBy("shard", "node").agg(F.max("own").alias("own")), "graph-places")
    full = lambda part: part.hint("merge").join(united.select("node", "near").hint("merge"), "node").join(nodes.select("node", "first_id", "copies", "vec").hint("merge"), "node")
    found = in_waves(places, waves, lambda part: search(full(part), cosine), "graph-found")
    dropped(shards, united, places)
    return found


def audited_recall(nodes: DataFrame, counts: DataFrame, cosine: float, queries: int = AUDIT) -> float | None:
    """The lower one of two recalls: of about ``queries`` of all nodes and of as many nodes with links."""
    found = [_recall(nodes, of, counts, cosine, queries) for of in (nodes, nodes.join(counts.where("n > 0").hint("merge"), "node", "left_semi"))]
    found = [f for f in found if f is not None]
    return min(found) if found else None


def _recall(nodes: DataFrame, of: DataFrame, counts: DataFrame, cosine: float, queries: int) -> float | None:
    """Share of the true links of ``queries`` nodes of ``of``, chosen by hash, that ``counts`` has; None if there are none."""
    rows = of.select("node", "first_id", "vec").orderBy(F.xxhash64("first_id", F.lit("audit")), "node").limit(queries).toArrow()
    ids, units = rows.column(0).to_numpy(), rows.column(2).to_pylist()
    if not len(ids):
        return None

    def run(batches):
        for batch in batches:
            other, mine, copies = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            total = np.zeros(len(ids), np.int64)
            for n in {len(u) for u in units}:
                q, at = np.array([i for i, u in enumerate(units) if len(u) == n]), np.array([i for i, u in enumerate(mine) if len(u) == n], np.int64)
                if len(at):
                    near = (matrix(units[i] for i in q) @ matrix(mine[i] for i in at).T >= cosine) & (ids[q][:, None] != other[at])
                    total[q] += near @ copies[at]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "true"])

    truth = nodes.select("node", "vec", "copies").mapInArrow(run, "node int, true bigint").groupBy("node").agg(F.sum("true").alias("true"))
    true, hit = truth.join(counts.hint("merge"), "node", "left").agg(F.sum("true"), F.sum("n")).first()
    return (hit or 0) / true if true else None


def embedding_links(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for every row."""
    vectors = keyed_vectors(df, vec_id, vec)
    rows = saved(vectors.select("vec_id", "key"), "graph-keys")
    good = rows.where("key is not null and vec_id is not null")
    classes = vectors.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("vec").alias("vec"))
    # numbers are given once, as the table is written
    nodes = numbered(classes, "node", "graph-nodes").withColumn("node", F.col("node").cast("int"))
    n = nodes.count()
    for overlap in OVERLAPS:
        found = link_counts(nodes, n, cosine, overlap)
        counts = found.where("kind = 'count'").select(F.col("x").cast("int").alias("node"), F.col("y").alias("n"))
        recall = audited_recall(nodes, counts, cosine)
        if recall is None or recall >= WANTED_RECALL:
            break
        if overlap != OVERLAPS[-1]:
            dropped(found)
    if recall is not None and recall < LEAST_RECALL:
        raise RuntimeError(f"audited recall is {recall:.4f}, less than {LEAST_RECALL}")
    edges = found.where("kind = 'link'").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # the vectors of one id share its component
    several = good.groupBy("vec_id").agg(F.min(F.xxhash64("key")).alias("low"), F.max(F.xxhash64("key")).alias("high")).where("low <> high").select("vec_id")
    several = saved(several, "graph-several")
    if not several.isEmpty():
        own = good.join(several.hint("merge"), "vec_id", "left_semi").select("vec_id", "key").distinct()
        own = own.join(nodes.select("key", "first_id").hint("merge"), "key")
        edges = edges.unionByName(own.select(F.col("vec_id").alias("a"), F.col("first_id").alias("b")))
    labels = components(edges).withColumnRenamed("node", "first_id")
    named = nodes.join(counts.hint("merge"), "node").join(labels.hint("merge"), "first_id", "left")
    named = saved(named.select("key", (F.col("copies") - 1 + F.col("n")).alias("n_links"), F.coalesce("component", "first_id").alias("component_id")), "graph-named")
    linked = good.select("vec_id", "key").join(named.hint("merge"), "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audit_recall", F.lit(recall).cast("double"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
