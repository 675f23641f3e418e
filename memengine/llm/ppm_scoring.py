"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes. A byte is predicted by the longest context that has
been seen; where that context lacks it, the escape probability of method C is paid and the next shorter context is
asked, without the symbols that the longer one would have predicted (symbol exclusion), down to equal shares of the
bytes never seen. A text is read as its lower-cased words joined by one space and one end mark, so its code length is
that of its token sequence. ``pretrained`` scores come from the counts of training rows alone.

Counting: every block's distinct (ORDER+1)-byte strings go, with their training counts, to the part that the hash of
the last ``HEAD`` context bytes names. A part so has all contexts of ``HEAD`` bytes or more whole, and the counts
under shorter ones, whose number the alphabet bounds, come as one table. It sums the counts, works out each
string's log probability and returns those to the blocks. All training rows count, and nothing is pruned. Rows are
one per block and part where both meet, so never more than the blocks have distinct strings. Word counts for the base
score come back to the texts by an exchange on word hashes, per block of texts.

Defined results:
* null or empty text, or only white space: the end mark alone; rows without an id train and are scored like others;
* no training rows: N and V are 0, every byte has the share 1/256;
* texts are read whole; repeated rows count each and are scored each; an empty table gives no rows;
* columns besides id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, released, saved, table

ORDER = 6
HEAD = 3
PART_BYTES = 8 << 20
BLOCK_BYTES = 3 << 20
BLOCK_ROWS = 2048
END = b"\n"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def canonical(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").translate(_LOWER).split()) + END


def word_hash(word: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(word), "big", signed=True)


def strings(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order+1)-byte string that ends at each byte of each text (end marks stand before its start), as integers
    with the predicted byte lowest; and how many each text has."""
    pad = END * order
    flat = pad + pad.join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    # eight bytes from each place on, the first one highest; those behind the string are shifted out
    key = np.ndarray((len(flat) - order,), ">u8", flat + bytes(8), 0, (1,)).astype(np.uint64)
    key = (key >> np.uint64(8 * (7 - order))).view(np.int64)
    stop = np.cumsum(sizes + order)  # after each text follow the marks of the next
    keep = np.ones(len(key), bool)
    for k in range(order):
        at = stop - order + k
        keep[at[at < len(key)]] = False
    return key[keep], sizes


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.r_[starts, len(keys)])


class Lookup:
    """Where distinct keys stand in their array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._spot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[todo[free]]  # of several that want one slot the last gets it
            won = self.slots[at] == keys[todo]
            self.place[at[won]] = todo[won]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        at = self._spot(keys)
        out = self.place[at]
        open_ = np.nonzero(self.slots[at] != keys)[0]
        at = at[open_]
        out[open_] = -1
        more = self.slots[at] >= 0
        open_, at = open_[more], at[more]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.slots[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.place[at[hit]]
            more = ~hit & (there >= 0)
            open_, at = open_[more], at[more]
        return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of canonical texts in the order of their first place, the number of each word of
    the texts (-1 for the empty word of an empty text), and where each text's words begin and end."""
    lists = pc.split_pattern(pa.array([t[:-1] for t in texts], pa.binary()).cast(pa.string()), " ")
    coded = lists.values.dictionary_encode()
    words, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if b"" in words:
        none = words.index(b"")
        words.pop(none)
        codes = np.where(codes == none, -1, codes - (codes > none))
    return np.array(list(map(word_hash, words)), np.int64), codes, lists.offsets.to_numpy().astype(np.int64)


def words_in_parts(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of word hashes by part and hash, and where each part starts and ends in it."""
    part = ((hashes.view(np.uint64) >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((hashes, part))
    return by, np.searchsorted(part[by], np.arange(parts + 1))


def blocks(docs: DataFrame, train) -> DataFrame:
    """Neighbouring rows of ``docs`` (doc_id, text) as one row per block: ids, sizes of the canonical texts, the texts
    compressed, and whether each trains."""

    def run(batches):
        from pyspark import TaskContext

        first, serial = TaskContext.get().partitionId() << 32, 0
        rows, size = [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + serial], pa.int64()),
                    pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                    pa.array([[len(r[1]) for r in rows]], pa.list_(pa.int32())),
                    pa.array([pa.compress(b"".join(r[1] for r in rows), codec="zstd", asbytes=True)], pa.binary()),
                    pa.array([[r[2] for r in rows]], pa.list_(pa.bool_())),
                ],
                names=["block", "ids", "sizes", "data", "trains"],
            )

        for batch in batches:
            for i, t, trains in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                t = canonical(t)
                rows.append((i, t, trains))
                size += len(t)
                if size >= BLOCK_BYTES or len(rows) >= BLOCK_ROWS:
                    yield block()
                    rows, size, serial = [], 0, serial + 1
        if rows:
            yield block()

    schema = "block bigint, ids array<bigint>, sizes array<int>, data binary, trains array<boolean>"
    return docs.select("doc_id", "text", train.alias("trains")).mapInArrow(run, schema)


def texts_in(sizes: list[int], data: bytes) -> list[bytes]:
    """The texts of a block."""
    ends = np.cumsum([0, *sizes]).tolist()
    whole = pa.decompress(data, ends[-1], codec="zstd", asbytes=True)
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def string_counts(parts: DataFrame, order: int) -> DataFrame:
    """(key, n) of the training texts of all blocks."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            return summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        def out(keys, n):
            for s in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + (1 << 17)]), pa.array(n[s : s + (1 << 17)])], names=["key", "n"])

        for batch in batches:
            for sizes, data, trains in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = texts_in(sizes, data)
                mine = [t for t, yes in zip(texts, trains, strict=True) if yes]
                if not mine:
                    continue
                held.append(distinct(strings(mine, order)[0]))
                if sum(len(k) for k, _ in held) > 1 << 21:
                    keys, n = merged()
                    held = [(keys, n)]
                    if len(keys) > 1 << 20:
                        yield from out(keys, n)
                        held = []
        if held:
            yield from out(*merged())

    return parts.select("sizes", "data", "trains").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (keys[1:] < keys[:-1]).any():
        by = np.argsort(keys)
        keys, n = keys[by], n[by]
    starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    return keys[starts], np.add.reduceat(n, starts)


def packed(x: np.ndarray) -> bytes:
    """The bytes of ``x`` by their places, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.decompress(data, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def short_floats(x: np.ndarray) -> np.ndarray:
    """The upper three bytes of ``x`` as float32, rounded: a relative error of 2**-17 at most."""
    return (x.astype(np.float32).view(np.uint32) + np.uint32(128)) >> np.uint32(8)


def in_parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted ``keys`` by part and key, and where each part starts and ends in it."""
    head = ((keys >> 8) & ((1 << (8 * HEAD)) - 1)).astype(np.uint64)
    part = (((head + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts
    by = np.argsort(part, kind="stable")
    return by, np.searchsorted(part[by], np.arange(parts + 1))


def dealt(blocks_: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, block, size, keys, n): each block's distinct strings by part, with their training counts; from ``parts``
    on its distinct words in the same way."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, sizes, data, trains = (batch.column(c)[k].as_py() for c in range(4))
                texts = texts_in(sizes, data)
                groups = [[t for t, yes in zip(texts, trains, strict=True) if bool(yes) == kind] for kind in (True, False)]
                (seen, count), (others, _) = (distinct(strings(g, order)[0]) if g else (np.zeros(0, np.int64),) * 2 for g in groups)
                keys, n = summed(np.concatenate((seen, others)), np.concatenate((count, np.zeros(len(others), np.int64))))
                by, cuts = in_parts(keys, parts)
                rows = [(p, keys[by[i:j]], n[by[i:j]]) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                hashes, codes, ends = words_of(texts)
                taught = np.repeat([bool(t) for t in trains], np.diff(ends)) & (codes >= 0)
                n = np.bincount(codes[taught], minlength=len(hashes))
                by, cuts = words_in_parts(hashes, parts)
                rows += [(parts + p, hashes[by[i:j]], n[by[i:j]]) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array([len(r[1]) for r in rows], pa.int64()),
                        pa.array([packed(np.diff(r[1], prepend=0)) for r in rows], pa.binary()),
                        pa.array([packed(r[2]) for r in rows], pa.binary()),
                    ],
                    names=["part", "block", "size", "keys", "n"],
                )

    return blocks_.select("block", "sizes", "data", "trains").mapInArrow(run, "part int, block bigint, size bigint, keys binary, n binary")


def short_counts(blocks_: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The training counts of all HEAD-byte strings; the alphabet bounds their number, not the corpus."""
    t = string_counts(blocks_, HEAD - 1).toArrow()
    return summed(t.column(0).to_numpy().astype(np.int64), t.column(1).to_numpy().astype(np.int64))


def trie_of(longest: tuple[np.ndarray, np.ndarray], order: int, short: tuple[np.ndarray, np.ndarray] | None = None) -> Trie:
    """The trie of all strings in ``longest``; orders under ``HEAD`` from ``short`` where it is given."""
    levels = [None] * (order + 1)
    levels[order] = longest
    for k in range(order - 1, -1, -1):
        keys, n = short if short is not None and k == HEAD - 1 else levels[k + 1]
        levels[k] = summed(keys & ((1 << (8 * (k + 1))) - 1), n)
    return Trie(levels, [summed(keys >> 8, n) for keys, n in levels])


def worked_out(dealt_: DataFrame, short: tuple[np.ndarray, np.ndarray], order: int, parts: int) -> DataFrame:
    """(block, part, found, total, kinds): log10 of the probability of each string of a block in a part, in 24 bits; in the parts of
    words each word's training count, and on one row the sum of the part's counts and how many are over 0."""
    shared = dealt_.sparkSession.sparkContext.broadcast(short)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        mine = [np.cumsum(unpacked(k, int(size), np.int64)) for k, size in zip(frame["keys"], frame["size"], strict=True)]
        keys, n = summed(np.concatenate(mine), np.concatenate([unpacked(c, int(size), np.int64) for c, size in zip(frame["n"], frame["size"], strict=True)]))
        part = int(frame["part"].iloc[0])
        if part < parts:
            value = short_floats(trie_of((keys[n > 0], n[n > 0]), order, shared.value).logs(keys))
        else:
            value = n
        out = pd.DataFrame({"block": frame["block"], "part": frame["part"], "found": [packed(value[np.searchsorted(keys, m)]) for m in mine], "total": 0, "kinds": 0})
        if part >= parts:
            out.iloc[0, 3:] = [int(n.sum()), int((n > 0).sum())]
        return out

    return dealt_.groupBy("part").applyInPandas(run, "block bigint, part int, found binary, total bigint, kinds bigint")


class Trie:
    """Strings and contexts of every order as arrays in order, with all that scoring needs worked out."""

    def __init__(self, strings_by_order: list[tuple[np.ndarray, np.ndarray]], contexts_by_order: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(strings_by_order) - 1
        self.keys, self.count, self.contexts, self.fresh_log, self.start_escape = [], [], [], [], []
        self.after_total, self.after_escape = [], []
        kept, missing, kinds = [], [], []
        for (keys, n), (ctx, total) in zip(strings_by_order, contexts_by_order, strict=True):
            n = n.astype(float)
            own = keys >> 8
            starts = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0] if len(own) else np.zeros(0, np.int64)
            mine = own[starts]
            known = np.add.reduceat(n, starts) if len(starts) else np.zeros(0)
            q = np.diff(np.r_[starts, len(own)]).astype(float)
            full = total[np.searchsorted(ctx, mine)].astype(float) if len(mine) else np.zeros(0)
            self.keys.append(keys)
            self.count.append(n)
            self.contexts.append(mine)
            kept.append(known)
            kinds.append(q)
            missing.append(np.maximum(full - known, 0))
            self.start_escape.append(np.log10((missing[-1] + q) / (known + missing[-1] + q)) if len(mine) else known)
            self.fresh_log.append(np.log10(n / (known + missing[-1] + q)[np.searchsorted(mine, own)]) if len(mine) else known)
        # what a context leaves to the next shorter one once its own symbols are excluded
        for k in range(1, self.order + 1):
            mask = (1 << (8 * k)) - 1
            below = np.searchsorted(self.keys[k - 1], self.keys[k] & mask)
            at = np.searchsorted(self.contexts[k], self.keys[k] >> 8)
            excluded = np.bincount(at, self.count[k - 1][below], len(self.contexts[k])) if len(at) else np.zeros(0)
            parent = np.searchsorted(self.contexts[k - 1], self.contexts[k] & (mask >> 8))
            if len(at):
                left = np.maximum(kept[k - 1][parent] - excluded, 0)
                escape = missing[k - 1][parent] + kinds[k - 1][parent] - kinds[k]
                total = left + escape
                self.after_total.append(np.log10(np.where(total > 0, total, 1)))
                self.after_escape.append(np.where((total > 0) & (escape > 0), np.log10(np.where(escape > 0, escape, 1) / np.where(total > 0, total, 1)), 0.0))
            else:
                self.after_total.append(np.zeros(0))
                self.after_escape.append(np.zeros(0))
        self.unseen = -np.log10(max(1.0, 256 - len(self.keys[0])))
        self.longest = Lookup(self.keys[-1])  # they answer most look-ups at once

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte after the bytes before it."""
        at = self.longest.find(keys)
        out = self.fresh_log[-1][at] if len(self.fresh_log[-1]) else np.zeros(len(keys))
        miss = np.nonzero(at < 0)[0]
        if len(miss):
            out[miss] = self._slow(keys[miss])
        return out

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def _slow(self, keys: np.ndarray) -> np.ndarray:
        """The walk through shorter and shorter contexts."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        above = np.full(len(keys), -1, np.int64)  # the context one order up, where one was asked
        for k in range(self.order, -1, -1):
            part = keys[open_] & ((1 << (8 * (k + 1))) - 1)
            at, found = self._find(self.keys[k], part)
            ctx, known = self._find(self.contexts[k], part >> 8)
            up = above[open_]
            asked = up >= 0
            gain = np.zeros(len(open_))
            done = found & asked
            if k < self.order:
                gain[done] = np.log10(self.count[k][at[done]]) - self.after_total[k][up[done]]
            new = found & ~asked
            gain[new] = self.fresh_log[k][at[new]]
            lost = ~found & asked
            if k < self.order:
                gain[lost] = self.after_escape[k][up[lost]]
            begun = ~found & ~asked & known
            gain[begun] = self.start_escape[k][ctx[begun]]
            out[open_] += gain
            above[open_[known]] = ctx[known]
            above[open_[~known]] = -1
            open_ = open_[~found]
        out[open_] += self.unseen
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        keys, sizes = strings(texts, self.order)
        return np.add.reduceat(self.logs(keys), np.cumsum(sizes) - sizes)


def train_trie(parts: DataFrame, order: int = ORDER) -> Trie:
    """The trie of all training texts in one piece, for texts that fit the driver."""
    t = string_counts(parts, order).toArrow()
    return trie_of(summed(t.column(0).to_numpy().astype(np.int64), t.column(1).to_numpy().astype(np.int64)), order)


def scores(docs: DataFrame, train) -> DataFrame:
    """(doc_id, trains, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; ``train`` is
    the condition that picks training rows."""
    parts = saved(blocks(docs, train), "ppm-blocks")
    spark = docs.sparkSession
    size = parts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()[0] or 0
    n_parts = max(1, -(-size // PART_BYTES))
    found = saved(worked_out(dealt(parts, ORDER, n_parts), short_counts(parts), ORDER, n_parts), "ppm-found")
    released(spark)
    stats = found.agg(F.sum("total"), F.sum("kinds")).first()
    ends = parts.select(F.explode("trains").alias("t")).where("t").count()
    n, v = (stats[0] or 0) + ends, (stats[1] or 0) + (1 if ends else 0)
    sorted_ = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "found"))).alias("s"))
    full = parts.select("block", "ids", "sizes", "data", "trains").join(sorted_.select("block", F.col("s.part").alias("part"), F.col("s.found").alias("found")).hint("merge"), "block")

    def run(batches):
        bottom = np.log10(n + 0.5 * (v + 1))
        end = float(np.log10(ends + 0.5) - bottom)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, data, trains = (batch.column(c)[k].as_py() for c in range(1, 5))
                texts = texts_in(sizes, data)
                # the block's words and strings in the order in which they were dealt
                part, found = (batch.column(c)[k].as_py() for c in (5, 6))
                hashes, codes, stops = words_of(texts)
                by, cuts = words_in_parts(hashes, n_parts)
                counts = np.zeros(len(hashes) + 1, np.int64)
                got = [unpacked(f, int(cuts[p - n_parts + 1] - cuts[p - n_parts]), np.int64) for p, f in zip(part, found, strict=True) if p >= n_parts]
                counts[by] = np.concatenate(got) if got else np.zeros(0, np.int64)
                # the last entry stands for the empty word, which is none
                worth = np.append(np.log10(counts[:-1] + 0.5) - bottom, 0.0)
                sizes = np.add.reduceat((codes >= 0).astype(np.int64), stops[:-1]) + 1
                hits = np.add.reduceat((counts > 0)[codes].astype(np.int64), stops[:-1]) + (ends > 0)
                base = np.add.reduceat(worth[codes], stops[:-1]) + end
                every, lengths = strings(texts, ORDER)
                keys = distinct(every)[0]
                by, cuts = in_parts(keys, n_parts)
                value = np.empty(len(keys), np.float64)
                logs = np.concatenate([unpacked(f, int(cuts[p + 1] - cuts[p]), np.uint32) for p, f in zip(part, found, strict=True) if p < n_parts])
                value[by] = (logs << np.uint32(8)).view(np.float32)
                out = np.add.reduceat(value[Lookup(keys).find(every)], np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(trains, pa.bool_()),
                        pa.array(sizes, pa.int64()),
                        pa.array(hits, pa.int64()),
                        pa.array([n] * len(ids), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(out),
                    ],
                    names=["doc_id", "trains", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return full.mapInArrow(run, "doc_id bigint, trains boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return out.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
