"""Alignment of two tokenizers: where tokens of both end, the text is cut into groups.

``Fragment`` is what a byte range of a text comes to: tokens up to the first common end (open to the left), closed
groups, tokens after the last common end (open to the right). ``composed`` joins two neighbours and is associative, so
the fragments of a long text are reduced as a tree, over tasks, in any bracketing. Ranges need not end where tokens of
both end: a long text is cut where one tokenizer surely ends a token, for each of the two at a place of its own.

A stretch between single spaces is a fragment that is closed at both ends, so texts that are not long are put together
from the distinct stretches of a part: each is tokenized and aligned once.

Links are counted in blocks of text: a block asks for the pairs it holds, once each, whatever their number, so the rows
that are shuffled grow with the text and a frequent pair is one row a block.

Defined results: null and empty texts have no tokens; texts whose bytes a tokenizer doesn't give back have none either;
special strings are plain text; texts of any length are read whole; repeated rows and ids count each; an empty table
gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import copy
import functools
import gc
import hashlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import bpe
from .bpe import WHITE, ragged
from .common import dropped, mapped, saved, table

#: Bytes of a text from which on it is cut into ranges, and of a range.
RANGE_BYTES = 1 << 16
#: Characters of texts that one block holds.
BLOCK_CHARS = 1 << 20
#: Blocks of a file.
FILE_BLOCKS = 4
#: Fragments of one text that a task composes in a round.
FAN_IN = 32

#: The left tokenizer ends a token before white space that follows other characters, the right one before spaces that
#: follow another character and lead to one.
_LEFT_END = regex.compile(rf"[^{WHITE}](?=[{WHITE}])")
_RIGHT_END = regex.compile(r"[^ ](?= +[^ ])")
_BOTH_END = regex.compile(rf"[^{WHITE}](?= [^{WHITE}])")


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Stream:
    """Tokens of both sides in order, each with the byte where it ends."""

    a: np.ndarray = field(default_factory=_none)
    a_end: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)
    b_end: np.ndarray = field(default_factory=_none)

    def parts(self):
        return self.a, self.a_end, self.b, self.b_end

    def __add__(self, other: Stream) -> Stream:
        return Stream(*(np.concatenate((x, y)) for x, y in zip(self.parts(), other.parts(), strict=True)))

    def within(self, start: int, stop: int) -> Stream:
        """Tokens that end after ``start`` and not after ``stop``."""
        i, j = np.searchsorted(self.a_end, [start, stop], side="right")
        k, m = np.searchsorted(self.b_end, [start, stop], side="right")
        return Stream(self.a[i:j], self.a_end[i:j], self.b[k:m], self.b_end[k:m])

    def common_ends(self) -> np.ndarray:
        return np.intersect1d(self.a_end, self.b_end)


@dataclass
class Groups:
    """Groups one after another: their written form, how many, the pairs linked at their ends (left id in the upper 32
    bits), and the byte where the last one ends."""

    text: str
    n: int
    links: list[int]
    stop: int


@dataclass
class Fragment:
    head: Stream
    closed: list[Groups]
    tail: Stream
    cut: bool  # whether tokens of both end together anywhere; if not, all is in ``head``


def grouped(s: Stream) -> Groups:
    """The groups of a stream that begins and ends at common ends."""
    ends = s.common_ends()
    at_a, at_b = np.searchsorted(s.a_end, ends, side="right"), np.searchsorted(s.b_end, ends, side="right")
    return Groups(";".join(_written(s.a, at_a, s.b, at_b).to_pylist()), len(ends), _linked(s.a[at_a - 1], s.b[at_b - 1]).tolist(), int(ends[-1]))


def _joined(values: pa.Array, stops: np.ndarray, by: str) -> pa.Array:
    """Runs of strings, each joined to one; a run stops before the place ``stops`` says."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), values), by)


def _written(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> pa.Array:
    """Each group as text; they stop before the tokens ``at_a`` and ``at_b``."""
    return pc.binary_join_element_wise(_joined(pa.array(a).cast(pa.string()), at_a, ","), _joined(pa.array(b).cast(pa.string()), at_b, ","), "|")


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


def fragment(s: Stream) -> Fragment:
    """A byte range: what is left of its first common end and right of its last stays open."""
    ends = s.common_ends()
    if not len(ends):
        return Fragment(s, [], Stream(), False)
    first, last = int(ends[0]), int(ends[-1])
    closed = [grouped(s.within(first, last))] if last > first else []
    return Fragment(s.within(-1, first), closed, s.within(last, 1 << 62), True)


def composed(x: Fragment, y: Fragment) -> Fragment:
    """``x`` and the range right of it; associative, with ``fragment(Stream())`` as its neutral element."""
    seam = fragment((x.tail if x.cut else x.head) + y.head)
    if not seam.cut:  # then y has no common end either
        return Fragment(x.head, x.closed, seam.head, True) if x.cut else seam
    # what the seam has up to its first common end begins at the last one of x, if there is one
    at_seam = [grouped(seam.head), *seam.closed] if x.cut else seam.closed
    return Fragment(x.head if x.cut else seam.head, [*x.closed, *at_seam, *y.closed], y.tail if y.cut else seam.tail, True)


def whole(x: Fragment) -> list[Groups]:
    """The groups of a whole text: it begins and ends where both tokenizers do."""
    return [grouped(x.head), *x.closed] if x.cut else []


class Tokenizers:
    """The left one is a byte-level BPE file of the ``tokenizers`` library, used on a space and the text; the right one
    a model of ``sentencepiece``, which adds that space itself. Special strings are plain text."""

    def __init__(self, left: str, right: str):
        import sentencepiece

        self.left = copy.copy(bpe.vocabulary(left))
        self.left.special, self.left.special_re = {}, None
        self.merger = bpe.RankSynchronousCounter(self.left)
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        ids = range(self.right.get_piece_size())
        spelled = [bytes([int(self.right.id_to_piece(i)[3:-1], 16)]) if self.right.is_byte(i) else self.right.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.left_bytes = np.array([len(b) for b in self.left.bytes_of], np.int64)
        self.right_bytes = np.array([len(b) for b in spelled], np.int64)
        self.right_flat, self.right_at = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.right_bytes) - self.right_bytes

    def left_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        ids, ends = bpe.TokenTable(self.left, texts).merged(self.merger)
        return ids.astype(np.int64), np.diff(ends)

    def right_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for texts without the space they begin with, and whether the bytes of space and text come back;
        where not, there are no ids."""
        found = self.right.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        del found
        empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        flat, due = _bytes(pc.binary_join_element_wise(empty, pa.array(texts, pa.large_string()), space))
        owner = np.repeat(np.arange(len(texts)), sizes)
        good = np.bincount(owner, self.right_bytes[ids], len(texts)).astype(np.int64) == due
        ids, owner = ids[good[owner]], owner[good[owner]]
        mine = self.right_flat[ragged(self.right_at[ids], self.right_bytes[ids])]
        theirs = flat if good.all() else flat[np.repeat(good, due)]
        if not np.array_equal(mine, theirs):
            spots = np.repeat(np.flatnonzero(good), due[good])
            good[np.unique(spots[mine != theirs])] = False
            ids, owner = ids[good[owner]], owner[good[owner]]
        return ids, np.bincount(owner, minlength=len(texts)), good

    def stream(self, left: str, left_start: int, right: str, right_start: int) -> tuple[Stream, bool]:
        """Tokens of a range, and whether its bytes come back."""
        a, _ = self.left_ids([left])
        b, _, good = self.right_ids([right[1:]]) if right else (_none(), None, np.array([True]))
        return Stream(a, left_start + np.cumsum(self.left_bytes[a]), b, right_start + np.cumsum(self.right_bytes[b])), bool(good[0])


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings one after another, and how many each has."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    flat = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, np.diff(offsets)


@functools.lru_cache(maxsize=1)
def tokenizers(left: str, right: str) -> Tokenizers:
    return Tokenizers(left, right)


def _forgotten(run):
    """``run`` without the tokenizers after its task: idle workers would hold them beside all later stages."""

    @functools.wraps(run)
    def held(batches):
        try:
            yield from run(batches)
        finally:
            tokenizers.cache_clear()
            bpe.vocabulary.cache_clear()
            gc.collect()

    return held


def ranges(text: str, size: int):
    """Byte ranges of about ``size`` bytes of a space and the text: (left start, left text, right start, right text)."""
    text = " " + text
    left = right = left_byte = right_byte = 0
    while left < len(text) or right < len(text):
        at = min(left, right) + size  # a character has a byte at least
        stops = [len(text) if at >= len(text) or (m := end.search(text, at)) is None else m.end() for end in (_LEFT_END, _RIGHT_END)]
        a, b = text[left : max(left, stops[0])], text[right : max(right, stops[1])]
        yield left_byte, a, right_byte, b
        left, right, left_byte, right_byte = left + len(a), right + len(b), left_byte + len(a.encode()), right_byte + len(b.encode())


class Stretches:
    """The distinct stretches of many texts, aligned; every text is a run of them.

    For text i: ``n_a[i]``, ``n_b[i]``, ``n_groups[i]``; zeros for a text that is empty or whose bytes don't come
    back."""

    def __init__(self, both: Tokenizers, texts: list[str]):
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        odd = self._uneven(codes, offsets, distinct)
        if len(odd):  # white space meets white space at a cut: such texts are cut elsewhere
            known = distinct.to_pylist()
            place = {c: i for i, c in enumerate(known)}
            runs = [codes[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            for i in odd.tolist():
                text, at, run = " " + texts[i], 0, []
                for stop in [*(m.end() for m in _BOTH_END.finditer(text)), len(text)]:
                    c = text[at + 1 : stop]
                    run.append(place.setdefault(c, len(place)))
                    if run[-1] == len(known):
                        known.append(c)
                    at = stop
                runs[i] = np.array(run, np.int64)
            codes, offsets = np.concatenate(runs), np.cumsum([0, *map(len, runs)])
            used = np.unique(codes)
            distinct, codes = [known[i] for i in used.tolist()], np.searchsorted(used, codes)
        else:
            distinct = distinct.to_pylist()
        self.codes, self.offsets, n = codes, offsets, len(distinct)
        a, a_size = both.left_ids([" " + c for c in distinct])
        b, b_size, good = both.right_ids(distinct)
        a_end = np.cumsum(both.left_bytes[a])
        begin = np.concatenate(([0], np.concatenate(([0], a_end))[np.cumsum(a_size)]))
        owner = np.repeat(np.arange(n), b_size)
        b_end = np.cumsum(both.right_bytes[b])
        before = np.concatenate(([0], b_end))[np.cumsum(b_size) - b_size]
        b_end = b_end + (begin[:-1] - before)[owner]
        at = np.minimum(np.searchsorted(a_end, b_end), max(0, len(a_end) - 1))
        meet = np.flatnonzero(a_end[at] == b_end) if len(b) else _none()
        self.pairs = _linked(a[at[meet]], b[meet])
        self.per = np.bincount(owner[meet], minlength=n)  # groups of each stretch
        self.first = np.cumsum(self.per) - self.per
        # a stretch that is not good has no groups, so what is written of the next one must not begin with its tokens
        a_kept = np.repeat(good, a_size)
        written = _written(a[a_kept], np.cumsum(a_kept)[at[meet]], b, meet + 1)
        self.written = _joined(written, np.cumsum(self.per), ";").cast(pa.large_string())
        self.n_texts = len(texts)
        fine = np.ones(len(texts), bool)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        fine[owner[~good[codes]]] = False
        fine &= np.array([bool(t) for t in texts], bool)
        self.fine = fine
        total = lambda x: np.where(fine, np.diff(np.concatenate(([0], np.cumsum(x[codes])))[offsets]), 0)
        self.n_a, self.n_b, self.n_groups = total(a_size), total(b_size), total(self.per)

    @staticmethod
    def _uneven(codes: np.ndarray, offsets: np.ndarray, distinct) -> np.ndarray:
        begins = pc.match_substring_regex(distinct, f"^[{WHITE}]|^$").to_numpy(zero_copy_only=False)
        stops = pc.match_substring_regex(distinct, f"[{WHITE}]$|^$").to_numpy(zero_copy_only=False)
        inner = np.ones(len(codes), bool)
        inner[offsets[:-1][offsets[:-1] < len(codes)]] = False  # a text's first stretch follows nothing
        at = np.flatnonzero(inner)
        at = at[stops[codes[at - 1]] & begins[codes[at]]]
        # a space at an end of a text has no stretch of its own either
        bare = np.flatnonzero((pc.binary_length(distinct).to_numpy() == 0)[codes])
        found = np.unique(np.searchsorted(offsets, np.concatenate((at, bare)), side="right") - 1)
        return found[np.diff(offsets)[found] > 1]  # the empty text is one empty stretch

    def digests(self) -> list[str]:
        """Hashes of the written groups of every text."""
        out, step = [], max(1, self.n_texts // 8)
        for s in range(0, self.n_texts, step):
            ends = self.offsets[s : s + step + 1]
            runs = self.written.take(pa.array(self.codes[ends[0] : ends[-1]]))
            texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends - ends[0]), runs), pa.scalar(";", pa.large_string()))
            flat, sizes = _bytes(texts)
            stops = np.cumsum(sizes).tolist()
            view = memoryview(flat)
            for i, (stop, size) in enumerate(zip(stops, sizes.tolist(), strict=True)):
                out.append(hashlib.sha256(view[stop - size : stop]).hexdigest() if self.fine[s + i] else "")
        return out

    def block(self):
        """The distinct pairs of all fine texts, how often each is linked, and the texts' links as numbers into them."""
        runs = self.codes[np.repeat(self.fine, np.diff(self.offsets))]
        pairs, number = np.unique(self.pairs, return_inverse=True)
        links = number[ragged(self.first[runs], self.per[runs])].astype(np.int32)
        counts = np.bincount(links, minlength=len(pairs))
        used = counts > 0
        return pairs[used], counts[used], (np.cumsum(used) - 1).astype(np.int32)[links]


#: A block of texts. ``size`` links each; ``key`` is null for a whole text, else the long text of which it is a part.
BLOCK = "block bigint, pairs array<bigint>, counts array<bigint>, codes array<int>, texts array<struct<key:bigint,size:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,groups_sha256:string>>"


def _block_schema(ident) -> StructType:
    return StructType.fromDDL(BLOCK).add("ids", StructType.fromDDL(f"x array<{ident.simpleString()}>")["x"].dataType)


def _block_row(schema, number: int, pairs, counts, codes, texts: list[dict], ids) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    one = lambda values, kind: pa.array([values], kind)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.asarray(x, t))) for x, t in ((pairs, np.int64), (counts, np.int64), (codes, np.int32))]
    columns = [pa.array([number], pa.int64()), *lists, one(texts, arrow.field("texts").type), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(arrow.field("ids").type.value_type))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names)


def text_blocks(docs: DataFrame, left: str, right: str) -> DataFrame:
    """Blocks of whole texts; ``docs`` has the columns id and text."""
    schema = _block_schema(docs.schema["id"].dataType)

    def run(batches):
        both = tokenizers(left, right)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            start = 0
            while start < len(sizes):
                stop, held = start, 0
                while stop < len(sizes) and (stop == start or held + sizes[stop] <= BLOCK_CHARS):
                    held += sizes[stop]
                    stop += 1
                s = Stretches(both, [t or "" for t in batch.column(1).slice(start, stop - start).to_pylist()])
                rows = [{"key": None, "size": n, "n_a": a, "n_b": b, "n_groups": n, "groups_sha256": d} for a, b, n, d in zip(s.n_a.tolist(), s.n_b.tolist(), s.n_groups.tolist(), s.digests(), strict=True)]
                row = _block_row(schema, number, *s.block(), rows, batch.column(0).slice(start, stop - start))
                del s, rows  # before the next block is made
                yield row
                del row
                number += 1
                start = stop

    return mapped(docs.select("id", "text"), _forgotten(run), schema)


STREAM = "struct<a:array<bigint>,a_end:array<bigint>,b:array<bigint>,b_end:array<bigint>>"
GROUPS = "array<struct<text:string,n:bigint,links:array<bigint>,stop:bigint>>"
FRAGMENT = f"key bigint, part bigint, head {STREAM}, closed {GROUPS}, tail {STREAM}, cut boolean"


def _stream_row(s: Stream) -> dict:
    return {k: x.tolist() for k, x in zip(("a", "a_end", "b", "b_end"), s.parts(), strict=True)}


def _stream_of(row) -> Stream:
    return Stream(*(np.array(row[k], np.int64) for k in ("a", "a_end", "b", "b_end")))


def _groups_row(g: Groups) -> dict:
    return {"text": g.text, "n": g.n, "links": g.links, "stop": g.stop}


def cut_ranges(docs: DataFrame, size: int) -> DataFrame:
    """A row per range of each text (key, id, part, left_start, left, right_start, right)."""
    schema = StructType.fromDDL("key bigint").add(docs.schema["id"]).add("part", "long").add("left_start", "long").add("left", "string").add("right_start", "long").add("right", "string")

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                for part, found in enumerate(ranges(batch.column(1)[i].as_py(), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((number, batch.column(0)[i].as_py(), part, *found), arrow, strict=True)], names=arrow.names)
                number += 1

    return saved(mapped(docs.select("id", "text"), run, schema), "alignment-ranges")


def range_fragments(parts: DataFrame, left: str, right: str) -> DataFrame:
    """The fragment of every range; its own closed groups are ``inner``, and stay behind when fragments are composed."""
    kept = StructType([parts.schema["id"]])
    schema = StructType(StructType.fromDDL(FRAGMENT).fields + kept.fields).add("good", "boolean").add("n_a", "long").add("n_b", "long").add("inner", StructType.fromDDL(f"x {GROUPS}")["x"].dataType)

    def run(batches):
        both, arrow = tokenizers(left, right), to_arrow_schema(schema)
        for batch in batches:
            for r in batch.to_pylist():
                s, good = both.stream(r["left"], r["left_start"], r["right"], r["right_start"])
                f = fragment(s)
                row = {"key": r["key"], "part": r["part"], "head": _stream_row(f.head), "closed": [], "tail": _stream_row(f.tail), "cut": f.cut}
                row |= {"id": r["id"], "good": good, "n_a": len(s.a), "n_b": len(s.b), "inner": [_groups_row(g) for g in f.closed]}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    dealt = parts.repartition("key", "part")  # ranges of one text go to many tasks
    return saved(mapped(dealt, _forgotten(run), schema), "alignment-fragments")


def reduced(fragments: DataFrame) -> DataFrame:
    """(key, seams): the groups that close where ranges meet, by a tree over tasks. What is composed holds only open
    ends and seams, whatever the length of the text."""

    def compose(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("part")
        total = None
        for row in pdf.itertuples(index=False):
            f = Fragment(_stream_of(row.head), [Groups(g["text"], int(g["n"]), [int(x) for x in g["links"]], int(g["stop"])) for g in row.closed], _stream_of(row.tail), bool(row.cut))
            total = f if total is None else composed(total, f)
        return pd.DataFrame([{"key": key[0], "part": key[1], "head": _stream_row(total.head), "closed": [_groups_row(g) for g in total.closed], "tail": _stream_row(total.tail), "cut": total.cut}])

    now = fragments.select("key", "part", "head", "closed", "tail", "cut")
    while now.agg(F.max("part")).first()[0]:
        above = now.groupBy("key", F.floor(F.col("part") / FAN_IN).alias("part_above")).applyInPandas(compose, FRAGMENT)
        now = saved(above, "alignment-tree")
    close = StructType.fromDDL("key bigint, seams " + GROUPS)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                first = [grouped(_stream_of(r["head"]))] if r["cut"] else []
                yield pa.RecordBatch.from_pylist([{"key": r["key"], "seams": [_groups_row(g) for g in first] + r["closed"]}], schema=to_arrow_schema(close))

    return mapped(now, run, close)


def long_groups(docs: DataFrame, left: str, right: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Of texts that are cut into ranges: their groups (key, stop, text, n, links), which keep their place in the text
    by ``stop``, and a row per text (key, id, n_a, n_b)."""
    parts = cut_ranges(docs, size)
    fragments = range_fragments(parts, left, right)
    dropped(parts)
    texts = fragments.groupBy("key").agg(F.first("id").alias("id"), F.min("good").alias("good"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    texts = saved(texts.select("key", "id", "good", *[F.when(F.col("good"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b")]), "alignment-texts")
    groups = fragments.select("key", F.explode("inner").alias("g")).unionByName(reduced(fragments).select("key", F.explode("seams").alias("g")))
    fine = texts.where("good").select("key").hint("shuffle_hash")
    return saved(groups.select("key", "g.stop", "g.text", "g.n", "g.links").join(fine, "key"), "alignment-groups"), texts


def streamed_digests(groups: DataFrame) -> DataFrame:
    """(key, groups_sha256): hashes of the written groups of each text, which go by in order, none held but one."""
    schema = "key bigint, groups_sha256 string"

    def run(batches):
        now = hasher = None
        for batch in batches:
            for key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    if hasher is not None:
                        yield pa.RecordBatch.from_pydict({"key": [now], "groups_sha256": [hasher.hexdigest()]})
                    now, hasher = key, hashlib.sha256()
                else:
                    hasher.update(b";")
                hasher.update(text.encode())
        if hasher is not None:
            yield pa.RecordBatch.from_pydict({"key": [now], "groups_sha256": [hasher.hexdigest()]})

    return mapped(groups.repartition("key").sortWithinPartitions("key", "stop").select("key", "text"), run, schema)


def group_blocks(groups: DataFrame, ident) -> DataFrame:
    """Blocks of the groups of long texts, one of them a row of its own."""
    schema = _block_schema(ident)

    def run(batches):
        number = (TaskContext.get().partitionId() << 32) | (1 << 31)  # apart from the blocks of whole texts
        for batch in batches:
            for key, n, links in zip(*(batch.column(k) for k in range(3)), strict=True):
                pairs, codes, counts = np.unique(links.values.to_numpy(), return_inverse=True, return_counts=True)
                row = {"key": key.as_py(), "size": len(codes), "n_a": 0, "n_b": 0, "n_groups": n.as_py(), "groups_sha256": None}
                yield _block_row(schema, number, pairs, counts, codes, [row], pa.nulls(1))
                number += 1

    return mapped(groups.select("key", "n", "links"), run, schema)


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold a pair, and whether its right id is in no other pair more often."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    pairs = saved(pairs, "alignment-pairs")
    right = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = pairs.groupBy(right.alias("right")).agg(F.max("n").alias("most"))
    return saved(pairs.withColumn("right", right).hint("merge").join(most.hint("merge"), "right").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-counts")


RESULT = "key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def counted(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per text of every block, with the counts of its links."""
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.hint("merge").join(counts.hint("merge"), "pair").groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("told"))
    ready = blocks.select("block", "codes", "texts", "ids").hint("merge").join(told.hint("merge"), "block", "left").select("codes", "texts", "ids", "told")
    schema = StructType(StructType.fromDDL(RESULT).fields)
    schema.add("id", blocks.schema["ids"].dataType.elementType)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                codes, texts = batch.column(0)[k].values.to_numpy(), batch.column(1)[k].values
                told = batch.column(3)[k]
                n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if told.is_valid:
                    told = told.values
                    at = told.field("at").to_numpy()
                    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    n[at] = told.field("n").to_numpy()
                    best[at] = told.field("best").to_numpy(zero_copy_only=False)
                size = texts.field("size")
                ends = np.concatenate(([0], np.cumsum(size.to_numpy())))
                per = lambda x: pa.array(np.diff(np.concatenate(([0], np.cumsum(x[codes])))[ends]))
                own = {c: texts.field(c) for c in ("key", "n_a", "n_b", "n_groups", "groups_sha256")}
                row = own | {"n_links": size, "n_best": per(best), "count_sum": per(n), "id": batch.column(2)[k].values}
                yield pa.RecordBatch.from_pydict({f: row[f] for f in schema.names})

    return mapped(ready, run, schema)


def aligned(docs: DataFrame, left: str, right: str, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > range_bytes, F.lit(False))
    blocks = [saved(text_blocks(docs.where(~is_long), left, right), "alignment-blocks", FILE_BLOCKS)]
    long_docs = docs.where(is_long)
    texts = None
    if not long_docs.isEmpty():
        groups, texts = long_groups(long_docs, left, right, range_bytes)
        digests = saved(streamed_digests(groups), "alignment-digests")
        blocks.append(saved(group_blocks(groups, docs.schema["id"].dataType), "alignment-blocks"))
        dropped(groups)
    every = blocks[0] if texts is None else blocks[0].unionByName(blocks[1])
    counts = link_counts(every)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = counted(blocks[0], counts).select(F.col("id").alias(doc_id), *columns)
    if texts is not None:
        sums = counted(blocks[1], counts).groupBy("key").agg(*[F.sum(c).alias(c) for c in columns[2:6]])
        full = texts.hint("merge").join(sums.hint("merge"), "key", "left").join(digests.hint("merge"), "key", "left")
        out = out.unionByName(full.select(F.col("id").alias(doc_id), "n_a", "n_b", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns[2:6]], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
