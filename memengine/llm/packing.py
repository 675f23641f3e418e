"""Vector bin packing of token sequences with the dot-product heuristic.

An example takes room in three dimensions at once: tokens, segments (one per piece) and loss-bearing tokens. For
each open sequence the heuristic places, of all pieces that still fit in every dimension, the one whose demand has
the largest dot product with the room left, each dimension weighted by how scarce it is in the window.

Each task packs the rows of its own partition, window by window; nothing is shuffled, a hot key cannot skew it, and
a lost task is repeated on the same rows with the same result. Sequences of a window that stay too empty give their
pieces back to the next window. With ``cut`` the last gaps are filled by cutting pieces of the emptiest sequences.

Defined results:
* null ids or text: packed as the empty example (for ``op2``, its end id alone); null in other columns passes through;
* an example beyond the limits of one sequence is cut into pieces that each fill a sequence, and a rest;
* an example without tokens and without an end id gives no piece; repeated rows are packed each;
* of pieces with equal demand the first comes first, of equal scores the demand met first; an empty table gives no rows;
* columns of the input stay; added names that clash get underscores in front.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bpe
from .common import fresh, mapped, table, with_arrays


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


#: Tokens and pieces a window holds before it is packed; a gap below ``MIN_GAP`` tokens is left as padding.
WINDOW_TOKENS = 1 << 20
WINDOW_PIECES = 1 << 16
MIN_GAP = 32
GIVE_BACK = 0.98


class _Piece:
    __slots__ = ("row", "start", "length", "loss_from")

    def __init__(self, row, start, length, loss_from):
        self.row, self.start, self.length, self.loss_from = row, start, length, loss_from

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def head(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.row, self.start, n, self.loss_from), _Piece(self.row, self.start + n, self.length - n, self.loss_from)


def cut_example(row, n: int, loss_from: int, limits: Limits) -> tuple[list[_Piece], _Piece | None]:
    """Pieces that fill a sequence each, and the rest that still needs a place."""
    full, start = [], 0
    while n - start > 0:
        most = min(limits.tokens, max(loss_from - start, 0) + limits.loss)
        if n - start < most or (n - start == most and most < limits.tokens):
            return full, _Piece(row, start, n - start, loss_from)
        full.append(_Piece(row, start, most, loss_from))
        start += most
    return full, None


def pack_window(pieces: list[_Piece], limits: Limits) -> list[list[_Piece]]:
    """Sequences by the dot-product heuristic. Pieces of equal demand are one class with a queue, so a choice costs
    the number of different demands, not of pieces."""
    caps = np.array([limits.tokens, limits.segments, limits.loss], float)
    queues: dict[tuple[int, int], list[_Piece]] = {}
    for p in pieces:
        queues.setdefault((p.length, p.loss), []).append(p)
    need = np.array([[n, 1, loss] for n, loss in queues], float).reshape(-1, 3) / caps
    left = np.array([len(q) for q in queues.values()])
    waiting = [q[::-1] for q in queues.values()]
    total = need.T @ left
    worth = need * (total / max(total.sum(), 1e-12))
    class_ = np.arange(len(left))
    out: list[list[_Piece]] = []
    while len(class_):
        room, bin_ = np.ones(3), []
        demand, parts, mine = need[class_], worth[class_], left[class_]
        while True:
            fits = (mine > 0) & (demand <= room + 1e-9).all(1)
            if not fits.any():
                break
            at = int(np.argmax(np.where(fits, parts @ room, -1.0)))
            mine[at] -= 1
            room = room - demand[at]
            bin_.append(waiting[class_[at]].pop())
        if not bin_:
            raise ValueError("a piece exceeds the limits of a sequence")
        out.append(bin_)
        left[class_] = mine
        class_ = class_[mine > 0]
    return out


def fill_gaps(bins: list[list[_Piece]], limits: Limits, min_gap: int = MIN_GAP) -> list[list[_Piece]]:
    """Cuts pieces of the emptiest sequences into the gaps of the fuller ones."""
    used = [sum(p.length for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-used[i], i))
    bins, lo, hi = [bins[i] for i in order], 0, len(order) - 1
    used = [used[i] for i in order]
    loss = [sum(p.loss for p in b) for b in bins]
    while lo < hi:
        gap = limits.tokens - used[lo]
        if gap < min_gap or len(bins[lo]) >= limits.segments or limits.loss - loss[lo] < min_gap:
            lo += 1
            continue
        p = bins[hi].pop()
        n = min(gap, p.length)
        n = min(n, max(p.loss_from - p.start, 0) + limits.loss - loss[lo])
        moved, rest = p.head(n) if n < p.length else (p, None)
        bins[lo].append(moved)
        used[lo] += moved.length
        loss[lo] += moved.loss
        used[hi] -= moved.length
        loss[hi] -= moved.loss
        if rest is not None:
            bins[hi].append(rest)
        if not bins[hi]:
            hi -= 1
    return [b for b in bins if b]


class _Packer:
    """Rows in, finished sequences out; holds one window."""

    def __init__(self, limits: Limits, cut: bool, window_tokens: int):
        self.limits, self.cut, self.window_tokens = limits, cut, window_tokens
        self.pool: list[_Piece] = []
        self.held = 0

    def add(self, row, n: int, loss_from: int):
        full, rest = cut_example(row, n, loss_from, self.limits)
        for p in full:
            yield [p]
        if rest is not None:
            self.pool.append(rest)
            self.held += rest.length
        if self.held >= self.window_tokens or len(self.pool) >= WINDOW_PIECES:
            yield from self.flush(last=False)

    def flush(self, last: bool):
        bins = pack_window(self.pool, self.limits)
        if self.cut:
            bins = fill_gaps(bins, self.limits)
        self.pool, self.held = [], 0
        for b in bins:
            n = sum(p.length for p in b)
            if last or len(b) >= self.limits.segments or n >= GIVE_BACK * self.limits.tokens or sum(p.loss for p in b) >= GIVE_BACK * self.limits.loss:
                yield b
            else:
                self.pool += b
                self.held += n
        if not last and (self.held >= self.window_tokens // 2 or len(self.pool) >= WINDOW_PIECES // 2):  # a window of pieces that don't combine
            for b in pack_window(self.pool, self.limits):
                yield b
            self.pool, self.held = [], 0


def pack(
    df: DataFrame,
    ids: str = "ids",
    loss_from: str | None = None,
    limits: Limits = Limits(),
    cut: bool = True,
    with_ids: bool = True,
    window_tokens: int = WINDOW_TOKENS,
    encode=None,
) -> DataFrame:
    """One row per piece: the other columns of its row, and ``start``, ``length``, ``doc_tokens``, ``loss_tokens``,
    ``ids_crc32``, ``sequence_id``, ``offset``, and with ``with_ids`` the piece's ``ids``.

    ``loss_from`` names the column with the number of leading tokens that bear no loss (the prompt); without it, all
    tokens but an example's first bear loss. ``sequence_id`` is unique over the whole result."""
    names = [c for c in df.columns if c not in (ids, loss_from)]
    base = df.select(*[F.col(f"`{c}`") for c in df.columns])
    rest = base.select(*[F.col(f"`{c}`") for c in names])
    new = [("start", "bigint"), ("length", "bigint"), ("doc_tokens", "bigint"), ("loss_tokens", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    added = [(fresh(rest, n), t) for n, t in new] + ([(fresh(rest, "ids"), "array<int>")] if with_ids else [])
    schema = StructType([df.schema[n] for n in names] + StructType.fromDDL(",".join(f"`{n}` {t}" for n, t in added)).fields)

    def run(batches):
        from pyspark import TaskContext

        packer, serial = _Packer(limits, cut, window_tokens), TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        rows: dict[int, tuple] = {}  # rows with pieces in the pool: a one-row batch, its ids, pieces still open
        ready, size, key = [], 0, 0

        def emit():
            tabs = [r for r, *_ in ready]
            part = pa.Table.from_batches(tabs).combine_chunks() if names else None
            cols = [part.column(n) for n in names] if names else []
            for k, (_, t) in enumerate(added[:7]):
                cols.append(pa.array([r[k + 1] for r in ready], pa.int64()))
            if with_ids:
                cols.append(pa.array([r[8] for r in ready], pa.list_(pa.int32())))
            return from_columns(cols)

        def from_columns(cols):
            t = pa.table([c for c in cols], names=[*names, *[n for n, _ in added]])
            yield from t.combine_chunks().to_batches()

        def take(bins):
            nonlocal serial, size
            for b in bins:
                offset = 0
                for p in b:
                    one, all_ids = rows[p.row][:2]
                    part = all_ids[p.start : p.start + p.length]
                    ready.append((one, p.start, p.length, len(all_ids), p.loss, zlib.crc32(part.astype("<u4").tobytes()), serial, offset, part if with_ids else None))
                    offset += p.length
                    size += p.length
                    rows[p.row][2] -= p.length
                    if rows[p.row][2] == 0:
                        del rows[p.row]
                serial += 1
            if len(ready) >= 4096 or size >= 1 << 22:
                yield from emit()
                ready.clear()
                size = 0

        for batch in batches:
            # a copy, as what waits in the pool would else hold the whole batch
            slim = batch.select(names).take(pa.array(range(batch.num_rows), pa.int64())) if names else batch.select(names)
            column = batch.column(batch.schema.get_field_index(ids))
            prompt = batch.column(batch.schema.get_field_index(loss_from)).to_pylist() if loss_from else None
            del batch
            if encode is not None:
                column = encode(column)
            for i in range(len(column)):
                value = column[i]
                tokens = value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int32)
                if len(tokens):
                    rows[key] = [slim.slice(i, 1), np.array(tokens, np.int32), len(tokens)]
                    yield from take(list(packer.add(key, len(tokens), 1 if prompt is None else max(0, prompt[i] or 0))))
                    key += 1
        yield from take(list(packer.flush(last=True)))
        if ready:
            yield from emit()

    return mapped(base, run, schema)


def token_ids(texts: list[str], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text as the ``tokenizers`` library gives them, then ``end_id``, one after another as little-endian
    32-bit integers, and where each text's begin and end."""
    v = bpe.vocabulary(path)
    ids, ends = bpe.encoded(v, bpe.RankSynchronousCounter(v), texts)
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


def encoder(path: str, end_id: int):
    """From an array of texts to the lists of their ids and the end id; a null text is empty."""

    def encode(column):
        ids, ends = token_ids([t or "" for t in column.to_pylist()], path, end_id)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    return encode


def tokenize(df: DataFrame, path: str, end_id: int, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` without ``text``, with its ids and the end id; a null text is empty."""
    encode = encoder(path, end_id)
    return with_arrays(df, text, [(fresh(df, name), "array<int>")], lambda column: [encode(column)], drop=True)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Whole ``documents`` with the production vocabulary and limits, without the pieces' ids."""
    encode = encoder(public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pack(docs.select("doc_id", "text"), ids="text", with_ids=False, encode=encode)


def conversation_examples(conversations: DataFrame, path: str, end_id: int) -> DataFrame:
    """(conv_id, turn, ids, prompt_tokens): each assistant turn as an example, prompted by the turn before it; only the
    turn's own tokens and its end id bear loss."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", "role", "text", F.lag("text").over(before).alias("prompt"))
    asked = tokenize(turns.where("role = 'assistant'").select("conv_id", "turn", "text", "prompt"), path, end_id, text="prompt", name="prompt_ids")
    both = tokenize(asked, path, end_id, name="answer_ids")
    return both.select("conv_id", "turn", F.concat("prompt_ids", "answer_ids").alias("ids"), F.size("prompt_ids").alias("prompt_tokens"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data under three limits that all bind: tokens, segments and loss-bearing tokens."""
    examples = conversation_examples(table(spark, sf_dir, "conversations"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return pack(examples, loss_from="prompt_tokens", limits=Limits(tokens=2048, segments=12, loss=1024), cut=False, with_ids=False)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
