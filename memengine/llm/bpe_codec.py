"""Encoding and decoding with byte-pair merges found by a segment tree over adjacent pair ranks.

Defined results: a null text is encoded as the empty text (no ids, decoded to the empty text); special strings
inside a text become their id, as the library has it by default; texts of any length are encoded whole, one long
pre-token in time n log n; repeated rows are encoded each; an empty table gives an empty result; input columns stay
and added names that clash get underscores in front; an id outside the vocabulary decodes to no bytes; bytes that
are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import fresh, table, with_arrays


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another as little-endian 32-bit integers, and where each text's begin and end."""
    v = bpe.vocabulary(path)
    return bpe.encoded(v, bpe.SegmentTreeBPE(v), texts)


def encode(df: DataFrame, path: str, text: str = "text", name: str = "ids", drop_text: bool = False) -> DataFrame:
    """``df`` with the ids of ``text`` as an array of integers."""

    def compute(column):
        ids, ends = encode_texts([t or "" for t in column.to_pylist()], path)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]

    return with_arrays(df, text, [(fresh(df, name), "array<int>")], compute, drop_text)


@functools.lru_cache(maxsize=2)
def _spelled(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids one after another, where each id's begin and how many it has; one more entry is empty."""
    v = bpe.vocabulary(path)
    ends = {i for t, i in v.ids.items() if v.suffix and t.endswith(v.suffix)}
    spelled = [b + b" " if i in ends else b for i, b in enumerate(v.bytes_of)] + [b""]
    sizes = np.array([len(b) for b in spelled], np.int64)
    return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``; special tokens are written out."""

    def compute(column):
        flat, starts, sizes = _spelled(path)
        rows = column.offsets.to_numpy().astype(np.int64)
        mine = column.values.slice(rows[0], rows[-1] - rows[0]).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        mine = np.where((mine < 0) | (mine >= len(sizes) - 1), len(sizes) - 1, mine)  # the last entry has no bytes
        # null rows keep their (empty) place in the offsets
        texts, step = [], 0
        rows = rows - rows[0]
        while step < len(column):
            stop = max(step + 1, int(np.searchsorted(rows, rows[step] + (4 << 20), side="right")) - 1)
            part = mine[rows[step] : rows[stop]]
            data = flat[bpe.ragged(starts[part], sizes[part])].tobytes()
            ends = np.concatenate(([0], np.cumsum(sizes[part])))[rows[step : stop + 1] - rows[step]].tolist()
            texts += [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            step = stop
        return [pa.array(texts, pa.string())]

    return with_arrays(df, ids, [(fresh(df, name), "string")], compute)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, drop_text=True)
    back = decode(coded, path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
