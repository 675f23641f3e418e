"""Token counts by rank-synchronous array merging.

Defined results: a null text counts as empty (0 tokens, 0 bytes); a text of white space only has 0 tokens under a
vocabulary that drops white space; special strings inside a text are one token each, as the library has it by
default; long texts are read whole, in chunks; repeated rows are counted each; an empty table gives an empty result;
columns of the input stay, added names that clash get underscores in front.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import fresh, table, with_arrays

LIMIT = 2048


def count_texts(texts: list[str], path: str) -> np.ndarray:
    v = bpe.vocabulary(path)
    return bpe.counted(v, bpe.RankSynchronousCounter(v), texts)


def with_token_counts(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens", drop_text: bool = False) -> DataFrame:
    """``df`` with the number of tokens of ``text`` under the vocabulary file at ``path``."""

    def compute(column):
        return [pa.array(count_texts([t or "" for t in column.to_pylist()], path), pa.int64())]

    return with_arrays(df, text, [(fresh(df, name), "bigint")], compute, drop_text)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), drop_text=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
