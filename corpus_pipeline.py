"""From raw documents to packed training sequences: language, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of their input. Null values in any column, empty and very
long texts, repeated rows and empty tables are defined by each operator; extra columns pass through untouched, also
where their names clash with names the operators use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.llm.common import saved, table
from memengine.llm.language_id import with_language
from memengine.llm.minhash_dedup import BROADCAST_IDS, duplicate_rows, words_keys
from memengine.llm.packing import pack_documents
from memengine.llm.quality_rules import with_outliers, with_text_counts

#: A text further than this from every profile is in no known language.
LEAST_LANGUAGE_SCORE = 0.15


def _wrapped(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator needs, and all others as one, so that their names can't clash; a text travels once."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(F.struct(*rest or [F.lit(None).alias("none")]).alias("row"), *needed)


def _unwrapped(df: DataFrame, like: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``like`` out of what came from ``_wrapped(like, *needed)``."""
    return df.select(*[F.col(c) if c in needed else F.col(f"row.`{c}`").alias(c) for c in like.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no profile comes near; profiles come from the labelled rows."""
    known = with_language(_wrapped(docs, "text"), docs.select("text", "lang"))
    return _unwrapped(known.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)), docs, "text")


def check_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or are outliers of their language and source."""
    counted = with_text_counts(_wrapped(docs, "text", "lang", "source"))
    return _unwrapped(with_outliers(counted).where("kept"), docs, "text", "lang", "source")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicate texts, one row with the smallest id; rows without an id or a word stay."""
    gone, again = (rows.toDF("gone_id", "gone_key") for rows in duplicate_rows(docs))
    wrapped = _wrapped(docs, "doc_id", "text")
    ids = saved(gone.unionByName(again).select("gone_id").distinct(), "pipeline-ids")
    few = ids.count() <= BROADCAST_IDS
    sized = lambda df: F.broadcast(df) if few else df.hint("merge")
    same_id = F.col("doc_id") == F.col("gone_id")
    # most ids have nothing to drop; of the others the words decide, as an id may have several texts
    clean = wrapped.join(sized(ids), same_id, "left_anti")
    keyed = words_keys(wrapped.join(sized(ids), same_id, "left_semi"))
    same = same_id & (F.col("words_key") == F.col("gone_key"))
    left = keyed.join(gone.hint("merge"), same, "left_anti")
    if not again.isEmpty():
        # equal rows of one id stand in for each other
        once = left.join(again.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "words_key"])
        left = left.join(again.hint("merge"), same, "left_anti").unionByName(once)
    left = clean.unionByName(left.drop("words_key"))
    return _unwrapped(left, docs, "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", check_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Profiles, robust covariances and packing have no SQL form; tests compare each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
