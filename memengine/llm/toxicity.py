"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed and of a learned lexicon (whole words and stems), how near hits stand to a
second-person word, shares of capitals and of marks, and how often a lexicon word shows only once look-alike
characters are undone. The learned lexicon, the trees and the calibration each learn from labelled rows of their own
part (by a hash of the id), so no part judges rows it has learned from. Each part uses ``SAMPLE_ROWS`` labelled rows
at most, chosen by hash: that bound is the documented limit of what a classifier is fitted on. Features and scores
cover every row and the whole text.

Defined results:
* null or empty text: the features of no words, scored like any other;
* labels that are null or neither 0 nor 1, and rows without an id, teach nothing; several labels of one id: the
  largest counts;
* too few rows of a class to learn from: every row gets the share of toxic labels (0 without labels);
* repeated rows are scored each; an empty table gives no rows; added names that clash get underscores in front.
"""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, fresh, memo, saved, table, with_arrays

#: Common insults, second-person words of four languages, look-alike characters.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool foolish ugly hate jerk pig bastard crap shut vermin filth imbecile cretin".split())
SECOND_PERSON = frozenset("you your yours yourself u ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros vuestro".split())
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

SAMPLE_ROWS = 40_000
LEXICON_TERMS = 3000
STEMS = range(4, 8)
NEAR = 5
TREES, DEPTH, STEP = 20, 3, 0.25
LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = ["fixed_density", "learned_density", "stem_density", "largest_weight", "log_hits", "near_you", "capitals", "exclamations", "marks", "obfuscated", "symbols", "log_words"]


def lexicon_counts(df: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many texts of each class of (text, label) a word or stem occurs."""

    def run(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(LETTERS.findall((text or "").lower()))
                for term in {f"w{w}" for w in words} | {f"s{w[:k]}" for w in words for k in STEMS if len(w) > k}:
                    held.setdefault(term, [0, 0])[label] += 1
            if len(held) > 300_000:
                yield rows(held)
                held = {}
        yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())],
            names=["term", "toxic", "clean"],
        )

    parts = df.select("text", "label").mapInArrow(run, "term string, toxic bigint, clean bigint")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learned_lexicon(df: DataFrame) -> dict[str, float]:
    """Terms whose log-odds for the toxic class stay over 1 at 2.5 standard errors below; ``LEXICON_TERMS`` at most."""
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    low = odds - 2.5 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = lexicon_counts(df).where(F.col("toxic") >= 3).select("term", odds.alias("odds"), low.alias("low")).where("low > 1")
    return {r["term"]: r["odds"] for r in best.orderBy(F.desc("low"), "term").limit(LEXICON_TERMS).collect()}


class Features:
    """Feature vectors of texts under one lexicon; what a chunk of text contributes is remembered, within a bound."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {t[1:]: v for t, v in lexicon.items() if t[0] == "w"}
        self.stems = {t[1:]: v for t, v in lexicon.items() if t[0] == "s"}
        self.key = ("toxicity", hash(frozenset(lexicon.items())))

    def _word(self, w: str) -> tuple[int, float, float] | None:
        fixed, learned = w in INSULTS, self.words.get(w, 0.0)
        stem = max((self.stems.get(w[:k], 0.0) for k in STEMS if len(w) > k), default=0.0) if self.stems else 0.0
        return (int(fixed), learned, stem) if fixed or learned or stem else None

    def _chunk(self, c: str):
        """None for most chunks; True for a second-person word; else (fixed, learned, stem, obfuscated)."""
        parts = LETTERS.findall(c)
        hits = [h for h in map(self._word, parts) if h]
        if hits:
            return max(h[0] for h in hits), max(h[1] for h in hits), max(h[2] for h in hits), 0
        if any(p in SECOND_PERSON for p in parts):
            return True
        if parts and (len(parts) > 1 or len(parts[0]) < len(c)):
            plain = "".join(LETTERS.findall(c.strip(".,!?;:\"'()").translate(LOOKALIKE)))
            hit = self._word(plain) if plain not in parts else None
            if hit and (hit[0] or hit[1]):
                return *hit, 1
        return None

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        chunks = text.lower().split()
        n = len(chunks)
        known = memo(*self.key)
        for c in known.room_for(set(chunks)):
            known[c] = self._chunk(c)
        found = [(i, k) for i, k in enumerate(map(known.__getitem__, chunks)) if k is not None]
        you = [i for i, k in found if k is True]
        hits = [(i, k) for i, k in found if k is not True]
        near, at = 0, 0
        for i, _ in hits:
            while at < len(you) and you[at] < i - NEAR:
                at += 1
            near += at < len(you) and you[at] <= i + NEAR
        data, size, words = text.encode("utf-8", "replace"), max(1, len(text)), max(1, n)
        rate = lambda marks: (len(data) - len(data.translate(None, marks))) / size
        return [
            100 * sum(k[0] for _, k in hits) / words,
            100 * sum(k[1] for _, k in hits) / words,
            100 * sum(k[2] for _, k in hits) / words,
            max((max(k[1], k[2], 5.0 * k[0]) for _, k in hits), default=0.0),
            math.log1p(len(hits)),
            math.log1p(near),
            rate(bytes(range(65, 91))),
            rate(b"!"),
            rate(b".,;:?'\"-()"),
            100 * sum(k[3] for _, k in hits) / words,
            rate(b"#*$%&|<>"),
            math.log1p(n),
        ]


@functools.lru_cache(maxsize=2)
def _features(items: tuple) -> Features:
    return Features(dict(items))


def with_features(df: DataFrame, lexicon: dict[str, float], text: str = "text", name: str = "features", drop_text: bool = False) -> DataFrame:
    """``df`` with the vector of ``FEATURES`` as an array of doubles."""
    items = tuple(sorted(lexicon.items()))

    def compute(column):
        f = _features(items)
        return [pa.array([f.of(t) for t in column.to_pylist()], pa.list_(pa.float64()))]

    return with_arrays(df, text, [(fresh(df, name), "array<double>")], compute, drop_text)


def _chosen(rows: DataFrame, most: int):
    """A condition on doc_id that holds for all of ``rows``, or by a hash for about ``most`` of them."""
    n = rows.count()
    return F.lit(True) if n <= most else F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30))


def part_of(column: str = "doc_id"):
    """0 and 1: lexicon, 2: trees, 3: calibration."""
    return F.pmod(F.xxhash64(column, F.lit("part")), F.lit(4))


def with_toxicity(docs: DataFrame, labels: DataFrame, score: str = "score") -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, label)."""
    docs = docs.select("doc_id", "text")
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = saved(known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), "toxicity-labels")

    def part(condition, rows, label):
        # the condition is on the id alone, so it thins the wide side before the exchange
        mine = condition & _chosen(ids.where(condition), SAMPLE_ROWS)
        return saved(rows.where(mine).join(ids.where(mine).hint("shuffle_hash"), "doc_id").drop("doc_id"), label)

    lexicon = learned_lexicon(part(part_of() < 2, docs, "toxicity-lexicon"))
    vectors = saved(with_features(docs, lexicon, drop_text=True), "toxicity-features")
    share = ids.agg(F.avg("label")).first()[0] or 0.0
    flat = vectors.select("doc_id", array_to_vector("features").alias("features"))
    trees, calibration = (part(part_of() == k, flat, f"toxicity-part{k}").select("features", F.col("label").cast("double").alias("label")).coalesce(6) for k in (2, 3))
    few = min([len(trees.where(F.col("label") == y).limit(3).collect()) for y in (0, 1)])
    if few < 3:
        return vectors.select("doc_id", F.lit(float(share)).alias(score))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=7, maxMemoryInMB=128)
    model = gbt.fit(trees)

    def raw(df):
        return model.transform(df).withColumn("raw", vector_to_array("probability")[1])

    scored = raw(flat).select("doc_id", "raw")
    held = raw(calibration).select("raw", "label")
    if held.agg(F.countDistinct("label")).first()[0] < 2:
        return scored.select("doc_id", F.col("raw").alias(score))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(held)
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))
    # the steps of the calibration are flat; a thousandth of the trees' own probability keeps the order inside one
    return steps.transform(scored).select("doc_id", (0.999 * level + 0.001 * F.col("raw")).alias(score))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    out = with_toxicity(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
