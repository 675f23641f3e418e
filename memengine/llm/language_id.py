"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words padded) of a language, in
order of frequency. A document's own list is compared to every profile: the out-of-place distance adds, for each of
its n-grams, how far apart the two ranks are, and the full length of a profile where the profile lacks it.

Defined results:
* null text or a text without a letter: ``und`` with score 0; so is every text when no row is labelled;
* null labels are no training rows; labels, ids and all other columns never enter a prediction;
* ties between n-grams go to the smaller code, ties between languages to the alphabetically first;
* texts are read whole, whatever their length; repeated rows are scored each (and counted each in training);
* an empty table gives no rows; input columns stay, added names that clash get underscores in front.
The score is 1 minus the distance over its largest possible value for that document.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, fresh, mapped, table, with_arrays

PROFILE = 300
#: Labels are a closed set, so all profiles travel to every task. Of a label column with more values than this the
#: ones with the most rows are learned.
MAX_LABELS = 2000
HELD_OUT = 200_000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of the text, repeated as they occur; letters in lower case, anything else parts words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = np.where(_letters()[points], points, 0).astype(np.int64)
    padded = np.concatenate(([0], letters, [0]))
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    a = padded[keep]
    if len(a) < 3:
        return np.zeros(0, np.int64)
    letter = a > 0
    a = np.where(letter, a, 1)  # a pad of its own: with 0 in front a longer n-gram would have a shorter one's code
    two = (a[:-1] << 21) | a[1:]
    three = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    return np.concatenate((a[letter], two, three[letter[1:-1]]))


def top_grams(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in rank order."""
    codes, counts = np.unique(grams(text), return_counts=True)
    if len(codes) > size:
        # all that can be among the first by count, then the exact order
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.lexsort((codes, -counts))][:size]


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) summed in each task; a task holds one table of counts and passes it on when it grows large."""

    def run(batches):
        held: dict[str, list] = {}

        def merged():
            rows = []
            for label, parts in held.items():
                codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                rows.append((label, codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)))
            return rows

        def out(rows):
            for label, codes, n in rows:
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

        size, waiting = 0, {}
        for batch in batches:
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = grams(t)
                waiting.setdefault(label, []).append(g)
                size += len(g)
                if size > 1 << 21:
                    for k, gs in waiting.items():
                        held.setdefault(k, []).append(np.unique(np.concatenate(gs), return_counts=True))
                    waiting, size = {}, 0
                    rows = merged()
                    if sum(len(r[1]) for r in rows) > HELD_OUT:
                        yield from out(rows)
                        held = {}
                    else:
                        held = {k: [(c, n)] for k, c, n in rows}
        for k, gs in waiting.items():
            held.setdefault(k, []).append(np.unique(np.concatenate(gs), return_counts=True))
        yield from out(merged())

    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = mapped(rows, run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0): ``size`` rows a language at most."""
    labels = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).count()
    counts = gram_counts(df, text, lang)
    if labels.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        most = labels.orderBy(F.desc("count"), "lang").limit(MAX_LABELS).select("lang")
        counts = counts.join(F.broadcast(most), "lang", "left_semi")
    # a limit on the number itself lets every task drop all but its own first rows before the exchange
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return ranked.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class RankModel:
    """Profiles as arrays; at most ``MAX_LABELS`` languages of ``size`` n-grams, a bound on what tasks receive."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        at = {name: i for i, name in enumerate(self.langs)}
        for name, gram, rank in rows:
            self.ranks[at[name], np.searchsorted(self.codes, gram)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top_grams(text, self.size) if text else ()
        if not len(own) or not self.langs:
            return "und", 0.0
        spot = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        spot = np.where(self.codes[spot] == own, spot, len(self.codes))
        ranks = self.ranks[:, spot]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), self.size).sum(1)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.size * len(own)))


def with_language(df: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``df`` with the predicted language of ``text`` and its score, learned from ``text`` and ``lang`` of ``train``."""
    # MAX_LABELS times PROFILE rows at most
    model = RankModel([tuple(r) for r in profiles(train, text, lang).collect()])

    def compute(column):
        out = [model.predict(t.as_py()) for t in column]
        return [pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())]

    return with_arrays(df, text, [(fresh(df, pred), "string"), (fresh(df, score), "double")], compute)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.where(fold("doc_id", 3) != 1)
    out = with_language(docs.select("doc_id", "text"), train)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
