"""Quality rules: base counts of a text, and robust multivariate outliers by minimum covariance determinant.

``with_text_counts`` counts words, symbols, repeated lines and repeated three-word windows. ``with_outliers`` turns
them into variance-stabilized shares, estimates per (language, source) the centre and the covariance of the
half-plus subset of rows with the smallest determinant, and rejects rows whose squared Mahalanobis distance lies
beyond a chi-square quantile.

The estimate uses all rows. Every group has ``STARTS`` starts: medians with absolute deviations, and small subsets
drawn by hash. Each makes ``FIRST_STEPS`` concentration steps: distance of every row, the group's quantile of
distances (approximate, to 1 in 2000), mean and covariance of the rows below it. The start with the smallest
determinant goes on until no group's determinant falls any more. Each step is a Spark aggregation with partial sums,
so a group of any size needs no task of its own. As part of the method, groups under ``MIN_ROWS`` rows, too few for a
covariance of their own, use the estimate of their language, small languages that of all rows.

Defined results:
* null or empty text: all counts 0, ``base_failed`` true, not kept; it takes no part in any estimate;
* null language or source: a group of its own (together with the empty string);
* no row that passes the base rules, or an empty table: nothing to estimate, verdicts follow the base rules;
* a statistic without spread (most texts have no symbol): each scale has a floor, so covariances stay invertible;
* a row exactly at a quantile belongs to the subset, also where many rows tie;
* texts are read whole; repeated rows count each; input columns stay, added names that clash get underscores.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, table, with_arrays

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Smallest scale of each statistic, in its transformed unit, in the order of ``statistics``.
FLOORS = (0.08, 0.05, 0.20, 0.15, 0.05, 0.05)
SUPPORT = 0.6
STARTS = 3
START_ROWS = 60
FIRST_STEPS = 2
MOST_STEPS = 20
SETTLED = 1e-3
MIN_ROWS = 200
TAIL = 1e-6
BROADCAST_GROUPS = 20_000


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return 0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0, 0, 0, 0
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    n = len(words)
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        m = len(numbers)
        pair = at[:-1] * m + at[1:]
        if m > 1 << 20:
            pair, m2 = np.unique(pair, return_inverse=True)[1], m
        else:
            m2 = m
        window = pair[:-1] * m2 + at[2:]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(window)] |= twice
        repeated = int(covered.sum())
    gone = lambda marks: len(data) - len(data.translate(None, marks))
    return n, len(text) - gone(SPACE), gone(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), gone(UPPER), gone(MARKS)


def with_text_counts(df: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``df`` with ``COUNTS`` of ``text``."""

    def compute(column):
        rows = [text_counts(t.as_py()) for t in column]
        return [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]

    return with_arrays(df, text, [(fresh(df, c), "bigint") for c in COUNTS], compute, drop_text)


def base_failed(of=F.col):
    """``of`` gives the column of a count by its name."""
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def statistics(of=F.col):
    """The vector of a row: log of the mean word length, and square roots of shares, which have an even spread."""
    chars, words, lines = (F.greatest(of(c), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    share = lambda c, d: F.sqrt(of(c) / d)
    return [
        F.log(chars / words),
        share("n_symbols", chars),
        share("n_dup_lines", lines),
        share("n_repeat_words", words),
        share("n_upper", chars),
        share("n_marks", chars),
    ]


def chi_square(x: float, k: int) -> float:
    """Distribution function of chi-square with ``k`` degrees of freedom (series of the incomplete gamma)."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 1000):
        term *= x / (a + i)
        total += term
        if term < total * 1e-14:
            break
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    """Its inverse by Wilson and Hilferty, from the upper tail ``1 - p`` given as is when ``p`` is below 0.5."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def consistency(support: float, k: int) -> float:
    """How much the covariance of the ``support`` closest rows of a normal sample falls short."""
    cut = chi_square_quantile(support, k)
    return support / chi_square(cut, k + 2)


def _precision(frames):
    """Rows (g, start, size, used, sums, squares) to (g, start, size, mean, precision, logdet)."""
    p = len(FLOORS)
    ridge, factor = np.diag(np.square(FLOORS)), consistency(SUPPORT, p)
    for frame in frames:
        means, inverses, dets = [], [], []
        for n, s, q in zip(frame["used"], frame["sums"], frame["squares"], strict=True):
            mean = np.array(s, float) / n
            cov = np.zeros((p, p))
            cov[np.triu_indices(p)] = np.array(q, float) / n
            cov = (cov + np.triu(cov, 1).T - np.outer(mean, mean)) * factor + ridge
            means.append(mean.tolist())
            inverses.append(np.linalg.inv(cov).ravel().tolist())
            dets.append(float(np.linalg.slogdet(cov)[1]))
        yield pd.DataFrame({"g": frame["g"], "start": frame["start"], "size": frame["size"], "mean": means, "precision": inverses, "logdet": dets})


MODEL = "g string, start int, size bigint, mean array<double>, precision array<double>, logdet double"


def _estimate(used: DataFrame) -> DataFrame:
    """``MODEL`` of rows (g, start, size, x0, ..)."""
    p = len(FLOORS)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = used.groupBy("g", "start").agg(
        F.first("size").alias("size"),
        F.count(F.lit(1)).alias("used"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in upper],
    )
    sums = sums.select("g", "start", "size", "used", F.array(*[f"s{i}" for i in range(p)]).alias("sums"), F.array(*[f"q{i}_{j}" for i, j in upper]).alias("squares"))
    return sums.mapInPandas(_precision, MODEL)


def concentrated(stats: DataFrame, model: DataFrame, groups: int) -> DataFrame:
    """One concentration step from every row of ``model``, written."""
    p = len(FLOORS)
    keys = ["g", "start"]
    near = _joined(stats, model.select("g", "start", "size", "mean", "precision"), groups).select(*keys, "size", *[f"x{i}" for i in range(p)], _distance(p).alias("d2"))
    cuts = saved(near.groupBy(*keys).agg(F.percentile_approx("d2", SUPPORT, 2000).alias("cut")), "mcd-cut")
    used = near.join(F.broadcast(cuts) if groups <= BROADCAST_GROUPS else cuts.hint("merge"), keys).where(F.col("d2") <= F.col("cut"))
    return saved(_estimate(used), "mcd-step")


def least_determinant(model: DataFrame) -> DataFrame:
    """Of each group the row with the smallest determinant, the first start of equal ones."""
    return model.groupBy("g").agg(F.min_by(F.struct("start", "size", "mean", "precision", "logdet"), F.struct("logdet", "start")).alias("m")).select("g", "m.*")


def _joined(rows: DataFrame, model: DataFrame, groups: int) -> DataFrame:
    """Every row with the numbers of its group; beyond a bound of groups by a sort-merge join, whose hot keys the
    adaptive planner splits."""
    return rows.join(F.broadcast(model) if groups <= BROADCAST_GROUPS else model.hint("merge"), "g")


def _distance(p: int):
    """Squared Mahalanobis distance of x0.. to ``mean`` under ``precision``."""
    diff = [F.col(f"x{i}") - F.col("mean")[i] for i in range(p)]
    out = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            out = out + (1 if i == j else 2) * F.col("precision")[i * p + j] * diff[i] * diff[j]
    return out


def fit(stats: DataFrame) -> tuple[DataFrame, int]:
    """``MODEL`` with one row for every group of ``stats`` (g, x0, x1, ...), and the number of groups."""
    p = len(FLOORS)
    xs = [f"x{i}" for i in range(p)]
    first = stats.groupBy("g").agg(F.count(F.lit(1)).alias("size"), *[F.percentile_approx(x, 0.5, 2000).alias(f"m{x}") for x in xs])
    first = saved(first.where(F.col("size") >= MIN_ROWS).select("g", "size", F.array(*[f"m{x}" for x in xs]).alias("mean")), "mcd-medians")
    groups = first.count()
    away = _joined(stats, first, groups).groupBy("g").agg(
        F.first("size").alias("size"), F.first("mean").alias("mean"), *[F.percentile_approx(F.abs(F.col(x) - F.col("mean")[i]), 0.5, 2000).alias(f"d{x}") for i, x in enumerate(xs)]
    )
    diagonal = [F.lit(0.0)] * (p * p)
    for i, x in enumerate(xs):
        diagonal[i * p + i] = 1 / (F.pow(1.4826 * F.col(f"d{x}"), 2) + FLOORS[i] ** 2)
    model = away.select("g", F.lit(0).alias("start"), "size", "mean", F.array(*diagonal).alias("precision"), F.lit(0.0).alias("logdet"))
    if STARTS > 1:
        # about START_ROWS rows of a group for each further start
        sized = _joined(stats, first.select("g", "size"), groups).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
        drawn = sized.where(F.pmod(F.xxhash64("start", *xs), F.lit(1 << 30)) < F.lit(float(START_ROWS << 30)) / F.col("size"))
        model = model.unionByName(_estimate(drawn))
    model = saved(model, "mcd-starts")
    for _ in range(FIRST_STEPS):
        model = concentrated(stats, model, groups)
    best = saved(least_determinant(model), "mcd-best")
    for _ in range(MOST_STEPS - FIRST_STEPS):
        after = concentrated(stats, best, groups)
        both = best.unionByName(after.withColumn("start", F.lit(STARTS)))
        falls = best.select("g", "logdet").join(after.select("g", F.col("logdet").alias("now")).hint("merge"), "g").agg(F.max(F.col("logdet") - F.col("now"))).first()[0]
        best = saved(least_determinant(both), "mcd-best")
        if falls is None or falls < SETTLED:
            break
    return best, groups


def with_outliers(counted: DataFrame, lang: str = "lang", source: str = "source", counts: list[str] = COUNTS) -> DataFrame:
    """``counted`` with ``base_failed``, the distance ``d2``, the ``fitted_on`` group and ``kept``. ``counts`` names its
    columns of ``COUNTS``."""
    p = len(FLOORS)
    sep = "\x1f"
    name = dict(zip(COUNTS, counts, strict=True))
    of = lambda c: F.col(f"`{name[c]}`")
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    fine, mid = F.concat_ws(sep, F.lit("s"), part(lang), part(source)), F.concat_ws(sep, F.lit("l"), part(lang))
    # the whole row is one column from here on, so that its names can't clash
    rows = counted.select(F.struct(*[F.col(f"`{c}`") for c in counted.columns]).alias("row"), base_failed(of).alias("failed"), fine.alias("fine"), mid.alias("mid"), *[x.alias(f"x{i}") for i, x in enumerate(statistics(of))])
    stats = saved(rows.where("not failed").select(F.array("fine", "mid", F.lit("all")).alias("levels"), *[f"x{i}" for i in range(p)]), "mcd-stats")
    model, groups = fit(stats.select(F.explode("levels").alias("g"), *[f"x{i}" for i in range(p)]))
    model = saved(model.select("g", "mean", "precision"), "mcd-model")
    whole = model.where("g = 'all'").first()  # one row at most
    verdicts = rows
    for level in ("fine", "mid"):
        named = model.select(F.col("g").alias(level), F.struct("g", "mean", "precision").alias(f"{level}_model"))
        verdicts = verdicts.join(F.broadcast(named) if groups <= BROADCAST_GROUPS else named.hint("merge"), level, "left")
    # without an estimate all distances are null
    doubles = lambda v: F.array(*[F.lit(float(x)) for x in v])
    last = F.struct(F.lit("all").alias("g"), doubles(whole["mean"]).alias("mean"), doubles(whole["precision"]).alias("precision")) if whole else F.lit(None).cast("struct<g:string,mean:array<double>,precision:array<double>>")
    verdicts = verdicts.select("row", "failed", *[f"x{i}" for i in range(p)], F.coalesce("fine_model", "mid_model", last).alias("m")).select("row", "failed", *[f"x{i}" for i in range(p)], "m.*")
    cutoff = chi_square_quantile(1 - TAIL, p)
    added = [fresh(counted, c) for c in ("base_failed", "d2", "fitted_on", "kept")]
    return verdicts.select(
        *[F.col(f"row.`{c}`").alias(c) for c in counted.columns],
        F.col("failed").alias(added[0]),
        F.when(~F.col("failed"), _distance(p)).alias(added[1]),
        F.regexp_replace("g", sep, "/").alias(added[2]),
        (~F.col("failed") & F.coalesce(_distance(p) <= cutoff, F.lit(True))).alias(added[3]),
    )


def with_quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` with ``COUNTS`` of ``text`` and the columns of ``with_outliers``. Counts are made once and written, as
    the fit reads them often."""
    counts = [fresh(df, c) for c in COUNTS]
    return with_outliers(saved(with_text_counts(df, text), "quality-counts"), lang, source, counts)


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, verdict) for ``documents``."""
    counted = with_text_counts(docs.select("doc_id", "lang", "source", "text"), drop_text=True)
    return with_outliers(saved(counted, "quality-counts"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "d2", "fitted_on")
