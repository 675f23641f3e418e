"""Column functions: text normalization, ids, token sets and similarity scores. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space (and the four separators that Python counts to it), for a character class.
#: Classes that Java looks up by property cost a fraction of unions of ranges, as each character takes one step a range.
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]+"
#: What is no part of a word of the reward normalization: punctuation and white space alike.
NO_WORD = r"[^\p{L}\p{N}_]+"
#: One character that the normalizations keep. A search for it ends at the first, so that whether a text is
#: blank costs no normalization, also where Spark works a condition out apart from the columns it names.
INK, WORD_CHAR = r"[^\s\p{Z}\x1c-\x1f\x85]", r"[\p{L}\p{N}_]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c) -> Column:
    """White space runs become one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), WHITE, " "))


def has_text(c) -> Column:
    """Whether ``normalize_text`` leaves anything."""
    return F.coalesce(_c(c), F.lit("")).rlike(INK)


def has_words(c) -> Column:
    """Whether ``tokens_reward`` has a token."""
    return F.lower(F.coalesce(_c(c), F.lit(""))).rlike(WORD_CHAR)


def canonicalize_name(c) -> Column:
    """Lower case, everything but a-z, 0-9 and CJK becomes ``_``; empty is ``unknown``."""
    # white space is among what becomes "_", so it needs no step of its own; the look-ahead passes most characters fast
    under = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"(?!\p{Alnum})[^a-z0-9一-鿿]+", "_")
    return F.coalesce(F.nullif(F.btrim(under, F.lit("_")), F.lit("")), F.lit("unknown"))


def stable_id(prefix: str, *parts) -> Column:
    """Prefix and 16 hex digits of SHA-1 over the parts; a null part reads ``None``."""
    texts = [F.coalesce(_c(p).cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("||", *texts).cast("binary")), 1, 16))


def weakness_id(record, question, failure, node_ids) -> Column:
    """Independent of the order of the node ids."""
    raw = F.concat_ws(":", _c(record), _c(question), _c(failure), F.array_join(F.array_sort(_c(node_ids)), "|"))
    return F.concat(F.lit("weak_"), F.substring(F.sha2(raw.cast("binary"), 256), 1, 8))


def normalize_for_reward(c) -> Column:
    """P5: lower case, punctuation becomes a space, white space collapses."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), NO_WORD, " "))


def _words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, " "), ""))


def tokens_ws(c) -> Column:
    """Distinct tokens between white space, case and punctuation kept (retrieval, grounding)."""
    return _words(normalize_text(c))


def tokens_reward(c) -> Column:
    """Distinct tokens of the reward normalization."""
    return _words(normalize_for_reward(c))


def once(value, f) -> Column:
    """``f`` of ``value``, which is worked out once a row, however often ``f`` names it: branches of a CASE share nothing."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sizes(a: Column, b: Column) -> Column:
    return F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("both"))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets: prediction, expected."""

    def score(n):
        p, r = n["both"] / n["a"], n["both"] / n["b"]
        return F.when(n["b"] == 0, F.when(n["a"] == 0, 1.0).otherwise(0.0)).when((n["a"] == 0) | (n["both"] == 0), 0.0).otherwise(2 * p * r / (p + r))

    return once(_sizes(a, b), score)


def token_f1(prediction, expected) -> Column:
    """P6."""
    return once(_pair(tokens_reward(prediction), tokens_reward(expected)), lambda t: set_f1(t["a"], t["b"]))


def set_jaccard(a: Column, b: Column) -> Column:
    def score(n):
        return F.when((n["a"] == 0) & (n["b"] == 0), 1.0).when((n["a"] == 0) | (n["b"] == 0), 0.0).otherwise(n["both"] / (n["a"] + n["b"] - n["both"]))

    return once(_sizes(a, b), score)


def token_jaccard(a, b) -> Column:
    """P7."""
    return once(_pair(tokens_reward(a), tokens_reward(b)), lambda t: set_jaccard(t["a"], t["b"]))


def answer_correctness(prediction, expected) -> Column:
    """Equal 1, one contains the other 0.75 (for an expected text of 10 characters or more), else F1."""

    def score(t):
        p, e = t["a"], t["b"]
        held = (F.length(e) >= 10) & (F.contains(p, e) | F.contains(e, p))
        return F.when(p == e, 1.0).when(held, 0.75).otherwise(once(_pair(_words(p), _words(e)), lambda w: set_f1(w["a"], w["b"])))

    empty = lambda c: F.coalesce(_c(c), F.lit("")) == ""
    return F.when(empty(expected) | empty(prediction), 0.0).otherwise(once(_pair(normalize_for_reward(prediction), normalize_for_reward(expected)), score))


def clamp(c, low: float = 0.0, high: float = 1.0) -> Column:
    """P9."""
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(c)))


def score_1_5(c, default: int) -> Column:
    """P10: half-even rounding to 1..5; what is no number gives the default."""
    v = F.bround(_c(c).cast("string").try_cast("double")).cast("int")
    return F.when(v.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), v)))


def finite_or_null(c) -> Column:
    """P12."""
    v = _c(c)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def checkpoint_id(role, policy, round_id, step_id, source) -> Column:
    """``role:policy:round000:step000:hash|none``."""
    tail = F.when(F.coalesce(_c(source), F.lit("")) == "", F.lit("none")).otherwise(F.substring(F.sha2(_c(source).cast("binary"), 256), 1, 8))
    return F.concat_ws(":", _c(role), _c(policy), F.format_string("round%03d", _c(round_id)), F.format_string("step%03d", _c(step_id)), tail)


def coalesce_truthy(*cols) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cols])


def clip(c, limit: int) -> Column:
    """At most ``limit`` characters, cut text ends in dots."""
    cut = lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))
    return normalize_text(c) if limit <= 0 else once(normalize_text(c), cut)


def unit_hash(*keys) -> Column:
    """A number in (0, 1] drawn from the keys; the same on every run and partitioning."""
    raw = F.concat_ws(":", *[_c(k).cast("string") for k in keys])
    twelve = F.conv(F.substring(F.sha2(raw.cast("binary"), 256), 1, 12), 16, 10).cast("long")
    return (twelve + 1) / F.lit(float(16**12 + 1))


def register_sql(spark) -> None:
    """The text and score functions as SQL functions of the session, written in SQL, so that plans stay native."""
    white, gone = (p.replace("\\", "\\\\") for p in (WHITE, NO_WORD))
    for text in (
        f"normalize_text(t STRING) RETURNS STRING RETURN trim(regexp_replace(coalesce(t, ''), '{white}', ' '))",
        f"normalize_for_reward(t STRING) RETURNS STRING RETURN trim(regexp_replace(lower(coalesce(t, '')), '{gone}', ' '))",
        "tokens_reward(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(array_remove(split(normalize_for_reward(t), ' '), ''))",
        "token_jaccard(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN size(array_union(tokens_reward(a), tokens_reward(b))) = 0 THEN 1.0D ELSE size(array_intersect(tokens_reward(a), tokens_reward(b))) / size(array_union(tokens_reward(a), tokens_reward(b))) END",
        "clamp01(x DOUBLE) RETURNS DOUBLE RETURN greatest(0.0D, least(1.0D, x))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
