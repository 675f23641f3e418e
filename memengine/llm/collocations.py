"""Phrase collocations from a weighted de Bruijn graph of words.

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Edges of the graph are
the longest grams (four words), nodes their first and last three. Every word that a phrase may start at starts one edge;
where the piece ends sooner, the edge is filled up with ``END`` and is the piece-end correction. So only edges are
counted, and all shorter counts follow: a gram of three words occurs as often as the edges that leave its node, one of
two words as often as the three-word grams that begin with it, a word as often as its two-word grams.

A word that occurs less often than a candidate has to can be in no candidate, so it ends a piece. What is left of
the graph after edges under the minimum went is compacted: edges that follow one another without a branch and with
one weight become a path (``unary_paths``), which shows repeated passages whole.

Words travel as numbers. Blocks of a MB of text hold their words as a list of their own, so the table of frequent
words is joined to (block, word) rows, which grow with the text and never with a word's count, and is never broadcast.

Defined results: a null text is empty; a null language is ``und``, together with rows of that language; ids and other
columns play no part; repeated rows count each; long texts are read whole, in several blocks; an empty table gives an
empty result; ties are broken as the columns say.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, mapped, numbered, saved, table

#: Words of the longest grams.
ORDER = 4
#: Bytes of text that a block holds. A block is a row: smaller ones keep rows, pages and batches small in every step.
BLOCK_BYTES = 1 << 20
#: Blocks of a file.
FILE_BLOCKS = 4
#: Number of no word: the piece ends here.
END = 0

_SPACE, _CUT = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def cut_words(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased UTF-8 text, and for each whether a piece ends after it."""
    flat = _LOWER[np.frombuffer(data, np.uint8)]
    kind = _CLASS[flat]
    inside = kind == 0
    first = np.nonzero(inside & np.r_[True, ~inside[:-1]])[0] if len(flat) else np.zeros(0, np.int64)
    last = np.nonzero(inside & np.r_[~inside[1:], True])[0] if len(flat) else first
    cuts = np.cumsum(kind == _CUT)
    if not len(first):
        return pa.array([], pa.string()), np.zeros(0, bool)
    ends = np.r_[cuts[first[1:]] > cuts[last[:-1]], True]
    offsets = np.r_[0, np.cumsum(last - first + 1)]
    kept = flat[inside]
    words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)])
    return words, ends


def _split_long(data: bytes):
    """Parts of at most about BLOCK_BYTES, cut where a piece ends; a longer piece stays whole."""
    start = 0
    while len(data) - start > BLOCK_BYTES:
        window = _CLASS[np.frombuffer(data, np.uint8, offset=start + BLOCK_BYTES // 2)]
        at = np.flatnonzero(window == _CUT)[:1]
        if not len(at):
            break
        stop = start + BLOCK_BYTES // 2 + int(at[0])
        yield data[start:stop]
        start = stop
    yield data[start:]


BLOCK_SCHEMA = "block bigint, lang string, words array<string>, counts array<bigint>, codes array<int>"


def blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row per block of text of one language: its distinct words, how often each occurs, and its words in order as
    numbers from 1 into that list, with 0 where a piece ends."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size = dict.fromkeys(held, 0)

        def emit(name):
            nonlocal number
            words, ends = cut_words(b"\n".join(held.pop(name)))
            size.pop(name)
            if not len(words):
                return
            coded = words.dictionary_encode()
            del words
            codes = coded.indices.to_numpy().astype(np.int32) + 1
            counts = np.bincount(codes, minlength=len(coded.dictionary) + 1)[1:]
            codes = np.insert(codes, np.flatnonzero(ends) + 1, END)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([name]), one(coded.dictionary, pa.string()), one(pa.array(counts), pa.int64()), one(pa.array(codes), pa.int32())],
                names=["block", "lang", "words", "counts", "codes"],
            )
            number += 1

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                for part in _split_long(data):
                    held.setdefault(name, []).append(part)
                    size[name] = size.get(name, 0) + len(part) + 1
                    if size[name] >= BLOCK_BYTES:
                        yield from emit(name)
            # many languages at once: the largest goes first
            while sum(size.values()) >= 2 * BLOCK_BYTES:
                yield from emit(max(size, key=size.get))
        for name in list(held):
            yield from emit(name)

    return mapped(docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")), run, BLOCK_SCHEMA)


def frequent_words(texts: DataFrame, least: int) -> DataFrame:
    """(word_id, lang, word, n): the words that occur ``least`` times or more in their language."""
    words = texts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return saved(numbered(often, "word_id", "collocation-counts"), "collocation-words")


def edges(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(head, tail, weight): all edges of the graph of ``texts``, which are removed; ``head`` holds the numbers of the first and second word, ``tail``
    those of the third and fourth, 32 bits each."""
    asked = texts.select("block", "lang", F.posexplode("words").alias("at", "word"))
    found = asked.hint("merge").join(words.select("lang", "word", "word_id").hint("merge"), ["lang", "word"])
    found = found.groupBy("block").agg(F.collect_list(F.struct("at", F.col("word_id").cast("int").alias("id"))).alias("found"))
    # written before edges are counted, so that neither the blocks nor what was shuffled for this lies on disk by then
    ready = saved(texts.select("block", "codes").hint("merge").join(found.hint("merge"), "block").select("codes", "found"), "collocation-texts", FILE_BLOCKS)
    dropped(texts)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                codes = batch.column(0)[k].values.to_numpy()
                pairs = batch.column(1)[k].values
                ids = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
                ids[pairs.field("at").to_numpy() + 1] = pairs.field("id").to_numpy()
                w = np.concatenate((ids[codes], np.zeros(ORDER, np.int64)))
                n = len(codes)
                grams = [w[:n]]
                for j in range(1, ORDER):
                    grams.append(np.where(grams[-1] == END, END, w[j : n + j]))
                start = grams[0] != END
                head = (grams[0][start] << 32) | grams[1][start]
                tail = (grams[2][start] << 32) | grams[3][start]
                del w, grams, codes
                order = np.lexsort((tail, head))
                head, tail = head[order], tail[order]
                new = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]) if len(head) else np.zeros(0, np.int64)
                weight = np.diff(np.r_[new, len(head)])
                for s in range(0, len(new), 1 << 16):
                    at = new[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(head[at]), pa.array(tail[at]), pa.array(weight[s : s + (1 << 16)])], names=["head", "tail", "weight"])

    counted = mapped(ready, run, "head bigint, tail bigint, weight bigint")
    out = saved(counted.groupBy("head", "tail").agg(F.sum("weight").alias("weight")), "collocation-edges")
    dropped(ready)
    return out


def _first(column):
    return F.shiftright(column, 32).cast("int")


def _second(column):
    return F.col(column).bitwiseAND(0xFFFFFFFF).cast("int")


def phrases(graph: DataFrame, least: int) -> DataFrame:
    """(ids, f): all phrases of 1 to ORDER frequent words with ``f`` of ``least`` or more, shorter ones by node flow."""
    third = _first("tail")
    flow3 = saved(graph.groupBy("head", third.alias("third")).agg(F.sum("weight").alias("f")), "collocation-nodes")
    flow2 = saved(flow3.groupBy("head").agg(F.sum("f").alias("f")), "collocation-pairs")
    flow1 = flow2.groupBy(_first("head").alias("word")).agg(F.sum("f").alias("f"))
    often = F.col("f") >= least
    four = graph.where((_second("tail") != END) & (F.col("weight") >= least)).select(F.array(_first("head"), _second("head"), third, _second("tail")).alias("ids"), F.col("weight").alias("f"))
    three = flow3.where((F.col("third") != END) & often).select(F.array(_first("head"), _second("head"), "third").alias("ids"), "f")
    two = flow2.where((_second("head") != END) & often).select(F.array(_first("head"), _second("head")).alias("ids"), "f")
    one = flow1.where(often).select(F.array("word").alias("ids"), "f")
    out = saved(four.unionByName(three).unionByName(two).unionByName(one), "collocation-phrases")
    dropped(flow3, flow2)
    return out


def unary_paths(counts: DataFrame) -> DataFrame:
    """(ids, path, place, edges): for every edge among the phrases of ORDER words the path that it lies on.

    An edge is followed by another where the node between has that one edge out, this one edge in, and both weigh the
    same. Each edge looks at its successor, then at the successor's successor, and so on: as many rounds as the longest
    path has binary digits. A ring has no end; its edges keep looking round, so the smallest stands for it."""
    graph = counts.where(F.size("ids") == ORDER).select("ids", "f")
    ends = graph.select("ids", "f", F.slice("ids", 1, ORDER - 1).alias("out_of"), F.slice("ids", 2, ORDER - 1).alias("into"))
    leaving = ends.groupBy("out_of").agg(F.count(F.lit(1)).alias("n"), F.first("ids").alias("next"), F.first("f").alias("g")).where("n = 1").drop("n")
    entering = ends.groupBy("into").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    through = entering.hint("merge").join(leaving.hint("merge"), F.col("into") == F.col("out_of")).select("into", "next", "g")
    link = F.when((F.col("g") == F.col("f")), F.col("next"))
    # ``last`` is the furthest edge known, ``least`` the smallest on the way, ``steps`` how far it is
    now = ends.hint("merge").join(through.hint("merge"), "into", "left").select("ids", link.alias("next"))
    now = saved(now.select("ids", "next", F.coalesce("next", "ids").alias("last"), F.least("ids", F.coalesce("next", "ids")).alias("low"), F.col("next").isNotNull().cast("bigint").alias("steps")), "collocation-paths")
    open_before = -1
    while True:
        still = now.where("next is not null").count()
        if still in (0, open_before):
            break
        open_before = still
        far = now.select(F.col("ids").alias("next"), F.col("next").alias("next2"), F.col("last").alias("last2"), F.col("low").alias("low2"), F.col("steps").alias("steps2"))
        after = now.hint("merge").join(far.hint("merge"), "next", "left")
        more = saved(after.select("ids", F.col("next2").alias("next"), F.coalesce("last2", "last").alias("last"), F.least("low", F.coalesce("low2", "low")).alias("low"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")), "collocation-paths")
        dropped(now)
        now = more
    ring = F.col("next").isNotNull()
    labelled = now.select("ids", F.when(ring, F.col("low")).otherwise(F.col("last")).alias("path"), F.when(ring, F.lit(0)).otherwise(F.col("steps")).alias("to_end"))
    sizes = labelled.groupBy("path").agg(F.count(F.lit(1)).alias("edges"))
    return labelled.hint("merge").join(sizes.hint("merge"), "path").select("ids", "path", (F.col("edges") - 1 - F.col("to_end")).alias("place"), "edges")


def scored(counts: DataFrame) -> DataFrame:
    """(ids, a, l, r, score) of the phrases of two words or more, by their lowest-scoring cut. Scores are exact: sums and
    products are decimals that hold any count of 64 bits."""
    long = counts.where(F.size("ids") > 1)
    cut = long.select("ids", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    side = lambda s, part: F.struct(F.lit(s).alias("side"), part.alias("part"))
    left, right = F.expr("slice(ids, 1, k)"), F.expr("slice(ids, k + 1, size(ids) - k)")
    parts = cut.select("ids", "a", "k", F.explode(F.array(side("l", left), side("r", right))).alias("s")).select("ids", "a", "k", "s.*")
    known = parts.hint("merge").join(counts.select(F.col("ids").alias("part"), "f").hint("merge"), "part")
    cuts = known.groupBy("ids", "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return cuts.groupBy("ids", "a").agg(lowest).select("ids", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to four words of each language (lang, rank, phrase, a, l, r, n, score, path_words).

    A phrase inside a longer one that has at least ``share`` hundredths of its count is left out. ``path_words`` is the
    number of words of the longest compacted path that holds the phrase; null where none does."""
    texts = saved(blocks(docs, text, lang), "collocation-blocks", FILE_BLOCKS)
    totals = saved(texts.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("n")), "collocation-totals")
    words = frequent_words(texts, least)
    graph = edges(texts, words)
    counts = phrases(graph, least)
    dropped(graph)
    # what lies in a longer phrase, and how often that one occurs
    longer = counts.where(F.size("ids") > 2).hint("merge").join(unary_paths(counts).select("ids", (F.col("edges") + (ORDER - 1)).alias("path_words")).hint("merge"), "ids", "left")
    spans = F.expr("flatten(transform(sequence(2, size(ids)), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")
    inner = longer.select(F.explode(spans).alias("inner"), F.when(F.size("ids") > F.size("inner"), F.col("f")).alias("over"), "path_words")
    inner = inner.groupBy("inner").agg(F.max("over").alias("over"), F.max("path_words").alias("path_words"))
    wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(5,0)")
    kept = scored(counts).hint("merge").join(inner.withColumnRenamed("inner", "ids").hint("merge"), "ids", "left")
    kept = saved(kept.where(F.col("over").isNull() | (wide("over", 100) < wide("a", share))).drop("over"), "collocation-kept")
    named = kept.select("*", F.posexplode("ids").alias("at", "word_id")).hint("merge").join(words.select(F.col("word_id").cast("int").alias("word_id"), "lang", "word").hint("merge"), "word_id")
    spelled = named.groupBy("ids", "a", "l", "r", "score", "path_words", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.hint("merge").join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("path_words").cast("long").alias("path_words"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("path_words")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM pieces, (VALUES (1), (2), (3), (4)) AS sizes(m)
), f AS (SELECT lang, m, g, count(*)::HUGEINT AS a FROM grams GROUP BY lang, m, g HAVING count(*) >= 30),
cand AS (SELECT lang, m, g, a, string_split(g, ' ') AS w FROM f WHERE m >= 2),
cuts AS (
  SELECT c.lang, c.g, c.m, c.a, k, fl.a AS l, fr.a AS r, (2000000::HUGEINT * c.a) // (fl.a + fr.a) AS score
  FROM cand c, (VALUES (1), (2), (3)) AS ks(k), f fl, f fr
  WHERE k < c.m AND fl.lang = c.lang AND fl.g = array_to_string(c.w[1:k], ' ') AND fr.lang = c.lang AND fr.g = array_to_string(c.w[k + 1:c.m], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f p WHERE p.lang = b.lang AND p.m > b.m AND contains(' ' || p.g || ' ', ' ' || b.g || ' ') AND 100 * p.a >= 80 * b.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
