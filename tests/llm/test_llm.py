"""Training-data operators against the library, brute force, round trips and held-out accuracy on small fixtures."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memengine.llm import bpe, bpe_codec, embedding_graph, language_id, minhash_dedup, packing, ppm_scoring, quality_rules, sharding, token_counts, toxicity
from memengine.llm.components import components

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "   ", " a  b", "<|endoftext|> hi<|endoftext|>x  <|endoftext|>", "it's I'LL  don't\n\n\tx", "ΣΑΣ Σ.", "café İs.\n\n\nx", "\x1c\x1d a\x85b", "日本語" * 90, "a" * 700, "12 3a8, b. c.\nd",
    "!!??..#@ $$", "😀😀", "a.\n\n\n", "word, word. Word!!, x_. y", "\x00 a, b",
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def lists(coded):
    ids, ends = coded
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fuzzed(n=400):
    rng = np.random.default_rng(12)
    bits = ["a", "Bc", "é", "é", "Σ", "ß", "İ", "don't", "12", "3", ".", ",", "!?", "\n", "\t", " ", " ", "  ", "\u00a0", "\u2003", "\x85", "<|endoftext|>", "<", "日本", "😀", "'s", "-", "x" * 250, "\x1c", "\0"]
    return ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_merges_equal_the_library(monkeypatch, part):
    monkeypatch.setattr(bpe, "PART_CHARS", part)
    texts = [*ODD, *fuzzed(), *ODD[::-1]]
    assert lists(bpe_codec.encode_texts(texts, BYTE)) == library(BYTE, texts)
    want = library(WORD, texts)
    assert token_counts.count_texts(texts, WORD).tolist() == [len(w) for w in want]
    assert lists(packing.token_ids(texts, WORD, 2)) == [w + [2] for w in want]


def test_codec_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None])], "doc_id int, text string, ids string")
    coded = bpe_codec.encode(df, BYTE)
    assert coded.columns == ["doc_id", "text", "ids", "_ids"]
    rows = bpe_codec.decode(coded, BYTE, ids="_ids").collect()
    assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == len(ODD) + 1
    assert bpe_codec.encode(df.where("false"), BYTE).count() == 0


def test_token_counts_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello, world", 7), (2, None, 8), (2, None, 8)], "doc_id int, text string, n_tokens int")
    rows = token_counts.with_token_counts(df, WORD).orderBy("doc_id").collect()
    assert [(r.n_tokens, r._n_tokens) for r in rows] == [(7, 3), (8, 0), (8, 0)]


def test_shuffle_is_a_permutation_in_equal_shards(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.lit(3).alias("shard"))
    out = sharding.external_shuffle(df, shards=16, bucket_rows=100).collect()
    assert sorted(r.doc_id for r in out) == list(range(1000)) and {r.shard for r in out} == {3}
    by = {}
    for r in out:
        by.setdefault(r._shard, []).append(r.slot)
    assert sorted(map(len, by.values()))[0] == 62 and all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {r.doc_id: r.bucket for r in sharding.external_shuffle(df.repartition(5), shards=16, bucket_rows=100).collect()}
    assert again == {r.doc_id: r.bucket for r in out} and sorted(r.position for r in out) == list(range(1000))
    same = spark.createDataFrame([(None, "x")] * 500 + [(1, None)], "doc_id int, text string")
    rows = sharding.external_shuffle(same, shards=4, bucket_rows=50).collect()
    assert len(rows) == 501 and max(np.bincount([r.shard for r in rows])) <= 126
    assert sharding.external_shuffle(same.where("false")).count() == 0


def test_packing_limits_and_coverage(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(0, 9, n)], int(n // 2)) for i, n in enumerate([*rng.integers(1, 90, 60), 700, 1])] + [(99, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, ids array<int>, prompt int").coalesce(1)
    limits = packing.Limits(tokens=128, segments=4, loss=50)
    out = packing.pack(df, loss_from="prompt", limits=limits, window_tokens=1500).collect()
    want, seqs, got = {r[0]: r for r in rows}, {}, {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append(r)
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, parts in got.items():
        assert [x for _, p in sorted(parts) for x in p] == want[i][1]
    assert 99 not in got and len(got) == 62
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert sum(r.length for r in s) <= 128 and len(s) <= 4 and sum(r.loss_tokens for r in s) <= 50
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
    assert packing.pack(df.where("false")).count() == 0


def by_hand(pieces, limits):
    """The dot-product heuristic, piece by piece."""
    caps = np.array([limits.tokens, limits.segments, limits.loss], float)
    need = [np.array([p.length, 1, p.loss]) / caps for p in pieces]
    weight = sum(need) / sum(need).sum()
    left, out = list(range(len(pieces))), []
    while left:
        room, got = np.ones(3), []
        while fitting := [i for i in left if (need[i] <= room + 1e-9).all()]:
            best = max(fitting, key=lambda i: (round(float((need[i] * weight) @ room), 12), -i))
            left.remove(best)
            got.append(best)
            room = room - need[best]
        out.append([(pieces[i].length, pieces[i].loss) for i in got])
    return out


def test_packing_follows_the_heuristic():
    rng = np.random.default_rng(5)
    limits = packing.Limits(tokens=256, segments=6, loss=90)
    pieces = [packing._Piece(i, 0, int(n), int(rng.integers(max(0, n - 90), n + 1))) for i, n in enumerate([*rng.integers(1, 120, 150), *[1] * 40, *[70] * 20])]
    got = packing.pack_window(pieces, limits)
    assert [[(p.length, p.loss) for p in b] for b in got] == by_hand(pieces, limits)
    full = [(sum(p.length for p in b), len(b), sum(p.loss for p in b)) for b in got]
    assert any(s == 6 for _, s, _ in full) and any(x >= 88 for *_, x in full) and any(t >= 250 for t, *_ in full)


def test_packing_of_very_many_tiny_pieces():
    pieces = [packing._Piece(i, 0, 1, 1) for i in range(30_000)]
    assert len(packing.pack_window(pieces, packing.Limits())) == -(-30_000 // 128)


def test_language_profiles(spark):
    words = {"aa": ["tha", "shi", "hun"], "bb": ["que", "ñor", "zil"]}
    rows = [(i, " ".join(words[g][(i + k) % 3] for k in range(20)), g) for i in range(20) for g in words]
    df = spark.createDataFrame([*rows, (90, None, "aa"), (91, "123 !!", None)], "doc_id int, text string, lang string")
    out = language_id.with_language(df.select("doc_id", "text", F.lit(1).alias("lang_pred")), df).collect()
    assert all(r._lang_pred == dict((x[1], x[2]) for x in rows)[r.text] for r in out if r.doc_id < 90)
    assert {(r._lang_pred, r.lang_score) for r in out if r.doc_id >= 90} == {("und", 0.0)}
    none = language_id.with_language(df.select("text"), df.where("false")).first()
    assert none.lang_pred == "und"


def test_out_of_place_distance_by_hand(spark):
    texts = [(1, "abab abc", "aa"), (2, "abab ab", "aa"), (3, "xyxy xz", "bb"), (4, "xyz xyz zz", "bb"), (5, None, "aa"), (6, "1 2", "bb"), (7, "abab abc", "aa")]
    df = spark.createDataFrame(texts, "doc_id int, text string, lang string")

    def ranked(lines):
        count = {}
        for line in lines:
            for w in line.split():
                padded = f"_{w}_" if w.isalpha() else ""
                for k in (1, 2, 3):
                    for i in range(len(padded) - k + 1):
                        g = padded[i : i + k]
                        if g != "_" and not (k == 3 and g[1] == "_"):
                            count[g] = count.get(g, 0) + 1
        code = lambda g: sum((1 if c == "_" else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        return sorted(count, key=lambda g: (-count[g], code(g)))[: language_id.PROFILE]

    profile = {g: ranked(t for _, t, lang in texts if lang == g and t) for g in ("aa", "bb")}
    for r in language_id.with_language(df.select("doc_id", "text"), df).collect():
        own = ranked([r.text or ""])
        if not own:
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
            continue
        far = {g: sum(abs(i - p.index(x)) if x in p else language_id.PROFILE for i, x in enumerate(own)) for g, p in profile.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and abs(r.lang_score - (1 - far[best] / (language_id.PROFILE * len(own)))) < 1e-12


def test_labels_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LABELS", 2)
    rows = [("abc abd", "aa")] * 3 + [("xyz xyw", "bb")] * 2 + [("mno mnp", "cc")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert {r.lang_pred for r in language_id.with_language(df.select("text"), df).collect()} <= {"aa", "bb"}


def test_text_counts_brute_force():
    text = "a b c\na b c\n\n x# y$ a b c z\nx# y$"
    words = text.split()
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cov = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    n, chars, sym, dup, rep, *_ = quality_rules.text_counts(text)
    assert (n, chars, sym, dup, rep) == (len(words), sum(map(len, words)), 4, 1, len(cov))
    assert quality_rules.text_counts(None)[:5] == (0, 0, 0, 0, 0)
    assert abs(quality_rules.chi_square(quality_rules.chi_square_quantile(0.95, 6), 6) - 0.95) < 2e-3


def test_outliers_keep_clean_documents(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(80)]
        if i % 30 == 0:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "s"))
    df = spark.createDataFrame([*rows, (900, None, None, None)], "doc_id int, text string, lang string, source string")
    out = {r.doc_id: r for r in quality_rules.with_outliers(quality_rules.with_text_counts(df)).collect()}
    assert all(out[i].kept == (i % 30 != 0) for i in range(300)) and not out[900].kept and out[900].base_failed
    assert quality_rules.with_outliers(quality_rules.with_text_counts(df.where("false"))).count() == 0


def test_outliers_use_their_own_counts(spark):
    text = " ".join(f"word{k}" for k in range(80))
    df = spark.createDataFrame([(1, text, "en", "s", 5, 2.0, "x"), (2, "too short", "en", "s", 500, 2.0, "y")], "doc_id int, text string, lang string, source string, n_words int, mean double, kept string")
    out = {r.doc_id: r for r in quality_rules.with_quality(df).collect()}
    assert (out[1].n_words, out[1]._n_words, out[1].mean, out[1].kept, out[1]._kept, out[1].base_failed) == (5, 80, 2.0, "x", True, False)
    assert (out[2].n_words, out[2]._n_words, out[2].kept, out[2]._kept, out[2].base_failed) == (500, 2, "y", False, True)


def test_least_determinant_by_hand(spark):
    rng = np.random.default_rng(21)
    p, n = len(quality_rules.FLOORS), 500
    x = rng.normal(size=(n, p)) * 0.3
    x[:150] = rng.normal(size=(150, p)) * 3.0 + 1.0
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"x{i} double" for i in range(p)))
    model = quality_rules.fit(df)[0].first()
    mean, precision = np.array(model["mean"]), np.array(model["precision"]).reshape(p, p)
    step = lambda m, q: np.argsort(np.einsum("ni,ij,nj->n", x - m, q, x - m), kind="stable")[: int(np.ceil(quality_rules.SUPPORT * n))]

    def estimate(at):
        cov = np.cov(x[at].T, bias=True) * quality_rules.consistency(quality_rules.SUPPORT, p) + np.diag(np.square(quality_rules.FLOORS))
        return x[at].mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    best = np.inf
    for _ in range(60):  # the same by brute force, from many random starts
        m, q, d = estimate(rng.permutation(n)[: p + 2])
        for _ in range(30):
            m, q, d = estimate(step(m, q))
        best = min(best, d)
    assert abs(-np.linalg.slogdet(precision)[1] - best) < 0.05 and np.abs(mean).max() < 0.2
    assert len(set(step(mean, precision)) & set(range(150))) < 5


def brute_components(texts, width, percent):
    sets = {i: (frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()) for i, w in ((i, (t or "").lower().split()) for i, t in texts)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_min_max_dedup_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.012 * (i % 5) else f"x{rng.integers(999)}" for w in base)) for i in range(60)]
    rows += [(100 + i, " ".join(f"v{rng.integers(500)}" for _ in range(30))) for i in range(20)]
    rows += [(200, rows[3][1].upper()), (201, None), (202, ""), (203, "one two"), (204, "One  two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, width=4).collect()}
    assert got == want


def test_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    rows = minhash_dedup.near_duplicates(df).collect()
    assert len(rows) == 4 and {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, None, True), (1, 1, True), (2, 2, True)}


def test_dedup_of_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (5, c), (6, c + " x"), (6, "short one"), (6, "short one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, width=4).collect())
    assert got == [(1, 37, 1, True), (1, 37, 1, True), (2, 38, 1, False), (3, 38, 1, False), (5, 37, 5, True), (6, 1, 5, False), (6, 1, 5, False), (6, 38, 5, False)]
    import corpus_pipeline

    docs = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert left == sorted([(1, a), (1, b), (5, c), (6, "short one")])


def test_dedup_of_a_loose_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rng = np.random.default_rng(15)
    base = [f"w{k}" for k in range(150)]
    rows = [(int(i), " ".join(w if rng.random() > 0.03 else f"x{rng.integers(9999)}" for w in base)) for i in rng.permutation(120)]
    want = brute_components(rows, 4, 80)
    assert len({c for _, c in want.values()}) > 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4).collect()}
    assert got == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_embedding_links_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16))
    x[50:90] = x[0] + rng.normal(size=(40, 16)) * 0.15
    x[90:95] = x[1]
    x[95:98] = x[2] * [[2.0], [3.0], [0.1]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [1.0, 2.0]), (204, [None] + [1.0] * 15), (205, []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = embedding_graph.embedding_links(df).collect()
    got = {r.vec_id: r for r in out}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    assert len(out) == len(rows) and [got[i].n_links for i in range(150)] == links.tolist() and got[0].audit_recall == 1.0
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (200, 201, 202, 203, 204, 205))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert embedding_graph.embedding_links(df.where("false")).count() == 0


def test_embedding_rows_of_one_id(spark):
    rows = [(7, [1.0, 0.0]), (7, None), (7, [0.0, 1.0]), (3, [0.0, 2.0]), (9, [1.0, 0.01]), (9, [1.0, 0.01]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("unit", F.lit(1))
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_graph.embedding_links(df).collect())
    assert out == [(3, 1, 3, True), (5, 0, 5, True), (7, 0, 7, True), (7, 1, 3, False), (7, 2, 3, False), (9, 2, 3, False), (9, 2, 3, False)]
    lone = embedding_graph.embedding_links(df.where("vec_id = 5")).first()
    assert lone.audit_recall is None


def component_of(near):
    label = np.arange(len(near))
    while True:
        new = np.array([label[near[i] | (np.arange(len(near)) == i)].min() for i in range(len(near))])
        if (new == label).all():
            return label.tolist()
        label = new


def test_many_and_oversized_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "MAX_CENTROIDS", 2)
    monkeypatch.setattr(embedding_graph, "SHARD_ROWS", 100)
    monkeypatch.setattr(embedding_graph, "SHARD_TARGET", 50)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 16))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.1, x[0] + rng.normal(size=(300, 16)) * 0.2])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in embedding_graph.embedding_links(df, cosine=0.95).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert near.sum() > 3000 and (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum() and got[0].audit_recall >= 0.97
    assert np.mean([got[i].component_id == c for i, c in enumerate(component_of(near))]) > 0.99


def test_ppm_is_a_distribution_and_counts_match(spark):
    rng = np.random.default_rng(4)
    words = ["the", "then", "when", "zoo", "Ähre"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(80)] + [(500, None), (501, "never seen <<>> words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = F.col("doc_id") % 5 != 0
    out = {r.doc_id: r for r in ppm_scoring.scores(df, train).collect()}
    count, ends = {}, 0
    for i, t in rows:
        if i % 5:
            ends += 1
            for w in ppm_scoring.canonical(t).split():
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for i, t in rows:
        w = ppm_scoring.canonical(t).split()
        base = sum(np.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert abs(out[i].base_score - base) < 1e-9 and out[i].train_tokens == n and out[i].n_known == sum(x in count for x in w) + 1
    assert ppm_scoring.scores(df.where("false"), train).count() == 0
    trie = ppm_scoring.train_trie(ppm_scoring.blocks(df, train))
    for context in (0, int.from_bytes(b"\n\n\n the"[-6:], "big"), int.from_bytes(b"n whenz"[-6:], "big")):
        assert abs((10 ** trie.logs((context << 8) | np.arange(256))).sum() - 1) < 1e-5


def test_ppm_scores_from_all_counts(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rare = "zyx wvut qrpo zzyy xwvu tsrq"
    rows = [(i, " ".join(rng.choice(words, 15000))) for i in range(1, 50) if i % 5] + [(1001, rare), (1000, rare)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in ppm_scoring.scores(df, F.col("doc_id") % 5 != 0).collect()}
    texts = [ppm_scoring.canonical(t) for i, t in rows if i % 5]
    assert sum(map(len, texts)) > 1 << 21
    levels = [np.unique(ppm_scoring.strings(texts, k)[0], return_counts=True) for k in range(7)]
    contexts = []
    for keys, n in levels:
        own, at = np.unique(keys >> 8, return_inverse=True)
        contexts.append((own, np.bincount(at, n).astype(np.int64)))
    want = ppm_scoring.Trie(levels, contexts).score([ppm_scoring.canonical(t) for _, t in rows])
    assert all(abs(got[i] - w) < 1e-3 + 1e-6 * abs(w) for (i, _), w in zip(rows, want, strict=True))


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(6)
    plain = ["tree", "river", "stone", "cloud", "you", "walk"]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        if i % 4 == 0:
            w[5], w[20] = "grumblex", "idiot" if i % 8 else "id1ot"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (900, None)], "doc_id bigint, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 5] + [(7000, None)], "doc_id bigint, label int")
    out = {r.doc_id: r.score for r in toxicity.with_toxicity(docs, known).collect()}
    assert len(out) == 601 and all(0 <= s <= 1 for s in out.values())
    held = [i for i in range(600) if i % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert {r.score for r in toxicity.with_toxicity(docs, known.where("false")).collect()} == {0.0}


@pytest.mark.parametrize("name", ["language_id", "quality_rules", "near_duplicates", "packing"])
def test_pipeline_stages_take_empty_tables(spark, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([], DOCS + ", row string, words_key string")
    out = stage(spark, docs, "")
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_pipeline_stages_decide(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeioutnsr"), 5))
    texts = [" ".join(word() for _ in range(90)) for _ in range(30)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(50, texts[0], "en", "s", 1), (51, "1234 ### 99", None, None, None), (52, " ".join("zz zz zz".split() * 40), "en", None, 1), (None, texts[1], None, "s", 1), (3, texts[3], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        if name == "language_id":
            assert 51 not in [r.doc_id for r in docs.collect()]
        if name == "quality_rules":
            assert 52 not in [r.doc_id for r in docs.collect()]
    ids = [r.doc_id for r in docs.collect()]
    assert sorted(i for i in ids if i is not None) == list(range(30)) and ids.count(None) == 1  # 50 copies 0, 3 stands twice
