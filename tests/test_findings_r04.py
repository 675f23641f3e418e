"""What the findings of round 4 named."""

import random

import numpy as np
from pyspark.sql import functions as F

from memengine.llm import collocations as P
from memengine.llm import embedding_graph as G
from memengine.llm import token_alignment as T
from memengine.operators import rewards


def test_large_records_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rewards, "WHOLE_SETS", 40, raising=False)
    monkeypatch.setattr(rewards, "CHUNK_SETS", 48, raising=False)  # several chunks a size class
    rows, kept = [], []
    held = rewards.durable
    monkeypatch.setattr(rewards, "durable", lambda *a, **k: kept.append(held(*a, **k)) or kept[-1])
    rng, words = random.Random(4), [f"w{i}" for i in range(45)]
    for record, n in (("big", 260), ("other", 90), ("small", 30)):
        texts = [rng.sample(words, rng.choice([1, 2, 6, 7, 8, 13, 20, 30, 40])) for _ in range(n)]
        texts += [t[len(t) // 12 :] + rng.sample(words, rng.randint(0, 2)) for t in texts[: n // 2]] + texts[:5] + [[]] * 3
        texts += [[f"{record}{i}" for i in range(300 + k)] for k in (0, 20, 60)]  # wider sketches
        rows += [(record, f"{i % 50:02}", "active", " ".join(t)) for i, t in enumerate(texts)]  # ids repeat
    rows += [(None, "1", "active", "a b"), (None, "2", "active", "a b"), ("big", "x", "gone", "a")]
    got = {r.record_id: r.non_redundancy for r in rewards.non_redundancy(spark.createDataFrame(rows, "record_id string, node_id string, status string, content string")).collect()}
    near = 0
    for record in ("big", "other", "small", None):
        sets = [frozenset(r[3].split()) for r in rows if r[0] == record and r[2] == "active"]
        alike = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :] if a == b or len(a & b) / len(a | b) >= 0.85]
        assert abs(got[record] - (1 - len(alike) / (len(sets) * (len(sets) - 1) / 2))) < 1e-12
        near += sum(a != b for a, b in alike)
    assert near > 30
    # what is written follows the nodes, not the pairs that meet by chance
    assert max(df.count() for df in kept) < 2 * len(rows)


def test_phrase_blocks_are_small_and_numbers_need_no_python(spark):
    text = " ".join(f"w{i % 900}" for i in range(700_000))
    sizes = P.blocks(spark.createDataFrame([(text[k : k + 40_000], "en") for k in range(0, len(text), 40_000)], "text string, lang string").coalesce(1)).select(F.size("codes")).collect()
    assert len(sizes) > 2 and max(s for (s,) in sizes) * 4.8 < 1.2 * (1 << 20)
    made = P.numbered(spark.range(1000, numPartitions=7).select((F.col("id") * 3).alias("x")), "number", "test-numbers")
    assert sorted(r.number for r in made.collect()) == list(range(1, 1001))
    assert "ExistingRDD" not in made._jdf.queryExecution().toString()
    assert P.numbered(spark.range(0), "number", "test-numbers").count() == 0


def test_files_of_blocks_are_small(spark, monkeypatch):
    kept = {}
    for module in (P, T):
        held = module.saved
        monkeypatch.setattr(module, "saved", lambda df, label, *rows, held=held: kept.setdefault(label, []).append(held(df, label, *rows)) or kept[label][-1])
    monkeypatch.setattr(P, "BLOCK_BYTES", 500)
    monkeypatch.setattr(T, "BLOCK_CHARS", 500)
    monkeypatch.setattr(P, "dropped", lambda *df: None)
    texts = [" ".join(f"w{i % 7}" for i in range(k, k + 60)) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    assert P.collocations(docs).count()
    left, right = (T.public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    assert sorted(r.doc_id for r in T.aligned(docs, left, right).collect()) == list(range(60))
    for label in ("collocation-blocks", "collocation-texts", "alignment-blocks"):
        per = [n for (_, n) in kept[label][0].groupBy(F.input_file_name()).count().collect()]
        assert sum(per) > 10 and max(per) <= 4


def test_links_write_a_vector_once(spark, monkeypatch):
    monkeypatch.setattr(G, "WAVE_NODES", 60, raising=False)  # several waves
    monkeypatch.setattr(G, "SHARD_ROWS", 60)
    monkeypatch.setattr(G, "SHARD_TARGET", 40)
    monkeypatch.setattr(G, "MAX_CENTROIDS", 2)  # shards are split again
    kept, held = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df, label: kept.append(df.schema) or held(df, label))
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 12)), 6, axis=0) + rng.normal(size=(240, 12)) * 0.12
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(500, [0.0] * 12), (501, None)]
    for kind in ("float", "double"):
        kept.clear()
        got = {r.vec_id: r for r in G.embedding_links(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
        u = np.array([v for _, v in rows[:240]])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        want = (u @ u.T >= 0.9).sum(1) - 1
        assert all(got[i].n_links <= want[i] for i in range(240)) and sum(got[i].n_links for i in range(240)) >= 0.97 * want.sum() > 100
        assert len(got) == 242 and got[500].n_links == got[501].n_links == 0
        # hashes of directions are the only bytes that are written beside the one table of vectors
        assert not [f.name for schema in kept for f in schema if f.dataType.simpleString() == "binary" and f.name != "key"]
