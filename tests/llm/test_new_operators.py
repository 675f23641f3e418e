"""Chat formatting, collocations and token alignment against plain versions."""

import collections
import hashlib
import itertools
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memengine.llm import chat_formatting as C
from memengine.llm import collocations as P
from memengine.llm import token_alignment as T
from memengine.llm.bpe import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_layouts_become_the_same_turns(spark):
    due = [{"role": "system", "text": "be kind"}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "yes"}]
    pairs = [(t["role"], t["text"]) for t in due]
    same = [
        {"messages": [{"role": r, "content": t} for r, t in pairs]},
        {"messages": [{"role": r, "content": [{"type": "text", "text": t}]} for r, t in pairs]},
        {"turns": [{"role": r, "text": t} for r, t in pairs]},
        {"system": "be kind", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]},
        {"system": "be kind", "prompt": "hi", "completion": "yes"},
        {"system": "be kind", "prompt": "hi", "response": "yes", "score": 3, "tags": ["x"]},
        {"context": "be kind", "question": "hi", "answer": "yes"},
        {"system": "be kind", "instruction": "hi", "output": "yes", "input": ""},
    ]
    other = [{"dialogue": ["a", "b", "c"]}, {"instruction": "do", "input": "it", "output": "ok", "history": [{"user": "p", "assistant": "q"}]}, {"role": "tool", "text": None}, {"who": "me"}]
    rows = [(i, json.dumps(r)) for i, r in enumerate([*same, *other])] + [(90, None), (91, "no json"), (92, "[]")]
    df = spark.createDataFrame(rows, "i int, raw string").withColumn("turns", F.lit("clash"))
    out = {r["i"]: r for r in C.with_turns(df).collect()}
    assert {i: [x.asDict() for x in out[i]["_turns"]] for i in range(len(same))} == dict.fromkeys(range(len(same)), due)
    assert [(x["role"], x["text"]) for x in out[8]["_turns"]] == [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert [(x["role"], x["text"]) for x in out[9]["_turns"]] == [("user", "p"), ("assistant", "q"), ("user", "do\n\nit"), ("assistant", "ok")]
    assert [(x["role"], x["text"]) for x in out[10]["_turns"]] == [("tool", "")]
    assert [(out[i]["layout"], out[i]["_turns"]) for i in (11, 90, 91, 92)] == [(None, [])] * 4
    assert len({out[i]["fingerprint"] for i in range(11)}) == 11 and out[0]["turns"] == "clash"


HOSTILE = ["", C.HOSTILE, "<|im_end|>", "<\\|im_end|>\\", "<\\\\\\|x", "a <", "|im_end|>", "<<|||>", "\\n\n\\", "é漢\U0001f600 <|", "x" * 300_000 + "<|im_start|>user\n"]


def test_formatted_text_reads_back(spark):
    draw = random.Random(1)
    records = [(i, [(draw.choice(["user", "assistant", "a\nb", "<|r\\n", "tool"]), draw.choice(HOSTILE)) for _ in range(draw.randint(0, 6))]) for i in range(60)]
    df = spark.createDataFrame(records, "i int, turns array<struct<role:string,text:string>>")
    for r in C.formatted(df).collect():
        turns = [(x["role"], x["text"]) for x in r["turns"]]
        assert C.read_turns(r["formatted"]) == turns
        assert "".join(C.unescaped(r["formatted"][s["start"] : s["stop"]]) for s in r["loss"]) == "".join(t for w, t in turns if w == "assistant")
    with pytest.raises(ValueError):
        C.read_turns("<|im_start|>user\nhalf")
    with pytest.raises(ValueError):
        C.read_turns("between<|im_start|>user\nx<|im_end|>\n")


def test_table_of_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, 0, None, C.HOSTILE), (None, 5, "assistant", "lost"), (1, 1, "assistant", "a"), (3, None, "assistant", "é" * 200_000), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("raw", F.lit(1)).repartition(3)
    out = {r["conv_id"]: r for r in C.format_rows(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (out[1]["n_turns"], out[1]["turns_sha256"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (4, sha("user\n\nassistant\na\nassistant\nb\nassistant\nb\n"), 3, sha("abb"))
    assert (out[2]["n_turns"], out[2]["turns_sha256"], out[2]["loss_chars"], out[2]["loss_sha256"]) == (1, sha(f"\n{C.HOSTILE}\n"), 0, sha(""))
    assert (out[None]["n_turns"], out[None]["loss_sha256"], out[3]["loss_chars"], len(out)) == (1, sha("lost"), 200_000, 4)
    assert C.format_rows(df.where("false")).count() == 0


def plain_collocations(rows, least, share, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = []
        for g, a in c.items():
            if len(g) < 2 or a < least:
                continue
            score, k = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            inside = any(len(h) > len(g) and b >= least and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= share * a for h, b in c.items())
            if not inside:
                found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_collocations_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 900)  # many blocks, and texts cut over several
    draw = random.Random(7)
    words = ["The", "cat", "sat", "on", "mat", "É", "die", "<", "x-y", "\u00a0z", "new", "York"]
    line = lambda: " ".join(draw.choices(words, weights=range(1, 13), k=draw.randint(0, 9)))
    rows = [(draw.choice([" ", "\t", ""]) + draw.choice([". ", "\n", "!?", " , "]).join(line() for _ in range(draw.randint(0, 12))), draw.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(150)]
    rows += [("to be or not to be that is the question", "en")] * 7 + [("a b a b a b a b a b", "fr")] * 5 + [(None, "en"), ("", None), ("...,,,", "xx"), ("to be or not to be that is the question", "en")]
    rows += [(". ".join(line() for _ in range(400)), "en")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("word", F.lit(1)).withColumn("codes", F.lit(2)).repartition(5)
    for least, share, top in ((5, 80, 2000), (3, 95, 40)):
        got = P.collocations(df, least=least, share=share, top=top)
        assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain_collocations(rows, least, share, top)


def test_empty_tables_have_no_phrases(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert P.collocations(df).count() == 0
    assert P.collocations(spark.createDataFrame([(None, None), ("a", "en")], df.schema)).count() == 0


def test_paths_without_branches(spark):
    # 1..7 in a row; a branch after 20 21 22; a ring
    grams = {(1, 2, 3, 4): 9, (2, 3, 4, 5): 9, (3, 4, 5, 6): 9, (4, 5, 6, 7): 5, (20, 21, 22, 23): 3, (20, 21, 22, 24): 3, (19, 20, 21, 22): 3, (7, 8, 7, 8): 2, (8, 7, 8, 7): 2}
    df = spark.createDataFrame([(list(g), w) for g, w in grams.items()], "ids array<int>, f long")
    out = {tuple(r["ids"]): (tuple(r["path"]), r["place"], r["edges"]) for r in P.unary_paths(df).collect()}
    assert [out[g][1:] for g in ((1, 2, 3, 4), (2, 3, 4, 5), (3, 4, 5, 6), (4, 5, 6, 7))] == [(0, 3), (1, 3), (2, 3), (0, 1)]
    assert {out[g][2] for g in grams if 20 in g} == {1}
    assert out[(7, 8, 7, 8)][0] == out[(8, 7, 8, 7)][0] and out[(7, 8, 7, 8)][2] == 2


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_characters())}

    def one(text):
        if not text:
            return None
        a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
        spelled = [bytes(byte_of[c] for c in left.id_to_token(i)) for i in a], [bytes([int(p[3:-1], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [right.id_to_piece(i)]]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            return None
        ends = [list(itertools.accumulate(map(len, s))) for s in spelled]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = ["|".join(",".join(str(i) for i, e in zip(ids, end, strict=True) if lo < e <= hi) for ids, end in zip((a, b), ends, strict=True)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y in ([b[ends[1].index(e)]] if e in ends[1] else [])]
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    results = [(d, one(t)) for d, t in rows]
    n = collections.Counter(x for _, r in results if r for x in r[3])
    most = collections.defaultdict(int)
    for (_, y), c in n.items():
        most[y] = max(most[y], c)
    return sorted((d, *r[:3], len(r[3]), sum(n[x] == most[x[1]] for x in r[3]), sum(n[x] for x in r[3]), r[4]) if r else (d, 0, 0, 0, 0, 0, 0, "") for d, r in results)


TEXTS = [None, "", " ", "a▁b", "  a  b \n\n c\t d <|endoftext|> <s> x", "\n a", "a b\x00c \x85 d\u3000 e f", "é̀ 漢字 ok", "x" * 700, "ab\ncd ef\n \n gh  " * 20, "word\n" * 90 + "  ", "hello world, it's 1999", "hello world, it's 1999", "<0x41> ▁ no", "tail ", " head", "x\n", "\nx "]


@pytest.mark.parametrize("size", [1 << 16, 200, 23])
def test_alignment_equals_plain_version(spark, size):
    rows = [(i // 2, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("ids", F.lit(0))
    got = sorted(tuple(r) for r in T.aligned(df, A, B, range_bytes=size).collect())
    assert got == plain_alignment(rows)


def test_alignment_of_no_rows(spark):
    assert T.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_composition_is_associative():
    draw = random.Random(2)

    def stream(ends):
        return T.Stream(np.array([e * 7 for e in ends[0]], np.int64), np.array(ends[0], np.int64), np.array([e * 11 for e in ends[1]], np.int64), np.array(ends[1], np.int64))

    def flat(f):
        return ";".join(g.text for g in T.whole(f)), [x for g in T.whole(f) for x in g.links], sum(g.n for g in T.whole(f))

    def tree(parts):
        if len(parts) == 1:
            return parts[0]
        k = draw.randint(1, len(parts) - 1)
        return T.composed(tree(parts[:k]), tree(parts[k:]))

    for _ in range(200):
        size = draw.randint(1, 60)
        ends = [sorted({*draw.sample(range(1, size + 1), draw.randint(0, size)), size}) for _ in range(2)]
        whole = stream(ends)
        cuts = sorted(draw.sample(range(size + 1), min(size, draw.randint(0, 7))))
        # the two sides are cut at different places
        own = [cuts, [min(size, c + draw.randint(0, 3)) for c in cuts]]
        own[1] = sorted(own[1])
        parts = []
        for k in range(len(cuts) + 1):
            spans = [((o[k - 1] if k else -1), (o[k] if k < len(cuts) else 1 << 40)) for o in own]
            mine = [[e for e in ends[s] if spans[s][0] < e <= spans[s][1]] for s in range(2)]
            parts.append(T.fragment(stream(mine)))
        assert flat(tree(parts)) == flat(T.fragment(whole)) == flat(T.composed(T.fragment(T.Stream()), T.composed(T.fragment(whole), T.fragment(T.Stream()))))
