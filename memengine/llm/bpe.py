"""Byte-pair encoding: vocabulary files, pre-tokens, and two exact merge procedures.

* ``SegmentTreeBPE`` keeps a segment tree over the ranks of adjacent pairs. The root is the leftmost lowest-rank
  merge; each merge updates three leaves and their paths. Short pre-tokens run as rows of one batch of trees, a
  long one runs alone, in time n log n.
* ``RankSynchronousCounter`` holds all pre-tokens of a batch in ragged numpy arrays and applies the lowest-rank
  pair of every sequence in the same round, until no sequence has a mergeable pair.

Both give what the ``tokenizers`` library gives. ``TokenTable`` makes the pre-tokens of many texts at once: Arrow cuts
texts at white space, distinct chunks become pre-tokens, and each distinct pre-token is merged once. Nothing is kept
from one part of a batch to the next, so memory is bounded by ``PART_CHARS`` and the longest stretch without a space.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed values of the two public vocabularies: the Unicode White_Space characters and the split patterns.
WHITE = "\t-\r \x85\xa0  -     　"
GPT_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
WORD_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"

LONG = 192
BATCH = 8192
#: Characters of text whose pre-tokens are made together, and distinct pre-tokens that are merged together.
PART_CHARS = 1 << 20
MERGED_TOGETHER = 1 << 16


def byte_characters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    rest follow from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    table = {b: chr(b) for b in own}
    return [table[b] if b in table else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.lower = bool(self.suffix)
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        chars = byte_characters()
        self.byte_ids = np.array([self.ids[c] for c in chars], np.int64)
        self.last_ids = np.array([self.ids[c + self.suffix] for c in chars], np.int64)
        pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = left * self.size + right
        self._pair_table(keys)
        self.made = made
        self.n_merges = len(made)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.split = regex.compile(WORD_SPLIT if self.lower else GPT_SPLIT)
        #: a place where a long text can be cut: one space between two words
        self.gap = regex.compile(rf"[^{WHITE}](?= [^{WHITE}])")
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * self.size
        for t, i in self.ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in (t.removesuffix(self.suffix) if self.suffix else t) if c in byte_of)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()

    def prepared(self, text: str) -> str:
        """What the vocabulary's normalizer makes of a text, white space aside."""
        if not self.lower:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def parts(self, text: str) -> list[int | str]:
        """Ids of special tokens, and pre-tokens, of a text as it stands, in order."""
        out: list[int | str] = []
        for piece in self.special_re.split(text) if self.special_re is not None else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += self.split.findall(self.prepared(piece))
        return out

    def _pair_table(self, keys: np.ndarray) -> None:
        """Ranks of pairs by open addressing."""
        self.bits = int(len(keys)).bit_length() + 2
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, len(keys), np.int64)
        todo, at = np.arange(len(keys)), self._spot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[todo[free]]  # of several that want one slot the last gets it
            won = self.slots[at] == keys[todo]
            self.slot_rank[at[won]] = todo[won]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``n_merges`` where it never merges."""
        keys = left * self.size + right
        at = self._spot(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.slot_rank[at], self.n_merges)
        open_ = np.nonzero((there != keys) & (there >= 0))[0]
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.slots[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.slot_rank[at[hit]]
            more = ~hit & (there >= 0)
            open_, at = open_[more], at[more]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, .. of every i, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Merged:
    """Ids of sequences, one after another: those of sequence i begin at ``starts[i]``, ``sizes[i]`` of them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray | None = None):
        """``owner``: which sequence each stretch belongs to; each has one stretch."""
        starts = np.cumsum(sizes) - sizes
        self.ids = ids
        if owner is not None:
            by = np.empty(len(owner), np.int64)
            by[owner] = np.arange(len(owner))
            starts, sizes = starts[by], sizes[by]
        self.starts, self.sizes = starts, sizes


class SegmentTreeBPE:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> Merged:
        """Ids of each pre-token; ``flat`` holds their bytes one after another."""
        starts = np.cumsum(lengths) - lengths
        ids, sizes, owner = [], [], []
        width = np.where(lengths < 3, 1, 1 << np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64))
        width[lengths > LONG] = 0
        for w in np.unique(width):
            members = np.nonzero(width == w)[0]
            for s in range(0, len(members), BATCH if w else 1):
                part = members[s : s + (BATCH if w else 1)]
                if w:
                    found, n = self._many(flat, starts[part], lengths[part], int(w))
                else:
                    found = self._one(flat[starts[part[0]] : starts[part[0]] + lengths[part[0]]].tobytes())
                    n = np.array([len(found)])
                ids.append(found)
                sizes.append(n)
                owner.append(part)
        if not ids:
            return Merged(np.zeros(0, np.int64), np.zeros(0, np.int64))
        return Merged(np.concatenate(ids), np.concatenate(sizes), np.concatenate(owner))

    def _symbols(self, token: bytes) -> np.ndarray:
        ids = self.v.byte_ids[np.frombuffer(token, np.uint8)]
        if len(ids):
            ids[-1] = self.v.last_ids[token[-1]]
        return ids

    def _many(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``width`` leaves a tree, a power of two that holds the pairs of every token here."""
        v, rows, cols = self.v, len(starts), width + 1
        flat = flat[ragged(starts, lengths)]
        row = np.repeat(np.arange(rows), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbol = np.full((rows, cols + 1), -1, np.int64)
        symbol[row, col] = np.where(col == lengths[row] - 1, v.last_ids[flat], v.byte_ids[flat])
        after = np.tile(np.arange(1, cols + 2), (rows, 1))
        before = np.tile(np.arange(-1, cols), (rows, 1))
        never = v.n_merges * width
        tree = np.full((rows, 2 * width), never, np.int64)
        left, right = symbol[:, :width], symbol[:, 1 : width + 1]
        has = right >= 0
        leaf = np.full((rows, width), never, np.int64)
        leaf[has] = v.ranks(left[has], right[has]) * width + np.nonzero(has)[1]
        leaf[leaf >= never] = never
        tree[:, width:] = leaf
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(r, at, value):
            spot = at + width
            tree[r, spot] = value
            while spot[0] > 1:  # all leaves lie on one level
                spot = spot >> 1
                tree[r, spot] = np.minimum(tree[r, 2 * spot], tree[r, 2 * spot + 1])

        def leaf_value(a, b, at):
            rank = np.where(b >= 0, v.ranks(a, np.maximum(b, 0)), v.n_merges)
            return np.where(rank < v.n_merges, rank * width + at, never)

        live = np.nonzero(tree[:, 1] < never)[0]
        while len(live):
            root = tree[live, 1]
            at, rank = root % width, root // width
            gone = after[live, at]
            nxt = after[live, gone]
            made = v.made[rank]
            symbol[live, at], symbol[live, gone] = made, -1
            after[live, at] = nxt
            inside = nxt <= cols
            before[live[inside], nxt[inside]] = at[inside]
            ends = gone < width  # the last symbol has no leaf of its own
            put(live[ends], gone[ends], np.full(ends.sum(), never)) if ends.any() else None
            follower = symbol[live, np.minimum(nxt, cols)]
            put(live, at, leaf_value(made, follower, at))
            prev = before[live, at]
            has = prev >= 0
            if has.any():
                r, p = live[has], prev[has]
                put(r, p, leaf_value(symbol[r, p], made[has], p))
            live = live[tree[live, 1] < never]
        kept = symbol >= 0
        return symbol[kept], kept.sum(1)

    def _one(self, token: bytes) -> np.ndarray:
        """The same with Python lists, for one long pre-token."""
        v = self.v
        symbol = self._symbols(token).tolist()
        n = len(symbol)
        width = 1 << max(0, (n - 2).bit_length())
        never = v.n_merges * width
        get, size, made = v.rank_of.get, v.size, v.made
        first = v.ranks(np.array(symbol[:-1]), np.array(symbol[1:]))
        leaves = np.full(width, never, np.int64)
        leaves[: n - 1] = np.where(first < v.n_merges, first * width + np.arange(n - 1), never)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [never] + [x for lv in reversed(levels) for x in lv.tolist()]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at, value):
            spot = at + width
            tree[spot] = value
            spot >>= 1
            while spot:
                a, b = tree[2 * spot], tree[2 * spot + 1]
                tree[spot] = a if a < b else b
                spot >>= 1

        while tree[1] < never:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            nxt = after[gone]
            new = symbol[at] = int(made[rank])
            symbol[gone] = -1
            after[at] = nxt
            if gone < n - 1:
                put(gone, never)
            if nxt < n:
                before[nxt] = at
                rank = get(new * size + symbol[nxt])
                put(at, never if rank is None else rank * width + at)
            else:
                put(at, never)
            prev = before[at]
            if prev >= 0:
                rank = get(symbol[prev] * size + new)
                put(prev, never if rank is None else rank * width + prev)
        return np.array([s for s in symbol if s >= 0], np.int64)


class RankSynchronousCounter:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab

    def count(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each pre-token; ``flat`` holds their bytes one after another."""
        out = np.zeros(len(lengths), np.int64)
        for owner, sizes, _ in self._rounds(flat, lengths):
            out[owner] = sizes
        return out

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> Merged:
        """The symbols that survive in each pre-token, none of them empty."""
        done = list(self._rounds(flat, lengths))
        if not done:
            return Merged(np.zeros(0, np.int64), np.zeros(0, np.int64))
        owner, sizes, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return Merged(symbols, sizes, owner)

    def _rounds(self, flat: np.ndarray, lengths: np.ndarray):
        """After each round, the sequences in which nothing merges any more: number, size, symbols."""
        start = np.cumsum(lengths) - lengths
        for s in range(0, len(lengths), MERGED_TOGETHER):
            mine = lengths[s : s + MERGED_TOGETHER]
            a = int(start[s])
            for owner, sizes, symbols in self._together(flat[a : a + int(mine.sum())], mine):
                yield owner + s, sizes, symbols

    def _together(self, flat: np.ndarray, lengths: np.ndarray):
        v = self.v
        if not len(flat):
            return
        symbol = v.byte_ids[flat]
        full = np.nonzero(lengths)[0]
        last = np.cumsum(lengths)[full] - 1
        symbol[last] = v.last_ids[flat[last]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbol), v.n_merges, np.int64)  # of the pair that starts here
        inner = np.nonzero(owner[:-1] == owner[1:])[0]
        rank[inner] = v.ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == v.n_merges
            if done.any():
                stay = ~np.repeat(done, sizes)
                yield owner[starts[done]], sizes[done], symbol[~stay]
                symbol, owner, rank, lowest, sizes = symbol[stay], owner[stay], rank[stay], lowest[~done], sizes[~done]
                if not len(symbol):
                    break
            hit = rank == np.repeat(lowest, sizes)
            at = np.nonzero(hit)[0]
            # pairs of one symbol with itself overlap in a run; every other one of the run merges, from its left end
            follows = np.r_[False, (at[1:] == at[:-1] + 1)] if len(at) else np.zeros(0, bool)
            if follows.any():
                run_start = np.maximum.accumulate(np.where(follows, -1, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbol[at] = v.made[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            at = moved[at]
            symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
            again = np.zeros(len(symbol), bool)
            again[at] = True
            again[at[at > 0] - 1] = True
            rank[again] = v.n_merges
            pair = np.nonzero(again[:-1])[0]
            pair = pair[owner[pair] == owner[pair + 1]]
            rank[pair] = v.ranks(symbol[pair], symbol[pair + 1])


MARKS = ".,!?;:"


class TokenTable:
    """The distinct pre-tokens of many texts, and every text as a run of numbers into them.

    ``tokens`` are distinct pre-tokens; ``refs[offsets[i]:offsets[i + 1]]`` are those of text i, where a number
    n >= len(tokens) stands for the special id ``specials[n - len(tokens)]``."""

    def __init__(self, v: Vocabulary, texts: list[str]):
        self.v = v
        odd = {i: None for i, t in enumerate(texts) if (v.special_re is not None and "<" in t and v.special_re.search(t)) or (v.lower and any(c in t for c in "\x1c\x1d\x1e\x1f"))}
        codes, offsets, chunks = self._cut(["" if i in odd else v.prepared(t) for i, t in enumerate(texts)])
        if not v.lower:
            odd |= dict.fromkeys(self._uneven(codes, offsets, chunks).tolist())
            codes[offsets[:-1]] += len(chunks)  # a text's first chunk has no space before it
        # which chunks occur, and what each comes to
        seen = np.zeros(2 * len(chunks), bool)
        seen[codes] = True
        used, codes = np.nonzero(seen)[0], (np.cumsum(seen) - 1)[codes]
        raw = used >= len(chunks)
        strings = chunks.take(pa.array(used % max(1, len(chunks))))
        word = pc.utf8_rtrim(strings, MARKS)
        plain = pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False)
        cut = pc.utf8_length(strings).to_numpy() - pc.utf8_length(word).to_numpy()
        one, two = plain & (cut == 0), plain & (cut == 1)
        at_one, at_two, at_odd = np.nonzero(one)[0], np.nonzero(two)[0], np.nonzero(~(one | two))[0]
        bare = lambda at: at[raw[at]] if not v.lower else at
        led = lambda at: at[~raw[at]] if not v.lower else at[:0]
        space = lambda a: pc.binary_join_element_wise(pa.scalar(" "), a, pa.scalar("")) if len(a) else a
        some = lambda a, at: a.take(pa.array(at))
        words = [some(strings, bare(at_one)), space(some(strings, led(at_one))), some(word, bare(at_two)), space(some(word, led(at_two))), some(pc.utf8_slice_codeunits(strings, -1), at_two)]
        owner = [bare(at_one), led(at_one), bare(at_two), led(at_two), at_two]
        place = [np.zeros(len(o), np.int64) for o in owner[:4]] + [np.ones(len(at_two), np.int64)]
        rest, rest_owner, rest_place = [], [], []
        for k, c in zip(at_odd.tolist(), some(strings, at_odd).to_pylist(), strict=True):
            found = v.split.findall(c if raw[k] or v.lower else f" {c}") if c or not (raw[k] or v.lower) else []
            rest += found
            rest_owner += [k] * len(found)
            rest_place += range(len(found))
        # texts that are split as they stand
        apart, special = [], []
        for i in odd:
            found = v.parts(texts[i])
            for k, t in enumerate(found):
                if isinstance(t, int):
                    special.append(t)
                    apart.append((i, k, -len(special)))
                else:
                    apart.append((i, k, len(rest)))
                    rest.append(t)
                    rest_owner.append(-1)
                    rest_place.append(0)
        words.append(pa.array(rest, pa.string()))
        owner.append(np.array(rest_owner, np.int64))
        place.append(np.array(rest_place, np.int64))
        coded = pa.concat_arrays([w.cast(pa.string()) for w in words]).dictionary_encode()
        self.tokens, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.specials = np.array(special, np.int64)
        owner, place = np.concatenate(owner), np.concatenate(place)
        own = np.nonzero(owner >= 0)[0]
        own = own[np.lexsort((place[own], owner[own]))]
        refs, per = number[own], np.bincount(owner[own], minlength=len(used))
        first = np.cumsum(per) - per
        # every text: its chunks' pre-tokens in order
        lengths = per[codes]
        flat = refs[ragged(first[codes], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[offsets]
        if odd:
            free = len(number) - len(rest)
            by_text: dict[int, list[int]] = {i: [] for i in odd}
            for i, _, k in apart:
                by_text[i].append(int(number[free + k]) if k >= 0 else len(self.tokens) - k - 1)
            runs = [np.array(by_text[i], np.int64) if i in by_text else flat[ends[i] : ends[i + 1]] for i in range(len(texts))]
            flat, ends = np.concatenate(runs), np.concatenate(([0], np.cumsum([len(r) for r in runs])))
        self.refs, self.offsets = flat, ends

    def _cut(self, texts: list[str]):
        """Number of each chunk among the distinct ones, where each text's chunks start, and the distinct chunks."""
        lists = (pc.utf8_split_whitespace if self.v.lower else lambda a: pc.split_pattern(a, " "))(pa.array(texts, pa.string()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), offsets - offsets[0], coded.dictionary

    def _uneven(self, codes: np.ndarray, offsets: np.ndarray, chunks) -> np.ndarray:
        """Texts in which white space meets white space across a cut: it is split there in another way."""
        begins = pc.match_substring_regex(chunks, f"^[{WHITE}]|^$").to_numpy(zero_copy_only=False)
        stops = pc.match_substring_regex(chunks, f"[{WHITE}]$|^$").to_numpy(zero_copy_only=False)
        meets = np.zeros(len(codes) + 1, bool)
        if len(codes) > 1:
            meets[1:-1] = stops[codes[:-1]] & begins[codes[1:]]
        meets[offsets[:-1]] = False
        return np.unique(np.searchsorted(offsets, np.nonzero(meets)[0], side="right") - 1)

    def merged(self, merger) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin; ``merger`` merges pre-tokens."""
        flat, lengths = self.bytes()
        m = merger.merge(flat, lengths)
        ids = np.concatenate((m.ids, self.specials))
        starts = np.concatenate((m.starts, len(m.ids) + np.arange(len(self.specials))))[self.refs]
        sizes = np.concatenate((m.sizes, np.ones(len(self.specials), np.int64)))[self.refs]
        ends = np.concatenate(([0], np.cumsum(sizes)))[self.offsets]
        return ids[ragged(starts, sizes)].astype("<i4"), ends

    def counts(self, counter: RankSynchronousCounter) -> np.ndarray:
        """Number of tokens of each text."""
        sizes = np.concatenate((counter.count(*self.bytes()), np.ones(len(self.specials), np.int64)))
        total = np.concatenate(([0], np.cumsum(sizes[self.refs])))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pre-tokens one after another, and how many each has."""
        a = pa.concat_arrays([self.tokens])
        offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
        flat = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        return flat, np.diff(offsets)


def parted(v: Vocabulary, texts: list[str]):
    """Pieces of texts in parts of about ``PART_CHARS``: (pieces, number of the text that each belongs to)."""
    pieces, owner, held = [], [], 0
    for i, t in enumerate(texts):
        start = 0
        while True:
            stop = len(t)
            if len(t) - start > PART_CHARS and (m := v.gap.search(t, start + PART_CHARS // 2)):
                stop = m.end()
            pieces.append(t[start:stop])
            owner.append(i)
            held += stop - start
            start = stop
            if held >= PART_CHARS:
                yield pieces, np.array(owner)
                pieces, owner, held = [], [], 0
            if start >= len(t):
                break
    if pieces:
        yield pieces, np.array(owner)


def encoded(v: Vocabulary, merger, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another as little-endian 32-bit integers, and where each text's begin and end."""
    ids, sizes = [], np.zeros(len(texts), np.int64)
    for pieces, owner in parted(v, texts):
        found, ends = TokenTable(v, pieces).merged(merger)
        ids.append(found)
        np.add.at(sizes, owner, np.diff(ends))
    return np.concatenate(ids) if ids else np.zeros(0, "<i4"), np.concatenate(([0], np.cumsum(sizes)))


def counted(v: Vocabulary, counter: RankSynchronousCounter, texts: list[str]) -> np.ndarray:
    """Number of tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    for pieces, owner in parted(v, texts):
        np.add.at(out, owner, TokenTable(v, pieces).counts(counter))
    return out
