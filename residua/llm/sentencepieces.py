"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The texts of a batch are cut into words where no merge can reach across; words that were not seen before lie in one
flat array of symbols.  Each round finds every word's best-ranked adjacent pair by a segmented minimum, merges all its
occurrences at once, leftmost first where they overlap, and drops the words that have no pair left.

Merging all occurrences at once equals merging one by one as long as the merged piece can't begin a pair of a still
better rank.  For pieces that can, only the leftmost occurrence of a word is merged in a round.

A long word has many ranks and occurrences, so there a pair is merged as soon as it is the best within ``reach`` symbols
on both sides, and of equal ones those after the first whose piece has a pair as good as its own, with the symbols that
stand beside it, wait for the next round.
What a merge leads to stays in one piece, so nothing from farther away can get between; waiting, too, ends with a gap
of ``reach`` symbols.  The rounds then grow with ``reach`` and the logarithm of the length, not with the length.  Where
pieces wait for each other all along a word (spaces do: their runs have equal ranks), rounds get slow and a queue of
pairs finishes it.
"""

from __future__ import annotations

import re
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import col
from .texts import by_batch, sha256, slices

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Words, and characters of words, whose pieces are remembered by a worker; beyond either the memory starts anew.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8 << 20
#: Longer words are also cut between characters that are adjacent in no piece, and remembered for one batch only.
LONG_WORD = 256
#: If this many rounds leave more than this part of long words' symbols, the rest is merged pair by pair.
ROUNDS, SLOW = 8, 0.98


def least_near(rank: np.ndarray, before: int, after: int) -> np.ndarray:
    """The least of the ranks from ``before`` places before each to ``after`` places after it."""
    width, step = before + after + 1, 1
    out = np.concatenate([np.full(before, NONE, rank.dtype), rank, np.full(after, NONE, rank.dtype)])
    while 2 * step <= width:  # of runs of ``step`` places, by doubling
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(rank)], out[width - step : width - step + len(rank)])


class Vocabulary:
    """Pieces, scores and kinds of a model file, and what encoding and decoding derive from them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], control: set[int], unknown: int, eos: int, dummy_prefix: bool, unknown_surface: str):
        self.pieces, self.scores, self.byte_ids, self.control = pieces, scores, byte_ids, control
        self.unknown, self.eos, self.dummy_prefix, self.unknown_surface = unknown, eos, dummy_prefix, unknown_surface
        self.memory: dict[str, tuple[int, ...]] = {}
        self.chars, self.passing = 0, []

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, kinds = m.normalizer_spec, {p.type for p in m.pieces}
        # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or kinds & {4, 5} or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation and without user-defined or unused pieces")
        if not m.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback")
        byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        return cls([p.piece if p.type == 1 else "" for p in m.pieces], [p.score for p in m.pieces], byte_ids, {i for i, p in enumerate(m.pieces) if p.type == 3},
                   next(i for i, p in enumerate(m.pieces) if p.type == 2), m.trainer_spec.eos_id, n.add_dummy_prefix, m.trainer_spec.unk_surface)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("pieces", "scores", "byte_ids", "control", "unknown", "eos", "dummy_prefix", "unknown_surface")} | {"memory": {}, "chars": 0, "passing": []}

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if p}

    @cached_property
    def symbol_of(self) -> np.ndarray:
        """The piece of each single character; characters without one follow the vocabulary."""
        out = np.arange(0x110000, dtype=np.int32) + len(self.pieces)
        for p, i in self.ids.items():
            if len(p) == 1:
                out[ord(p)] = i
        return out

    @cached_property
    def rank_of(self) -> np.ndarray:
        """0 for the best score; equal scores have equal ranks. A last entry is for no piece."""
        best = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        return np.array([best.get(s, NONE) if p else NONE for p, s in zip(self.pieces, self.scores, strict=True)] + [NONE], dtype=np.int32)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys left * 2^32 + right of all mergeable pairs, and the merged piece of each."""
        found = [(self.ids[p[:k]] << 32 | self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        keys, merged = (np.array(x) for x in zip(*sorted(found), strict=True))
        return keys.astype(np.int64), merged.astype(np.int32)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The pairs in an open-addressing hash table: keys (-1: free), merged pieces, and the longest probe."""
        keys, merged = self.pairs
        size = 1 << (4 * len(keys)).bit_length()
        slots, values, rest, step = np.full(size, -1, dtype=np.int64), np.full(size, len(self.pieces), dtype=np.int32), np.arange(len(keys)), 0
        while len(rest):
            at = self._slot(keys[rest], size, step)
            new = rest[slots[at] == -1]
            slots[self._slot(keys[new], size, step)] = keys[new]  # of keys with one slot the last stays
            placed = slots[at] == keys[rest]
            values[at[placed]] = merged[rest[placed]]
            rest, step = rest[~placed], step + 1
        return slots, values, step

    @staticmethod
    def _slot(keys: np.ndarray, size: int, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) + step * (step + 1) // 2) & (size - 1)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair of symbols merges into; the number of pieces if nothing."""
        slots, values, steps = self.table
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key, len(slots), 0)
        out = values[at]
        rest = np.flatnonzero(slots[at] != key)
        out[rest] = len(self.pieces)
        rest = rest[slots[at[rest]] != -1]
        for step in range(1, steps):
            if not len(rest):
                break
            at = self._slot(key[rest], len(slots), step)
            here = slots[at] == key[rest]
            out[rest[here]] = values[at[here]]
            rest = rest[~here & (slots[at] != -1)]
        return out

    @cached_property
    def one_by_one(self) -> np.ndarray:
        """Pieces that are half of a pair with a rank no worse than their own."""
        keys, merged = self.pairs
        out = np.zeros(len(self.pieces) + 1, dtype=bool)
        for half in (keys >> 32, keys & 0xFFFFFFFF):
            out[half[self.rank_of[merged] <= self.rank_of[half]]] = True
        return out

    @cached_property
    def cutter(self) -> re.Pattern:
        """Words: spaces with what follows them. Line feeds stand alone if no piece has one."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):  # a merge could then reach over the end of a word
            return re.compile(r"(?s).+")
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if any("\n" in p for p in self.ids) else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    @cached_property
    def adjacent(self) -> set[str]:
        return {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    @cached_property
    def numerals(self) -> list[str]:
        return [str(i) for i in range(len(self.pieces))]

    @cached_property
    def surfaces(self) -> list[bytes]:
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            out[i] = bytes([b])
        out[self.unknown] = self.unknown_surface.encode()
        return out

    @cached_property
    def reach(self) -> int:
        """Symbols between two merges that keep whatever they lead to apart."""
        return 2 * max(map(len, self.ids)) + 2

    def rank_beside(self, left: np.ndarray, right: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols that is ``there``."""
        out = np.full(len(left), NONE, dtype=np.int32)
        at = np.flatnonzero(there)
        out[at] = self.rank_of[self.pair(left[at], right[at])]
        return out

    @cached_property
    def merges(self) -> dict[int, int]:
        return dict(zip(self.pairs[0].tolist(), self.pairs[1].tolist(), strict=True))

    def in_turn(self, symbols: list[int]) -> list[int]:
        """Merge by merge, the best pair first, of equal ones the leftmost, from a queue of rank * 2^32 + place."""
        n, pair, nothing, ranks = len(symbols), self.merges, len(self.pieces), self.rank_of.tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        symbols = [*symbols, -1]  # -1: merged into one before it, or the end
        queue = [ranks[m] << 32 | k for k in range(n - 1) if (m := pair.get(symbols[k] << 32 | symbols[k + 1], nothing)) != nothing]
        heapify(queue)
        while queue:
            key = heappop(queue)
            k = key & 0xFFFFFFFF
            m = after[k] if symbols[k] >= 0 else n
            found = pair.get(symbols[k] << 32 | symbols[m], nothing) if m < n else nothing
            if found == nothing or ranks[found] != key >> 32:
                continue  # what stood there is gone
            symbols[k], symbols[m], after[k] = found, -1, after[m]
            a, b = before[k], after[k]
            if a >= 0 and (m := pair.get(symbols[a] << 32 | found, nothing)) != nothing:
                heappush(queue, ranks[m] << 32 | a)
            if b < n:
                before[b] = k
                if (m := pair.get(found << 32 | symbols[b], nothing)) != nothing:
                    heappush(queue, ranks[m] << 32 | k)
        return [s for s in symbols if s >= 0]

    def merged(self, words: list[str], reach: int = 0) -> list[tuple[int, ...]]:
        """The ids of each word; with ``reach`` pairs are merged that are the best within so many symbols, else the best of words."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        nothing = len(self.pieces)
        # found[k]: what the pair of symbols k and k + 1 merges into
        last = np.r_[word[1:] != word[:-1], True]
        found = np.full(len(symbols), nothing, dtype=np.int32)
        at = np.flatnonzero(~last)
        found[at] = self.pair(symbols[at], symbols[at + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rounds, size = 0, 0
        while len(symbols):
            first = np.flatnonzero(np.r_[True, last[:-1]])
            sizes = np.diff(np.r_[first, len(word)])
            rank = self.rank_of[found]
            best = np.minimum.reduceat(rank, first)
            more = best != NONE
            rounds += 1
            if not more.all():
                open_ = np.repeat(more, sizes)
                done.append((word[~open_], symbols[~open_]))
                symbols, word, found, rank, last = symbols[open_], word[open_], found[open_], rank[open_], last[open_]
                sizes, best = sizes[more], best[more]
                first = np.cumsum(sizes) - sizes
                if not len(symbols):
                    break
            slow = reach and rounds % ROUNDS == 0 and len(symbols) > SLOW * size
            size = size if rounds % ROUNDS else len(symbols)
            if slow and rounds > ROUNDS:
                for a, b in zip(first.tolist(), (first + sizes).tolist(), strict=True):
                    rest = np.array(self.in_turn(symbols[a:b].tolist()), dtype=np.int32)
                    done.append((np.full(len(rest), word[a], dtype=np.int32), rest))
                break
            hit = (rank == least_near(rank, reach, reach)) & (rank != NONE) if reach else rank == np.repeat(best, sizes)
            place = np.flatnonzero(hit)
            early = least_near(np.where(hit, NONE, rank), reach, 0)[place] == rank[place] if reach else np.zeros(len(place), dtype=bool)
            run = np.r_[True, place[1:] != place[:-1] + 1]
            order = np.arange(len(place))
            odd = (order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0  # of overlapping pairs the leftmost, then every second
            place, early = place[odd], early[odd]
            single = self.one_by_one[found[place]]
            if reach and (early.any() or single.any()):
                place = place[self.settled(symbols, word, found, rank, place, early, reach)]
            elif single.any():  # in short words one such piece a round
                of = word[place]
                place = place[~single | np.r_[True, of[1:] != of[:-1]]]
            symbols[place] = found[place]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            last[place] = last[place + 1]
            moved = place - np.arange(len(place))
            symbols, word, found, last = symbols[keep], word[keep], found[keep], last[keep]
            at = np.r_[moved, moved[moved > 0] - 1]
            inner = at[~last[at]]
            found[at[last[at]]] = nothing
            found[inner] = self.pair(symbols[inner], symbols[inner + 1])
        if not done:
            return [() for _ in words]
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        symbols, v = symbols[order], len(self.pieces)
        strange = set(word[order][symbols >= v].tolist())
        flat = symbols.tolist()
        out = [tuple(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for k in strange:
            out[k] = tuple(j for i in out[k] for j in ([i] if i < v else [self.byte_ids[x] for x in chr(i - v).encode("utf-8", "surrogatepass")]))
        return out

    def settled(self, symbols: np.ndarray, word: np.ndarray, found: np.ndarray, rank: np.ndarray, place: np.ndarray, early: np.ndarray, reach: int) -> np.ndarray:
        """Which of the places in long words can be merged together.

        Of places of a word no more than ``reach`` apart, those up to the first whose piece has a pair as good as its
        own, and before the first that is ``early``: it has an equal pair before it that has to wait.
        """
        piece, of, n = found[place], word[place], len(symbols)
        single = np.flatnonzero(self.one_by_one[piece])
        p, own = place[single], rank[place[single]]
        near = np.r_[False, place[1:] == place[:-1] + 2][single] & (single > 0)  # the pair before it is merged first
        left = np.where(near, piece[np.maximum(single - 1, 0)], symbols[np.maximum(p - 1, 0)])
        right = symbols[np.minimum(p + 2, n - 1)]
        beside = np.minimum(self.rank_beside(left, piece[single], (p > 0) & (word[np.maximum(p - 1, 0)] == of[single])),
                            self.rank_beside(piece[single], right, (p + 2 < n) & (word[np.minimum(p + 2, n - 1)] == of[single])))
        restless = np.zeros(len(place), dtype=np.int64)
        restless[single[beside <= own]] = 1
        begins = np.r_[True, (of[1:] != of[:-1]) | (place[1:] - place[:-1] > reach)]
        stop = np.cumsum(restless + early) - restless
        start = stop[begins] - early[begins]
        return stop == np.repeat(start, np.diff(np.r_[np.flatnonzero(begins), len(place)]))

    def split_long(self, word: str) -> list[str]:
        cuts = [0, *(k + 1 for k in range(len(word) - 1) if word[k : k + 2] not in self.adjacent), len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        found = self.cutter.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))
        if max(map(len, found)) > LONG_WORD:
            found = [x for w in found for x in (self.split_long(w) if len(w) > LONG_WORD else [w])]
        return found

    def learn(self, words: set[str]) -> None:
        """Remember the ids of these words; those of long ones until the next call."""
        for w in self.passing:
            self.memory.pop(w, None)
        new = [w for w in words if w not in self.memory]
        chars = sum(len(w) for w in new if len(w) <= LONG_WORD)
        if len(self.memory) + len(new) > REMEMBERED or self.chars + chars > REMEMBERED_CHARS:
            self.memory.clear()
            self.chars, new = 0, list(words)
            chars = sum(len(w) for w in new if len(w) <= LONG_WORD)
        self.chars += chars
        short, self.passing = [w for w in new if len(w) <= LONG_WORD], [w for w in new if len(w) > LONG_WORD]
        self.memory.update(zip(short, self.merged(short), strict=True))
        self.memory.update(zip(self.passing, self.merged(self.passing, self.reach), strict=True))

    def encode(self, text: str | None, eos: bool = True) -> list[int]:
        words = self.words(text or "")
        self.learn(set(words))
        return [i for w in words for i in self.memory[w]] + [self.eos] * eos

    def decode(self, ids) -> bytes:
        """The text in UTF-8: pieces joined, a space for each space symbol, without the one put before the text; invalid byte runs become U+FFFD for each byte."""
        ids = [i for i in ids if i not in self.control] if not self.control.isdisjoint(ids) else ids
        data = b"".join(map(self.surfaces.__getitem__, ids))
        try:
            data.decode()
        except UnicodeDecodeError:
            data = re.sub("[\udc80-\udcff]", "\ufffd", data.decode("utf-8", "surrogateescape")).encode()
        return data[1:] if self.dummy_prefix and ids and self.pieces[ids[0]].startswith(SPACE) else data


def roundtrip(docs: DataFrame, vocabulary: Vocabulary, id_col="doc_id", text_col="text", ids: bool = False) -> DataFrame:
    """Per document: id_col, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also token_ids and decoded.

    Null texts count as empty ones, which are the end id alone; repeated rows give repeated results; other columns of
    ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(x: pd.DataFrame) -> pd.DataFrame:
        v, out = shared.value, []
        texts = x["text"].tolist()
        for a, b in slices([t or "" for t in texts]):
            split = [v.words(t or "") for t in texts[a:b]]
            v.learn(set().union(*split))
            for words in split:
                tokens = [*chain.from_iterable(map(v.memory.__getitem__, words)), v.eos]
                line = " ".join(map(v.numerals.__getitem__, tokens))
                decoded = v.decode(tokens)
                out.append((len(tokens), sha256(line.encode()), sha256(decoded), *((tokens, decoded.decode()) if ids else ())))
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids", "decoded"] if ids else [])]
        return pd.concat([x[["id"]], pd.DataFrame(out, columns=names)], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>, decoded string" if ids else "")
    out = by_batch(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), ["id", "text"], work, schema)
    return out.withColumnRenamed("id", id_col)
