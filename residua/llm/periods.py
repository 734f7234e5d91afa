"""Periodic runs of words: a suffix automaton whose end positions are merged small to large.

A run of period q is a stretch of words in which words q apart are equal, at least ``least`` words and two periods long,
that no neighbouring word extends; q is its smallest period.

Where a run is, its words but for the last q occur again q words later, so at least half of ``least`` words lie in equal
windows of that many words.  Words in windows that a text has once are in no run: what is left of most texts is nothing,
and each stretch of the rest is searched alone, in a suffix automaton of its own.

The states of the automaton form a tree by their suffix links; a state's end positions are its own and those of the
states below.  From the longest state to the shortest the smaller set goes into the larger one, position by position.  A
position and its new neighbour, d apart, in the set of a state of length l >= d are a square: the last l + d words have
period d, and can't be extended to the left if the two meet here first.  Both ends of a run's first square meet as
neighbours in the state of its first words (were a third occurrence between them, the run's period would be smaller), so
every run is found; extended to the right it is whole.  Of squares that grow to the same stretch the smallest period counts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .common import fresh
from .texts import append, encode

#: Positions of a block of an ordered set, at most twice.
BLOCK = 512
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Ends:
    """An ordered set of positions in short blocks, so that putting one into a large set moves few others."""

    __slots__ = ("blocks", "firsts", "n")

    def __init__(self, one: int):
        self.blocks, self.firsts, self.n = [[one]], [one], 1

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Puts in x, which it hasn't; returns its neighbours."""
        k = max(0, bisect_right(self.firsts, x) - 1)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else None
        after = block[i] if i < len(block) else self.firsts[k + 1] if k + 1 < len(self.firsts) else None
        block.insert(i, x)
        if not i:  # only before all others
            self.firsts[k] = x
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts.insert(k + 1, block[BLOCK])
        self.n += 1
        return before, after


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state of the suffix automaton its length, its suffix link and, unless it is a clone, its end position, else -1."""
    length, link, end, go = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(word):
        new = len(length)
        length.append(at + 1)
        end.append(at)
        go.append({})
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link.append(q)
            else:
                clone = new + 1
                link.append(clone)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                go.append(go[q].copy())
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = clone
        last = new
    return length, link, end


def squares(word: list[int], shortest: int) -> set[tuple[int, int, int]]:
    """period, start, end (of its last word) of squares from which all runs grow whose first words, all but a period, are ``shortest`` or more."""
    length, link, end = automaton(word)
    sets: list = [Ends(e) if e >= 0 else None for e in end]
    found = set()
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        own, p = sets[state], link[state]
        sets[state] = None
        if p < 0 or (most := length[p]) < shortest:
            continue
        into = sets[p]
        if into is None:
            sets[p] = own
            continue
        if into.n < own.n:
            into, own = own, into
        for x in own:
            before, after = into.add(x)
            if before is not None and x - before <= most:
                found.add((x - before, before - most + 1, x))
            if after is not None and after - x <= most:
                found.add((after - x, x - most + 1, after))
        sets[p] = into
    return found


def stretch_runs(word: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of one stretch, by start, then period."""
    best: dict[tuple[int, int], int] = {}
    period, reach, first = 0, -1, 0
    for d, start, end in sorted(squares(word.tolist(), (least + 1) // 2), key=lambda s: (s[0], s[2], s[1])):
        if d != period:
            period, reach, first = d, -1, 0
        if end < reach and start >= first:  # within the last run of this period
            continue
        size = 64
        end += 1
        while end < len(word):  # grow to the right by doubling steps
            equal = word[end : end + size] == word[end - d : end - d + min(size, len(word) - end)]
            if not equal.all():
                end += int(np.argmin(equal))
                break
            end += len(equal)
            size *= 2
        reach, first = end, start
        if end - start >= max(least, 2 * d):
            best[start, end] = min(d, best.get((start, end), d))
    return sorted((s, e - s, d) for (s, e), d in best.items())


def candidates(word: np.ndarray, size: int) -> np.ndarray:
    """Bounds (rows of begin, end) of the stretches of words in windows of ``size`` words that the text has twice or more."""
    n = len(word) - size + 1
    if n < 2:
        return np.empty((0, 2), dtype=np.int64)
    code, kinds = word[:n], int(word.max()) + 1
    top = kinds
    for k in range(1, size):
        if top > (1 << 62) // kinds:  # exact names: pairs of places, renumbered before they overflow
            code = np.unique(code, return_inverse=True)[1]
            top = n
        code = code * kinds + word[k : k + n]
        top *= kinds
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return np.empty((0, 2), dtype=np.int64)
    hit = np.unique(np.r_[order[1:][same], order[:-1][same]])
    change = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + size, -1)
    inside = np.r_[0, (np.cumsum(change) > 0).astype(np.int8), 0]
    step = np.diff(inside)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


def word_runs(word: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a text, its words as numbers from 0 on, by start, then period."""
    out = []
    for a, b in candidates(word, max(1, (least + 1) // 2)).tolist():
        if b - a >= least:
            out += [(a + s, n, q) for s, n, q in stretch_runs(word[a:b], least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run goes but for its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, text_col="text", least: int = 12, edit: tuple[list[str], Callable[..., list]] | None = None) -> tuple[DataFrame, dict]:
    r"""``docs`` with n_words, runs (array of start, length, period, by start, then period) and collapsed_text; and the names these got.

    Words are `[^\x20\x09-\x0D]+`, numbered from 0; collapsed_text has those that no run contains after its first
    period, joined by one space.  ``edit``, columns and a function of their values and a text's words, may put other
    words in place first.  Null and empty texts, and texts without a word, have no words, no runs and an empty
    collapsed_text; texts of fewer than ``least`` words have no runs.  Every row is worked on alone, so repeated rows
    give repeated results and ids may be null; an empty table gives an empty one.  Columns of ``docs`` that have one of
    the new names keep it: the new column gets another.  A text is searched whole, in memory of some hundred bytes a
    word of its stretches of repeated windows.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    columns, change = edit or ([], None)

    def one(text: str | None, *more) -> tuple:
        words = encode(text).split()  # of bytes, so at the six ASCII spaces only
        if change is not None:
            words = change(*more, words)
        runs = word_runs(numbered(words), least)
        kept = [words[k] for k in np.flatnonzero(collapsed(len(words), runs)).tolist()] if runs else words
        return len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept).decode("utf-8", "surrogatepass")

    def work(texts: list, *more: list) -> list[list]:
        return [list(c) for c in zip(*map(one, texts, *more), strict=True)] if texts else [[], [], []]

    names = dict(zip(all_ := ["n_words", "runs", "collapsed_text"], fresh(docs, *all_), strict=True))
    return append(docs, [text_col, *columns], work, [(names["n_words"], "bigint"), (names["runs"], RUNS), (names["collapsed_text"], "string")]), names
