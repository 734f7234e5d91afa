"""License scans by an exact set-similarity join of text blocks with license templates.

Blocks are runs of 2 * half consecutive words, one from every half-th word on, so every passage of half + 1 words lies in one.
half is HALF for templates of up to HALF + 1 words and twice that, four times that and so on for longer ones, so that
each template's words lie in one block wherever they are; templates of one half are joined together.
A block matches a template of distinct words T if it has at least o = ceil(threshold * |T|) of them.  The template words
are ordered by how many documents have them, rarest first, over all documents.  A match must have one of the first
|T| - o + 1 words of T (prefix filter), at least o template words (length filter), and after the first common word, in
this order, enough words must follow on both sides (positional filter).  What is left is compared whole.  Of a template
of fewer than SHORT distinct words a block must also have all words that no template of another label has, since the
threshold alone would let another license's name pass for it, and these and o words in all must stand in the template's
order in a stretch of twice its words, since a block has common words anyway.

Notices of kindred licenses differ in a word or two: each template is told from those of other labels that share the
threshold of its words or their own.  A match stands only if the block has all words that tell its template from such a
neighbour; where a template has none because the neighbour only adds words, it stands unless the block has those.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh
from .texts import append, by_batch, encode

HALF = 48
THRESHOLD = 0.8
SHORT = 10

#: Phrases whose every place counts, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Customary license notices and the texts of short licenses, with their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("hpnd", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
            "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
            "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

#: Bytes of words as they are, A-Z in lower case, all others as spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return encode(text).translate(WORDS).split()


def half_of(template: str) -> int:
    half, n = HALF, len(words_of(template))
    while half + 1 < n:
        half *= 2
    return half


def marks_of(label: str, template: str, known: list[tuple[str, str]]) -> set[bytes]:
    """The words of a short template that no template of another label has."""
    own = set(words_of(template))
    return own.difference(*(words_of(t) for other, t in known if other != label)) if known and len(own) < SHORT else set()


def told_by(templates: list[tuple[str, str]], threshold: float) -> list[tuple[list[frozenset[bytes]], list[frozenset[bytes]]]]:
    """For each template what a block must have, all words of each set, and what it must not, to be no neighbour's."""
    sets = [(label, frozenset(words_of(t))) for label, t in templates]
    out = []
    for label, s in sets:
        near = [t for other, t in sets if other != label and s and t and len(s & t) >= threshold * min(len(s), len(t)) - 1e-9]
        out.append(([s - t for t in near if s - t], [t - s for t in near if not s - t and t - s]))
    return out


@dataclass
class Join:
    """The template side of the join: word sets as ranks in the global order, required overlaps, an index of the prefixes, half of a block, and words that must not lack."""

    rank: dict[bytes, int]
    sets: list[tuple[str, frozenset[int], int]]
    prefix: dict[int, list[tuple[int, int]]]
    half: int
    marks: list[frozenset[int]]
    orders: list[list[int]]

    @classmethod
    def build(cls, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float, known: list[tuple[str, str]] = ()) -> Join:
        """``known``: the templates that short ones must be told from."""
        vocabulary = {w for _, t in templates for w in words_of(t)}
        rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        sets = [(label, frozenset(rank[w] for w in words_of(t))) for label, t in templates]
        sets = [(label, s, ceil(threshold * len(s) - 1e-9)) for label, s in sets]
        prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (_, s, need) in enumerate(sets):
            for i, r in enumerate(sorted(s)[: len(s) - need + 1]):
                prefix.setdefault(r, []).append((k, i))
        marks = [frozenset(rank[w] for w in marks_of(label, t, known)) for label, t in templates]
        orders = [[rank[w] for w in words_of(t)] for _, t in templates]
        return cls(rank, sets, prefix, max((half_of(t) for _, t in templates), default=HALF), marks, orders)

    def matches(self, block: set[int]) -> list[tuple[int, float]]:
        """Templates that the block, as a set of ranks, contains to the threshold, and how much of them."""
        own, tried, out = sorted(block), set(), []
        for j, r in enumerate(own):
            for k, i in self.prefix.get(r, ()):
                if k in tried:
                    continue
                tried.add(k)  # the first common word decides
                _, s, need = self.sets[k]
                if len(own) < need or 1 + min(len(s) - i - 1, len(own) - j - 1) < need:
                    continue
                common = len(s & block)
                if common >= need and self.marks[k] <= block:
                    out.append((k, common / len(s)))
        return out

    def in_order(self, k: int, at: list[tuple[int, int]]) -> bool:
        """Whether a stretch of the block, given as places and ranks of template words, has enough of template k in its order, its marks among them."""
        _, own, need = self.sets[k]
        marks, order, first = self.marks[k], self.orders[k], 0
        at = [(p, r) for p, r in at if r in own]
        weight = {r: len(order) + 1 if r in marks else 1 for r in own}
        least = len(marks) * (len(order) + 1) + need - len(marks)
        for last in range(len(at)):
            while at[last][0] - at[first][0] >= 2 * len(order):
                first += 1
            best = [0] * (len(order) + 1)  # of a common subsequence with each beginning of the template
            for _, r in at[first : last + 1]:
                for j in range(len(order), 0, -1):
                    if order[j - 1] == r:
                        best[j] = max(best[j], best[j - 1] + weight[r])
                for j in range(1, len(order) + 1):
                    best[j] = max(best[j], best[j - 1])
            if best[-1] >= least:
                return True
        return False

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """label, first word, end word, containment: for each label and matching block its best template."""
        at = [(p, self.rank[w]) for p, w in enumerate(words) if w in self.rank]
        if not any(r in self.prefix for _, r in at):
            return []
        halves: dict[int, set[int]] = {}
        for p, r in at:
            halves.setdefault(p // self.half, set()).add(r)
        out = []
        for h in sorted({h for x in halves for h in (x - 1, x) if h >= 0}):
            best: dict[str, float] = {}
            for k, c in self.matches(halves.get(h, set()) | halves.get(h + 1, set())):
                if self.marks[k] and not self.in_order(k, [x for x in at if h <= x[0] // self.half <= h + 1]):
                    continue
                best[self.sets[k][0]] = max(c, best.get(self.sets[k][0], 0.0))
            out += [(label, h * self.half, min(len(words), (h + 2) * self.half), c) for label, c in sorted(best.items())]
        return out


def joins(templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float) -> list[Join]:
    """A join for the templates of each half."""
    by: dict[int, list] = {}
    for label, t in templates:
        by.setdefault(half_of(t), []).append((label, t))
    return [Join.build(own, counts, threshold, templates) for _, own in sorted(by.items())]


def places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """First word and label of every place of a phrase."""
    split = {tuple(p.encode().split()): label for p, label in phrases.items()}
    first = {p[0] for p in split}
    return [(k, label) for k, w in enumerate(words) if w in first for p, label in split.items() if p[0] == w and tuple(words[k : k + len(p)]) == p]


def document_counts(docs: DataFrame, vocabulary: set[bytes], text_col="text") -> dict[bytes, int]:
    """In how many documents each word of the templates' vocabulary is; one row per word reaches the driver."""
    known = frozenset(vocabulary)

    def work(x: pd.DataFrame) -> pd.DataFrame:
        n: dict[bytes, int] = {}
        for t in x["text"]:
            for w in known.intersection(words_of(t)):
                n[w] = n.get(w, 0) + 1
        return pd.DataFrame({"word": [w.decode() for w in n], "n": list(n.values())})

    rows = by_batch(docs.select(col(text_col).alias("text")), ["text"], work, "word string, n bigint")
    return {r["word"].encode(): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, text_col="text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> tuple[DataFrame, dict]:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans; and the names they got.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  Base: all places of PHRASES, the
    smallest and largest first word among them, and their labels.  spans: label, first word, end word and containment of
    every matching block, shorter blocks first.  labels: base labels and those of spans.  score: the largest containment, 1 for a phrase, 0
    for nothing.  Null texts are empty ones, without words or labels; repeated rows give repeated results.  Columns of
    ``docs`` that have one of the new names keep it: the new column gets another.
    """
    templates = TEMPLATES if templates is None else templates
    counts = document_counts(docs, {w for _, t in templates for w in words_of(t)}, text_col) if templates else {}
    sides = joins(templates, counts, threshold)
    rules: dict[tuple[str, int], list] = {}
    for (label, t), told in zip(templates, told_by(templates, threshold), strict=True):
        rules.setdefault((label, half_of(t)), []).append((frozenset(words_of(t)), marks_of(label, t, templates), *told))

    def stands(words: list[bytes], span: tuple, half: int) -> bool:
        """Whether a template of the span's label that the block matches is told from its neighbours there."""
        block = set(words[span[1] : span[2]])
        return any(len(s & block) >= ceil(threshold * len(s) - 1e-9) and marks <= block and all(n <= block for n in needs) and not any(n <= block for n in bars) for s, marks, needs, bars in rules[span[0], half])

    def work(texts: list) -> list[list]:
        out = []
        for t in texts:
            words = words_of(t)
            base, spans = places(words), [s for j in sides for s in j.scan(words) if stands(words, s, j.half)]
            own = sorted({label for _, label in base})
            score = max([1.0 if base else 0.0, *(c for *_, c in spans)])
            out.append((len(words), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None), ",".join(own), ",".join(sorted({*own, *(s[0] for s in spans)})), score,
                        [dict(zip(("label", "first", "end", "containment"), s, strict=True)) for s in spans]))
        return [list(c) for c in zip(*out, strict=True)]

    fields = [("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", "array<struct<label:string,first:bigint,end:bigint,containment:double>>")]
    names = dict(zip((n for n, _ in fields), fresh(docs, *(n for n, _ in fields)), strict=True))
    return append(docs, [text_col], work, [(names[n], kind) for n, kind in fields]), names
