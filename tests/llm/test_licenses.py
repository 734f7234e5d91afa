import random
import re
from itertools import combinations
from math import ceil

from residua.llm import licenses as m


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def blocks(w):
    last = max(1, ceil(len(w) / m.HALF)) - 1
    return [(h * m.HALF, w[h * m.HALF : (h + 2) * m.HALF]) for h in range(last + 1)]


def test_join_finds_all_matching_blocks():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(14)]
    templates = [(f"l{k}", " ".join(rng.sample(vocabulary, rng.randint(1, 10)))) for k in range(8)]
    for _ in range(150):
        text = " ".join(rng.choice([*vocabulary, "x", "y", "z", "x2", "é"]) for _ in range(rng.randint(0, 400)))
        counts = {w.encode(): rng.randint(0, 5) for w in vocabulary}
        join = m.Join.build(templates, counts, 0.7)
        expected = set()
        for at, block in blocks(words(text)):
            for label, t in templates:
                s = set(words(t))
                if len(s & set(block)) >= ceil(0.7 * len(s) - 1e-9):
                    expected.add((label, at))
        assert {(label, a) for label, a, _, _ in join.scan(m.words_of(text))} >= expected
        assert all(c >= 0.7 for *_, c in join.scan(m.words_of(text)))


def test_words_and_places():
    for t in ("GNU General-Public\x00License v3", "cc by, CC-BY ccby", "É1 a_b A"):
        assert [w.decode() for w in m.words_of(t)] == words(t)
    assert m.places(m.words_of("The MIT  License; mit license CC BY-NC. Apache, License gnu general public")) == [(1, "mit"), (3, "mit"), (5, "cc-by"), (8, "apache")]


def test_operator(spark):
    notice = dict((label, t) for label, t in m.TEMPLATES)["mit"]
    texts = [None, "", "Released under the MIT License.", "word " * 5000 + "Licensed under CC BY-NC 4.0. " + "word " * 70, "Permission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation, to deal in the Software without restriction", "nothing here", "released under the of license"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts * 2)], "doc_id bigint, text string, labels int")
    x, n = m.scan_licenses(docs)
    got = {r["doc_id"]: r for r in x.collect()}
    row = lambda k: tuple(got[k][n[c]] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert row(0) == row(1) == row(7) == (0, 0, None, None, "", "")
    assert row(2) == (5, 1, 3, 3, "mit", "mit")
    assert row(3) == (5077, 1, 5002, 5002, "cc-by", "cc-by,cc-by-nc")
    assert row(4)[1] == 0 and row(4)[5] == "mit" and 0.8 <= got[4][n["score"]] <= 1 and notice
    assert row(5)[5] == "" and got[5][n["score"]] == 0
    assert m.scan_licenses(docs.limit(0))[0].count() == 0
    assert m.scan_licenses(docs, templates=[])[0].filter(f"`{n['n_base']}` > 0").count() == 4


def test_long_templates(spark):
    templates = [(f"l{n}", " ".join(f"w{n}x{k}" for k in range(n))) for n in (49, 50, 97, 98, 200, 1000)] + [("short", "a b c")]
    texts = ["y " * before + t + " y" * 300 for _, t in templates for before in (0, 30, 47, 48, 95, 150, 383)]
    texts += ["y " * 70 + " ".join(w for k, w in enumerate(templates[4][1].split()) if k % 5) + " y" * 70, "a" + " y" * 200 + " b c"]
    x, n = m.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), templates=templates)
    got = [r[n["labels"]] for r in x.orderBy("doc_id").collect()]
    assert got == [label for label, _ in templates for _ in range(7)] + ["l200", ""]


def test_short_templates_need_their_own_words(spark):
    texts = ["Released under the Apache License", "Licensed under the Mozilla Public License, Version 2.0", "Licensed under CC BY-SA 4.0", "Released under MIT License", "licensed under the Apache License, version 2", "Licensed CC BY-NC 4.0"]
    x, n = m.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [r[n["labels"]] for r in x.orderBy("doc_id").collect()] == ["apache", "", "cc-by", "mit", "apache", "cc-by,cc-by-nc"]
    assert [m.marks_of(label, t, m.TEMPLATES) for label, t in m.TEMPLATES if len(set(m.words_of(t))) < m.SHORT] == [{b"apache"}, {b"cc", b"nc"}, {b"mit"}]


def ordered(block, template, marks, need):
    """Whether some words of the template, marks among them, stand in its order in a stretch of the block."""
    return any(set(chosen) >= marks and any(follows(chosen, block[a : a + 2 * len(template)]) for a in range(len(block)))
               for n in range(need, len(template) + 1) for chosen in combinations(template, n))


def follows(chosen, stretch):
    rest = iter(stretch)
    return all(w in rest for w in chosen)


def test_blocks_by_brute_force():
    """Every matching block, no other, of templates of several lengths, with all that the joins do."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(90)]
    templates = [(f"l{k % 7}", " ".join(rng.sample(vocabulary, n))) for k, n in enumerate((1, 2, 3, 5, 8, 9, 10, 30, 48, 49, 60, 80))]
    for _ in range(60):
        w = [rng.choice([*vocabulary, "x", "y"]) for _ in range(rng.choice([0, 1, 47, 48, 49, 97, 300, 700]))]
        for _, t in rng.sample(templates, 3):
            at = rng.randint(0, len(w))
            w[at:at] = [v for v in t.split() if rng.random() < 0.9]
        counts = {v.encode(): rng.randint(0, 5) for v in vocabulary}
        got = [s for j in m.joins(templates, counts, 0.8) for s in j.scan([v.encode() for v in w])]
        expected = {}
        for label, t in templates:
            own, half = set(t.split()), m.half_of(t)
            marks = {v.decode() for v in m.marks_of(label, t, templates)}
            for h in range(-(-len(w) // half)):
                near = w[h * half : (h + 2) * half]
                block, need = set(near), ceil(0.8 * len(own) - 1e-9)
                if len(own & block) >= need and marks <= block and (not marks or ordered(near, t.split(), marks, need)):
                    key = half, label, h * half, min(len(w), (h + 2) * half)
                    expected[key] = max(expected.get(key, 0), len(own & block) / len(own))
        assert sorted(got) == sorted((*key[1:], c) for key, c in expected.items())


def test_near_misses_and_whole_licenses(spark):
    near = {"Licensed under CC BY 4.0": "cc-by", "released under the BSD license": "", "Licensed under the Mozilla Public License, Version 2.0": "", "Released under the GNU General Public License": "gpl",
            "Released under the Apache License": "apache", "mit der Software " * 30 + "released under the license": "", "released under " + "the x " * 12 + "mit license": "mit", "released under the " + "x " * 12 + "mit und license": "", "This program is free software": ""}
    long = [(label, t) for label, t in m.TEMPLATES if len(m.words_of(t)) > 100]
    assert {label for label, _ in long} == {"bsd", "isc", "mit"}
    whole = [("intro " * before + t + " outro" * 500, label) for label, t in long for before in (0, 1, 47, 95, 200, 1000)]
    cases = [*near.items(), *whole]
    x, n = m.scan_licenses(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id bigint, text string"))
    assert [r[n["labels"]] for r in x.orderBy("doc_id").collect()] == [label for _, label in cases]


def test_kindred_notices_have_only_their_own_labels(spark):
    gnu = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    cases = [(gnu.format("This program", ""), "gpl"), (gnu.format("This program", "Affero "), "agpl"), (gnu.format("This library", "Lesser "), "lgpl"), (gnu.format("This program", "Lesser "), "lgpl")]
    cases += [(f"This work is licensed under the GNU {x}General Public License, version 3", label) for x, label in (("", "gpl"), ("Affero ", "agpl"), ("Lesser ", "lgpl"))]
    cases += [(cc.format(x), label) for x, label in (("", "cc-by"), ("-ShareAlike", "cc-by-sa"), ("-NonCommercial", "cc-by-nc"), ("-NoDerivatives", "cc-by-nd"), ("-NonCommercial-ShareAlike", "cc-by-nc-sa"), ("-NonCommercial-NoDerivatives", "cc-by-nc-nd"))]
    cases += [("Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.", "hpnd"),
              ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc")]
    rows = [(f"{'intro ' * n}{t} {'outro ' * 150}", label) for t, label in cases for n in (0, 30, 60, 200)]
    x, n = m.scan_licenses(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id bigint, text string"))
    assert [r[n["labels"]] for r in x.orderBy("doc_id").collect()] == [label for _, label in rows]


def test_what_tells_templates_apart():
    t = [("a", "one two three four five"), ("b", "one two three four five six"), ("c", "one two three four seven"), ("a", "one two three four five six eight"), ("d", "nine ten")]
    told = m.told_by(t, 0.8)
    words = lambda sets: sorted(sorted(w.decode() for w in s) for s in sets)
    assert [tuple(map(words, x)) for x in told] == [([["five"]], [["six"]]), ([["five", "six"], ["six"]], [["eight"]]), ([["seven"], ["seven"], ["seven"]], []), ([["eight"], ["eight", "five", "six"]], []), ([], [])]


def test_batches_without_template_words(spark):
    """Rows that go to Python together may have none of the templates' words; the counts of such a batch have no rows."""
    rows = [(1, None), (2, ""), (3, "zzz qqq"), (4, "Released under the MIT License")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4, "doc_id")
    for part, labels in ((docs.filter("doc_id < 4"), {1: "", 2: "", 3: ""}), (docs, {1: "", 2: "", 3: "", 4: "mit"})):
        out, names = m.scan_licenses(part)
        assert {r["doc_id"]: r[names["labels"]] for r in out.collect()} == labels
    assert m.document_counts(docs.filter("doc_id < 4"), {b"license", b"mit"}) == {}
    assert m.document_counts(docs, {b"license", b"mit"}) == {b"license": 1, b"mit": 1}
