"""The operators' rules in plain Python, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def mix(rows, share=1.5, weights=(5, 2, 1)):
    """rows: (id, size, source). Per row: source_size, target, taken."""
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, n, t in rows if t == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, left, open_ = {}, share * sum(size.values()), set(sources)
    while True:
        part = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * size[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    out = []
    for s in sources:
        at = 0
        for i, n, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest(), r[1])):
            taken = sum(max(0, min(n, int(target[s] + 1e-6) - size[s] * p - at)) for p in (0, 1))
            out.append((i, n, size[s], round(target[s], 6), taken))
            at += n
    return out


def lines(texts, most=10):
    """Per text: number of lines, of dropped ones, kept text."""
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    n = {}
    for s in split:
        for k in {key(x) for x in s}:
            n[k] = n.get(k, 0) + 1
    gone = {k for k, c in n.items() if k and c >= most}
    return [(len(s), sum(key(x) in gone for x in s), "\n".join(x for x in s if key(x) not in gone)) for s in split]


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def classes(rows, size, percent):
    """rows: (id, text), ids may be null. Per row: shingles, component id, kept."""
    sets, parent = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return [(i, len(sets[k]), least[root(k)], least[root(k)] is None or i == least[root(k)]) for k, (i, _) in enumerate(rows)]
