"""Quality rules with risk-controlled cutoffs.

A rule rejects texts whose measure exceeds a cutoff.  Cutoffs come from labelled texts: of n good texts of a stratum, k
may lie at or beyond its cutoffs, the largest k for which an exact binomial test rejects "more than ``alpha`` of the good
texts are beyond".  The k places go round the rules, passing those that are down to zero, and a rule with j of them has
its j-th largest good measure as its cutoff.  These are the sequentially determined blocks of Tukey and Fraser, whose
share of all good texts depends on k and n only; so the whole ``alpha`` is spent on what the rules of a stratum reject
together, without a correction over rules or cutoffs.  Strata share out ``delta`` by Bonferroni's correction.

Strata with too few labels for a test of their own (for the defaults, 299 good texts for one test, 437 for four) have the
cutoffs of one pooled stratum: all such strata together or, if that is still too small, all strata together; so have
strata without labels.  With probability 1 - delta neither the pool nor any other stratum loses more than ``alpha`` of
its good texts; of one pooled stratum alone nothing is promised.  A stratum with few places has cutoffs for the first
rules only.  With too few labels altogether there are no cutoffs.
"""

from __future__ import annotations

from bisect import bisect_right
from math import lgamma, log, log1p

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, written
from .texts import append, encode, sha256

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
GRID = 200
ALPHA, DELTA = 0.01, 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that the text has twice or more."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) > len(words) - 1:
        return 0
    code, n = flat[: len(flat) - window + 1], len(ids)
    for k in range(1, window):
        if int(code.max()) > (1 << 62) // n:
            code = np.unique(code, return_inverse=True)[1]
        code = code * n + flat[k : len(flat) - window + 1 + k]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[hit + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """COUNTS of one text; null has none of anything but one empty line."""
    text = text or ""
    data = encode(text)
    words = data.split()  # of bytes, so at the six ASCII spaces only
    lines, seen, dup = data.split(b"\n"), set(), 0
    for x in lines:
        if x in seen:
            dup += bool(x.strip())
        else:
            seen.add(x)
    letters = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) if data else np.zeros(256, dtype=np.int64)
    return (len(words), len(text) - int(letters[[ord(c) for c in SPACES]].sum()), int(letters[[ord(c) for c in SYMBOLS]].sum()), dup, repeated_words(words), len(lines), int(letters[65:91].sum()), int(letters[33]))


def measured(docs: DataFrame, text_col="text") -> tuple[DataFrame, dict]:
    """``docs`` with COUNTS and text_sha256, and the names these got."""
    names = dict(zip(all_ := [*COUNTS, "text_sha256"], fresh(docs, *all_), strict=True))

    def work(texts: list) -> list[list]:
        return [list(c) for c in zip(*((*measure(t), sha256(encode(t))) for t in texts), strict=True)]

    return append(docs, [text_col], work, [*((names[c], "bigint") for c in COUNTS), (names["text_sha256"], "string")]), names


def rules(names: dict) -> dict[str, Column]:
    """Each rule's measure, 0 to 1; larger is worse."""
    c = {k: col(v) for k, v in names.items()}
    share = lambda a, b: F.least(F.lit(1.0), F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)))
    return {
        "symbols": share(c["n_symbols"], c["word_chars"]),
        "repeats": share(c["n_repeat_words"], c["n_words"]),
        "dup_lines": share(c["n_dup_lines"], c["n_lines"]),
        "upper": share(c["n_upper"], c["word_chars"]),
        "bangs": share(c["n_bangs"], c["n_words"]),
        "long_words": share(c["word_chars"], c["n_words"] * 40),
    }


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly but for rounding."""
    if k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return float(min(1.0, np.exp(np.array(terms) - top).sum() * np.exp(top)))


def places(n: int, alpha: float, delta: float) -> int:
    """How many of ``n`` good texts may lie at or beyond cutoffs that reject less than ``alpha``, but for a probability of ``delta``."""
    return bisect_right(range(min(n, int(2 * n * alpha) + 50)), delta, key=lambda k: at_most(k, n, alpha))


def cutoffs(good: dict[str, np.ndarray], k: int) -> dict[str, int]:
    """By rule, the cell above which it rejects, ``k`` places shared out over the rules; ``good`` counts the same good texts per cell for each."""
    beyond = {r: np.cumsum(c[::-1])[::-1] for r, c in good.items()}  # texts in a cell or above
    most = {r: int(b[1]) + 1 for r, b in beyond.items()}  # the place that is in cell 0
    own = dict.fromkeys(good, 0)
    while k > 0 and (open_ := [r for r in good if own[r] < most[r]]):
        step = max(1, min(k // len(open_), *(most[r] - own[r] for r in open_)))
        for r in open_[:k]:
            own[r] += step
            k -= step
    return {r: int(np.flatnonzero(beyond[r] >= j)[-1]) for r, j in own.items() if j}


def cutoff(good: np.ndarray, alpha: float, delta: float) -> int | None:
    """The strictest cell g such that rejecting cells above g is safe; ``good`` counts the good texts per cell. None: not even rejecting none is shown to be."""
    return cutoffs({"": good}, places(int(good.sum()), alpha, delta)).get("")


def fit(measured_docs: DataFrame, names: dict, labels: DataFrame, id_col="doc_id", stratum_col="lang", label_col="quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, int]]:
    """Cutoffs by stratum and rule, from all labelled texts; copies of a text count once.  None: those of all other strata.

    What reaches the driver is a histogram of GRID + 1 cells per stratum and rule.
    """
    x = measured_docs.select(col(id_col).alias("id"), F.coalesce(col(stratum_col).cast("string"), F.lit("")).alias("stratum"), col(names["text_sha256"]).alias("sha"),
                             *(F.floor(v * GRID).cast("int").alias(r) for r, v in rules(names).items()))
    x = x.join(labels.filter(col(label_col) == 1).select(col(id_col).alias("id")).dropDuplicates(), "id").drop("id").dropDuplicates()
    kinds = list(rules(names))
    long = x.select("stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("cell")) for r in kinds))).alias("v")).groupBy("stratum", "v.rule", "v.cell").count()
    found: dict = {}
    for r in long.collect():
        found.setdefault(r["stratum"], {k: np.zeros(GRID + 1, dtype=np.int64) for k in kinds})[r["rule"]][r["cell"]] += r["count"]
    size = {s: int(good[kinds[0]].sum()) for s, good in found.items()}
    by_size = sorted(size, key=lambda s: (-size[s], s))
    k = 0  # strata with cutoffs of their own, chosen by their sizes alone; one more test is the pool's
    while k < len(by_size) and places(size[by_size[k]], alpha, delta / (k + 2)):
        k += 1
    pool = by_size[k:]
    if not places(sum(size[s] for s in pool), alpha, delta / (k + 1)):
        pool = by_size
    sets: dict = {s: found[s] for s in by_size[:k]}
    sets[None] = {r: sum((found[s][r] for s in pool), np.zeros(GRID + 1, dtype=np.int64)) for r in kinds}
    return {s: cutoffs(good, places(int(good[kinds[0]].sum()), alpha, delta / (k + 1))) for s, good in sets.items()}


def verdicts(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", stratum_col="lang", label_col="quality", alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, dict]:
    """id and stratum columns of ``docs`` with COUNTS, base_failed, failed_rules, kept; and the new columns' names.

    Base: fewer than 50 words, or over half of them in repeated 3-word windows.  Null and empty texts have no words and
    fail.  Without labels no rule has a cutoff.  A null stratum counts as an empty one; repeated rows give repeated results.
    Columns of ``docs`` beside id, stratum and text are not read; where these have one of the new names they keep it.
    """
    small = docs.select(*dict.fromkeys([id_col, stratum_col, text_col]))
    x, names = measured(small, text_col)
    x = written(x.drop(text_col), "measures")
    found = fit(x, names, labels, id_col, stratum_col, label_col, alpha, delta)
    stratum = F.coalesce(col(stratum_col).cast("string"), F.lit(""))
    fails = []
    for r, v in rules(names).items():
        cells = {s: c.get(r, GRID) for s, c in found.items()}
        if min(cells.values()) < GRID:
            limit = F.lit(cells.pop(None))
            if cells:  # a stratum here has enough labels for a guarantee, so there are few of them
                limit = F.coalesce(F.element_at(F.create_map(*(F.lit(y) for p in cells.items() for y in p)), stratum), limit)
            fails.append(F.when(F.floor(v * GRID) > limit, F.lit(r)))
    more = dict(zip(n := ["base_failed", "failed_rules", "kept"], fresh(x, *n), strict=True))
    n_words, repeats = col(names["n_words"]), col(names["n_repeat_words"])
    failed = F.concat_ws(",", *fails) if fails else F.lit("")
    x = x.withColumns({more["base_failed"]: (n_words < 50) | (100 * repeats > 50 * n_words), more["failed_rules"]: failed})
    return x.withColumn(more["kept"], ~col(more["base_failed"]) & (col(more["failed_rules"]) == "")), names | more
