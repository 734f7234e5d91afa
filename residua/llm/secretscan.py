"""Secrets in texts: fixed patterns, and values in a credential context that cost too many guesses to be made up by hand.

Three patterns find assignments, access keys and hex strings.  Beside them the values that stand where a credential
stands (after "password:", "api-key =", "passphrase is" and the like, quoted or not) are priced by ``guesses.Guesses``:
those that a guesser needs ``least`` guesses for or more are secrets of the kind ``guess``; placeholders, words, dates
and keyboard walks cost less.  The default, 1e10, is where published strength meters call a password very hard to guess.

The words that a guesser tries first are those of the corpus, counted over all texts; the few best-known password words
come before them.  What reaches the driver is a histogram of how common words are, some hundred cells, and the ``most``
commonest words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, fresh, written
from .guesses import LONGEST_WORD, PASSWORDS, SHORTEST, Guesses
from .texts import append, encode, give_back, ready, sliced

KINDS = ("assign", "access", "hex", "guess")
LEAST_GUESSES, MOST_WORDS = 1e10, 20_000
#: Different words that a task counts before it passes them on.
HELD = 200_000
#: Steps of commonness between a count and its double.
STEPS = 8
SECRETS = "array<struct<kind:string,start:bigint,end:bigint,bits:double>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|secret|credentials?|token|(?:api|access|private)[_-]?key|(?<![A-Za-z])(?:pass|pwd|pw|pin|auth|login))[0-9]*["'`]?"""
    r"""\x20{0,3}(?:=>|:=|==?|:|->|(\bis\b))\x20{0,3}(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|([^\x09-\x0D\x20"'`<>]+))""", re.I | re.A)
#: What matches begin with.
ASSIGN_STEMS = ("passw", "secret", "token", "api")
CONTEXT_STEMS = ("pass", "secret", "credential", "token", "api", "access", "private", "pwd", "pw", "pin", "auth", "login")
TAIL = ".,;:!?)]}"
WORD = re.compile(rb"[a-z]{%d,%d}" % (SHORTEST, LONGEST_WORD))


def lower(text: str) -> str:
    """Lower-cased, each character at its place."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c if len(c) == 1 else "?" for c in map(str.lower, text))


def matches(pattern: re.Pattern, text: str, low: str, stems: tuple[str, ...]) -> Iterator[re.Match]:
    """What finditer finds of a pattern whose matches begin with one of these stems, in either case; it is tried only there."""
    at = []
    for stem in stems:
        k = low.find(stem)
        while k >= 0:
            at.append(k)
            k = low.find(stem, k + 1)
    end = 0
    for k in sorted(set(at)):
        if k >= end and (m := pattern.match(text, k)):
            end = m.end()
            yield m


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    """kind, start, end (in code points) of the fixed patterns' matches."""
    out = [("assign", *m.span()) for m in matches(ASSIGN, text, low, ASSIGN_STEMS) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def values(text: str, low: str) -> list[tuple[int, int]]:
    """Where the values in a credential context stand; an unquoted one after "is" must have a digit."""
    out = []
    for m in matches(CONTEXT, text, low, CONTEXT_STEMS):
        group = m.lastindex
        start, end = m.span(group)
        if group == 5:
            end = start + len(text[start:end].rstrip(TAIL))
            if m.group(1) and not any("0" <= c <= "9" for c in text[start:end]):
                continue
        if end > start:
            out.append((start, end))
    return out


def found(text: str | None, guesses: Guesses, least: float) -> list[tuple[str, int, int, float]]:
    """kind, start, end, bits of all secrets, by start, then kind; bits, the cost of guessing, of the kind guess only."""
    if not text:
        return []
    low = lower(text)
    out = [(*s, None) for s in base_spans(text, low)]
    for start, end in values(text, low):
        bits = guesses.bits(text[start:end])
        if bits >= log2(least):
            out.append(("guess", start, end, bits))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def common_words(docs: DataFrame, text_col="text", most: int = MOST_WORDS) -> list[str]:
    """The commonest words of A-Z letters, lower-cased, of all texts, at most ``most``; equally common ones by the alphabet.

    A word stands between spaces; one sign of punctuation may follow it.  Words are as common if their counts lie in one
    of the STEPS steps from a power of two to the next; such words are taken all or none.
    """
    import pyarrow as pa

    def count(batches):
        held: Counter = Counter()

        def passed_on():
            own = [(w, n) for w, n in held.items() if WORD.fullmatch(w)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                own = Counter(encode(text).lower().split())
                for w, n in own.items():
                    if w[-1] in b".,;:!?":
                        w = w[:-1]
                    if w:
                        held[w] += n
            if len(held) > HELD:
                yield passed_on()
        yield passed_on()
        give_back()

    ready(docs)
    step = F.floor(F.log2("n") * STEPS).cast("int").alias("step")
    counts = docs.select(col(text_col)).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).select("word", "n", step)
    table = written(counts, "words")
    least, room = None, most
    for r in sorted(table.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # some hundred rows
        if r["count"] > room:
            break
        least, room = r["step"], room - r["count"]
    rows = [] if least is None else table.filter(F.col("step") >= least).collect()
    discard(table)
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def ranks(words: list[str]) -> dict[str, int]:
    return {w: k + 1 for k, w in enumerate(dict.fromkeys([*PASSWORDS, *words]))}


def scan_secrets(docs: DataFrame, text_col="text", least: float = LEAST_GUESSES, words: list[str] | None = None, most: int = MOST_WORDS) -> tuple[DataFrame, dict]:
    """``docs`` with secrets (array of kind, start, end, bits, by start, then kind), and the name that column got.

    Places are code points, ends exclusive; bits is the cost of guessing a value, null for the fixed patterns.  ``words``:
    common words, commonest first; if not given, those of ``docs``.  Null and empty texts have no secrets.  Each row is
    worked on alone, so repeated rows give repeated results; values of any length are priced whole.  An empty table gives
    an empty one.  A column of ``docs`` named secrets keeps its name: the new one gets another.
    """
    known = docs.sparkSession.sparkContext.broadcast(ranks(common_words(docs, text_col, most) if words is None else words))

    def work(texts: list) -> list[list]:
        guesses = Guesses(known.value)
        return [[[dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in found(t, guesses, least)] for t in texts]]

    (name,) = fresh(docs, "secrets")
    return append(docs, [text_col], work, [(name, SECRETS)]), {"secrets": name}
