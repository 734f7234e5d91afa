"""How many guesses a password costs: the cheapest way to put it together from what guessers try.

A value is cut into segments; each costs the logarithm (base 2) of the guesses it takes, and each segment after the first
one bit more.  A segment is a word (its rank among common words; capitals, letters written as digits or signs, and
reversal cost extra), a date, a walk over the keyboard or the alphabet, a repeat of a short base, or a span that is tried
character by character.  The minimum over all cuts is found from left to right, in time linear in the value's length.
"""

from __future__ import annotations

import re
from math import comb, log2

# Rows of the US keyboard, unshifted and shifted, and letters written as other characters.
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", " QWERTYUIOP{}|", ' ASDFGHJKL:"', " ZXCVBNM<>?")
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "2": "z"}
# Words that passwords are known to be made of, most common first.
PASSWORDS = ("password", "qwerty", "admin", "welcome", "letmein", "login", "monkey", "dragon", "master", "secret", "changeme", "default", "test", "guest", "root", "user", "pass", "token", "example", "sample", "placeholder", "your", "none", "null", "true", "false", "undefined")

SHORTEST, LONGEST_WORD, LONGEST_BASE, LONGEST_WALK = 3, 20, 16, 32
#: First and last year that a date may have.
YEARS = 1900, 2050


def neighbours() -> dict[str, dict[str, int]]:
    """Key -> neighbouring key -> direction."""
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
    key = {v: k for k, v in at.items()}
    steps = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))
    return {c: {key[r + a, k + b]: d for d, (a, b) in enumerate(steps) if (r + a, k + b) in key} for c, (r, k) in at.items()}


KEYS = neighbours()
LETTERS = {chr(97 + k): {chr(97 + k + s): d for d, s in ((0, 1), (1, -1)) if 0 <= k + s < 26} for k in range(26)}
UNSHIFT = str.maketrans("".join(SHIFTED).replace(" ", ""), "".join(ROWS).replace(" ", ""))
PLAIN = str.maketrans(LEET)
DATES = [re.compile(p, re.A) for p in (r"(\d{4})", r"(\d\d)(\d\d)(\d\d)", r"(\d\d)(\d\d)(\d{4})", r"(\d{4})(\d\d)(\d\d)", r"(\d\d?)[-/._ ](\d\d?)[-/._ ](\d{4}|\d\d)", r"(\d{4})[-/._ ](\d\d?)[-/._ ](\d\d?)")]


def brute_bits(c: str) -> float:
    """Bits of one character among those of its kind."""
    if "0" <= c <= "9":
        return log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log2(26)
    return log2(33) if c < "\x80" else log2(128)


def case_bits(segment: str) -> float:
    upper, lower = sum("A" <= c <= "Z" for c in segment), sum("a" <= c <= "z" for c in segment)
    if not upper:
        return 0.0
    if not lower or upper == 1 and ("A" <= segment[0] <= "Z" or "A" <= segment[-1] <= "Z"):
        return 1.0
    return log2(sum(comb(upper + lower, k) for k in range(1, min(upper, lower) + 1)))


def date_bits(segment: str, parts: tuple[str, ...]) -> float | None:
    years = YEARS[1] - YEARS[0] + 1
    year = lambda t: len(t) == 2 or YEARS[0] <= int(t) <= YEARS[1]
    if len(parts) == 1:
        return log2(years) if year(parts[0]) else None
    y, rest = (parts[0], parts[1:]) if len(parts[0]) == 4 else (parts[2], parts[:2])
    a, b = map(int, rest)
    if not (year(y) and 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31):
        return None
    return log2(years * 365) + (0.0 if segment.isdigit() else 2.0)


class Guesses:
    """``ranks``: common words, lower-case, and their places, from 1."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def words(self, value: str, i: int):
        """end, bits of the words that begin at i."""
        low = value[i : i + LONGEST_WORD].lower()
        for text, more in ((low, 0.0), (low.translate(PLAIN), 1.0)):
            if more and text == low:
                continue
            for n in range(SHORTEST, len(text) + 1):
                part = text[:n]
                rank, back = self.ranks.get(part), self.ranks.get(part[::-1])
                if rank is None and back is None:
                    continue
                bits = min(log2(rank) if rank else 1e9, log2(back) + 1 if back else 1e9)
                changed = sum(a != b for a, b in zip(part, low, strict=False)) if more else 0
                yield i + n, bits + case_bits(value[i : i + n]) + more * changed

    @staticmethod
    def dates(value: str, i: int):
        for d in DATES:
            m = d.match(value, i)
            if m and (bits := date_bits(m.group(), m.groups())) is not None:
                yield m.end(), bits

    @staticmethod
    def walks(value: str, plain: str, i: int):
        for graph in (KEYS, LETTERS):
            turns, last, at = 0, None, i
            while at + 1 < min(len(plain), i + LONGEST_WALK) and (d := graph.get(plain[at], {}).get(plain[at + 1])) is not None:
                turns += last is not None and d != last
                last, at = d, at + 1
                if (n := at + 1 - i) >= SHORTEST:
                    yield at + 1, log2(len(graph) * 6 * n) + turns * log2(5 * n) + case_bits(value[i : at + 1])

    def bits(self, value: str, known: dict[str, float] | None = None, repeats: bool = True) -> float:
        """The logarithm of the guesses; 0 for nothing."""
        n, known = len(value), {} if known is None else known
        plain = value.translate(UNSHIFT)
        best, brute = [0.0] + [float("inf")] * n, [float("inf")] * (n + 1)
        again = {p: [0] * (n + 1) for p in range(1, LONGEST_BASE + 1)} if repeats else {}
        for p, run in again.items():
            for i in range(n - p - 1, -1, -1):
                run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
        for i, c in enumerate(value):
            base = best[i] + (1.0 if i else 0.0)
            brute[i + 1] = min(brute[i], base) + brute_bits(c)
            best[i + 1] = min(best[i + 1], brute[i + 1])
            for found in (self.words(value, i), self.dates(value, i), self.walks(value, plain, i)):
                for end, cost in found:
                    if base + cost < best[end]:
                        best[end] = base + cost
            for p, run in again.items():
                if run[i] >= p:
                    times, part = run[i] // p + 1, value[i : i + p]
                    if part not in known:
                        known[part] = self.bits(part, repeats=False)
                    end = i + times * p
                    best[end] = min(best[end], base + known[part] + log2(times))
        return best[n]
