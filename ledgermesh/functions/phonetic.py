"""Metaphone (Philips 1990) as an Arrow-batched function."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = "AEIOU"


@functools.lru_cache(maxsize=200_000)
def metaphone(word: str) -> str:
    """Metaphone code of a word of ASCII letters; '' for a word without any."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    if w[:2] in ("KN", "GN", "PN", "AE", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, n = [], len(w)
    at = lambda i: w[i] if 0 <= i < n else ""
    front = lambda c: c != "" and c in "EIY"
    vowel = lambda c: c != "" and c in _VOWELS
    i = 0
    while i < n:
        c, prev, nxt = w[i], at(i - 1), at(i + 1)
        if c == prev and c != "C":
            i += 1
            continue
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and prev == "M"):
                out.append("B")
        elif c == "C":
            if front(nxt):
                if nxt == "I" and at(i + 2) == "A":
                    out.append("X")
                elif prev != "S":
                    out.append("S")
            elif nxt == "H":
                out.append("K" if prev == "S" else "X")
                i += 1
            else:
                out.append("K")
        elif c == "D":
            if nxt == "G" and front(at(i + 2)):
                out.append("J")
                i += 1
            else:
                out.append("T")
        elif c == "G":
            if nxt == "H":
                if i + 2 >= n or vowel(at(i + 2)):
                    out.append("K" if vowel(at(i + 2)) and i == 0 else "F" if i + 2 >= n and i > 0 else "K")
                i += 1
            elif nxt == "N" and (i + 2 >= n or w[i + 2 :] == "ED"):
                pass
            elif front(nxt) and prev != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if vowel(nxt) and prev not in ("C", "S", "P", "T", "G"):
                out.append("H")
        elif c == "K":
            if prev != "C":
                out.append("K")
        elif c == "P":
            if nxt == "H":
                out.append("F")
                i += 1
            else:
                out.append("P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if nxt == "H":
                out.append("X")
                i += 1
            elif nxt == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            else:
                out.append("S")
        elif c == "T":
            if nxt == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif nxt == "H":
                out.append("0")
                i += 1
            elif not (nxt == "C" and at(i + 2) == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if vowel(nxt):
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:  # F J L M N R
            out.append(c)
        i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def metaphone_words(words: pd.Series) -> pd.Series:
    """Codes of space-separated words, joined without spaces."""
    return words.map(lambda s: "" if s is None else "".join(metaphone(t) for t in s.split(" ")))
