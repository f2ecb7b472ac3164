"""Glossary correction: phrases that sound like a supplied term become the term."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = re.compile(r"(\s+)")
_TAIL = re.compile(r"[.,;:!?]+\Z")


def bare(s: str) -> str:
    """Letters and digits of the lower-cased, accent-free text."""
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if "a" <= c <= "z" or "0" <= c <= "9")


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` when it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return min(row[-1], most + 1)


def correct(text: str | None, terms: list[str]) -> tuple[str | None, int]:
    """The corrected text and the number of replacements.

    Terms go one after another.  Each slides over the words left to right, as many at a time as it has
    words; a run that differs by few letters becomes the term, keeping punctuation at its end, and is
    one word from then on.  Up to one edit is allowed for terms of five letters, 34 % of the letters
    for longer ones; terms under three letters are left alone.
    """
    if text is None or not terms:
        return text, 0
    parts, made = _BLANK.split(text), 0
    words, gaps = parts[::2], parts[1::2]
    for term in filter(None, (t.strip() for t in terms)):
        size, want = len(term.split()), bare(term)
        if len(want) < 3:
            continue
        most = 1 if len(want) <= 5 else int(len(want) * 0.34)
        at = 0
        while at + size <= len(words):
            have = bare(" ".join(words[at : at + size]))
            if have and have != want:
                d = edits(have, want, most)
                if d <= most and d / max(len(have), len(want)) <= 0.34:
                    tail = _TAIL.search(words[at + size - 1])
                    words[at : at + size] = [term + (tail[0] if tail else "")]
                    del gaps[at : at + size - 1]
                    made += 1
            at += 1
    return "".join(w + g for w, g in zip(words, [*gaps, ""], strict=True)), made


def apply_glossary(text: Column, terms: list[str]) -> Column:
    """struct(text, replacements)."""

    @F.pandas_udf("struct<text:string,replacements:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [correct(t, terms) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done], "replacements": [n for _, n in done]})

    return run(text)


def correct_words(text: Column, term: str) -> Column:
    """The one-word case without Python: words within the allowed edits of the term become it."""
    want = bare(term)
    most = 1 if len(want) <= 5 else int(len(want) * 0.34)

    def one(word: Column) -> Column:
        have = F.regexp_replace(F.lower(word), "[^a-z0-9]+", "")
        d = F.levenshtein(have, F.lit(want))
        near = (F.length(have) > 0) & (have != want) & (d <= most) & (d / F.greatest(F.length(have), F.lit(len(want))) <= 0.34)
        return F.when(near, F.concat(F.lit(term), F.regexp_extract(word, r"[.,;:!?]+\z", 0))).otherwise(word)

    return F.array_join(F.transform(F.split(text, " "), one), " ") if len(want) >= 3 else text
