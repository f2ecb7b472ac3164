"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that search ignores. Those with accents never match, as tokens have none.
STOP_WORDS = (
    "a", "o", "e", "de", "da", "do", "que", "em", "um", "uma", "para", "com", "não", "se", "na", "no", "por", "os", "as", "dos", "das", "ele", "ela", "eu", "você", "isso", "aqui",
    "então", "the", "and", "of", "to", "in", "is", "it", "you", "that", "this", "for", "on", "with", "as", "are", "be", "at", "or",
)
#: Words whose hits vote for a language.
LANGUAGE_VOTES = {
    "pt": ("que", "não", "você", "para", "com", "uma", "isso", "então", "aqui", "tem"),
    "en": ("the", "and", "you", "that", "this", "with", "for", "have", "what", "here"),
    "es": ("que", "para", "con", "una", "esto", "pero", "aquí", "tiene", "entonces", "también"),
}


@cache
def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks and the letter each has under its marks."""
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<")}
    return "".join(plain), "".join(plain.values())


def strip_accents(c: Column) -> Column:
    """The text without combining marks, composed or not."""
    return F.regexp_replace(F.translate(c, *_accents()), "[\\u0300-\\u036f]", "")


def search_tokens(text: Column) -> Column:
    """Lower-case accent-free runs of letters and digits, of two characters or more, that are no stop word."""
    parts = F.split(strip_accents(F.lower(text)), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def compact(text: Column) -> Column:
    """Letters and digits only, for comparing glossary terms."""
    return F.regexp_replace(strip_accents(F.lower(text)), "[^a-z0-9]+", "")


@cache
def _compatible() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters with a compatibility form: those whose form is one character, and the forms of the others.

    All of the basic plane but Hangul and the ideographs, whose forms are composed.
    """
    one, many = {}, {}
    for c in map(chr, [*range(0xA0, 0x3400), *range(0xFB00, 0x10000)]):
        form = unicodedata.normalize("NFKC", c)
        if form != c and unicodedata.category(c) not in ("Cs", "Cn"):
            (one if len(form) == 1 else many)[c] = form
    return "".join(one), "".join(one.values()), tuple(many.items())


@cache
def _composed() -> tuple[tuple[str, str], ...]:
    """Latin letters with one mark, as two characters and as one."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and unicodedata.normalize("NFC", parts) == c:
            pairs.append((parts, c))
    return tuple(pairs)


def _class(chars: Iterable[str]) -> str:
    """A character class, neighbours as ranges."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def _exchange(text: Column, pattern: str, forms: tuple[tuple[str, str], ...]) -> Column:
    """The text with each match of a pattern that has a form replaced by it; other texts aren't opened."""
    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in forms)), F.lit("\x01"), F.lit("\x02"))
    parts = F.split(text, f"(?={pattern})|(?<={pattern})")
    return F.when(text.rlike(pattern), F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")).otherwise(text)


#: Stretches of the basic plane that hold all characters with a compatibility form, and marks; letters of most scripts aside.
MAY_HAVE_FORMS = "[\\u00a0\\u00a8\\u00aa\\u00af\\u00b2-\\u00b5\\u00b8-\\u00ba\\u00bc-\\u00be\\u0132-\\u03f9\\u0587\\u0675-\\u0678\\u0958-\\u0fb9\\u10fc-\\u2011\\u2017\\u2024-\\u2026\\u202f\\u2033-\\u20a8\\u2100-\\u33ff\\ufb00-\\uffff]"


def compatible(text: Column) -> Column:
    """The text in its compatibility form (full-width letters, ligatures, superscripts, marks after Latin letters).

    Marks are composed with Latin letters, one a letter.  Texts without a character of the stretches that
    such characters are in pass with one look at each of theirs.
    """
    chars, forms, many = _compatible()
    told = F.when(text.rlike(f"[{_class(chars)}]"), F.translate(text, chars, forms)).otherwise(text)
    told = _exchange(told, f"[{_class(a for a, _ in many)}]", many)
    told = _exchange(told, f"[{_class({a[0] for a, _ in _composed()})}][{_class({a[1] for a, _ in _composed()})}]", _composed())
    return F.when(text.rlike(MAY_HAVE_FORMS), told).otherwise(text)


def plain(text: Column) -> Column:
    """Lower case, compatibility forms, punctuation and symbols as blanks, blanks collapsed; accents stay."""
    return F.btrim(F.regexp_replace(F.regexp_replace(compatible(F.lower(text)), r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def plain_for_rates(text: Column) -> Column:
    """Both sides of an error rate: no accents, no bracketed remarks, letters and digits only."""
    said = F.regexp_replace(strip_accents(F.lower(text)), r"\[[^\]]*\]|\([^)]*\)", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(said, r"[^a-z0-9\s]", " "), r"\s+", " "))


def word_count(text: Column) -> Column:
    """Words between blanks; an empty text counts as one, as a split of it gives one part."""
    return F.size(F.split(F.coalesce(text, F.lit("")), r"\s+"))


def hits(text: Column, word: str) -> Column:
    """Occurrences of a word between single blanks that don't overlap."""
    bare, needle = F.concat(F.lit(" "), F.lower(text), F.lit(" ")), f" {word} "
    return ((F.length(bare) - F.length(F.replace(bare, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def guess_language(text: Column) -> Column:
    """The language with most votes, ``auto`` under three; ties go to the first of pt, en, es."""
    votes = {lang: sum((hits(text, w) for w in words[1:]), hits(text, words[0])) for lang, words in LANGUAGE_VOTES.items()}
    best = F.greatest(*votes.values())
    return F.when(best < 3, "auto").when(best == votes["pt"], "pt").when(best == votes["en"], "en").otherwise("es")


def mask(value: Column) -> Column:
    return F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(3)))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5).cast("long")


def truncate_to_budget(text: Column, budget: int, pointer: str) -> Column:
    keep = max(200, int(budget * 3.5 - 200))
    note = f"\n\n[…truncated to fit the response budget. Full content: {pointer}]"
    return F.when(estimate_tokens(text) <= budget, text).otherwise(F.concat(F.left(text, F.lit(keep)), F.lit(note)))


def cap_text(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("…")))


def untrusted(text: Column) -> Column:
    """An envelope that says the text came out of the media."""
    return F.concat(F.lit('<untrusted-content source="media">\n'), text, F.lit("\n</untrusted-content>"))


#: What follows a job's id in the address of each of its artifacts.
ARTIFACTS = {
    "transcript": "transcript",
    "srt": "transcript.srt",
    "ocr": "ocr",
    "report": "report",
    "sheet": "sheet/%d",
    "frame": "frame/%d",
    "events": "events",
    "speakers": "speakers",
    "transcript_speakers": "transcript.speakers",
}


def artifact_uri(job_id: Column, kind: str, number: Column | None = None) -> Column:
    form = f"strand://jobs/%s/{ARTIFACTS[kind]}"
    return F.format_string(form, job_id) if number is None else F.format_string(form, job_id, number)
