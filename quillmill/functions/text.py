"""Scalar text functions: sentences, candidates, keywords, dates, repair and small predicates."""

from __future__ import annotations

import pandas as pd
from dateutil import parser as dates
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from quillmill.functions.mojibake import fix_text, repair  # noqa: F401

# Words after which a full stop doesn't end a sentence.
ABBREVIATIONS = ("dr", "vs", "mr", "mrs", "prof", "inc")
#: A capitalised word and those that follow it after single spaces: what stands in for a named-entity model.
CANDIDATE = r"(\p{Lu}[\p{L}0-9]*(?: \p{Lu}[\p{L}0-9]*)*)"
#: A candidate, or a word outside of candidates as far as it is ASCII: what stands outside has no capital letter.
TOKEN = r"\p{Lu}[\p{L}0-9]*+(?: \p{Lu}[\p{L}0-9]*+)*+|[a-z0-9_]++"
#: Marks that stand between steps: noncharacters, which no text holds; one that does has them replaced.
HELD, CUT, MARK = "\ufdd0", "\ufdd1", "\ufdd2"


def unmarked(text: Column) -> Column:
    held = F.contains(text, F.lit(HELD)) | F.contains(text, F.lit(CUT)) | F.contains(text, F.lit(MARK))
    return F.when(held, F.translate(text, HELD + CUT + MARK, "\ufffd" * 3)).otherwise(text)


def _held(text: Column, form: str) -> Column:
    """The text with HELD for the stop and blank after words of this form.

    The expression begins with the stop, which is rare, and looks back from it: one that begins with the word is
    tried at every character. A form that follows another at once has no blank of its own before it and is left as it is.
    """
    return F.regexp_replace(text, rf"\.(?<=(?:^|[^A-Za-z0-9_]){form}\.)\s({form}\.\s)?", f"{HELD}$1")


def sentences(text: Column) -> Column:
    """Array of sentences: cut after . ? ! and white space, but not after abbreviations and initials.

    A text without any of those, as most are, is only cut.
    """
    words = f"(?i:{'|'.join(ABBREVIATIONS)})"
    kept = _held(_held(unmarked(text), words), "[A-Z]")
    cut = F.split(F.regexp_replace(kept, r"([.?!])\s+", f"$1{CUT}"), CUT)
    held = F.transform(cut, lambda s: F.replace(s, F.lit(HELD), F.lit(". ")))
    return F.when(text.rlike(rf"\.(?<=(?:^|[^A-Za-z0-9_])(?:{words}|[A-Z])\.)\s"), held).otherwise(F.split(unmarked(text), r"(?<=[.?!])\s+"))


def pieces(sentence: Column) -> Column:
    """The sentence cut around its candidates: those stand at odd places."""
    return F.split(F.regexp_replace(unmarked(sentence), CANDIDATE, f"{MARK}$1{MARK}"), MARK)


def tokens(sentence: Column) -> Column:
    """The candidates and the words outside of them, in order, found in one pass."""
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))


def is_capital(token: Column) -> Column:
    """Whether a token is a candidate: it begins with other than a small letter, digit or underscore of ASCII."""
    return (token >= "{") | ((token >= "A") & (token < "["))


def candidates(sentence: Column, least: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(sentence, F.lit(CANDIDATE), F.lit(1)), lambda c: F.length(c) >= least)


def split_keywords(contents: Column) -> Column:
    """Comma-separated keywords of several meta tags, trimmed, those empty before trimming left out."""
    return F.transform(F.filter(F.flatten(F.transform(contents, lambda c: F.split(c, ","))), lambda k: k != ""), lambda k: F.trim(k))


def normal_key(key: Column) -> Column:
    return F.replace(F.lower(key), F.lit("."), F.lit("_"))


def split_blank(text: Column) -> Column:
    """Words between white space, as of a form's category field."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.size(split_blank(text))


def charset(html: Column) -> Column:
    """The charset that a meta http-equiv content-type tag names; utf-8 otherwise."""
    got = F.lower(F.regexp_extract(html, r"""(?i)<meta[^>]*http-equiv=["']?content-type["']?[^>]*charset=([^"'\s>;]+)""", 1))
    return F.when(got != "", got).otherwise("utf-8")


def is_object_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{24}$"), F.lit(False))


def first_integer(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")), F.lit("999999999999999999")).cast("long")


@F.pandas_udf(TimestampType())
def fuzzy_date(text: pd.Series) -> pd.Series:
    """A date read leniently; a time zone is replaced by UTC and not converted. Null if there is none."""

    def one(x: str | None):
        try:
            return None if x is None else dates.parse(x, fuzzy=True).replace(tzinfo=None)
        except (ValueError, OverflowError):
            return None

    return pd.to_datetime(pd.Series([one(x) for x in text], dtype="object"), errors="coerce")


# Frequent words that tell a language.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "on"),
    "fr": ("le", "la", "les", "de", "des", "et", "est", "un", "une", "que"),
    "de": ("der", "die", "das", "und", "ist", "ein", "eine", "mit", "von", "zu"),
    "es": ("el", "la", "los", "de", "que", "y", "en", "un", "una", "por"),
}


def language_vote(text: Column) -> Column:
    """The language of which the text holds most stop words; en on a tie or without any, as names of things seldom have one."""
    found = F.split(F.lower(text), r"[^\p{L}]+")
    votes = {k: F.size(F.array_intersect(F.array(*map(F.lit, v)), found)) for k, v in STOP_WORDS.items()}
    best = F.greatest(*votes.values())
    out = F.when(votes["en"] == best, "en")
    for k in ("fr", "de", "es"):
        out = out.when(votes[k] == best, k)
    return out
