"""Lexicon sentiment as plain column expressions: no join, no shuffle, no UDF.

A lexicon has few thousand words and about ten different scores. Words of a text are tested
against the set of all terms once, and the few that hit are counted per score; the sets are
literals that Spark turns into hash sets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores of common words, which the full word list (a parameter) has too.
DEFAULT_LEXICON = {
    "abuse": -3, "accident": -2, "alas": -1, "amazing": 4, "anger": -3, "anti": -1, "awesome": 4, "awful": -3, "bad": -3, "beautiful": 3,
    "best": 3, "brilliant": 4, "calm": 2, "crisis": -3, "damage": -3, "dead": -3, "die": -3, "disaster": -2, "disgusting": -3, "evil": -3,
    "excellent": 3, "fail": -2, "failure": -2, "fantastic": 4, "fear": -2, "free": 1, "fun": 4, "glad": 3, "good": 3, "great": 3,
    "ha": 2, "haha": 3, "hahaha": 3, "happy": 3, "hate": -3, "help": 2, "hope": 2, "horrible": -3, "idiot": -3, "joy": 3,
    "kill": -3, "like": 2, "lose": -3, "loser": -3, "loss": -3, "love": 3, "moron": -3, "nice": 3, "no": -1, "outstanding": 5,
    "pain": -2, "pathetic": -2, "perfect": 3, "poor": -2, "problem": -2, "proud": 2, "restored": 1, "sad": -2, "stupid": -2, "success": 2,
    "superb": 5, "terrible": -3, "terror": -3, "thank": 2, "threat": -2, "threaten": -2, "ugly": -3, "vile": -3, "war": -2, "welcome": 2,
    "win": 4, "wonderful": 4, "worst": -3, "worthless": -2, "wrong": -2, "yes": 1,
}

#: How steep the curve is that maps a mean score into -1 to 1.
CALIBRATION = 2.0
DIGITS = 9


def words(text: Column) -> Column:
    """Lower-cased pieces between runs of anything but ASCII letters, digits and underscores."""
    return F.split(F.lower(text), r"\W+")


def sigmoid(x: Column) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(x * F.lit(-CALIBRATION))) - F.lit(1.0)


def _one_of(terms: list[str]):
    """A test for filter(); it takes one argument, since a second one would be the place in the array."""
    return lambda w: w.isin(terms)


def hits(text: Column, lexicon: dict[str, int]) -> Column:
    """The text's words that have a score other than zero."""
    return F.filter(words(text), _one_of([t for t, s in lexicon.items() if s]))


def _one_word_of(ends: list[str]) -> str:
    """An expression for any of the words, letter by letter: one that names them in a row tries each of them at every place."""
    after: dict[str, list[str]] = {}
    for w in ends:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    if not after:
        return ""
    return f"(?:{'|'.join(c + _one_word_of(more) for c, more in sorted(after.items()))}){'?' if '' in ends else ''}"


def _words_of(lexicon: dict[str, int]) -> str:
    """An expression for the terms that have a score; those that are no words are never found and left out."""
    return _one_word_of([t for t, s in lexicon.items() if s and re.fullmatch("[a-z0-9_]+", t)]) or "(?!)"


def has_hit(text: Column, lexicon: dict[str, int]) -> Column:
    """Whether hits() of the text has any."""
    return F.lower(text).rlike(f"(?<![a-zA-Z0-9_]){_words_of(lexicon)}(?![a-zA-Z0-9_])")


def hit_totals(found: Column, lexicon: dict[str, int]) -> tuple[Column, Column]:
    """Sum and number of the scores of found, an array from hits()."""
    total = F.lit(0)
    for score in sorted({s for s in lexicon.values() if s}):
        total = total + F.size(F.filter(found, _one_of([t for t, s in lexicon.items() if s == score]))) * score
    total = F.when(F.size(found) == 0, F.lit(0)).otherwise(total)  # most texts have none
    return total.cast("long"), F.size(found).cast("long")


def score_of(total: Column, count: Column, digits: int | None = DIGITS) -> Column:
    """The score of a sum and number of hits: 0 without any. Means are taken of scores in full (digits None) and rounded after."""
    score = sigmoid(total.cast("double") / count)
    return F.when(count > 0, score if digits is None else F.round(score, digits)).otherwise(F.lit(0.0))


def kind_of(score: Column) -> Column:
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")
