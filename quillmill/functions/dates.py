"""Dates in running text: words become kinds, and short shapes of kinds become dates.

A kind is one letter: M a month's name, W a weekday's, D a number from 1 to 31, n another of two digits,
Y one of four digits, s an ordinal's ending, o and t the words of and the; marks stand for themselves
and x for anything else. A shape is an expression over kinds, so it says nothing of spelling or case.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = {n.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, n in enumerate(names) if n} | {"sept": 9}
_DAYS = {n.lower() for names in (calendar.day_name, calendar.day_abbr) for n in names} | {"tues", "thur", "thurs"}
_ENDINGS = frozenset(("st", "nd", "rd", "th"))
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Shapes in the order in which they are tried at a place; numbers with marks between them stand close together.
_SHAPES = [
    ("close", re.compile(r"(?P<Y>Y)-(?P<M>D)-(?P<D>D)(?!-)")),
    ("close", re.compile(r"(?P<M>D)(?P<mark>[-/])(?P<D>D)(?P=mark)(?P<Y>[YnD])(?![-/])")),
    ("apart", re.compile(r"(?P<M>M)\.?(?P<D>D)s?(?:,?(?P<Y>Y))?")),
    ("apart", re.compile(r"t?(?P<D>D)[s.]?o?(?P<M>M)\.?(?:,?(?P<Y>Y))?")),
    ("apart", re.compile(r"W\.?,?t?(?P<D>D)s?(?!\w)")),
]


def _kinds(text: str) -> tuple[str, list[re.Match]]:
    found = list(_TOKEN.finditer(text))
    out = []
    for k, m in enumerate(found):
        word = m.group().lower()
        if word.isascii() and word.isdigit():
            out.append("Y" if len(word) == 4 and word < "3000" else "x" if len(word) > 2 else "D" if 1 <= int(word) <= 31 else "n")
        elif word in _ENDINGS and k and found[k - 1].end() == m.start() and out[-1] == "D":
            out.append("s")
        elif word in _NAMES:
            out.append("M")
        elif word in _DAYS:
            out.append("W")
        else:
            out.append({"of": "o", "the": "t"}.get(word, word if word in ",.-/" else "x"))
    return "".join(out), found


def dates_in(text: str, now: datetime) -> list[datetime]:
    """Midnights of the dates that the text gives, in its order. A part that isn't given is that of now; of two numbers the month comes first; days that no month has are none."""
    kinds, found = _kinds(text)
    out, at = [], 0
    while at < len(kinds):
        for spacing, shape in _SHAPES:
            if (m := shape.match(kinds, at)) is None:
                continue
            if spacing == "close" and any(found[k].end() != found[k + 1].start() for k in range(at, m.end() - 1)):
                continue
            value = {k: found[m.start(k)].group() for k, v in m.groupdict().items() if v is not None and k != "mark"}
            month = value.get("M", str(now.month))
            year = int(value.get("Y", now.year))
            if len(value.get("Y", "four")) < 3:
                year += 1900 if year > 68 else 2000
            try:
                out.append(datetime(year, _NAMES.get(month.lower()) or int(month), int(value["D"])))
            except ValueError:
                continue
            at = m.end() - 1
            break
        at += 1
    return out


def latest_date(text: Column, now: datetime) -> Column:
    """The latest date of each text that isn't after now; null without one, or without text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: max((d for d in dates_in(x, now) if d <= now), default=None), na_action="ignore").astype("datetime64[us]")

    return F.pandas_udf(run, "timestamp_ntz")(text).cast("date")
