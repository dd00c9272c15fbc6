"""Repair of text whose UTF-8 was read as a one-byte code, once or several times over, in whole or in parts.

A damaged character is a run that spells the bytes of one UTF-8 character: a leading byte's character and
as many following ones. Each run is repaired by itself, so undamaged parts of a text stay. What a run
becomes must be likely in text: a run that would become a letter of no likely script was none, such as
a capital letter before a closing quote. Passes go on while the text gets better, at most LAYERS.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LAYERS = 4


def _byte_characters() -> dict[str, int]:
    """What each byte from 0x80 on may have been read as: by Latin-1, and by Windows-1252 where that differs."""
    out = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        try:
            out[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:  # Windows has no character there
            continue
    return out


_BYTES = _byte_characters()


def _class(lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in _BYTES.items() if lo <= b <= hi) + "]"


_FOLLOWING = _class(0x80, 0xBF)
_CHARACTER = f"(?:{_class(0xC2, 0xDF)}{_FOLLOWING}|{_class(0xE0, 0xEF)}{_FOLLOWING}{{2}}|{_class(0xF0, 0xF4)}{_FOLLOWING}{{3}})"
_RUN = re.compile(f"{_CHARACTER}+")
#: Characters that a single run may become, as ranges: Latin letters and marks, punctuation, currency, signs, CJK, emoji.
LIKELY = [(0xA0, 0x17F), (0x300, 0x36F), (0x2010, 0x203A), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x21FF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1FAFF)]
#: Letters that become likely where several of them stand together.
SCRIPTS = [(0x370, 0x52F), (0x590, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F)]


def _within(c: str, ranges: list[tuple[int, int]]) -> bool:
    return any(lo <= ord(c) <= hi for lo, hi in ranges)


def _repaired(run: re.Match) -> str:
    try:
        read = bytes(_BYTES[c] for c in run.group()).decode("utf-8")
    except UnicodeDecodeError:
        return run.group()
    again = any(c in _BYTES for c in read) and not _within(read[0], [(0xA0, 0x17F)])  # a layer below: C1 characters
    if len(read) > 1 and all(_within(c, LIKELY + SCRIPTS) or c in _BYTES for c in read):
        return read
    return read if again or all(_within(c, LIKELY) for c in read) else run.group()


def badness(text: str) -> int:
    """How much of a text reads as damage: characters of such runs, C1 control characters and replacement characters."""
    return sum(map(len, _RUN.findall(text))) + sum(0x80 <= ord(c) < 0xA0 or c == "�" for c in text)


def repair(text: str) -> str:
    """The text without the damage that can be told, in composed form."""
    if not text.isascii():
        bad = badness(text)
        for _ in range(LAYERS):
            if not bad:
                break
            tried = _RUN.sub(_repaired, text)
            now = badness(tried)
            if now >= bad:
                break
            text, bad = tried, now
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def fix_text(text: pd.Series) -> pd.Series:
    return text.map(repair, na_action="ignore")
