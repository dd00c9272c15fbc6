"""URL functions over columns. Built-ins wherever they carry the meaning; urljoin is a pandas UDF."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A URL in text: what the characters of a URL can be, without nested repetition, so that long matches need no stack.
ABSOLUTE_URL = r"(https?://[!$-_a-z]+)"
#: An anchor's target, wherever it stands among its attributes: in quotes of either kind, or without.
ANCHOR_TARGET = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def anchor_targets(html: Column) -> Column:
    """The targets of the anchors in HTML, as they are written, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR_TARGET), F.lit(1)), lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))


def host(url: Column) -> Column:
    """Lower-cased host without port or user; null for what has none."""
    got = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(got != "", got)


def bare_host(name: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(name, r"^www\.", "")


def other_host(name: Column) -> Column:
    """The host with www. added, or taken off if it is there."""
    return F.when(name.startswith("www."), bare_host(name)).otherwise(F.concat(F.lit("www."), name))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def is_image(url: Column) -> Column:
    """Whether the URL ends in .jpg or .png, in lower case."""
    return url.rlike(r"\.(jpg|png)$")


def looks_like_html(url: Column) -> Column:
    """Whether the URL tells of HTML by itself: any character before htm, as the pattern has it."""
    return url.rlike(r".html|.htm")


def join_simple(base: Column, href: Column) -> Column:
    """href against base where built-ins can tell: absolute, //host, /path, ?query, #fragment and empty."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(without_fragment(base), href))
        .when(href == "", base)
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )


@F.pandas_udf(StringType())
def join(base: pd.Series, href: pd.Series) -> pd.Series:
    """urljoin in full, with dot segments; null where either is null or the URL is broken."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return None if b is None or h is None else urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])
