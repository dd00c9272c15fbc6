"""Checks of stored rows: required fields, versions, and rows to do again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The form of extracted pages; rows of an earlier one are done again.
VERSION = 2
EXTRACTED_FIELDS = ("url", "site", "title", "text", "entities", "candidates")


def missing_fields(columns: list[str], required: tuple[str, ...]) -> list[str]:
    """The required fields that aren't among columns."""
    return [c for c in required if c not in columns]


def with_required(rows: DataFrame, key: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """rows with all required fields, and rejects (key, reason: the fields that are null). A field that no row has is an error of the plan."""
    if lacking := missing_fields(rows.columns, required):
        raise ValueError(f"the table lacks {', '.join(lacking)}")
    nulls = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in required))
    return rows.filter(nulls == ""), rows.filter(nulls != "").select(key, F.concat(F.lit("missing "), nulls).alias("reason"))


def current(pages: DataFrame, legacy_field: str = "text") -> tuple[DataFrame, DataFrame]:
    """Extracted pages of the present form, and url of those to extract again.

    A page is of an earlier form if its version is, where there is one, or if its first entity
    has the earlier form's field.
    """
    old = F.lit(False)
    if "version" in pages.columns:
        old = F.coalesce("version", F.lit(0)) < VERSION
    if (kind := dict(pages.dtypes).get("entities", "")).startswith("array<struct") and f"{legacy_field}:" in kind:
        old = old | F.get("entities", F.lit(0))[legacy_field].isNotNull()
    elif kind.startswith("array<map"):
        old = old | F.coalesce(F.map_contains_key(F.get("entities", F.lit(0)), legacy_field), F.lit(False))
    return pages.filter(~old), pages.filter(old).select("url")
