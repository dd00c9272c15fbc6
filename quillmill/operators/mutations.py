"""Changes to stored tables, as transforms from the old table to the new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: that of the greatest version; a new row wins a tie. Copies meet map-side before the shuffle."""
    cols = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(cols).withColumn("_new", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(cols)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key isn't there yet, one of each key."""
    return old.unionByName(new.select(old.columns).join(old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys))


def delete(old: DataFrame, keys: DataFrame) -> DataFrame:
    """old without the rows whose key is in keys."""
    return old.join(keys.distinct(), keys.columns, "left_anti")


def set_where(old: DataFrame, where: Column, **values) -> DataFrame:
    """Sets columns, to values or expressions, on the rows for which `where` holds."""
    hit = F.coalesce(where, F.lit(False))
    return old.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def increment(old: DataFrame, counts: DataFrame, keys: list[str], column: str, by: str) -> DataFrame:
    """Adds counts (keys and `by`) to a column."""
    joined = old.join(counts.select(*keys, F.col(by).alias("_by")), keys, "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("_by", F.lit(0))).drop("_by").select(old.columns)


def merge_documents(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the values that changes gives; `enabled` (boolean) among them sets status to 1 or 0. Nulls change nothing."""
    given = [c for c in changes.columns if c not in keys]
    joined = old.join(changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in given)), keys, "left")
    out = {c: F.coalesce(f"_new_{c}", c) for c in given if c in old.columns}
    if "enabled" in given and "status" in old.columns:
        out["status"] = F.coalesce(F.when(F.col("_new_enabled"), 1).when(~F.col("_new_enabled"), 0), F.col("status"))
    return joined.withColumns(out).select(old.columns)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)
