"""What the training-data operators share: tables, words, and storage that all executors see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.storage import discard, materialize, new_path, shared_dir  # noqa: F401

#: Words are maximal runs of anything but these bytes: space, tab, LF, VT, FF, CR.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
