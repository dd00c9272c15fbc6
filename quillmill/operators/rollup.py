"""Rollups of pages into sites, their ranked statistics, and their merge with earlier rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.storage import materialize

#: Sentiments are stored in full, so that merging loses nothing, and rounded before they are shown or ranked.
DIGITS = 6
TOP = 40
MIN_COUNT = 10


#: A name with more rows on one site than this is folded in blocks of its order.
HOT_ROWS = 500_000


def _steps(rows: DataFrame, order: str, keys: list[str], start: Column, first: Column) -> DataFrame:
    """Adds _log (of the factor by which a row multiplies what was there), _share (what it adds) and _sofar (running sum of _log) per keys.

    start is the count before the keys' first row, first whether that row is a name's first of all.
    """
    at = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_after", start + F.sum("count").over(at)).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    opens = (F.col("_place") == 1) & first
    moves = ~opens & (F.col("score") != 0)
    factor = F.when(moves, F.ln((F.col("_after") - F.col("count")) / F.col("_after"))).otherwise(F.lit(0.0))
    share = F.when(opens, F.col("score")).when(moves, F.col("score") * F.col("count") / F.col("_after")).otherwise(F.lit(0.0))
    return counted.withColumn("_log", factor).withColumn("_share", share).withColumn("_sofar", F.sum("_log").over(at))


def _folded(rows: DataFrame, order: str) -> DataFrame:
    logs = _steps(rows, order, ["site", "name"], F.lit(0).cast("long"), F.lit(True))
    return logs.groupBy("site", "name").agg(F.sum("count").alias("count"), (F.exp(F.sum("_log")) * F.sum(F.col("_share") * F.exp(-F.col("_sofar")))).alias("s"))


def _folded_in_blocks(rows: DataFrame, order: str) -> DataFrame:
    """The same fold with the order cut into ranges: a block is one factor and one share, and a name's blocks are folded as its rows are."""
    keys = ["site", "name", "_block"]
    dealt = materialize(rows.repartitionByRange("site", "name", order).withColumn("_block", F.spark_partition_id()), "fold-blocks")
    earlier = Window.partitionBy("site", "name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys).agg(F.sum("count").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(earlier)).select(*keys, F.coalesce("_start", F.lit(0)).alias("_start"), F.col("_start").isNull().alias("_opens"))
    logs = _steps(dealt.join(starts, keys), order, keys, F.col("_start"), F.col("_opens"))
    blocks = logs.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("_log").alias("_log"), (F.exp(F.sum("_log")) * F.sum(F.col("_share") * F.exp(-F.col("_sofar")))).alias("_share"))
    later = Window.partitionBy("site", "name").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    rest = blocks.withColumn("_later", F.coalesce(F.sum("_log").over(later), F.lit(0.0)))
    return rest.groupBy("site", "name").agg(F.sum("count").alias("count"), F.sum(F.col("_share") * F.exp("_later")).alias("s"))


def fold_entities(rows: DataFrame, order: str = "ord", hot_rows: int = HOT_ROWS) -> DataFrame:
    """site, name, _name, count, sentiment from rows (site, name, ord, count, score), folded in order.

    The count adds up; the sentiment moves to the weighted mean, except that a row of score 0
    leaves it as it is. As a sum: a step with a score multiplies what was there by before / after
    and adds its share, so each row's share ends up multiplied by all later factors. With
    running sums of counts and of the factors' logarithms that is one sorted pass, which streams.
    Names with over hot_rows rows on a site are cut into ranges of the order, which fold apart.
    """
    rows = materialize(rows.select("site", "name", order, "count", "score"), "fold")
    hot = materialize(rows.groupBy("site", "name").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("site", "name"), "fold-hot")
    if hot.isEmpty():
        out = _folded(rows, order)
    else:
        same = [rows[c].eqNullSafe(hot[c]) for c in ("site", "name")]
        out = _folded(rows.join(hot, same, "left_anti"), order).unionByName(_folded_in_blocks(rows.join(hot, same, "left_semi"), order))
    return out.select("site", "name", F.lower("name").alias("_name"), "count", F.col("s").alias("sentiment"))


def fold_candidates(rows: DataFrame) -> DataFrame:
    """site, name, _name, count, sentiment: the plain mean weighted by count, in any order."""
    out = rows.groupBy("site", "name").agg(F.sum(F.col("score") * F.col("count")).alias("t"), F.sum("count").alias("count"))
    return out.select("site", "name", F.lower("name").alias("_name"), "count", (F.col("t") / F.col("count")).alias("sentiment"))


def rounded(rollup: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The rollup with sentiments that differ only by the order of additions made equal."""
    return rollup.withColumn("sentiment", F.round("sentiment", digits))


def merge_entities(old: DataFrame, rows: DataFrame, order: str = "ord") -> DataFrame:
    """A stored rollup with a new batch of pages: the old row of a key comes before all new ones."""
    first = old.select("site", "name", F.lit(None).cast(rows.schema[order].dataType).alias(order), "count", F.col("sentiment").alias("score"))
    return fold_entities(first.unionByName(rows.select("site", "name", order, "count", "score")), order)


def merge_candidates(old: DataFrame, rows: DataFrame) -> DataFrame:
    return fold_candidates(old.select("site", "name", "count", F.col("sentiment").alias("score")).unionByName(rows.select("site", "name", "count", "score")))


def top_by_count(rollup: DataFrame, k: int = TOP) -> DataFrame:
    """Each site's k most counted names with their rank; ties go by name. Spark cuts each partition to k before the shuffle."""
    order = Window.partitionBy("site").orderBy(F.desc("count"), "name")
    return rollup.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def min_counts(rollup: DataFrame, k: int = TOP, most: int = MIN_COUNT) -> DataFrame:
    """site and min_count: the count of the last of the top k, but `most` at most."""
    return top_by_count(rollup, k).groupBy("site").agg(F.least(F.min("count"), F.lit(most).cast("long")).alias("min_count"))


def top_by_sentiment(rollup: DataFrame, k: int = TOP) -> DataFrame:
    """The k most positive and most negative names of each site that reach its least count, tagged by kind."""
    enough = rollup.join(min_counts(rollup, k), "site").filter("count >= min_count").drop("min_count")
    out = None
    for kind, order in (("positive", F.desc("sentiment")), ("negative", F.asc("sentiment"))):
        mine = enough.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(order, "name"))).filter(F.col("rank") <= k).withColumn("kind", F.lit(kind))
        out = mine if out is None else out.unionByName(mine)
    return out


def site_stats(entities: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """kind (entities, candidates, positive, negative), site, rank, name, count, sentiment. Sites without an entity have no statistics."""
    names = ["kind", "site", "rank", "name", "count", "sentiment"]
    sites = entities.select("site").distinct()
    tops = top_by_count(entities, k).withColumn("kind", F.lit("entities")).select(names)
    cands = top_by_count(candidates.join(sites, "site", "left_semi"), k).withColumn("kind", F.lit("candidates")).select(names)
    return tops.unionByName(cands).unionByName(top_by_sentiment(entities, k).select(names))
