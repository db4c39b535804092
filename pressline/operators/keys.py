"""Key checks, checked joins and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_scalars


def one_row(*tables: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side; the later ones enter as scalar subqueries."""
    return reduce(with_scalars, tables)


def checked_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail at run time on a repeated key.

    The count uses the partitioning the join on the same key needs anyway.
    """
    first = keys[0]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    guarded = F.when(F.col("_n") == 1, F.col(first)).otherwise(
        F.raise_error(F.concat(F.lit("duplicate key: "), F.coalesce(F.col(first).cast("string"), F.lit("null"))))
    )
    return df.withColumn("_n", n).withColumn(first, guarded).drop("_n")


def one_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return checked_unique(left, keys).join(checked_unique(right, keys), list(keys), how)


def semi_filter(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys), list(keys), "left_semi")


def anti_unknown(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")


def set_compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys on one side only and whether the sets are equal.

    Both sides are tagged and grouped together: one map-side combined shuffle.
    """
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    sides = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.agg(
        F.count_if(F.col("_b") == 0).alias("only_left"), F.count_if(F.col("_a") == 0).alias("only_right")
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def distinct_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def identical_records(df: DataFrame, record: Sequence[str], by: str = "model") -> DataFrame:
    """One row: does every group of ``by`` hold the same set of records?"""
    pairs = df.select(by, *record).distinct()
    groups = df.select(by).distinct().agg(F.count(F.lit(1)).alias("_groups"))
    per_record = pairs.groupBy(*record).agg(F.count(F.lit(1)).alias("_in"))
    spread = per_record.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.min("_in"), F.lit(0)).alias("_least")
    )
    return one_row(spread, groups).select(
        "records",
        F.col("_groups").alias("groups"),
        ((F.col("_least") == F.col("_groups")) | (F.col("records") == 0)).alias("identical"),
    )


def canonical_sort(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)
