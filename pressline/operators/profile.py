"""Profiles of scans: completeness, counts, time checks and feature statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import EpisodeConfig
from ..functions import ordered
from ..functions.columns import count_where, share, truth
from .turnover import PERIOD


def event_type_filter(events: DataFrame, types: Sequence[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def negative_time(events: DataFrame) -> DataFrame:
    """Events before the start of their period, counted per period and type."""
    return (
        events.where(F.col("t_us") < 0)
        .groupBy("period_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("earliest_us"))
    )


def dataset_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, periods and missing times per data set."""
    parts = []
    for name, df in tables.items():
        periods = df.groupBy("period_id").agg(
            F.count(F.lit(1)).alias("_rows"), count_where(F.col("t_us").isNull()).alias("_missing")
        )
        parts.append(
            periods.agg(
                F.lit(name).alias("dataset"),
                F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
                F.lit(len(df.columns)).alias("columns"),
                F.count("period_id").alias("periods"),
                F.coalesce(F.sum("_missing"), F.lit(0)).alias("timestamp_missing"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def possession_coverage(frames: DataFrame) -> DataFrame:
    alive = F.col("ball_state") == "alive"
    return frames.agg(
        count_where(alive).alias("alive_frames"),
        share(count_where(alive & F.col("owner").isNotNull()), count_where(alive)).alias("owned_share"),
    )


def field_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null count and percentage per column, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot(["_rows"], list(columns), "field", "non_null")
    return long.select("field", "non_null", F.round(share(F.col("non_null"), F.col("_rows")) * 100, 2).alias("percent"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, null included, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def transition_summary(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"{c}_available") for c in columns]
    )


def time_audit(events: DataFrame) -> DataFrame:
    return events.groupBy("period_id").agg(
        F.count("t_us").alias("n"),
        F.min("t_us").alias("min_us"),
        F.max("t_us").alias("max_us"),
        count_where(F.col("t_us") < 0).alias("negative"),
    )


def event_team_changes(events: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Changes of team between consecutive events that name one (diagnostic)."""
    named = events.where(F.col("team_id").isNotNull())
    slices = ordered.time_slices("t_us", cfg.slices.widths())
    prev = ordered.previous_row(named, PERIOD, ["t_us", "event_id"], slices, ["team_id"])
    return prev.where(truth(F.col("team_id") != F.col("prev_team_id")))


def split_summary(manifest: DataFrame) -> DataFrame:
    """Matches, episodes and positives per split with the share of all episodes.

    Matches are counted per (split, match) first; only one row per match is left
    when they are counted. ``match_names`` lists every match of the split in order;
    the names are also the rows of :func:`split_matches`.
    """
    per_match = manifest.groupBy("split", "match_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("label_regain_5s").alias("_pos"),
        count_where(F.col("eligible_for_detection_training")).alias("_usable"),
    )
    per_split = per_match.groupBy("split").agg(
        F.count(F.lit(1)).alias("matches"),
        F.sum("_n").alias("strict_valid_episodes"),
        F.sum("_pos").alias("quick_regain_positive"),
        F.sum("_usable").alias("annotated_usable"),
        F.array_join(F.sort_array(F.collect_list("match_id")), ", ").alias("match_names"),
        F.min("match_id").alias("first_match"),
        F.max("match_id").alias("last_match"),
    )
    whole = F.sum("strict_valid_episodes").over(Window.partitionBy(F.lit(0)))
    return per_split.withColumns(
        {
            "quick_regain_negative": F.col("strict_valid_episodes") - F.col("quick_regain_positive"),
            "episode_share_percent": F.round(share(F.col("strict_valid_episodes"), whole) * 100, 2),
        }
    )


def split_matches(manifest: DataFrame) -> DataFrame:
    """(split, match_id) of every match."""
    return manifest.select("split", "match_id").distinct()


def feature_profile(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Describe each feature: count, missing, mean, deviation, exact quartiles, range."""
    long = features.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "feature", "value")
    v = F.col("value")
    stats = long.groupBy("feature").agg(
        F.count(v).alias("count"),
        (F.count(F.lit(1)) - F.count(v)).alias("missing"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    quartiles = ordered.exact_quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return stats.join(quartiles, "feature", "left")
