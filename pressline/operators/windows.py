"""Bounded time intervals around candidates: one bucketed interval join, and what builds on it.

Candidates (few) are spread over the buckets their interval touches; frames or
events (many) carry one bucket and are never copied. The equi-join key
(match, period, bucket) is fine-grained, and adaptive execution splits it
further where one bucket is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import SECOND, EpisodeConfig
from ..functions import ordered
from ..functions.columns import bucket_of, count_where
from .turnover import FRAME_ORDER, PERIOD


def interval_join(
    candidates: DataFrame, rows: DataFrame, start: Column, end: Column, width: int, t: str = "t_us", how: str = "inner"
) -> DataFrame:
    """Rows of the same period with start <= t <= end, both ends included."""
    spread = candidates.withColumns({"_start": start, "_end": end}).withColumn(
        "_bucket", F.explode(F.sequence(bucket_of("_start", width), bucket_of("_end", width)))
    )
    placed = rows.withColumn("_bucket", bucket_of(t, width))
    joined = spread.join(placed, [*PERIOD, "_bucket"], how)
    return joined.where(F.col(t).between(F.col("_start"), F.col("_end"))).drop("_bucket", "_start", "_end")


def relative_seconds(t: str = "t_us", origin: str = "loss_t_us") -> Column:
    return (F.col(t) - F.col(origin)) / F.lit(float(SECOND))


def episode_window(candidates: DataFrame, frames: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Frames from ``pre`` before to ``post`` after the turnover."""
    t0 = F.col("loss_t_us")
    joined = interval_join(candidates, frames, t0 - cfg.pre_us, t0 + cfg.post_us, cfg.pre_us + cfg.post_us)
    return joined.withColumn("relative_time_s", relative_seconds())


def decision_window(candidates: DataFrame, frames: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Frames from the turnover to ``post`` after it."""
    t0 = F.col("loss_t_us")
    joined = interval_join(candidates, frames, t0, t0 + cfg.post_us, cfg.post_us)
    return joined.withColumn("relative_time_s", relative_seconds())


def require_frames(candidates: DataFrame, window: DataFrame) -> DataFrame:
    """Candidates with their frame count; an empty window stops the job."""
    counts = window.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("frame_count"))
    checked = F.when(F.col("frame_count") > 0, F.col("candidate_id")).otherwise(
        F.raise_error(F.concat(F.lit("empty window: "), F.col("candidate_id")))
    )
    return candidates.join(counts, "candidate_id", "left").withColumn("candidate_id", checked)


def outcome_window(candidates: DataFrame, frames: DataFrame, cfg: EpisodeConfig, pre_us: int = 0) -> DataFrame:
    """Frames from ``pre`` before the turnover to the regain; only candidates with one."""
    found = candidates.where(F.col("regain_found"))
    joined = interval_join(
        found, frames, F.col("loss_t_us") - pre_us, F.col("regain_t_us"), cfg.regain_horizon_us + pre_us
    )
    return joined.withColumn("relative_time_s", relative_seconds())


def loss_frame_lookup(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """How often the loss frame occurs in its period: 0 is missing, above 1 is not unique."""
    seen = frames.select(*PERIOD, F.col("frame_id").alias("loss_frame"), F.lit(1).alias("_hit"))
    return (
        candidates.select("candidate_id", *PERIOD, "loss_frame")
        .join(seen, [*PERIOD, "loss_frame"], "left")
        .groupBy("candidate_id")
        .agg(F.count("_hit").alias("loss_rows"))
        .withColumn("missing_loss_frame", F.col("loss_rows") == 0)
    )


def event_context(candidates: DataFrame, events: DataFrame, reach_us: int) -> DataFrame:
    """Events at most ``reach`` before or after the turnover, with their relative time."""
    t0 = F.col("loss_t_us")
    joined = interval_join(candidates, events, t0 - reach_us, t0 + reach_us, 2 * reach_us)
    return joined.withColumn("relative_time_s", relative_seconds())


def nearest_snapshots(window: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Frame nearest to each target time per candidate; the earlier one wins a tie.

    One aggregate holds all targets, so no row is copied per target.
    """
    rel = F.col("relative_time_s")

    def pick(target):
        return F.struct(
            F.lit(float(target)).alias("target_s"),
            F.min_by(
                F.struct("frame_id", "relative_time_s"),
                F.struct(F.abs(F.round(rel - target, 9)), rel, F.col("frame_id")),
            ).alias("_f"),
        )

    picks = window.groupBy("candidate_id").agg(F.array(*[pick(t) for t in targets]).alias("_p"))
    return picks.select("candidate_id", F.inline("_p")).select("candidate_id", "target_s", "_f.*")


def lookback_state(candidates: DataFrame, frames: DataFrame, cfg: EpisodeConfig, rows: int = 50) -> DataFrame:
    """Dead frames among the ``rows`` frames before the loss frame, and the state just before it."""
    slices = ordered.time_slices("t_us", cfg.slices.widths())
    seen = ordered.recent_rows(
        frames.select(*PERIOD, *FRAME_ORDER, "ball_state"),
        PERIOD,
        FRAME_ORDER,
        slices,
        rows,
        {
            "dead_frames_before": count_where(F.col("ball_state") != "alive"),
            "previous_frame_state": F.last("ball_state"),
        },
    )
    before = seen.select(
        *PERIOD, F.col("frame_id").alias("loss_frame"), "dead_frames_before", "previous_frame_state"
    )
    return candidates.select("candidate_id", *PERIOD, "loss_frame").join(before, [*PERIOD, "loss_frame"])


def contiguity(window: DataFrame, cfg: EpisodeConfig, *more: Column) -> DataFrame:
    """Per candidate: are all frame steps 1 and all time steps regular; false below two rows.

    ``more`` adds aggregates over the same rows.
    """
    w = Window.partitionBy("candidate_id").orderBy("t_us", "frame_id")
    steps = window.withColumns(
        {
            "_df": F.col("frame_id") - F.lag("frame_id").over(w),
            "_dt": F.col("t_us") - F.lag("t_us").over(w),
        }
    )
    some = F.count("_df") > 0
    regular = F.abs(F.col("_dt") - cfg.frame_step_us) <= cfg.step_tolerance_us
    return steps.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("frame_count"),
        (some & F.coalesce(F.bool_and(F.col("_df") == 1), F.lit(False))).alias("continuous_frames"),
        (some & F.coalesce(F.bool_and(regular), F.lit(False))).alias("regular_25hz"),
        *more,
    )


def is_ordered(rows: DataFrame, keys: Sequence[str], sequence: str, t: str) -> DataFrame:
    """Per group: is time non-decreasing in source order?"""
    prev = ordered.previous_row(rows, keys, [sequence], ordered.number_slices(sequence), [t])
    return prev.groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.col(f"prev_{t}") <= F.col(t), F.lit(True))).alias("is_ordered")
    )
