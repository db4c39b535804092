"""Possession changes, quick regains and the statistics around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import SECOND, EpisodeConfig
from ..functions import ordered
from ..functions.columns import count_where, share, truth
from ..session import stage

PERIOD = ["match_id", "period_id"]
FRAME_ORDER = ["t_us", "frame_id"]


def candidate_key(match="match_id", period="period_id", frame="frame_id") -> Column:
    return F.concat(F.col(match), F.lit("_P"), F.col(period).cast("string"), F.lit("_F"), F.col(frame).cast("string"))


def with_previous_owner(frames: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """``prev_owner`` is the owner in the frame directly before, null if it had none."""
    slices = ordered.time_slices("t_us", cfg.slices.widths())
    return ordered.previous_row(frames, PERIOD, FRAME_ORDER, slices, ["owner"])


def possession_changes(frames: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    return with_previous_owner(frames, cfg).where(truth(F.col("owner") != F.col("prev_owner")))


def alive_changes(frames: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """The state filter sits above the look-back: dead frames still hide a change."""
    return possession_changes(frames, cfg).where(F.col("ball_state") == "alive")


def quick_regain(changes: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """First later change that gives the ball back to the losing team.

    A forward as-of join without a join: each change is a loss of one team and
    a gain of the other, and a scan backwards in time carries the nearest gain
    to each loss. The scan is sliced, so neither a hot period nor a long
    horizon gathers in one task.
    """

    def role(team, gain):
        nothing = F.lit(None).cast("struct<t_us:bigint,frame_id:bigint>")
        return F.struct(F.col(team).alias("team"), (F.struct("t_us", "frame_id") if gain else nothing).alias("_gain"))

    roles = changes.select(
        *PERIOD,
        *FRAME_ORDER,
        "owner",
        (-F.col("t_us")).alias("_back_t"),
        (-F.col("frame_id")).alias("_back_f"),
        F.inline(F.array(role("prev_owner", False), role("owner", True))),
    )
    slices = ordered.time_slices("_back_t", cfg.slices.widths())
    scanned = ordered.last_seen(
        roles, [*PERIOD, "team"], ["_back_t", "_back_f"], slices, F.col("_gain"), "_next"
    ).where(F.col("_gain").isNull())
    found = truth((F.col("_next.t_us") - F.col("t_us")) <= cfg.regain_horizon_us)
    return scanned.select(
        candidate_key().alias("candidate_id"),
        *PERIOD,
        F.col("t_us").alias("loss_t_us"),
        F.col("frame_id").alias("loss_frame"),
        F.col("team").alias("losing_team"),
        F.col("owner").alias("opponent_team"),
        found.alias("regain_found"),
        found.cast("int").alias("label_regain_5s"),
        F.when(found, F.col("_next.t_us")).alias("regain_t_us"),
        F.when(found, F.col("_next.frame_id")).alias("regain_frame"),
        F.when(found, (F.col("_next.t_us") - F.col("t_us")) / F.lit(float(SECOND))).alias("regain_gap_seconds"),
    )


def turnover_candidates(frames: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Changes are a small fraction of the frames and feed several branches of the
    regain scan: they are written once, so the frames are sorted once."""
    changes = alive_changes(frames, cfg).select(*PERIOD, *FRAME_ORDER, "owner", "prev_owner")
    return quick_regain(stage(changes, "changes"), cfg)


def change_gap(candidates: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Seconds since the previous candidate of the period."""
    slices = ordered.time_slices("loss_t_us", cfg.slices.widths())
    prev = ordered.previous_row(candidates, PERIOD, ["loss_t_us", "loss_frame"], slices, ["loss_t_us"])
    return prev.withColumn(
        "gap_seconds", (F.col("loss_t_us") - F.col("prev_loss_t_us")) / F.lit(float(SECOND))
    ).drop("prev_loss_t_us")


def gap_stats(gaps: DataFrame, value: str, thresholds: dict[str, float]) -> DataFrame:
    """One row: count, mean, std, exact quantiles and counts up to each threshold.

    The values feed two scans, so they are written once instead of computed twice.
    """
    gaps = stage(gaps.select(value), "gaps")
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95}
    stats = gaps.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[count_where(F.col(value) <= limit).alias(name) for name, limit in thresholds.items()],
    )
    return ordered.with_scalars(stats, ordered.exact_quantiles(gaps, [], value, probs))


def regain_distribution(candidates: DataFrame) -> DataFrame:
    found = count_where(F.col("regain_found"))
    total = F.count(F.lit(1))
    return candidates.groupBy("match_id").agg(
        total.alias("changes"),
        found.alias("regained"),
        (total - found).alias("not_regained"),
        (share(found, total) * 100).alias("regain_pct"),
    )


def match_summary(candidates: DataFrame, strict_valid: Column | None = None) -> DataFrame:
    """Candidates, positives, strict-valid episodes and rate per match."""
    valid = F.lit(True) if strict_valid is None else strict_valid
    total = F.count(F.lit(1))
    return candidates.groupBy("match_id").agg(
        total.alias("candidates"),
        F.sum("label_regain_5s").alias("positives"),
        count_where(valid).alias("strict_valid"),
        share(count_where(valid), total).alias("strict_valid_rate"),
        share(F.sum("label_regain_5s"), total).alias("regain_rate"),
    )


def possession_quantity(frames: DataFrame, candidates: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Per match and in total: frames, owned frames, changes, alive changes, regains."""
    changed = truth(F.col("owner") != F.col("prev_owner"))
    alive = F.col("ball_state") == "alive"
    per_frame = (
        with_previous_owner(frames, cfg)
        .groupBy("match_id")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.count("owner").alias("owned_frames"),
            count_where(changed).alias("all_changes"),
            count_where(changed & alive).alias("alive_changes"),
        )
    )
    regains = candidates.groupBy("match_id").agg(count_where(F.col("regain_found")).alias("regains"))
    names = ["frames", "owned_frames", "all_changes", "alive_changes", "regains"]
    return (
        per_frame.join(regains, "match_id", "left")
        .rollup("match_id")
        .agg(F.grouping("match_id").alias("_total"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        .select(F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("match_id")).alias("match_id"), *names)
    )


def first_episode(candidates: DataFrame) -> DataFrame:
    """First positive candidate in canonical order (top-1 without a full sort)."""
    return (
        candidates.where(F.col("label_regain_5s") == 1)
        .orderBy("match_id", "period_id", "loss_t_us", "loss_frame")
        .limit(1)
    )
