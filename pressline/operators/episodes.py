"""Structural audit of episodes and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import EpisodeConfig
from ..functions.columns import count_where
from . import roster as rosters
from . import windows


def episode_audit(
    candidates: DataFrame, frames: DataFrame, positions: DataFrame, teams: DataFrame, cfg: EpisodeConfig
) -> DataFrame:
    """Counts, validity flags and the failed checks of every candidate."""
    window = windows.episode_window(candidates, frames, cfg)
    active = rosters.active_roster(candidates, positions, teams)
    nodes = rosters.node_table(candidates, window, active, positions)
    # Every frame has at least its ball node, so the frame checks read the same pass.
    per_frame = nodes.groupBy("candidate_id", "frame_id", "t_us").agg(
        count_where(~F.col("valid")).alias("_bad"),
        count_where(~F.col("valid") & (F.col("is_ball") == 1)).alias("_bad_ball"),
    )
    checked = windows.contiguity(
        per_frame,
        cfg,
        F.sum("_bad").alias("invalid_node_observations"),
        F.max("_bad").alias("max_invalid_nodes_per_frame"),
        F.sum("_bad_ball").alias("ball_invalid_frames"),
    )
    sizes = active.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("active_player_count"),
        count_where(F.col("is_losing")).alias("losing_player_count"),
        count_where(~F.col("is_losing")).alias("opponent_player_count"),
    )
    found = windows.loss_frame_lookup(candidates, frames)
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    counts = [
        "frame_count",
        "active_player_count",
        "losing_player_count",
        "opponent_player_count",
        "invalid_node_observations",
        "max_invalid_nodes_per_frame",
        "ball_invalid_frames",
    ]
    joined = candidates.select(
        "candidate_id", "match_id", "period_id", "loss_frame", "loss_t_us", "label_regain_5s"
    )
    for part in (checked, sizes, found.drop("loss_rows")):
        joined = joined.join(part, "candidate_id", "left")
    filled = joined.withColumns(
        {
            **{c: F.coalesce(c, zero) for c in counts},
            **{c: F.coalesce(c, no) for c in ("continuous_frames", "regular_25hz")},
            "expected_frame_count": F.lit(cfg.expected_frame_count),
        }
    ).withColumn("complete_window", F.col("frame_count") == cfg.expected_frame_count)
    size = cfg.team_size
    checks = [
        ("missing_loss_frame", F.col("missing_loss_frame")),
        ("active_player_count_not_22", F.col("active_player_count") != 2 * size),
        ("team_split_not_11_11", (F.col("losing_player_count") != size) | (F.col("opponent_player_count") != size)),
        ("incomplete_window", ~F.col("complete_window")),
        ("non_contiguous_frames", ~F.col("continuous_frames")),
        ("irregular_timestamps", ~F.col("regular_25hz")),
        ("invalid_node_positions", F.col("invalid_node_observations") > 0),
    ]
    reasons = F.concat_ws("|", *[F.when(failed, name) for name, failed in checks])
    return (
        filled.withColumn("failure_reasons", reasons)
        .withColumn("strict_valid", F.col("failure_reasons") == "")
        .drop("missing_loss_frame")
    )


def valid_by_label(audit: DataFrame) -> DataFrame:
    return audit.groupBy("label_regain_5s", "strict_valid").agg(F.count(F.lit(1)).alias("n"))


def failure_counts(audit: DataFrame) -> DataFrame:
    reason = F.explode(F.split("failure_reasons", r"\|")).alias("reason")
    return audit.select(reason).where(F.col("reason") != "").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def roster_distribution(audit: DataFrame) -> DataFrame:
    return audit.groupBy("match_id", "active_player_count").agg(F.count(F.lit(1)).alias("n"))
