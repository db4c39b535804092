"""Teams of players, rosters of episodes and the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .turnover import PERIOD


def player_team(events: DataFrame) -> DataFrame:
    """Team of a player: the one named by the player's first event of the match; times restart per period."""
    known = events.where(F.col("player_id").isNotNull() & F.col("team_id").isNotNull())
    return known.groupBy("match_id", "player_id").agg(
        F.min_by("team_id", F.struct("period_id", "t_us", "event_id")).alias("team_id")
    )


def active_roster(candidates: DataFrame, positions: DataFrame, teams: DataFrame) -> DataFrame:
    """Players of both teams with a position in the loss frame, numbered by id."""
    at_loss = positions.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *PERIOD, F.col("frame_id").alias("loss_frame"), "player_id"
    )
    own = F.col("team_id") == F.col("losing_team")
    w = Window.partitionBy("candidate_id").orderBy("player_id")
    return (
        candidates.select("candidate_id", *PERIOD, "loss_frame", "losing_team", "opponent_team")
        .join(at_loss, [*PERIOD, "loss_frame"])
        .join(teams, ["match_id", "player_id"])
        .where(own | (F.col("team_id") == F.col("opponent_team")))
        .select(
            "candidate_id",
            *PERIOD,
            "player_id",
            "team_id",
            own.alias("is_losing"),
            (F.row_number().over(w) - 1).alias("node_idx"),
        )
    )


def node_table(candidates: DataFrame, window: DataFrame, roster: DataFrame, positions: DataFrame) -> DataFrame:
    """One row per (candidate, frame, node): roster order, the ball last.

    A missing position keeps speed and team flags but sets x = y = 0 and
    ``valid`` to false. The ball takes a seat like a player, so the window is
    read once; a candidate without roster still has its ball.
    """
    size = roster.groupBy("candidate_id").agg(F.count(F.lit(1)).cast("int").alias("_seats"))
    ball = candidates.select("candidate_id").join(size, "candidate_id", "left")
    seats = roster.select("candidate_id", "player_id", "is_losing", "node_idx").unionByName(
        ball.select(
            "candidate_id",
            F.lit("BALL").alias("player_id"),
            F.lit(None).cast("boolean").alias("is_losing"),
            F.coalesce("_seats", F.lit(0)).alias("node_idx"),
        )
    )
    frame = window.select(
        "candidate_id", *PERIOD, "frame_id", "t_us", "relative_time_s", "ball_x", "ball_y", "ball_speed"
    )
    tracks = positions.select(*PERIOD, "frame_id", "player_id", "x", "y", "speed")
    is_ball = F.col("is_losing").isNull()

    def either(ball_column, player_column):
        return F.when(is_ball, F.col(ball_column)).otherwise(F.col(player_column))

    def flag(c):
        return F.when(c, 1).otherwise(0)

    x, y = either("ball_x", "x"), either("ball_y", "y")
    valid = x.isNotNull() & y.isNotNull()
    return (
        frame.join(seats, "candidate_id")
        .join(tracks, [*PERIOD, "frame_id", "player_id"], "left")
        .select(
            "candidate_id",
            "match_id",
            "frame_id",
            "t_us",
            "relative_time_s",
            "node_idx",
            "player_id",
            F.when(valid, x).otherwise(0.0).alias("x"),
            F.when(valid, y).otherwise(0.0).alias("y"),
            F.coalesce(either("ball_speed", "speed"), F.lit(0.0)).alias("speed"),
            flag(is_ball).alias("is_ball"),
            flag(F.col("is_losing")).alias("is_losing"),
            flag(~F.col("is_losing")).alias("is_opponent"),
            valid.alias("valid"),
        )
    )
