"""Pressure cues: distances, approach, pressers, compactness, runs and player responses.

All rows of one episode (frames of a short window times a roster) fit a task.
They are hash-partitioned by candidate once; every window and aggregate below
is keyed by candidate plus more, so none of them shuffles again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import PressureConfig
from ..functions.columns import count_where, share, truth
from .turnover import PERIOD

PLAYER = ["candidate_id", "player_id"]
FRAME = ["candidate_id", "frame_id"]


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def to_metres(df: DataFrame, cfg: PressureConfig, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns(
        {f"{x}_m": F.col(x) * cfg.pitch_length_m, f"{y}_m": F.col(y) * cfg.pitch_width_m}
    )


def player_distances(window: DataFrame, roster: DataFrame, positions: DataFrame, cfg: PressureConfig) -> DataFrame:
    """Per (candidate, frame, roster player): metres, distance to the ball in both units."""
    frame = window.select(
        "candidate_id", *PERIOD, "frame_id", "t_us", "relative_time_s", "ball_state", "ball_x", "ball_y", "ball_z"
    )
    seats = roster.select("candidate_id", "player_id", "is_losing")
    tracks = positions.select(*PERIOD, "frame_id", "player_id", "x", "y", "speed")
    joined = frame.join(seats, "candidate_id").join(tracks, [*PERIOD, "frame_id", "player_id"], "left")
    metres = to_metres(to_metres(joined, cfg), cfg, "ball_x", "ball_y")
    return metres.withColumns(
        {
            "distance_m": distance(F.col("x_m"), F.col("y_m"), F.col("ball_x_m"), F.col("ball_y_m")),
            "distance_norm": distance(F.col("x"), F.col("y"), F.col("ball_x"), F.col("ball_y")),
        }
    ).repartition("candidate_id")


def central_gradient(value: str, dt: float) -> Column:
    """Derivative at a fixed step: central inside, one-sided at the first and last frame."""
    w = Window.partitionBy(*PLAYER).orderBy("t_us", "frame_id")
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    first, last = F.lag("frame_id").over(w).isNull(), F.lead("frame_id").over(w).isNull()
    return (
        F.when(first, (after - here) / dt).when(last, (here - before) / dt).otherwise((after - before) / (2 * dt))
    )


def with_approach(distances: DataFrame, cfg: PressureConfig) -> DataFrame:
    """``approach_rate``: how fast the distance to the ball shrinks, metres per second."""
    return distances.withColumn("approach_rate", -central_gradient("distance_m", 1.0 / cfg.frame_rate))


def own_approach(distances: DataFrame, cfg: PressureConfig) -> DataFrame:
    """``own_approach``: the player's own velocity along the line to the ball."""
    dt = 1.0 / cfg.frame_rate
    vx, vy = central_gradient("x_m", dt), central_gradient("y_m", dt)
    dx, dy = F.col("ball_x_m") - F.col("x_m"), F.col("ball_y_m") - F.col("y_m")
    # greatest() skips nulls, so a missing distance is kept missing explicitly.
    unit = F.when(F.col("distance_m").isNotNull(), F.greatest(F.col("distance_m"), F.lit(1e-9)))
    return distances.withColumns({"_vx": vx, "_vy": vy}).withColumn(
        "own_approach", (F.col("_vx") * dx + F.col("_vy") * dy) / unit
    ).drop("_vx", "_vy")


def backward_rate(distances: DataFrame) -> DataFrame:
    """Losing players with a position: change of normalised distance per second since their last one."""
    seen = distances.where(F.col("is_losing") & F.col("distance_norm").isNotNull())
    w = Window.partitionBy(*PLAYER).orderBy("t_us", "frame_id")
    delta = F.col("distance_norm") - F.lag("distance_norm").over(w)
    dt = F.col("relative_time_s") - F.lag("relative_time_s").over(w)
    return seen.withColumns({"delta_distance": delta, "_dt": dt}).withColumn(
        "rate", -F.col("delta_distance") / F.nullif(F.col("_dt"), F.lit(0.0))
    ).drop("_dt")


def stretch_columns(rows: DataFrame, cfg: PressureConfig) -> DataFrame:
    """Distance of each losing player to the team centroid and to the centroid near the ball."""
    frame = Window.partitionBy(*FRAME)
    losing = F.col("is_losing") & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()
    local = losing & truth(F.col("distance_m") <= cfg.local_radius_m)

    def centre(flag, c):
        return F.avg(F.when(flag, F.col(c))).over(frame)

    x, y = F.col("x_m"), F.col("y_m")
    team = distance(x, y, centre(losing, "x_m"), centre(losing, "y_m"))
    near = distance(x, y, centre(local, "x_m"), centre(local, "y_m"))
    return rows.withColumns({"_team": F.when(losing, team), "_near": F.when(local, near)})


def frame_pressure(distances: DataFrame, cfg: PressureConfig, with_own: bool = False) -> DataFrame:
    """Eleven cues per (candidate, frame); ``with_own`` adds the largest own approach of a losing player within reach."""
    d, rate, losing = F.col("distance_m"), F.col("approach_rate"), F.col("is_losing")
    direct = losing & truth(d <= cfg.direct_radius_m)
    within_10 = losing & truth(d <= cfg.approach_radius_m)
    within_15 = losing & truth(d <= cfg.local_radius_m)
    approaching = within_10 & truth(rate >= cfg.min_approach_rate_mps)
    own = [F.max(F.when(within_10, F.col("own_approach"))).alias("max_own_approach")] if with_own else []
    return (
        stretch_columns(with_approach(distances, cfg), cfg)
        .groupBy(*FRAME)
        .agg(
            F.first("t_us").alias("t_us"),
            F.first("relative_time_s").alias("relative_time_s"),
            F.first("ball_state").alias("ball_state"),
            F.first("ball_x_m").alias("ball_x_m"),
            F.first("ball_y_m").alias("ball_y_m"),
            F.first("ball_z").alias("ball_z"),
            count_where(direct).alias("direct_pressers"),
            count_where(approaching).alias("approaching_pressers"),
            count_where(direct | approaching).alias("total_pressers"),
            count_where(within_10).alias("losing_players_within_10m"),
            count_where(within_15).alias("losing_players_within_15m"),
            F.min(F.when(losing, d)).alias("minimum_losing_distance_m"),
            F.max(F.when(losing, rate)).alias("maximum_approach_rate_mps"),
            F.min(F.when(~losing, d)).alias("nearest_opponent_to_ball_m"),
            F.avg("_team").alias("team_stretch_m"),
            F.when(F.count("_near") >= 2, F.avg("_near")).alias("local_compactness_m"),
            *own,
        )
    )


# Names of the cue columns.
CUES = [
    "relative_time_s",
    "direct_pressers",
    "approaching_pressers",
    "total_pressers",
    "losing_players_within_10m",
    "losing_players_within_15m",
    "minimum_losing_distance_m",
    "maximum_approach_rate_mps",
    "nearest_opponent_to_ball_m",
    "team_stretch_m",
    "local_compactness_m",
]


def with_runs(cues: DataFrame) -> DataFrame:
    """Consecutive frames with pressure up to this one: row number minus that of the last frame without."""
    key, order = ["candidate_id"], ["t_us", "frame_id"]
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    sofar = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = cues.withColumn("_at", at)
    total = F.col("total_pressers")

    def run(flag):
        return F.col("_at") - F.coalesce(F.max(F.when(~flag, F.col("_at"))).over(sofar), F.lit(0))

    return numbered.withColumns({"_run_1": run(total >= 1), "_run_2": run(total >= 2)}).drop("_at")


def longest_runs(cues: DataFrame, cfg: PressureConfig) -> DataFrame:
    return with_runs(cues).groupBy("candidate_id").agg(*_run_columns(cfg))


def _run_columns(cfg: PressureConfig) -> list[Column]:
    one, two = F.max("_run_1"), F.max("_run_2")
    return [
        (one / F.lit(cfg.frame_rate)).alias("pressure_duration_s"),
        (two / F.lit(cfg.frame_rate)).alias("collective_pressure_duration_s"),
        (one >= cfg.minimum_sustained_frames).alias("sustained_pressure_cue"),
        (two >= cfg.minimum_sustained_frames).alias("sustained_collective_cue"),
    ]


def _stretch_change() -> Column:
    return F.max_by("team_stretch_m", "t_us") - F.min_by("team_stretch_m", "t_us")


def _feature_columns(cfg: PressureConfig) -> list[Column]:
    return [
        F.max("total_pressers").alias("max_total_pressers"),
        F.max("direct_pressers").alias("max_direct_pressers"),
        F.max("approaching_pressers").alias("max_approaching_pressers"),
        *_run_columns(cfg),
        F.min("minimum_losing_distance_m").alias("minimum_losing_distance_m"),
        F.max("maximum_approach_rate_mps").alias("maximum_approach_rate_mps"),
        F.max("losing_players_within_10m").alias("max_losing_players_within_10m"),
        F.avg("local_compactness_m").alias("mean_local_compactness_m"),
        _stretch_change().alias("team_stretch_change_m"),
    ]


def pressure_features(cues: DataFrame, cfg: PressureConfig, candidates: DataFrame | None = None) -> DataFrame:
    """The twelve features of an episode; with ``candidates``, one without frames or roster keeps a row of nulls."""
    found = with_runs(cues).groupBy("candidate_id").agg(*_feature_columns(cfg))
    return found if candidates is None else candidates.select("candidate_id").join(found, "candidate_id", "left")


# Names of the feature columns.
FEATURES = [
    "max_total_pressers",
    "max_direct_pressers",
    "max_approaching_pressers",
    "pressure_duration_s",
    "collective_pressure_duration_s",
    "sustained_pressure_cue",
    "sustained_collective_cue",
    "minimum_losing_distance_m",
    "maximum_approach_rate_mps",
    "max_losing_players_within_10m",
    "mean_local_compactness_m",
    "team_stretch_change_m",
]


def stretch_change(cues: DataFrame) -> DataFrame:
    return cues.groupBy("candidate_id").agg(_stretch_change().alias("team_stretch_change_m"))


def _first_cue() -> Column:
    return F.min(F.when(F.col("total_pressers") >= 1, F.col("relative_time_s"))).alias("first_cue_s")


def first_cue(cues: DataFrame) -> DataFrame:
    dead = F.min(F.when(F.col("ball_state") != "alive", F.col("relative_time_s")))
    return cues.groupBy("candidate_id").agg(_first_cue(), dead.alias("first_dead_after_s"))


def carrier_proxy(distances: DataFrame) -> DataFrame:
    """Opponent nearest to the ball in each frame; the lower id wins a tie."""
    seen = distances.where(~F.col("is_losing") & F.col("distance_m").isNotNull())
    return seen.groupBy(*FRAME).agg(
        F.min_by("player_id", F.struct("distance_m", "player_id")).alias("carrier"),
        F.min("distance_m").alias("carrier_distance_m"),
    )


# --- player and team responses ---------------------------------------
def _first(c: str) -> Column:
    """First non-null value in time order."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("relative_time_s")))


def _last(c: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("relative_time_s")))


def _response() -> list[Column]:
    return [
        _first("distance_norm").alias("distance_t0"),
        _last("distance_norm").alias("distance_t1"),
        F.min("distance_norm").alias("min_distance"),
        _first("speed").alias("speed_t0"),
        F.max("speed").alias("max_speed"),
        F.max("rate").alias("max_approach_rate"),
        F.avg("rate").alias("mean_approach_rate"),
    ]


def _changes() -> dict[str, Column]:
    return {
        "distance_change": F.col("distance_t1") - F.col("distance_t0"),
        "distance_reduction": F.col("distance_t0") - F.col("min_distance"),
    }


def _temporal() -> list[Column]:
    frames = F.count("frame_id")
    toward = count_where(F.col("rate") > 0)
    return [
        frames.alias("observed_frames"),
        F.avg("speed").alias("mean_speed"),
        _last("speed").alias("speed_t1"),
        toward.alias("positive_approach_frames"),
        F.coalesce(F.sum(F.abs("delta_distance")), F.lit(0.0)).alias("total_distance_movement"),
        share(toward, frames).alias("approach_frame_share"),
    ]


def player_response(rates: DataFrame) -> DataFrame:
    return rates.groupBy(*PLAYER).agg(*_response()).withColumns(_changes())


def player_temporal(rates: DataFrame) -> DataFrame:
    return rates.groupBy(*PLAYER).agg(*_temporal())


def player_extrema(rates: DataFrame) -> DataFrame:
    """All response features of a player, with the time of the least distance and first approach.

    One aggregate per player: the three feature groups need no join.
    """
    nearest = F.min_by(F.struct("relative_time_s", "frame_id"), F.struct("distance_norm", "relative_time_s"))
    players = rates.groupBy(*PLAYER).agg(
        *_response(),
        *_temporal(),
        nearest.alias("_at"),
        F.min(F.when(F.col("rate") > 0, F.col("relative_time_s"))).alias("first_approach_time"),
    )
    ratio = F.when(F.col("distance_t0") > 0, F.col("distance_reduction") / F.col("distance_t0"))
    return (
        players.withColumns(_changes())
        .withColumns(
            {
                "time_to_min_distance": F.col("_at.relative_time_s"),
                "min_distance_frame": F.col("_at.frame_id"),
                "distance_reduction_ratio": ratio,
                "speed_change": F.col("speed_t1") - F.col("speed_t0"),
                "approached_ball": truth(F.col("distance_change") < 0),
            }
        )
        .drop("_at")
    )


def best_response(players: DataFrame, n: int = 1) -> DataFrame:
    w = Window.partitionBy("candidate_id").orderBy(
        F.desc_nulls_last("distance_reduction"), F.desc_nulls_last("max_approach_rate"), "player_id"
    )
    return players.withColumn("response_rank", F.row_number().over(w)).where(F.col("response_rank") <= n)


def team_response(players: DataFrame) -> DataFrame:
    """Means, maxima and the outstanding players of the losing team per episode."""

    def nearest(c):
        rank = F.struct(F.col(c), -F.col("distance_reduction"), F.col("player_id"))
        return F.min_by("player_id", F.when(F.col(c).isNotNull(), rank))

    best = F.struct(-F.col("distance_reduction"), -F.coalesce("max_approach_rate", F.lit(-1e308)), F.col("player_id"))
    return players.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n_losing_players"),
        count_where(F.col("approached_ball")).alias("n_players_approached_ball"),
        F.avg("distance_t0").alias("mean_distance_t0"),
        F.avg("distance_t1").alias("mean_distance_t1"),
        F.avg("distance_reduction").alias("mean_distance_reduction"),
        F.max("distance_reduction").alias("max_distance_reduction"),
        F.avg("mean_approach_rate").alias("mean_approach_rate"),
        F.max("max_approach_rate").alias("max_approach_rate"),
        F.avg("mean_speed").alias("mean_speed_after_loss"),
        F.max("max_speed").alias("max_speed_after_loss"),
        nearest("distance_t0").alias("closest_player_t0"),
        nearest("distance_t1").alias("closest_player_t1"),
        F.min_by("player_id", best).alias("best_response_player"),
    )


# --- screening --------------------------------------------------------
# Names of the screening classes.
NO_CUE = "prioritas_tanpa_cue_bola"
SHORT_CUE = "prioritas_cue_singkat"
NOT_POSITIVE = "review_label_negatif_atau_ragu"
UNSEEN = "belum_ditinjau_visual"
NO_DATA = "tanpa_data"
SHORT_PRESSURE_S = 0.4


def screening_class() -> Column:
    return (
        F.when(F.col("max_total_pressers").isNull(), NO_DATA)
        .when(F.col("max_total_pressers") == 0, NO_CUE)
        .when(F.col("pressure_duration_s") < SHORT_PRESSURE_S, SHORT_CUE)
        .when(~F.col("label_original").eqNullSafe(F.lit(1)), NOT_POSITIVE)
        .otherwise(UNSEEN)
    )


def cue_screening(distances: DataFrame, labels: DataFrame, cfg: PressureConfig) -> DataFrame:
    """Review table: features, first cue, own approach, dead frames, ball path and class.

    One aggregate per frame and one per candidate. A labelled candidate without
    frames or roster stays, with nulls and the class ``NO_DATA``.
    """
    cues = frame_pressure(own_approach(distances, cfg), cfg, with_own=True)

    def end(c, pick):
        return pick(c, "t_us")

    found = with_runs(cues).groupBy("candidate_id").agg(
        *_feature_columns(cfg),
        _first_cue(),
        F.count(F.lit(1)).alias("frames"),
        count_where(F.col("ball_state") != "alive").alias("dead_frames"),
        F.max("ball_z").alias("ball_z_max_raw"),
        end("minimum_losing_distance_m", F.min_by).alias("distance_at_0_m"),
        end("minimum_losing_distance_m", F.max_by).alias("distance_at_end_m"),
        distance(
            end("ball_x_m", F.max_by), end("ball_y_m", F.max_by), end("ball_x_m", F.min_by), end("ball_y_m", F.min_by)
        ).alias("ball_xy_displacement_m"),
        F.max("max_own_approach").alias("max_own_approach_within_10m_mps"),
    )
    out = labels.select("candidate_id", F.col("label").alias("label_original"))
    return out.join(found, "candidate_id", "left").withColumn("screening", screening_class())


def restart_flags(screened: DataFrame, lookback: DataFrame) -> DataFrame:
    """Dead ball inside the window, and dead ball shortly before it."""
    before = lookback.select("candidate_id", "dead_frames_before")
    return screened.select("candidate_id", "dead_frames").join(before, "candidate_id", "left").select(
        "candidate_id",
        (F.col("dead_frames") > 0).alias("dead_after_flag"),
        truth(F.col("dead_frames_before") > 0).alias("near_restart_flag"),
    )
