"""Parameters of the operators. Times are integer microseconds throughout."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
HOUR = 3_600 * SECOND


@dataclass(frozen=True)
class TimeSlices:
    """Widths that cut the time axis of a period into slices.

    ``fine`` bounds what one task sorts. The slices of one period are then
    scanned in one task: a period of hours has a few hundred of them. A time
    axis without such a bound takes ``coarse`` slices as a second level.
    """

    fine: int = 60 * SECOND
    coarse: int | None = None

    def widths(self) -> list[int]:
        return [self.fine] if self.coarse is None else [self.fine, self.coarse]


@dataclass(frozen=True)
class EpisodeConfig:
    pre_us: int = 2 * SECOND
    post_us: int = 2 * SECOND
    regain_horizon_us: int = 5 * SECOND
    frame_step_us: int = 40_000
    step_tolerance_us: int = 1
    k_neighbors: int = 4
    team_size: int = 11
    slices: TimeSlices = TimeSlices()

    @property
    def expected_frame_count(self) -> int:
        return round((self.pre_us + self.post_us) / self.frame_step_us) + 1

    @property
    def frame_rate(self) -> float:
        return SECOND / self.frame_step_us


@dataclass(frozen=True)
class PressureConfig:
    pitch_length_m: float = 105.0
    pitch_width_m: float = 68.0
    direct_radius_m: float = 4.572
    approach_radius_m: float = 10.0
    local_radius_m: float = 15.0
    min_approach_rate_mps: float = 1.0
    minimum_sustained_frames: int = 10
    frame_rate: float = 25.0


@dataclass(frozen=True)
class GraphShape:
    """Shape a complete episode graph must have."""

    frames: int = 101
    nodes: int = 23
    features: int = 6
    edges_per_frame: int = 92


# Match of the published data set -> split.
MATCH_SPLIT = {
    "J03WMX": "train",
    "J03WN1": "train",
    "J03WOH": "train",
    "J03WOY": "train",
    "J03WR9": "train",
    "J03WQQ": "validation",
    "J03WPY": "test",
}

SPLITS = ("train", "validation", "test")
