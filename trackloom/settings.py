"""Frozen settings for the operators. The defaults are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RallySettings:
    """Frame thresholds are counts at ``target_fps``; speeds are in image widths per frame."""

    target_fps: float = 30.0
    visible_streak: int = 5
    start_confirmation: int = 15
    start_buffer: int = 15
    short_gap: int = 30
    long_missing_gap: int = 60
    stopped_window: int = 45
    end_confirmation: int = 45
    end_buffer: int = 15
    minimum_rally: int = 60
    minimum_visible_frames: int = 20
    interpolation_gap: int = 12
    smoothing_window: int = 7
    smoothing_polyorder: int = 2
    peak_cutoff: float = 0.5
    max_single_frame_jump: float = 0.35
    isolated_radius: int = 2
    stopped_speed: float = 0.0015
    recent_motion_window: int = 30
    recent_motion_minimum: float = 0.015
    minimum_motion: float = 0.08
    outside_court_frames: int = 30
    court_tolerance: float = 0.20
    reliable_weight: float = 0.40
    motion_weight: float = 0.25
    player_weight: float = 0.15
    long_gap_weight: float = -0.10
    removed_weight: float = -0.10

    def __post_init__(self) -> None:
        for name in SCALED_FIELDS:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.smoothing_window % 2 == 0 or self.smoothing_window < 3:
            raise ValueError("smoothing_window must be odd and at least 3")
        if self.smoothing_polyorder >= self.smoothing_window:
            raise ValueError("smoothing_polyorder must be below smoothing_window")

    def for_fps(self, fps: float) -> RallySettings:
        """Rescale the frame-count thresholds to another frame rate (half-even, at least 1)."""
        if fps <= 0:
            raise ValueError("fps must be positive")
        scaled = {n: max(1, round(getattr(self, n) * fps / self.target_fps)) for n in SCALED_FIELDS}
        window = max(3, scaled["smoothing_window"] | 1)
        scaled["smoothing_window"] = window
        return replace(self, **scaled, smoothing_polyorder=min(self.smoothing_polyorder, window - 1))


# Integer frame-count settings that follow the frame rate.
SCALED_FIELDS = (
    "visible_streak", "start_confirmation", "start_buffer", "short_gap", "long_missing_gap",
    "stopped_window", "end_confirmation", "end_buffer", "minimum_visible_frames",
    "interpolation_gap", "smoothing_window", "isolated_radius", "recent_motion_window",
    "outside_court_frames",
)


@dataclass(frozen=True)
class EvidenceSettings:
    """Seconds and ratios of the evidence-fusion decoder."""

    readiness_seconds: float = 0.5
    start_lookback_seconds: float = 1.5
    start_confirmation_seconds: float = 1.0
    recoverable_gap_seconds: float = 0.5
    end_confirmation_seconds: float = 1.0
    cooldown_seconds: float = 1.0
    hypothesis_score_floor: float = 0.60
    hypothesis_ambiguity: float = 0.10
    opposite_half_ratio: float = 0.80
    settled_mad_multiplier: float = 2.5
    activity_burst_mad_multiplier: float = 4.0
    minimum_travel_diagonal: float = 0.08
    activity_history: int = 150
    mad_floor: float = 1e-4

    def frames(self, seconds: float, fps: float) -> int:
        return max(1, round(seconds * fps))


@dataclass(frozen=True)
class LinkSettings:
    """Frame-to-frame candidate linking."""

    max_missing_frames: int = 1
    max_speed_diagonals_per_second: float = 6.0
    ambiguity_ratio: float = 0.7
    candidate_threshold: float | None = 0.5


@dataclass(frozen=True)
class AssociationSettings:
    """Tracklet-to-tracklet linking and path search."""

    max_gap_seconds: float = 0.5
    max_speed_diagonals_per_second: float = 6.0
    hypotheses_per_region: int = 5
    minimum_difference: float = 0.25


assert set(SCALED_FIELDS) <= {f.name for f in fields(RallySettings)}
