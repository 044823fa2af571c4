"""Parameters of the engine.

Everything here is small, known before a job starts and inlined into plans as
literals, so no dimension table has to be joined for a threshold test.
"""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
DAY_US = 24 * HOUR_US


@dataclass(frozen=True)
class Sensor:
    key: str
    label: str
    unit: str
    baseline: float
    warning: float
    critical: float
    low: float
    high: float
    cap: float
    weight: float

    @property
    def span(self) -> float:
        return self.critical - self.baseline


@dataclass(frozen=True)
class Integrity:
    """What the data-quality rules know about one instrument."""

    resolution: float
    decimals: int
    response_s: float
    physical_min: float
    physical_max: float
    stuck_observe_s: float
    stuck_suspect_s: float
    exact_values: bool
    related: tuple[str, ...]
    context_change: float


# Manufacturer limits per sensor.
SENSORS: tuple[Sensor, ...] = (
    Sensor("vibration_mps2", "Vibration", "m/s^2", 1.0, 3.0, 4.0, 0.0, 20.0, 6.5, 0.5),
    Sensor("temperature_c", "Temperature", "degC", 30.0, 60.0, 80.0, -20.0, 200.0, 110.0, 0.3),
    Sensor("current_ampere", "Current", "A", 4.0, 6.0, 8.0, 0.0, 50.0, 10.0, 0.2),
)
SENSOR_KEYS = tuple(s.key for s in SENSORS)
BY_KEY = {s.key: s for s in SENSORS}

# Instrument knowledge used by the data-quality rules.
INTEGRITY: dict[str, Integrity] = {
    "vibration_mps2": Integrity(
        0.01, 2, 120, 0.0, 20.0, 3600, 7200, True, ("current_ampere", "temperature_c"), 0.5),
    "temperature_c": Integrity(
        0.1, 1, 3600, -20.0, 200.0, 14400, 28800, True, ("current_ampere", "vibration_mps2"), 2.0),
    "current_ampere": Integrity(
        0.01, 2, 300, 0.0, 50.0, 3600, 7200, True, ("vibration_mps2", "temperature_c"), 0.5),
}

# Factors by which a finding lowers forecast confidence.
PENALTIES = {
    "observation": 1.0, "suspected": 0.65, "noise": 0.75, "short_gap": 0.9,
    "long_gap": 0.0, "machine_event": 0.55, "invalid": 0.0,
}

STATUS_NAMES = ("NORMAL", "WARNING", "CRITICAL")
WINDOWS_MIN = (5, 15, 30, 60, 180, 360, 720, 1440)
TREND_WINDOWS_MIN = (60, 180, 360, 720, 1440)
HORIZONS_H = (6, 12, 24)
DURATION_BOUNDS_H = (72, 168, 336, 720)
PROBABILITY_TARGETS = tuple(
    f"probability_{kind}_{h}h" for kind in ("warning", "critical") for h in HORIZONS_H)
REQUIRED_TARGETS = ("probability_warning_12h", "probability_critical_24h")
ETA_TARGETS = ("time_to_warning", "time_to_critical")


@dataclass(frozen=True)
class Cadence:
    expected_s: float = 60.0
    interpolate: bool = False
    max_interpolation_min: float = 5.0
    large_gap_policy: str = "mark_unavailable"

    @property
    def max_gap_s(self) -> float:
        return self.max_interpolation_min * 60.0


@dataclass(frozen=True)
class Smoothing:
    median_rows: int = 5
    fast_alpha: float = 0.35
    slow_alpha: float = 0.10
    process_variance: float = 5e-5
    measurement_variance: float = 0.01
    jump_multiplier: float = 4.0


@dataclass(frozen=True)
class Monitoring:
    vote_rows: int = 5
    votes: int = 3
    normal_recovery_rows: int = 5
    critical_recovery_rows: int = 5
    minimum_forecast_points: int = 1440
    minimum_r_squared: float = 0.3
    horizon_h: float = 240.0
    step_min: float = 10.0


@dataclass(frozen=True)
class Lifecycle:
    degraded_min: float = 30.0
    confirm_min: float = 60.0
    medium_factor: float = 1.5
    pre_window_min: float = 60.0
    post_window_min: float = 60.0
    min_life_h: float = 12.0
    cooldown_h: float = 2.0
    improved_sensors: int = 2
    sensor_drop: float = 0.20
    severity_drop: float = 0.30
    baseline_tolerance: float = 0.35
    warning_confirm_min: float = 30.0
    critical_confirm_min: float = 30.0
    critical_before_reset_min: float = 30.0
    max_gap_min: float = 5.0


@dataclass(frozen=True)
class Anomaly:
    enabled: bool = True
    observe_s: float = 180.0
    persist_s: float = 180.0
    recovery_multiplier: float = 3.0
    abrupt_fraction: float = 0.25
    noise_rows: int = 20
    noise_multiplier: float = 8.0
    clip_tolerance: float = 0.5
    clip_rows: int = 3
    correlation_s: float = 300.0
    long_gap_s: float = 300.0
    gap_tolerance_s: float = 5.0
    recovery_rows: int = 5
    context_events: int = 2
    drift_rows: int = 120
    drift_span: float = 0.35
    history_rows: int = 1440
    confidence_floor: float = 0.0


@dataclass(frozen=True)
class Prognostics:
    enabled: bool = True
    min_history_min: float = 180.0
    min_windows: int = 2
    min_samples: int = 30
    min_coverage: float = 0.8
    min_history_fraction: float = 0.9
    baseline_alpha: float = 0.002
    baseline_min_samples: int = 180
    initial_std_fraction: float = 0.05
    min_std_fraction: float = 0.02
    min_sigma_fraction: float = 0.001
    single_window_uncertainty: float = 0.5
    full_strength_snr: float = 2.0
    shrink_uncertainty: float = 0.5
    interval_z: float = 1.2815515655446004
    high_history_min: float = 720.0
    high_windows: int = 4
    high_consistency: float = 0.75
    medium_consistency: float = 0.55
    z_cap: float = 8.0
    action_probability: float = 0.5
    eta_action_probability: float = 0.5
    update_max_z: float = 2.5
    warmup_max_z: float = 8.0
    release_fraction: float = 0.7
    release_min: float = 60.0
    warning_persist_min: float = 10.0
    critical_persist_min: float = 30.0
    advisory: bool = True
    automated: bool = False


@dataclass(frozen=True)
class Params:
    cadence: Cadence = field(default_factory=Cadence)
    smoothing: Smoothing = field(default_factory=Smoothing)
    monitoring: Monitoring = field(default_factory=Monitoring)
    lifecycle: Lifecycle = field(default_factory=Lifecycle)
    anomaly: Anomaly = field(default_factory=Anomaly)
    prognostics: Prognostics = field(default_factory=Prognostics)
    inclusive: bool = False


DEFAULT = Params()
