"""Parameters of the signal engine, passed explicitly; there are no globals from the environment."""

from __future__ import annotations

from dataclasses import dataclass

#: Class groups, drone types, integrity rules in bit order, features in column order, faults.
CLASS_GROUPS = ("drone", "bird", "human", "reflector")
DRONES = ("D1", "D2", "D3", "D4", "D5", "D6")
HARD_RULES = ("nonfinite", "dead_block", "frozen_block", "clipping", "duplicate")
STAT_RULES = ("dc_offset", "spike", "off_centre", "edge_cliff")
INTEGRITY_RULES = HARD_RULES + STAT_RULES
FEATURES = (
    "snr_db",
    "peak_doppler_hz",
    "doppler_centroid_hz",
    "doppler_spread_hz",
    "spectral_entropy",
    "md_bandwidth_hz",
    "n_cfar",
    "zero_doppler_ratio",
    "centre_power_frac",
    "noise_floor_db",
    "envelope_cv",
    "amp_kurtosis",
    "crest_factor_db",
    "lag1_coherence",
    "envelope_roughness",
    "iq_power_ratio_db",
)
FAULTS = (
    "dropped_block",
    "adc_clipping",
    "interference_burst",
    "dc_leakage",
    "phase_jump",
    "range_offset",
    "frozen_block",
    "duplicate_segment",
    "gain_drift",
)


@dataclass(frozen=True)
class Radar:
    """Shape and rates of a segment, and the constants of its processing."""

    n_range: int = 5
    n_slow: int = 256
    prf_hz: float = 17_000.0
    fc_hz: float = 77e9
    c_mps: float = 299_792_458.0
    cfar_guard: int = 4
    cfar_train: int = 16
    cfar_pfa: float = 1e-4
    stft_size: int = 64
    stft_hop: int = 16
    md_threshold_db: float = 10.0
    zero_doppler_bins: int = 2
    edge_window: int = 8
    zero_eps: float = 1e-9
    clip_tol: float = 1e-6

    @property
    def centre(self) -> int:
        return self.n_range // 2

    @property
    def wavelength_m(self) -> float:
        return self.c_mps / self.fc_hz


#: The shape of the signals that are packed from vectors of 64 values.
SMALL = Radar(n_slow=64, stft_size=16, stft_hop=4)


@dataclass(frozen=True)
class Quality:
    """Thresholds of rules and flags."""

    dead_run: int = 16
    frozen_run: int = 8
    clip_min_samples: int = 6
    low_snr_db: float = 6.0
    gap_s: float = 0.5
    rule_percentile: float = 0.999
    ml_percentile: float = 0.99
    fractions: tuple[float, float, float] = (0.6, 0.2, 0.2)

    def hard(self) -> dict[str, float]:
        return {"nonfinite": 1.0, "dead_block": self.dead_run, "frozen_block": self.frozen_run, "clipping": self.clip_min_samples, "duplicate": 1.0}
