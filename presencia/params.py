"""Parameters of a scoring run."""

from __future__ import annotations

from dataclasses import dataclass

UNIT_MODES = ("all-samples", "per-sample", "metadata")
UNIQUE_MODES = ("auto", "empirical-background", "hypergeometric-opportunity", "alpha-upper-bound")
COMBINERS = ("simes-closed", "fisher", "harmonic-mean-calibrated", "harmonic-mean", "unique-only", "bonferroni-min")


@dataclass(frozen=True)
class Calibration:
    """How the excluded share of an empirical background is found."""

    initial: float
    least: float
    most: float
    max_iterations: int
    candidate_q: float = 0.20
    settled: float = 0.01


# One profile for a cohort-wide unit, one for grouped units.
ALL_SAMPLES_CALIBRATION = Calibration(0.10, 0.05, 0.20, 5)
GROUPED_CALIBRATION = Calibration(0.05, 0.02, 0.20, 3)


@dataclass(frozen=True)
class ScoreParams:
    unit_mode: str = "all-samples"
    peptide_policy: str = "il-equivalent"
    min_intensity: float = 0.0
    intensity_quantile: float = 0.0
    error_cutoff: float | None = 0.05
    decoy_marker: str = "+"
    unique_mode: str = "auto"
    combiner: str = "simes-closed"
    alpha: float = 0.05
    unique_count_power: float = 1.0
    error_source: str = "global-alpha"
    degeneracy_edges: tuple[int, ...] = (1, 5, 20, 100, 500)
    length_edges: tuple[int, ...] = (7, 10, 14, 20, 30)
    use_length_strata: bool = False
    knockoff_top_n: int | None = None
    hmp_require_unique: bool = True
    seed: int = 42
    iterations_stage1: int = 500
    iterations_stage2: int = 2000
    stage2_ranges: tuple[tuple[float, float], ...] = ((0.01, 0.05),)
    empirical_method: str = "alpha-excess"
    threshold_quantile: float = 0.95
    min_bin_size: int = 50
    max_bins: int = 8

    def __post_init__(self):
        for value, choices in ((self.unit_mode, UNIT_MODES), (self.unique_mode, UNIQUE_MODES), (self.combiner, COMBINERS)):
            if value not in choices:
                raise ValueError(f"{value!r} is not one of {choices}")
        if self.peptide_policy not in ("exact", "il-equivalent"):
            raise ValueError("peptide_policy must be exact or il-equivalent")
        if self.empirical_method not in ("alpha-excess", "empirical-tail"):
            raise ValueError("empirical_method must be alpha-excess or empirical-tail")
        if self.error_source not in ("global-alpha", "peptide-error-column"):
            raise ValueError("error_source must be global-alpha or peptide-error-column")
        if not 0 < self.unique_count_power <= 1:
            raise ValueError("unique_count_power must lie in (0, 1]")
        if not 0 <= self.intensity_quantile <= 1:
            raise ValueError("intensity_quantile must lie in [0, 1]")

    @property
    def calibration(self) -> Calibration:
        return ALL_SAMPLES_CALIBRATION if self.unit_mode == "all-samples" else GROUPED_CALIBRATION
