"""Columns for p-values, their combination, and evidence bins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_P = 1e-300


def clip_p(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(LEAST_P))


def bin_of(value: Column, edges: tuple[int, ...]) -> Column:
    """Index of the first edge that is not below the value; past all: their number."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < value))


def stratum(d: Column, peptide: Column, params) -> Column:
    length = bin_of(F.length(peptide), params.length_edges) if params.use_length_strata else F.lit(0)
    return F.struct(bin_of(d, params.degeneracy_edges).alias("deg_bin"), length.alias("len_bin"))


def effective_unique(u: Column, power: float) -> Column:
    return F.when(u <= 0, 0.0).otherwise(F.least(u.cast("double"), F.pow(u.cast("double"), F.lit(power))))


def alpha_p(u: Column, log_error_sum: Column, power: float) -> Column:
    """Product of error bounds, tempered by the effective count."""
    log_p = log_error_sum * effective_unique(u, power) / F.greatest(u, F.lit(1))
    return F.when(u <= 0, 1.0).otherwise(clip_p(F.exp(F.greatest(log_p, F.lit(math.log(LEAST_P))))))


def simes_intersection(pu: Column, ps: Column) -> Column:
    a, b = clip_p(pu), clip_p(ps)
    return F.least(F.lit(1.0), 2 * F.least(a, b), F.greatest(a, b))


def simes_closed(pu: Column, ps: Column, unique: Column) -> Column:
    a, b = clip_p(pu), clip_p(ps)
    return F.when(F.coalesce(unique, F.lit(0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * a, F.greatest(a, b)))


def harmonic(pu: Column, ps: Column, unique: Column, gated: bool = True, factor: float = 1.0) -> Column:
    """Two-test harmonic mean p; ``factor`` two is its exact calibration."""
    a, b = clip_p(pu), clip_p(ps)
    value = F.least(F.lit(1.0), factor * (2 * a * b / (a + b)))
    return F.when(F.coalesce(unique, F.lit(0)) <= 0, 1.0).otherwise(value) if gated else value


def bonferroni(pu: Column, ps: Column, unique: Column) -> Column:
    return F.when(F.coalesce(unique, F.lit(0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.least(clip_p(pu), clip_p(ps))))


def fisher(pu: Column, ps: Column) -> Column:
    """Closed form for two p-values; has no gate on unique evidence."""
    half = -(F.ln(clip_p(pu)) + F.ln(clip_p(ps)))
    return F.exp(-half) * (1 + half)


def all_combined(pu: Column, ps: Column, unique: Column, hmp_gated: bool = True) -> dict[str, Column]:
    return {
        "pvalue_simes_closed": simes_closed(pu, ps, unique),
        "pvalue_simes_intersection": simes_intersection(pu, ps),
        "pvalue_combined_harmonic_calibrated": harmonic(pu, ps, unique, True, 2.0),
        "pvalue_combined_harmonic": harmonic(pu, ps, unique, hmp_gated),
        "pvalue_combined_bonferroni": bonferroni(pu, ps, unique),
        "pvalue_combined_fisher": fisher(pu, ps),
        "pvalue_unique_only": clip_p(pu),
    }


#: Which of them a configured combiner selects.
SELECTED = {
    "simes-closed": "pvalue_simes_closed",
    "fisher": "pvalue_combined_fisher",
    "harmonic-mean-calibrated": "pvalue_combined_harmonic_calibrated",
    "harmonic-mean": "pvalue_combined_harmonic",
    "unique-only": "pvalue_unique_only",
    "bonferroni-min": "pvalue_combined_bonferroni",
}


def presence_score(q: Column) -> Column:
    score = -F.log10(clip_p(q))
    return F.when(F.abs(score) < 1e-12, 0.0).otherwise(score)


def in_any_range(p: Column, ranges) -> Column:
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | p.between(min(a, b), max(a, b))
    return F.coalesce(inside, F.lit(False))
