"""Unique-evidence p-values by mode."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.functions import stats as S
from presencia.params import ScoreParams


def alpha_bound(rows: DataFrame, params: ScoreParams) -> DataFrame:
    """pvalue_unique, unique_effective_count from error bounds. Peptides'
    own bounds must be there for every unique peptide."""
    if params.error_source == "peptide-error-column" and not rows.where("n_unique_without_error > 0").isEmpty():
        raise ValueError("unique peptides without an error bound")
    return rows.withColumn("pvalue_unique", S.alpha_p(F.col("n_unique"), F.col("log_error_sum"), params.unique_count_power)).withColumn(
        "unique_effective_count", S.effective_unique(F.col("n_unique"), params.unique_count_power)
    )


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    logs = np.frompyfunc(math.lgamma, 1, 1)
    return (logs(n + 1.0) - logs(k + 1.0) - logs(n - k + 1.0)).astype(float)


def upper_tails(universe: np.ndarray, successes: np.ndarray, draws: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """P(X >= seen) of hypergeometric counts, all rows at once.

    The first term comes from log factorials and the others from their ratios.
    Above the mean terms fall from ``seen`` upwards; below it the lower tail's
    fall downwards and are taken from one. Both end after some standard
    deviations, however large the counts.
    """
    n, k, s, x = (np.asarray(v, dtype=float) for v in (universe, successes, draws, seen))
    least, most = np.maximum(0.0, s + k - n), np.minimum(k, s)
    out = np.where((x <= least) | (n <= 0), 1.0, np.where(x > most, S.LEAST_P, np.nan))
    todo = np.flatnonzero(np.isnan(out))
    n, k, s, x, least, most = (v[todo] for v in (n, k, s, x, least, most))
    up = x > s * k / np.maximum(n, 1.0)
    at = np.where(up, x, x - 1.0)
    log_first = _log_choose(k, at) + _log_choose(n - k, s - at) - _log_choose(n, s)
    total, term, live = np.ones(len(todo)), np.ones(len(todo)), np.ones(len(todo), bool)
    while live.any():
        inside = np.where(up, at < most, at > least)
        # rows that are done may divide by zero; their terms are not used
        with np.errstate(divide="ignore", invalid="ignore"):
            rise = (k - at) * (s - at) / ((at + 1.0) * (n - k - s + at + 1.0))
            fall = at * (n - k - s + at) / ((k - at + 1.0) * (s - at + 1.0))
            term = np.where(live & inside, term * np.where(up, rise, fall), 0.0)
        total += term
        at = at + np.where(up, 1.0, -1.0)
        live &= inside & (term > total * 1e-18)
    tail = np.exp(np.maximum(log_first + np.log(total), math.log(S.LEAST_P)))
    out[todo] = np.clip(np.where(up, tail, 1.0 - tail), S.LEAST_P, 1.0)
    return out


def hypergeometric(rows: DataFrame, pool_sizes: DataFrame, universe: DataFrame) -> DataFrame:
    """pvalue_hypergeometric, expected_unique, unique_fold.

    ``universe``: one row with n_unique, the panel-unique peptides of all
    genomes; a unit's draws are its observed ones. Genomes without a unique
    peptide have p 1; the others' distinct counts are worked out once each.
    """

    @F.pandas_udf("double")
    def tail(n, k, s, x):
        import pandas as pd

        return pd.Series(upper_tails(n.to_numpy(), k.to_numpy(), s.to_numpy(), x.to_numpy()))

    total = universe.select(F.col("n_unique").alias("_total"))
    out = rows.join(pool_sizes, "analysis_unit_id", "left").fillna(0, ["observed_panel_unique"]).crossJoin(F.broadcast(total))  # one number
    counts = ["_total", "opportunity", "observed_panel_unique", "n_unique"]
    found = out.where("n_unique > 0").select(*counts).distinct().withColumn("_p", tail(*counts))
    expected = F.when(F.col("_total") > 0, F.col("observed_panel_unique") * F.col("opportunity") / F.col("_total")).otherwise(0.0)
    fold = F.when(F.col("expected_unique") > 0, F.col("n_unique") / F.col("expected_unique")).otherwise(0.0)
    out = out.join(found, counts, "left").withColumn("expected_unique", expected)
    return out.withColumns({"pvalue_hypergeometric": F.coalesce("_p", F.lit(1.0)), "unique_fold": fold}).drop("_total", "_p")
