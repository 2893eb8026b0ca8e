"""Combination of p-values, false discovery rate, ranks and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presencia.functions import stats as S
from presencia.operators.ranking import counted, running, with_rank
from presencia.params import ScoreParams


def combined(rows: DataFrame, params: ScoreParams, pu: str = "pvalue_unique", ps: str = "pvalue_shared", unique: str = "n_unique", target: str = "is_target") -> DataFrame:
    """All combiners, and ``pvalue``, the configured one. Genomes that are no
    target keep p = 1 throughout."""
    cols = S.all_combined(F.col(pu), F.col(ps), F.col(unique), params.hmp_require_unique)
    gated = {k: F.when(F.coalesce(F.col(target), F.lit(False)), c).otherwise(1.0) for k, c in cols.items()}
    return rows.withColumns(gated).withColumn("pvalue", F.col(S.SELECTED[params.combiner]))


def bh(rows: DataFrame, p: str = "pvalue", out: str = "qvalue", unit: str = "analysis_unit_id", family: str = "n_matched") -> DataFrame:
    """Benjamini-Hochberg within a unit over the genomes with a match; others
    get 1. Equal p share a q, so counts of distinct p-values are summed up from
    the least on, and the least value of all larger p is taken, over ranges of
    p: no task holds a unit's p-values."""
    keyed = q_values(rows.where(F.col(family) >= 1), p, out, unit).drop("n")
    joined = rows.join(keyed, [unit, p], "left")
    return joined.withColumn(out, F.when(F.col(family) >= 1, F.col(out)).otherwise(1.0))


def q_values(active: DataFrame, p: str = "pvalue", out: str = "qvalue", unit: str = "analysis_unit_id", n: Column | None = None) -> DataFrame:
    """unit, p, n, q: a row a distinct p of a unit, and how many rows have it
    (or ``n``, an aggregate, where a row stands for several)."""
    steps = counted(active, [unit], p, n, label="p-values").withColumn("raw", F.col(p) * F.col("total") / F.col("upto"))
    steps = running(steps, [unit], p, "raw", out, F.min, backwards=True)
    return steps.select(unit, p, "n", F.least(F.lit(1.0), out).alias(out))


def ranked(rows: DataFrame) -> DataFrame:
    """presence_rank over all candidates of a unit, the score and the flags."""
    order = [F.asc("qvalue"), F.desc("n_unique"), F.desc("n_matched"), F.asc("genome_id")]
    some = F.col("n_matched") >= 1
    return with_rank(rows, "analysis_unit_id", order, "presence_rank").withColumns(
        {
            "presence_score": S.presence_score(F.col("qvalue")),
            "pass_q_0_01": (F.col("qvalue") <= 0.01) & some,
            "pass_q_0_05": (F.col("qvalue") <= 0.05) & some,
        }
    )


def with_targets(rows: DataFrame, top_n: int | None = None) -> DataFrame:
    """is_target: genomes with a match, or the strongest ``top_n`` of them."""
    active = F.col("n_matched") >= 1
    if top_n is None:
        return rows.withColumn("is_target", active)
    order = [
        F.desc(active.cast("int")), F.desc("n_unique"), F.desc("unique_weighted_evidence"), F.desc("weighted_evidence"),
        F.desc("effective_count"), F.desc("match_ratio"), F.desc("n_matched"), F.asc("genome_id"),
    ]
    ranked = with_rank(rows, "analysis_unit_id", order, "_place", "targets")
    return ranked.withColumn("is_target", active & (F.col("_place") <= max(0, top_n))).drop("_place")
