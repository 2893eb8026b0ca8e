"""Evidence per unit and genome, from unit peptides and panel matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.functions import stats as S
from presencia.params import ScoreParams


def peptide_table(degeneracy: DataFrame, scores: DataFrame, errors: DataFrame | None, params: ScoreParams) -> DataFrame:
    """peptide, d, score, error, weight, contribution, stratum."""
    out = degeneracy.select("peptide", "d").join(scores, "peptide", "left").fillna(1.0, ["score"])
    out = out.join(errors, "peptide", "left") if errors is not None else out.withColumn("error", F.lit(None).cast("double"))
    return out.withColumn("weight", 1 / F.greatest("d", F.lit(1))).withColumn("contribution", F.col("weight") * F.col("score")).withColumn(
        "stratum", S.stratum(F.col("d"), F.col("peptide"), params)
    )


def unit_matches(unit_peptides: DataFrame, peptides: DataFrame, matches: DataFrame) -> DataFrame:
    """unit x genome x peptide with the peptide's columns."""
    return unit_peptides.join(peptides, "peptide").join(matches, "peptide")


def unit_metrics(rows: DataFrame, params: ScoreParams) -> DataFrame:
    """One aggregation per (unit, genome) that has any match."""
    unique, shared = F.col("d") == 1, F.col("d") >= 2
    if params.error_source == "global-alpha":
        log_error = F.count_if(unique) * F.ln(F.lit(params.alpha))
    else:
        log_error = F.sum(F.when(unique, F.ln("error")))
    return rows.groupBy("analysis_unit_id", "genome_id").agg(
        F.count("*").alias("n_matched"),
        F.count_if(unique).alias("n_unique"),
        F.count_if(shared).alias("n_shared"),
        F.avg("score").alias("average_score"),
        F.sum("weight").alias("effective_count"),
        F.sum("contribution").alias("weighted_evidence"),
        F.coalesce(F.sum(F.when(unique, F.col("score"))), F.lit(0.0)).alias("unique_weighted_evidence"),
        F.coalesce(F.sum(F.when(shared, F.col("weight"))), F.lit(0.0)).alias("effective_count_shared"),
        F.coalesce(F.sum(F.when(shared, F.col("contribution"))), F.lit(0.0)).alias("weighted_evidence_shared"),
        F.coalesce(log_error, F.lit(0.0)).alias("log_error_sum"),
        F.count_if(unique & F.col("error").isNull()).alias("n_unique_without_error"),
    )


def strata_counts(rows: DataFrame) -> DataFrame:
    """How many shared peptides of each stratum a (unit, genome) has."""
    return rows.where("d >= 2").groupBy("analysis_unit_id", "genome_id", "stratum").agg(F.count("*").alias("c"))


def knockoff_pools(unit_peptides: DataFrame, peptides: DataFrame) -> DataFrame:
    """unit, stratum, contribution, n: histograms of what the unit's shared
    peptides contribute."""
    shared = unit_peptides.join(peptides.where("d >= 2"), "peptide")
    return shared.groupBy("analysis_unit_id", "stratum", "contribution").agg(F.count("*").alias("n"))


def null_moments(strata: DataFrame, pools: DataFrame) -> DataFrame:
    """unit, genome, null_mean, null_var: moments of the sums in closed form."""
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("contribution")) / total
    square = F.sum(F.col("n") * F.col("contribution") * F.col("contribution")) / total
    of_pool = pools.groupBy("analysis_unit_id", "stratum").agg(mean.alias("m"), F.greatest(square - mean * mean, F.lit(0.0)).alias("v"))
    both = strata.join(of_pool, ["analysis_unit_id", "stratum"])
    return both.groupBy("analysis_unit_id", "genome_id").agg(F.sum(F.col("c") * F.col("m")).alias("null_mean"), F.sum(F.col("c") * F.col("v")).alias("null_var"))


def grid(units: DataFrame, genomes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every unit reports every candidate genome; no match gives zeros.

    Units times genomes is the size of the result itself; metrics are summed
    up before they meet it.
    """
    out = units.crossJoin(genomes).join(metrics, ["analysis_unit_id", "genome_id"], "left")
    zeros = {c: 0 for c, t in metrics.dtypes if c not in ("analysis_unit_id", "genome_id") and t in ("bigint", "double", "int")}
    out = out.fillna(zeros)
    return out.withColumn("match_ratio", F.col("n_matched") / F.greatest("total_peptide_count", F.lit(1))).withColumn(
        "shared_fraction", F.when(F.col("n_matched") > 0, F.col("n_shared") / F.col("n_matched")).otherwise(0.0)
    )


def observed_pool_sizes(metrics: DataFrame) -> DataFrame:
    """Observed unique peptides of a unit over all genomes."""
    return metrics.groupBy("analysis_unit_id").agg(F.sum("n_unique").alias("observed_panel_unique"))
