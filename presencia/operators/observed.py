"""Observed tables: normalising, filtering, and what is known per peptide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.functions import text as T
from presencia.operators.ranking import quantiles
from presencia.params import ScoreParams

# Other marks of a decoy, in the order they are tried.
DECOY_MARKS = ("True", "true", "1", "decoy", "Decoy", "DECOY", "T", "t")


def decoy_marker(observed: DataFrame, configured: str = "+") -> str:
    """The configured mark as it is, but for the default ``+``: where the
    column never says that and says one of the known others, it is the first of
    these. One action that returns no more than the known marks."""
    if configured != "+":
        return configured
    marks = T.strip_all(F.col("decoy"))
    values = {r[0] for r in observed.select(marks.alias("m")).where(F.col("m").isin(configured, *DECOY_MARKS)).distinct().collect()}
    return configured if configured in values else next((m for m in DECOY_MARKS if m in values), configured)


def targets(observed: DataFrame, params: ScoreParams = ScoreParams(), marker: str | None = None) -> DataFrame:
    """sample_id, peptide, raw, intensity, score, error without decoys."""
    marker = decoy_marker(observed, params.decoy_marker) if marker is None else marker
    kept = observed.where(~T.strip_all(F.col("decoy")).eqNullSafe(F.lit(marker)))
    return kept.select(
        T.sample_id(F.col("sample")).alias("sample_id"),
        T.peptide(F.col("sequence"), params.peptide_policy).alias("peptide"),
        T.peptide(F.col("sequence"), "exact").alias("raw"),
        "intensity", "score", "error",
    )


def valid(rows: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """Filled ids, intensity above the minimum, error within its cutoff, and
    at or above the sample's own intensity quantile if one is asked for."""
    out = rows.where((F.col("sample_id") != "") & (F.col("peptide") != "") & (F.col("intensity") > params.min_intensity))
    if params.error_cutoff is not None:
        out = out.where(F.col("error") <= params.error_cutoff)
    if params.intensity_quantile > 0:
        out = above_quantile(out, params.intensity_quantile)
    return out


def above_quantile(rows: DataFrame, q: float) -> DataFrame:
    """Rows at or above the linear quantile of their sample's intensities; a
    sample may hold all rows."""
    bound = quantiles(rows.select("sample_id", "intensity"), ["sample_id"], "intensity", {"bound": q}, "intensities").select("sample_id", "bound")
    return rows.join(bound, "sample_id").where(F.col("intensity") >= F.col("bound")).drop("bound")


def sample_rows(rows: DataFrame) -> DataFrame:
    """Rows per sample before the validity filter."""
    return rows.groupBy("sample_id").agg(F.count("*").alias("n_total_rows"))


def sample_pairs(valid_rows: DataFrame) -> DataFrame:
    return valid_rows.select("sample_id", "peptide").distinct()


def sample_preview(rows: DataFrame, valid_rows: DataFrame) -> DataFrame:
    """Per sample: all rows, valid distinct peptides (merged by no rule), and
    whether it has any."""
    n = valid_rows.groupBy("sample_id").agg(F.count_distinct("raw").alias("n_valid_peptides"))
    out = sample_rows(rows).join(n, "sample_id", "left").fillna(0, ["n_valid_peptides"])
    return out.withColumn("included", F.col("n_valid_peptides") > 0)


def collisions(rows: DataFrame) -> DataFrame:
    """How many distinct peptides merge under the normalisation; one row."""
    return rows.agg(F.count_distinct("raw").alias("n_before"), F.count_distinct("peptide").alias("n_after")).withColumn("n_merged", F.col("n_before") - F.col("n_after"))


def peptide_scores(rows: DataFrame) -> DataFrame:
    """Best score per peptide, scaled to [0, 1] over all peptides; equal
    scores, and peptides without one, get 1."""
    best = rows.groupBy("peptide").agg(F.max("score").alias("best"))
    span = best.agg(F.min("best").alias("low"), F.max("best").alias("high"))
    scaled = (F.col("best") - F.col("low")) / (F.col("high") - F.col("low"))
    # one row of two numbers on the right
    both = best.crossJoin(F.broadcast(span))
    return both.select("peptide", F.when(F.col("best").isNull() | (F.col("high") <= F.col("low")), 1.0).otherwise(scaled).alias("score"))


def peptide_errors(rows: DataFrame) -> DataFrame:
    """Largest error per peptide, kept within [1e-12, 1]."""
    return rows.groupBy("peptide").agg(F.max("error").alias("error")).where("error IS NOT NULL").withColumn("error", F.greatest(F.least("error", F.lit(1.0)), F.lit(1e-12)))


def score_quantiles(scores: DataFrame) -> DataFrame:
    qs = {f"q{int(100 * q):02d}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    return quantiles(scores.select(F.lit(1).alias("_all"), "score"), ["_all"], "score", qs, "scores").select(*qs)


def left_after_filters(rows: DataFrame, params: ScoreParams) -> DataFrame:
    """One row: rows, valid rows, samples with a valid peptide, and whether a
    run over them would have nothing to score."""
    of = valid(rows, params).agg(F.count("*").alias("n_valid"), F.count_distinct("sample_id").alias("n_samples"))
    # one row each
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(of).withColumn("empty", F.col("n_valid") == 0)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} left after filtering")
    return df
