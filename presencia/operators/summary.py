"""Summaries of scored units: cohort, calls, matrices, coverage, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.operators.ranking import quantiles, running_sum


def with_lineage(rows: DataFrame, lineage: DataFrame) -> DataFrame:
    """Lineage by genome; one that is there and filled wins."""
    there = F.col("Lineage") if "Lineage" in rows.columns else F.lit(None).cast("string")
    out = rows.withColumn("_own", F.when(there != "", there)).drop("Lineage")
    return out.join(lineage, "genome_id", "left").withColumn("Lineage", F.coalesce("_own", "Lineage")).drop("_own")


def cohort_summary(scored: DataFrame) -> DataFrame:
    """One row a genome over all units."""
    excess = F.coalesce(F.col("excess_count"), F.lit(0.0)) if "excess_count" in scored.columns else F.lit(0.0)
    q, n = F.col("qvalue"), F.count("*")
    out = scored.groupBy("genome_id").agg(
        n.alias("n_units_tested"),
        F.count_if(F.col("n_matched") >= 1).alias("n_units_matched_ge_1"),
        F.count_if(F.col("n_unique") > 0).alias("n_units_with_unique_evidence"),
        F.count_if(q <= 0.05).alias("n_units_q_le_0_05"),
        F.count_if(q <= 0.01).alias("n_units_q_le_0_01"),
        F.min(q).alias("best_qvalue"),
        F.min("presence_rank").alias("best_presence_rank"),
        F.sum("n_unique").alias("total_unique_peptides"),
        F.max("n_unique").alias("max_unique_peptides"),
        F.sum("n_matched").alias("total_matched_peptides"),
        F.max("n_matched").alias("max_matched_peptides"),
        F.max(excess).alias("max_excess"),
        F.sum(excess).alias("total_excess"),
        F.count_if(excess >= 3).alias("n_units_excess_ge_3"),
        (F.count_if(q <= 0.05) / n).alias("fraction_units_q_le_0_05"),
        (F.count_if(q <= 0.01) / n).alias("fraction_units_q_le_0_01"),
    )
    for value, name in (("qvalue", "median_qvalue"), ("presence_rank", "median_presence_rank")):
        out = out.join(quantiles(scored, ["genome_id"], value, {name: 0.5}, "medians").select("genome_id", F.col(name).cast("double").alias(name)), "genome_id", "left")
    return out


def ordered_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("n_units_q_le_0_05"), F.asc("best_qvalue"), F.desc("total_unique_peptides"), F.asc("genome_id"))


def call_counts(scored: DataFrame, samples: DataFrame) -> DataFrame:
    """One row a unit: its samples, calls, matched and well supported genomes."""
    out = scored.groupBy("analysis_unit_id").agg(
        F.count_if("pass_q_0_01").alias("n_genomes_q_le_0_01"),
        F.count_if("pass_q_0_05").alias("n_genomes_q_le_0_05"),
        F.count_if(F.col("n_matched") >= 1).alias("n_genomes_matched_ge_1"),
        F.count_if(F.col("n_unique") >= 3).alias("n_genomes_unique_ge_3"),
        F.min("qvalue").alias("best_qvalue"),
    )
    out = out.join(quantiles(scored, ["analysis_unit_id"], "qvalue", {"median_qvalue": 0.5}, "medians").drop("n"), "analysis_unit_id", "left")
    return out.join(samples, "analysis_unit_id", "left").fillna(0, ["n_samples_in_unit"])


def threshold_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("analysis_unit_id").agg(F.count_if("pass_q_0_01").alias("q001_genomes"), F.count_if("pass_q_0_05").alias("q005_genomes"))


def presence_long(scored: DataFrame) -> DataFrame:
    """The matrices' cells, the form that suits many units."""
    return scored.select("genome_id", "analysis_unit_id", F.col("pass_q_0_01").cast("int").alias("q001"), F.col("pass_q_0_05").cast("int").alias("q005"), "qvalue")


def presence_matrix(scored: DataFrame, value: str, most_units: int = 5_000) -> DataFrame:
    """Genome by unit: ``q001`` or ``q005`` flags of genomes called anywhere,
    or ``qvalue`` of all. Columns are the sorted unit ids; more than
    ``most_units`` do not make a table, and ``presence_long`` has their cells."""
    long = presence_long(scored)
    units = sorted(r[0] for r in long.select("analysis_unit_id").distinct().limit(most_units + 1).collect())
    if len(units) > most_units:
        raise ValueError(f"more than {most_units} units are too many columns; use presence_long")
    if value == "qvalue":
        return long.groupBy("genome_id").pivot("analysis_unit_id", units).agg(F.max("qvalue"))
    called = long.groupBy("genome_id").agg(F.max(value).alias("any")).where("any = 1").select("genome_id")
    wide = long.join(called, "genome_id", "left_semi").groupBy("genome_id").pivot("analysis_unit_id", units).agg(F.max(value))
    return wide.fillna(0)


def coverage(scored: DataFrame, unit_matches: DataFrame) -> DataFrame:
    """Per unit and rank: peptides first covered there, covered so far, and the
    share of the unit's matchable ones. A peptide counts at the best rank of
    the genomes that hold it."""
    ranks = scored.select("analysis_unit_id", "genome_id", "presence_rank")
    best = unit_matches.select("analysis_unit_id", "genome_id", "peptide").join(ranks, ["analysis_unit_id", "genome_id"])
    best = best.groupBy("analysis_unit_id", "peptide").agg(F.min("presence_rank").alias("presence_rank"))
    new = best.groupBy("analysis_unit_id", "presence_rank").agg(F.count("*").alias("n_new"))
    rows = ranks.join(new, ["analysis_unit_id", "presence_rank"], "left").fillna(0, ["n_new"])
    rows = running_sum(rows, "analysis_unit_id", "presence_rank", "n_new", "n_covered").withColumnRenamed("n_covered_total", "n_matchable")
    return rows.withColumn("covered_pct", F.when(F.col("n_matchable") > 0, 100.0 * F.col("n_covered") / F.col("n_matchable")).otherwise(0.0))


def significant(scored: DataFrame, flag: str = "pass_q_0_05") -> DataFrame:
    """Called rows with all their columns, by unit, rank and q."""
    return scored.where(flag).orderBy("analysis_unit_id", "presence_rank", "qvalue", "genome_id")


def compact_list(scored: DataFrame, flag: str = "pass_q_0_05", lineage: DataFrame | None = None) -> DataFrame:
    """Called rows as unit, genome, Lineage, rank and q, in the same order. The
    lineage is that of the rows, or joined before they are put in order."""
    rows = scored.where(flag)
    if lineage is not None:
        rows = with_lineage(rows, lineage)
    elif "Lineage" not in rows.columns:
        rows = rows.withColumn("Lineage", F.lit(None).cast("string"))
    return rows.select("analysis_unit_id", "genome_id", "Lineage", "presence_rank", "qvalue").orderBy("analysis_unit_id", "presence_rank", "qvalue", "genome_id")


def union_of_calls(cohort: DataFrame, level: str) -> DataFrame:
    """Rows of the cohort summary of genomes called in some unit at a level,
    ``0_01`` or ``0_05``: most units first, then the best q."""
    n = f"n_units_q_le_{level}"
    return cohort.where(F.col(n) >= 1).orderBy(F.desc(n), F.asc("best_qvalue"), F.desc("total_unique_peptides"), F.asc("genome_id"))


def require_nested(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """``narrow``, unless it has a genome that ``wide`` lacks."""
    lacking = [r[0] for r in narrow.select("genome_id").join(wide.select("genome_id"), "genome_id", "left_anti").limit(5).collect()]
    if lacking:
        raise RuntimeError(f"genomes called at the lower level only: {lacking}")
    return narrow


def called_anywhere(scored: DataFrame, q: float | None = None) -> DataFrame:
    """Genomes called in any unit, at 0.05 unless ``q`` is given, with how
    often and how well."""
    called = F.col("pass_q_0_05") if q is None else (F.col("qvalue") <= q) & (F.col("n_matched") >= 1)
    out = scored.groupBy("genome_id").agg(
        F.count_if(called).alias("n_called"), F.count_if("pass_q_0_01").alias("n_q001"), F.min("qvalue").alias("best_qvalue"), F.sum("n_unique").alias("total_unique")
    )
    return out.where("n_called > 0")


RESULT_RULES = {
    "negative_counts": "n_matched < 0 OR n_unique < 0 OR n_shared < 0",
    "unique_above_matched": "n_unique > n_matched",
    "q001_not_in_q005": "pass_q_0_01 AND NOT pass_q_0_05",
    "q_outside": "qvalue < 0 OR qvalue > 1",
}


def violations(scored: DataFrame) -> DataFrame:
    """One row: how many result rows break each rule."""
    missing = {"n_matched", "n_unique", "n_shared", "pass_q_0_01", "pass_q_0_05", "qvalue"} - set(scored.columns)
    if missing:
        raise ValueError(f"results lack {sorted(missing)}")
    return scored.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in RESULT_RULES.items()])
