"""Diagnostic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Labels of the degeneracy bins, edges of the p histogram,
# thresholds of the calling curve.
DEGENERACY_LABELS = ("1", "2-5", "6-20", "21-100", "101-500", ">500")
P_EDGES = (0.0, 1e-6, 1e-4, 1e-3, 1e-2, 5e-2, 0.1, 0.2, 0.5, 1.0)
Q_THRESHOLDS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)


def degeneracy_histogram(degeneracy: DataFrame, edges: tuple[int, ...] = (1, 5, 20, 100, 500)) -> DataFrame:
    """label, n, fraction for every label, empty ones too."""
    spark = degeneracy.sparkSession
    labels = spark.createDataFrame(list(enumerate(DEGENERACY_LABELS)), "bin int, label string")
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("d")))
    n = degeneracy.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    out = labels.join(n, "bin", "left").fillna(0, ["n"])  # six rows from here
    return out.withColumn("fraction", F.when(total > 0, F.col("n") / total).otherwise(0.0)).select("label", "n", "fraction")


def shared_p_histogram(scored: DataFrame) -> DataFrame:
    """pool, bin, above, upto, n, fraction of pvalue_shared: of all genomes with
    a match, and of those without unique peptides. Bins are right-closed, the
    first one closed on both sides; a pool that has any row has all bins."""
    at = F.greatest(F.size(F.filter(F.array(*[F.lit(e) for e in P_EDGES]), lambda e: e < F.col("pvalue_shared"))) - 1, F.lit(0))
    pools = F.when(F.col("n_unique") == 0, F.array(F.lit("all"), F.lit("unique_0"))).otherwise(F.array(F.lit("all")))
    rows = scored.where((F.col("n_matched") >= 1) & F.col("pvalue_shared").isNotNull()).withColumn("pool", F.explode(pools))
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("above"), F.lit(b).alias("upto")) for i, (a, b) in enumerate(zip(P_EDGES, P_EDGES[1:]))])
    n = rows.groupBy("pool", at.alias("at")).agg(F.count("*").alias("k"))
    found = n.groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct("at", "k"))).alias("ks"), F.sum("k").alias("total"))
    out = found.select("pool", "ks", "total", F.explode(bins).alias("b")).select("pool", "b.*", F.coalesce(F.col("ks")[F.col("b.bin")], F.lit(0)).alias("n"), "total")
    return out.withColumn("fraction", F.col("n") / F.col("total")).drop("total")


def calling_curve(scored: DataFrame) -> DataFrame:
    """threshold, n_calls: genomes with a match at or below each of ten q
    thresholds."""
    counts = scored.where("n_matched >= 1").agg(*[F.count_if(F.col("qvalue") <= t).alias(str(i)) for i, t in enumerate(Q_THRESHOLDS)])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`{i}`").alias("n_calls")) for i, t in enumerate(Q_THRESHOLDS)])
    return counts.select(F.explode(pairs).alias("x")).select("x.*")


def contributions(scored: DataFrame, unit_matches: DataFrame, top: int = 20) -> DataFrame:
    """What each peptide adds to the ``top`` best-ranked genomes of a unit."""
    best = scored.where((F.col("presence_rank") <= top) & (F.col("n_matched") >= 1)).select("analysis_unit_id", "genome_id", "presence_rank")
    return unit_matches.join(best, ["analysis_unit_id", "genome_id"]).select(
        "analysis_unit_id", "genome_id", "presence_rank", "peptide", "d", F.col("stratum.deg_bin").alias("deg_bin"), "score", "weight", "contribution", (F.col("d") == 1).alias("is_unique")
    )


def run_document(scored: DataFrame, params, counts: dict | None = None, seconds: dict | None = None) -> DataFrame:
    """One row, ``value``: the run as JSON, its parameters, what was counted
    on the way, seconds by step and the summary's counts."""
    import json
    import platform
    import sys
    from dataclasses import asdict

    fixed = {"parameters": asdict(params), "counts": counts or {}, "seconds": seconds or {}, "python": sys.version, "platform": platform.platform()}
    summary = run_summary(scored)
    body = F.to_json(F.struct(*summary.columns))
    return summary.select(F.concat(F.lit(json.dumps(fixed)[:-1] + ', "results": '), body, F.lit("}")).alias("value"))


def run_summary(scored: DataFrame) -> DataFrame:
    """One row: units, genomes, tests, calls and genomes called anywhere."""
    return scored.agg(
        F.count_distinct("analysis_unit_id").alias("n_units"), F.count_distinct("genome_id").alias("n_genomes"), F.count("*").alias("n_tests"),
        F.count_if(F.col("n_matched") >= 1).alias("n_matched_tests"), F.count_if("pass_q_0_01").alias("n_calls_q001"), F.count_if("pass_q_0_05").alias("n_calls_q005"),
        F.count_distinct(F.when(F.col("pass_q_0_01"), F.col("genome_id"))).alias("n_union_q001"), F.count_distinct(F.when(F.col("pass_q_0_05"), F.col("genome_id"))).alias("n_union_q005"),
    )
