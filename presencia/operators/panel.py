"""The panel: what each genome could produce, and what of it is observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.operators.ranking import quantiles


def select_genomes(panel: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Keep the genomes of one id table and drop those of another."""
    out = panel
    if include is not None:
        out = out.join(include.select(F.col("genome_id").cast("string").alias("genome_id")).distinct(), "genome_id", "left_semi")
    if exclude is not None:
        out = out.join(exclude.select(F.col("genome_id").cast("string").alias("genome_id")).distinct(), "genome_id", "left_anti")
    if out.isEmpty():
        raise ValueError("no genome is left after the selection")
    return out


def unknown_genomes(panel: DataFrame, asked: DataFrame) -> DataFrame:
    """Ids asked for that the panel lacks."""
    return asked.select(F.col("genome_id").cast("string").alias("genome_id")).distinct().join(panel.select("genome_id").distinct(), "genome_id", "left_anti")


def sample_genomes(panel: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A trial run's genomes: the n smallest by the MD5 of seed and id."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("genome_id")).cast("binary"))
    ids = panel.select("genome_id").distinct().orderBy(mixed, "genome_id").limit(n)
    return panel.join(ids, "genome_id", "left_semi")


def opportunity(panel: DataFrame) -> DataFrame:
    """genome_id, total_peptide_count, opportunity (peptides of no other genome).

    Two aggregations over the distinct panel; owners are counted per peptide
    before anything meets per genome.
    """
    own = panel.groupBy("peptide").agg(F.count("*").alias("n"), F.min("genome_id").alias("genome_id")).where("n = 1")
    unique = own.groupBy("genome_id").agg(F.count("*").alias("opportunity"))
    total = panel.groupBy("genome_id").agg(F.count("*").alias("total_peptide_count"))
    return total.join(unique, "genome_id", "left").fillna(0, ["opportunity"])


def universe(panel: DataFrame) -> DataFrame:
    """One row: distinct peptides, pairs, and peptides of exactly one genome."""
    n = panel.groupBy("peptide").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_peptides"), F.sum("n").alias("n_pairs"), F.count_if(F.col("n") == 1).alias("n_unique"))


def match(panel: DataFrame, peptides: DataFrame) -> DataFrame:
    """genome_id, peptide of the panel among the observed ``peptides``
    (distinct). Spark picks a broadcast by size, else a shuffle."""
    return panel.join(peptides.select("peptide").distinct(), "peptide").select("genome_id", "peptide")


def degeneracy(matches: DataFrame) -> DataFrame:
    """peptide, d (genomes that hold it), owner (where d is one)."""
    out = matches.groupBy("peptide").agg(F.count("*").alias("d"), F.min("genome_id").alias("owner"))
    return out.withColumn("owner", F.when(F.col("d") == 1, F.col("owner")))


def opportunity_quantiles(genomes: DataFrame) -> DataFrame:
    qs = {f"q{int(100 * q):03d}": q for q in (0.0, 0.25, 0.5, 0.75, 1.0)}
    found = quantiles(genomes.select(F.lit(1).alias("_all"), "opportunity"), ["_all"], "opportunity", qs, "opportunities")
    return found.select(*[F.col(c).cast("double").alias(c) for c in qs])
