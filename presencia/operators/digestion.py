"""Proteins into peptides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presencia.functions import text as T


def digest(proteins: DataFrame, missed: int = 0, least: int = 7, most: int = 30, rule: str = T.TRYPTIC) -> DataFrame:
    """genome_id, protein, peptide of the given lengths; repeats are kept.

    ``proteins``: genome_id, header, sequence. Marks at a sequence's end go,
    marks inside it stay, and sequences left empty give nothing.
    """
    if least > most:
        raise ValueError("the least length is above the most")
    clean = T.sanitised_protein(F.col("sequence"))
    rows = proteins.select("genome_id", F.col("header").alias("protein"), F.explode(T.fragments(clean, rule, missed)).alias("peptide"))
    return rows.where(F.length("peptide").between(least, most))


def digest_qc(proteins: DataFrame, missed: int = 0, least: int = 7, most: int = 30, rule: str = T.TRYPTIC, examples: int = 5) -> DataFrame:
    """Per genome: records, stop marks at the end and inside, emptied records,
    fragments before and after the length filter, their share, and up to five
    headers with a mark inside, the first by name."""
    clean = T.sanitised_protein(F.col("sequence"))
    bare = F.regexp_replace("sequence", r"\s+", "")
    rows = proteins.select("genome_id", "header", bare.alias("bare"), clean.alias("clean"), T.fragments(clean, rule, missed).alias("parts"))
    ended, inner = F.col("bare").endswith("*"), F.col("clean").contains("*")
    fits = F.size(F.filter("parts", lambda x: F.length(x).between(least, most)))
    out = rows.groupBy("genome_id").agg(
        F.count("*").alias("n_records"),
        F.count_if(ended).alias("n_terminal_stop_records"),
        F.sum(F.length("bare") - F.length("clean")).cast("long").alias("n_terminal_stop_marks"),
        F.count_if(inner).alias("n_inner_stop_records"),
        F.count_if(F.col("clean") == "").alias("n_emptied_records"),
        F.sum(F.size("parts")).cast("long").alias("n_fragments"),
        F.sum(fits).cast("long").alias("n_kept"),
    )
    first = Window.partitionBy("genome_id").orderBy("header")
    shown = rows.where(inner).select("genome_id", "header").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= examples)
    shown = shown.groupBy("genome_id").agg(F.sort_array(F.collect_list("header")).alias("inner_stop_examples"))
    none = F.expr("cast(array() as array<string>)")
    out = out.join(shown, "genome_id", "left").withColumn("inner_stop_examples", F.coalesce("inner_stop_examples", none))
    return out.withColumn("retention_pct", F.when(F.col("n_fragments") > 0, 100.0 * F.col("n_kept") / F.col("n_fragments")).otherwise(0.0))


def write_digest(rows: DataFrame, path: str, skip_existing: bool = True) -> None:
    """Protein, Peptide below ``path``, a folder a genome; genomes that are
    there already are left as they are."""
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    out = rows.select("genome_id", F.col("protein").alias("Protein"), F.col("peptide").alias("Peptide"))
    if skip_existing:
        try:
            # with a schema, so that the folder 001 is not read as the number 1
            there = spark.read.schema("Protein string, Peptide string, genome_id string").csv(path, sep="\t", header=True).select("genome_id").distinct()
            out = out.join(there, "genome_id", "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    out.write.mode("append").partitionBy("genome_id").csv(path, sep="\t", header=True)
