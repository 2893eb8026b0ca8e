"""Tables of the domain derived from the driver's: text read as protein."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.functions import text as T


def letters(text: str):
    """ASCII letters first, upper case after: engines differ on others."""
    return F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", ""))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a driver's table. Cutting text is the dear part, so a table
    with fewer splits than there are cores is dealt over them first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """genome_id, header, sequence: one protein a document; some end in a stop
    mark and some hold one."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    body = letters("text")
    marked = F.when(F.col("doc_id") % 5 == 0, F.concat(body, F.lit("**"))).when(F.col("doc_id") % 7 == 0, F.concat(body, F.lit("*AK"))).otherwise(body)
    return docs.select(F.concat(F.lit("g"), F.pmod("doc_id", F.lit(50)).cast("string")).alias("genome_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("header"), marked.alias("sequence"))


def panel(spark: SparkSession, sf_dir: str, policy: str = "il-equivalent") -> DataFrame:
    """genome_id, peptide: distinct fragments of 7 to 30 letters a document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("string").alias("genome_id"), F.explode(T.fragments(letters("text"))).alias("f"))
    return rows.where(F.length("f").between(7, 30)).select("genome_id", T.peptide(F.col("f"), policy).alias("peptide")).distinct()


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed table under the names a search tool would write."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", F.explode(T.fragments(letters("text"))).alias("f"))
    n = F.length("f")
    return rows.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".raw")).alias("Run"),
        F.col("f").alias("Stripped.Sequence"),
        (n * (F.col("turn") + 1)).cast("double").alias("Precursor.Quantity"),
        ((n % 8) / 8.0).alias("Evidence"),
        (((F.col("conv_id") * 7 + F.col("turn") * 13) % 100) / 1000.0).alias("Q.Value"),
        F.when(F.col("role") == "system", "true").otherwise("false").alias("Decoy"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    return turns.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".raw")).alias("sample_id"),
        F.concat(F.lit("u"), (F.col("conv_id") % 4).cast("string")).alias("analysis_unit_id"),
        F.when(F.col("conv_id") % 17 == 0, "no").otherwise("yes").alias("included"),
        F.concat(F.lit("site"), (F.col("conv_id") % 3).cast("string")).alias("site"),
    )


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("genome_id"), F.concat("lang", F.lit("/"), "source").alias("Lineage"))
