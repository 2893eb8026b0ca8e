"""Samples, analysis units, and the tables that assign them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.functions import text as T

ALL = "all-samples"


def _examples(df: DataFrame, col: str) -> list:
    return [r[0] for r in df.select(col).distinct().orderBy(col).limit(10).collect()]


# What metadata must not have, by the column of ``metadata_violations``.
METADATA_RULES = {
    "blank_sample": "metadata has blank sample ids",
    "repeated": "samples more than once in metadata",
    "no_unit": "included samples without a unit",
}


def metadata_violations(metadata: DataFrame) -> DataFrame:
    """sample_id and the rules it breaks, of samples that break any."""
    flag = T.is_included(F.col("included").cast("string")) if "included" in metadata.columns else F.lit(True)
    no_unit = flag & (F.coalesce("analysis_unit_id", F.lit("")) == "")
    samples = metadata.groupBy("sample_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(no_unit), F.lit(False)).alias("no_unit"))
    out = samples.select("sample_id", (F.coalesce("sample_id", F.lit("")) == "").alias("blank_sample"), (F.col("n") > 1).alias("repeated"), "no_unit")
    return out.where("blank_sample OR repeated OR no_unit")


def check_metadata(metadata: DataFrame) -> DataFrame:
    """Raise for blank or repeated samples, and blank units of included ones.
    One pass tells whether there are any; examples are fetched only then."""
    found = metadata_violations(metadata)
    broken = found.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in METADATA_RULES]).first()
    for rule, message in METADATA_RULES.items():
        if broken[rule]:
            raise ValueError(f"{message}: {_examples(found.where(rule), 'sample_id')}")
    return metadata


def assign_units(samples: DataFrame, mode: str, metadata: DataFrame | None = None) -> DataFrame:
    """sample_id, analysis_unit_id, included and the metadata's other columns.

    ``samples``: distinct sample_id. Metadata of samples that were not observed
    is left out; a sample that metadata lacks is an error.
    """
    if mode == "all-samples":
        return samples.select("sample_id", F.lit(ALL).alias("analysis_unit_id"), F.lit(True).alias("included"))
    if mode == "per-sample":
        return samples.select("sample_id", F.col("sample_id").alias("analysis_unit_id"), F.lit(True).alias("included"))
    if metadata is None:
        raise ValueError("unit mode metadata needs a metadata table")
    if found := _examples(samples.join(metadata, "sample_id", "left_anti"), "sample_id"):
        raise ValueError(f"samples without metadata: {found}")
    flag = T.is_included(F.col("included").cast("string")) if "included" in metadata.columns else F.lit(True)
    return samples.join(metadata.withColumn("included", flag), "sample_id", "left")


def sample_mapping(assigned: DataFrame, rows_per_sample: DataFrame, pairs: DataFrame) -> DataFrame:
    """The mapping with n_valid_peptides and n_total_rows; extra columns last."""
    n = pairs.groupBy("sample_id").agg(F.count("*").alias("n_valid_peptides"))
    fixed = ["sample_id", "analysis_unit_id", "included", "n_valid_peptides", "n_total_rows"]
    extra = [c for c in assigned.columns if c not in fixed]
    out = assigned.join(n, "sample_id", "left").join(rows_per_sample, "sample_id", "left")
    return out.fillna(0, ["n_valid_peptides", "n_total_rows"]).select(*fixed, *[F.col(f"`{c}`") for c in extra])


def unit_peptides(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """analysis_unit_id, peptide: the union over the included samples."""
    keep = mapping.where("included").select("sample_id", "analysis_unit_id")
    return pairs.join(keep, "sample_id").select("analysis_unit_id", "peptide").distinct()


def unit_samples(mapping: DataFrame) -> DataFrame:
    return mapping.where("included").groupBy("analysis_unit_id").agg(F.count("*").alias("n_samples_in_unit"))


def set_included(mapping: DataFrame, column: str, value: str, mode: str) -> DataFrame:
    """Edit inclusion by a group: ``include`` or ``exclude`` its samples, or
    include ``only`` them."""
    member = F.coalesce(F.col(f"`{column}`").cast("string") == value, F.lit(False))
    new = {"include": F.col("included") | member, "exclude": F.col("included") & ~member, "only": member}
    if mode not in new:
        raise ValueError("mode must be include, exclude or only")
    return mapping.withColumn("included", new[mode])


def override_units(mapping: DataFrame, table: DataFrame) -> DataFrame:
    """Units from a lenient table (sample_id, analysis_unit_id): blank rows are
    dropped, one per sample counts (the least unit), samples it lacks keep
    theirs, and a blank unit falls back to the sample."""
    rows = table.select(T.sample_id(F.col("sample_id").cast("string")).alias("sample_id"), T.strip_all(F.col("analysis_unit_id").cast("string")).alias("unit"))
    rows = rows.where("sample_id <> '' AND unit <> ''").groupBy("sample_id").agg(F.min("unit").alias("unit"))
    unit = F.coalesce("unit", F.when(F.col("analysis_unit_id") != "", F.col("analysis_unit_id")), "sample_id")
    return mapping.join(rows, "sample_id", "left").withColumn("analysis_unit_id", unit).select(*mapping.columns)


def sample_differences(samples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Samples on one side only: missing from metadata, or extra there."""
    missing = samples.join(metadata, "sample_id", "left_anti").select("sample_id", F.lit("missing").alias("side"))
    extra = metadata.join(samples, "sample_id", "left_anti").select("sample_id", F.lit("extra").alias("side"))
    return missing.union(extra)
