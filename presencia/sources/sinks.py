"""Sinks: result tables, column extracts, manifests, reusable intermediates."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_UNITS = "map<string,struct<sample_ids:array<string>,n_samples:bigint,genome_ids_q005:array<string>,genome_ids_q001:array<string>>>"


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder a table below ``path``; ``fmt`` parquet or tsv. Array, map
    and struct columns become JSON in tsv."""
    for name, df in tables.items():
        if fmt == "parquet":
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])
            flat.write.mode("overwrite").csv(f"{path}/{name}", sep="\t", header=True)


def extract_columns(spark: SparkSession, source: str, target: str, columns: list[str], names: list[str] | None = None, overwrite: bool = False) -> None:
    """Columns of a Parquet table, renamed pairwise, as tab-separated text."""
    names = names or columns
    if len(names) != len(columns):
        raise ValueError("as many names as columns are needed")
    table = spark.read.parquet(source)
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise ValueError(f"no column {missing} among {table.columns}")
    out = table.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])
    out.write.mode("overwrite" if overwrite else "error").csv(target, sep="\t", header=True)


def selection(mapping: DataFrame, scored: DataFrame) -> DataFrame:
    """unit, sample_ids, n_samples, genome_ids_q005, genome_ids_q001 of every
    unit with an included sample."""
    samples = mapping.where("included").groupBy("analysis_unit_id").agg(F.sort_array(F.collect_set("sample_id")).alias("sample_ids"))

    def called(flag):
        return F.sort_array(F.collect_set(F.when(F.col(flag), F.col("genome_id"))))

    calls = scored.groupBy("analysis_unit_id").agg(called("pass_q_0_05").alias("genome_ids_q005"), called("pass_q_0_01").alias("genome_ids_q001"))
    none = F.expr("cast(array() as array<string>)")
    return samples.join(calls, "analysis_unit_id", "left").select(
        "analysis_unit_id", "sample_ids", F.size("sample_ids").cast("long").alias("n_samples"),
        F.coalesce("genome_ids_q005", none).alias("genome_ids_q005"), F.coalesce("genome_ids_q001", none).alias("genome_ids_q001"),
    )


def manifest(selected: DataFrame, created: str, inputs: dict | None = None, artifacts: dict | None = None, warnings: list | None = None) -> DataFrame:
    """One row, ``value``: the manifest as JSON. Its units are a map, so the
    document is as large as the calls it lists."""
    entry = F.struct("sample_ids", "n_samples", "genome_ids_q005", "genome_ids_q001")
    units = selected.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("analysis_unit_id").alias("key"), entry.alias("value"))))).alias("units"))
    fixed = {"schema_version": 1, "created_utc": created, "thresholds": {"q005": 0.05, "q001": 0.01}, "inputs": inputs or {}, "artifacts": artifacts or {}, "warnings": warnings or []}
    body = F.to_json(F.struct(F.size("units").alias("n_units"), "units"))
    head = json.dumps(fixed)[:-1]
    return units.select(F.concat(F.lit(head + ","), F.substring(body, 2, 1 << 30)).alias("value"))


def write_manifest(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The units of a written manifest as a table, checked."""
    raw = spark.read.text(path, wholetext=True)
    units = F.from_json("value", f"struct<n_units:bigint,units:{MANIFEST_UNITS}>").alias("m")
    rows = raw.select(units).select("m.n_units", F.explode("m.units").alias("analysis_unit_id", "u"))
    table = rows.select("analysis_unit_id", "u.*", "n_units")
    check_selection(table)
    return table.drop("n_units")


def selection_violations(table: DataFrame) -> DataFrame:
    """One row: how many rows of a selection table break each rule."""
    n = F.count("*").over(Window.partitionBy())
    rows = table.withColumn("_n", n) if "n_units" in table.columns else table
    checks = {
        "empty_samples": F.size("sample_ids") <= 0,
        "wrong_n_samples": F.col("n_samples") != F.size("sample_ids"),
        "repeated_samples": F.size(F.array_distinct("sample_ids")) != F.size("sample_ids"),
        "repeated_genomes": F.size(F.array_distinct("genome_ids_q005")) != F.size("genome_ids_q005"),
        "q001_not_in_q005": F.size(F.array_except("genome_ids_q001", "genome_ids_q005")) > 0,
    }
    if "n_units" in table.columns:
        checks["wrong_n_units"] = F.col("n_units") != F.col("_n")
    out = rows.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    shared = table.select("analysis_unit_id", F.explode("sample_ids").alias("s")).distinct().groupBy("s").count().where("count > 1")
    return out.crossJoin(shared.agg(F.count("*").alias("samples_in_units")))  # one row each


def check_selection(table: DataFrame) -> DataFrame:
    bad = {k: v for k, v in selection_violations(table).first().asDict().items() if v}
    if bad:
        raise ValueError(f"selection table breaks rules: {bad}")
    return table


def content_hash(df: DataFrame, *columns: str) -> str:
    """Order-independent hash of the rows: count, sum and xor of row hashes."""
    h = F.xxhash64(*columns)
    n, total, x = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.expr(f"bit_xor(xxhash64({','.join('`' + c + '`' for c in columns)}))")).first()
    return f"{n}-{total or 0}-{x or 0}"


def materialise(make, spark: SparkSession, path: str, provenance: dict) -> tuple[DataFrame, bool]:
    """(table, reused): the Parquet table below ``path`` if it was made under
    the same provenance, else ``make()`` written there. The provenance is
    written after the table, so a broken run is not reused."""
    want = json.dumps(provenance, sort_keys=True)
    try:
        if spark.read.text(f"{path}/provenance", wholetext=True).first()[0].strip() == want:
            return spark.read.parquet(f"{path}/table"), True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([("",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")
    make().write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")
    return spark.read.parquet(f"{path}/table"), False
