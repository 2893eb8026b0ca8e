"""Selection of samples and genomes by unit, as a document of many lines.

A selection is a table of members (unit, kind, id), kind ``sample``, ``q005`` or
``q001``, so a unit may have any number of them. Its document has a head line,
a line a unit with its counts, and lines of about ``CHUNK`` ids of one unit and
kind, dealt by a hash of the id; it is written and read in parallel, and what
is read must have the counts that the head and the units declare.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = "analysis_unit_id"
KINDS = ("sample", "q005", "q001")
CHUNK = 1_000
LINE = "line string, analysis_unit_id string, kind string, ids array<string>, n_samples bigint, n_q005 bigint, n_q001 bigint, n_units bigint, schema_version int"


def members(mapping: DataFrame, scored: DataFrame) -> DataFrame:
    """unit, kind, id of the units with an included sample."""
    samples = mapping.where("included").select(UNIT, F.lit("sample").alias("kind"), F.col("sample_id").alias("id")).distinct()
    flags = F.array_compact(F.array(F.when(F.col("pass_q_0_05"), "q005"), F.when(F.col("pass_q_0_01"), "q001")))
    calls = scored.where("pass_q_0_05 OR pass_q_0_01").select(UNIT, F.explode(flags).alias("kind"), F.col("genome_id").alias("id"))
    return samples.union(calls.join(samples.select(UNIT).distinct(), UNIT, "left_semi"))


def declared(rows: DataFrame) -> DataFrame:
    """unit, n_samples, n_q005, n_q001."""
    count = {"n_samples": "sample", "n_q005": "q005", "n_q001": "q001"}
    return rows.groupBy(UNIT).agg(*[F.count_if(F.col("kind") == kind).alias(name) for name, kind in count.items()])


def lines(rows: DataFrame, created: str, inputs: dict | None = None, artifacts: dict | None = None, warnings: list | None = None) -> DataFrame:
    """``value``: the document's lines. ``rows``: members, read more than once."""
    units = declared(rows)
    fixed = {"line": "head", "schema_version": 2, "created_utc": created, "thresholds": {"q005": 0.05, "q001": 0.01}, "inputs": inputs or {}, "artifacts": artifacts or {}, "warnings": warnings or []}
    body = json.dumps(fixed)[:-1]
    head = units.agg(F.count("*").alias("n")).select(F.concat(F.lit(body + ', "n_units": '), F.col("n").cast("string"), F.lit("}")).alias("value"))
    of_units = units.select(F.to_json(F.struct(F.lit("unit").alias("line"), "*")).alias("value"))
    sizes = rows.groupBy(UNIT, "kind").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("_chunks"))
    dealt = rows.join(sizes, [UNIT, "kind"]).withColumn("_chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")))
    # about CHUNK ids, however many a unit has
    chunks = dealt.groupBy(UNIT, "kind", "_chunk").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return head.union(of_units).union(chunks.select(F.to_json(F.struct(F.lit("ids").alias("line"), UNIT, "kind", "ids")).alias("value")))


def write(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, units as declared) of a written document, checked."""
    found = spark.read.text(path).select(F.from_json("value", LINE).alias("l")).select("l.*")
    heads = found.where("line = 'head'").select("n_units", "schema_version").take(2)
    if len(heads) != 1 or heads[0].schema_version != 2:
        raise ValueError(f"a manifest has one head line of schema version 2, not {heads}")
    units = found.where("line = 'unit'").select(UNIT, "n_samples", "n_q005", "n_q001")
    rows = found.where("line = 'ids'").select(UNIT, "kind", F.explode("ids").alias("id"))
    check(rows, units, heads[0].n_units)
    return rows, units


def violations(rows: DataFrame, units: DataFrame, n_units: int | None = None) -> DataFrame:
    """One row: how many units break each rule, and samples in several units.
    Everything is counted by unit or by member; no unit's ids are gathered."""
    by_id = rows.groupBy(UNIT, "id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    per_unit = by_id.groupBy(UNIT).agg(
        *[F.sum(k).alias(f"has_{k}") for k in KINDS],
        F.max(F.col("sample") > 1).alias("twice_sample"), F.max(F.col("q005") > 1).alias("twice_genome"),
        F.max((F.col("q001") > 0) & (F.col("q005") == 0)).alias("outside"),
    )
    both = units.join(per_unit, UNIT, "full").fillna(0, [f"has_{k}" for k in KINDS])
    n = {k: F.coalesce(f"n_{'samples' if k == 'sample' else k}", F.lit(-1)) for k in KINDS}
    checks = {
        "empty_samples": F.col("has_sample") == 0,
        "wrong_n_samples": n["sample"] != F.col("has_sample"),
        "wrong_n_genomes": (n["q005"] != F.col("has_q005")) | (n["q001"] != F.col("has_q001")),
        "repeated_samples": F.coalesce("twice_sample", F.lit(False)),
        "repeated_genomes": F.coalesce("twice_genome", F.lit(False)),
        "q001_not_in_q005": F.coalesce("outside", F.lit(False)),
    }
    out = both.agg(*[F.count_if(c).alias(k) for k, c in checks.items()], F.count("*").alias("_units"))
    out = out.withColumn("wrong_n_units", (F.col("_units") != F.lit(n_units)).cast("long") if n_units is not None else F.lit(0).cast("long")).drop("_units")
    shared = rows.where("kind = 'sample'").select(UNIT, "id").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return out.crossJoin(shared.agg(F.count("*").alias("samples_in_units")))  # one row each


def check(rows: DataFrame, units: DataFrame, n_units: int | None = None) -> DataFrame:
    bad = {k: v for k, v in violations(rows, units, n_units).first().asDict().items() if v}
    if bad:
        raise ValueError(f"selection breaks rules: {bad}")
    return rows
