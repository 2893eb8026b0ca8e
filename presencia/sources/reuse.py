"""Matched peptides that outlive a run, kept genome by genome.

A store is a folder. What the matches depend on beside the genomes (schema
version, peptide policy, observed peptides, digestion parameters) names a part
of it. In a part, each run that meets new or changed genomes adds a batch: their
matches, then a ledger of their content marks. A genome whose mark is in a
finished ledger is not matched again, wherever and in which order its rows lie;
genomes that left the panel are passed over. A run that breaks leaves no ledger,
so nothing of it is taken.

Defined cases: an empty panel has no matches and adds nothing; a genome without
a match is in the ledger alone; repeated (genome, peptide) rows are an error of
the caller, who gives distinct ones.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.operators import panel as P
from presencia.sources import sinks
from presencia.tables import written

#: Raised when the stored tables or the rules that make them change.
SCHEMA_VERSION = 1


def genome_marks(panel: DataFrame) -> DataFrame:
    """genome_id, mark: count, sum and xor of two hashes of its peptides. Summed
    up where the rows lie; one row a genome and task moves."""
    total = F.sum(F.xxhash64("peptide").cast("decimal(38,0)"))
    mixed = F.bit_xor(F.xxhash64(F.lit("mark"), F.col("peptide")))
    return panel.groupBy("genome_id").agg(F.concat_ws("/", F.count("*").cast("string"), total.cast("string"), mixed.cast("string")).alias("mark"))


def provenance(policy: str, digestion: dict | None, observed: DataFrame | None = None, marks: DataFrame | None = None) -> dict:
    """What a stored table was made of; tables of equal provenance are equal.
    ``observed`` (peptide) and ``marks`` (``genome_marks``) where it depends on them."""
    out = {"schema": SCHEMA_VERSION, "policy": policy, "digestion": digestion or {}}
    if observed is not None:
        out["observed"] = sinks.content_hash(observed, "peptide")
    if marks is not None:
        out |= {"genomes": sinks.content_hash(marks, "genome_id"), "bundle": sinks.content_hash(marks, "genome_id", "mark")}
    return out


def _finished(spark: SparkSession, folder: str) -> list[str]:
    """Names of the batches whose ledger was written to its end."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger/batch=*/_SUCCESS")
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().getParent().getName().removeprefix("batch=") for f in found)


def _batches(spark: SparkSession, folder: str, names: list[str], column: str) -> DataFrame:
    schema = f"genome_id string, {column} string, batch string"
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/batch={n}" for n in names])


def matched(panel: DataFrame, peptides: DataFrame, path: str, policy: str, digestion: dict | None = None, marks: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(matches, counts): ``panel.match`` of distinct (genome_id, peptide) rows
    and ``peptides``, with what the store below ``path`` has of it. The counts
    say how many genomes were reused and how many matched now."""
    spark = panel.sparkSession
    peptides = peptides.select("peptide").distinct()
    named = json.dumps(provenance(policy, digestion, peptides), sort_keys=True)
    folder = f"{path.rstrip('/')}/matches-{hashlib.sha256(named.encode()).hexdigest()[:32]}"
    done = _finished(spark, folder)
    known = _batches(spark, f"{folder}/ledger", done, "mark").groupBy("genome_id", "mark").agg(F.min("batch").alias("batch"))
    state = written((genome_marks(panel) if marks is None else marks).join(known, ["genome_id", "mark"], "left"), "reuse-state")
    n, fresh = state.agg(F.count("*"), F.count_if(F.col("batch").isNull())).first()
    if fresh:
        new = uuid.uuid4().hex
        rows = panel if fresh == n else panel.join(state.where("batch IS NULL").select("genome_id"), "genome_id", "left_semi")
        P.match(rows, peptides).write.parquet(f"{folder}/rows/batch={new}")
        state.where("batch IS NULL").select("genome_id", "mark").write.parquet(f"{folder}/ledger/batch={new}")
        done, state = [*done, new], state.fillna(new, ["batch"])
    rows = _batches(spark, f"{folder}/rows", done, "peptide")
    matches = rows.join(state.select("genome_id", "batch"), ["genome_id", "batch"], "left_semi").select("genome_id", "peptide")
    return matches, {"genomes_reused": n - fresh, "genomes_matched": fresh}
