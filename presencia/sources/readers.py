"""Sources: observed tables, digest panels, FASTA, metadata and lineages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presencia.functions import text as T
from presencia.tables import written

# Names under which tools write each column, in order of choice.
ALIASES = {
    "sample": ("Run", "File.Name", "Raw.File", "Sample", "Sample.Name"),
    "sequence": ("Stripped.Sequence", "Base Sequence", "Sequence", "Peptide.Sequence", "PeptideSequence"),
    "score": ("Evidence", "Score", "CScore"),
    "decoy": ("Reverse", "Target/Decoy", "TargetDecoy", "Decoy"),
    "intensity": ("Precursor.Quantity", "Precursor.Normalised", "Intensity"),
    "error": ("Q.Value", "QValue", "Qval", "QVal", "PEP", "FDR"),
}
#: Order in which the pooled reader looks for an error column.
POOLED_ERRORS = ("PEP", "FDR", "Q.Value")
# Texts that mean a missing value in delimited files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _loose(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve(columns: list[str], kind: str, preferred: str | None = None, required: bool = False) -> str | None:
    """The column that holds ``kind``: the preferred name as it stands, else
    the first loose match of it and the known names."""
    if preferred and preferred in columns:
        return preferred
    by_loose: dict[str, str] = {}
    for c in columns:
        by_loose.setdefault(_loose(c), c)
    for name in ([preferred] if preferred else []) + list(ALIASES[kind]):
        if _loose(name) in by_loose:
            return by_loose[_loose(name)]
    if required:
        raise ValueError(f"no {kind} column among {columns}; known names: {ALIASES[kind]}")
    return None


def read_table(spark: SparkSession, path: str, sep: str = "\t", na_tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Parquet by its suffix, else delimited text (``.csv``: comma) of strings
    with missing marks as null."""
    if path.rstrip("/").lower().endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raw = spark.read.csv(path, sep="," if path.lower().endswith(".csv") else sep, header=True, inferSchema=False)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*na_tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def observed_columns(raw: DataFrame, unit_mode: str, preferred: dict[str, str] | None = None, needs_intensity: bool = False) -> DataFrame:
    """sample, sequence, intensity, score, error, decoy out of any known table;
    only those columns are read. A cohort-wide run may lack sample and
    intensity: one sample and intensity 1 stand in."""
    preferred, cohort = preferred or {}, unit_mode == "all-samples"
    found = {k: resolve(raw.columns, k, preferred.get(k), k == "sequence" or (k in ("sample", "intensity") and not cohort)) for k in ALIASES}
    if needs_intensity and found["intensity"] is None:
        raise ValueError("filtering by intensity needs an intensity column")

    types = dict(raw.dtypes)

    def take(kind, dtype, missing):
        if not found[kind]:
            return missing.alias(kind)
        value = F.col(f"`{found[kind]}`").cast(dtype)
        # truth values read as the marks that tools write for them
        return (F.initcap(value) if types[found[kind]] == "boolean" else value).alias(kind)

    return raw.select(
        take("sample", "string", F.lit("__global__")),
        take("sequence", "string", F.lit(None)),
        take("intensity", "string", F.lit("1.0")),
        take("score", "string", F.lit(None).cast("string")),
        take("error", "string", F.lit(None).cast("string")),
        take("decoy", "string", F.lit(None).cast("string")),
    ).withColumns({c: T.number(F.col(c)) for c in ("intensity", "score", "error")})


def pooled_columns(raw: DataFrame, sequence: str = "Base Sequence", score: str | None = None, decoy: str | None = None, error: str | None = None) -> DataFrame:
    """The pooled reader: one sequence column, the rest optional; the error
    column is looked for in a fixed order."""
    error = error or next((c for c in POOLED_ERRORS if c in raw.columns), None)
    names = {"sequence": sequence, "score": score, "decoy": decoy, "error": error}
    renamed = {v: k for k, v in names.items() if v}
    missing = [v for v in renamed if v not in raw.columns]
    if missing:
        raise ValueError(f"no column {missing} among {raw.columns}")
    picked = raw.select(*[F.col(f"`{v}`").cast("string").alias(ALIASES[k][0]) for v, k in renamed.items()])
    return observed_columns(picked, "all-samples").where(F.col("sequence").isNotNull())


AMINO_ACIDS = "^[A-Za-z*]+$"


def panel_lines(spark: SparkSession, directories: list[str]) -> DataFrame:
    """source, genome_id, value, named, file, at, row: the filled values of the
    peptide column of every digest below ``directories``, ``*.tsv``, one file a
    genome, or folders ``genome_id=...`` as ``write_digest`` leaves them. The
    column is ``Peptide``, else the first. Written once."""
    # files differ in their columns, so each line is cut by its own tabs
    raw = spark.read.option("pathGlobFilter", "*.{tsv,csv}").option("recursiveFileLookup", "true").text(directories).select(F.split("value", "\t").alias("cells"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # numbered once, in a written table: what follows reads it several times
    lined = written(raw.withColumn("row", F.monotonically_increasing_id()), "panel-lines")
    # a file's head is the least of its rows, found by sums of numbers; written,
    # so that Spark knows how small the heads are and no line is dealt or sorted by file
    first = lined.groupBy("file", "at").agg(F.min("row").alias("row")).groupBy("file").agg(F.min_by("row", "at").alias("row"))
    first = written(first, "panel-firsts")
    head = lined.join(first, ["file", "row"]).select("file", F.col("row").alias("head_row"), F.transform("cells", T.strip_all).alias("names"))
    head = written(head, "panel-heads")
    place = F.coalesce(F.nullif(F.array_position("names", F.lit("Peptide")), F.lit(0)), F.lit(1)).cast("int")
    rows = lined.join(head.withColumn("place", place).withColumn("named", F.array_contains("names", "Peptide")), "file").where("row <> head_row")
    value = T.strip_all(F.try_element_at("cells", F.col("place")))
    folder = F.nullif(F.regexp_extract("file", "/genome_id=([^/]+)/[^/]+$", 1), F.lit(""))
    place = F.when(folder.isNotNull(), F.regexp_replace("file", "/[^/]+$", "")).otherwise(F.col("file"))
    genome = F.coalesce(folder, F.regexp_extract("file", r"([^/]+)\.[a-z]+$", 1))
    return rows.select("file", place.alias("source"), "at", "row", "named", genome.alias("genome_id"), value.alias("value")).where("value <> ''")


def panel_problems(rows: DataFrame) -> DataFrame:
    """genome_id, problem, n of ``panel_lines``: values that are no peptides
    among the first 200 of a file read by position (``no peptides``), and places
    of a genome that has more than one (``two places``)."""
    first = Window.partitionBy("file").orderBy("at", "row")
    guessed = rows.where("NOT named").withColumn("r", F.row_number().over(first)).where("r <= 200")
    odd = guessed.where(~F.col("value").rlike(AMINO_ACIDS)).groupBy("genome_id").agg(F.count("*").alias("n")).select("genome_id", F.lit("no peptides").alias("problem"), "n")
    twice = rows.select("genome_id", "source").distinct().groupBy("genome_id").agg(F.count("*").alias("n")).where("n > 1")
    return odd.union(twice.select("genome_id", F.lit("two places").alias("problem"), "n"))


def read_panel(spark: SparkSession, directories: list[str], policy: str = "il-equivalent") -> DataFrame:
    """genome_id, peptide (distinct) of ``panel_lines``; ``panel_problems`` are
    errors."""
    rows = panel_lines(spark, directories)
    bad = panel_problems(rows).limit(10).collect()
    if bad:
        raise ValueError(f"first columns that hold no peptides, or genomes in more than one place: {[tuple(r) for r in bad]}")
    return rows.select("genome_id", T.peptide(F.col("value"), policy).alias("peptide")).where("peptide <> ''").distinct()


def read_fasta(spark: SparkSession, path: str, shorten: bool = False) -> DataFrame:
    """genome_id (file stem), header, sequence of every record. Files that do
    not start with ``>`` are not FASTA and left out."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a file's first record keeps its mark; later ones lost it with the separator
    started = raw.where((F.col("block") == 0) & F.col("value").startswith(">")).select("file").distinct()
    record = F.regexp_replace("value", "^>", "")
    header = T.strip_all(F.substring_index(record, "\n", 1))
    rows = raw.join(started, "file", "left_semi").select(
        F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("genome_id"),
        (T.short_header(header) if shorten else header).alias("header"),
        F.regexp_replace(F.regexp_replace(record, "^[^\n]*\n?", ""), r"\s+", "").alias("sequence"),
    )
    return rows.where("header <> '' OR sequence <> ''")


def fasta_files(spark: SparkSession, path: str) -> DataFrame:
    """file, fasta, n_records: every file below ``path`` and whether it is
    FASTA; those that are not have no records and ``read_fasta`` leaves them out."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    of = raw.groupBy("file").agg(F.max((F.col("block") == 0) & F.col("value").startswith(">")).alias("fasta"), F.count("*").alias("n"))
    return of.select("file", "fasta", F.when(F.col("fasta"), F.col("n")).otherwise(0).alias("n_records"))


def not_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` that ``read_fasta`` leaves out."""
    return fasta_files(spark, path).where("NOT fasta").select("file")


def read_metadata(spark: SparkSession, path: str, sample_col: str = "sample_id", unit_col: str = "analysis_unit_id") -> DataFrame:
    """All-string metadata with sample_id, analysis_unit_id and the rest."""
    return metadata_columns(read_table(spark, path), sample_col, unit_col)


def metadata_columns(raw: DataFrame, sample_col: str = "sample_id", unit_col: str = "analysis_unit_id") -> DataFrame:
    missing = [c for c in (sample_col, unit_col) if c not in raw.columns]
    if missing:
        raise ValueError(f"metadata lacks {missing}; it has {raw.columns}")
    rest = [c for c in raw.columns if c not in (sample_col, unit_col, "sample_id", "analysis_unit_id")]
    return raw.select(
        T.sample_id(F.col(f"`{sample_col}`").cast("string")).alias("sample_id"),
        T.strip_all(F.col(f"`{unit_col}`").cast("string")).alias("analysis_unit_id"),
        *[F.col(f"`{c}`").cast("string").alias(c) for c in rest],
    )


def read_lineage(spark: SparkSession, path: str, id_col: str = "genome_id", lineage_col: str = "Lineage") -> DataFrame:
    found = lineage_columns(read_table(spark, path), id_col, lineage_col)
    if found.isEmpty():
        raise ValueError("the lineage table has no filled row")
    return found


def lineage_columns(raw: DataFrame, id_col: str = "genome_id", lineage_col: str = "Lineage") -> DataFrame:
    """genome_id, Lineage: trimmed, filled, one per genome (the least)."""
    rows = raw.select(T.strip_all(F.col(f"`{id_col}`").cast("string")).alias("genome_id"), T.strip_all(F.col(f"`{lineage_col}`").cast("string")).alias("Lineage"))
    return rows.where("genome_id <> '' AND Lineage <> ''").groupBy("genome_id").agg(F.min("Lineage").alias("Lineage"))
