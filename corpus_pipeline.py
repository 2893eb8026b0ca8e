"""A training corpus out of raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every one is
written as Parquet and read again as the next one's documents. All but the
last return the columns of documents.

What holds for every stage: an empty table gives an empty result; further
columns are carried (by packing: not looked at), and columns named ``_llm_...``
are an error; ids must be whole numbers or null; whole texts are read, however
long. What a stage does with nulls, ties and repeated rows is in its docstring.
A stage's result must be written before the next stage begins, as ``run`` does.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.llm import linededup, neardup, packing, quality, secrets
from presencia.llm.tables import written
from presencia.session import ship_package
from presencia.tables import clear_scratch, scratch

#: Near copies share 0.8 and more of their five-word shingles. Fingerprints of
#: 64 bits cannot tell that (README, Limits): candidates are verified by their sets.
NEAR = neardup.NearParams(shingle_words=5)


def _stage(fn):
    """A stage whose inner tables lie in a folder of their own. Those of the
    stages before are deleted when it begins: what they returned has been
    written by then, unless ``docs`` still reads from their folders."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = getattr(spark, "_corpus_scratches", [])
        read = docs.inputFiles() if held else []
        spark._corpus_scratches = [name for name in held if any(name in file for file in read)]
        for name in set(held) - set(spark._corpus_scratches):
            clear_scratch(spark, name)
        ship_package(spark)
        with scratch(spark) as name:
            out = fn(spark, docs, sf_dir)
        spark._corpus_scratches.append(name)
        return out

    return run


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive thresholds reject go.

    Null, empty and wordless texts are rejected. A null lang or source is a
    group of its own. A measure equal to its threshold passes. Repeated rows
    count and are judged as often as they occur.
    """
    return quality.quality_filter(docs)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that other documents hold too stay in one document only.

    Null and empty texts stay as they are; a text may become empty. The smallest
    id keeps a passage, of equal ids the smaller hash of the text, null ids come
    last. Rows of equal id and text keep their text together.
    """
    return _sized(linededup.line_dedup(docs))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest id, null
    ids last.

    Null, empty and wordless texts are equal to each other, so one of them
    stays. A similarity of exactly 0.8 links. Of repeated rows one stays.
    """
    return neardup.near_dedup(docs, NEAR)


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark.

    Null texts stay null, empty ones empty. Of overlapping finds the union is
    masked once. Repeated rows are masked alike.
    """
    return _sized(secrets.redact_secrets(docs))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a training sequence.

    Null and empty texts are one end token. Equal pieces may change places; of
    sequences that suit a piece equally well the tighter one is taken. Repeated
    rows are packed as often as they occur.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The tokenizer and the shingle sets are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
