"""Quality rules with thresholds from mergeable quantile sketches.

Each document's measures come from its whole text. Per language and source the
measures are summed up in log-bucket sketches: counts per bucket, whose merge
is addition, so any partitioning gives the same sketch and every quantile is
within ``accuracy`` of the true one. Upper fences replace fixed cutoffs: the
upper quartile times a power of the quartiles' ratio, as buckets are steps of
a ratio. Most documents have no symbol and no repeat, so each measure has a
small addition above and below, as if the document went on for a little: none
in a long text says more than none in a short one, and the quartiles of such
rates differ where those of plain ones are zero. The logarithms of a group's
quartiles are drawn towards those of its language, and these towards those of
everything, as if ``prior_docs`` documents had them: the fewer documents, the
more. The fences are joined back and decide.

Defined cases: null or blank text has no words and fails the base rule; null
lang or source is a group of its own; repeated rows count and are judged as
often as they occur; an empty table gives an empty result. Other columns are
carried by the filter, which refuses ``_llm_...``, and not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presencia.llm.tables import reserved, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FEATURES = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
#: Measures of the verdict and what they divide.
MEASURES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: Added above and below: half a case in one more place, and twenty words of five letters.
ADDED = {"symbols": (0.5, 1.0), "dup_lines": (0.5, 1.0), "repeats": (0.5, 1.0), "word_length": (100.0, 20.0)}


@dataclass(frozen=True)
class QualityParams:
    """A document fails a measure above ``q75 * (q75 / q25) ** reach`` and above
    ``slack`` more than q75, so groups without spread keep what is ordinary."""

    accuracy: float = 0.01
    prior_docs: int = 50
    reach: tuple[tuple[str, float], ...] = (("symbols", 2.5), ("dup_lines", 1.25), ("repeats", 2.5), ("word_length", 4.0))
    slack: tuple[tuple[str, float], ...] = (("symbols", 0.05), ("dup_lines", 0.1), ("repeats", 0.05), ("word_length", 0.5))


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The values of COUNTS for one text."""
    data = text or b""
    words = data.split()
    n = len(words)
    spaces = len(data) - len(data.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d"))
    points = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.split()]
    return n, points - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    mixed = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():
        return 0  # different keys are different windows
    # equal keys: compare the windows themselves
    _, at, times = np.unique(np.stack([ids[k : k + n] for k in range(window)], axis=1), axis=0, return_inverse=True, return_counts=True)
    twice = times[at.ravel()] > 1
    step = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def with_counts(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    @F.pandas_udf(FEATURES)
    def counts(texts):
        import pandas as pd

        return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return docs.withColumn(out, counts(F.col(f"`{text_col}`").cast("binary")))


def base_failed(c: str) -> Column:
    """Fixed part: under ten words, or over a fifth of them in repeats."""
    return (F.col(f"{c}.n_words") < 10) | (100 * F.col(f"{c}.n_repeat_words") > 20 * F.col(f"{c}.n_words"))


def _measure(c: str, name: str) -> Column:
    (top, below), (a, b) = MEASURES[name], ADDED[name]
    return (F.col(f"{c}.{top}") + F.lit(a)) / (F.col(f"{c}.{below}") + F.lit(b))


def sketches(rows: DataFrame, counts: str, group: list[str], params: QualityParams) -> DataFrame:
    """(group, measure, bucket, n): log buckets of relative accuracy over the
    documents with a word. Sketches merge by adding n."""
    gamma = (1 + params.accuracy) / (1 - params.accuracy)
    values = F.array(*[F.struct(F.lit(m).alias("measure"), _measure(counts, m).alias("value")) for m in MEASURES])
    flat = rows.where(F.col(f"{counts}.n_words") > 0).select(*group, F.explode(values).alias("m"))
    bucket = F.ceil(F.ln("m.value") / F.lit(math.log(gamma))).cast("int")
    return flat.groupBy(*group, F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, group: list[str], params: QualityParams) -> DataFrame:
    """(group, measure, docs, q25, q75) out of sketches."""
    gamma = (1 + params.accuracy) / (1 - params.accuracy)
    by = Window.partitionBy(*group, "measure")
    run = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("docs", F.sum("n").over(by))
    value = F.pow(F.lit(gamma), F.col("bucket")) * 2 / (gamma + 1)
    return run.groupBy(*group, "measure").agg(
        F.max("docs").alias("docs"),
        *[F.min(F.when(F.col("upto") >= F.ceil(F.col("docs") * q), value)).alias(f"q{int(100 * q)}") for q in (0.25, 0.75)],
    )


def fences(rows: DataFrame, counts: str, params: QualityParams, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, fences map<measure, bound>, floors), one row a group;
    ``floors`` counts the measures whose bound the slack alone decides."""
    own = sketches(rows, counts, [lang, source], params)
    by_lang = own.groupBy(lang, "measure", "bucket").agg(F.sum("n").alias("n"))
    of_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    a = quartiles(own, [lang, source], params)
    b = quartiles(by_lang, [lang], params).select(F.col(lang).alias("b_lang"), F.col("measure").alias("b_measure"), *[F.col(x).alias(f"b_{x}") for x in ("docs", "q25", "q75")])
    # one row a measure
    c = F.broadcast(quartiles(of_all, [], params).select(F.col("measure").alias("c_measure"), *[F.col(x).alias(f"c_{x}") for x in ("q25", "q75")]))
    all_three = a.join(b, F.col(lang).eqNullSafe(F.col("b_lang")) & (a.measure == F.col("b_measure"))).join(c, a.measure == F.col("c_measure"))
    prior = F.lit(float(params.prior_docs))

    def pick(q):
        of_lang = (F.col("b_docs") * F.ln(f"b_{q}") + prior * F.ln(f"c_{q}")) / (F.col("b_docs") + prior)
        return F.exp((F.col("docs") * F.ln(q) + prior * of_lang) / (F.col("docs") + prior))

    def of(pairs):
        return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.col("measure")]

    spread = all_three.withColumns({"low": pick("q25"), "high": pick("q75")}).withColumns({"reached": F.col("high") * F.pow(F.col("high") / F.col("low"), of(params.reach)), "floor": F.col("high") + of(params.slack)})
    # one entry a measure
    entries = F.collect_list(F.struct("measure", F.greatest("reached", "floor").alias("bound")))
    return spread.groupBy(lang, source).agg(F.map_from_entries(entries).alias("fences"), F.count_if(F.col("floor") > F.col("reached")).alias("floors"))


def _judged(rows: DataFrame, counts: str, params: QualityParams, lang: str, source: str) -> DataFrame:
    bounds = fences(rows, counts, params, lang, source).drop("floors").withColumnsRenamed({lang: "_llm_lang", source: "_llm_source"})
    joined = rows.join(bounds, F.col(lang).eqNullSafe(F.col("_llm_lang")) & F.col(source).eqNullSafe(F.col("_llm_source")), "left")
    over = [F.coalesce((F.col(f"{counts}.n_words") > 0) & (_measure(counts, m) > F.col("fences")[m]), F.lit(False)) for m in MEASURES]
    failed = F.array_compact(F.array(*[F.when(o, F.lit(m)) for o, m in zip(over, MEASURES)]))
    return joined.withColumn("_llm_base_failed", base_failed(counts)).withColumn("_llm_over", failed).withColumn(
        "_llm_kept", ~F.col("_llm_base_failed") & (F.size("_llm_over") == 0)
    )


def quality_report(docs: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the measures over their fence."""
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    rows = written(with_counts(rows, "text", "c").drop("text"), "quality")
    out = _judged(rows, "c", params, "lang", "source")
    return out.select("doc_id", *[F.col(f"c.{c}").alias(c) for c in COUNTS[:5]], F.col("_llm_base_failed").alias("base_failed"), F.col("_llm_kept").alias("kept"), F.array_join("_llm_over", ",").alias("over"))


def quality_filter(docs: DataFrame, params: QualityParams = QualityParams(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    names = reserved(docs).columns
    rows = written(with_counts(docs, text_col, "_llm_counts"), "quality-docs")
    out = _judged(rows, "_llm_counts", params, lang_col, source_col)
    return out.where("_llm_kept").select(*[rows[f"`{n}`"] for n in names])
