"""What filters do to a corpus in every order, and how they overlap.

Each document gets five bits, one a filter that it fails. Per part the
documents, and those of them with good and with toxic labels, are counted by
their bits: at most 32 numbers, which are a 2x2x2x2x2 tensor with an axis a
filter. Whatever a filter does at any step of any order is a contraction of
that tensor: along each axis ``einsum`` takes those that pass, those that fail
or all of them.

Defined cases: null text counts as empty; a null part is the empty string; of
repeated labels of a document one that says so is enough; documents without a
label are neither good nor toxic. Rows count as often as they occur, rows of
one id and text are no copies of each other; a null id comes after all others.
An empty table has no parts and gives an empty result. Texts are whole
whatever their length. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.llm.tables import hot_join, hot_keys, written

FILTERS = "ABCDE"
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
UPPER = bytes(range(65, 91))


def failed(text: bytes | None) -> int:
    """Bits of the filters A to D that one text fails.

    A: under 200 words; B: under half of the words distinct; C: over three in a
    hundred code points upper-case; D: any of ``#$%&*|``.
    """
    data = text or b""
    words = data.split()
    points = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
    upper = len(data) - len(data.translate(None, UPPER))
    odd = len(data) != len(data.translate(None, b"#$%&*|"))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2 | odd << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, bits: the filters that each row fails, E by the digest of its
    text: a smaller id has the same text."""

    @F.pandas_udf("int")
    def bits_of(texts):
        import pandas as pd

        return pd.Series([failed(t) for t in texts], dtype="int32")

    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        bits_of(body).alias("bits"), F.unhex(F.sha2(body, 256)).alias("digest"),
    )
    rows = written(rows, "audit-rows")
    digests = written(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "audit-digests")
    both = hot_join(rows, digests.select("digest", "least"), hot_keys(digests.select("digest", "n"), "digest"), "digest", "left")
    later = F.coalesce((F.col("id") > F.col("least")) | (F.col("id").isNull() & F.col("least").isNotNull()), F.lit(False))
    return both.select("id", "part", (F.col("bits") + F.when(later, 16).otherwise(0)).alias("bits"))


def cells(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, docs, good, toxic: the tensors' cells, at most 32 a part."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")
    )
    rows = written(failures, "audit-failures")
    counts = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "audit-ids")
    both = hot_join(rows, said, hot_keys(counts, "id"), "id", "left")
    return both.groupBy("part", "bits").agg(F.count("*").alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def contracted(tensors: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Sums of the stacked tensors, each axis as ``axes`` says or over all."""
    return np.einsum("xabcde,a,b,c,d,e->x", tensors, *[axes.get(i, ALL) for i in range(5)])


def steps(tensors: np.ndarray) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for all orders; tensors: documents, good, toxic."""
    every, removed = list(itertools.permutations(range(5))), {}
    for f in range(5):
        others = [i for i in range(5) if i != f]
        for k in range(5):
            for before in itertools.combinations(others, k):
                removed[f, frozenset(before)] = contracted(tensors, {i: PASS for i in before} | {f: FAIL})
    alone = [int(removed[f, frozenset(range(5)) - {f}][0]) for f in range(5)]
    total = [int(removed[f, frozenset()][0]) for f in range(5)]
    shapley = [0] * 5
    for order in every:
        for k, f in enumerate(order):
            shapley[f] += int(removed[f, frozenset(order[:k])][0])
    for order in every:
        for k, f in enumerate(order):
            gone = removed[f, frozenset(order[:k])]
            kept = contracted(tensors[:1], {i: PASS for i in order[: k + 1]})
            yield "".join(FILTERS[i] for i in order), k + 1, int(kept[0]), int(gone[0]), total[f] - int(gone[0]), alone[f], int(gone[1]), int(gone[2]), shapley[f]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row a part, order and step. ``labels``: doc_id, quality, toxic."""

    def of_part(found):
        import pandas as pd

        tensors = np.zeros((3, 32), np.int64)
        for i, name in enumerate(("docs", "good", "toxic")):
            tensors[i, found["bits"]] = found[name]
        # bit 0 is filter A and must be the first axis
        shaped = tensors.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)
        return pd.DataFrame([(found["part"].iloc[0], *row) for row in steps(shaped)], columns=[c.split()[0] for c in RESULT.split(", ")])

    return cells(failures(docs, id_col, text_col, part_col), labels).groupBy("part").applyInPandas(of_part, RESULT)
