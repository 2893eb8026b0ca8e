"""A quality classifier of supervised subword embeddings.

A document is the average of the learned vectors of its words, of its pairs of
neighbouring words and of the words' character n-grams, hashed into a fixed
number of slots (all pairs of twice the same word into one); a softmax over two
classes reads it. Vectors and softmax are trained together by plain stochastic
gradient descent in numpy, one document a step with a rate that falls to zero.
As nothing but an average lies between vectors and softmax, scoring adds up one
number a slot: the slot's vector by the difference of the classes' weights.

It learns from at most ``fit_docs`` labelled documents with together about
``fit_chars`` characters, chosen by a hash of the id, and scores every whole
text by nothing but the text. Characters keep their case; words are what stands
between ASCII white space.

Defined cases: null text counts as empty; a text without a word has the end
mark as its only feature, so it is scored as well. Of repeated rows of an id
one is learned from, of several labels of an id the largest; null ids and null
labels teach nothing. Without any label every score is 0.5, with one class only
it is near that class. Repeated rows are scored alike. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presencia.llm.tables import written

#: Characters that are turned into features at a time, more only for a longer word.
BLOCK = 200_000
EDGE = 32


@dataclass(frozen=True)
class ClassifierParams:
    """``fit_docs`` and ``fit_chars`` bound what is learned from; n-grams have
    ``shortest`` to ``longest`` characters, the word's two edges among them."""

    fit_docs: int = 4_000
    fit_chars: int = 16_000_000
    slot_bits: int = 18
    dims: int = 16
    shortest: int = 3
    longest: int = 5
    epochs: int = 3
    rate: float = 2.0
    least_score: float = 0.3
    seed: int = 7


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n, modulo 2**64; remembered up to a block."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, BLOCK + 2)
    both = []
    for base in (_P, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    if size <= 4 * BLOCK:
        _POWERS[:] = both
    return both[0][:n], both[1][:n]


def _blocks(text: str) -> Iterator[str]:
    """The text in pieces of about BLOCK characters, cut where a word ends."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not (text[end] == " " or "\t" <= text[end] <= "\r"):
            end += 1
        yield text[at:end]
        at = end


def slots(text: str, params: ClassifierParams) -> Iterator[np.ndarray]:
    """Slots of all features of a text, an array a block and kind; the end mark last."""
    shift = np.uint64(64 - params.slot_bits)

    def mixed(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h ^ np.uint64(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift

    last = None
    for block in _blocks(text):
        raw = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        keep[:1] = ~space[:1]
        y = np.where(space, np.uint64(EDGE), raw)[keep]
        if not len(y):
            continue
        ends = [np.uint64(EDGE)] if y[-1] != EDGE else []
        y = np.concatenate([[np.uint64(EDGE)], y, ends]).astype(np.uint64)
        edge = y == EDGE
        at = np.flatnonzero(edge)
        power, inverse = _powers(len(y))
        sums = np.cumsum(y * power, dtype=np.uint64)
        # a word lies between two edges: its sum, moved to power zero
        words = (sums[at[1:] - 1] - sums[at[:-1]]) * inverse[at[:-1] + 1]
        yield mixed(words, 1)
        row = words if last is None else np.concatenate([[last], words])
        last = row[-1]
        # two words: what they are, or only that they are the same
        yield mixed(np.where(row[1:] == row[:-1], np.uint64(0), row[:-1] * _P + row[1:]), 6 + params.longest)
        upto = np.concatenate([[0], np.cumsum(edge)])
        h = y.copy()
        for n in range(2, params.longest + 1):
            if len(y) < n:
                break
            h = h[: len(y) - n + 1] * _P + y[n - 1 :]
            if n >= params.shortest:
                # no edge but at its ends
                inner = upto[n - 1 : len(y)] == upto[1 : len(y) - n + 2]
                yield mixed(h[inner], n)
    yield mixed(np.array([0], np.uint64), 0)


def features(text: str | None, params: ClassifierParams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their shares of all features of a text."""
    tally = np.zeros(0, np.uint64)
    counts = np.zeros(0, np.int64)
    for some in slots(text or "", params):
        both = np.concatenate([tally, some])
        weight = np.concatenate([counts, np.ones(len(some), np.int64)])
        tally, place = np.unique(both, return_inverse=True)
        counts = np.bincount(place, weight, len(tally)).astype(np.int64)
    return tally.astype(np.int32), (counts / counts.sum()).astype(np.float32)


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], params: ClassifierParams) -> tuple[np.ndarray, float]:
    """(number of each slot, offset): positive sums speak for class 1.

    ``samples``: (class, slots, shares). Vectors start small and random, the
    softmax at zero."""
    rng = np.random.default_rng(params.seed)
    vectors = rng.uniform(-1.0, 1.0, (1 << params.slot_bits, params.dims)).astype(np.float32) / params.dims
    weights, offset = np.zeros((2, params.dims), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, params.epochs * len(samples))
    for _ in range(params.epochs):
        for i in rng.permutation(len(samples)):
            label, at, share = samples[i]
            rate = np.float32(params.rate * (1 - step / steps))
            step += 1
            hidden = share @ vectors[at]
            logits = weights @ hidden + offset
            p = np.exp(logits - logits.max())
            slope = p / p.sum()
            slope[label] -= 1
            back = slope @ weights
            weights -= rate * np.outer(slope, hidden)
            offset -= rate * slope
            vectors[at] -= rate * share[:, None] * back
    return vectors @ (weights[1] - weights[0]), float(offset[1] - offset[0])


def is_held_out(id_: Column) -> Column:
    """The fixed fold: the CRC-32 of the id as text, modulo five, is zero."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chosen(docs: DataFrame, labels: DataFrame, params: ClassifierParams) -> DataFrame:
    """id, text, label, place: what is learned from. ``docs``: id, text;
    ``labels``: id, label. Ids are thinned out by a hash before anything is
    ranked, and texts meet only the ids that are chosen."""
    said = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    lengths = docs.where("id IS NOT NULL").groupBy("id").agg(F.min(F.length("text")).alias("chars"))
    known = written(said.join(lengths, "id").withColumn("key", F.xxhash64("id", F.lit(params.seed))), "labelled")
    n = known.count()
    limit = 2.0 * params.fit_docs / max(1, n)
    some = known.where(F.pmod("key", F.lit(1 << 30)) < limit * (1 << 30)) if limit < 1 else known
    # about twice fit_docs rows of numbers
    by = Window.orderBy(F.xxhash64("key", "id"), "id")
    placed = some.withColumn("place", F.row_number().over(by)).withColumn("before", F.sum(F.coalesce("chars", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce("chars", F.lit(0)))
    few = written(placed.where((F.col("place") <= params.fit_docs) & (F.col("before") < params.fit_chars)).select("id", "label", "place"), "chosen-ids")
    shortest = F.min_by(F.coalesce("text", F.lit("")), F.struct(F.length("text"), F.xxhash64("text")))
    texts = docs.join(few.select("id"), "id", "left_semi").groupBy("id").agg(shortest.alias("text"))
    return texts.join(few, "id")


@dataclass
class QualityModel:
    numbers: np.ndarray
    offset: float
    params: ClassifierParams

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for some in slots(text or "", self.params):
            total += float(self.numbers[some].sum(dtype=np.float64))
            n += len(some)
        return float(1 / (1 + np.exp(-(total / n + self.offset))))


def train(docs: DataFrame, labels: DataFrame, params: ClassifierParams = ClassifierParams()) -> QualityModel:
    """The model of ``docs`` (id, text) and ``labels`` (id, label), both already
    without what must not be learned from. Features are made where the texts
    are; one task, whose input ``fit_docs`` and ``fit_chars`` bound, descends."""

    def made(batches):
        for batch in batches:
            rows = [features(t, params) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("label"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
                names=["place", "label", "slots", "shares"],
            )

    sample = written(chosen(docs, labels, params).mapInArrow(made, "place int, label int, slots array<int>, shares array<float>"), "features")

    def descend(batches):
        rows = []
        for b in batches:
            for place, label, at, share in zip(b.column("place").to_pylist(), b.column("label").to_pylist(), b.column("slots"), b.column("shares")):
                rows.append((place, label, at.values.to_numpy(zero_copy_only=False), share.values.to_numpy(zero_copy_only=False)))
        rows.sort(key=lambda r: r[0])
        numbers, offset = fit([r[1:] for r in rows], params) if rows else (np.zeros(1 << params.slot_bits, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(numbers, "<f4").tobytes()], pa.binary()), pa.array([offset], pa.float64())], names=["numbers", "offset"])

    # one number a slot, whatever the corpus
    found = sample.coalesce(1).mapInArrow(descend, "numbers binary, offset double").first()
    return QualityModel(np.frombuffer(found.numbers, "<f4"), found.offset, params) if found else QualityModel(np.zeros(1 << params.slot_bits, np.float32), 0.0, params)


def predict(docs: DataFrame, model: QualityModel, text_col: str, out: str) -> DataFrame:
    """``docs`` with the score column ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, score(F.col(f"`{text_col}`")))


def score_quality(docs: DataFrame, labels: DataFrame, params: ClassifierParams = ClassifierParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    said = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label_col}`") == 1).cast("int").alias("label"))
    learn = ~is_held_out(F.col("id"))
    model = train(rows.where(learn), said.where(learn), params)
    out = predict(rows, model, "text", "score")
    return out.select(F.col("id").alias("doc_id"), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= params.least_score).cast("int").alias("predicted"))
