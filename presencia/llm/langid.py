"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit says from hashed
byte n-grams (log odds between the languages with and without the bit) which
side a text is on. Decoding weighs each bit's logistic loss by how well its
classifier did in training and takes the codeword with the least loss; a small
lead over the next one is flagged as ambiguous.

The classifiers are fitted on at most ``docs_per_lang`` whole texts of each
language, chosen by a hash of the id; prediction reads every whole text and
nothing but the text.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
so is everything when nothing can be learned from; with one language to learn
it is always that one. Equal losses go to the first language by name. There may
be any number of languages; the driver holds their names, codewords and the
classifiers, one table slot at a time a language. Rows with a null id are predicted, never learned from.
Repeated rows are predicted alike. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presencia.llm.tables import written


@dataclass(frozen=True)
class LangParams:
    docs_per_lang: int = 1_000
    bits_of_hash: int = 15
    sharpness: float = 8.0
    ambiguous_below: float = 0.1


def codebook(n: int, seed: int = 3) -> np.ndarray:
    """n rows of -1/+1: all splits of up to six languages, else random words
    chosen for their least distance."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        cols = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(cols, np.int8).T
    rng, length = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n)))

    def words() -> np.ndarray:
        book = rng.choice(np.array([-1, 1], np.int8), (n, length))
        return book[:, np.abs(book.sum(axis=0, dtype=np.int64)) < n]

    # as many tries as some seconds allow: comparing n words takes n * n steps
    tries = max(1, min(200, 4_000_000 // (n * n)))
    books = [words() for _ in range(tries)]
    if tries == 1:
        return books[0]

    def least_distance(book: np.ndarray) -> int:
        wide = book.astype(np.int32)
        return int(((book.shape[1] - wide @ wide.T) // 2 + np.eye(n, dtype=np.int32) * 10**6).min())

    return max(books, key=least_distance)


def grams(text: str, bits: int) -> np.ndarray:
    """Hashed byte 1- to 4-grams of the lower-cased text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for n in range(4):
        if len(b) <= n:
            break
        h = h[: len(b) - n] * np.uint32(257) + b[n:] + np.uint32(n + 1)
        out.append((h * np.uint32(2654435761)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def is_training(id_col: Column) -> Column:
    """The fixed fold: the CRC-32 of the id as text, modulo four, is not two."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


@dataclass
class LangModel:
    langs: list[str]
    book: np.ndarray
    odds: np.ndarray
    weights: np.ndarray
    params: LangParams

    def margins(self, text: str) -> np.ndarray:
        g = grams(text, self.params.bits_of_hash)
        total = np.zeros(self.odds.shape[1])
        for at in range(0, len(g), 100_000):
            total += self.odds[g[at : at + 100_000]].sum(axis=0, dtype=np.float64)
        return total / max(1, len(g))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = np.logaddexp(0, -self.params.sharpness * self.book * self.margins(text)) @ self.weights
        near = np.exp(loss.min() - loss)
        share = near / near.sum()
        order = np.argsort(loss, kind="stable")
        return self.langs[order[0]], float(share[order[0]]), bool(share[order[0]] - share[order[1]] < self.params.ambiguous_below)


def train(docs: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """Fit on ``docs`` (id, text, lang): what it may learn from, already chosen."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n_docs")), "lang-sizes")
    langs = [r.lang for r in sizes.select("lang").orderBy("lang").collect()]  # names only
    place = {lang: i for i, lang in enumerate(langs)}
    bits, book = params.bits_of_hash, codebook(len(langs))
    empty = LangModel(langs, book, np.zeros((1 << bits, book.shape[1]), np.float32), np.ones(book.shape[1]), params)
    if len(langs) < 2:
        return empty
    # about twice as many as needed by a hash of the id, the first of them by another
    share = F.lit(2.0 * params.docs_per_lang * (1 << 20)) / F.col("n_docs")
    some = rows.select("id", "lang").join(sizes, "lang").where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < share)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= params.docs_per_lang).select("id", "lang").distinct()
    # their number is that of the languages times a parameter; written, its size is known to Spark
    chosen = written(chosen, "lang-chosen")
    sample = written(rows.join(chosen, ["id", "lang"], "left_semi").select("lang", "text"), "lang-sample")

    def count(batches):
        tally: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                tally[lang] = tally.get(lang, 0) + np.bincount(grams(text, bits), minlength=1 << bits)
        for lang, n in tally.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "slot", "n"])

    counted = sample.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # one row a language at a time, its list no longer than the hash has slots
    sides = np.zeros((2, book.shape[1], 1 << bits))
    by_lang = counted.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns"))
    for r in by_lang.orderBy("lang").toLocalIterator():
        counts = np.ones(1 << bits)
        counts[np.array(r.slots)] += np.array(r.ns)
        word = book[place[r.lang]]
        for side, sign in enumerate((1, -1)):
            sides[side, word == sign] += counts / counts.sum()
    means = sides / np.stack([(book > 0).sum(axis=0), (book < 0).sum(axis=0)])[:, :, None]
    odds = np.log(means[0] / means[1]).T
    model = LangModel(langs, book, np.ascontiguousarray(odds, np.float32), np.ones(book.shape[1]), params)

    def score(batches):
        right = np.zeros(book.shape[1], np.int64)
        seen = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                right += np.sign(model.margins(text)) == book[place[lang]]
                seen += 1
        yield pa.RecordBatch.from_arrays([pa.array([right.tolist()], pa.list_(pa.int64())), pa.array([seen], pa.int64())], names=["right", "seen"])

    parts = sample.mapInArrow(score, "right array<long>, seen long").select("seen", F.posexplode("right").alias("bit", "n"))
    rates = {r.bit: (r.n + 1) / (r.seen + 2) for r in parts.groupBy("bit").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")).collect()}
    rate = np.clip([rates.get(b, 0.5) for b in range(book.shape[1])], 0.501, 0.999)
    model.weights = np.log(rate / (1 - rate))
    model.weights /= model.weights.sum()
    return model


def predict(docs: DataFrame, model: LangModel, text_col: str, out: str) -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def guess(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])

    return docs.withColumn(out, guess(F.col(f"`{text_col}`")))


def identify(docs: DataFrame, params: LangParams = LangParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row."""
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (lang_col, "lang"))])
    model = train(rows.where(is_training(F.col("id"))), params)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = predict(rows.select("id", "text"), model, "text", "p")
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous"))
