"""Token counts without tokens: a Viterbi pass that carries only the best
score and its number of pieces.

The unigram vocabulary's matches in a text are enumerated by an Aho-Corasick
automaton. Ties follow the unigram tokenizer: of paths with equal scores to
one place, the one whose last piece starts first wins. A character that no
piece covers alone costs the least score minus ten and counts as its UTF-8
bytes (byte fallback).

Defined cases: null and empty text have no tokens and score zero. Repeated
rows are counted alike; ids may be null. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.llm.pieces import Pieces, Remembered, model_path


@dataclass(frozen=True)
class CountParams:
    """``cache_bytes`` bounds a worker's memory of words it has counted."""

    model: str | None = None
    cache_bytes: int = 130_000_000


class UnigramCounter:
    def __init__(self, path: str, most: int):
        import ahocorasick

        self.pieces = Pieces(path)
        self.matches = ahocorasick.Automaton()
        for piece, score in zip(self.pieces.pieces, self.pieces.scores):
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(self.pieces.scores) - 10.0
        self.memory = Remembered(self.pieces, self.chunk, lambda a, b: (a[0] + b[0], a[1] + b[1]), most)

    def chunk(self, text: str) -> tuple[float, int]:
        """(best score, number of tokens) of one chunk."""
        n = len(text)
        ending: list[list] = [[] for _ in range(n)]
        for last, match in self.matches.iter(text):
            ending[last].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best = None
            single = False
            # the automaton lists the longest match first: the earliest start
            for size, value in ending[end - 1]:
                single = single or size == 1
                total = score[end - size] + value
                if best is None or total > best:
                    best, at = total, count[end - size] + 1
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, at = total, count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
            score[end], count[end] = best, at
        return score[n], count[n]

    def text(self, text: str | None) -> tuple[float, int]:
        found = self.memory.of(text or "")
        return float(sum([s for s, _ in found])), sum([c for _, c in found])


_workers: dict[tuple, UnigramCounter] = {}


def _worker(path: str, most: int) -> UnigramCounter:
    if (path, most) not in _workers:
        _workers[path, most] = UnigramCounter(path, most)
    return _workers[path, most]


def with_token_counts(docs: DataFrame, params: CountParams = CountParams(), text_col: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``out``: n_tokens, score."""
    path, most = params.model or model_path(), params.cache_bytes

    @F.pandas_udf("n_tokens long, score double")
    def count(texts):
        import pandas as pd

        counter = _worker(path, most)
        found = [counter.text(t) for t in texts]
        return pd.DataFrame({"n_tokens": [c for _, c in found], "score": [s for s, _ in found]}).astype({"n_tokens": "int64", "score": "float64"})

    return docs.withColumn(out, count(F.col(f"`{text_col}`")))


def token_counts(docs: DataFrame, params: CountParams = CountParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score for every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_token_counts(rows, params, "text", "tokens").select("doc_id", "tokens.n_tokens", "tokens.score")
