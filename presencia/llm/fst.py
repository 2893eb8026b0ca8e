"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file. The normaliser copies
characters, writes the space mark for a space and one before the first
character. The pieces are a trie of all spellings: a path from the root to the
end of a piece is an arc that reads the spelling and writes the piece. Byte
fallback has, for a character that is no piece, an arc that writes the pieces
of its UTF-8 bytes. States between arcs remember the last piece, and weights
are those of the tropical semiring: a piece arc costs nothing where the model's
own merges leave the two neighbours apart as they are and is infinite
elsewhere, and a byte arc costs one a byte, so that any spelling by pieces is
cheaper. The weights of neighbours are worked out when an arc first needs them.

The normalised input is composed with pieces and fallback state by state, and
the path of least weight is taken, states settled in order of their weight. The
model's pieces are made by merges, and sums of its scores would give other ids;
with these weights the least path is the model's own segmentation, as every
stretch between byte arcs has exactly one segmentation of weight zero.

Defined cases: null text gives null ids, empty text none; a character outside
the vocabulary becomes its UTF-8 bytes' pieces. Decoding takes null to null,
drops the control pieces and the space that the normaliser put in front, and
puts U+FFFD for bytes that are not UTF-8; ids that the model lacks are an
error. Repeated rows are coded alike; ids may be null. An empty table gives an
empty result. Other columns are carried, but a column of the output's name is
an error.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.llm.pieces import SPACE, Pieces, Remembered, model_path
from presencia.llm.tables import reserved


@dataclass(frozen=True)
class FstParams:
    """``cache_bytes`` bounds a worker's memory of words it has coded,
    ``cache_pairs`` the number of weights of neighbours it remembers."""

    model: str | None = None
    cache_bytes: int = 180_000_000
    cache_pairs: int = 500_000


#: States that no piece led to.
START, AFTER_BYTES = -1, -2


class PieceFst:
    def __init__(self, path: str, most_bytes: int = 180_000_000, pairs: int = 500_000):
        self.pieces = Pieces(path)
        names, scores = self.pieces.pieces, self.pieces.scores
        self.score = {names[i]: scores[i] for i in self.pieces.plain}
        #: every beginning of a spelling; its piece, or -1 where none ends there
        self.trie: dict[str, int] = {}
        for i in self.pieces.plain:
            for end in range(1, len(names[i])):
                self.trie.setdefault(names[i][:end], -1)
            self.trie[names[i]] = i
        self.free: dict[int, bool] = {}
        self.most_pairs = pairs
        self.memory = Remembered(self.pieces, self.chunk, lambda a, b: a + b, most_bytes)
        #: the inverse machine: what each piece writes back
        self.out = [p.replace(SPACE, " ").encode() for p in names]
        for byte, i in self.pieces.byte_id.items():
            self.out[i] = bytes([byte])
        silent = set(range(len(self.out))) - set(self.pieces.plain) - set(self.pieces.byte_id.values())
        for i in silent:
            self.out[i] = b""

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short string: best score first, leftmost of
        equals. Only compiles the weights of neighbours."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def apart(self, last: int, piece: int) -> bool:
        """Whether the arc of ``piece`` costs nothing in the state ``last``; it
        is infinite otherwise."""
        key = (last + 2) << 20 | piece
        known = self.free.get(key)
        if known is None:
            if len(self.free) > self.most_pairs:
                self.free.clear()
            b = self.pieces.pieces[piece]
            a = [self.pieces.pieces[last]] if last >= 0 else []
            known = self.free[key] = self.merged("".join(a) + b) == a + [b]
        return known

    def chunk(self, text: str) -> bytes:
        """Ids of one chunk, as little-endian 32-bit numbers: the output of the
        path of least weight through the composition."""
        n, trie = len(text), self.trie
        back: dict[tuple[int, int], tuple[int, int] | None] = {}
        waiting: dict[int, list] = {0: [(0, START, None)]}
        final = None
        while final is None:
            weight = min(waiting)
            states = waiting.pop(weight)
            while states:
                place, last, before = states.pop()
                here = (place, last)
                if here in back or last >= 0 and not self.apart(before[1], last):
                    continue
                back[here] = before
                if place == n:
                    final = here
                    break
                char = text[place]
                if trie.get(char, -1) < 0:
                    waiting.setdefault(weight + len(char.encode("utf-8", "replace")), []).append((place + 1, AFTER_BYTES, here))
                for end in range(place + 1, n + 1):
                    piece = trie.get(text[place:end])
                    if piece is None:
                        break
                    if piece >= 0:  # it may weigh nothing, which is seen when its turn comes
                        states.append((end, piece, here))
        ids: list[int] = []
        while back[final] is not None:
            if final[1] >= 0:
                ids.append(final[1])
            else:
                ids.extend(reversed([self.pieces.byte_id[b] for b in text[final[0] - 1].encode("utf-8", "replace")]))
            final = back[final]
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.memory.of(text)), "<u4")

    def decode(self, ids) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_workers: dict[tuple, PieceFst] = {}


def _worker(key: tuple) -> PieceFst:
    if key not in _workers:
        _workers[key] = PieceFst(*key)
    return _workers[key]


def _key(params: FstParams) -> tuple:
    return params.model or model_path(), params.cache_bytes, params.cache_pairs


def encode(docs: DataFrame, params: FstParams = FstParams(), text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array<int> column of piece ids."""
    key = _key(params)

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        import pandas as pd

        fst = _worker(key)
        return pd.Series([None if t is None else fst.encode(t).astype(np.int32) for t in texts], dtype=object)

    return reserved(docs, out).withColumn(out, ids_of(F.col(f"`{text_col}`")))


def decode(coded: DataFrame, params: FstParams = FstParams(), ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``coded`` with a string column of the texts of its ids."""
    key = _key(params)

    @F.pandas_udf("string")
    def text_of(lists):
        import pandas as pd

        fst = _worker(key)
        return pd.Series([None if ids is None else fst.decode(ids) for ids in lists], dtype=object)

    return reserved(coded, out).withColumn(out, text_of(F.col(f"`{ids_col}`")))


def encoding_report(docs: DataFrame, params: FstParams = FstParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 and whether decoding gives the text again."""
    key = _key(params)

    @F.pandas_udf("n_ids long, ids_crc32 long, round_trip boolean")
    def report(texts):
        import pandas as pd

        fst = _worker(key)
        out = []
        for t in texts:
            ids = fst.encode(t or "")
            out.append((len(ids), zlib.crc32(ids.tobytes()), fst.decode(ids.tolist()) == (t or "")))
        return pd.DataFrame(out, columns=["n_ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.withColumn("r", report("text")).select("doc_id", "r.*")
