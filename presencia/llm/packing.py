"""Sum-of-squares packing of tokenised documents into training sequences.

Each packer keeps, per residual gap, how many open sequences have it, and puts
the next item where the sum of the squared counts becomes smallest. Items are
dealt over many packers of bounded size; the items of sequences that stay
underfull anywhere then meet and are packed once more, if that saves any.

Defined cases: null text is packed as empty (its end token only); a document
longer than a sequence is cut into full pieces and a rest; repeated rows are
packed as often as they occur; null ids are kept; an empty table gives an
empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.llm.tables import written


@dataclass(frozen=True)
class PackParams:
    """``packer_items`` is what one task packs; ``cache_bytes`` bounds a
    worker's memory of words it has tokenised, beyond those of one text."""

    capacity: int = 4096
    end_id: int = 1
    tokenizer: str | None = None
    packer_items: int = 65_536
    cache_bytes: int = 200_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file, which is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of a text by the tokenizer, word by word.

    The tokenizer splits at white space and normalises each side on its own, so
    a text's ids are those of its words in order. A word's ids come from the
    tokenizer itself, once per worker while the word stays remembered. A full
    stop or comma after an ASCII letter is always a token of its own. The
    tokenizer composes letters before it lowers them, so only words of ASCII
    alone are lowered here.
    """

    #: What an entry takes beyond its word and ids: two objects and their slots.
    ENTRY_BYTES = 170

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.held = most, 0
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + self.ENTRY_BYTES

    def learn(self, words: list[bytes]) -> None:
        plain, other = [], []
        for w in words:
            t = w.decode("utf-8", "replace")
            (plain if t.isalpha() and max(t) < "\u0130" else other).append((w, t))
        # words of letters alone are one stretch each, which ends in a token
        # that is marked as a word's end: many of them go through together
        for at in range(0, len(plain), 1_024):
            some = plain[at : at + 1_024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in some])], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(some):
                other += some
                continue
            data, first = ids.tobytes(), 0
            for (w, _), stop in zip(some, (4 * stops).tolist()):
                self._keep(w, data[first:stop])
                first = stop
        # a slice at a time: one long text must not hold all its encodings at once
        for at in range(0, len(other), 4_096):
            some = other[at : at + 4_096]
            coded = self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)
            for (w, _), e in zip(some, coded):
                self._keep(w, np.array(e.ids, dtype="<u4").tobytes())

    def ids(self, text: bytes) -> bytes:
        known = self.known
        # a text with other letters is looked up as it stands; its words are remembered in both forms
        words = text.lower().split() if text.isascii() else text.split()
        found = list(map(known.get, words))
        if None not in found:
            return b"".join(found)
        if self.held > self.most:
            known.clear()
            self.held = 0
        raw = {w for w, ids in zip(words, found) if ids is None}
        lowered = {w: w.lower() if w.isascii() else w for w in raw}
        new = {w for w in lowered.values() if w not in known}
        ends = {w for w in new if len(w) > 1 and w[-1] in b".," and 97 <= w[-2] <= 122}
        need = {w[:-1] for w in ends} | {b".", b","} | (new - ends)
        self.learn([w for w in need if w not in known])
        for w in ends:
            self._keep(w, known[w[:-1]] + known[w[-1:]])
        for w, low in lowered.items():
            if w != low:
                self._keep(w, known[low])
        return b"".join([known[w] if ids is None else ids for w, ids in zip(words, found)])


_workers: dict[tuple, WordIds] = {}


def worker_ids(path: str, most: int) -> WordIds:
    """The Python worker's tokenizer, kept between its tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, most) not in _workers:
        _workers[path, most] = WordIds(path, most)
    return _workers[path, most]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, params: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece of at most ``capacity`` ids; ``with_ids`` adds the ids."""
    path, most, cap, end = params.tokenizer or tokenizer_path(), params.cache_bytes, params.capacity, params.end_id
    tail = np.array([end], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches):
        coder = worker_ids(path, most)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.ids(text.as_py() or b"") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * cap)):
                    part = ids[at : at + 4 * cap]
                    row = [doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)]
                    if with_ids:
                        row.append(np.frombuffer(part, "<u4").astype(np.int32))
                        held += len(part)
                    for c, v in zip(out, row):
                        c.append(v)
                if held > 8_000_000:
                    yield batch_of(out)
                    out, held = [[] for _ in names], 0
            yield batch_of(out)

    def batch_of(out):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


class SumOfSquares:
    """One packer: counts of open bins per gap, and the bins themselves."""

    def __init__(self, capacity: int):
        self.cap = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item; ties go to the tighter bin, then to an
        open one before a new one."""
        cap, count = self.cap, self.count
        if size < cap:
            here = count[size:]
            cost = 2 * (count[: cap - size + 1] - here) + 2
            cost[0] -= 1 + 2 * count[0]
            cost[here == 0] = 1 << 60
            cost[cap - size] = 1 << 60
            gap = int(cost.argmin()) + size
            if cost[gap - size] <= 2 * count[cap - size] + 1:
                name = self.open[gap].pop()
                self.count[gap] -= 1
                self._keep(gap - size, name)
                return name, cap - gap
        name = self.bins
        self.bins += 1
        self._keep(cap - size, name)
        return name, 0

    def _keep(self, gap: int, name: int) -> None:
        if gap:
            self.count[gap] += 1
            self.open.setdefault(gap, []).append(name)


def _packed(items: DataFrame, params: PackParams, order: list) -> DataFrame:
    """``items`` (a written table with a long ``length``) plus packer, bin and
    offset. Rows are dealt by their place in the table, so that equal ones
    spread; a packer that was dealt far more than its share packs it in runs."""
    from pyspark.sql import types as T

    capacity, most = params.capacity, 2 * params.packer_items
    packers = max(1, -(-items.count() // params.packer_items))
    placed_at = items.withColumn("_llm_at", F.monotonically_increasing_id())
    dealt = placed_at.repartition(packers, F.xxhash64("_llm_at")).sortWithinPartitions(*order).drop("_llm_at")
    out = T.StructType(items.schema.fields + [T.StructField("packer", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType())])

    def run_of(held, bins, me):
        table = pa.Table.from_batches(held).combine_chunks()
        sizes, best = table.column("length").to_pylist(), None
        # falling sizes suit few items, a mixed order suits many: the better one counts
        for order in (range(len(sizes)), np.random.default_rng(1).permutation(len(sizes)).tolist()):
            packer, placed = SumOfSquares(capacity), [(0, 0)] * len(sizes)
            for i in order:
                placed[i] = packer.place(sizes[i])
            if best is None or packer.bins < best[0]:
                best = packer.bins, placed
        for name, values in (("packer", [me] * len(sizes)), ("bin", [bins + b for b, _ in best[1]]), ("offset", [o for _, o in best[1]])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table, bins + best[0]

    def pack(batches):
        from pyspark import TaskContext

        me, bins, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= most:
                table, bins = run_of(held, bins, me)
                yield from table.to_batches(max_chunksize=10_000)
                held, n = [], 0
        if held:
            yield from run_of(held, bins, me)[0].to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(pack, out)


def pack(items: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``items`` (a written table of any columns that can be sorted, among them
    a long ``length`` of 1 to capacity) with sequence_id and offset added."""
    names = items.columns
    if clash := {"packer", "bin", "offset", "sequence_id"} & set(names):
        raise ValueError(f"items hold columns that packing adds: {sorted(clash)}")
    order = [F.desc("length"), *[F.asc(c) for c in names]]
    first = written(_packed(items, params, order), "packing")
    fill = first.groupBy("packer", "bin").agg((F.sum("length") < params.capacity).alias("open"))
    marked = written(first.join(fill, ["packer", "bin"]), "packing-marked")
    loose = marked.where("open").select(*names)
    again = written(_packed(loose, params, order), "packing-again")

    def named(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*names, (F.shiftleft("packer", 32) * 2 + F.col("bin") * 2 + kind).alias("sequence_id"), "offset")

    before = fill.where("open").count()
    if again.select("packer", "bin").distinct().count() >= before:
        return named(marked, 0)
    return named(marked.where("NOT open"), 0).union(named(again, 1))


def pack_documents(docs: DataFrame, params: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    return pack(written(token_pieces(docs, params, id_col, text_col), "pieces"), params)


def packed_sequences(docs: DataFrame, params: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, each at most
    ``capacity`` ids long."""
    pieces = pack(written(token_pieces(docs, params, id_col, text_col, with_ids=True), "pieces-ids"), params)
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
