"""Line deduplication over content-defined chunks of lines.

Lines without a word are passed over. A rolling hash over the hashes of the
last lines decides where a chunk ends, so an insertion moves only the
boundaries near it; a line of ``long_words`` is always a chunk. From every
chunk on so many chunks are taken together that they have ``chunk_words``. Such
groups that occur more than once anywhere, found by counting their digests, are
held against the occurrence in the smallest document: bytes are compared, and
the match is extended at both ends over lines of equal 128-bit hashes: above
up to the chunk before and below to the end of the group that follows, and in
both directions over the lines whose boundaries may still depend on what lies
outside the match. Two documents that share a passage so lose all of its whole
lines if a group lies within it. Matches that touch make a run; a run of
``least_words`` over several lines, or of ``line_words`` in a single one, is
removed, and the wordless lines within it. A removed line always has an equal
one in a smaller document, or further up in its own, so one copy stays.

Defined cases: null text stays null and has no chunks; empty text stays empty;
runs of only blank lines are never removed; within a document a repeated run
stays once, the first. Documents are ordered by id, null ids last, then by a
hash of their text; rows of equal id and text are one document and share its
fate, so repeated rows keep their text together. Ids that are no whole numbers
are an error, and so are columns named ``_llm_...``. An empty table gives an
empty result. Texts are whole whatever their length, one at a time in a task. Other
columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.llm.tables import hot_join, hot_keys, reserved, written

#: Stands for a null id in orderings: it comes last.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class LineParams:
    """``window`` lines decide a boundary, one in ``divisor`` windows is one;
    ``long_words``: a line of so many words is a chunk of its own; a chunk has
    ``most_lines`` at most; ``chunk_words``: chunks are taken together until
    they have so many words; ``least_words`` and ``line_words``: the least run
    that is removed, of several lines and of one."""

    window: int = 2
    divisor: int = 2
    long_words: int = 8
    most_lines: int = 64
    chunk_words: int = 5
    least_words: int = 20
    line_words: int = 50


def worded(text: bytes) -> tuple[list[bytes], list[int], list[int], list[bytes]]:
    """The lines that have a word, their numbers of words, their places among
    all lines, and all lines."""
    every = text.split(b"\n")
    counts = [len(x.split()) for x in every]
    at = [i for i, n in enumerate(counts) if n]
    return [every[i] for i in at], [counts[i] for i in at], at, every


def chunks(lines: list[bytes], words: list[int], params: LineParams) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk, in order."""
    import xxhash

    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    base, mask = 0x100000001B3, (1 << 64) - 1
    out, first, rolled = [], 0, 0
    drop = pow(base, params.window, 1 << 64)
    for i, h in enumerate(hashes):
        rolled = (rolled * base + h) & mask
        if i >= params.window:
            rolled = (rolled - hashes[i - params.window] * drop) & mask
        if words[i] >= params.long_words:
            if i > first:
                out.append((first, i))
            out.append((i, i + 1))
            first = i + 1
        elif ((rolled * 0x9E3779B97F4A7C15 & mask) >> 40) % params.divisor == 0 or i + 1 - first >= params.most_lines:
            out.append((first, i + 1))
            first = i + 1
    if first < len(lines):
        out.append((first, len(lines)))
    return out


def groups(parts: list[tuple[int, int]], words: list[int], params: LineParams) -> list[int]:
    """For each chunk the last one that it needs to have ``chunk_words``; the
    number of chunks where there are not enough."""
    sizes = [sum(words[a:b]) for a, b in parts]
    out, last, total = [], -1, 0
    for i, size in enumerate(sizes):
        while total < params.chunk_words and last + 1 < len(parts):
            last += 1
            total += sizes[last]
        out.append(last if total >= params.chunk_words else len(parts))
        total -= size
    return out


def digest(data: bytes) -> bytes:
    """24 bytes of two hashes: equal digests are equal chunks for counting."""
    import xxhash

    return xxhash.xxh3_128_digest(data) + xxhash.xxh64_digest(data, 7)


def _candidates(text: bytes, params: LineParams):
    """(first line, line after, body, above, below) of a text's groups, in
    places among its lines with words: above, nearest first, and below are the
    lines that a match may be extended over."""
    lines, words, *_ = worded(text)
    parts = chunks(lines, words, params)
    last, more = groups(parts, words, params), params.window - 1
    for i, end in enumerate(last):
        if end == len(parts):
            break  # all further ones have too few words as well
        a, b = parts[i][0], parts[end][1]
        over = parts[min(last[end + 1], len(parts) - 1)][1] if end + 1 < len(parts) else b
        yield a, b, b"\n".join(lines[a:b]), lines[max(parts[max(0, i - 1)][0] - more, 0) : a][::-1], lines[b : over + more]


#: A task hands rows on once they hold so many bytes.
FLUSH = 8_000_000


def _counted(params: LineParams):
    """Digests of groups of chunks, for counting."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                out += [digest(body) for _, _, body, _, _ in _candidates(text.as_py() or b"", params)]
                if len(out) * 40 > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["digest"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["digest"])

    return run


OCCURRENCE = "id long, h long, digest binary, first long, after long, body binary, above binary, below binary"


def _occurrences(params: LineParams):
    """Groups with their bytes and the 16-byte hashes of the lines above
    (nearest first) and below them."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in OCCURRENCE.split(", ")]

    def run(batches):
        import xxhash

        def hashed(lines):
            return b"".join([xxhash.xxh3_128_digest(x) for x in lines])

        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for id_, h, text in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(), batch.column("text")):
                for a, b, body, up, down in _candidates(text.as_py() or b"", params):
                    row = (id_, h, digest(body), a, b, body, hashed(up), hashed(down))
                    for c, v in zip(out, row):
                        c.append(v)
                    held += len(body) + len(row[6]) + len(row[7]) + 60
                    if held > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                        out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def _common(one: bytes, two: bytes) -> int:
    """How many 16-byte hashes two lists have in common from their start."""
    n = 0
    while n < min(len(one), len(two)) and one[n : n + 16] == two[n : n + 16]:
        n += 16
    return n // 16


def repeated_lines(rows: DataFrame, params: LineParams) -> DataFrame:
    """(id, h, first, after): stretches of lines that a smaller document, or an
    earlier place in the same one, holds too. ``rows``: id, h, text.

    Places are those among the lines with words. Digests are counted first, so
    only the bytes of groups that repeat move.
    A digest's smallest occurrence is found by partial minima, and the others
    are held against it, hot digests in parts.
    """
    counted = rows.select("text").mapInArrow(_counted(params), "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    repeated = written(counted.where("n > 1"), "lines-repeated")
    hot = hot_keys(repeated, "digest")
    found = written(hot_join(rows.mapInArrow(_occurrences(params), OCCURRENCE), repeated.select("digest"), hot, "digest"), "lines-found")
    where = F.struct("id", "h", "first")
    keeper = found.groupBy("digest").agg(F.min_by(F.struct(where.alias("where"), "body", "above", "below"), where).alias("keeper"))
    both = hot_join(found, keeper, hot, "digest").where(where > F.col("keeper.where"))

    def compare(batches):
        names = ["id", "h", "first", "after"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            keepers = batch.column("keeper")
            columns = [batch.column(c).to_pylist() for c in ("id", "h", "first", "after", "body", "above", "below")]
            for i, (id_, h, first, after, body, above, below) in enumerate(zip(*columns)):
                other = keepers[i].as_py()
                if body == other["body"]:
                    for c, v in zip(out, (id_, h, first - _common(above, other["above"]), after + _common(below, other["below"]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return both.mapInArrow(compare, "id long, h long, first long, after long")


def removed(words: list[int], stretches: list[tuple[int, int]], params: LineParams) -> list[tuple[int, int]]:
    """The runs to remove: stretches that touch, long enough together. Places
    are those among the lines that have ``words``."""
    runs: list[list[int]] = []
    for a, b in sorted(stretches):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs if sum(words[a:b]) >= (params.least_words if b - a > 1 else params.line_words)]


def _with_removals(docs: DataFrame, params: LineParams, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _llm_out: text, lines_removed, runs_removed."""
    reserved(docs)
    body = F.col(f"`{text_col}`").cast("binary")
    keys = {"id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)), "h": F.xxhash64(body)}
    rows = docs.select(*[c.alias(n) for n, c in keys.items()], body.alias("text"))
    # copies of a row have the same stretches; then a list is no longer than its document has chunks
    gone = repeated_lines(rows, params).distinct().groupBy("id", "h").agg(F.flatten(F.collect_list(F.array("first", "after"))).alias("_llm_gone"))
    gone = written(gone.select(F.struct("id", "h").alias("_llm_key"), "_llm_gone"), "lines-gone")

    @F.pandas_udf("text string, lines_removed long, runs_removed long")
    def apply(texts, stretches):
        import pandas as pd

        out = []
        for text, some in zip(texts, stretches):
            if text is None or some is None:
                out.append((None if text is None else text.decode("utf-8", "replace"), 0, 0))
                continue
            _, words, at, every = worded(text)
            runs = removed(words, list(zip(some[::2], some[1::2])), params)
            before = len(every)
            for a, b in reversed(runs):
                del every[at[a] : at[b - 1] + 1]
            out.append((b"\n".join(every).decode("utf-8", "replace"), before - len(every), len(runs)))
        return pd.DataFrame(out, columns=["text", "lines_removed", "runs_removed"])

    keyed = docs.withColumn("_llm_key", F.struct(*[c.alias(n) for n, c in keys.items()]))
    counts = written(keyed.groupBy("_llm_key").agg(F.count("*").alias("n")), "lines-documents")
    joined = hot_join(keyed, gone, hot_keys(counts, "_llm_key"), "_llm_key", "left")
    return joined.withColumn("_llm_out", apply(body, F.col("_llm_gone")))


def line_dedup(docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (a table of files) with its texts deduplicated; columns as they were."""
    out = _with_removals(docs, params, id_col, text_col)
    return out.select(*[F.col("_llm_out.text").alias(n) if n == text_col else F.col(f"`{n}`") for n in docs.columns])


def line_report(docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, lines_removed, runs_removed per row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _with_removals(rows, params, "doc_id", "text").select("doc_id", "_llm_out.*")
