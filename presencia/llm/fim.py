"""Fill-in-middle: texts are cut at two ranks of their units and put in another
order.

A unit is a run of ASCII letters or any other single code point. Where a rank
lies in the text is asked of an indexable skip list over the units: each lane's
links carry how many units and how many code points they pass, and a descent
from the top lane adds them up until the rank is reached. Ranks and forms
follow from a hash of the document's id, so every run gives the same.

Defined cases: null text counts as empty; empty texts, and texts that hold one
of the marks, stay as they are (``plain``); a null id counts as the empty one;
both ranks may be equal, which leaves the middle empty. Repeated rows are cut
alike. An empty table gives an empty result. Texts are whole whatever their
length: the list takes some tens of bytes a unit, one text at a time. Other columns are
carried by ``fill_in_middle``, which refuses the name ``fim`` and ``_llm_...``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presencia.llm.tables import reserved

CUT = "struct<n:bigint,first:bigint,second:bigint>"


@dataclass(frozen=True)
class FimParams:
    """``rate`` of a hundred texts are cut, ``spm`` of a hundred of these begin
    with the suffix; marks stand before prefix, suffix and middle."""

    rate: int = 90
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1:"


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit, in order."""
    if text.isascii():
        points = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower = points | 32
    letter = (lower >= 97) & (lower <= 122) & (points < 128)
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.diff(np.flatnonzero(begins), append=len(points))


class SkipList:
    """A skip list that is built once and asked by rank.

    Lane 0 links all units; one in four nodes of a lane, by a hash of its rank,
    is also in the next. ``units`` and ``points`` are what a link passes,
    ``down`` is the node's place in the lane below.
    """

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        mixed = np.arange(self.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed >>= np.uint64(8)
        self.units, self.points, self.down = [np.ones(self.n, np.int64)], [np.asarray(widths, np.int64)], [np.zeros(0, np.int64)]
        lane = 1
        while len(self.units[-1]) > 4:
            up = (mixed & np.uint64(3)) == 0
            up[0] = True  # the head is in every lane
            place = np.flatnonzero(up)
            if len(place) == len(mixed):
                break
            self.units.append(np.add.reduceat(self.units[-1], place))
            self.points.append(np.add.reduceat(self.points[-1], place))
            self.down.append(place)
            mixed = mixed[place] >> np.uint64(2)
            lane += 1

    def descend(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them for rank n."""
        node = units = points = 0
        for lane in range(len(self.units) - 1, -1, -1):
            passes, widths = self.units[lane], self.points[lane]
            while node < len(passes) and units + passes[node] <= rank:
                units += int(passes[node])
                points += int(widths[node])
                node += 1
            if units == rank:
                return points
            if lane:
                node = int(self.down[lane][node])
        raise IndexError(f"rank {rank} is outside of {self.n} units")


def cut(text: str, a: int | None, b: int | None) -> tuple[int, int | None, int | None]:
    """Units, and the code points before the smaller and the larger rank that
    ``a`` and ``b`` give modulo the number of ranks; None without them."""
    widths = unit_widths(text)
    if a is None or b is None:
        return len(widths), None, None
    ranks = sorted((int(a) % (len(widths) + 1), int(b) % (len(widths) + 1)))
    index = SkipList(widths)
    return len(widths), index.descend(ranks[0]), index.descend(ranks[1])


def _hash(id_: Column, i: int, params: FimParams) -> Column:
    """The i-th group of eight hex digits of the id's SHA-256, as a number."""
    text = F.concat(F.lit(params.seed), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 8 * i - 7, 8), 16, 10).cast("long")


def _cuts(texts: Column, first: Column, second: Column) -> Column:
    @F.pandas_udf(CUT)
    def cuts(texts, first, second):
        import pandas as pd

        rows = [cut(t, None if pd.isna(a) else a, None if pd.isna(b) else b) for t, a, b in zip(texts, first, second)]
        return pd.DataFrame({k: pd.array([r[i] for r in rows], "Int64") for i, k in enumerate(("n", "first", "second"))})

    return cuts(texts, first, second)


def fill_in_middle(docs: DataFrame, params: FimParams = FimParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fim``: n, form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and the output text."""
    reserved(docs, "fim")
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marks = (params.prefix, params.suffix, params.middle)
    plain = (text == "") | (_hash(id_, 3, params) % 100 >= params.rate)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(_hash(id_, 4, params) % 100 < params.spm, "spm").otherwise("psm")
    rows = docs.withColumn("_llm_form", form)
    moved = F.col("_llm_form") != "plain"
    rows = rows.withColumn("_llm_cut", _cuts(text, F.when(moved, _hash(id_, 1, params)), F.when(moved, _hash(id_, 2, params))))
    first, second = F.col("_llm_cut.first").cast("int"), F.col("_llm_cut.second").cast("int")
    p, m, s = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.lit((1 << 31) - 1))
    a, b, c = (F.lit(x) for x in marks)
    out = F.when(~moved, text).when(F.col("_llm_form") == "psm", F.concat(a, p, b, s, c, m)).otherwise(F.concat(b, s, a, p, c, m))
    fim = F.struct(
        F.col("_llm_cut.n").alias("n"), F.col("_llm_form").alias("form"), F.col("_llm_cut.first").alias("prefix_chars"),
        (F.col("_llm_cut.second") - F.col("_llm_cut.first")).alias("middle_chars"), out.alias("output"),
    )
    return rows.withColumn("fim", fim).drop("_llm_form", "_llm_cut")


def restored(output: Column, form: Column, params: FimParams = FimParams()) -> Column:
    """The text out of an output and its form. Marks are found where they
    stand: a text that holds one was left plain."""
    a, b, c = params.prefix, params.suffix, params.middle

    def between(lead: str, mark: str) -> tuple[Column, Column]:
        head = F.substring(F.substring_index(output, mark, 1), len(lead) + 1, (1 << 31) - 1)
        return head, F.substring_index(output, mark, -1)

    p1, rest1 = between(a, b)
    s2, rest2 = between(b, a)
    psm = F.concat(p1, F.substring_index(rest1, c, -1), F.substring_index(rest1, c, 1))
    spm = F.concat(F.substring_index(rest2, c, 1), F.substring_index(rest2, c, -1), s2)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fim_report(docs: DataFrame, params: FimParams = FimParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output
    and of the text rebuilt from it."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    f = fill_in_middle(rows, params, "doc_id", "text").select("doc_id", "fim.*")
    digests = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"), params)}
    return f.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c.cast("binary"), 256).alias(k) for k, c in digests.items()])
