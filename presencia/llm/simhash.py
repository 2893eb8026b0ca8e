"""SimHash near-duplicates by a generalised pigeonhole index.

Bits that go together are put in one part, every part gets its own radius
(minus one: not probed) with the radii adding up to ``distance - parts + 1``,
and dynamic programming picks radii and the number of parts that promise the
fewest candidates. Two fingerprints within ``distance`` bits are then within
its radius in at least one part, so probing the parts loses no link.

Defined cases: null or wordless text has fingerprint zero and links like any
other; repeated rows and exact copies share one fingerprint; a null doc_id
takes part, and a component's id is the smallest doc_id that is not null (null
if all are). Ids that are no whole numbers are an error. An empty table gives an
empty result. Other columns of the input are not looked at, so their names
can't clash; ``near_dedup``, which carries them, refuses ``_llm_...``.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presencia.llm.components import connected_components
from presencia.llm.tables import hot_join, hot_keys, reserved, written


@dataclass(frozen=True)
class SimHashParams:
    """``sample_rows`` bounds what the index is fitted on (bit correlations
    and candidate estimates); every fingerprint is indexed whatever it holds.
    ``block_rows`` bounds a bucket that one task compares."""

    shingle_words: int = 3
    seed: int = 42
    distance: int = 3
    sample_rows: int = 20_000
    block_rows: int = 2_048
    refinements: int = 2


def majority(hashed: np.ndarray) -> int:
    """A signed long whose bits are set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 65_536):
        part = hashed[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashed), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: bytes | None, words_per: int, seed: int) -> int:
    """64 bits of the majority vote of the shingles' XXH64, as a signed long."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per:
        hashed = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - words_per + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashed = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(starts, ends[words_per - 1 :].tolist())), np.uint64, len(starts)
        )
    return majority(hashed)


def with_fingerprints(docs: DataFrame, text: str, params: SimHashParams, out: str) -> DataFrame:
    """``docs`` with a long column ``out``; texts go to Python as Arrow batches."""
    words_per, seed = params.shingle_words, params.seed

    @F.pandas_udf("long")
    def prints(texts):
        import pandas as pd

        return pd.Series([fingerprint(t, words_per, seed) for t in texts], dtype="int64")

    return docs.withColumn(out, prints(F.col(text).cast("binary")))


# ---- the index ---------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    radius: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def group_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Greedy grouping: each part grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    if len(bits) > 1:
        bits -= bits.mean(axis=0)
        size = np.sqrt((bits**2).sum(axis=0))
        size[size == 0] = 1
        close = np.abs(bits.T @ bits) / np.outer(size, size)
    else:
        close = np.zeros((64, 64))
    left, out = set(range(64)), []
    for i in range(parts):
        width = 64 // parts + (i < 64 % parts)
        first = max(sorted(left), key=lambda b: close[b, sorted(left)].sum())
        group = [first]
        left.discard(first)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: close[b, group].sum())
            group.append(best)
            left.discard(best)
        out.append(tuple(sorted(group)))
    return out


#: Moving one key costs about as much as comparing so many pairs.
KEY_COST = 100.0


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, j) for j in range(radius + 1))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Radii from -1 up that add up to ``total`` at the least cost.

    ``costs[i][t + 1]`` is the cost of part i at radius t; dynamic programming
    over the parts and the sum so far.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, radii) in best.items():
            for t, c in enumerate(row, start=-1):
                at = (cost + c, radii + [t])
                if so_far + t not in nxt or at < nxt[so_far + t]:
                    nxt[so_far + t] = at
        best = nxt
    return best[total]


def fit_index(sample: np.ndarray, rows: int, distance: int) -> list[Part]:
    """Parts and radii for ``rows`` fingerprints, judged on the sample.

    Costs are estimated keys to move plus estimated candidate pairs to verify.
    """
    sample = np.unique(sample.astype(np.uint64))
    some = sample[np.random.default_rng(7).permutation(len(sample))[:3_000]]
    best = None
    for m in range(1, distance + 3):
        groups = group_bits(sample, m)
        costs = []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            values = some & mask
            tally = np.zeros(65, np.int64)
            for at in range(0, len(values), 500):
                apart = np.bitwise_count(values[at : at + 500, None] ^ values[None, :])
                tally += np.bincount(apart.ravel(), minlength=65)
            tally[0] -= len(values)
            within = np.cumsum(tally) / max(1, len(values) * (len(values) - 1))
            row = [0.0]
            for t in range(distance + 1):
                ball = _ball(len(bits), t)
                share = max(within[t], ball / 2.0 ** len(bits))
                row.append(rows * ball * KEY_COST + float(rows) * rows * share / 2)
            costs.append(row)
        cost, radii = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [Part(b, r) for b, r in zip(groups, radii) if r >= 0])
    return best[1]


def _keys(part: Part, fp: Column) -> Column:
    """The part's value and, for a radius, all values around it."""
    flips = [0]
    for n in range(1, part.radius + 1):
        flips += [sum(1 << b for b in some) for some in itertools.combinations(part.bits, n)]
    value = fp.bitwiseAND(F.lit(_signed(part.mask)))
    if len(flips) == 1:
        return F.array(value)
    return F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: value.bitwiseXOR(x))


def _counted(rows: DataFrame) -> DataFrame:
    """Bucket sizes beside the rows, hot buckets in parts; buckets that can
    hold no pair go. ``rows`` are worked out of files row by row."""
    n = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    return hot_join(rows, n, hot_keys(n, "bucket"), "bucket")


def _close_runs(distance: int):
    """Links inside runs of equal bucket, as a star per connected run part."""

    def one(bucket, fp):
        n = len(fp)
        root = np.arange(n)
        edge = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1])])
        end = np.repeat(np.r_[edge[1:], n], np.diff(np.r_[edge, n]))
        at = np.arange(n)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        step = 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                break
            near = np.bitwise_count(fp[at] ^ fp[at + step]) <= distance
            a, b = at[near], at[near] + step
            differ = root[a] != root[b]
            for i, j in zip(a[differ].tolist(), b[differ].tolist()):
                i, j = find(i), find(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
            if differ.any():
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root[:] = up
            step += 1
        moved = np.flatnonzero(root != np.arange(n))
        return fp[moved], fp[root[moved]]

    def run(batches):
        rest = None
        for batch in batches:
            # batches are bounded, and so is a bucket: what is carried on is one bucket
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = rest["bucket"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            if last:
                yield from pack(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and len(rest):
            yield from pack(rest)

    def pack(table):
        fp = table["fp"].to_numpy().view(np.uint64)
        a, b = one(table["bucket"].to_numpy(), fp)
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"]
            )

    return run


def links(prints: DataFrame, params: SimHashParams) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect exactly
    what pairs within the distance connect. A bucket emits a spanning star, not
    its pairs. Buckets above ``block_rows`` are cut finer by the pigeonhole on
    the remaining bits, and at last into pairs of blocks."""
    total = prints.count()
    sample = np.array(
        [r[0] for r in prints.orderBy(F.xxhash64("fp")).limit(params.sample_rows).select("fp").collect()], dtype=np.int64
    )
    spark = prints.sparkSession
    if total < 2:
        return spark.createDataFrame([], "u long, v long")
    index = fit_index(sample.view(np.uint64), total, params.distance)
    rows = None
    for i, part in enumerate(index):
        some = prints.select(F.lit(_signed(part.mask)).alias("mask"), F.lit(i).alias("part"), "fp", F.explode(_keys(part, F.col("fp"))).alias("value"))
        some = some.select(F.xxhash64("part", "value").alias("bucket"), "mask", "fp")
        rows = some if rows is None else rows.unionByName(some)
    rows = _counted(rows)
    for level in range(params.refinements + 1):
        rows = written(rows, f"simhash-buckets-{level}")
        fits = rows.where(F.col("n") <= params.block_rows).select("bucket", "fp")
        ready = fits if level == 0 else ready.unionByName(fits)
        large = rows.where(F.col("n") > params.block_rows)
        if large.isEmpty():
            large = None
            break
        if level < params.refinements:
            # the distance that is left lies in the bits outside the mask: cut
            # those into distance + 1 classes; one of them agrees in full
            classes = params.distance + 1
            finer = [F.lit(_signed(sum(1 << b for b in range(64) if (b // (level + 1) + b % (level + 1)) % classes == c))) for c in range(classes)]
            large = large.select("bucket", "mask", "fp", F.explode(F.array(*finer)).alias("class"))
            free = F.col("class").bitwiseAND(F.bitwise_not("mask"))
            large = large.select(
                F.xxhash64("bucket", "class", F.col("fp").bitwiseAND(free)).alias("bucket"),
                F.col("mask").bitwiseOR(free).alias("mask"), "fp",
            )
            rows = _counted(large)
    if large is not None:
        blocks = F.ceil(F.col("n") / F.lit(params.block_rows // 2)).cast("long")
        mine = F.pmod(F.xxhash64("fp", F.lit(99)), blocks)
        pairs = large.select("bucket", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        ready = ready.unionByName(
            pairs.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp")
        )
    dealt = ready.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_close_runs(params.distance), "u long, v long")


def near_duplicate_components(rows: DataFrame, params: SimHashParams) -> DataFrame:
    """(fp, component) for every distinct fingerprint of ``rows`` (column fp)."""
    prints = written(rows.select("fp").distinct(), "simhash-prints")
    found = connected_components(links(prints, params))
    return prints.join(found, prints.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, params: SimHashParams = SimHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(with_fingerprints(rows, "text", params, "fp").select("doc_id", "fp"), "simhash-rows")
    comps = near_duplicate_components(rows, params)
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-least").join(comps, "fp")
    least = written(least, "simhash-components")
    ids = least.groupBy("component").agg(F.min("low").alias("component_id"))
    by_print = least.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return hot_join(rows, by_print, hot_keys(least.select("fp", "n"), "fp"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, params: SimHashParams = SimHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (nulls
    last, repeated rows once). Columns and texts are those of ``docs``."""
    names = reserved(docs).columns
    keyed = docs.withColumn("_llm_row", F.monotonically_increasing_id())
    keyed = written(with_fingerprints(keyed, text_col, params, "_llm_fp"), "simhash-docs")
    rows = keyed.select(F.col(id_col).alias("doc_id"), F.col("_llm_row").alias("row"), F.col("_llm_fp").alias("fp"))
    comps = near_duplicate_components(rows, params)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.groupBy("fp").agg(F.min(order).alias("first")).join(comps, "fp")
    stays = first.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_llm_row"))
    return keyed.join(stays, "_llm_row", "left_semi").select(*[F.col(f"`{n}`") for n in names])
