"""Shared evidence: knockoff sums drawn from pools of contributions.

Draws come from a counter-based generator: draw i of iteration k of a unit,
genome and stratum is a hash of these and the seed, so any task can make any
draw, no result depends on the partitioning, and more iterations continue what
fewer have begun. A draw is a place in the stratum's pool, a histogram of
distinct contributions with their cumulative counts; pools are cut into pages,
and a task adds up the draws of some genomes that fall on one page. The partial
sums of a genome's pages are added up by an aggregate. A pool's counts must
stay under 2**32. Ties count as at least as large.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presencia.operators.ranking import running_sum, with_rank
from presencia.tables import written

KEYS = ["analysis_unit_id", "genome_id"]
STRATUM = ["deg_bin", "len_bin"]
#: Distinct contributions on a page, draws a group makes, draws at a time, a
#: genome's draws in one sum, cells of a pool's table.
PAGE, WORK, BLOCK, RUN, CELLS = 1 << 20, 1 << 26, 1 << 17, 64, 1 << 20
SUMS = "analysis_unit_id string, genome_id string, page long, first int, sums binary"
NULL = "pvalue_shared double, null_mean double, null_sd double, null_q95 double, null_q99 double, z_shared double"
LEAST_ITERATIONS = 50
# Multipliers of a 32-bit mixing function.
MIX = (0x21F0AAAD, 0xD35A2D97)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers that spreads close ones."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(MIX[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(MIX[1])
    x ^= x >> np.uint32(15)
    return x


def _places(ks: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    out = mixed(ks ^ at).astype(np.uint64)
    out *= np.uint64(total)
    out >>= np.uint64(32)
    return out.view(np.int64)


def draws(k0: int, k1: int, c: int, total: int, first: int, last: int) -> np.ndarray:
    """Places in a pool of ``total``: a row an iteration, a column a draw."""
    ks = mixed(np.arange(first, last, dtype=np.uint32) + np.uint32(k0))
    at = mixed(np.arange(c, dtype=np.uint32) + np.uint32(k1))
    return _places(ks[:, None], at[None, :], total)


def _key(seed: int, i: int) -> Column:
    """The i-th group of eight hex digits of the hash of seed and stratum."""
    text = F.concat_ws("|", F.lit(str(seed)), *KEYS, *[F.col(c).cast("string") for c in STRATUM])
    return F.conv(F.substring(F.md5(text), 8 * i + 1, 8), 16, 10).cast("long")


def pool_pages(pools: DataFrame) -> DataFrame:
    """unit, deg_bin, len_bin, contribution, n, low, total, page: the places
    from ``low`` on of a stratum's pool are this contribution's. Written."""
    unit = KEYS[0]
    rows = pools.select(unit, *[F.col(f"stratum.{c}").alias(c) for c in STRATUM], "contribution", "n")
    ranked = with_rank(rows, unit, [F.col(c) for c in (*STRATUM, "contribution")], "_rank", "pool-ranks")
    summed = running_sum(ranked, unit, "_rank", "n", "_upto").drop("_upto_total")
    whole = summed.groupBy(unit, *STRATUM).agg(F.sum("n").alias("total"), F.min(F.col("_upto") - F.col("n")).alias("_base"))
    out = summed.join(whole, [unit, *STRATUM]).withColumn("low", F.col("_upto") - F.col("n") - F.col("_base"))
    page = F.floor((F.col("_rank") - 1) / F.lit(PAGE)).cast("long")
    return written(out.select(unit, *STRATUM, "contribution", "n", "low", "total", page.alias("page")), "pool-pages")


class _Pool:
    """A stratum's contributions on one page, by their places."""

    def __init__(self, part):
        part = part.sort_values("low")
        self.low, n = part["low"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        self.values, self.total = part["contribution"].to_numpy(float), int(part["total"].iloc[0])
        self.start, self.end = int(self.low[0]), int(self.low[-1] + n[-1])
        self.whole = self.end - self.start == self.total
        # few places: one cell each; many: a cell for a run of them, from which the value is near
        self.shift = max(0, (self.end - self.start - 1).bit_length() - CELLS.bit_length() + 1)
        if self.shift:
            self.guide = np.searchsorted(self.low, self.start + (np.arange((self.end - self.start >> self.shift) + 1) << self.shift), "right").astype(np.int32) - np.int32(1)
            self.next = np.append(self.low[1:], self.end)
        else:
            self.cells = np.repeat(self.values, n)

    def values_at(self, place: np.ndarray) -> np.ndarray:
        if not self.whole:
            inside = (place >= self.start) & (place < self.end)
            place = np.where(inside, place, self.start)
        if self.shift:
            at = self.guide[place - self.start >> self.shift]
            beyond = place >= self.next[at]
            if beyond.any():
                at[beyond] = np.searchsorted(self.low, place[beyond], "right") - 1
            found = self.values[at]
        else:
            found = self.cells[place - self.start if self.start else place]
        return found if self.whole else np.where(inside, found, 0.0)


def _add_draws(sums: np.ndarray, genome: np.ndarray, c: np.ndarray, k0: np.ndarray, k1: np.ndarray, pool: _Pool, first: int, last: int) -> None:
    """Add one stratum's draws to the rows ``genome`` of ``sums``. A genome's
    draws go in runs of fixed length, many genomes' at once; what they add up to
    does not depend on which are at once."""
    ks = np.arange(first, last, dtype=np.uint32)
    runs = -(-c // RUN)
    row = np.repeat(np.arange(len(c)), runs)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
    size = np.minimum(RUN, c[row] - begin)
    upto = np.cumsum(size)
    most, a = max(RUN, BLOCK // max(1, last - first)), 0
    while a < len(row):
        b = int(np.searchsorted(upto, upto[a] - size[a] + most, "right"))
        some, n = row[a:b], size[a:b]
        offset = np.cumsum(n) - n
        draw = np.arange(int(n.sum())) - np.repeat(offset - begin[a:b], n)
        of = np.repeat(some, n)
        at = mixed(draw.astype(np.uint32) + k1[of])
        mine = mixed(k0[some[0] : some[-1] + 1, None] + ks)
        found = np.add.reduceat(pool.values_at(_places(mine[of - some[0]], at[:, None], pool.total)), offset, axis=0)
        if (some[1:] == some[:-1]).any():
            np.add.at(sums, genome[some], found)
        else:
            sums[genome[some]] += found
        a = b


def _drawn(targets, page, first: int, last: int):
    """(rows of ``targets``, sums): each genome's first row and its sums of the
    draws that fall on the page, a bounded number of genomes at a time."""
    pools = {key: _Pool(part) for key, part in page.groupby(STRATUM, sort=False)}
    targets = targets.sort_values(["genome_id", *STRATUM], ignore_index=True)
    heads = np.flatnonzero(targets["genome_id"].ne(targets["genome_id"].shift()).to_numpy())
    ends = np.append(heads[1:], len(targets))
    step = max(1, PAGE // max(1, last - first))
    for a in range(0, len(heads), step):
        some = heads[a : a + step]
        part = targets.iloc[some[0] : ends[min(len(heads), a + step) - 1]]
        genome = np.repeat(np.arange(len(some)), ends[a : a + step] - some)
        sums = np.zeros((len(some), last - first))
        columns = [part[x].to_numpy() for x in ("c", "k0", "k1")]
        for key, at in sorted(part.reset_index(drop=True).groupby(STRATUM).indices.items()):
            c, k0, k1 = (x[at] for x in columns)
            _add_draws(sums, genome[at], c.astype(np.int64), k0.astype(np.uint32), k1.astype(np.uint32), pools[key], first, last)
        yield targets.iloc[some], sums


def _page_sums(first: int, last: int):
    """Sums of the draws that fall on one page, a row a genome."""

    def run(targets, page):
        import pandas as pd

        rows = []
        for heads, sums in _drawn(targets, page, first, last):
            at = int(page["page"].iloc[0])
            rows += [(unit, genome, at, first, s.tobytes()) for unit, genome, s in zip(heads[KEYS[0]], heads[KEYS[1]], sums)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SUMS.split(", ")])

    return run


def _page_nulls(first: int, last: int):
    """The null's moments, a row a genome, where a page holds its whole pools."""

    def run(targets, page):
        import pandas as pd

        keys, found = [], []
        for heads, sums in _drawn(targets, page, first, last):
            keys += heads[KEYS].itertuples(index=False, name=None)
            found.append(np.column_stack(_moments(sums, heads["weighted_evidence_shared"].to_numpy(float))))
        names = [x.split()[0] for x in NULL.split(", ")]
        if not keys:
            return pd.DataFrame([], columns=[*KEYS, *names])
        return pd.DataFrame(dict(zip(KEYS, zip(*keys))) | dict(zip(names, np.concatenate(found).T)))

    return run


def _moments(sums: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """p, mean, sd, q95, q99 and z: a value a row of ``sums`` each."""
    n = sums.shape[1]
    least = own - 1e-9 * np.maximum(1.0, np.abs(own))
    ge = (sums >= least[:, None]).sum(axis=1)
    mean = sums.mean(axis=1)
    sd = sums.std(axis=1, ddof=1) if n > 1 else np.zeros(len(sums))
    q95, q99 = np.quantile(sums, [0.95, 0.99], axis=1)
    return (1.0 + ge) / (1.0 + n), mean, sd, q95, q99, (own - mean) / (sd + 1e-12)


def _dealt(targets: DataFrame, strata: DataFrame, pages: DataFrame, iterations: int, seed: int, work: int):
    """Targets' rows and copies of the pages, cogrouped: genomes of a page are
    dealt over tasks by the draws they need."""
    unit = KEYS[0]
    rows = targets.join(strata, KEYS).select(*targets.columns, *[F.col(f"stratum.{c}").alias(c) for c in STRATUM], "c")
    on = pages.select(unit, *STRATUM, "page").distinct()
    rows = written(rows.withColumn("k0", _key(seed, 0)).withColumn("k1", _key(seed, 1)).join(on, [unit, *STRATUM]), "knockoff-rows")
    load = rows.groupBy(unit, "page").agg(F.ceil(F.sum(F.col("c") + 16) * F.lit(iterations) / F.lit(work)).alias("_tasks"))
    dealt = rows.join(load, [unit, "page"]).withColumn("bucket", F.pmod(F.xxhash64("genome_id"), F.col("_tasks"))).drop("_tasks")
    copies = pages.join(load, [unit, "page"]).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1))).drop("_tasks")
    keys = [unit, "page", "bucket"]
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys))


def knockoff_sums(targets: DataFrame, strata: DataFrame, pages: DataFrame, first: int, last: int, seed: int = 42, work: int = WORK) -> DataFrame:
    """unit, genome, page, first, sums: for each target and page of its
    strata the partial sums of the iterations ``first`` to ``last`` - 1, as
    doubles."""
    return _dealt(targets.select(*KEYS), strata, pages, last - first, seed, work).applyInPandas(_page_sums(first, last), SUMS)


def null_of(targets: DataFrame, sums: DataFrame) -> DataFrame:
    """pvalue_shared and the null's moments for ``targets`` (unit, genome,
    weighted_evidence_shared); those without sums get 1 and zeros. Partial sums
    of pages are added up, those of further iterations put behind."""

    @F.pandas_udf(NULL)
    def moments(parts, seen):
        import pandas as pd

        rows = []
        for some, own in zip(parts, seen):
            spans: dict[int, np.ndarray] = {}
            for p in some:
                values = np.frombuffer(p["sums"], float)
                spans[p["first"]] = spans[p["first"]] + values if p["first"] in spans else values
            s = np.concatenate([spans[k] for k in sorted(spans)])
            rows.append([x[0] for x in _moments(s[None, :], np.array([own], float))])
        return pd.DataFrame(rows, columns=[x.split()[0] for x in NULL.split(", ")], dtype=float)

    # as many as its strata's pages, in order: sums of doubles depend on it
    parts = F.sort_array(F.collect_list(F.struct("first", "page", "sums")))
    whole = sums.groupBy(*KEYS).agg(parts.alias("parts")).join(targets.select(*KEYS, "weighted_evidence_shared"), KEYS)
    found = whole.select(*KEYS, moments("parts", "weighted_evidence_shared").alias("m")).select(*KEYS, "m.*")
    return _filled(targets, found)


def _filled(targets: DataFrame, found: DataFrame) -> DataFrame:
    out = targets.select(*KEYS).join(found, KEYS, "left")
    return out.fillna(1.0, ["pvalue_shared"]).fillna(0.0, ["null_mean", "null_sd", "null_q95", "null_q99", "z_shared"])


def nulls(targets: DataFrame, strata: DataFrame, pages: DataFrame, iterations: int, seed: int = 42, work: int = WORK) -> DataFrame:
    """``null_of`` the first ``iterations``. Where one page holds a unit's
    pools, a task that draws gives the moments at once and no sums move; further
    iterations draw the first ones again, which costs less than keeping them."""
    targets, unit = targets.select(*KEYS, "weighted_evidence_shared"), KEYS[0]
    many = pages.where("page > 0").select(unit).distinct()
    if many.isEmpty():
        return _filled(targets, _dealt(targets, strata, pages, iterations, seed, work).applyInPandas(_page_nulls(0, iterations), f"{unit} string, genome_id string, {NULL}"))
    one, more = ((targets.join(many, unit, how), pages.join(many, unit, how)) for how in ("left_anti", "left_semi"))
    found = _dealt(one[0], strata, one[1], iterations, seed, work).applyInPandas(_page_nulls(0, iterations), f"{unit} string, genome_id string, {NULL}")
    return _filled(one[0], found).union(null_of(more[0], knockoff_sums(more[0], strata, more[1], 0, iterations, seed, work)))


def knockoff(targets: DataFrame, strata: DataFrame, pools: DataFrame, iterations: int, seed: int = 42, work: int = WORK) -> DataFrame:
    """One stage from the start: pools to p-values."""
    return nulls(targets, strata, pool_pages(pools), max(LEAST_ITERATIONS, iterations), seed, work)


def refined(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """Stage 2's values where it ran, else stage 1's."""
    cols = [c for c in stage1.columns if c not in KEYS]
    second = stage2.select(*KEYS, *[F.col(c).alias(f"_2_{c}") for c in cols])
    return stage1.join(second, KEYS, "left").select(*KEYS, *[_either(c).alias(c) for c in cols], F.col("_2_pvalue_shared").isNotNull().alias("refined"))


def _either(c: str) -> Column:
    return F.coalesce(f"_2_{c}", c)
