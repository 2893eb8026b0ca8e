"""Ranks, running sums and minima, and order statistics within groups of any size.

One group may hold every row, so nothing here sorts a group in one task or
keeps its values in one buffer: rows are dealt by ranges of the whole sort key,
worked on where they lie, and what the other ranges have is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presencia.tables import written

#: Ranks that one task sums up.
STRIDE = 65_536


def with_rank(rows: DataFrame, unit: str, order: list[Column], out: str, label: str = "ranked") -> DataFrame:
    """``rows`` with their place in the unit, from 1. ``order`` must tell all
    rows of a unit apart. The numbered rows are written: places in ranges hold
    only for one dealing."""
    dealt = rows.repartitionByRange(F.col(unit), *order).sortWithinPartitions(F.col(unit), *order)
    # the upper bits name the range, the lower ones count its rows
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy(unit, "_range").agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    before = Window.partitionBy(unit).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")  # a row a range and unit
    numbered = placed.join(sizes, [unit, "_range"])
    return numbered.withColumn(out, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_range", "_first", "_before")


def running_sum(rows: DataFrame, unit: str, rank: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with their rank, and
    ``out``_total, the unit's whole sum. Ranks are whole numbers from 1."""
    placed = rows.withColumn("_stride", F.floor((F.col(rank) - 1) / F.lit(STRIDE)))
    sums = placed.groupBy(unit, "_stride").agg(F.sum(value).alias("_sum"))
    by = Window.partitionBy(unit)
    before = by.orderBy("_stride").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(unit, "_stride", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(by).alias(f"{out}_total"))
    inside = Window.partitionBy(unit, "_stride").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    both = placed.withColumn(out, F.sum(value).over(inside)).join(sums, [unit, "_stride"])
    return both.withColumn(out, F.col(out) + F.col("_before")).drop("_stride", "_before")


def ranged(rows: DataFrame, keys: list[str], value: str, label: str = "ranges") -> DataFrame:
    """``rows`` with ``_range``, the number of the range of keys and value that
    they lie in. Equal ones share a range. Written: ranges hold for one dealing."""
    dealt = rows.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    return written(dealt.withColumn("_range", F.spark_partition_id()), label)


def running(rows: DataFrame, keys: list[str], value: str, of: str, out: str, fn=F.sum, backwards: bool = False) -> DataFrame:
    """``rows`` (``ranged``, one a value) with ``fn``, F.sum or F.min, of ``of``
    over all values of the group up to the own one, or from it on."""
    turn = F.desc if backwards else F.asc
    so_far = Window.unboundedPreceding
    parts = rows.groupBy(*keys, "_range").agg(fn(of).alias("_part"))
    # a row a range and group
    parts = parts.select(*keys, "_range", fn("_part").over(Window.partitionBy(*keys).orderBy(turn("_range")).rowsBetween(so_far, -1)).alias("_before"))
    inside = fn(of).over(Window.partitionBy(*keys, "_range").orderBy(turn(value)).rowsBetween(so_far, 0))
    both = rows.withColumn(out, inside).join(parts, [*keys, "_range"])
    whole = F.col(out) + F.coalesce("_before", F.lit(0)) if fn is F.sum else F.least(out, "_before")
    return both.withColumn(out, whole).drop("_before")


def counted(rows: DataFrame, keys: list[str], value: str, n: Column | None = None, label: str = "counted") -> DataFrame:
    """(keys, value, n, upto, total, _range): the histogram of a column with
    running counts. ``n``: what a group of equal values counts, else its rows."""
    of = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if n is None else n).alias("n"))
    placed = running(ranged(of, keys, value, label), keys, value, "n", "upto")
    return placed.join(placed.groupBy(*keys).agg(F.sum("n").alias("total")), keys)


def at_place(place: Column, value: str) -> Column:
    """Aggregate over ``counted`` rows: the value at a place from 0."""
    return F.min(F.when(F.col("upto") > place, F.col(value)))


def quantiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float], label: str = "quantiles") -> DataFrame:
    """(keys, a column a name of ``qs``, n): linear quantiles of the values
    that are not null, exact, by counts of distinct values over ranges."""
    of = counted(rows, keys, value, label=label)

    def place(q: float) -> Column:
        return (F.col("total") - 1) * F.lit(q)

    picked = []
    for name, q in qs.items():
        low = F.floor(place(q))
        picked += [at_place(low, value).alias(f"_a_{name}"), at_place(F.least(low + 1, F.col("total") - 1), value).alias(f"_b_{name}"), F.max(place(q) - low).alias(f"_f_{name}")]
    found = of.groupBy(*keys).agg(*picked, F.max("total").alias("n"))
    between = {q: (F.col(f"_a_{q}") + (F.col(f"_b_{q}") - F.col(f"_a_{q}")) * F.col(f"_f_{q}")).alias(q) for q in qs}
    return found.select(*keys, *between.values(), "n")
