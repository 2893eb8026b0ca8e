"""Written intermediate tables, and joins that no hot key can bind to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.tables import new_path, shared_root, written

__all__ = ["hot_join", "new_path", "reserved", "shared_root", "written"]

#: A key is hot that holds more than one in so many rows, so there are never more hot keys.
HOT_SHARE = 1_000


def reserved(df: DataFrame, *names: str) -> DataFrame:
    """``df``, unless it has a column that an operator would overwrite."""
    clash = [c for c in df.columns if c in names or c.startswith("_llm_")]
    if clash:
        raise ValueError(f"columns {clash} are taken by the operator; rename them")
    return df


def hot_keys(counts: DataFrame, on: str, least: int = 500) -> DataFrame | None:
    """(on, _llm_salts): the keys of ``counts`` (on, n; written) that hold more
    than a thousandth of all rows, with the number of parts they are cut into;
    None if there are none. There are never more than a thousand, so they may
    be broadcast; written, their size is known to Spark."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(least, total // HOT_SHARE)
    found = counts.where(F.col("n") > limit).select(on, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("_llm_salts"))
    return None if found.isEmpty() else written(found, "hot-keys")


def hot_join(rows: DataFrame, keyed: DataFrame, hot: DataFrame | None, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key); the ``hot_keys`` of
    ``rows`` are cut into parts.

    The places of ``rows`` deal them, so these must come from files or from what
    is worked out of files row by row, which keep their order when a task is
    run again.
    """
    if hot is None:
        return rows.join(keyed, on, how)
    hot = F.broadcast(hot)
    dealt = rows.withColumn("_llm_at", F.monotonically_increasing_id()).join(hot, on, "left")
    dealt = dealt.withColumn("_llm_salt", F.pmod("_llm_at", F.coalesce("_llm_salts", F.lit(1))).cast("int")).drop("_llm_at", "_llm_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_llm_salts", F.lit(1)) - 1)
    spread = keyed.join(hot, on, "left").withColumn("_llm_salt", F.explode(copies)).drop("_llm_salts")
    return dealt.join(spread, [on, "_llm_salt"], how).drop("_llm_salt")
