"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to unit length, turned by three rounds of random signs and
a fast Hadamard transform, and assigned to the nearest signed axis; ``k`` such
hashes name a bucket of a table. Queries probe, in every table, the buckets
whose axes lose the least. Candidates are ranked by exact Euclidean distance
between original vectors in double precision.

How many buckets to probe is fitted on a bounded number of queries
(``fit_queries``) against an exact pass over all rows, so that ``recall`` of
their true neighbours is met; every row is indexed, at every size of table.
Queries whose buckets hold too few rows for a full list are held against all
rows, in blocks. Equal vectors are one class that carries its smallest ids,
which is all that a top list can use. Hot buckets are dealt over tasks, and so are
queries where many meet in one bucket; a task holds a block of a bucket's queries
and reads the members once.

Defined cases: vectors that are null, empty, zero, of another than the most
common length, or that hold null or non-finite components take no part; null
ids neither. Repeated (id, vector) rows count once; of an id with several
vectors the nearest counts, and as a query it has one list, from all of them.
Ties go to the smaller id. Ids that are no whole numbers are an error. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presencia.llm.tables import hot_keys, written


@dataclass(frozen=True)
class AnnParams:
    """``most_probes`` bounds the buckets probed in a table once these are more
    than the signed axes; ``block_rows`` is what one task takes of a hot bucket
    at a time, ``block_queries`` what it holds of a bucket's queries."""

    top: int = 10
    tables: int = 3
    seed: int = 5
    recall: float = 0.96
    fit_queries: int = 128
    most_probes: int = 1_024
    block_rows: int = 8_192
    block_queries: int = 1_024


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """``tables`` hashes of ``k`` signed axes each over ``dim`` components."""

    def __init__(self, dim: int, k: int, tables: int, seed: int):
        self.dim, self.k, self.tables = dim, k, tables
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, k, 3, self.width))

    def turned(self, vectors: np.ndarray, table: int, j: int) -> np.ndarray:
        x = np.zeros((len(vectors), self.width))
        x[:, : self.dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for signs in self.signs[table, j]:
            x = _hadamard(x * signs)
        return x

    def codes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(vectors), np.int64)
        for j in range(self.k):
            x = self.turned(vectors, table, j)
            axis = np.abs(x).argmax(axis=1)
            code = code * (2 * self.width) + 2 * axis + (x[np.arange(len(x)), axis] < 0)
        return code

    def most(self, limit: int) -> int:
        """Probes to be had in a table: with one axis a bucket, all buckets."""
        return 2 * self.width if self.k == 1 else limit

    def probes(self, vectors: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` codes of least loss, by growing loss: the sum over
        hashes of how far the squared component falls below the best one."""
        codes = losses = None
        for j in range(self.k):
            x = self.turned(vectors, table, j)
            signed = np.stack([x, -x], axis=2).reshape(len(x), -1)
            loss = (signed.max(axis=1, keepdims=True) - signed) ** 2
            order = np.argsort(loss, axis=1, kind="stable")[:, :most]
            loss = np.take_along_axis(loss, order, axis=1)
            if codes is None:
                codes, losses = order.astype(np.int64), loss
                continue
            # a pair of ranks a, b is behind at least (a + 1) * (b + 1) - 1 others
            a, b = np.array([(a, b) for a in range(codes.shape[1]) for b in range(min(order.shape[1], most // (a + 1)))]).T
            both, code = losses[:, a] + loss[:, b], codes[:, a] * (2 * self.width) + order[:, b]
            keep = np.argsort(both, axis=1, kind="stable")[:, :most]
            codes, losses = np.take_along_axis(code, keep, axis=1), np.take_along_axis(both, keep, axis=1)
        return codes


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def _nearest_of(fit: list, dim: int, top: int):
    queries = np.array(fit, dtype=np.float64)

    def run(batches):
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            rows, ids = _matrix(batch.column("vec"), dim), batch.column("low").to_pylist()
            for i, q in enumerate(queries):
                d = _distances(rows, q)
                some = np.argpartition(d, top)[: top + 1] if len(d) > top + 1 else range(len(d))
                best[i] = sorted(best[i] + [(float(d[j]), ids[j], rows[j]) for j in some], key=lambda x: x[:2])[: top + 1]
        flat = [(i, d, k, v.tolist()) for i, found in enumerate(best) for d, k, v in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))],
            names=["q", "d", "low", "vec"],
        )

    return run


def _fit_set(classes: DataFrame, asked: DataFrame, dim: int, params: AnnParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries to fit on, and their true neighbours as (place of query, vector)."""
    fit = [list(r.vec) for r in asked.orderBy("h1", "h2").limit(params.fit_queries).select("vec").collect()]
    by = Window.partitionBy("q").orderBy("d", "low")
    near = classes.select("vec", "low").mapInArrow(_nearest_of(fit, dim, params.top), "q int, d double, low long, vec array<double>")
    near = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= params.top + 1).collect()
    pairs = [(r.q, r.vec) for r in near if r.d > 0]
    return np.array(fit, dtype=np.float64), np.array([q for q, _ in pairs], np.int64), np.array([v for _, v in pairs], np.float64)


def _fit_probes(fit: tuple[np.ndarray, np.ndarray, np.ndarray], index: CrossPolytope, params: AnnParams) -> int | None:
    """The smallest number of probes that finds ``recall`` of the neighbours
    fitted on; None if the most do not."""
    queries, of, others = fit
    if not len(of):
        return 1
    most = index.most(params.most_probes)
    place = np.full(len(of), most)
    for t in range(index.tables):
        codes, probes = index.codes(others, t), index.probes(queries, t, most)
        for i, q in enumerate(of):
            at = np.flatnonzero(probes[q] == codes[i])
            place[i] = min(place[i], at[0]) if len(at) else place[i]
    probes = int(np.sort(place)[int(np.ceil(params.recall * len(place))) - 1]) + 1
    return probes if probes <= most else None


def _ranked(dim: int, top: int):
    """Top lists inside runs of equal (bucket, salt): queries come first and
    are held, members pass by."""
    names = ["h1", "h2", "id", "d"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def shortened(found: list) -> list:
        seen, out = set(), []
        for d, i in sorted(found):
            if i not in seen:
                seen.add(i)
                out.append((d, i))
                if len(out) > top:
                    break
        return out

    def result(queries):
        rows = [(h1, h2, i, d) for h1, h2, _, best in queries for d, i in best]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    def run(batches):
        key, queries = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, salt, role = (batch.column(c).to_numpy() for c in ("bucket", "salt", "role"))
            h1, h2, ids = (batch.column(c) for c in ("h1", "h2", "ids"))
            rows = _matrix(batch.column("vec"), dim)
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in itertools.pairwise([0, *change.tolist(), len(bucket)]):
                if (bucket[a], salt[a]) != key:
                    if queries:
                        yield result(queries)
                    key, queries = (bucket[a], salt[a]), []
                if role[a] == 0:
                    queries += [(h1[i].as_py(), h2[i].as_py(), rows[i], []) for i in range(a, b)]
                    continue
                lists = ids.slice(a, b - a).to_pylist() if queries else []
                for _, _, vec, best in queries:
                    d = _distances(rows[a:b], vec)
                    # every class tied with the last place stays in play
                    far = min(np.partition(d, top)[top] if len(d) > top + 1 else np.inf, best[top][0] if len(best) > top else np.inf)
                    best[:] = shortened(best + [(float(d[j]), x) for j in np.flatnonzero(d <= far) for x in lists[j]])
        if queries:
            yield result(queries)

    return run


def _usable(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes.dim if sizes else 0
    return rows.where(F.size("vec") == dim), dim


def nearest(table: DataFrame, is_query=None, params: AnnParams = AnnParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id satisfies ``is_query``
    (a function of the id column; None: every row)."""
    spark = table.sparkSession
    rows, dim = _usable(table, id_col, vec_col)
    kind = rows.schema["vec"].dataType.elementType.simpleString()
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    asking = rows.where(is_query(F.col("id")) if is_query else F.lit(True))
    first_ids = Window.partitionBy("h1", "h2").orderBy("id")
    classes = written(
        rows.withColumn("r", F.dense_rank().over(first_ids)).where(F.col("r") <= params.top + 1)
        .groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids")).withColumn("low", F.col("ids")[0]),
        "ann-classes",
    )
    asked = written(asking.groupBy("h1", "h2").agg(F.first("vec").alias("vec")), "ann-queries")
    n, fit = classes.count(), _fit_set(classes, asked, dim, params)
    k, width = 1, 2 * (1 << max(1, (dim - 1).bit_length()))
    while n > 8 * width ** (k + 1) and k < 3:
        k += 1
    while True:
        index = CrossPolytope(dim, k, params.tables, params.seed)
        probes = _fit_probes(fit, index, params)
        if probes is not None:
            break
        k -= 1  # with one axis a bucket all buckets can be probed

    def code_rows(batches):
        for batch in batches:
            vectors = _matrix(batch.column("vec"), dim)
            codes = np.stack([(t << 40) + index.codes(vectors, t) for t in range(index.tables)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * index.tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("h1", "h2", "vec", "ids")] + [lists], names=["h1", "h2", "vec", "ids", "codes"])

    def probe_rows(batches):
        for batch in batches:
            vectors = _matrix(batch.column("vec"), dim)
            for t, at in itertools.product(range(index.tables), range(0, len(vectors), 256)):
                part = batch.slice(at, 256)
                codes = index.probes(vectors[at : at + 256], t, probes)
                rows_of = pa.array(np.repeat(np.arange(len(codes)), codes.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((t << 40) + codes.ravel())] + [part.column(c).take(rows_of) for c in ("h1", "h2", "vec")], names=["bucket", "h1", "h2", "vec"]
                )

    schema = f"h1 long, h2 long, vec array<{kind}>"
    coded = written(classes.select("h1", "h2", "vec", "ids").mapInArrow(code_rows, schema + ", ids array<long>, codes array<long>"), "ann-codes")
    counts = written(coded.select(F.explode("codes").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), "ann-buckets")
    none = spark.createDataFrame([], "bucket long, _llm_salts int")
    hot = hot_keys(counts, "bucket", params.block_rows) or none  # at most a thousand
    asks = written(asked.mapInArrow(probe_rows, "bucket long, " + schema).join(counts, "bucket", "left_semi"), "ann-asks")
    # a bucket's queries are held in blocks, too; its members pass by each block
    cells = asks.groupBy("bucket").agg(F.ceil(F.count("*") / params.block_queries).cast("int").alias("blocks"))
    cells = written(cells.join(F.broadcast(hot), "bucket", "left").select("bucket", "blocks", F.coalesce("_llm_salts", F.lit(1)).alias("salts")), "ann-cells")
    cell = (F.col("part") * F.col("blocks") + F.col("block")).cast("int").alias("salt")

    def dealt(column, n):
        return F.pmod(F.xxhash64("h1", "h2", F.lit(column)), n)

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    members = coded.select(F.explode("codes").alias("bucket"), "h1", "h2", "vec", "ids").join(cells, "bucket")
    members = members.withColumn("part", dealt("part", F.col("salts"))).withColumn("block", each(F.col("blocks"))).select("bucket", cell, "h1", "h2", "vec", "ids")
    asks = asks.join(cells, "bucket").withColumn("block", dealt("block", F.col("blocks"))).withColumn("part", each(F.col("salts"))).select("bucket", cell, "h1", "h2", "vec")
    found = written(_met(members, asks, dim, params.top), "ann-found")

    # as many ids as a list can ask for; a query's own is among what it found
    full = rows.select("id").distinct().limit(params.top + 1).count()
    enough = found.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= full)
    short = written(asked.join(enough, ["h1", "h2"], "left_anti"), "ann-short")
    if lacking := short.count():
        blocks, groups = -(-n // (4 * params.block_rows)), -(-lacking // params.block_queries)
        spread = F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks))
        members = classes.select(spread.alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("salt"), "h1", "h2", "vec", "ids")
        asks = short.select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("bucket"), F.pmod(F.xxhash64("h1", "h2"), F.lit(groups)).cast("int").alias("salt"), "h1", "h2", "vec"
        )
        found = found.join(short, ["h1", "h2"], "left_anti").unionByName(_met(members, asks, dim, params.top))
    best = Window.partitionBy("h1", "h2").orderBy("d", "id")
    found = found.groupBy("h1", "h2", "id").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= params.top + 1).drop("r")
    own = asking.select(F.col("id").alias("query_id"), "h1", "h2").distinct()
    order = Window.partitionBy("query_id").orderBy("d", "id")
    listed = own.join(found, ["h1", "h2"]).where("id <> query_id").groupBy("query_id", "id").agg(F.min("d").alias("d")).withColumn("rank", F.row_number().over(order))
    return listed.where(F.col("rank") <= params.top).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("d").alias("score"))


def _met(members: DataFrame, asks: DataFrame, dim: int, top: int) -> DataFrame:
    """h1, h2, id, d: the best of every query within each (bucket, salt)."""
    cols = ["bucket", "salt", "role", "h1", "h2", "vec", "ids"]
    asks = asks.withColumns({"role": F.lit(0), "ids": F.expr("cast(array() as array<long>)")})
    both = asks.select(*cols).union(members.withColumn("role", F.lit(1)).select(*cols))
    dealt = both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "role")
    return dealt.mapInArrow(_ranked(dim, top), "h1 long, h2 long, id long, d double")
