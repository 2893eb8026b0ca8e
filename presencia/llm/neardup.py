"""Near-duplicate removal by the exact similarity of word shingles.

Documents link where the Jaccard similarity of their shingle sets reaches
``similarity``; linked groups keep one document. Candidates meet in buckets, and
there what similar pairs connect is found by whole sets, first with the bucket's
smallest document, then among the rest. A bucket is

* a component of ``simhash``'s index over the sets' fingerprints (all that pairs
  within ``distance`` bits connect; exact), and
* for similar pairs that lie further apart than any index of 64 bits can tell,
  a band of minima of the shingles' hashes under random functions. A pair of
  similarity s shares none with probability (1 - s ** band_rows) ** bands,
  under 0.00003 at 0.8.

Shingles are those of ``simhash.fingerprint``: lower-cased words, the whole
text where it has fewer words. Sets hold 64-bit hashes of shingles.

Defined cases: null and wordless texts equal each other; equal sets link
whatever their rows; repeated rows stay once; null ids come last. An empty
table gives an empty result. Other columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.llm import simhash
from presencia.llm.components import connected_components
from presencia.llm.tables import hot_join, hot_keys, reserved, written


@dataclass(frozen=True)
class NearParams:
    """``similarity`` as a fraction, so that it is compared in whole numbers;
    ``block_rows`` bounds what one task compares at a time. Within six
    bits two random fingerprints lie once in 2 * 10^11 pairs, so components stay small."""

    shingle_words: int = 5
    similarity: tuple[int, int] = (4, 5)
    seed: int = 42
    distance: int = 6
    bands: int = 20
    band_rows: int = 4
    block_rows: int = 1_024


def shingles(text: bytes | None, params: NearParams) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles; never empty."""
    import xxhash

    words, per, seed = (text or b"").lower().split(), params.shingle_words, params.seed
    joined = b" ".join(words)
    if len(words) <= per:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - per + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[per - 1 :].tolist())), np.uint64, len(starts)))


def _functions(params: NearParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(params.seed)
    size = (params.bands * params.band_rows, 1)
    factors, terms = (rng.integers(0, 1 << 64, size, dtype=np.uint64) for _ in range(2))
    return factors | np.uint64(1), terms


def band_keys(found: np.ndarray, functions: tuple[np.ndarray, np.ndarray], params: NearParams) -> np.ndarray:
    """A bucket per band: a hash of the band and its minima."""
    import xxhash

    factors, terms = functions
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4_096):
        mixed = (found[at : at + 4_096] ^ terms) * factors
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(params.bands, params.band_rows)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def _with_keys(docs: DataFrame, text: str, params: NearParams) -> DataFrame:
    """``docs`` with _llm_near: a digest of the whole set, its fingerprint and
    the bands' keys."""

    @F.pandas_udf("same binary, fp long, keys array<long>")
    def keys(texts):
        import pandas as pd
        import xxhash

        functions = _functions(params)
        out = []
        for t in texts:
            found = shingles(t, params)
            out.append((xxhash.xxh3_128_digest(found.tobytes()), simhash.majority(found), band_keys(found, functions, params)))
        return pd.DataFrame(out, columns=["same", "fp", "keys"])

    return docs.withColumn("_llm_near", keys(F.col(f"`{text}`").cast("binary")))


def _sets(params: NearParams):
    def run(batches):
        for batch in batches:
            body = pa.array([shingles(t.as_py(), params).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), body], names=["node", "body"])

    return run


def similar(node: np.ndarray, sets: list[np.ndarray], asking: int, similarity: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Links that connect what the similar pairs of the first ``asking`` sets
    with all others connect.

    Each of them is held against all later ones at once; it ends when all are one.
    """
    n = len(node)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark = np.zeros(int(at.max()) + 1, bool)
    root, groups = np.arange(n), n
    a, b, (top, under) = [], [], similarity
    for i in range(min(asking, n - 1)):
        if groups == 1:
            break
        later = slice(first[i + 1], None)
        mine = at[first[i] : first[i + 1]]
        mark[mine] = True
        common = np.add.reduceat(mark[at[later]].astype(np.int64), first[i + 1 :] - first[i + 1])
        mark[mine] = False
        # common / (sizes - common) >= top / under
        near = common * (top + under) >= top * (sizes[i] + sizes[i + 1 :])
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                groups -= 1
                a.append(int(node[i]))
                b.append(int(node[j]))
    return a, b


def _stars(similarity: tuple[int, int]):
    """Each member of a star against its head, which comes first of its part."""
    top, under = similarity

    def run(batches):
        head, own = None, None
        for batch in batches:
            heads, nodes, near = batch.column("u").to_numpy(), batch.column("node").to_numpy(), []
            for u, v, body in zip(heads.tolist(), nodes.tolist(), batch.column("body")):
                found = np.frombuffer(body.as_py(), np.uint64)
                if u == v:
                    head, own = u, found
                    near.append(True)
                    continue
                assert u == head
                common = len(np.intersect1d(own, found, assume_unique=True))
                near.append(common * (top + under) >= top * (len(own) + len(found)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("node"), pa.array(near, pa.bool_())], names=["u", "node", "near"])

    return run


def _blocks(similarity: tuple[int, int]):
    def run(batches):
        rest = None
        for batch in batches:
            # a block is bounded, and what is carried on is one block
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = rest["block"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            if last:
                yield pack(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and len(rest):
            yield pack(rest)

    def pack(table):
        block, node, asks = table["block"].to_numpy(), table["node"].to_numpy(), table["asks"].to_numpy()
        edge = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)].tolist()
        u, v = [], []
        for a, b in zip(edge, edge[1:]):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["body"].slice(a, b - a)]
            for out, found in zip((u, v), similar(node[a:b], sets, int(asks[a:b].sum()), similarity)):
                out.extend(found)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def links(texts: DataFrame, heads: DataFrame, params: NearParams) -> DataFrame:
    """Edges (u, v) between nodes. ``texts``: node, text; ``heads``: node, keys.

    Buckets of the same members are one bucket. Sets are made only of texts
    that share a bucket. First every member is held against the smallest node
    of its bucket, once for all buckets in which the two meet; of a group of
    copies that is all. Only members that are not near to it are then held
    against all of their bucket, in blocks of ``block_rows`` rows, so no similar
    pair of a bucket is left unconnected.
    """
    rows = heads.select(F.explode("keys").alias("bucket"), "node")
    known = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"), F.min("node").alias("u")).where("n > 1")
    known = written(known.groupBy("n", "members", "u").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "u"), "near-known")
    rows = written(hot_join(rows, known, hot_keys(known.select("bucket", "n"), "bucket"), "bucket"), "near-buckets")
    some = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.col("text").cast("binary").alias("text"))
    sets = written(some.mapInArrow(_sets(params), "node long, body binary"), "near-sets")

    pairs = written(rows.where("node <> u").select("u", "node").distinct(), "near-pairs")
    half = params.block_rows // 2
    sizes = written(pairs.groupBy("u").agg(F.count("*").alias("n")), "near-stars")
    parts = F.ceil(F.col("n") / F.lit(params.block_rows)).cast("long")
    dealt = hot_join(pairs, sizes, hot_keys(sizes, "u"), "u").select("u", "node", F.pmod(F.xxhash64("node", F.lit(99)), parts).alias("part"))
    copies = sizes.select("u", F.col("u").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    met = dealt.union(copies).join(sets, "node").repartition("u", "part").sortWithinPartitions("u", "part", F.col("node") != F.col("u"))
    stars = written(met.select("u", "node", "body").mapInArrow(_stars(params.similarity), "u long, node long, near boolean"), "near-found")
    linked = stars.where("near AND u <> node").select("u", F.col("node").alias("v"))

    far = stars.where("NOT near").select("u", "node")
    # what its bucket's smallest node is not near to, bucket by bucket
    asking = written(rows.join(far, ["u", "node"], "left_semi"), "near-asking")
    counts = asking.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(half)).cast("long").alias("asking"), F.max(F.ceil(F.col("n") / F.lit(half))).cast("long").alias("blocks"))
    counts = written(counts, "near-left")
    zero = F.lit(0).cast("long")

    def block(i, j):
        return F.xxhash64("bucket", i, j).alias("block")

    def place(blocks):
        return F.pmod(F.xxhash64("node", F.lit(99)), blocks)

    asks = asking.join(counts, "bucket").select("bucket", "node", place(F.col("asking")).alias("i"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("j"))
    members = rows.where("node <> u").join(counts, "bucket").select("bucket", "node", F.explode(F.sequence(zero, F.col("asking") - 1)).alias("i"), place(F.col("blocks")).alias("j"))
    ready = asks.select(block("i", "j"), "node", F.lit(True).alias("asks")).union(members.select(block("i", "j"), "node", F.lit(False).alias("asks")))
    met = ready.join(sets, "node").repartition("block").sortWithinPartitions("block", F.desc("asks"))
    return linked.union(met.mapInArrow(_blocks(params.similarity), "u long, v long"))


def with_components(heads: DataFrame, params: NearParams) -> DataFrame:
    """``heads`` (node, fp, keys) whose keys have their component of the
    fingerprint index beside the bands."""
    prints = written(heads.groupBy("fp").agg(F.count("*").alias("n")), "near-prints")
    index = simhash.SimHashParams(shingle_words=params.shingle_words, seed=params.seed, distance=params.distance)
    found = written(simhash.near_duplicate_components(prints, index), "near-index")
    both = hot_join(heads, found, hot_keys(prints, "fp"), "fp")
    return both.withColumn("keys", F.concat(F.array(F.xxhash64(F.lit("simhash"), "component")), "keys")).drop("fp", "component")


def near_dedup(docs: DataFrame, params: NearParams = NearParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each linked group stays: that of the smallest doc_id (nulls
    last, repeated rows once). Columns and texts are those of ``docs``."""
    names = reserved(docs).columns
    keyed = docs.withColumn("_llm_row", F.monotonically_increasing_id())
    keyed = written(_with_keys(keyed, text_col, params), "near-docs")
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("doc_id"), F.col("_llm_row").alias("row"))
    heads = keyed.groupBy(F.col("_llm_near.same").alias("same")).agg(F.min(order).alias("first")).select("first", F.col("first.row").alias("node"))
    heads = written(heads.join(keyed.select(F.col("_llm_row").alias("node"), "_llm_near.fp", "_llm_near.keys"), "node"), "near-heads")
    texts = keyed.select(F.col("_llm_row").alias("node"), F.col(f"`{text_col}`").alias("text"))
    found = connected_components(links(texts, with_components(heads.drop("first"), params), params)).select("node", "component")
    groups = heads.select("node", "first").join(found, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    stays = groups.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_llm_row"))
    return keyed.join(stays, "_llm_row", "left_semi").select(*[F.col(f"`{n}`") for n in names])
