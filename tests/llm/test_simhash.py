import random

import numpy as np
import pytest
import xxhash

from presencia.llm import simhash as M
from presencia.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id long, bucket int"


def brute_print(text, k=3):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").split("\n") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) > k else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, distance):
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        new = [min([label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= distance]) for i in range(len(fps))]
        if new == label:
            break
        label = new
    low = {}
    for l, i in zip(label, ids):
        if i is not None:
            low[l] = min(low.get(l, i), i)
    return [low.get(l) for l in label]


def texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 80))) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    for t in base[:8]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append((100 + len(out), " ".join(w)))
    out += [(7, base[3]), (500, base[3].upper()), (501, None), (502, ""), (503, "\n \t"), (504, "one"), (505, "one two"), (None, base[5]), (None, "alone with null id here"), (506, "é x ünï \x1c y"), (507, "long " * 9000 + "tail")]
    return out


def test_components_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 5, 1) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in M.simhash_components(df).collect())
    fps = [brute_print(t) for _, t in rows]
    comps = brute_components(fps, [i for i, _ in rows], 3)
    assert got == sorted((str(i), f"{p:016x}", str(c)) for (i, _), p, c in zip(rows, fps, comps))


def test_empty_table(spark):
    assert M.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.near_dedup(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "fp", "component_id", "bucket"]


@pytest.mark.parametrize("block,refinements,distance", [(64, 2, 3), (16, 0, 3), (16, 1, 3), (32, 2, 6), (32, 0, 6)])
def test_hot_buckets_lose_no_link(spark, block, refinements, distance):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    while len(fps) < 250:
        x = centre
        for b in rng.choice(64, rng.integers(1, 12), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps], "fp long")
    params = M.SimHashParams(block_rows=block, refinements=refinements, distance=distance)
    got = {r.fp: r.component for r in M.near_duplicate_components(df, params).collect()}
    want = brute_components(fps, list(range(len(fps))), distance)
    groups = {}
    for x, w in zip(fps, want):
        groups.setdefault(w, set()).add(got[x - (1 << 64) if x >= 1 << 63 else x])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_index_covers_every_pair(distance):
    rng = np.random.default_rng(distance)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for rows in (500, 10**7, 10**10):
        parts = M.fit_index(sample, rows, distance)
        bits = sorted(b for p in parts for b in p.bits)
        assert len(bits) == len(set(bits))
        for _ in range(300):
            flip = set(rng.choice(64, distance, replace=False).tolist())
            assert any(len(flip & set(p.bits)) <= p.radius for p in parts)


def test_allocation_is_optimal():
    rng = random.Random(1)
    for m, total in ((2, 2), (3, 1), (4, 0)):
        costs = [[0.0] + sorted(rng.random() for _ in range(4)) for _ in range(m)]
        import itertools

        want = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in itertools.product(range(-1, 4), repeat=m) if sum(ts) == total)
        assert M.allocate(costs, total)[0] == pytest.approx(want)


def test_near_dedup_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words stand here instead of those"), (None, "a b c d e f g")]
    df = spark.createDataFrame([(i, t, "k", 9, 1) for i, t in rows], SCHEMA)
    out = M.near_dedup(df, M.SimHashParams(shingle_words=5))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + star + [(7, 7)], "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 60))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
