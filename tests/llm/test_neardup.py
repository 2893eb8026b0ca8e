import random

import pytest

import corpus_pipeline
from presencia.llm import neardup as M


def jaccard(a, b, k=5):
    def cut(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) > k else {tuple(w)}

    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


def documents():
    """Originals with copies of one to four changed words, and chains of them."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(40):
        w = [rng.choice(words) for _ in range(rng.randint(30, 250))]
        out.append(" ".join(w))
        for n in (1, 2, 3, 4):
            w = w[:] if n == 3 else out[-1].split()
            for _ in range(n):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out)] + [(900, None), (901, " \n"), (902, "one two"), (903, "One  two"), (None, out[0]), (3, out[3])]


def kept_by_brute_force(rows):
    label = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8]
    while True:
        before = label[:]
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    groups = {}
    for l, (i, _) in zip(label, rows):
        groups.setdefault(l, []).append(i)
    return sorted(min(x for x in g if x is not None) for g in groups.values())


@pytest.mark.parametrize("block", [1_024, 2])
def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch, block):
    monkeypatch.setattr(corpus_pipeline, "NEAR", type(corpus_pipeline.NEAR)(shingle_words=5, block_rows=block))
    rows = documents()
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _x string")
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == kept_by_brute_force(rows)


def test_stage_on_an_empty_table(spark):
    assert M.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_bucket_moves_each_set_once_or_twice(spark):
    """Thirty thousand near copies of one text, and a second group that shares
    buckets with them: all links stay, and no set is copied a block pair."""
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    texts = [(i, f"{base} e{i}") for i in range(30_000)] + [(100_000 + i, f"{' '.join(base.split()[:60])} {' '.join(f'v{j}' for j in range(60))} f{i}") for i in range(200)]
    params = M.NearParams()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    keyed = M._with_keys(docs.withColumnRenamed("doc_id", "node"), "text", params)
    heads = keyed.select("node", "_llm_near.keys")
    found = M.links(keyed.select("node", "text"), heads, params)
    assert found.count() < 5 * len(texts)
    assert sorted(r.doc_id for r in M.near_dedup(docs, params).collect()) == [0, 100_000]


def test_candidates_come_from_the_fingerprint_index(spark, monkeypatch):
    """Without any band the index alone finds near copies, and what it finds is
    held against the whole sets."""
    import numpy as np

    monkeypatch.setattr(M, "band_keys", lambda found, functions, params: np.zeros(0, np.int64))
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    near, unlike = base[:], " ".join(f"v{rng.randrange(900)}" for _ in range(300))
    near[200] = "changed"
    texts = [(2, " ".join(near)), (1, " ".join(base)), (3, unlike)]
    prints = [M.simhash.majority(M.shingles(t.encode(), M.NearParams())) for _, t in texts]
    assert 0 < ((prints[0] ^ prints[1]) & (1 << 64) - 1).bit_count() <= M.NearParams().distance and jaccard(texts[0][1], texts[1][1]) >= 0.8
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [1, 3]
    # equal fingerprints of unlike sets do not link
    monkeypatch.setattr(M.simhash, "majority", lambda hashed: 5)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [1, 3]
