"""The pipeline's stages against plain Python, and on rows that are odd."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from presencia.llm import linededup, quality

STAGES = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, ids string, n int"
RNG = random.Random(21)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(3, 8))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "b", "i", 1) for i, t, l, s in rows], DOCS)


def odd_rows():
    base, passage, key = prose(120), prose(70), "token=abcdefghijklmnop"
    near = base.split()
    near[60] = "changed"
    rows = [(i, prose(80) + "\n" + prose(60), "en", "s") for i in range(30)]
    rows += [(100, base, "en", "s"), (101, base, "en", "s"), (101, base, "en", "s"), (99, " ".join(near), "en", "s"), (None, base, None, None)]
    rows += [(200 + i, f"{prose(30)}\n{passage}\n{prose(30)}", "en", "s") for i in range(4)]
    rows += [(300, f"{prose(40)} {key} {prose(20)}", "en", "t"), (301, f"{prose(40)} {key} {prose(20)}", "en", "t")]
    rows += [(400, None, "en", "s"), (401, "", None, "s"), (402, " \n\t", "en", None), (None, None, None, None), (403, "too short", "en", "s"), (404, "same words again and again " * 30, "en", "s")]
    return rows + [(500, prose(30_000), "en", "s")], passage, key


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_groups(rows):
    """Components of Jaccard 0.8 and up, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(min(g, key=lambda k: (k is None, k or 0)) for g in groups.values() if g != [None]) + [None for g in groups.values() if g == [None]]


def texts(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_stages_on_odd_rows(spark):
    rows, passage, key = odd_rows()
    table = docs(spark, rows)
    good = STAGES["quality"](spark, table, "")
    left = {r.doc_id for r in good.collect()}
    assert good.columns == table.columns and not left & {400, 401, 402, 403, 404} and set(range(30)) | {99, 100, 500} <= left
    report = {r.doc_id: r.kept for r in quality.quality_report(table).collect() if r.doc_id is not None}
    assert left - {None} == {i for i, k in report.items() if k}

    lines = STAGES["line_dedup"](spark, table, "")
    assert lines.columns == table.columns and lines.count() == len(rows)
    held = [r.doc_id for r in lines.collect() if r.text and passage in r.text]
    assert held == [200] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    near = STAGES["near_dedup"](spark, table, "")
    assert near.columns == table.columns
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted(map(str, plain_groups([r[:2] for r in rows])))

    masked = STAGES["secrets"](spark, table, "")
    assert texts(masked) == sorted((str(i), str(t).replace(key, "[SECRET]")) for i, t, _, _ in rows)
    packed = STAGES["packing"](spark, table, "").collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(r[0]) for r in rows)
    ends = {}
    for r in packed:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_an_empty_table(spark, name):
    assert STAGES[name](spark, docs(spark, []), "").count() == 0


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_refuses_taken_names(spark, name):
    with pytest.raises(ValueError):
        STAGES[name](spark, docs(spark, odd_rows()[0][:3]).withColumn("_llm_key", F.lit(1)), "")


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    rows, _, key = odd_rows()
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {(r.doc_id, r.text) for r in STAGES["quality"](spark, seen, "").collect()}
    plain = kept
    lines = {(r.doc_id, r.text) for r in linededup.line_dedup(docs(spark, [(i, t, "en", "s") for i, t in plain])).collect()}
    left = plain_groups(sorted(lines, key=str))
    assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(map(str, left))
