import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from presencia.llm import classifier, filteraudit, fim
from tests.duck import SF

DOCS = "doc_id long, text string, lang string, quality string, fit string"
LABELS = "doc_id long, quality int, toxic int"
LONG = ("Some words, and ünïcode 😀; " * 200_000)[:5_000_000]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, "q", "f") for i, t, l in rows], DOCS)


# ---- fill in the middle --------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "1", "<", "x<P>y", "<S", "\n\r\t \x85 ", "ÀÉ[`{@", "😀a😀b", LONG] + ["".join(rng.choice("abYZ <>PSM.\n9éß中😀") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    rows = [(i * 7, t, None) for i, t in enumerate(texts)] + [(None, "no id here", "en"), (None, None, None), (14, "a", None), (14, "a", None)]
    out = fim.fill_in_middle(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "quality", "fit", "fim"]
    got = sorted(out.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r.fim) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    report = {(r.doc_id, r.output_sha256): r for r in fim.fim_report(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        want = plain_fim(i, t)
        r = report[i, hashlib.sha256(want[4].encode()).hexdigest()]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[:4]
        assert r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 3, 5, 64, 5000])
def test_descents_reach_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    index = fim.SkipList(widths)
    assert [index.descend(r) for r in range(n + 1)] == [0, *np.cumsum(widths)]
    for lane in range(1, len(index.units)):
        assert index.units[lane].sum() == n and index.points[lane].sum() == widths.sum()
        assert len(index.units[lane]) < len(index.units[lane - 1])
    with pytest.raises(IndexError):
        index.descend(n + 1)


def test_a_descent_is_short():
    """No lane is walked far: a rank of a million is some dozens of links away."""
    index = fim.SkipList(np.ones(1_000_000, np.int64))
    walked = []
    for rank in (1, 333_333, 999_999):
        node = units = steps = 0
        for lane in range(len(index.units) - 1, -1, -1):
            while node < len(index.units[lane]) and units + index.units[lane][node] <= rank:
                units, node, steps = units + index.units[lane][node], node + 1, steps + 1
            node = index.down[lane][node] if lane and units < rank else node
            if units == rank:
                break
        walked.append(steps)
    assert max(walked) < 200


def test_fim_of_no_rows_and_taken_names(spark):
    assert fim.fill_in_middle(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs(spark, []).withColumn("fim", F.lit(1)))


# ---- filter audit --------------------------------------------------------------


def plain_failures(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        later = t in least and (i is None or i > least[t])
        yield i, part or "", (len(words) < 200, 2 * len(set(words)) < len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), later)


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found, out = list(plain_failures(rows)), set()
    for part in {p for _, p, _ in found}:
        mine = [(i, f) for i, p, f in found if p == part]
        lines, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                k = "ABCDE".index(name)
                gone = [x for x in left if x[1][k]]
                redundant = sum(f[k] for _, f in mine) - len(gone)
                left = [x for x in left if not x[1][k]]
                shapley[name] += len(gone)
                alone = sum(f[k] and sum(f) == 1 for _, f in mine)
                lines.append((part, "".join(order), step, len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name))
        out |= {(*x[:-1], shapley[x[-1]]) for x in lines}
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(9)

    def text():
        many = rng.choice((5, 190, 200, 260))
        words = [rng.choice(("word", "Ätna", "HEAD", "x#", "end.")) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(many)]
        return rng.choice((" ", "\n", "\x0b", " ")).join(words)

    some = [text() for _ in range(60)]
    rows = [(rng.randrange(300), rng.choice(some), rng.choice(("en", "de", "", None))) for _ in range(400)]
    rows += [(None, some[0], "en"), (None, "only without an id", None), (None, "only without an id", None), (3, None, "fr"), (4, "", "fr"), (5, LONG, "fr"), (6, LONG, "fr")] + [(9, some[1], "en")] * 3
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in rng.choices(range(300), k=250)] + [(None, 1, 1), (9, 1, 0), (9, 0, 1)]
    out = filteraudit.audit(docs(spark, rows), spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("x")))
    assert out.schema.simpleString() == "struct<part:string,filter_order:string,step:int,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint,shapley:bigint>"
    got = [tuple(r) for r in out.collect()]
    want = plain_audit(rows, labels)
    assert len(got) == len(want) == 600 * 4 and set(got) == want


def test_audit_of_copies_and_of_nothing(spark):
    """Copies of one text over a third of the rows, and an id over as many."""
    rows = [(i, "one text", "en") for i in range(2_000)] + [(7, f"text {i}", "en") for i in range(2_000)] + [(10_000 + i, f"t{i}", None) for i in range(2_000)]
    labels = [(7, 1, 1)]
    got = {tuple(r) for r in filteraudit.audit(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert got == plain_audit(rows, labels)
    none = filteraudit.audit(docs(spark, []), spark.createDataFrame([], LABELS))
    assert none.count() == 0 and "shapley" in none.columns


# ---- quality classifier --------------------------------------------------------


def plain_slots(text, p):
    mask = (1 << 64) - 1
    k = int(classifier._P)

    def mixed(h, kind):
        h = (h ^ (kind * 0x632BE59BD9B4E019 & mask)) * 0xD6E8FEB86659FD93 & mask
        h ^= h >> 32
        return (h * 0xC2B2AE3D27D4EB4F & mask) >> (64 - p.slot_bits)

    out, before = [mixed(0, 0)], None
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        h = sum(ord(c) * pow(k, i, 1 << 64) for i, c in enumerate(word)) & mask
        out.append(mixed(h, 1))
        if before is not None:
            out.append(mixed(0 if h == before else (before * k + h) & mask, 6 + p.longest))
        before = h
        padded = f" {word} "
        for n in range(p.shortest, p.longest + 1):
            for i in range(len(padded) - n + 1):
                g = 0
                for c in padded[i : i + n]:
                    g = (g * k + ord(c)) & mask
                out.append(mixed(g, n))
    return sorted(out)


ODD = ["", " ", "a", " a  b\tb b\n", "naïve 😀😀 x y", "\x0b\x0cword", "wordwordword " * 9, "x" * 40]


@pytest.mark.parametrize("block", [1, 7, 200_000])
def test_features_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(classifier, "BLOCK", block)
    monkeypatch.setattr(classifier, "_POWERS", [])
    p = classifier.ClassifierParams()
    for text in ODD:
        assert sorted(np.concatenate(list(classifier.slots(text, p))).tolist()) == plain_slots(text, p), text


def test_a_step_follows_the_gradient():
    """One step on one document against differences of the loss."""
    p = classifier.ClassifierParams(slot_bits=4, dims=3, epochs=1, rate=1.0)
    at, share = np.array([1, 5, 9]), np.array([0.5, 0.25, 0.25], np.float32)
    start = np.random.default_rng(p.seed).uniform(-1.0, 1.0, (16, 3)).astype(np.float32) / 3
    numbers, offset = classifier.fit([(1, at, share)], p)
    hidden = share @ start[at]
    # softmax at zero: both classes one half, so weights move by half of hidden
    assert np.allclose(numbers, start @ hidden, atol=1e-6)
    assert offset == pytest.approx(1.0)


def test_scores_are_sums_over_slots():
    p = classifier.ClassifierParams(slot_bits=8, dims=4, epochs=2)
    samples = [(i % 2, *classifier.features(t, p)) for i, t in enumerate(ODD)]
    numbers, offset = classifier.fit(samples, p)
    model = classifier.QualityModel(numbers, offset, p)
    for text in ODD:
        at, share = classifier.features(text, p)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(float(share @ numbers[at]) + offset))), abs=1e-5)


def test_held_out_documents_are_told_apart(spark):
    sf = SF.replace("0.001", "0.1")
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in classifier.score_quality(d, l).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    known = [(out[i], q) for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall() if out[i].held_out]
    good, bad = [r for r, q in known if q == 1], [r for r, q in known if q == 0]
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert sum(r.predicted for r in bad) <= 0.05 * len(bad)


def test_labels_of_held_out_documents_teach_nothing(spark):
    rows = [(i, f"good words of text {i}" if i % 2 else "BAD ### BAD ###", "en") for i in range(200)] + [(None, None, None), (None, "x y", "en"), (3, "good words", None), (3, "good words", None), (501, "", "en"), (502, LONG, "en")]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = [(i, i % 2, 0) for i in range(200)] + [(None, 1, 1), (4, None, 0), (5, 1, 1)]
    turned = [(i, 1 - q if i in held and q is not None else q, t) for i, q, t in labels]
    frames = [spark.createDataFrame(x, LABELS).repartition(n) for x, n in ((labels, 1), (turned, 5))]
    one, two = (sorted(map(str, classifier.score_quality(docs(spark, rows).repartition(n), x).collect())) for x, n in zip(frames, (1, 7)))
    assert one == two and len(one) == len(rows)
    got = classifier.score_quality(docs(spark, rows), frames[0]).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id in held)


def test_sample_is_bounded(spark):
    rows = [(i, "word " * (i % 50 + 1), "en") for i in range(3_000)] + [(1, "again", "en")] * 3_000
    some = classifier.ClassifierParams(fit_docs=100, fit_chars=5_000)
    d = docs(spark, rows).select(F.col("doc_id").alias("id"), "text")
    l = spark.createDataFrame([(i, 1) for i in range(3_000)], "id long, label int")
    few = classifier.chosen(d, l, some).collect()
    assert 0 < len(few) <= 100 and len({r.id for r in few}) == len(few)
    lengths = [len(r.text) for r in sorted(few, key=lambda r: r.place)]
    assert sum(lengths[:-1]) <= 5_000


def test_no_labels_one_class_and_no_documents(spark):
    d = docs(spark, [(i, f"text {i}", "en") for i in range(20)])
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in classifier.score_quality(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    assert all(r.score > 0.5 for r in classifier.score_quality(d, one).collect())
    assert classifier.score_quality(docs(spark, []), one).count() == 0
