"""One text of five million characters, its near copy and short texts through
every operator on documents, against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from presencia.llm import classifier, filteraudit, fim, langid, linededup, neardup, packing, quality, secrets, simhash
from tests.llm.test_other_operators import brute_counts

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnoprstuvwz") for _ in range(RNG.randint(2, 9))) for _ in range(20_000)]


def prose(n):
    return "\n".join(" ".join(RNG.choices(VOCABULARY, k=min(12, n - at))) for at in range(0, n, 12))


PASSAGE, KEY = prose(60), "token=abcdEFGH1234ijkl"
LONG = f"{prose(800_000)}\n{PASSAGE}\nthe end é {KEY} fin"
NEAR = LONG.replace("the end", "another end")
TEXTS = {2: f"{prose(90)}\n{PASSAGE}\n{prose(90)}", 4: LONG, 6: NEAR, 8: prose(300)}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    spark.createDataFrame([(i, t, "en", "s") for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i > 2), 0) for i in TEXTS], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_the_text_is_long():
    assert len(LONG) > 4_900_000


def test_simhash(table):
    got = by_id(simhash.simhash_components(table))
    for i, text in TEXTS.items():
        words = text.lower().split()
        h = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)], np.uint64)
        bits = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
        assert got[i].fingerprint == f"{bits:016x}"
    assert got[4].component_id == got[6].component_id == 4


def test_near_dedup(table):
    assert sorted(by_id(neardup.near_dedup(table, neardup.NearParams()))) == [2, 4, 8]


def test_secrets(table):
    got = by_id(secrets.snapshot_report(table))
    for i in (4, 6):
        start = TEXTS[i].index(KEY)
        assert got[i].n_assign == 1 and f"assign:{start}:{start + len(KEY)}" in got[i].spans.split(",")


def test_packing(table):
    from public_tokenizers import path

    tokenizer = Tokenizer.from_file(str(path("word_bpe_49k.json")))
    rows = packing.pack_documents(table).collect()
    for i, text in TEXTS.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        n = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        assert [r.start for r in pieces] == list(range(0, n, 4096)) and sum(r.length for r in pieces) == n


def test_language_and_quality_scores(table, labels):
    assert all(r.lang_pred == "en" and 0 <= r.score <= 1 for r in langid.identify(table).collect())
    scores = by_id(classifier.score_quality(table, labels))
    assert sorted(scores) == sorted(TEXTS) and all(0 <= r.score <= 1 for r in scores.values())


def test_quality_counts(table):
    got = by_id(quality.quality_report(table))
    for i, text in TEXTS.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text)


def test_shared_passage(table):
    got = {i: r.text for i, r in by_id(linededup.line_dedup(table)).items()}
    assert got[2] == TEXTS[2] and got[8] == TEXTS[8]
    assert PASSAGE not in got[4] and PASSAGE not in got[6]
    # what the near copy shares with the first long text goes as well
    assert len(got[4]) == len(LONG) - len(PASSAGE) - 1 and "another end" in got[6] and len(got[6]) < 1_000


def test_fill_in_middle(table):
    got = by_id(fim.fim_report(table))
    for i, text in TEXTS.items():
        assert got[i].n == len(re.findall("[A-Za-z]+|[^A-Za-z]", text))
        assert got[i].restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_filter_audit(table, labels):
    rows = filteraudit.audit(table, labels).where("step = 1").groupBy("part").agg(F.min(F.col("kept") + F.col("removed")), F.max(F.col("kept") + F.col("removed"))).collect()
    assert [tuple(r) for r in rows] == [("en", 4, 4)]
    # two long texts hold few different words for their length, the two shortest have 240 and 300 words
    fails = {r.filter_order[0]: r.removed for r in filteraudit.audit(table, labels).where("step = 1").select("filter_order", "removed").distinct().collect()}
    assert fails == {"A": 0, "B": 2, "C": 0, "D": 0, "E": 0}
