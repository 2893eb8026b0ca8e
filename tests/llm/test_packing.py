import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from presencia.llm import packing as M

TEXTS = [
    None, "", "it's don't. İstanbul ΣΑΣ ΟΔΟΣ. a b́ c\x1cd 12.5, é. <|endoftext|>", "x " * 9000, "Å.,.. \x85 ok, Kelvin K 你好,世界。 ﬁ\r\n\x0b\x0cq.", "same words", "same words",
    "Ａ ǅ ᾳ ß ẞ ŉ. ª. İ, I'LL we'Re 'S x's. o'm", "​   　 ﻿",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, length int, piece string")


def test_pieces_equal_the_tokenizer(spark):
    coder = Tokenizer.from_file(M.tokenizer_path())
    coder.encode_special_tokens = True
    rows = list(enumerate(TEXTS)) + [(None, "no id")]
    for cap, most in ((4096, 200_000_000), (16, 500)):
        want = []
        for i, t in rows:
            ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
            want += [(str(i), n, at, len(ids[at : at + cap]), zlib.crc32(np.array(ids[at : at + cap], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), cap))]
        out = M.pack_documents(frame(spark, rows), M.PackParams(capacity=cap, cache_bytes=most)).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
        assert_packed(out, cap)


def test_ids_of_decomposed_letters():
    """Any letters beside any marks, upper and lower case."""
    coder = Tokenizer.from_file(M.tokenizer_path())
    coder.encode_special_tokens = True
    mine, rng = M.WordIds(M.tokenizer_path(), 1_000_000), random.Random(9)
    for _ in range(6_000):
        text = "".join(rng.choice("JTHWYAEIjthwyaei") + rng.choice(["", "", "\u030c", "\u0308", "\u0331", "\u030a", "\u0301"]) + rng.choice(["", "", "", " ", "."]) for _ in range(rng.randint(1, 8)))
        want = np.array(coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert mine.ids(text.encode()) == want, text


def assert_packed(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    return len(by)


def brute_place(state, cap, size):
    """Try every gap and a new bin; the least sum of squares, then the tighter."""
    options = []
    for gap in [g for g in state if state[g] and g >= size] + [None]:
        new = dict(state)
        if gap is not None:
            new[gap] -= 1
        left = (cap if gap is None else gap) - size
        if left:
            new[left] = new.get(left, 0) + 1
        options.append((sum(v * v for v in new.values()), gap is None, gap or 0, new))
    return min(options, key=lambda o: o[:3])


def test_placement_minimises_the_sum_of_squares():
    rng, cap = random.Random(3), 24
    packer, state = M.SumOfSquares(cap), {}
    for _ in range(400):
        size = rng.randint(1, cap)
        cost, _, _, state = brute_place(state, cap, size)
        packer.place(size)
        assert int((packer.count[1:] ** 2).sum()) == cost
        got = {g: int(packer.count[g]) for g in range(1, cap + 1) if packer.count[g]}
        assert got == {g: v for g, v in state.items() if v}


def test_waste_is_small_over_several_packers(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 100)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, length long")
    out = M.pack(df, M.PackParams(capacity=100, packer_items=500)).collect()
    assert sorted((r.k, r.length) for r in out) == rows
    assert assert_packed(out, 100) <= 1.035 * sum(n for _, n in rows) / 100 + 8


def test_empty_and_repeated(spark):
    assert M.pack_documents(frame(spark, [])).count() == 0
    assert M.pack_documents(frame(spark, [(1, "a b")] * 3)).count() == 3


def test_sequences_hold_the_ids(spark):
    out = M.packed_sequences(frame(spark, [(1, "a b c"), (2, "d e")]), M.PackParams(capacity=8)).collect()
    assert sorted(len(r.ids) for r in out) == [7] and all(r.ids.count(1) == 2 for r in out)
