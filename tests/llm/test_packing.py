import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meterwise.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_cover_the_ids_and_sequences_have_no_gaps(spark, tokenizer):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Ω", "\n", "x1"]) for _ in range(rng.choice([0, 1, 3, 30, 200, 700])))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "a null id"), (5, "again"), (5, "again"), (1002, "see <|endoftext|> here"), (1003, "<|endoftext|>"), (1004, "long " * 60_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, piece int").repartition(5)
    packed = P.best_fit_packing(docs, PATH, end=2, capacity=64, with_ids=True)
    out = packed.collect()
    places, whole = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        places[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.piece, r.start, bytes(r.ids)))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in rows:
        if i == 5:
            continue
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(whole[i])
        assert b"".join(p[2] for p in parts) == ids.tobytes()
        assert [p[1] for p in parts] == [sum(len(q[2]) // 4 for q in parts[:k]) for k in range(len(parts))]
        assert all(len(p[2]) == 256 for p in parts[1:])
    total = sum(r.length for r in out)
    assert len(places) <= 1.1 * total / 64 + 5
    rebuilt = P.sequences(packed).collect()
    assert sum(r.length for r in rebuilt) == total
    assert all(len(r.ids) == 4 * r.length for r in rebuilt)


def test_best_fit_and_bounded_space():
    s = P.OpenSequences(10, 2)
    assert [s.place(n) for n in (6, 7, 3, 4, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    s = P.OpenSequences(10, 2)
    for n in (6, 7, 8):
        s.place(n)
    assert s.open == 2 and s.place(3) == (0, 6)  # the fullest, with 7, has closed
    assert s.place(2) == (2, 8)


def test_first_piece_is_the_short_one():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [(p, s, len(i) // 4) for p, s, i in P.pieces_of(ids, 4)] == [(0, 0, 2), (1, 2, 4), (2, 6, 4)]
    assert [(p, s, len(i) // 4) for p, s, i in P.pieces_of(ids, 5)] == [(0, 0, 5), (1, 5, 5)]


def test_empty(spark):
    assert P.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_special_tokens_are_those_of_the_library(tokenizer):
    texts = ["see <|endoftext|> here", "<|endoftext|>", "<|endof text|>", "plain", "a <|endoftext|><|endoftext|>  b"]
    got = [np.frombuffer(x, "<u4").tolist() for x in P.tokenizer_of(PATH)(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def packed_by_scanning(lengths, capacity, most):
    """Best fit over a plain list of open sequences, the one filled last at its end."""
    open_, out, begun = [], [], 0
    for n in lengths:
        fits = [s for s in open_ if s[1] >= n]
        if fits:
            least = min(s[1] for s in fits)
            found = [s for s in fits if s[1] == least][-1]
            open_.remove(found)
        else:
            found = (begun, capacity)
            begun += 1
            if n < capacity and len(open_) == most:
                least = min(s[1] for s in open_)
                open_.remove([s for s in open_ if s[1] == least][-1])
        out.append((found[0], capacity - found[1]))
        if found[1] > n:
            open_.append((found[0], found[1] - n))
    return out


@pytest.mark.parametrize("most", [1, 3, 50, 1000])
def test_packing_equals_an_independent_packer(spark, most):
    rng = random.Random(most)
    rows = [(i, 0, rng.choice([1, 64, rng.randrange(1, 65)]), rng.randrange(2**32)) for i in range(1500)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")
    got = {r.doc_id: (r.sequence_id, r.offset) for r in P.pack(pieces.repartition(7), 64, most).collect()}
    assert got == dict(enumerate(packed_by_scanning([r[2] for r in rows], 64, most)))
