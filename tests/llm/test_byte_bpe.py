import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from meterwise.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    found = ["", " ", "  a", "a  ", "a b", " a b\n c", "<|endoftext|> x", "it's we'll", "漢字" * 200, "a" * 3000, "%*" * 900, "x" * 63 + "y", "é" * 40, "w " * 50_000]
    found += ["".join(rng.choice(" \n\t\x85  \x1cab'sdré1²漢😀_-.") for _ in range(rng.randrange(80))) for _ in range(400)]
    return found


def test_ids_equal_the_library_and_decode_to_the_text(spark, library):
    rows = [(i, t, "e") for i, t in enumerate(texts())] + [(None, None, "n"), (3, "a b", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    out = B.bpe_decode(B.bpe_encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = sorted((str(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in out) == want


def test_both_trees_agree():
    vocabulary, rng = B.ranks_of(PATH), random.Random(4)
    for n in range(1, 65):
        piece = bytes(rng.choice(b"aeinorst ,%\xc3\xa9") for _ in range(n))
        assert B.merge_short([piece, b"x" * n], vocabulary)[0] == B.merge_long(piece, vocabulary)


def test_cache_is_bounded():
    asked = []
    encode = B.CachedEncoder(lambda heads, words: asked.append(len(words)) or [c.encode() for c in (*heads, *(f" {w}" for w in words))], cache_bytes=1000)
    for n in range(40):
        text = " ".join(f"w{n}x{i}" for i in range(20))
        assert encode([text]) == [text.encode()]
        assert len(encode.known) <= 20


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.bpe_encode(docs, PATH, public_tokenizers.PATTERN).count() == 0
    encoded = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert B.bpe_decode(encoded, PATH).where(F.col("decoded").isNull()).count() == 1


def test_patterns_that_join_words_need_whole_texts(spark):
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = r"\S+ \S+|\S+|\s+"
    library = tiktoken.Encoding("joined", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(1, "two words and one more"), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in B.bpe_encode(docs, PATH, pattern, cut_at_blanks=False).collect()}
    assert got == {1: library.encode_ordinary("two words and one more"), 2: library.encode_ordinary("a b")}
