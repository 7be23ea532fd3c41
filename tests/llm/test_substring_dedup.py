import random
import re

import numpy as np
import pyarrow as pa
import pytest

from meterwise.llm import substring_dedup as S


def brute(rows, window=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for a in range(len(w) - window + 1):
                if least[tuple(w[a : a + window])] < i:
                    gone |= set(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "漢字", "A", "a"]
    passages = [[rng.choice(words) for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = []
    for n in range(150):
        text = []
        for _ in range(rng.randrange(6)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(30))]
        rows.append((rng.randrange(10_000) if n else 0, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(5, "x " * 40), (6, "x " * 30), (7, "x y " * 30), (8, None), (9, ""), (None, "x " * 40), (None, None), (6, "x " * 30), (11, " ".join(f"w{i % 40}" for i in range(30_000)))]
    return rows


@pytest.mark.parametrize(("group", "parts", "marks"), [(50_000, 5, 9), (3, 5, 100_000), (3, 1, 100_000), (1, 9, 100_000), (2, 4, 0)])
def test_equals_brute_force(spark, monkeypatch, group, parts, marks):
    monkeypatch.setattr(S, "MARKS", marks)
    rows = corpus(group + parts)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, place int").repartition(parts)
    got = S.remove_repeats(docs, group=group).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_batches_and_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH", 300)
    rows = corpus(77)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, S.remove_repeats(docs, group=20).collect()), key=str) == brute(rows)


def test_texts_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame(corpus(1), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    out = S.remove_repeats(spark.read.parquet(f"{tmp_path}/docs"))
    out.write.format("noop").mode("overwrite").save()
    found = out._jdf.queryExecution().executedPlan()
    out.collect()
    assert "ReusedExchange" in found.toString() or "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_are_counted_over_all_batches():
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(12)]
    texts = [" ".join([f"a{rng.random()}" for _ in range(15)] + shared + [f"b{rng.random()}" for _ in range(15)]) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 10)), pa.array(range(a, a + 10), pa.int32()), pa.array(texts[a : a + 10])], names=["doc_id", "tag", "text"]) for a in range(0, 40, 10)]
    prefixes, counts = np.unique(S.Suffixes([t.encode() for t in texts], S.WINDOW, S.PREFIX).prefix, return_counts=True)
    rows = pa.Table.from_batches([b for batch in batches for b in S._places(S.WINDOW, S.PREFIX)(iter([batch]))])
    rows = rows.sort_by([("prefix", "ascending"), ("doc_id", "ascending")])
    own = rows.filter(rows["prefix"].is_valid())  # what is dealt by prefix
    top = int(counts.max())  # which shared prefixes are sampled depends on the hash, in all texts or nearly all
    assert top > 30
    for size in (7, 1000):
        for group in (20, top - 1, top):
            out = [b for b in S._shared(group)(iter(own.to_batches(max_chunksize=size)))]
            heavy = sorted(x for b in out for x in b.column(4).to_pylist() if x is not None)
            assert heavy == sorted(prefixes[counts > group].tolist())


def alternating(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_fool_polynomial_hashes_are_told_apart(spark):
    one = alternating(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    start = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{start} {one}"), (2, f"{start} {two}")], "doc_id long, text string")
    assert [r.n_removed for r in S.remove_repeats(docs).collect()] == [0, 0]


@pytest.mark.parametrize("lie", ["hashes", "prefixes"])
def test_equal_hashes_do_not_remove_words(spark, monkeypatch, lie):
    # every hash of words is 7, or of windows only: words themselves must decide
    monkeypatch.setattr(S.Words, "grams", lambda self, k, lane=0: np.full(max(len(self.hashes) - k + 1, 0), 7 if lie == "hashes" or k == S.PREFIX else k, np.uint64))
    rows = [(i, " ".join(f"{i}-{k}" if k % 3 else f"s{k}" for k in range(40))) for i in range(4)] + [(9, " ".join(f"2-{k}" if k % 3 else f"s{k}" for k in range(20)))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([list(range(36))] * 4 + [list(range(16))], pa.list_(pa.int32()))], names=["doc_id", "row", "text", "places"])
    found = pa.Table.from_batches(list(S._candidates(13, 5)(iter([batch])))).sort_by([("key", "ascending"), ("suffix", "ascending")])
    gone = set()
    for b in S._trees(13, 50_000)(iter(found.to_batches())):
        for r in b.to_pylist():
            gone |= {(r["doc_id"], k) for k in range(r["start"], r["stop"])}
    assert gone == {(9, k) for k in range(20)}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_nodes_of_subtrees_equal_pairs_of_windows(chunk):
    rng = random.Random(chunk)
    window = 4
    rows = []
    for n in range(120):
        key, before, after = rng.randrange(3), [rng.choice("ab") for _ in range(rng.randrange(3))], [rng.choice("ab") for _ in range(4)]
        stop = rng.randrange(4 - len(before), 5)
        start = rng.randrange(50)
        rows.append((key, rng.randrange(12), n, start, start + len(before) + stop, start + len(before), "".join(f"{w} " for w in before), f"{key} " + "".join(f"{w} " for w in after[: max(stop - 1, 0)])))
    rows.sort(key=lambda r: (r[0], r[7]))
    windows = [(r[0], r[1], r[2], r[5] - k, tuple(r[6].split()[len(r[6].split()) - k :]), tuple(r[7].split()[: window - k]), k) for r in rows for k in range(r[5] - r[4] + window, r[5] - r[3] + 1) if 0 <= k < window]
    want = {(w[2], w[3] + i) for w in windows if any(v[0] == w[0] and v[4:] == w[4:] and v[1] < w[1] for v in windows) for i in range(window)}
    table = pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(S.CANDIDATES.types)], schema=S.CANDIDATES)
    got = set()
    for b in S._trees(window, chunk)(iter(table.to_batches(max_chunksize=7))):
        for r in b.to_pylist():
            got |= {(r["row"], i) for i in range(r["start"], r["stop"])}
    assert got == want


def test_one_window_in_half_of_all_rows(spark):
    rng = random.Random(3)
    hot = " ".join(f"h{i}" for i in range(20))
    rows = [(n, " ".join([*(f"x{rng.random()}" for _ in range(8)), *([hot] if n % 2 else []), *(f"y{rng.random()}" for _ in range(8))])) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert sorted(map(tuple, S.remove_repeats(docs, group=3).collect()), key=str) == brute(rows)


def test_words_are_numbered_by_their_bytes_without_a_call_for_each():
    import cProfile
    import pstats

    from meterwise.llm.common import Words

    long = "x" * 40
    words = [*"aba", "é", "漢字", long, long + "y", long, "\x01", "", "a"]
    assert Words([" ".join(words[:4]).encode(), b"", "\n ".join(words[4:]).encode()]).numbers().tolist() == [0, 1, 0, 2, 3, 4, 5, 4, 6, 0]
    assert Words([]).numbers().tolist() == Words([b" \n"]).numbers().tolist() == []
    text = " ".join(f"w{i}" for i in range(20_000))
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "row": i, "text": text, "places": list(range(20_000))} for i in range(2)], pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text", pa.string()), ("places", pa.list_(pa.int32()))]))
    profile = cProfile.Profile()
    profile.enable()
    found = pa.Table.from_batches(list(S._candidates(13, 5)(iter([batch]))))
    profile.disable()
    gone = found.filter(pa.compute.is_null(found["key"]))
    assert set(gone["doc_id"].to_pylist()) == {1} and min(gone["start"].to_pylist()) == 0 and max(gone["stop"].to_pylist()) == 20_000
    assert pstats.Stats(profile).total_calls < 40_000
