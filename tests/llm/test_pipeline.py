import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_minhash_dedup import brute
from test_pii import brute_feistel
from test_toxicity import corpus
from tokenizers import Tokenizer

import corpus_pipeline
from meterwise.llm.packing import sequences
from meterwise.llm.pii import session_key


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Labelled documents, exact and near copies, personal data, nulls and repeated rows."""
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, t) for i, t, _, _ in corpus(1, 300)]
    labels = [(i, q, y) for i, _, q, y in corpus(1, 300)]
    rng = random.Random(4)
    for n in range(10):
        base = [f"n{n}w{rng.randrange(500)}" for _ in range(150)]
        for copy in range(4):
            text = list(base)
            if copy:
                text[rng.randrange(150)] = f"edit{copy}"
            rows.append((1000 + 10 * n + copy, " ".join(text)))
        rows.append((2000 + n, "\n".join(base)))
    rows += [(3005, " ".join(f"long{n % 7919}x{n}" for n in range(60_000)))]
    rows += [(3000, None), (3001, ""), (3002, " "), (3003, "write to ab.12@mail.example.com now"), (3004, "4429526289707580 does not check"), (1000, rows[300][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"{folder}", rows


def survivors(rows):
    """What the stages keep, by comparing everything with everything."""
    clean = [(i, t) for i, t in rows if not re.search("zlurk|vexnar", (t or "").lower())]
    groups = defaultdict(list)
    for i, t in clean:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i, t))
    one = [(i, t) for _, i, t in (min(g, key=lambda x: x[:2]) for g in groups.values())]
    kept = {i for i, _, _, k in brute(one) if k}
    return {i: t for i, t in one if i in kept}


def test_rows_equal_brute_force(spark, sf_dir):
    path, rows = sf_dir
    packed = corpus_pipeline.run(spark, path).persist()
    out = packed.collect()
    whole = sequences(packed).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in out) and max(r.length for r in whole) <= 1024
    want = survivors(rows)
    assert {r.doc_id for r in out} == want.keys()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import test_pii

    test_pii.KEY = session_key(spark)
    name = brute_feistel("ab.12", "email", "mail.example.com")
    want[3003] = want[3003].replace("ab.12", name)
    parts = defaultdict(list)
    for r in out:
        parts[r.doc_id].append((r.start, r.length, r.ids_crc32))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in want.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert sum(p[1] for p in parts[i]) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in parts[i])
    test_pii.KEY = "k"


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir[0]).columns == docs.columns, name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}").count() == 0
