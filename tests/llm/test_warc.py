import gzip
import json
import os
import time
from collections import defaultdict

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from meterwise.llm import warc as W

ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3", None), (4, None, ""), (5, "http://a/5", "é" * 90_000), (7, "u", "short"), (6, "u", "short"), (8, "two\r\nlines", "x"), (None, "n", "<p>same</p>"), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n")]


def brute(rows, least):
    by = defaultdict(list)
    for i, _, t in rows:
        by[t or ""].append(i)
    out = []
    for i, _, t in rows:
        data, same = (t or "").encode(), [x for x in by[t or ""] if x is not None]
        first = min(same, default=None) if len(data) >= least else None
        revisit = first is not None and first != i
        out.append((i, len(data), W.digest(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    for least in (0, 6):
        got = W.archived_pages(pages, least=least)
        assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, least)


def test_filters_are_pushed_and_payloads_decoded(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    W.write_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    df = W.read_warc(spark, path).where("record_type = 'response' and content_length > 1000")
    rows = df.collect()
    assert [bytes(r.payload).decode() for r in rows] == ["é" * 90_000]
    assert rows[0].computed_digest == rows[0].payload_digest
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert W.read_warc(spark, path, "skip").where("record_type <> 'revisit'").where(F.col("payload").isNotNull()).count() == 0
    assert W.read_warc(spark, path).where("refers_to is null and http_status = 200").count() == 6
    W.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert W.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_unfinished_files_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/w"
    W.write_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string"), f"file://{path}")
    with open(f"{path}/part-000000-of-a-lost-task.warc.gz", "wb") as f:
        f.write(b"\x1f\x8bcut off")
    assert W.read_warc(spark, f"file://{path}").count() == len(ROWS)
    assert any(x.startswith("_manifest-") for x in os.listdir(path))


def plain(kind, block, more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:7>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(tmp_path):
    parts = [plain("warcinfo", b"software: x\r\n"), plain("response", b"HTTP/1.1 404 Gone\r\nA: b\r\n\r\n" + b"y" * 200_000, "Content-Type: application/http; msgtype=response\r\n"), plain("resource", b"z" * 70_000)]
    where = fs.LocalFileSystem()
    for name, data in (("a.warc", b"".join(parts)), ("b.warc.gz", b"".join(map(gzip.compress, parts)))):
        (tmp_path / name).write_bytes(data)
        for mode in ("decode", "skip"):
            with where.open_input_file(str(tmp_path / name)) as f:
                rows = list(W.records(f, name, lambda r: r["record_type"] != "warcinfo", mode))
            assert [(r["record_type"], r["http_status"], r["payload_length"]) for r in rows] == [("response", 404, None), ("resource", None, 70_000)]
            assert [len(r["payload"] or b"") for r in rows] == ([200_000, 70_000] if mode == "decode" else [0, 0])
            assert pa.RecordBatch.from_pylist(rows, W.ARROW).num_rows == 2


def test_many_files_are_planned_fast_and_an_empty_first_one_too(spark, tmp_path):
    for i in range(20_000):
        (tmp_path / f"{i:06}.warc").touch()
    began = time.perf_counter()
    assert len(W.WarcReader({"path": f"file://{tmp_path}"}).partitions()) == 1
    (tmp_path / "_manifest-x").write_text(json.dumps([f"{i:06}.warc" for i in range(15_000)]))
    [planned] = W.WarcReader({"path": f"file://{tmp_path}"}).partitions()
    assert len(planned.files) == 15_000 and time.perf_counter() - began < 5


def test_no_pages(spark):
    assert W.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
