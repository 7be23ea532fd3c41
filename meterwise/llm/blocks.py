"""Links between nodes that share buckets, found block by block.

Nodes of one bucket that earlier links have joined need no comparison. Of the others each must meet each, and a bucket
may hold a third of all nodes; so a bucket is dealt into blocks, each pair of blocks is compared in one task, and only
links leave it. What a task holds is bounded by the sizes of two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY = ["bucket", "kind", "i", "j"]
BLOCK = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("component", pa.int64())])
#: near(bucket, sketches, n, others): of the positions `others`, those alike to n by their sketches, with a score; only
#: if `bucket` is the first that both share, so that a pair is compared once.
Near = Callable[[int, list, int, list], list[tuple[float, int]]]
#: prepare(bodies) gives what linked(x, y) compares.
Prepare = Callable[[list], list]


def deal(buckets: DataFrame, labels: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Rows of BLOCK for buckets (bucket, node, bytes) that hold several components of labels (node, component).

    The nodes of a bucket's largest component and all others are dealt into blocks of about `block` nodes or
    `block_bytes`. Each block of others meets every block; two blocks of the largest component never meet.
    """
    rows = buckets.join(labels, "node", "left").select("bucket", "node", "bytes", F.coalesce("component", "node").alias("component"))
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    top = F.max(F.struct("n", "bytes", "component")).alias("top")
    split = parts.groupBy("bucket").agg(top, F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / block_bytes), F.lit(1)).cast("int")
    split = split.select("bucket", F.col("top.component").alias("largest"), blocks(F.col("top.n"), F.col("top.bytes")).alias("k"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others"))
    dealt = rows.join(split, "bucket").withColumn("main", F.col("component") == F.col("largest"))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("k")).otherwise(F.col("others"))).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("others")).otherwise(F.col("k") + F.col("others")) - 1)))
    main, mixed, o = F.col("main"), F.col("x") < F.col("k"), F.col("x") - F.col("k")
    return dealt.select(
        "bucket",
        F.when(main | mixed, 0).otherwise(1).alias("kind"),
        F.when(main, F.col("home")).when(mixed, F.col("x")).otherwise(F.least("home", o)).alias("i"),
        F.when(main, F.col("x")).when(mixed, F.col("home")).otherwise(F.greatest("home", o)).alias("j"),
        F.when(main, 0).when(mixed, 1).otherwise((F.col("home") > o).cast("int")).alias("side"),
        "node",
        "component",
    )


def _pairs(rows: list, near: Near) -> list[tuple[int, int]]:
    """The pairs of positions in different components that are near, the best first."""
    left = [n for n, r in enumerate(rows) if r[4] == 0]
    right = [n for n, r in enumerate(rows) if r[4] == 1]
    sketches, found = [r[7:9] for r in rows], []
    for n in left:
        others = [m for m in right or left if rows[m][6] != rows[n][6] and (right or m > n)]
        if others:
            found += [(score, n, m) for score, m in near(rows[n][0], sketches, n, others)]
    return [(n, m) for _, n, m in sorted(found, key=lambda f: (-f[0], f[1], f[2]))]


def _compare(near: Near, prepare: Prepare | None, linked: Callable[[Any, Any], bool] | None):
    def result(rows: list) -> pa.RecordBatch:
        found = _pairs(rows, near)
        used = sorted({n for pair in found for n in pair})
        if prepare is None:
            return pa.RecordBatch.from_arrays([pa.array([rows[n][c] for n in used], kind) for c, kind in enumerate(BLOCK.types)], names=BLOCK.names)
        bodies = dict(zip(used, prepare([rows[n][9] for n in used]), strict=True)) if used else {}
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        out: tuple[list, list] = ([], [])
        for n, m in found:
            c, d = root(rows[n][6]), root(rows[m][6])
            if c != d and linked(bodies[n], bodies[m]):
                up[c] = d
                out[0].append(rows[n][5])
                out[1].append(rows[m][5])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:4] != key:
                    if rows:
                        yield result(rows)
                    key, rows = r[:4], []
                rows.append(r)
        if rows:
            yield result(rows)

    return run


def crossing_links(buckets: DataFrame, labels: DataFrame, sketches: DataFrame, bodies: DataFrame, near: Near, prepare: Prepare, linked: Callable[[Any, Any], bool], block: int = 512, block_bytes: int = 8 << 20) -> DataFrame:
    """Links (a, b) between nodes that share a bucket but no component: all of them, but for those that join what others
    join already. sketches has (node, keys, sketch), bodies (node, body); bodies go only to block pairs where a node has
    a pair whose sketches are near.
    """
    dealt = deal(buckets, labels, block, block_bytes)
    signed = dealt.join(sketches, "node").select(*BLOCK.names, "keys", "sketch").repartition(*KEY).sortWithinPartitions(*KEY, "node")
    alike = stored(signed.mapInArrow(_compare(near, None, None), "bucket long, kind int, i int, j int, side int, node long, component long"), "alike")
    wanted = bodies.join(alike.select("node").distinct(), "node", "left_semi")  # so that only these bodies move if they are few
    whole = alike.join(sketches, "node").join(wanted, "node").select(*BLOCK.names, "keys", "sketch", "body")
    return whole.repartition(*KEY).sortWithinPartitions(*KEY, "node").mapInArrow(_compare(near, prepare, linked), "a long, b long").distinct()
