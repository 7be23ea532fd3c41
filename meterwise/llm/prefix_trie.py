"""The trie of conversations that begin alike, and what sharing their beginnings would save.

A node is a sequence of turns, known by a hash chained from turn to turn. Nodes are dealt by prefix to shards, each the
subtree of a node below which at most LIMIT turns lie; a task builds the succinct trie of its shards, a LOUDS bit vector
and labels in level order, and rolls it up from the last level to the first. The levels above the shards, whose
nodes may hold any share of the conversations, are merged separately by sums over the conversations that run through them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_spread
from .common import few_rows, stored

#: Turns of all conversations below the top of a shard, nodes that one trie is built for at least, if there are as many, and ids
#: that are joined to one text.
LIMIT, NODES, IDS = 100_000, 50_000, 2_000
ROOT = bytes(16)


def with_depth(turns: DataFrame) -> DataFrame:
    """turns with their depth, from 0 on, instead of pos, and len, the depth of their conversation's last turn."""
    of_conv = Window.partitionBy("conv_id")
    depth, size = F.row_number().over(of_conv.orderBy("pos")).cast("long") - 1, F.count("*").over(of_conv) - 1
    return turns.select("conv_id", depth.alias("depth"), size.alias("len"), "label", "words")


def labelled(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, label, words) of each turn in order: a digest of its role and text, and the words of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", label.alias("label"), words.alias("words"))
    return turns.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "label")).cast("long") - 1).alias("i"), "label", "words")


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The conversations of `labelled` turns with their first h turns taken from the conversation conv_id - conv_id % every, h being
    the CRC-32 of the id modulo `most`; (conv_id, pos, label, words), and a row without turn at pos -1 for each conversation."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    convs = own.where("i = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    heads = own.where((F.col("i") < most - 1) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "i", "label", "words")
    inherited = convs.join(heads, "base").where("i < h").select("conv_id", F.col("i").alias("pos"), "label", "words")
    rest = own.where(F.col("i") >= h).select("conv_id", (F.col("i") + most).alias("pos"), "label", "words")
    start = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("words"))
    return inherited.unionByName(rest).unionByName(start)


def chained(rows: DataFrame) -> DataFrame:
    """rows of `with_depth` with the node that each turn leads to and its parent, hashes of 128 bits chained along a
    conversation; a task holds one hash of it, however long it is."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = ROOT
        for batch in batches:
            nodes, parents = [], []
            for depth, label in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parents.append(node if depth else None)
                node = hashlib.blake2b(node + label, digest_size=16).digest() if depth else ROOT
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())], names=["conv_id", "depth", "len", "words", "node", "parent"])

    in_order = rows.sortWithinPartitions("conv_id", "depth")  # the windows have put a conversation into one partition
    return in_order.mapInArrow(run, f"conv_id {kind}, depth long, len long, words long, node binary, parent binary")


class Louds:
    """A forest as a bit vector: a run of ones for the roots and then for each node, in level order, one for each of its children, each
    run ended by a zero. Node i is the one bit i; `levels` are where levels begin, and the end."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        ones = np.flatnonzero(bits)
        #: of node i, the zeros before its bit number its parent from 1 on; 0 is above the roots
        self.parents = ones - np.arange(len(ones)) - 1
        self.degrees = np.bincount(self.parents[self.parents >= 0], minlength=len(ones))
        self.levels, end = [0], int(np.count_nonzero(self.parents < 0))
        while end > self.levels[-1]:
            self.levels.append(end)
            end = int(np.searchsorted(self.parents, end))  # children of the level stand before those of the next

    @classmethod
    def of(cls, parent_rows: np.ndarray, depth: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray]:
        """The trie of rows that name their parents' rows (-1: none), and the rows in its order; siblings are ordered by label."""
        place = np.full(len(depth), -1)
        by_depth = np.argsort(depth, kind="stable")
        edges = np.flatnonzero(np.diff(depth[by_depth], prepend=-1)).tolist() + [len(depth)]
        order, at = [], 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = by_depth[a:b]
            above = np.where(parent_rows[rows] < 0, -1, place[parent_rows[rows]])
            rows = rows[np.lexsort((labels[rows], above))]
            place[rows] = np.arange(at, at + len(rows))
            at += len(rows)
            order.append(rows)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        above = np.where(parent_rows[order] < 0, 0, place[parent_rows[order]] + 1)
        bits = np.zeros(2 * len(order) + 1, bool)
        bits[np.arange(len(order)) + above] = True
        return cls(bits), order

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """For each node the sum of values in its subtree, from the last level to the first."""
        total = values.copy()
        for a, b in reversed(list(zip(self.levels[1:-1], self.levels[2:], strict=True))):
            np.add.at(total, self.parents[a:b], total[a:b])
        return total


def _numbered(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays of (n, 2) halves of keys as numbers, equal for equal keys."""
    both = np.concatenate(keys)
    order = np.lexsort((both[:, 1], both[:, 0]))
    new = np.concatenate(([False], (both[order][1:] != both[order][:-1]).any(1)))
    numbers = np.empty(len(both), np.int64)
    numbers[order] = np.cumsum(new)
    return np.split(numbers, np.cumsum([len(k) for k in keys])[:-1])


def _halves(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def _shard_rows(table: pa.Table) -> pa.RecordBatch:
    """What a trie of whole shards knows of its nodes."""
    table = table.combine_chunks()
    node, parent = _numbered([_halves(table["node"]), _halves(table["parent"])])
    depth = table["depth"].to_numpy() - table["top"].to_numpy()
    rows = np.full(max(node.max(), parent.max()) + 1, -1)
    rows[node] = np.arange(len(node))
    parents = np.where(depth > 0, rows[parent], -1)
    trie, order = Louds.of(parents, depth, node)
    n, words, convs = (table[c].to_numpy()[order] for c in ("n_convs", "words", "conv_id"))
    above = trie.parents
    columns = {
        "node": table["node"].combine_chunks().take(pa.array(order)),
        "parent": table["parent"].combine_chunks().take(pa.array(order)),
        "conv_id": pa.array(convs),
        "depth": pa.array(table["depth"].to_numpy()[order]),
        "parent_conv_id": pa.array(convs[np.maximum(above, 0)], mask=above < 0),
        "n_convs": pa.array(n),
        "n_children": pa.array(trie.degrees.astype(np.int64)),
        "n_leaves": pa.array(trie.rolled_up((trie.degrees == 0).astype(np.int64))),
        "saved_tokens": pa.array(trie.rolled_up((n - 1) * words)),
    }
    return pa.RecordBatch.from_pydict(columns)


def shard_tries(nodes: DataFrame) -> DataFrame:
    """Light nodes (shard, top, node, parent, depth, n_convs, words, conv_id) with what their tries say: n_children, n_leaves and
    saved_tokens, and their parents' conv_id but for the tops of shards."""
    kind = nodes.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            shards = batch.column(0).to_pylist()
            if count >= NODES:  # a trie ends with a shard
                last = held[-1].column(0)[-1].as_py()
                cut = next((i for i, s in enumerate(shards) if s != last), None)
                if cut is not None:
                    yield _shard_rows(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield _shard_rows(pa.Table.from_batches(held))

    dealt = nodes.select("shard", "top", "node", "parent", "depth", "n_convs", "words", "conv_id").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, f"node binary, parent binary, conv_id {kind}, depth long, parent_conv_id {kind}, n_convs long, n_children long, n_leaves long, saved_tokens long")


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the digest of a node's ids in order, joined by commas.

    Ids are dealt by ranges of (node, conv_id) and joined to texts of IDS ids first, so the task that digests a node that holds
    most conversations takes one row for so many of them, and holds one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for of, id_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (of != node or len(ids) == IDS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = of
                ids.append(id_)
            if out:
                yield made(out, batch.schema.types[1])
        if ids:
            yield made([(node, ids[0], ",".join(map(str, ids)))], pa.int64())

    def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], pa.string())], names=["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for batch in batches:
            out = []
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if of != node:
                    if node is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = of, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    joined = ends.select("node", F.col("conv_id").cast("long").alias("conv_id")).repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, ids string")
    return few_rows(joined.repartition("node").sortWithinPartitions("node", "first")).mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each node of the trie of conversations (conv_id, pos, label, words; each has a row without turn at pos -1):
    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (of its subtree: for each
    node the words of its last turn, once for each member but one), ends_sha256 (of the ids that end there).

    A node below which more than `limit` turns lie, all its conversations counted, belongs to the upper levels; so do the
    nodes above it. The topmost others are the tops of shards. No conversation, shared beginning or group of equal conversations,
    however large, needs the memory of a task. An empty table gives no rows.
    """
    walked = stored(chained(with_depth(rows)), "trie-turns")
    below = F.sum(F.col("len") - F.col("depth") + 1).alias("below")
    facts = [F.first(c).alias(c) for c in ("parent", "depth", "words")]
    nodes = stored(walked.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), below, *facts), "trie-nodes")
    upper = nodes.where((F.col("depth") == 0) | (F.col("below") > limit))
    light = nodes.where((F.col("depth") > 0) & (F.col("below") <= limit))
    # the rows of conversations within the upper levels, and how deep these go in each
    through = stored(join_spread(walked, upper.select("node", F.col("n_convs").alias("size")), ["node"], "size", walked.count()).select("conv_id", "depth", "node"), "trie-upper")
    tops = through.groupBy("conv_id").agg((F.max("depth") + 1).alias("top"))
    shards = walked.join(tops, "conv_id").where("depth = top").select("conv_id", F.col("node").alias("shard"), "top")
    tries = stored(shard_tries(light.join(shards, "conv_id")), "tries")
    roots = tries.where("parent_conv_id IS NULL")
    children = upper.where("depth > 0").select("parent").unionAll(roots.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children"))
    known = upper.join(children.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["n_children"])
    # each node's own share stands in its smallest conversation; what lies below a turn of it counts for the node there
    own = known.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    own = own.unionByName(roots.select("conv_id", "depth", "n_leaves", "saved_tokens")).withColumn("node", F.lit(None).cast("binary"))
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda name: F.coalesce(F.sum(name).over(from_end), F.lit(0))
    sums = through.unionByName(own, allowMissingColumns=True).select("node", total("n_leaves").alias("n_leaves"), total("saved_tokens").alias("saved_tokens"))
    sums = sums.where("node IS NOT NULL").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    merged = stored(known.join(sums, "node").select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie-merged")
    outer = merged.where("depth > 0").unionByName(roots.drop("parent_conv_id"))
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    outer = stored(outer, "trie-outer")
    under = join_spread(outer, parents.withColumnRenamed("n_children", "size"), ["parent"], "size", outer.count())
    names = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    top = merged.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(walked.schema["conv_id"].dataType))
    every = tries.where("parent_conv_id IS NOT NULL").select(*names).unionByName(under.select(*names)).unionByName(top.select(*names))
    digests = end_digests(walked.where("depth = len"))
    return every.join(digests, "node", "left").select(*names[1:], F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """prefix_trie of conversations (conv_id, turn, role, text) whose beginnings are taken from every twentieth one: see `rebuilt`.

    Turns are in order of their number, null first, those of one number in that of a hash of their role and text; null roles and
    texts are empty; texts of any length are read whole; repeated rows are turns of their own. Rows without conv_id belong to
    no conversation and are left out. An empty table gives no rows; other columns are ignored.
    """
    return prefix_trie(rebuilt(stored(labelled(conversations), "trie-labels")), limit)
