"""Fingerprints of texts by context-triggered piecewise hashing, and how alike two of them are.

A hash of the last eight bytes rolls over a text; where its low bits are all ones, a piece ends. Pieces become one letter
each, so an edit changes the letters around it only. A fingerprint has the letters at a block size that gives about 32 to 64
of them and at twice that size; fingerprints are compared by edit distance where they share a block size.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows, mix, stored, text_batches

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Letters that a text of any size should have at most and at least, the least power of two as block size, and where a signature ends.
MOST, FEW, LEAST, LIMIT = 64, 16, 1, 128
#: Letters in a row that alike signatures share, and how many equal ones in a row count.
RUN, SAME = 4, 3
#: Bytes that are hashed at once.
BLOCK = 1 << 20


def piece_ends(data: bytes, bits: int) -> np.ndarray:
    """Where pieces of the block size 1 << bits end; block by block, so that a text of any length needs little memory."""
    mask, found = np.uint64((1 << bits) - 1), []
    for at in range(0, len(data), BLOCK):
        part = (data[at - 7 : at] if at else bytes(7)) + data[at : at + BLOCK]
        hashes = mix(np.ndarray((len(part) - 7,), "<u8", part, strides=(1,)).copy())
        found.append(np.flatnonzero(hashes & mask == mask) + (at + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def signature(data: bytes, ends: np.ndarray) -> str:
    """A letter for each piece; the last of LIMIT letters stands for all the rest."""
    view = memoryview(data)
    cuts = [0, *ends[: LIMIT - 1].tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join(LETTERS[zlib.crc32(view[a:b]) & 63] for a, b in itertools.pairwise(cuts))


def fingerprint(data: bytes) -> str:
    """block size:letters:letters at twice the size. A text with too few pieces, as of repeated bytes, gets smaller blocks."""
    bits = max(LEAST, (-(-len(data) // MOST) - 1).bit_length())
    ends = piece_ends(data, bits)
    while len(ends) < FEW and bits > LEAST:
        bits -= 1
        ends = piece_ends(data, bits)
    return f"{1 << bits}:{signature(data, ends)}:{signature(data, piece_ends(data, bits + 1))}"


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of the table in the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def _alike(a: str, b: str) -> float:
    a, b = ("".join("".join(itertools.islice(g, SAME)) for _, g in itertools.groupby(x)) for x in (a, b))
    if not any(a[i : i + RUN] in b for i in range(len(a) - RUN + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) as a share of the letters, the best of the block sizes that both
    have; 0 without RUN letters in a row in common, or without such a size; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (size, *first), (other, *second) = a.split(":"), b.split(":")
    sizes = [{int(s) << i: x for i, x in enumerate(two)} for s, two in ((size, first), (other, second))]
    return max((_alike(x, sizes[1][s]) for s, x in sizes[0].items() if s in sizes[1]), default=0.0)


def likeness_of(a: Column | str, b: Column | str) -> Column:
    """likeness of two columns of fingerprints; null where one is."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return alike(a, b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) for each row, of its whole text in UTF-8; a null text counts as empty. Repeated rows and null
    ids go through; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t.encode()) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return few_rows(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


#: What is known of a row once the next one is; edge is 1 for the first row of a partition, 2 for its last, which waits.
_FOUND = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGES = pa.schema([("edge", pa.int32()), ("part", pa.int32()), ("text", pa.string())])


def _against(text: str, own: str, after: str, next_: str) -> tuple:
    """The columns of _FOUND for a text and its fingerprint, and those of the next."""
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[:half]).encode()
    print_ = fingerprint(edited)
    return len(text), hashlib.sha256(edited).hexdigest(), own, print_, likeness(own, print_), likeness(own, next_)


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint against that of its text with the last half of the characters replaced by as many of the next row's
    first ones (or all), and against the next row's: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Rows follow each other by descending id, null ids at the end, and the last by the first; rows of one id are in the order
    of a hash of their texts. Texts are dealt by ranges of that order once, however many rows share an id; each task goes
    through its rows with one text in hand, and the first and last row of each partition meet in a join. A null text counts
    as empty, texts of any length are taken whole, a single row follows itself, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.withColumns({"hash": order[1], "place": order[2]}).repartitionByRange(order[0], "hash", "place").sortWithinPartitions(order[0], "hash", "place").select("doc_id", "text")
    found = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double' if f.type == pa.float64() else 'string'}" for f in _FOUND)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        none = (None,) * len(_FOUND)

        def made(ids: list, rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*_FOUND.types, *_EDGES.types]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *_FOUND.names, *_EDGES.names])

        id_kind = None
        for batch, texts in text_batches(batches, 1):
            id_kind, ids, out = batch.schema.types[0], [], []
            for id_, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                own = fingerprint(text.encode())
                if held is None:
                    ids.append(id_)
                    out.append((*none[:2], own, *none[3:], 1, part, text))
                else:
                    ids.append(held[0])
                    out.append((*_against(*held[1:], text, own), 0, part, None))
                held = id_, text, own
            if out:
                yield made(ids, out)
        if held is not None:
            yield made([held[0]], [(*none[:2], held[2], *none[3:], 2, part, held[1])])

    walked = stored(few_rows(dealt).mapInArrow(walk, f"doc_id {kind}, {found}, edge int, part int, text string"), "fingerprints")
    parts = sorted(r.part for r in walked.where("edge = 1").select("part").collect())  # one a partition
    heads = walked.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("next_print"))
    links = walked.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    tails = walked.where("edge = 2").select("doc_id", "part", "text", "fingerprint").join(links, "part").join(heads, "next").select("doc_id", "text", "fingerprint", "after", "next_print")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_against(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(map(itemgetter(i), done), k) for i, k in enumerate(_FOUND.types))], names=["doc_id", *_FOUND.names])

    return walked.where("edge = 0").select("doc_id", *_FOUND.names).unionByName(tails.mapInArrow(finish, f"doc_id {kind}, {found}"))
