"""Count-min sketches of hashes: sums by slices that tasks add up, of which a bit a cell says what may be frequent."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import few_rows

#: Rows of a sketch, bounds of their cells, and the slices in which rows are added up.
ROWS, CELLS, SLICE = 2, (1 << 16, 1 << 28), 1 << 20


def cells_of(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """A cell for each hash in each row of the sketch."""
    return [(hashes >> np.uint64(32 * r)) & np.uint64(cells - 1) for r in range(ROWS)]


def packed(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers with their first bytes together, then their second ones and so on, compressed."""
    data = numbers.astype(kind)
    return pa.compress(data.view(np.uint8).reshape(len(data), -1).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


PARTS = "slice int, n long, places binary, counts binary"


def parts_of(places: np.ndarray, counts: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Counts at ascending places as rows of PARTS, one for each slice of `size` places."""
    edges = np.searchsorted(places, np.arange(0, int(places[-1]) + size + 1, size)) if len(places) else np.zeros(1, np.int64)
    for s, (a, b) in enumerate(itertools.pairwise(edges.tolist())):
        if a < b:
            steps = np.diff(places[a:b].astype(np.int64) - s * size, prepend=0)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "n": pa.array([b - a], pa.int64()), "places": [packed(steps, "<u4")], "counts": [packed(counts[a:b], "<i8")]})


def summed(parts: DataFrame, size: int, schema: str, finish: Callable[[int, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What finish makes of each slice's sums; a task holds one slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, None
        for batch in batches:
            for s, n, places, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != of:
                    if of is not None:
                        yield finish(of, total)
                    of, total = s, np.zeros(size, np.int64)
                total[np.cumsum(unpacked(places, n, "<u4"))] += unpacked(counts, n, "<i8")
        if of is not None:
            yield finish(of, total)

    return few_rows(parts.repartition("slice").sortWithinPartitions("slice")).mapInArrow(run, schema)


class Sketch:
    """A count-min sketch of which two bits a cell are kept, one in each row: whether a phrase that falls there may be frequent."""

    def __init__(self, rows: list[bytes], cells: int):
        self.rows, self.cells = [np.frombuffer(x, np.uint8) for x in rows], cells

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for row, at in zip(self.rows, cells_of(hashes, self.cells), strict=True):
            found &= (row[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def places_of(hashes: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    """PARTS of how many hashes fall into each cell of both rows."""
    both = np.concatenate([at + np.uint64(r * cells) for r, at in enumerate(cells_of(hashes, cells))])
    yield from parts_of(*np.unique(both, return_counts=True), min(cells, SLICE))


def frequent_cells(parts: DataFrame, least: int, cells: int) -> list[bytes]:
    """For each row a bit for each cell: whether its hashes are `least` together. Of bounded size: two bits a cell reach the driver."""
    size = min(cells, SLICE)

    def bits(s: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})

    found = {r["slice"]: bytes(r["bits"]) for r in summed(parts, size, "slice int, bits binary", bits).collect()}
    each = cells // size
    return [b"".join(found.get(r * each + s) or bytes(-(-size // 8)) for s in range(each)) for r in range(ROWS)]


def width(hashes: int) -> int:
    """Cells of a row for so many hashes: a power of two within CELLS. Beyond, less is ruled out; results are the same."""
    return min(max(1 << max(hashes - 1, 0).bit_length(), CELLS[0]), CELLS[1])
