"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Bounded-space online best-fit: each packing task takes the pieces as they arrive, in the order of their documents, holds
a fixed number of open sequences in a bitset keyed by free space and puts a piece where it leaves the least. A piece that
fits nowhere opens a sequence; if too many are open, the fullest closes first.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .byte_bpe import CachedEncoder
from .common import few_rows, stored, text_batches

#: Pieces for one packing task: enough that its open sequences at the end weigh little, few enough for many tasks.
TASK_PIECES = 20_000
#: Sequences that a task may hold open. More of them change the number of sequences by less than a thousandth.
OPEN = 1024
#: Bytes of words and their ids that a Python worker remembers.
CACHE = 192 << 20


@functools.lru_cache(2)
def tokenizer_of(path: str, cache_bytes: int = CACHE) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts as the library `tokenizers` does, without adding special tokens. Texts that hold one, as it takes these for
    tokens, go to it whole; the others word by word, through a cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = tokenizer.normalizer is not None or any(" " in x for x in added)

    def ids(texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    widths = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        widths[i] = len(token)  # a byte-level token has a character for each byte

    def encode(heads: list[str], words: list[str]) -> list[bytes]:
        """Words go to the library many in one text, which is cut where their bytes end."""
        odd = [i for i, w in enumerate(words) if not w or w[0].isspace() or w[-1].isspace()]
        found = ids([*heads, *(f" {words[i]}" for i in odd)])
        out, apart = found[: len(heads)], dict(zip(odd, found[len(heads) :], strict=True))
        plain = [w for i, w in enumerate(words) if i not in apart] if odd else words
        cut: list[bytes] = []
        for at in range(0, len(plain), 4096):
            text = " " + " ".join(plain[at : at + 4096])
            [joined] = ids([text])
            data = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(data == 32)[1:], len(data)) if len(plain[at : at + 4096]) == np.count_nonzero(data == 32) else None
            if ends is None:  # a word with blanks inside
                ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in plain[at : at + 4096]), np.int64))
            cuts = (4 * (np.searchsorted(np.cumsum(widths[np.frombuffer(joined, "<u4")]), ends) + 1)).tolist()
            cut += [joined[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        if not odd:
            return out + cut
        rest = iter(cut)
        return out + [apart[i] if i in apart else next(rest) for i in range(len(words))]

    cached = CachedEncoder(encode, cache_bytes)

    def encoded(texts: list[str]) -> list[bytes]:
        apart = [whole or any(x in t for x in added) for t in texts]
        found = {True: iter(ids([t for t, a in zip(texts, apart, strict=True) if a])), False: iter(cached([t for t, a in zip(texts, apart, strict=True) if not a]))}
        return [next(found[a]) for a in apart]

    return encoded


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of one document: only the first piece may be shorter than the capacity if there are several."""
    total = len(ids) // 4
    first = (total - 1) % capacity + 1
    for piece, start in enumerate([0, *range(first, total, capacity)]):
        yield piece, start, ids[4 * start : 4 * (start + (capacity if piece else first))]


def tokenized_pieces(docs: DataFrame, path: str, end: int, capacity: int, with_ids: bool, id_col: str, text_col: str, cache_bytes: int = CACHE) -> DataFrame:
    schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    schema = schema if with_ids else schema.remove(4)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = tokenizer_of(path, cache_bytes), end.to_bytes(4, "little")
        for batch, texts in text_batches(batches, 1):
            at, found = [], []
            for i, ids in enumerate(encode(texts)):
                for piece, start, some in pieces_of(ids + stop, capacity):
                    at.append(i)
                    found.append((piece, start, len(some) // 4, zlib.crc32(some), some))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(schema.types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", *schema.names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return few_rows(rows).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class OpenSequences:
    """At most `most` open sequences: bit f of `bits` is set if one has f places free, and `by_free[f]` holds those."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.by_free, self.open, self.begun = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        found = self.by_free[free]
        sequence = found.pop()
        if not found:
            self.bits ^= 1 << free
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that a piece of this length goes to, and its offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.begun
            self.begun += 1
            if length < free and self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        if left := free - length:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(sequence)
            self.open += 1
        return sequence, self.capacity - free


def pack(pieces: DataFrame, capacity: int = 1024, open_sequences: int = OPEN, task_pieces: int = TASK_PIECES) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset; lengths are from 1 to the capacity.

    pieces is read twice, so give a stored table. Tasks pack independently of each other, pieces in the order of their
    documents; ties in that order are broken by the pieces' checksums, so a repeated task packs alike.
    """
    tasks = max(1, -(-pieces.count() // task_pieces))
    names, at = [*pieces.columns, "sequence_id", "offset"], pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences, base = OpenSequences(capacity, open_sequences), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [sequences.place(n) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([p[i] + base * (1 - i) for p in placed], pa.int64()) for i in (0, 1))], names=names)

    keys = [F.col(c) for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    dealt = pieces.repartition(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def best_fit_packing(docs: DataFrame, path: str, end: int = 2, capacity: int = 1024, open_sequences: int = OPEN, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A document's ids are those that the tokenizer file `path` gives without adding special tokens, then `end`; a text that
    holds a special token has its id. A document of more than `capacity` ids is cut into pieces of that length, of which
    the first may be shorter; others are whole. ids are little-endian unsigned 32-bit integers, ids_crc32 is theirs. A
    null text counts as empty: its one piece is `end`. A text of any length is tokenized whole; an empty table gives no
    rows. Repeated rows and null ids are packed as they come; other columns are ignored.
    """
    return pack(stored(tokenized_pieces(docs, path, end, capacity, with_ids, id_col, text_col, cache_bytes), "pieces"), capacity, open_sequences)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with ids: sequence_id, length, doc_ids and ids (binary), by offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.col("parts.doc_id").alias("doc_ids"), joined.alias("ids"))
