"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern and each match is merged by itself: a segment tree over the match's byte
positions holds, for each live position, the rank of the pair that starts there, and at its root the leftmost least
one. A merge takes the root, links the neighbours, and updates the three leaves that changed on their way up. Many short
matches are merged side by side, one tree a row of a NumPy array; a long one has a tree of its own.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import few_rows, text_batches

#: Matches up to this many bytes are merged side by side.
SHORT = 64
#: The cache of chunks is emptied beyond this many bytes of keys and values, so that memory is bounded.
CACHE_BYTES = 48 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "!#$%&*+,-./:;<=>?@^_|~)]}\""
_NONE = np.int32(2**31 - 1)


class Ranks:
    """The vocabulary: byte strings by rank, and for each pair of ranks that merges the rank it gives."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, rank) for token, rank in self.ranks.items() for cut in range(1, len(token)) if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None]
        pairs.sort()
        self.pair_keys, self.pair_ranks = (np.array(x) for x in zip(*pairs, strict=True))

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks that the pairs (a, b) merge to, or -1; a negative rank merges with nothing."""
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_ranks[at], -1).astype(np.int32)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def merge_short(pieces: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """The ids of each piece (little-endian unsigned 32-bit), for pieces whose lengths round up to one power of two."""
    count, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << int(lengths.max() - 1).bit_length()
    shift = width.bit_length()
    # one more column: what lies before the first and behind the last position
    rank = np.full((count, width + 1), -1, np.int32)
    rows = np.repeat(np.arange(count), lengths)
    rank[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = vocabulary.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, width + 2, dtype=np.int16), (count, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int16), (count, 1))
    before[:, 0] = width
    live = rank[:, :width] >= 0

    def leaf(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        merged = vocabulary.merged(a, b)
        return np.where(merged < 0, _NONE, merged << shift | at)

    tree = np.full((count, 2 * width), _NONE, np.int32)
    tree[:, width:] = leaf(rank[:, :-1].ravel(), rank[:, 1:].ravel(), np.tile(np.arange(width, dtype=np.int32), count)).reshape(count, width)
    half = width >> 1
    while half:
        np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
        half >>= 1

    def update(row: np.ndarray, at: np.ndarray, value: np.ndarray | np.int32) -> None:
        node = at.astype(np.int64) + width
        tree[row, node] = value
        for _ in range(shift - 1):
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    row = np.arange(count)
    while True:
        least = tree[row, 1]
        row, least = row[least != _NONE], least[least != _NONE]
        if not len(row):
            break
        at, new = least & ((1 << shift) - 1), least >> shift
        right, left = after[row, at], before[row, at]
        behind = after[row, right]
        rank[row, at], after[row, at], before[row, behind], live[row, right] = new, behind, at, False
        update(row, right, _NONE)
        update(row, at, leaf(new, rank[row, behind], at))
        has = left < width
        update(row[has], left[has], leaf(rank[row[has], left[has]], new[has], left[has].astype(np.int32)))
    ids, ends = rank[:, :width][live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merge_long(piece: bytes, vocabulary: Ranks) -> bytes:
    """The same for one piece of any length, in O(n log n)."""
    count, ranks, tokens = len(piece), vocabulary.ranks, vocabulary.tokens
    width = 1 << max(count - 1, 1).bit_length()
    none, shift = 1 << 62, width.bit_length()
    rank = vocabulary.of_byte[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))

    def leaf(a: int, b: int) -> int:
        merged = ranks.get(tokens[rank[a]] + tokens[rank[b]]) if b < count else None
        return none if merged is None else merged << shift | a

    tree = [none] * width + [leaf(a, a + 1) for a in range(count)] + [none] * (width - count)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(at: int, value: int) -> None:
        node = at + width
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            value = a if a < b else b
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] != none:
        at, new = tree[1] & ((1 << shift) - 1), tree[1] >> shift
        right = after[at]
        behind = after[right]
        rank[at], rank[right], after[at] = new, -1, behind
        if behind < count:
            before[behind] = at
        update(right, none)
        update(at, leaf(at, behind))
        if before[at] >= 0:
            update(before[at], leaf(before[at], at))
    return np.array([r for r in rank if r >= 0], "<u4").tobytes()


def encode_pieces(pieces: list[bytes], vocabulary: Ranks) -> dict[bytes, bytes]:
    """The ids of each distinct piece: a piece that is a token itself is that token, the others are merged."""
    out, widths = {}, {}
    for piece in set(pieces):
        if (rank := vocabulary.ranks.get(piece)) is not None:
            out[piece] = rank.to_bytes(4, "little")
        elif len(piece) > SHORT:
            out[piece] = merge_long(piece, vocabulary)
        else:
            widths.setdefault((len(piece) - 1).bit_length(), []).append(piece)
    for same in widths.values():
        for at in range(0, len(same), 1 << 14):
            some = same[at : at + (1 << 14)]
            out.update(zip(some, merge_short(some, vocabulary), strict=True))
    return out


class CachedEncoder:
    """Encodes texts through `encode`, asking it once for each chunk. encode(heads, words) gives the ids of the heads,
    which begin a text, and then of the words, each with a blank before it.

    A text is cut at blanks. The patterns of byte-level vocabularies begin a match at a blank that no white space comes
    before, so ids of a text are those of its chunks, one after another. Where white space does come before a blank,
    only blanks between two other characters cut.
    """

    def __init__(self, encode: Callable[[list[str], list[str]], list[bytes]], cache_bytes: int = CACHE_BYTES):
        self.encode, self.cache_bytes = encode, cache_bytes
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.loose: set[str] = set()  # of the known chunks those that a cut may not follow
        self.held = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        chunks = [t.split(" ") for t in texts]
        new = set().union(*(c[1:] for c in chunks)).difference(self.known)
        loose = {c for c in new if not c or c[-1].isspace()} | self.loose
        if loose or any(not c[0] or c[0][-1].isspace() for c in chunks):
            chunks = [_CUT.split(t) if not loose.isdisjoint(c) or not c[0] or c[0][-1].isspace() else c for t, c in zip(texts, chunks, strict=True)]
            new = set().union(*(c[1:] for c in chunks)).difference(self.known)
        self.loose.update(c for c in new if not c or c[-1].isspace())
        # a word of letters and the marks after it are matches of their own
        words = {c: w for c in new if (w := c.rstrip(_MARKS)) != c and w.isalpha()}
        asked = list(new.difference(words).union(words.values()).difference(self.known))
        alone = list({c[0] for c in chunks}.union(c[len(w) :] for c, w in words.items()))
        ids = self.encode(alone, asked)
        head = dict(zip(alone, ids, strict=False))
        self.known.update(zip(asked, ids[len(alone) :], strict=True))
        self.known.update((c, self.known[w] + head[c[len(w) :]]) for c, w in words.items())
        self.held += sum(map(len, new)) + sum(map(len, ids)) + 150 * len(new)
        out = [b"".join([head[c[0]], *map(self.known.__getitem__, c[1:])]) for c in chunks]
        if self.held > self.cache_bytes:
            self._forget()
        return out


@functools.lru_cache(2)
def encoder_of(path: str, pattern: str, cut_at_blanks: bool) -> Callable[[list[str]], list[bytes]]:
    vocabulary, find = ranks_of(path), regex.compile(pattern).findall

    def whole(texts: list[str]) -> list[bytes]:
        cut = [[piece.encode() for piece in find(t)] for t in texts]
        ids = encode_pieces([piece for pieces in cut for piece in pieces], vocabulary)
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def encode(heads: list[str], words: list[str]) -> list[bytes]:
        return whole([*heads, *(f" {w}" for w in words)])

    return CachedEncoder(encode) if cut_at_blanks else whole


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cut_at_blanks: bool = True) -> DataFrame:
    """(doc_id, ids) for each row of docs: the whole text's ids as little-endian unsigned 32-bit integers.

    path names a file of base64 tokens and ranks, pattern the expression whose matches are merged separately. Special
    tokens are ordinary text. A null text counts as empty and has no ids; a text of any length is encoded whole; an empty
    table gives no rows; repeated and null doc_ids stay as they are; other columns are ignored.

    With cut_at_blanks, texts are cut before single blanks and chunks are encoded once. That is right for patterns that
    begin a match at each blank that no white space comes before, and for no others, such as `\\S+ \\S+`: ask for False then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(path, pattern, cut_at_blanks)
        for batch, texts in text_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(texts), pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return few_rows(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with ids as bpe_encode gives them) and the column `decoded`: the bytes that the ids stand for; null for null."""
    names, at = [*encoded.columns, "decoded"], encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks_of(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                decoded = [None if ids is None else vocabulary.decode(ids) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=names)

    return few_rows(encoded).mapInArrow(run, StructType([*encoded.schema, StructField("decoded", BinaryType())]))
