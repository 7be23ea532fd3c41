"""Shared helpers: table access, tables in the shared folder, and vectorised word hashes."""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='meterwise-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def session_conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows with texts that a Python worker gets at once; a few thousand long ones would not fit in its memory.
TEXT_ROWS = 1000


def few_rows(df: DataFrame) -> DataFrame:
    """df, in whose session a Python worker now gets TEXT_ROWS rows at once, if it got more."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df


def spare(columns: list[str], *names: str) -> list[str]:
    """names, with underscores where one is among the columns already."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: The folder below the shared one where tables are stored.
_scratch: ContextVar[str] = ContextVar("scratch", default="")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: its lineage is cut and executors may be lost. The table
    stays until `dropped` or the end of the `temporary` tables around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meterwise/{_scratch.get()}{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def dropped(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    _delete(df.sparkSession, df.stored_at)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, so results must be written before."""
    name = f"{_scratch.get()}temporary-{uuid.uuid4().hex}/"
    token = _scratch.set(name)
    try:
        yield
    finally:
        _scratch.reset(token)
        _delete(spark, f"{shared_dir(spark)}/meterwise/{name}")


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes that words may consist of.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LETTERS_AND_DIGITS = LETTERS.copy()
LETTERS_AND_DIGITS[48:58] = True
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SPAN = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Of a little-endian word of 64 bits, the mask of its first n bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a few texts: byte spans in `data`, hashes, and where each text begins.

    With `kind` (LETTERS: ASCII letters and bytes beyond ASCII) words are runs of such bytes instead. A word has 128 bits
    in two lanes, `hashes` and `second`: up to 16 bytes are mixed whole, longer words are digested by BLAKE2.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, kind: np.ndarray | None = None):
        joined = b"\n".join(texts)
        self.data = joined.lower() if lower else joined
        raw = np.frombuffer(self.data, np.uint8)
        ends_of_text = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        inside = np.concatenate(([False], (~_SPACE if kind is None else kind)[raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        padded = self.data + bytes(16)
        self._eights = np.ndarray((len(self.data) + 9,), "<u8", padded, strides=(1,))
        #: text i has the words first[i] to first[i + 1]
        self.first = np.concatenate(([0], np.searchsorted(self.starts, ends_of_text))) if len(texts) else np.zeros(1, np.int64)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    @functools.cached_property
    def second(self) -> np.ndarray:
        return self.spans(self.starts, self.ends, 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """Hashes of the bytes from starts to ends."""
        size = ends - starts
        low = self._eights[starts] & _FIRST[np.minimum(size, 8)]
        high = self._eights[np.minimum(starts + 8, len(self._eights) - 1)] & _FIRST[np.clip(size - 8, 0, 8)]
        h = mix(low + mix(high + size.astype(np.uint64) * _SPAN[1 - lane]) * _SPAN[lane])
        for i in np.flatnonzero(size > 16).tolist():
            digest = hashlib.blake2b(self.data[starts[i] : ends[i]], digest_size=16).digest()
            h[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
        return h

    def grams(self, k: int, lane: int = 0) -> np.ndarray:
        """Hashes of k consecutive words, from each word on; those that leave a text are meaningless."""
        words = self.second if lane else self.hashes
        n = max(len(words) - k + 1, 0)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = mix(h * _GRAM + words[j : j + n])
        return h

    def numbers(self) -> np.ndarray:
        """The words as numbers, equal ones alike; told apart by their bytes, not by hashes."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] = 1
        inside[self.ends] -= 1
        letters = np.frombuffer(self.data, np.uint8)[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        return words.dictionary_encode().indices.to_numpy()


@contextmanager
def kept_tables() -> Iterator[None]:
    """What is stored inside stays, whatever temporary tables are around it."""
    token = _scratch.set("")
    try:
        yield
    finally:
        _scratch.reset(token)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `most` bytes of text, or one text that is longer."""
    for batch in batches:
        texts = utf8(batch.column(text))
        at = size = 0
        for i, x in enumerate(texts):
            if size and size + len(x) > most:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(x)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def text_batches(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), about `most` characters each, or one text that is longer."""
    for batch in batches:
        at = size = 0
        texts: list[str] = []
        for i in range(batch.num_rows):
            x = batch.column(text)[i].as_py() or ""
            if size and size + len(x) > most:
                yield batch.slice(at, i - at), texts
                at, size, texts = i, 0, []
            texts.append(x)
            size += len(x)
        if texts:
            yield batch.slice(at), texts
