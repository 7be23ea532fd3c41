"""Phrases of two to five words that occur together more often than their parts suggest, for each language.

A count-min sketch of all word sequences gives an upper bound for each phrase, so those that reach a count by it are the
candidates and none is missed. The candidates become Aho-Corasick automata whose symbols are words, with a guard symbol
between pieces of text and in place of other words; tasks scan the texts for all overlapping matches, and the sums decide.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, few_rows, mix, small_batches, stored, utf8
from .sketch import PARTS, Sketch, frequent_cells, parts_of, places_of, summed, width

#: A sketch has a cell for WIDTH bytes of text; a task sends its counts when it has FLUSH phrases. Candidates are united in SLICES slices.
WIDTH, FLUSH, SLICES = 16, 4_000_000, 64
#: Phrases, and bytes of them, that one automaton may have.
PHRASES, BYTES = 1_000_000, 32 << 20
#: Phrases that a task remembers to have named, and those whose sums one task makes at a time.
NAMED, PATTERNS = 1_000_000, 1 << 14
#: Bytes between words, and those of them that end a piece.
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_ENDS
_INSIDE[list(b" \t")] = False
_NEXT = np.uint64(0x9FB21C651E98DF25)


@functools.lru_cache(10_000)
def _lang_keys(lang: str) -> tuple[int, int]:
    digest = hashlib.blake2b(lang.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


class LangWords:
    """The words of some texts, lower-cased (A-Z): two lanes of hashes that differ by language, and the number of each word's
    piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.words = Words(texts, lower=True, kind=_INSIDE)
        self.piece = np.cumsum(_ENDS[np.frombuffer(self.words.data, np.uint8)])[self.words.starts] if len(self.words.starts) else np.zeros(0, np.int64)
        self.of_text = np.diff(self.words.first)
        self._keys = np.array([_lang_keys(x) for x in langs], np.uint64).reshape(-1, 2)

    @functools.cached_property
    def first(self) -> np.ndarray:
        return mix(self.words.hashes ^ np.repeat(self._keys[:, 0], self.of_text))

    @functools.cached_property
    def second(self) -> np.ndarray:
        return mix(self.words.second ^ np.repeat(self._keys[:, 1], self.of_text))

    def phrases(self, longest: int, lane: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hashes, whole) for k from 2: hashes of k words from each word on, and whether they lie in one piece."""
        h = lane
        for k in range(2, longest + 1):
            h = mix(h[:-1] * _NEXT + lane[k - 1 :]) if len(h) > 1 else h[:0]
            yield k, h, self.piece[: len(h)] == self.piece[k - 1 : k - 1 + len(h)]

    def text(self, at: int, k: int) -> str:
        w = self.words
        return b" ".join(w.data[w.starts[i] : w.ends[i]] for i in range(at, at + k)).decode()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], LangWords]]:
    """Batches of (lang, text)."""
    for batch, texts in small_batches(batches, 1):
        langs = batch.column(0).to_pylist()
        yield langs, LangWords(texts, langs)


def _held(words: LangWords, longest: int, sketches: list[Sketch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, at): where phrases of k words stand that the sketches, the first of pairs, the second of longer ones, do not rule
    out, nor any phrase within. Lengths beyond the sketches are held as their parts are."""
    below = None
    for k, hashes, whole in words.phrases(longest, words.first):
        at = np.flatnonzero(whole if below is None else whole & below[:-1] & below[1:])
        if len(sketches) > (k > 2):
            at = at[sketches[k > 2].may_have(hashes[at])]
        yield k, hashes, at
        below = np.zeros(len(whole), bool)
        below[at] = True
        if not len(at):
            return


def sketched(texts: DataFrame, least: int, sizes: range, cells: int, known: list[bytes]) -> list[bytes]:
    """The sketch of phrases of `sizes` words: for each row a bit for each cell, whether its phrases occur `least` times together.

    Tasks count their cells and send them by slices, which other tasks add up, so what reaches the driver is two bits a
    cell. known has the rows of the sketch of pairs, if phrases of more words are counted: only those count whose pairs it has.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [Sketch(shared.value, cells)] if known else []
        held, n = [], 0

        for _, words in _read(batches):
            for k, hashes, at in _held(words, sizes[-1], pairs):
                if k in sizes:
                    held.append(hashes[at])
                    n += len(at)
            if n > FLUSH:
                yield from places_of(np.concatenate(held), cells)
                held, n = [], 0
        if n:
            yield from places_of(np.concatenate(held), cells)

    return frequent_cells(few_rows(texts).mapInArrow(count, PARTS), least, cells)


def candidates(texts: DataFrame, rows: list[list[bytes]], longest: int, cells: int) -> DataFrame:
    """(lang, phrase) for the phrases of two words and more whose bounds, and those of the phrases within, are high enough.

    Tasks send the distinct ones that they find packed by slices of hashes, which other tasks unite.
    """
    shared = texts.sparkSession.sparkContext.broadcast(rows)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, named, out = [Sketch(x, cells) for x in shared.value], set(), [[] for _ in range(SLICES)]

        def sent() -> Iterator[pa.RecordBatch]:
            for s, found in enumerate(out):
                if found:
                    table, sink = pa.table({"lang": pa.array([f[0] for f in found], pa.string()), "phrase": pa.array([f[1] for f in found], pa.string())}), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                        stream.write_table(table)
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "phrases": [sink.getvalue().to_pybytes()]})

        for langs, words in _read(batches):
            ends = np.cumsum(words.of_text)
            for k, hashes, at in _held(words, longest, sketches):
                second = words.second[at]
                for j in range(1, k):
                    second = mix(second * _NEXT + words.second[at + j])
                order = np.lexsort((second, hashes[at]))
                a, b = hashes[at][order], second[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
                for i, key in zip(at[order][new].tolist(), zip(a[new].tolist(), b[new].tolist(), strict=True), strict=True):
                    if key not in named:
                        named.add(key)
                        out[key[1] % SLICES].append((langs[int(np.searchsorted(ends, i, "right"))], words.text(i, k)))
            if len(named) > NAMED:
                yield from sent()
                named, out = set(), [[] for _ in range(SLICES)]
        yield from sent()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, found = None, set()
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != of and found:
                    yield made(found)
                    found = set()
                of, table = s, pa.ipc.open_stream(data).read_all()
                found.update(zip(table["lang"].to_pylist(), table["phrase"].to_pylist(), strict=True))
        if found:
            yield made(found)

    def made(found: set) -> pa.RecordBatch:
        pairs = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in pairs], pa.string()) for i in (0, 1)], names=["lang", "phrase"])

    sent = few_rows(texts).mapInArrow(name, "slice int, phrases binary").repartition("slice").sortWithinPartitions("slice")
    return sent.mapInArrow(unite, "lang string, phrase string")


class Scanner:
    """The automaton of some phrases and the numbers of their words, from 1 on. A word is three symbols, the digits of its
    number, each of a range of its own, so that no node has many children; the symbol 0 is the guard, which no phrase has."""

    def __init__(self, patterns: pa.Table):
        langs, self.size = patterns["lang"].to_pylist(), patterns.num_rows
        found = LangWords(utf8(patterns["phrase"]), langs)
        order = np.lexsort((found.second, found.first))
        first, second = found.first[order], found.second[order]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))) if len(order) else np.zeros(0, bool)
        self.first, self.second = first[new], second[new]
        symbols = np.zeros(len(order), np.int64)
        symbols[order] = np.cumsum(new)
        ends = np.cumsum(found.of_text)
        single = found.of_text == 1
        #: of each symbol, the phrase that is this word alone, or -1
        self.alone = np.full(len(self.first) + 1, -1)
        self.alone[symbols[ends[single] - 1]] = np.flatnonzero(single)
        self.base = max(2, int(np.ceil(np.cbrt(len(self.first)))) + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        digits = self.digits(symbols).tolist()
        for i in np.flatnonzero(found.of_text > 1).tolist():
            self.automaton.add_word(tuple(digits[3 * (ends[i] - found.of_text[i]) : 3 * ends[i]]), i)
        self.automaton.make_automaton()

    def digits(self, symbols: np.ndarray) -> np.ndarray:
        """Three symbols for each word's number."""
        b, x = self.base, symbols - 1
        return np.where(symbols[:, None] > 0, np.stack((1 + x // (b * b), 1 + b + x // b % b, 1 + 2 * b + x % b), 1), 0).ravel()

    def scan(self, words: LangWords, counts: np.ndarray) -> None:
        """Adds to counts how often each phrase occurs."""
        if not len(self.first) or not len(words.piece):
            return
        at = np.minimum(np.searchsorted(self.first, words.first), len(self.first) - 1)
        symbols = np.where((self.first[at] == words.first) & (self.second[at] == words.second), at + 1, 0)
        seen = np.bincount(symbols, minlength=len(self.alone))
        counted = np.flatnonzero((self.alone >= 0) & (seen > 0))
        counts[self.alone[counted]] += seen[counted]
        ends = np.concatenate(([False], words.piece[1:] != words.piece[:-1]))
        guarded = np.zeros(len(symbols) + int(ends.sum()), np.int64)
        guarded[np.arange(len(symbols)) + np.cumsum(ends)] = symbols
        beside = np.concatenate(([False], guarded[:-1] > 0)) | np.concatenate((guarded[1:] > 0, [False]))
        guarded = guarded[beside]  # a word without a neighbour, and all but the first and last of some guards, match nothing
        if self.automaton.kind == ahocorasick.AHOCORASICK and len(guarded):
            matches = np.fromiter(map(itemgetter(1), self.automaton.iter(tuple(self.digits(guarded).tolist()))), np.int64)
            if len(matches):
                counts += np.bincount(matches, minlength=len(counts))


_scanners: dict[str, Scanner] = {}


def _scanner(key: str, patterns: Broadcast) -> Scanner:
    """A Python worker builds the automaton of a scan once."""
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(patterns.value)
    return _scanners[key]


def _counted(texts: DataFrame, patterns: Broadcast, totals: bool) -> DataFrame:
    """PARTS of how often each phrase, by its row in patterns, occurs in a task's texts; with `totals` rows (lang, n) besides, of
    how many words they have."""
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words_of = None, {}
        for langs, words in _read(batches):
            scanner = _scanner(key, patterns)
            counts = np.zeros(scanner.size, np.int64) if counts is None else counts
            scanner.scan(words, counts)
            if totals:
                for lang, n in zip(langs, words.of_text.tolist(), strict=True):
                    words_of[lang] = words_of.get(lang, 0) + n
        if counts is not None:
            there = np.flatnonzero(counts)
            for part in parts_of(there, counts[there], PATTERNS):
                yield part.append_column("lang", pa.nulls(1, pa.string()))
        if words_of:
            n = len(words_of)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(list(words_of.values()), pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(list(words_of), pa.string())], names=["slice", "n", "places", "counts", "lang"])

    return few_rows(texts).mapInArrow(count, f"{PARTS}, lang string")


def counted_phrases(texts: DataFrame, least: int, longest: int, cells: int, phrases: int = PHRASES, most_bytes: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) for every phrase of two to `longest` words that occurs `least` times, its first and last word, and
    maybe others; and (lang, n), the words of each language.

    What one automaton may hold is bounded; more candidates take more automata, each broadcast by itself, and so many more scans.
    """
    pairs = sketched(texts, least, range(2, 3), cells, [])
    sketches = [pairs, sketched(texts, least, range(3, longest + 1), cells, pairs)] if longest > 2 else [pairs]
    found = candidates(texts, sketches, longest, cells)
    ends = F.array(F.col("phrase"), F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1))
    named = stored(found.select("lang", F.explode(ends).alias("phrase")).distinct(), "phrases")
    n, size = named.agg(F.count("*"), F.sum(F.octet_length("phrase"))).first()
    groups = max(1, -(-n // phrases), -(-(size or 0) // most_bytes))
    context, sums, totals = texts.sparkSession.sparkContext, [], None
    for g in range(groups):
        table = named.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(groups)) == g).toArrow()
        patterns = context.broadcast(table)
        parts = stored(_counted(texts, patterns, g == 0), "phrase-counts")

        def rows(s: int, total: np.ndarray, patterns: Broadcast = patterns) -> pa.RecordBatch:
            at = np.flatnonzero(total)
            some = patterns.value.take(pa.array(at + s * PATTERNS)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(some[c].combine_chunks() for c in ("lang", "phrase")), pa.array(total[at], pa.int64())], names=["lang", "phrase", "f"])

        sums.append(stored(summed(parts.where("slice IS NOT NULL").drop("lang"), PATTERNS, "lang string, phrase string, f long", rows), "phrase-sums"))
        totals = totals or parts.where("slice IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        patterns.destroy()
    return functools.reduce(DataFrame.unionByName, sums), totals


def cells_for(texts: DataFrame) -> int:
    """Cells of a row of the sketch, in proportion to the bytes of the texts."""
    return width((texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // WIDTH)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, best: int = 2000, cells: int | None = None, phrases: int = PHRASES, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The `best` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at [.,;:!?\x0A-\x0D] into pieces and those at blanks and tabs into words. Phrases of two
    to `longest` words of a piece that occur a >= `least` times, overlaps included, count; of the cuts into a first part that
    occurs l times and a rest that occurs r times the one with the least floor(1000 * a * n / (l * r)) is a phrase's score,
    n being the words of its language. Phrases within a longer one that occurs `percent` in a hundred times as often are left
    out. Ties go to the shorter first part, the more frequent phrase and the order of UTF-8 bytes.

    A null language is `und`; a null or empty text has no words; texts of any length are read whole; repeated rows count each;
    an empty table gives no rows; other columns are ignored. The texts are read five
    times, and once more for each further automaton.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts, totals = counted_phrases(texts, least, longest, cells or cells_for(texts), phrases)
    frequent = counts.withColumn("words", F.split("phrase", " ")).where((F.col("f") >= least) & (F.size("words") > 1))
    part = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    # a phrase within a longer one lies within one that is a word longer and occurs as often at least
    within = frequent.where(F.size("words") > 2).select("lang", F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"), F.col("f").alias("longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = frequent.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("f"), F.lit(True)))
    cuts = own.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    sides = lambda text, name: counts.select("lang", F.col("phrase").alias(text), F.col("f").alias(name))
    cuts = cuts.join(sides("head", "l"), ["lang", "head"]).join(sides("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(16, 0)) * CAST(r AS DECIMAL(16, 0)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.select("lang", "phrase", "cut.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
