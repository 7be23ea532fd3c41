"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A window is WINDOW consecutive words. The trees are sparse: suffixes start at sampled words, in every window that word whose
PREFIX words have the least hash, so windows of equal words sample the same place. A window is then found by the suffix
that it samples and by how many words before it the window begins.

1. Suffixes are dealt by their prefix, its first PREFIX words. A prefix of one document only is a leaf and goes.
2. Suffixes with a shared prefix come with their words: those up to the end of their windows, and those before them. If more
   than GROUP suffixes share a prefix, their windows become suffixes of their own, from their first word on, and the
   prefix grows word by word until a group fits. A group whose prefix is a whole window is one leaf; of such a group the
   parts compete, GROUP suffixes at a time, until its first document is known.
3. The sorted suffixes of a group, with the number of words that neighbours have in common, are its subtree: an internal node at
   depth d is a run of suffixes with d words in common. A window that begins k words before its suffix belongs to
   the node at depth WINDOW - k and, below it, to suffixes with the same k words before them. It goes if a smaller doc_id
   passes there; runs of such windows are the maximal repeats. Words are compared as such, not by hashes.

Each task first settles what its own batch of documents can: prefixes that two of them share, windows that one of them
has before another. What is hot thus reaches the shuffles once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, few_rows, mix, small_batches, stored

WINDOW, PREFIX = 13, 5
#: Suffixes that a subtree may hold.
GROUP = 50_000
#: Bytes of text that a task looks at together.
BATCH = 4 << 20
#: Marks of large groups that are broadcast, 12 bytes each; and parts into which their rows are dealt where there are more.
MARKS, SALTS = 100_000, 256


class Suffixes:
    """The sampled suffixes of some texts, and for each window of a text the suffix that it samples."""

    def __init__(self, texts: list[bytes], window: int, prefix: int):
        self.words = words = Words(texts)
        count = max(len(words.hashes) - window + 1, 0)
        text_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
        starts = np.arange(count)
        inside = text_of[:count] == text_of[window - 1 : window - 1 + count]
        starts = starts[inside]
        if len(starts):
            grams, span = words.grams(prefix), window - prefix + 1
            best = sliding_window_view(mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)), span)
            sampled = np.concatenate([at + best[at].argmin(1) for at in np.array_split(starts, 1 + len(starts) // 100_000)])
            # windows of one text that sample one place follow each other
            begins = np.flatnonzero(np.concatenate(([True], (sampled[1:] != sampled[:-1]) | (text_of[starts[1:]] != text_of[starts[:-1]]))))
            self.prefix = grams[sampled[begins]].view(np.int64)
        else:
            sampled = begins = np.zeros(0, np.int64)
            self.prefix = np.zeros(0, np.int64)
        first = words.first[:-1]
        self.text = text_of[sampled[begins]]
        self.place = sampled[begins] - first[self.text]
        self.begin = starts
        self.start = starts - first[text_of[starts]] if len(starts) else starts
        self.lengths = np.diff(np.append(begins, len(starts)))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs begin in which all keys stay the same."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(np.int32)))


PLACES = pa.schema([("prefix", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("place", pa.int32()), ("count", pa.int64()), ("places", pa.list_(pa.int32()))])
_PLACES = "prefix long, doc_id long, tag int, place int, count long, places array<int>"


def _places(window: int, prefix: int):
    """Rows for the suffixes of a batch. Those whose prefix two of its documents share are sure, and come as a list for
    each document, without a prefix; two rows without a place then tell other batches, the first with their count. The
    counts of a prefix's rows thus add up to its suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_batches(batches, 2, BATCH):
            s = Suffixes(texts, window, prefix)
            ids, tags = _longs(batch.column(0)), _longs(batch.column(1))
            order = np.lexsort((ids[s.text], s.prefix))
            p, d = s.prefix[order], ids[s.text[order]]
            head = _runs(p)
            sizes = np.diff(np.append(head, len(p)))
            low, high = d[head], d[head + sizes - 1]
            shared = low < high
            sure = np.zeros(len(p), bool)
            sure[order] = np.repeat(shared, sizes)
            single, n = np.flatnonzero(~sure), int(shared.sum())
            counts = np.bincount(s.text[sure], minlength=len(texts))
            docs = np.flatnonzero(counts)
            m = len(single) + 2 * n
            columns = [
                pa.array(np.concatenate((s.prefix[single], p[head][shared], p[head][shared], np.zeros(len(docs), np.int64))), mask=np.arange(m + len(docs)) >= m),
                pa.array(np.concatenate((ids[s.text[single]], low[shared], high[shared], ids[docs]))),
                pa.array(np.concatenate((tags[s.text[single]], np.zeros(2 * n, np.int64), tags[docs])).astype(np.int32)),
                pa.array(np.concatenate((s.place[single], np.full(2 * n + len(docs), -1))).astype(np.int32)),
                pa.array(np.concatenate((np.ones(len(single), np.int64), sizes[shared], np.zeros(n + len(docs), np.int64)))),
                pa.concat_arrays([pa.nulls(m, PLACES.types[5]), _lists(s.place[sure], counts[docs])]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=PLACES)

    return run


SHARED = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("place", pa.int32()), ("places", pa.list_(pa.int32())), ("heavy", pa.int64())])
_SHARED = "doc_id long, tag int, place int, places array<int>, heavy long"


def _shared(group: int):
    """From rows sorted by prefix and doc_id, those whose prefix has several documents, and those that are sure; and
    (heavy) each prefix of more than `group` suffixes. Only the rows of one document are held until another is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, first_doc, known, count = None, None, False, 0

        def out(part: pa.RecordBatch, heavy: list[int]) -> pa.RecordBatch:
            part = part.filter(pa.array(part.column(3).to_numpy() >= 0))
            n, none = part.num_rows, len(heavy)
            columns = [pa.concat_arrays([part.column(i), pa.nulls(none, part.column(i).type)]) for i in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(n + none, SHARED.types[3]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(heavy, pa.int64())])], schema=SHARED)

        for batch in batches:
            open_ = batch.column(0).is_valid()
            sure, batch = batch.filter(pa.compute.invert(open_)), batch.filter(open_)
            if sure.num_rows:
                yield pa.RecordBatch.from_arrays([sure.column(1), sure.column(2), pa.nulls(sure.num_rows, pa.int32()), sure.column(5), pa.nulls(sure.num_rows, pa.int64())], schema=SHARED)
            if not batch.num_rows:
                continue
            p, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            head = _runs(p)
            sizes = np.diff(np.append(head, len(p)))
            low, high = d[head].copy(), d[head + sizes - 1]
            shared, heavy = low < high, []
            totals = np.add.reduceat(batch.column(4).to_numpy(), head)
            if p[0] == last:
                low[0] = first_doc
                shared[0] = known or first_doc < high[0]
                totals[0] += count
                if shared[0]:
                    yield from (out(b, []) for b in held)
                    held = []
            elif last is not None:
                if count > group:
                    heavy.append(last)
            if p[0] != last or len(head) > 1 or shared[0]:
                held = []  # their prefix has one document
            heavy += p[head[:-1]][totals[:-1] > group].tolist()
            keep = np.repeat(shared, sizes)
            if keep.any() or heavy:
                yield out(batch.filter(pa.array(keep)), heavy)
            last, first_doc, known, count = int(p[-1]), int(low[-1]), bool(shared[-1]), int(totals[-1])
            if not known:
                held.append(batch.slice(int(head[-1])))
        if last is not None and count > group:
            yield out(pa.RecordBatch.from_arrays([pa.array([], t) for t in PLACES.types], schema=PLACES), [last])

    return run


CANDIDATES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("place", pa.int32()), ("before", pa.string()), ("suffix", pa.string())])


def _firsts(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place the first place with the same key whose doc is the least."""
    order = np.lexsort((doc, key))
    head = _runs(key[order])
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(order[head], np.diff(np.append(head, len(key))))
    return first


#: Every space a blank.
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)


def _single_spaced(text: bytes) -> bytes:
    """The text with one blank for each run of spaces."""
    text = text.translate(_BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def _candidates(window: int, prefix: int, heavy: np.ndarray | None = None, only: bool = False):
    """Of rows (doc_id, row, text, places), runs of windows that sample those places. Windows that a smaller document of
    the batch has too are settled: words start to stop of the row go. The others come with their words. heavy has
    prefixes, of which the suffixes are left out or, with `only`, the only ones; rows then need no places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = batches if only else (b.filter(b.column(3).is_valid()) for b in batches)
        for batch, texts in small_batches(some, 2, BATCH):
            s = Suffixes([_single_spaced(t) for t in texts], window, prefix)
            words, first_word = s.words, s.words.first[:-1]
            ids, rows = _longs(batch.column(0)), _longs(batch.column(1))
            wanted = np.isin(s.prefix, [] if heavy is None else heavy) == only
            if not only:
                places = batch.column(3)
                asked = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(places.offsets.to_numpy())) << 32 | places.flatten().to_numpy().astype(np.int64)
                wanted &= np.isin(s.text.astype(np.int64) << 32 | s.place, asked)
            suffix = np.repeat(np.arange(len(s.text)), s.lengths)
            keep = wanted[suffix] if len(suffix) else np.zeros(0, bool)
            suffix, at, start = suffix[keep], s.begin[keep], s.start[keep]
            text = s.text[suffix]
            doc = ids[text]
            first = _firsts(words.grams(window)[at], doc)
            settled = doc[first] < doc
            later = np.flatnonzero(settled)
            number = words.numbers() if len(later) else later
            for j in range(window):  # equal hashes are not yet equal words
                later = later[number[at[later] + j] == number[at[first[later]] + j]]
            settled[:] = False
            settled[later] = True
            head = _runs(suffix, settled)
            ends = np.append(head[1:], len(suffix))
            goes, of, place = settled[head], s.text[suffix[head]], s.place[suffix[head]]
            begin, stop = start[head], start[ends - 1] + window if len(head) else start
            base = first_word[of]
            a, b, c = words.starts[begin + base], words.starts[place + base], words.ends[stop + base - 1]
            spans = [None if gone else (words.data[x:y], words.data[y:z] + b" ") for gone, x, y, z in zip(goes.tolist(), a.tolist(), b.tolist(), c.tolist(), strict=True)]
            texts_of = [pa.array([t and t[i] for t in spans], pa.binary()).cast(pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(s.prefix[suffix[head]], mask=goes), pa.array(ids[of]), pa.array(rows[of]), *(pa.array(x.astype(np.int32)) for x in (begin, stop, place)), *texts_of], schema=CANDIDATES)

    return run


GONE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_GONE, _CANDIDATES = "doc_id long, row long, start int, stop int", "key long, doc_id long, row long, start int, stop int, place int, before string, suffix string"


def _symbols(texts: list[str], backwards: bool = False) -> np.ndarray:
    """The words of each text, all followed by a space, as a row of numbers, in which -1 stands for none."""
    words = Words([t.encode() for t in texts])
    number, counts = words.numbers(), np.diff(words.first)
    row = np.repeat(np.arange(len(texts)), counts)
    column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.full((len(texts), int(counts.max(initial=0))), -1, np.int64)
    out[row, counts[row] - 1 - column if backwards else column] = number
    return out


class Subtrees:
    """The suffix trees of one or more groups. Rows are (key, doc_id, start, stop, place, before, suffix), sorted by key and suffix,
    so that `common`, the number of words that a suffix shares with the one above it, holds the nodes: those at depth d are
    the runs in which `common` is d or more."""

    def __init__(self, key: np.ndarray, before: list[str], suffix: list[str], window: int):
        self.window, self.before, words = window, _symbols(before, backwards=True), _symbols(suffix)
        same = (words[1:] == words[:-1]) & (words[1:] >= 0) & (key[1:] == key[:-1])[:, None]
        self.common = np.concatenate(([0], np.cumprod(same, axis=1).sum(1)))

    def removed(self, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each suffix and k, whether its window that begins k words before it is in a smaller doc too. A suffix has
        the windows that begin from `begin` down to `end` words before it."""
        gone = np.zeros((len(doc), int(begin.max(initial=0)) + 2), bool)
        left = np.zeros(len(doc), np.int64)
        for k in range(int(begin.max(initial=-1)) + 1):
            if k:
                left = np.unique((left << 32) + self.before[:, k - 1] + 1, return_inverse=True)[1].reshape(-1)
            node = np.cumsum(self.common < self.window - k)
            inner = np.bincount(node)[node] > 1
            at = np.flatnonzero(inner & (end <= k) & (k <= begin))
            if len(at):
                d = doc[at]
                gone[at, k] = d[_firsts((node[at] << 32) + left[at], d)] < d
        return gone


def _trees(window: int, group: int, survivors: bool = False):
    """From rows (key, doc_id, row, start, stop, place, before, suffix), sorted by key and suffix, and settled rows (no
    key), the words to remove. Whole groups are taken together, several small ones or one. With survivors the other rows
    come back too (stop null)."""

    def settle(table: pa.RecordBatch) -> pa.RecordBatch:
        key, ids, rows, start, stop, place = (table.column(i).to_numpy() for i in range(6))
        tree = Subtrees(key, table.column(6).to_pylist(), table.column(7).to_pylist(), window)
        gone = tree.removed(ids, place - start, place - stop + window)
        flat = np.diff(np.concatenate(([False], gone.reshape(-1))).astype(np.int8))
        first, end = np.flatnonzero(flat == 1), np.flatnonzero(flat == -1)  # the last column of each row is false
        at, most, least = first // gone.shape[1], (end - 1) % gone.shape[1], first % gone.shape[1]
        found = pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip((ids[at], rows[at], place[at] - most, place[at] - least + window), GONE.types, strict=True)], schema=GONE)
        if not survivors:
            return found
        stay = pa.array(np.flatnonzero(~gone.any(1)))
        n, m = found.num_rows, len(stay)
        other = [*(table.column(i).take(stay) for i in (1, 2, 3)), pa.nulls(m, pa.int32()), table.column(7).take(stay)]
        columns = [pa.concat_arrays([x, y]) for x, y in zip([*found.columns, pa.nulls(n, other[-1].type)], other, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*GONE.names, "suffix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            open_ = batch.column(0).is_valid()
            settled = batch.filter(pa.compute.invert(open_))
            if settled.num_rows:
                yield settled.select(GONE.names)
            batch = batch.filter(open_)
            held.append(batch)
            count += batch.num_rows
            if count >= group:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(_runs(whole.column(0).to_numpy())[-1])  # the last group may go on
                if cut:
                    yield settle(whole.slice(0, cut))
                held, count = [whole.slice(cut)], count - cut
        if count:
            yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in small_batches(batches, 2):
        words, rows, gaps = Words(texts), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        out: tuple[list, ...] = ([], [], [])
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            keep = np.ones(b - a, bool)
            for gap in gaps[i] or ():
                if gap["row"] == rows[i]:
                    keep[gap["start"] : gap["stop"]] = False
            at = np.flatnonzero(keep) + a
            out[0].append(int(b - a))
            out[1].append(int(b - a - len(at)))
            out[2].append(b" ".join([words.data[x:y] for x, y in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def _prefix_key(words: int) -> Column:
    return F.xxhash64(F.substring_index("suffix", " ", words))


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (key, doc_id, row, start, ...) with the column `large` that marks has for some keys. Up to MARKS of them are
    broadcast; more keys, which stand for many rows each, meet them in parts, with copies of the mark."""
    marks = stored(marks, "marks")
    if marks.count() <= MARKS:
        return rows.join(F.broadcast(marks), "key", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(SALTS)).cast("int"))
    copies = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["key", "salt"], "left").drop("salt")


def _grown(windows: DataFrame, window: int, prefix: int, group: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Windows (doc_id, row, start, suffix) with, as key, the shortest prefix that at most `group` of them share; and
    those that share their whole words with more."""
    fit = []
    for words in range(prefix, window + 1):
        keyed = windows.withColumn("key", _prefix_key(words))
        large = keyed.groupBy("key").count().where(F.col("count") > group).select("key", F.lit(True).alias("large"))
        marked = stored(_marked(keyed, large), f"prefix-{words}")
        fit.append(marked.where("large IS NULL").drop("large"))
        windows = marked.where("large").drop("large")
        if windows.isEmpty():
            return fit, None
    return fit, windows


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of CANDIDATES by groups, those of a group sorted by their suffixes."""
    return rows.repartition(F.coalesce("key", F.hash("doc_id", "row"))).sortWithinPartitions("key", "suffix")


def _suffixes(windows: DataFrame, window: int) -> DataFrame:
    """Windows (key, doc_id, row, start, suffix) as rows of CANDIDATES."""
    return windows.select("key", "doc_id", "row", "start", (F.col("start") + window).cast("int").alias("stop"), F.col("start").alias("place"), F.lit("").alias("before"), "suffix")


def _leaves(windows: DataFrame, window: int, group: int) -> list[DataFrame]:
    """What goes of windows (key, doc_id, row, start, suffix) that too many share: a part of a group loses all but the
    windows of its first document, which then compete with those of other parts."""
    gone: list[DataFrame] = []
    while True:
        groups = windows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        most = groups.where("lo < hi").agg(F.max("n")).first()[0]
        if most is None:
            return gone
        parts = -(-most // max(group, 8))
        part = F.pmod(F.xxhash64("doc_id", "row", "start", F.lit(len(gone))), F.lit(parts))
        rows = _suffixes(windows.withColumn("key", F.xxhash64("key", part)), window)
        settled = stored(_dealt(rows).mapInArrow(_trees(window, group, survivors=True), f"{_GONE}, suffix string"), "leaves")
        gone.append(settled.where("stop IS NOT NULL").drop("suffix"))
        windows = settled.where("stop IS NULL").select(_prefix_key(window).alias("key"), "doc_id", "row", "start", "suffix")


def _large_groups(candidates: DataFrame, window: int, prefix: int, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Candidates of large groups as suffixes that begin where their windows do, in groups that fit; and what goes already."""
    words = F.split(F.concat("before", "suffix"), " ")
    each = F.transform(F.sequence(F.lit(0), F.col("stop") - F.col("start") - window), lambda i: F.struct((F.col("start") + i).alias("start"), F.concat(F.array_join(F.slice(words, i + 1, F.lit(window)), " "), F.lit(" ")).alias("suffix")))
    settled = candidates.where("key IS NULL").select(*GONE.names)
    windows = candidates.where("key IS NOT NULL").select("doc_id", "row", F.explode(each).alias("w")).select("doc_id", "row", "w.start", "w.suffix")
    fit, rest = _grown(windows, window, prefix, group)
    return [_suffixes(part, window) for part in fit], [settled, *([] if rest is None else _leaves(rest, window, group))]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, text (the kept words, joined by one space).

    Words are [^\\x20\\x09-\\x0D]+. A word goes if a window of `window` words covers it whose words also follow each
    other in a document with a smaller id. Windows are judged on the input. Null texts have no words; an empty table gives no
    rows; a text of any length is looked at whole. A null id is neither smaller nor larger than any: its text stays
    whole and removes nothing. Rows that share an id remove nothing from each other. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows that share an id are told apart by a hash of their texts; a tag is enough where more places than a row's own do no harm
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    rows = rows.select("doc_id", F.shiftright("row", 48).cast("int").alias("tag"), "row", "text")
    known = few_rows(rows).where("doc_id is not null")
    places = known.select("doc_id", "tag", "text").mapInArrow(_places(window, prefix), _PLACES)
    places = places.repartition(F.coalesce("prefix", F.xxhash64("doc_id", "tag"))).sortWithinPartitions("prefix", "doc_id")
    shared = stored(places.mapInArrow(_shared(group), _SHARED), "places")
    by_text = shared.where("heavy IS NULL").groupBy("doc_id", "tag").agg(F.concat(F.collect_list("place"), F.flatten(F.collect_list("places"))).alias("places"))
    # the hints, and two left joins: texts are dealt by document at every size of the input, once for both joins
    asked = rows.join(by_text.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "row", "text", "places")
    found = lambda texts, *which: texts.mapInArrow(_candidates(window, prefix, *which), _CANDIDATES)
    heavy = stored(shared.where("heavy IS NOT NULL").select("heavy").distinct(), "heavy")
    gone: list[DataFrame] = []
    count = heavy.count()
    if not count:
        candidates = found(asked)
    elif count <= MARKS:  # they are shared, so the texts need no places; a second look costs less than writing all candidates
        prefixes = np.array([r.heavy for r in heavy.collect()], np.int64)
        candidates, large = found(asked, prefixes), stored(found(known.select("doc_id", "row", "text"), prefixes, True), "large")
    else:
        marked = stored(_marked(found(asked), heavy.select(F.col("heavy").alias("key"), F.lit(True).alias("large"))), "candidates")
        candidates, large = (marked.where(x).select(*CANDIDATES.names) for x in ("large IS NULL", "large"))
    if count:
        parts, gone = _large_groups(large, window, prefix, group)
        for part in parts:
            candidates = candidates.unionByName(part)
    removed = _dealt(candidates).mapInArrow(_trees(window, group), _GONE)
    for part in gone:
        removed = removed.unionByName(part)
    gaps = removed.select("doc_id", F.shiftright("row", 48).cast("int").alias("tag"), F.struct("row", "start", "stop").alias("gap")).groupBy("doc_id", "tag").agg(F.collect_list("gap").alias("gaps"))
    whole = rows.join(gaps.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "row", "text", "gaps")
    return whole.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, text string")
