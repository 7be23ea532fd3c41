"""Near-duplicate detection: MinHash bands propose pairs, signatures and full sets confirm them, stars join them up.

1. A document's set is its distinct word shingles. Documents with equal sets collapse to one node, the smallest id.
2. Each node has BANDS * ROWS minima of universal hashes; nodes that agree on a whole band share a bucket. A pair at the
   threshold 0.85 meets in no bucket with a probability of (1 - 0.85 ** 6) ** 28 = 1.8e-6.
3. In each bucket the most connected node leads. Each node is paired with the leader whose signature is closest to its
   own, the full sets confirm the pairs, and confirmed pairs go to the components.
4. Buckets that still hold several components compare, in blocks, nodes of different components, so that no link is
   lost: signatures first, then the full sets; only confirmed links leave a block. Where more than CROWD nodes of a bucket
   are outside its largest component, that would cost more rows than FINE finer bands do, which then deal its nodes into
   smaller buckets; a pair at the threshold meets in none of these with a probability of about 3e-6.

Shingles have two independent hashes of 64 bits, mixed from whole words: sets are sketched by one and compared by the
other, and sets collapse as equal by a digest of both. A bucket or set that many documents share is joined by broadcast
of its one row, so no task gets all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from ..operators.joins import join_spread
from .blocks import crossing_links
from .common import Words, dropped, few_rows, mix, small_batches, spare, stored

BANDS, ROWS = 28, 6
#: Signatures this far below the threshold rule a pair out: five standard errors of the estimate.
MARGIN = 0.14
SHINGLE = 5
#: A hot document's pairs are dealt into up to so many parts.
SALTS = 4096
_rng = np.random.default_rng(909)
_A = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
#: Buckets with more nodes than CROWD, where comparing block by block would cost more rows, are split by FINE finer bands,
#: each of FINE_ROWS places of the signature.
FINE, FINE_ROWS = 128, 10
CROWD = 512 * FINE
_FINE = np.random.default_rng(910).permuted(np.tile(np.arange(BANDS * ROWS), (FINE, 1)), axis=1)[:, :FINE_ROWS]
_BAND = _rng.integers(0, 2**63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's set of k-word shingles in two lanes of 64 bits, each in the order of the first; A-Z are lower-cased. A
    text of fewer words is one shingle. Sets are sketched by the first lane and compared by the second."""
    words = Words(texts, lower=True)
    lanes = words.grams(k), words.grams(k, 1)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            first, at = np.unique(lanes[0][a : b - k + 1], return_index=True)
            yield first, lanes[1][a + at]
        elif b > a:
            short = [np.array([b - a], np.uint64) for _ in lanes]
            for i in range(a, b):
                short = [mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i]) for h, w in zip(short, (words.hashes, words.second), strict=True)]
            yield short[0], short[1]
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def common_count(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sets have in common."""
    return len(np.intersect1d(x, y, assume_unique=True))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The signature: for each hash a * x + b the least value over the set."""
    least = np.full(len(_A), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(1), out=least)
    return least


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("bytes", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in small_batches(batches, 1):
        sizes, hi, lo, bands, signatures = [], [], [], [], []
        lengths = [len(x) for x in texts]
        for s, second in shingle_sets(texts):
            sizes.append(len(s))
            digest = np.frombuffer(hashlib.blake2b(s.tobytes() + second.tobytes(), digest_size=16).digest(), np.int64)
            hi.append(digest[0])
            lo.append(digest[1])
            if not len(s):
                bands.append(None)
                signatures.append(None)
                continue
            least = minima(s)
            rows = least.reshape(BANDS, ROWS)
            h = _BAND.copy()
            for r in range(ROWS):
                h = (h ^ rows[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            bands.append(h.view(np.int64))
            signatures.append((mix(least) >> np.uint64(48)).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, t) for x, t in zip((sizes, hi, lo, lengths, bands, signatures), SKETCH.types[1:], strict=True))], schema=SKETCH)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return few_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sketch, "doc_id long, n_shingles long, set_hi long, set_lo long, bytes long, bands array<long>, signature binary")


def _alike(floor: float):
    """Keeps the pairs (a, b, sig_a, sig_b) whose signatures agree in `floor` of the places; gives the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                share = (x == y).mean(1)
                keep = pa.array(share >= floor)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(share).filter(keep)], names=["a", "b", "share"])

    return run


def _confirm(percent: int):
    """From rows (a, salt, b, text), each a's own text first (b null), the pairs with 100 * |A & B| >= percent * |A | B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, mine = None, None
        for batch, texts in small_batches(batches, 3):
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for x, s, y, (_, shingles) in zip(a, salt, b, shingle_sets(texts), strict=True):
                if y is None:
                    lead, mine = (x, s), shingles
                elif lead == (x, s):
                    both = common_count(mine, shingles)
                    if 100 * both >= percent * (len(mine) + len(shingles) - both):
                        found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on the full sets. A hot a is dealt out in salted parts, each with a copy of its text."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    counts = pairs.groupBy("a", "salt").count().groupBy("a").agg(F.sum("count").alias("n"))
    salts = F.least(F.lit(SALTS), F.ceil(F.col("n") / 128)).cast("int")
    salted = pairs.join(counts.select("a", salts.alias("parts")), "a").select("a", F.expr("salt % parts").alias("salt"), "b")
    members = salted.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    leads = salted.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = leads.unionAll(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirm(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id that each node of edges (a, b) reaches, by alternating large and small stars. Each
    round is stored, and the one before it then deleted."""
    rounds: list[DataFrame] = []

    def cut(df: DataFrame) -> DataFrame:
        rounds.append(stored(df, "edges"))
        if len(rounds) > 1:
            dropped(rounds.pop(0))
        return rounds[0]

    return connected(edges, cut)


def _near(floor: float):
    """For blocks.crossing_links: keys are a node's bands, its sketch is the signature."""

    def near(bucket: int, sketches: list, n: int, others: list) -> list[tuple[float, int]]:
        signatures = np.frombuffer(b"".join(sketches[m][1] for m in others), np.uint16).reshape(len(others), -1)
        share = (signatures == np.frombuffer(sketches[n][1], np.uint16)).mean(1)
        found = []
        for k in np.flatnonzero(share >= floor).tolist():
            m = others[k]
            first = next((x for x, y in zip(sketches[n][0], sketches[m][0], strict=True) if x == y), None)
            if first == bucket:
                found.append((float(share[k]), m))
        return found

    return near


def fine_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature its FINE finer bands, as keys that tell bands apart."""
    keys = np.tile(np.arange(1, FINE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signatures), 1))
    for places in _FINE.T:
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + signatures[:, places])
    return keys.view(np.int64)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        keys = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * FINE, fine_keys(signatures).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, batch.column(2)], names=["node", "bytes", "keys", "sketch"])


def _crowds(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets with more than CROWD nodes outside their largest component."""
    rows = buckets.where(F.col("n") > CROWD).join(labels, "node", "left")
    parts = rows.groupBy("bucket", F.coalesce("component", "node").alias("component")).agg(F.count("*").alias("n"))
    return parts.groupBy("bucket").agg((F.sum("n") - F.max("n")).alias("others")).where(F.col("others") > CROWD).select("bucket")


def _linked(percent: int):
    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = common_count(x, y)
        return 100 * both >= percent * (len(x) + len(y) - both)

    return linked


def _sets(texts: list[str]) -> list[np.ndarray]:
    return [second for _, second in shingle_sets([(t or "").encode() for t in texts])]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A & B| >= percent * |A | B| over their distinct 5-word shingles (A-Z lower-cased,
    words [^\\x20\\x09-\\x0D]+; fewer than five words are one shingle). component_id is the smallest id reachable. Null or
    blank texts have no shingles and are linked with nothing; texts of any length are shingled whole; an empty table gives no
    rows. Rows that share an id are one node: their component is that of their sets' links. A null id is linked with
    nothing: its component_id is null and it is kept. Ids are numbers. Other columns are ignored. percent may not be under 80.
    """
    if percent < 80:
        raise ValueError("the bands are set for a threshold of at least 80 per cent")
    floor = percent / 100 - MARGIN
    sketch = stored(sketches(docs, id_col, text_col), "sketch")
    total = sketch.count()
    compared = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    known = sketch.where(compared)
    classes = known.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("node"), F.count("*").alias("members"))
    first = classes.select("set_hi", "set_lo", F.col("node").alias("doc_id"))
    nodes = stored(known.join(first, ["set_hi", "set_lo", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set_hi", "set_lo"]).select("doc_id", "bands", "signature", "bytes"), "nodes")
    bands = nodes.select(F.col("doc_id").alias("node"), "bytes", F.explode("bands").alias("bucket"))
    crowded = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket", "n", F.col("n").alias("size"))
    buckets = stored(join_spread(bands, crowded, ["bucket"], "size", BANDS * nodes.count()).select("bucket", "node", "n", "bytes"), "buckets")
    rank = buckets.groupBy("node").agg(F.sum("n").alias("rank"))
    # the hint: all texts are dealt by id at every size of the input
    wanted = rank.select(F.col("node").alias("doc_id")).hint("merge")
    texts = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id", "left_semi"), "texts")
    ranked = stored(buckets.select("bucket", "node").join(rank, "node"), "ranked")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("node")).alias("minus"))).alias("top"), F.count("*").alias("n")).select("bucket", (-F.col("top.minus")).alias("a"), "n")
    stars = join_spread(ranked, leaders, ["bucket"], "n", ranked.count()).where("a <> node").select("a", F.col("node").alias("b")).distinct()
    left = nodes.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a"))
    right = nodes.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b"))
    stars = stars.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(floor), "a long, b long, share double")
    best = stars.groupBy("b").agg(F.max(F.struct("share", (-F.col("a")).alias("minus"))).alias("top")).select((-F.col("top.minus")).alias("a"), "b")
    links = stored(confirmed(stored(best, "best"), texts, percent), "links")
    labels = stored(components(links), "labels")
    keys = nodes.select(F.col("doc_id").alias("node"), F.col("bands").alias("keys"), F.col("signature").alias("sketch"))
    bodies = texts.select(F.col("doc_id").alias("node"), F.col("text").alias("body"))
    compared_by = (bodies, _near(floor), _sets, _linked(percent))
    rest, finer = buckets.select("bucket", "node", "bytes"), None
    if not buckets.where(F.col("n") > CROWD).isEmpty():
        crowds = F.broadcast(stored(_crowds(buckets, labels), "crowds"))  # at most BANDS in CROWD of all nodes
        inside = rest.join(crowds, "bucket", "left_semi").select(F.col("node").alias("doc_id")).distinct()
        finer = stored(nodes.join(inside, "doc_id", "left_semi").select("doc_id", "bytes", "signature").mapInArrow(_finer, "node long, bytes long, keys array<long>, sketch binary"), "finer")
        rest = rest.join(crowds, "bucket", "left_anti")
    more = crossing_links(rest, labels, keys, *compared_by)
    if finer is not None:
        split = finer.select(F.explode("keys").alias("bucket"), "node", "bytes")
        more = more.unionAll(crossing_links(split, labels, finer.select("node", "keys", "sketch"), *compared_by))
    more = stored(more, "crossing")
    if not more.isEmpty():
        labels = stored(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "labels")
    named = classes.join(labels, "node", "left").select("set_hi", "set_lo", "members", F.coalesce("component", "node").alias("component"))
    rows = join_spread(known.select("doc_id", "n_shingles", "set_hi", "set_lo"), named, ["set_hi", "set_lo"], "members", total)
    alone = sketch.where(~compared).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    rows = rows.select("doc_id", "n_shingles", "component").unionAll(alone)
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs whose document stands for its component, with all their columns."""
    [key] = spare(docs.columns, "kept_id")
    none = F.lit(-(2**63))  # stands for a null id
    kept = near_duplicates(docs, id_col, text_col, percent).where("kept").select(F.coalesce("doc_id", none).alias(key)).distinct()
    return docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), none)).join(kept, key, "left_semi").select(docs.columns)
