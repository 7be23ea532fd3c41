"""Cropped and edited copies of images, by local descriptors.

1. Every image is brought to one size, so that resized copies look alike, and corners are found on several scales of it,
   near enough to each other for any crop. Around each corner, the direction to the centre of brightness turns a fixed set
   of binary brightness tests, so that the 256-bit descriptor stays when the image is turned. The tests reach far: small
   patches of unlike images often look alike.
2. Each word of KEY_BITS bits of a descriptor is a key of a table; descriptors at a small Hamming distance agree in some
   word. Images that share SHARED keys are compared.
3. Pairs need descriptors that are each other's nearest and one similarity transform that most of these matches obey.
4. In each bucket the most connected image leads; an image is compared with the leader that it shares most keys with.
   In buckets that then still hold several components the images of different ones meet, so that no link is lost. Nearly
   all pairs meet in one bucket only, by chance: a sketch of pairs leaves them out before any row is made of them. In
   crowded buckets, where fewer keys than images would meet, images meet by pairs of their keys instead. Where more than
   SMALL images have the same two keys, or nearly all of a crowded bucket are of one component, they are compared block
   by block, each pair once. Exact copies are one node from the start.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_spread
from .blocks import crossing_links
from .common import mix, session_conf, stored
from .minhash_dedup import components
from .sketch import CELLS, PARTS, Sketch, frequent_cells, places_of, width

#: The side of a square of the area to which images are resized; scales below, and the corners kept on each.
AREA_SIDE = 160
SCALES = tuple(2 ** (k / 8) for k in range(9))
CORNERS = (28, 23, 19, 16, 13, 11, 9, 8, 7)
#: Pixels that the tests and the disc for the direction reach, and that corners keep from the border.
RADIUS, DISC, BORDER = 16, 12, 18
TESTS, WORDS, KEY_BITS = 256, 4, 60
#: A word with fewer set or unset bits says too little to be a key.
LEAST_BITS = 8
#: Keys that a pair must share, bits in which a match may differ, matches that must obey one transform, pixels (at the one
#: size) by which they may miss.
SHARED, DISTANCE, INLIERS, MISS = 2, 64, 7, 3.0
#: Images with two keys in common up to which those of different components are paired.
SMALL = 16
#: Buckets of up to SMALL images, or MEET for each key that an image has on average, are not crowded.
MEET = 2
#: Images beside those of one component up to which a crowded bucket is compared block by block.
FEW = 16
#: Cells of a sketch for each meeting of images, or of keys; with less than LEAST_CELLS at the sketch's bound there are several rounds.
PAIR_CELLS, LEAST_CELLS = 8, 2
#: Shared keys that are broadcast, 16 bytes each, or four times the pairs; more meet the keys, or bodies, by shuffle.
MARKS = 2_000_000
#: Pairs of one image that a task compares.
PART = 128
#: Keys, or pairs, that a task counts before it sends them.
FLUSH = 2_000_000
#: Images that a Python worker gets at once.
BATCH = "256"
_rng = np.random.default_rng(256)
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2, (TESTS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
_TESTED = np.concatenate([_PAIRS[:, n, 0] + 1j * _PAIRS[:, n, 1] for n in (0, 1)])
_DISC = np.array([(x, y) for x in range(-DISC, DISC + 1) for y in range(-DISC, DISC + 1) if x * x + y * y <= DISC * DISC])
_ARMS = _DISC.T.astype(np.float32)


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """The grey levels of a binary PGM image (P5, up to 255); None if it isn't one."""
    if not data or data[:2] != b"P5":
        return None
    parts = data[:64].split(maxsplit=4)
    try:
        width, height, top = (int(x) for x in parts[1:4])
        at = data.index(parts[3], data.index(parts[2], data.index(parts[1], 2) + len(parts[1])) + len(parts[2])) + len(parts[3]) + 1
    except (ValueError, IndexError):
        return None
    if not 0 < top < 256 or len(data) - at < width * height or width < 1 or height < 1:
        return None
    return np.frombuffer(data, np.uint8, width * height, at).reshape(height, width)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.clip(image, 0, 255).astype(np.uint8).tobytes()


def _taps(x: np.ndarray, step: int) -> np.ndarray:
    """Binomial sums of five values of a flat array, `step` apart."""
    a, b, c, d, e = (x[i * step : len(x) - (4 - i) * step] for i in range(5))
    out, more = b + d, a + e
    out *= 4
    out += more
    out += np.multiply(c, 6, out=more)
    return out


def _within(x: np.ndarray) -> np.ndarray:
    """Five-tap binomial blur over the last two axes, without the two outer rows and columns on each side."""
    height, width = x.shape[-2:]
    sums = _taps(_taps(x.reshape(-1), width), 1)
    kept = np.ndarray((*x.shape[:-2], height - 4, width - 4), x.dtype, sums, strides=x.strides)
    return kept * np.float32(1 / 256)


def _blur(x: np.ndarray) -> np.ndarray:
    """The same of an image, whose border repeats."""
    height, width = x.shape
    p = np.empty((height + 4, width + 4), x.dtype)
    p[2:-2, 2:-2] = x
    p[2:-2, :2], p[2:-2, -2:] = x[:, :1], x[:, -1:]
    p[:2], p[-2:] = p[2], p[-3]
    return _within(p)


def _resized(image: np.ndarray, scale: float) -> np.ndarray:
    """image at 1 / scale of its size: the mean of whole blocks, then between pixels."""
    block = int(scale)
    if block > 1 and min(image.shape) >= block:
        height, width = (n // block for n in image.shape)
        image = image[: height * block, : width * block].reshape(height, block, width, block).mean((1, 3), dtype=np.float32)
        scale /= block
    if scale == 1:
        return image
    (y0, y1, fy), (x0, x1, fx) = (_between(n, scale) for n in image.shape)
    left = 1 - fy[:, None]
    rows = image[y0] * left
    rows += image[y1] * (1 - left)
    out = rows.take(x0, 1)
    out *= 1 - fx
    more = rows.take(x1, 1)
    more *= fx
    out += more
    return out


@functools.lru_cache(64)
def _between(n: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pixel of n at 1 / scale: the two between which it lies, and how near it is to the second."""
    at = (np.arange(max(1, round(n / scale))) + 0.5) * scale - 0.5
    one = np.clip(np.floor(at).astype(int), 0, n - 2 if n > 1 else 0)
    return one, np.minimum(one + 1, n - 1), np.clip(at - one, 0, 1).astype(np.float32)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x + iy, in pixels of the image at the one size) and descriptors (bytes) of an image's corners."""
    places, found = [], []
    one_size = float(np.sqrt(image.size)) / AREA_SIDE
    base = image.astype(np.float32)
    base = _blur(_resized(_blur(base) if one_size > 1 else base, one_size))
    for scale, most in zip(SCALES, CORNERS, strict=True):
        level = _resized(base, scale)
        if scale > 1:
            level = _blur(level)
        if min(level.shape) <= 2 * BORDER + 2:
            break
        # corners keep BORDER from the border, so that more than three pixels around them are not needed
        far = BORDER - 3
        gx = level[far:-far, far + 1 : 1 - far] - level[far:-far, far - 1 : -far - 1]
        gy = level[far + 1 : 1 - far, far:-far] - level[far - 1 : -far - 1, far:-far]
        xx, yy, xy = _within(np.stack((gx * gx, gy * gy, gx * gy)))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[1:-1, 1:-1]
        most_of = np.maximum(np.maximum(r[:, :-2], r[:, 2:]), r[:, 1:-1])
        peak = inner >= np.maximum(np.maximum(most_of[:-2], most_of[2:]), most_of[1:-1])
        peak &= inner > max(1.0, 0.005 * float(inner.max()))
        y, x = np.nonzero(peak)
        best = np.argsort(-inner[y, x], kind="stable")[:most]
        y, x = y[best] + BORDER, x[best] + BORDER
        if not len(x):
            continue
        smooth = _blur(_blur(level))
        flat, across = smooth.reshape(-1), smooth.shape[1]
        corner = (y * across + x)[:, None]
        disc = flat[corner + (_DISC[:, 1] * across + _DISC[:, 0])]
        disc = disc - disc.mean(1, keepdims=True)
        turn = (disc * _ARMS[0]).sum(1) + 1j * (disc * _ARMS[1]).sum(1)
        turn = turn / np.maximum(np.abs(turn), 1e-6)
        at = np.rint((_TESTED[None] * turn[:, None]).view(np.float64)).astype(np.int64)
        value = flat[corner + at[:, 1::2] * across + at[:, ::2]]
        found.append(np.packbits(value[:, TESTS:] > value[:, :TESTS], axis=1))
        places.append(((x + 0.5) + 1j * (y + 0.5)) * scale)
    if not found:
        return np.zeros(0, complex), np.zeros((0, TESTS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(found)


def keys_of(descriptors: np.ndarray) -> np.ndarray:
    """The table keys of an image, sorted: for each word that says enough, a hash of its table and its bits."""
    part = np.ascontiguousarray(descriptors).view(">u8").astype(np.uint64)
    words = np.empty_like(part)
    words[:, 0] = part[:, 0]
    for n in range(1, WORDS):  # WORDS words of 60 bits, which lie side by side
        words[:, n] = part[:, n - 1] << np.uint64(64 - 4 * n) | part[:, n] >> np.uint64(4 * n)
    words &= ~np.uint64(2 ** (64 - KEY_BITS) - 1)
    keys = mix(mix(words.byteswap()) + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ones = np.bitwise_count(words)
    return np.unique(keys.view(np.int64)[(ones >= LEAST_BITS) & (ones <= KEY_BITS - LEAST_BITS)])


def body_of(places: np.ndarray, descriptors: np.ndarray) -> bytes:
    """Places to an eighth of a pixel, then descriptors."""
    grid = np.clip(np.rint(np.stack((places.real, places.imag), 1) * 8), 0, 2**16 - 1).astype("<u2")
    return grid.tobytes() + descriptors.tobytes()


def parse_body(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(body) // (4 + TESTS // 8)
    grid = np.frombuffer(body, "<u2", 2 * n).reshape(n, 2) / 8
    return grid[:, 0] + 1j * grid[:, 1], np.frombuffer(body, np.uint8, offset=4 * n).reshape(n, -1)


def consensus(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> int:
    """How many matches of two images obey the similarity transform that most obey."""
    (a, da), (b, db) = one, two
    if min(len(a), len(b)) < INLIERS:
        return 0
    da, db = (np.ascontiguousarray(d).view(np.uint64) for d in (da, db))
    distance = np.bitwise_count(da[:, None, 0] ^ db[None, :, 0]).astype(np.uint16)
    for word in range(1, da.shape[1]):
        distance += np.bitwise_count(da[:, None, word] ^ db[None, :, word])
    near, back = distance.argmin(1), distance.argmin(0)
    rows = np.arange(len(a))
    good = (back[near] == rows) & (distance[rows, near] <= DISTANCE)
    x, y = a[good], b[near[good]]
    if len(x) < INLIERS:
        return 0
    i, j = np.triu_indices(len(x), 1)
    apart = np.abs(x[i] - x[j]) > 6
    i, j = i[apart], j[apart]
    if not len(i):
        return 0
    factor = (y[i] - y[j]) / (x[i] - x[j])
    fair = (np.abs(factor) > 0.4) & (np.abs(factor) < 2.5)
    factor, i = factor[fair], i[fair]
    if not len(i):
        return 0
    best, obey = 0, None
    for at in range(0, len(i), 1024):
        f, k = factor[at : at + 1024, None], i[at : at + 1024]
        hits = np.abs(f * (x[None] - x[k][:, None]) + y[k][:, None] - y[None]) <= MISS
        top = int(hits.sum(1).argmax())
        if hits[top].sum() > best:
            best, obey = int(hits[top].sum()), hits[top]
    # matches at one place on several scales count once
    return len(np.unique(np.rint(x[obey] / 4)))


def near(bucket: int, sketches: list, n: int, others: list) -> list[tuple[float, int]]:
    """For blocks.crossing_links: keys are the low 32 bits of those that an image has in buckets of several components, sketches
    the buckets that are compared by blocks. Pairs that share SHARED keys are near in the first bucket that they share: few
    are, and their full keys are compared later."""
    lists = [sketches[m][0] for m in others]
    both = np.isin(np.concatenate(lists), sketches[n][0]).astype(np.int64)
    counts = np.add.reduceat(both, np.cumsum([0, *map(len, lists[:-1])]))
    own = set(sketches[n][1])
    return [(float(counts[k]), others[k]) for k in np.flatnonzero(counts >= SHARED).tolist() if min(own.intersection(sketches[others[k]][1])) == bucket]


def prepared(bodies: list) -> list[tuple]:
    return [parse_body(b) for b in bodies]


def linked(one: tuple, two: tuple) -> bool:
    return consensus(one, two) >= INLIERS and len(np.intersect1d(keys_of(one[1]), keys_of(two[1]), assume_unique=True)) >= SHARED


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            counts, bodies = [], []
            for data in part.column(1):
                image = decode_pgm(data.as_py())
                places, descriptors = describe(image) if image is not None else (np.zeros(0, complex), np.zeros((0, TESTS // 8), np.uint8))
                counts.append(len(places))
                bodies.append(body_of(places, descriptors))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary())], names=["image_id", "digest", "n_corners", "body"])


def _keys(batches: Iterator[pa.RecordBatch], seen: Sketch | None = None) -> Iterator[pa.RecordBatch]:
    """The keys of images (node, body), with `seen` those that two images may have."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys = [keys_of(parse_body(b)[1]) for b in part.column(1).to_pylist()]
            if seen:
                keys = [k[seen.may_have(k.view(np.uint64))] for k in keys]
            nodes = np.repeat(part.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], names=["node", "bucket"])


def _frequent(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int, expected: int) -> Broadcast:
    """A sketch of those hashes of rows that may occur `least` times, wide enough for so many `expected` ones."""
    cells = width(expected)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in hashes(batches):
            held.append(found)
            n += len(found)
            if n > FLUSH:
                yield from places_of(np.concatenate(held), cells)
                held, n = [], 0
        if n:
            yield from places_of(np.concatenate(held), cells)

    return rows.sparkSession.sparkContext.broadcast((frequent_cells(rows.mapInArrow(count, PARTS), least, cells), cells))


def _seen_twice(bodies: DataFrame, corners: int) -> Broadcast:
    """A sketch of the keys that two images may have: nearly all keys are of one image, and are neither counted nor dealt."""
    return _frequent(bodies, lambda batches: (b.column(1).to_numpy().view(np.uint64) for b in _keys(batches)), 2, 2 * WORDS * corners)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From rows (bucket, node, component) that hold buckets together, each bucket's pairs a < b of different components.
    Held are a batch, the bucket that it ends in, and as many pairs as their rows; a row meets those after it in its bucket."""
    kept = [np.zeros(0, np.int64)] * 3
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            whole, kept = kept, []
        else:
            rows = [np.concatenate(x) for x in zip(kept, (c.to_numpy() for c in batch.columns), strict=True)]
            last = int(np.flatnonzero(np.diff(rows[0], prepend=rows[0][:1] - 1))[-1]) if len(rows[0]) else 0
            whole, kept = [x[:last] for x in rows], [x[last:] for x in rows]
        bucket, node, component = whole
        for step in range(1, len(bucket)):
            same = bucket[step:] == bucket[:-step]
            if not same.any():
                break
            one, two = node[:-step], node[step:]
            met = same & (one != two) & (component[step:] != component[:-step])
            yield np.minimum(one, two)[met], np.maximum(one, two)[met]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64)) + b.view(np.uint64))


def _repeated(rows: DataFrame, found: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, list[np.ndarray]]]], columns: list[str], total: int) -> DataFrame:
    """Of what tasks find in rows, hashes and `columns` of numbers, that whose hash may be found SHARED times, of a total of so
    many. A sketch of all hashes tells; beyond its bound there are several, each of a share of the hashes, one after another."""
    rounds = max(-(-LEAST_CELLS * total // CELLS[1]), 1)
    share = lambda hashes, r: mix(hashes) % np.uint64(rounds) == np.uint64(r) if rounds > 1 else np.ones(len(hashes), bool)
    parts = []
    for r in range(rounds):
        often = _frequent(rows, lambda batches, r=r: (h[share(h, r)] for h, _ in found(batches)), SHARED, PAIR_CELLS * total // rounds)

        def run(batches: Iterator[pa.RecordBatch], r: int = r, often: Broadcast = often) -> Iterator[pa.RecordBatch]:
            seen = Sketch(*often.value)
            for hashes, values in found(batches):
                may = share(hashes, r)
                may[may] = seen.may_have(hashes[may])
                yield pa.RecordBatch.from_arrays([pa.array(v[may]) for v in values], names=columns)

        part = rows.mapInArrow(run, ", ".join(f"{c} long" for c in columns))
        parts.append(part if rounds == 1 else stored(part, "repeated"))
        if rounds > 1:
            often.destroy()
    return functools.reduce(DataFrame.unionAll, parts)


def _sharing(small: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of images of different components that share SHARED of the buckets of small (bucket, node, n,
    component), of n images at most. A bucket's pairs meet in the task that holds it; of them, it gives those that a sketch
    of all pairs says may meet SHARED times, and these are counted."""
    meetings = int(small.agg(F.sum((F.col("n") - 1) / 2)).first()[0] or 0)
    rows = small.select("bucket", "node", "component").repartition("bucket").sortWithinPartitions("bucket")
    pairs = _repeated(rows, lambda batches: ((_pair_hash(a, b), [a, b]) for a, b in _meetings(batches)), ["a", "b"], meetings)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("a", "b")


def _key_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """From rows (node, component, crowded, others) with an image's keys, a hash for each two of them of which one is crowded,
    with (bucket, node, component), where the bucket is that hash."""

    def joined() -> tuple[np.ndarray, list[np.ndarray]]:
        hashes, sizes = np.concatenate([h for h, _, _ in held]), [len(h) for h, _, _ in held]
        return hashes, [hashes.view(np.int64), *(np.repeat(np.array([x[k] for x in held], np.int64), sizes) for k in (1, 2))]

    held, n = [], 0
    for batch in batches:
        for node, component, crowded, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            one, two = (np.sort(keys.values.to_numpy()).view(np.uint64) for keys in (crowded, others))
            i, j = np.triu_indices(len(one), 1)
            held.append((np.concatenate([mix(mix(one[i]) + one[j]), mix(mix(one)[:, None] + two).ravel()]), node, component))
            n += len(held[-1][0])
            if n > FLUSH:
                yield joined()
                held, n = [], 0
    if n:
        yield joined()


def _finer(split: DataFrame) -> DataFrame:
    """Buckets of split (bucket, node, component, crowded) for two keys instead of one, of which one is crowded: those that several
    images have and that hold several components, with all their images."""
    full = F.col("crowded")
    keys = split.groupBy("node", "component").agg(F.collect_list(F.when(full, F.col("bucket"))).alias("crowded"), F.collect_list(F.when(~full, F.col("bucket"))).alias("others"))
    keys = stored(keys.where(F.size("crowded") > 0), "keys")
    total = keys.agg(F.sum(F.size("crowded") * (F.size("others") + (F.size("crowded") - 1) / 2))).first()[0]
    found = stored(_repeated(keys, _key_pairs, ["bucket", "node", "component"], int(total or 0)), "finer")
    several = found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket", "n")
    return stored(found.join(several, "bucket"), "finer")


def _met(small: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of images of different components in the same bucket."""
    rows = small.select("bucket", "node", "component").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"]) for pair in _meetings(batches)), "a long, b long").distinct()


def _counts(batches: Iterator[pa.RecordBatch], seen: Sketch) -> Iterator[pa.RecordBatch]:
    """For each key of a batch of images how many have it, and the least and largest of them."""
    for batch in _keys(batches, seen):
        node, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        order = np.lexsort((node, bucket))
        node, bucket = node[order], bucket[order]
        head = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)) if len(bucket) else order
        size = np.diff(np.append(head, len(bucket)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket[head], size, node[head], node[head + size - 1])], names=["bucket", "n", "lo", "hi"])


def _obey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, salt, b, body), each a's own body first (b null), the pairs that are linked."""
    lead, mine = None, None
    for batch in batches:
        found = []
        for a, salt, b, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            [one] = prepared([body])
            if b is None:
                lead, mine = (a, salt), one
            elif lead == (a, salt) and linked(mine, one):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _obeyed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. The bodies of images without a pair stay where they are, as long as the pairs can be
    broadcast; a hot a is dealt out in parts of about PART pairs, each with a copy of its body."""
    tried = stored(pairs, "pairs")
    total = tried.count()
    parts = tried.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART).alias("parts"))
    salted = join_spread(tried, parts, ["a"], "n", total).select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"))
    leads = salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    ends = salted.select("a", "salt", "b", F.col("b").alias("node")).unionAll(leads)
    met = bodies.join(F.broadcast(ends) if total <= MARKS // 4 else ends, "node").select("a", "salt", "b", "body")
    rows = met.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return stored(rows.mapInArrow(_obey, "a long, b long"), "links")


def image_copies(images: DataFrame, id_col: str = "image_id", media_col: str = "media") -> DataFrame:
    """One row for each row of images: image_id, n_corners, class_id, kept.

    class_id is the smallest id of the images that copies link, exact ones included; kept marks that image. A null or
    unreadable image is linked with its exact copies only, a null with nothing. Rows that share an id and their media
    are exact copies; a null id is linked with nothing, has no class and is kept. An empty table gives no rows. Other
    columns are ignored. Images of any size are binary PGM; two are linked if they share SHARED keys and INLIERS of their
    corners obey one similarity transform. Ids are numbers.
    """
    rows = images.select(F.col(id_col).cast("long").alias("image_id"), F.col(media_col).alias("media"))
    digest = F.when(F.col("media").isNotNull() & F.col("image_id").isNotNull(), F.unhex(F.sha2("media", 256)))
    described = rows.select("image_id", "media", digest.alias("digest")).mapInArrow(_describe, "image_id long, digest binary, n_corners long, body binary")
    with session_conf(images.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH):
        described = stored(described.withColumn("row", F.monotonically_increasing_id()), "corners")
    # of exact copies all but one are left out; the list is small where copies are few, and then spares the others a shuffle
    known = described.where("digest IS NOT NULL").select("image_id", "digest", "row")
    groups = known.groupBy("digest").agg(F.min(F.struct("image_id", "row")).alias("best"))
    copies = stored(known.join(groups, "digest").where(F.col("row") != F.col("best.row")).select("row"), "copies")
    bodies = described.where((F.col("n_corners") >= INLIERS) & F.col("digest").isNotNull()).join(copies, "row", "left_anti").select(F.col("image_id").alias("node"), "body")
    seen = _seen_twice(bodies, described.agg(F.sum("n_corners")).first()[0] or 0)
    keyed = bodies.mapInArrow(lambda batches: _keys(batches, Sketch(*seen.value)), "node long, bucket long")
    # keys are counted by batches and dealt as they are: those of one image that the sketch lets pass, tasks would only spill
    counted = bodies.mapInArrow(lambda batches: _counts(batches, Sketch(*seen.value)), "bucket long, n long, lo long, hi long").repartition("bucket")
    crowded = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("bucket", "n")
    crowded = stored(crowded, "crowded")  # few of all keys: so the others need not move to be left out
    marks = F.broadcast(crowded) if crowded.count() <= MARKS else crowded
    buckets = stored(keyed.join(marks, "bucket").select("bucket", "node", "n"), "buckets")
    rank = buckets.groupBy("node").agg(F.sum("n").alias("rank"))
    ranked = buckets.join(rank, "node")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("node")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("a"))
    stars = ranked.join(leaders, "bucket").where("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    best = stars.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("minus"))).alias("top")).select((-F.col("top.minus")).alias("a"), "b")
    links = _obeyed(best, bodies)
    labels = stored(components(links), "labels")
    placed = buckets.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    split = stored(placed.join(split, "bucket"), "split")
    joined = lambda links: stored(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links)), "labels")
    held = split.agg(F.count("*"), F.count_distinct("node")).first()
    most = max(SMALL, MEET * held[0] // max(held[1], 1))
    small, large = split.where(F.col("n") <= most), split.where(F.col("n") > most)
    pairs, by_blocks = _sharing(small), None
    if not large.isEmpty():
        main = large.groupBy("bucket", "n", "component").count().groupBy("bucket", "n").agg(F.max("count").alias("main"))
        main = stored(main.select("bucket", (F.col("n") - F.col("main") <= FEW).alias("few")), "crowds")
        sized = large.join(main, "bucket")
        marked = small.withColumn("crowded", F.lit(False)).unionByName(sized.select(*small.columns, (~F.col("few")).alias("crowded")))
        finer = _finer(marked.select("bucket", "node", "component", "crowded"))
        pairs = pairs.unionAll(_met(finer.where(F.col("n") <= SMALL))).distinct()
        by_blocks = sized.where("few").select("bucket", "node").unionAll(finer.where(F.col("n") > SMALL).select("bucket", "node"))
    labels = joined(_obeyed(pairs, bodies))
    if by_blocks is not None and not (by_blocks := stored(by_blocks, "blocks")).isEmpty():
        low = F.col("bucket").bitwiseAND(2**32 - 1)
        low = F.when(low < 2**31, low).otherwise(low - 2**32).cast("int")
        # at most an image's keys, not a set, so that two keys alike in these bits count as two; with fewer than SHARED there is no pair
        keys = split.join(by_blocks.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list(low).alias("keys")).where(F.size("keys") >= SHARED)
        sketches = keys.join(by_blocks.groupBy("node").agg(F.collect_list("bucket").alias("sketch")), "node")
        sized = by_blocks.select("bucket", "node", F.lit(4096).cast("long").alias("bytes"))
        more = stored(crossing_links(sized, labels, sketches, bodies, near, prepared, linked), "crossing")
        labels = joined(more)
    named = groups.select("digest", F.col("best.image_id").alias("node")).join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    out = described.select("image_id", "n_corners", "digest").join(named, "digest", "left")
    found = F.coalesce("class", "image_id")
    return out.select("image_id", "n_corners", found.alias("class_id"), F.coalesce(F.col("image_id") == found, F.lit(True)).alias("kept"))


# ---- images for tables that have none


SIZE = 96
_WAVES = np.random.default_rng(96)
_FREQUENCIES, _PHASES = _WAVES.normal(0, 6, (2, 64)), _WAVES.uniform(0, 2 * np.pi, 64)
_YS, _XS = np.mgrid[0:SIZE, 0:SIZE] / SIZE
_BASIS = np.cos(2 * np.pi * (_FREQUENCIES[0, :, None, None] * _XS + _FREQUENCIES[1, :, None, None] * _YS) + _PHASES[:, None, None]).reshape(64, -1)


def picture(vector: np.ndarray) -> np.ndarray:
    """An image of SIZE x SIZE pixels drawn from a vector: each value is the height of one of 64 fixed waves."""
    v = np.resize(np.nan_to_num(np.asarray(vector, np.float64)), 64) if len(vector) else np.zeros(64)
    v = v / max(float(np.linalg.norm(v)), 1e-9)
    return np.clip(128 + 90 * (v @ _BASIS), 0, 255).reshape(SIZE, SIZE)


def edited(image: np.ndarray) -> np.ndarray:
    """A copy of which a quarter of each side is cut off and whose contrast and brightness are changed."""
    quarter = SIZE // 8
    return np.clip(image[quarter:-quarter, quarter:-quarter] * 0.85 + 20, 0, 255)


def drawn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20) -> DataFrame:
    """Images (image_id, media) for a table of vectors: 2 * id is the picture of a row; of each row whose id is divisible
    by `every` there is an edited copy too, 2 * id + 1. A null vector has no media, a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, media = [], []
                for i, v in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    image = None if v is None else picture(np.array([np.nan if x is None else x for x in v]))
                    ids.append(None if i is None else 2 * i)
                    media.append(None if image is None else encode_pgm(image))
                    if i is not None and i % every == 0 and image is not None:
                        ids.append(2 * i + 1)
                        media.append(encode_pgm(edited(image)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["image_id", "media"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, "image_id long, media binary")
