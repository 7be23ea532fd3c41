import hashlib

import numpy as np
import pytest

from meterwise.llm import image_copies as M


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(7)
    return [np.floor(M.picture(rng.normal(size=64))) for _ in range(40)]


def test_pgm_round_trip():
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (M.decode_pgm(M.encode_pgm(image)) == image).all()
    for bad in (None, b"", b"P5", b"P5\n4 3\n255\n123", b"P6\n1 1\n255\nabc", b"P5\nx y\n255\n"):
        assert M.decode_pgm(bad) is None


def variants(image, rng):
    yield M.edited(image)
    yield np.rot90(image)
    yield image + rng.normal(0, 2, image.shape)
    yield image[8:80, 14:90]


def test_copies_agree_and_others_do_not(pictures):
    rng = np.random.default_rng(8)
    bodies = [M.describe(p) for p in pictures]
    parsed = M.prepared([M.body_of(*b) for b in bodies])
    found = total = 0
    for n, p in enumerate(pictures):
        for v in variants(p, rng):
            d = M.describe(np.clip(np.floor(v), 0, 255))
            total += 1
            found += M.linked(parsed[n], M.prepared([M.body_of(*d)])[0])
    assert found >= 0.97 * total
    assert not any(M.linked(a, b) for n, a in enumerate(parsed) for b in parsed[:n])


def brute(rows):
    """Classes by comparing all pairs of images."""
    bodies = {i: M.describe(M.decode_pgm(m)) for i, m in rows if i is not None and M.decode_pgm(m) is not None}
    up = {i: i for i, m in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids, digests = sorted(up), {}
    for i, m in rows:
        if i is not None and m is not None:
            digests.setdefault(i, set()).add(hashlib.sha256(m).hexdigest())
    for a in ids:
        for b in ids:
            if a < b:
                same = bool(digests.get(a, set()) & digests.get(b, set()))
                if not same and a in bodies and b in bodies:
                    same = min(len(bodies[a][0]), len(bodies[b][0])) >= M.INLIERS and M.linked(*M.prepared([M.body_of(*bodies[a]), M.body_of(*bodies[b])]))
                if same:
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("small", [16, 2])
def test_classes_equal_brute_force(spark, pictures, small, monkeypatch):
    monkeypatch.setattr(M, "SMALL", small)
    rng = np.random.default_rng(9)
    rows = [(10 * n, M.encode_pgm(p)) for n, p in enumerate(pictures[:14])]
    rows += [(10 * n + k + 1, M.encode_pgm(v)) for n, p in enumerate(pictures[:6]) for k, v in enumerate(variants(p, rng))]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, b"junk"), (504, b"junk"), (505, M.encode_pgm(np.zeros((5, 5)))), (506, M.encode_pgm(np.zeros((96, 96)))), (507, None)]
    want = brute(rows)
    docs = spark.createDataFrame([(i, bytearray(m) if m is not None else None, "x") for i, m in [*rows, (None, rows[0][1]), (500, rows[3][1])]], "image_id long, media binary, node string").repartition(4)
    out = M.image_copies(docs).collect()
    assert len(out) == len(rows) + 2
    assert {r.image_id: r.class_id for r in out if r.image_id is not None} == want
    assert [(r.class_id, r.kept) for r in out if r.image_id is None] == [(None, True)]
    assert want[500] == want[501] == 30 and want[1] == 0


def test_pairs_that_meet_once_are_not_made(spark, monkeypatch):
    """Pairs of a bucket meet in the task that holds it; only those that may share SHARED buckets leave it."""
    rng = np.random.default_rng(11)
    buckets = [rng.choice(2000, size=rng.integers(1, M.SMALL + 1), replace=False) for _ in range(600)]
    buckets += [np.array([k, k + 1, 1999 - k]) for k in range(0, 40, 4) for _ in range(2)]
    rows = [(k - 300, int(x), len(nodes), int(x) // 2 * 2 if x % 8 < 2 else int(x)) for k, nodes in enumerate(buckets) for x in nodes]
    met = {}
    for nodes in buckets:
        for a in nodes.tolist():
            for b in nodes.tolist():
                if a < b and not (a % 8 == 0 and b == a + 1):
                    met[a, b] = met.get((a, b), 0) + 1
    want = {pair for pair, n in met.items() if n >= M.SHARED}
    small = spark.createDataFrame(rows, "bucket long, node long, n long, component long").repartition(5)
    made, kind = [], type(small)
    mapped = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *args: made.append(mapped(self, *args)) or made[-1])
    monkeypatch.setattr(M, "FLUSH", 500)
    pairs = M._sharing(small)
    monkeypatch.undo()
    assert len(want) >= 20 and {tuple(r) for r in pairs.collect()} == want
    assert made[-1].columns == ["a", "b"] and made[-1].count() <= len(met) / 10


def test_small_buckets_are_not_joined(spark, pictures, monkeypatch):
    plans, obeyed = [], M._obeyed
    monkeypatch.setattr(M, "_obeyed", lambda pairs, bodies: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or obeyed(pairs, bodies))
    rows = [(n, M.encode_pgm(p)) for n, p in enumerate(pictures[:8])] + [(10, M.encode_pgm(pictures[0][8:80, 14:90]))]
    found = {r.image_id: r.class_id for r in M.image_copies(spark.createDataFrame(rows, "image_id long, media binary")).collect()}
    assert found == brute(rows)
    assert len(plans) == 2 and "Join" not in plans[1]


def test_empty(spark):
    assert M.image_copies(spark.createDataFrame([], "image_id long, media binary")).count() == 0
    assert M.drawn(spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")).count() == 2


def warped(image, factor, angle, size):
    """The image turned about its centre and scaled, between pixels, in a frame of the given size; black outside."""
    (height, width), (rows, columns) = image.shape, size
    ys, xs = np.mgrid[0:rows, 0:columns]
    z = ((xs + 0.5 - columns / 2) + 1j * (ys + 0.5 - rows / 2)) * np.exp(1j * np.deg2rad(angle)) / factor
    x, y = z.real + width / 2 - 0.5, z.imag + height / 2 - 0.5
    x0, y0 = np.clip(np.floor(x).astype(int), 0, width - 2), np.clip(np.floor(y).astype(int), 0, height - 2)
    fx, fy = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    value = (image[y0, x0] * (1 - fx) + image[y0, x0 + 1] * fx) * (1 - fy) + (image[y0 + 1, x0] * (1 - fx) + image[y0 + 1, x0 + 1] * fx) * fy
    return np.where((x >= -0.5) & (x <= width - 0.5) & (y >= -0.5) & (y <= height - 0.5), value, 0)


def scaled(factor):
    return lambda p: warped(p, factor, 0, tuple(round(n * factor) for n in p.shape))


EDITS = {
    **{f"turned by {a}": lambda p, a=a: warped(p, 1, a, p.shape) for a in (5, 10, 20, 30, 45)},
    **{f"scaled by {f}": scaled(f) for f in (1.2, 1.4, 2.0, 4.0)},
    **{f"reduced by {f}": scaled(1 / f) for f in (1.2, 1.4, 2.0)},
    "cropped to half its area": lambda p: p[14:82, 14:82],
    "cropped at a side": lambda p: p[:, 20:],
    "brighter": lambda p: p * 0.7 + 60,
}


@pytest.mark.parametrize("marks", [2_000_000, 0])
def test_recall_by_edit(spark, pictures, monkeypatch, marks):
    monkeypatch.setattr(M, "MARKS", marks)
    pictures = pictures if marks else pictures[:6]
    rows = [(1000 * n, M.encode_pgm(p)) for n, p in enumerate(pictures)]
    rows += [(1000 * n + k, M.encode_pgm(np.rint(edit(p)))) for n, p in enumerate(pictures) for k, edit in enumerate(EDITS.values(), 1)]
    images = spark.createDataFrame(rows, "image_id long, media binary").repartition(8)
    found = {r.image_id: r.class_id for r in M.image_copies(images).collect()}
    recall = {name: sum(found[1000 * n + k] == found[1000 * n] for n in range(len(pictures))) / len(pictures) for k, name in enumerate(EDITS, 1)}
    assert min(recall.values()) >= 0.9, recall
    assert all(found[i] // 1000 == i // 1000 for i in found)  # unlike pictures are not linked


def test_large_and_long_images_are_brought_to_one_size():
    rng = np.random.default_rng(3)
    picture = M.picture(rng.normal(size=64))
    large = np.kron(picture, np.ones((20, 20)))
    one, two = (M.prepared([M.body_of(*M.describe(x))])[0] for x in (picture, large))
    assert M.linked(one, two)
    assert len(M.describe(np.tile(picture, (1, 8)))[0]) and not len(M.describe(picture[:2])[0]) and not len(M.describe(picture[:1, :1])[0])


@pytest.mark.parametrize(("small", "few"), [(2, 0), (16, 0), (2, 16)])
def test_crowded_buckets_lose_no_link(spark, pictures, monkeypatch, small, few):
    """Images of crowded buckets meet by pairs of keys; what many share, and what is nearly all of one component, by blocks."""
    for name, value in (("MEET", 0), ("SMALL", small), ("FEW", few), ("FLUSH", 300)):
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(10)
    patch, alike = M.picture(rng.normal(size=64))[:27, :27], [p.copy() for p in pictures[:18]]
    for p in alike:
        p[30:57, 30:57] = patch
    rows = [(10 * n, M.encode_pgm(p)) for n, p in enumerate(alike)] + [(10 * n + k + 1, M.encode_pgm(v)) for n, p in enumerate(alike[:3]) for k, v in enumerate(variants(p, rng))]
    used, crossing = [], M.crossing_links
    monkeypatch.setattr(M, "crossing_links", lambda buckets, *rest: used.append(buckets.count()) or crossing(buckets, *rest))
    docs = spark.createDataFrame([(i, bytearray(m)) for i, m in rows], "image_id long, media binary").repartition(4)
    assert {r.image_id: r.class_id for r in M.image_copies(docs).collect()} == brute(rows)
    assert bool(used) or small == 16


def test_crowded_buckets_are_not_compared_all_with_all(spark, monkeypatch):
    """400 images with one common key: only those that share a second one leave the tasks, also where a sketch is not enough for all."""
    monkeypatch.setattr(M, "FLUSH", 500)
    rng = np.random.default_rng(12)
    rows = [(1, node, 400, node) for node in range(400)]
    rows += [(1000 + key, node, 2, node) for node in range(400) for key in rng.choice(40_000, 20, replace=False).tolist()]
    held = {}
    for bucket, node, _, _ in rows:
        held.setdefault(bucket, set()).add(node)
    want = {(a, b) for bucket, nodes in held.items() if bucket != 1 for a in nodes for b in nodes if a < b}
    split = spark.createDataFrame([(b, node, c, b == 1) for b, node, _, c in rows], "bucket long, node long, component long, crowded boolean").repartition(5)
    for rounds in (1, 3):
        monkeypatch.setattr(M, "CELLS", (1 << 16, 1 << 28 if rounds == 1 else M.LEAST_CELLS * 8000 // 3 + 1))
        finer = M._finer(split)
        assert len(want) > 100 and {tuple(r) for r in M._met(finer).collect()} == want and finer.count() <= 4 * len(want)
