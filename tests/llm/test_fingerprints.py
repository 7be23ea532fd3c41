"""Fingerprints against a version written byte by byte, and rows against their next ones."""

import hashlib
import random
import zlib

from meterwise.llm.fingerprints import BLOCK, edited_copies, fingerprint, fingerprints, likeness, likeness_of

LETTERS = [*map(chr, range(65, 91)), *map(chr, range(97, 123)), *"0123456789+/"]
WORD = (1 << 64) - 1


def _mixed(window: bytes) -> int:
    h = int.from_bytes(window, "little")
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor & WORD
    return h ^ h >> 31


def _letters(data: bytes, size: int) -> tuple[str, int]:
    out, piece, ends = [], b"", 0
    for i, b in enumerate(data):
        piece += bytes([b])
        if _mixed((bytes(7) + data)[i : i + 8]) % size == size - 1:
            ends += 1
            if len(out) < 127:
                out.append(piece)
                piece = b""
    return "".join(LETTERS[zlib.crc32(x) % 64] for x in [*out, *([piece] if piece else [])]), ends


def _print(data: bytes) -> str:
    size = 2
    while 64 * size < len(data):
        size *= 2
    while size > 2 and _letters(data, size)[1] < 16:
        size //= 2
    return f"{size}:{_letters(data, size)[0]}:{_letters(data, 2 * size)[0]}"


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def _short(x: str) -> str:
    return "".join(c for i, c in enumerate(x) if x[max(i - 3, 0) : i] != c * 3)


def _like(a: str, b: str) -> float:
    if a == b:
        return 1.0
    best, (s, *x), (t, *y) = 0.0, a.split(":"), b.split(":")
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            p1, q1 = _short(p), _short(q)
            if int(s) << i == int(t) << j and any(p1[k : k + 4] in q1 for k in range(len(p1) - 3)):
                best = max(best, 1 - _distance(p1, q1) / (len(p1) + len(q1)))
    return best


def _texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij ü", k=rng.randint(1, 9))) for _ in range(300)]
    return ["", "a", "ab cd", "x" * 5000, "one line\n" * 400] + [" ".join(rng.choices(words, k=rng.choice((1, 3, 20, 100, 600)))) for _ in range(n)]


def test_fingerprints_equal_those_made_byte_by_byte():
    for text in _texts(60):
        assert fingerprint(text.encode()) == _print(text.encode())


def test_blocks_of_long_texts_meet(monkeypatch):
    text = " ".join(_texts(300, 7)).encode()
    whole = fingerprint(text)
    for block in (9, 1000, 4096):
        monkeypatch.setattr("meterwise.llm.fingerprints.BLOCK", block)
        assert fingerprint(text) == whole
    assert len(text) < BLOCK


def test_likeness_is_an_edit_distance():
    texts = _texts(60, 3)
    prints = [fingerprint(t.encode()) for t in texts] + [fingerprint((t[: len(t) // 2] + u).encode()) for t, u in zip(texts, texts[1:], strict=False)]
    rng = random.Random(5)
    for a, b in [*zip(prints, prints[65:], strict=False), *((rng.choice(prints), rng.choice(prints)) for _ in range(300))]:
        assert abs(likeness(a, b) - _like(a, b)) < 1e-12
        assert likeness(a, b) == likeness(b, a)


def _expected(rows):
    """Rows by descending id; those of one id have equal texts here, or the test compares only their number."""
    rows = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, next_ = (_print(x.encode()) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other, round(_like(own, other), 9), round(_like(own, next_), 9)))
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def test_edited_copies_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(_texts(80, 11))]
    rows += [(200, None), (201, ""), (202, "same " * 50), (203, "same " * 50), (None, "no id"), (204, "日本語 text " * 30)]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, part int").repartition(7)
    assert _rows(edited_copies(docs)) == _expected(rows)


def test_repeated_rows_and_one_and_none(spark):
    rows = [(5, "many copies of one row " * 9)] * 300 + [(i, f"text {i} " * 20) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _rows(edited_copies(docs)) == _expected(rows)
    one = spark.createDataFrame([(1, "alone in the table " * 3)], "doc_id long, text string")
    assert _rows(edited_copies(one)) == _expected([(1, "alone in the table " * 3)])
    assert edited_copies(one.limit(0)).count() == 0


def test_fingerprint_columns(spark):
    docs = spark.createDataFrame([(1, "a text of some words " * 20), (2, "a text of some words " * 20), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert found[1].fingerprint == found[2].fingerprint and found[3].n_chars == 0
    pair = spark.createDataFrame([(found[1].fingerprint, found[2].fingerprint), (found[1].fingerprint, None)], "a string, b string")
    assert [r[0] for r in pair.select(likeness_of("a", "b")).collect()] == [1.0, None]
    assert fingerprints(docs.limit(0)).count() == 0
