"""The prefix trie against one built of Python dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from meterwise.llm import prefix_trie as trie_module
from meterwise.llm.prefix_trie import Louds, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string"


def _brute(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in said.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * words
            leaves[node[:d]] += not children[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(6)
    return sorted((tuple(r) for r in conversation_trie(frame, **how).collect()), key=str)


def _conversations(seed=1, n=150):
    """Some begin alike, some are equal, some are long, some have one turn or gaps; a few ids lack the one they begin with."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        for turn in range(rng.choice((1, 1, 2, 4, 7, 30 if c % 29 == 0 else 3))):
            text = "Hello you" if turn == 0 and c % 3 == 0 else "same in all " if c % 3 == 0 and turn < 3 else rng.choice(("yes", "no", f"text {c} \x0b of {turn}", None, ""))
            rows.append((c, turn * 2, rng.choice(("user", None)) if turn > 2 else "user", text))
    rows += [(1000, None, "system", "first"), (1000, 5, "user", "last"), (1000, 1, "user", "middle"), (None, 1, "user", "of no conversation"), (1003, 0, "user", "long " * 20000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 4, 25, 100_000])
def test_trie_equals_dictionaries(spark, limit):
    """With low limits most nodes belong to the upper levels, with the last one none but the root."""
    rows = _conversations()
    assert _run(spark, rows, limit=limit) == _brute(rows)


def test_equal_conversations_and_shards_of_several_batches(spark, monkeypatch):
    monkeypatch.setattr(trie_module, "NODES", 10)
    monkeypatch.setattr(trie_module, "IDS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        rows = [(c, t, "user", f"turn {t}") for c in range(-200, 200, 2) for t in range(4)] + [(c, t, "user", f"own {c} {t}") for c in range(1001, 1100, 3) for t in range(5)]
        for limit in (50, 100_000):
            got = [r for r in _run(spark, rows, limit=limit)]
            # ids below zero take the SQL remainder, which has the sign of the id
            assert len(got) == len({(r[0], r[1]) for r in got}) and sum(r[3] for r in got if r[1] == 0) == 233
        rows = [r for r in rows if r[0] >= 0]
        assert _run(spark, rows, limit=50) == _brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_one_deep_conversation_turnless_ones_and_none(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(600)] + [(1, 0, "user", "a"), (41, 0, "user", "b")]
    for limit in (200, 100_000):
        assert _run(spark, rows, limit=limit) == _brute(rows)
    turnless = [(c, 0, "user", "gone") for c in (21, 23, 42, 44) if zlib.crc32(str(c).encode()) % 4]
    assert turnless and _run(spark, turnless) == _brute(turnless)
    assert _run(spark, []) == []


def test_louds_of_a_known_forest():
    """Two trees: a with b and c, b with d; e alone."""
    parents, depth = np.array([-1, 0, 0, 1, -1]), np.array([0, 1, 1, 2, 0])
    trie, order = Louds.of(parents, depth, np.arange(5))
    assert order.tolist() == [0, 4, 1, 2, 3]
    assert "".join("01"[int(b)] for b in trie.bits) == "11011001000"
    assert trie.parents.tolist() == [-1, -1, 0, 0, 2] and trie.degrees.tolist() == [2, 0, 1, 0, 0]
    assert trie.rolled_up(np.array([1, 10, 100, 1000, 10000])).tolist() == [11101, 10, 10100, 1000, 10000]
