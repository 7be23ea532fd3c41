import re
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from meterwise.llm.exact_dedup import exact_dedup, exact_groups, merge_runs

ROWS = [(5, "a b"), (3, "a  b"), (4, "a\tb "), (2, "ab"), (1, None), (6, ""), (7, " \n"), (8, "x" * 200_000), (9, "é b"), (9, "é b"), (10, "é b"), (None, "q q"), (None, "q q"), (11, "qq")]


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_equals_brute_force(spark):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[bare(t)].append((-len(t or ""), i is None, i))
    want = sorted((str((i, min(groups[bare(t)])[2], len(groups[bare(t)]), sha256(bare(t).encode()).hexdigest())) for i, t in ROWS))
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in ROWS], "doc_id long, text string, kept_id int, sha string").repartition(4)
    got = exact_groups(docs).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(bare(r.text) for r in kept.collect()) == sorted(groups)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_any_tree_gives_the_same(spark, parts):
    docs = spark.createDataFrame(ROWS * 3, "doc_id long, text string").repartition(parts)
    found = [sorted(map(str, exact_groups(docs, bits=k).drop("row_id").collect())) for k in (1, 2, 5)]
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == 3 * len(ROWS)


def test_runs_merge_in_rounds(spark):
    docs = spark.createDataFrame([(i, f"t{i % 50}") for i in range(400)], "doc_id long, text string").repartition(16)
    digests = docs.select(F.spark_partition_id().alias("run"), "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("check"), F.length("text").alias("size"))
    runs = digests.groupBy("run", "sha", "check", "size").agg(F.min(F.struct("doc_id")).alias("best"), F.count("*").alias("members"))
    merged = merge_runs(runs, 16, 1)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 4 and "Python" not in plan  # sixteen runs, pairs of them: four rounds
    assert sorted((r.best.doc_id, r.members) for r in merged.collect()) == [(i, 8) for i in range(50)]


def test_hot_text_is_not_dealt_to_one_task(spark, monkeypatch):
    from meterwise.operators import joins

    monkeypatch.setattr(joins, "LEAST", 20)
    rows = [(i, "hot  text" if i % 3 == 0 else f"t{i // 2}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(docs).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in rows}


def test_rows_that_differ_in_other_columns_are_told_apart(spark):
    rows = [(1, "a b", n, {"k": n}) for n in range(6)] + [(1, " ab", 9, {})]
    kept = [exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, other int, more map<string,int>").repartition(n)).collect() for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
