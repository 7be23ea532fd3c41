"""Exact deduplication by merging sorted runs of digests in a binomial tree.

Every input partition is a run: one row for each distinct text, sorted by digest. In each round the runs whose numbers agree
but for the lowest bits merge: each run is cut at the same digests into as many slices as runs have merged so far, the
equal slices of 2 ** bits runs meet in one task, are sorted together, and of equal digests the best row is kept. After
the last round one run is left, in slices over the cluster. However many copies a text has, a task of a round meets one
row of it from each run. A digest is SHA-256 of the normalised text, verified at each level by a second hash (64-bit)
and the length; rows count as equal only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_spread
from .common import spare, stored

BLANKS = " \t\n\x0b\f\r"
KEY = ["sha", "check", "size"]


def normalised(text: Column) -> Column:
    """text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def merge_runs(runs: DataFrame, count: int, bits: int) -> DataFrame:
    """The rounds of the tree: `count` runs (run, sha, check, size, best, members) to one row a text."""
    start = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    merged = 0
    while count > 1:
        merged, count = merged + bits, -(-count // 2**bits)
        piece = [F.shiftright("run", bits).alias("run"), F.shiftright(start, max(32 - merged, 0)).alias("slice")]
        met = runs.select(*piece, *KEY, "best", "members").repartition("run", "slice")
        runs = met.groupBy("run", "slice", *KEY).agg(F.min("best").alias("best"), F.sum("members").alias("members")).drop("slice")
    return runs.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, tie: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, best_chars, best_tie, row_id.

    Of rows whose text is equal but for blanks, the one with the most characters in its original text stays, then the
    smallest id (null ids last), then the least `tie` (a long, 0 by default), then the first row; so exactly one row of each
    group stays, repeated rows included. Null texts count as empty, and all empty texts are one group. A text of any
    length is one digest. Other columns are ignored. An empty table gives no rows. The tree merges 2 ** bits runs at a time.
    """
    text = normalised(F.col(text_col))
    digests = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
        (F.lit(0) if tie is None else tie).cast("long").alias("tie"),
        text.alias("bare"),
    ).select("doc_id", "row_id", "chars", "tie", F.unhex(F.sha2("bare", 256)).alias("sha"), F.xxhash64("bare").alias("check"), F.length("bare").alias("size"))
    digests = stored(digests, "digests")
    run = F.shiftright("row_id", 33).cast("int")  # the partition that read the row
    count, total = digests.agg(F.coalesce(F.max(run) + 1, F.lit(0)), F.count("*")).first()
    best = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "tie", F.col("row_id").alias("row"))
    runs = digests.groupBy(run.alias("run"), *KEY).agg(F.min(best).alias("best"), F.count("*").alias("members"))
    several = stored(merge_runs(runs, count, bits).where("members > 1").withColumn("n", F.col("members")), "copies")
    found = join_spread(digests, several, KEY, "n", total, "left")
    alone = F.col("best").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.coalesce(-F.col("best.shorter"), "chars").alias("best_chars"),
        F.coalesce("best.tie", "tie").alias("best_tie"),
        "row_id",
    )


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each group of exact_groups.

    Rows that share their id and length are told apart by a hash of all their columns, so a repeated task keeps the same
    row. The surviving rows are found again by all of these, and of rows equal in all of them one is left, in the
    partitions of the join.
    """
    keys = spare(docs.columns, "kept_id", "kept_sha", "kept_chars", "kept_tie")
    groups = exact_groups(docs, id_col, text_col, tie=row_hash(docs)).where("kept")
    found = F.xxhash64("doc_id"), F.unhex("text_sha256"), F.col("best_chars"), F.col("best_tie")
    kept = groups.select(*(c.alias(k) for c, k in zip(found, keys, strict=True)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.xxhash64(id_col), F.unhex(F.sha2(normalised(F.col(text_col)), 256)), F.length(text), row_hash(docs)
    whole = docs.withColumns(dict(zip(keys, own, strict=True)))
    return whole.join(kept, keys, "left_semi").dropDuplicates(keys).select(docs.columns)
