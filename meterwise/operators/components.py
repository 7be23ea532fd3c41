"""Connected components of a graph, by rounds of joins and minima."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import join_spread

#: Edges of a node, two numbers each, that one task may take.
EDGES = 50_000
#: Has Spark delete the shuffle files of a query when it has run, and not when the driver comes to clean up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted when it has run; so no DataFrame may run there and again later."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder of spark.checkpoint.dir; a local session may go without one."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="meterwise-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def connected(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that each reaches.

    Large stars link every neighbour above a node to its least neighbour, small stars those below it; each round halves
    the longest paths or better. A neighbourhood is only ever a minimum and a count, and the neighbours of a hub get the
    minimum where they are, so hot nodes need no memory and no task of their own. cut ends the lineage of each round.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, total = None, edges.count()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = join_spread(both, least, ["u"], "n", 2 * total, least=EDGES).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        edges = cut(join_spread(large, low, ["u"], "n", 2 * total, least=EDGES).select(pairs.alias("e")).select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            return found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())
        before, total = now, now[0]
