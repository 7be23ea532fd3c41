"""Managed nodes: host metrics that share a name, address, serial number or machine id are one node."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import whole_days
from .components import checkpointed, connected
from .joins import join_spread

#: The identifiers, and the texts that stand for a missing one.
IDENTIFIERS = {"hostname": (), "host_variable": ("",), "product_serial": ("", "NA"), "machine_id": ("", "NA")}


def identified(metrics: DataFrame) -> DataFrame:
    """metrics with null for missing identifiers."""
    return metrics.withColumns({c: F.when(~F.col(c).isin(*missing), F.col(c)) for c, missing in IDENTIFIERS.items() if missing})


def numbered(metrics: DataFrame, idx: str = "idx") -> DataFrame:
    """metrics with a number for each row, which stays: the rows are stored with it."""
    return checkpointed(metrics.withColumn(idx, F.monotonically_increasing_id()))


def node_groups(metrics: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, group_id) for each row: the smallest idx that a chain of shared identifiers reaches.

    Each value of an identifier links its rows to the smallest idx that has it, so edges grow with the rows and no value,
    however common, makes pairs or a task of its own. metrics is read several times.
    """
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(IDENTIFIERS))))
    rows = metrics.select(idx, values.alias("i")).select(F.col(idx).alias("b"), "i.kind", "i.value").where("value IS NOT NULL")
    least = rows.groupBy("kind", "value").agg(F.min("b").alias("a"), F.max("b").alias("top"), F.count("*").alias("n")).where("a < top").drop("top")
    labels = connected(join_spread(rows, least, ["kind", "value"], "n", len(IDENTIFIERS) * metrics.count()).select("a", "b").where("a <> b").distinct())
    return metrics.select(idx).join(labels.withColumnRenamed("node", idx), idx, "left").select(idx, F.coalesce("component", idx).alias("group_id"))


def _until_still(start: DataFrame, iterations: int, step: Callable[[DataFrame, str], DataFrame], size: Callable[[DataFrame], object]) -> DataFrame:
    """start after a step for each identifier in order, `iterations` times, or until no identifier changes its size any more. Steps
    read their table more than once, so each is stored."""
    table = checkpointed(start)
    now, still = size(table), 0
    for name in list(IDENTIFIERS) * iterations:
        table = checkpointed(step(table, name))
        before, now = now, size(table)
        still = still + 1 if now == before else 0
        if still == len(IDENTIFIERS):
            break
    return table


def _first_seeds(rows: DataFrame, idx: str, iterations: int) -> DataFrame:
    """(idx, first): for each row the smallest open row in whose bounded lookup it is; null if there is none. Labels go from
    value to value as lookups do, so a value, however common, is a minimum."""

    def step(labels: DataFrame, name: str) -> DataFrame:
        least = labels.where(F.col(name).isNotNull() & F.col("first").isNotNull()).groupBy(name).agg(F.min("first").alias("least"))
        return labels.join(least, name, "left").withColumn("first", F.least("first", "least")).drop("least")

    labels = rows.select(idx, *IDENTIFIERS, F.when(F.col("open"), F.col(idx)).alias("first"))
    sizes = lambda df: df.agg(F.sum(F.col("first").cast("decimal(38,0)")), F.count("first")).first()
    return _until_still(labels, iterations, step, sizes).select(idx, "first")


def _lookups(rows: DataFrame, seeds: DataFrame, idx: str, iterations: int) -> DataFrame:
    """(group_id, idx): the rows that the bounded lookup of each seed finds, itself among them. What a seed has found meets
    the rows by its distinct values, never row by row."""

    def step(found: DataFrame, name: str) -> DataFrame:
        of_rows = rows.where(F.col(name).isNotNull()).select(idx, name)
        values = found.join(of_rows, idx).select("group_id", name).distinct()
        return found.unionByName(values.join(of_rows, name).select("group_id", idx)).distinct()

    return _until_still(seeds.select(F.col(idx).alias("group_id"), idx), iterations, step, DataFrame.count)


def bounded_groups(metrics: DataFrame, iterations: int, idx: str = "idx") -> DataFrame:
    """(idx, group_id) as a sequence of bounded lookups gives them: the rows in order of idx, each that no lookup before has found
    begins one, of its name's rows and then `iterations` times of all rows that share a name, an address, a serial number and a
    machine id, in this order, with those found. Groups may overlap, and a chain of more links than that is cut.

    Lookups stay within components, so the first row of each begins one, and that finds all of most components. In the others
    the rows that begin lookups are found in rounds: an open row that no smaller open one would find begins one for certain, so
    each round decides many. metrics is read several times.
    """
    rows = checkpointed(metrics.select(idx, *IDENTIFIERS).join(node_groups(metrics, idx), idx).withColumn("open", F.lit(True)))
    parts: list[DataFrame] = []
    while not rows.isEmpty():
        if not parts:
            seeds = rows.where(F.col(idx) == F.col("group_id"))
        else:
            seeds = _first_seeds(rows, idx, iterations).where(F.col("first") == F.col(idx))
        found = _lookups(rows, seeds, idx, iterations)
        parts.append(found)
        done = found.select(idx).distinct().withColumn("found", F.lit(True))
        rows = rows.join(done, idx, "left").withColumn("open", F.col("open") & F.col("found").isNull()).drop("found")
        rows = checkpointed(rows)
        rows = checkpointed(rows.join(rows.where("open").select("group_id").distinct(), "group_id", "left_semi"))
    return reduce(DataFrame.unionByName, parts) if parts else metrics.select(idx, F.col(idx).alias("group_id")).limit(0)


#: Names of one kind that a row of a node holds at most; all are in node_members.
NAMES = 1_000
_SETS = {"hostname": "hostnames", "host_variable": "host_variables", "product_serial": "product_serials", "machine_id": "machine_ids"}


def node_members(metrics: DataFrame, groups: DataFrame, idx: str = "idx") -> DataFrame:
    """(group_id, kind, name): every identifier of every node, however many a node has."""
    rows = identified(metrics).join(groups, idx)
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for c, k in _SETS.items())))
    return rows.select("group_id", values.alias("v")).select("group_id", "v.*").where("name IS NOT NULL").distinct()


def managed_nodes(metrics: DataFrame, idx: str = "idx", iterations: int | None = None, names: int = NAMES) -> DataFrame:
    """One row for each node. Its name is that of the row last automated, of those not deleted if there are any, and the
    first name in order of rows automated at the same time; it is deleted if all its rows are.

    Nodes are the components of node_groups, or with `iterations` the groups of bounded_groups. Of names, addresses, serial
    numbers and machine ids the first `names` in order stand in texts, and the counts say how many there are; node_members has all.
    Names are ranked below their nodes, where a task keeps that many of each, so no row grows with a node.
    """
    rows = checkpointed(identified(metrics))
    groups = checkpointed(node_groups(rows, idx) if iterations is None else bounded_groups(rows, iterations, idx))
    return aggregated(rows.join(groups, idx), names)


def aggregated(rows: DataFrame, names: int = NAMES) -> DataFrame:
    """One row for each group_id: see managed_nodes."""
    latest = F.struct("deleted", F.col("last_automation").isNull().alias("never"), (-F.unix_micros(F.col("last_automation").cast("timestamp"))).alias("age"), "hostname")
    spans = [F.min("first_automation").alias("first_automation"), F.max("last_automation").alias("last_automation"), F.sum("automated_counter").alias("automated_counter"), F.sum("deleted_counter").alias("deleted_counter"), F.max("last_deleted").alias("last_deleted")]
    of_name = rows.groupBy("group_id", "hostname").agg(F.min(latest).alias("latest"), F.min("deleted").alias("all_deleted"), F.max("deleted").alias("some_deleted"), *spans)
    nodes = of_name.groupBy("group_id").agg(
        F.min("latest")["hostname"].alias("hostname"),
        F.count("hostname").alias("record_count"),
        F.count(F.when(~F.col("all_deleted"), F.col("hostname"))).alias("record_count_active"),
        F.count(F.when(F.col("some_deleted"), F.col("hostname"))).alias("record_count_deleted"),
        F.min("all_deleted").alias("deleted"),
        *spans,
    )
    nodes = nodes.join(_name_texts(rows, names), "group_id", "left").fillna("", list(_SETS.values()))
    return nodes.withColumn("days_automated", whole_days(F.col("first_automation"), F.col("last_automation")))


def _name_texts(rows: DataFrame, names: int) -> DataFrame:
    """(group_id, hostnames, ...): the first names of each kind, joined by commas. The rank in a window that only asks for the first
    ones is cut before the exchange, so a node of very many names meets in one task with `names` of each task's."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in enumerate(_SETS))))
    each = rows.select("group_id", values.alias("v")).select("group_id", "v.*").where("name IS NOT NULL").distinct()
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("group_id", "kind").orderBy("name"))).where(F.col("rank") <= names)
    texts = ranked.groupBy("group_id", "kind").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("text"))
    return texts.groupBy("group_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("text"))).alias(n) for k, n in enumerate(_SETS.values())))


def ephemeral(days: int, now: datetime) -> Column:
    """Whether a node was automated for at most so many days, and first so long ago that it could have been for more."""
    threshold = (now - timedelta(days=days - 1)).replace(hour=0, minute=0, second=0, microsecond=0)
    return (F.col("days_automated") <= days) & (F.col("first_automation") <= F.lit(threshold).cast("timestamp_ntz"))


def active(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("deleted"))


def deleted(nodes: DataFrame) -> DataFrame:
    return nodes.where("deleted")


def ephemeral_nodes(nodes: DataFrame, days: int, now: datetime, with_deleted: bool = False) -> DataFrame:
    return (nodes if with_deleted else active(nodes)).where(ephemeral(days, now))


def lasting_nodes(nodes: DataFrame, days: int, now: datetime) -> DataFrame:
    return active(nodes).where(~ephemeral(days, now))


def ephemeral_usage(nodes: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_start, window_end, ephemeral_hosts): the names automated within each window, 0 for none.

    Windows are of one length and begin at midnight on successive days, so a node counts in those from the day its first
    window ends on to that of its last automation. A name's spans of days are merged; each adds one on its first day and takes
    it back after its last, and the windows add up what their days change: two rows a name, however long the period.
    """
    days = windows.select("window_start", "window_end", F.to_date("window_start").alias("day"))
    reach = days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max(F.date_diff(F.to_date("window_end"), "day")).alias("span")).first()
    if reach.span is None:
        return windows.select("window_start", "window_end", F.lit(0).cast("long").alias("ephemeral_hosts"))
    first = F.greatest(F.date_sub(F.to_date("first_automation"), reach.span), F.lit(reach.first_day))
    last = F.least(F.to_date("last_automation"), F.lit(reach.last_day))
    spans = nodes.where("hostname IS NOT NULL").select("hostname", first.alias("first"), last.alias("last")).where("first <= last")
    of_name = Window.partitionBy("hostname").orderBy("first", "last")
    before = F.max("last").over(of_name.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("first") > F.date_add(before, 1), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(of_name))
    spans = spans.groupBy("hostname", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    changes = spans.select(F.explode(F.array(F.struct(F.col("first").alias("day"), F.lit(1).alias("by")), F.struct(F.date_add("last", 1).alias("day"), F.lit(-1).alias("by")))).alias("c"))
    changes = changes.groupBy("c.day").agg(F.sum("c.by").alias("by"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row for each day of the period
    return days.join(changes, "day", "left").select("window_start", "window_end", F.coalesce(F.sum("by").over(upto), F.lit(0)).alias("ephemeral_hosts"))


#: The lines of a renewal summary.
AUTOMATED, EPHEMERAL, DELETED = "Automated hosts", "Ephemeral automated hosts total", "Deleted Automated hosts"
PEAK = "Ephemeral automated hosts maximum concurrent usage in defined interval"


def renewal_summary(nodes: DataFrame, days: int | None = None, now: datetime | None = None, usage: DataFrame | None = None) -> DataFrame:
    """(position, description, quantity_consumed): two lines, or four if nodes are told apart as ephemeral."""
    live, name = ~F.col("deleted"), F.col("hostname")
    count = lambda holds: F.count_distinct(F.when(holds, name))
    if days is None:
        lines = {AUTOMATED: count(live)}
        peak = None
    else:
        short = ephemeral(days, now)
        lines = {AUTOMATED: count(live & ~short), EPHEMERAL: count(live & short)}
        peak = usage.agg(F.coalesce(F.max("ephemeral_hosts"), F.lit(0)).alias("quantity_consumed"))
    lines[DELETED] = count(F.col("deleted"))
    counts = nodes.agg(*(c.alias(f"c{i}") for i, c in enumerate(lines.values())))
    pairs = F.explode(F.array(*(F.struct(F.lit(i if i < 2 or days is None else 3).alias("position"), F.lit(text).alias("description"), F.col(f"c{i}").alias("quantity_consumed")) for i, text in enumerate(lines))))
    out = counts.select(pairs.alias("line")).select("line.*")
    if peak is not None:
        out = out.unionByName(peak.select(F.lit(2).alias("position"), F.lit(PEAK).alias("description"), "quantity_consumed"))
    return out
