"""Reports of usage over the rollups.

In the reports a host run is a row of the rollup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded, total

JOB = ("job_remote_id", "install_uuid")
_MEASURES = ("host_runs", "task_runs", "first_run", "last_run")


def _counted(hosts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs and names, each counted once, runs, tasks and times for each key; a job counts even where a part of it is null.

    The rollup is grouped by job and by name below the keys, and a last grouping counts the rows of both. Both groupings take
    the same columns of the rollup, so that its exchange, and all below, is planned once and read twice; no row is expanded
    for each distinct count, and a key, job or name of any size is summed before it is dealt.
    """
    measures = [F.count("host_name").alias("host_runs"), total("task_runs").alias("task_runs"), F.min("job_created").alias("first_run"), F.max("job_created").alias("last_run")]
    both = [hosts.groupBy(*keys, *by).agg(*measures).select(*keys, F.lit(n).alias("kind"), counts.alias("counts"), *_MEASURES) for n, (by, counts) in enumerate(((JOB, F.lit(True)), (("host_name",), F.col("host_name").isNotNull())))]
    of = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    # either kind of rows adds up to the same
    same = lambda fold, column: F.greatest(fold(of(0, column)), fold(of(1, column))).alias(column)
    counts = [F.count_if((F.col("kind") == n) & F.col("counts")).alias(name) for n, name in enumerate(("job_runs", "host_runs_unique"))]
    return both[0].unionByName(both[1]).groupBy(*keys).agg(*counts, same(F.sum, "host_runs"), same(F.sum, "task_runs"), same(F.min, "first_run"), same(F.max, "last_run"))


def by_job(hosts: DataFrame) -> DataFrame:
    return _counted(hosts, ["organization_name", "job_template_name"])


def by_organization(hosts: DataFrame, jobs: bool = True) -> DataFrame:
    if jobs:
        return _counted(hosts, ["organization_name"]).drop("first_run", "last_run")
    return hosts.groupBy("organization_name").agg(F.count_distinct("host_name").alias("host_runs_unique"), F.count("host_name").alias("host_runs"), total("task_runs").alias("task_runs"))


def _node_counts() -> list:
    return [F.count("host_name").alias("host_runs"), total("task_runs").alias("task_runs"), F.min("first_automation").alias("first_automation"), F.max("last_automation").alias("last_automation")]


def by_node(hosts: DataFrame) -> DataFrame:
    return hosts.groupBy("host_name").agg(F.count_distinct("organization_name").alias("organizations"), *_node_counts())


def by_node_of_organization(hosts: DataFrame) -> DataFrame:
    """by_node for each organization at once; a sheet of one organization is a filter of it."""
    return hosts.groupBy("organization_name", "host_name").agg(*_node_counts())


def by_node_with_organizations(hosts: DataFrame, organizations: Sequence[str]) -> DataFrame:
    """by_node, and in last_automations, an array, the last automation of the node in each organization, in the order given.

    Rows are grouped by node and organization once, and a node's entries, of which a sheet holds a bounded number, are put at
    their organizations' places with the gaps between them filled; so more organizations add no aggregates, and no work for
    each row. with_organization_columns makes columns of the array.
    """
    table = hosts.sparkSession.createDataFrame([(name, n) for n, name in enumerate(organizations)], "organization_name string, place int")
    # at most as many rows as a sheet has columns
    of_both = hosts.groupBy("host_name", "organization_name").agg(*_node_counts()).join(F.broadcast(table), "organization_name", "left")
    known = F.when(F.col("place").isNotNull() & F.col("host_name").isNotNull(), F.struct("place", "last_automation"))
    merged = [F.sum("host_runs").alias("host_runs"), F.sum("task_runs").alias("task_runs"), F.min("first_automation").alias("first_automation"), F.max("last_automation").alias("last_automation")]
    nodes = of_both.groupBy("host_name").agg(F.count("organization_name").alias("organizations"), *merged, F.array_sort(F.collect_list(known)).alias("found"))
    none = F.lit(None).cast(hosts.schema["last_automation"].dataType)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("found", i - 1)["place"])
    filled = F.flatten(F.transform("found", lambda e, i: F.concat(F.array_repeat(none, e["place"] - before(i) - 1), F.array(e["last_automation"]))))
    rest = F.array_repeat(none, F.lit(len(organizations)) - F.size(filled))
    return nodes.select(*(c for c in nodes.columns if c != "found"), F.concat(filled, rest).alias("last_automations"))


def with_organization_columns(nodes: DataFrame, organizations: int) -> DataFrame:
    """nodes with a column org_<n> for each place of last_automations."""
    return nodes.select(*(c for c in nodes.columns if c != "last_automations"), *(F.get("last_automations", n).alias(f"org_{n}") for n in range(organizations)))


def organization_names(hosts: DataFrame, most: int = 16_000) -> list[str]:
    """The organizations in order. A sheet holds at most 16384 columns, so more than `most` is an error."""
    names = [r[0] for r in hosts.select("organization_name").where("organization_name IS NOT NULL").distinct().orderBy("organization_name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} organizations do not fit on a sheet")
    return names


def of_organizations(hosts: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Only these organizations' rows; events are never filtered so."""
    return hosts if names is None else hosts.where(F.col("organization_name").isin(*names))


def by_content(content: DataFrame, kind: str) -> DataFrame:
    """Usage by collection_name, role_name or module_name.

    A host's jobs are counted below its name, so three groupings of shrinking size do without expanding the rows for
    each distinct count.
    """
    measures = [total("task_runs").alias("task_runs"), total("duration").alias("duration")]
    jobs = content.groupBy(kind, "host_name", "install_uuid", "job_remote_id").agg(*measures)
    hosts = jobs.groupBy(kind, "host_name").agg(F.count("*").alias("host_runs"), *measures)
    return hosts.groupBy(kind).agg(F.count("host_name").alias("host_runs_unique"), F.sum("host_runs").alias("host_runs"), total("task_runs").alias("task_runs"), total("duration").cast("double").alias("duration"))


def billing_by_organization(hosts: DataFrame, price: float) -> DataFrame:
    price = round(price, 2)
    counts = hosts.groupBy("organization_name").agg(F.count_distinct("host_name").alias("quantity_consumed"))
    return counts.select("organization_name", F.lit("").alias("mark_x"), "quantity_consumed", F.lit(price).alias("unit_price"), rounded(F.col("quantity_consumed") * price).alias("extended_unit_price"))


def billing_total(hosts: DataFrame, price: float, company: Sequence[str] = ("", "", "", ""), sku: str = "", sku_description: str = "") -> DataFrame:
    """One row for all nodes, none if there are none."""
    price = round(price, 2)
    fields = [F.lit(v).alias(f"end_user_company_{n}") for n, v in zip(("name", "city", "state", "country"), company, strict=True)]
    counts = hosts.agg(F.count_distinct("host_name").alias("quantity_consumed")).where("quantity_consumed > 0")
    return counts.select(
        fields[0], F.lit("").alias("mark_x"), *fields[1:], F.lit(sku).alias("sku_number"), "quantity_consumed", F.lit(sku_description).alias("sku_description"),
        F.lit(price).alias("unit_price"), rounded(F.col("quantity_consumed") * price).alias("extended_unit_price"), F.lit("").alias("notes"),
    )
