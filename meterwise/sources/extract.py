"""The exported tables, from the relations of a controller's database. Only rows of a period are read."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import event_field, variable
from ..options import RUNNER_EVENTS, HostFields

COUNTERS = ("changed", "dark", "failures", "ok", "processed", "skipped", "failed", "ignored", "rescued")


def _within(column: Column, since: datetime, until: datetime) -> Column:
    return (column >= F.lit(since).cast("timestamp_ntz")) & (column < F.lit(until).cast("timestamp_ntz"))


def job_hosts(db: Mapping[str, DataFrame], since: datetime, until: datetime, fields: HostFields) -> DataFrame:
    """What a job did on each host, with the names of its template, inventory, organization and project.

    db has job_hosts, jobs, unified_jobs, templates, inventories, organizations and hosts.
    """
    runs = db["job_hosts"].where(_within(F.col("modified"), since, until))
    named = lambda name, prefix: db[name].select(F.col("id").alias(f"{prefix}_remote_id"), F.col("name").alias(f"{prefix}_name"))
    jobs = db["jobs"].select(F.col("unifiedjob_ptr_id").alias("job_id"), F.col("project_id").alias("project_remote_id"), F.col("inventory_id").alias("inventory_remote_id"))
    projects, inventories, organizations = named("templates", "project"), named("inventories", "inventory"), named("organizations", "organization")
    # a job has a project or inventory only if its row there exists
    jobs = jobs.join(projects.withColumn("project_there", F.lit(True)), "project_remote_id", "left").join(inventories.withColumn("inventory_there", F.lit(True)), "inventory_remote_id", "left")
    jobs = jobs.select("job_id", *(F.when(F.col(f"{p}_there"), F.col(f"{p}_remote_id")).alias(f"{p}_remote_id") for p in ("project", "inventory")), "project_name", "inventory_name")
    unified = db["unified_jobs"].select(F.col("id").alias("job_id"), F.col("created").alias("job_created"), F.col("unified_job_template_id").alias("job_template_remote_id"), F.col("name").alias("job_template_name"), F.col("organization_id").alias("organization_remote_id"))
    unified = unified.join(organizations.withColumn("organization_there", F.lit(True)), "organization_remote_id", "left")
    unified = unified.select("job_id", "job_created", "job_template_remote_id", "job_template_name", F.when(F.col("organization_there"), F.col("organization_remote_id")).alias("organization_remote_id"), "organization_name")
    hosts = db["hosts"].select(F.col("id").alias("host_id"), variable(F.col("variables"), fields.address).alias("host_variable"), variable(F.col("variables"), fields.connection).alias("connection_variable"))
    return (
        runs.join(jobs, "job_id", "left").join(unified, "job_id", "left").join(hosts, "host_id", "left")
        .select("id", "created", "modified", "host_name", F.col("host_id").alias("host_remote_id"), "host_variable", "connection_variable", *COUNTERS, "job_created", F.col("job_id").alias("job_remote_id"),
                "job_template_remote_id", "job_template_name", "inventory_remote_id", "inventory_name", "organization_remote_id", "organization_name", "project_remote_id", "project_name")
    )


def job_events(db: Mapping[str, DataFrame], since: datetime, until: datetime, *more: str) -> DataFrame:
    """The task events of the jobs and hosts of a period. db has job_hosts, unified_jobs and events.

    Events are found by job_created too. Where they have landed by its day or month (see sinks.landing.land_events), only the days of
    the period's jobs are read: these days, one row each, are broadcast, and Spark prunes partitions by them when the plan runs.
    more may name `run_modified`, the moment that puts an event into the period.
    """
    runs = db["job_hosts"].where(_within(F.col("modified"), since, until)).select(F.col("id").alias("job_host_id"), F.col("created").alias("job_host_created"), F.col("modified").alias("run_modified"), "job_id", "host_name")
    scope = runs.join(db["unified_jobs"].select(F.col("id").alias("job_id"), F.col("created").alias("job_created")), "job_id")
    events = db["events"].where(F.col("event").isin(*RUNNER_EVENTS))
    for grain in ("day", "month"):
        if f"job_{grain}" in events.columns:
            days = scope.select(F.to_date(F.date_trunc(grain, "job_created")).alias(f"job_{grain}")).distinct()  # as many rows as days, however many jobs
            events = events.join(F.broadcast(days), f"job_{grain}", "left_semi")
    fields = [event_field(F.col("event_data"), f).alias(f) for f in ("task_action", "resolved_action", "resolved_role", "duration")]
    return events.join(scope, ["job_created", "job_id", "host_name"]).select(
        "job_host_id", "job_host_created", "id", "created", "modified", "job_created", "event", *fields, "failed", "changed", "playbook", "play", "task", "role", F.col("job_id").alias("job_remote_id"), F.col("host_id").alias("host_remote_id"), "host_name", *more
    )


def host_metrics(db: Mapping[str, DataFrame], since: datetime, fields: HostFields) -> DataFrame:
    """Hosts automated since a moment, once for each inventory that they are in. db has host_metrics and hosts."""
    recent = db["host_metrics"].where(F.col("last_automation") >= F.lit(since).cast("timestamp_ntz"))
    facts = {fields.serial: "product_serial", fields.machine: "machine_id"}
    hosts = db["hosts"].select(
        F.col("name").alias("hostname"), F.col("id").alias("host_id"), *(F.get_json_object("facts", f"$.{f}").alias(n) for f, n in facts.items()),
        variable(F.col("variables"), fields.address).alias("host_variable"), variable(F.col("variables"), fields.connection).alias("connection_variable"),
    )
    return recent.join(hosts, "hostname", "left").withColumn("host_id", F.coalesce("host_id", F.lit(0)))


#: The relations that the tables above are made of: the number by which each is cut into parts, and the moment by which only
#: rows of a period are read.
RELATIONS = {"job_hosts": ("id", "modified"), "jobs": ("unifiedjob_ptr_id", None), "unified_jobs": ("id", None), "templates": ("id", None), "inventories": ("id", None), "organizations": ("id", None), "hosts": ("id", None), "events": ("id", None), "host_metrics": ("id", "last_automation")}


def landed_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations as Parquet tables under a path."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in RELATIONS}


def jdbc_database(spark: SparkSession, url: str, tables: Mapping[str, str], parts: int = 32, since: datetime | None = None, until: datetime | None = None, **properties: str) -> dict[str, DataFrame]:
    """The relations of a controller's database; tables gives each its name there. Each is read in about `parts` parts of equal
    size; of job hosts and host metrics only rows from since on and before until."""
    db = {}
    for name, table in tables.items():
        key, moment = RELATIONS[name]
        db[name] = jdbc_table(spark, url, table, key, parts, within(moment, since, None if name == "host_metrics" else until), **properties)
    return db


def within(moment: str | None, since: datetime | None, until: datetime | None) -> str:
    """SQL that holds for rows of a period."""
    bounds = [f'"{moment}" {sign} {{ts \'{at:%Y-%m-%d %H:%M:%S.%f}\'}}' for sign, at in ((">=", since), ("<", until)) if moment and at]
    return " AND ".join(bounds) or "1 = 1"


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, parts: int, where: str = "1 = 1", **properties: str) -> DataFrame:
    """The rows of a table of the database for which `where` holds, read at once in about `parts` parts between quantiles of
    key, which the database finds among those rows. So parts are even however keys are spread, and each is a range scan of the
    key's index as keyset paging makes it; rows without a key are in the first."""
    key = f'"{key}"'
    one = lambda query: spark.read.jdbc(url, query, properties=properties)
    n = one(f"(SELECT count(*) AS n FROM {table} WHERE {where}) AS counted").first()[0]
    step = max(1, -(-n // parts))
    ordered = f"(SELECT {key} AS k FROM {table} WHERE {where} AND {key} IS NOT NULL ORDER BY {key}) AS ordered"
    cuts = f"(SELECT k FROM (SELECT k, ROW_NUMBER() OVER () AS place FROM {ordered}) AS placed WHERE MOD(place, {step}) = 0) AS cuts"
    bounds = sorted({r[0] for r in one(cuts).collect()})[: parts - 1]  # fewer than parts
    ranges = [f"({key} < {bounds[0]} OR {key} IS NULL)", *(f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)), f"{key} >= {bounds[-1]}"] if bounds else ["1 = 1"]
    return spark.read.jdbc(url, table, predicates=[f"{where} AND {r}" for r in ranges], properties=properties)
