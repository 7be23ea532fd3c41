"""Rollups: one row for each host of a job, and one for each module, collection and role that it ran.

Batches need no merging of their own: partial and final aggregation of one groupBy over all of them give the same.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import collection_name, role_name, total
from ..options import NO_COLLECTION, NO_ORGANIZATION, NO_ROLE

HOST_KEYS = ["organization_name", "job_template_name", "host_name", "original_host_name", "install_uuid", "job_remote_id"]
CONTENT_KEYS = ["host_name", "module_name", "collection_name", "role_name", "install_uuid", "job_remote_id"]
TASK_COUNTERS = ("dark", "failures", "ok", "skipped", "ignored", "rescued")
#: What host_rollup reads of an export.
HOST_COLUMNS = ("organization_name", "job_template_name", "host_variable", "host_name", "job_remote_id", "created", "job_created", *TASK_COUNTERS)


def normalised_job_hosts(job_hosts: DataFrame, *more: str) -> DataFrame:
    """job_hosts with a name for each organization, and each host's real name where its variables give one.

    A row's task_runs are null, and later count as 0, if one of its counters is null.
    """
    variable = F.col("host_variable") if "host_variable" in job_hosts.columns else F.lit(None).cast("string")
    return job_hosts.select(
        F.coalesce("organization_name", F.lit(NO_ORGANIZATION)).alias("organization_name"),
        "job_template_name",
        F.coalesce(variable, F.col("host_name")).alias("host_name"),
        F.col("host_name").alias("original_host_name"),
        "install_uuid",
        "job_remote_id",
        reduce(add, (F.col(c) for c in TASK_COUNTERS)).alias("task_runs"),
        "created",
        "job_created",
        *more,
    )


def host_rollup(job_hosts: DataFrame, *more: str) -> DataFrame:
    """Runs, tasks and times for each organization, template, host, installation and job, and of the columns `more`; null keys are
    groups too."""
    return normalised_job_hosts(job_hosts, *more).groupBy(*HOST_KEYS, *more).agg(
        F.count("host_name").alias("host_runs"),
        total("task_runs").alias("task_runs"),
        F.min("created").alias("first_automation"),
        F.max("created").alias("last_automation"),
        F.max("job_created").alias("job_created"),
    )


def merged_host_rollups(rollups: DataFrame) -> DataFrame:
    """One rollup of the union of several."""
    return rollups.groupBy(*HOST_KEYS).agg(
        total("host_runs").alias("host_runs"), total("task_runs").alias("task_runs"), F.min("first_automation").alias("first_automation"), F.max("last_automation").alias("last_automation"), F.max("job_created").alias("job_created")
    )


def content_rollup(events: DataFrame) -> DataFrame:
    """Tasks and their duration for each host, module, collection, role, installation and job.

    Events without an action or a host do not count. What an action resolves to comes before the action itself.
    """
    used = events.where(F.col("task_action").isNotNull() & F.col("host_name").isNotNull())
    module = F.coalesce("resolved_action", "task_action")
    named = used.select(
        "host_name",
        module.alias("module_name"),
        F.coalesce(collection_name(module), F.lit(NO_COLLECTION)).alias("collection_name"),
        F.coalesce(role_name(F.coalesce("resolved_role", "role")), F.lit(NO_ROLE)).alias("role_name"),
        "install_uuid",
        "job_remote_id",
        "duration",
    )
    return named.groupBy(*CONTENT_KEYS).agg(F.count("module_name").alias("task_runs"), total("duration").alias("duration"))


def with_real_hosts(content: DataFrame, hosts: DataFrame) -> DataFrame:
    """A content rollup with the host names that a host rollup has for the same host, installation and job.

    Where one host has several, that of the last organization, template and name in their order counts, nulls last.
    """
    order = F.struct("organization_name", F.col("job_template_name").isNull(), "job_template_name", F.col("host_name").isNull(), "host_name")
    names = hosts.where("original_host_name IS NOT NULL").groupBy("original_host_name", "install_uuid", "job_remote_id").agg(F.max_by("host_name", order).alias("real_name"))
    n, c = names.alias("n"), content.alias("c")
    same = (F.col("c.host_name") == F.col("n.original_host_name")) & F.col("c.install_uuid").eqNullSafe(F.col("n.install_uuid")) & F.col("c.job_remote_id").eqNullSafe(F.col("n.job_remote_id"))
    rest = [F.col(f"c.{x}") for x in content.columns if x != "host_name"]
    return c.join(n, same, "left").select(F.coalesce("n.real_name", "c.host_name").alias("host_name"), *rest)
