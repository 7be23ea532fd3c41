"""Schemas of the exports, and how a table of an older or newer exporter is brought to them."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


JOB_HOSTS = """id long, created timestamp_ntz, modified timestamp_ntz, host_name string, host_remote_id long, host_variable string,
 connection_variable string, changed long, dark long, failures long, ok long, processed long, skipped long, failed boolean, ignored long, rescued long,
 job_created timestamp_ntz, job_remote_id long, job_template_remote_id long, job_template_name string, inventory_remote_id long, inventory_name string,
 organization_remote_id long, organization_name string, project_remote_id long, project_name string"""
JOB_EVENTS = """job_host_id long, job_host_created timestamp_ntz, id long, created timestamp_ntz, modified timestamp_ntz, job_created timestamp_ntz, event string,
 task_action string, resolved_action string, resolved_role string, duration double, failed boolean, changed boolean, playbook string, play string,
 task string, role string, job_remote_id long, host_remote_id long, host_name string"""
HOST_METRICS = """hostname string, host_id long, first_automation timestamp_ntz, last_automation timestamp_ntz, automated_counter long, deleted_counter long,
 last_deleted timestamp_ntz, deleted boolean, product_serial string, machine_id string, host_variable string, connection_variable string"""

#: The tables of an export: the name of its file, and its columns.
TABLES = {"job_host_summary": JOB_HOSTS, "main_jobevent": JOB_EVENTS}
#: Columns that the files name after another table.
RENAMED = {"main_jobhostsummary_id": "job_host_id", "main_jobhostsummary_created": "job_host_created"}


def plain_name(name: str, renamed: Mapping[str, str] | None = None) -> str:
    """A column's name in the schemas above; `renamed` has a platform's own names."""
    return (renamed or {}).get(name) or RENAMED.get(name, name)


def columns_of(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split(None, 1)) for part in re.sub(r"\s+", " ", schema).split(", ")]


def conformed(df: DataFrame, schema: str, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """df with exactly the columns of schema: missing ones are null, others go, and texts that do not fit become null."""
    there = {plain_name(c, renamed): c for c in df.columns}
    return df.select(*((F.col(f"`{there[name]}`").try_cast(kind) if name in there else F.lit(None).cast(kind)).alias(name) for name, kind in columns_of(schema)))
