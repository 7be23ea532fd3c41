"""The generic test tables in the shape of the exports, so that every query can run on them.

Each adapter is one SELECT that Spark and other engines read alike; {name} is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..options import HostFields

#: The names that the test relations have.
FIELDS = HostFields("host_address", "host_connection", "serial_number", "machine_number")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Rows of the large tables for each part of a shuffle or scan.
PART_ROWS = 150_000
#: Bytes up to which adaptive execution merges parts of large tables, in place of its default, which is too much for well-packed rows.
MERGED, DEFAULT_MERGED = "8m", "67108864b"

JOB_HOSTS = """
SELECT l.l_shipdate AS created, o.o_orderdate AS job_created, l.l_orderkey AS job_remote_id, p.p_type AS job_template_name,
  CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL ELSE c.c_mktsegment END AS organization_name, s.s_name AS host_name,
  CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE concat('host-', CAST(l.l_suppkey % 40 AS STRING)) END AS host_variable,
  concat('install-', l.l_linestatus) AS install_uuid, CAST(l.l_linenumber % 2 AS BIGINT) AS dark, CAST(round(l.l_discount * 100) AS BIGINT) AS failures,
  CAST(l.l_quantity AS BIGINT) AS ok, CAST(round(l.l_tax * 100) AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS ignored,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE CAST(0 AS BIGINT) END AS rescued
FROM {lineitem} l LEFT JOIN {orders} o ON l.l_orderkey = o.o_orderkey LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey
  LEFT JOIN {supplier} s ON l.l_suppkey = s.s_suppkey LEFT JOIN {part} p ON l.l_partkey = p.p_partkey
"""

#: %(k)s: the number k in the column props.
JOB_EVENTS = """
SELECT j.host_name, j.job_remote_id, j.install_uuid, e.event_type AS event, CAST(e.value AS DECIMAL(18, 2)) AS duration,
  CASE WHEN e.k % 10 = 9 THEN NULL WHEN e.k % 10 = 8 THEN 'shell'
    ELSE concat('ns', CAST(e.k % 4 AS STRING), '.coll', CAST(e.k % 3 AS STRING), '.mod', CAST(e.k AS STRING)) END AS task_action,
  CASE WHEN e.k % 2 = 0 THEN NULL ELSE concat('ns', CAST(e.k % 4 AS STRING), '.coll', CAST(e.k % 3 AS STRING), '.sub.mod', CAST(e.k AS STRING)) END AS resolved_action,
  CASE WHEN e.k % 5 = 0 THEN NULL ELSE concat('ns', CAST(e.k % 4 AS STRING), '.coll', CAST(e.k % 3 AS STRING), '.role', CAST(e.k % 7 AS STRING)) END AS resolved_role,
  CASE WHEN e.k % 3 = 0 THEN NULL WHEN e.k % 3 = 1 THEN concat('owner', CAST(e.k % 5 AS STRING), '.role', CAST(e.k % 7 AS STRING)) ELSE 'plainrole' END AS role
FROM (SELECT *, CAST(@K AS BIGINT) AS k FROM {events}) e JOIN {job_hosts} j ON j.job_remote_id = e.event_id
"""

#: A host's first and last automation lie up to 980 and 720 days within its first and last line, so that some are short.
HOST_METRICS = """
SELECT s.s_suppkey AS idx, s.s_name AS hostname, min(l.l_shipdate) + (s.s_suppkey % 50) * INTERVAL '20' DAY AS first_automation,
  max(l.l_shipdate) - (s.s_suppkey % 37) * INTERVAL '20' DAY AS last_automation, count(*) AS automated_counter,
  CAST(s.s_suppkey % 3 AS BIGINT) AS deleted_counter, s.s_acctbal < 1000 AS deleted, CASE WHEN s.s_suppkey % 3 > 0 THEN max(l.l_shipdate) END AS last_deleted,
  CASE WHEN s.s_suppkey % 6 IN (0, 1) THEN concat('SN', CAST(CAST(floor(s.s_suppkey / 6) AS INT) AS STRING)) WHEN s.s_suppkey % 6 = 2 THEN 'NA' ELSE '' END AS product_serial,
  CASE WHEN s.s_suppkey % 6 IN (1, 2) THEN concat('M', CAST(CAST(floor(s.s_suppkey / 6) AS INT) AS STRING)) WHEN s.s_suppkey % 6 = 3 THEN 'NA' ELSE '' END AS machine_id,
  CASE WHEN s.s_suppkey % 6 IN (2, 3) THEN concat('ip', CAST(CAST(floor(s.s_suppkey / 6) AS INT) AS STRING)) ELSE NULL END AS host_variable
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_name, s.s_acctbal
"""

#: Relations of a controller's database. Jobs without a row of their own, and references that lead nowhere, are in them.
DATABASE = {
    "job_hosts": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS created, l_shipdate AS modified, concat('host-', CAST(l_suppkey AS STRING)) AS host_name, l_suppkey AS host_id,
  CAST(l_linenumber AS BIGINT) AS changed, CAST(0 AS BIGINT) AS dark, CAST(1 AS BIGINT) AS failures, CAST(l_quantity AS BIGINT) AS ok, CAST(1 AS BIGINT) AS processed,
  CAST(0 AS BIGINT) AS skipped, l_returnflag = 'R' AS failed, CAST(0 AS BIGINT) AS ignored, CAST(0 AS BIGINT) AS rescued, l_orderkey AS job_id FROM {lineitem}
""",
    "jobs": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END AS unifiedjob_ptr_id, o_custkey % 50 - 5 AS project_id, CAST(o_custkey % 30 AS INT) AS inventory_id FROM {orders}",
    "unified_jobs": """
SELECT o_orderkey AS id, o_orderdate AS created, o_custkey % 100 AS unified_job_template_id, concat('template ', CAST(o_custkey % 100 AS STRING)) AS name,
  CAST(o_custkey % 30 AS INT) AS organization_id FROM {orders}
""",
    "templates": "SELECT p_partkey AS id, p_name AS name FROM {part}",
    "inventories": "SELECT n_nationkey AS id, n_name AS name FROM {nation}",
    "organizations": "SELECT n_nationkey AS id, n_name AS name FROM {nation}",
    "hosts": """
SELECT s_suppkey AS id, concat('host-', CAST(s_suppkey % 60 AS STRING)) AS name,
  concat('{"serial_number": "SN', CAST(s_suppkey % 9 AS STRING), '", "machine_number": "M', CAST(s_suppkey AS STRING), '"}') AS facts,
  CASE s_suppkey % 5 WHEN 0 THEN concat('{"host_address": "10.0.0.', CAST(s_suppkey AS STRING), '", "host_connection": "ssh"}')
    WHEN 1 THEN concat('---', chr(10), 'host_address: "node', CAST(s_suppkey AS STRING), '"', chr(10), 'host_connection=local')
    WHEN 2 THEN concat('other: 1', chr(10), '  host_address: indented') WHEN 3 THEN '' ELSE NULL END AS variables FROM {supplier}
""",
    "host_metrics": """
SELECT concat('host-', CAST(s_suppkey AS STRING)) AS hostname, min(l_shipdate) AS first_automation, max(l_shipdate) AS last_automation, count(*) AS automated_counter,
  CAST(s_suppkey % 3 AS BIGINT) AS deleted_counter, max(l_shipdate) AS last_deleted, s_acctbal < 1000 AS deleted
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal
""",
    "events": """
SELECT e.event_id * 10 + l.l_linenumber AS id, e.ts AS created, e.ts AS modified, o.o_orderdate AS job_created,
  CASE e.event_type WHEN 'click' THEN 'runner_on_ok' WHEN 'view' THEN 'runner_on_failed' WHEN 'error' THEN 'runner_retry' ELSE 'playbook_on_start' END AS event,
  concat('{"task_action": "ns.coll.mod', CAST(@K AS STRING), '", "resolved_role": "own.role", "duration": "', CAST(e.event_id % 100 AS STRING), '", "text": "caf', chr(92), 'u00e9"}') AS event_data,
  e.event_type = 'error' AS failed, e.event_type = 'view' AS changed, 'site.yml' AS playbook, 'all' AS play, concat('task ', @K) AS task, '' AS role,
  o.o_orderkey AS job_id, l.l_suppkey AS host_id, concat('host-', CAST(l.l_suppkey AS STRING)) AS host_name
FROM {events} e JOIN {orders} o ON o.o_orderkey = e.event_id JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
""",
}
_SPARK_K, _DUCKDB_K = "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"


def _select(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """text with tables put in by temporary names that are gone afterwards."""
    names = {name: f"_adapter_{name}" for name in tables if f"{{{name}}}" in text}
    for name, view in names.items():
        tables[name].createOrReplaceTempView(view)
    for name, view in names.items():
        text = text.replace(f"{{{name}}}", view)
    out = spark.sql(text.replace("@K", _SPARK_K))
    out.schema  # analysed while the names are there
    for view in names.values():
        spark.catalog.dropTempView(view)
    return out


def in_parts(spark: SparkSession, rows: int) -> None:
    """Has the session read and shuffle so many rows in parts of PART_ROWS at most, on average.

    Spark's own numbers do not follow the input, so a task would take more as it grows. Small parts are merged by adaptive
    execution. As plans are made when they run, the session keeps the numbers; they are never lowered.
    """
    for setting in ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum"):
        if int(spark.conf.get(setting, None) or 0) < (parts := -(-rows // PART_ROWS)):
            spark.conf.set(setting, parts)
            if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == DEFAULT_MERGED:
                spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED)


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    in_parts(spark, sum(tables[name].count() for name in ("lineitem", "events")))
    return tables


def job_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, JOB_HOSTS, base_tables(spark, sf_dir))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = base_tables(spark, sf_dir)
    return _select(spark, JOB_EVENTS, tables | {"job_hosts": _select(spark, JOB_HOSTS, tables)})


def host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, HOST_METRICS, base_tables(spark, sf_dir))


def database(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = base_tables(spark, sf_dir)
    return {name: _select(spark, text, tables) for name, text in DATABASE.items()}


def oracle_text(text: str) -> str:
    """An adapter for DuckDB, whose views have the tables' names."""
    for name in TABLES:
        text = text.replace(f"{{{name}}}", name)
    return text.replace("{job_hosts}", "job_hosts").replace("@K", _DUCKDB_K)
