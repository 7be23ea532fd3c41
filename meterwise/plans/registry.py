"""The usage-metering queries and the SQL they are checked against."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, datetime

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import COLLECTION, ROLE
from ..functions.dates import sliding_windows
from ..operators import hosts, rollups, usage
from ..operators.components import checkpointed, shuffles_removed
from ..sinks.files import file_system, names_in
from ..sinks.landing import land, land_events, landed, ship_slices
from ..sources import adapters, extract
from ..sources.exports import read_configs, read_exports, scan_exports, with_configs
from ..streaming.incremental import gather_exports, gather_new, streamed_rollup
from .gather import sliced

PRICE = 11.55
ORGANIZATIONS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "No organization name")
NOW, DAYS, SINCE, UNTIL = datetime(2003, 1, 15, 10, 30), 2450, date(1995, 6, 1), date(2003, 6, 1)
WINDOW = 30
PERIOD = (datetime(1996, 1, 1), datetime(1997, 1, 1))

# ---- queries


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.host_rollup(adapters.job_hosts(spark, sf_dir))


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rollups.content_rollup(adapters.job_events(spark, sf_dir))
    return rollups.with_real_hosts(events, _hosts(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.managed_nodes(adapters.host_metrics(spark, sf_dir))


def _usage(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    return hosts.ephemeral_usage(hosts.ephemeral_nodes(nodes, DAYS, NOW, with_deleted=True), sliding_windows(spark, SINCE, UNTIL, WINDOW))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = checkpointed(_nodes(spark, sf_dir))  # counted twice
    return hosts.renewal_summary(nodes, DAYS, NOW, _usage(spark, nodes))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of three batches, merged."""
    rows = adapters.job_hosts(spark, sf_dir)
    batch = F.pmod(F.xxhash64("created"), F.lit(3))
    parts = [rollups.host_rollup(rows.where(batch == i)) for i in range(3)]
    return rollups.merged_host_rollups(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='meterwise-')}"
    return f"{folder.rstrip('/')}/meterwise/{name}-{uuid.uuid4().hex}"


@contextmanager
def _stored(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """df as Parquet in a folder of path, for what reads it more than once inside; then the folder goes."""
    where, root = file_system(path)
    try:
        with shuffles_removed(df.sparkSession):
            df.write.parquet(f"{path}/stored")
        yield df.sparkSession.read.parquet(f"{path}/stored")
    finally:
        where.delete_dir(f"{root.rstrip('/')}/stored")


def _shipped(job_hosts: DataFrame, path: str, until: datetime | None = None, whole: bool = False, **how) -> None:
    """Ships job hosts as tarballs, a slice a year and installation; only rows before `until`, where slices end then. A slice is
    dealt to as many tasks as it needs, or, where its tarball is to be whole, to one. Rows are dealt as they are, and become texts
    where they are written; the rows of a job follow each other there, which makes tarballs small."""
    rows = job_hosts
    year, end = F.date_trunc("year", "created").cast("timestamp_ntz"), F.expr("INTERVAL 1 YEAR")
    rows = rows if until is None else rows.where(F.col("created") < F.lit(until).cast("timestamp_ntz"))
    last = year + end if until is None else F.least(year + end, F.lit(until).cast("timestamp_ntz"))
    for install in ("install-F", "install-O"):
        part = rows.where(F.col("install_uuid") == install).drop("install_uuid")
        cut = part.withColumns({"slice_start": year, "slice_end": last})
        order = ["slice_start", "job_remote_id", "host_name", "created", "ok"]
        dealt = cut.repartition("slice_start") if whole else cut.repartitionByRange(*order).sortWithinPartitions(*order)
        ship_slices(dealt.select(*(F.col(c).cast("string").alias(c) for c in part.columns), "slice_start", "slice_end"), path, "job_host_summary", install, **how)


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job hosts shipped as tarballs, read back, and rolled up."""
    path = _scratch(spark, "exports")
    with _stored(adapters.job_hosts(spark, sf_dir), path) as rows:
        _shipped(rows, path)
    return rollups.host_rollup(read_exports(spark, path, "job_host_summary", date(1990, 1, 1), date(2010, 12, 31), rollups.HOST_COLUMNS))


def _reshipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, shipped up to the middle of a year first, and then again with all of that year."""
    path = _scratch(spark, "reshipped")
    with _stored(adapters.job_hosts(spark, sf_dir), path) as rows:
        _shipped(rows, path, until=datetime(1996, 7, 1))
        _shipped(rows.where("created >= '1996-01-01'"), path)
    return rollups.host_rollup(read_exports(spark, path, "job_host_summary", date(1990, 1, 1), date(2010, 12, 31), rollups.HOST_COLUMNS))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped in two goes, the second of which replaces a slice of the first, each followed by a run of the stream."""
    path = _scratch(spark, "streamed")
    with _stored(adapters.job_hosts(spark, sf_dir), path) as rows:
        for part, until in ((rows, datetime(1996, 7, 1)), (rows.where("created >= '1996-01-01'"), None)):
            _shipped(part, f"{path}/shipped", until)
            gather_exports(spark, f"{path}/shipped", f"{path}/target", f"{path}/checkpoint").awaitTermination()
    return streamed_rollup(spark, f"{path}/shipped", f"{path}/target")


def _halve(where: FileSystem, folder: str, name: str) -> None:
    """Cuts a file to its first half, a piece at a time."""
    with where.open_input_file(f"{folder}/{name}") as file, where.open_output_stream(f"{folder}/.{name}", compression=None) as out:
        left = file.size() // 2
        while left:
            out.write(piece := file.read(min(left, 4 << 20)))
            left -= len(piece)
    where.move(f"{folder}/.{name}", f"{folder}/{name}")


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and unreadable tarballs by year of a landed set in which every tarball of 1999 has lost its second half."""
    path = _scratch(spark, "rejects")
    with _stored(adapters.job_hosts(spark, sf_dir), path) as rows:
        _shipped(rows, path, whole=True, rows=1 << 40, most_bytes=1 << 50)
    where, root = file_system(path)
    for name in names_in(folder := f"{path}/data/1999/01/01"):
        if name.endswith(".tar.gz"):
            _halve(where, f"{root}{folder.removeprefix(path)}", name)
    scan = scan_exports(spark, path, "job_host_summary", columns=["created"])
    return scan.groupBy(F.year("slice_day").cast("long").alias("year")).agg(F.count_if(F.col("error").isNull()).alias("n_rows"), F.count_if(F.col("error").isNotNull()).alias("n_rejects"))


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of one installation in some years; the tarballs of others are not opened."""
    path = _scratch(spark, "pruned")
    with _stored(adapters.job_hosts(spark, sf_dir), path) as rows:
        _shipped(rows, path)
    scan = scan_exports(spark, path, "job_host_summary", columns=["organization_name", "ok"]).where("install_uuid = 'install-F' AND slice_day >= DATE '1996-01-01' AND slice_day < DATE '1998-01-01'")
    return scan.where("error IS NULL").groupBy("install_uuid", "organization_name").agg(F.count("*").alias("n_rows"), F.sum("ok").alias("ok"))


def _by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by the platform that each slice's installation ran on: shipped in two goes, the later with a newer release."""
    path = _scratch(spark, "platforms")
    with _stored(adapters.job_hosts(spark, sf_dir), path) as rows:
        for part, release in ((rows.where("created < '1998-01-01'"), "8"), (rows.where("created >= '1998-01-01'"), "9")):
            _shipped(part, path, config={"platform": {"system": "Linux", "release": release}})
    used = with_configs(scan_exports(spark, path, "job_host_summary", columns=["ok"]).where("error IS NULL"), read_configs(spark, path, "job_host_summary"))
    release = F.try_variant_get("config", "$.platform.release", "string")
    return used.groupBy("install_uuid", release.alias("release")).agg(F.count("*").alias("n_rows"), F.sum("ok").alias("ok"))


def _pruned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a period's jobs, from events that have landed by month."""
    path = _scratch(spark, "events")
    db = adapters.database(spark, sf_dir)
    land_events(db["events"], path, "month")
    return extract.job_events({**db, "events": spark.read.parquet(path)}, *PERIOD)


def _landed_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job hosts landed as Parquet by month, of which the folders of a period are read."""
    path = _scratch(spark, "landed")
    month = F.date_trunc("month", "created")
    land(adapters.job_hosts(spark, sf_dir).withColumn("month_start", month), path, F.col("month_start"))
    rows = landed(spark.read.parquet(path), date(1996, 1, 1), date(1996, 12, 31))
    return rows.groupBy("organization_name").agg(F.count("*").alias("n_rows"), F.sum("ok").alias("ok"))


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of two streaming runs, the second over what has landed since the first, merged."""
    rows, path = adapters.job_hosts(spark, sf_dir), _scratch(spark, "incremental")
    late = F.col("job_remote_id") % 2 == 0
    for part in (rows.where(~late), rows.where(late)):
        part.write.mode("append").parquet(f"{path}/landed")
        gather_new(spark, f"{path}/landed", f"{path}/rollups", f"{path}/checkpoint", rows.schema).awaitTermination()
    return rollups.merged_host_rollups(spark.read.parquet(f"{path}/rollups").drop("batch"))


def _gathered_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a gathering ships, by day."""
    since, until = datetime(1996, 1, 1, 7, 30), datetime(1996, 3, 1)
    rows = sliced(extract.job_hosts(adapters.database(spark, sf_dir), since, until, adapters.FIELDS), "modified", since, until)
    return rows.groupBy("slice_start", "slice_end").agg(F.count("*").alias("n_rows"), F.sum("ok").alias("ok"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "jobhost_rollup": _hosts,
        "batch_merge_invariance": _merged,
        "usage_by_job": lambda s, d: usage.by_job(_hosts(s, d)),
        "usage_by_organization": lambda s, d: usage.by_organization(_hosts(s, d)),
        "usage_by_organization_basic": lambda s, d: usage.by_organization(_hosts(s, d), jobs=False),
        "usage_by_node": lambda s, d: usage.by_node(_hosts(s, d)),
        "usage_by_node_org_detail": lambda s, d: usage.with_organization_columns(usage.by_node_with_organizations(_hosts(s, d), ORGANIZATIONS), len(ORGANIZATIONS)),
        "usage_by_node_per_org": lambda s, d: usage.by_node_of_organization(_hosts(s, d)),
        "billing_by_organization": lambda s, d: usage.billing_by_organization(_hosts(s, d), PRICE),
        "billing_total": lambda s, d: usage.billing_total(_hosts(s, d), PRICE, ("Example", "Town", "State", "Land"), "SKU1", "nodes"),
        "org_filtered_usage": lambda s, d: usage.by_organization(usage.of_organizations(_hosts(s, d), ORGANIZATIONS[:2])),
        "content_rollup": lambda s, d: rollups.content_rollup(adapters.job_events(s, d)).withColumn("duration", F.col("duration").cast("double")),
        "usage_by_collection": lambda s, d: usage.by_content(_content(s, d), "collection_name"),
        "usage_by_role": lambda s, d: usage.by_content(_content(s, d), "role_name"),
        "usage_by_module": lambda s, d: usage.by_content(_content(s, d), "module_name"),
        "jobhost_extract": lambda s, d: extract.job_hosts(adapters.database(s, d), *PERIOD, adapters.FIELDS),
        "jobevent_extract": lambda s, d: extract.job_events(adapters.database(s, d), datetime(1990, 1, 1), datetime(2010, 1, 1)),
        "jobevent_pruned": _pruned_events,
        "host_metric_extract": lambda s, d: extract.host_metrics(adapters.database(s, d), datetime(1998, 6, 1), adapters.FIELDS),
        "host_dedup": _nodes,
        "host_dedup_3": lambda s, d: hosts.managed_nodes(adapters.host_metrics(s, d), iterations=3),
        "host_dedup_1": lambda s, d: hosts.managed_nodes(adapters.host_metrics(s, d), iterations=1),
        "managed_nodes": lambda s, d: hosts.active(_nodes(s, d)),
        "managed_nodes_ephemeral": lambda s, d: hosts.ephemeral_nodes(_nodes(s, d), DAYS, NOW),
        "managed_nodes_non_ephemeral": lambda s, d: hosts.lasting_nodes(_nodes(s, d), DAYS, NOW),
        "deleted_nodes": lambda s, d: hosts.deleted(_nodes(s, d)),
        "ephemeral_windows": lambda s, d: _usage(s, _nodes(s, d)),
        "renewal_summary": _summary,
        "renewal_summary_plain": lambda s, d: hosts.renewal_summary(_nodes(s, d)),
        "exports_rollup": _exported,
        "reshipped_rollup": _reshipped,
        "exports_stream_rollup": _streamed,
        "export_rejects": _rejects,
        "pruned_exports": _pruned,
        "usage_by_platform": _by_platform,
        "landed_period": _landed_period,
        "incremental_rollup": _incremental,
        "gathered_slices": _gathered_slices,
    }


# ---- SQL

_JOB_HOSTS = f"job_hosts AS ({adapters.oracle_text(adapters.JOB_HOSTS)})"
_HOSTS = f"""{_JOB_HOSTS}, normalised AS (
  SELECT coalesce(organization_name, 'No organization name') AS organization_name, job_template_name, coalesce(host_variable, host_name) AS host_name,
    host_name AS original_host_name, install_uuid, job_remote_id, dark + failures + ok + skipped + ignored + rescued AS task_runs, created, job_created FROM job_hosts
), hosts AS (
  SELECT organization_name, job_template_name, host_name, original_host_name, install_uuid, job_remote_id, count(host_name) AS host_runs,
    CAST(coalesce(sum(task_runs), 0) AS BIGINT) AS task_runs, min(created) AS first_automation, max(created) AS last_automation, max(job_created) AS job_created
  FROM normalised GROUP BY ALL
)"""
_COLLECTION, _ROLE = f"'{COLLECTION}'", f"'{ROLE}'"
_EVENTS = rf"""job_events AS ({adapters.oracle_text(adapters.JOB_EVENTS)}), named AS (
  SELECT host_name, coalesce(resolved_action, task_action) AS module_name, coalesce(resolved_role, role) AS full_role, install_uuid, job_remote_id, duration
  FROM job_events WHERE task_action IS NOT NULL AND host_name IS NOT NULL
), parts AS (
  SELECT *, regexp_extract(module_name, {_COLLECTION}, 1) AS m1, regexp_extract(module_name, {_COLLECTION}, 2) AS m2, regexp_extract(full_role, {_COLLECTION}, 1) AS r1,
    regexp_extract(full_role, {_COLLECTION}, 2) AS r2, regexp_extract(full_role, {_COLLECTION}, 3) AS r3, regexp_extract(full_role, {_ROLE}, 1) AS s1, regexp_extract(full_role, {_ROLE}, 2) AS s2 FROM named
), content AS (
  SELECT host_name, module_name, CASE WHEN m1 <> '' THEN m1 || '.' || m2 ELSE 'No collection used' END AS collection_name,
    CASE WHEN r1 <> '' THEN r1 || '.' || r2 || '.' || r3 WHEN s1 <> '' THEN s1 || '.' || s2 ELSE 'No role used' END AS role_name, install_uuid, job_remote_id,
    count(module_name) AS task_runs, coalesce(sum(duration), 0) AS duration FROM parts GROUP BY ALL
)"""
_CONTENT = f"""{_HOSTS}, {_EVENTS}, names AS (
  SELECT original_host_name, install_uuid, job_remote_id, arg_max(host_name, (organization_name, job_template_name IS NULL, job_template_name, host_name IS NULL, host_name)) AS real_name
  FROM hosts WHERE original_host_name IS NOT NULL GROUP BY ALL
), mapped AS (
  SELECT coalesce(n.real_name, c.host_name) AS host_name, c.* EXCLUDE (host_name) FROM content c LEFT JOIN names n
    ON c.host_name = n.original_host_name AND c.install_uuid IS NOT DISTINCT FROM n.install_uuid AND c.job_remote_id IS NOT DISTINCT FROM n.job_remote_id
)"""


def _by_content(kind: str) -> str:
    return f"""WITH {_CONTENT} SELECT {kind}, count(DISTINCT host_name) AS host_runs_unique, count(DISTINCT (host_name, install_uuid, job_remote_id)) AS host_runs,
  CAST(sum(task_runs) AS BIGINT) AS task_runs, CAST(sum(duration) AS DOUBLE) AS duration FROM mapped GROUP BY {kind}"""


def _database(*names: str) -> str:
    return ", ".join(f"db_{n} AS ({adapters.oracle_text(adapters.DATABASE[n])})" for n in names)


def _variable(name: str) -> str:
    return rf"""CASE WHEN json_valid(h.variables) THEN json_extract_string(h.variables, '$.{name}') ELSE trim(nullif(regexp_extract(h.variables, '(?m)^{name} *[:=] *(.+?) *$', 1), ''), '"') END"""


_METRICS = f"""raw AS ({adapters.oracle_text(adapters.HOST_METRICS)}), metrics AS (
  SELECT idx, hostname, first_automation, last_automation, automated_counter, deleted_counter, deleted, last_deleted, nullif(nullif(product_serial, ''), 'NA') AS product_serial,
    nullif(nullif(machine_id, ''), 'NA') AS machine_id, nullif(host_variable, '') AS host_variable FROM raw
)"""
_GROUPED = """nodes AS (
  SELECT group_id, arg_min(hostname, (deleted, last_automation IS NULL, -epoch_us(last_automation), hostname)) AS hostname, count(DISTINCT hostname) AS record_count,
    count(DISTINCT CASE WHEN NOT deleted THEN hostname END) AS record_count_active, count(DISTINCT CASE WHEN deleted THEN hostname END) AS record_count_deleted,
    coalesce(string_agg(DISTINCT hostname, ', ' ORDER BY hostname), '') AS hostnames, coalesce(string_agg(DISTINCT host_variable, ', ' ORDER BY host_variable), '') AS host_variables,
    coalesce(string_agg(DISTINCT product_serial, ', ' ORDER BY product_serial), '') AS product_serials, coalesce(string_agg(DISTINCT machine_id, ', ' ORDER BY machine_id), '') AS machine_ids,
    min(deleted) AS deleted, min(first_automation) AS first_automation, max(last_automation) AS last_automation, CAST(sum(automated_counter) AS BIGINT) AS automated_counter,
    CAST(sum(deleted_counter) AS BIGINT) AS deleted_counter, max(last_deleted) AS last_deleted,
    greatest(CAST(floor((epoch_us(max(last_automation)) - epoch_us(min(first_automation))) / 86400000000) AS BIGINT), 0) AS days_automated
  FROM metrics JOIN labels USING (idx) GROUP BY group_id
)"""
_NODES = f"""{_METRICS}, edges AS (
  SELECT a.idx AS a, b.idx AS b FROM metrics a JOIN metrics b ON a.hostname = b.hostname UNION SELECT a.idx, b.idx FROM metrics a JOIN metrics b ON a.product_serial = b.product_serial
  UNION SELECT a.idx, b.idx FROM metrics a JOIN metrics b ON a.machine_id = b.machine_id UNION SELECT a.idx, b.idx FROM metrics a JOIN metrics b ON a.host_variable = b.host_variable
), reach AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), labels AS (SELECT a AS idx, min(b) AS group_id FROM reach GROUP BY a), {_GROUPED}"""


def _bounded(iterations: int) -> str:
    """The lookups of every row, step by step; then the rows in order, each that no chosen one has found being chosen."""
    steps = "".join(
        f""", found{n + 1} AS (SELECT seed, idx FROM found{n} UNION SELECT seed, b.idx FROM found{n} JOIN metrics a USING (idx) JOIN metrics b ON a.{kind} = b.{kind})"""
        for n, kind in enumerate(["hostname", "host_variable", "product_serial", "machine_id"] * iterations)
    )
    return f"""{_METRICS}, found0 AS (SELECT idx AS seed, idx FROM metrics){steps}, whole AS (SELECT seed, list(idx) AS members FROM found{4 * iterations} GROUP BY seed), chosen AS (
  SELECT seed, members AS gone FROM whole WHERE seed = (SELECT min(seed) FROM whole)
  UNION ALL SELECT w.seed, list_concat(gone, members) FROM (SELECT c.gone, min(w.seed) AS seed FROM chosen c JOIN whole w ON NOT list_contains(c.gone, w.seed) GROUP BY c.gone) n JOIN whole w USING (seed)
), labels AS (SELECT seed AS group_id, unnest(members) AS idx FROM whole WHERE seed IN (SELECT seed FROM chosen)), {_GROUPED}"""


_SHORT = "days_automated <= 2450 AND first_automation <= TIMESTAMP '1996-05-02 00:00:00'"
_WINDOWS = f"""windows AS (
  SELECT w AS window_start, w + INTERVAL 30 DAY - INTERVAL 1 MICROSECOND AS window_end FROM (SELECT unnest(generate_series(TIMESTAMP '1995-06-01', TIMESTAMP '2003-05-03', INTERVAL 1 DAY)) AS w)
), usage AS (
  SELECT window_start, window_end, count(DISTINCT hostname) AS ephemeral_hosts FROM windows LEFT JOIN (SELECT * FROM nodes WHERE {_SHORT})
    ON last_automation >= window_start AND first_automation <= window_end GROUP BY window_start, window_end
)"""
_USAGE_COUNTS = "count(DISTINCT host_name) AS host_runs_unique, count(host_name) AS host_runs, CAST(sum(task_runs) AS BIGINT) AS task_runs"
_NODE_COUNTS = "count(host_name) AS host_runs, CAST(sum(task_runs) AS BIGINT) AS task_runs, min(first_automation) AS first_automation, max(last_automation) AS last_automation"
_JOBS = "count(DISTINCT (job_remote_id, install_uuid)) AS job_runs"


def _events_of(since: str, until: str) -> str:
    return f"""WITH {_database("job_hosts", "unified_jobs", "events")}
SELECT r.id AS job_host_id, r.created AS job_host_created, e.id, e.created, e.modified, e.job_created, e.event, json_extract_string(d, '$.task_action') AS task_action,
  json_extract_string(d, '$.resolved_action') AS resolved_action, json_extract_string(d, '$.resolved_role') AS resolved_role, json_extract_string(d, '$.duration') AS duration,
  e.failed, e.changed, e.playbook, e.play, e.task, e.role, e.job_id AS job_remote_id, e.host_id AS host_remote_id, e.host_name
FROM (SELECT *, replace(event_data, chr(92) || 'u', chr(92) || 'u005cu') AS d FROM db_events) e JOIN db_job_hosts r ON r.job_id = e.job_id AND r.host_name = e.host_name
  JOIN db_unified_jobs u ON u.id = r.job_id AND u.created = e.job_created
WHERE e.event LIKE 'runner%' AND r.modified >= TIMESTAMP '{since}' AND r.modified < TIMESTAMP '{until}'"""


def oracle_sql() -> dict[str, str]:
    organizations = ", ".join(f"max(CASE WHEN organization_name = '{o}' AND host_name IS NOT NULL THEN last_automation END) AS org_{n}" for n, o in enumerate(ORGANIZATIONS))
    rollup = f"WITH {_HOSTS} SELECT * FROM hosts"
    return {
        "jobhost_rollup": rollup,
        "batch_merge_invariance": rollup,
        "usage_by_job": f"WITH {_HOSTS} SELECT organization_name, job_template_name, {_JOBS}, {_USAGE_COUNTS}, min(job_created) AS first_run, max(job_created) AS last_run FROM hosts GROUP BY 1, 2",
        "usage_by_organization": f"WITH {_HOSTS} SELECT organization_name, {_JOBS}, {_USAGE_COUNTS} FROM hosts GROUP BY 1",
        "usage_by_organization_basic": f"WITH {_HOSTS} SELECT organization_name, {_USAGE_COUNTS} FROM hosts GROUP BY 1",
        "usage_by_node": f"WITH {_HOSTS} SELECT host_name, count(DISTINCT organization_name) AS organizations, {_NODE_COUNTS} FROM hosts GROUP BY 1",
        "usage_by_node_org_detail": f"WITH {_HOSTS} SELECT host_name, count(DISTINCT organization_name) AS organizations, {_NODE_COUNTS}, {organizations} FROM hosts GROUP BY 1",
        "usage_by_node_per_org": f"WITH {_HOSTS} SELECT organization_name, host_name, {_NODE_COUNTS} FROM hosts GROUP BY 1, 2",
        "billing_by_organization": f"""WITH {_HOSTS} SELECT organization_name, '' AS mark_x, count(DISTINCT host_name) AS quantity_consumed, CAST(11.55 AS DOUBLE) AS unit_price,
  round(count(DISTINCT host_name) * 11.55, 2)::DOUBLE AS extended_unit_price FROM hosts GROUP BY 1""",
        "billing_total": f"""WITH {_HOSTS} SELECT 'Example' AS end_user_company_name, '' AS mark_x, 'Town' AS end_user_company_city, 'State' AS end_user_company_state,
  'Land' AS end_user_company_country, 'SKU1' AS sku_number, count(DISTINCT host_name) AS quantity_consumed, 'nodes' AS sku_description, CAST(11.55 AS DOUBLE) AS unit_price,
  round(count(DISTINCT host_name) * 11.55, 2)::DOUBLE AS extended_unit_price, '' AS notes FROM hosts HAVING count(DISTINCT host_name) > 0""",
        "org_filtered_usage": f"WITH {_HOSTS} SELECT organization_name, {_JOBS}, {_USAGE_COUNTS} FROM hosts WHERE organization_name IN ('AUTOMOBILE', 'BUILDING') GROUP BY 1",
        "content_rollup": f"WITH {_JOB_HOSTS}, {_EVENTS} SELECT * REPLACE (CAST(duration AS DOUBLE) AS duration) FROM content",
        "usage_by_collection": _by_content("collection_name"),
        "usage_by_role": _by_content("role_name"),
        "usage_by_module": _by_content("module_name"),
        "jobhost_extract": f"""WITH {_database("job_hosts", "jobs", "unified_jobs", "templates", "inventories", "organizations", "hosts")}
SELECT r.id, r.created, r.modified, r.host_name, r.host_id AS host_remote_id, {_variable(adapters.FIELDS.address)} AS host_variable, {_variable(adapters.FIELDS.connection)} AS connection_variable,
  r.changed, r.dark, r.failures, r.ok, r.processed, r.skipped, r.failed, r.ignored, r.rescued, u.created AS job_created, r.job_id AS job_remote_id,
  u.unified_job_template_id AS job_template_remote_id, u.name AS job_template_name, i.id AS inventory_remote_id, i.name AS inventory_name, o.id AS organization_remote_id, o.name AS organization_name,
  t.id AS project_remote_id, t.name AS project_name
FROM db_job_hosts r LEFT JOIN db_jobs j ON r.job_id = j.unifiedjob_ptr_id LEFT JOIN db_templates t ON t.id = j.project_id LEFT JOIN db_inventories i ON i.id = j.inventory_id
  LEFT JOIN db_unified_jobs u ON u.id = r.job_id LEFT JOIN db_organizations o ON o.id = u.organization_id LEFT JOIN db_hosts h ON h.id = r.host_id
WHERE r.modified >= TIMESTAMP '1996-01-01' AND r.modified < TIMESTAMP '1997-01-01'""",
        "jobevent_extract": _events_of("1990-01-01", "2010-01-01"),
        "jobevent_pruned": _events_of("1996-01-01", "1997-01-01"),
        "host_metric_extract": f"""WITH {_database("host_metrics", "hosts")}
SELECT m.hostname, coalesce(h.id, 0) AS host_id, m.first_automation, m.last_automation, m.automated_counter, m.deleted_counter, m.last_deleted, m.deleted,
  json_extract_string(h.facts, '$.{adapters.FIELDS.serial}') AS product_serial, json_extract_string(h.facts, '$.{adapters.FIELDS.machine}') AS machine_id,
  {_variable(adapters.FIELDS.address)} AS host_variable, {_variable(adapters.FIELDS.connection)} AS connection_variable
FROM db_host_metrics m LEFT JOIN db_hosts h ON h.name = m.hostname WHERE m.last_automation >= TIMESTAMP '1998-06-01'""",
        "host_dedup": f"WITH RECURSIVE {_NODES} SELECT * FROM nodes",
        "host_dedup_3": f"WITH RECURSIVE {_bounded(3)} SELECT * FROM nodes",
        "host_dedup_1": f"WITH RECURSIVE {_bounded(1)} SELECT * FROM nodes",
        "managed_nodes": f"WITH RECURSIVE {_NODES} SELECT * FROM nodes WHERE NOT deleted",
        "managed_nodes_ephemeral": f"WITH RECURSIVE {_NODES} SELECT * FROM nodes WHERE NOT deleted AND {_SHORT}",
        "managed_nodes_non_ephemeral": f"WITH RECURSIVE {_NODES} SELECT * FROM nodes WHERE NOT deleted AND NOT ({_SHORT})",
        "deleted_nodes": f"WITH RECURSIVE {_NODES} SELECT * FROM nodes WHERE deleted",
        "ephemeral_windows": f"WITH RECURSIVE {_NODES}, {_WINDOWS} SELECT * FROM usage",
        "renewal_summary": f"""WITH RECURSIVE {_NODES}, {_WINDOWS}
SELECT 0 AS position, 'Automated hosts' AS description, count(DISTINCT hostname) AS quantity_consumed FROM nodes WHERE NOT deleted AND NOT ({_SHORT})
UNION ALL SELECT 1, 'Ephemeral automated hosts total', count(DISTINCT hostname) FROM nodes WHERE NOT deleted AND {_SHORT}
UNION ALL SELECT 2, 'Ephemeral automated hosts maximum concurrent usage in defined interval', coalesce(max(ephemeral_hosts), 0) FROM usage
UNION ALL SELECT 3, 'Deleted Automated hosts', count(DISTINCT hostname) FROM nodes WHERE deleted""",
        "renewal_summary_plain": f"""WITH RECURSIVE {_NODES} SELECT 0 AS position, 'Automated hosts' AS description, count(DISTINCT hostname) AS quantity_consumed FROM nodes WHERE NOT deleted
UNION ALL SELECT 1, 'Deleted Automated hosts', count(DISTINCT hostname) FROM nodes WHERE deleted""",
        "exports_rollup": rollup,
        "reshipped_rollup": rollup,
        "exports_stream_rollup": rollup,
        "export_rejects": f"""WITH {_JOB_HOSTS} SELECT CAST(year(created) AS BIGINT) AS year, CAST(count(*) FILTER (WHERE year(created) <> 1999) AS BIGINT) AS n_rows,
  count(DISTINCT CASE WHEN year(created) = 1999 THEN install_uuid END) AS n_rejects FROM job_hosts GROUP BY 1""",
        "pruned_exports": f"""WITH {_JOB_HOSTS} SELECT install_uuid, organization_name, count(*) AS n_rows, CAST(sum(ok) AS BIGINT) AS ok FROM job_hosts
WHERE install_uuid = 'install-F' AND created >= TIMESTAMP '1996-01-01' AND created < TIMESTAMP '1998-01-01' GROUP BY 1, 2""",
        "usage_by_platform": f"""WITH {_JOB_HOSTS} SELECT install_uuid, CASE WHEN created < TIMESTAMP '1998-01-01' THEN '8' ELSE '9' END AS release, count(*) AS n_rows, CAST(sum(ok) AS BIGINT) AS ok
FROM job_hosts GROUP BY 1, 2""",
        "landed_period": f"""WITH {_JOB_HOSTS} SELECT organization_name, count(*) AS n_rows, CAST(sum(ok) AS BIGINT) AS ok FROM job_hosts
WHERE created >= TIMESTAMP '1996-01-01' AND created < TIMESTAMP '1997-01-01' GROUP BY 1""",
        "incremental_rollup": rollup,
        "gathered_slices": f"""WITH {_database("job_hosts")} SELECT greatest(date_trunc('day', modified), TIMESTAMP '1996-01-01 07:30:00') AS slice_start,
  least(date_trunc('day', modified) + INTERVAL 1 DAY, TIMESTAMP '1996-03-01') AS slice_end, count(*) AS n_rows, CAST(sum(ok) AS BIGINT) AS ok
FROM db_job_hosts WHERE modified >= TIMESTAMP '1996-01-01 07:30:00' AND modified < TIMESTAMP '1996-03-01' GROUP BY 1, 2""",
    }
