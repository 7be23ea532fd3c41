"""Events pruned by day, database reads cut at quantiles, configs as of a slice, and rollups read once."""

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterwise.operators import rollups, usage
from meterwise.options import HostFields, Settings
from meterwise.plans import gather
from meterwise.sinks import landing
from meterwise.sinks.commits import Span
from meterwise.sources import extract
from meterwise.sources.exports import read_configs, scan_exports, with_configs

DAY = datetime(2024, 1, 1)


def jobs(spark, days=10):
    """A job a day, with a host and two events."""
    moment = "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id AS int))"
    runs = spark.range(days).selectExpr("id", f"{moment} AS created", f"{moment} + interval 1 hour AS modified", "id AS job_id", "concat('h', id) AS host_name", "id AS host_id")
    unified = spark.range(days).selectExpr("id", f"{moment} AS created")
    events = spark.range(2 * days).withColumn("n", F.expr("id DIV 2")).selectExpr("id", moment.replace("cast(id", "cast(n") + " AS job_created", "job_created AS created", "job_created AS modified", "'runner_on_ok' AS event",
        "'{\"task_action\": \"a\"}' AS event_data", "false AS failed", "true AS changed", "'p' AS playbook", "'y' AS play", "'t' AS task", "'r' AS role", "n AS job_id", "n AS host_id", "concat('h', n) AS host_name")
    return {"job_hosts": runs, "unified_jobs": unified, "events": events}


@pytest.mark.parametrize("grain", ["day", "month"])
def test_only_the_days_of_the_jobs_are_read(spark, tmp_path, grain):
    """Files of other days are spoilt, which only who reads them notices; the plan prunes when it runs."""
    db = jobs(spark, 70)
    landing.land_events(db["events"], f"file://{tmp_path}/e", grain)
    since, until = datetime(2024, 2, 1), datetime(2024, 2, 4)
    want = sorted(r.id for r in extract.job_events(db, since, until).collect())
    read = {**db, "events": spark.read.parquet(f"file://{tmp_path}/e")}
    spoilt = [f for f in (tmp_path / "e").glob("*/*.parquet") if not re.search(r"2024-02-0[123]" if grain == "day" else "2024-02", str(f))]
    for f in spoilt:
        f.write_bytes(b"spoilt")
    found = extract.job_events(read, since, until)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in found.collect()) == want and len(want) == 6 and len(spoilt) >= (60 if grain == "day" else 2)


def test_database_parts_are_even_though_keys_are_not(spark):
    """Ids of a month that lie close together at the end of a table with few others."""
    url, driver = "jdbc:derby:memory:meterwise;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(400).selectExpr("CASE WHEN id < 40 THEN id * 1000003 ELSE 90000000 + id END AS id", "CASE WHEN id < 40 THEN timestamp'2023-05-01' ELSE timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int)) END AS modified", "concat('h', id) AS host_name")
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS id, timestamp'2024-01-02' AS modified, 'none' AS host_name"))
    try:
        rows.write.mode("overwrite").jdbc(url, "runs", properties=driver)
    except Exception as error:
        if "ClassNotFound" in str(error) or "No suitable driver" in str(error):
            pytest.skip("Derby is not there")
        raise
    month = extract.within("modified", DAY, datetime(2024, 2, 1))
    for where in (month, "1 = 1"):
        parts = extract.jdbc_table(spark, url, "runs", "id", 8, where, **driver)
        sizes = [r.n for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        want = rows.where("modified >= '2024-01-01' AND modified < '2024-02-01'" if where == month else "true")
        assert sorted(map(str, parts.select("id", "host_name").collect())) == sorted(map(str, want.select("id", "host_name").collect()))
        assert 7 <= len(sizes) <= 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert extract.jdbc_table(spark, url, "runs", "id", 8, "1 = 0", **driver).count() == 0
    db = extract.jdbc_database(spark, url, {"job_hosts": "runs"}, 4, DAY, datetime(2024, 1, 10), **driver)
    assert db["job_hosts"].count() == rows.where("modified >= '2024-01-01' AND modified < '2024-01-10'").count()
    assert "PushedFilters" in db["job_hosts"].where("host_name = 'none'")._jdf.queryExecution().executedPlan().toString()


def test_rows_have_the_config_of_their_time(spark, tmp_path):
    path, settings = str(tmp_path), Settings(HostFields("a", "b", "c", "d"), install_uuid="i")
    rows = spark.range(10).selectExpr("id", "concat('h', id) AS host_name", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id AS int)) AS modified")
    for first, last, version in ((0, 4, "1"), (4, 10, "2")):
        span = Span(DAY + timedelta(days=first), DAY + timedelta(days=last))
        part = gather.sliced(rows.where(f"id >= {first} AND id < {last}"), "modified", span.since, span.until)
        gather.ship({"job_host_summary": part}, Settings(settings.host_fields, install_uuid="i", config={"licence": {"version": version}}), path, {"job_host_summary": span})
    scan, configs = scan_exports(spark, path, "job_host_summary"), read_configs(spark, path, "job_host_summary")
    version = F.try_variant_get("config", "$.licence.version", "string").alias("version")
    assert {r.id: r.version for r in with_configs(scan, configs).select("id", version).collect()} == {i: "1" if i < 4 else "2" for i in range(10)}
    some = configs.where("slice_start IN (timestamp_ntz'2024-01-03', timestamp_ntz'2024-01-08')")
    assert {r.id: r.version for r in with_configs(scan, some).select("id", version).collect()} == {i: None if i < 2 else "1" if i < 7 else "2" for i in range(10)}
    first = configs.select(F.try_variant_get("config", "$.platform.system", "string"), F.try_variant_get("config", "$.install_uuid", "string")).first()
    assert first[0] and first[1] == "i" and with_configs(scan, configs.limit(0)).where("config IS NOT NULL").count() == 0
    assert read_configs(spark, path, "job_host_summary", date(2030, 1, 1), date(2030, 1, 2)).count() == 0


def test_two_counts_take_one_scan(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('o', id % 3) AS organization_name", "concat('t', id % 5) AS job_template_name", "IF(id % 11 = 0, NULL, concat('h', id % 7)) AS host_name", "CAST(NULL AS string) AS host_variable", "'u' AS install_uuid", "IF(id % 13 = 0, NULL, id % 17) AS job_remote_id",
        "1L AS dark", "0L AS failures", "id AS ok", "0L AS skipped", "0L AS ignored", "0L AS rescued", "timestamp_ntz'2024-01-01' AS created", "timestamp_ntz'2024-01-01' AS job_created")
    rows.write.parquet(f"file://{tmp_path}/r")
    rollup = rollups.host_rollup(spark.read.parquet(f"file://{tmp_path}/r"))
    found = usage.by_job(rollup)
    got = {(r.organization_name, r.job_template_name): tuple(r)[2:6] for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    kept = rollup.collect()
    for key, (job_runs, unique, runs, tasks) in got.items():
        own = [r for r in kept if (r.organization_name, r.job_template_name) == key]
        assert job_runs == len({(r.job_remote_id, r.install_uuid) for r in own}) and unique == len({r.host_name for r in own} - {None})
        assert runs == sum(r.host_name is not None for r in own) and tasks == sum(r.task_runs for r in own)
