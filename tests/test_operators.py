import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterwise.functions.dates import sliding_windows
from meterwise.operators import components, hosts, rollups, usage

T0 = datetime(2024, 1, 1)
HOST_SCHEMA = "organization_name string, job_template_name string, host_name string, host_variable string, install_uuid string, job_remote_id long, dark long, failures long, ok long, skipped long, ignored long, rescued long, created timestamp_ntz, job_created timestamp_ntz"


def host_rows():
    row = lambda org, template, host, variable, job, ok, hours: (org, template, host, variable, "u1", job, 0, 0, ok, 0, 0, 0, T0 + timedelta(hours=hours), T0)
    return [row("o1", "t", "h1", None, 1, 5, 0), row("o1", "t", "h1", None, 1, 2, 5), row(None, None, "h1", "real", 2, None, 1), row("o2", "t", "h2", None, None, 3, 2), row("o2", "t", None, None, 3, 1, 2)]


def test_host_rollup_keeps_nulls_and_counts_their_sums_as_zero(spark):
    out = {(r.organization_name, r.host_name, r.job_remote_id): r for r in rollups.host_rollup(spark.createDataFrame(host_rows(), HOST_SCHEMA)).collect()}
    assert len(out) == 4
    first = out["o1", "h1", 1]
    assert (first.host_runs, first.task_runs, first.first_automation, first.last_automation) == (2, 7, T0, T0 + timedelta(hours=5))
    assert out["No organization name", "real", 2].task_runs == 0 and out["No organization name", "real", 2].original_host_name == "h1"
    assert out["o2", None, 3].host_runs == 0
    older = spark.createDataFrame(host_rows(), HOST_SCHEMA).drop("host_variable")
    assert "real" not in {r.host_name for r in rollups.host_rollup(older).collect()}


def test_batches_do_not_matter(spark):
    rows = spark.createDataFrame(host_rows() * 3, HOST_SCHEMA)
    whole = sorted(map(str, rollups.host_rollup(rows).collect()))
    parts = rollups.host_rollup(rows.where("ok > 2")).unionByName(rollups.host_rollup(rows.where("NOT ok > 2 OR ok IS NULL")))
    assert sorted(map(str, rollups.merged_host_rollups(parts).select(rollups.host_rollup(rows).columns).collect())) == whole


def test_a_host_run_is_a_rollup_row_and_jobs_with_nulls_count(spark):
    rollup = rollups.host_rollup(spark.createDataFrame(host_rows(), HOST_SCHEMA))
    by = {r.organization_name: r for r in usage.by_organization(rollup).collect()}
    assert (by["o1"].job_runs, by["o1"].host_runs_unique, by["o1"].host_runs, by["o1"].task_runs) == (1, 1, 1, 7)
    assert (by["o2"].job_runs, by["o2"].host_runs) == (2, 1)
    assert usage.organization_names(rollup) == ["No organization name", "o1", "o2"]
    wide = {r.host_name: r for r in usage.with_organization_columns(usage.by_node_with_organizations(rollup, ["o1", "o2"]), 2).collect()}
    swapped = {r.host_name: r.last_automations for r in usage.by_node_with_organizations(rollup, ["none", "o2", "x", "o1", "y"]).collect()}
    assert swapped["h1"] == [None, None, None, T0 + timedelta(hours=5), None] and swapped[None] == [None] * 5 and swapped["h2"][1] is not None
    assert wide["h1"].org_0 == T0 + timedelta(hours=5) and wide["h1"].org_1 is None and wide[None].org_1 is None
    assert usage.of_organizations(rollup, None).count() == 4 and usage.of_organizations(rollup, ["o1"]).count() == 1
    assert usage.billing_total(rollup.limit(0), 1.5).count() == 0
    bill = usage.billing_total(rollup, 2.0).first()
    assert (bill.quantity_consumed, bill.extended_unit_price) == (3, 6.0)


EVENTS = "host_name string, job_remote_id long, install_uuid string, duration double, task_action string, resolved_action string, resolved_role string, role string"


def test_content(spark):
    rows = [("h1", 2, "u1", 1.5, "a.b.c", None, None, "x.y"), ("h1", 2, "u1", None, "a.b.c", None, None, "x.y"), ("h2", 9, "u1", 2.0, "m", "a.b.d", "n.c.r", None), (None, 1, "u1", 1.0, "m", None, None, None), ("h2", 9, "u1", 1.0, None, "a.b.c", None, None), ("h2", 9, "u1", 1.0, "shell", None, None, "?")]
    content = rollups.content_rollup(spark.createDataFrame(rows, EVENTS))
    got = {(r.host_name, r.module_name, r.collection_name, r.role_name): (r.task_runs, r.duration) for r in content.collect()}
    assert got == {("h1", "a.b.c", "a.b", "x.y"): (2, 1.5), ("h2", "a.b.d", "a.b", "n.c.r"): (1, 2.0), ("h2", "shell", "No collection used", "No role used"): (1, 1.0)}
    hosts_ = rollups.host_rollup(spark.createDataFrame(host_rows(), HOST_SCHEMA))
    mapped = rollups.with_real_hosts(content, hosts_)
    assert {r.host_name for r in mapped.collect()} == {"real", "h2"} and mapped.count() == 3
    usage_ = {r.collection_name: r for r in usage.by_content(mapped, "collection_name").collect()}
    assert (usage_["a.b"].host_runs_unique, usage_["a.b"].host_runs, usage_["a.b"].task_runs, usage_["a.b"].duration) == (2, 2, 3, 3.5)


def test_the_last_of_several_names_counts(spark):
    row = lambda org, template, variable: (org, template, "h", variable, "u", 1, 0, 0, 1, 0, 0, 0, T0, T0)
    rollup = rollups.host_rollup(spark.createDataFrame([row("a", "z", "v1"), row("b", "a", "v2"), row("b", None, "v0"), row("b", "c", "v3")], HOST_SCHEMA))
    content = spark.createDataFrame([("h", "m", "c", "r", "u", 1, 1, 0.0)], "host_name string, module_name string, collection_name string, role_name string, install_uuid string, job_remote_id long, task_runs long, duration double")
    assert rollups.with_real_hosts(content, rollup).first().host_name == "v0"


METRICS = "idx long, hostname string, host_variable string, product_serial string, machine_id string, deleted boolean, first_automation timestamp_ntz, last_automation timestamp_ntz, automated_counter long, deleted_counter long, last_deleted timestamp_ntz"


def metric(idx, host, variable=None, serial=None, machine=None, deleted=False, first=0, last=0):
    return (idx, host, variable, serial, machine, deleted, T0 + timedelta(days=first), T0 + timedelta(days=last), 1, 0, None)


CASES = [("abc", "111", ("v11", "v21"), ("h11", "h21")), ("abc", "111", ("v11", "v21"), ("h11", "h21")), ("", "111", ("v11", "v21"), ("h11", "h21")), ("", "222", ("v11", "v21"), ("h11", "h21")), ("def", "", ("v11", "v21"), ("h11", "h21")),
         ("abc", "1234", ("v11", "v21"), ("h11", "h21")), ("abc", "12345", ("v51", "v61"), ("h51", "h61")), ("abc", "12345", ("v11", "v51"), ("h11", "v51")), ("", "", ("v11",), ("h11",)), ("", "", (None,), ("h11",))]


def test_ten_ways_to_be_the_same_node(spark):
    rows = [(h, v, s, m) for s, m, vs, hs in CASES for v, h in zip(vs, hs, strict=True)]
    random.Random(1).shuffle(rows)
    metrics = spark.createDataFrame([metric(i, h, v, s, m) for i, (h, v, s, m) in enumerate(rows)], METRICS)
    nodes = hosts.managed_nodes(metrics).collect()
    assert len(nodes) == 1 and nodes[0].automated_counter == len(rows) and nodes[0].record_count == 5


def test_missing_identifiers_link_nothing_but_na_is_an_address(spark):
    rows = [metric(0, "a", "", "NA", "NA"), metric(1, "b", "", "NA", "NA"), metric(2, "c", "NA"), metric(3, "d", "NA"), metric(4, None), metric(5, None)]
    nodes = hosts.managed_nodes(spark.createDataFrame(rows, METRICS)).collect()
    assert sorted(n.group_id for n in nodes) == [0, 1, 2, 4, 5]


def test_a_long_chain_is_one_node_and_a_live_name_stands_for_it(spark):
    rows = [metric(i, f"h{i}", f"v{i}", f"s{i // 2}", f"m{(i + 1) // 2}", deleted=i != 7, first=i, last=i) for i in range(40)]
    rows += [metric(100, "x", deleted=True, last=3), metric(101, "y", "z", deleted=True, last=3), metric(102, "w", "z", deleted=True, last=3)]
    nodes = {n.group_id: n for n in hosts.managed_nodes(spark.createDataFrame(rows, METRICS)).collect()}
    assert set(nodes) == {0, 100, 101}
    assert (nodes[0].hostname, nodes[0].deleted, nodes[0].record_count, nodes[0].record_count_active, nodes[0].days_automated) == ("h7", False, 40, 1, 39)
    assert (nodes[101].hostname, nodes[101].deleted, nodes[101].hostnames) == ("w", True, "w, y")
    assert hosts.deleted(hosts.managed_nodes(spark.createDataFrame(rows, METRICS))).count() == 2


def test_empty_metrics(spark):
    assert hosts.managed_nodes(spark.createDataFrame([], METRICS)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_ephemeral_windows_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [metric(i, f"h{i % 17}", first=(a := rng.randrange(-5, 40)), last=a + rng.randrange(0, 12)) for i in range(60)] + [metric(99, None, first=1, last=2)]
    nodes = spark.createDataFrame(rows, METRICS).withColumn("days_automated", F.lit(0))
    windows = sliding_windows(spark, T0.date(), (T0 + timedelta(days=70)).date(), 5)
    got = {r.window_start: r.ephemeral_hosts for r in hosts.ephemeral_usage(nodes, windows).collect()}
    want = {r.window_start: len({x[1] for x in rows if x[1] and x[7] >= r.window_start and x[6] <= r.window_end}) for r in windows.collect()}
    assert got == want and 0 in got.values() and max(got.values()) > 3
    assert hosts.ephemeral_usage(nodes, windows.limit(0)).count() == 0


def bounded_brute(rows, iterations):
    """Lookups row after row, each over all rows."""
    clean = {r[0]: (r[1], r[2] or None, None if r[3] in ("", "NA") else r[3], None if r[4] in ("", "NA") else r[4]) for r in rows}
    done, groups = set(), {}
    for idx in sorted(clean):
        if idx in done:
            continue
        found = {idx}
        for _ in range(iterations):
            for k in range(4):
                values = {clean[i][k] for i in found} - {None}
                found |= {i for i, c in clean.items() if c[k] in values}
        groups[idx] = found
        done |= found
    return {(g, i) for g, found in groups.items() for i in found}


def test_bounded_lookups_equal_brute_force(spark):
    """Chains that the bound cuts, so that groups overlap, hubs, and rows without names."""
    rng = random.Random(4)
    pick = lambda p, n: f"{p}{rng.randrange(n)}" if rng.random() < 0.5 else rng.choice(("", "NA", None))
    rows = [metric(i, f"h{rng.randrange(20)}" if i % 9 else None, pick("v", 16), pick("s", 16), pick("m", 16)) for i in range(24)]
    rows += [metric(100 + i, f"c{i}", f"cv{i // 2}", f"cs{(i + 1) // 2}") for i in rng.sample(range(8), 8)]
    rows += [metric(200 + i, f"hub{i}", None, None, "one") for i in range(12)] + [metric(300, "x", "NA"), metric(301, "y", "NA")]
    got = {(r.group_id, r.idx) for r in hosts.bounded_groups(hosts.identified(spark.createDataFrame(rows, METRICS)), 1).collect()}
    assert got == bounded_brute(rows, 1) and len(got) > len(rows)


def test_bounded_lookups_over_the_ten_cases_and_none(spark):
    rows = [(h, v, s, m) for s, m, vs, hs in CASES for v, h in zip(vs, hs, strict=True)]
    rows = [metric(i, h, v, s, m) for i, (h, v, s, m) in enumerate(rows)]
    nodes = hosts.managed_nodes(spark.createDataFrame(rows, METRICS), iterations=3).collect()
    assert len(nodes) == 1 and nodes[0].automated_counter == len(rows)
    assert hosts.managed_nodes(spark.createDataFrame([], METRICS), iterations=3).count() == 0


def test_a_node_of_very_many_names_has_short_rows(spark):
    metrics = spark.range(100_000).selectExpr("id AS idx", "concat('a rather long host name, number ', id) AS hostname", "concat('v', id % 7) AS host_variable", "'' AS product_serial", "'image' AS machine_id",
                                              "id % 2 = 0 AS deleted", "timestamp_ntz'2024-01-01' AS first_automation", "timestamp_ntz'2024-01-02' AS last_automation", "1L AS automated_counter", "0L AS deleted_counter", "CAST(NULL AS timestamp_ntz) AS last_deleted")
    nodes = hosts.managed_nodes(metrics).collect()
    assert len(nodes) == 1 and nodes[0].record_count == 100_000 and nodes[0].record_count_active == 50_000 and nodes[0].host_variables == "v0, v1, v2, v3, v4, v5, v6"
    assert len(nodes[0].hostnames.split(", a ")) == hosts.NAMES and len(str(nodes[0])) < 1 << 20
    rows = hosts.identified(metrics)
    members = hosts.node_members(metrics, hosts.node_groups(rows))
    assert {r.kind: r.n for r in members.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"hostnames": 100_000, "host_variables": 7, "machine_ids": 1}
