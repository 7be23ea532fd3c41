import io
import json
import os
import tarfile
import zipfile
from datetime import date, datetime
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from meterwise import cli
from meterwise.operators import hosts, rollups
from meterwise.options import OPTIONAL_SHEETS, SHEETS, BadSetting, MissingSetting, ReportOptions, Settings
from meterwise.plans import gather, registry, reports
from meterwise.sinks import landing, xlsx
from meterwise.sinks.commits import Span
from meterwise.sources import adapters, extract
from meterwise.sources.exports import read_exports
from meterwise.sources.schemas import TABLES, columns_of, conformed, plain_name
from meterwise.streaming import incremental

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in adapters.TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def csv_of(df, table):
    """df with the names and nulls of an export's CSV."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


def test_exports_round_trip_and_report(spark, tmp_path):
    rows = adapters.job_hosts(spark, SF).where("install_uuid = 'install-F'").drop("install_uuid").limit(200).persist()
    since, until = datetime(2024, 2, 5), datetime(2024, 2, 6)
    files = landing.ship_tarballs(csv_of(rows, "job_host_summary"), f"file://{tmp_path}", "job_host_summary", "install-F", since, until, rows=70).collect()
    assert sum(f.rows for f in files) == 200 and len(files) >= 3 and all("/data/2024/02/05/install-F-" in f.file for f in files)
    folder = tmp_path / "data/2024/02/05"
    (folder / "broken.tar.gz").write_bytes(b"no tarball")
    read = lambda a, b: read_exports(spark, f"file://{tmp_path}", "job_host_summary", a, b)
    back = read(date(2024, 2, 1), date(2024, 2, 29))
    assert back.columns == [n for n, _ in columns_of(TABLES["job_host_summary"])] + ["install_uuid"]
    keys = rollups.HOST_KEYS
    want = sorted(map(str, rollups.host_rollup(rows.withColumn("install_uuid", F.lit("install-F"))).select(*keys, "task_runs").collect()))
    assert sorted(map(str, rollups.host_rollup(back).select(*keys, "task_runs").collect())) == want
    assert read(date(2024, 3, 1), date(2024, 3, 2)).count() == 0
    args = cli.parser().parse_args(["report", "company", "--path", str(tmp_path), "--month", "2024-02", "--price", "2.5", "--sheets", ",".join((*SHEETS, *OPTIONAL_SHEETS))])
    assert cli.build_report(spark, args, datetime(2024, 3, 1)) and not cli.build_report(spark, args, datetime(2024, 3, 1))
    file = tmp_path / "reports/2024/02/company-2024-02.xlsx"
    with zipfile.ZipFile(file) as book:
        titles = [e.attrib["name"] for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]
        assert titles[:4] == ["Usage Reporting", "Jobs", "Managed nodes", "Usage by organizations"] and "BUILDING" in titles
        first = book.read("xl/worksheets/sheet1.xml").decode()
        assert "<f>G8*I8</f>" in first and "<f>G13*I13</f>" in first and "<f>SUM(J8:J13)</f>" in first


def test_provider_and_renewal_reports(spark, tmp_path):
    options = ReportOptions(month=date(1996, 1, 1), now=datetime(2003, 1, 15), price_per_node=1.0)
    tables = reports.provider_report(registry._hosts(spark, SF), rollups.content_rollup(adapters.job_events(spark, SF)), options)
    assert list(tables) == ["Usage Reporting", "Managed nodes", "Usage by collections", "Usage by roles", "Usage by modules"]
    assert reports.save_report(f"{tmp_path}/r.xlsx", reports.workbook("provider", tables, options))
    reports.save_tables(tables, f"file://{tmp_path}/tables")
    assert spark.read.parquet(f"file://{tmp_path}/tables/managed_nodes").count() == tables["Managed nodes"].count()
    metrics = adapters.host_metrics(spark, SF)
    plain_ = ReportOptions(since=date(1996, 1, 1), until=date(1997, 1, 1), now=datetime(2003, 1, 15))
    assert list(reports.renewal_report(metrics, plain_)) == ["Usage Reporting", "Managed nodes", "Deleted Managed nodes"]
    short = ReportOptions(since=date(1996, 1, 1), until=date(1997, 1, 1), now=datetime(2003, 1, 15), ephemeral_days=30)
    assert list(reports.renewal_report(metrics, short))[1:] == ["Managed nodes", "Managed nodes ephemeral", "Managed nodes ephemeral usage", "Deleted Managed nodes"]
    with pytest.raises(ValueError):
        reports.renewal_report(metrics, options)
    with pytest.raises(ValueError):
        ReportOptions(sheets=("nonsense",))


def test_landed_tables_are_pruned(spark, tmp_path):
    rows = adapters.job_hosts(spark, SF).limit(100)
    landing.land(rows, f"file://{tmp_path}/t", F.col("created"))
    found = landing.landed(spark.read.parquet(f"file://{tmp_path}/t"), date(1996, 1, 1), date(1996, 12, 31))
    assert found.count() == rows.where("year(created) = 1996").count()
    assert "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().executedPlan().toString()


def test_new_files_are_gathered_once(spark, tmp_path):
    rows = adapters.job_hosts(spark, SF).persist()
    source, target, mark = (f"file://{tmp_path}/{n}" for n in ("source", "target", "mark"))
    for n in range(2):
        rows.where(F.pmod("job_remote_id", F.lit(2)) == n).write.mode("append").parquet(source)
        incremental.gather_new(spark, source, target, mark, rows.schema).awaitTermination()
    incremental.gather_new(spark, source, target, mark, rows.schema).awaitTermination()
    whole = rollups.host_rollup(rows)
    merged = rollups.merged_host_rollups(spark.read.parquet(target).drop("batch")).select(whole.columns)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_hourly_usage(spark, tmp_path):
    rows = adapters.job_hosts(spark, SF)
    rows.write.parquet(f"file://{tmp_path}/s")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/s")
    query = incremental.hourly_usage(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(task_runs) FROM hours").first()[0] == rollups.host_rollup(rows).agg(F.sum("task_runs")).first()[0]


def test_sheets(tmp_path):
    sheet = xlsx.Sheet("a/b" * 20, iter([xlsx.styled(["x & <y>", 1, 2.5, None, True, date(2024, 1, 1), "=HYPERLINK(1)", "\x01z", xlsx.Formula("A1")], "bold")]))
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert xlsx.sheet_titles(["a", "A", "x" * 40, "x" * 40]) == ["a", "A_2", "x" * 31, "x" * 29 + "_2"]
    xlsx.write_workbook(tmp_path / "b.xlsx", [sheet, xlsx.Sheet("two")])
    with zipfile.ZipFile(tmp_path / "b.xlsx") as book:
        for name in book.namelist():
            ElementTree.fromstring(book.read(name))
        first = book.read("xl/worksheets/sheet1.xml")
        assert b"<v>45292.0</v>" in first and b"<f>A1</f>" in first and b">=HYPERLINK(1)</t>" in first and first.count(b"<f>") == 1


def test_names_of_columns():
    own = {"x_host_variable": "host_variable"}
    assert [plain_name(c, own) for c in ("x_host_variable", "host_name", "y_host_variable", "main_jobhostsummary_id")] == ["host_variable", "host_name", "y_host_variable", "job_host_id"]


def cells(file, sheet):
    """The cells of a sheet: texts, numbers, and formulas with their equals sign."""
    name = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(file) as book:
        number = [e.attrib["name"] for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{name}sheet")].index(sheet) + 1
        found = {}
        for c in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{name}c"):
            formula, value, text = c.find(f"{name}f"), c.find(f"{name}v"), c.find(f"{name}is/{name}t")
            found[c.attrib["r"]] = f"={formula.text}" if formula is not None else float(value.text) if value is not None else text.text or ""
    return found


SETTINGS = {"host_fields": {"address": "host_address", "connection": "host_connection", "serial": "serial_number", "machine": "machine_number"}, "install_uuid": "install-X"}


@pytest.fixture(scope="module")
def relations(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("relations")
    for name, table in adapters.database(spark, SF).items():
        table = table.withColumn("id", F.xxhash64("hostname")) if name == "host_metrics" else table
        table.write.parquet(f"file://{folder}/{name}")
    (folder / "settings.json").write_text(json.dumps(SETTINGS))
    return folder


def test_from_relations_to_workbooks(spark, relations, tmp_path):
    now = datetime(1996, 4, 1)
    base = ["--relations", f"file://{relations}", "--path", f"file://{tmp_path}", "--settings", str(relations / "settings.json")]
    parse = cli.parser().parse_args
    planned = cli.gather_period(spark, parse(["gather", *base, "--since", "1996-02-01", "--until", "1996-03-01", "--dry-run"]), now)
    assert not (tmp_path / "data").exists() and len(planned) > 20
    sent = cli.gather_period(spark, parse(["gather", *base, "--since", "1996-02-01", "--until", "1996-03-01", "--ship"]), now)
    rows = spark.read.parquet(f"file://{relations}/job_hosts").where("modified >= '1996-02-01' AND modified < '1996-03-01'")
    assert f"{rows.count()} rows" in sent[0] and sum(int(x.split()[-2]) for x in planned if x.startswith("job_host")) == rows.count()
    last = gather.last_gathered(f"file://{tmp_path}", "install-X")
    assert last["job_host_summary"] == datetime(1996, 3, 1)
    assert gather.interval(last["job_host_summary"], None, None, datetime(1996, 3, 5)) == Span(datetime(1996, 3, 1), datetime(1996, 3, 5))
    assert gather.interval(last["job_host_summary"], None, None, now).since == now - gather.HORIZON
    assert all((tmp_path / f"data/1996/02/{d:02}").is_dir() for d in (1, 15, 29))
    with pytest.raises(gather.NothingGathered):
        cli.gather_period(spark, parse(["gather", *base, "--since", "1980-02-01", "--until", "1980-03-01", "--ship"]), now)
    more = ["--month", "1996-02", "--price", "2.5", "--sku", "S1", "--sku-description", "nodes", "--title", "Bill", "--company", "Ours", "--email", "a@b", "--login", "us", "--po-number", "PO7", "--end-user-name", "=Theirs", "--business-leader", "B", "--procurement-leader", "P"]
    assert cli.build_report(spark, parse(["report", "company", "--path", f"file://{tmp_path}", *more, "--sheets", "summary,managed_nodes,jobs,managed_nodes_by_organizations"]), now)
    hosts_ = rollups.host_rollup(read_exports(spark, f"file://{tmp_path}", "job_host_summary", date(1996, 2, 1), date(1996, 2, 29)))
    nodes = hosts_.select("host_name").distinct().count()
    found = cells(tmp_path / "reports/1996/02/company-1996-02.xlsx", "Usage Reporting")
    want = {"A1": "Bill", "H1": "Updated: Apr 01, 1996", "A2": "Company name", "B2": "Ours", "I2": "Grand total", "J2": "=SUM(J8:J13)", "A3": "Email", "B3": "a@b", "A4": "Login", "B4": "us", "E4": "PO number", "F4": "PO7", "A5": "Report period", "B5": "1996-02",
            "A7": "End user company name", "G7": "Quantity consumed", "A8": "=Theirs", "F8": "S1", "G8": float(nodes), "H8": "nodes", "I8": 2.5, "J8": "=G8*I8", **{f"J{n}": f"=G{n}*I{n}" for n in range(9, 14)}}
    assert {k: found.get(k) for k in want} == want
    with zipfile.ZipFile(tmp_path / "reports/1996/02/company-1996-02.xlsx") as book:
        assert b"<f>Theirs" not in book.read("xl/worksheets/sheet1.xml")
    managed = cells(tmp_path / "reports/1996/02/company-1996-02.xlsx", "Managed nodes")
    assert managed["C1"] == "Job runs" and managed["A1"] == "Host name"
    jobs = cells(tmp_path / "reports/1996/02/company-1996-02.xlsx", "Jobs")
    assert jobs["E1"] == "Non-unique managed nodes automated"
    one = hosts_.select(F.min("organization_name")).first()[0]
    assert cells(tmp_path / "reports/1996/02/company-1996-02.xlsx", one)["B1"] == "Job runs"
    assert cli.build_report(spark, parse(["report", "provider", "--path", f"file://{tmp_path}", *more, "--sheets", "summary"]), now)
    found = cells(tmp_path / "reports/1996/02/provider-1996-02.xlsx", "Usage Reporting")
    organizations = hosts_.select("organization_name").distinct().count()
    last = 17 + organizations
    want = {"A1": "Bill", "A3": "Monthly payment", "A6": "Company name", "B6": "Ours", "A9": "Report period", "B10": "B", "B11": "P", "B12": "Report is submitted monthly", "A13": "SKU", "A14": "S1", "B14": "nodes", "G14": 2.5, "A16": "Organization name",
            "E17": "=C17*D17", f"A{last}": "Sum of monthly payment", f"E{last}": f"=SUM(E17:E{last - 1})"}
    assert {k: found.get(k) for k in want} == want
    renewal = ["report", "renewal", "--path", f"file://{tmp_path}", "--relations", f"file://{relations}", "--settings", str(relations / "settings.json"), "--since", "1990-01-01", "--until", "2003-01-01", "--ephemeral", "30d"]
    assert cli.build_report(spark, parse(renewal), datetime(2003, 1, 1))
    found = cells(tmp_path / "reports/1990/01/renewal-1990-01-01--2003-01-01.xlsx", "Usage Reporting")
    metrics = hosts.numbered(extract.host_metrics(adapters.database(spark, SF), datetime(1990, 1, 1), adapters.FIELDS))
    assert found["A5"] == "Automated hosts" and found["B5"] == hosts.lasting_nodes(hosts.managed_nodes(metrics), 30, datetime(2003, 1, 1)).count()
    assert cli.build_report(spark, parse([*renewal[:-2], "--tables"]), datetime(2003, 1, 1)) is False  # the workbook is there
    assert cli.build_report(spark, parse([*renewal[:-2], "--tables", "--force"]), datetime(2003, 1, 1))
    assert spark.read.parquet(f"file://{tmp_path}/reports/1990/01/renewal-1990-01-01--2003-01-01/usage_reporting").count() == 2


def test_wrong_settings_and_places(spark, relations, tmp_path):
    parse = cli.parser().parse_args
    with pytest.raises(BadSetting):
        cli.build_report(spark, parse(["report", "company", "--path", "ftp://x/y"]), datetime(2024, 1, 1))
    with pytest.raises(MissingSetting):
        cli.build_report(spark, parse(["report", "renewal", "--path", str(tmp_path)]), datetime(2024, 1, 1))
    with pytest.raises(MissingSetting):
        gather.gathered({}, Settings(), {"job_host_summary": Span(datetime(2024, 1, 1), datetime(2024, 1, 2))})
    with pytest.raises(BadSetting):
        gather.interval(None, datetime(2024, 1, 2), datetime(2024, 1, 2), datetime(2024, 1, 3))
    for text, error in (('{"host_fields": {"address": "a"}}', MissingSetting), ('{"x": 1}', BadSetting), ('{"tables": ["x"]}', BadSetting)):
        with pytest.raises(error):
            Settings.of(text)
    args = parse(["gather", "--relations", "jdbc:x:y", "--path", str(tmp_path), "--settings", str(relations / "settings.json"), "--ship"])
    with pytest.raises(MissingSetting, match="relations"):
        cli.gather_period(spark, args, datetime(2024, 1, 1))
    with pytest.raises(SystemExit):
        parse(["gather", "--relations", "r", "--path", "p", "--settings", "s", "--ship", "--dry-run"])


def test_reports_go_to_any_file_system(spark, monkeypatch):
    from pyarrow import fs as arrow_fs

    from meterwise.sinks import files

    memory, _ = arrow_fs.FileSystem.from_uri("mock:///")
    monkeypatch.setattr(files, "file_system", lambda path: (memory, path.split("://", 1)[1].lstrip("/")))
    monkeypatch.setattr(reports, "file_system", files.file_system)
    file = reports.report_file("s3a://bucket/usage/", "company", date(2024, 2, 1), None, None)
    assert file == "s3a://bucket/usage/reports/2024/02/company-2024-02.xlsx"
    assert reports.save_report(file, [xlsx.Sheet("one", [xlsx.styled(["x"])])]) and not reports.save_report(file, [])
    with memory.open_input_file("bucket/usage/reports/2024/02/company-2024-02.xlsx") as source:
        assert cells(io.BytesIO(source.read()), "one") == {"A1": "x"}


def tar_of(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))


def test_members_of_tarballs(spark, tmp_path):
    folder = tmp_path / "data/2024/05/01"
    folder.mkdir(parents=True)
    config = '{"install_uuid": "i1"}'
    tar_of(folder / "a.tar.gz", {"./config.json": config, "./job_host_summary.csv": 'host_name,own_variable,dark,more\n"a\nb",x,1,9\nNA,,,\n'})
    tar_of(folder / "ragged.tar.gz", {"config.json": config, "job_host_summary.csv": "host_name,dark\nshort\nlong,2,3\n"})
    tar_of(folder / "outside.tar.gz", {"config.json": config, "../job_host_summary.csv": "host_name\nevil\n"})
    tar_of(folder / "other.tar.gz", {"config.json": config, "job_host_summary.txt": "host_name\nno\n"})
    tar_of(folder / "none.tar.gz", {"job_host_summary.csv": "host_name\nno\n"})
    day = date(2024, 5, 1)
    found = read_exports(spark, f"file://{tmp_path}", "job_host_summary", day, day, ("host_name", "host_variable", "dark"), {"own_variable": "host_variable"})
    assert found.columns == ["host_name", "host_variable", "dark", "install_uuid"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a\nb", "x", 1, "i1"), (None, None, None, "i1"), ("short", None, None, "i1"), ("long", None, 2, "i1")], key=str)


def test_tarballs_are_cut_by_size_and_slice(spark, tmp_path):
    rows = [(i, f"h{i}", datetime(2024, 1, 1 + i // 40, 5)) for i in range(100)]
    table = spark.createDataFrame(rows, "id long, host_name string, modified timestamp_ntz")
    cut = gather.sliced(table, "modified", datetime(2024, 1, 1, 3), datetime(2024, 1, 3, 6))
    files = landing.ship_slices(cut, f"file://{tmp_path}", "job_host_summary", "i", most_bytes=1).collect()
    assert sum(f.rows for f in files) == 100 and {f.file.split("/data/")[1][:10] for f in files} == {"2024/01/01", "2024/01/02", "2024/01/03"}
    assert any("i-2024-01-01-030000-2024-01-02-000000-" in f.file for f in files) and any("2024-01-03-000000-2024-01-03-060000" in f.file for f in files)
    assert max(f.rows for f in landing.ship_slices(cut, f"file://{tmp_path}/b", "job_host_summary", "i", rows=7).collect()) == 7


def test_moments_keep_their_wall_time(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02 03:04:05.678", "2024-01-02T03:04:05+00:00", "2024-01-02 03:04:05+00", "2024-01-02 03:04:05+02:00", "no", ""]
    rows = conformed(spark.createDataFrame([(t,) for t in texts], "created string"), "created timestamp_ntz").collect()
    moment = datetime(2024, 1, 2, 3, 4, 5)
    assert [r.created for r in rows] == [moment, datetime(2024, 1, 2, 3, 4, 5, 678000), moment, moment, moment, None, None]


def test_parts_of_shuffles_and_scans_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(adapters, "PART_ROWS", 500)
    settings = {n: spark.conf.get(n, None) for n in ("spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum", "spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rollups.host_rollup(adapters.job_hosts(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() >= 6_000 // 500
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == adapters.MERGED
        adapters.in_parts(spark, 1)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == parts
    finally:
        for name, value in settings.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
