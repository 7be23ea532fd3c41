"""Shipments that count once, what failed ones leave, filters and streams of exports, and the state of gatherings."""

import io
import json
import os
import tarfile
from datetime import date, datetime, timedelta

import pyarrow as pa
import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from meterwise.options import HostFields, Settings
from meterwise.plans import gather, registry, state
from meterwise.sinks import commits, landing
from meterwise.sinks.commits import Span
from meterwise.sinks.files import create_text, names_in
from meterwise.sources import exports
from meterwise.sources.exports import live_slices, read_exports, rejected, scan_exports
from meterwise.streaming.incremental import gather_exports, streamed_rollup

DAY = datetime(2024, 1, 1)
NOON = DAY + timedelta(hours=12)


def moments(spark, n=10, begin=DAY, hours=2):
    rows = [(i, f"h{i}", begin + timedelta(hours=hours * i)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, host_name string, modified timestamp_ntz")


def ship(table, path, since, until, install="i", **how):
    rows = table.where((F.col("modified") >= F.lit(since).cast("timestamp_ntz")) & (F.col("modified") < F.lit(until).cast("timestamp_ntz")))
    cut = gather.sliced(rows, "modified", since, until)
    return landing.ship_slices(cut.withColumn("id", F.col("id").cast("string")), path, "job_host_summary", install, covers=[Span(since, until)], **how)


def hosts(spark, path, since=date(2024, 1, 1), until=date(2024, 1, 9)):
    return sorted(r.host_name for r in read_exports(spark, path, "job_host_summary", since, until).collect())


def test_a_period_shipped_twice_counts_once(spark, tmp_path):
    """With another end, with other cuts, and with less rows than before; a slice of another installation stays."""
    path, rows = f"file://{tmp_path}", moments(spark)
    ship(rows, path, DAY, NOON, rows=2)
    assert hosts(spark, path) == [f"h{i}" for i in range(6)]
    ship(rows.where("id < 3"), path, DAY, NOON, install="j")
    ship(rows, path, DAY, DAY + timedelta(days=1))
    assert hosts(spark, path) == sorted([f"h{i}" for i in range(10)] + ["h0", "h1", "h2"])
    ship(rows.where("id > 7"), path, DAY, DAY + timedelta(days=1), rows=1)
    assert hosts(spark, path) == ["h0", "h1", "h2", "h8", "h9"]
    ship(rows.limit(0), path, DAY, DAY + timedelta(days=2))
    assert hosts(spark, path) == ["h0", "h1", "h2"]


def test_slices_that_follow_each_other_stay_and_parts_are_refused(spark, tmp_path):
    path, rows = str(tmp_path), moments(spark, 20)
    ship(rows, path, DAY, NOON)
    ship(rows, path, NOON, DAY + timedelta(days=2))
    assert len(hosts(spark, path)) == 20
    with pytest.raises(commits.PartlyShipped):
        ship(rows, path, DAY + timedelta(hours=6), DAY + timedelta(days=1))
    ship(rows, path, DAY, DAY + timedelta(days=1))
    assert len(hosts(spark, path)) == 20


def test_a_shipment_that_fails_half_way_adds_nothing(spark, tmp_path):
    path, rows = str(tmp_path), moments(spark)
    texts = gather.sliced(rows.withColumn("host_name", F.when(F.col("id") < 8, F.col("host_name")).otherwise(F.raise_error(F.lit("gone")))), "modified", DAY, DAY + timedelta(days=1))
    with pytest.raises(Exception, match="gone"):
        landing.ship_slices(texts, path, "job_host_summary", "i", rows=1, covers=[Span(DAY, DAY + timedelta(days=1))])
    landing.write_slices(gather.sliced(rows, "modified", DAY, DAY + timedelta(days=1)), path, "job_host_summary", "i", "0" * 32).collect()
    assert len(list((tmp_path / "data/2024/01/01").glob("*.tar.gz"))) > 0 and hosts(spark, path) == []
    # and so does one whose manifests are there, but not its record
    commits.write_manifest(path, date(2024, 1, 1), commits.Manifest("i", "job_host_summary", "0" * 32, (), {Span(DAY, NOON): tuple(names_in(f"{path}/data/2024/01/01"))}))
    assert hosts(spark, path) == []
    ship(rows, path, DAY, DAY + timedelta(days=1))
    assert len(hosts(spark, path)) == 10


def test_filters_choose_tarballs_by_name(spark, tmp_path):
    path = f"file://{tmp_path}"
    for install in ("i", "j", "k"):
        ship(moments(spark, 30, hours=4), path, DAY, DAY + timedelta(days=5), install=install)
    scan = scan_exports(spark, path, "job_host_summary")
    opened = lambda df: df.rdd.getNumPartitions()
    assert opened(scan) == 15
    one = scan.where("install_uuid = 'i' AND slice_day >= DATE '2024-01-02' AND slice_day < DATE '2024-01-04'")
    assert opened(one) == 2 and {(r.install_uuid, r.slice_day) for r in one.collect()} == {("i", date(2024, 1, 2)), ("i", date(2024, 1, 3))}
    assert opened(scan.where("install_uuid IN ('i', 'k') AND slice_day = DATE '2024-01-05'")) == 2
    assert opened(read_exports(spark, path, "job_host_summary", date(2024, 1, 1), date(2024, 1, 3)).where("install_uuid = 'j'")) == 3
    assert scan.where("install_uuid = 'nobody'").count() == 0 and scan.where("slice_day > DATE '2030-01-01'").count() == 0


def tar_of(members, cut=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()[:cut]


def test_broken_tarballs_are_rejected_with_their_errors(spark, tmp_path):
    folder = tmp_path / "data/2024/01/01"
    folder.mkdir(parents=True)
    text, config = "host_name,dark\n" + "".join(f"h{i},{i}\n" for i in range(2000)), '{"install_uuid": "i"}'
    whole = {"config.json": config, "job_host_summary.csv": text}
    files = {
        "whole": tar_of(whole), "short": tar_of(whole, 3000), "text": b"no tarball", "empty": b"", "none": tar_of({"job_host_summary.csv": text}),
        "config": tar_of({**whole, "config.json": "{"}), "other": tar_of({**whole, "config.json": "{}"}), "i-2024-01-01-000000-2024-99-01-000000": tar_of(whole), "events": tar_of({"config.json": config}),
    }
    for name, data in files.items():
        (folder / f"{name}.tar.gz").write_bytes(data)
    scan = scan_exports(spark, str(tmp_path), "job_host_summary", date(2024, 1, 1), date(2024, 1, 1), ("host_name",))
    found = {r.file.rpartition("/")[2][:-7]: r.error for r in rejected(scan).collect()}
    assert found.keys() == {"short", "text", "empty", "none", "config", "other"} and "config.json" in found["none"]
    assert len(hosts(spark, str(tmp_path))) == 4000



def test_errors_of_the_store_fail_the_read(tmp_path):
    """Also when the reader of tarballs takes them for a fault of the format."""
    good = tmp_path / "a.tar.gz"
    good.write_bytes(tar_of({"config.json": '{"install_uuid": "i"}', "job_host_summary.csv": "host_name\n" + "x\n" * 200_000}))
    tarball = exports.Tarball(str(good), date(2024, 1, 1), None)

    class Store:
        def __init__(self, fails_at):
            self.fails_at = fails_at

        def open_input_file(self, name):
            store, file = self, open(name, "rb")  # noqa: SIM115

            class File:
                def read(self, size=None):
                    if file.tell() >= store.fails_at:
                        raise OSError("503 Slow Down")
                    return file.read(-1 if size is None else min(size, 100))

                def seek(self, to, whence=0):
                    return file.seek(to, whence)

                def tell(self):
                    return file.tell()

                def __enter__(self):
                    return self

                def __exit__(self, *error):
                    file.close()

            return File()

    for at in (0, 100, 400):
        with pytest.raises(OSError, match="503"):
            list(exports.rows_of(Store(at), tarball, "job_host_summary", ["host_name"], {}))
    held, again = (sum(b.num_rows for b in exports.rows_of(arrow_fs.LocalFileSystem(), tarball, "job_host_summary", ["host_name"], {}, held)) for held in (1 << 30, 10))
    assert held == again == 200_000


def test_a_stream_takes_shipments_once(spark, tmp_path):
    path, target, mark = str(tmp_path / "shipped"), f"file://{tmp_path}/target", f"file://{tmp_path}/mark"
    rows = moments(spark, 20)

    def total():
        gather_exports(spark, path, target, mark).awaitTermination()
        return streamed_rollup(spark, path, target).agg(F.sum("host_runs")).first()[0]

    ship(rows, path, DAY, NOON)
    assert total() == 6 and total() == 6
    ship(rows, path, NOON, DAY + timedelta(days=1), install="j")
    ship(rows, path, DAY, DAY + timedelta(days=1))  # replaces what has been streamed
    assert total() == 12 + 6
    folder = tmp_path / "shipped/data/2024/01/01"
    file = next(x for x in folder.glob("j-*.tar.gz"))
    file.write_bytes(file.read_bytes()[:50])
    ship(rows, path, DAY + timedelta(days=1), DAY + timedelta(days=2))
    assert total() == 20 + 6
    assert live_slices(spark, path, "job_host_summary", [date(2024, 1, 1)]).count() == 2


FIELDS = HostFields("a", "b", "c", "d")


def test_each_table_has_its_own_mark(spark, tmp_path):
    path, settings = str(tmp_path), Settings(FIELDS, install_uuid="i")
    spans = {"job_host_summary": Span(DAY, NOON), "main_jobevent": Span(DAY, NOON)}
    rows = gather.sliced(moments(spark), "modified", DAY, NOON).where("modified < '2024-01-01 12:00:00'")
    fails = rows.withColumn("host_name", F.raise_error(F.lit("gone")).cast("string"))
    with pytest.raises(Exception, match="gone"):
        gather.ship({"job_host_summary": fails, "main_jobevent": rows}, settings, path, spans)
    assert gather.last_gathered(path, "i") == {"main_jobevent": NOON}
    assert gather.intervals(path, settings, None, NOON, NOON).keys() == {"job_host_summary"}
    assert gather.ship({"job_host_summary": rows}, settings, path, spans)["job_host_summary"][1] == 6
    assert gather.last_gathered(path, "i") == {"main_jobevent": NOON, "job_host_summary": NOON}
    later = gather.intervals(path, settings, None, None, DAY + timedelta(days=1))
    assert later == dict.fromkeys(("job_host_summary", "main_jobevent"), Span(NOON, DAY + timedelta(days=1)))
    with pytest.raises(ValueError, match="all tables"):
        gather.intervals(path, settings, None, NOON, NOON)


def test_one_of_two_gatherings_stops(spark, tmp_path):
    path, now = str(tmp_path), [DAY]
    clock = lambda: now[0]
    rows = gather.sliced(moments(spark), "modified", DAY, NOON)
    with state.lease(path, "i") as first:
        with pytest.raises(state.GatheringElsewhere):
            gather.ship({"job_host_summary": rows}, Settings(FIELDS, install_uuid="i"), path, {"job_host_summary": Span(DAY, NOON)})
        first.mark("job_host_summary", NOON)
    with state.lease(path, "j", clock) as first:
        now[0] += state.LEASE
        with state.lease(path, "j", clock) as second:
            with pytest.raises(state.GatheringElsewhere):
                first.mark("job_host_summary", NOON)
            second.mark("job_host_summary", NOON)
            first.end()
            assert state.load(path, "j").holder
    assert state.load(path, "i").marks == {"job_host_summary": NOON} and not state.load(path, "j").holder


def test_state_changes_by_compare_and_set(tmp_path):
    path = str(tmp_path)
    raced = []

    def slow(before):
        if not raced:
            raced.append(state.change(path, "i", lambda s: state.replace(s, marks={**s.marks, "a": DAY})))
        return state.replace(before, marks={**before.marks, "b": NOON})

    assert state.change(path, "i", slow).marks == {"a": DAY, "b": NOON}
    for n in range(40):
        state.change(path, "i", lambda s, n=n: state.replace(s, marks={**s.marks, "n": DAY + timedelta(hours=n)}))
    assert state.load(path, "i").version == 42 and len(names_in(f"{path}/gathered/i")) == state.KEPT
    assert create_text(f"{path}/once", "a") and not create_text(f"{path}/once", "b") and (tmp_path / "once").read_text() == "a"
    assert json.loads((tmp_path / "gathered/i/00000042.json").read_text())["marks"]["a"] == DAY.isoformat()


def test_rows_of_slices_in_any_order_make_one_tarball_each(spark, tmp_path):
    """A tarball is written from its CSV file, which leaves memory once it is large."""
    rows = moments(spark, 40, hours=24).withColumn("id", F.pmod("id", F.lit(2))).coalesce(1)
    slices = {"slice_start": F.timestamp_add("DAY", "id", F.lit(DAY)).cast("timestamp_ntz"), "slice_end": F.timestamp_add("DAY", F.col("id") + 1, F.lit(DAY)).cast("timestamp_ntz")}
    files = landing.ship_slices(rows.withColumns(slices).withColumn("id", F.col("id").cast("string")), f"file://{tmp_path}", "job_host_summary", "i").collect()
    assert sorted(f.rows for f in files) == [20, 20] and len(hosts(spark, f"file://{tmp_path}")) == 40
    part = landing._Part(pa.schema({"host_name": pa.string()}))
    part.add(pa.RecordBatch.from_pydict({"host_name": ["h" * 100] * (landing.SPOOLED // 100)}))
    assert part.text._rolled


def test_a_slice_is_dealt_to_several_tasks_unless_it_is_to_be_whole(spark, tmp_path):
    rows = spark.range(2_000).select(F.lit(DAY).cast("timestamp_ntz").alias("created"), F.col("id").alias("job_remote_id"), F.lit("h").alias("host_name"), F.lit(1).alias("ok"), F.lit("install-F").alias("install_uuid"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for whole in (False, True):
            registry._shipped(rows, f"file://{tmp_path}/{whole}", whole=whole)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {whole: len(list(tmp_path.glob(f"{whole}/data/**/*.tar.gz"))) for whole in (False, True)}
    assert files == {False: 4, True: 1}


def shuffled(spark):
    """Bytes of shuffle files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return sum(os.path.getsize(f) for f in files if "/shuffle_" in f and os.path.exists(f))


def test_shipping_leaves_tarballs_only(spark, tmp_path):
    """Neither the shuffle files of a shipment nor the stored rows stay on disk; tarballs have the rows of a job together."""
    rows = spark.range(20_000).select(F.lit(DAY).cast("timestamp_ntz").alias("created"), F.pmod("id", F.lit(50)).alias("job_remote_id"), F.concat(F.lit("h"), "id").alias("host_name"), F.lit(1).alias("ok"), F.lit("install-F").alias("install_uuid"))
    before = shuffled(spark)
    with registry._stored(rows.repartition(3), f"file://{tmp_path}/exports") as stored:
        registry._shipped(stored, f"file://{tmp_path}/exports")
        assert (tmp_path / "exports/stored").exists()
    assert sorted(x.name for x in (tmp_path / "exports").iterdir()) == ["data", "log"] and shuffled(spark) < before + 10_000
    found = read_exports(spark, f"file://{tmp_path}/exports", "job_host_summary", date(2024, 1, 1), date(2024, 1, 1), ("job_remote_id", "host_name"))
    assert found.count() == found.distinct().count() == 20_000
    assert all(r[0] == sorted(r[0]) for r in found.groupBy(F.spark_partition_id()).agg(F.collect_list("job_remote_id")).select("collect_list(job_remote_id)").collect())


def test_a_stream_reads_tarballs_once_and_keeps_no_copy(spark, tmp_path, monkeypatch):
    path, target = str(tmp_path / "shipped"), f"file://{tmp_path}/target"
    ship(moments(spark, 20), path, DAY, NOON)
    ship(moments(spark, 20), path, NOON, DAY + timedelta(days=1), install="j")
    file = next((tmp_path / "shipped/data/2024/01/01").glob("j-*.tar.gz"))
    file.write_bytes(file.read_bytes()[:50])
    monkeypatch.setattr(type(spark.range(1)), "persist", None)
    before = shuffled(spark)
    gather_exports(spark, path, target, f"file://{tmp_path}/mark").awaitTermination()
    assert shuffled(spark) <= before
    assert [r.file.rpartition("/")[2] for r in spark.read.parquet(f"{target}/rejects").collect()] == [file.name]
    rollup = streamed_rollup(spark, path, target)
    assert rollup.agg(F.sum("host_runs"), F.count("*")).first() == (6, 6)
    assert "SortMergeJoin" not in rollup._jdf.queryExecution().executedPlan().toString()
