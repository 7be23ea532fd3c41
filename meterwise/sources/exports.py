"""Landed exports: a Spark data source for tarballs in day folders.

An installation lands {path}/data/YYYY/MM/DD/{install_uuid}-{since}-{until}.tar.gz with config.json and CSV files. Each
tarball is a partition; only the days asked for are listed, and members are read in memory, never unpacked to disk. Of a
CSV file only the columns asked for are made, all as texts. Of this engine's own shipments those count that the log of commits
has, see sinks.commits; tarballs of other exporters always do.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import lzma
import tarfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.columns import without_null_tokens
from ..sinks import commits
from ..sinks.commits import Name, Span, day_folder
from ..sinks.files import file_system, names_in, read_text
from .schemas import TABLES, columns_of, conformed, plain_name

#: Bytes of a CSV file that are parsed at once, and of a tarball's columns that are held until its end is known to be sound.
BLOCK, HELD = 4 << 20, 256 << 20
#: Days up to which each is listed without a look at which there are.
LISTED = 62
#: What a scan knows of a row's tarball; `error` says why a tarball is rejected, in a row of its own.
ORIGIN = {"install_uuid": "string", "shipment": "string", "slice_start": "timestamp_ntz", "slice_end": "timestamp_ntz", "slice_day": "date", "file": "string", "error": "string"}
#: The member with an installation's own document, which is read like a table of one row and column.
CONFIG = "config"
#: What is wrong with a tarball itself; any other error is the store's, and fails the task, which Spark repeats.
FORMAT_ERRORS = (tarfile.TarError, gzip.BadGzipFile, zlib.error, lzma.LZMAError, EOFError, csv.Error, pa.ArrowInvalid, ValueError, KeyError)


def members(tar: tarfile.TarFile) -> dict[str, tarfile.TarInfo]:
    """The JSON and CSV files of a tarball by their base names; names that leave the folder are refused."""
    safe = (m for m in tar.getmembers() if m.isfile() and m.name.endswith(("json", "csv")) and ".." not in m.name.split("/"))
    return {m.name.rpartition("/")[2]: m for m in safe}


@dataclass
class Tarball(InputPartition):
    file: str
    day: date
    name: Name | None


class Watched(io.RawIOBase):
    """A file that remembers the store's errors, as readers of tarballs may report them as faults of the format."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.failed = file, None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def _do(self, what, *args):
        try:
            return what(*args)
        except Exception as error:
            self.failed = error
            raise

    def read(self, size: int | None = -1) -> bytes:
        return self._do(self.file.read, None if size is None or size < 0 else size)

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, to: int, whence: int = 0) -> int:
        return self._do(self.file.seek, to, whence)

    def tell(self) -> int:
        return self.file.tell()


def csv_batches(open_member, names: Sequence[str], renamed: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    """The columns `names` of a CSV file as texts; those that it lacks are null. open_member opens it anew."""
    header = next(csv.reader(io.TextIOWrapper(open_member(), "utf-8", newline="")), [])
    there = {plain_name(name, renamed): name for name in header}
    used = [there[n] for n in names if n in there]
    if not used:
        return
    convert = arrow_csv.ConvertOptions(column_types=dict.fromkeys(header, pa.string()), include_columns=used, strings_can_be_null=False)
    parsed = arrow_csv.open_csv(open_member(), arrow_csv.ReadOptions(block_size=BLOCK), arrow_csv.ParseOptions(newlines_in_values=True), convert)
    for batch in parsed:
        yield pa.RecordBatch.from_arrays([batch.column(there[n]) if n in there else pa.nulls(batch.num_rows, pa.string()) for n in names], names=list(names))


def ragged_batches(open_member, names: Sequence[str], renamed: Mapping[str, str], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same row by row, for files whose rows have unlike lengths: what a row lacks is null, what it has beyond the header goes."""
    lines = csv.reader(io.TextIOWrapper(open_member(), "utf-8", newline=""))
    header = {plain_name(name, renamed): i for i, name in enumerate(next(lines, []))}
    at = [header.get(name) for name in names]
    held: list[list[str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] if i is not None and i < len(r) else None for r in held], pa.string()) for i in at], names=list(names))

    for row in lines:
        held.append(row)
        if len(held) == rows:
            yield batch()
            held = []
    if held:
        yield batch()


def _sound(tar: tarfile.TarFile, table: str, names: Sequence[str], renamed: Mapping[str, str], held: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table, once all of it has been parsed: from memory if they take at most `held` bytes, else parsed again."""
    inside = members(tar)
    config = tar.extractfile(inside["config.json"]).read().decode()
    install = json.loads(config)["install_uuid"]
    if table == CONFIG:
        yield pa.RecordBatch.from_pydict({CONFIG: [config], "install_uuid": [install]})
        return
    if f"{table}.csv" not in inside:
        return
    opened = lambda: tar.extractfile(inside[f"{table}.csv"])
    for parse in (csv_batches, ragged_batches):
        kept, size = [], 0
        try:
            for batch in parse(opened, names, renamed):
                size += batch.nbytes
                kept = [*kept, batch] if size <= held else []
            break
        except pa.ArrowInvalid:
            if parse is ragged_batches:
                raise
    for b in kept if size <= held else parse(opened, names, renamed):
        yield b.append_column("install_uuid", pa.repeat(pa.scalar(install, pa.string()), b.num_rows))


def rows_of(where: arrow_fs.FileSystem, tarball: Tarball, table: str, names: Sequence[str], renamed: Mapping[str, str], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """The rows of a tarball with ORIGIN, or one row with an error: a tarball that is broken or has no config gives no others,
    not even those before its fault. What the store fails to give raises."""
    span = tarball.name.span if tarball.name else None
    known = {"shipment": (tarball.name.shipment or None) if tarball.name else None, "slice_start": span and span.since, "slice_end": span and span.until, "slice_day": tarball.day, "file": tarball.file, "error": None}
    kinds = {"slice_start": pa.timestamp("us"), "slice_end": pa.timestamp("us"), "slice_day": pa.date32()}
    order = [*names, *ORIGIN]

    def whole(batch: pa.RecordBatch, **more) -> pa.RecordBatch:
        for name, value in {**known, **more}.items():
            batch = batch.append_column(name, pa.repeat(pa.scalar(value, kinds.get(name, pa.string())), batch.num_rows))
        return batch.select(order)

    with where.open_input_file(tarball.file) as file:
        watched, sent = Watched(file), False
        try:
            with tarfile.open(fileobj=io.BufferedReader(watched, 1 << 20), mode="r:*") as tar:
                for batch in _sound(tar, table, names, renamed, held):
                    sent = True
                    yield whole(batch)
        except FORMAT_ERRORS as error:
            if watched.failed:
                raise watched.failed from error
            if sent:  # it was sound a moment ago
                raise
            none = pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()) for _ in (*names, "install_uuid")], names=[*names, "install_uuid"])
            yield whole(none, error=f"{type(error).__name__}: {error}"[:1000])


def _days_there(path: str) -> list[date]:
    """The days that have a folder."""
    found = []
    for year in (y for y in names_in(f"{path}/data", folders=True) if y.isdigit()):
        for month in (m for m in names_in(f"{path}/data/{year}", folders=True) if m.isdigit()):
            found += [date(int(year), int(month), int(d)) for d in names_in(f"{path}/data/{year}/{month}", folders=True) if d.isdigit()]
    return sorted(found)


class _Scan:
    """What batch and stream readers share."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.table, self.names = options["path"].rstrip("/"), options["table"], names
        self.member = CONFIG if options.get("configs") else self.table
        self.renamed, self.held = json.loads(options.get("renamed", "{}")), int(options.get("held", HELD))

    def read(self, partition: Tarball) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from rows_of(file_system(self.path)[0], partition, self.member, self.names, self.renamed, self.held)

    def tarballs(self, folders: Mapping[date, commits.Folder], shipments: set[str] | None = None) -> list[Tarball]:
        """The tarballs that count, or those of some shipments."""
        _, root = file_system(self.path)
        found = []
        for day, folder in folders.items():
            shipped = (f for (_, shipment, _), files in folder.live.items() if shipments is None or shipment in shipments for f in files)
            found += [Tarball(f"{day_folder(root, day)}/{f}", day, Name.of(f)) for f in sorted((*shipped, *(folder.others if shipments is None else ())))]
        return found


class ExportReader(_Scan, DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        super().__init__(options, names)
        self.since, self.until = (date.fromisoformat(options[n]) if n in options else None for n in ("since", "until"))
        self.installs: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of install_uuid and slice_day choose tarballs by their names and folders; Spark applies all filters to the
        rows besides, as a config has the last word on its installation."""
        for f in filters:
            if getattr(f, "attribute", None) == ("install_uuid",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                given = set(f.value if isinstance(f, In) else [f.value])
                self.installs = given if self.installs is None else self.installs & given
            elif getattr(f, "attribute", None) == ("slice_day",):
                if isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual)) and f.value:
                    first = f.value + timedelta(days=isinstance(f, GreaterThan))
                    self.since = max(self.since or first, first)
                if isinstance(f, (EqualTo, EqualNullSafe, LessThan, LessThanOrEqual)) and f.value:
                    last = f.value - timedelta(days=isinstance(f, LessThan))
                    self.until = min(self.until or last, last)
            yield f

    def partitions(self) -> list[Tarball]:
        if self.since and self.until and (self.until - self.since).days < LISTED:
            days = [self.since + timedelta(days=n) for n in range((self.until - self.since).days + 1)]
        else:
            days = [d for d in _days_there(self.path) if (not self.since or d >= self.since) and (not self.until or d <= self.until)]
        wanted = lambda install, _: self.installs is None or install in self.installs
        return self.tarballs(commits.live_folders(self.path, days, self.table, wanted)) or [Tarball("", date.min, None)]


class ExportStream(_Scan, DataSourceStreamReader):
    """The tarballs of shipments in the order of their commits. An offset has the last record of each installation's log, so a
    checkpoint marks shipments, and its size does not grow with them."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        logs = {i: names_in(commits.log_folder(self.path, i)) for i in commits.installs(self.path)}
        return {i: names[-1] for i, names in logs.items() if names}

    def partitions(self, start: dict, end: dict) -> list[Tarball]:
        found = []
        for install, last in end.items():
            new = {s: n for s, n in commits.records(self.path, install).items() if start.get(install, "") < n <= last}
            texts = [json.loads(read_text(f"{commits.log_folder(self.path, install)}/{n}")) for n in new.values()]
            days = sorted({date.fromisoformat(d) for t in texts if t["table"] == self.table for d in t["days"]})
            found += self.tarballs(commits.live_folders(self.path, days, self.table, lambda i, _, own=install: i == own, end), set(new))
        return found or [Tarball("", date.min, None)]


class ExportSource(DataSource):
    """Options: path, table (job_host_summary, main_jobevent), since and until (days, both included; all by default), columns
    (those to read, separated by commas; all by default), renamed (JSON: an export's own column names to those of the
    schemas), held (bytes of a tarball that are kept in memory), configs (true: the configs of the table's tarballs)."""

    @classmethod
    def name(cls) -> str:
        return "usage_export"

    def _names(self) -> list[str]:
        if self.options.get("configs"):
            return [CONFIG]
        wanted = self.options.get("columns")
        return [name for name, _ in columns_of(TABLES[self.options["table"]]) if not wanted or name in wanted.split(",")]

    def schema(self) -> str:
        return ", ".join([*(f"{name} string" for name in self._names()), *(f"{n} {k}" for n, k in ORIGIN.items())])

    def reader(self, schema) -> ExportReader:
        return ExportReader(dict(self.options), self._names())

    def streamReader(self, schema) -> ExportStream:
        return ExportStream(dict(self.options), self._names())


def _scanned(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None, renamed: Mapping[str, str] | None, stream: bool = False, **bounds: date | None) -> DataFrame:
    spark.dataSource.register(ExportSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "table": table, "renamed": json.dumps(dict(renamed or {})), "columns": ",".join(columns or ()), **{n: d.isoformat() for n, d in bounds.items() if d}}
    kinds = [(n, k) for n, k in columns_of(TABLES[table]) if not columns or n in columns]
    raw = (spark.readStream if stream else spark.read).format("usage_export").options(**options).load()
    return conformed(without_null_tokens(raw, among=[n for n, _ in kinds]), ", ".join(f"{n} {k}" for n, k in [*kinds, *ORIGIN.items()]))


def scan_exports(spark: SparkSession, path: str, table: str, since: date | None = None, until: date | None = None, columns: Sequence[str] | None = None, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """read_exports with ORIGIN, and a row with an error for each tarball that is broken or lacks its config. Filters on
    install_uuid and slice_day choose the tarballs that are opened; without since and until all days are looked through."""
    return _scanned(spark, path, table, columns, renamed, since=since, until=until)


def stream_exports(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """scan_exports as a stream of the shipments that are committed, each once. A slice that a later shipment replaces after it
    has been streamed comes again with that shipment: see streaming.incremental."""
    return _scanned(spark, path, table, columns, renamed, stream=True)


def rejected(scan: DataFrame) -> DataFrame:
    """(file, slice_day, error) of the tarballs of a scan that could not be read."""
    return scan.where("error IS NOT NULL").select("file", "slice_day", "error")


def read_exports(spark: SparkSession, path: str, table: str, since: date, until: date, columns: Sequence[str] | None = None, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """A table of the exports that landed on the days from since to until, with the columns of its schema (or those of them
    in `columns`) and install_uuid.

    Texts that mean null in an export are null, and so is what does not fit its column. Rows are not filtered by their
    dates: the day of landing decides. renamed has an export's own names for columns. Broken tarballs give no rows.
    """
    scan = scan_exports(spark, path, table, since, until, columns, renamed)
    return scan.where("error IS NULL").select(*(c for c in scan.columns if c not in ORIGIN), "install_uuid")


def live_slices(spark: SparkSession, path: str, table: str, days: Sequence[date]) -> DataFrame:
    """(install_uuid, shipment, slice_start) of the slices that count now."""
    found = [(i, s, span.since) for folder in commits.live_folders(path, days, table).values() for i, s, span in folder.live]
    return spark.createDataFrame(found, "install_uuid string, shipment string, slice_start timestamp_ntz")


def read_configs(spark: SparkSession, path: str, table: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """(install_uuid, slice_start, config): the configs, as VARIANT, in the tarballs of a table that count; one for each slice, the
    greatest text where a slice's tarballs have several."""
    spark.dataSource.register(ExportSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bounds = {n: d.isoformat() for n, d in (("since", since), ("until", until)) if d}
    raw = spark.read.format("usage_export").options(path=path, table=table, configs="true", **bounds).load().where("error IS NULL")
    return raw.groupBy("install_uuid", "slice_start").agg(F.max(CONFIG).alias(CONFIG)).withColumn(CONFIG, F.try_parse_json(CONFIG))


def with_configs(scan: DataFrame, configs: DataFrame) -> DataFrame:
    """A scan with its installation's latest config that is not after the row's slice; null if there is none.

    The slices of the scan, far fewer than its rows, and the configs are put in order once, each slice takes the last config
    before it, and rows get it by their slice.
    """
    slices = scan.select("install_uuid", "slice_start").distinct()
    both = slices.withColumn("known", F.lit(None).cast("string")).unionByName(configs.select("install_uuid", "slice_start", F.to_json(CONFIG).alias("known")))
    upto = Window.partitionBy("install_uuid").orderBy("slice_start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("latest", F.last("known", ignorenulls=True).over(upto)).groupBy("install_uuid", "slice_start").agg(F.max("latest").alias("latest"))
    joined = scan.alias("s").join(found.alias("f"), F.col("s.install_uuid").eqNullSafe(F.col("f.install_uuid")) & F.col("s.slice_start").eqNullSafe(F.col("f.slice_start")), "left")
    return joined.select("s.*", F.try_parse_json("latest").alias(CONFIG))
