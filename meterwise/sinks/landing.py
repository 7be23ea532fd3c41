"""Where gathered tables land: tarballs in day folders, or Parquet partitioned by day."""

from __future__ import annotations

import io
import itertools
import json
import tarfile
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import checkpointed, shuffles_removed
from . import commits
from .commits import Manifest, Span, day_folder
from .files import file_system

#: What a tarball holds at most: rows, and bytes of its columns in memory.
ROWS, BYTES = 100_000, 64 << 20
#: Tarballs that a task has open at once, bytes of each that are held in memory, and how hard they are compressed.
OPEN, SPOOLED, LEVEL = 128, 1 << 20, 6


class _Part:
    """A tarball in the making: its CSV file, on the task's disk once it is more than SPOOLED bytes."""

    def __init__(self, schema: pa.Schema):
        self.text, self.rows, self.size = tempfile.SpooledTemporaryFile(SPOOLED), 0, 0
        self.csv = arrow_csv.CSVWriter(self.text, schema)

    def add(self, rows: pa.RecordBatch) -> None:
        self.csv.write_batch(rows)
        self.rows, self.size = self.rows + rows.num_rows, self.size + rows.nbytes

    def write(self, out, table: str, config: bytes) -> None:
        self.csv.close()
        length = self.text.tell()
        self.text.seek(0)
        with self.text, tarfile.open(fileobj=out, mode="w|gz", compresslevel=LEVEL) as tar:
            for name, data, size in (("config.json", io.BytesIO(config), len(config)), (f"{table}.csv", self.text, length)):
                info = tarfile.TarInfo(name)
                info.size = size
                tar.addfile(info, data)


def _by_slice(batch: pa.RecordBatch) -> Iterator[tuple[tuple[datetime, datetime], pa.RecordBatch]]:
    """The rows of each slice in a batch."""
    ends = [batch.column(batch.schema.get_field_index(c)) for c in ("slice_start", "slice_end")]
    _, first, of = np.unique(np.column_stack([e.cast(pa.int64()).to_numpy(zero_copy_only=False) for e in ends]), axis=0, return_index=True, return_inverse=True)
    for n, i in enumerate(first):
        yield tuple(e[int(i)].as_py() for e in ends), batch if len(first) == 1 else batch.take(pa.array(np.flatnonzero(of.reshape(-1) == n)))


def write_slices(df: DataFrame, path: str, table: str, install_uuid: str, shipment: str, rows: int = ROWS, most_bytes: int = BYTES, config: dict | None = None) -> DataFrame:
    """The first phase of ship_slices: the tarballs of a shipment, which do not count yet. (slice_start, slice_end, file, rows) when
    evaluated; an attempt of a task that fails leaves files that are not among them.

    Rows go to the CSV file of their slice as they come, so a task holds a batch and no tarball, however large."""
    document = json.dumps({**(config or {}), "install_uuid": install_uuid}).encode()
    names = [c for c in df.columns if c not in ("slice_start", "slice_end")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = file_system(path)
        numbers, open_ = itertools.count(), {}

        def write(slice_: tuple[datetime, datetime]) -> pa.RecordBatch:
            folder, task, part = day_folder(root, slice_[0].date()), TaskContext.get(), open_.pop(slice_)
            name = commits.tarball_name(install_uuid, Span(*slice_), table, shipment, f"{task.partitionId()}-{task.taskAttemptId()}-{next(numbers)}")
            where.create_dir(folder, recursive=True)
            with where.open_output_stream(f"{folder}/{name}", compression=None) as out:
                part.write(out, table, document)
            start, end = (pa.array([x], pa.timestamp("us")) for x in slice_)
            return pa.RecordBatch.from_arrays([start, end, pa.array([f"{folder}/{name}"]), pa.array([part.rows], pa.int64())], names=["slice_start", "slice_end", "file", "rows"])

        for batch in batches:
            for slice_, found in _by_slice(batch) if batch.num_rows else ():
                left = found.select(names)
                while left.num_rows:
                    part = open_[slice_] = open_.pop(slice_, None) or _Part(left.schema)  # the last one used is the last in order
                    now = left.slice(0, rows - part.rows)
                    part.add(now)
                    left = left.slice(now.num_rows)
                    if part.rows >= rows or part.size >= most_bytes:
                        yield write(slice_)
                    elif len(open_) > OPEN:
                        yield write(next(iter(open_)))
        for slice_ in list(open_):
            yield write(slice_)

    return df.mapInArrow(run, "slice_start timestamp_ntz, slice_end timestamp_ntz, file string, rows long")


def ship_slices(df: DataFrame, path: str, table: str, install_uuid: str, rows: int = ROWS, most_bytes: int = BYTES, covers: Sequence[Span] | None = None, config: dict | None = None) -> DataFrame:
    """Ships df, which has the columns slice_start and slice_end beside those of the table, as tarballs with the installation's
    config: each of one slice, of at most `rows` rows or about `most_bytes` bytes, in the folder of the slice's first day.

    All tarballs count at once, when the shipment is committed, or none; those of the same table whose slices lie in what
    the shipment covers (the slices themselves, if `covers` is not given) count no more. PartlyShipped is raised where a
    slice would be replaced only in part. Rows of a slice that do not follow each other make more tarballs only where a task has
    more than OPEN slices at once. Returns (file, rows).
    """
    shipment = uuid.uuid4().hex
    if covers:
        commits.refuse_parts(path, install_uuid, table, covers)
    with shuffles_removed(df.sparkSession):
        written = checkpointed(write_slices(df, path, table, install_uuid, shipment, rows, most_bytes, config))
    spans = list(covers) if covers else [Span(*r) for r in written.select("slice_start", "slice_end").distinct().collect()]
    if not covers:
        commits.refuse_parts(path, install_uuid, table, spans)
    days: set[date] = set()
    listed = (r for r in written.orderBy("slice_start", "slice_end", "file").toLocalIterator())
    for day, found in itertools.groupby(listed, lambda r: r.slice_start.date()):
        slices = {span: tuple(r.file.rpartition("/")[2] for r in some) for span, some in itertools.groupby(found, lambda r: Span(r.slice_start, r.slice_end))}
        touching = [s for s in spans if day in (s.since.date(), *commits.days_of(s))] if covers else list(slices)
        commits.write_manifest(path, day, Manifest(install_uuid, table, shipment, tuple(touching), slices))
        days.add(day)
    for day, folder in commits.live_folders(path, sorted({d for s in spans for d in commits.days_of(s)} - days), table, lambda i, _: i == install_uuid).items() if covers else ():
        if folder.live:  # what was there is replaced by nothing
            commits.write_manifest(path, day, Manifest(install_uuid, table, shipment, tuple(s for s in spans if day in commits.days_of(s)), {}))
            days.add(day)
    if days:
        commits.commit(path, install_uuid, table, shipment, days)
    return written.select("file", "rows")


def ship_tarballs(df: DataFrame, path: str, table: str, install_uuid: str, since: datetime, until: datetime, rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """df as tarballs of one slice, from since to until: see ship_slices."""
    slice_ = {"slice_start": F.lit(since).cast("timestamp_ntz"), "slice_end": F.lit(until).cast("timestamp_ntz")}
    return ship_slices(df.withColumns(slice_), path, table, install_uuid, rows, most_bytes, [Span(since, until)])


def land(df: DataFrame, path: str, day: Column, mode: str = "errorifexists") -> None:
    """df as Parquet in folders year=/month=/day=, so that a filter on them prunes. mode overwrite replaces only days of df."""
    parts = {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}
    writer = df.withColumns(parts).repartition(*parts).write.partitionBy(*parts).mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def landed(df: DataFrame, since: date, until: date) -> DataFrame:
    """The rows of a landed table of the days from since to until, by its folders."""
    number = F.col("year") * 10_000 + F.col("month") * 100 + F.col("day")
    return df.where(number.between(since.year * 10_000 + since.month * 100 + since.day, until.year * 10_000 + until.month * 100 + until.day))


def land_events(events: DataFrame, path: str, grain: str = "day") -> None:
    """Events as Parquet in folders job_day= (or job_month=, with its first day), of their job's creation, by which
    sources.extract.job_events prunes. A folder with a large share of all events is dealt to several tasks."""
    name = f"job_{grain}"
    rows = events.withColumn(name, F.to_date(F.date_trunc(grain, "job_created")))
    rows.repartitionByRange(name, "job_id", "id").write.partitionBy(name).parquet(path)
