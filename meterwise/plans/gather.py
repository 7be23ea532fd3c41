"""Gathering: the tables of a period, taken from a controller's relations and shipped as tarballs of a day each."""

from __future__ import annotations

import platform
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..options import OPTIONAL_TABLES, BadSetting, MissingSetting, Settings
from ..sinks.commits import Span
from ..sinks.landing import BYTES, ROWS, ship_slices
from ..sources import extract
from . import state

#: How far back a gathering begins that knows of none before.
HORIZON = timedelta(weeks=4)


class NothingGathered(ValueError):
    """A period has no rows."""


def last_gathered(path: str, install: str) -> Mapping[str, datetime]:
    """For each table the moment up to which earlier gatherings of an installation have shipped it to path."""
    return state.load(path, install).marks


def interval(last: datetime | None, since: datetime | None, until: datetime | None, now: datetime) -> Span:
    """The period of a gathering: without since it goes on where the last one ended, but begins HORIZON before its end at most."""
    until = min(until or now, now)
    if since is None:
        since = max(last or until - HORIZON, until - HORIZON)
    if since >= until:
        raise BadSetting(f"nothing lies between {since} and {until}")
    return Span(since, until)


def intervals(path: str, settings: Settings, since: datetime | None, until: datetime | None, now: datetime) -> dict[str, Span]:
    """The period of each table that the settings ask for. A table that an earlier gathering has shipped up to the end asked for
    is not among them, unless since is given."""
    marks = last_gathered(path, settings.install_uuid) if settings.install_uuid else {}
    end = min(until or now, now)
    names = [n for n in COLLECTORS if n not in OPTIONAL_TABLES or n in settings.tables]
    open_ = [n for n in names if since is not None or n not in marks or marks[n] < end]
    if not open_:
        raise BadSetting(f"all tables are shipped up to {end}")
    return {n: interval(marks.get(n), since, until, now) for n in open_}


def sliced(table: DataFrame, moment: str, since: datetime, until: datetime) -> DataFrame:
    """table with slice_start and slice_end: the day of `moment`, cut to the period. Rows of a day follow each other, and a large
    day is dealt to several tasks."""
    low, high, day = F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz"), F.date_trunc("day", moment).cast("timestamp_ntz")
    rows = table.withColumns({"slice_start": F.greatest(day, low), "slice_end": F.least(day + F.expr("INTERVAL 1 DAY"), high)})
    return rows.repartitionByRange("slice_start", "id").sortWithinPartitions("slice_start", "id")


@dataclass(frozen=True)
class Collector:
    """How a table of the export is made: its rows of a period, and the column with the moment that puts a row into it. A helper
    column of this kind is not shipped."""

    rows: Callable[[Mapping[str, DataFrame], datetime, datetime, Settings], DataFrame]
    moment: str
    helper: bool = False


#: The tables of an export. Those of OPTIONAL_TABLES are gathered if the settings ask for them.
COLLECTORS = {
    "job_host_summary": Collector(lambda db, since, until, settings: extract.job_hosts(db, since, until, settings.host_fields), "modified"),
    "main_jobevent": Collector(lambda db, since, until, settings: extract.job_events(db, since, until, "run_modified"), "run_modified", helper=True),
}


def gathered(db: Mapping[str, DataFrame], settings: Settings, spans: Mapping[str, Span]) -> dict[str, DataFrame]:
    """The tables of an export, each for its period, in slices of a day."""
    if settings.host_fields is None:
        raise MissingSetting("gathering needs host_fields in the settings")
    if unknown := set(settings.tables) - set(OPTIONAL_TABLES):
        raise BadSetting(f"unknown tables: {', '.join(sorted(unknown))}")
    tables = {}
    for name, span in spans.items():
        collector = COLLECTORS[name]
        rows = sliced(collector.rows(db, span.since, span.until, settings), collector.moment, span.since, span.until)
        tables[name] = rows.drop(collector.moment) if collector.helper else rows
    return tables


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, slice_start, slice_end, rows): what shipping would send."""
    parts = [t.groupBy("slice_start", "slice_end").agg(F.count("*").alias("rows")).withColumn("table", F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("table", "slice_start", "slice_end", "rows")


def config_snapshot(settings: Settings) -> dict:
    """The document that is shipped beside the tables: the settings' config, and the system and versions that gathered them."""
    system = {"system": platform.system(), "release": platform.release(), "type": platform.machine(), "python": platform.python_version()}
    return {"platform": system, "version": __version__, "tables": list(settings.tables), **settings.config}


def ship(tables: Mapping[str, DataFrame], settings: Settings, path: str, spans: Mapping[str, Span], rows: int = ROWS, most_bytes: int = BYTES) -> dict[str, tuple[int, int]]:
    """Ships the tables; for each its files and rows. Each is committed by itself, and then marked as shipped, so a table that
    fails is the only one that the next gathering takes again. One gathering of an installation runs at a time."""
    if not settings.install_uuid:
        raise MissingSetting("shipping needs install_uuid in the settings")
    sent, errors = {}, []
    with state.lease(path, settings.install_uuid) as lease:
        for name, table in tables.items():
            texts = table.select(*(F.col(c) if c.startswith("slice_") else F.col(c).cast("string").alias(c) for c in table.columns))
            try:
                files = ship_slices(texts, path.rstrip("/"), name, settings.install_uuid, rows, most_bytes, [spans[name]], config_snapshot(settings))
            except BadSetting:
                raise
            except Exception as error:  # the other tables do not wait for this one
                errors.append(error)
                continue
            sent[name] = tuple(x or 0 for x in files.agg(F.count("*"), F.sum("rows")).first())
            if sent[name][1]:
                lease.mark(name, spans[name].until)
    if errors:
        raise errors[0]
    if not any(n for _, n in sent.values()):
        raise NothingGathered("no rows in the period")
    return sent
