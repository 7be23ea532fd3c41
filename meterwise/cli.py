"""Command line: gather a period of a controller's relations, build a report, ship a table, or send tarballs on to a service."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .functions.dates import parse_date, parse_days, parse_month, period
from .operators import hosts, rollups
from .options import OPTIONAL_SHEETS, SHEETS, Heading, MissingSetting, ReportOptions, Settings
from .plans import gather, reports
from .sinks.files import exists, file_system, read_text, url
from .sinks.landing import ship_tarballs
from .sinks.upload import Endpoint, upload
from .sources import extract
from .sources.exports import read_exports

KINDS = ("provider", "company", "renewal")
#: What the rollups read of an export.
HOST_COLUMNS = rollups.HOST_COLUMNS
EVENT_COLUMNS = ("host_name", "task_action", "resolved_action", "resolved_role", "role", "job_remote_id", "duration")
_HEADING = {"title": "heading of the report", "company": "company name", "email": "its e-mail address", "login": "its login", "business_leader": "its business leader", "procurement_leader": "its procurement leader", "po_number": "PO number"}
_END_USER = ("name", "city", "state", "country")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meterwise", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    collect = commands.add_parser("gather", help="take a period of the relations, a day a slice")
    collect.add_argument("--relations", required=True, help="where the relations are: Parquet tables below a path or URL, or a JDBC URL")
    collect.add_argument("--path", required=True, help="where tarballs go")
    collect.add_argument("--settings", required=True, help="JSON file with the platform's names")
    collect.add_argument("--since", help="a date, Nd or Nmonths; where the last gathering ended if not given")
    collect.add_argument("--until", help="a date, Nd or Nmonths; now if not given")
    what = collect.add_mutually_exclusive_group(required=True)
    what.add_argument("--ship", action="store_true", help="write the tarballs")
    what.add_argument("--dry-run", action="store_true", help="only count what would be shipped")
    report = commands.add_parser("report", help="build a report")
    report.add_argument("kind", choices=KINDS)
    report.add_argument("--path", required=True, help="where exports have landed and reports go: a path or a URL")
    report.add_argument("--metrics", help="Parquet table of host metrics, for renewal")
    report.add_argument("--relations", help="relations to take host metrics from, for renewal")
    report.add_argument("--settings", help="JSON file with the platform's names")
    report.add_argument("--month", help="YYYY-MM; the last month if no days are given")
    report.add_argument("--since", help="first day: a date, Nd or Nmonths")
    report.add_argument("--until", help="last day, included")
    report.add_argument("--ephemeral", help="tell nodes apart that are automated for at most so many days, as 30d or 2months")
    report.add_argument("--price", type=float, default=0.0)
    report.add_argument("--sku", default="")
    report.add_argument("--sku-description", default="")
    for name, text in _HEADING.items():
        report.add_argument(f"--{name.replace('_', '-')}", default="", help=text)
    for name in _END_USER:
        report.add_argument(f"--end-user-{name}", default="", help=f"{name} of the end user")
    report.add_argument("--organizations", help="names, separated by semicolons")
    report.add_argument("--sheets", help=f"of {', '.join((*SHEETS, *OPTIONAL_SHEETS))}, separated by commas")
    report.add_argument("--force", action="store_true", help="replace a report that is there")
    report.add_argument("--tables", action="store_true", help="save the tables as Parquet instead of a workbook")
    ship = commands.add_parser("ship", help="ship a gathered table as tarballs")
    ship.add_argument("table", choices=("job_host_summary", "main_jobevent"))
    for name in ("--source", "--path", "--install", "--since", "--until"):
        ship.add_argument(name, required=True)
    ship.add_argument("--dry-run", action="store_true", help="only count what would be shipped")
    upload_ = commands.add_parser("upload", help="send landed tarballs on to a service")
    upload_.add_argument("table", choices=("job_host_summary", "main_jobevent"))
    upload_.add_argument("--path", required=True, help="where tarballs have landed")
    upload_.add_argument("--endpoint", required=True, help="JSON file with upload_url, and maybe token_url, client_id, content_type, proxy and certificate")
    upload_.add_argument("--secret-variable", default="METERWISE_CLIENT_SECRET", help="the environment variable that has the client's secret")
    upload_.add_argument("--since", required=True, help="first day: a date, Nd or Nmonths")
    upload_.add_argument("--until", help="last day, included; today if not given")
    return top


def options_of(args: argparse.Namespace, now: datetime) -> ReportOptions:
    since, until = (moment.date() if (moment := parse_date(text, now)) else None for text in (args.since, args.until))
    return ReportOptions(
        month=None if since else parse_month(args.month, now),
        since=since,
        until=until or (now.date() if since else None),
        now=now,
        price_per_node=args.price,
        sku=args.sku,
        sku_description=args.sku_description,
        company=tuple(getattr(args, f"end_user_{name}") for name in _END_USER),
        organizations=tuple(args.organizations.split(";")) if args.organizations else None,
        sheets=tuple(args.sheets.split(",")) if args.sheets else SHEETS,
        ephemeral_days=parse_days(args.ephemeral) if args.ephemeral else None,
        heading=Heading(**{name: getattr(args, name) for name in _HEADING}),
    )


def settings_of(args: argparse.Namespace) -> Settings:
    return Settings.of(read_text(args.settings)) if args.settings else Settings()


def relations_of(spark: SparkSession, args: argparse.Namespace, settings: Settings, since: datetime, until: datetime | None = None) -> dict[str, DataFrame]:
    """The relations in Parquet tables, or those of a period in the database of a JDBC URL, where the settings name them."""
    if not args.relations.startswith("jdbc:"):
        return extract.landed_database(spark, args.relations)
    if missing := set(extract.RELATIONS) - set(settings.relations):
        raise MissingSetting(f"the settings do not name the relations {', '.join(sorted(missing))}")
    return extract.jdbc_database(spark, args.relations, settings.relations, since=since, until=until)


def _metrics(spark: SparkSession, args: argparse.Namespace, options: ReportOptions) -> DataFrame:
    if options.since is None or not (args.metrics or args.relations):
        raise MissingSetting("a renewal report needs --since, and --metrics or --relations")
    if args.metrics:
        return spark.read.parquet(args.metrics)
    settings = settings_of(args)
    if settings.host_fields is None:
        raise MissingSetting("host metrics of relations need host_fields in the settings")
    since = datetime.combine(options.since, datetime.min.time())
    return hosts.numbered(extract.host_metrics(relations_of(spark, args, settings, since), since, settings.host_fields))


def build_report(spark: SparkSession, args: argparse.Namespace, now: datetime) -> bool:
    options = options_of(args, now)
    file_system(args.path)  # a place of an unknown kind is refused before anything is read
    file = reports.report_file(args.path, args.kind, options.month, options.since, options.until)
    if exists(file) and not args.force:
        return False
    names: list[str] = []
    if args.kind == "renewal":
        tables = reports.renewal_report(_metrics(spark, args, options), options)
    else:
        (since, until), renamed = period(options.month, options.since, options.until), settings_of(args).columns
        read = lambda table, columns: read_exports(spark, url(args.path), table, since, until, columns, renamed)
        host_rollup = rollups.host_rollup(read("job_host_summary", HOST_COLUMNS)).persist()
        if host_rollup.isEmpty():
            return False
        events = rollups.content_rollup(read("main_jobevent", EVENT_COLUMNS)).persist()
        content = None if events.isEmpty() else events
        if args.kind == "provider":
            tables = reports.provider_report(host_rollup, content, options)
        else:
            tables, names = reports.provider_report_by_company(host_rollup, content, options)
    if args.tables:
        reports.save_tables(tables, url(file.removesuffix(".xlsx")), "overwrite" if args.force else "errorifexists")
        return True
    return reports.save_report(file, reports.workbook(args.kind, tables, options, names), args.force)


def gather_period(spark: SparkSession, args: argparse.Namespace, now: datetime) -> list[str]:
    """The lines that the command prints: files and rows of each table, or what they would be."""
    settings = settings_of(args)
    spans = gather.intervals(args.path, settings, parse_date(args.since, now), parse_date(args.until, now), now)
    db = relations_of(spark, args, settings, min(s.since for s in spans.values()), max(s.until for s in spans.values()))
    tables = gather.gathered(db, settings, spans)
    if args.dry_run:
        return [f"{r.table} {r.slice_start}: {r.rows} rows" for r in gather.counts(tables).orderBy("table", "slice_start").toLocalIterator()]
    return [f"{name}: {files} files, {rows} rows" for name, (files, rows) in gather.ship(tables, settings, args.path, spans).items()]


def main(argv: Sequence[str] | None = None, now: datetime | None = None) -> int:
    args = parser().parse_args(argv)
    spark, now = SparkSession.builder.getOrCreate(), now or datetime.now()
    if args.command == "report":
        print("written" if build_report(spark, args, now) else "nothing to do")
        return 0
    if args.command == "gather":
        print("\n".join(gather_period(spark, args, now)))
        return 0
    if args.command == "upload":
        (first, last), endpoint = ((parse_date(t, now) or now).date() for t in (args.since, args.until)), Endpoint.of(read_text(args.endpoint))
        days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
        print(f"{upload(spark, args.path, args.table, days, endpoint, os.environ.get(args.secret_variable, ''))} files sent")
        return 0
    table, since, until = spark.read.parquet(args.source), parse_date(args.since, now), parse_date(args.until, now)
    if args.dry_run:
        print(f"{table.count()} rows")
        return 0
    for r in ship_tarballs(table, url(args.path), args.table, args.install, since, until).toLocalIterator():
        print(r.file, r.rows)
    return 0
