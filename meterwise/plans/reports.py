"""Whole reports: which tables they hold, in which order, and how they become sheets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from datetime import date
from itertools import chain, groupby
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row

from ..functions.dates import period, sliding_windows
from ..operators import hosts, rollups, usage
from ..options import ReportOptions
from ..sinks.files import exists, file_system
from ..sinks.xlsx import Formula, Sheet, column_name, styled, write_workbook

#: Labels of the columns of a sheet.
LABELS = {
    "organization_name": "Organization name", "job_template_name": "Job template name", "job_runs": "Job runs", "host_runs_unique": "Unique managed nodes automated", "host_runs": "Non-unique managed nodes automated",
    "task_runs": "Number of task runs", "first_run": "First run", "last_run": "Last run", "host_name": "Host name", "organizations": "Automated by organizations", "first_automation": "First automation", "last_automation": "Last automation",
    "collection_name": "Collection name", "role_name": "Role name", "module_name": "Module name", "duration": "Duration of task runs [seconds]", "mark_x": "Enter 'X' to indicate internal usage", "quantity_consumed": "Quantity consumed", "unit_price": "Unit price",
    "extended_unit_price": "Extended unit price", "end_user_company_name": "End user company name", "end_user_company_city": "End user city", "end_user_company_state": "End user state/province", "end_user_company_country": "Country of use",
    "sku_number": "SKU number", "sku_description": "SKU description", "notes": "Notes", "hostname": "Host name", "automated_counter": "Number of automations", "days_automated": "Number of days between first and last automation", "deleted_counter": "Number of deletions",
    "last_deleted": "Last deleted", "record_count": "Record count", "record_count_active": "Active record count", "record_count_deleted": "Deleted record count", "hostnames": "Host names", "host_variables": "Host variables", "product_serials": "Serial numbers",
    "machine_ids": "Machine ids", "window_start": "Start of the ephemeral window", "window_end": "End of the ephemeral window", "ephemeral_hosts": "Ephemeral automated hosts", "description": "Description",
}
#: On sheets of nodes a host run is called otherwise.
NODE_LABELS = {"host_runs": "Job runs"}
NODE_COLUMNS = ("hostname", "first_automation", "last_automation", "automated_counter", "days_automated", "deleted_counter", "last_deleted", "record_count", "record_count_active", "record_count_deleted", "hostnames", "host_variables", "product_serials", "machine_ids")
_NODE = ("host_name", "organizations", "host_runs", "task_runs", "first_automation", "last_automation")
BY_ORGANIZATION = "Nodes of organizations"
Tables = dict[str, DataFrame]


def _node_table(table: DataFrame) -> DataFrame:
    return table.select(*[c for c in (*_NODE, "last_automations") if c in table.columns])


def _content_tables(options: ReportOptions, content: DataFrame | None) -> Tables:
    kinds = {"usage_by_collections": ("Usage by collections", "collection_name"), "usage_by_roles": ("Usage by roles", "role_name"), "usage_by_modules": ("Usage by modules", "module_name")}
    wanted = {title: kind for sheet, (title, kind) in kinds.items() if sheet in options.sheets and content is not None}
    return {title: usage.by_content(content, kind) for title, kind in wanted.items()}


def provider_report(host_rollup: DataFrame, content: DataFrame | None, options: ReportOptions) -> Tables:
    """The monthly report of a provider: billing by organization, nodes, and content."""
    mapped = None if content is None else rollups.with_real_hosts(content, host_rollup)
    tables: Tables = {}
    if "summary" in options.sheets:
        tables["Usage Reporting"] = usage.billing_by_organization(host_rollup, options.price_per_node)
    if "managed_nodes" in options.sheets:
        tables["Managed nodes"] = _node_table(usage.by_node(host_rollup))
    return tables | _content_tables(options, mapped)


def provider_report_by_company(host_rollup: DataFrame, content: DataFrame | None, options: ReportOptions) -> tuple[Tables, list[str]]:
    """The report with one billing line for the company; and the organizations whose nodes follow, each on a sheet.

    Hosts are filtered by organization after they have named the hosts of events, and events never are.
    """
    mapped = None if content is None else rollups.with_real_hosts(content, host_rollup)
    own = usage.of_organizations(host_rollup, options.organizations)
    tables: Tables = {}
    sheets = options.sheets
    names = usage.organization_names(own) if "managed_nodes_by_organizations" in sheets else []
    if "summary" in sheets:
        tables["Usage Reporting"] = usage.billing_total(own, options.price_per_node, options.company, options.sku, options.sku_description)
    if "jobs" in sheets:
        tables["Jobs"] = usage.by_job(own).select("job_template_name", "organization_name", "job_runs", "host_runs_unique", "host_runs", "task_runs", "first_run", "last_run")
    if "managed_nodes" in sheets:
        tables["Managed nodes"] = _node_table(usage.by_node_with_organizations(own, names) if names else usage.by_node(own))
    if "usage_by_organizations" in sheets:
        tables["Usage by organizations"] = usage.by_organization(own)
    tables |= _content_tables(options, mapped)
    if names:
        tables[BY_ORGANIZATION] = usage.by_node_of_organization(own)
    return tables, names


def renewal_report(metrics: DataFrame, options: ReportOptions) -> Tables:
    """Managed nodes of host metrics; with ephemeral_days told apart as ephemeral or not, and their usage in windows."""
    if options.since is None:
        raise ValueError("a renewal report needs a first day")
    nodes = hosts.managed_nodes(metrics).persist(StorageLevel.MEMORY_AND_DISK)
    days, now = options.ephemeral_days, options.now
    tables: Tables = {}
    if days is None:
        tables["Usage Reporting"] = hosts.renewal_summary(nodes)
        found = {"Managed nodes": hosts.active(nodes)}
    else:
        since, until = period(None, options.since, options.until)
        windows = hosts.ephemeral_usage(hosts.ephemeral_nodes(nodes, days, now, with_deleted=True), sliding_windows(metrics.sparkSession, since, until, days))
        tables["Usage Reporting"] = hosts.renewal_summary(nodes, days, now, windows)
        found = {"Managed nodes": hosts.lasting_nodes(nodes, days, now), "Managed nodes ephemeral": hosts.ephemeral_nodes(nodes, days, now)}
    if "managed_nodes" in options.sheets:
        tables |= {title: table.select(*NODE_COLUMNS) for title, table in found.items()}
        if days is not None:
            tables["Managed nodes ephemeral usage"] = windows
        tables["Deleted Managed nodes"] = hosts.deleted(nodes).select(*NODE_COLUMNS)
    return tables


# ---- sheets

_ORDER = {"Usage by organizations": "organization_name", "Usage by collections": "collection_name", "Usage by roles": "role_name", "Usage by modules": "module_name", "Managed nodes ephemeral usage": "window_start", "Jobs": "organization_name"}
#: Widths of columns: the first, then all others, by kind of report.
_WIDTHS = {"provider": (63, 15), "company": (40, 25), "renewal": (40, 20)}
#: Formula rows that are left for additions below a company's bill.
SPARE_ROWS = 5
Rows = Iterable[list[tuple[Any, str]]]


def heading(kind: str, options: ReportOptions, total: Formula | None = None) -> list[list[tuple[Any, str]]]:
    """The rows above the first sheet's table. total is the sum of a company's bill."""
    h, (since, until) = options.heading, period(options.month, options.since, options.until)
    span = f"{since:%Y-%m}" if options.since is None else f"{since} - {until}"
    who = [("Company name", h.company), ("Email", h.email), ("Login", h.login), ("Report period", span)]
    updated = f"Updated: {options.now:%b %d, %Y}"
    title = [(h.title or f"Usage report: {kind}", "title")]
    pairs = [[(label, "bold"), (value, "plain")] for label, value in who]
    if kind == "company":
        title += [(None, "plain")] * 6 + [(updated, "plain")]
        pairs[0] += [(None, "plain")] * 6 + [("Grand total", "bold"), (total, "price")]
        pairs[2] += [(None, "plain")] * 2 + [("PO number", "bold"), (h.po_number, "plain")]
        return [title, *pairs, []]
    if kind == "renewal":
        return [[*title, (updated, "plain")], pairs[3], []]
    pairs += [[(label, "bold"), (value, "plain")] for label, value in (("Company business leader", h.business_leader), ("Company procurement leader", h.procurement_leader), ("Periodicity", "Report is submitted monthly"))]
    # The columns and units of a price list
    block = [styled(("SKU", "SKU description", "", "Term", "Unit of measure", "Currency", "Price"), "bold"), styled((options.sku, options.sku_description, "", "MONTH", "MANAGED NODE", "USD", options.price_per_node))]
    return [title, [], [("Monthly payment", "bold")], [], [], *pairs, *block, []]


def _labels(title: str, columns: Sequence[str], names: Sequence[str]) -> list[str]:
    own = NODE_LABELS if title in ("Managed nodes", BY_ORGANIZATION) else {}
    labels = LABELS | own
    return [label for c in columns for label in (names if c == "last_automations" else [labels.get(c, c)])]


def _sorted(title: str, table: DataFrame) -> Iterator[Row]:
    """The rows in the order of the sheet, a partition at a time."""
    return table.orderBy(table[_ORDER.get(title, table.columns[0])].asc_nulls_last()).toLocalIterator(prefetchPartitions=True)


def _table(title: str, columns: Sequence[str], rows: Iterable[Row], names: Sequence[str] = ()) -> Rows:
    yield styled(_labels(title, columns, names), "bold")
    for r in rows:
        yield styled(x for c in columns for x in (r[c] if c == "last_automations" else [r[c]]))


def _bill(columns: Sequence[str], rows: Iterable[Row], start: int, spare: int = 0, total: bool = False) -> Rows:
    """Billing lines from row `start` on: amounts are formulas, with spare rows below, or their sum."""
    at = {c: i for i, c in enumerate(columns)}
    amount, prices = at["extended_unit_price"], {at[c]: "price" for c in ("unit_price", "extended_unit_price")}
    product = lambda n: Formula(f"{column_name(at['quantity_consumed'])}{n}*{column_name(at['unit_price'])}{n}")
    n = start
    for r in chain(rows, [None] * spare):
        yield styled((product(n) if i == amount else None if r is None else r[c] for i, c in enumerate(columns)), styles=prices)
        n += 1
    if total and n > start:
        column = column_name(amount)
        yield styled(("Sum of monthly payment" if i == 0 else Formula(f"SUM({column}{start}:{column}{n - 1})") if i == amount else None for i in range(len(columns))), "bold", prices)


def _summary(kind: str, title: str, table: DataFrame, options: ReportOptions) -> Rows:
    columns = [c for c in table.columns if c != "position"]
    if kind == "renewal":
        return chain(heading(kind, options), _table(title, columns, _sorted(title, table)))
    start = len(heading(kind, options)) + 2
    if kind == "company":  # one line at most, so its end is known
        rows = table.collect()
        column = column_name(columns.index("extended_unit_price"))
        top = heading(kind, options, Formula(f"SUM({column}{start}:{column}{start + len(rows) + SPARE_ROWS - 1})"))
        body = _bill(columns, rows, start, SPARE_ROWS)
    else:
        top, body = heading(kind, options), _bill(columns, _sorted(title, table), start, total=True)
    return chain(top, [styled(_labels(title, columns, ()), "bold")], body)


def workbook(kind: str, tables: Mapping[str, DataFrame], options: ReportOptions, organizations: Sequence[str] = ()) -> Iterator[Sheet]:
    """The sheets of a report, each with its rows as a stream, so they are to be written one after another. The nodes of
    organizations are sorted once and cut into a sheet for each."""
    first, rest = _WIDTHS[kind]
    for title, table in tables.items():
        widths = [first, *[rest] * (len(table.columns) - 1)]
        if title == "Usage Reporting":
            yield Sheet(title, _summary(kind, title, table, options), widths)
        elif title == BY_ORGANIZATION:
            columns = ("host_name", "host_runs", "task_runs", "first_automation", "last_automation")
            rows = table.orderBy("organization_name", table["host_name"].asc_nulls_last()).toLocalIterator(prefetchPartitions=True)
            for name, own in groupby(rows, key=lambda r: r["organization_name"]):
                yield Sheet(name, _table(title, columns, own), widths)
        else:
            yield Sheet(title, _table(title, table.columns, _sorted(title, table), organizations), widths)


def report_file(path: str, kind: str, month: date | None, since: date | None, until: date | None) -> str:
    """Where a report goes: reports/YYYY/MM below path, which may be a URL, named by its month or its days."""
    first, last = period(month, since, until)
    name = f"{kind}-{first}--{last}.xlsx" if since is not None else f"{kind}-{first:%Y-%m}.xlsx"
    return f"{path.rstrip('/')}/reports/{first:%Y}/{first:%m}/{name}"


def save_report(file: str, sheets: Iterable[Sheet], force: bool = False) -> bool:
    """Writes a workbook unless it is there already; whether it was written."""
    if exists(file) and not force:
        return False
    where, path = file_system(file)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as out:
        write_workbook(out, sheets)
    return True


def save_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """A report as Parquet, one folder for each table: the form for reports that are larger than a sheet."""
    for title, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{title.lower().replace(' ', '_')}")
