"""What a report or a gathering is asked for. The clock is a field, so that a report can be repeated."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime

#: What stands for a missing name in the rollups.
NO_ORGANIZATION, NO_ROLE, NO_COLLECTION = "No organization name", "No role used", "No collection used"
#: The events of a task's run on a host.
RUNNER_EVENTS = (
    "runner_on_ok", "runner_on_failed", "runner_on_unreachable", "runner_on_skipped", "runner_retry", "runner_on_async_ok", "runner_item_on_ok", "runner_item_on_failed", "runner_item_on_skipped",
)
#: Texts that a CSV export's reader takes for null.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

SHEETS = ("summary", "managed_nodes", "usage_by_organizations", "usage_by_collections", "usage_by_roles", "usage_by_modules")
OPTIONAL_SHEETS = ("jobs", "managed_nodes_by_organizations")
#: Tables of an export that are gathered only if asked for; the others always are.
OPTIONAL_TABLES = ("main_jobevent",)


class MissingSetting(ValueError):
    """A setting that is needed is not given."""


class BadSetting(ValueError):
    """A setting has a value that is not allowed."""


@dataclass(frozen=True)
class HostFields:
    """The variables of an inventory that say where a host really is and how it is reached, and the fields of its facts with its
    serial number and machine id. Each automation platform has its own names."""

    address: str
    connection: str
    serial: str
    machine: str


@dataclass(frozen=True)
class Settings:
    """A platform's names, from a JSON file: host_fields, columns (an export's column to that of the schemas), relations (their
    names in its database), install_uuid, the optional tables to gather, and config: what a platform says of itself (versions,
    licence, settings), which is shipped with each gathering."""

    host_fields: HostFields | None = None
    columns: Mapping[str, str] = field(default_factory=dict)
    relations: Mapping[str, str] = field(default_factory=dict)
    install_uuid: str = ""
    tables: tuple[str, ...] = OPTIONAL_TABLES
    config: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, text: str) -> Settings:
        given = json.loads(text)
        if unknown := set(given) - {"host_fields", "columns", "relations", "install_uuid", "tables", "config"}:
            raise BadSetting(f"unknown settings: {', '.join(sorted(unknown))}")
        if unknown := set(given.get("tables", ())) - set(OPTIONAL_TABLES):
            raise BadSetting(f"unknown tables: {', '.join(sorted(unknown))}")
        fields = given.get("host_fields")
        try:
            names = HostFields(**fields) if fields else None
        except TypeError:
            raise MissingSetting("host_fields needs address, connection, serial and machine") from None
        return cls(names, given.get("columns", {}), given.get("relations", {}), given.get("install_uuid", ""), tuple(given.get("tables", OPTIONAL_TABLES)), given.get("config", {}))


@dataclass(frozen=True)
class Heading:
    """What stands above the first sheet of a report."""

    title: str = ""
    company: str = ""
    email: str = ""
    login: str = ""
    business_leader: str = ""
    procurement_leader: str = ""
    po_number: str = ""


@dataclass(frozen=True)
class ReportOptions:
    """since and until bound the days of a report, both included; month is used if they are not given. company is the end
    user's name, city, state and country."""

    month: date | None = None
    since: date | None = None
    until: date | None = None
    now: datetime = field(default_factory=datetime.now)
    price_per_node: float = 0.0
    sku: str = ""
    sku_description: str = ""
    company: tuple[str, str, str, str] = ("", "", "", "")
    organizations: tuple[str, ...] | None = None
    sheets: tuple[str, ...] = SHEETS
    ephemeral_days: int | None = None
    heading: Heading = Heading()

    def __post_init__(self) -> None:
        if unknown := set(self.sheets) - {*SHEETS, *OPTIONAL_SHEETS}:
            raise BadSetting(f"unknown sheets: {', '.join(sorted(unknown))}")
