"""What has been shipped: the log of commits, by which readers tell whole shipments from parts of failed ones.

Tarballs of a shipment carry its id in their names. When all are written, a manifest in each day's folder lists those of that day,
and at last a record in {path}/log/{installation}/ makes the shipment count, with all its days at once. A table's slice that a
later shipment of the installation covers again is replaced by it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from ..options import BadSetting
from .files import create_text, names_in, read_text, write_text

#: Names of shipped tarballs: the installation, a slice, and for those of a shipment its table and id.
TARBALL = re.compile(r"(?P<install>.*?)-(?P<since>\d{4}-\d\d-\d\d-\d{6})-(?P<until>\d{4}-\d\d-\d\d-\d{6})(?P<rest>.*)\.tar\.gz$")
_SHIPPED = re.compile(r"-(?P<table>\w+)\.(?P<shipment>[0-9a-f]{32})\.")
_MANIFEST = re.compile(r"(?P<install>.*)\.(?P<table>\w+)\.(?P<shipment>[0-9a-f]{32})\.manifest\.json$")
_RECORD = re.compile(r"(?P<number>\d{8})\.(?P<shipment>[0-9a-f]{32})\.json$")
_MOMENT = "%Y-%m-%d-%H%M%S"
#: Manifests and records that are read at once.
READERS = 16


class PartlyShipped(BadSetting):
    """A shipment would cover a slice that is there only in part, so that rows of it would be lost."""


@dataclass(frozen=True, order=True)
class Span:
    """A half-open period."""

    since: datetime
    until: datetime

    def meets(self, other: Span) -> bool:
        return self.since < other.until and other.since < self.until

    def holds(self, other: Span) -> bool:
        return self.since <= other.since and other.until <= self.until

    @classmethod
    def of(cls, texts: Sequence[str]) -> Span:
        return cls(*map(datetime.fromisoformat, texts))

    def texts(self) -> list[str]:
        return [self.since.isoformat(), self.until.isoformat()]


@dataclass(frozen=True)
class Name:
    """What a tarball's name says; shipment and table are empty for those of other exporters."""

    install: str
    span: Span
    table: str = ""
    shipment: str = ""

    @classmethod
    def of(cls, file: str) -> Name | None:
        found = TARBALL.match(file.rpartition("/")[2])
        if not found:
            return None
        try:
            span = Span(*(datetime.strptime(found[n], _MOMENT) for n in ("since", "until")))
        except ValueError:
            return None
        shipped = _SHIPPED.match(found["rest"])
        return cls(found["install"], span, *((shipped["table"], shipped["shipment"]) if shipped else ()))


def tarball_name(install: str, span: Span, table: str, shipment: str, part: str) -> str:
    return f"{install}-{span.since:{_MOMENT}}-{span.until:{_MOMENT}}-{table}.{shipment}.{part}.tar.gz"


def day_folder(path: str, day: date) -> str:
    return f"{path.rstrip('/')}/data/{day:%Y/%m/%d}"


def log_folder(path: str, install: str) -> str:
    return f"{path.rstrip('/')}/log/{install}"


def days_of(span: Span) -> Iterator[date]:
    """The days that a span touches."""
    last = (span.until - timedelta(microseconds=1)).date()
    for n in range((last - span.since.date()).days + 1):
        yield span.since.date() + timedelta(days=n)


@dataclass(frozen=True)
class Manifest:
    """What a shipment has in a day's folder: the spans that it covers there, and the slices with their files."""

    install: str
    table: str
    shipment: str
    covers: tuple[Span, ...]
    slices: Mapping[Span, tuple[str, ...]]


def write_manifest(path: str, day: date, manifest: Manifest) -> None:
    text = {"covers": [c.texts() for c in manifest.covers], "slices": [{"span": s.texts(), "files": list(f)} for s, f in manifest.slices.items()]}
    write_text(f"{day_folder(path, day)}/{manifest.install}.{manifest.table}.{manifest.shipment}.manifest.json", json.dumps(text))


def _manifest(folder: str, file: str) -> Manifest:
    name, text = _MANIFEST.match(file), json.loads(read_text(f"{folder}/{file}"))
    slices = {Span.of(s["span"]): tuple(s["files"]) for s in text["slices"]}
    return Manifest(name["install"], name["table"], name["shipment"], tuple(map(Span.of, text["covers"])), slices)


def commit(path: str, install: str, table: str, shipment: str, days: Iterable[date]) -> str:
    """Makes a shipment count; the name of its record. The numbers of an installation's records are their order."""
    folder, text = log_folder(path, install), json.dumps({"table": table, "days": sorted(d.isoformat() for d in days)})
    names = names_in(folder)
    name = f"{1 + max((int(n[:8]) for n in names if _RECORD.match(n)), default=0):08d}.{shipment}.json"
    if not create_text(f"{folder}/{name}", text):
        raise FileExistsError(f"{folder}/{name}")
    return name


def records(path: str, install: str) -> dict[str, str]:
    """The names of an installation's records by their shipments."""
    return {found["shipment"]: name for name in names_in(log_folder(path, install)) if (found := _RECORD.match(name))}


def installs(path: str) -> list[str]:
    """The installations that have a log."""
    return names_in(f"{path.rstrip('/')}/log", folders=True)


@dataclass(frozen=True)
class Folder:
    """What a day's folder has that counts: tarballs of other exporters, and the live slices of shipments with their files."""

    others: tuple[str, ...]
    live: Mapping[tuple[str, str, Span], tuple[str, ...]]


def _live(manifests: Sequence[Manifest], order: Mapping[str, str]) -> dict[tuple[str, str, Span], tuple[str, ...]]:
    """(installation, shipment, slice) of those manifests whose shipments are in order (by the names of their records), and whose
    slices no later one covers."""
    counted = sorted((m for m in manifests if m.shipment in order), key=lambda m: order[m.shipment])
    found = {}
    for i, m in enumerate(counted):
        later = [c for n in counted[i + 1 :] if n.install == m.install for c in n.covers]
        found |= {(m.install, m.shipment, s): f for s, f in m.slices.items() if not any(c.meets(s) for c in later)}
    return found


def live_folders(path: str, days: Iterable[date], table: str, wanted=lambda install, span: True, upto: Mapping[str, str] | None = None) -> dict[date, Folder]:
    """What counts of a table on some days. wanted tells by installation and slice what is asked for, as far as names say it.
    upto has for each installation the last record that counts; all do without it."""
    days, logs = list(days), {}
    with ThreadPoolExecutor(READERS) as pool:
        names = list(pool.map(lambda day: names_in(day_folder(path, day)), days))
        asked = [[n for n in found if (m := _MANIFEST.match(n)) and m["table"] == table and wanted(m["install"], None)] for found in names]
        for install in {_MANIFEST.match(n)["install"] for found in asked for n in found}:
            logs |= {s: r for s, r in records(path, install).items() if upto is None or r <= upto.get(install, "")}
        read = list(pool.map(lambda x: _manifest(day_folder(path, x[0]), x[1]), [(d, n) for d, found in zip(days, asked, strict=True) for n in found if _MANIFEST.match(n)["shipment"] in logs]))
    rest, out = iter(read), {}
    for day, found, own in zip(days, names, asked, strict=True):
        manifests = [next(rest) for n in own if _MANIFEST.match(n)["shipment"] in logs]
        kept = {k: f for k, f in _live(manifests, logs).items() if wanted(k[0], k[2])}
        others = (n for n in found if not _MANIFEST.match(n) and not ((x := Name.of(n)) and (x.shipment or not wanted(x.install, x.span))))
        out[day] = Folder(tuple(others), kept)
    return out


def refuse_parts(path: str, install: str, table: str, spans: Sequence[Span]) -> None:
    """Raises PartlyShipped if a live slice lies only partly within the spans."""
    days = sorted({d for s in spans for d in days_of(s)})
    for folder in live_folders(path, days, table, lambda i, _: i == install).values():
        for _, _, old in folder.live:
            met = [s for s in spans if s.meets(old)]
            if met and not any(s.holds(old) for s in spans) and not _covered(old, met):
                raise PartlyShipped(f"{table} is there from {old.since} to {old.until}: ship all of that again, or what follows it")


def _covered(old: Span, spans: Sequence[Span]) -> bool:
    """Whether the spans together leave no gap in old."""
    at = old.since
    for s in sorted(spans):
        if s.since <= at:
            at = max(at, s.until)
    return at >= old.until
