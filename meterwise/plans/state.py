"""What each collector of an installation has shipped, and who gathers just now, in one versioned document.

Versions are files of their own, {path}/gathered/{installation}/{number}.json. A change writes the next one, which fails if
another writer was faster, so marks and the lease change by compare and set on any file system that creates files once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta

from ..sinks.files import create_text, file_system, names_in, read_text

#: How long a gathering holds its lease unless it ends before, and how many versions stay.
LEASE, KEPT = timedelta(hours=6), 20


class GatheringElsewhere(RuntimeError):
    """Another gathering of the installation holds the lease."""


def _clock() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


@dataclass(frozen=True)
class State:
    """marks: for each table the moment up to which it is shipped."""

    version: int = 0
    marks: Mapping[str, datetime] = field(default_factory=dict)
    holder: str = ""
    expires: datetime = datetime.min

    def text(self) -> str:
        return json.dumps({"marks": {t: m.isoformat() for t, m in self.marks.items()}, "holder": self.holder, "expires": self.expires.isoformat()})


def _folder(path: str, install: str) -> str:
    return f"{path.rstrip('/')}/gathered/{install}"


def load(path: str, install: str) -> State:
    names = [n for n in names_in(_folder(path, install)) if n.endswith(".json")]
    if not names:
        return State()
    text = json.loads(read_text(f"{_folder(path, install)}/{names[-1]}"))
    return State(int(names[-1][:-5]), {t: datetime.fromisoformat(m) for t, m in text["marks"].items()}, text["holder"], datetime.fromisoformat(text["expires"]))


def change(path: str, install: str, new: Callable[[State], State]) -> State:
    """Writes new(state) as the next version; where another writer was faster, of the state that it wrote."""
    while True:
        before = load(path, install)
        after = replace(new(before), version=before.version + 1)
        if create_text(f"{_folder(path, install)}/{after.version:08d}.json", after.text()):
            where, root = file_system(_folder(path, install))
            for name in names_in(_folder(path, install))[:-KEPT]:
                where.delete_file(f"{root}/{name}")
            return after


class Lease:
    """The right to gather for an installation; shipped tables are marked under it."""

    def __init__(self, path: str, install: str, holder: str, clock: Callable[[], datetime]):
        self.path, self.install, self.holder, self.clock = path, install, holder, clock

    def _held(self, state: State) -> State:
        if state.holder != self.holder:
            raise GatheringElsewhere(f"the lease of {self.install} has gone to {state.holder or 'nobody'}")
        return state

    def mark(self, table: str, until: datetime) -> None:
        """table is shipped up to a moment; an earlier one than before does not take the mark back. The lease is renewed."""
        change(self.path, self.install, lambda s: replace(self._held(s), marks={**s.marks, table: max(until, s.marks.get(table, until))}, expires=self.clock() + LEASE))

    def end(self) -> None:
        change(self.path, self.install, lambda s: replace(s, holder="", expires=datetime.min) if s.holder == self.holder else s)


@contextmanager
def lease(path: str, install: str, clock: Callable[[], datetime] = _clock) -> Iterator[Lease]:
    """The lease of an installation, or GatheringElsewhere while another holds it that has not expired."""
    holder = uuid.uuid4().hex

    def take(state: State) -> State:
        if state.holder and state.expires > clock():
            raise GatheringElsewhere(f"{state.holder} gathers for {install} until {state.expires}")
        return replace(state, holder=holder, expires=clock() + LEASE)

    change(path, install, take)
    held = Lease(path, install, holder, clock)
    try:
        yield held
    finally:
        held.end()
