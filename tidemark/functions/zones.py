"""Versioned transition tables of time zones.

A table lists, for one zone, the instants at which its clock changes with the
offset and abbreviation that hold from there on. Tables are probed from the
zone database once and carry its version, so results can be tied to it.

They begin before any zone had a standard time. The calendar repeats every 400
years, to the day of the week, and so do the rules that hold in the future:
a time beyond a table's end is looked up a number of such cycles earlier.
"""

from __future__ import annotations

import bisect
import functools
import zoneinfo
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path

import numpy as np

FIRST, STEP = datetime(1840, 1, 1, tzinfo=UTC), timedelta(days=7)
#: Tables go to NEAR; where times beyond it occur to FAR, a cycle after the last rule change that can be known.
NEAR, FAR = datetime(2100, 1, 1, tzinfo=UTC), datetime(2500, 1, 1, tzinfo=UTC)
#: Seconds of 400 years.
CYCLE = 146_097 * 86_400


@functools.cache
def version() -> str:
    """The version of the zone database in use."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            path = Path(folder, name)
            if path.exists():
                return path.read_text(errors="replace").splitlines()[0].removeprefix("# version ").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@dataclass(frozen=True)
class Transitions:
    """From begin[i] (epoch seconds) on the clock is offset[i] seconds ahead of UTC and called name[i]."""

    zone: str
    version: str
    begin: np.ndarray
    offset: np.ndarray
    name: tuple[str, ...]

    def instants(self, clock: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(epoch seconds, whether settled) of clock times given as seconds since 1970 on that clock.

        A time that the clock shows twice, or never, is not settled.
        """
        table, cycles = self, np.zeros(len(clock), np.int64)
        if len(clock) and clock.max() >= NEAR.timestamp() - 2 * 86_400:
            table = transitions(self.zone, far=True)
            # a day's margin on both sides, as clock and UTC differ by less
            cycles = np.maximum(-((int(FAR.timestamp()) - 2 * 86_400 - clock) // CYCLE), 0)
        clock = clock - cycles * CYCLE
        hits = np.zeros(len(clock), np.int64)
        out = np.zeros(len(clock), np.int64)
        for offset in np.unique(table.offset):
            at = clock - offset
            match = table.offset[np.maximum(np.searchsorted(table.begin, at, "right") - 1, 0)] == offset
            hits += match
            out[match] = at[match]
        return out + cycles * CYCLE, hits == 1

    def abbreviated(self, name: str, clock: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(epoch seconds, whether known) of clock times with an abbreviation of the zone.

        The abbreviation stands for the offset it has in the zone; had it
        several, for the one of the latest period that begins before the time.
        """
        own = np.array([i for i, n in enumerate(self.name) if n.upper() == name], np.int64)
        if not len(own):
            return clock, np.zeros(len(clock), bool)
        k = np.maximum(np.searchsorted(self.begin[own] + self.offset[own], clock, "right") - 1, 0)
        return clock - self.offset[own][k], np.ones(len(clock), bool)


@functools.lru_cache(maxsize=2048)
def transitions(zone: str, far: bool = False) -> Transitions | None:
    """The table of a zone by name, letter case aside; None if there is no such zone."""
    last = FAR if far else NEAR
    known = canonical().get(zone.lower())
    if known is None:
        return None
    info = zoneinfo.ZoneInfo(known)

    def state(at: datetime) -> tuple[int, str]:
        local = at.astimezone(info)
        return int(local.utcoffset().total_seconds()), local.tzname()

    begin, states = [FIRST], [state(FIRST)]
    at = FIRST
    while at < last:
        after = min(at + STEP, last)
        if state(after) != states[-1]:
            low, span = at, int((after - at).total_seconds())
            first = bisect.bisect_left(range(span + 1), True, key=lambda s, low=low: state(low + timedelta(seconds=s)) != states[-1])
            begin.append(low + timedelta(seconds=first))
            states.append(state(begin[-1]))
            after = begin[-1]
        at = after
    starts = np.array([int(b.timestamp()) for b in begin], np.int64)
    starts[0] = -(1 << 62)
    return Transitions(known, version(), starts, np.array([o for o, _ in states], np.int64), tuple(n for _, n in states))


@functools.cache
def canonical() -> dict[str, str]:
    """Names of zones by their lower-case form."""
    return {z.lower(): z for z in zoneinfo.available_timezones()}
