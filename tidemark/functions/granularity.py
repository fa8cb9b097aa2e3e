"""Granularities of periodic measurements: text, arithmetic, alignment, buckets.

Buckets are closed on the right and named by their end: a value stamped T
measures what happened in (T - granularity, T].
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3600, 86400
_UNITS = {"s": 1, "m": MINUTE, "h": HOUR, "d": DAY, "w": 7 * DAY}


@dataclass(frozen=True)
class Granularity:
    """A number of months, or of seconds; never both."""

    seconds: int = 0
    months: int = 0

    def __post_init__(self):
        if (self.seconds > 0) == (self.months > 0):
            raise ValueError("a granularity is a positive number of seconds or of months")

    def __str__(self) -> str:
        if self.months:
            return "1 month" if self.months == 1 else f"{self.months} months"
        days, rest = divmod(self.seconds, DAY)
        clock = f"{rest // HOUR:02d}:{rest % HOUR // MINUTE:02d}:{rest % MINUTE:02d}"
        if not days:
            return clock
        named = "1 day" if days == 1 else f"{days} days"
        return named if not rest else f"{named} {clock}"

    def __lt__(self, other: Granularity) -> bool:
        return self.span() < other.span()

    def span(self) -> int:
        """Seconds, a month counting as one of 31 days."""
        return self.seconds or self.months * 31 * DAY

    def add(self, at: datetime, times: int = 1) -> datetime:
        """`at` moved on the wall clock of its zone, so a day stays a day across clock changes."""
        zone, wall = at.tzinfo, at.replace(tzinfo=None)
        if self.months:
            index = wall.year * 12 + wall.month - 1 + self.months * times
            year, month = divmod(index, 12)
            last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
            wall = wall.replace(year=year, month=month + 1, day=min(wall.day, last))
        elif self.seconds % DAY == 0 or not isinstance(zone, ZoneInfo):
            wall += timedelta(seconds=self.seconds * times)
        else:
            return (at.astimezone(ZoneInfo("UTC")) + timedelta(seconds=self.seconds * times)).astimezone(zone)
        return wall.replace(tzinfo=zone)

    def floor(self, at: datetime) -> datetime:
        """The last aligned time at or before `at`, on its wall clock; weeks begin on Monday."""
        midnight = at.replace(hour=0, minute=0, second=0, microsecond=0)
        if self.months:
            first = midnight.replace(day=1)
            return first.replace(month=(first.month - 1) // self.months * self.months + 1) if 12 % self.months == 0 else first
        if self.seconds == 7 * DAY:
            return midnight - timedelta(days=at.weekday())
        if self.seconds == DAY:
            return midnight
        if DAY % self.seconds:
            raise ValueError(f"{self} does not divide a day")
        into = at.hour * HOUR + at.minute * MINUTE + at.second
        return midnight + timedelta(seconds=into - into % self.seconds)

    def range(self, start: datetime, end: datetime) -> list[datetime]:
        """The stamps in (start, end], one granularity apart."""
        out, at = [], self.add(start)
        while at <= end:
            out.append(at)
            at = self.add(at)
        return out

    def interval(self) -> Column:
        """A Spark interval, calendar-aware for months."""
        return F.make_interval(months=F.lit(self.months)) if self.months else F.make_dt_interval(secs=F.lit(float(self.seconds)))


def parse(text: str | int | timedelta) -> Granularity:
    """A granularity from seconds, a timedelta or text: 900s, 15m, 1h, 1d, 1w, 1month, 00:15:00, `2 days`, `1 day 00:00:00`."""
    if isinstance(text, timedelta):
        return Granularity(int(text.total_seconds()))
    if isinstance(text, int):
        return Granularity(text)
    clean = text.strip().lower()
    if found := re.fullmatch(r"(?:(\d+) days?,? ?)?(\d{1,2}):(\d{2}):(\d{2})", clean):
        days, hours, minutes, seconds = (int(x or 0) for x in found.groups())
        return Granularity(days * DAY + hours * HOUR + minutes * MINUTE + seconds)
    if found := re.fullmatch(r"(\d+) ?(?:months?|mons?)", clean):
        return Granularity(months=int(found[1]))
    if found := re.fullmatch(r"(\d+) ?(s|m|h|d|w)(?:ec(?:ond)?s?|in(?:ute)?s?|(?:ou)?rs?|ays?|eeks?)?", clean):
        return Granularity(int(found[1]) * _UNITS[found[2]])
    raise ValueError(f"no granularity: {text!r}")


def bucket_end(at: Column, granularity: Granularity | str) -> Column:
    """End of the right-closed bucket that holds a timestamp, on the session's clock."""
    g = parse(granularity) if isinstance(granularity, str) else granularity
    just_before = at - F.expr("INTERVAL '0.000001' SECOND")
    if g.months:
        if g.months == 1:
            return F.date_trunc("MONTH", just_before) + F.expr("INTERVAL 1 MONTH")
        begin = F.date_trunc("YEAR", just_before)
        whole = F.floor((F.month(just_before) - 1) / g.months) + 1
        return begin + F.make_ym_interval(months=(whole * g.months).cast("int"))
    if g.seconds == 7 * DAY:
        return F.date_trunc("WEEK", just_before) + F.expr("INTERVAL 7 DAYS")
    if g.seconds == DAY:
        return F.date_trunc("DAY", just_before) + F.expr("INTERVAL 1 DAY")
    step = g.seconds * 1_000_000
    ahead = F.pmod(-F.unix_micros(at.cast("timestamp")), F.lit(step))
    return at + F.make_dt_interval(secs=(ahead / 1_000_000).cast("decimal(18,6)"))


def most_recent(at: Column, granularity: Granularity | str, zone: str | None = None) -> Column:
    """The last aligned time at or before a timestamp, without zone; in a zone, on its clock. Weeks begin on Monday."""
    g = parse(granularity) if isinstance(granularity, str) else granularity
    clock = F.from_utc_timestamp(at.cast("timestamp"), zone) if zone else at.cast("timestamp")
    if g.months:
        return F.date_trunc("MONTH", clock).cast("timestamp_ntz")
    if g.seconds in (DAY, 7 * DAY):
        return F.date_trunc("DAY" if g.seconds == DAY else "WEEK", clock).cast("timestamp_ntz")
    micros = F.unix_micros(clock)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(g.seconds * 1_000_000))).cast("timestamp_ntz")


def partition_index(at: Column, size: Granularity | str) -> Column:
    """Number of the partition, `size` long since 1970, that holds a timestamp; a boundary belongs to the later one."""
    g = parse(size) if isinstance(size, str) else size
    if g.months:
        return F.floor(((F.year(at) - 1970) * 12 + F.month(at) - 1) / g.months)
    return F.floor(F.unix_micros(at.cast("timestamp")) / (g.seconds * 1_000_000))


def partition_between(column: str, size: Granularity | str, start: datetime, end: datetime) -> Column:
    """A predicate on the partition column for timestamps in (start, end], so whole partitions are not read."""
    low, high = (partition_index(F.lit(t), size) for t in (start, end))
    return F.col(column).between(low, high)


def stamps(start: Column, end: Column, granularity: Granularity | str) -> Column:
    """An array of the stamps in (start, end]."""
    g = parse(granularity) if isinstance(granularity, str) else granularity
    step = F.expr(f"INTERVAL {g.months} MONTHS" if g.months else f"INTERVAL {g.seconds} SECONDS")
    return F.when(start + step <= end, F.sequence(start + step, end, step)).otherwise(F.array().cast("array<timestamp_ntz>"))


#: The partition size that fits data of a granularity.
PARTITION_SIZES = {"15m": "1d", "30m": "2d", "1h": "4d", "1d": "3month", "1w": "12month", "1month": "60month"}


def partition_size(granularity: str) -> Granularity:
    """The partition size for tables of a granularity."""
    own = parse(granularity)
    for name, size in PARTITION_SIZES.items():
        if parse(name) == own:
            return parse(size)
    raise ValueError(f"no partition size for {granularity}")


def duration_text(span: timedelta) -> str:
    """A duration in words, a year counting 365 days: `1 hour 15 minutes`."""
    left, words = int(span.total_seconds()), []
    for name, size in (("year", 365 * DAY), ("day", DAY), ("hour", HOUR), ("minute", MINUTE), ("second", 1)):
        n, left = divmod(left, size)
        if n:
            words.append(f"{n} {name}{'s' * (n != 1)}")
    return " ".join(words) or "0 seconds"
