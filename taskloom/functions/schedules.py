"""Next runs of schedules: intervals, fixed times of the hour, day, week and month, and cron sets, in a time zone.

Local times that a clock change skips don't run; of those it repeats the earlier does.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from itertools import islice
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns

MOST_DAYS = 146_097


def interval_column(after: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    if not (days or hours or minutes or seconds):
        return F.lit(None).cast("timestamp_ntz")
    return after + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def local_time(at: Column, zone: str) -> Column:
    """The local time of a moment in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def moment(local: Column, zone: str) -> Column:
    """The moment in UTC of a local time, the earlier one where a clock change repeats it; null where one skips it."""
    at = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return F.when(local_time(at, zone) == local, at)


def _first(after: Column, candidates: Column, zone: str) -> Column:
    """The first of the local times, which ascend, whose moment exists and is after `after`."""
    return F.array_min(F.filter(F.transform(candidates, lambda x: moment(x, zone)), lambda x: x > after))


def monthly_column(after: Column, day: int, hour: int, minute: int, zone: str = "UTC", months: int = 4) -> Column:
    """The next run on a day of the month, or its last day; months in which a clock change skips it are passed over."""
    this = F.date_trunc("MONTH", local_time(after, zone)).cast("timestamp_ntz")

    def of(n: Column) -> Column:
        month = F.add_months(this, n).cast("timestamp_ntz")
        return month + F.make_dt_interval(F.least(F.lit(day), F.dayofmonth(F.last_day(month))) - 1, F.lit(hour), F.lit(minute))

    return _first(after, F.transform(F.sequence(F.lit(0), F.lit(months)), of), zone)


def daily_column(after: Column, hour: int, minute: int, weekdays: list[int] = (), zone: str = "UTC") -> Column:
    """The next run at a time of day, on these days of the week (Monday is 0) or all; days on which a clock change skips it are passed over."""
    day = F.date_trunc("DAY", local_time(after, zone)).cast("timestamp_ntz")
    every = F.transform(F.sequence(F.lit(0), F.lit(21 if weekdays else 3)), lambda d: day + F.make_dt_interval(d, F.lit(hour), F.lit(minute)))
    return _first(after, F.filter(every, lambda x: F.weekday(x).isin(list(weekdays))) if weekdays else every, zone)


def hourly_column(after: Column, minute: int, second: int = 0, zone: str = "UTC") -> Column:
    """The next run at a minute of the hour, by the clock on the wall."""
    hour = F.date_trunc("HOUR", local_time(after, zone)).cast("timestamp_ntz")
    return _first(after, F.transform(F.sequence(F.lit(0), F.lit(26)), lambda h: hour + F.make_dt_interval(hours=h, mins=F.lit(minute), secs=F.lit(second))), zone)


def cron_day(at: Column, cron: Cron) -> Column:
    """Whether a day fits a cron's months, days of the month and days of the week."""
    fits = lambda c, values: c.isin(sorted(values)) if values is not None else F.lit(True)
    of_month, of_week = fits(F.dayofmonth(at), cron.month_days), fits(F.weekday(at), cron.week_days)
    either = cron.month_days is not None and cron.week_days is not None and not cron.both
    return fits(F.month(at), cron.months) & ((of_month | of_week) if either else (of_month & of_week))


def cron_column(after: Column, cron: Cron, zone: str = "UTC") -> Column:
    """The next run of a cron, found by mask arithmetic (see patterns)."""
    bits = lambda values, every: F.lit(sum(1 << v for v in (every if values is None else values))).cast("long")
    mode = "any" if cron.month_days is None and cron.week_days is None else "week" if cron.month_days is None else "month" if cron.week_days is None else "both" if cron.both else "either"
    pattern = F.struct(F.lit(0).alias("second"), bits(cron.minutes, ()).alias("minutes"), bits(cron.hours, ()).alias("hours"), bits(cron.months, ()).alias("months"), bits(cron.month_days, range(1, 32)).alias("month_days"), bits(cron.week_days, range(7)).alias("week_days"), F.lit(mode).alias("mode"), F.lit(31).alias("last"))
    return patterns.next_run(after, F.lit("cron"), F.lit(0), pattern, F.lit(zone))


def should_run(next_run: Column, as_of: Column) -> Column:
    return next_run.isNull() | (next_run <= as_of)


def missed_slots(first: Column, as_of: Column, step_s: int, most: int) -> Column:
    """The slots from the first one due up to now, the first `most` of them."""
    return F.when(first <= as_of, F.slice(F.sequence(first, as_of, F.make_dt_interval(secs=F.lit(step_s))), 1, most)).otherwise(F.array().cast("array<timestamp_ntz>"))


def latest_slot(first: datetime, now: datetime, step: timedelta) -> datetime:
    """The last slot that is due, without walking over the others."""
    if step <= timedelta(0):
        raise ValueError("slots must go forward")
    return first if first > now else first + (now - first) // step * step


def instant(local: datetime, zone: ZoneInfo) -> datetime | None:
    """The moment of a local time; None if a clock change skips it."""
    at = local.replace(tzinfo=zone, fold=0).astimezone(timezone.utc)
    return at if at.astimezone(zone).replace(tzinfo=None) == local else None


def expand(term: str | int | list, low: int, high: int, names: tuple[str, ...] = ()) -> set[int]:
    """The values of a cron term: *, */n, a, a-b, a-b/n, lists of these, and names."""
    if isinstance(term, int):
        term = str(term)
    out: set[int] = set()
    for part in term.split(",") if isinstance(term, str) else map(str, term):
        body, _, step = part.strip().partition("/")
        n = int(step) if step else 1
        number = lambda x: low + names.index(x.upper()) if x.upper() in names else int(x)
        a, b = (low, high) if body == "*" else map(number, body.split("-")) if "-" in body else (number(body), number(body) if not step else high)
        if not low <= a <= b <= high or n < 1 or (step and n > high - low):
            raise ValueError(f"{part!r} is out of {low}..{high}")
        out |= set(range(a, b + 1, n))
    if not out:
        raise ValueError("a term must hold a value")
    return out


@dataclass(frozen=True)
class Cron:
    """Sets of minutes, hours and months; days of the month and of the week (Monday is 0), joined by `either` or `both` where both are given."""

    minutes: frozenset[int]
    hours: frozenset[int]
    months: frozenset[int] = frozenset(range(1, 13))
    month_days: frozenset[int] | None = None
    week_days: frozenset[int] | None = None
    both: bool = False

    def __post_init__(self):
        for values, low, high in ((self.minutes, 0, 59), (self.hours, 0, 23), (self.months, 1, 12), (self.month_days, 1, 31), (self.week_days, 0, 6)):
            if values is not None and (not values or min(values) < low or max(values) > high):
                raise ValueError(f"values must lie in {low}..{high}")
        if self.month_days and (self.week_days is None or self.both) and not any(d <= (29 if m == 2 else calendar.monthrange(2001, m)[1]) for m in self.months for d in self.month_days):
            raise ValueError("no month has such a day")

    def on(self, d: date) -> bool:
        if d.month not in self.months:
            return False
        of_month = self.month_days is None or d.day in self.month_days
        of_week = self.week_days is None or d.weekday() in self.week_days
        if self.month_days is not None and self.week_days is not None and not self.both:
            return of_month or of_week
        return of_month and of_week

    def next(self, after: datetime, zone: str = "UTC") -> datetime | None:
        tz = ZoneInfo(zone)
        local = after.astimezone(tz)
        times = sorted((h, m) for h in self.hours for m in self.minutes)
        for n in range(MOST_DAYS):
            d = local.date() + timedelta(days=n)
            if self.on(d):
                for h, m in times:
                    at = instant(datetime(d.year, d.month, d.day, h, m), tz)
                    if at and at > after:
                        return at
        return None


def slots(cron: Cron, after: datetime, most: int, zone: str = "UTC") -> list[datetime]:
    def walk():
        at = after
        while at := cron.next(at, zone):
            yield at

    return list(islice(walk(), most))


@dataclass(frozen=True)
class Schedule:
    """Checked settings of one schedule."""

    name: str
    kind: str
    every: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if not self.name or self.kind not in ("interval", "hourly", "daily", "weekly", "monthly", "cron"):
            raise ValueError("a schedule needs a name and a known kind")
        for unit, high in (("minute", 59), ("second", 59), ("hour", 23), ("day", 31)):
            if not 0 <= self.every.get(unit, 0) <= high:
                raise ValueError(f"{unit} must lie in 0..{high}")
