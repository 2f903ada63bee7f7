"""Schedules a row: vectors, faults, local times that never run, and Cron.next() on the driver as a second opinion."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from taskloom.functions import patterns as N
from taskloom.functions import schedules as H

SCHEMA = "id int, kind string, zone string, every_days int, every_hours int, every_minutes int, every_seconds int, second string, minute string, hour string, month string, month_day string, week_day string, at_time string, day_mode string, after timestamp_ntz"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def rows(spark, *given):
    base = {"zone": "UTC", "after": datetime(2025, 1, 1, 12)}
    return spark.createDataFrame([tuple((base | {"id": i} | g).get(f) for f in FIELDS) for i, g in enumerate(given)], SCHEMA)


def runs(spark, *given):
    return [(r.fault, r.next_run) for r in N.with_next_run(N.compiled(rows(spark, *given)), "after").orderBy("id").collect()]


def cron(**k):
    return {"kind": "cron", "minute": "0", "hour": "0", "month": "*", "day_mode": "any"} | k


def test_vectors(spark):
    d, ny = datetime, "America/New_York"
    cases = [
        ({"kind": "interval", "every_seconds": 30}, d(2025, 1, 1, 12, 0, 30)),
        ({"kind": "interval", "every_days": 1, "every_hours": 2, "every_minutes": 3}, d(2025, 1, 2, 14, 3)),
        ({"kind": "hourly", "minute": "0"}, d(2025, 1, 1, 13)),
        ({"kind": "hourly", "minute": "0", "second": "5"}, d(2025, 1, 1, 12, 0, 5)),
        ({"kind": "daily", "at_time": "12:00:00"}, d(2025, 1, 2, 12)),
        ({"kind": "weekly", "week_day": "wed", "at_time": "11:59:59"}, d(2025, 1, 8, 11, 59, 59)),
        ({"kind": "monthly", "month_day": "31", "at_time": "06:00:00", "after": d(2025, 1, 31, 6)}, d(2025, 2, 28, 6)),
        ({"kind": "daily", "at_time": "02:30:00", "zone": ny, "after": d(2024, 3, 10, 6, 59)}, d(2024, 3, 11, 6, 30)),  # 02:30 is skipped on the 10th
        ({"kind": "hourly", "minute": "30", "zone": ny, "after": d(2024, 3, 10, 6, 40)}, d(2024, 3, 10, 7, 30)),
        ({"kind": "hourly", "minute": "30", "zone": ny, "after": d(2024, 11, 3, 5, 40)}, d(2024, 11, 3, 7, 30)),  # the second 01:30 doesn't count
        (cron(minute="*/15", hour="*", zone=ny, after=d(2024, 3, 10, 6, 45)), d(2024, 3, 10, 7)),
        (cron(month="feb", month_day="29", day_mode="month"), d(2028, 2, 29)),
        (cron(month="feb", month_day="29", week_day="wed", day_mode="both"), d(2040, 2, 29)),
        (cron(month="feb", month_day="29", day_mode="month", after=d(2097, 1, 1)), d(2104, 2, 29)),
        (cron(month="mar", month_day="8-14", week_day="sun", day_mode="both", hour="2", minute="30", zone=ny), None),  # skipped each year
        (cron(month_day="15", week_day="fri", day_mode="either"), d(2025, 1, 3)),
    ]
    assert runs(spark, *(g for g, _ in cases)) == [(None, want) for _, want in cases]


def test_faults(spark):
    cases = {
        "kind UNKNOWN": {"kind": "yearly"}, "zone UNKNOWN": {"kind": "daily", "at_time": "01:00:00", "zone": "Nowhere"}, "every EMPTY": {"kind": "interval"}, "every_hours RANGE": {"kind": "interval", "every_hours": 169},
        "minute RANGE": cron(minute="60"), "minute SYNTAX": cron(minute="five"), "hour STEP": cron(hour="*/24"), "hour ORDER": cron(hour="5-2"), "month EMPTY": cron(month=" "), "week_day EMPTY": cron(day_mode="week"),
        "month_day RANGE": cron(month_day="0", day_mode="month"), "NEVER": cron(month="apr,feb", month_day="31", day_mode="month"), "day_mode UNKNOWN": cron(day_mode="some"), "at_time SYNTAX": {"kind": "daily", "at_time": "24:00:00"},
        "week_day DUPLICATE": {"kind": "weekly", "at_time": "01:00:00", "week_day": "mon,tue,mon"}, "hour SYNTAX": cron(hour="*-3"),
    }
    assert runs(spark, *cases.values()) == [(f, None) for f in cases]
    assert runs(spark, cron(month="apr,feb", month_day="31", week_day="mon", day_mode="either"))[0][0] is None


@pytest.mark.parametrize("zone", ["Europe/Berlin", "Australia/Lord_Howe", "America/St_Johns"])
def test_against_the_driver(spark, zone):
    """Random patterns around clock changes, next runs and, by walking, latest slots."""
    r = random.Random(zone)
    pick = lambda low, high: sorted({r.randint(low, high) for _ in range(r.randint(1, 5))})
    given, want = [], []
    for i in range(60):
        minutes, hours, months, days, weeks = pick(0, 59), pick(0, 4), pick(1, 12), pick(1, 28), pick(0, 6)
        mode = r.choice(["any", "month", "week", "either", "both"])
        after = r.choice([datetime(2024, 3, 30), datetime(2024, 10, 26), datetime(2024, 4, 6), datetime(2024, 10, 5), datetime(2024, 11, 2), datetime(2024, 3, 9)]) + timedelta(minutes=r.randint(0, 2880), seconds=r.choice([0, 30]))
        text = lambda v: ",".join(map(str, v))
        given.append({"kind": "cron", "zone": zone, "minute": text(minutes), "hour": text(hours), "month": text(months), "month_day": text(days), "week_day": text(weeks), "day_mode": mode, "after": after})
        c = H.Cron(frozenset(minutes), frozenset(hours), frozenset(months), frozenset(days) if mode in ("month", "either", "both") else None, frozenset(weeks) if mode in ("week", "either", "both") else None, mode == "both")
        at = c.next(after.replace(tzinfo=timezone.utc), zone)
        want.append((None, at and at.replace(tzinfo=None)))
    assert runs(spark, *given) == want
    # the last slot before the next run is no later than `after`, and the next run after it is the same
    back = N.with_latest_slot(N.compiled(rows(spark, *given)).withColumn("first", F.lit(datetime(1990, 1, 1)).cast("timestamp_ntz")), "first", "after")
    again = N.with_next_run(back.where("latest_slot > first"), "latest_slot").select("id", "latest_slot", "next_run").collect()
    assert len(again) > 50 and all(a.latest_slot <= given[a.id]["after"] and a.next_run == want[a.id][1] for a in again)


def test_first_slots_and_empty(spark):
    df = rows(spark, cron(hour="3"), {"kind": "interval", "every_hours": 5}).withColumns({"first": F.lit(datetime(2025, 1, 1, 11)).cast("timestamp_ntz"), "later": F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz")})
    at = lambda first: [r.latest_slot for r in N.with_latest_slot(N.compiled(df), first, "after").orderBy("id").collect()]
    assert at("first") == [datetime(2025, 1, 1, 11)] * 2 and at("later") == [datetime(2026, 1, 1)] * 2
    assert N.with_next_run(N.compiled(df.limit(0)), "after").count() == 0
