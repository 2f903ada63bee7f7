"""Schedules a row: each row has its own pattern and zone. Terms become bit masks in columns, and the next and the last
run come from them by mask arithmetic, from the month to the day to the clock. There is no list of days.

A pattern is a struct: second, minutes (bits 0-59), hours (0-23), months (1-12), month_days (1-31), week_days (0-6,
Monday is 0), mode and last. mode says how days are chosen: any, month, week, either, both, or last (day `last` of the
month, or its last one). Local times that a clock change skips don't run; of those it repeats the earlier does. Clock
changes are taken to begin and end at quarters of an hour.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of months and days, as terms may use them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEK_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: Months in which a pattern is looked for: a 29 February on a day of the week comes again within 40 years.
MOST_MONTHS = 12 * 41
#: Spans of months that are looked through one after the other: this one and the next, a year, up to a 29 February, the rest.
SPANS = ((0, 1), (2, 12), (13, 48), (49, MOST_MONTHS))
#: Weeks of a month, as the factor that repeats seven bits.
WEEKS = sum(1 << 7 * i for i in range(5))
LONG_MONTHS, SHORT_MONTHS = (sum(1 << m for m in months) for months in ((1, 3, 5, 7, 8, 10, 12), (4, 6, 9, 11)))
#: The most of each unit of an interval.
MOST = {"every_seconds": 86_400, "every_minutes": 1_440, "every_hours": 168, "every_days": 365}
#: Tries at local times that don't run before a pattern counts as one that never does.
TRIES = (8, 1_000)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once."""
    return F.transform(F.array(value), of)[0]


def _bit(n: Column | int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(n).cast("int") if isinstance(n, int) else n.cast("int"))


def _from(mask: Column, n: Column) -> Column:
    """The bits at n and above."""
    return mask.bitwiseAND(-_bit(n))


def _upto(mask: Column, n: Column) -> Column:
    """The bits at n and below; none if n is -1."""
    return mask.bitwiseAND(_bit(n + 1) - 1)


def _lowest(mask: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(-mask) - 1)


def _highest(mask: Column) -> Column:
    return F.length(F.bin(mask)) - 1


def _has(mask: Column, n: Column) -> Column:
    return mask.bitwiseAND(_bit(n)) != 0


def days_of(month: Column, p: Column) -> Column:
    """The days of a month (its first day) that a pattern takes, as bits 1-31."""
    size = F.dayofmonth(F.last_day(month))
    week = F.call_function("shiftright", p["week_days"].bitwiseOR(p["week_days"] * 128), F.weekday(month)).bitwiseAND(127) * WEEKS * 2
    mode = p["mode"]
    chosen = (F.when(mode == "month", p["month_days"]).when(mode == "week", week).when(mode == "either", p["month_days"].bitwiseOR(week))
              .when(mode == "both", p["month_days"].bitwiseAND(week)).when(mode == "last", _bit(F.least(p["last"], size))).otherwise(F.lit(-1).cast("long")))
    return F.when(_has(p["months"], F.month(month)), _upto(chosen, size).bitwiseAND(-2)).otherwise(F.lit(0).cast("long"))


def _day(day: Column, p: Column, back: bool) -> Column:
    """The first matching day from `day` on, or the last one up to it."""
    pick, keep, best = (_highest, _upto, F.array_max) if back else (_lowest, _from, F.array_min)

    def within(a: int, b: int) -> Column:
        def of(k: Column) -> Column:
            first = F.add_months(F.trunc(day, "MONTH"), -k if back else k)
            bound = F.when(k == 0, F.dayofmonth(day)).otherwise(31 if back else 1)
            return let(first, lambda m: let(keep(days_of(m, p), bound), lambda mask: F.when(mask != 0, F.date_add(m, pick(mask) - 1))))

        return best(F.transform(F.sequence(F.lit(a), F.lit(b)), of))

    return F.coalesce(*(within(a, b) for a, b in SPANS))


def _minute(t: Column, p: Column, back: bool) -> Column:
    """The first matching minute of the day from t on, or the last one up to it; null if there is none."""
    def of(h: Column, m: Column) -> Column:
        if back:
            inside, others, end = _upto(p["minutes"], m), _upto(p["hours"], h - 1), _highest
        else:
            inside, others, end = _from(p["minutes"], m), _from(p["hours"], h + 1), _lowest
        here = F.when(_has(p["hours"], h) & (inside != 0), h * 60 + end(inside))
        return F.coalesce(here, F.when(others != 0, end(others) * 60 + end(p["minutes"])))

    return F.when((t >= 0) & (t < 1440), of(F.floor(t / 60).cast("int"), (t % 60).cast("int")))


def _local(at: Column, p: Column, back: bool) -> Column:
    """The first matching local time from `at` on, or the last one up to it."""
    clock = F.hour(at) * 60 + F.minute(at)
    inside, second = F.date_part(F.lit("SECOND"), at), p["second"]
    t = clock - F.when(inside < second, 1).otherwise(0) if back else clock + F.when(inside > second, 1).otherwise(0)
    whole = lambda d, m: d.cast("timestamp_ntz") + F.make_dt_interval(mins=m, secs=p["second"].cast("decimal(18,6)"))
    edge = F.lit(1439 if back else 0)

    def of(today: Column) -> Column:
        day, left = today["day"], today["minute"]  # the matching minute that is left of the day, if it matches
        start = F.when(left.isNull(), F.date_add(day, -1 if back else 1)).otherwise(day)
        return let(_day(start, p, back), lambda d: whole(d, F.when((d == day) & left.isNotNull(), left).otherwise(_minute(edge, p, back))))

    return let(F.struct(F.to_date(at).alias("day"), _minute(t, p, back).alias("minute")), of)


def local_time(at: Column, zone: Column) -> Column:
    """The local time of a moment in UTC."""
    return F.convert_timezone(F.lit("UTC"), zone, at)


def moment(local: Column, zone: Column) -> Column:
    """The moment in UTC of a local time, the earlier one where it is repeated; null where it is skipped."""
    return let(F.convert_timezone(zone, F.lit("UTC"), local), lambda at: F.when(local_time(at, zone) == local, at))


def _search(start: Column, p: Column, zone: Column, fits: Callable[[Column], Column], back: bool) -> Column:
    """The first matching local time from `start` whose moment fits, as a moment. Where one doesn't (a clock change), the
    search goes on at the next quarter of an hour."""
    hour = lambda c: F.date_trunc("HOUR", c).cast("timestamp_ntz")
    quarter = lambda c: F.floor(F.minute(c) / 15).cast("int") * 15
    on = (lambda c: hour(c) + F.make_dt_interval(mins=quarter(c)) - F.expr("interval 1 microsecond")) if back else (lambda c: hour(c) + F.make_dt_interval(mins=quarter(c) + 15))
    none = F.lit(None).cast("timestamp_ntz")
    state = lambda at, run: F.struct(at.cast("timestamp_ntz").alias("at"), run.cast("timestamp_ntz").alias("run"))

    def step(s: Column, _: Column) -> Column:
        tried = let(_local(s["at"], p, back), lambda c: let(moment(c, zone), lambda m: F.when(fits(m), state(s["at"], m)).otherwise(state(on(c), none))))
        return F.when(s["run"].isNotNull() | s["at"].isNull(), s).otherwise(tried)

    def within(n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), state(start, none), step)["run"]

    return F.coalesce(*(within(n) for n in TRIES))


def next_run(after: Column, kind: Column, step: Column, p: Column, zone: Column) -> Column:
    """The next run after a moment: of an interval after + step seconds, else by the pattern. Null if it never runs."""
    start = local_time(after, zone) + F.expr("interval 1 microsecond")
    later = after + F.make_dt_interval(secs=step.cast("decimal(18,6)"))
    return F.when(kind == "interval", F.when(step > 0, later)).otherwise(_search(start, p, zone, lambda m: m > after, False))


def latest_slot(first: Column, now: Column, kind: Column, step: Column, p: Column, zone: Column) -> Column:
    """The last slot up to now, of those that follow a first one that is due; that one if no other is. It is searched for
    backwards from now. A first slot after now comes back as it is."""
    seconds = lambda a, b: (b - a).cast("interval second").cast("decimal(18,6)")
    whole = F.floor(seconds(first, now) / step).cast("long") * step
    by_step = first + F.make_dt_interval(secs=whole.cast("decimal(18,6)"))
    # in an hour that a clock change repeats, all of its first pass lies before now
    start = let(local_time(now, zone), lambda local: local + (now - F.coalesce(moment(local, zone), now)))
    back = _search(start, p, zone, lambda m: m <= now, True)
    last = F.when(kind == "interval", F.when(step > 0, by_step)).otherwise(back)
    return F.when(first > now, first).otherwise(F.coalesce(F.greatest(last, first), first))


def term(text: Column, low: int, high: int, names: tuple[str, ...] = ()) -> Column:
    """struct(mask, fault) of a term: *, */n, a, a-b, a-b/n, names, lists of these. Faults: EMPTY, SYNTAX, RANGE, ORDER, STEP."""
    named = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, low + i))) if names else F.expr("cast(map() as map<string, int>)")
    value = lambda x: F.coalesce(F.try_element_at(named, x), x.try_cast("int"))
    shape = r"^\s*(\*|[a-z]+|\d+)(?:-([a-z]+|\d+))?(?:/(\d+))?\s*$"

    def part(raw: Column) -> Column:
        group = lambda i: F.nullif(F.regexp_extract(raw, shape, i), F.lit(""))
        star = group(1) == "*"
        a = F.when(star, low).otherwise(value(group(1)))
        b = F.when(star, high).when(group(2).isNotNull(), value(group(2))).when(group(3).isNotNull(), high).otherwise(value(group(1)))
        return F.struct(a.alias("a"), b.alias("b"), F.coalesce(group(3).try_cast("int"), F.lit(1)).alias("n"), (raw.rlike(shape) & ~(star & group(2).isNotNull())).alias("ok"))

    def judged(x: Column) -> Column:
        span = high - low
        fault = (F.when(~x["ok"] | x["a"].isNull() | x["b"].isNull(), "SYNTAX").when((x["a"] < low) | (x["a"] > high) | (x["b"] < low) | (x["b"] > high), "RANGE")
                 .when(x["a"] > x["b"], "ORDER").when((x["n"] < 1) | (x["n"] > span), "STEP"))
        bits = F.aggregate(F.sequence(x["a"], x["b"], x["n"]), F.lit(0).cast("long"), lambda m, v: m.bitwiseOR(_bit(v)))
        return let(fault, lambda f: F.struct(F.when(f.isNull(), bits).otherwise(F.lit(0).cast("long")).alias("mask"), f.alias("fault")))

    parts = F.transform(F.split(F.lower(text), ","), lambda raw: let(part(raw), judged))
    found = let(parts, lambda all_: F.struct(F.aggregate(all_, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x["mask"])).alias("mask"), F.get(F.array_compact(F.transform(all_, lambda x: x["fault"])), F.lit(0)).alias("fault")))
    empty = F.struct(F.lit(0).cast("long").alias("mask"), F.lit("EMPTY").alias("fault"))
    return F.when(text.isNull() | (F.trim(text) == ""), empty).otherwise(found)




def compiled(schedules: DataFrame) -> DataFrame:
    """schedules with `step` (seconds of an interval), `pattern` and `fault` (null if the schedule can run).

    Columns: kind (interval, hourly, daily, weekly, monthly, cron), zone, every_days to every_seconds, and as text second,
    minute, hour, month, month_day, week_day (terms; only cron takes more than numbers and lists of days), at_time
    (HH:MM:SS) and day_mode (any, month, week, either, both). A fault names the field and what is wrong with it, the
    first by order of fields; NEVER: no chosen month has a chosen day.
    """
    kind, c = F.col("kind"), F.col
    # a row takes long, and a small table may be one file: rows are dealt out before
    schedules = schedules.repartition(4 * schedules.sparkSession.sparkContext.defaultParallelism)
    timed, cron = kind.isin("daily", "weekly", "monthly"), kind == "cron"
    shape = r"^([01]\d|2[0-3]):([0-5]\d):([0-5]\d)$"
    clock = lambda i: F.regexp_extract("at_time", shape, i)
    hourly = kind == "hourly"
    texts = {
        "second": (F.when(hourly, F.coalesce(c("second"), F.lit("0"))).when(timed, clock(3)).otherwise("0"), 0, 59, ()),
        "minute": (F.when(timed, clock(2)).otherwise(c("minute")), 0, 59, ()),
        "hour": (F.when(timed, clock(1)).when(hourly, "*").otherwise(c("hour")), 0, 23, ()),
        "month": (F.when(cron, c("month")).otherwise("*"), 1, 12, MONTHS),
        "month_day": (F.when((kind == "monthly") | (cron & c("day_mode").isin("month", "either", "both")), c("month_day")).otherwise("*"), 1, 31, ()),
        "week_day": (F.when((kind == "weekly") | (cron & c("day_mode").isin("week", "either", "both")), c("week_day")).otherwise("*"), 0, 6, WEEK_DAYS),
    }
    # each exploded array has one element: what is in it is computed once a row, however often it is used
    out = schedules.select("*", F.explode(F.array(F.struct(*(term(t, a, b, n).alias(f) for f, (t, a, b, n) in texts.items())))).alias("_terms"))
    mode = F.when(kind == "weekly", "week").when(kind == "monthly", "last").when(cron, c("day_mode")).otherwise("any")
    mask = lambda f: c("_terms")[f]["mask"]
    pattern = F.struct(_highest(mask("second")).alias("second"), mask("minute").alias("minutes"), mask("hour").alias("hours"), mask("month").alias("months"), mask("month_day").alias("month_days"), mask("week_day").alias("week_days"), mode.alias("mode"), _highest(mask("month_day")).alias("last"))
    units = [F.when((c(u) < 1) | (c(u) > most), F.concat(F.lit(u), F.lit(" RANGE"))) for u, most in MOST.items()]
    interval = F.when(F.coalesce(*(c(u) for u in MOST)).isNull(), "every EMPTY").otherwise(F.coalesce(*units))
    said = [F.when(c("_terms")[f]["fault"].isNotNull(), F.concat(F.lit(f"{f} "), c("_terms")[f]["fault"])) for f in texts]
    single = [F.when(kind.isin(*kinds) & (F.bit_count(mask(f)) != 1), F.lit(f"{f} SYNTAX")) for f, kinds in (("second", ["hourly", "cron"]), ("minute", ["hourly"]), ("month_day", ["monthly"]))]
    twice = F.when((kind == "weekly") & (F.size(F.split("week_day", ",")) != F.bit_count(mask("week_day"))), "week_day DUPLICATE")
    upto = lambda n: mask("month_day").bitwiseAND((1 << (n + 1)) - 1) != 0
    some = lambda months: mask("month").bitwiseAND(months) != 0
    feasible = some(LONG_MONTHS) | (some(SHORT_MONTHS) & upto(30)) | (some(1 << 2) & upto(29))
    never = F.when(cron & c("day_mode").isin("month", "both") & ~feasible, "NEVER")
    calendar = F.coalesce(
        F.when(timed & ~F.coalesce(c("at_time").rlike(shape), F.lit(False)), "at_time SYNTAX"), *said, *single, twice,
        F.when(cron & ~F.coalesce(c("day_mode").isin("any", "month", "week", "either", "both"), F.lit(False)), "day_mode UNKNOWN"), never)
    known = kind.isin("interval", "hourly", "daily", "weekly", "monthly", "cron")
    fault = F.coalesce(F.when(~F.coalesce(known, F.lit(False)), "kind UNKNOWN"), F.when(~F.coalesce(c("zone").isin(*sorted(available_timezones())), F.lit(False)), "zone UNKNOWN"), F.when(kind == "interval", interval).otherwise(calendar))
    step = sum((F.coalesce(c(u), F.lit(0)).cast("long") * s for u, s in (("every_days", 86_400), ("every_hours", 3_600), ("every_minutes", 60), ("every_seconds", 1))), F.lit(0).cast("long"))
    made = F.explode(F.array(F.struct(F.when(kind == "interval", step).alias("step"), pattern.alias("pattern"), fault.alias("fault")))).alias("_made")
    return out.select(*schedules.columns, made).select(*schedules.columns, "_made.*")


def with_next_run(schedules: DataFrame, after: str) -> DataFrame:
    """compiled schedules with next_run after the moment in column `after`; null where the schedule has a fault."""
    run = next_run(F.col(after), F.col("kind"), F.col("step"), F.col("pattern"), F.col("zone"))
    return schedules.withColumn("next_run", F.when(F.col("fault").isNull(), run))


def with_latest_slot(schedules: DataFrame, first: str, now: str) -> DataFrame:
    """compiled schedules with latest_slot, see latest_slot(); null where the schedule has a fault."""
    slot = latest_slot(F.col(first), F.col(now), F.col("kind"), F.col("step"), F.col("pattern"), F.col("zone"))
    return schedules.withColumn("latest_slot", F.when(F.col("fault").isNull(), slot))
