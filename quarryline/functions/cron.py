"""Cron schedules as column expressions: validation, and the next run after a time.

The fields are minute, hour, day of month, month and weekday (0 and 7 are Sunday, or
names); each is a set of numbers, and a run needs all of them.  The next run is
found by carry: later today, or at the first time of the next day that fits, which
is looked for month by month.

Defined cases: expressions of other than five fields, with values out of range,
steps of 0, ranges that fall or steps of weekdays are invalid; a schedule that fits no
day (30 February) never runs; null expressions are invalid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_MINUTES, LONGEST = 5, 100
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DAYS = "sun mon tue wed thu fri sat".split()
#: Months that are looked through: all runs but those on rare days lie in the first span, any run in the second.
NEAR, FAR = 13, 12 * 40


def _named(field: Column, names: list[str], first: int) -> Column:
    """Names as numbers."""
    return reduce(lambda c, x: F.regexp_replace(c, rf"\b{x[1]}\b", str(x[0] + first)), enumerate(names), F.lower(field))


def _numbers(field: Column, low: int, high: int, steps: bool = True) -> Column:
    """The sorted numbers of a field; null where it is invalid."""
    parts = F.split(field, ",", -1)
    shape = r"^(\*|\d{1,2}(-\d{1,2})?)(/\d{1,3})?$" if steps else r"^(\*|\d{1,2}(-\d{1,2})?)$"

    def ends(p: Column) -> Column:
        span, step = F.split_part(p, F.lit("/"), F.lit(1)), F.split_part(p, F.lit("/"), F.lit(2)).try_cast("int")
        a = F.when(span == "*", low).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int"))
        b = F.when(span == "*", high).when(span.contains("-"), F.split_part(span, F.lit("-"), F.lit(2)).try_cast("int")).when(p.contains("/"), high).otherwise(a)
        return F.struct(a.alias("a"), b.alias("b"), F.coalesce(step, F.lit(1)).alias("s"))

    made = F.transform(parts, ends)
    fine = F.forall(parts, lambda p: p.rlike(shape)) & F.coalesce(F.forall(made, lambda e: (e["a"] >= low) & (e["b"] <= high) & (e["a"] <= e["b"]) & (e["s"] > 0)), F.lit(False))
    # The bounds keep a sequence that is worked out for an invalid part short and legal.
    spans = F.transform(made, lambda e: F.sequence(F.least(e["a"], e["b"]), e["b"], F.greatest(e["s"], F.lit(1))))
    return F.when(fine, F.array_sort(F.array_distinct(F.flatten(spans))))


def fields(expression: Column) -> Column:
    """A struct of the five sets; weekdays run from 0 for Sunday.  A set is null where its field is invalid."""
    f = F.split(F.btrim(expression, F.lit(" \t")), r"[ \t]+")
    day = _numbers(_named(f[4], _DAYS, 0), 0, 7, steps=False)
    sets = F.struct(_numbers(f[0], 0, 59).alias("minute"), _numbers(f[1], 0, 23).alias("hour"), _numbers(f[2], 1, 31).alias("day"), _numbers(_named(f[3], _MONTHS, 1), 1, 12).alias("month"), F.array_sort(F.array_distinct(F.transform(day, lambda d: d % 7))).alias("weekday"))
    return F.when((F.size(f) == 5) & (F.length(expression) <= LONGEST), sets)


def _fits(s: Column, day: Column) -> Column:
    return F.array_contains(s["month"], F.month(day)) & F.array_contains(s["day"], F.day(day)) & F.array_contains(s["weekday"], F.dayofweek(day) - 1)


def _next_day(s: Column, after: Column, months: int) -> Column:
    """The first day later than ``after`` that fits, in the month of ``after`` and the ``months`` that follow."""
    start = F.trunc(after, "month")
    wanted = F.filter(F.transform(F.sequence(F.lit(0), F.lit(months)), lambda i: F.add_months(start, i)), lambda m: F.array_contains(s["month"], F.month(m)))

    def first_in(m: Column) -> Column:
        inside = F.filter(s["day"], lambda d: d <= F.day(F.last_day(m)))
        days = F.transform(inside, lambda d: F.date_add(m, d - 1))
        return F.array_min(F.filter(days, lambda d: (d > after) & F.array_contains(s["weekday"], F.dayofweek(d) - 1)))

    return F.array_min(F.transform(wanted, first_in))


def next_run(sets: Column, after: Column, zone: Column | str = "UTC") -> Column:
    """The first run later than ``after`` (a timestamp), null if there is none; ``sets`` is a column made by ``fields``, and the fields are of local time in ``zone``."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    local = F.from_utc_timestamp(after, zone)
    today, now = F.to_date(local), F.hour(local) * 60 + F.minute(local)
    # Later today: another minute of this hour, or the first minute of a later hour.
    this = F.array_min(F.filter(sets["minute"], lambda m: (m > F.minute(local)) & F.array_contains(sets["hour"], F.hour(local))))
    hour = F.array_min(F.filter(sets["hour"], lambda h: h > F.hour(local)))
    late = F.coalesce(F.hour(local) * 60 + this, hour * 60 + F.array_min(sets["minute"]))
    first = F.array_min(sets["hour"]) * 60 + F.array_min(sets["minute"])
    same = F.when(_fits(sets, today) & (late > now), late)
    day = F.coalesce(_next_day(sets, today, NEAR), _next_day(sets, today, FAR))
    at = F.coalesce(F.timestamp_add("MINUTE", same, today.cast("timestamp")), F.timestamp_add("MINUTE", first, day.cast("timestamp")))
    return F.to_utc_timestamp(at, zone)


def problem(sets: Column) -> Column:
    """What is wrong with a schedule, null if nothing: invalid, never runs, or runs more often than every ``LEAST_MINUTES`` minutes."""
    invalid = sets.isNull() | reduce(lambda a, b: a | b, (sets[n].isNull() for n in ("minute", "hour", "day", "month", "weekday")))
    m, h = sets["minute"], sets["hour"]
    inside = F.exists(F.zip_with(m, F.slice(m, 2, 60), lambda a, b: b - a), lambda g: g < LEAST_MINUTES)
    neighbours = F.exists(h, lambda x: F.array_contains(h, (x + 1) % 24))
    across = neighbours & (60 - F.array_max(m) + F.array_min(m) < LEAST_MINUTES)
    # Every day of the month that a month has meets every weekday in some year.
    length = F.array(*map(F.lit, (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))
    never = ~F.exists(sets["month"], lambda m: F.array_min(sets["day"]) <= F.get(length, m - 1))
    return F.when(invalid, "invalid").when(never, "never runs").when(inside | across, f"runs more often than every {LEAST_MINUTES} minutes")
