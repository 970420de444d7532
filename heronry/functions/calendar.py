"""Calendar and number rules as columns: months, weeks, waits, projections, axis steps. All instants are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(c: Column) -> Column:
    """An instant as text with milliseconds and Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def instant(c: Column) -> Column:
    """Text of an instant, also with an offset without colon; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def days_before(c: Column, days: int) -> Column:
    return c - F.make_dt_interval(F.lit(days))


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_plus(c: Column, count) -> Column:
    """YYYY-MM some months on."""
    return F.date_format(F.add_months(F.to_date(F.concat(c, F.lit("-01"))), count), "yyyy-MM")


def months_back(now: Column, since: Column, most: int = 12) -> Column:
    """The last `most` months up to now's, oldest first, from the month of `since` on."""
    last = F.trunc(now, "month")
    first = F.greatest(F.add_months(last, 1 - most), F.trunc(since, "month"))
    return F.when(first > last, F.expr("cast(array() AS array<string>)")).otherwise(F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM")))


def week_start(c: Column) -> Column:
    """Monday of the instant's week, as a date."""
    return F.trunc(c, "week")


def bucket_start(label: Column) -> Column:
    """First instant of a month (YYYY-MM) or week (YYYY-MM-DD)."""
    return F.to_date(F.when(F.length(label) == 7, F.concat(label, F.lit("-01"))).otherwise(label)).cast("timestamp")


def bucket_end(label: Column) -> Column:
    """Last millisecond of a month or week."""
    start = bucket_start(label)
    after = F.when(F.length(label) == 7, F.add_months(start, 1)).otherwise(F.date_add(start, 7)).cast("timestamp")
    return after - F.expr("interval 1 millisecond")


def clipped_coverage(stored_from: Column, first_append: Column, view_from: Column) -> Column:
    """Where recorded coverage begins in a view: the latest of what is stored, appended and shown."""
    return F.greatest(stored_from, F.coalesce(first_append, stored_from), view_from)


def elapsed_share(now: Column, unit: str) -> Column:
    """Share of now's month or day that has passed."""
    start = F.date_trunc(unit, now)
    stop = F.when(F.lit(unit == "month"), F.add_months(start, 1)).otherwise(F.date_add(start, 1)).cast("timestamp")
    return (F.unix_micros(now) - F.unix_micros(start)) / (F.unix_micros(stop) - F.unix_micros(start))


def whole_days(since: Column, until: Column) -> Column:
    return F.floor((F.unix_micros(until) - F.unix_micros(since)) / 86_400_000_000).cast("long")


def age_state(age_ms: Column, warn_ms: int, firing_ms: int) -> Column:
    """ok, warning or firing by age; firing where nothing is known."""
    return F.when(age_ms.isNull() | (age_ms >= firing_ms), "firing").when(age_ms >= warn_ms, "warning").otherwise("ok")


def release_time(release: Column) -> Column:
    """The instant in a release id such as feed-20240131T120000Z-ab12; null where there is none."""
    return F.try_to_timestamp(F.regexp_extract(release, r"(\d{8}T\d{6})Z", 1), F.lit("yyyyMMdd'T'HHmmss"))


def backfill_start(c: Column, now: Column, most_days: int = 365) -> Column:
    """A valid date that isn't in the future and at most `most_days` back, as text; else null."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(c)))
    return F.when((day <= F.to_date(now)) & (day >= F.date_sub(F.to_date(now), most_days)), c)


def rounded4(c: Column) -> Column:
    """Four decimals, halves up."""
    return F.floor(c * 10_000 + 0.5) / 10_000


def floored(c: Column, decimals: int) -> Column:
    """Down to so many decimals, after rounding away what a sum of binary fractions leaves behind."""
    scale = 10**decimals
    return F.floor(F.round(c * scale, 6)) / scale


def projected(value: Column, share: Column) -> Column:
    """A count carried on in proportion to the end of the period; the count itself before anything has passed."""
    return F.when(share > 0, value / share).otherwise(value)


def nice_step(top: Column, ticks: int = 3, largest: float | None = None) -> Column:
    """1, 2 or 5 times a power of ten, that gives at most `ticks` steps up to top; null where that is above `largest`."""
    raw = F.greatest(F.lit(1.0), top.cast("double")) / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    steps = F.filter(F.array(*[power * k for k in (1, 2, 5, 10)]), lambda s: s >= raw)
    step = F.greatest(F.lit(1.0), F.coalesce(F.get(steps, 0), power * 10))
    return step if largest is None else F.when(step <= largest, step)


def cost_units(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Units for a call, prices a million tokens, to the nearest unit, halves up."""
    return F.floor((input_tokens * input_price + output_tokens * output_price) / 1_000_000 + 0.5).cast("long")


def backoff_hours(strikes: Column, first: int = 24, most: int = 720) -> Column:
    """Hours of quarantine: doubled with each strike, up to `most`."""
    return F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), strikes)).cast("long")
