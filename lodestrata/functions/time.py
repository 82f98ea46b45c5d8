"""Column functions on dates and moments. All moments are UTC; `as_of` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days up to which evidence is recent, and prior.
RECENT_DAYS, PRIOR_DAYS = 90, 180


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a moment without a zone (UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment.cast("timestamp_ntz"))


def utc_text(value: Column) -> Column:
    """A moment's text as UTC with a Z; what does not parse stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss'Z'"), value)


def lenient_date(text: Column) -> Column:
    """The first 20yy-m-d (or -, /, 年月日, day optional: 1) in a text; null if there is no such day."""
    p = r"(20\d{2})[-/年](\d{1,2})(?:[-/月](\d{1,2}))?"
    part = lambda k: F.regexp_extract(text, p, k)
    made = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(F.when(part(3) == "", "1").otherwise(part(3)), 2, "0"))
    return F.when(part(1) == "", F.lit(None).cast("date")).otherwise(F.try_to_timestamp(made, F.lit("yyyy-MM-dd")).cast("date"))


def available_timeline(published: Column, observed: Column, occurred: Column) -> Column:
    """The later of publication and observation, else the event's own date."""
    return F.coalesce(F.greatest(published, observed), occurred)


def available_backtest(published: Column, observed: Column) -> Column:
    """The later of publication and observation; no fallback."""
    return F.greatest(published, observed)


def available_training(published: Column, observed: Column) -> Column:
    """The first that is known of publication and observation."""
    return F.coalesce(published, observed)


def age_bucket(occurred: Column, as_of: Column) -> Column:
    """0-90, 91-180 or undated; null if later than as_of or older."""
    age = F.datediff(as_of, occurred)
    return F.when(occurred.isNull(), "undated").when(age.between(0, RECENT_DAYS), "0-90").when(age.between(RECENT_DAYS + 1, PRIOR_DAYS), "91-180")


def decayed(weight: Column, occurred: Column, as_of: Column, half_life: Column) -> Column:
    """weight x 2**(-age / half_life); an undated row is 30 days old, a future one 0."""
    age = F.coalesce(F.greatest(F.datediff(as_of, occurred), F.lit(0)), F.lit(30))
    return weight * F.pow(F.lit(2.0), -age / half_life)


def recency(occurred: Column, as_of: Column) -> Column:
    return 1.0 / (1.0 + F.datediff(as_of, occurred) / 30.0)


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(micros(a) - micros(b)) / 86_400e6


def month_bucket(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def shifted_months(day: Column, months: int) -> Column:
    """The same day so many months on, or the month's last if it is shorter."""
    return F.add_months(day, months)


def month_end(day: Column, months: int = 0) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "month"), months))


def cutoffs_before(day: Column, n: int) -> Column:
    """The last n month ends before a day, oldest first."""
    return F.transform(F.sequence(F.lit(n), F.lit(1)), lambda i: F.last_day(F.add_months(F.trunc(day, "month"), -i)))


def relative_date(text: Column, base: Column) -> Column:
    """The day that 'N days / weeks / months ago' names before a base day; a month is 30 days."""
    n = F.regexp_extract(text, r"(\d+)\s*(day|week|month)s? ago", 1)
    unit = F.regexp_extract(text, r"(\d+)\s*(day|week|month)s? ago", 2)
    size = F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)
    return F.when(n != "", F.date_sub(base, (n.try_cast("int") * size).cast("int")))


def billing_day(moment: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.from_utc_timestamp(moment, zone).cast("date")


def query_window(text: Column) -> Column:
    """The dates after after: and before: in a search query."""
    day = lambda key: F.try_to_timestamp(F.nullif(F.regexp_extract(text, key + r":(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    return F.struct(day("after").alias("after"), day("before").alias("before"))


def jitter(key: Column, spread: float) -> Column:
    """A steady pseudo-random share in [-spread, spread] from the sha256 of a key."""
    share = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
    return (share * 2 - 1) * spread
