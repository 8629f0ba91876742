"""Date expressions. `now` is always an argument: no operator reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_feed_date(c: Column) -> Column:
    """ISO-8601, RFC-822 or another common spelling of a date to a timestamp, NULL when none fits.

    An ISO date must begin with year, month and day: a bare time would take the date of the day
    on which it is read. Its time may lack seconds. Other dates may lack their weekday, seconds,
    time or zone (then UTC), have a two-digit year after the month (50 to 99 are of the last
    century), a month spelt out or before the day, slashes (year first, or month first with the year
    last), AM or PM, a zone as GMT+0100 or +01:00 and a zone name in brackets. The weekday is removed
    first: pattern letter E is not accepted.
    """
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    seconds = F.regexp_replace(t, r"^(\S{10}[T ]\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]|$)"), F.try_to_timestamp(seconds))
    plain = F.regexp_replace(t, r" ?\([^)]*\)$", "")
    plain = F.regexp_replace(plain, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[A-Za-z]*,? ", "")
    plain = F.regexp_replace(plain, r"^([A-Za-z]{3})[A-Za-z]*\.? (\d{1,2}),? (\d{4})(?=,? |$)", "$2 $1 $3")
    plain = F.regexp_replace(plain, r"^(\d{1,2} [A-Za-z]{3})[A-Za-z]*\.?,? ", "$1 ")
    plain = F.regexp_replace(plain, r"^(\d{1,2} [A-Za-z]{3}) ([0-4]\d)(?= |$)", "$1 20$2")
    plain = F.regexp_replace(plain, r"^(\d{1,2} [A-Za-z]{3}) ([5-9]\d)(?= |$)", "$1 19$2")
    plain = F.regexp_replace(plain, r"(?<=\d{4}), (?=\d)", " ")
    plain = F.regexp_replace(plain, r" (\d{1,2}:\d{2})(?= |$)", " $1:00")
    plain = F.regexp_replace(plain, r" (?:GMT|UTC)?([+-]\d{2}):?(\d{2})$", " $1$2")

    def with_day(text: Column, day: str) -> Column:
        patterns = [f"{day} H:mm:ss zzz", f"{day} H:mm:ss Z", f"{day} H:mm:ss", day, f"{day} h:mm:ss a"]
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])

    def spelt(text: Column) -> Column:
        return F.when(text.rlike(r"^\d{1,2} "), with_day(text, "d MMM yyyy")).when(
            text.rlike(r"^\d{4}/"), with_day(text, "yyyy/M/d")).when(
            text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), with_day(text, "M/d/yyyy"))

    # The cleaned text is computed once and named in the lambda, not repeated in every pattern.
    return F.coalesce(iso, F.transform(F.array(plain), spelt)[0])


def normalise_ts(c: Column) -> Column:
    """ISO-8601 UTC text of a parseable date; any other text unchanged."""
    return F.coalesce(
        F.date_format(parse_feed_date(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), c
    )


def iso_date_or(c: Column, fallback: Column) -> Column:
    """A valid YYYY-MM-DD date as a timestamp, else `fallback`."""
    valid = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    return F.coalesce(valid, fallback)


def cutoff(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def recency_score(ts: Column, now: Column, window_days: int) -> Column:
    """Linear decay from 1 (now) to 0 (window edge); an unknown date scores 0.5."""
    decay = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age_days(ts, now) / window_days))
    return F.when(ts.isNull(), F.lit(0.5)).otherwise(decay)


def relative_age(ts: Column, now: Column) -> Column:
    """'3 days ago': each unit rounded from the one below it."""
    def rounded(c: Column) -> Column:
        return F.floor(c + 0.5)

    minutes = rounded((F.unix_millis(now) - F.unix_millis(ts)) / 60_000)
    hours = rounded(minutes / 60)
    days = rounded(hours / 24)

    def count_of(n: Column, unit: str) -> Column:
        plural = F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
        return F.concat(n.cast("string"), F.lit(f" {unit}"), plural, F.lit(" ago"))

    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, count_of(hours, "hour"))
        .otherwise(count_of(days, "day"))
    )


def period_label(start: Column, end: Column) -> Column:
    day = "yyyy-MM-dd"
    return F.concat(F.date_format(start, day), F.lit(" → "), F.date_format(end, day))


def window_days(start: Column, end: Column) -> Column:
    return F.floor(age_days(start, end) + 0.5).cast("bigint")
