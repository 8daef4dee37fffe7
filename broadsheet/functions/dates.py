"""Dates and times as column expressions. Nothing reads the clock: `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank


def parse(value: Column | str, zone: str = "UTC", missing: Column | None = None) -> Column:
    """ISO 8601 and RFC 822 dates; one without a zone is local to `zone`; what can't be parsed is `missing` (null by default)."""
    v = F.trim(blank(value))
    zoned = v.rlike(r"(?i)(?:z|[+-]\d{2}:?\d{2}|gmt|utc)$")
    iso = F.try_to_timestamp(v)
    mail = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3},\s*", ""), r"(?i)\s*(?:gmt|utc)$", " +0000")
    rfc = F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")))
    found = F.coalesce(iso, rfc)
    out = F.when(zoned, found).otherwise(F.to_utc_timestamp(found, zone))
    return F.coalesce(out, missing) if missing is not None else out


def parse_policy(value: Column | str, policy: str, now: Column, zone: str = "America/Toronto") -> Column:
    """parse() under the rules of one use.

    collected   local without a zone, now where there is none
    ranked      UTC without a zone, the epoch where there is none
    audited     UTC without a zone, null where there is none
    indexed     as audited, but a time ahead of now by more than half an hour is none
    stored      ISO 8601 alone, UTC without a zone, null where there is none
    """
    if policy == "collected":
        return parse(value, zone, now)
    if policy == "ranked":
        return parse(value, "UTC", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    if policy == "audited":
        return parse(value)
    if policy == "indexed":
        found = parse(value)
        return F.when(found <= now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30)), found)
    if policy == "stored":
        v = F.trim(blank(value))
        return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), parse(v))
    raise ValueError(policy)


def duration_label(minutes: Column) -> Column:
    """"45 min", "2 hr", "2 hr 5 min"."""
    whole = F.floor(minutes)
    hours, rest = F.floor(whole / 60), whole % 60
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes.isNull() | (minutes < 0), "Unknown").when(whole < 60, text(whole, " min")).when(rest == 0, text(hours, " hr")).otherwise(F.concat(text(hours, " hr "), text(rest, " min")))


def next_slot(now: Column, slots: tuple[int, ...] = (17, 47)) -> Column:
    """The next time that a schedule by minutes of the hour comes round, after now's minute."""
    hour, minute = F.date_trunc("hour", now), F.minute(now)
    after = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))
    out = None
    for m in slots:
        out = F.when(minute < m, hour + after(m)) if out is None else out.when(minute < m, hour + after(m))
    return out.otherwise(hour + after(60 + slots[0]))


def hours_between(now: Column, then: Column) -> Column:
    """Hours from then to now, none for the future; null without a then."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(3_600_000_000.0)))


def freshness(now: Column, published: Column, steps: tuple) -> Column:
    age = hours_between(now, published)
    out = None
    for hours, score in steps:
        out = F.when(age <= hours, score) if out is None else out.when(age <= hours, score)
    return F.coalesce(out.otherwise(0), F.lit(0))


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_group(ts: Column, reference: Column, zone: str) -> Column:
    """Today, yesterday, two days ago or earlier, by local days."""
    days = F.datediff(local_day(reference, zone), local_day(ts, zone))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days == 2, "two-days-ago").otherwise("earlier")


def relative_label(now: Column, ts: Column) -> Column:
    """"5 minutes ago" and the like."""
    minutes = F.floor(F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    unit = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(ts.isNull(), "").when(minutes < 1, "Just now").when(minutes < 60, unit(minutes, "minute")).when(minutes < 1440, unit(F.floor(minutes / 60), "hour")).otherwise(unit(F.floor(minutes / 1440), "day"))


def feed_state(now: Column, generated: Column) -> Column:
    """How old a feed is: fresh to 50 minutes, late to 70, then stale."""
    minutes = hours_between(now, generated) * 60
    return F.when(generated.isNull(), "unknown").when(minutes <= 50, "fresh").when(minutes <= 70, "late").otherwise("stale")


def local_format(ts: Column, zone: str, pattern: str = "MMM d, yyyy, h:mm a") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)
