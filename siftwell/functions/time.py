"""Dates and times as Column expressions; instants are UTC."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.constants import EXTENDED_DAYS, IST, NEAR_DAYS, OPENED_DAYS


_DATE = r"(\d{4})(?:-?(\d{2})-?(\d{2})|-(\d{2})|-?W(\d{2})(?:-?([1-7]))?|-?(\d{3}))?"
_CLOCK = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_ISO = rf"^{_DATE}(?:\D{_CLOCK}(?:([Zz])|([+-])(\d{{2}}):?(\d{{2}})?)?)?$"


def _any_iso(t: Column, zone: Column) -> Column:
    """The forms that a cast does not read: basic, week and ordinal dates, hour 24, other separators."""
    parts = F.split(F.regexp_replace(t, _ISO, "|".join(f"${n}" for n in range(1, 16))), r"\|")

    def read(p: Column) -> Column:
        part = lambda n, other: F.coalesce(p[n - 1].try_cast("int"), F.lit(other))
        or_first = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("01"))
        month_day = F.concat_ws("-", p[0], or_first(F.concat(p[1], p[3])), or_first(p[2])).try_cast("date")
        monday = F.trunc(F.concat(p[0], F.lit("-01-04")).try_cast("date"), "week")
        by_week = F.when(part(5, 1).between(1, 53), F.date_add(monday, (part(5, 1) - 1) * 7 + part(6, 1) - 1))
        by_day = F.date_add(F.concat(p[0], F.lit("-01-01")).try_cast("date"), part(7, 1) - 1)
        day = F.when(p[4] != "", by_week).when(p[6] != "", F.when(F.year(by_day) == part(1, 0), by_day)).otherwise(month_day)
        micros = F.coalesce(F.rpad(F.nullif(p[10], F.lit("")), 6, "0").cast("long"), F.lit(0))
        late = (part(8, 0) == 24) & (part(9, 0) + part(10, 0) + micros == 0)
        sound = (part(9, 0) < 60) & (part(10, 0) < 60) & ((part(8, 0) < 24) | late) & (part(14, 0) < 24) & (part(15, 0) < 60)
        span = ((part(8, 0) * 60 + part(9, 0)) * 60 + part(10, 0)).cast("long") * 1_000_000 + micros
        when = F.when(sound, F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + span))
        offset = F.when(p[12] == "-", -1).otherwise(1) * (part(14, 0) * 60 + part(15, 0))
        aware = F.concat(p[11], p[12]) != ""
        return F.when(aware, when - F.make_dt_interval(F.lit(0), F.lit(0), offset)).otherwise(F.to_utc_timestamp(when, zone))

    return F.transform(F.array(parts), read)[0]


def iso_parse(x: Column, zone: str | Column = "UTC") -> Column:
    """ISO date or date-time -> UTC; without an offset it is local to ``zone``. Null on failure. The session's zone is UTC."""
    t = F.trim(x)
    zone = F.lit(zone) if isinstance(zone, str) else zone
    plain = t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3]):\d{2}(?::\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?)?$")
    aware = t.rlike(r"[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:\d{2})$")
    return (
        F.when(plain & aware, t.try_cast("timestamp")).when(plain, F.to_utc_timestamp(t.try_cast("timestamp_ntz").cast("timestamp"), zone))
        .when(t.rlike(_ISO), _any_iso(t, zone))
    )


def epoch_millis(x: Column) -> Column:
    """Positive finite milliseconds -> instant."""
    n = x.try_cast("double")
    return F.when((n > 0) & (n < 2.5e14), F.timestamp_millis(n.cast("long")))


def local(ts: Column, zone: str = IST) -> Column:
    return F.from_utc_timestamp(ts, zone)


def ist_display(ts: Column) -> Column:
    return F.date_format(local(ts), "EEE, dd MMM · h:mm a 'IST'")


def ist_date(ts: Column) -> Column:
    return F.date_format(local(ts), "yyyy-MM-dd")


def day_bound(text: str, end: bool, zone: str = IST) -> tuple[dt.datetime, bool]:
    """A bound of a filter -> (UTC instant, exclusive). A date is a whole local day; a timestamp must carry an offset."""
    if len(text) == 10:
        day = dt.date.fromisoformat(text) + dt.timedelta(days=int(end))
        return dt.datetime.combine(day, dt.time(), ZoneInfo(zone)).astimezone(dt.UTC), end
    when = dt.datetime.fromisoformat(text)
    if when.tzinfo is None:
        raise ValueError("a timestamp must carry an offset")
    return when.astimezone(dt.UTC), False


def urgency(starts_at: Column, now: Column) -> Column:
    gap = F.unix_micros(starts_at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    day = 86_400_000_000
    return F.when(gap.isNull() | (gap < 0), 0).when(gap <= 2 * day, 4).when(gap <= 7 * day, 2).otherwise(0)


def within_window(starts_at: Column, ends_at: Column, opened_at: Column, first_open_at: Column, now: Column) -> Column:
    days = lambda n: F.make_dt_interval(F.lit(n))
    near = starts_at <= now + days(NEAR_DAYS)
    recent = F.coalesce(F.coalesce(opened_at, first_open_at) >= now - days(OPENED_DAYS), F.lit(False)) & (starts_at <= now + days(EXTENDED_DAYS))
    return F.coalesce(starts_at.isNotNull() & ~(F.coalesce(ends_at, starts_at) < now - days(1)) & (near | recent), F.lit(False))


def iso_text(ts: Column) -> Column:
    """As a change log stores an instant: microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(ts.cast("timestamp")) % 1_000_000 == 0, F.concat(whole, F.lit("+00:00"))).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def backoff_minutes(attempts: Column) -> Column:
    return F.least(F.lit(60), F.pow(F.lit(2), attempts)).cast("long")
