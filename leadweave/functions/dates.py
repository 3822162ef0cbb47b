"""Column functions over time: freshness of pages, ages, stamps. The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions.text import or_empty

HOUR, DAY, WEEK, MONTH, OLDER = "hour", "day", "week", "month", "older"
# Phrases that date a page, with the unit that they count; the first in this order wins.
PHRASES = (
    (r"(?i)updated\s+(\d+)\s+hour", HOUR),
    (r"(?i)updated\s+(\d+)\s+day", DAY),
    (r"(?i)updated\s+(\d+)\s+week", WEEK),
    (r"(?i)updated\s+(\d+)\s+month", MONTH),
    (r"(?iu)mis\s+[àa]\s+jour\s+il\s+y\s+a\s+(\d+)\s+heure", HOUR),
    (r"(?iu)mis\s+[àa]\s+jour\s+il\s+y\s+a\s+(\d+)\s+jour", DAY),
    (r"(?iu)mis\s+[àa]\s+jour\s+il\s+y\s+a\s+(\d+)\s+semaine", WEEK),
    (r"(?iu)mis\s+[àa]\s+jour\s+il\s+y\s+a\s+(\d+)\s+mois", MONTH),
    (r"(?U)تم\s+التحديث\s+منذ\s+(\d+)\s+ساعة", HOUR),
    (r"(?U)تم\s+التحديث\s+منذ\s+(\d+)\s+يوم", DAY),
    (r"(?U)تم\s+التحديث\s+منذ\s+(\d+)\s+أسبوع", WEEK),
    (r"(?U)تم\s+التحديث\s+منذ\s+(\d+)\s+شهر", MONTH),
    (r"(?iu)(opened\s+recently|newly\s+opened|nouvellement\s+ouvert|جديد|حديث)", "recent"),
)
_SECONDS = {HOUR: 3600, DAY: 86_400, WEEK: 604_800, MONTH: 2_592_000}
_COARSER = {HOUR: DAY, DAY: WEEK, WEEK: MONTH, MONTH: MONTH}
FRESHNESS = "struct<last_updated:timestamp,relative_age_hint:string,calculated_age_class:string>"


def seconds_before(now: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - seconds * 1_000_000)


def age_class(at: Column, now: Column) -> Column:
    """hour, day, week, month (30 days) or older."""
    age = F.unix_micros(now) - F.unix_micros(at)
    out = F.when(age <= _SECONDS[HOUR] * 1_000_000, HOUR)
    for unit in (DAY, WEEK, MONTH):
        out = out.when(age <= _SECONDS[unit] * 1_000_000, unit)
    return out.otherwise(OLDER)


def http_date(value: Column) -> Column:
    """RFC 1123 date of a header, null if it is none. The weekday is not looked at."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(value), "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))


def _made(at: Column, hint: Column, age: Column) -> Column:
    return F.struct(at.alias("last_updated"), hint.alias("relative_age_hint"), age.alias("calculated_age_class")).cast(FRESHNESS)


def from_headers(last_modified: Column, date: Column, now: Column) -> Column:
    made = [F.when(http_date(v).isNotNull(), _made(http_date(v), F.lit(f"http:{name}"), age_class(http_date(v), now))) for v, name in ((last_modified, "last-modified"), (date, "date"))]
    return F.coalesce(*made)


def from_text(text: Column, now: Column) -> Column:
    made = []
    for pattern, unit in PHRASES:
        hint = F.trim(F.regexp_extract(or_empty(text), pattern, 0))
        if unit == "recent":
            made.append(F.when(hint != "", _made(now, hint, F.lit(HOUR))))
        else:
            n = F.translate(F.regexp_extract(or_empty(text), pattern, 1), "٠١٢٣٤٥٦٧٨٩", "0123456789").cast("long")
            made.append(F.when(hint != "", _made(seconds_before(now, n * _SECONDS[unit]), hint, F.when(n <= 1, unit).otherwise(_COARSER[unit]))))
    return F.coalesce(*made)


def freshness(text: Column, now: Column, last_modified: Column | None = None, date: Column | None = None) -> Column:
    """Headers first, then the text, else older."""
    none = F.lit(None).cast("string")
    headers = [] if last_modified is None and date is None else [from_headers(none if last_modified is None else last_modified, none if date is None else date, now)]
    return F.coalesce(*headers, from_text(text, now), _made(F.lit(None).cast("timestamp"), none, F.lit(OLDER)))


def iso(c: Column) -> Column:
    """Timestamp of ISO text, null if it is none."""
    return F.try_to_timestamp(c)


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")
