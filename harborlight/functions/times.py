"""Times as lists and feeds write them: relative, spoken and bare clock times; results are UTC.

The session's time zone must be UTC, as the queries set it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for now, seconds of the units of "N units ago", days before today, and the patterns of the texts.
NOW_WORDS = ("刚刚", "刚才", "现在", "just now")
UNIT_SECONDS = {"秒钟": 1, "秒": 1, "分钟": 60, "分": 60, "个小时": 3600, "小时": 3600, "时": 3600, "天": 86400, "日": 86400, "个星期": 604800, "星期": 604800, "周": 604800, "个月": 2592000, "月": 2592000}
DAYS_BACK = {"今天": 0, "今日": 0, "昨天": 1, "昨日": 1, "前天": 2, "前日": 2}

_CLOCK = r"(\d{1,2})[:：时点](\d{1,2})(?:[:：分](\d{1,2}))?秒?"
_AGO = rf"^(\d+(?:\.\d+)?)\s*({'|'.join(UNIT_SECONDS)})\s*(?:之)?前$"
_DAY = rf"^({'|'.join(DAYS_BACK)})\s*(?:{_CLOCK})?$"
_MONTH_DAY = rf"^(\d{{1,2}})\s*[-/月.]\s*(\d{{1,2}})\s*日?(?:\s+{_CLOCK})?$"
_FULL = rf"^(\d{{4}})\s*[-/年.]\s*(\d{{1,2}})\s*[-/月.]\s*(\d{{1,2}})\s*日?(?:[\sT]+{_CLOCK})?$"
_BARE = r"^(\d{1,2})[:：](\d{2})(?:[:：](\d{2}))?$"


def spoken_zone(market: Column) -> Column:
    """Zone of spoken times: New York for the US, else Shanghai."""
    return F.when(F.lower(F.trim(market)) == "us", "America/New_York").otherwise("Asia/Shanghai")


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _groups(text: Column, pattern: str, first: int, n: int) -> list[Column]:
    """The groups from ``first`` on as numbers; one that is not there is 0."""
    return [F.coalesce(F.regexp_extract(text, pattern, first + i).try_cast("int"), F.lit(0)) for i in range(n)]


def spoken_time(raw: Column, market: Column, now: Column) -> Column:
    """Relative, day, month-day and full dates; null if the text is none of them, or no real time.

    A date without a year is of this year, or of last year if that is over a day ahead.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("　"), F.lit(" ")), "发布于|更新于", ""), r"\s+", " "))
    zone = spoken_zone(market)
    local = F.from_utc_timestamp(now, zone)
    micros = F.unix_micros(now.cast("timestamp"))
    ago = F.regexp_extract(text, _AGO, 1).try_cast("double") * _lookup(UNIT_SECONDS, F.regexp_extract(text, _AGO, 2)) * 1000000
    back = F.date_sub(F.to_date(local), _lookup(DAYS_BACK, F.regexp_extract(text, _DAY, 1)))
    of_day = F.try_make_timestamp(F.year(back), F.month(back), F.day(back), *_groups(text, _DAY, 2, 3))
    month_day = _groups(text, _MONTH_DAY, 1, 5)
    years = [F.try_make_timestamp(F.year(local) - y, *month_day) for y in (0, 1)]
    recent = F.coalesce(*(F.when(x <= local + F.expr("interval 1 day"), x) for x in years))
    return (
        F.when(F.lower(text).isin(*NOW_WORDS), F.timestamp_seconds(F.floor(micros / 1000000)))
        .when(text.rlike(_AGO), F.timestamp_seconds(F.floor((micros - ago) / 1000000)))
        .when(text.rlike(_DAY), F.to_utc_timestamp(of_day, zone))
        .when(text.rlike(_FULL), F.to_utc_timestamp(F.try_make_timestamp(*_groups(text, _FULL, 1, 6)), zone))
        .when(text.rlike(_MONTH_DAY), F.to_utc_timestamp(recent, zone))
    )


def clock_time(raw: Column, market: Column, now: Column) -> Column:
    """A bare clock time of today; one more than two hours ahead is yesterday's."""
    text, zone = F.trim(raw), spoken_zone(market)
    local = F.from_utc_timestamp(now, zone)
    at = F.try_make_timestamp(F.year(local), F.month(local), F.day(local), *_groups(text, _BARE, 1, 3))
    return F.when(text.rlike(_BARE), F.to_utc_timestamp(F.when(at > local + F.expr("interval 2 hours"), at - F.expr("interval 1 day")).otherwise(at), zone))


def hour_bucket(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH"), F.lit("unknown"))


def clamp_days(days: Column, default: int = 30, least: int = 1, most: int = 90) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(days, F.lit(default))))


def next_time_of_day(now: Column, hour: int, minute: int, zone: str) -> Column:
    """The next moment, after ``now``, at which clocks in ``zone`` show the time: the end of quiet hours."""
    local = F.from_utc_timestamp(now, zone)
    at = F.date_trunc("day", local) + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
    return F.to_utc_timestamp(F.when(at <= local, at + F.expr("interval 1 day")).otherwise(at), zone)
