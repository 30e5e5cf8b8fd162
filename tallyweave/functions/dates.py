"""Date and time text: extraction from noisy text, parsing, and differences. All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The writings of dates that are looked for, most specific first, and how the parts are put together.
WRITINGS = [
    (r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})[\s日]*(\d{1,2}):(\d{2}):(\d{2})", "{1}-{2p}-{3p} {4p}:{5}:{6}"),
    (r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})[\s日]*(\d{1,2}):(\d{2})", "{1}-{2p}-{3p} {4p}:{5}"),
    (r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})", "{1}-{2p}-{3p}"),
    (r"(\d{2})-(\d{2})[\s]*(\d{1,2})[:：][\s]*(\d{2})", "{1}-{2} {3p}:{4}"),
    (r"(\d{2})-(\d{2})(\d{1,2})[\s]+(\d{2})", "{1}-{2} {3p}:{4p}"),
    (r"(\d{2})-(\d{2})(\d{1,2})", "{1}-{2} {3p}:??"),
    (r"(\d{2})-(\d{2})[\s]*(\d{1,2})[:：]", "{1}-{2} {3p}:??"),
    (r"(\d{2})-(\d{2})", "{1}-{2}"),
]
FULL_FORMATS = ["yyyy-M-d H:m", "yyyy-M-d H:m:s", "yyyy-M-d", "yyyy/M/d H:m", "yyyy/M/d H:m:s", "yyyy/M/d", "yyyy-MM-ddHH:mm", "yyyy-MM-ddHH:mm:ss"]


def extract_datetime(text: Column) -> Column:
    """The first date or time in a noisy text in one form; a missing minute is written ``??``. NULL if none."""
    import re

    choice = None
    for pattern, shape in WRITINGS:
        parts = []
        for literal, group, pad in re.findall(r"([^{]*)(?:\{(\d)(p?)\})?", shape):
            if literal:
                parts.append(F.lit(literal))
            if group:
                part = F.regexp_extract(text, pattern, int(group))
                parts.append(F.lpad(part, 2, "0") if pad else part)
        value = F.concat(*parts)
        hit = text.rlike(pattern)
        choice = F.when(hit, value) if choice is None else choice.when(hit, value)
    return choice


def parse_datetime(text: Column, as_of_year: int) -> Column:
    """A wall-clock timestamp of a written time; texts without a year get ``as_of_year``, or the year before
    where the date does not exist in it. NULL for incomplete or impossible texts."""
    clean = F.trim(F.regexp_replace(F.trim(text), ":+$", ""))
    attempt = lambda c: F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FULL_FORMATS])
    with_year = lambda y: attempt(F.concat(F.lit(f"{y}-"), clean))
    short = clean.rlike(r"^\d\d-\d\d")
    whole = F.coalesce(attempt(clean), F.when(short, F.coalesce(with_year(as_of_year), with_year(as_of_year - 1))))
    return F.when(~clean.contains("??"), whole).cast("timestamp_ntz")


def extract_date(text: Column, as_of_year: int) -> Column:
    """The date part of a written time as text: its first ten characters, the year put before MM-DD, or the
    day of a spreadsheet serial between 40000 and 55000."""
    number = text.try_cast("double")
    return (
        F.when((F.octet_length(text) >= 10) & (F.substring(text, 5, 1) == "-"), F.substring(text, 1, 10))
        .when(text.rlike(r"^\d\d-\d\d"), F.concat(F.lit(f"{as_of_year}-"), F.substring(text, 1, 5)))
        .when((number > 40000) & (number < 55000), F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(number) - 25569).cast("int")).cast("string"))
    )


def serial_datetime(serial: Column) -> Column:
    """A spreadsheet day serial as ``YYYY-MM-DD HH:MM:SS``, counted from 1899-12-30, seconds rounded."""
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("bigint")
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit(" "), two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60))


def same_or_next_day(first: Column, second: Column) -> Column:
    """Whether the second date is the first or the day after; true where either is unknown."""
    return F.coalesce(F.datediff(second, first).isin(0, 1), F.lit(True))


def inclusive_days(start: Column, end: Column) -> Column:
    """Days from start to end with both; 1 where they are reversed or unknown."""
    return F.coalesce(F.greatest(F.datediff(end, start) + 1, F.lit(1)), F.lit(1))


def clock(hour: Column, minute: Column) -> Column:
    """HH:MM of valid parts, NULL otherwise."""
    h, m = hour.try_cast("int"), minute.try_cast("int")
    return F.when(h.between(0, 23) & m.between(0, 59), F.format_string("%02d:%02d", h, m))


def stay_year(issue: Column, month: Column) -> Column:
    """The year of a stay whose year is not written: a gap of seven months or more turns the year."""
    gap = F.month(issue) - month
    return F.year(issue) + F.when(gap >= 7, 1).when(gap <= -7, -1).otherwise(0)


def year_in_text(text: Column) -> Column:
    """The first year 2020 to 2100 that a text names."""
    year = F.regexp_extract(text, r"(20\d\d)", 1).try_cast("int")
    return F.when(year.between(2020, 2100), year)


def time_difference(a: Column, b: Column) -> Column:
    """The absolute difference of two timestamps in words: ``N分钟`` or ``H小时M分``."""
    minutes = F.abs(F.timestamp_diff("MINUTE", a, b))
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("分钟"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("小时"), (minutes % 60).cast("string"), F.lit("分")))


def repair_split_times(text: Column) -> Column:
    """Joins ``MM-DD HH:`` with minutes that a line break tore off."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d{2}-\d{2} \d{1,2}[:：])\s*\n\s*(\d{2})", "$1$2"), r"(周)\s*\n\s*([一二三四五六日])", "$1$2")
