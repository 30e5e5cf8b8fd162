"""Stays and journeys in the remarks of documents.

A text is read once into tokens: dates (with or without year and month), words that join two dates, labels of arrival
and departure, counts of nights. Stays are then short patterns over the tokens. Distinct texts of an Arrow batch are
read once. A year that is missing is the one that brings the month nearest to the document's date.

Defined results: NULL or a text without a stay gives NULL; a stay that ends before it begins or lasts over 366 nights is none; a
stay within one day counts one night.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import narrow, squeeze_date_blanks

# Labels, joining words, words that show that two dotted numbers are dates, and bounds.
ARRIVE, LEAVE = ("入住", "住店"), ("离店", "退房")
STAY_WORDS = ("入住", "离店", "住宿", "日期", "住店", "退房", "期间")
MOST_NIGHTS, ROLL_DAYS, MONTHS_APART = 366, 92, 7
FIRST_YEAR, LAST_YEAR = 2020, 2100
TOKEN = re.compile(
    r"(?P<year>\d{4})[年\-./](?P<month>\d{1,2})[月\-./](?P<day>\d{1,2})[日号]?"
    r"|(?P<han_month>\d{1,2})月(?P<han_day>\d{1,2})[日号]?"
    r"|(?P<pair_month>\d{1,2})(?P<sign>[-/.])(?P<pair_day>\d{1,2})(?!\d)"
    r"|[共住]计?\s*(?P<nights>\d+)\s*[天晚]"
    r"|(?P<only_day>\d{1,2})[日号]|(?P<bare>\d{1,2})(?!\d)"
    r"|(?P<label>入住|住店|离店|退房)|(?P<to>起?至|到|~|[-–—]+)"
)
KIND = "struct<check_in: date, check_out: date, nights: int>"


class Token(NamedTuple):
    kind: str  # date, label, to, nights
    style: str  # of a date: full, han, the sign between its numbers, day or bare
    year: int | None
    month: int | None
    day: int
    start: int
    end: int
    word: str


def tokens(text: str) -> list[Token]:
    out = []
    for m in TOKEN.finditer(text):
        g, at = m.groupdict(), (m.start(), m.end(), m[0])
        if g["year"]:
            out.append(Token("date", "full", int(g["year"]), int(g["month"]), int(g["day"]), *at))
        elif g["han_month"]:
            out.append(Token("date", "han", None, int(g["han_month"]), int(g["han_day"]), *at))
        elif g["pair_month"]:
            out.append(Token("date", g["sign"], None, int(g["pair_month"]), int(g["pair_day"]), *at))
        elif g["nights"]:
            out.append(Token("nights", "", None, None, int(g["nights"]), *at))
        elif g["only_day"] or g["bare"]:
            out.append(Token("date", "day" if g["only_day"] else "bare", None, None, int(g["only_day"] or g["bare"]), *at))
        else:
            out.append(Token("label" if g["label"] else "to", "", None, None, 0, *at))
    return out


def day_of(y: int, m: int, d: int) -> dt.date | None:
    try:
        return dt.date(y, m, d)
    except ValueError:
        return None


def year_near(month: int, date: dt.date) -> int:
    """The year of a month without one, by the document's date: half a year away is the next or the last year."""
    apart = date.month - month
    return date.year + (apart >= MONTHS_APART) - (apart <= -MONTHS_APART)


def resolved(t: Token, date: dt.date, since: dt.date | None = None) -> dt.date | None:
    """The day of a token; what is missing comes from the arrival, if known, else from the document's date."""
    if t.year:
        return day_of(t.year, t.month, t.day)
    if t.month:
        if since:
            same, later = day_of(since.year, t.month, t.day), day_of(since.year + 1, t.month, t.day)
            if same and same >= since:
                return same
            if later and (later - since).days <= ROLL_DAYS:
                return later
        return day_of(year_near(t.month, date), t.month, t.day)
    if since is None:
        return day_of(date.year, date.month, t.day)
    same = day_of(since.year, since.month, t.day)
    if same and same >= since:
        return same
    return day_of(since.year + since.month // 12, since.month % 12 + 1, t.day)


def stay(arrival: dt.date | None, departure: dt.date | None) -> tuple[dt.date, dt.date, int] | None:
    if not arrival or not departure or not 0 <= (departure - arrival).days <= MOST_NIGHTS:
        return None
    return arrival, departure, max(1, (departure - arrival).days)


def _ranges(text: str, ts: list[Token]) -> list[tuple[Token, Token]]:
    """Pairs of dates with only a joining word between them."""
    out = []
    for a, to, b in zip(ts, ts[1:], ts[2:]):
        if a.kind == b.kind == "date" and to.kind == "to" and not text[a.end : to.start].strip() and not text[to.end : b.start].strip():
            out.append((a, b))
    return out


def _short(a: Token, b: Token, text: str, date: dt.date) -> tuple[dt.date, dt.date] | None:
    if a.style == "han" and b.style in ("han", "day", "bare"):
        b = b._replace(month=b.month or a.month)
    elif a.style != b.style or a.style not in "-/." or (a.style == "." and "-" in text[a.end : b.start] and not any(w in text for w in STAY_WORDS)):
        return None
    first, last = (day_of(year_near(t.month, date), t.month, t.day) for t in (a, b))
    if first and last and last < first:
        last = day_of(last.year + 1, last.month, last.day)
    return (first, last) if first and last else None


def _beside(text: str, ts: list[Token], labels: tuple[str, ...], after_first: bool) -> list[Token]:
    """Dates right before or after a label, in the order of the labels."""
    out = []
    for word in labels:
        for k, t in enumerate(ts):
            if t.kind != "label" or t.word != word:
                continue
            after = [x for x in ts[k + 1 : k + 2] if x.kind == "date" and x.style != "bare" and re.fullmatch(r"(?:时间|日期)?[:：]?\s*", text[t.end : x.start])]
            before = [x for x in ts[:k] if x.kind == "date" and x.style != "bare" and re.fullmatch(r"(?:[（(][^（）()]{1,6}[）)])?(?:\s*\d{1,2}[:：]\d{2})?\s*", text[x.end : t.start])][-1:]
            out += after + before if after_first else before + after
    return out


@lru_cache(maxsize=100_000)
def read_stay(text: str, date: dt.date) -> tuple[dt.date, dt.date, int] | None:
    """(arrival, departure, nights) from a remark in one width without blanks inside of dates."""
    ts = tokens(text)
    ranges = _ranges(text, ts)
    for a, b in ranges:
        if a.style == "full" and b.style not in ("day", "bare"):
            first = resolved(a, date)
            last = resolved(b, date)
            if b.style != "full" and first and last and last < first:
                last = day_of(last.year + 1, last.month, last.day)
            return stay(first, last)
    for style in ("han", "-", "/", "."):
        for a, b in ranges:
            if a.style == style and (found := _short(a, b, text, date)):
                return stay(*found)
    arrivals, departures = _beside(text, ts, ARRIVE, False), _beside(text, ts, LEAVE, True)
    for a in arrivals:
        first = resolved(a, date)
        for b in departures if first else ():
            if (last := resolved(b, date, first)) and last >= first:
                return stay(first, last)
    nights = next((t.day for t in ts if t.kind == "nights"), 0)
    if nights and (first := next((x for t in arrivals if (x := resolved(t, date))), None)):
        return stay(first, first + dt.timedelta(days=nights))
    if nights and (last := next((x for t in departures if (x := resolved(t, date))), None)):
        return stay(last - dt.timedelta(days=nights), last)
    return None


def stay_in(remarks: Column, date: Column) -> Column:
    """The stay that a remark tells: struct of check_in, check_out and nights; NULL if there is none."""

    @F.pandas_udf(KIND)
    def run(text: pd.Series, day: pd.Series) -> pd.DataFrame:
        found = [read_stay(t, d) if isinstance(t, str) and d is not None and not pd.isna(d) else None for t, d in zip(text, day)]
        return pd.DataFrame([x or (None, None, None) for x in found], columns=["check_in", "check_out", "nights"]).astype({"nights": "Int32"})

    told = run(squeeze_date_blanks(narrow(remarks)), date)
    return F.when(told["check_in"].isNotNull(), told)


# ---------------------------------------------------------------- columns only


def nights_told(remarks: Column) -> Column:
    """The number of nights that a remark counts; NULL if none."""
    return F.regexp_extract(squeeze_date_blanks(narrow(remarks)), r"[共住]计?\s*(\d+)\s*[天晚]", 1).try_cast("int")


def item_nights(items: Column) -> Column:
    """The quantity of a lodging item: the number before its price; NULL if none."""
    row = F.regexp_extract(items, r"\*(?:住宿服务|生产生活服务)\*.*?\s+(?:天\s+)?(\d+)\s+[\d,.]+", 1)
    return F.coalesce(F.nullif(row, F.lit("")), F.regexp_extract(items, r"天\s*(\d)", 1)).try_cast("int")


def checked_nights(told: Column, quantity: Column, stay_nights: Column) -> Column:
    """Nights of a lodging: the larger of remark and item where both count them, an item of one doesn't count; else the stay's; else 1."""
    trusted = F.when(quantity > 1, quantity)
    return F.coalesce(F.greatest(told, trusted), stay_nights, F.lit(1))


def statement_stay(text: Column) -> Column:
    """The stay of a statement with labelled days of arrival and departure, written with a year."""
    clean = squeeze_date_blanks(narrow(text))

    def labelled(*labels: str) -> Column:
        days = []
        for label in labels:
            rest = F.regexp_extract(clean, label + r":?\s*([^\n]+)", 1)
            parts = [F.regexp_extract(rest, r"(\d{4})[年\-/.](\d{1,2})[月\-/.](\d{1,2})", i) for i in (1, 2, 3)]
            days.append(F.try_to_date(F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd"))
        return F.coalesce(*days)

    first, last = labelled("入住日期", "入住时间"), labelled("离店日期", "离店时间")
    return F.when(first.isNotNull() & last.isNotNull(), F.struct(first.alias("check_in"), last.alias("check_out"), F.greatest(F.datediff(last, first), F.lit(1)).alias("nights")))


# Labels of a ticket's cities and the signs of a route.
TRAIN_FROM, TRAIN_TO, FLIGHT_FROM, FLIGHT_TO = ("出发站", "发站"), ("到达站", "到站"), ("自", "FROM"), ("至", "TO")


def ticket_cities(text: Column, category: Column) -> Column:
    """struct(departure, arrival) of a train or flight ticket: after labels, beside the train's number, else a route of two names."""
    from tallyweave.functions.text import station_city

    def labelled(words: tuple[str, ...], most: int) -> Column:
        piece = F.get(F.split(text, "|".join(f"{w}[：:]" for w in words), 2), 1)
        word = F.regexp_extract(piece, r"^\s*(\S+)", 1)
        return F.when(F.char_length(word) >= 2, F.substring(word, 1, most))

    def two(pattern: str) -> tuple[Column, Column]:
        return tuple(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in (1, 2))

    after_number = two(r"[A-Z]+\d+\s*(\S{2,6}站)\s+(\S{2,6}站)")
    before_number = two(r"(\p{IsHan}{2,6})\s+(\p{IsHan}{2,6})\s+[A-Z]+\d+")
    route = two(r"(\p{IsHan}{2,4})\s*[-－—]\s*(\p{IsHan}{2,4})")
    train = [F.coalesce(labelled(words, 7), after_number[k], before_number[k], route[k]) for k, words in enumerate((TRAIN_FROM, TRAIN_TO))]
    flight = [F.coalesce(labelled(words, 10), route[k]) for k, words in enumerate((FLIGHT_FROM, FLIGHT_TO))]
    ends = [F.when(category == "Train", station_city(a)).when(category == "Flight", station_city(b)) for a, b in zip(train, flight)]
    return F.struct(ends[0].alias("departure"), ends[1].alias("arrival"))


def ticket_day(text: Column, category: Column) -> Column:
    """The day of travel of a train or flight ticket: written with slashes, in Han with a time, ISO; 2020 to 2100."""
    clean = F.regexp_replace(text, r"\s*([年月])\s*", "$1")

    def day(pattern: str) -> Column:
        parts = [F.regexp_extract(clean, pattern, i) for i in (1, 2, 3)]
        d = F.try_to_date(F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")
        return F.when(F.year(d).between(FIRST_YEAR, LAST_YEAR), d)

    han = F.coalesce(day(r"(\d{4})年(\d{1,2})月(\d{1,2})\s*日\s+\d{1,2}:\d{2}"), F.when(category == "Train", day(r"(\d{4})年(\d{1,2})月(\d{1,2})\s*日\s*:?\s*[\d:]+\s*开")))
    return F.when(category.isin("Train", "Flight"), F.coalesce(day(r"(\d{4})/(\d{1,2})/(\d{1,2})"), han, day(r"(\d{4})-(\d{2})-(\d{2})")))


def ticket_time(text: Column) -> Column:
    """HH:MM beside a ticket's day in Han; NULL if it is no time."""
    h, m = (F.regexp_extract(text, r"日\s*(\d{1,2}):(\d{2})", i).try_cast("int") for i in (1, 2))
    return F.when((h <= 23) & (m <= 59), F.format_string("%02d:%02d", h, m))
