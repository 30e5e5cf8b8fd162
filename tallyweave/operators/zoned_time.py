"""Mixed timestamp writings and zones, normalised to UTC epoch seconds.

Every value is tokenised into a character-class shape mask (digits become ``9``, runs of two or more
letters ``A``, runs of blanks one space, the rest stays). All values of one mask have their numbers at the
same places, so each distinct mask is mapped to a parser once, and the parser is a set of array slices that
works on all values of the mask together. Wall-clock times are then turned into instants by search in zone
transition tables. They are read on the driver from the zone files of the installed tz database, with its
version (``zone_tables``), and travel to the workers with the function; the few spans of unambiguous wall-clock time
around a batch's date travel with the batch (``with_walls``), so that the commonest writing is converted by
the same tables inside of the JVM.

Defined results: NULL and the empty string are missing and give NULL; a value that denotes no single
instant gives -1: impossible or incomplete values, unknown writings or zones, and local times that the zone
skips or has twice. Blanks at the ends and repeated blanks don't count, however many there are.
"""

from __future__ import annotations

import datetime as dt
import importlib.resources
import os
import re
import struct
import zoneinfo
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.tables import few, table

DAY = 86_400
# Excel day serials count from this date.
SERIAL_EPOCH = -25_569 * DAY
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
# Offsets in minutes of zone abbreviations, used where the row's own zone has no such one.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
MONTHS |= {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())} | {"sept": 9}


# ---------------------------------------------------------------- zone transition tables


def tz_version() -> str:
    """Version of the tz database that the tables are built from."""
    for base in zoneinfo.TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            try:
                with open(os.path.join(base, name), encoding="utf-8") as f:
                    if m := re.match(pattern, f.readline()):
                        return m[1]
            except OSError:
                continue
        if os.path.isdir(base):
            return "system"  # the zones come from a folder that doesn't name its version
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _zone_file(name: str) -> bytes:
    for base in zoneinfo.TZPATH:
        at = os.path.join(base, *name.split("/"))
        if os.path.isfile(at):
            with open(at, "rb") as f:
                return f.read()
    return importlib.resources.files("tzdata.zoneinfo").joinpath(name).read_bytes()


def _listed(data: bytes) -> tuple[list[int], list[tuple[int, str]], tuple[int, str]]:
    """(UTC seconds of the changes that a zone file lists, (offset, abbreviation) after each, that before the first)."""

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", data[at + 20 : at + 44])

    wide, at = data[4:5] >= b"2", 0
    if wide:  # the first block holds the same in 32 bits
        utc, std, leap, times, types, chars = counts(0)
        at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    _, _, _, times, types, chars = counts(at)
    at, size = at + 44, 8 if wide else 4
    when = list(struct.unpack(f">{times}{'q' if wide else 'l'}", data[at : at + times * size]))
    which = data[at + times * size : at + times * (size + 1)]
    at += times * (size + 1)
    kinds = [struct.unpack(">lBB", data[at + 6 * k : at + 6 * k + 6]) for k in range(types)]
    words = data[at + 6 * types : at + 6 * types + chars]
    named = [(off, words[k:].split(b"\0")[0].decode()) for off, _, k in kinds]
    standard = [x for x, k in zip(named, kinds) if not k[1]]
    return when, [named[k] for k in which], standard[0] if standard else named[0]


@lru_cache(maxsize=None)
def transitions(name: str, last: int = 2100) -> tuple[np.ndarray, np.ndarray, dict[str, int]] | None:
    """(starts, offsets, abbreviations) of a zone; interval k begins at UTC second starts[k] with offsets[k].

    The changes that the zone's file lists, and up to the year ``last`` those by its yearly rule, each bisected
    to the second. None: no such zone.
    """
    try:
        zone = ZoneInfo(name)
        when, after, now = _listed(_zone_file(name))
    except (ZoneInfoNotFoundError, ValueError, OSError, ModuleNotFoundError):
        return None

    def at(sec: int) -> tuple[int, str]:
        d = (EPOCH + dt.timedelta(seconds=sec)).astimezone(zone)
        return int(d.utcoffset().total_seconds()), d.tzname()

    first = at(0)
    starts, offsets, names = [-(2**62)], [now[0]], {first[1]: first[0] // 60}

    def change(sec: int, new: tuple[int, str]) -> None:
        if new[0] != offsets[-1]:
            starts.append(sec)
            offsets.append(new[0])
        if sec >= 0:  # abbreviations of before 1970 mean other offsets in many zones
            names[new[1]] = new[0] // 60

    for sec, new in zip(when, after):
        change(sec, new)
    lo = max([0, *when[-1:]])
    now = at(lo)
    change(lo, now)
    for sec in range(lo, int((dt.datetime(last, 1, 1, tzinfo=dt.timezone.utc) - EPOCH).total_seconds()), 3 * DAY):
        new = at(sec + 3 * DAY)
        if new == now:
            continue
        a, b = sec, sec + 3 * DAY  # a yearly rule changes twice a year, so once at most in here
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if at(mid) == now else (a, mid)
        change(b, new)
        now = new
    return np.array(starts, np.int64), np.array(offsets, np.int64), names


def walls(name: str, first: dt.date, last: dt.date) -> list[tuple[int, int, int]]:
    """(from, to, offset): the spans of wall-clock seconds between two days that denote one instant each."""
    found = transitions(name)
    if found is None:
        return []
    starts, offsets, _ = found
    begin = np.maximum(starts, -(2**61)) + offsets
    end = np.append(starts[1:], 2**61) + offsets
    begin_, end_ = np.maximum(begin, np.append(-(2**62), end[:-1])), np.minimum(end, np.append(begin[1:], 2**62))
    lo, hi = ((d - EPOCH.date()).days * DAY for d in (first, last))
    spans = [(max(int(a), lo), min(int(b), hi), int(o)) for a, b, o in zip(begin_, end_, offsets)]
    return [x for x in spans if x[0] < x[1]]


def local_to_utc(local: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """UTC seconds of wall-clock seconds, -1 where the zone skips that time or has it twice."""
    begin = np.maximum(starts, -(2**61)) + offsets
    end = np.append(starts[1:], 2**61) + offsets
    near = np.clip(np.searchsorted(starts + 0, local) - 1, 0, len(starts) - 1)
    hits = np.zeros(len(local), np.int64)
    utc = np.full(len(local), -1, np.int64)
    for shift in (-1, 0, 1):
        k = near + shift
        ok = (k >= 0) & (k < len(starts))
        k = np.clip(k, 0, len(starts) - 1)
        ok &= (local >= begin[k]) & (local < end[k])
        hits += ok
        utc = np.where(ok, local - offsets[k], utc)
    return np.where(hits == 1, utc, -1)


# ---------------------------------------------------------------- masks and their parsers

_TIME = r"(?P<h>9{1,2})(?:[:：] ?|[时h])(?P<m>99)(?:分|[:：](?P<s>99)(?:[.,](?P<f>9+))?)?秒?"
_HALF = r"(?: ?(?P<half>AA|[APap]\.?[Mm]\.?))?"
_WEEK = r"(?: ?[(（]?(?:周|星期) ?[w日][)）]?)?"
_ZONE = r"(?: ?(?:(?P<zulu>[Zz])|(?P<sign>[+-])(?P<oh>99):?(?P<om>99)|(?P<name>A{3})(?P<sign2>[+-])(?P<oh2>9{1,2})(?::?(?P<om2>99))?|(?P<abbr>A{3,5})|[(（]?(?P<bj>北京时间)[)）]?))?"
_CN = r"(?P<cn>上午|下午|凌晨|早上|中午|傍晚|晚上)?"
_YMD = r"(?P<Y>9999)(?:-(?P<M>9{1,2})-(?P<D>9{1,2})|/(?P<M_>9{1,2})/(?P<D_>9{1,2})|\.(?P<M__>9{1,2})\.(?P<D__>9{1,2})|年 ?(?P<M___>9{1,2})月 ?(?P<D___>9{1,2})日)"
_END = _HALF + _WEEK + _ZONE + _WEEK + r" ?$"
GRAMMAR = [
    re.compile(p)
    for p in (
        r"^ ?(?:(?P<bj0>北京时间) )?" + _YMD + r"(?: ?[Tt]| ?)" + _CN + " ?" + _TIME + _END,
        r"^ ?(?P<Y>9999)(?P<M>99)(?P<D>99)[Tt ]?(?P<h>99)(?P<m>99)(?P<s>99)?(?P<zulu>[Zz])?(?:(?P<sign>[+-])(?P<oh>99):?(?P<om>99))? ?$",
        r"^ ?(?:A{3,9},? )?(?P<D>9{1,2})[- ](?P<mon>A{3,9})[- ,]{1,2}(?P<Y>9999),? " + _TIME + _END,
        r"^ ?(?:A{3,9},? )?(?P<mon>A{3,9}) (?P<D>9{1,2}),? (?P<Y>9999),? " + _TIME + _END,
        r"^ ?(?P<n1>9{1,2})(?P<sep>[./-])(?P<n2>9{1,2})(?P=sep)(?P<Y>9999),? " + _TIME + _END,
        r"^ ?(?P<M>99)[-/](?P<D>99) ?(?P<h>99)(?:: ?| )(?P<m>99)" + _WEEK + " ?$",
        r"^ ?(?P<M>99)[-/](?P<D>99) ?(?P<h>99): ?(?P<m>99):(?P<s>99)" + _WEEK + " ?$",
        r"^ ?(?P<M>9{1,2})月(?P<D>9{1,2})日 ?" + _CN + " ?" + _TIME + _WEEK + " ?$",
    )
]
CLOCK = [
    re.compile(p)
    for p in (
        r"^ ?" + _CN + " ?" + _TIME + r"(?: ?开)?" + _END,
        r"^ ?(?P<h>9{1,2})[.:](?P<m>99) (?P<uhr>A{3}) ?$",
        r"^ ?(?P<h>9{1,2})[HhＨ](?P<m>99)?(?:AAA)? ?$",
        r"^ ?(?P<h>99)(?P<m>99)(?P<s>99)? ?$",
    )
]
SECONDS, MILLIS, SERIAL = re.compile("^ ?(?P<e>9{10}) ?$"), re.compile("^ ?(?P<e>9{13}) ?$"), re.compile(r"^ ?(?P<e>9{5})(?:\.(?P<f>9+))? ?$")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point of the basic plane: its mask character, and its digit value."""
    import unicodedata

    mask, digit = np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, np.int64)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isdigit() and (v := unicodedata.digit(ch, None)) is not None and unicodedata.category(ch) == "Nd":
            mask[c], digit[c] = ord("9"), v
        elif ch.isspace():
            mask[c] = ord(" ")
    for ch in "一二三四五六天":
        mask[ord(ch)] = ord("w")
    return mask, digit


_TABLES: list = []


def _codes(texts: np.ndarray) -> np.ndarray:
    fixed = texts.astype(f"U{max(1, max(map(len, texts), default=1))}")
    return np.minimum(fixed.view(np.uint32).reshape(len(texts), -1), 0xFFFF)


def shape_masks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct masks as code rows, the number of each row's mask, digit values); zero pads short texts."""
    if not _TABLES:
        _TABLES.extend(_classes())
    mask = _TABLES[0][codes]
    letter = ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    pad = np.zeros((len(codes), 1), bool)
    run = letter & (np.hstack([pad, letter[:, :-1]]) | np.hstack([letter[:, 1:], pad]))
    mask[run] = ord("A")
    rows = np.ascontiguousarray(mask.astype(np.uint16)).view([("", np.uint16)] * mask.shape[1]).ravel()
    distinct, which = np.unique(rows, return_inverse=True)
    return distinct.view(np.uint16).reshape(len(distinct), -1), which.ravel(), _TABLES[1][codes]


@lru_cache(maxsize=100_000)
def parser_of(mask: str, clock: bool) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """What a mask denotes, and where its parts stand; each distinct mask is looked at once per worker."""
    kinds = [("clock", CLOCK)] if clock else [("seconds", [SECONDS]), ("millis", [MILLIS]), ("serial", [SERIAL]), ("wall", GRAMMAR)]
    for kind, patterns in kinds:
        for p in patterns:
            if m := p.match(mask):
                spans = {k.rstrip("_"): m.span(k) for k, v in m.groupdict().items() if v}
                texts = {"=" + k: v for k, v in m.groupdict().items() if v and k in ("cn", "half", "sign", "sign2")}
                return kind, spans | texts
    return None


_DAYS_IN = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    mm = np.clip(m, 1, 12)
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (d <= _DAYS_IN[mm - 1] + (leap & (mm == 2))) & (y >= 1)
    yy = y - (mm <= 2)
    era, yoe = yy // 400, yy % 400
    doy = (153 * (mm + np.where(mm > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468, ok


def _words(codes: np.ndarray, span: tuple[int, int], lookup, none: int) -> np.ndarray:
    part = np.ascontiguousarray(codes[:, span[0] : span[1]].astype(np.uint32)).view(f"U{span[1] - span[0]}").ravel()
    distinct, which = np.unique(part, return_inverse=True)
    return np.array([lookup(str(x).lower(), none) for x in distinct], np.int64)[which.ravel()]


def _rows_of_mask(kind: str, spans: dict, codes, digits, received, order, base, zones, zone_no, tables) -> np.ndarray:
    n = len(codes)

    def num(k: str, default: int = 0) -> np.ndarray:
        if k not in spans:
            return np.full(n, default, np.int64)
        a, b = spans[k]
        v = np.zeros(n, np.int64)
        for i in range(a, b):
            v = v * 10 + digits[:, i]
        return v

    if kind == "seconds":
        return num("e")
    if kind == "millis":
        return num("e") // 1000
    if kind == "serial":
        a, b = spans.get("f", (0, 0))
        part = sum((digits[:, i] / 10.0 ** (i - a + 1) for i in range(a, b)), np.zeros(n))
        days, ok = num("e") * DAY + SERIAL_EPOCH, np.ones(n, bool)
        wall = days + np.floor(part * DAY + 0.5).astype(np.int64)
    else:
        h, m, s = num("h"), num("m"), num("s")
        if kind == "clock":
            days, ok = base.astype(np.int64), base > -700_000  # the year 1 stands for a missing day
        elif "Y" in spans:
            month, day = num("M"), num("D")
            if "mon" in spans:
                month = _words(codes, spans["mon"], MONTHS.get, 0)
            elif "n1" in spans:
                one, two = num("n1"), num("n2")
                month, day = np.where(order == 0, one, np.where(order == 1, two, 0)), np.where(order == 0, two, one)
            days, ok = _days(num("Y"), month, day)
        else:
            year = (received.astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970)
            days, ok = np.zeros(n, np.int64), np.zeros(n, bool)
            for back in range(9):  # 29 February may be eight years back
                d, there = _days(year - back, num("M"), num("D"))
                new = ~ok & there & (d <= received) & (received > -(10**6))
                days, ok = np.where(new, d, days), ok | new
        half = None
        if "cn" in spans:
            half = spans["=cn"] not in ("上午", "凌晨", "早上")
        elif "half" in spans:
            half = spans["=half"][0] in "Pp"
            if spans["=half"] == "AA":
                half = _words(codes, spans["half"], {"am": 0, "pm": 1}.get, -1)
                ok &= half >= 0
        if half is not None:
            ok &= (h >= 1) & (h <= 12) if "half" in spans else (h <= 12)
            h = h % 12 + 12 * np.asarray(half, np.int64)
        if "uhr" in spans:
            ok &= _words(codes, spans["uhr"], {"uhr": 1}.get, 0) == 1
        midnight = (h == 24) & (m == 0) & (s == 0) & (num("f") == 0 if "f" in spans and spans["f"][1] - spans["f"][0] < 15 else True)
        ok &= (m <= 59) & (s <= 59) & ((h <= 23) | midnight)
        wall = days * DAY + h * 3600 + m * 60 + s
        fixed = None
        if "zulu" in spans:
            fixed = np.zeros(n, np.int64)
        elif "bj" in spans or "bj0" in spans:
            fixed = np.full(n, 480, np.int64)
        elif "sign" in spans or "sign2" in spans:
            two = "2" * ("sign2" in spans)
            fixed = num("oh" + two) * 60 + num("om" + two)
            ok &= (fixed <= 18 * 60) & (num("om" + two) <= 59)
            fixed = fixed * (-1 if spans["=sign" + two] == "-" else 1)
            if two:
                ok &= _words(codes, spans["name"], {"utc": 1, "gmt": 1}.get, 0) == 1
        elif "abbr" in spans:
            fixed = np.full(n, 10**6, np.int64)
            for z in np.unique(zone_no):
                own = tables.get(zones[z], (None, None, {}))[2] if tables.get(zones[z]) else {}
                here = zone_no == z
                fixed[here] = _words(codes[here], spans["abbr"], lambda x, none, own=own: own.get(x.upper(), ABBREVIATIONS.get(x.upper(), none)), 10**6)
            ok &= fixed < 10**6
        if fixed is not None:
            return np.where(ok, wall - fixed * 60, -1)
    utc = np.full(n, -1, np.int64)
    for z in np.unique(zone_no):
        if found := tables.get(zones[z]):
            here = zone_no == z
            utc[here] = local_to_utc(wall[here], found[0], found[1])
    return np.where(ok, utc, -1)


ORDERS = {"MDY": 0, "DMY": 1}
BLANKS = re.compile(r"\s\s+|^\s+|\s+$")
LONGEST = 96  # characters of the longest text that any pattern of the grammar matches, fractions of seconds aside


def _bare(text: str) -> str:
    """The text with single blanks and none at its ends, and without digits of a fraction beyond the tenth."""
    text = BLANKS.sub(" ", text).strip() if BLANKS.search(text) else text
    return re.sub(r"([.,]\d{10})\d+", r"\1", text) if len(text) > LONGEST else text


def convert(values: pd.Series, zone: pd.Series, order: pd.Series, received: pd.Series, base: pd.Series, tables: dict) -> pd.Series:
    """One Arrow batch of values to UTC seconds; base is the day of clock times, NULL for full timestamps."""
    n = len(values)
    texts = values.to_numpy(object)
    there = np.array([isinstance(x, str) and x != "" for x in texts], bool)
    out = np.full(n, -1, np.int64)
    at = np.flatnonzero(there)
    bare = np.array([_bare(x) for x in texts[at]], object)
    fits = np.array([0 < len(x) <= LONGEST for x in bare], bool)  # what is longer matches no pattern
    at, bare = at[fits], bare[fits]
    if len(at):
        day = lambda s: s.fillna(-(10**7)).to_numpy(np.int64)[at]
        rec, bas, clock = day(received), day(base), base.notna().to_numpy()[at]
        zone_no, zones = pd.factorize(zone.to_numpy(object)[at], use_na_sentinel=False)
        orders = np.array([ORDERS.get(x, 2) for x in order.to_numpy(object)[at]], np.int64)
        codes = _codes(bare)
        masks, which, digits = shape_masks(codes)
        groups = np.argsort(which * 2 + clock, kind="stable")
        keys = (which * 2 + clock)[groups]
        for part in np.split(groups, np.flatnonzero(np.diff(keys)) + 1):
            row = masks[which[part[0]]]
            mask = "".join(map(chr, row)).rstrip("\0")
            found = parser_of(mask, bool(clock[part[0]]))
            if found:
                out[at[part]] = _rows_of_mask(*found, codes[part], digits[part], rec[part], orders[part], bas[part], list(zones), zone_no[part], tables)
    return pd.Series(pd.array(out, "Int64")).mask(pd.Series(~there))


WALLS = "array<struct<lo: string, hi: string, off: int>>"
YEARS_BACK = 4
BROADCAST_BATCHES = 100_000  # of some hundred bytes each


def zone_tables(batches: DataFrame) -> tuple[str, dict]:
    """(tz version, tables) of the zones named in ``batches``; there are at most as many as the tz database has."""
    names = [r[0] for r in few(batches.select("zone_name").distinct()) if r[0]]
    return tz_version(), {z: t for z in names if (t := transitions(z))}


def _written(local: int) -> str:
    """A wall-clock second in the commonest writing, which sorts like the time; full minutes without seconds."""
    return (EPOCH + dt.timedelta(seconds=local)).strftime("%Y-%m-%d %H:%M:%S").removesuffix(":00")


def with_walls(batches: DataFrame) -> DataFrame:
    """Adds ``walls``: the spans of single instants in the batch's zone from some years before to a year after it.

    There are at most as many kinds of spans as zones times years, so they are made on the driver and broadcast. The
    batches are to be broadcast too, up to BROADCAST_BATCHES counted ones; beyond that their joins shuffle.
    """
    spark, year = batches.sparkSession, F.year("received_on")
    kinds = [tuple(r) for r in few(batches.groupBy("zone_name", year).count())]
    spans = [(z, y, [(_written(a), _written(b), o) for a, b, o in walls(z, dt.date(y - YEARS_BACK, 1, 1), dt.date(y + 2, 1, 1))]) for z, y, _ in kinds if z and y and 1975 < y < 2090]
    known = spark.createDataFrame([x for x in spans if x[2]], f"__zone string, __year int, walls {WALLS}")
    out = batches.join(F.broadcast(known), (F.col("zone_name") == F.col("__zone")) & (year == F.col("__year")), "left").drop("__zone", "__year")
    return F.broadcast(out) if sum(n for _, _, n in kinds) <= BROADCAST_BATCHES else out


def plain_seconds(value: Column, spans: Column) -> Column:
    """UTC seconds of a value in the commonest writing, by the spans; NULL for all others, -1 for no single instant."""
    off = F.get(F.filter(spans, lambda x: (value >= x["lo"]) & (value < x["hi"])), 0)["off"]
    inside = (value >= F.get(spans, 0)["lo"]) & (value < F.element_at(spans, -1)["hi"])
    local = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value.try_cast("timestamp_ntz"))
    return F.when(value.rlike(PLAIN) & inside, F.coalesce(local - off, F.lit(-1).cast("bigint")))


def utc_seconds(spark: SparkSession, batches: DataFrame):
    """A column function (value, zone_name, date_order, received_on, base_day, walls) -> UTC seconds.

    The zones named in ``batches`` get their tables. Where ``walls`` is given the commonest writing needs no Python.
    """
    shared = spark.sparkContext.broadcast(zone_tables(batches))

    @F.pandas_udf("long")
    def run(value: pd.Series, zone: pd.Series, order: pd.Series, received: pd.Series, base: pd.Series) -> pd.Series:
        return convert(value, zone, order, received, base, shared.value[1])

    def column(value: Column, zone: Column, order: Column, received: Column, base: Column | None = None, spans: Column | None = None) -> Column:
        days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
        rest = lambda v: run(v, zone, order, days(received), days(base) if base is not None else F.lit(None).cast("int"))
        if base is not None or spans is None:
            return rest(value)
        # what the spans told is sent as NULL, so Python has nothing to do for it
        fast = plain_seconds(value, spans)
        return F.coalesce(fast, rest(F.when(fast.isNull(), value)))

    return column


PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-9]{2}(:[0-9]{2})?$"
PLAIN_CLOCK = r"^([01][0-9]|2[0-3]):[0-9]{2}$"


def timed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, rec_id, ride_index, value, base_day, batch_id) of all four timestamp fields that are not missing."""
    pay, inv = table(spark, sf_dir, "payment"), table(spark, sf_dir, "invoice")
    none = F.lit(None).cast("date")
    rides = inv.select("id", "batch_id", F.posexplode("itineraries").alias("ride_index", "ride"))
    parts = [
        pay.select(F.lit("payment.transaction_time").alias("field"), F.col("id").alias("rec_id"), F.lit(-1).alias("ride_index"), F.col("transaction_time").alias("value"), none.alias("base_day"), "batch_id"),
        rides.select(F.lit("itinerary.date_time").alias("field"), F.col("id").alias("rec_id"), "ride_index", F.col("ride.date_time").alias("value"), none.alias("base_day"), "batch_id"),
        inv.select(F.lit("invoice.toll_travel_time").alias("field"), F.col("id").alias("rec_id"), F.lit(-1).alias("ride_index"), F.col("toll_travel_time").alias("value"), none.alias("base_day"), "batch_id"),
        inv.select(F.lit("invoice.travel_time").alias("field"), F.col("id").alias("rec_id"), F.lit(-1).alias("ride_index"), F.col("travel_time").alias("value"), F.coalesce("travel_date", F.lit("0001-01-01").cast("date")).alias("base_day"), "batch_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("value") != "")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = with_walls(table(spark, sf_dir, "import_batch").select("batch_id", "received_on", "zone_name", "date_order"))
    utc = utc_seconds(spark, batches)
    rows = timed_values(spark, sf_dir).join(batches, "batch_id", "left")
    told = [F.col(c) for c in ("value", "zone_name", "date_order", "received_on")]
    clock = F.col("field") == "invoice.travel_time"
    rows = rows.filter(clock).withColumn("utc_sec", utc(*told, F.col("base_day"))).unionByName(rows.filter(~clock).withColumn("utc_sec", utc(*told, spans=F.col("walls"))))
    plain = F.when(F.col("field") == "invoice.travel_time", F.col("value").rlike(PLAIN_CLOCK)).otherwise(F.col("value").rlike(PLAIN))
    usual = (F.col("utc_sec") != -1) & F.coalesce(F.col("zone_name") == "Asia/Shanghai", F.lit(False)) & plain
    return rows.filter(~usual).select("field", "rec_id", "ride_index", "utc_sec")


def p1_zone_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tz_version, zone_name, from_utc, offset_sec): the transition tables that p1_found converts with."""
    version, tables = zone_tables(table(spark, sf_dir, "import_batch"))
    rows = [(version, z, int(a) if k else None, int(o)) for z, (starts, offsets, _) in sorted(tables.items()) for k, (a, o) in enumerate(zip(starts, offsets))]
    return spark.createDataFrame(rows, "tz_version string, zone_name string, from_utc bigint, offset_sec int")
