import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from tallyweave.operators import zoned_time as z

ZONES = ["Asia/Shanghai", "Europe/Berlin", "America/New_York", "Australia/Sydney", "Europe/Lisbon", "Asia/Kathmandu"]
TABLES = {n: z.transitions(n) for n in ZONES}


def convert(value, zone="Asia/Shanghai", order="YMD", received="2025-06-30", base=None):
    days = lambda d: None if d is None else (dt.date.fromisoformat(d) - dt.date(1970, 1, 1)).days
    s = lambda x, t="object": pd.Series([x], dtype=t)
    out = z.convert(s(value), s(zone), s(order), s(days(received), "float"), s(days(base), "float"), TABLES)
    return None if pd.isna(out[0]) else int(out[0])


def sec(text, zone="Asia/Shanghai"):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone)).timestamp())


CASES = [
    ("2025-05-06 07:08", sec("2025-05-06T07:08")), ("2025/5/6 07:08:09", sec("2025-05-06T07:08:09")), ("2025.05.06　07:08:09", sec("2025-05-06T07:08:09")), ("2025-05-0607:08:09", sec("2025-05-06T07:08:09")),
    ("2025年5月6日 7时08分", sec("2025-05-06T07:08")), ("2025年05月06日下午1:16", sec("2025-05-06T13:16")), ("2025年05月06日上午12:16", sec("2025-05-06T00:16")), ("May 6, 2025 12:01 PM", sec("2025-05-06T12:01")),
    ("06-May-2025 07:08", sec("2025-05-06T07:08")), ("Tue, 06 May 2025 07:08:09 +0545", sec("2025-05-06T07:08:09", "Asia/Kathmandu")), ("2025-05-06T07:08:09.999Z", 1746515289), ("20250506T070809Z", 1746515289),
    ("1746515289", 1746515289), ("1746515289999", 1746515289), ("20250506070809", sec("2025-05-06T07:08:09")), ("2025-05-06 07:08:09 GMT+08:00", sec("2025-05-06T07:08:09")), ("2025-05-06 7:08 p.m.", sec("2025-05-06T19:08")),
    ("2025-05-06 07:08:09 (北京时间)", sec("2025-05-06T07:08:09")), ("2025-05-06 07:08:09 CEST", 1746508089), ("45783.5", sec("2025-05-06T12:00")), ("07-03 20:\n15", sec("2024-07-03T20:15")), ("05-06 07:08 周二", sec("2025-05-06T07:08")),
    ("02-2907 08", sec("2024-02-29T07:08")), ("2025-05-06 24:00:00", sec("2025-05-07T00:00")), ("2025-05-06 25:00:00", -1), ("2025-13-06 07:08", -1), ("2025-02-30 07:08", -1), ("07-03 20:??", -1), ("2025-05-06 13:08 PM", -1),
    ("2025-05-06", -1), ("nonsense", -1), ("x" * 5000, -1), ("", None), (None, None),
]


@pytest.mark.parametrize("value,want", CASES)
def test_writings(value, want):
    assert convert(value) == want


def test_orders_zones_clocks():
    assert convert("05/06/2025 07:08", "Europe/Berlin", "DMY") == sec("2025-06-05T07:08", "Europe/Berlin")
    assert convert("05/06/2025 07:08", "America/New_York", "MDY") == sec("2025-05-06T07:08", "America/New_York")
    assert convert("05/06/2025 07:08", "Asia/Shanghai", "YMD") == -1
    assert convert("2025-03-30 02:30:00", "Europe/Berlin") == -1 and convert("2025-10-26 02:30:00", "Europe/Berlin") == -1
    assert convert("2025-10-26 02:30:00 CET", "Europe/Berlin") == 1761442200 and convert("2025-05-06 07:08", "No/Where") == -1
    for text, hour in {"13:28": "13:28", "１３：２８": "13:28", "13h28": "13:28", "13时28分": "13:28", "13.28 Uhr": "13:28", "1328": "13:28", "1:28 PM": "13:28", "下午1:28": "13:28", "13:28开": "13:28", "13:28:00.000": "13:28"}.items():
        assert convert(text, base="2025-05-06") == sec(f"2025-05-06T{hour}")
    assert convert("05:28Z", base="2025-05-06") == sec("2025-05-06T13:28") and convert("13:28 UTC+9", base="2025-05-06") == sec("2025-05-06T12:28")
    assert convert("25:29", base="2025-05-06") == -1 and convert("--:--", base="2025-05-06") == -1 and convert("13:28", base="0001-01-01") == -1


@pytest.mark.parametrize("zone", ZONES)
def test_tables_agree_with_zoneinfo(zone):
    rng = np.random.RandomState(3)
    local = rng.randint(0, 2_000_000_000, 3000)
    got = z.local_to_utc(local.astype(np.int64), *TABLES[zone][:2])
    info = ZoneInfo(zone)
    for s, g in zip(local.tolist(), got.tolist()):
        naive = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)
        both = {int(naive.replace(tzinfo=info, fold=f).timestamp()) for f in (0, 1)}
        exact = [u for u in both if dt.datetime.fromtimestamp(u, info).replace(tzinfo=None) == naive]
        assert g == (exact[0] if len(exact) == 1 else -1)


def test_blanks_dont_count():
    want = sec("2025-01-02T10:00:00")
    for text in ("2025-01-02 10:00:00" + " " * 60, " " * 500 + "2025-01-02   10:00:00", "2025-01-02 10:00:00." + "1" * 400):
        assert convert(text) == want


def test_tables_reach_before_1970_and_name_their_version():
    assert convert("1950-06-01 12:00:00", "America/New_York") == sec("1950-06-01T12:00", "America/New_York") and z.tz_version() not in ("", "unknown")
    assert convert("1940-06-02 12:00:00", "Europe/Berlin") == sec("1940-06-02T12:00", "Europe/Berlin")


@pytest.mark.parametrize("zone", ZONES)
def test_walls_agree_with_the_tables(zone):
    starts, offsets, _ = z.transitions(zone)
    local = np.arange(0, 3 * 366 * 86_400, 1800) + sec("2023-01-01T00:00", "UTC")
    want = z.local_to_utc(local, starts, offsets)
    got = np.full(len(local), -1)
    for a, b, o in z.walls(zone, dt.date(2023, 1, 1), dt.date(2026, 12, 31)):
        here = (local >= a) & (local < b)
        got[here] = local[here] - o
    assert (got == want).all() and (want == -1).any() == (len(z.walls(zone, dt.date(2023, 1, 1), dt.date(2026, 12, 31))) > 1)
