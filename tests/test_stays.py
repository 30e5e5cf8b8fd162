import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import stays

DAY = dt.date(2026, 7, 1)


@pytest.mark.parametrize("text,want", [
    ("2026/6/23-2026/6/26", ("2026-06-23", "2026-06-26", 3)), ("入住 2026年6月23日至2026年6月26日", ("2026-06-23", "2026-06-26", 3)), ("2026-12-30至1-2", ("2026-12-30", "2027-01-02", 3)),
    ("6月23日至6月26日", ("2026-06-23", "2026-06-26", 3)), ("6月23-26日", ("2026-06-23", "2026-06-26", 3)), ("6月23至26", ("2026-06-23", "2026-06-26", 3)), ("8月2号至8月11号", ("2026-08-02", "2026-08-11", 9)),
    ("5-29至6-5", ("2026-05-29", "2026-06-05", 7)), ("6/23-6/26", ("2026-06-23", "2026-06-26", 3)), ("4.24至4.27", ("2026-04-24", "2026-04-27", 3)), ("住宿日期:4.24-4.27", ("2026-04-24", "2026-04-27", 3)), ("折扣4.24-4.27", None),
    ("6月23日入住,6月26日离店", ("2026-06-23", "2026-06-26", 3)), ("入住时间:6月23日 离店时间:26日", ("2026-06-23", "2026-06-26", 3)), ("入住6月30日，2日退房", ("2026-06-30", "2026-07-02", 2)),
    ("6月23日入住 共3天", ("2026-06-23", "2026-06-26", 3)), ("6月26日退房 共3晚", ("2026-06-23", "2026-06-26", 3)), ("2026-06-23至2026-06-23", ("2026-06-23", "2026-06-23", 1)), ("2026-06-23至2024-06-23", None), ("没有日期", None), ("", None),
])
def test_stays(text, want):
    got = stays.read_stay(text, DAY)
    assert (None if got is None else (str(got[0]), str(got[1]), got[2])) == want


def test_years():
    assert stays.year_near(1, dt.date(2026, 12, 5)) == 2027 and stays.year_near(12, dt.date(2026, 1, 5)) == 2025 and stays.year_near(6, DAY) == 2026


def test_columns(spark):
    rows = [("２０２６ 年 6 月 23 日至 6 月 26 日", DAY), (None, DAY), ("6-1至6-4", None), ("x" * 20_000, DAY)]
    got = [r["s"] for r in spark.createDataFrame(rows, "t string, d date").select(stays.stay_in(F.col("t"), F.col("d")).alias("s")).collect()]
    assert got[0]["nights"] == 3 and got[1:] == [None, None, None]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    text = lambda t: F.lit(t)
    assert one(stays.nights_told(text("共 3 天"))) == 3 and one(stays.item_nights(text("*住宿服务*房费 天 4 200.00"))) == 4 and one(stays.checked_nights(F.lit(None).cast("int"), F.lit(1), F.lit(5))) == 5
    s = one(stays.statement_stay(text("入住日期：2026年6月1日\n离店日期：2026-06-04 12:00")))
    assert str(s["check_in"]) == "2026-06-01" and s["nights"] == 3
    for t, cat, want in [("出发站：长沙南站 到站：武汉站", "Train", ("长沙", "武汉")), ("G878长沙南站 武汉站", "Train", ("长沙", "武汉")), ("长沙南\n武汉\nG878", "Train", ("长沙", "武汉")), ("自：上海虹桥 至：成都", "Flight", ("上海", "成都")), ("2026/05/15 成都-长沙 3U8767", "Flight", ("成都", "长沙")), ("成都-长沙", "Meal", (None, None))]:
        c = one(stays.ticket_cities(text(t), F.lit(cat)))
        assert (c["departure"], c["arrival"]) == want, t
    day = lambda t, cat="Train": str(one(stays.ticket_day(text(t), F.lit(cat))))
    assert day("2026/05/15 成都") == "2026-05-15" and day("2026 年 3 月 9 日 07:12 开") == "2026-03-09" and day("2026年3月9日0712开") == "2026-03-09" and day("2019-01-01") == "None" and day("2026-05-15", "Meal") == "None"
    assert one(stays.ticket_time(text("2026年3月9日 7:12 开"))) == "07:12" and one(stays.ticket_time(text("3月9日 27:12"))) is None
