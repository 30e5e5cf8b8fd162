import pytest
from pyspark.sql import functions as F

from tallyweave.functions import dates

CASES = [
    ("2026-04-2408:48:00", "2026-04-24 08:48:00"), ("2026年04月24日", "2026-04-24"), ("05-11 11:48 周\n一", "05-11 11:48"), ("04-22 21:\n10 周三", "04-22 21:10"),
    ("07-03 20:", "07-03 20:??"), ("07-0320", "07-03 20:??"), ("07-0320 46", "07-03 20:46"), ("04-28", "04-28"), ("专车 成都", None), (None, None), ("", None),
]


def test_extract(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", dates.extract_datetime(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(CASES))] == [b for _, b in CASES]


@pytest.mark.parametrize("text,want", [("2025-3-4 5:06", "2025-03-04 05:06:00"), ("2025/03/04", "2025-03-04 00:00:00"), ("02-29 08:00", "2024-02-29 08:00:00"), ("07-03 20:??", None), ("2025-13-01 00:00", None), ("2026-04-2408:48:00", "2026-04-24 08:48:00")])
def test_parse(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(dates.parse_datetime(F.col("t"), 2025).cast("string").alias("x")).first()["x"]
    assert got == want


def test_serial_and_differences(spark):
    r = spark.range(1).select(
        dates.serial_datetime(F.lit(46134.5)).alias("a"), dates.extract_date(F.lit("40001"), 2025).alias("b"), dates.extract_date(F.lit("03-05 10:00"), 2025).alias("c"),
        dates.inclusive_days(F.lit("2025-01-05").cast("date"), F.lit("2025-01-01").cast("date")).alias("d"), dates.same_or_next_day(F.lit(None).cast("date"), F.lit("2025-01-01").cast("date")).alias("e"),
        dates.time_difference(F.lit("2025-01-01 10:00").cast("timestamp"), F.lit("2025-01-01 12:05").cast("timestamp")).alias("f"), dates.clock(F.lit("7"), F.lit("61")).alias("g"),
    ).first()
    assert tuple(r) == ("2026-04-22 12:00:00", "2009-07-07", "2025-03-05", 1, True, "2小时5分", None)
