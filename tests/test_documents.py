import datetime as dt

from pyspark.sql import functions as F

from tallyweave.operators import documents

CELLS = "doc_id string, page int, table_no int, row_no int, col_no int, text string, texts array<string>"
WORDS = "doc_id string, page int, seq int, text string, x0 double, top double, x1 double, bottom double"


def test_a_batch_of_documents(spark):
    texts = [("i", 1, "电子发票 发票号码：12345678 2025年6月3日 价税合计 ¥50.00 名称：甲出行科技有限公司"), ("r", 2, "行程单 合计 50.00 元\n2025-01-02 08:30 甲 ¥12.50\n2025-01-02 09:30 乙 ¥37.50"), ("b", 3, "结账单"), ("e", 4, ""), ("g", 5, "���x"), ("n", 6, "发票 nothing"), ("c", 7, "行程单")]
    head = ["序号", "服务商", "上车时间", "起点", "终点", "金额(元)"]
    rows = [head, ["1", "甲车", "2025-01-02 08:30", "a", "b", "7.00"]]
    cells = [("c", 1, 0, r, k, x, [x]) for r, row in enumerate(rows) for k, x in enumerate(row)]
    inv, rides, errors = documents.parsed(spark.createDataFrame(texts, "doc_id string, doc_pos int, text string"), spark.createDataFrame(cells, CELLS), spark.createDataFrame([], WORDS))
    assert [(r["doc_id"], r["amount"], r["category"]) for r in inv.collect()] == [("i", 50.0, "CityTransport")]
    assert sorted((r["doc_id"], r["date_time"], r["amount"], r["printed"]) for r in rides.collect()) == [("c", "2025-01-02 08:30", 7.0, None), ("r", "2025-01-02 08:30", 12.5, 50.0), ("r", "2025-01-02 09:30", 37.5, 50.0)]
    assert {r["doc_id"]: r["error"] for r in errors.collect()} == {"b": "bill", "e": "empty", "g": "unreadable", "n": "no amount"}


def test_ride_lists(spark):
    inv = spark.createDataFrame([("i1", 1, 50.0, False), ("i2", 2, 50.0, False), ("i3", 3, 70.0, True), ("i4", 4, 81.0, False)], "inv_id string, inv_pos int, inv_amount double, has_rides boolean")
    lists = spark.createDataFrame([("d1", 1, 50.0, True), ("d2", 2, 70.0, True), ("d3", 3, 80.0, False), ("d4", 4, 81.5, True)], "doc_id string, doc_pos int, total double, printed boolean")
    got, alone = documents.with_ride_lists(inv, lists)
    assert sorted(map(tuple, got.collect())) == [("d1", "i1"), ("d3", "i4")] and sorted(r["doc_id"] for r in alone.collect()) == ["d2", "d4"]


def test_trips_and_matches(spark):
    d = dt.date
    trips = spark.createDataFrame([("k", 1, d(2025, 1, 1), d(2025, 1, 5), ["武汉"]), ("k", 2, d(2025, 1, 4), d(2025, 1, 9), ["北京"])], "k string, trip_no int, start date, end date, cities array<string>")
    ride = "array<struct<pickup:string,dropoff:string,city:string>>"
    inv = [("k", "meal", [d(2025, 1, 4)], "Meal", ["x"], []), ("k", "ride", [d(2025, 1, 4), d(2025, 1, 6)], "CityTransport", ["x"], [("北京南站", "y", "")]), ("k", "out", [d(2025, 2, 1)], "Meal", [], None)]
    got = documents.on_trips(spark.createDataFrame(inv, f"k string, inv_id string, days array<date>, category string, names array<string>, rides {ride}"), trips, ["k"])
    assert sorted((r["inv_id"], r["trip_no"]) for r in got.collect()) == [("meal", 1), ("ride", 2)]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    day, none = F.lit("2025-01-01").cast("date"), F.lit(None).cast("date")
    days = lambda cat, **k: one(documents.candidate_days(F.lit(cat), day, k.get("check_in", none), k.get("rides", F.lit(None).cast("array<date>")), k.get("toll", none)))
    other = F.lit("2025-01-09").cast("date")
    assert days("Hotel", check_in=other) == [d(2025, 1, 9)] and days("Hotel") == [d(2025, 1, 1)] and days("CityTransport", rides=F.array(other, none)) == [d(2025, 1, 9)] and days("Toll", toll=other) == [d(2025, 1, 9)] and days("Meal") == [d(2025, 1, 1)]
    pairs = F.array(F.struct(F.lit(1).alias("ride"), F.lit("p9").alias("pay_id")))
    pays = F.array(F.lit("p0"), F.lit("p1"))
    assert one(documents.payment_of_ride(pays, pairs, F.lit(1))) == "p9" and one(documents.payment_of_ride(pays, pairs, F.lit(0))) is None and one(documents.payment_of_ride(pays, F.array().cast("array<struct<ride:int,pay_id:string>>"), F.lit(0))) == "p0"
    p = lambda *ids: spark.createDataFrame([(x, g) for x, g in ids], "pay_id string, g string")
    assert sorted(map(tuple, documents.candidate_pool(p(("a", "1")), p(("a", "2"), ("b", "2"))).collect())) == [("a", "1"), ("b", "2")]
    m = spark.createDataFrame([("i", 60.0, [("01-02 08:30", "甲", "乙", 20.0), ("01-02 09:30", "丙", "丁", 35.0)], [("p1", 20.0)]), ("j", 5.0, [], [])], "inv_id string, inv_amount double, rides array<struct<date_time:string,pickup:string,dropoff:string,amount:double>>, payments array<struct<pay_id:string,amount:double>>")
    rows = [tuple(r) for r in documents.match_rows(m).orderBy("inv_id", "row_no").collect()]
    assert rows == [("i", 0, 60.0, 20.0, "01-02 08:30  甲 → 乙", "p1", 20.0, 40.0), ("i", 1, None, 35.0, "01-02 09:30  丙 → 丁", None, None, None), ("j", 0, 5.0, None, None, None, None, 5.0)]


def test_one_trip_without_tickets(spark):
    t = spark.createDataFrame([("a", "t1", "长沙", "上海", dt.date(2025, 5, 20), 1), ("a", "t2", "上海", "长沙", dt.date(2025, 5, 22), 2)], "who string, id string, departure string, arrival string, travel_date date, pos int")
    everything = spark.createDataFrame([("a", dt.date(2025, 1, 1)), ("b", dt.date(2025, 2, 1)), ("b", dt.date(2025, 2, 9))], "who string, day date")
    got = sorted((r["who"], r["destination"], str(r["travel_start"]), str(r["travel_end"])) for r in documents.trips_of(t, "who", everything).collect())
    assert got == [("a", "上海", "2025-05-20", "2025-05-22"), ("b", "", "2025-02-01", "2025-02-09")]
