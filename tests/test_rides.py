from pyspark.sql import functions as F

from tallyweave.operators import rides

CELLS = "doc_id string, page int, table_no int, row_no int, col_no int, text string"
HEAD = ["序号", "服务商", "上车时间", "城市", "起点", "终点", "金额(元)"]


def table(doc, rows, page=1, table_no=0):
    return [(doc, page, table_no, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)]


def test_cells(spark):
    rows = table("a", [["行程单"], HEAD, ["1", "甲车", "2025-01-02 08:30", "北京", "起1", "终1", "12.50"], ["", "", "", "", "出站：西门", "", ""], ["2", "乙车", "2025-01-02 09:30", "北京", "进站：南门~出站：北门", "", "8"], ["3", "丙车", "x", "", "", "", "0"]])
    rows += table("flat", [HEAD, ["1 甲车 01-02 08:30 12.50"]]) + table("nohead", [["1", "2"]]) + [("null", 1, 0, 0, 0, None)]
    rows += table("route", [["序", "行程类型", "时间", "进出站", "金额"], ["1", "地铁", "2025-01-02 08:30", "进站：甲站~出站：乙站", "3.00元"], ["", "", "", "出站：丙站", ""]])
    got = {(r["doc_id"], r["pos"]): (r["date_time"], r["provider"], r["pickup"], r["dropoff"], r["amount"]) for r in rides.rides_in_cells(spark.createDataFrame(rows, CELLS)).collect()}
    assert got == {
        ("a", 1): ("2025-01-02 08:30", "甲车", "起1", "终1", 12.5), ("a", 2): ("2025-01-02 09:30", "乙车", "南门", "", 8.0),
        ("route", 1): ("2025-01-02 08:30", "地铁", "甲站", "乙站", 3.0),
    }
    assert rides.rides_in_cells(spark.createDataFrame([], CELLS)).count() == 0


def test_words(spark):
    schema = "doc_id string, page int, seq int, text string, x0 double, top double, x1 double, bottom double"
    at = lambda doc, rows: [(doc, 1, 10 * r + c, x, c * 100.0, y + (c % 2) + 0.0, c * 100.0 + 40, y + 10.0) for r, (y, row) in enumerate(rows) for c, x in enumerate(row) if x]
    rows = at("a", [(10, HEAD), (60, ["1", "甲车", "2025-01-02 08:30", "北京", "起", "终", "1250"]), (72, ["", "", "", "", "点南", "", ""]), (100, ["2", "乙车", "2025-01-02 09:30", "", "x", "y", "8.00"]), (130, ["3", "乙车", "2025-01-02 09:30", "", "x", "y", "8.00"]), (160, ["x", "", "", "", "", "", ""])])
    rows += at("nohead", [(10, ["序", "时间"]), (40, ["1", "2"])]) + [("null", 1, 0, None, None, None, None, None)]
    got = [(r["doc_id"], r["date_time"], r["pickup"], r["amount"]) for r in rides.rides_in_words(spark.createDataFrame(rows, schema)).orderBy("pos").collect()]
    assert got == [("a", "2025-01-02 08:30", "起点南", 12.5), ("a", "2025-01-02 09:30", "x", 8.0)]


def test_repair(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lacks = lambda t, a: one(rides.missing_fields(F.lit(t), F.lit(a)))
    assert lacks("2025-01-02 08:30", 3.0) == [] and lacks("01-02 08:??", 0.0) == ["amount", "date_time"] and lacks(None, None) == ["amount", "date_time"] and lacks("01-02 08:", 1.0) == ["date_time"]
    assert one(rides.printed_total(F.lit("合计 1,234.50 元"))) == 1234.5 and one(rides.printed_total(F.lit("合计金额：¥3.50"))) == 3.5 and one(rides.printed_total(F.lit("x"))) is None
    r = spark.createDataFrame([("a", 1, "01-02 08:??", "甲", 1.0), ("a", 2, "01-03 09:00", "乙车行", 2.0), ("b", 1, "01-05 ??", "丙车", 5.0)], "doc_id string, pos int, date_time string, provider string, amount double")
    ref = spark.createDataFrame([("a", [1.5, 2.0], ["甲车", "乙车"], ["01-02 08:10", "01-03 09:30"]), ("b", [1.0, 2.0], ["丙车行", "丁"], ["01-04 10:00", "01-05 11:00"])], "doc_id string, amounts array<double>, providers array<string>, times array<string>")
    got = sorted((x["doc_id"], x["pos"], x["date_time"], x["provider"], x["amount"]) for x in rides.cross_checked(r, ref).collect())
    assert got == [("a", 1, "01-02 08:10", "甲车", 1.5), ("a", 2, "01-03 09:00", "乙车行", 2.0), ("b", 1, "01-05 11:00", "丙车行", 5.0)]
    lists = rides.reference_lists(spark.createDataFrame([("a", "1 专车 01-02 08:10 12.50元\n2 快车 01-03 09:30 3.00 元")], "doc_id string, text string")).first()
    assert lists["amounts"] == [12.5, 3.0] and lists["providers"] == ["专车", "快车"] and lists["times"] == ["01-02 08:10", "01-03 09:30"]


def test_documents_of_invoices_and_cities(spark):
    docs = spark.createDataFrame([("k", "d1", 1, 50.0), ("k", "d2", 2, 50.0), ("k", "d3", 3, 70.0), ("m", "d4", 1, 50.0)], "batch string, doc_id string, doc_pos int, total double")
    inv = spark.createDataFrame([("k", "i1", 1, 50.0), ("k", "i2", 2, 50.0), ("k", "i3", 3, 50.0)], "batch string, inv_id string, inv_pos int, inv_amount double")
    assert sorted((r["doc_id"], r["inv_id"]) for r in rides.paired_documents(docs, inv, ["batch"]).collect()) == [("d1", "i1"), ("d2", "i2")]
    t = spark.createDataFrame([("武汉某店", [("甲", "乙", "武汉市")], ["武汉"]), ("店", [("甲", "乙", None)], ["武汉"]), ("店", [], ["武汉"]), ("店", [("甲", "乙", "")], [])], "name string, rides array<struct<pickup:string,dropoff:string,city:string>>, cities array<string>")
    assert [r["x"] for r in t.select(rides.in_cities([F.col("name")], F.col("rides"), F.col("cities")).alias("x")).collect()] == [True, False, True, True]
