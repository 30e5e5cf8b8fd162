from pyspark.sql import functions as F

from tallyweave.functions import routing
from tallyweave.operators import invoice_cells

CELLS = "doc_id string, page int, table_no int, row_no int, col_no int, texts array<string>"


def test_fields(spark):
    rows = [
        ("a", 1, 0, 0, 0, ["销售方信息"]), ("a", 1, 0, 0, 1, [None, "", "", ""]), ("a", 1, 0, 0, 2, ["名称：甲 乙 酒店有限公司 统一社会信用代码 91430100MA4L0AAA1B"]), ("a", 1, 0, 1, 0, ["x", "*住宿服务*房费 天 2 200.00", "", ""]),
        ("a", 1, 0, 2, 0, ["价税合计（大写）"]), ("a", 1, 0, 2, 1, ["叁佰圆整", "（小写）¥1,300.50"]), ("a", 1, 0, 3, 0, ["备 注"]), ("a", 1, 0, 3, 1, ["ab"]), ("a", 1, 0, 3, 2, ["6月1日入住"]), ("a", 2, 0, 0, 0, ["价税合计"]), ("a", 2, 0, 0, 1, ["9.99"]),
        ("b", 1, 0, 0, 0, None), ("c", 1, 0, 0, 0, ["备注" + "长" * 30_000]), ("c", 1, 0, 0, 1, ["值值值"]),
    ]
    got = {r["doc_id"]: r for r in invoice_cells.invoice_fields(spark.createDataFrame(rows, CELLS)).collect()}
    a = got["a"]
    assert (a["seller"], a["amount"], a["remarks"], a["item"], a["detail"]) == ("甲乙酒店有限公司", 1300.5, "6月1日入住", "住宿服务", "房费")
    assert got["b"]["amount"] is None and got["c"]["remarks"] is None and invoice_cells.invoice_fields(spark.createDataFrame([], CELLS)).count() == 0
    texts = spark.createDataFrame([("a", "发票号码：12345678 2025年6月3日"), ("z", "nothing"), ("y", "价税合计 ¥5.00 名称：丙餐饮店")], "doc_id string, text string")
    inv = {r["doc_id"]: r for r in invoice_cells.invoices_of(spark.createDataFrame(rows, CELLS), texts).collect()}
    assert set(inv) == {"a", "y"} and inv["a"]["number"] == "12345678" and inv["a"]["category"] == "Hotel" and str(inv["a"]["date"]) == "2025-06-03" and inv["y"]["amount"] == 5.0


def test_seller_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    seller = lambda t: one(invoice_cells.seller_value(F.lit(t)))
    assert seller("甲乙丙公司 名称：") == "甲乙丙公司" and seller("名甲乙称：丙公司 123") == "甲乙丙公司" and seller("91430100MA4L0AAA1B 名称：甲店铺") == "甲店铺" and seller("") is None
    detail = lambda t: one(invoice_cells.item_detail(F.lit(t)))
    assert detail("*保险服务*组合险 份 1") == "组合险" and detail("*餐饮服务*餐费**x") == "餐费" and detail("*a*合计") is None and detail("x") is None


def test_cell_categories(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    cat = lambda item="", detail="", seller="", text="", remarks="": one(routing.category_by_cells(*map(F.lit, (item, detail, seller, text, remarks))))
    assert cat("保险服务", "机票航意") == "Insurance" and cat(detail="预付卡", seller="公交公司") == "CityTransport" and cat(detail="预付卡") == "Other" and cat("生产生活服务", seller="某酒店") == "Hotel" and cat("生产生活服务", text="通行费") == "Toll"
    assert cat("运输服务", text="车次") == "Train" and cat("运输服务") == "CityTransport" and cat(seller="某公路") == "Toll" and cat(remarks="退票") == "TicketChange" and cat() == "Other"
    kind = lambda t: one(routing.file_kind(F.lit(t)))
    assert kind("行程单 发票") == "Itinerary" and kind("结账单") == "Bill" and kind("增值税") == "Invoice" and kind("x") == "Other"
    assert one(routing.block_kind(F.lit("名称：甲"))) == "KeyValue" and one(routing.block_kind(F.lit("电子发票"))) == "Title" and one(routing.block_kind(F.lit(None).cast("string"))) == "Other"
