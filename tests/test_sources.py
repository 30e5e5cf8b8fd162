import zipfile

from tallyweave.operators import records
from tallyweave.sources import bills
from tallyweave.streaming import arrivals


def test_statement(spark, tmp_path):
    text = "支付宝账单\n----\n交易时间,交易分类,交易对方,对方账号,商品说明,收/支,金额,方式,交易状态,订单号,商家订单号\n2025-01-01 10:00:00,餐饮,店甲,x,y,支出,￥12.50,余额,交易成功,T1,M1\n2025-01-02 10:00:00,退款,店甲,x,y,不计收支,2.50,余额,退款成功,T1_R,M1\n2025-01-03 10:00:00,餐饮,店乙,x,y,支出,9,余额,交易关闭,T3,M3\n\n"
    (tmp_path / "a.csv").write_bytes(text.encode("gbk"))
    rows = bills.alipay(spark, str(tmp_path / "a.csv"))
    assert sorted((r["trade_id"], r["amount"]) for r in rows.collect()) == [("T1", 12.5), ("T1_R", -2.5)]
    assert [round(r["net"], 2) for r in records.net_refunds(rows).collect()] == [10.0]
    assert bills.bill_kind(spark, str(tmp_path / "a.csv")).first()["kind"] == "Alipay"


def sheet(path, rows):
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + i)}{n + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + i)}{n + 1}"><v>{v}</v></c>' for i, v in enumerate(r)) + "</row>" for n, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    sheet(tmp_path / "w.xlsx", [["微信账单"], ["交易时间", "类型", "对方", "商品", "收/支", "金额", "方式", "状态", "单号", "商户单号", "备注"], [45658.5, "商户消费", "店甲", "饭", "支出", "¥20.00", "零钱", "已退款(¥5.00)", "W1", "", "已优惠¥1.00"], ["2025-01-02 08:00:00", "退款", "店乙", "饭", "收入", "3", "零钱", "成功", "W2", "", "/"], ["2025-01-02 08:00:00", "商户消费", "店丙", "饭", "支出", "3", "零钱", "已全额退款", "W3", "", "/"]])
    got = sorted((r["trade_id"], r["time"], r["amount"], r["discount"]) for r in bills.wechat(spark, str(tmp_path)).collect())
    assert got == [("W1", "2025-01-01 12:00:00", 15.0, 1.0), ("W2", "2025-01-02 08:00:00", -3.0, 0.0)]
    sheet(tmp_path / "h.xlsx", [["甲市、乙市", 350], ["丙市", 0]])
    assert sorted(r["region"] for r in bills.region_list(bills.workbook(spark, str(tmp_path / "h.xlsx"))).collect()) == ["乙市", "甲市"]
    assert bills.files(spark, str(tmp_path), ("XLSX".lower(),)).count() == 2


def test_stream(spark, tmp_path):
    schema = "id int, number string"
    arriving, store = str(tmp_path / "in"), str(tmp_path / "store")
    for rows in ([(1, "a"), (2, "a"), (3, "")], [(4, "a"), (5, "b"), (6, "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arriving)
        arrivals.store_new(spark, arriving, store, str(tmp_path / "ck"), schema, "number", "id").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(store).collect()) == [1, 3, 5, 6]
