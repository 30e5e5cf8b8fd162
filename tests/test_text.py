from pyspark.sql import functions as F

from tallyweave.functions import fields, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_capitals(spark):
    want = {0: "零元整", 10000: "壹佰元整", 813278: "捌仟壹佰叁拾贰元柒角捌分", 10**10: "壹亿元整", 100105: "壹仟零壹元零伍分", 1000000: "壹万元整", 50: "伍角", 5: "伍分"}
    for cents, words in want.items():
        assert one(spark, text.capital_amount(F.lit(cents).cast("bigint"))) == words


def test_station(spark):
    for a, b in {"上海虹桥站": "上海", "广州南站": "广州", "成都双流国际机场": "成都", "宝安": "深圳"}.items():
        assert one(spark, text.station_city(F.lit(a))) == b


def test_merchant(spark):
    score = lambda a, b: one(spark, text.merchant_score(F.lit(a), F.lit(b)))
    assert score("如家酒店", "如家酒店") == 1.0 and score("Hotel A", "hotel a") == 1.0
    assert score("北京如家酒店", "如家酒店") == 0.9 and score("如家快捷上海分店甲", "北京如家二店乙") == 0.85 and score("", "x") == 0.0


def test_document_fields(spark):
    amount = lambda t: one(spark, fields.document_amount(F.lit(t)))
    assert amount("6.30价税合计(大写)") == 6.3 and amount("税额 143.10价税合计\n实际 2528.05价税合计") == 2528.05
    assert amount("价税合计（大写） ¥523.57") == 523.57 and amount("没有金额 2026") is None
    assert one(spark, fields.document_number(F.lit("发 票 号 码:32092584"))) == "32092584" and one(spark, fields.document_number(F.lit("26512000001728418261发票号码"))) == "26512000001728418261"
    assert str(one(spark, text.document_date(F.lit("20年06月05日")))) == "2020-06-05" and one(spark, text.document_date(F.lit("2026-02-30"))) is None
    assert one(spark, fields.company_name(F.lit("购买方 甲有限公司 销售方 乙丙股份有限公司"))) == "乙丙股份有限公司"
    assert one(spark, fields.refund_in_status(F.lit("已退款(¥12.50)"))) == 12.5 and one(spark, fields.discount_in_remark(F.lit("无"))) == 0.0


def test_category(spark):
    cat = lambda a, b: one(spark, text.category(F.lit(a), F.lit(b)))
    assert cat("某酒店", "*住宿服务*") == "Hotel" and cat("", "*保险服务*国内机票航空意外险") == "Insurance" and cat(None, None) == "Other"


def test_sellers_and_cells(spark):
    seller = lambda t: one(spark, fields.document_seller(F.lit(t)))
    assert seller("名称：某大学 统一社会信用代码 1 名称：甲乙有限公司 统一社会信用代码 2") == "甲乙有限公司" and seller("名 称：甲店\n电话 名称：某医院 地址") == "甲店" and seller("收款单位：丙店 x") == "丙店" and seller("") == ""
    assert one(spark, fields.clean_seller(F.lit(" 甲店销售方 售"))) == "甲店" and one(spark, fields.is_buyer(F.lit("某学院"))) and one(spark, fields.company_before(F.lit("甲有限公司 税号 乙有限公司"), "税号")) == "甲有限公司"
    assert one(spark, fields.enough_text(F.array(F.lit("甲"), F.lit(None).cast("string"), F.lit("ab")), 5)) and not one(spark, fields.enough_text(F.array(F.lit("ab")), 3))
    seq = lambda t: one(spark, fields.seq_number(F.lit(t)))
    assert seq(" 12 ") == 12 and seq("46周五") == 46 and seq("201") is None and seq("01-02") is None and seq("x") is None
    clean = lambda t: one(spark, fields.clean_time(F.lit(t)))
    assert clean("3 01-02 08: 30") == "01-02 08: 30" and clean("01-02 08:30") == "01-02 08:30" and clean("7") == "7"
    assert one(spark, fields.garbled_time(F.lit("08:??"))) and one(spark, fields.garbled_time(F.lit(None).cast("string"))) and not one(spark, fields.garbled_time(F.lit("01-02 08:30")))
    assert one(spark, fields.document_item(F.lit("*住宿服务*房费"))) == "住宿服务" and one(spark, fields.document_item(F.lit("项目名称： 餐费 1"))) == "餐费" and one(spark, fields.looks_like_datetime(F.lit("2025年1月2日"))) and not one(spark, fields.looks_like_datetime(F.lit("甲 12.50")))


def test_routing(spark):
    from tallyweave.functions import routing

    kind = lambda t: one(spark, routing.document_kind(F.lit(t)))
    assert kind("滴滴出行 行程单") == "RideHailingItinerary" and kind("国内机票航空意外险") == "Other" and kind("G123 长沙站") == "TrainInvoice" and kind("滴⼦ T3") == "RideHailingInvoice" and kind(None) == "Other" and kind("电子发票 普通发票") == "VatElectronicInvoice"
    by_text = lambda t, k="Other": one(spark, routing.category_by_text(F.lit(t), F.lit(k)))
    assert by_text("*运输服务*高铁票") == "Train" and by_text("*运输服务*") == "CityTransport" and by_text("x", "TollInvoice") == "Toll" and by_text("ETC") == "Toll" and by_text("x") == "Other"
    strategy = lambda cat, n, seller, **k: one(spark, routing.strategy(F.lit(cat), F.lit(n), F.lit(seller), **{a: F.lit(b) for a, b in k.items()}))
    assert strategy("CityTransport", 1, "") == "OneToMany" and strategy("Meal", 0, "x") == "AmountWithMerchant" and strategy("Meal", 0, "", payments=5) == "StrictAmountOnly" and strategy("Meal", 0, "x", has_merchants=False, exact_times=True) == "AmountWithTime" and strategy("Meal", 0, "", payments=300) == "FuzzyMatching"


def test_summaries(spark):
    from tallyweave.operators import summaries

    pays = F.array(F.struct(F.lit(3.0).alias("amount"), F.lit("Wechat").alias("source"), F.lit("7").alias("transaction_id")), F.struct(F.lit(2.0).alias("amount"), F.lit("Alipay").alias("source"), F.lit("8").alias("transaction_id")))
    assert one(spark, summaries.payment_numbers(pays)) == "微信单号：7，支付宝单号：8" and one(spark, summaries.by_hand(F.lit(5.0), pays))["confidence"] == 1.0 and one(spark, summaries.by_hand(F.lit(6.0), pays))["confidence"] == 0.8
    assert [one(spark, summaries.band(F.lit(x))) for x in (0.0, 0.5, -5.0, 50.0)] == ["equal", "near", "off", "far"] and one(spark, summaries.label(F.lit("Toll"))) == "市内交通费"
    assert one(spark, summaries.unpaired_rides(F.lit(3), F.array(F.lit(0)))) == 2 and one(spark, summaries.unpaired_rides(F.lit(3), F.array().cast("array<int>"))) == 0
    assert one(spark, summaries.hours_apart(F.lit(None).cast("int"))) == 999 and one(spark, summaries.close_by(F.lit(9.0), F.lit(50.0), F.lit(7))) and not one(spark, summaries.close_by(F.lit(11.0), F.lit(50.0), F.lit(1)))
    m = spark.createDataFrame([("a", 2, [0])], "inv_id string, rides int, pairs array<int>")
    assert tuple(summaries.gaps(m, m.limit(0)).first()) == (0, 1, True)
