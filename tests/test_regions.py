from pyspark.sql import functions as F

from tallyweave.operators import regions

SCHEMA = "doc_id string, page int, seq int, text string, x0 double, top double, x1 double, bottom double"


def words(spark, rows):
    return spark.createDataFrame([("d", 1, k, t, float(x), float(y), float(x + w), float(y + 10)) for k, (t, x, y, w) in enumerate(rows)] + [("d", 1, 99, None, None, None, None, None)], SCHEMA)


def test_boxes_and_columns(spark):
    w = words(spark, [("左1", 0, 0, 20), ("右1", 200, 0, 20), ("左2", 0, 20, 20), ("右2", 200, 20, 20)])
    splits = spark.createDataFrame([("d", 1, 100.0)], "doc_id string, page int, split_x double")
    assert regions.column_text(w, splits).first()["text"] == "左1 左2 右1 右2" and regions.column_text(w, splits.limit(0)).first()["text"] == "左1 右1 左2 右2"
    boxes = spark.createDataFrame([("d", 1, 7, 150.0, -1.0, 300.0, 40.0)], "doc_id string, page int, no int, x0 double, top double, x1 double, bottom double")
    assert tuple(regions.text_in_boxes(w, boxes, ["no"]).first()) == ("d", 1, 7, "右1右2")
    items = boxes.withColumnRenamed("no", "item_no")
    assert sorted(r["seq"] for r in regions.words_of_items(w, items).collect()) == [1, 3]
    p = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3, 1), (9, 1), (9, 5), (3, 5))])
    assert tuple(spark.range(1).select(regions.box_of(p).alias("b")).first()["b"]) == (3, 1, 9, 5)


def test_titles_and_fields(spark):
    w = words(spark, [("备", 0, 0, 10), ("注", 0, 14, 10), ("x", 0, 90, 10), ("6月1日", 20, 2, 40), ("入住", 20, 14, 40), ("名称：甲大学", 0, 50, 60), ("名称：", 200, 50, 30), ("乙有限公司", 235, 51, 60), ("价税合计", 0, 120, 40), ("¥12.50", 100, 121, 40)])
    assert [(r["text"], r["bottom"]) for r in regions.vertical_titles(w).collect()] == [("备注", 24.0)]
    assert regions.remarks_by_place(w).first()["remarks"] == "6月1日 入住"
    assert regions.seller_by_place(w).first()["seller"] == "乙有限公司" and regions.amount_by_place(w).first()["amount"] == 12.5
    rows = words(spark, [("1", 0, 0, 5), ("2", 0, 30, 5), ("3", 0, 52, 5), ("甲", 9, 52, 5)])
    assert regions.row_height(rows, F.col("text").rlike(r"^\d+$")).first()["height"] == 22.0
    assert regions.seller_by_place(rows).count() == 0 and regions.amount_by_place(rows.limit(0)).count() == 0
