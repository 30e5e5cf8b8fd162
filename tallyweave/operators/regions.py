"""Fields by their place on a page: boxes, columns, vertical titles, what stands right of or below a label.

``words``: doc_id, page, seq, text, x0, top, x1, bottom, as in layout. All are joins within a page and aggregates; words without a
place or text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions.fields import amount_of
from tallyweave.functions.text import is_tax_id

PAGE = ["doc_id", "page"]
ABOVE, BELOW = 5.0, 3.0  # how far an amount may stand above and below its label
LEAST_GAP = 10.0  # distance of two rows of a table at least


def box_of(points: Column) -> Column:
    """struct(x0, top, x1, bottom) around an array of structs with x and y."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("top"), F.array_max(x).alias("x1"), F.array_max(y).alias("bottom"))


def placed(words: DataFrame) -> DataFrame:
    return words.filter("text is not null and x0 is not null and top is not null and x1 is not null and bottom is not null")


def text_of(order: list[str], between: str = "") -> Column:
    """The texts of a group in the order of its columns."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda w: w["text"]), between)


def column_text(words: DataFrame, splits: DataFrame) -> DataFrame:
    """(doc_id, page, text): pages in two columns (split_x) read column by column, others from top to bottom."""
    w = placed(words).join(splits, PAGE, "left").withColumn("column", (F.col("x0") >= F.coalesce("split_x", F.lit(float("inf")))).cast("int"))
    return w.groupBy(*PAGE).agg(text_of(["column", "top", "x0", "seq"], " ").alias("text"))


def text_in_boxes(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, page, keys, text) of the words whose centre lies in a box, in reading order."""
    b = boxes.select(*PAGE, *keys, F.col("x0").alias("bx0"), F.col("top").alias("btop"), F.col("x1").alias("bx1"), F.col("bottom").alias("bbottom"))
    inside = ((F.col("x0") + F.col("x1")) / 2).between(F.col("bx0"), F.col("bx1")) & ((F.col("top") + F.col("bottom")) / 2).between(F.col("btop"), F.col("bbottom"))
    return placed(words).join(b, PAGE).filter(inside).groupBy(*PAGE, *keys).agg(text_of(["top", "x0", "seq"]).alias("text"))


def vertical_titles(words: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, page, text, x0, top, x1, bottom) of single characters that stand below each other.

    Characters belong to one column while the next starts within their width of the one before, and to one title
    while the blank between them is below their height.
    """
    c = placed(words).filter(F.char_length(F.trim("text")) == 1).withColumns({"wide": F.col("x1") - F.col("x0"), "high": F.col("bottom") - F.col("top")})
    across = W.partitionBy(*PAGE).orderBy("x0", "top", "seq")
    c = c.withColumn("new", (F.col("x0") - F.lag("x0").over(across) > F.col("wide") / 2).cast("int")).withColumn("column", F.sum(F.coalesce("new", F.lit(0))).over(across))
    down = W.partitionBy(*PAGE, "column").orderBy("top", "x0", "seq")
    c = c.withColumn("cut", (F.col("top") - F.lag("bottom").over(down) > F.col("high")).cast("int")).withColumn("title", F.sum(F.coalesce("cut", F.lit(0))).over(down))
    box = [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]
    return c.groupBy(*PAGE, "column", "title").agg(text_of(["top", "x0", "seq"]).alias("text"), F.count("*").alias("n"), *box).filter(F.col("n") >= least).drop("column", "title", "n")


def beside(words: DataFrame, titles: DataFrame, side: str = "right") -> DataFrame:
    """(doc_id, page, title, text): the words right of a title at its height, or below it within its width."""
    t = titles.select(*PAGE, F.col("text").alias("title"), F.col("x0").alias("tx0"), F.col("top").alias("ttop"), F.col("x1").alias("tx1"), F.col("bottom").alias("tbottom"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    near = (F.col("x0") >= F.col("tx1")) & cy.between(F.col("ttop"), F.col("tbottom")) if side == "right" else (F.col("top") >= F.col("tbottom")) & cx.between(F.col("tx0"), F.col("tx1"))
    return placed(words).join(t, PAGE).filter(near).groupBy(*PAGE, "title").agg(text_of(["top", "x0", "seq"], " ").alias("text"))


def _line_after(words: DataFrame, label: str, rightmost: bool) -> DataFrame:
    """The text of a label's word and of the words right of it on its line."""
    w = placed(words)
    order = F.struct((-F.col("x0")).alias("x"), "top", "seq") if rightmost else F.struct("top", F.col("x0").alias("x"), "seq")
    first = w.filter(F.col("text").rlike(label)).groupBy(*PAGE).agg(F.min_by(F.struct("x0", "top", "bottom"), order).alias("a"))
    line = w.join(first, PAGE).filter((F.col("x0") >= F.col("a.x0")) & ((F.col("top") + F.col("bottom")) / 2).between(F.col("a.top") - ABOVE, F.col("a.bottom") + BELOW))
    return line.groupBy(*PAGE).agg(text_of(["x0", "seq"]).alias("text"))


def seller_by_place(words: DataFrame) -> DataFrame:
    """(doc_id, seller): the name behind the right-most label of names, of the first page that has one."""
    name = F.trim(F.regexp_replace(F.regexp_extract("text", r"名\s*称\s*[：:]\s*(.+)", 1), r"统一社会.*$", ""))
    found = _line_after(words, r"名\s*称\s*[：:]", True).withColumn("seller", name).filter((F.char_length("seller") >= 3) & ~is_tax_id(F.col("seller")))
    return found.groupBy("doc_id").agg(F.min_by("seller", "page").alias("seller"))


def amount_by_place(words: DataFrame) -> DataFrame:
    """(doc_id, amount): the first number with two decimals on the line of the label of totals."""
    value = amount_of(F.regexp_extract("text", r"(?:价税合计|小写).*?(\d[\d,]*\.\d{2})", 1))
    found = _line_after(words, "价税合计|小写", False).withColumn("amount", value).filter("amount > 0")
    return found.groupBy("doc_id").agg(F.min_by("amount", "page").alias("amount"))


def remarks_by_place(words: DataFrame) -> DataFrame:
    """(doc_id, page, remarks): the words right of a vertical title of remarks, line by line."""
    titles = vertical_titles(words).filter(F.col("text").contains("备注"))
    return beside(words, titles).select(*PAGE, F.col("text").alias("remarks"))


def row_height(words: DataFrame, numbers: Column) -> DataFrame:
    """(doc_id, page, height): the smallest distance of two sequence numbers that are not on one line."""
    gap = F.col("top") - F.lag("top").over(W.partitionBy(*PAGE).orderBy("top", "seq"))
    return placed(words).filter(numbers).withColumn("gap", gap).filter(F.col("gap") > LEAST_GAP).groupBy(*PAGE).agg(F.min("gap").alias("height"))


def words_of_items(words: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, page, item_no, seq): which recognised item (item_no and box) each word lies in."""
    b = items.select(*PAGE, "item_no", F.col("x0").alias("bx0"), F.col("top").alias("btop"), F.col("x1").alias("bx1"), F.col("bottom").alias("bbottom"))
    inside = ((F.col("x0") + F.col("x1")) / 2).between(F.col("bx0"), F.col("bx1")) & ((F.col("top") + F.col("bottom")) / 2).between(F.col("btop"), F.col("bbottom"))
    met = placed(words).join(b, PAGE).filter(inside)
    return met.groupBy(*PAGE, "seq").agg(F.min("item_no").alias("item_no")).select(*PAGE, "item_no", "seq")
