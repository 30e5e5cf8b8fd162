"""Geometry of words on pages: reading order, lines, columns, cells, bands.

``words``: doc_id, page, seq, text, x0, top, x1, bottom. What depends on the element before runs in a grouped
map per page; a page is bounded. The rest are native joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LINES = "doc_id string, page int, line_no int, part_no int, text string, x0 double, top double, x1 double, bottom double"


def group_lines(page: pd.DataFrame, height_share: float = 0.5, gap_share: float = 2.0) -> pd.DataFrame:
    """Words of one page as lines: a word joins a line whose first word is nearer than a share of the mean
    height; a line is cut where the blank between words exceeds ``gap_share`` heights."""
    w = page.sort_values(["top", "x0"], na_position="last", kind="stable")
    height = float((w["bottom"] - w["top"]).clip(lower=0).mean() or 0)
    near = max(height * height_share, 1e-9)
    lines, anchor = [], None
    for r in w.itertuples():
        if anchor is None or abs(r.top - anchor) > near or pd.isna(r.top):
            lines.append([])
            anchor = r.top
        lines[-1].append(r)
    out = []
    for n, line in enumerate(lines):
        line.sort(key=lambda r: (np.inf if pd.isna(r.x0) else r.x0))
        parts = [[line[0]]]
        for r in line[1:]:
            if r.x0 - parts[-1][-1].x1 > gap_share * height:
                parts.append([])
            parts[-1].append(r)
        for k, part in enumerate(parts):
            out.append((line[0].doc_id, line[0].page, n, k, "".join(r.text or "" for r in part), min(r.x0 for r in part), min(r.top for r in part), max(r.x1 for r in part), max(r.bottom for r in part)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])


def lines(words: DataFrame, height_share: float = 0.5, gap_share: float = 2.0) -> DataFrame:
    return words.groupBy("doc_id", "page").applyInPandas(lambda p: group_lines(p, height_share, gap_share), LINES)


def reading_order(words: DataFrame) -> DataFrame:
    """Adds ``place``: top to bottom, left to right, words without a position last."""
    w = W.partitionBy("doc_id", "page").orderBy(F.asc_nulls_last("top"), F.asc_nulls_last("x0"), "seq")
    return words.withColumn("place", F.row_number().over(w))


def column_split(words: DataFrame, width: float = 10.0, least: int = 3) -> DataFrame:
    """(doc_id, page, split_x) of pages in two columns: the middle of the widest run of at least ``least``
    empty cells of word starts; of equal runs the last."""
    low = F.min("x0").over(W.partitionBy("doc_id", "page"))
    cells = words.filter("x0 is not null").withColumn("low", low).select("doc_id", "page", "low", F.floor((F.col("x0") - F.col("low")) / width).alias("cell")).distinct()
    after = cells.withColumn("next", F.lead("cell").over(W.partitionBy("doc_id", "page").orderBy("cell")))
    gaps = after.withColumn("gap", F.col("next") - F.col("cell") - 1).filter(F.col("gap") >= least)
    best = gaps.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "page").orderBy(F.desc("gap"), F.desc("cell")))).filter("n = 1")
    return best.select("doc_id", "page", (F.col("low") + (F.col("cell") + F.col("next") + 1) / 2 * width).alias("split_x"))


def words_in_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_no, row_no, col_no, text) of each cell: the words whose centre lies in it, in reading order."""
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    inside = cx.between(F.col("c.x0"), F.col("c.x1")) & cy.between(F.col("c.top"), F.col("c.bottom"))
    on = (F.col("w.doc_id") == F.col("c.doc_id")) & (F.col("w.page") == F.col("c.page"))
    hit = words.alias("w").join(cells.alias("c"), on & inside)
    word = F.struct(F.col("w.top").alias("top"), F.col("w.x0").alias("x0"), F.col("w.seq").alias("seq"), F.col("w.text").alias("text"))
    grouped = hit.groupBy("c.doc_id", "c.page", "c.table_no", "c.row_no", "c.col_no").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    return grouped.select("doc_id", "page", "table_no", "row_no", "col_no", F.array_join(F.transform("ws", lambda x: x["text"]), "").alias("text"))


def bands(words: DataFrame) -> DataFrame:
    """(doc_id, page, band, x0, top, x1, bottom, words): the upper and lower fifth of a page and what is between."""
    high = F.max("bottom").over(W.partitionBy("doc_id", "page"))
    centre = (F.col("top") + F.col("bottom")) / 2
    band = F.when(centre < 0.2 * high, "header").when(centre > 0.8 * high, "footer").otherwise("body")
    return words.withColumn("band", band).groupBy("doc_id", "page", "band").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("words"))


def rides_in_text(docs: DataFrame) -> DataFrame:
    """(doc_id, ride_no, time, amount) of ride lists in text: lines with a time and a currency amount, or, where
    a document has none of those, lines ending in an amount whose time stands on them or up to six lines above."""
    from tallyweave.functions.dates import extract_datetime, repair_split_times
    from tallyweave.operators.records import last_within

    lines_ = docs.select("doc_id", F.posexplode(F.split(repair_split_times(F.col("text")), "\n")).alias("pos", "line"))
    lines_ = lines_.withColumn("time", extract_datetime(F.col("line")))
    money = r"[¥￥]\s*([\d,]+\.\d{2})|([\d,]+\.\d{2})\s*元"
    found = F.regexp_extract("line", money, 1)
    signed = F.when(F.col("line").rlike(money), F.regexp_replace(F.when(found != "", found).otherwise(F.regexp_extract("line", money, 2)), ",", "").try_cast("double"))
    bare = F.when(F.col("line").rlike(r"(?:^|\s)(\d{1,4}\.\d{2})\s*$"), F.regexp_extract("line", r"(?:^|\s)(\d{1,4}\.\d{2})\s*$", 1).try_cast("double"))
    marked = last_within(lines_.withColumns({"signed": F.when(F.col("time").isNotNull(), signed), "bare": bare}), "doc_id", "pos", "time").withColumn("any_signed", F.max(F.col("signed").isNotNull()).over(W.partitionBy("doc_id")))
    amount = F.when(F.col("any_signed"), F.col("signed")).otherwise(F.when(F.col("near").isNotNull(), F.col("bare")))
    out = marked.withColumn("amount", amount).filter(F.col("amount") > 0).withColumn("when", F.coalesce("time", "near"))
    return out.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).alias("ride_no"), F.col("when").alias("time"), "amount")
