"""Bill files as DataFrames: GBK statement text, workbooks, type sniffing, and a splitting import.

Statement bytes are decoded in a pandas UDF, because Spark's own text reader would decode them wrongly
without a word and its decode() refuses GBK. Workbooks are read as bytes by Spark, whatever the file system, and
parsed by the standard library in Arrow batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyweave.functions.dates import serial_datetime
from tallyweave.functions.fields import discount_in_remark, refund_in_status

HEADER = ("交易时间", "金额")


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("pdf", "jpg", "jpeg", "png")) -> DataFrame:
    """The files below a folder with one of the extensions, any case: path, modification time, length."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(ext.isin(list(extensions))).drop("content")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """GBK bytes as text, undecodable bytes as U+FFFD."""
    return content.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))


def statement_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of the lines after the header of each statement; blank and ``-`` lines are left out."""
    text = spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))
    lines = text.select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    head = F.col("line").contains(HEADER[0]) & F.col("line").contains(HEADER[1])
    first = lines.filter(head).groupBy("path").agg(F.min("pos").alias("head"))
    kept = lines.filter(F.trim("line").rlike(r"\S") & ~F.col("line").startswith("-"))
    return kept.join(first, "path").filter("pos > head").drop("head")


def alipay(spark: SparkSession, path: str) -> DataFrame:
    """Rows of comma-separated statements: closed trades and unreadable or empty amounts are dropped, incomes
    and refunds are negative. Refunds are netted by operators.records.net_refunds()."""
    cells = F.split("line", ",")
    cell = lambda i: F.trim(F.coalesce(F.try_element_at(cells, F.lit(i + 1)), F.lit("")))
    rows = statement_lines(spark, path).filter(F.size(cells) >= 8)
    out = rows.select("path", "pos", cell(0).alias("time"), cell(1).alias("type"), cell(2).alias("merchant"), cell(5).alias("direction"), F.coalesce(F.regexp_replace(cell(6), "[¥￥,]", "").try_cast("double"), F.lit(0.0)).alias("value"), cell(7).alias("method"), cell(8).alias("status"), cell(9).alias("trade_id"), cell(10).alias("merchant_order"))
    sign = F.when(F.col("type").contains("退款") | F.col("direction").contains("收入"), -1).when(F.col("direction").contains("支出") | F.col("direction").contains("支付"), 1)
    out = out.filter(~F.col("status").contains("交易关闭") & (F.col("value") > 0)).withColumn("amount", F.col("value") * sign)
    return out.filter("amount is not null").drop("value")


# ---------------------------------------------------------------- workbooks

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes, sheet: int = 0) -> Iterator[list[str]]:
    """The cells of one sheet of a workbook as text; numbers stay as written."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        if sheet >= len(names):
            return
        for row in ET.fromstring(book.read(names[sheet])).iter(f"{{{_NS['m']}}}row"):
            cells: list[str] = []
            for c in row.findall("m:c", _NS):
                column = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "")) [0] if re.match(r"[A-Z]+", c.get("r", "")) else "":
                    column = column * 26 + ord(ch) - 64
                while column and len(cells) < column - 1:
                    cells.append("")
                value = c.find("m:v", _NS)
                kind = c.get("t", "n")
                if kind == "s" and value is not None:
                    cells.append(shared[int(value.text)])
                elif kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
                else:
                    cells.append(value.text or "" if value is not None else "")
            yield cells


def workbook(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """(path, pos, cells) of the first or the chosen sheet of every .xlsx file of a folder or path, on any file system."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = list(enumerate(sheet_rows(content.as_py(), sheet)))
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.string()), pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["path", "pos", "cells"])

    books = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return books.select("path", "content").mapInArrow(read, "path string, pos int, cells array<string>")


def wechat(spark: SparkSession, path: str) -> DataFrame:
    """Rows of workbook bills below their header, net of what their status names as refunded."""
    cells = workbook(spark, path)
    head = cells.filter(F.try_element_at("cells", F.lit(1)).contains(HEADER[0])).groupBy("path").agg(F.min("pos").alias("head"))
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit("")))
    number = cell(0).try_cast("double")
    time = F.when((number > 40000) & (number < 55000), serial_datetime(number)).otherwise(cell(0))
    rows = cells.join(head, "path").filter((F.col("pos") > F.col("head")) & (F.size("cells") >= 9))
    out = rows.select("path", "pos", time.alias("time"), cell(1).alias("type"), cell(2).alias("merchant"), cell(3).alias("category"), cell(4).alias("direction"), F.coalesce(F.regexp_replace(cell(5), "[¥￥,]", "").try_cast("double"), F.lit(0.0)).alias("value"), cell(6).alias("method"), cell(7).alias("status"), cell(8).alias("trade_id"), refund_in_status(cell(7)).alias("refund"), discount_in_remark(cell(10)).alias("discount"))
    income, expense = F.col("direction").contains("收"), F.col("direction").contains("支")
    amount = F.when(income & F.col("type").contains("退款"), -F.col("value")).when(expense & F.col("status").contains("全额退款"), None).when(expense & (F.col("refund") > 0), F.col("value") - F.col("refund")).when(expense, F.col("value"))
    return out.withColumn("amount", amount).filter(F.abs("amount") >= 0.01)


def bill_kind(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of bill files by words in their first 64 KiB, else by their extension."""
    raw = spark.read.format("binaryFile").load(path).select("path", decoded(F.expr("substring(content, 1, 65536)")).alias("text"))
    words = lambda *w: F.coalesce(F.col("text").rlike("|".join(w)), F.lit(False))
    kind = F.when(words("交易单号", "商户单号"), "Wechat").when(words("商家订单号", "支付宝"), "Alipay").when(F.lower("path").endswith(".csv"), "Alipay").otherwise("Wechat")
    return raw.select("path", kind.alias("kind"))


def region_list(rows: DataFrame) -> DataFrame:
    """(region, value) of a two-column sheet whose first column joins regions by ``、``; values up to 0 are left out."""
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit("")))
    out = rows.select(F.explode(F.split(cell(0), "、")).alias("region"), cell(1).try_cast("double").alias("value"))
    return out.select(F.trim("region").alias("region"), "value").filter("region <> '' and value > 0")


def with_errors(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that have all required values, rows that lack one with its name as ``error``)."""
    lacking = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    marked = df.withColumn("error", lacking)
    return marked.filter("error = ''").drop("error"), marked.filter("error <> ''")


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds the place of each row within its key."""
    return df.withColumn("no", F.row_number().over(W.partitionBy(key).orderBy(order)))
