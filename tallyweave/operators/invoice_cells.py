"""Fields of an invoice from the cells of its tables.

``cells``: doc_id, page, table_no, row_no, col_no, texts (array of the cell's readings: line, merged, column, raw). A field is read from the
first cell to the right of its label, from the first of the cell's readings that gives a value; of several tables and
rows the first counts. One aggregation a document, no sort of whole documents.

Defined results: NULL readings count as empty; a field that is not found is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions import fields
from tallyweave.functions.text import is_tax_id, squeeze_han_blanks

# Labels with the most letters that their cell may have, heads that end an item's detail, its units, words no seller begins with.
LABELS = {"seller": ("销售方", 15), "amount": ("价税合计", 60), "remarks": ("备注", 15)}
HEADS = ("项目名称", "规格型号", "单位", "数量", "单价", "金额", "税率", "税额", "合计")
UNITS = "份个张次台套件升吨度人间晚日天月年页本册盒箱包批"
NO_SELLER = ("项目", "货物", "密码")
HAN = r"[\x{4e00}-\x{9fff}]"


def _name(text: Column, least: int = 3, han: bool = True) -> Column:
    """The text if it may be a seller's name."""
    t = F.trim(text)
    ok = (F.char_length(t) >= least) & ~is_tax_id(t)
    return F.when(ok & t.rlike(HAN) if han else ok, t)


def seller_value(text: Column) -> Column:
    """A name before its label, after it, or written between the label's signs; else the seller of the text."""
    before = F.regexp_extract(F.get(F.split(text, r"名称[：:]"), 0), r"(\S{3,40})\s*\z", 1)
    before = F.when(text.rlike(r"名称[：:]") & ~F.substring(before, 1, 2).isin(*NO_SELLER), _name(before))
    after = F.get(F.split(F.get(F.split(text, r"名称[：:]", 2), 1), r"\s*称[：:]|\s+[A-Z0-9]{15,}|\s*统一社会|\s*纳税人", 2), 0)
    one, two = F.regexp_extract(text, r"名(.+?)称[：:](.+)", 1), F.regexp_extract(text, r"名(.+?)称[：:]\s*([^0-9\s]*)", 2)
    apart = F.when(one != "", F.coalesce(_name(F.concat(F.trim(one), two)), _name(two), _name(one)))
    return F.coalesce(before, _name(after, han=False), apart, F.nullif(fields.document_seller(text), F.lit("")))


def amount_value(text: Column) -> Column:
    """The first number with two decimals below a million."""
    values = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*\.\d{2})"), 1), fields.amount_of)
    return F.get(F.filter(values, lambda v: (v > 0) & (v < fields.LARGEST)), 0)


def remarks_value(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.char_length(t) >= 3, t)


def item_value(text: Column) -> Column:
    """The code between two stars, if it has Han characters."""
    code = F.regexp_extract(text, r"\*(.+?)\*", 1)
    return F.when(code.rlike(HAN), code)


def item_detail(text: Column) -> Column:
    """What follows the code of an item: up to a second code, a digit, a currency sign, a head, a unit or a 合 of its own."""
    after = F.get(F.split(F.get(F.split(text, r"\*.+?\*", 2), 1), r"\*\*", 2), 0)
    detail = F.get(F.split(F.ltrim(after), "[0-9¥]|" + "|".join(HEADS) + rf"|合(?=\s|计|$)|(?<=\s)[{UNITS}](?=\s|$)", 2), 0)
    return F.nullif(F.trim(detail), F.lit(""))


VALUES = {"seller": seller_value, "amount": amount_value, "remarks": remarks_value}


def first_reading(texts: Column, value) -> Column:
    """The value of the first reading that gives one."""
    return F.get(F.filter(F.transform(texts, value), lambda v: v.isNotNull()), 0)


def invoice_fields(cells: DataFrame) -> DataFrame:
    """(doc_id, seller, amount, remarks, item, detail)."""
    clean = F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: squeeze_han_blanks(F.coalesce(t, F.lit(""))))
    c = cells.withColumns({"texts": clean, "written": F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")))})
    merged, raw = F.coalesce(F.get("texts", 1), F.get("texts", 0), F.lit("")), F.regexp_replace(F.coalesce(F.try_element_at("texts", F.lit(-1)), F.lit("")), r"\s", "")
    row = W.partitionBy("doc_id", "page", "table_no", "row_no")
    place, found = F.struct("page", "table_no", "row_no", "col_no"), []
    for name, (label, most) in LABELS.items():
        is_label = (merged.contains(label) & (F.char_length(merged) <= most)) | (raw.contains(label) & (F.char_length(raw) <= most))
        c = c.withColumn(f"at_{name}", F.min(F.when(is_label, F.col("col_no"))).over(row))
    for name, value in VALUES.items():
        got = F.when(F.col("col_no") > F.col(f"at_{name}"), first_reading(F.col("texts"), value))
        found.append(F.min_by(got, F.when(got.isNotNull(), place)).alias(name))
    rest = lambda c: F.slice(c, F.when(F.size(c) > 1, 2).otherwise(1), F.greatest(F.size(c), F.lit(1)))
    item = first_reading(rest("texts"), item_value)
    found += [F.min_by(item, F.when(item.isNotNull(), place)).alias("item"), F.min_by(first_reading(rest("written"), item_detail), F.when(item.isNotNull(), place)).alias("detail")]
    return c.groupBy("doc_id").agg(*found)


def invoices_of(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Invoices from their cells and, for what the cells lack, from their whole text (doc_id, text).

    doc_id, number, amount, seller, item, date, remarks, category; documents without an amount are left out.
    """
    from tallyweave.functions import routing
    from tallyweave.functions.text import document_date

    both = texts.join(invoice_fields(cells), "doc_id", "left")
    text = F.col("text")
    number = F.coalesce(F.nullif(fields.document_number(text), F.lit("")), F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{18,22})(?!\d)", 1), F.lit("")), F.lit(""))
    told = both.withColumns({"number": number, "amount": F.coalesce("amount", fields.document_amount(text)), "seller": F.coalesce("seller", F.nullif(fields.document_seller(text), F.lit("")), fields.company_name(text), F.lit("")), "item": F.coalesce("item", fields.document_item(text)), "date": document_date(text)})
    kind = routing.category_by_cells(F.col("item"), F.col("detail"), F.col("seller"), text, F.col("remarks"))
    return told.filter("amount is not null").select("doc_id", "number", "amount", "seller", "item", "date", F.coalesce("remarks", F.lit("")).alias("remarks"), kind.alias("category"))
