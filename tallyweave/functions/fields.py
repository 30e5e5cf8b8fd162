"""Fields of document text that stand beside a label.

A text is cut at the labels of a field. What begins a piece follows a label, what ends one precedes a label, so
each field is a table of labels, of what may stand between label and value, and of the value's form; two
functions read them all. The same tables give the SQL that the queries are compared with.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = r"[\d,]+\.\d{2}"
LARGEST = 1_000_000


class Rule(NamedTuple):
    """Where a value stands. ``side``: before, after or apart (as a word of its own); ``pick``: first or largest."""

    labels: tuple[str, ...]
    side: str
    gap: str
    value: str
    pick: str = "first"
    not_beside: tuple[str, ...] = ()  # words that spoil the line of a value before its label


# Labels of amounts and of numbers, what may stand between them and the value, in the order in which they count.
AMOUNT = (
    Rule(("价税合计",), "before", r"[^\S\n]*", MONEY, "largest", ("税额", "税率", "不含税")),
    Rule(("价税合计", "合计金额", "总金额"), "after", r"[^¥￥]{0,20}[¥￥]\s*", MONEY),
    Rule(("价税合计", "合计金额"), "after", r"[^0-9]{0,10}", MONEY),
    Rule(("合计",), "after", r"\s*", MONEY + r"\s*元"),
    Rule((), "apart", "", r"[\d,]{1,7}\.\d{2}", "largest"),
    Rule(("¥", "￥"), "after", r"\s*", r"[\d,]+\.?\d*", "largest"),
)
NUMBER = (
    Rule(("发票号码：", "发票号码:", "No：", "No:"), "after", r"\s*", r"\d+"),
    Rule((r"发\s*票\s*号\s*码",), "after", r"[：:]?\s*", r"\d+"),
    Rule((r"发\s*票\s*号\s*码",), "before", r"\s*", r"\d{8,20}"),
)
ITEM_LABELS = ("项目名称", "货物或应税劳务", "商品名称")
# The word that ends a company's legal name, and the signs and number of letters that may stand before it.
COMPANY, NAME_SIGNS, NAME_LETTERS = "公司", "一-龥（）()", 40
REFUNDED, DISCOUNTED = ("已退款", "已退"), ("已优惠",)
NOT_A_WORD = r"[^\p{L}\p{N}_.,]+"


def _any(words: tuple[str, ...]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def found(text: Column, rule: Rule) -> Column:
    """The values that a rule finds, in the order of the text."""
    if rule.side == "apart":
        words = F.transform(F.split(text, NOT_A_WORD), lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
        return F.filter(words, lambda w: w.rlike(f"^(?:{rule.value})$"))
    pieces = F.split(text, _any(rule.labels))
    if rule.side == "after":
        beside = F.slice(pieces, 2, F.size(pieces))
        values = F.transform(beside, lambda p: F.regexp_extract(p, f"^{rule.gap}({rule.value})", 1))
    else:
        beside = F.slice(pieces, 1, F.size(pieces) - 1)
        if rule.not_beside:
            beside = F.filter(beside, lambda p: ~F.element_at(F.split(p, "\n"), -1).rlike(f"(?:{_any(rule.not_beside)}).*[0-9]"))
        values = F.transform(beside, lambda p: F.regexp_extract(p, rf"({rule.value}){rule.gap}\z", 1))
    return F.filter(values, lambda v: v != "")


def amount_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\d.]", "").try_cast("double")


def _least_bounded(values: Column) -> Column:
    return F.array_max(F.filter(F.transform(values, amount_of), lambda v: (v > 0) & (v < LARGEST)))


def document_amount(text: Column) -> Column:
    """The total of a document by the first rule that finds one; NULL if there is none."""
    return F.coalesce(*[_least_bounded(found(text, r)) if r.pick == "largest" else amount_of(F.get(found(text, r), 0)) for r in AMOUNT])


def document_number(text: Column) -> Column:
    """The number of a document, after or before its label; '' if there is none."""
    return F.coalesce(*[F.get(found(text, r), 0) for r in NUMBER], F.lit(""))


def document_item(text: Column) -> Column:
    """The first item between stars, or the word after its label; '' if there is none."""
    starred = F.split(text, r"\*")
    inside = F.filter(F.slice(starred, 2, F.greatest(F.size(starred) - 2, F.lit(0))), lambda x: (x != "") & ~x.contains("\n"))
    labelled = found(text, Rule(tuple(f"{x}{c}" for x in ITEM_LABELS for c in "：:"), "after", r"\s*", r"\S+"))
    return F.coalesce(F.get(inside, 0), F.get(labelled, 0), F.lit(""))


def company_name(text: Column) -> Column:
    """The last company name of a text: a run of name signs up to its last legal ending; NULL if there is none."""
    runs = F.transform(F.split(text, f"[^{NAME_SIGNS}]+"), lambda r: F.regexp_extract(r, f"^.*{COMPANY}", 0))
    named = F.filter(runs, lambda r: F.char_length(r) >= len(COMPANY) + 2)
    last = F.try_element_at(named, F.lit(-1))
    return F.substring(last, F.greatest(F.char_length(last) - len(COMPANY) - NAME_LETTERS, F.lit(0)) + 1, NAME_LETTERS + len(COMPANY))


def _amount_after(text: Column, words: tuple[str, ...]) -> Column:
    piece = F.get(F.split(text, _any(words), 2), 1)
    return F.coalesce(F.regexp_extract(F.translate(F.substring(piece, 1, 24), "(（¥￥", ""), r"^[\d.]+", 0).try_cast("double"), F.lit(0.0))


def refund_in_status(status: Column) -> Column:
    """The amount a status names as refunded; 0 if none."""
    return _amount_after(status, REFUNDED)


def discount_in_remark(remark: Column) -> Column:
    """The amount a remark names as discount; 0 if none."""
    return _amount_after(remark, DISCOUNTED)


def shape(text: Column) -> Column:
    """The text with 9 for every digit and one sign for each kind of colon."""
    return F.translate(text, "0123456789：", "9999999999:")


# Shapes that show a time or a date.
TIME_SHAPES = [f"9999{a}{m}{b}9" for a in "-/年" for m in ("9", "99") for b in "-/月"] + ["9:99", "99-99"]


def looks_like_datetime(text: Column) -> Column:
    mask = shape(text)
    out = mask.contains(TIME_SHAPES[0])
    for x in TIME_SHAPES[1:]:
        out = out | mask.contains(x)
    return out


# ---------------------------------------------------------------- the same in SQL


def _sql_found(rule: Rule) -> str:
    if rule.side == "apart":
        words = f"list_transform(string_split_regex(text, '{NOT_A_WORD}'), lambda w: regexp_replace(w, '^[.,]+|[.,]+$', '', 'g'))"
        return f"list_filter({words}, lambda w: regexp_full_match(w, '{rule.value}'))"
    pieces = f"string_split_regex(text, '{_any(rule.labels)}')"
    if rule.side == "after":
        values = f"list_transform({pieces}[2:], lambda p: regexp_extract(p, '^{rule.gap}({rule.value})', 1))"
    else:
        beside = f"{pieces}[:-2]"
        if rule.not_beside:
            beside = f"list_filter({beside}, lambda p: not regexp_matches(string_split(p, chr(10))[-1], '(?:{_any(rule.not_beside)}).*[0-9]'))"
        values = f"list_transform({beside}, lambda p: regexp_extract(p, '({rule.value}){rule.gap}\\z', 1))"
    return f"list_filter({values}, lambda v: v <> '')"


def amount_sql() -> str:
    number = lambda x: f"try_cast(regexp_replace({x}, '[^0-9.]', '', 'g') as double)"
    parts = [f"list_max(list_filter(list_transform({_sql_found(r)}, lambda x: {number('x')}), lambda v: v > 0 and v < {LARGEST}))" if r.pick == "largest" else number(f"({_sql_found(r)})[1]") for r in AMOUNT]
    return f"coalesce({', '.join(parts)})"


def number_sql() -> str:
    return f"coalesce({', '.join(f'({_sql_found(r)})[1]' for r in NUMBER)}, '')"


def company_sql() -> str:
    runs = f"list_transform(string_split_regex(text, '[^{NAME_SIGNS}]+'), lambda r: regexp_extract(r, '^.*{COMPANY}'))"
    last = f"(list_filter({runs}, lambda r: length(r) >= {len(COMPANY) + 2}))[-1]"
    return f"right({last}, {NAME_LETTERS + len(COMPANY)})"


# ---------------------------------------------------------------- sellers and small tests

# Words that show a buyer, words that end a name behind its label, signs that labels leave at its end.
BUYERS = ("购买方", "国防", "大学", "学院", "医院")
NAME_ENDS = r"名\s*称|统一|纳税人|电话|开户|地址|销|买|售|备"
LABEL_SIGNS = "销买售购方"
SELLER_LABELS = ("销售方：", "销售方:", "收款单位：", "收款单位:", "开票方：", "开票方:")
MOST_SEQ = 200


def is_buyer(name: Column) -> Column:
    hit = name.contains(BUYERS[0])
    for w in BUYERS[1:]:
        hit = hit | name.contains(w)
    return hit


def clean_seller(name: Column) -> Column:
    """A seller's name without the label's words and the signs that a label leaves at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "销售方|销售", ""), f"[{LABEL_SIGNS}\\s]+$", ""))


def document_seller(text: Column) -> Column:
    """The seller of a document: the last name behind a label of names that is no buyer's, else the last of all,
    else the word behind a label of sellers; '' if there is none."""
    behind = F.slice(F.split(text, r"名\s*称\s*[：:]"), 2, 2**30)
    names = F.transform(behind, lambda p: F.trim(F.regexp_replace(F.trim(F.get(F.split(p, f"(?:\\s*(?:{NAME_ENDS}))|\\n", 2), 0)), "[买售 ]+$", "")))
    names = F.filter(names, lambda n: F.char_length(n) >= 1)
    sellers = F.filter(names, lambda n: ~is_buyer(n))
    labelled = found(text, Rule(SELLER_LABELS, "after", r"\s*", r"\S+"))
    return F.coalesce(F.try_element_at(sellers, F.lit(-1)), F.try_element_at(names, F.lit(-1)), F.get(labelled, 0), F.lit(""))


def company_before(text: Column, label: str) -> Column:
    """The last company name before a label; NULL if there is none."""
    return company_name(F.get(F.split(text, label, 2), 0))


def enough_text(texts: Column, least: int) -> Column:
    """Whether texts have that many bytes together."""
    return F.aggregate(texts, F.lit(0), lambda n, t: n + F.coalesce(F.octet_length(t), F.lit(0))) >= least


def seq_number(text: Column) -> Column:
    """The sequence number that a cell begins with, up to 200; NULL for dates, times and other texts."""
    t = F.trim(text)
    n = F.regexp_extract(t, r"^(\d{1,9})", 1).try_cast("int")
    return F.when(~t.rlike("[-:：]") & (n <= MOST_SEQ), n)


def clean_time(text: Column) -> Column:
    """A time cell without sequence numbers between its words; a number after a colon is its minutes."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    kept = F.filter(F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit("")), words).alias("before")), lambda x: x["w"].isNotNull() & (~x["w"].rlike(r"^\d{1,3}$") | (x["w"].try_cast("int") > MOST_SEQ) | x["before"].rlike("[:：]$")))
    out = F.array_join(F.transform(kept, lambda x: x["w"]), " ")
    return F.when(out == "", text).otherwise(out)


def garbled_time(text: Column) -> Column:
    """Whether a ride's time can't be read: empty, with question marks, cut behind a colon or without one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.contains("??") | t.rlike("[:：]$") | ~t.rlike("[:：]")
