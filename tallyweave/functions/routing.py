"""What a document is, and the category of an invoice by its regions or its whole text: cascades of word rules.

A rule names a result and what must hold together: (field, words of which one must occur), a field with ``~`` before it being one
in which none may occur. The first rule that holds decides. The same tables give the SQL the queries are compared with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, tuple[tuple[str, tuple[str, ...]], ...]]

# Kinds of documents with the words that tell them, in the order in which they count.
HAILING = ("滴滴", "高德", "T3", "曹操")
DOCUMENT_KINDS: tuple[Rule, ...] = (
    ("RideHailingItinerary", (("text", ("行程报销单",)),)),
    ("RideHailingItinerary", (("text", ("行程单",)), ("text", HAILING))),
    ("TransitCardStatement", (("text", ("天府通",)),)),
    ("TransitCardStatement", (("text", ("电子行程单",)), ("text", ("公交", "地铁")))),
    ("FlightInvoice", (("~text", ("保险", "意外险")), ("text", ("机票", "航班", "航空")))),
    ("FlightInvoice", (("~text", ("保险", "意外险")), ("text", ("行程单",)), ("text", ("飞猪", "携程", "去哪儿")))),
    ("TollInvoice", (("text", ("通行费", "过路费")),)),
    ("TollInvoice", (("text", ("ETC", "电子发票")), ("text", ("高速",)))),
    ("VatElectronicInvoice", (("text", ("增值税",)), ("text", ("电子发票",)))),
    ("VatElectronicInvoice", (("text", ("电子发票",)), ("text", ("普通发票",)), ("~text", HAILING))),
    ("VatElectronicInvoice", (("text", ("电子发票",)), ("text", ("普通发票",)), ("text", ("行程单",)))),
    ("HotelStatement", (("text", ("结账单", "账单")), ("text", ("酒店",)))),
    ("TrainInvoice", (("text", ("火车票", "铁路客票", "铁路电子客票", "高铁")),)),
    ("TrainInvoice", (("train_no", ("1",)), ("text", ("站", "铁路")))),
    ("RideHailingInvoice", (("text", HAILING), ("~text", ("行程单",)))),
)
LODGING_CODES, TRANSPORT_CODES, FLIGHT_CODES = ("*住宿服务*", "*生产生活服务*住宿费"), ("*运输服务*", "*客运服务*"), ("*航空运输服务*", "*旅客运输服务*")
RAIL, AIR = ("火车", "高铁", "铁路"), ("航空", "机票")
# Categories by the regions of an invoice.
REGION_RULES: tuple[Rule, ...] = (
    ("Hotel", (("items", LODGING_CODES),)),
    ("Train", (("items", TRANSPORT_CODES), ("items", RAIL))),
    ("Flight", (("items", TRANSPORT_CODES), ("items", AIR))),
    ("CityTransport", (("items", TRANSPORT_CODES),)),
    ("Flight", (("items", FLIGHT_CODES),)),
    ("Meal", (("items", ("*餐饮服务*",)),)),
    ("Hotel", (("item", ("住宿", "酒店", "宾馆", "民宿")),)),
    ("Insurance", (("item", ("保险", "意外险")),)),
    ("Flight", (("item", ("机票", "航空", "航班")),)),
    ("Train", (("item", RAIL),)),
    ("Meal", (("item", ("餐饮", "饭店", "餐厅")),)),
    ("Insurance", (("items", ("保险服务", "意外险", "保险费")),)),
    ("Flight", (("items", ("机票", "航空", "航班", "旅客运输")),)),
    ("TicketChange", (("items", ("退票", "改签", "手续费")),)),
    ("Train", (("items", RAIL),)),
    ("Hotel", (("items", ("住宿", "酒店", "宾馆")),)),
    ("CityTransport", (("seller", ("滴滴", "高德", "网约车", "t3", "曹操")),)),
    ("Hotel", (("seller", ("酒店", "宾馆", "住宿")),)),
    ("Flight", (("seller", AIR),)),
    ("Train", (("seller", RAIL),)),
    ("Flight", (("seller_region", AIR),)),
    ("Train", (("seller_region", RAIL),)),
)
# Categories by the whole text and the kind of the document.
TEXT_RULES: tuple[Rule, ...] = (
    ("Hotel", (("text", LODGING_CODES),)),
    ("Train", (("text", TRANSPORT_CODES), ("text", RAIL))),
    ("Flight", (("text", TRANSPORT_CODES), ("text", AIR))),
    ("CityTransport", (("text", TRANSPORT_CODES),)),
    ("Flight", (("text", FLIGHT_CODES),)),
    ("Insurance", (("text", ("保险服务", "意外险", "保险费")),)),
    ("Flight", (("kind", ("FlightInvoice",)),)),
    ("Train", (("kind", ("TrainInvoice",)),)),
    ("Hotel", (("kind", ("HotelStatement",)),)),
    ("CityTransport", (("kind", ("RideHailingInvoice", "RideHailingItinerary")),)),
    ("Toll", (("kind", ("TollInvoice",)),)),
    ("Toll", (("text", ("通行费", "过路费", "etc")),)),
    ("Hotel", (("text", ("酒店", "宾馆", "住宿", "招待所", "民宿")),)),
    ("CityTransport", (("text", ("滴滴", "网约车", "高德", "t3", "曹操", "出租", "地铁", "轨道")),)),
    ("Insurance", (("text", ("保险",)),)),
    ("TicketChange", (("text", ("退票", "改签")),)),
    ("Flight", (("text", ("航空", "机票", "航班")),)),
    ("Train", (("text", ("铁路", "高铁", "火车", "客运站")),)),
    ("Meal", (("text", ("餐饮", "饭店", "食品", "餐厅", "饭馆")),)),
)
TRAIN_NO = "[GD][0-9]+"
OTHER = "Other"


def first_rule(rules: tuple[Rule, ...], fields: dict[str, Column]) -> Column:
    """The result of the first rule that holds for the fields."""
    clean = {k: F.coalesce(v, F.lit("")) for k, v in fields.items()}

    def holds(condition: tuple[str, tuple[str, ...]]) -> Column:
        field, words = condition
        hit = reduce(lambda a, b: a | b, [clean[field.lstrip("~")].contains(w) for w in words])
        return ~hit if field.startswith("~") else hit

    return F.coalesce(*[F.when(reduce(lambda a, b: a & b, map(holds, conditions)), F.lit(result)) for result, conditions in rules], F.lit(OTHER))


def first_rule_sql(rules: tuple[Rule, ...], fields: dict[str, str]) -> str:
    def holds(field: str, words: tuple[str, ...]) -> str:
        hit = "(" + " or ".join(f"contains({fields[field.lstrip('~')]}, '{w}')" for w in words) + ")"
        return f"not {hit}" if field.startswith("~") else hit

    return "case " + " ".join(f"when {' and '.join(holds(*c) for c in conditions)} then '{result}'" for result, conditions in rules) + f" else '{OTHER}' end"


def one_radical(text: Column) -> Column:
    """A radical that some fonts give in place of the character."""
    return F.translate(text, "⼦", "子")


def document_kind(text: Column) -> Column:
    """The kind of a document by its text."""
    clean = one_radical(F.coalesce(text, F.lit("")))
    return first_rule(DOCUMENT_KINDS, {"text": clean, "train_no": F.when(clean.rlike(TRAIN_NO), F.lit("1"))})


def category_by_regions(items: Column, item: Column, seller: Column, seller_region: Column) -> Column:
    """The category of an invoice by the text of its items, its item and its seller."""
    return first_rule(REGION_RULES, {"items": F.lower(items), "item": F.lower(item), "seller": F.lower(seller), "seller_region": F.lower(seller_region)})


def category_by_text(text: Column, kind: Column) -> Column:
    """The category of a document by its whole text and its kind."""
    return first_rule(TEXT_RULES, {"text": F.lower(text), "kind": kind})


# Texts of strategies.
STRATEGIES = {
    "OneToMany": "a claim with rides is paid by several payments", "AmountWithMerchant": "amount within the payments of the same merchant", "AmountWithTime": "amount and exact time",
    "StrictAmountOnly": "amount alone, few payments", "FuzzyMatching": "all scores, many payments", "MultiDimensional": "amount, merchant, time and category",
}
FEW, MANY = 20, 200


def strategy(category: Column, rides: Column, seller: Column, payments: Column | None = None, has_merchants: Column | None = None, exact_times: Column | None = None) -> Column:
    """How a claim is matched: by its rides, its seller, exact times of the payments, or by their number."""
    named = F.coalesce(seller, F.lit("")) != ""
    out = F.when((category == "CityTransport") & (rides > 0), F.lit("OneToMany")).when(named if has_merchants is None else named & has_merchants, F.lit("AmountWithMerchant"))
    if exact_times is not None:
        out = out.when(exact_times, F.lit("AmountWithTime"))
    if payments is not None:
        out = out.when(payments < FEW, F.lit("StrictAmountOnly")).when(payments > MANY, F.lit("FuzzyMatching"))
    return out.otherwise(F.lit("MultiDimensional"))


CARRIERS = ("天府通", "轨道交通", "公交", "地铁")
# Categories by an item's code (item), its detail, the seller, the whole text and the remarks.
CELL_RULES: tuple[Rule, ...] = (
    ("Insurance", (("item", ("保险",)),)),
    ("TicketChange", (("detail", ("退票", "改签")),)),
    ("Insurance", (("detail", ("保险", "意外险", "意外", "航意", "航延")),)),
    ("Hotel", (("detail", ("住宿", "酒店", "宾馆")),)),
    ("Flight", (("detail", ("机票", "航空", "客票")),)),
    ("Train", (("detail", ("火车", "车票", "铁路")),)),
    ("Meal", (("detail", ("餐饮", "餐费", "餐饮费")),)),
    ("Toll", (("detail", ("通行费", "高速")),)),
    ("CityTransport", (("detail", ("客运", "运输")),)),
    ("CityTransport", (("detail", ("预付卡",)), ("seller", CARRIERS))),
    ("Other", (("detail", ("预付卡",)),)),
    ("TicketChange", (("context", ("退票", "改签")),)),
    ("Hotel", (("item", ("住宿",)),)),
    ("Train", (("item", ("运输服务", "客运服务")), ("text", ("火车", "车次", "铁路")))),
    ("Flight", (("item", ("运输服务", "客运服务")), ("text", ("航班", "机票")))),
    ("CityTransport", (("item", ("运输服务", "客运服务")),)),
    ("Flight", (("item", ("经纪代理", "航空运输", "旅客运输")),)),
    ("Meal", (("item", ("餐饮",)),)),
    ("Hotel", (("item", ("生产生活服务",)), ("seller", ("酒店", "宾馆")))),
    ("Hotel", (("item", ("生产生活服务",)), ("context", ("住宿费", "住宿服务")))),
    ("Toll", (("item", ("生产生活服务",)), ("context", ("高速", "通行费", "收费车道")))),
    ("Flight", (("item", ("生产生活服务",)), ("remarks", ("经济舱", "头等舱", "商务舱")))),
    ("Flight", (("item", ("生产生活服务",)), ("text", ("航班", "机票")))),
    ("Flight", (("item", ("生产生活服务",)), ("seller", ("航空服务",)))),
    ("CityTransport", (("seller", ("滴滴", "出行科技", "优行", *CARRIERS)),)),
    ("Hotel", (("seller", ("酒店", "宾馆", "民宿")),)),
    ("Toll", (("seller", ("高速", "公路")),)),
)
# The route of a file by the words of its text.
FILE_KINDS: tuple[Rule, ...] = (("Itinerary", (("text", ("行程单", "行程报销单", "电子行程单")),)), ("Bill", (("text", ("结账单",)),)), ("Invoice", (("text", ("发票", "增值税")),)))


def category_by_cells(item: Column, detail: Column, seller: Column, text: Column, remarks: Column) -> Column:
    """The category of an invoice by what its cells hold, its seller and its text."""
    context = F.concat_ws(" ", remarks, seller, text)
    return first_rule(CELL_RULES, {"item": item, "detail": detail, "seller": seller, "text": text, "remarks": remarks, "context": context})


def file_kind(text: Column) -> Column:
    """Itinerary, Bill, Invoice or Other: which way a file goes."""
    return first_rule(FILE_KINDS, {"text": text})


def block_kind(text: Column) -> Column:
    """Title, KeyValue or Other: what a block of recognised text is."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike("^[^：:]{1,12}[：:]"), "KeyValue").when((F.char_length(t) <= 20) & t.rlike("发票|行程单|账单|报销单"), "Title").otherwise("Other")
