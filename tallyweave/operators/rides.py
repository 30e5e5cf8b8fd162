"""Rides from tables and from words on pages, and their repair.

``cells``: doc_id, page, table_no, row_no, col_no, text; ``words``: doc_id, page, seq, text, x0, top, x1, bottom. Everything is
joins, aggregates and windows keyed by document and page. Rides are doc_id, page, pos (order within the page),
date_time, provider, city, pickup, dropoff, amount.

Defined results: NULL texts count as empty; a table or page without a header gives no rides; rides without a positive
amount are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions.dates import extract_datetime
from tallyweave.functions.text import contains_any

# Words of the heads of columns, the longest first.
HEADS = {
    "seq": ["序号", "序"], "time": ["出行时间", "上车时间", "时间", "时"], "pickup": ["起点", "进站", "进出站", "起"], "dropoff": ["终点", "出站", "终"],
    "amount": ["金额", "元"], "provider": ["服务商", "行程类型", "车型", "型"], "city": ["城市", "城"],
}
FIELDS = [f for f in HEADS if f != "seq"]
HAS_TIME = r"\d{2}-\d{2}\s+\d{1,2}[:：]|\d{4}-\d{2}-\d{2}\s+\d{1,2}[:：]"
HEAD_REACH = 20  # how far from its first word the words of a header line may stand
MOST_SEQ = 200
WHOLE_CENTS = 1000  # an amount from here on without a point is in cents


def last_amount(text: Column) -> Column:
    """The last number of a text."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), F.lit(-1)).try_cast("double")


def station(text: Column, label: str, first: bool) -> Column:
    """A place beside its label, else the first or last part of a route written with a tilde, else the text."""
    line = F.trim(F.regexp_replace(text, "\n", ""))
    named = F.regexp_extract(line, label + r"[：:]\s*([^\s~]+)", 1)
    ends = F.split(line, "~")
    part = F.trim(F.regexp_replace(F.trim(F.get(ends, 0) if first else F.try_element_at(ends, F.lit(-1))), f"^{label}[：:]", ""))
    return F.when(named != "", named).when(line.contains("~") & (part != ""), part).otherwise(line)


def _head_of(text: Column) -> Column:
    """The fields that a head may stand for."""
    return F.filter(F.array(*[F.when(contains_any(text, words), F.lit(f)) for f, words in HEADS.items()]), lambda x: x.isNotNull())


def rides_in_cells(cells: DataFrame) -> DataFrame:
    """Rides of tables whose head names a sequence number and an amount.

    A row of at most two filled cells continues the ride above it and may add its places. A document in which such a row holds
    a whole ride was flattened by the extraction and gives none.
    """
    table_, row = ["doc_id", "page", "table_no"], ["doc_id", "page", "table_no", "row_no"]
    cells = cells.withColumn("text", F.coalesce("text", F.lit("")))
    rows = cells.groupBy(*row).agg(F.max(F.col("text").contains("序")).alias("s"), F.max(contains_any(F.col("text"), ["额", "元"])).alias("a"), F.count(F.when(F.col("text") != "", 1)).alias("filled"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]), " ").alias("whole"))
    head = rows.filter("s and a").groupBy(*table_).agg(F.min("row_no").alias("head"))
    named = cells.join(head.withColumnRenamed("head", "row_no"), row).select(*table_, "col_no", F.explode(_head_of(F.col("text"))).alias("field"))
    columns = named.groupBy(*table_, "field").agg(F.min("col_no").alias("col_no"))
    # one column may stand for several fields, as for both ends of a route
    value = cells.join(columns, [*table_, "col_no"]).groupBy(*row).pivot("field", list(HEADS)).agg(F.first("text"))
    body = rows.join(head, table_).filter("row_no > head").join(value, row, "left")
    flat = body.filter((F.col("filled") <= 2) & F.col("whole").rlike(HAS_TIME) & F.col("whole").rlike(r"\d")).select("doc_id").distinct()
    body = body.join(flat, "doc_id", "left_anti").withColumn("sum", F.coalesce(last_amount(F.col("amount")), F.lit(0.0)))
    order = W.partitionBy(*table_).orderBy("row_no")
    body = body.withColumn("begins", ((F.col("filled") > 2) & (F.col("sum") > 0)).cast("int")).withColumn("ride", F.sum("begins").over(order))
    body = body.filter("ride > 0 and (begins = 1 or filled <= 2)")
    more = lambda label: F.min(F.when((F.col("begins") == 0) & F.col("whole").rlike(label + "[：:]"), F.struct("row_no", F.regexp_extract("whole", label + r"[：:]\s*([^\s~]+)", 1).alias("x"))))["x"]
    own = lambda c: F.max(F.when(F.col("begins") == 1, c))
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    got = body.groupBy(*table_, "ride").agg(
        F.coalesce(own(extract_datetime(F.col("time"))), F.lit("")).alias("date_time"), own(text("provider")).alias("provider"), own(text("city")).alias("city"), own(F.coalesce(station(F.col("pickup"), "进站", True), F.lit(""))).alias("pickup"),
        own(F.coalesce(station(F.col("dropoff"), "出站", False), F.lit(""))).alias("dropoff"), own(F.col("sum")).alias("amount"), more("进站").alias("more_pickup"), more("出站").alias("more_dropoff"),
    )
    filled = lambda c: F.when(F.col(c) == "", F.coalesce(f"more_{c}", F.lit(""))).otherwise(F.col(c)).alias(c)
    pos = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("table_no", "ride")).alias("pos")
    return got.select("doc_id", "page", pos, "date_time", "provider", "city", filled("pickup"), filled("dropoff"), "amount")


def rides_in_words(words: DataFrame) -> DataFrame:
    """Rides of pages whose words stand in columns below a header line.

    The header is the first line around a word with 序 that names a number and a time, an amount or a starting place. Columns
    end halfway between heads. A sequence number in its column anchors a ride, and words belong to the anchor whose
    height is nearest. Rides with equal times and amounts are one.
    """
    page = ["doc_id", "page"]
    w = words.filter("text is not null and x0 is not null and top is not null").withColumn("x", (F.col("x0") + F.col("x1")) / 2)
    around = w.filter(F.col("text").contains("序")).select(*page, F.col("top").alias("line")).distinct()
    line = w.join(around, page).filter(F.abs(F.col("top") - F.col("line")) <= HEAD_REACH)
    joined = line.groupBy(*page, "line").agg(F.concat_ws("", F.collect_list("text")).alias("t")).filter(F.col("t").contains("号") & contains_any(F.col("t"), ["时间", "金额", "起点"]))
    head = joined.groupBy(*page).agg(F.min("line").alias("line"))
    longest = F.greatest(*[F.when(F.col("text").contains(x), F.lit(len(x))).otherwise(F.lit(0)) for words_ in HEADS.values() for x in words_])
    heads = w.join(head, page).filter(F.abs(F.col("top") - F.col("line")) <= HEAD_REACH).select(*page, "line", "x", "seq", longest.alias("n"), F.explode(_head_of(F.col("text"))).alias("field"))
    heads = heads.groupBy(*page, "line", "field").agg(F.min_by("x", F.struct((-F.col("n")).alias("n"), "seq")).alias("x"))
    beside = W.partitionBy(*page).orderBy("x", "field")
    spans = heads.select(*page, "line", "field", ((F.lag("x").over(beside) + F.col("x")) / 2).alias("from"), ((F.lead("x").over(beside) + F.col("x")) / 2).alias("to"))
    below = w.join(spans, page).filter((F.col("top") > F.col("line") + HEAD_REACH) & (F.coalesce(F.col("x") >= F.col("from"), F.lit(True))) & (F.coalesce(F.col("x") < F.col("to"), F.lit(True))))
    number = F.when(F.col("text").rlike(r"^\d{1,3}$"), F.col("text").cast("int"))
    marks = below.withColumn("y", F.when((F.col("field") == "seq") & (number <= MOST_SEQ), F.col("top")))
    order = W.partitionBy(*page).orderBy("top", F.asc_nulls_last("y"), "seq")
    up, down = F.last("y", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.first("y", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    nearest = F.when(F.col("up").isNull() | (F.col("down") - F.col("top") < F.col("top") - F.col("up")), F.col("down")).otherwise(F.col("up"))
    placed = marks.withColumns({"up": up, "down": down}).withColumn("anchor", nearest).filter("anchor is not null and field <> 'seq'")
    text = placed.groupBy(*page, "anchor", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x", "seq", "text"))), lambda t: t["text"]), " ").alias("text"))
    got = text.groupBy(*page, "anchor").pivot("field", FIELDS).agg(F.first("text"))
    amount = last_amount(F.col("amount"))
    amount = F.when((amount >= WHOLE_CENTS) & ~F.col("amount").contains("."), amount / 100).otherwise(amount)
    squeezed = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), " ", "").alias(c)
    rides = got.select(*page, "anchor", F.coalesce(extract_datetime(F.col("time")), F.lit("")).alias("date_time"), squeezed("provider"), squeezed("city"), squeezed("pickup"), squeezed("dropoff"), amount.alias("amount")).filter("amount > 0")
    rides = rides.withColumn("pos", F.row_number().over(W.partitionBy(*page).orderBy("anchor")))
    return distinct_rides(rides, page).select("doc_id", "page", "pos", "date_time", "provider", "city", "pickup", "dropoff", "amount")


# ---------------------------------------------------------------- repair


def distinct_rides(rides: DataFrame, keys: list[str]) -> DataFrame:
    """The first ride of each time and amount in cents."""
    same = W.partitionBy(*keys, "date_time", F.round(F.col("amount") * 100)).orderBy("pos")
    return rides.withColumn("__n", F.row_number().over(same)).filter("__n = 1").drop("__n")


def missing_fields(date_time: Column, amount: Column) -> Column:
    """Names of the fields that a ride lacks: an amount that isn't positive, a time that is empty, unreadable or cut."""
    t = F.trim(F.coalesce(date_time, F.lit("")))
    no_time = ~t.rlike("[:：]") | t.contains("??") | t.rlike("[:：]$")
    return F.array_compact(F.array(F.when(~F.coalesce(amount > 0, F.lit(False)), F.lit("amount")), F.when(no_time, F.lit("date_time"))))


def any_incomplete(rides: Column) -> Column:
    """Whether a ride of an array (with date_time and amount) lacks something."""
    return F.exists(rides, lambda r: F.size(missing_fields(r["date_time"], r["amount"])) > 0)


def printed_total(text: Column) -> Column:
    """The total that a document prints: 合计 with an amount before 元 or after its label; NULL if none."""
    money = r"([\d,]+\.\d{1,2})"
    found = F.coalesce(F.nullif(F.regexp_extract(text, r"合计\s*" + money + r"\s*元", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"合计(?:金额)?[：:]\s*[¥￥]?\s*" + money, 1), F.lit("")))
    return F.regexp_replace(found, ",", "").try_cast("double")


def cross_checked(rides: DataFrame, reference: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rides repaired by lists of the same document read another way.

    ``reference``: key, amounts, providers, times (arrays in order). Where a list has as many values as the document has rides, wrong
    amounts, cut or empty providers and unreadable times take the value at their place; else a cut provider or
    time takes the first value that begins with it.
    """
    n, at = F.count("*").over(W.partitionBy(key)), F.row_number().over(W.partitionBy(key).orderBy("pos"))
    both = rides.withColumns({"__n": n, "__at": at}).join(reference, key, "left")
    fits = lambda c: F.coalesce(F.size(c) == F.col("__n"), F.lit(False))
    nth = lambda c: F.get(F.col(c), F.col("__at") - 1)
    amount = F.when(fits("amounts") & (nth("amounts") > 0) & (F.abs(F.col("amount") - nth("amounts")) > 0.005), nth("amounts")).otherwise(F.col("amount"))
    p = F.col("provider")
    poor = (p == "") | p.rlike(r"^\d+$") | (F.char_length(p) <= 1) | nth("providers").startswith(p)
    longer = F.get(F.filter("providers", lambda x: x.startswith(p) & (F.char_length(x) > F.char_length(p))), 0)
    provider = F.when(fits("providers"), F.when(poor & (nth("providers") != ""), nth("providers")).otherwise(p)).when(F.char_length(p) > 1, F.coalesce(longer, p)).otherwise(p)
    t = F.col("date_time")
    bad = F.array_contains(missing_fields(t, F.lit(1.0)), "date_time")
    day = F.regexp_extract(t, r"^(\d{2}-\d{2})", 1)
    same_day = F.get(F.filter("times", lambda x: (day != "") & x.startswith(day)), 0)
    time = F.when(bad, F.coalesce(F.when(fits("times"), nth("times")).otherwise(same_day), t)).otherwise(t)
    return both.withColumns({"amount": amount, "provider": provider, "date_time": time}).select(*rides.columns)


def reference_lists(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, amounts, providers, times) that a document's text names, in order."""
    amounts = F.transform(F.regexp_extract_all("text", F.lit(r"(\d+\.\d{2})\s*元"), 1), lambda x: x.try_cast("double"))
    times = F.regexp_extract_all("text", F.lit(r"(\d{2}-\d{2} \d{2}:\d{2})"), 1)
    providers = F.regexp_extract_all("text", F.lit(r"(?:^|\n)\s*\d{1,3}\s+(\S+)\s+\d{2}-\d{2}"), 1)
    return docs.select(key, amounts.alias("amounts"), providers.alias("providers"), times.alias("times"))


def paired_documents(rides: DataFrame, invoices: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """(keys, doc_id, inv_id): ride documents and the invoices they belong to, by equal totals, each once.

    ``rides``: keys, doc_id, doc_pos, total; ``invoices``: keys, inv_id, inv_pos, inv_amount. Documents in their order take the first
    free invoice of their total.
    """
    from tallyweave.operators.matching import band_join, one_per_payment

    pairs = band_join(rides, invoices, "total", "inv_amount", tolerance, keys)
    pairs = pairs.select(*keys, F.col("doc_id").alias("inv_id"), F.col("inv_id").alias("pay_id"), "doc_pos", "inv_pos")
    got = one_per_payment(pairs, [F.asc("inv_pos"), F.asc("pay_id")], [F.col("doc_pos"), F.col("inv_id")], keys)
    return got.select(*keys, F.col("inv_id").alias("doc_id"), F.col("pay_id").alias("inv_id"))


def in_cities(names: list[Column], rides: Column, cities: Column) -> Column:
    """Whether one of a trip's cities occurs in the names or in the places of the rides; true where either is unknown."""
    places = F.flatten(F.transform(rides, lambda r: F.array(r["pickup"], r["dropoff"], r["city"])))
    all_ = F.array_compact(F.concat(F.array(*names), F.coalesce(places, F.array().cast("array<string>"))))
    hit = F.exists(cities, lambda c: F.exists(all_, lambda x: x.contains(c)))
    return F.coalesce(F.size(cities) == 0, F.lit(True)) | F.coalesce(F.size(rides) <= 0, F.lit(True)) | F.coalesce(hit, F.lit(False))

