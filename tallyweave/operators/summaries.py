"""Totals, checks and labels of matched claims.

``matched``: inv_id, category, inv_amount, rides (number of rides), pairs (array of ride numbers that have a payment), payments (array of
structs with amount, refund, discount, source, transaction_id). Arrays are summed within their row, so no join multiplies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories in the order of a summary, their labels, prefixes of payment numbers, bands of differences.
ORDER = ("Train", "Flight", "Insurance", "TicketChange", "CityTransport", "Toll", "Hotel", "Meal", "Other")
LABELS = {
    "Train": "车、船票", "Flight": "飞机票", "Insurance": "保险费 (含交通险)", "TicketChange": "订（退、改签）票", "CityTransport": "市内交通费", "Toll": "市内交通费",
    "Hotel": "住宿费", "Meal": "餐补/伙食补助", "Other": "其他",
}
PREFIXES = {"Wechat": "微信单号：", "Alipay": "支付宝单号："}
BANDS = ((0.01, "equal"), (1.0, "near"), (10.0, "off"))


def label(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[category], F.lit(LABELS["Other"]))


def band(diff: Column) -> Column:
    """How far an amount is off: equal, near, off or far."""
    out = None
    for most, name in BANDS:
        out = F.when(F.abs(diff) < most, name) if out is None else out.when(F.abs(diff) < most, name)
    return out.otherwise("far")


def ordered_summary(rows: DataFrame, category: str, amount: str) -> DataFrame:
    """(category, place, n, cents) of the categories that occur, in the fixed order."""
    place = F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col(category)).cast("int")
    got = rows.withColumn(category, F.when(F.col(category).isin(*ORDER), F.col(category)).otherwise("Other")).groupBy(category).agg(F.count("*").alias("n"), F.sum(F.round(F.col(amount) * 100).cast("bigint")).alias("cents"))
    return got.select(category, place.alias("place"), "n", "cents")


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first by name."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), value)).alias(value), F.max("n").alias("n"))


def paid(payments: Column, field: str) -> Column:
    return F.aggregate(payments, F.lit(0.0), lambda s, p: s + F.coalesce(p[field], F.lit(0.0)))


def footer(matched: DataFrame) -> DataFrame:
    """One row: totals of claims, payments, refunds and discounts in cents, and rides."""
    cents = lambda c: F.coalesce(F.sum(F.round(c * 100).cast("bigint")), F.lit(0))
    return matched.agg(cents(F.col("inv_amount")).alias("claims"), cents(paid(F.col("payments"), "amount")).alias("paid"), cents(paid(F.col("payments"), "refund")).alias("refunds"), cents(paid(F.col("payments"), "discount")).alias("discounts"), F.coalesce(F.sum("rides"), F.lit(0)).alias("rides"))


def unpaired_rides(rides: Column, pairs: Column) -> Column:
    """Rides of a match without a payment; 0 where no ride was paired by itself."""
    numbers = F.when(rides > 0, F.sequence(F.lit(0), rides.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, F.lit(0)).otherwise(F.size(F.array_except(numbers, pairs)))


def gaps(matched: DataFrame, unmatched: DataFrame) -> DataFrame:
    """One row: claims without a payment, rides without one, and whether there is any such gap."""
    rides = matched.agg(F.coalesce(F.sum(unpaired_rides(F.col("rides"), F.col("pairs"))), F.lit(0)).alias("open_rides"))
    return unmatched.agg(F.count("*").alias("open_claims")).crossJoin(rides).withColumn("any_gap", (F.col("open_claims") > 0) | (F.col("open_rides") > 0))  # one row each


def stay_check(trips: DataFrame, hotels: DataFrame, key: str) -> DataFrame:
    """(key, trip_days, expected_nights, nights, unknown, status) of trips whose nights don't agree with their days.

    ``trips``: key, start, end; ``hotels``: key, nights. incomplete where a stay has no nights, mismatch where their sum is not days - 1.
    """
    days = F.greatest(F.datediff("end", "start") + 1, F.lit(1))
    known = hotels.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("nights") > 0, F.col("nights"))), F.lit(0)).alias("nights"), F.count(F.when(F.coalesce("nights", F.lit(0)) <= 0, 1)).alias("unknown"))
    both = trips.filter("start is not null and end is not null").join(known, key).select(key, days.alias("trip_days"), (days - 1).alias("expected_nights"), "nights", "unknown")
    status = F.when(F.col("unknown") > 0, "incomplete").when(F.col("nights") != F.col("expected_nights"), "mismatch")
    return both.withColumn("status", status).filter("status is not null")


def trip_form(trips: DataFrame, key: str) -> DataFrame:
    """(key, start, end, destinations): the span of all trips of a batch, and their destinations in the order of their start."""
    stops = F.array_sort(F.collect_list(F.when(F.col("destination") != "", F.struct("start", "destination"))))
    return trips.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_distinct(F.transform(stops, lambda s: s["destination"])), "、").alias("destinations"))


def payment_numbers(payments: Column) -> Column:
    """The numbers of payments with the prefix of their source, joined."""
    prefix = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    return F.array_join(F.transform(payments, lambda p: F.concat(F.coalesce(prefix[p["source"]], F.lit("")), F.coalesce(p["transaction_id"], F.lit("")))), "，")


def by_hand(inv_amount: Column, payments: Column) -> Column:
    """struct(amount_diff, confidence) of a match made by hand: sure where the amounts agree."""
    diff = F.abs(inv_amount - paid(payments, "amount"))
    return F.struct(diff.alias("amount_diff"), F.when(diff == 0, F.lit(1.0)).otherwise(F.lit(0.8)).alias("confidence"))


def hours_apart(days: Column) -> Column:
    """Days as hours; 999 where a time can't be read."""
    return F.coalesce(days * 24, F.lit(999))


def close_by(diff: Column, target: Column, days: Column) -> Column:
    """Whether a payment is near enough to be offered: a tenth of the amount or 10, and within a week."""
    return (F.abs(diff) <= F.greatest(F.abs(target) * 0.1, F.lit(10.0))) & (F.abs(days) <= 7)
