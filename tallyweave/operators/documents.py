"""Whole batches of documents: which way each goes, what it gives, and what it gives to others.

``texts``: doc_id, doc_pos, text; ``cells`` and ``words`` as in invoice_cells, rides and layout. A document gives an invoice, a list of
rides, or an error with its reason; no document ends the batch. Ride lists then go to the invoices of their total, and
invoices to the trips of their days and cities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions import routing, text
from tallyweave.operators import invoice_cells, matching, records, rides
from tallyweave.operators.layout import rides_in_text

GARBLED = 0.3  # share of unreadable characters from which a text is given up
EXACT, ROUGH = 0.01, 2.0  # how near an invoice is to a printed total, and to a sum of rides
RIDE = ["doc_id", "pos", "date_time", "provider", "city", "pickup", "dropoff", "amount"]


def routed(texts: DataFrame) -> DataFrame:
    """Adds ``way``: invoice, itinerary, or error with its reason."""
    kind = routing.file_kind(F.col("text"))
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(text.garbled_share(F.col("text")) >= GARBLED, "unreadable").when(kind == "Bill", "bill")
    return texts.withColumns({"error": reason, "way": F.when(reason.isNotNull(), "error").when(kind == "Itinerary", "itinerary").otherwise("invoice")})


def best_rides(sources: list[DataFrame]) -> DataFrame:
    """(doc_id, pos, ..., source) of the first source whose rides are complete, else of the first that has any.

    ``sources``: rides of the same documents read in several ways, in the order in which they are trusted.
    """
    every = None
    for rank, s in enumerate(sources):
        some = s.select(*[F.col(c) if c in s.columns else F.lit("").alias(c) for c in RIDE]).withColumn("source", F.lit(rank))
        every = some if every is None else every.unionByName(some)
    lacks = (F.size(rides.missing_fields(F.col("date_time"), F.col("amount"))) > 0).cast("int")
    of = every.groupBy("doc_id", "source").agg(F.max(lacks).alias("lacks"))
    best = of.groupBy("doc_id").agg(F.min_by("source", F.struct("lacks", "source")).alias("source"))
    return every.join(best, ["doc_id", "source"])


def parsed(texts: DataFrame, cells: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoices, rides with the document's printed total, errors: doc_id and error) of a batch of documents."""
    way = routed(texts)
    inv = invoice_cells.invoices_of(cells, way.filter("way = 'invoice'").select("doc_id", "doc_pos", "text"))
    lists = way.filter("way = 'itinerary'").select("doc_id", "text")
    own = lambda d: d.join(lists.select("doc_id"), "doc_id", "left_semi")
    in_text = rides_in_text(lists).select("doc_id", F.col("ride_no").alias("pos"), F.col("time").alias("date_time"), "amount")
    of = best_rides([own(rides.rides_in_cells(cells)), own(rides.rides_in_words(words)), in_text]).join(lists.select("doc_id", rides.printed_total(F.col("text")).alias("printed")), "doc_id")
    told = inv.select("doc_id").unionByName(of.select("doc_id").distinct())
    errors = way.filter("way = 'error'").select("doc_id", "error").unionByName(way.filter("way <> 'error'").join(told, "doc_id", "left_anti").select("doc_id", F.concat(F.lit("no "), F.when(F.col("way") == "invoice", "amount").otherwise("ride")).alias("error")))
    return inv, of, errors


def with_ride_lists(invoices: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, inv_id, of the pairs; doc_id, inv_amount, category of invoices made up for the lists without one).

    ``lists``: doc_id, doc_pos, total, printed (whether the total is printed); ``invoices``: inv_id, inv_pos, inv_amount, has_rides. Lists in their order
    take the first invoice without rides whose amount is near: to the cent for a printed total, within 2.00 for a sum.
    """
    free = invoices.filter(~F.col("has_rides"))
    near = matching.band_join(lists, free, "total", "inv_amount", ROUGH).filter(F.abs(F.col("total") - F.col("inv_amount")) <= F.when(F.col("printed"), F.lit(EXACT + 1e-9)).otherwise(F.lit(ROUGH)))
    pairs = near.select(F.col("doc_id").alias("inv_id"), F.col("inv_id").alias("pay_id"), "doc_pos", "inv_pos")
    got = matching.one_per_payment(pairs, [F.asc("inv_pos"), F.asc("pay_id")], [F.col("doc_pos"), F.col("inv_id")]).select(F.col("inv_id").alias("doc_id"), F.col("pay_id").alias("inv_id"))
    alone = lists.join(got, "doc_id", "left_anti").select("doc_id", F.col("total").alias("inv_amount"), F.lit("CityTransport").alias("category"))
    return got, alone


# ---------------------------------------------------------------- trips


def candidate_days(category: Column, day: Column, check_in: Column, ride_days: Column, toll_day: Column) -> Column:
    """The days that may place an invoice in a trip: check-in, the rides' days, the toll's day, else its own."""
    known = F.when(category == "Hotel", F.array(check_in)).when(category == "CityTransport", ride_days).when(category == "Toll", F.array(toll_day))
    some = F.array_compact(F.coalesce(known, F.array().cast("array<date>")))
    return F.when(F.size(some) > 0, some).otherwise(F.array(day))


def on_trips(invoices: DataFrame, trips: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inv_id, trip_no): the earliest trip with one of an invoice's days that its cities don't contradict.

    ``invoices``: keys, inv_id, days (array), category, names (array), rides (array with pickup, dropoff, city); ``trips``: keys, trip_no, start, end, cities (array).
    """
    days = invoices.select(*keys, "inv_id", "category", "names", "rides", F.explode("days").alias("day"))
    met = matching.window_join(days, trips, keys, "day", "start", "end")
    hit = F.when(F.col("category") == "CityTransport", rides.in_cities([F.array_join("names", "|")], F.col("rides"), F.col("cities"))).otherwise(F.lit(True))
    return matching.least_by(met.filter(hit), [*keys, "inv_id"], F.col("start"), F.col("trip_no")).select(*keys, "inv_id", "trip_no")


def trips_of(tickets: DataFrame, key: str, everything: DataFrame, origin: str | None = None) -> DataFrame:
    """(key, trip_no, destination, travel_start, travel_end) by the tickets; a key without any ticket has one trip with everything.

    ``everything``: key, day of all its invoices.
    """
    found = records.trip_rows(records.trips(tickets, key, origin), key).select(key, "trip_no", "destination", "travel_start", "travel_end")
    alone = everything.join(tickets.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min("day").alias("travel_start"), F.max("day").alias("travel_end"))
    return found.unionByName(alone.select(key, F.lit(1).alias("trip_no"), F.lit("").alias("destination"), "travel_start", "travel_end"), allowMissingColumns=True)


# ---------------------------------------------------------------- matches


def payment_of_ride(payments: Column, pairs: Column, ride: Column) -> Column:
    """The payment of a ride: the one that its pair (struct of ride and pay_id) names, or, where no pair is told, the one at its place."""
    named = F.get(F.filter(pairs, lambda p: p["ride"] == ride), 0)["pay_id"]
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, named).otherwise(F.get(payments, ride))


def candidate_pool(*groups: DataFrame, key: str = "pay_id") -> DataFrame:
    """Payments of several groups, each once, from the first group that has it."""
    every = None
    for n, g in enumerate(groups):
        some = g.withColumn("__g", F.lit(n))
        every = some if every is None else every.unionByName(some)
    return every.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("__g"))).filter("__n = 1").drop("__n", "__g")


def match_rows(matches: DataFrame) -> DataFrame:
    """One row a ride or payment of each match for a sheet: the match's own columns only on its first row.

    ``matches``: inv_id, inv_amount, rides (array with date_time, pickup, dropoff, amount), payments (array with pay_id, amount). Adds the remark of the ride and, on the first
    row, what the payments leave of the claim's amount.
    """
    n = F.greatest(F.size("rides"), F.size("payments"), F.lit(1))
    rows = matches.withColumn("row_no", F.explode(F.sequence(F.lit(0), n - 1)))
    ride, pay, first = F.get("rides", F.col("row_no")), F.get("payments", F.col("row_no")), F.col("row_no") == 0
    left = F.col("inv_amount") - F.aggregate("payments", F.lit(0.0), lambda s, p: s + p["amount"])
    remark = F.when(ride.isNotNull(), F.concat(F.coalesce(ride["date_time"], F.lit("")), F.lit("  "), F.coalesce(ride["pickup"], F.lit("")), F.lit(" → "), F.coalesce(ride["dropoff"], F.lit(""))))
    return rows.select("inv_id", "row_no", F.when(first, F.col("inv_amount")).alias("inv_amount"), ride["amount"].alias("ride_amount"), remark.alias("remark"), pay["pay_id"].alias("pay_id"), pay["amount"].alias("pay_amount"), F.when(first, F.round(left, 2)).alias("discount"))
