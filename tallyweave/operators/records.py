"""Record keeping: refund netting, duplicates, summaries, ordered folds over rides and tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.tables import few

# ---------------------------------------------------------------- refunds


def net_refunds(rows: DataFrame) -> DataFrame:
    """Payments net of their refunds.

    ``rows``: pos (file order), trade_id, merchant_order, amount (refunds negative). A refund belongs to the
    first payment with its non-empty merchant order, preferring one whose number begins the refund's; else
    to the first payment whose number begins the refund's. Refunds without a payment are dropped, and so
    are payments that are refunded in full. Both links are equi joins: a number that begins another is found
    by its length among the lengths that occur.
    """
    paid, back = rows.filter("amount > 0"), rows.filter("amount < 0").select(F.col("pos").alias("r_pos"), F.col("trade_id").alias("r_id"), F.col("merchant_order").alias("r_order"), F.col("amount").alias("r_amount"))
    by_order = back.filter("r_order <> ''").join(paid, F.col("r_order") == F.col("merchant_order")).select("r_pos", "r_amount", "pos", F.when(F.col("r_id").startswith(F.col("trade_id")), 0).otherwise(1).alias("tier"))
    lengths = F.array(*[F.lit(r["n"]) for r in few(paid.select(F.length("trade_id").alias("n")).distinct()) if r["n"]]).cast("array<int>")
    cut = back.select("r_pos", "r_amount", "r_id", F.explode(F.filter(lengths, lambda n: n <= F.length("r_id"))).alias("n")).select("r_pos", "r_amount", F.substring(F.col("r_id"), F.lit(1), F.col("n")).alias("trade_id"))
    by_prefix = cut.join(paid.select("trade_id", "pos"), "trade_id").select("r_pos", "r_amount", "pos", F.lit(2).alias("tier"))
    first = W.partitionBy("r_pos").orderBy("tier", "pos")
    linked = by_order.unionByName(by_prefix).withColumn("n", F.row_number().over(first)).filter("n = 1")
    totals = linked.groupBy("pos").agg((-F.sum("r_amount")).alias("refunded"))
    out = paid.join(totals, "pos", "left").withColumn("refunded", F.coalesce("refunded", F.lit(0.0)))
    return out.filter(F.col("refunded") < F.col("amount")).withColumn("net", F.col("amount") - F.col("refunded"))


# ---------------------------------------------------------------- duplicates


def first_of_each(df: DataFrame, number: str, others: list[str], order: str) -> DataFrame:
    """Adds ``copy_no``: 1 for the first row of a number, or of the other columns where the number is empty."""
    empty = F.coalesce(F.col(number), F.lit("")) == ""
    key = F.when(empty, F.struct(F.lit("").alias("n"), *[F.col(c).cast("string").alias(c) for c in others])).otherwise(F.struct(F.col(number).alias("n"), *[F.lit(None).cast("string").alias(c) for c in others]))
    return df.withColumn("copy_no", F.row_number().over(W.partitionBy(key).orderBy(order)))


def new_numbers(new: DataFrame, known: DataFrame, number: str) -> DataFrame:
    """New rows whose number is not known; rows without a number always pass."""
    empty = F.coalesce(F.col(number), F.lit("")) == ""
    return new.filter(empty).unionByName(new.filter(~empty).join(known.select(number).distinct(), number, "left_anti"))


def first_arrivals(rows: DataFrame, number: str, order: list[str], id_: str) -> DataFrame:
    """Ids of the rows whose number no earlier row has; rows without a number always pass."""
    empty = F.coalesce(F.col(number), F.lit("")) == ""
    firsts = rows.filter(~empty).groupBy(number).agg(F.min(F.struct(*order, id_)).alias("first"))
    return rows.filter(empty).select(id_).unionByName(firsts.select(F.col(f"first.{id_}").alias(id_)))


# ---------------------------------------------------------------- ordered folds


def share_of_printed_total(rides: DataFrame, key: str, amount: str, printed: str, least: float = 0.5) -> DataFrame:
    """Amounts scaled to a printed total where their sum differs by ``least`` or more; cents are rounded."""
    total = F.sum(amount).over(W.partitionBy(key))
    scale = (F.abs(F.col(printed) - total) >= least) & (total > 0)
    return rides.withColumn("fixed", F.when(scale, F.round(F.col(amount) * F.col(printed) / total * 100) / 100).otherwise(F.col(amount)))


def rolling_years(rides: DataFrame, key: str, pos: str, month: str, base_year: str) -> DataFrame:
    """The year of dates without one: it rises whenever the month falls back."""
    w = W.partitionBy(key).orderBy(pos)
    falls = F.when(F.col(month) < F.lag(month).over(w), 1).otherwise(0)
    return rides.withColumn("__falls", falls).withColumn("year", F.col(base_year) + F.sum("__falls").over(w)).drop("__falls")


def last_within(lines: DataFrame, key: str, pos: str, value: str, rows: int = 6) -> DataFrame:
    """The last known value on the line or up to ``rows`` lines above."""
    w = W.partitionBy(key).orderBy(pos).rowsBetween(-rows, 0)
    return lines.withColumn("near", F.last(value, ignorenulls=True).over(w))


def conditional_sums(rows: DataFrame, key: str, column: str, amount: str, groups: dict[str, list[str]]) -> DataFrame:
    """One row a key with the sum of cents for each group of values, in one aggregation."""
    cents = F.round(F.col(amount) * 100).cast("bigint")
    return rows.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col(column).isin(v), cents)), F.lit(0)).alias(n) for n, v in groups.items()])


# ---------------------------------------------------------------- trips

_TICKET = "struct<id:string,dep:string,arr:string,day:date>"
_TRIP = f"struct<dest:string,start:date,stop:date,ids:array<string>>"


def trips(tickets: DataFrame, key: str, origin: str | None = None) -> DataFrame:
    """Round trips from the tickets of each key, by following the chain of cities.

    ``tickets``: key, id, departure, arrival, travel_date, pos. Tickets are folded in the order of date and
    position. Without an origin a chain starts at its first ticket, goes on while a ticket departs where the
    last arrived, and ends with one that returns to the start; a break sends the chain to the unassigned.
    With an origin, trips open on a departure from it and close on an arrival at it. One row a key: trips
    and ids that are in none. The tickets of one key are one traveller's.
    """
    row = F.struct(F.col("travel_date").alias("day"), "pos", F.col("id").cast("string").alias("id"), F.col("departure").alias("dep"), F.col("arrival").alias("arr"))
    lists = tickets.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("ts"))
    empty = f"named_struct('trips', cast(array() as array<{_TRIP}>), 'un', cast(array() as array<string>), 'ids', cast(array() as array<string>), 'org', cast(null as string), 'front', cast(null as string), 'start', cast(null as date))"
    state = lambda trips_, un, ids, org, front, start: f"named_struct('trips', {trips_}, 'un', {un}, 'ids', {ids}, 'org', {org}, 'front', {front}, 'start', {start})"
    opened = "size(s.ids) > 0"
    none, nobody, nowhen = "cast(array() as array<string>)", "cast(null as string)", "cast(null as date)"
    closed = "array_append(s.trips, named_struct('dest', t.dep, 'start', s.start, 'stop', t.day, 'ids', array_append(s.ids, t.id)))"
    begin = lambda un: state("s.trips", un, "array(t.id)", "t.dep", "t.arr", "t.day")
    go_on = state("s.trips", "s.un", "array_append(s.ids, t.id)", "s.org", "t.arr", "s.start")
    close = state(closed, "s.un", none, nobody, nobody, nowhen)
    if origin is None:
        merge = f"case when {opened} and t.dep = s.front and t.arr = s.org then {close} when {opened} and t.dep = s.front then {go_on} else {begin('concat(s.un, s.ids)')} end"
    else:
        o = "'" + origin.replace("'", "''") + "'"
        skip = state("s.trips", "array_append(s.un, t.id)", "s.ids", "s.org", "s.front", "s.start")
        merge = f"case when not ({opened}) then (case when t.dep = {o} then {begin('s.un')} else {skip} end) when t.arr = {o} then {close} when t.dep = s.front then {go_on} when t.dep = {o} then {begin('concat(s.un, s.ids)')} else {skip} end"
    folded = lists.selectExpr(key, f"aggregate(ts, {empty}, (s, t) -> {merge}, s -> named_struct('trips', s.trips, 'unassigned', concat(s.un, s.ids))) as f")
    return folded.select(key, F.col("f.trips").alias("trips"), F.col("f.unassigned").alias("unassigned"))


def trip_rows(folded: DataFrame, key: str) -> DataFrame:
    """One row a trip, numbered within its key."""
    return folded.select(key, F.posexplode("trips").alias("n", "t")).select(key, (F.col("n") + 1).alias("trip_no"), F.col("t.dest").alias("destination"), F.col("t.start").alias("travel_start"), F.col("t.stop").alias("travel_end"), F.col("t.ids").alias("ticket_ids"))
