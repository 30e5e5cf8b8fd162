"""Set-based matching of claims and payments: tolerance bands, nearest dates, ride windows, scores.

Claims (``inv``): inv_id, inv_amount, inv_date and whatever else; payments (``pay``): pay_id, pay_amount,
pay_total, pay_time, pay_pos. All joins are band joins: both sides get a cell number, the claims take the
neighbouring cells, the join is an equi join on the cell, and the exact bound is a residual predicate; so no
pair of rows outside of neighbouring cells is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions.text import category_bit, category_bits, category_score, category_score_of, merchant_score


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, keys: list[str] = ()) -> DataFrame:
    """All pairs with |left - right| <= width, within equal ``keys``, by an equi join on cells of that width."""
    w = max(float(width), 0.01)
    cell = lambda c: F.floor(F.col(c) / w)
    a = left.withColumn("__cell", F.explode(F.array(cell(left_value) - 1, cell(left_value), cell(left_value) + 1)))
    b = right.withColumn("__cell", cell(right_value))
    return a.join(b, [*keys, "__cell"]).filter(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("__cell")


def tolerance_candidates(inv: DataFrame, pay: DataFrame, tolerance: float, keys: list[str] = ()) -> DataFrame:
    """Pairs whose amount is within the tolerance of the payment's amount or of its total with discounts.

    Adds ``amount_diff``, the smaller difference. One join per amount, each pair kept once.
    """
    diff = F.least(F.abs(F.col("inv_amount") - F.col("pay_amount")), F.abs(F.col("inv_amount") - F.col("pay_total")))
    net = band_join(inv, pay, "inv_amount", "pay_amount", tolerance, keys)
    total = band_join(inv, pay.filter("pay_total <> pay_amount"), "inv_amount", "pay_total", tolerance, keys)
    total = total.filter(F.abs(F.col("inv_amount") - F.col("pay_amount")) > tolerance)
    return net.unionByName(total).withColumn("amount_diff", diff)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def least_by(df: DataFrame, keys: list[str], *rank: Column) -> DataFrame:
    """The row of each key with the least ``rank``, whose values are put in ascending order, missing ones first.

    An aggregation that is combined before the shuffle, so a hot key costs one row a task.
    """
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("__b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__b.`{c}`").alias(c) for c in df.columns])


def nearest_match(inv: DataFrame, pay: DataFrame, tolerance: float, keys: list[str] = (), paid_before: bool = False) -> DataFrame:
    """For each claim the payment within the tolerance with the nearest date, then the smallest difference.

    ``paid_before`` keeps payments up to the claim's date only. Payments without a readable time come last.
    Adds ``days`` and ``confidence``. Claims without a candidate are left out.
    """
    c = tolerance_candidates(inv, pay, tolerance, keys)
    day = F.to_date("pay_time")
    if paid_before:
        c = c.filter(F.coalesce(day <= F.col("inv_date"), F.lit(True)))
    c = c.withColumn("days", F.abs(F.datediff("inv_date", day)))
    best = least_by(c, [*keys, "inv_id"], F.col("days").isNull(), F.col("days"), F.col("amount_diff"), F.col("pay_pos"))
    return best.withColumn("confidence", 1 - F.col("amount_diff") / F.greatest(F.col("inv_amount"), F.lit(0.01)))


FEW = 100_000  # open candidates from which the rest of the assignment is one pass in one task


def one_per_payment(candidates: DataFrame, rank: list[Column], priority: list[Column], keys: list[str] = (), few: int = FEW) -> DataFrame:
    """Greedy one-to-one assignment at scale.

    Claims in a fixed priority each take their best payment that is still free. A claim that is the first of all
    its best payment's claims gets it whatever happens elsewhere; so do, round by round, the claims that
    become first when such claims and their payments are gone. Each round removes the settled rows, and only
    the others are written again. Once at most ``few`` candidates are open, or where a round settles
    less than a hundredth of them (long chains, in which each refusal leads to the next), each connected rest is small or a
    chain, and the open rows are gone through in order of priority.
    """
    from tallyweave.tables import cut

    ranked = F.row_number().over(W.partitionBy(*keys, "inv_id").orderBy(*rank))
    prio = F.struct(*[x.alias(f"p{i}") for i, x in enumerate(priority)])
    c = cut(candidates.withColumns({"__rank": ranked, "__prio": prio}))
    claim, paid = [*keys, "inv_id"], [*keys, "pay_id"]
    left, taken = c.select(*keys, "inv_id", "pay_id", "__rank", "__prio"), None
    n = left.count()
    while n:
        if n <= few:
            best = cut(_in_order(left, list(keys)))
        else:
            # what a payment's first claim is, and whether that payment is the claim's best
            firsts = left.groupBy(*paid).agg(F.min_by("inv_id", "__prio").alias("inv_id"))
            best = cut(left.groupBy(*claim).agg(F.min_by("pay_id", "__rank").alias("pay_id")).join(firsts, [*claim, "pay_id"], "left_semi"))
        taken = best if taken is None else taken.unionByName(best)
        if n <= few:
            break
        left = cut(left.join(best.select(*claim), claim, "left_anti").join(best.select(*paid), paid, "left_anti"))
        before, n = n, left.count()
        if before - n < before // 100:
            few = n
    if taken is None:
        return candidates.limit(0)
    return c.join(taken, [*claim, "pay_id"], "left_semi").drop("__rank", "__prio").select(*candidates.columns)


def _in_order(left: DataFrame, keys: list[str]) -> DataFrame:
    """The open claims in order of priority, each with its best free payment; rows stream through one task."""
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "inv_id", "pay_id"])

    def run(batches):
        used, done = set(), set()
        for b in batches:
            out = []
            for row in zip(*(b[k] for k in [*keys, "inv_id", "pay_id"])):
                key, inv, pay = row[:-2], row[-2], row[-1]
                if (key, inv) not in done and (key, pay) not in used:
                    done.add((key, inv))
                    used.add((key, pay))
                    out.append(row)
            yield b.head(0)[[*keys, "inv_id", "pay_id"]] if not out else type(b)(out, columns=[*keys, "inv_id", "pay_id"])

    return left.orderBy("__prio", *keys, "inv_id", "__rank").coalesce(1).select(*keys, "inv_id", "pay_id").mapInPandas(run, schema)


STRETCH = 1_000_000  # rows of the ordered stream that are looked at together


def one_per_payment_by_amount(inv: DataFrame, pay: DataFrame, tolerance: float, stretch: int = STRETCH) -> DataFrame:
    """(inv_id, pay_id, days): one_per_payment() of tolerance_candidates() where the greatest amount chooses first, then the smaller inv_id.

    A claim takes the free payment with the fewest days (missing ones last), then the smallest difference, then the smaller
    pay_id. No pair is written: claims and payments stream through one task by falling amount, each payment from the greater of
    its amounts on until the lesser is passed. The task holds only the payments between these.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("double")
    none = F.lit(None)
    sound = lambda c: F.when(~F.isnan(c), F.col(c))
    kinds = {f.name: f.dataType.simpleString() for f in [*inv.schema, *pay.schema]}
    own = inv.select(sound("inv_amount").alias("at"), sound("inv_amount").alias("amount"), none.cast("double").alias("total"), day("inv_date").alias("day"), "inv_id", none.cast(kinds["pay_id"]).alias("pay_id"))
    top = F.greatest(sound("pay_amount"), sound("pay_total"))
    paid = pay.select((top + _slack(top, tolerance, F.abs)).alias("at"), sound("pay_amount").alias("amount"), sound("pay_total").alias("total"), day("pay_time").alias("day"), none.cast(kinds["inv_id"]).alias("inv_id"), "pay_id")
    rows = own.unionByName(paid.filter("pay_id is not null")).filter("at is not null").orderBy(F.desc("at"), "inv_id").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, kept, n = None, [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            if n >= stretch:
                pool, out = _take_in_order(pa.Table.from_batches(kept), pool, tolerance)
                yield out
                kept, n = [], 0
        if n:
            yield _take_in_order(pa.Table.from_batches(kept), pool, tolerance)[1]

    return rows.mapInArrow(run, f"inv_id {kinds['inv_id']}, pay_id {kinds['pay_id']}, days int")


def _slack(value, tolerance: float, size):
    """What is looked beyond the tolerance, so that rounding hides no pair; the exact difference decides."""
    return tolerance + 0.01 + size(value) * 1e-12


def _take_in_order(rows: pa.Table, pool: pa.Table | None, tolerance: float) -> tuple[pa.Table, pa.RecordBatch]:
    """Lets the claims of a stretch choose; returns the payments that later claims may take, and the matches."""
    is_claim = pc.is_valid(rows["inv_id"])
    claims, paid = rows.filter(is_claim), rows.filter(pc.invert(is_claim)).select(["amount", "total", "day", "pay_id"])
    paid = (pa.concat_tables([pool, paid]) if pool is not None else paid).combine_chunks()
    number = lambda t, c: pc.fill_null(t[c], float("nan")).to_numpy()
    amount, total, day = (number(paid, c) for c in ("amount", "total", "day"))
    free = np.ones(len(amount), bool)
    at, on = number(claims, "amount"), number(claims, "day")
    slack = _slack(at, tolerance, np.abs)
    windows = []
    for value in (amount, total):
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        windows.append((order, np.searchsorted(ranked, at - slack, "left"), np.searchsorted(ranked, at + slack, "right")))
    (by_a, lo_a, hi_a), (by_t, lo_t, hi_t) = windows
    some = np.flatnonzero((hi_a > lo_a) | (hi_t > lo_t))
    took_claim, took_pay, took_days = [], [], []
    ids = paid["pay_id"]
    known: dict[float, list | None] = {}  # of claims with the same amount: None after the first of a day, then all its candidates in order
    last = None
    for k in some.tolist():
        a, d = at[k], on[k]
        if a != last:
            known, last = {}, a
        d_key = None if d != d else d
        if known.get(d_key) is None:
            i = np.concatenate([by_a[lo_a[k] : hi_a[k]], by_t[lo_t[k] : hi_t[k]]])
            i = i[free[i]]
            diff = np.fmin(np.abs(a - amount[i]), np.abs(a - total[i]))
            near = diff <= tolerance
            i, diff = i[near], diff[near]
            days = np.abs(d - day[i])
            days[np.isnan(days)] = np.inf
            if d_key in known and len(i):  # a second such claim: put all in order once, the last to choose first
                i, first = np.unique(i, return_index=True)
                names = ids.take(pa.array(i)).to_pylist()
                known[d_key] = [x[3:] + x[:1] for x in sorted(zip(days[first].tolist(), diff[first].tolist(), names, i.tolist()), reverse=True)]
            elif len(i):
                known[d_key] = None
                at_best = np.flatnonzero(days == days.min())
                at_best = at_best[diff[at_best] == diff[at_best].min()]
                best = i[at_best]
                one = int(best[0]) if (best == best[0]).all() else min(zip(ids.take(pa.array(best)).to_pylist(), best.tolist()))[1]
                free[one] = False
                took_claim.append(k)
                took_pay.append(one)
                took_days.append(days[at_best[0]])
                continue
            else:
                known[d_key] = []
        rest = known[d_key]
        while rest:
            one, far = rest.pop()
            if free[one]:
                free[one] = False
                took_claim.append(k)
                took_pay.append(one)
                took_days.append(far)
                break
    end = rows["at"][-1].as_py()
    rest = paid.filter(pa.array(free & (np.fmin(amount, total) <= end + _slack(end, tolerance, abs))))
    columns = [claims["inv_id"].take(pa.array(took_claim, pa.int64())), ids.take(pa.array(took_pay, pa.int64())), pa.array([None if x == np.inf else int(x) for x in took_days], pa.int32())]
    return rest, pa.table(columns, names=["inv_id", "pay_id", "days"]).combine_chunks().to_batches()[0] if took_claim else pa.RecordBatch.from_arrays([pa.array([], c.type) for c in columns], names=["inv_id", "pay_id", "days"])


# ---------------------------------------------------------------- rides, windows


def ride_candidates(rides: DataFrame, pay: DataFrame, keys: list[str], hours: int = 12) -> DataFrame:
    """Payments from the ride's start up to ``hours`` full hours later; adds ``hours_after``.

    Times meet in cells of a day within the keys; ride_time and pay_time are zone-less timestamps.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    a = rides.withColumn("__day", F.explode(F.array(day("ride_time"), day("ride_time") + 1)))
    b = pay.withColumn("__day", day("pay_time"))
    after = F.timestamp_diff("HOUR", F.col("ride_time"), F.col("pay_time"))
    return a.join(b, [*keys, "__day"]).withColumn("hours_after", after).filter((F.col("pay_time") >= F.col("ride_time")) & F.col("hours_after").between(0, hours)).drop("__day")


def ride_best_payment(rides: DataFrame, pay: DataFrame, keys: list[str], tolerance: float, hours: int = 12) -> DataFrame:
    """For each ride its best payment: within the tolerance ranked by hours, then difference; else a payment
    that exceeds the ride by no more than the ride itself, on the same or the next day."""
    c = ride_candidates(rides, pay, keys, hours)
    ratio = F.col("pay_amount") / F.col("ride_amount")
    c = c.filter((F.col("ride_amount") <= 0) | (F.col("pay_amount") <= 0) | ratio.between(0.33, 3.0))
    off = F.col("pay_amount") - F.col("ride_amount")
    exact = F.abs(off) <= tolerance
    extra = (off > 0) & (off <= F.col("ride_amount")) & F.datediff("pay_time", "ride_time").isin(0, 1)
    c = c.withColumn("tier", F.when(exact, 0).when(extra, 1)).filter("tier is not null").withColumn("amount_diff", F.abs(off))
    return least_by(c, [*keys, "ride_id"], F.col("tier"), F.col("hours_after"), F.col("amount_diff"), F.col("pay_pos"))


HOT = 1_000_000  # rows of one key from which its time is cut into slices


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, left_id: str, right_id: str, hot: int = HOT) -> DataFrame:
    """For each left row the right row of the same keys with the nearest time, before or after; ties go to the smaller id.

    Both sides are merged in time order and the last earlier and first later right rows are carried along,
    so the cost is a sort within the keys and not the product of the sides. The time of hot keys, found by
    counting, is cut into slices that are sorted by themselves; the last right row of the slices before and the first of
    those after come from one row a slice.
    """
    a = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__s"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.schema.simpleString()).alias("__r"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__s"), F.lit(None).cast(left.schema.simpleString()).alias("__l"), F.struct(*right.columns).alias("__r"))
    both = a.unionByName(b)
    ends = both.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__t").alias("__from"), F.max("__t").alias("__to")).filter(F.col("__n") > hot)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = F.greatest(F.ceil((micros("__to") - micros("__from") + 1) / F.ceil(F.col("__n") / hot)), F.lit(1))
    slices = ends.select(*keys, micros("__from").alias("__low"), width.alias("__width"))  # at most all rows / hot of them
    sliced = not slices.isEmpty()
    if sliced:
        both = both.join(F.broadcast(slices), keys, "left").withColumn("__slice", F.coalesce(F.floor((micros("__t") - F.col("__low")) / F.col("__width")), F.lit(0))).drop("__low", "__width")
    else:
        both = both.withColumn("__slice", F.lit(0))
    order = W.partitionBy(*keys, "__slice").orderBy("__t", "__s", F.col(f"__r.{right_id}"))
    back = W.partitionBy(*keys, "__slice").orderBy(F.desc("__t"), F.asc("__s"), F.desc(F.col(f"__r.{right_id}")))
    marked = both.withColumn("__before", F.last("__r", ignorenulls=True).over(order)).withColumn("__after", F.last("__r", ignorenulls=True).over(back))
    own = marked.filter("__s = 1")
    if not sliced:
        return _nearer(own, left, right, keys, right_time, right_id)
    # one row a slice: its first and last right row, carried over the slices of the key
    at = F.struct("__t", F.col(f"__r.{right_id}"))
    edge = b.join(F.broadcast(slices), keys).withColumn("__slice", F.floor((micros("__t") - F.col("__low")) / F.col("__width"))).groupBy(*keys, "__slice").agg(F.min_by("__r", at).alias("__first"), F.max_by("__r", at).alias("__last"))
    along = W.partitionBy(*keys).orderBy("__slice")
    want = own.join(F.broadcast(slices).select(*keys), keys, "left_semi").select(*keys, "__slice").distinct()
    edge = want.join(edge, [*keys, "__slice"], "full_outer")
    edge = edge.select(*keys, "__slice", F.last("__last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("__earlier"), F.first("__first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("__later"))
    own = own.join(edge, [*keys, "__slice"], "left").withColumns({"__before": F.coalesce("__before", "__earlier"), "__after": F.coalesce("__after", "__later")})
    return _nearer(own, left, right, keys, right_time, right_id)


def _nearer(own: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], right_time: str, right_id: str) -> DataFrame:
    """Of the right rows before and after each left row the nearer one."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = lambda c: F.abs(micros("__t") - micros(f"{c}.{right_time}"))
    first = F.col(f"__before.{right_id}").isNotNull() & (F.col(f"__after.{right_id}").isNull() | (gap("__before") < gap("__after")) | ((gap("__before") == gap("__after")) & (F.col(f"__before.{right_id}") <= F.col(f"__after.{right_id}"))))
    near = F.when(first, F.col("__before")).otherwise(F.col("__after"))
    return own.withColumn("__n", near).filter(F.col(f"__n.{right_id}").isNotNull()).select(*[F.col(f"__l.{c}").alias(c) for c in left.columns], *[F.col(f"__n.{c}").alias(c) for c in right.columns if c not in keys and c not in left.columns])


def window_join(points: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, end: str, cell_days: int = 7) -> DataFrame:
    """Points whose date lies in a window of the same keys, both ends included, by cells of days."""
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / cell_days)
    cells = windows.filter(F.col(start) <= F.col(end)).withColumn("__cell", F.explode(F.sequence(number(start), number(end))))
    return points.withColumn("__cell", number(at)).join(cells, [*keys, "__cell"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__cell")


# ---------------------------------------------------------------- scores


def amount_score(diff: Column, tolerance: float = 5.0) -> Column:
    return F.when(diff == 0, F.lit(1.0)).when(diff <= tolerance, 1 - diff / tolerance * 0.5).otherwise(F.lit(0.0))


def time_score(days: Column) -> Column:
    return F.when(days.isNull(), F.lit(0.5)).when(days == 0, F.lit(1.0)).when(days <= 1, F.lit(0.9)).when(days <= 3, F.lit(0.7)).when(days <= 7, F.lit(0.5)).otherwise(F.lit(0.0))


WEIGHTS = (0.4, 0.3, 0.2, 0.1)  # of amount, merchant, time, category
NAMES = 3_000  # distinct names a side up to which all are compared with all beforehand


def mark_alike(inv: DataFrame, pay: DataFrame, most: int = NAMES) -> tuple[DataFrame, DataFrame]:
    """Adds ``inv_alike`` and ``pay_alike``: whether any name of the other side is like the row's name at all.

    Distinct names are compared once, so that pairs of other names need no comparison. Where there are more than
    ``most`` of them nothing is ruled out.
    """
    from tallyweave.tables import cut, cut_and_count

    (a, n), (b, m) = (cut_and_count(side.select(c).filter(F.col(c).isNotNull()).distinct()) for side, c in ((inv, "inv_seller"), (pay, "pay_merchant")))
    if n > most or m > most:
        return inv.withColumn("inv_alike", F.lit(True)), pay.withColumn("pay_alike", F.lit(True))
    alike = cut(a.crossJoin(F.broadcast(b)).filter(merchant_score(F.col("inv_seller"), F.col("pay_merchant")) > 0))
    if alike.isEmpty():
        return inv.withColumn("inv_alike", F.lit(False)), pay.withColumn("pay_alike", F.lit(False))
    mark = lambda side, c, to: side.join(F.broadcast(alike.select(c).distinct().withColumn(to, F.lit(True))), c, "left").withColumn(to, F.coalesce(to, F.lit(False)))
    return mark(inv, "inv_seller", "inv_alike"), mark(pay, "pay_merchant", "pay_alike")


def mark_parts(inv: DataFrame, pay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works out once a row what score_pairs() would else work out for each of its pairs: the bits of the categories, the day of the payment."""
    return inv.withColumn("inv_bit", category_bit(F.col("inv_category"))), pay.withColumns({"pay_bits": category_bits(F.col("pay_category")), "pay_time": F.to_date("pay_time")})


def can_reach(least: float, weights: tuple[float, float, float, float] = WEIGHTS, tolerance: float = 5.0) -> Column:
    """What a pair of tolerance_candidates() between sides of mark_alike() needs to reach the least score.

    Without a near date and like names only amount and category are left, so the amounts must be that near.
    """
    days = F.abs(F.datediff("inv_date", F.to_date("pay_time")))
    lacks = 1 - (least - weights[3]) / weights[0]  # how much the amount's score may be below 1
    near = F.lit(True) if lacks >= 0.5 else F.col("amount_diff") <= max(0.0, lacks * 2 * tolerance) if lacks >= 0 else F.lit(False)
    return days.isNull() | (days <= 7) | (F.col("inv_alike") & F.col("pay_alike")) | near


def score_pairs(pairs: DataFrame, weights: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """Adds the four part scores and their weighted total to pairs of a claim and a payment.

    Names are compared only where mark_alike(), if it was used, leaves that open; the bits of mark_parts() stand for the categories.
    The amounts' score falls with their difference, so the smaller of the two differences has the greater score.
    """
    days = F.abs(F.datediff("inv_date", F.to_date("pay_time")))
    names = merchant_score(F.col("inv_seller"), F.col("pay_merchant"))
    if "inv_alike" in pairs.columns:
        names = F.when(F.col("inv_alike") & F.col("pay_alike"), names).otherwise(F.lit(0.0))
    parts = {
        "amount_score": amount_score(F.least(F.abs(F.col("inv_amount") - F.col("pay_total")), F.abs(F.col("inv_amount") - F.col("pay_amount")))),
        "merchant_score": names,
        "time_score": time_score(days),
        "category_score": category_score_of(F.col("inv_bit"), F.col("pay_bits")) if "inv_bit" in pairs.columns else category_score(F.col("inv_category"), F.col("pay_category")),
    }
    out = pairs.withColumns(parts)
    total = sum((F.col(c) * w for c, w in zip(parts, weights)), F.lit(0.0))
    return out.withColumn("total_score", total)


def top_scored(pairs: DataFrame, keys: list[str], k: int = 10, least: float = 0.5) -> DataFrame:
    """The k best scored pairs of each claim with at least the least score; adds ``place``."""
    ranked = pairs.filter(F.col("total_score") >= least).withColumn("place", F.row_number().over(W.partitionBy(*keys, "inv_id").orderBy(F.desc("total_score"), F.asc("pay_pos"))))
    return ranked.filter(F.col("place") <= k)


# ---------------------------------------------------------------- ad-hoc queries


def search_payments(pay: DataFrame, source: str | None = None, start: str | None = None, end: str | None = None, text: str | None = None, least: float | None = None, most: float | None = None, category: str | None = None, method: str | None = None, kind: str | None = None) -> DataFrame:
    """Payments that meet all given conditions; ``text`` is looked for in merchant and number, any case."""
    out = pay
    if source:
        out = out.filter(F.col("source") == source)
    if start:
        out = out.filter(F.substring("transaction_time", 1, 10) >= start)
    if end:
        out = out.filter(F.substring("transaction_time", 1, 10) <= end)
    if text:
        out = out.filter(F.lower("merchant_name").contains(text.lower()) | F.lower("transaction_id").contains(text.lower()))
    if least is not None:
        out = out.filter(F.col("amount") >= least)
    if most is not None:
        out = out.filter(F.col("amount") <= most)
    if category:
        out = out.filter(F.col("category") == category)
    if method:
        out = out.filter(F.col("payment_method") == method)
    if kind:
        out = out.filter({"refund": F.col("refund_amount") > 0, "discount": F.col("discount") > 0, "none": (F.col("refund_amount") <= 0) & (F.col("discount") <= 0)}[kind])
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """One page of an ordered result, counted from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)
