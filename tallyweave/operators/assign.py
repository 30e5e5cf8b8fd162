"""Assignment of payments to claims batch by batch, where each step depends on what was used before.

The sequential part is a plain function over one batch, run by a grouped map; a batch is one import of one
user. Payments of a batch lie in a Pool that is sorted by time, by amount and by total, so a claim looks only at the
payments of its time window or amount band. Where only one-to-one steps are needed,
matching.one_per_payment() gives the same result with joins.

The limits MOST_CANDIDATES and MOST_PICKS are part of what a subset match means, not of how it is found.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CANDIDATES, MOST_PICKS = 20, 10
HOURS = 12  # full hours after a ride in which it is paid
NEVER = 2**62  # the time and day of a payment that can't be read
OUT = "batch string, inv_id string, pay_ids array<string>, kind string, amount_diff double, rides array<int>, shared_from string"


def subset_near(target: float, amounts: list[float], tolerance: float) -> tuple[list[int], float] | None:
    """The subset of the first candidates whose sum is nearest to the target, within the tolerance.

    Candidates are the first MOST_CANDIDATES amounts that don't exceed the target by more than the
    tolerance; a subset has at most MOST_PICKS; of equally near ones the first in depth-first order counts,
    and an exact one ends the search.
    """
    idx = [i for i, a in enumerate(amounts) if a <= target + tolerance][:MOST_CANDIDATES]
    best: list = [None, tolerance]
    tail = [0.0] * (len(idx) + 1)
    for k in range(len(idx) - 1, -1, -1):
        tail[k] = tail[k + 1] + max(0.0, amounts[idx[k]])

    def go(k: int, chosen: list[int], total: float) -> bool:
        off = abs(target - total)
        if chosen and (off < best[1] or (best[0] is None and off <= best[1])):
            best[0], best[1] = list(chosen), off
            if off == 0:
                return True
        if len(chosen) == MOST_PICKS:
            return False
        for j in range(k, len(idx)):
            if total + tail[j] < target - best[1] - 1e-9:
                return False  # even all that is left stays below what is already found
            a = amounts[idx[j]]
            if total + a > target + tolerance:
                continue
            chosen.append(idx[j])
            if go(j + 1, chosen, total + a):
                return True
            chosen.pop()
        return False

    go(0, [], 0.0)
    return (best[0], best[1]) if best[0] is not None else None


def least_subset(cents: list[int], target: int) -> list[int]:
    """Indices of the subset with the least sum of at least the target; all of them if none reaches it.

    Reachable sums are one big integer whose bit s stands for the sum s.
    """
    if sum(cents) < target:
        return list(range(len(cents)))
    reach = [1]
    for c in cents:
        reach.append(reach[-1] | reach[-1] << c)
    rest = target
    while not reach[-1] >> rest & 1:
        rest += 1
    out = []
    for i in range(len(cents) - 1, -1, -1):
        if not reach[i] >> rest & 1:
            out.append(i)
            rest -= cents[i]
    return out[::-1]


class Ride(NamedTuple):
    """A ride: its second (None if unreadable), its amount and the lower-cased provider."""

    at: int | None
    amount: float
    provider: str


class Match(NamedTuple):
    picks: list[int]
    kind: str
    diff: float
    rides: list[int]


class Pool:
    """The payments of a batch that are still free."""

    def __init__(self, pay: pd.DataFrame):
        pay = pay[pay["pay_amount"] > 0]
        at = pay["pay_time"].astype("Float64").fillna(NEVER).astype("int64").to_numpy()
        order = np.lexsort((pay["pay_pos"].to_numpy(), at))
        self.at, pay = at[order], pay.iloc[order]
        self.day = np.where(self.at == NEVER, NEVER, self.at // 86_400)
        self.readable = int((self.at < NEVER).sum())
        self.ids = pay["pay_id"].astype(str).tolist()
        self.amount, self.total = pay["pay_amount"].to_numpy(float), pay["pay_total"].to_numpy(float)
        self.name = pay["pay_merchant"].fillna("").str.lower().tolist()
        self.by_amount, self.by_total = (np.argsort(x, kind="stable") for x in (self.amount, self.total))
        self.amounts, self.totals = self.amount[self.by_amount], self.total[self.by_total]
        self.free = np.ones(len(self.at), bool)

    def take(self, picks: list[int]) -> None:
        self.free[picks] = False

    def _free(self, idx: np.ndarray) -> np.ndarray:
        return np.sort(idx[self.free[idx]])

    def between(self, least: float, most: float) -> np.ndarray:
        """Free payments by amount, both ends included."""
        return self._free(self.by_amount[np.searchsorted(self.amounts, least, "left") : np.searchsorted(self.amounts, most, "right")])

    def near(self, target: float, tolerance: float) -> np.ndarray:
        """Free payments whose amount or total is that near."""
        lo, hi = np.searchsorted(self.totals, [target - tolerance - 1e-9, target + tolerance + 1e-9])
        both = np.union1d(self.between(target - tolerance - 1e-9, target + tolerance + 1e-9), self._free(self.by_total[lo:hi]))
        return both[self.off(target, both) <= tolerance]

    def off(self, target: float, idx: np.ndarray) -> np.ndarray:
        return np.minimum(np.abs(target - self.total[idx]), np.abs(target - self.amount[idx]))

    def after(self, at: int) -> np.ndarray:
        """Free payments from then on for the hours in which a ride is paid."""
        lo, hi = np.searchsorted(self.at, [at, at + (HOURS + 1) * 3600])
        return self._free(np.arange(lo, hi))

    def until(self, day: int, idx: np.ndarray) -> np.ndarray:
        """Those paid on or before a day, and the unreadable ones."""
        return idx[(self.day[idx] <= day) | (self.day[idx] == NEVER)]

    # ------------------------------------------------------------ single payments

    def one(self, target: float, ref_day: int, tolerance: float, allowed=None) -> Match | None:
        """The payment near the target whose day is nearest, then the nearest amount, then the first."""
        idx = self.near(target, tolerance)
        if allowed is not None:
            idx = allowed(idx)
        if not len(idx):
            return None
        days = np.where(self.day[idx] == NEVER, NEVER, np.abs(self.day[idx] - ref_day))
        best = idx[np.lexsort((idx, self.off(target, idx), days))[0]]
        return Match([int(best)], "OneToOne", float(self.off(target, np.array([best]))[0]), [])

    def own_first(self, claim, tolerance: float) -> Match | None:
        """Like one(), first among the payments of the claim's own merchant."""
        paid = lambda idx: self.until(claim.day, idx)
        seller = claim.seller
        if seller:
            own = lambda idx: np.array([i for i in paid(idx) if seller in self.name[i] or self.name[i] in seller], np.int64)
            if got := self.one(claim.amount, claim.ref_day, tolerance, own):
                return got
        return self.one(claim.amount, claim.ref_day, tolerance, paid)

    # ------------------------------------------------------------ rides

    def best_for_ride(self, ride: Ride, used: set[int], merchant: str | None, tolerance: float) -> int | None:
        """A payment within the tolerance soonest after the ride; else one that exceeds it by no more than itself,
        on the same or the next day."""
        if ride.at is None:
            idx = self.between(min(ride.amount, 0.0) - tolerance if ride.amount <= 0 else ride.amount - tolerance, max(2 * ride.amount, ride.amount + tolerance))
        else:
            idx = np.append(self.after(ride.at), self._free(np.arange(self.readable, len(self.at))))
        idx = np.array([i for i in idx if i not in used and (merchant is None or merchant in self.name[i])], np.int64)
        if not len(idx):
            return None
        diff = self.amount[idx] - ride.amount
        hours = np.full(len(idx), 999) if ride.at is None else np.where(self.at[idx] == NEVER, 999, (self.at[idx] - ride.at) // 3600)
        fits = np.ones(len(idx), bool)
        if ride.amount > 0:
            fits = (self.amount[idx] / ride.amount >= 0.33) & (self.amount[idx] / ride.amount <= 3.0)
        exact = np.abs(diff) <= tolerance
        same_day = np.ones(len(idx), bool) if ride.at is None else (self.day[idx] == NEVER) | np.isin(self.day[idx] - ride.at // 86_400, (0, 1))
        tier = np.where(exact, 0, np.where((diff > 0) & (diff <= ride.amount) & same_day, 1, 2))
        ok = fits & (tier < 2)
        if not ok.any():
            return None
        order = np.lexsort((idx, np.abs(diff), hours, np.where(ok, tier, 9)))
        return int(idx[order[0]])

    def _first_or_any(self, ride: Ride, used: set[int], provider: str, tolerance: float) -> int | None:
        got = self.best_for_ride(ride, used, provider, tolerance) if provider else None
        return got if got is not None else self.best_for_ride(ride, used, None, tolerance)

    def pair_rides(self, rides: list[Ride], tolerance: float, retry: bool) -> dict[int, int]:
        """Payment of each ride. A first pass finds the merchant that most rides are paid to (of equally frequent ones
        the first by name), a second one pairs with that merchant only; ``retry`` gives what is left another try."""
        used: set[int] = set()
        merchants: Counter = Counter()
        for r in rides:
            got = self._first_or_any(r, used, rides[0].provider, tolerance)
            if got is not None:
                used.add(got)
                merchants[self.name[got]] += 1
        if not merchants:
            return {}
        merchant = min(merchants, key=lambda m: (-merchants[m], m))
        pairs: dict[int, int] = {}
        for k, r in enumerate(rides):
            got = self.best_for_ride(r, set(pairs.values()), merchant, tolerance) if merchant else None
            if got is not None:
                pairs[k] = got
        if retry:
            for k, r in enumerate(rides):
                if k not in pairs and (got := self._first_or_any(r, set(pairs.values()), rides[0].provider, tolerance)) is not None:
                    pairs[k] = got
        return dict(sorted(pairs.items()))

    def by_rides(self, rides: list[Ride], target: float, tolerance: float, partial: bool) -> Match | None:
        """Each ride its own payment; None unless all are paired, or any if ``partial``."""
        pairs = self.pair_rides(rides, tolerance, partial)
        if not pairs or (len(pairs) < len(rides) and not partial):
            return None
        picks = list(pairs.values())
        return Match(picks, "OneToMany", abs(target - float(self.amount[picks].sum())), list(pairs))

    def by_sum(self, rides: list[Ride], target: float, tolerance: float) -> Match | None:
        """Payments after the first ride whose sum is near the target."""
        idx = np.flatnonzero(self.free) if rides[0].at is None else self.after(rides[0].at)
        found = subset_near(target, self.amount[idx].tolist(), tolerance)
        return Match([int(idx[i]) for i in found[0]], "OneToMany", found[1], []) if found else None

    def with_unbilled_toll(self, ride: Ride) -> Match | None:
        """The payment that exceeds the first ride least, by no more than the ride, on its day or the next."""
        if ride.at is None:
            return None
        idx = self.between(ride.amount, 2 * ride.amount)
        idx = idx[(self.amount[idx] > ride.amount) & ((self.day[idx] == NEVER) | ((self.at[idx] >= ride.at) & np.isin(self.day[idx] - ride.at // 86_400, (0, 1))))]
        if not len(idx):
            return None
        best = int(idx[np.lexsort((idx, self.amount[idx]))[0]])
        return Match([best], "OneToOne", float(self.amount[best] - ride.amount), [])


class Claim(NamedTuple):
    batch: str
    inv_id: str
    amount: float
    day: int
    seller: str
    category: str
    pos: int
    rides: list[Ride]
    travel_day: int | None
    toll_at: int | None
    check_in: int | None

    @property
    def ref_day(self) -> int:
        """The day that payments are compared with: travel, toll, check-in or the claim's own."""
        days = (self.travel_day, None if self.toll_at is None else self.toll_at // 86_400, self.check_in)
        return next((d for d in days if d is not None), self.day)


def claims_of(inv: pd.DataFrame) -> list[Claim]:
    some = lambda x: None if x is None or pd.isna(x) else int(x)
    many = lambda x: list(x) if isinstance(x, (list, np.ndarray)) else []
    out = []
    for r in inv.itertuples():
        times, amounts, who = many(r.ride_times), many(r.ride_amounts), many(r.ride_providers)
        rides = [Ride(some(t), float(a or 0.0), (w or "").lower()) for t, a, w in zip(times, amounts, who)]
        out.append(Claim(str(r.batch), str(r.inv_id), float(r.inv_amount), some(r.inv_date) or 0, (r.inv_seller or "").lower(), r.category or "", r.inv_pos, rides, some(r.travel_day), some(r.toll_at), some(r.check_in)))
    return out


def nearest_trip(toll: Claim, trips: list[Claim], taken: set[str]) -> Claim | None:
    """The trip without a toll whose first ride is nearest to the toll's time; trips without a readable time come last."""
    at = toll.toll_at if toll.toll_at is not None else toll.day * 86_400
    free = [t for t in trips if t.inv_id not in taken]
    return min(free, key=lambda t: NEVER if t.rides[0].at is None else abs(t.rides[0].at - at), default=None)


def insurance(pool: Pool, claim: Claim, flights: list[tuple[int | None, int]], tolerance: float) -> Match | None:
    """An insurance with the flights of its batch, given as (second of payment or None, day of travel): paid in the same second;
    else between a flight's payment and its travel; else before the last travel; else before the claim."""
    one = lambda allowed: pool.one(claim.amount, claim.ref_day, tolerance, allowed)
    for at, _ in flights:
        if at is not None and (got := one(lambda idx, at=at: idx[pool.at[idx] == at])):
            return got

    def inside(idx: np.ndarray) -> np.ndarray:
        day = pool.day[idx]
        hit = np.zeros(len(idx), bool)
        for at, travel in flights:
            hit |= (day <= travel) & (day >= (-NEVER if at is None else at // 86_400))
        return idx[(day == NEVER) | (hit & (day <= claim.day))]

    if flights and (got := one(inside)):
        return got
    if flights and (got := one(lambda idx: pool.until(max(t for _, t in flights), idx))):
        return got
    return one(lambda idx: pool.until(claim.day, idx))


def match_batch(inv: pd.DataFrame, pay: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """One batch. Tolls first; a toll without a payment is put together with the nearest trip, whose payments then
    count for both; then the other claims by falling amount.

    Trips with several rides pair ride by ride, else take payments whose sum is near, else keep the rides that can
    be paired; a trip that finds nothing may have paid an unbilled toll. Times are seconds, days are days since 1970.
    """
    claims = sorted(claims_of(inv), key=lambda c: c.pos)
    pool = Pool(pay)
    tolls = [c for c in claims if c.category == "Toll"]
    others = [c for c in claims if c.category != "Toll"]
    trips = [c for c in others if c.category == "CityTransport" and c.rides]
    rows: list[tuple] = []
    flights: list[tuple[int | None, int]] = []

    def add(c: Claim, m: Match, shared_from: str | None = None, diff: float | None = None) -> None:
        pool.take(m.picks)
        rows.append((c.batch, c.inv_id, [pool.ids[i] for i in m.picks], m.kind, m.diff if diff is None else diff, m.rides, shared_from))
        if c.category == "Flight" and c.travel_day is not None:
            at = int(pool.at[m.picks[0]])
            flights.append((None if at == NEVER else at, c.travel_day))

    def trip(c: Claim, target: float) -> Match | None:
        first = pool.by_rides(c.rides, target, tolerance, False) if len(c.rides) > 1 else None
        return first or pool.by_sum(c.rides, target, tolerance)

    pending = []
    for c in tolls:
        got = pool.one(c.amount, c.ref_day, tolerance)
        if got:
            add(c, got)
        else:
            pending.append(c)
    linked: dict[str, str] = {}
    for c in pending:
        if near := nearest_trip(c, trips, set(linked.values())):
            linked[c.inv_id] = near.inv_id
    done: set[str] = set()
    for t in trips:
        for c in [c for c in pending if linked.get(c.inv_id) == t.inv_id]:
            got = trip(t, t.amount + c.amount)
            if got:
                paid = float(pool.amount[got.picks].sum())
                add(t, got, None, abs(t.amount - paid))
                add(c, Match(got.picks, "OneToOne", 0.0, []), t.inv_id)
                done |= {t.inv_id, c.inv_id}
            else:
                del linked[c.inv_id]
                if near := nearest_trip(c, trips, set(linked.values()) | done | {t.inv_id}):
                    linked[c.inv_id] = near.inv_id
    for c in sorted((c for c in others if c.inv_id not in done), key=lambda c: -c.amount):
        if c in trips:
            got = trip(c, c.amount) or (pool.by_rides(c.rides, c.amount, tolerance, True) if len(c.rides) > 1 else None) or pool.with_unbilled_toll(c.rides[0])
        elif c.category == "Insurance":
            known = {day for _, day in flights}
            later = list(dict.fromkeys(f.travel_day for f in others if f.category == "Flight" and f.travel_day is not None and f.travel_day not in known))
            got = insurance(pool, c, flights + [(None, d) for d in later], tolerance)
        else:
            got = pool.own_first(c, tolerance)
        if got:
            add(c, got)
    return pd.DataFrame(rows, columns=["batch", "inv_id", "pay_ids", "kind", "amount_diff", "rides", "shared_from"])


def match_batches(inv: DataFrame, pay: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """match_batch() for every batch.

    ``inv``: batch, inv_id, inv_amount, inv_date, inv_seller, category, inv_pos, rides (array of structs of a zone-less
    ``at``, ``amount`` and ``provider``), travel_date, toll_time, check_in; ``pay``: batch, pay_id, pay_time, pay_amount, pay_total,
    pay_merchant, pay_pos. Gives batch, inv_id, pay_ids, kind, amount_diff, rides (which ride each payment is for) and
    shared_from (the trip whose payments a toll shares) of the matched claims.
    """
    epoch = F.lit("1970-01-01")
    second = lambda t: F.timestamp_diff("SECOND", epoch.cast("timestamp_ntz"), t.cast("timestamp_ntz"))
    day = lambda c: F.datediff(c, epoch.cast("date"))
    inv = inv.select(
        "batch", "inv_id", "inv_amount", day("inv_date").alias("inv_date"), "inv_seller", "category", "inv_pos", F.transform("rides", lambda r: second(r["at"])).alias("ride_times"),
        F.col("rides.amount").alias("ride_amounts"), F.col("rides.provider").alias("ride_providers"), day("travel_date").alias("travel_day"), second(F.col("toll_time")).alias("toll_at"), day("check_in").alias("check_in"),
    )
    pay = pay.withColumn("pay_time", second(F.col("pay_time")))

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return match_batch(a, b, tolerance)

    return inv.filter("inv_amount is not null").groupBy("batch").cogroup(pay.groupBy("batch")).applyInPandas(run, OUT)
