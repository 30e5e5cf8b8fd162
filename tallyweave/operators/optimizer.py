"""Score-based matching of a batch, and the generator of data to time it with.

Claims are gone through in their order. A trip takes the first payments whose sum is near; any other claim takes the
free payment of the highest weighted score. Sure matches use their payments up at once; the others wait until
all claims were seen and then take what is still free. A claim whose payment was taken meanwhile stays unmatched.

Scores of all payments of a batch are arrays: names are scored once for each distinct pair, amounts, times and categories by numpy.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.text import AGREEING, BRANDS

WEIGHTS = (0.4, 0.3, 0.2, 0.1)  # amount, merchant, time, category
CANDIDATE, SURE = 0.5, 0.7
NEAR, MOST_PICKS = 5.0, 10
OUT = "batch string, inv_id string, pay_ids array<string>, kind string, amount_diff double, confidence double"


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@lru_cache(maxsize=1_000_000)
def name_score(seller: str, merchant: str) -> float:
    """Both lower-cased: equal 1, contained 0.9, close by edits their similarity, a shared brand 0.85, else 0."""
    if not seller or not merchant:
        return 0.0
    if seller == merchant:
        return 1.0
    if seller in merchant or merchant in seller:
        return 0.9
    long_ = max(len(seller), len(merchant))
    if abs(len(seller) - len(merchant)) < 0.3 * long_ and (like := 1 - edits(seller, merchant) / long_) > 0.7:
        return like
    return 0.85 if any(b in seller and b in merchant for b in BRANDS) else 0.0


@lru_cache(maxsize=100_000)
def kind_score(category: str, other: str) -> float:
    words = AGREEING.get(category)
    return 0.5 if words is None else float(any(w in other for w in words))


def first_subset(amounts: list[float], target: float) -> list[int] | None:
    """The first subset in depth-first order, of at most MOST_PICKS, whose sum is near the target."""
    left = np.concatenate([np.cumsum(np.maximum(amounts, 0.0)[::-1])[::-1], [0.0]]).tolist() if amounts else [0.0]
    path: list[int] = []
    total, k = 0.0, 0
    while True:
        if path and abs(target - total) <= NEAR:
            return path
        if len(path) < MOST_PICKS and total <= target + NEAR and k < len(amounts) and total + left[k] >= target - NEAR:
            path.append(k)
            total += amounts[k]
            k += 1
        elif path:
            k = path.pop() + 1
            total -= amounts[k - 1]
        else:
            return None


def optimize_batch(inv: pd.DataFrame, pay: pd.DataFrame) -> pd.DataFrame:
    """One batch; dates are days since 1970, a missing one scores half."""
    inv, pay = inv.sort_values("inv_pos", kind="stable"), pay.sort_values("pay_pos", kind="stable")
    amount, total = pay["pay_amount"].to_numpy(float), pay["pay_total"].to_numpy(float)
    day = pay["pay_day"].astype("Float64").to_numpy(float, na_value=np.nan)
    name_no, names = pd.factorize(pay["pay_merchant"].fillna("").str.lower())
    kind_no, kinds = pd.factorize(pay["pay_category"].fillna("").str.lower())
    ids = pay["pay_id"].astype(str).tolist()
    free = np.ones(len(ids), bool)
    rows, waiting = [], []

    def near(a: np.ndarray, b: float) -> np.ndarray:
        off = np.abs(a - b)
        return np.where(off == 0, 1.0, np.where(off <= NEAR, 1 - off / NEAR * 0.5, 0.0))

    for r in inv.itertuples():
        target = float(r.inv_amount)
        if r.category == "CityTransport" and r.has_rides:
            at = np.flatnonzero(free & (amount <= target + NEAR))
            found = first_subset(amount[at].tolist(), target)
            if found is None:
                continue
            picks, kind = at[found], "OneToMany"
            diff = abs(target - amount[picks].sum())
            sure = 1 - max(diff, 0.01) / max(target, 0.01)
        else:
            by_name = np.array([name_score((r.inv_seller or "").lower(), n) for n in names])
            by_kind = np.array([kind_score(r.category or "", k) for k in kinds])
            days = np.abs(day - (np.nan if pd.isna(r.inv_day) else r.inv_day))
            time = np.select([np.isnan(days), days == 0, days <= 1, days <= 3, days <= 7], [0.5, 1.0, 0.9, 0.7, 0.5], 0.0)
            score = WEIGHTS[0] * np.maximum(near(total, target), near(amount, target)) + WEIGHTS[1] * by_name[name_no] + WEIGHTS[2] * time + WEIGHTS[3] * by_kind[kind_no]
            score = np.where(free, score, -1.0)
            if not len(score) or score.max() < CANDIDATE:
                continue
            picks, kind = np.array([score.argmax()]), "OneToOne"
            sure = float(score.max())
            diff = min(abs(target - total[picks[0]]), abs(target - amount[picks[0]]))
        if sure >= SURE:
            free[picks] = False
            rows.append((str(r.batch), str(r.inv_id), [ids[i] for i in picks], kind, float(diff), float(sure)))
        else:
            waiting.append((r, int(picks[0])))
    for r, pick in waiting:
        if free[pick]:
            free[pick] = False
            rows.append((str(r.batch), str(r.inv_id), [ids[pick]], "OneToOne", 0.0, CANDIDATE))
    return pd.DataFrame(rows, columns=["batch", "inv_id", "pay_ids", "kind", "amount_diff", "confidence"])


def optimize(inv: DataFrame, pay: DataFrame) -> DataFrame:
    """optimize_batch() for every batch of claims and payments."""
    return inv.groupBy("batch").cogroup(pay.groupBy("batch")).applyInPandas(lambda key, a, b: optimize_batch(a, b), OUT)


def match_rate(matched: int, claims: int) -> float:
    return matched / claims if claims else 0.0


# ---------------------------------------------------------------- generated data

# Sellers, merchants and base amounts (least, spread) of the generated claims and payments.
SELLERS = ("如家酒店", "汉庭酒店", "滴滴出行", "高德打车", "肯德基", "麦当劳", "中国国航", "12306")
MERCHANTS = ("如家快捷酒店", "汉庭酒店", "滴滴出行科技有限公司", "高德软件有限公司", "肯德基餐厅", "麦当劳餐厅", "中国国际航空", "铁路12306")
PAID_FOR = ("住宿", "酒店", "交通", "出行", "餐饮", "快餐", "航空", "火车票")
CATEGORIES = (("Hotel", 200, 500), ("CityTransport", 20, 80), ("Meal", 30, 100), ("Flight", 500, 2000), ("Train", 100, 500), ("Other", 50, 200))
PRICES = ((200, 500), (200, 500), (20, 80), (20, 80), (30, 100), (30, 100), (500, 2000), (100, 500))


def _nth(values: tuple, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def generated_claims(spark: SparkSession, n: int, batch: Column | None = None) -> DataFrame:
    """n claims: batch, inv_id, inv_amount, inv_day, inv_seller, category, has_rides, inv_pos."""
    i = F.col("id")
    base, spread = _nth(tuple(c[1] for c in CATEGORIES), i), _nth(tuple(c[2] for c in CATEGORIES), i)
    kind = _nth(tuple(c[0] for c in CATEGORIES), i)
    start = F.datediff(F.lit("2025-01-01").cast("date"), F.lit("1970-01-01").cast("date"))
    return spark.range(n).select((F.lit("g") if batch is None else batch).alias("batch"), F.concat(F.lit("inv-"), i).alias("inv_id"), (base + i % spread).cast("double").alias("inv_amount"), (start + i % 28).cast("int").alias("inv_day"), _nth(SELLERS, i).alias("inv_seller"), kind.alias("category"), (kind == "CityTransport").alias("has_rides"), i.alias("inv_pos"))


def generated_payments(spark: SparkSession, n: int, batch: Column | None = None) -> DataFrame:
    """n payments: batch, pay_id, pay_amount, pay_total, pay_day, pay_merchant, pay_category, pay_pos."""
    i = F.col("id")
    price = (_nth(tuple(p[0] for p in PRICES), i) + i % _nth(tuple(p[1] for p in PRICES), i)).cast("double")
    start = F.datediff(F.lit("2025-01-01").cast("date"), F.lit("1970-01-01").cast("date"))
    return spark.range(n).select((F.lit("g") if batch is None else batch).alias("batch"), F.concat(F.lit("pay-"), i).alias("pay_id"), price.alias("pay_amount"), price.alias("pay_total"), (start + i % 28).cast("int").alias("pay_day"), _nth(MERCHANTS, i).alias("pay_merchant"), _nth(PAID_FOR, i).alias("pay_category"), i.alias("pay_pos"))


def generated_pairs(spark: SparkSession, claims: int, payments: int) -> tuple[DataFrame, DataFrame]:
    """Claims and payments of which the first ones have the amount and day of the claim with their number."""
    inv, pay = generated_claims(spark, claims), generated_payments(spark, payments)
    own = inv.select(F.col("inv_pos").alias("pay_pos"), "inv_amount", "inv_day")
    paired = pay.join(own, "pay_pos", "left").withColumns({"pay_amount": F.coalesce("inv_amount", "pay_amount"), "pay_total": F.coalesce("inv_amount", "pay_total"), "pay_day": F.coalesce("inv_day", "pay_day")})
    return inv, paired.select(*pay.columns)
