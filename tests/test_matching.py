import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from tallyweave.operators import assign, layout, matching, records


def frames(spark, inv, pay):
    i = spark.createDataFrame(inv, "inv_id string, inv_amount double, inv_date string").withColumn("inv_date", F.to_date("inv_date"))
    p = spark.createDataFrame(pay, "pay_id string, pay_amount double, pay_time string, pay_pos int").withColumn("pay_time", F.to_timestamp("pay_time")).withColumn("pay_total", F.col("pay_amount"))
    return i, p


def test_nearest(spark):
    i, p = frames(spark, [("a", 100.0, "2025-01-10"), ("b", 5.0, "2025-01-10")], [("p1", 50.0, "2025-01-10 10:00:00", 1), ("p2", 100.5, "2025-01-11 10:00:00", 2), ("p3", 99.5, "2025-01-10 08:00:00", 3), ("p4", 100.0, None, 0)])
    got = matching.nearest_match(i, p, 1.0).collect()
    assert [(r["inv_id"], r["pay_id"], r["days"]) for r in got] == [("a", "p3", 0)]


def test_one_per_payment_is_greedy(spark):
    rng = random.Random(4)
    for _ in range(3):
        inv = [(f"i{k}", float(rng.randint(1, 6)), "2025-01-10") for k in range(9)]
        pay = [(f"p{k}", float(rng.randint(1, 6)), f"2025-01-{rng.randint(5, 15):02d} 00:00:00", k) for k in range(9)]
        i, p = frames(spark, inv, pay)
        c = matching.tolerance_candidates(i, p, 1.0).withColumn("days", F.abs(F.datediff("inv_date", F.to_date("pay_time"))))
        rows = {}
        for r in c.collect():
            rows.setdefault(r["inv_id"], []).append((r["days"], r["amount_diff"], r["pay_pos"], r["pay_id"]))
        want, used = {}, set()
        for inv_id, amount, _ in sorted(inv, key=lambda x: (-x[1], x[0])):
            for *_, pid in sorted(rows.get(inv_id, [])):
                if pid not in used:
                    used.add(pid)
                    want[inv_id] = pid
                    break
        got = matching.one_per_payment(c, [F.asc("days"), F.asc("amount_diff"), F.asc("pay_pos")], [-F.col("inv_amount"), F.col("inv_id")])
        assert {r["inv_id"]: r["pay_id"] for r in got.collect()} == want


def test_subset():
    assert assign.subset_near(100, [30, 40, 30.5, 500], 1.0) == ([0, 1, 2], 0.5)
    assert assign.subset_near(100, [10, 20], 1.0) is None
    rng = random.Random(1)
    for _ in range(200):
        a, t = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))], rng.randint(5, 80)
        best = min((abs(t - sum(s)) for n in range(1, len(a) + 1) for s in itertools.combinations(a, n)), default=99)
        got = assign.subset_near(t, a, 2.0)
        assert (got is None) == (best > 2) and (got is None or (got[1] == best and abs(t - sum(a[i] for i in got[0])) == best))


def test_least_subset():
    c = [150, 90, 140, 80, 120, 80]
    assert sum(c[i] for i in assign.least_subset(c, 260)) == 260 and assign.least_subset([30, 15], 50) == [0, 1]


def sec(text):
    return None if text is None else int(pd.Timestamp(text).timestamp())


def claim(inv_id, amount, date="2025-01-10", seller="", category="Meal", pos=1, rides=(), travel=None, toll=None, check_in=None):
    at, amounts, who = ([list(x) for x in zip(*rides)] if rides else ([], [], []))
    return ("b", inv_id, amount, sec(date) // 86_400, seller, category, pos, [sec(t) for t in at], amounts, who, None if travel is None else sec(travel) // 86_400, sec(toll), None if check_in is None else sec(check_in) // 86_400)


def batch(inv, pay):
    i = pd.DataFrame(inv, columns=["batch", "inv_id", "inv_amount", "inv_date", "inv_seller", "category", "inv_pos", "ride_times", "ride_amounts", "ride_providers", "travel_day", "toll_at", "check_in"])
    p = pd.DataFrame([("b", f"p{k}", sec(t), a, a, m, k) for k, (t, a, m) in enumerate(pay)], columns=["batch", "pay_id", "pay_time", "pay_amount", "pay_total", "pay_merchant", "pay_pos"])
    return {r.inv_id: r for r in assign.match_batch(i, p, 1.0).itertuples()}


def test_batch_phases():
    pay = [("2025-01-10 12:00", 500.0, "酒店"), ("2025-01-10 13:00", 150.0, "餐"), ("2025-01-10 09:00", 30.0, "滴滴"), ("2025-01-10 10:00", 40.0, "滴滴"), ("2025-01-10 11:00", 30.0, "滴滴")]
    got = batch([claim("hotel", 500.0, seller="某酒店", category="Hotel"), claim("meal", 150.0, pos=2), claim("ride", 100.0, category="CityTransport", pos=3, rides=[("2025-01-10 08:30", 100.0, "")])], pay)
    assert {k: (r.pay_ids, r.kind) for k, r in got.items()} == {"hotel": (["p0"], "OneToOne"), "meal": (["p1"], "OneToOne"), "ride": (["p2", "p3", "p4"], "OneToMany")}
    got = batch([claim("r", 90.0, category="CityTransport", rides=[("2025-01-10 09:00", 30.0, ""), ("2025-01-10 10:00", 40.0, "")])], pay)
    assert got["r"].pay_ids == ["p2", "p3"] and got["r"].rides == [0, 1]


def test_rides_keep_to_the_merchant_of_most():
    pay = [("2025-01-10 08:10", 20.0, "甲车"), ("2025-01-10 09:10", 30.0, "甲车"), ("2025-01-10 10:05", 40.0, "乙店"), ("2025-01-10 10:30", 40.0, "甲车")]
    rides = [("2025-01-10 08:00", 20.0, ""), ("2025-01-10 09:00", 30.0, ""), ("2025-01-10 10:00", 40.0, "")]
    assert batch([claim("r", 90.0, category="CityTransport", rides=rides)], pay)["r"].pay_ids == ["p0", "p1", "p3"]
    # without that merchant's third payment the whole pairing fails, no sum is near, and the other merchant's one is taken at last
    assert batch([claim("r", 300.0, category="CityTransport", rides=rides)], pay[:3])["r"].pay_ids == ["p0", "p1", "p2"]
    part = batch([claim("r", 300.0, category="CityTransport", rides=rides)], pay[:2])["r"]
    assert part.pay_ids == ["p0", "p1"] and part.rides == [0, 1] and part.amount_diff == 250.0


def test_toll_with_the_nearest_trip():
    rides = lambda t: [(t, 50.0, "")]
    pay = [("2025-01-10 09:00", 62.0, "甲"), ("2025-01-11 09:00", 50.0, "乙")]
    inv = [claim("far", 50.0, category="CityTransport", pos=1, rides=rides("2025-01-11 08:30")), claim("near", 50.0, category="CityTransport", pos=2, rides=rides("2025-01-10 08:30")), claim("toll", 12.0, category="Toll", pos=3, toll="2025-01-10 08:40")]
    got = batch(inv, pay)
    assert got["toll"].shared_from == "near" and got["toll"].pay_ids == got["near"].pay_ids == ["p0"] and got["near"].amount_diff == 12.0 and got["far"].pay_ids == ["p1"]
    assert batch([claim("t", 50.0, category="CityTransport", rides=rides("2025-01-10 08:30"))], [("2025-01-10 09:00", 80.0, "甲")])["t"].amount_diff == 30.0
    assert batch([claim("t", 50.0, category="CityTransport", rides=rides("2025-01-10 08:30"))], [("2025-01-12 09:00", 80.0, "甲")]) == {}


def test_insurance_follows_its_flight():
    flight = claim("f", 900.0, date="2025-02-01", category="Flight", travel="2025-01-20")
    cover = claim("i", 30.0, date="2025-02-01", category="Insurance", pos=2)
    pay = [("2025-01-31 08:00", 30.0, "丙"), ("2025-01-05 10:00", 900.0, "航"), ("2025-01-05 10:00", 30.0, "保"), ("2025-01-10 10:00", 30.0, "丁")]
    assert batch([flight, cover], pay)["i"].pay_ids == ["p2"]  # the same second
    assert batch([flight, cover], [pay[0], pay[1], pay[3]])["i"].pay_ids == ["p2"]  # between payment and travel
    assert batch([flight, cover], [pay[1], pay[0]])["i"].pay_ids == ["p1"]  # before the claim
    assert "i" not in batch([flight, cover], [pay[1], ("2025-02-02 08:00", 30.0, "丙")])


def test_pool_against_plain_loops():
    import random

    rng = random.Random(5)
    pay = pd.DataFrame([("b", f"p{k}", rng.choice([None, 1_700_000_000 + rng.randint(0, 90_000)]), rng.randint(-5, 60) / 1.0, rng.randint(1, 60) / 1.0, rng.choice(["甲", "乙", ""]), k) for k in range(150)], columns=["batch", "pay_id", "pay_time", "pay_amount", "pay_total", "pay_merchant", "pay_pos"])
    pool = assign.Pool(pay)
    for _ in range(200):
        target, day = float(rng.randint(1, 60)), 19_675 + rng.randint(0, 2)
        got = pool.one(target, day, 1.0)
        near = [i for i in range(len(pool.ids)) if pool.free[i] and min(abs(target - pool.total[i]), abs(target - pool.amount[i])) <= 1.0]
        key = lambda i: (assign.NEVER if pool.day[i] == assign.NEVER else abs(pool.day[i] - day), min(abs(target - pool.total[i]), abs(target - pool.amount[i])), i)
        assert (got.picks[0] if got else None) == min(near, key=key, default=None)
        if got and rng.random() < 0.3:
            pool.take(got.picks)


def test_refunds(spark):
    rows = [(1, "A1", "M1", 800.25), (2, "A1_r", "M1", -300.15), (3, "B1", "", 10.0), (4, "B1*2", "", -10.0), (5, "C", "M3", 5.0), (6, "X", "M9", -1.0)]
    got = records.net_refunds(spark.createDataFrame(rows, "pos int, trade_id string, merchant_order string, amount double")).collect()
    assert sorted((r["trade_id"], round(r["net"], 2)) for r in got) == [("A1", 500.1), ("C", 5.0)]


def legs(spark, rows):
    return spark.createDataFrame([(1, f"t{k + 1}", a, b, d, k) for k, (a, b, d) in enumerate(rows)], "who int, id string, departure string, arrival string, d string, pos int").withColumn("travel_date", F.to_date("d"))


def test_trips(spark):
    cases = [
        ([("长沙", "上海", "2025-05-20"), ("上海", "长沙", "2025-05-22")], None, [("上海", ["t1", "t2"])], []),
        ([("长沙", "武汉", "2025-05-20"), ("武汉", "北京", "2025-05-21"), ("北京", "长沙", "2025-05-22")], None, [("北京", ["t1", "t2", "t3"])], []),
        ([("长沙", "武汉", "2025-05-20"), ("北京", "长沙", "2025-05-22")], None, [], ["t1", "t2"]),
        ([("长沙", "武汉", "2025-05-20"), ("北京", "长沙", "2025-05-22")], "长沙", [("北京", ["t1", "t2"])], []),
        ([("长沙", "上海", "2025-05-20"), ("苏州", "上海", "2025-05-21"), ("上海", "长沙", "2025-05-22")], "长沙", [("上海", ["t1", "t3"])], ["t2"]),
        ([("长沙", "武汉", "2025-05-20"), ("长沙", "北京", "2025-05-25"), ("北京", "长沙", "2025-05-27")], "长沙", [("北京", ["t2", "t3"])], ["t1"]),
    ]
    for rows, origin, trips, rest in cases:
        r = records.trips(legs(spark, rows), "who", origin).first()
        assert [(t["dest"], list(t["ids"])) for t in r["trips"]] == trips and sorted(r["unassigned"]) == rest


def test_layout(spark):
    w = [("d", 1, 0, "甲", 0.0, 0.0, 10.0, 10.0), ("d", 1, 1, "乙", 12.0, 1.0, 20.0, 11.0), ("d", 1, 2, "丙", 200.0, 0.0, 210.0, 10.0), ("d", 1, 3, "丁", 0.0, 50.0, 10.0, 60.0)]
    words = spark.createDataFrame(w, "doc_id string, page int, seq int, text string, x0 double, top double, x1 double, bottom double")
    assert sorted((r["line_no"], r["part_no"], r["text"]) for r in layout.lines(words).collect()) == [(0, 0, "甲乙"), (0, 1, "丙"), (1, 0, "丁")]
    assert layout.column_split(words).first()["split_x"] == 110.0
    cells = spark.createDataFrame([("d", 1, 0, 0, 0, -1.0, -1.0, 30.0, 20.0)], "doc_id string, page int, table_no int, row_no int, col_no int, x0 double, top double, x1 double, bottom double")
    assert [r["text"] for r in layout.words_in_cells(words, cells).collect()] == ["甲乙"]
    assert sum(r["words"] for r in layout.bands(words).collect()) == 4


def test_rides_in_text(spark):
    docs = spark.createDataFrame([("a", "2025-01-02 08:30 甲地 ¥12.50\n合计 12.50"), ("b", "01-03 09:00 起点\n终点\n 33.00"), ("c", None), ("d", "")], "doc_id string, text string")
    got = sorted((r["doc_id"], r["time"], r["amount"]) for r in layout.rides_in_text(docs).collect())
    assert got == [("a", "2025-01-02 08:30", 12.5), ("b", "01-03 09:00", 33.0)]


def greedy(rows):
    """Claims in order of priority, each taking its best payment that is free."""
    used, out = set(), []
    for inv in sorted({r[0] for r in rows}):
        best = min(((r[2], r[1]) for r in rows if r[0] == inv and r[1] not in used), default=None)
        if best:
            used.add(best[1])
            out.append((inv, best[1]))
    return out


def test_assignment_settles_on_any_chain(spark):
    import random

    rng = random.Random(3)
    chain = [(k, k, 1) for k in range(1, 121)] + [(k, k - 1, 0) for k in range(2, 121)]  # each claim is refused by the payment before it
    some = [(i, p, rng.randint(0, 9)) for i in range(60) for p in rng.sample(range(25), 4)]
    for rows in (chain, some, []):
        c = spark.createDataFrame(rows, "inv_id int, pay_id int, w int")
        for few in (0, 40, 100_000):
            got = matching.one_per_payment(c, [F.asc("w"), F.asc("pay_id")], [F.col("inv_id")], few=few)
            assert sorted((r["inv_id"], r["pay_id"]) for r in got.collect()) == greedy(rows), few


def test_optimizer(spark):
    from tallyweave.operators import optimizer

    inv, pay = optimizer.generated_pairs(spark, 100, 1000)
    got = optimizer.optimize(inv, pay).toPandas()
    used = [p for ids in got["pay_ids"] for p in ids]
    assert len(got) > 80 and len(used) == len(set(used)) and (got["confidence"] >= 0.7).sum() > 80 and optimizer.match_rate(len(got), 100) == len(got) / 100
    scarce = optimizer.optimize(*optimizer.generated_pairs(spark, 100, 50)).toPandas()
    assert 40 <= len(scarce) <= 60
    assert optimizer.first_subset([30.0, 50.0, 21.0], 50.0) == [0, 2] and optimizer.first_subset([], 5.0) is None and optimizer.first_subset([100.0], 5.0) is None
    assert optimizer.name_score("如家快捷上海分店甲", "北京如家二店乙") == 0.85 and optimizer.edits("kitten", "sitting") == 3


def test_nearest_in_time_in_slices(spark):
    import random

    rng = random.Random(2)
    left = [("hot", k, float(rng.randint(0, 3000))) for k in range(120)] + [("cold", 500, 5.0), ("none", 501, 5.0)]
    right = [("hot", k, float(rng.randint(0, 3000))) for k in range(60)] + [("hot", 90, 100.0), ("hot", 91, 100.0), ("cold", 95, 9.0)]
    at = lambda rows, i: spark.createDataFrame(rows, f"k string, {i} int, s double").withColumn(f"{i}_t", F.timestamp_seconds("s")).drop("s")
    got = [sorted((r["k"], r["l"], r["r"]) for r in matching.nearest_in_time(at(left, "l"), at(right, "r"), ["k"], "l_t", "r_t", "l", "r", hot=h).collect()) for h in (10**6, 40, 5)]
    gap = {(k, i): min(abs(s - t) for q, _, t in right if q == k) for k, i, s in left if k != "none"}
    assert all({(k, i) for k, i, _ in g} == set(gap) for g in got)
    time_l, time_r = {i: s for _, i, s in left}, {i: s for _, i, s in right}
    assert all(abs(time_l[i] - time_r[r]) == gap[k, i] for g in got for k, i, r in g)


def test_pairs_that_cannot_reach_the_score_are_left_out(spark):
    rng = random.Random(8)
    cents = lambda: rng.choice([100.0, 100.001, 100.3, 100.9, 101.0])
    day = lambda: rng.choice([None, "2025-01-01", "2025-01-05", "2025-01-20", "2025-03-01"])
    names = ["Moon Inn", "Moon Inn Two", "Taxi North", "Taxi Nord", "滴滴出行", "滴滴", "", None]
    inv = [(f"i{k}", cents(), day(), rng.choice(names), rng.choice(["Hotel", "Meal", "Other"])) for k in range(60)]
    pay = [(f"p{k:03}", cents(), day(), k, rng.choice(names), rng.choice(["酒店旅游", "餐饮美食", "x"])) for k in range(120)]
    i, p = frames(spark, [x[:3] for x in inv], [x[:4] for x in pay])
    i = i.join(spark.createDataFrame([(x[0], *x[3:]) for x in inv], "inv_id string, inv_seller string, inv_category string"), "inv_id")
    p = p.join(spark.createDataFrame([(x[0], *x[4:]) for x in pay], "pay_id string, pay_merchant string, pay_category string"), "pay_id")
    places = lambda pairs: sorted(map(tuple, matching.top_scored(matching.score_pairs(pairs), []).select("inv_id", "pay_id", "place", "total_score").collect()))
    every = matching.tolerance_candidates(i, p, 1.0).cache()
    want, n = places(every), every.count()
    assert len(want) > 100
    for most in (matching.NAMES, 2):  # with 2 nothing is known of the names
        some = matching.tolerance_candidates(*matching.mark_alike(i, p, most), 1.0).filter(matching.can_reach(0.5)).cache()
        assert places(some) == want and (some.count() < n) == (most > 2)


def test_one_per_payment_by_amount_writes_no_pairs(spark):
    rng = random.Random(6)
    day = lambda: rng.choice([None, *[f"2025-01-{k:02d}" for k in (3, 9, 10, 15)]])
    for spread in (6, 60):
        inv = [(f"i{k:03}", rng.randint(1, spread) + rng.choice([0.0, 0.0, 0.5, 1e-3]), day()) for k in range(90)] + [("far", 1e6, "2025-01-10"), ("none", None, None), ("nan", float("nan"), None)]
        pay = [(f"p{k}", float(rng.randint(1, spread)), day(), k) for k in range(150)] + [("q", None, None, 999)]
        i, p = frames(spark, inv, pay)
        p = p.withColumn("pay_total", F.when(F.crc32("pay_id") % 5 > 0, F.col("pay_amount") * (1 + F.crc32("pay_id") % 4 / 10)))
        rows = {}
        for r in i.crossJoin(p).withColumn("diff", F.least(F.abs(F.col("inv_amount") - F.col("pay_amount")), F.abs(F.col("inv_amount") - F.col("pay_total")))).filter("diff <= 1").withColumn("days", F.abs(F.datediff("inv_date", F.to_date("pay_time")))).collect():
            rows.setdefault(r["inv_id"], []).append((r["days"] is None, r["days"] or 0, r["diff"], r["pay_id"]))
        want, used = {}, set()
        for inv_id in sorted(rows, key=lambda x: (-dict((q[0], q[1]) for q in inv)[x], x)):
            best = next((x for x in sorted(rows[inv_id]) if x[3] not in used), None)
            if best:
                used.add(best[3])
                want[inv_id] = (best[3], None if best[0] else best[1])
        for stretch in (10**6, 7):
            got = matching.one_per_payment_by_amount(i, p, 1.0, stretch).collect()
            assert len(got) == len(want) > 40 and {r["inv_id"]: (r["pay_id"], r["days"]) for r in got} == want


def test_parts_of_scores_are_worked_out_once_a_row(spark):
    rng = random.Random(12)
    cents = lambda: rng.choice([100.0, 100.001, 100.3, 100.9, 101.0, None, float("nan")])
    day = lambda: rng.choice([None, "2025-01-01", "2025-01-05", "2025-01-20"])
    inv = [(f"i{k}", cents(), day(), rng.choice(["Hotel", "Meal", "Train", "Flight", "CityTransport", "Other", None])) for k in range(50)]
    pay = [(f"p{k:03}", cents(), day(), k, rng.choice(["酒店旅游", "餐饮美食", "滴滴 高铁", "饭店", "x", "", None])) for k in range(70)]
    i, p = frames(spark, [x[:3] for x in inv], [x[:4] for x in pay])
    i = i.join(spark.createDataFrame([(x[0], x[3], "A") for x in inv], "inv_id string, inv_category string, inv_seller string"), "inv_id")
    p = p.join(spark.createDataFrame([(x[0], x[4], "B") for x in pay], "pay_id string, pay_category string, pay_merchant string"), "pay_id")
    p = p.withColumn("pay_total", F.when(F.crc32("pay_id") % 4 > 0, F.col("pay_amount") + F.crc32("pay_id") % 3 * 0.2))
    cols = ["inv_id", "pay_id", "amount_score", "merchant_score", "time_score", "category_score", "total_score"]
    rows = lambda a, b: sorted(map(tuple, matching.score_pairs(a.crossJoin(b)).select(*cols).collect()))
    want, got = rows(i, p), rows(*matching.mark_parts(i, p))
    assert got == want and len({x[5] for x in want}) == 3
    off = lambda c: matching.amount_score(F.abs(F.col("inv_amount") - F.col(c)))
    two = F.greatest(off("pay_total"), off("pay_amount"))  # the score of each difference by itself
    each = {(r[0], r[1]): r[2] for r in i.crossJoin(p).select("inv_id", "pay_id", two).collect()}
    assert all(each[x[0], x[1]] == x[2] for x in want)
    plan = matching.score_pairs(matching.tolerance_candidates(*matching.mark_parts(i, p), 1.0)).select("inv_id", "pay_id", "total_score")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join Inner")[0]
    assert "total_score" in joined and "酒店" not in joined and "酒店" in plan
