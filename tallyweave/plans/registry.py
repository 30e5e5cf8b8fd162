"""The registered queries of the core, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions import dates, fields, routing, stays, text
from tallyweave.operators import assign, documents, invoice_cells, layout, matching, optimizer, records, regions, rejects, rides, summaries, zoned_time
from tallyweave.plans import views
from tallyweave.sources import bills
from tallyweave.streaming.arrivals import windowed_totals
from tallyweave.tables import shared_dir, table

BOTH = f"inv as ({views.CLAIMS_SQL}), pay as ({views.PAYMENTS_SQL})"
RIDES = f"ride as ({views.RIDES_SQL}), rpay as ({views.RIDE_PAY_SQL})"
DIFF = "least(abs(inv_amount - pay_amount), abs(inv_amount - pay_total))"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL it is compared with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- matching


@query(f"with {BOTH} select inv_id, pay_id, cast(round({DIFF} * 100) as bigint) as diff_cents from inv, pay where {DIFF} <= 1.0")
def q_tolerance_candidates(spark, sf_dir):
    c = matching.tolerance_candidates(views.claims(spark, sf_dir), views.payments(spark, sf_dir), 1.0)
    return c.select("inv_id", "pay_id", F.round(F.col("amount_diff") * 100).cast("bigint").alias("diff_cents"))


_NEAREST = f"""with {BOTH}, c as (select *, {DIFF} as d, abs(date_diff('day', cast(pay_time as date), inv_date)) as days from inv, pay where {DIFF} <= 1.0 {{more}}),
r as (select *, row_number() over (partition by inv_id order by days nulls last, d, pay_id) as n from c)
select inv_id, pay_id, cast(days as int) as days, cast(round(d * 100) as bigint) as diff_cents from r where n = 1"""


def _nearest(spark, sf_dir, before):
    m = matching.nearest_match(views.claims(spark, sf_dir), views.payments(spark, sf_dir), 1.0, paid_before=before)
    return m.select("inv_id", "pay_id", "days", F.round(F.col("amount_diff") * 100).cast("bigint").alias("diff_cents"))


@query(_NEAREST.format(more=""))
def q_tolerance_match(spark, sf_dir):
    return _nearest(spark, sf_dir, False)


@query(_NEAREST.format(more="and cast(pay_time as date) <= inv_date"))
def q_paid_before_match(spark, sf_dir):
    return _nearest(spark, sf_dir, True)


@query(_NEAREST.format(more="").split("select inv_id, pay_id, cast(days")[0] + ", m as (select pay_id from r where n = 1) select pay_id from pay where pay_id not in (select pay_id from m)")
def q_leftover_payments(spark, sf_dir):
    return views.payments(spark, sf_dir).select("pay_id").join(_nearest(spark, sf_dir, False), "pay_id", "left_anti")


_ROUNDS_OF_BEST = f"""with recursive {BOTH}, c as (select inv_id, pay_id, cast(days as int) as days, row_number() over (partition by inv_id order by days, d, pay_id) as r, dense_rank() over (order by -inv_amount, inv_id) as p
  from (select *, {DIFF} as d, abs(date_diff('day', cast(pay_time as date), inv_date)) as days from inv, pay where {DIFF} <= 1.0)),
l as (select *, false as taken from c union all
  select inv_id, pay_id, days, r, p, best from (select *, bool_or(best) over (partition by inv_id) as i, bool_or(best) over (partition by pay_id) as q
    from (select *, row_number() over (partition by inv_id order by r) = 1 and row_number() over (partition by pay_id order by p) = 1 as best from l where not taken)) where best or not (i or q))
select inv_id, pay_id, days from l where taken"""


@query(_ROUNDS_OF_BEST)
def q_one_per_payment(spark, sf_dir):
    return matching.one_per_payment_by_amount(views.claims(spark, sf_dir), views.payments(spark, sf_dir), 1.0)


_CATEGORY = "case inv_id % 5 when 0 then 'Hotel' when 1 then 'CityTransport' when 2 then 'Meal' when 3 then 'Train' else 'Other' end"
_PAID_FOR = "case line_no % 3 when 0 then '酒店旅游' when 1 then '交通出行' else '餐饮美食' end"
_BRAND_SQL = " or ".join(f"(contains(s, '{b}') and contains(m, '{b}'))" for b in text.BRANDS)
_AGREE_SQL = "case cat " + " ".join(f"when '{c}' then case when {' or '.join(f'contains(lower(pcat), {chr(39)}{w}{chr(39)})' for w in ws)} then 1.0 else 0.0 end" for c, ws in text.AGREEING.items()) + " else 0.5 end"
_SCORE_SQL = f"""with {BOTH}, p as (select inv.*, pay.*, lower('Seller ' || (inv_id % 97)) as s, lower('Supplier#' || supp % 97) as m, {_CATEGORY} as cat, {_PAID_FOR} as pcat,
  abs(date_diff('day', cast(pay_time as date), inv_date)) as days, 1 - levenshtein(lower('Seller ' || (inv_id % 97)), lower('Supplier#' || supp % 97)) / greatest(length('Seller ' || (inv_id % 97)), length('Supplier#' || supp % 97))::double as lev
  from inv, pay where {DIFF} <= 1.0),
q as (select inv_id, pay_id,
  greatest(case when abs(inv_amount - pay_total) = 0 then 1.0 when abs(inv_amount - pay_total) <= 5 then 1 - abs(inv_amount - pay_total) / 5 * 0.5 else 0 end,
           case when abs(inv_amount - pay_amount) = 0 then 1.0 when abs(inv_amount - pay_amount) <= 5 then 1 - abs(inv_amount - pay_amount) / 5 * 0.5 else 0 end) as a,
  case when s = m then 1.0 when contains(s, m) or contains(m, s) then 0.9 when lev > 0.7 then lev when {_BRAND_SQL} then 0.85 else 0.0 end as b,
  case when days = 0 then 1.0 when days <= 1 then 0.9 when days <= 3 then 0.7 when days <= 7 then 0.5 else 0.0 end as c, {_AGREE_SQL} as d from p),
t as (select *, cast(round((a * 0.4 + b * 0.3 + c * 0.2 + d * 0.1) * 10000) as bigint) as total_e4 from q)"""


def _scored(spark, sf_dir, least=None):
    inv = views.claims(spark, sf_dir).withColumns({"inv_seller": F.concat(F.lit("Seller "), F.col("inv_id") % 97), "inv_category": F.expr(_CATEGORY)})
    pay = views.payments(spark, sf_dir).withColumns({"pay_merchant": F.concat(F.lit("Supplier#"), F.col("supp") % 97), "pay_category": F.expr(_PAID_FOR)})
    inv, pay = matching.mark_parts(*matching.mark_alike(inv, pay))
    pairs = matching.tolerance_candidates(inv, pay, 1.0)
    if least is not None:
        pairs = pairs.filter(matching.can_reach(least))
    return matching.score_pairs(pairs).withColumn("total_e4", F.floor(F.col("total_score") * 10000 + 0.5))  # F.round() goes through decimal text for each pair


@query(_SCORE_SQL + " select inv_id, pay_id, total_e4 from t")
def q_score_pairs(spark, sf_dir):
    return _scored(spark, sf_dir).select("inv_id", "pay_id", "total_e4")


@query(_SCORE_SQL + ", r as (select *, row_number() over (partition by inv_id order by total_e4 desc, pay_id) as place from t where total_e4 >= 5000) select inv_id, pay_id, cast(place as int) as place from r where place <= 10")
def q_score_topk(spark, sf_dir):
    scored = _scored(spark, sf_dir, 0.4999).withColumn("total_score", F.col("total_e4") / 10000)  # what is rounded up to 0.5 counts
    return matching.top_scored(scored, []).select("inv_id", "pay_id", "place")


_RIDE = "date_sub('hour', ride_time, pay_time)"


@query(f"""with {RIDES}, c as (select *, {_RIDE} as h, pay_amount - ride_amount as off from ride join rpay using (user_id) where pay_time >= ride_time and {_RIDE} between 0 and 12
  and (ride_amount <= 0 or pay_amount <= 0 or pay_amount / ride_amount between 0.33 and 3.0)),
t as (select *, case when abs(off) <= 1 then 0 when off > 0 and off <= ride_amount and date_diff('day', cast(ride_time as date), cast(pay_time as date)) in (0, 1) then 1 end as tier from c),
r as (select *, row_number() over (partition by user_id, ride_id order by tier, h, abs(off), pay_id) as n from t where tier is not null)
select user_id, ride_id, pay_id, cast(tier as int) as tier, cast(h as bigint) as hours from r where n = 1""")
def q_ride_best_payment(spark, sf_dir):
    got = matching.ride_best_payment(views.rides(spark, sf_dir, 0), views.rides(spark, sf_dir, 1), ["user_id"], 1.0)
    return got.select("user_id", "ride_id", "pay_id", "tier", F.col("hours_after").cast("bigint").alias("hours"))


@query(f"""with {RIDES}, c as (select *, row_number() over (partition by user_id, ride_id order by abs(epoch_us(pay_time) - epoch_us(ride_time)), pay_id) as n from ride join rpay using (user_id))
select user_id, ride_id, pay_id from c where n = 1""")
def q_nearest_in_time(spark, sf_dir):
    got = matching.nearest_in_time(views.rides(spark, sf_dir, 0), views.rides(spark, sf_dir, 1), ["user_id"], "ride_time", "pay_time", "ride_id", "pay_id")
    return got.select("user_id", "ride_id", "pay_id")


_TRIPS = "t as (select id as trip_id, substr(id, 5, 8) as batch_id, travel_start, travel_end from trip)"


def _windows(spark, sf_dir):
    trips = table(spark, sf_dir, "trip").select(F.col("id").alias("trip_id"), F.substring("id", 5, 8).alias("batch_id"), "travel_start", "travel_end")
    return matching.window_join(table(spark, sf_dir, "invoice").select(F.col("id").alias("invoice_id"), "batch_id", "date"), trips, ["batch_id"], "date", "travel_start", "travel_end")


@query(f"with {_TRIPS} select i.id as invoice_id, trip_id from invoice i join t using (batch_id) where i.date between travel_start and travel_end")
def q_trip_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("invoice_id", "trip_id")


@query(f"with {_TRIPS}, r as (select i.id as invoice_id, trip_id, row_number() over (partition by i.id order by travel_start, trip_id) as n from invoice i join t using (batch_id) where i.date between travel_start and travel_end) select invoice_id, trip_id from r where n = 1")
def q_trip_of_invoice(spark, sf_dir):
    return matching.first_by(_windows(spark, sf_dir), ["invoice_id"], F.asc("travel_start"), F.asc("trip_id")).select("invoice_id", "trip_id")


@query(f"with {_TRIPS} select id as invoice_id from invoice where id not in (select i.id from invoice i join t using (batch_id) where i.date between travel_start and travel_end)")
def q_outside_trips(spark, sf_dir):
    return table(spark, sf_dir, "invoice").select(F.col("id").alias("invoice_id")).join(_windows(spark, sf_dir), "invoice_id", "left_anti")


@query()
def q_greedy_batches(spark, sf_dir):
    zones = zoned_time.with_walls(table(spark, sf_dir, "import_batch").select("batch_id", "received_on", "zone_name", "date_order"))
    utc = zoned_time.utc_seconds(spark, zones)
    pay = table(spark, sf_dir, "payment").join(zones, "batch_id").withColumn("sec", utc(F.col("transaction_time"), F.col("zone_name"), F.col("date_order"), F.col("received_on"), spans=F.col("walls")))
    shifted = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds("sec"), F.col("zone_name")))  # local wall clock, whatever the session's zone
    local = F.when(F.col("sec") >= 0, F.timestamp_add("SECOND", shifted, F.lit("1970-01-01").cast("timestamp_ntz")))
    pay = pay.select(F.col("batch_id").alias("batch"), F.col("id").alias("pay_id"), local.alias("pay_time"), F.col("amount").alias("pay_amount"), (F.greatest("amount", F.lit(0.0)) + F.coalesce("discount", F.lit(0.0))).alias("pay_total"), F.col("merchant_name").alias("pay_merchant"), F.col("import_seq").alias("pay_pos"))
    inv = table(spark, sf_dir, "invoice")
    rides = F.transform("itineraries", lambda r: F.struct(dates.parse_datetime(dates.extract_datetime(r["date_time"]), 2025).alias("at"), r["amount"].alias("amount"), r["provider"].alias("provider")))
    toll = dates.parse_datetime(dates.extract_datetime(F.col("toll_travel_time")), 2025)
    inv = inv.select(F.col("batch_id").alias("batch"), F.col("id").alias("inv_id"), F.col("amount").alias("inv_amount"), F.col("date").alias("inv_date"), F.col("seller_name").alias("inv_seller"), "category", F.col("import_seq").alias("inv_pos"), rides.alias("rides"), "travel_date", toll.alias("toll_time"), F.col("hotel_detail.check_in").alias("check_in"))
    return assign.match_batches(inv, pay)


@query()
def q_optimizer_generated(spark, sf_dir):
    """Score-based matching of 1,000 generated claims and 10,000 payments."""
    return optimizer.optimize(*optimizer.generated_pairs(spark, 1_000, 10_000))


# ---------------------------------------------------------------- payments


@query(""" with rows_ as (select *, row_number() over (order by pay_id) as pos from (""" + views.PAYMENTS_SQL + """)),
paid as (select * from rows_ where flag <> 'R'), back as (select * from rows_ where flag = 'R'),
o as (select b.pos as r_pos, b.pay_amount as amt, p.pos, case when starts_with(b.pay_id, p.pay_id) then 0 else 1 end as tier from back b join paid p using (order_key)),
n as (select distinct length(pay_id) as n from paid),
x as (select b.pos as r_pos, b.pay_amount as amt, substr(b.pay_id, 1, n) as cut from back b, n where n <= length(b.pay_id)),
y as (select r_pos, amt, p.pos, 2 as tier from x join paid p on p.pay_id = x.cut),
r as (select *, row_number() over (partition by r_pos order by tier, pos) as k from (select * from o union all select * from y)),
t as (select pos, sum(cast(round(amt * 100) as bigint)) as back_cents from r where k = 1 group by pos)
select pay_id, cast(round(pay_amount * 100) as bigint) - coalesce(back_cents, 0) as net_cents from paid left join t using (pos) where coalesce(back_cents, 0) < cast(round(pay_amount * 100) as bigint)""")
def q_refund_netting(spark, sf_dir):
    pay = views.payments(spark, sf_dir)
    cents = F.round(F.col("pay_amount") * 100)
    rows = pay.select(F.col("pay_id").alias("pos"), F.col("pay_id").alias("trade_id"), F.col("order_key").cast("string").alias("merchant_order"), F.when(F.col("flag") == "R", -cents).otherwise(cents).alias("amount"))
    return records.net_refunds(rows).select(F.col("trade_id").alias("pay_id"), F.col("net").cast("bigint").alias("net_cents"))


_SEARCH = "lower(merchant_name) like '%vip%' and amount between 10 and 5000 and source = 'Wechat' and substr(transaction_time, 1, 10) >= '2024-03-01'"


@query(f"select id, amount from payment where {_SEARCH}")
def q_payment_search(spark, sf_dir):
    return matching.search_payments(table(spark, sf_dir, "payment"), source="Wechat", start="2024-03-01", text="vip", least=10, most=5000).select("id", "amount")


@query("select id, amount from payment order by amount desc, import_seq limit 100 offset 100")
def q_payment_page(spark, sf_dir):
    return matching.page(table(spark, sf_dir, "payment").select("id", "amount", "import_seq"), [F.desc("amount"), F.asc("import_seq")], 1).select("id", "amount")


# ---------------------------------------------------------------- invoices

_DEDUP = "row_number() over (partition by case when coalesce(invoice_number, '') = '' then 'k|' || amount || '|' || coalesce(cast(date as varchar), '') || '|' || coalesce(seller_name, '~') else 'n|' || invoice_number end order by import_seq)"


@query(f"select id, cast({_DEDUP} as int) as copy_no from invoice")
def q_invoice_copies(spark, sf_dir):
    return records.first_of_each(table(spark, sf_dir, "invoice"), "invoice_number", ["amount", "date", "seller_name"], "import_seq").select("id", "copy_no")


@query(f"with d as (select *, {_DEDUP} as c from invoice) select distinct coalesce(invoice_number, '') as invoice_number from d where c > 1")
def q_duplicate_numbers(spark, sf_dir):
    d = records.first_of_each(table(spark, sf_dir, "invoice"), "invoice_number", ["amount", "date", "seller_name"], "import_seq").filter("copy_no > 1")
    return d.select(F.coalesce("invoice_number", F.lit("")).alias("invoice_number")).distinct()


@query("select id from invoice where batch_id > 'B0000006' and (coalesce(invoice_number, '') = '' or invoice_number not in (select invoice_number from invoice where batch_id <= 'B0000006' and invoice_number is not null))")
def q_cross_batch_new(spark, sf_dir):
    inv = table(spark, sf_dir, "invoice")
    return records.new_numbers(inv.filter("batch_id > 'B0000006'"), inv.filter("batch_id <= 'B0000006'"), "invoice_number").select("id")


@query("select id from (select id, invoice_number, row_number() over (partition by invoice_number order by batch_id nulls first, import_seq nulls first, id) as n from invoice) where coalesce(invoice_number, '') = '' or n = 1")
def q_every_batch_new(spark, sf_dir):
    """Every batch against all that arrived before it; q_cross_batch_new does so for one fixed cut."""
    return records.first_arrivals(table(spark, sf_dir, "invoice"), "invoice_number", ["batch_id", "import_seq"], "id")


@query("select category, count(*) as n, sum(cast(round(amount * 100) as bigint))::bigint as cents from invoice group by category")
def q_category_summary(spark, sf_dir):
    return table(spark, sf_dir, "invoice").groupBy("category").agg(F.count("*").alias("n"), F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents"))


_GROUPS = {"far": ["Train", "Flight"], "near": ["CityTransport", "Toll"], "stay": ["Hotel"]}


@query("select batch_id, " + ", ".join(f"coalesce(sum(case when category in ({', '.join(repr(x) for x in v)}) then cast(round(amount * 100) as bigint) end), 0)::bigint as {k}" for k, v in _GROUPS.items()) + " from invoice group by batch_id")
def q_conditional_sums(spark, sf_dir):
    return records.conditional_sums(table(spark, sf_dir, "invoice"), "batch_id", "category", "amount", _GROUPS)


@query("""select i.id, cast(u.pos - 1 as int) as ride_no, case when u.pos = 1 or u.pos is null then i.invoice_number end as invoice_number, u.it.pickup as pickup, u.it.dropoff as dropoff
from invoice i left join (select id, unnest(itineraries) as it, generate_subscripts(itineraries, 1) as pos from invoice) u on u.id = i.id""")
def q_ride_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "invoice").select("id", "invoice_number", F.posexplode_outer("itineraries").alias("ride_no", "ride"))
    return rows.select("id", "ride_no", F.when(F.coalesce("ride_no", F.lit(0)) == 0, F.col("invoice_number")).alias("invoice_number"), F.col("ride.pickup").alias("pickup"), F.col("ride.dropoff").alias("dropoff"))


@query("select id, case " + " ".join("when " + " or ".join(f"contains(t, '{w}')" for w in ws) + f" then '{c}'" for c, ws in text.CATEGORY_WORDS) + " else 'Other' end as category from (select id, lower(coalesce(seller_name, '') || ' ' || coalesce(item_name, '')) as t from invoice)")
def q_classify(spark, sf_dir):
    return table(spark, sf_dir, "invoice").select("id", text.category(F.col("seller_name"), F.col("item_name")).alias("category"))


def _station_sql() -> str:
    s = f"regexp_replace(regexp_replace(trim(raw, ' '), '(?:{text.STATION_ENDS})$', ''), '\\s*[A-Z]{{3}}$', '')"
    whens = [f"when ends_with(s, '{d}') then '{text.DISTRICTS[d]}'" for d in sorted(text.DISTRICTS, key=len, reverse=True)]
    whens.append("when regexp_replace(s, '[东南西北]$', '') in (" + ", ".join(f"'{c}'" for c in text.CITIES) + ") and regexp_replace(s, '[东南西北]$', '') <> s then regexp_replace(s, '[东南西北]$', '')")
    whens += [f"when starts_with(s, '{c}') and length(s) > {len(c)} then '{c}'" for c in text.CITIES]
    return f"with a as (select id, departure_city as raw from invoice where departure_city <> ''), b as (select id, raw, {s} as s from a) select id, case {' '.join(whens)} when length(s) between 2 and 4 then s else trim(raw, ' ') end as city from b"


@query(_station_sql())
def q_station_city(spark, sf_dir):
    return table(spark, sf_dir, "invoice").filter("departure_city <> ''").select("id", text.station_city(F.col("departure_city")).alias("city"))


_LEGS = "select o_custkey as who, o_orderkey as id, cast(o_orderdate as date) as day, row_number() over (partition by o_custkey order by cast(o_orderdate as date), o_orderkey) - 1 as k from orders"


def _tickets(spark, sf_dir):
    """Every customer's orders as legs of a round C0 - C1 - C2 - C0."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("travel_date"))
    k = F.row_number().over(W.partitionBy("who").orderBy("travel_date", "id")) - 1
    return o.withColumn("k", k).select("who", "id", F.concat(F.lit("C"), F.col("k") % 3).alias("departure"), F.concat(F.lit("C"), (F.col("k") + 1) % 3).alias("arrival"), "travel_date", F.col("id").alias("pos"))


_ROUNDS = """with l as ({legs}), g as (select who, (k - {first}) // 3 as n, min(day) as travel_start, max(day) as travel_end, count(*) as c from l where k >= {first} group by all)
select who, cast(n + 1 as int) as trip_no, '{dest}' as destination, travel_start, travel_end from g where c = 3"""


@query(_ROUNDS.format(legs=_LEGS, first=0, dest="C2"))
def q_trips_auto(spark, sf_dir):
    return records.trip_rows(records.trips(_tickets(spark, sf_dir), "who"), "who").drop("ticket_ids")


@query(_ROUNDS.format(legs=_LEGS, first=1, dest="C0"))
def q_trips_origin(spark, sf_dir):
    return records.trip_rows(records.trips(_tickets(spark, sf_dir), "who", origin="C1"), "who").drop("ticket_ids")


# ---------------------------------------------------------------- text


def _shape_sql() -> str:
    import re

    whens = []
    for pattern, shape in dates.WRITINGS:
        parts = []
        for literal, group, pad in re.findall(r"([^{]*)(?:\{(\d)(p?)\})?", shape):
            if literal:
                parts.append(f"'{literal}'")
            if group:
                part = f"regexp_extract(t, '{pattern}', {group})"
                parts.append(f"lpad({part}, 2, '0')" if pad else part)
        whens.append(f"when regexp_matches(t, '{pattern}') then {' || '.join(parts)}")
    return "select id, case " + " ".join(whens) + " end as found from (select id, transaction_time as t from payment)"


@query(_shape_sql())
def q_extract_datetime(spark, sf_dir):
    return table(spark, sf_dir, "payment").select("id", dates.extract_datetime(F.col("transaction_time")).alias("found"))


@query(f"select doc_id, {fields.number_sql()} as number from documents")
def q_document_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fields.document_number(F.col("text")).alias("number"))


@query(f"select doc_id, {fields.amount_sql()} as amount from documents")
def q_document_amount(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fields.document_amount(F.col("text")).alias("amount"))


@query(f"select doc_id, {fields.company_sql()} as company from documents")
def q_document_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fields.company_name(F.col("text")).alias("company"))


_SHEET = """select id, '货物或应税劳务：' || coalesce(item_name, '') || chr(10) || '发票号码：' || coalesce(invoice_number, '') || chr(10) || '价税合计（小写）¥' || printf('%.2f', amount) || chr(10) || '销售方 ' || coalesce(seller_name, '') as text from invoice where amount >= 0"""


@query(f"with s as ({_SHEET}) select id, {fields.amount_sql()} as amount, {fields.number_sql()} as number, {fields.company_sql()} as company from s")
def q_sheet_fields(spark, sf_dir):
    """Every invoice written as a sheet, and its fields read back from the text."""
    text_ = F.concat(F.lit("货物或应税劳务："), F.coalesce("item_name", F.lit("")), F.lit("\n发票号码："), F.coalesce("invoice_number", F.lit("")), F.lit("\n价税合计（小写）¥"), F.format_string("%.2f", "amount"), F.lit("\n销售方 "), F.coalesce("seller_name", F.lit("")))
    sheets = table(spark, sf_dir, "invoice").filter("amount >= 0").select("id", text_.alias("text"))
    return sheets.select("id", fields.document_amount(F.col("text")).alias("amount"), fields.document_number(F.col("text")).alias("number"), fields.company_name(F.col("text")).alias("company"))


_TIERS = ["", "行程报销单", "行程单 滴滴", "天府通", "电子行程单 地铁", "国内机票 保险", "航班", "行程单 携程", "过路费", "ETC 高速", "增值税 电子发票", "电子发票 普通发票", "电子发票 普通发票 高德", "酒店 结账单", "铁路电子客票", "G123 长沙站", "曹操", "*住宿服务*房费", "*运输服务*高铁", "*运输服务*机票", "*客运服务*", "*旅客运输服务*", "保险费", "网约车", "退票", "航空", "客运站", "餐厅", "民宿", "*餐饮服务*", "手续费"]
_TIERED = f"list_extract({_TIERS!r}, cast({{0}} % {len(_TIERS)} + 1 as int)) || ' ' || coalesce(substr({{1}}, 1, 40), '')"


def _tiered(number: Column, text_: Column) -> Column:
    """A text to which the words of one tier after the other are given, so that each tier occurs."""
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in _TIERS]), (number % len(_TIERS) + 1).cast("int")), F.lit(" "), F.coalesce(F.substring(text_, 1, 40), F.lit("")))


# the rides of an invoice as a table on a page: seven columns, a row each
_COLUMNS = ["序号", "服务商", "上车时间", "城市", "起点", "终点", "金额(元)"]
_SHEET_ROWS = """select id, cast(pos as int) as pos, it.provider as provider, it.date_time as t, it.city as city, it.pickup as pickup, it.dropoff as dropoff, round(it.amount, 2) as amount
from (select id, unnest(itineraries) as it, generate_subscripts(itineraries, 1) as pos from invoice)"""


def _sheet(spark, sf_dir) -> DataFrame:
    """(doc_id, row_no, col_no, text) of all ride sheets, with the head in row 0."""
    inv = table(spark, sf_dir, "invoice").filter(F.size("itineraries") > 0)
    r = F.col("ride")
    plain = lambda c: F.coalesce(r[c], F.lit(""))
    values = [(F.col("at") + 1).cast("string"), plain("provider"), plain("date_time"), plain("city"), plain("pickup"), plain("dropoff"), F.format_string("%.2f", r["amount"])]
    body = inv.select(F.col("id").alias("doc_id"), F.posexplode("itineraries").alias("at", "ride")).select("doc_id", (F.col("at") + 1).alias("row_no"), F.posexplode(F.array(*values)).alias("col_no", "text"))
    head = inv.select(F.col("id").alias("doc_id"), F.lit(0).alias("row_no"), F.posexplode(F.array(*[F.lit(c) for c in _COLUMNS])).alias("col_no", "text"))
    return head.unionByName(body)


def _ride_sql(time: str) -> str:
    line = lambda c: f"trim(regexp_replace(coalesce({c}, ''), chr(10), '', 'g'), ' ')"
    filled = " + ".join(f"cast(coalesce({c}, '') <> '' as int)" for c in ("provider", "t", "city", "pickup", "dropoff"))
    return f"select id, {time} as date_time, trim(coalesce(provider, ''), ' ') as provider, {line('pickup')} as pickup, {line('dropoff')} as dropoff, amount from ({_SHEET_ROWS}) where amount > 0 and {filled} > 0"


@query(_ride_sql("coalesce(" + _shape_sql().split("select id, ")[1].split(" as found")[0] + ", '')"))
def q_rides_in_cells(spark, sf_dir):
    cells = _sheet(spark, sf_dir).withColumns({"page": F.lit(1), "table_no": F.lit(0)})
    return rides.rides_in_cells(cells).select(F.col("doc_id").alias("id"), "date_time", "provider", "pickup", "dropoff", F.round("amount", 2).alias("amount"))


@query(f"select id, amount from (select id, pos, amount, row_number() over (partition by id, pos order by pos) from ({_SHEET_ROWS}) where amount > 0 and amount < 1000000)")
def q_rides_in_words(spark, sf_dir):
    """The sheets as words at positions: a column every 100, a row every 30. Times are made distinct, so every ride stays."""
    words = _sheet(spark, sf_dir).withColumns({"page": F.lit(1), "seq": F.col("row_no") * 10 + F.col("col_no"), "x0": F.col("col_no") * 100.0, "x1": F.col("col_no") * 100.0 + 40, "top": F.col("row_no") * 30.0 + 10, "bottom": F.col("row_no") * 30.0 + 20})
    words = words.withColumn("text", F.when((F.col("row_no") > 0) & (F.col("col_no") == 2), F.format_string("2025-01-02 %02d:%02d", (F.col("row_no") / 60).cast("int"), F.col("row_no") % 60)).otherwise(F.col("text"))).filter("text <> ''")
    return rides.rides_in_words(words).select(F.col("doc_id").alias("id"), F.round("amount", 2).alias("amount"))


_LACKS = "coalesce(list_filter([case when not coalesce(amount > 0, false) then 'amount' end, case when not regexp_matches(t, '[:：]') or contains(t, '??') or regexp_matches(t, '[:：]$') then 'date_time' end], lambda x: x is not null), [])"


@query(f"select id, pos - 1 as ride_no, array_to_string({_LACKS}, ',') as missing from (select id, cast(pos as int) as pos, trim(coalesce(it.date_time, ''), ' ') as t, it.amount as amount from (select id, unnest(itineraries) as it, generate_subscripts(itineraries, 1) as pos from invoice))")
def q_ride_missing(spark, sf_dir):
    r = table(spark, sf_dir, "invoice").select("id", F.posexplode("itineraries").alias("ride_no", "ride"))
    return r.select("id", "ride_no", F.array_join(rides.missing_fields(F.col("ride.date_time"), F.col("ride.amount")), ",").alias("missing"))


@query("with r as (select id, unnest(itineraries) as it, generate_subscripts(itineraries, 1) as pos from invoice) select id, cast(count(distinct (coalesce(it.date_time, chr(0)), round(it.amount * 100))) as bigint) as rides from r group by id")
def q_ride_distinct(spark, sf_dir):
    r = table(spark, sf_dir, "invoice").select("id", F.posexplode("itineraries").alias("pos", "ride")).select("id", "pos", "ride.date_time", "ride.amount")
    return rides.distinct_rides(r, ["id"]).groupBy("id").agg(F.count("*").alias("rides"))


@query(f"select id, round(amount, 2) as amount, case when length(coalesce(remarks, '')) >= 3 then trim(remarks, ' ') end as remarks from invoice where amount > 0 and amount < {fields.LARGEST} and not regexp_matches(coalesce(remarks, ''), '[^!-~一-龥]')")
def q_cell_fields(spark, sf_dir):
    """Amount and remarks of every invoice written into cells beside their labels, and read back."""
    inv = table(spark, sf_dir, "invoice").filter((F.col("amount") > 0) & (F.col("amount") < fields.LARGEST) & ~F.coalesce("remarks", F.lit("")).rlike("[^!-~一-龥]"))
    cell = lambda r, c, x: F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), F.array(x).alias("texts"))
    cells = F.array(cell(0, 0, F.lit("价税合计（大写）")), cell(0, 1, F.lit("圆整")), cell(0, 2, F.concat(F.lit("（小写）¥"), F.format_string("%.2f", F.round("amount", 2)))), cell(1, 0, F.lit("备 注")), cell(1, 1, F.coalesce("remarks", F.lit(""))))
    rows = inv.select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), F.explode(cells).alias("c")).select("doc_id", "page", "table_no", "c.*")
    return invoice_cells.invoice_fields(rows).select(F.col("doc_id").alias("id"), "amount", "remarks")


@query(f"select id, {routing.first_rule_sql(routing.CELL_RULES, {k: k for k in ('item', 'detail', 'seller', 'text', 'remarks', 'context')})} as category from (select id, coalesce(item_name, '') as item, {_TIERED.format('import_seq', 'item_name')} as detail, coalesce(seller_name, '') as seller, '' as text, coalesce(remarks, '') as remarks, concat_ws(' ', remarks, seller_name, '') as context from invoice)")
def q_cell_category(spark, sf_dir):
    inv = table(spark, sf_dir, "invoice")
    return inv.select("id", routing.category_by_cells(F.col("item_name"), _tiered(F.col("import_seq"), F.col("item_name")), F.col("seller_name"), F.lit(""), F.col("remarks")).alias("category"))


_LINE = "coalesce(it.date_time, '') || ' ' || coalesce(it.pickup, '') || ' ¥' || printf('%.2f', it.amount)"


@query(f"with r as (select id, pos, it.amount as amount, {_LINE} as t from (select id, unnest(itineraries) as it, generate_subscripts(itineraries, 1) as pos from invoice)), f as (select id, pos, amount, {_shape_sql().split('select id, ')[1].split(' as found')[0]} as found from r) select id as doc_id, cast(row_number() over (partition by id order by pos) as int) as ride_no, found as time, round(amount, 2) as amount from f where found is not null and round(amount, 2) > 0")
def q_document_rides(spark, sf_dir):
    """The rides of each invoice written as lines of a sheet and read back from its text."""
    line = lambda r: F.concat(F.coalesce(r["date_time"], F.lit("")), F.lit(" "), F.coalesce(r["pickup"], F.lit("")), F.lit(" ¥"), F.format_string("%.2f", r["amount"]))
    sheets = table(spark, sf_dir, "invoice").filter(F.size("itineraries") > 0).select(F.col("id").alias("doc_id"), F.array_join(F.transform("itineraries", line), "\n").alias("text"))
    return layout.rides_in_text(sheets)


_DIGIT = "list_extract(['零', '壹', '贰', '叁', '肆', '伍', '陆', '柒', '捌', '玖'], cast({0} as int) + 1)"


def _capitals_sql(cents: str) -> str:
    """Amounts below 100 million: every digit with its unit, then runs of zeros shortened."""
    places = [(10 ** (k + 2), u) for k, u in enumerate(["", "拾", "佰", "仟", "万", "拾", "佰", "仟"])][::-1]
    parts = []
    for size, unit in places:
        digit = f"({cents} // {size} % 10)"
        parts.append(f"case when {digit} > 0 then {_DIGIT.format(digit)} || '{unit}' else '{'零万' if unit == '万' else '零'}' end")
    whole = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({' || '.join(parts)}, '零+万', '万零', 'g'), '^(零|万)+', ''), '零+', '零', 'g'), '零$', '')"
    jiao, fen = f"({cents} // 10 % 10)", f"({cents} % 10)"
    tail = f"case when {jiao} = 0 and {fen} = 0 then '整' when {fen} = 0 then {_DIGIT.format(jiao)} || '角' when {jiao} = 0 then case when {cents} >= 100 then '零' else '' end || {_DIGIT.format(fen)} || '分' else {_DIGIT.format(jiao)} || '角' || {_DIGIT.format(fen)} || '分' end"
    return f"case when {cents} >= 100 then {whole} || '元' when {cents} > 0 then '' else '零元' end || {tail}"


@query(f"select id, {_capitals_sql('c')} as capitals from (select id, cast(round(amount * 100) as bigint) as c from invoice)")
def q_capital_amounts(spark, sf_dir):
    return table(spark, sf_dir, "invoice").select("id", text.capital_amount(F.round(F.col("amount") * 100).cast("bigint")).alias("capitals"))


_KIND_SQL = routing.first_rule_sql(routing.DOCUMENT_KINDS, {"text": "t", "train_no": f"(case when regexp_matches(t, '{routing.TRAIN_NO}') then '1' else '' end)"})


@query(f"with d as (select doc_id, {_TIERED.format('doc_id', 'text')} as t from documents), k as (select doc_id, t, {_KIND_SQL} as kind from d) select doc_id, kind, {routing.first_rule_sql(routing.TEXT_RULES, {'text': 'lower(t)', 'kind': 'kind'})} as category from k")
def q_document_kind(spark, sf_dir):
    """Kind and category of the heads of documents, with the words of every tier among them."""
    d = table(spark, sf_dir, "documents").select("doc_id", _tiered(F.col("doc_id"), F.col("text")).alias("t"))
    kind = routing.document_kind(F.col("t"))
    return d.select("doc_id", kind.alias("kind"), routing.category_by_text(F.col("t"), kind).alias("category"))


@query(f"with d as (select id, lower({_TIERED.format('import_seq', 'item_name')}) as items, lower(coalesce(item_name, '')) as item, lower(coalesce(seller_name, '')) as seller, lower(coalesce(remarks, '')) as region from invoice) select id, {routing.first_rule_sql(routing.REGION_RULES, {'items': 'items', 'item': 'item', 'seller': 'seller', 'seller_region': 'region'})} as category from d")
def q_region_category(spark, sf_dir):
    inv = table(spark, sf_dir, "invoice")
    return inv.select("id", routing.category_by_regions(_tiered(F.col("import_seq"), F.col("item_name")), F.col("item_name"), F.col("seller_name"), F.col("remarks")).alias("category"))


@query("select id, case when category = 'CityTransport' and len(itineraries) > 0 then 'OneToMany' when coalesce(seller_name, '') <> '' then 'AmountWithMerchant' else 'MultiDimensional' end as strategy from invoice")
def q_strategy(spark, sf_dir):
    return table(spark, sf_dir, "invoice").select("id", routing.strategy(F.col("category"), F.coalesce(F.size("itineraries"), F.lit(0)), F.col("seller_name")).alias("strategy"))


@query("select category, case category " + " ".join(f"when '{c}' then {k + 1}" for k, c in enumerate(summaries.ORDER)) + " end as place, count(*) as n, sum(cast(round(amount * 100) as bigint))::bigint as cents from (select case when category in (" + ", ".join(f"'{c}'" for c in summaries.ORDER) + ") then category else 'Other' end as category, amount from invoice) group by category")
def q_ordered_summary(spark, sf_dir):
    return summaries.ordered_summary(table(spark, sf_dir, "invoice"), "category", "amount")


@query("with c as (select batch_id, merchant_name, count(*) as n from payment where merchant_name is not null group by all), r as (select *, row_number() over (partition by batch_id order by n desc, merchant_name) as k from c) select batch_id, merchant_name, n from r where k = 1")
def q_batch_merchant(spark, sf_dir):
    return summaries.majority(table(spark, sf_dir, "payment"), ["batch_id"], "merchant_name")


def _per_batch(spark, sf_dir) -> DataFrame:
    """Batches as matches: the sum of their invoices and all their payments."""
    pay = table(spark, sf_dir, "payment").groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("transaction_id", "source", "amount", F.col("refund_amount").alias("refund"), "discount"))).alias("payments"))
    inv = table(spark, sf_dir, "invoice").groupBy("batch_id").agg(F.sum("amount").alias("inv_amount"), F.sum(F.greatest(F.size("itineraries"), F.lit(0))).alias("rides"))
    return inv.join(pay, "batch_id")


@query("with p as (select batch_id, cast(round(sum(coalesce(amount, 0)) * 100) as bigint) as a, cast(round(sum(coalesce(refund_amount, 0)) * 100) as bigint) as r, cast(round(sum(coalesce(discount, 0)) * 100) as bigint) as d from payment group by 1), i as (select batch_id, cast(round(sum(amount) * 100) as bigint) as c, sum(coalesce(len(itineraries), 0)) as n from invoice group by 1) select sum(c)::bigint as claims, sum(a)::bigint as paid, sum(r)::bigint as refunds, sum(d)::bigint as discounts, sum(n)::bigint as rides from i join p using (batch_id)")
def q_footer(spark, sf_dir):
    return summaries.footer(_per_batch(spark, sf_dir))


@query("with i as (select id, len(itineraries) as n from invoice where len(itineraries) > 0) select id, cast(n - n // 2 - n % 2 as int) as unpaired from i")
def q_unpaired_rides(spark, sf_dir):
    """Every ride with an even number is taken as paired."""
    inv = table(spark, sf_dir, "invoice").filter(F.size("itineraries") > 0).withColumn("n", F.size("itineraries"))
    pairs = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: k % 2 == 0)
    return inv.select("id", summaries.unpaired_rides(F.col("n"), pairs).alias("unpaired"))


_STAYS = "with t as (select id, travel_start as s, travel_end as e, unnest(invoice_ids) as inv from trip where travel_start is not null and travel_end is not null), h as (select t.id, t.s, t.e, i.hotel_detail.nights as n from t join invoice i on i.id = t.inv where i.category = 'Hotel'), g as (select id, greatest(date_diff('day', s, e) + 1, 1)::int as trip_days, coalesce(sum(case when n > 0 then n end), 0)::bigint as nights, count(case when coalesce(n, 0) <= 0 then 1 end) as unknown from h group by id, s, e)"


@query(_STAYS + " select id, trip_days, (trip_days - 1)::int as expected_nights, nights, unknown, case when unknown > 0 then 'incomplete' else 'mismatch' end as status from g where unknown > 0 or nights <> trip_days - 1")
def q_stay_check(spark, sf_dir):
    trips = table(spark, sf_dir, "trip").select("id", F.col("travel_start").alias("start"), F.col("travel_end").alias("end"), "invoice_ids")
    inv = table(spark, sf_dir, "invoice").filter("category = 'Hotel'").select(F.col("id").alias("inv"), F.col("hotel_detail.nights").alias("nights"))
    hotels = trips.select("id", F.explode("invoice_ids").alias("inv")).join(inv, "inv").select("id", "nights")
    return summaries.stay_check(trips.select("id", "start", "end"), hotels, "id")


@query("with t as (select substr(id, 5, 8) as batch, travel_start as s, travel_end as e, destination as d from trip), f as (select batch, d, min((coalesce(s, date '0001-01-01'), d)) as k from t where d <> '' group by all), j as (select batch, string_agg(d, '、' order by k) as destinations from f group by batch) select batch, min(s) as \"start\", max(e) as \"end\", coalesce(any_value(destinations), '') as destinations from t left join j using (batch) group by batch")
def q_trip_form(spark, sf_dir):
    trips = table(spark, sf_dir, "trip").select(F.substring("id", 5, 8).alias("batch"), F.col("travel_start").alias("start"), F.col("travel_end").alias("end"), "destination")
    return summaries.trip_form(trips, "batch")


@query("select id, case source when 'Wechat' then '微信单号：' when 'Alipay' then '支付宝单号：' else '' end || coalesce(transaction_id, '') as numbers from payment")
def q_payment_numbers(spark, sf_dir):
    one = F.array(F.struct("source", "transaction_id"))
    return table(spark, sf_dir, "payment").select("id", summaries.payment_numbers(one).alias("numbers"))


@query("select distinct category, payment_method from payment where category is not null and payment_method is not null")
def q_distinct_methods(spark, sf_dir):
    return table(spark, sf_dir, "payment").select("category", "payment_method").where("category is not null and payment_method is not null").distinct()


@query()
def q_remark_stays(spark, sf_dir):
    """The stays that remarks of invoices tell."""
    inv = table(spark, sf_dir, "invoice")
    return inv.withColumn("stay", stays.stay_in(F.col("remarks"), F.col("date"))).filter("stay is not null").select("id", "stay.check_in", "stay.check_out", "stay.nights")


@query(f"select id, hotel_detail.check_in as check_in, hotel_detail.check_out as check_out, greatest(date_diff('day', hotel_detail.check_in, hotel_detail.check_out), 1)::int as nights from invoice where date is not null and hotel_detail.check_in <= hotel_detail.check_out and date_diff('day', hotel_detail.check_in, hotel_detail.check_out) <= {stays.MOST_NIGHTS}")
def q_written_stays(spark, sf_dir):
    """Every known stay written as a remark and read back."""
    d = lambda c, f: F.date_format(F.col(f"hotel_detail.{c}"), f)
    inv = table(spark, sf_dir, "invoice").filter("hotel_detail.check_in is not null and hotel_detail.check_out is not null")
    text_ = F.concat(F.lit("入住 "), d("check_in", "y年M月d日"), F.lit("至"), d("check_out", "y/MM/dd"))
    return inv.select("id", stays.stay_in(text_, F.col("date")).alias("stay")).filter("stay is not null").select("id", "stay.check_in", "stay.check_out", "stay.nights")


def _at(rows: DataFrame, *words: tuple) -> DataFrame:
    """One page a row of (id), with words (text, x0, top, x1, bottom) on it."""
    cells = F.array(*[F.struct(F.lit(k).alias("seq"), t.alias("text"), *[F.lit(float(v)).alias(c) for c, v in zip(("x0", "top", "x1", "bottom"), at)]) for k, (t, *at) in enumerate(words)])
    return rows.select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.explode(cells).alias("w")).select("doc_id", "page", "w.*")


@query(f"select id, round(amount, 2) as amount, case when length(seller_name) >= 3 and not regexp_matches(seller_name, '统一社会|[^!-~一-龥]') and not regexp_matches(seller_name, '^[0-9A-Z]{{15,20}}$') then seller_name end as seller from invoice where round(amount, 2) > 0")
def q_fields_by_place(spark, sf_dir):
    """Amounts and sellers set on pages beside their labels, and read back by their places."""
    inv = table(spark, sf_dir, "invoice").filter(F.round("amount", 2) > 0)
    name = F.when(~F.col("seller_name").rlike("统一社会|[^!-~一-龥]"), F.col("seller_name"))
    words = _at(inv.withColumn("name", name), (F.lit("名称："), 0, 0, 30, 10), (F.lit("某大学"), 40, 0, 90, 10), (F.lit("名称："), 300, 0, 330, 10), (F.col("name"), 340, 1, 500, 11), (F.lit("价税合计"), 0, 100, 60, 110), (F.concat(F.lit("¥"), F.format_string("%.2f", F.round("amount", 2))), 200, 102, 260, 112), (F.lit("9.99"), 200, 140, 260, 150))
    out = regions.amount_by_place(words).join(regions.seller_by_place(words), "doc_id", "left")
    return out.select(F.col("doc_id").alias("id"), "amount", "seller")


@query("select id, substr(category, 1, 3) as title from invoice where length(category) >= 3")
def q_vertical_titles(spark, sf_dir):
    """Words written downwards, found again as titles."""
    inv = table(spark, sf_dir, "invoice").filter(F.length("category") >= 3)
    words = _at(inv, *[(F.substring("category", k + 1, 1), 10, 12 * k, 20, 12 * k + 10) for k in range(3)], (F.lit("文"), 60, 0, 70, 10))
    return regions.vertical_titles(words).select(F.col("doc_id").alias("id"), F.col("text").alias("title"))


_DAYS = "case when category = 'Hotel' and hotel_detail.check_in is not null then hotel_detail.check_in else date end"
_IN_CITY = "category <> 'CityTransport' or coalesce(len(itineraries), 0) = 0 or coalesce(d, '') = '' or contains(names, d) or len(list_filter(itineraries, lambda r: contains(coalesce(r.pickup, ''), d) or contains(coalesce(r.dropoff, ''), d) or contains(coalesce(r.city, ''), d))) > 0"


@query(f"with t as (select id as trip_id, substr(id, 5, 8) as batch_id, travel_start as s, travel_end as e, destination as d from trip), i as (select id, batch_id, category, {_DAYS} as day, concat_ws('|', seller_name, item_name, remarks) as names, itineraries from invoice), m as (select id, trip_id, row_number() over (partition by id order by s, trip_id) as n from i join t using (batch_id) where day between s and e and ({_IN_CITY})) select id, trip_id from m where n = 1")
def q_trip_by_city(spark, sf_dir):
    """Invoices on the earliest trip of their days that their rides' places don't contradict."""
    cities = F.when(F.coalesce("destination", F.lit("")) != "", F.array("destination")).otherwise(F.array().cast("array<string>"))
    trips_ = table(spark, sf_dir, "trip").select(F.col("id").alias("trip_no"), F.substring("id", 5, 8).alias("batch_id"), F.col("travel_start").alias("start"), F.col("travel_end").alias("end"), cities.alias("cities"))
    none = F.lit(None)
    days = documents.candidate_days(F.col("category"), F.col("date"), F.col("hotel_detail.check_in"), none.cast("array<date>"), none.cast("date"))
    inv = table(spark, sf_dir, "invoice").select("batch_id", F.col("id").alias("inv_id"), days.alias("days"), "category", F.array_compact(F.array("seller_name", "item_name", "remarks")).alias("names"), F.col("itineraries").alias("rides"))
    return documents.on_trips(inv, trips_, ["batch_id"]).select(F.col("inv_id").alias("id"), F.col("trip_no").alias("trip_id"))


@query("""select id, cast(pos - 1 as int) as row_no, case when pos = 1 then amount end as inv_amount, coalesce(it.date_time, '') || '  ' || coalesce(it.pickup, '') || ' → ' || coalesce(it.dropoff, '') as remark
from (select id, amount, unnest(itineraries) as it, generate_subscripts(itineraries, 1) as pos from invoice where amount is not null)""")
def q_match_rows(spark, sf_dir):
    none = F.array().cast("array<struct<pay_id:string,amount:double>>")
    inv = table(spark, sf_dir, "invoice").filter("size(itineraries) > 0 and amount is not null").select(F.col("id").alias("inv_id"), F.col("amount").alias("inv_amount"), F.col("itineraries").alias("rides"), none.alias("payments"))
    return documents.match_rows(inv).select(F.col("inv_id").alias("id"), "row_no", "inv_amount", "remark")


# ---------------------------------------------------------------- windows over events


@query("""with e as (select user_id, event_id, cast(round(value * 100) as bigint)::double as amount from events), t as (select *, sum(amount) over (partition by user_id) as total from e),
p as (select *, floor(total / 100) * 100 + 500 as printed from t)
select event_id, cast(case when abs(printed - total) >= 0.5 and total > 0 then round(amount * printed / total * 100) else amount * 100 end as bigint) as fixed_e2 from p""")
def q_proportional_fix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").cast("double").alias("amount"))
    e = e.withColumn("printed", F.floor(F.sum("amount").over(W.partitionBy("user_id")) / 100) * 100 + 500)
    fixed = records.share_of_printed_total(e, "user_id", "amount", "printed")
    return fixed.select("event_id", F.round(F.col("fixed") * 100).cast("bigint").alias("fixed_e2"))


@query("""with e as (select user_id, event_id, event_id * 7 % 12 + 1 as m from events), f as (select *, case when m < lag(m) over (partition by user_id order by event_id) then 1 else 0 end as falls from e)
select event_id, (2024 + sum(falls) over (partition by user_id order by event_id))::bigint as year from f""")
def q_year_rollover(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 12 + 1).alias("m"), F.lit(2024).alias("base"))
    return records.rolling_years(e, "user_id", "event_id", "m", "base").select("event_id", F.col("year").cast("bigint").alias("year"))


@query("select event_id, last_value(case when event_id % 5 = 0 then event_type end ignore nulls) over (partition by user_id order by event_id rows between 6 preceding and current row) as near from events")
def q_last_within_6(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 5 == 0, F.col("event_type")))
    return records.last_within(e, "user_id", "event_id", "v").select("event_id", "near")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, sum(cast(round(value * 100) as bigint))::bigint as cents from events group by all")
def q_windowed_totals(spark, sf_dir):
    return windowed_totals(table(spark, sf_dir, "events"), "ts", "event_type", "value")


_HOURS = SQL["q_windowed_totals"]


@query(_HOURS)
def q_streamed_totals(spark, sf_dir):
    """The same totals by a stream over the file: read as it arrives, windowed, the state written out whole at the end."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    totals = windowed_totals(arriving, "ts", "event_type", "value", late="400 days")
    write = lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/out")
    totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp_ntz, event_type string, n bigint, cents bigint").parquet(f"{at}/out") if _written(spark, f"{at}/out") else windowed_totals(spark.createDataFrame([], schema), "ts", "event_type", "value")


def _written(spark, path: str) -> bool:
    """Whether the stream had anything to write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@query("select id, round(amount, 2) as amount from payment where round(amount, 2) > 0")
def q_statement_files(spark, sf_dir):
    """Payments written as statement files in the statements' encoding, and read back by the source."""
    at = f"{shared_dir(spark)}/statements-{uuid.uuid4().hex}"
    bytes_ = lambda x: x.encode("gbk").decode("latin-1")  # noqa: E731  # the writer knows no GBK, but one character a byte
    word = lambda x: F.lit(bytes_(x))
    cents = F.concat(word("￥"), F.format_string("%.2f", F.round("amount", 2)))
    texts = {"交易时间": word("2025-01-01 10:00:00"), "交易分类": word("餐饮"), "交易对方": word("店"), "对方账号": word("x"), "商品说明": word("饭"), "收/支": word("支出"), "金额": cents, "方式": word("余额"), "交易状态": word("交易成功"), "订单号": F.col("id"), "商家订单号": word("m")}
    rows = table(spark, sf_dir, "payment").filter(F.round("amount", 2) > 0).select(*[c.alias(bytes_(k)) for k, c in texts.items()])
    rows.write.option("header", "true").option("encoding", "iso-8859-1").csv(at)
    return bills.alipay(spark, f"{at}/*.csv").select(F.col("trade_id").alias("id"), "amount")


# ---------------------------------------------------------------- training data, general

QUERIES["p1_found"] = zoned_time.p1_found
QUERIES["p1_zone_tables"] = zoned_time.p1_zone_tables
QUERIES["p6_found"] = rejects.p6_found
# the same by patterns on the raw lines, without any CSV reader
_B = r"[\s\x{a0}\x{3000}]"
_FIELD = rf'(?:{_B}*"(?:[^"]|"")*"{_B}*|[^",]*)'
_BARE = "regexp_replace(regexp_replace(@, '^" + _B + "+', ''), '" + _B + "+$', '')"
_CELL = _BARE.replace("@", "case when contains(@, '\"') then replace(regexp_replace(" + _BARE + ", '^\"|\"$', '', 'g'), '\"\"', '\"') else @ end")
SQL["p6_found"] = f"""with heads as (select batch_id, file_name, min(line_no) as head from raw_records where starts_with(raw_line, '{rejects.HEADER}') group by all),
lines as (select r.* from raw_records r join heads using (batch_id, file_name) where line_no > head and regexp_matches(raw_line, '\\S') and not starts_with(raw_line, '-')),
cut as (select raw_id, raw_line, case when regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*') then regexp_extract_all(',' || raw_line, ',({_FIELD})', 1) end as f from lines),
cells as (select raw_id, f, {_CELL.replace('@', 'f[1]')} as t, {_CELL.replace('@', 'f[3]')} as m, {_CELL.replace('@', 'f[7]')} as a from cut),
told as (select raw_id, case when f is null then 'quoting' when len(f) <> {rejects.FIELDS} then 'column_count'
  when not (regexp_full_match(t, '[0-9]{{4}}(-[0-9]{{1,2}}-|/[0-9]{{1,2}}/)[0-9]{{1,2}} ([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?') and try_cast(replace(split_part(t, ' ', 1), '/', '-') as date) is not null) then 'transaction_time'
  when not regexp_full_match(a, '[¥￥]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.][0-9]{{1,2}})?') then 'amount'
  when m = '' or regexp_matches(m, '[\\x00-\\x1f\\x7f\\x{{80}}-\\x{{9f}}\\x{{fffd}}]') then 'merchant_name' end as reason from cells)
select raw_id, reason from told where reason is not null"""
QUERIES["p6_loaded"] = rejects.p6_loaded


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
