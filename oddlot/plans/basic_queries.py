"""Scans, scalar expressions, aggregates, normalisation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, DAY_TEXT, HOUR, ID, MERCHANT, PAIR, PAIR_TEXT, RAW_TIME, TIME
from oddlot.functions.scalars import (
    at_least, cut_flag, day_part, hours_between,
)
from oddlot.operators import clean, features, rfm, sampling, skew, stats
from oddlot.operators.quantiles import table_quantiles
from oddlot.operators.ranking import with_row_index
from oddlot.plans.registry import EVENTS, LINES, events, lines, query, shown
from oddlot.sources.scan import prepare
from oddlot.sources.segments import SEGMENTS, inject_anomalies, merchant_segments
from oddlot.sources.views import event_transactions

STAMP = "'%Y-%m-%d %H:%M:%S'"

SCAN_SQL = f"""
select id as "PaymentTransactionId", m as merchant_id, c as customer_id, a as "Amount",
       concat(c, '_', m) as customer_merchant_id, hour(t) as hour,
       strftime(t, '%Y-%m-%d') as "Created_Time_str",
       strftime(raw, {STAMP}) as "RequestInsertTime", strftime(t, {STAMP}) as "Created_Time"
from txn"""
SCAN_COLUMNS = (ID, MERCHANT, CUSTOMER, AMOUNT, PAIR_TEXT, HOUR, DAY_TEXT)


@query("txn_scan", f"with {EVENTS} {SCAN_SQL}")
def txn_scan(spark, folder):
    return shown(events(spark, folder), *SCAN_COLUMNS, times=(RAW_TIME, TIME))


@query("txn_scan_lines", f"with {LINES} {SCAN_SQL}")
def txn_scan_lines(spark, folder):
    return shown(lines(spark, folder), *SCAN_COLUMNS, times=(RAW_TIME, TIME))


@query("txn_scan_day", f"with {EVENTS.replace(chr(39) + 'hour' + chr(39), chr(39) + 'day' + chr(39))} {SCAN_SQL}")
def txn_scan_day(spark, folder):
    return shown(
        prepare(event_transactions(spark, folder), grain="day"), *SCAN_COLUMNS, times=(RAW_TIME, TIME)
    )


@query(
    "txn_scan_day_column",
    f"""with txn as (
  select event_id as id, ts as raw, event_type as m, user_id as c, value as a,
         date_trunc('day', ts + interval 6 hours) as t
  from events) {SCAN_SQL}""",
)
def txn_scan_day_column(spark, folder):
    """The accounting day, which begins at 18:00 the evening before, is a column of the table."""
    raw = event_transactions(spark, folder)
    booked = raw.withColumn("day", F.to_date(F.expr(f"{RAW_TIME} + interval 6 hours")))
    return shown(prepare(booked, grain="day"), *SCAN_COLUMNS, times=(RAW_TIME, TIME))


@query(
    "sample_fixed",
    f"""with {EVENTS}
select id as "PaymentTransactionId", a as "Amount" from txn
order by md5(concat(id, '|0')), id limit 600""",
)
def sample_fixed(spark, folder):
    return sampling.sample_exact(events(spark, folder), 600, seed=0).select(ID, AMOUNT)


@query(
    "split_ratio",
    f"""with {EVENTS}, u as (
  select id, ('0x' || substr(md5(concat(id, '|1234')), 1, 13))::bigint / 4503599627370496.0::double as u
  from txn)
select id as "PaymentTransactionId", case when u < 0.8 then 'train' else 'test' end as side from u""",
)
def split_ratio(spark, folder):
    train, test = sampling.split_ratio(events(spark, folder), 0.8)
    return train.select(ID, F.lit("train").alias("side")).unionByName(
        test.select(ID, F.lit("test").alias("side"))
    )


def _segment_sql() -> str:
    ratios = [r for _, r in SEGMENTS]
    names = [n for n, _ in SEGMENTS]
    bounds, total = [], ""
    for i, ratio in enumerate(ratios[:-1]):
        total += (" + " if i else "") + f"floor({ratio} * n)"
        bounds.append(f"when r < {total} then '{names[i]}'")
    return f"""segments as (
  select m, case {' '.join(bounds)} else '{names[-1]}' end as segment
  from (select m, row_number() over (order by md5(concat(m, '|7')), m) - 1 as r,
               count(*) over () as n
        from (select distinct m from txn)))"""


@query(
    "merchant_segments",
    f"with {LINES}, {_segment_sql()} select m as merchant_id, segment from segments",
)
def segments(spark, folder):
    return merchant_segments(lines(spark, folder).select(MERCHANT), seed=7)


@query(
    "inject_anomalies",
    f"""with {LINES}, {_segment_sql()},
u as (
  select *, ('0x' || substr(md5(concat(id, '|11')), 1, 13))::bigint / 4503599627370496.0::double as u1,
         ('0x' || substr(md5(concat(id, '|12')), 1, 13))::bigint / 4503599627370496.0::double as u2,
         ('0x' || substr(md5(concat(id, '|13')), 1, 13))::bigint / 4503599627370496.0::double as u3,
         ('0x' || substr(md5(concat(c, '|14')), 1, 13))::bigint / 4503599627370496.0::double as u4,
         ('0x' || substr(md5(concat(c, '|15')), 1, 13))::bigint / 4503599627370496.0::double as u5
  from txn),
p as (
  select *, lag(raw) over (partition by c, m order by raw, id) as prev,
         cast(floor(u4 * 5) as int) as s1,
         cast((floor(u4 * 5) + 1 + floor(u5 * 4)) as int) % 5 as s2
  from u),
ranked as (
  select m, segment, row_number() over (order by segment, m) - 1 as r from segments),
sizes as (select segment, count(*) as n, min(r) as start from ranked group by segment),
o as (
  select p.*, u1 < 2000.0::double / 12000 as hit from p),
pos as (
  select o.*, f.total,
         cast(floor(u2 * f.total) as int) as want
  from o join (
    select a.s as s1, b.s as s2, sum(case when segment not in ('segment_' || (a.s + 1), 'segment_' || (b.s + 1)) then n else 0 end) as total
    from range(0, 5) a(s), range(0, 5) b(s), sizes group by all) f using (s1, s2)),
outside as (
  select a.s as s1, b.s as s2, m, row_number() over (partition by a.s, b.s order by segment, m) - 1 as want
  from range(0, 5) a(s), range(0, 5) b(s), ranked
  where segment not in ('segment_' || (a.s + 1), 'segment_' || (b.s + 1)))
select id as "PaymentTransactionId", c as customer_id,
       case when hit then outside.m else pos.m end as merchant_id,
       round(case when not hit then a when u3 < 0.5 then a * 1000 else 0.1 end, 3) as "Amount",
       strftime(case when hit then coalesce(prev, raw) + interval 1 second else raw end, {STAMP}) as "RequestInsertTime",
       case when hit then 1 else 0 end as is_injected
from pos left join outside using (s1, s2, want)""",
)
def injected(spark, folder):
    df = lines(spark, folder)
    out = inject_anomalies(df, merchant_segments(df.select(MERCHANT), seed=7))
    return shown(
        out, ID, CUSTOMER, MERCHANT, "is_injected", digits={AMOUNT: 3}, times=(RAW_TIME,)
    )


@query(
    "day_part",
    f"""with {EVENTS} select id as "PaymentTransactionId",
case when hour(t) < 8 then '[0-8)' when hour(t) < 12 then '[8-12)'
     when hour(t) < 18 then '[12-18)' else '[18-24)' end as day_part from txn""",
)
def day_parts(spark, folder):
    return events(spark, folder).select(ID, day_part(F.col(HOUR)).alias("day_part"))


@query(
    "hour_gap",
    f"""with {EVENTS} select id as "PaymentTransactionId",
coalesce(round(epoch(t - lag(t) over (partition by c order by t, id)) / 3600, 6), 0) as hour_gap from txn""",
)
def hour_gap(spark, folder):
    df = skew.with_previous_time(events(spark, folder), [CUSTOMER], TIME, ID, "prev")
    gap = F.round(hours_between(F.col(TIME), F.col("prev")), 6)
    return df.select(ID, F.coalesce(gap, F.lit(0.0)).alias("hour_gap"))


@query(
    "centroid_filter",
    f"""with {EVENTS}, mean as (select avg(a) as ma, avg(hour(t)) as mh from txn)
select id as "PaymentTransactionId", a as "Amount", hour(t) as hour from txn, mean
where a >= ma / 2 and hour(t) >= mh / 2""",
)
def centroid_filter(spark, folder):
    df = events(spark, folder)
    means = df.agg(F.avg(AMOUNT).alias(AMOUNT), F.avg(HOUR).alias(HOUR))
    centroid = {c: means.select(c).scalar() for c in (AMOUNT, HOUR)}
    return df.where(at_least(centroid, 2)).select(ID, AMOUNT, HOUR)


@query(
    "bias_binarise",
    f"""with {EVENTS}, cut as (select quantile_cont(a, 0.99) as q from txn)
select id as "PaymentTransactionId", a as "Amount",
       case when a >= q then -1 else 0 end as "Amount_flag" from txn, cut""",
)
def bias_binarise(spark, folder):
    df = events(spark, folder)
    cut = table_quantiles(df, {"q": (AMOUNT, 0.99)})["q"]
    return df.select(ID, AMOUNT, cut_flag(F.col(AMOUNT), cut).alias(f"{AMOUNT}_flag"))


@query(
    "total_danger",
    f"""with {EVENTS}, score as (
  select c, avg(a) as score from txn where m <> 'error' and c % 3 <> 0 group by c)
select id as "PaymentTransactionId", round(score, 4) as gmm_min_max_p_value,
       round(a + hour(t), 4) as total_danger_value
from txn left join score using (c)""",
)
def total_danger(spark, folder):
    df = events(spark, folder)
    scores = (
        df.where((F.col(MERCHANT) != "error") & (F.col(CUSTOMER) % 3 != 0))
        .groupBy(CUSTOMER)
        .agg(F.avg(AMOUNT).alias("score"))
    )
    out = features.danger_totals(df, scores, [AMOUNT, HOUR])
    return shown(out, ID, digits={"gmm_min_max_p_value": 4, "total_danger_value": 4})


@query(
    "group_aggs",
    f"""with {EVENTS} select c as customer_id, m as merchant_id, min(a) as min, max(a) as max,
round(avg(a), 8) as mean, round(median(a), 4) as median, round(sum(a), 4) as sum,
round(stddev_samp(a), 4) as std, count(a) as count, arg_min(id, row(a, id)) as first_id
from txn group by c, m""",
)
def group_aggs(spark, folder):
    out = stats.group_aggregates(events(spark, folder), PAIR)
    return shown(
        out, *PAIR, "min", "max", "count", "first_id",
        digits={"mean": 8, "median": 4, "sum": 4, "std": 4},
    )


@query(
    "stats_grouped",
    f"""with {EVENTS} select c as customer_id, round(avg(a), 8) as "Amount_mean",
round(stddev_samp(a), 4) as "Amount_std", count(a) as "Amount_count" from txn group by c""",
)
def stats_grouped(spark, folder):
    out = stats.grouped_stats(events(spark, folder), AMOUNT, [CUSTOMER])
    return shown(out, CUSTOMER, "Amount_count", digits={"Amount_mean": 8, "Amount_std": 4})


@query(
    "stats_global",
    f"""with {EVENTS}, s as (select avg(a) as mean, stddev_pop(a) as std, count(*) as n from txn)
select id as "PaymentTransactionId", round(mean, 4) as "Amount_mean", round(std, 4) as "Amount_std",
       n as "Amount_count" from txn, s""",
)
def stats_global(spark, folder):
    out = stats.with_table_stats(events(spark, folder), AMOUNT)
    return shown(out, ID, "Amount_count", digits={"Amount_mean": 4, "Amount_std": 4})


MERCHANT_RFM = """rfm as (
  select m, epoch((select max(t) + interval 1 day from txn) - max(t)) / 3600 as recency,
         median(gap) as frequency, median(a) as monetary
  from (select *, epoch(t - lag(t) over (partition by m order by t, id)) / 3600 as gap from txn)
  group by m having median(gap) is not null)"""
CUSTOMER_RFM = """rfm as (
  select c, epoch((select max(t) + interval 1 day from txn) - max(t)) / 3600 as recency,
         avg(gap) as frequency, median(a) as monetary
  from (select *, epoch(t - lag(t) over (partition by c order by t, id)) / 3600 as gap from txn)
  group by c having avg(gap) is not null)"""


@query(
    "rfm_merchant",
    f"""with {LINES}, {MERCHANT_RFM} select m as merchant_id, round(recency, 4) as recency,
round(frequency, 4) as frequency, round(monetary, 4) as monetary from rfm""",
)
def rfm_merchant(spark, folder):
    return shown(rfm.merchant_rfm(lines(spark, folder)), MERCHANT, digits=dict.fromkeys(rfm.RFM, 4))


@query(
    "rfm_customer",
    f"""with {EVENTS}, {CUSTOMER_RFM} select c as customer_id, round(recency, 4) as recency,
round(frequency, 4) as frequency, round(monetary, 4) as monetary from rfm""",
)
def rfm_customer(spark, folder):
    return shown(rfm.customer_rfm(events(spark, folder)), CUSTOMER, digits=dict.fromkeys(rfm.RFM, 4))


def noisy_sql(n: int) -> str:
    return f"""cleaned as (
  select * from (select *, count(id) over (partition by c, m) as n_pair from txn)
  where n_pair >= {n} or (select max(n) from (select count(id) as n from txn group by c, m)) < {n})"""


NOISY_OUT = """select id as "PaymentTransactionId", n_pair as frequency from cleaned"""


@query("remove_noisy", f"with {EVENTS}, {noisy_sql(5)} {NOISY_OUT}")
def remove_noisy(spark, folder):
    return clean.remove_noisy(events(spark, folder)).select(ID, "frequency")


@query("remove_noisy_none_qualify", f"with {LINES}, {noisy_sql(1000000)} {NOISY_OUT}")
def remove_noisy_none_qualify(spark, folder):
    return clean.remove_noisy(lines(spark, folder), 1_000_000).select(ID, "frequency")


@query(
    "daily_customer",
    f"""with {EVENTS} select c as customer_id, strftime(t, '%Y-%m-%d') as day,
round(avg(a), 8) as amount_mean, max(a) as amount_max, min(a) as amount_min,
round(sum(a), 4) as amount_total, count(id) as transaction_count from txn group by 1, 2""",
)
def daily_customer(spark, folder):
    out = features.daily_customer(events(spark, folder)).withColumn("day", F.col("day").cast("string"))
    return shown(
        out, CUSTOMER, "day", "amount_max", "amount_min", "transaction_count",
        digits={"amount_mean": 8, "amount_total": 4},
    )


@query(
    "daily_attach",
    f"""with {EVENTS} select id as "PaymentTransactionId",
count(id) over (partition by c, cast(t as date)) as transaction_count from txn""",
)
def daily_attach(spark, folder):
    return features.attach_daily_counts(events(spark, folder)).select(ID, "transaction_count")


@query(
    "daily_attach_fan_out",
    f"""with {EVENTS}, d as (select c, cast(t as date) as d, count(id) as n from txn group by 1, 2)
select id as "PaymentTransactionId", n as transaction_count from txn left join d using (c)""",
)
def daily_attach_fan_out(spark, folder):
    out = features.attach_daily_counts(events(spark, folder), on="customer")
    return out.select(ID, "transaction_count")


@query(
    "score_global",
    f"""with {EVENTS}, s as (select min(a) as lo, max(a) as hi from txn)
select id as "PaymentTransactionId", round((a - lo) / (hi - lo), 6) as amount_score from txn, s""",
)
def score_global(spark, folder):
    out = stats.with_table_min_max(events(spark, folder), AMOUNT, "amount_score")
    return shown(out, ID, digits={"amount_score": 6})


@query(
    "minmax_norm",
    f"""with {LINES} select id as "PaymentTransactionId",
round(coalesce((a - lo) / nullif(hi - lo, 0), 0), 6) as "Amount_min_max_p_value"
from (select *, min(a) over (partition by c, m) as lo, max(a) over (partition by c, m) as hi from txn)""",
)
def minmax_norm(spark, folder):
    out = stats.with_min_max_norm(lines(spark, folder), AMOUNT, PAIR)
    return shown(out, ID, digits={"Amount_min_max_p_value": 6})


# Two-sided mass of Student's t as a closed finite sum, with binomials through lgamma.
SCORED = """g as (
  select *, avg(a) over (partition by c, m) as mean, stddev_samp(a) over (partition by c, m) as std,
         count(a) over (partition by c, m) as n from txn),
tv as (select *, n - 1 as nu, abs(a - mean) / nullif(std * sqrt(2.0::double / n), 0) as tval from g),
th as (select *, atan(tval / sqrt(nu::double)) as th from tv where nu > 0),
ser as (
  select *, case when nu % 2 = 0 then
      list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(th), 2 * k)
                for k in range(0, nu // 2)])
    else
      list_sum([cos(th) * sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos(th), 2 * k)
                for k in range(0, (nu - 1) // 2)])
    end as series
  from th),
mass as (
  select id, case when nu % 2 = 0 then sin(th) * series
                  else 2 / pi() * (th + sin(th) * coalesce(series, 0)) end as mass
  from ser where tval is not null)"""


@query(
    "t_value",
    f"""with {EVENTS}, {SCORED} select id as "PaymentTransactionId", round(tval, 6) as "Amount_t_value" from tv""",
)
def t_value(spark, folder):
    out = stats.with_p_value(stats.with_grouped_stats(events(spark, folder), AMOUNT, PAIR), AMOUNT)
    return shown(out, ID, digits={"Amount_t_value": 6})


@query(
    "p_value_score",
    f"""with {EVENTS}, {SCORED} select txn.id as "PaymentTransactionId", round(mass, 6) as "Amount_p_value"
from txn left join mass using (id)""",
)
def p_value_score(spark, folder):
    out = stats.normalised(events(spark, folder), AMOUNT, PAIR, "pvalue")
    return shown(out, ID, digits={"Amount_p_value": 6})


def _h0_sql(column: str, name: str) -> str:
    """Simpson's rule over the density, independent of the quadrature used by the library."""
    return f"""{name}_s as (
  select id, count(*) over () as n, abs({column} - avg({column}) over ()) /
         (stddev_pop({column}) over () * sqrt(2.0::double / count(*) over ())) as tau from x),
{name} as (
  select id, least(1, exp(lgamma(n / 2.0::double) - lgamma((n - 1) / 2.0::double)) / sqrt((n - 1) * pi())
    * least(tau, 12) / 1000 / 3 * 2 * list_sum([
        (case when i in (0, 1000) then 1 when i % 2 = 1 then 4 else 2 end)
        * exp(-n / 2.0::double * ln(1 + pow(least(tau, 12) * i / 1000, 2) / (n - 1)))
        for i in range(0, 1001)])) as p
  from {name}_s)"""


H0 = f"""{EVENTS}, x as (select id, a, hour(t)::double as h from txn),
{_h0_sql('a', 'pa')}, {_h0_sql('h', 'ph')}"""


@query(
    "h0_labels",
    f"""with {H0} select id as "PaymentTransactionId", round(pa.p, 4) as "Amount_p_value",
round(ph.p, 4) as hour_p_value, case when pa.p > 0.05 then 1 else 0 end as "Amount_h0_rejected",
case when ph.p > 0.05 then 1 else 0 end as hour_h0_rejected from pa join ph using (id)""",
)
def h0_labels(spark, folder):
    out = stats.h0_labels(events(spark, folder), [AMOUNT, HOUR])
    return shown(
        out, ID, "Amount_h0_rejected", "hour_h0_rejected",
        digits={"Amount_p_value": 4, "hour_p_value": 4},
    )


@query(
    "h0_target",
    f"""with {H0} select id as "PaymentTransactionId",
case when pa.p > 0.95 and ph.p > 0.95 then 1 else 0 end as target from pa join ph using (id)""",
)
def h0_target(spark, folder):
    labelled = stats.h0_labels(events(spark, folder), [AMOUNT, HOUR], alpha=0.95)
    return stats.h0_target(labelled, [AMOUNT, HOUR]).select(ID, "target")


@query(
    "iqr_split",
    f"""with {EVENTS}, {CUSTOMER_RFM},
q as (select quantile_cont(recency, 0.25) as r1, quantile_cont(recency, 0.75) as r3,
             quantile_cont(frequency, 0.25) as f1, quantile_cont(frequency, 0.75) as f3,
             quantile_cont(monetary, 0.25) as m1, quantile_cont(monetary, 0.75) as m3 from rfm)
select c as customer_id, case when
  recency not between r1 - 3 * (r3 - r1) and r3 + 3 * (r3 - r1) or
  frequency not between f1 - 3 * (f3 - f1) and f3 + 3 * (f3 - f1) or
  monetary not between m1 - 3 * (m3 - m1) and m3 + 3 * (m3 - m1) then 1 else 0 end as is_outlier
from rfm, q""",
)
def iqr_split(spark, folder):
    out = stats.with_iqr_outlier(rfm.customer_rfm(events(spark, folder)), list(rfm.RFM))
    return out.select(CUSTOMER, F.col("is_outlier").cast("int").alias("is_outlier"))


@query(
    "prev_txn",
    f"""with {EVENTS} select id as "PaymentTransactionId",
strftime(lag(t) over (partition by m order by t, id), {STAMP}) as merchant_prev,
strftime(lag(t) over (partition by c order by t, id), {STAMP}) as customer_prev from txn""",
)
def prev_txn(spark, folder):
    df = events(spark, folder)
    hot = skew.find_hot_keys(df)
    df = skew.with_previous_time(df, [MERCHANT], TIME, ID, "merchant_prev", hot)
    df = skew.with_previous_time(df, [CUSTOMER], TIME, ID, "customer_prev", hot)
    return shown(df, ID, times=("merchant_prev", "customer_prev"))


EXTREMES = """ranked as (
  select *, row_number() over (partition by c, m order by a desc, id) as hi,
         row_number() over (partition by c, m order by a, id) as lo from txn),
ext as (
  select c, m, max(a) as a1, max(a) filter (hi = 2) as a2, min(a) as b1, min(a) filter (lo = 2) as b2
  from ranked group by c, m)"""


@query(
    "second_extreme",
    f"""with {EVENTS}, {EXTREMES} select c as customer_id, m as merchant_id, a1 as amount_max,
a2 as amount_max_2nd, b1 as amount_min, b2 as amount_min_2nd from ext""",
)
def second_extreme(spark, folder):
    return features.second_extremes(events(spark, folder))


@query(
    "top3",
    f"""with {EVENTS}, {EXTREMES}
select id as "PaymentTransactionId", 'max' as side, hi as rank from ranked where hi <= 3
union all select id, 'min', lo from ranked where lo <= 3""",
)
def top3(spark, folder):
    df = events(spark, folder)
    most = skew.ranked_first(df, PAIR, [F.desc(AMOUNT), F.col(ID)], 3, "rank")
    least = skew.ranked_first(df, PAIR, [F.asc(AMOUNT), F.col(ID)], 3, "rank")
    return most.select(ID, F.lit("max").alias("side"), "rank").unionByName(
        least.select(ID, F.lit("min").alias("side"), "rank")
    )


ROLLING = """sum(a) over (partition by c order by t
  range between interval '2591999 seconds' preceding and current row)"""


@query(
    "rolling_30d",
    f"""with {EVENTS} select id as "PaymentTransactionId", round({ROLLING}, 4) as total from txn""",
)
def rolling_30d(spark, folder):
    out = skew.with_trailing_sum(events(spark, folder), [CUSTOMER], TIME, AMOUNT, 30 * 86_400, "total")
    return shown(out, ID, digits={"total": 4})


@query(
    "is_last_day",
    f"""with {EVENTS}, x as (select id, t, max(t) over (partition by c) as mx from txn)
select id as "PaymentTransactionId", strftime(mx, {STAMP}) as day_max,
       case when t = mx then 1 else 0 end as is_last_day from x""",
)
def is_last_day(spark, folder):
    return shown(
        clean.with_last_activity(events(spark, folder)), ID, "is_last_day", times=("day_max",)
    )


@query(
    "is_last_day_by_day",
    f"""with {EVENTS}, x as (select id, t, max(t) over (partition by c) as mx from txn)
select id as "PaymentTransactionId", strftime(mx, {STAMP}) as day_max,
       case when date_trunc('day', t) = date_trunc('day', mx) then 1 else 0 end as is_last_day from x""",
)
def is_last_day_by_day(spark, folder):
    out = clean.with_last_activity(events(spark, folder), grain="day")
    return shown(out, ID, "is_last_day", times=("day_max",))


@query(
    "split_date",
    f"""with {EVENTS} select id as "PaymentTransactionId",
case when t < timestamp '2024-01-24' then 'train' else 'test' end as side from txn""",
)
def split_date(spark, folder):
    train, test = clean.split_by_date(events(spark, folder), "2024-01-24 00:00:00")
    return train.select(ID, F.lit("train").alias("side")).unionByName(
        test.select(ID, F.lit("test").alias("side"))
    )


@query(
    "split_last",
    f"""with {EVENTS}, x as (select id, t, max(t) over (partition by c) as mx from txn)
select id as "PaymentTransactionId", case when t = mx then 'test' else 'train' end as side from x""",
)
def split_last(spark, folder):
    train, test = clean.split_by_last_activity(clean.with_last_activity(events(spark, folder)))
    return train.select(ID, F.lit("train").alias("side")).unionByName(
        test.select(ID, F.lit("test").alias("side"))
    )


@query(
    "semi_anti",
    f"""with {EVENTS}, big as (select c from txn group by c having sum(a) > 3500)
select id as "PaymentTransactionId", case when c in (select c from big) then 'in' else 'out' end as side
from txn""",
)
def semi_anti(spark, folder):
    df = events(spark, folder)
    big = df.groupBy(CUSTOMER).agg(F.sum(AMOUNT).alias("s")).where(F.col("s") > 3500)
    return clean.keep_members(df, big, CUSTOMER).select(ID, F.lit("in").alias("side")).unionByName(
        clean.drop_members(df, big, CUSTOMER).select(ID, F.lit("out").alias("side"))
    )


@query(
    "fold_modulo",
    f"""with {EVENTS} select id as "PaymentTransactionId",
(row_number() over (order by id) - 1) % 5 as fold from txn""",
)
def fold_modulo(spark, folder):
    return with_row_index(events(spark, folder).select(ID), [ID], "fold").withColumn(
        "fold", F.col("fold") % 5
    )


