"""Feature operators and the feature run."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, HOUR, ID, MERCHANT, TIME
from oddlot.operators import features as f
from oddlot.operators.clusters import MIXTURE_PARTS, customer_mixture_scores
from oddlot.operators.rfm import RFM
from oddlot.plans.basic_queries import CUSTOMER_RFM, STAMP
from oddlot.plans.cluster_sql import kmeans_sql, mixture_sql
from oddlot.plans.feature_run import run_features
from oddlot.plans.registry import EVENTS, LINES, events, lines, query, shown

FREQ = "c_freq_diff"
FREQ_SCORE = "c_freq_diff_min_max_p_value"


def noisy_sql(source: str, out: str, n: int = 5) -> str:
    return f"""{out} as (
  select * from (select *, count(id) over (partition by c, m) as n_{out} from {source})
  where n_{out} >= {n}
     or (select max(k) from (select count(id) as k from {source} group by c, m)) < {n})"""


def freq_sql(source: str, out: str, positive: str = "freq") -> str:
    return f"""{out}_g as (
  select *, epoch((select max(t) + interval 1 day from {source}) - min(t) over (partition by c))
              / 3600 / count(id) over (partition by c) as freq,
         epoch(t - lag(t) over (partition by c order by t, id)) / 3600 as gap
  from {source}),
{out}_x as (
  select *, case when freq > gap then freq - gap else {positive} end as x from {out}_g
  where gap is not null),
{out} as (
  select *, coalesce((x - min(x) over (partition by c))
                     / nullif(max(x) over (partition by c) - min(x) over (partition by c), 0), 0) as score
  from {out}_x)"""


def peak_sql(source: str, out: str) -> str:
    return f"""{out}_r as (
  select *, row_number() over (partition by c, m order by a desc, id) as hi_{out},
         row_number() over (partition by c, m order by a, id) as lo_{out} from {source}),
{out}_e as (
  select c, m, max(a) as a1, max(a) filter (hi_{out} = 2) as a2,
         min(a) as b1, min(a) filter (lo_{out} = 2) as b2 from {out}_r group by c, m),
{out}_d as (select *, nullif(a1 - a2, 0) as peak, nullif(b2 - b1, 0) as dropped from {out}_e),
{out} as (
  select s.*, a1, b1,
    coalesce(case when peak is not null then coalesce((peak - (select min(peak) from {out}_d))
      / nullif((select max(peak) - min(peak) from {out}_d), 0), 0) end, 0) as peak_score,
    coalesce(case when dropped is not null then coalesce((dropped - (select min(dropped) from {out}_d))
      / nullif((select max(dropped) - min(dropped) from {out}_d), 0), 0) end, 0) as drop_score
  from {source} s join {out}_d using (c, m))"""


def slope_sql(source: str, out: str) -> str:
    def side(name: str, order: str) -> str:
        return f"""{out}_{name}r as (
  select *, row_number() over (partition by c, m order by {order}, id) as k from {source}),
{out}_{name}s as (
  select abs(regr_slope(a, k) filter (k <= 3)) as s, max(id) filter (k = 1) as sid
  from {out}_{name}r group by c, m),
{out}_{name} as (
  select sid, case when s is not null then coalesce((s - (select min(s) from {out}_{name}s))
    / nullif((select max(s) - min(s) from {out}_{name}s), 0), 0) end as v from {out}_{name}s)"""

    return f"""{side('hi', 'a desc')},
{side('lo', 'a')},
{out} as (
  select s.*, coalesce(v, 0) as slope from {source} s
  left join (select sid, max(v) as v from (from {out}_hi union all from {out}_lo) group by sid) b
    on s.id = b.sid)"""


FREQ_OUT = """select id as "PaymentTransactionId", round(freq, 6) as customer_freq, round(gap, 6) as day_diff,
round(x, 6) as c_freq_diff, round(score, 6) as c_freq_diff_min_max_p_value from fd"""


def _freq_shown(out):
    return shown(out, ID, digits={"customer_freq": 6, "day_diff": 6, FREQ: 6, FREQ_SCORE: 6})


@query("c_freq_diff", f"with {EVENTS}, {freq_sql('txn', 'fd')} {FREQ_OUT}")
def c_freq_diff(spark, folder):
    return _freq_shown(f.frequency_difference(events(spark, folder)))


@query("c_freq_diff_zero", f"with {EVENTS}, {freq_sql('txn', 'fd', '0')} {FREQ_OUT}")
def c_freq_diff_zero(spark, folder):
    return _freq_shown(f.frequency_difference(events(spark, folder), positive="zero"))


@query(
    "c_m_ratios",
    f"""with {LINES}, x as (
  select *, case when m % 7 <> 0 then m % 5 end as label from txn),
k as (select id, label, count(id) over (partition by c, m) as n_pair,
             count(id) over (partition by c, label) as n_label from x)
select id as "PaymentTransactionId", label as merchant_label,
       case when label is not null then n_pair end as c_m_t_count,
       case when label is not null then n_label end as c_m_label_t_count,
       case when label is null then 0 else round(n_pair::double / n_label, 6) end as c_m_ratios
from k""",
)
def c_m_ratios(spark, folder):
    df = lines(spark, folder)
    labels = (
        df.select(MERCHANT).distinct().where(F.col(MERCHANT) % 7 != 0)
        .withColumn("merchant_label", F.col(MERCHANT) % 5)
    )
    return shown(
        f.merchant_ratio(df, labels), ID, "merchant_label", "c_m_t_count", "c_m_label_t_count",
        digits={"c_m_ratios": 6},
    )


@query(
    "amount_change",
    f"""with {EVENTS}, md as (select c, m, median(a) as med, count(id) as n from txn group by c, m),
x as (select id, c, m, n, med, abs(a - med) as x from txn join md using (c, m)),
y as (select *, min(x) over (partition by c, m) as lo, max(x) over (partition by c, m) as hi from x)
select id as "PaymentTransactionId", n as t_transactions, round(med, 4) as c_m_med_amount,
       round(x, 4) as c_m_med_amount_change,
       case when n < 5 then 0 else round(coalesce((x - lo) / nullif(hi - lo, 0), 0), 6) end
         as c_m_med_amount_change_min_max_p_value from y""",
)
def amount_change(spark, folder):
    out = f.amount_change(events(spark, folder))
    return shown(
        out, ID, "t_transactions",
        digits={
            "c_m_med_amount": 4, "c_m_med_amount_change": 4,
            "c_m_med_amount_change_min_max_p_value": 6,
        },
    )


@query(
    "peak_drop",
    f"""with {EVENTS}, {peak_sql('txn', 'pk')} select id as "PaymentTransactionId",
round(peak_score, 6) as c_m_peak_drop_min_max_p_value, round(drop_score, 6) as drop_score from pk""",
)
def peak_drop(spark, folder):
    out = f.peak_drop(events(spark, folder))
    return shown(out, ID, digits={f.PEAK_SCORE: 6, "drop_score": 6})


@query(
    "peak_drop_extreme",
    f"""with {EVENTS}, {peak_sql('txn', 'pk')} select id as "PaymentTransactionId",
round(case when a = a1 then peak_score else 0 end, 6) as c_m_peak_drop_min_max_p_value,
round(case when a = b1 then drop_score else 0 end, 6) as drop_score from pk""",
)
def peak_drop_extreme(spark, folder):
    out = f.peak_drop(events(spark, folder), attach="extreme")
    return shown(out, ID, digits={f.PEAK_SCORE: 6, "drop_score": 6})


@query(
    "slope",
    f"""with {EVENTS}, {slope_sql('txn', 'sl')}
select id as "PaymentTransactionId", round(slope, 6) as slope from sl""",
)
def slope(spark, folder):
    return shown(f.slope(events(spark, folder)), ID, digits={"slope": 6})


@query(
    "last_month_totals",
    f"""with {EVENTS}, {freq_sql('txn', 'fd')},
lm as (
  select *, case when gap > 30 then a else sum(a) over (partition by c order by t
      range between interval '2591999 seconds' preceding and current row) end as total from fd)
select id as "PaymentTransactionId", case when gap > 30 then 0 else 1 end as has_last_month_of_transactions,
       strftime(t - interval 30 day, {STAMP}) as last_30_days, round(total, 4) as last_month_totals,
       round(coalesce((total - min(total) over (partition by c))
         / nullif(max(total) over (partition by c) - min(total) over (partition by c), 0), 0), 6)
         as last_month_totals_min_max_p_value
from lm""",
)
def last_month_totals(spark, folder):
    out = f.last_month_totals(f.frequency_difference(events(spark, folder)))
    return shown(
        out, ID, "has_last_month_of_transactions",
        digits={"last_month_totals": 4, "last_month_totals_min_max_p_value": 6},
        times=("last_30_days",),
    )


@query(
    "daily_sequence",
    f"""with {EVENTS}, hr as (
  select c, m, t, median(a) as a, count(id) as n from txn group by c, m, t),
sp as (select c, m, min(t) as s, max(t) as e, count(*) as k from hr group by c, m),
cal as (select c, m, k, unnest(generate_series(s, e - interval 1 second, interval 1 day)) as t
        from sp where s < e)
select c as customer_id, m as merchant_id, concat(c, '_', m) as customer_merchant_id,
       strftime(t, {STAMP}) as "Created_Time", hour(t) as hour,
       case when hour(t) < 8 then '[0-8)' when hour(t) < 12 then '[8-12)'
            when hour(t) < 18 then '[12-18)' else '[18-24)' end as day_part,
       k as n_hour_groups, n as hour_count, round(coalesce(a, 0), 4) as "Amount",
       (select cast(floor(epoch(max(t) - min(t)) / 86400) as bigint) from txn) as total_days
from cal left join hr using (c, m, t)""",
)
def daily_sequence(spark, folder):
    out = f.daily_sequence(events(spark, folder))
    return shown(
        out, CUSTOMER, MERCHANT, "customer_merchant_id", HOUR, "day_part", "n_hour_groups",
        "hour_count", "total_days", digits={AMOUNT: 4}, times=(TIME,),
    )


@query(
    "customer_encoder",
    f"""with {EVENTS}, d as (select c, cast(t as date) as d, count(id) as n from txn group by 1, 2),
av as (select c, avg(n) as mean from d group by c)
select c as customer_id, row_number() over (order by mean, c) - 1 as customers from av""",
)
def customer_encoder(spark, folder):
    return f.customer_encoder(events(spark, folder)).select(CUSTOMER, "customers")


MIXTURE_SQL = f"""{EVENTS}, {CUSTOMER_RFM},
fence as (select {', '.join(f'quantile_cont({c}, 0.25) as {c}_1, quantile_cont({c}, 0.75) as {c}_3' for c in RFM)} from rfm),
marked as materialized (select rfm.*, {' or '.join(
    f'{c} < {c}_1 - 3 * ({c}_3 - {c}_1) or {c} > {c}_3 + 3 * ({c}_3 - {c}_1)' for c in RFM)} as far from rfm, fence),
inlier as materialized (select c, recency, frequency, monetary from marked where not far),
{kmeans_sql(list(RFM), MIXTURE_PARTS, 'inlier')}, {mixture_sql(list(RFM), MIXTURE_PARTS, 'inlier')},
shares as (
  select c, ln(w) - 1.5 * ln(2 * pi() * v)
            - ({' + '.join(f'({c} - m{i}) * ({c} - m{i})' for i, c in enumerate(RFM))}) / (2 * v) as p
  from inlier, mix),
gm as (
  select c, 1 - 1 / sum(exp(p - top)) as gmm from (select *, max(p) over (partition by c) as top from shares) group by c
  union all select c, 1.0 from marked where far)"""


@query(
    "gmm_score",
    f"""with recursive {MIXTURE_SQL}
select id as "PaymentTransactionId", txn.c as customer_id, round(coalesce(gmm, 0), 6) as gmm
from txn left join gm using (c)""",
)
def gmm_score(spark, folder):
    df = events(spark, folder)
    out = f.attach_customer_score(df, customer_mixture_scores(df))
    return shown(out, ID, CUSTOMER, digits={"gmm": 6})


RUN = ["c_freq_diff", f.PEAK_SCORE, "slope"]
RUN_SQL = f"""{EVENTS}, {noisy_sql('txn', 'c1')}, {freq_sql('c1', 'fd')},
{noisy_sql('fd', 'c2')}, {peak_sql('c2', 'pk')}, {noisy_sql('pk', 'c3')}, {slope_sql('c3', 'sl')}"""


@query(
    "feature_run",
    f"""with {RUN_SQL}
select id as "PaymentTransactionId", n_c3 as frequency, round(score, 6) as c_freq_diff_min_max_p_value,
       round(peak_score, 6) as c_m_peak_drop_min_max_p_value, round(slope, 6) as slope,
       case when t = max(t) over (partition by c) then 1 else 0 end as is_last_day
from sl""",
)
def feature_run(spark, folder):
    out = run_features(events(spark, folder), RUN)
    return shown(
        out, ID, "frequency", "is_last_day", digits={FREQ_SCORE: 6, f.PEAK_SCORE: 6, "slope": 6}
    )


@query("feature_run_all")
def feature_run_all(spark, folder):
    out = run_features(events(spark, folder), "all")
    return shown(
        out, ID, "is_last_day", "merchant_label",
        digits={"c_m_ratios": 6, FREQ_SCORE: 6, f.PEAK_SCORE: 6, "slope": 6, "gmm": 6},
    )


@query(
    "feature_run_h0",
    f"""with {EVENTS}, {noisy_sql('txn', 'c1')}, {peak_sql('c1', 'pk')}, {noisy_sql('pk', 'c2')},
{slope_sql('c2', 'sl')},
z as (select id, abs(peak_score - avg(peak_score) over ())
             / (stddev_pop(peak_score) over () * sqrt(2.0::double / count(*) over ())) as zp,
         abs(slope - avg(slope) over ())
             / (stddev_pop(slope) over () * sqrt(2.0::double / count(*) over ())) as zs from sl)
select id as "PaymentTransactionId", case when zp > 0.0627 then 1 else 0 end as peak_rejected,
       case when zs > 0.0627 then 1 else 0 end as slope_rejected,
       case when zp > 0.0627 and zs > 0.0627 then 1 else 0 end as target from z""",
)
def feature_run_h0(spark, folder):
    out = run_features(events(spark, folder), [f.PEAK_SCORE, "slope"], h0_alpha=0.05)
    return out.select(
        ID, F.col(f"{f.PEAK_SCORE}_h0_rejected").alias("peak_rejected"),
        F.col("slope_h0_rejected").alias("slope_rejected"), "target",
    )
