"""Clustering, noise detection, detectors, exploration and model selection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from oddlot.columns import AMOUNT, CUSTOMER, HOUR, ID, MERCHANT, PAIR, TIME
from oddlot.detectors import dense_net as nets
from oddlot.detectors import isolation
from oddlot.operators import clean, explore, noise, stats
from oddlot.operators import features as f
from oddlot.operators.clusters import (
    MAX_K, Mixture, cluster_merchants, knee, sweep_k, with_responsibilities,
)
from oddlot.operators.rfm import RFM, customer_rfm, merchant_rfm
from oddlot.operators.sampling import split_ratio
from oddlot.plans import model_search, score_run
from oddlot.plans.basic_queries import CUSTOMER_RFM, MERCHANT_RFM, STAMP
from oddlot.plans.cluster_sql import kmeans_sql
from oddlot.plans.feature_queries import FREQ_SCORE, freq_sql, slope_sql
from oddlot.plans.feature_run import run_features, score_columns
from oddlot.plans.forest_sql import forest_sql
from oddlot.plans.registry import EVENTS, LINES, events, lines, query, shown
from oddlot.session import settle

RUN_SCORES = score_columns("all")
SPLIT_DATE = "2024-01-24 00:00:00"


def featured(spark, folder) -> DataFrame:
    """Events with all registered features."""
    return settle(run_features(events(spark, folder), "all"))


def split(df: DataFrame):
    return clean.split_by_date(df, SPLIT_DATE)


# ---- clustering ---------------------------------------------------------------------------------


ELBOW_SQL = """st as (select k, lag(distance) over (order by k) - distance as d from sweep),
se as (select 2.58 * stddev_pop(d) / sqrt(count(d)) as e from st),
elbow as (select min(k) as k from st, se where d < e)"""
MERCHANT_COLUMNS = ["recency", "monetary", "frequency"]


@query(
    "merchant_clusters",
    f"""with recursive {LINES}, {MERCHANT_RFM}, {kmeans_sql(MERCHANT_COLUMNS)}, {ELBOW_SQL},
pick as (select case when count(*) > 2 then coalesce((select k from elbow), max(k)) else max(k) end as k from sweep)
select m as merchant_id, best.l as merchant_label, round(recency, 4) as m_recency,
       round(frequency, 4) as m_frequency, round(monetary, 4) as m_monetary
from near join pick using (k)""",
)
def merchant_clusters(spark, folder):
    out = cluster_merchants(lines(spark, folder))
    return shown(out, MERCHANT, "merchant_label", digits={f"m_{m}": 4 for m in RFM})


def _merchant_sweep(spark, folder, max_k: int = MAX_K) -> DataFrame:
    return sweep_k(settle(merchant_rfm(lines(spark, folder))), list(RFM), max_k)[0]


SWEEP_K_SQL = f"with recursive {LINES}, {MERCHANT_RFM}, {kmeans_sql(list(RFM))}"


@query("k_sweep", f"{SWEEP_K_SQL} select k, round(distance, 4) as distance from sweep")
def k_sweep(spark, folder):
    return shown(_merchant_sweep(spark, folder), "k", digits={"distance": 4})


@query(
    "k_sweep_one",
    f"""with {LINES}, {MERCHANT_RFM},
ce as (select avg(recency) as r, avg(frequency) as fr, avg(monetary) as mo from rfm)
select 1 as k, round(avg(sqrt((recency - r) ** 2 + (frequency - fr) ** 2 + (monetary - mo) ** 2)), 4)
  as distance from rfm, ce""",
)
def k_sweep_one(spark, folder):
    return shown(_merchant_sweep(spark, folder, 1), "k", digits={"distance": 4})


@query("elbow_k", f"{SWEEP_K_SQL}, {ELBOW_SQL} select k from elbow")
def elbow_k(spark, folder):
    return knee(_merchant_sweep(spark, folder), "k", "distance")


# A mixture that the expectation step is checked against.
FIXED_MIXTURE = Mixture(
    tuple(RFM),
    (0.4, 0.3, 0.2, 0.1),
    ((26.0, 10.0, 30.0), (30.0, 11.0, 35.0), (40.0, 9.0, 40.0), (28.0, 12.0, 25.0)),
    (20.0, 40.0, 80.0, 30.0),
)


def _mixture_sql() -> str:
    parts = []
    for w, mean, v in zip(FIXED_MIXTURE.weights, FIXED_MIXTURE.means, FIXED_MIXTURE.variances):
        square = " + ".join(f"({c} - {m}) ** 2" for c, m in zip(RFM, mean))
        parts.append(f"{w} * exp(-({square}) / (2 * {v})) / pow(2 * pi() * {v}, 1.5)")
    return ", ".join(f"{p} as d{i}" for i, p in enumerate(parts))


@query(
    "gmm_estep",
    f"""with {EVENTS}, {CUSTOMER_RFM}, d as (select c, {_mixture_sql()} from rfm),
s as (select *, d0 + d1 + d2 + d3 as total, greatest(d0, d1, d2, d3) as top from d)
select c as customer_id, round(d0 / total, 6) as r0, round(d1 / total, 6) as r1,
       round(d2 / total, 6) as r2, round(d3 / total, 6) as r3, round(1 - top / total, 6) as gmm,
       case top when d0 then 0 when d1 then 1 when d2 then 2 else 3 end as label
from s""",
)
def gmm_estep(spark, folder):
    scored = with_responsibilities(customer_rfm(events(spark, folder)), FIXED_MIXTURE)
    shares = {f"r{i}": F.round(F.col("responsibility")[i], 6) for i in range(4)}
    own = F.round(1 - F.array_max("responsibility"), 6)
    return scored.select(CUSTOMER, "label", *[c.alias(n) for n, c in shares.items()], own.alias("gmm"))


# ---- noise --------------------------------------------------------------------------------------

PLANE = ["x", "y"]
PLANE_SQL = f"""{EVENTS}, pl as (
  select id, (a - (select min(a) from txn)) / (select max(a) - min(a) from txn) as x,
         hour(t) / 24.0::double as y from txn)"""


def plane(spark, folder, *more: str) -> DataFrame:
    """Events as points: scaled amount and share of the day."""
    df = stats.with_table_min_max(events(spark, folder), AMOUNT, "x")
    return settle(df.select(ID, CUSTOMER, "x", (F.col(HOUR) / F.lit(24.0)).alias("y"), *more))


CANDIDATES_SQL = f"""{PLANE_SQL},
po as (select * from pl where x >= (select avg(x) from pl) and y >= (select avg(y) from pl))"""


@query(
    "dbscan_noise",
    f"""with {PLANE_SQL},
pt as (select x, y, count(*) as w from pl group by x, y),
nb as (select p.x, p.y, sum(q.w) as n from pt p join pt q
       on sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.02 group by p.x, p.y),
quiet as (select p.x, p.y from pt p
      where not exists (select 1 from nb q where q.n >= 20
        and sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.02))
select id as "PaymentTransactionId", case when quiet.x is null then 0 else 1 end as noise
from pl left join quiet using (x, y)""",
)
def dbscan_noise(spark, folder):
    out = noise.with_noise(plane(spark, folder), PLANE, 0.02, 20)
    return out.select(ID, F.col("noise").cast("int").alias("noise"))


def _shares_sql() -> str:
    return ", ".join(f"{s!r}::double" for s in noise.MIN_SAMPLE_SHARES)


SWEEP_MS_SQL = f"""{CANDIDATES_SQL},
nb as (select p.id, p.x, p.y, count(*) as n from po p join po q
       on sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.1 group by p.id, p.x, p.y),
best as (select p.id, max(q.n) as best from po p join nb q
       on sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.1 group by p.id),
grid as (select cast(floor((select count(*) from po) * s) as bigint) as m_s
         from (select unnest([{_shares_sql()}]) as s)),
sweep as (select m_s, (select count(*) from best where best < m_s) as outliers from grid)"""


@query("dbscan_sweep_ms", f"with {SWEEP_MS_SQL} select m_s, outliers from sweep")
def dbscan_sweep_ms(spark, folder):
    return _sweep_ms(spark, folder)


def _sweep_ms(spark, folder) -> DataFrame:
    df = plane(spark, folder)
    po = settle(noise.candidates(df, PLANE, noise.feature_means(df, PLANE)))
    return noise.sweep_min_samples(po, PLANE, po.count())


@query(
    "knee_param",
    f"""with {SWEEP_MS_SQL},
st as (select m_s, lag(outliers) over (order by m_s) - outliers as d from sweep),
se as (select 2.58 * stddev_pop(d) / sqrt(count(d)) as e from st)
select max(m_s) as m_s from st, se where d < e""",
)
def knee_param(spark, folder):
    return knee(_sweep_ms(spark, folder), "m_s", "outliers", smallest=False)


@query(
    "dbscan_sweep_eps",
    f"""with {CANDIDATES_SQL},
d as (select p.id as p, q.id as q,
             sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d from po p cross join po q),
kd as (select p, list_sort(list(d))[cast(floor((select count(*) from po) * 0.05) as bigint)] as k
       from d group by p),
thr as (select d.p, min(greatest(d.d, kd.k)) as e from d join kd on kd.p = d.q group by d.p),
grid as (select unnest([{', '.join(f'{e!r}::double' for e in noise.EPS_GRID)}]) as eps)
select round(eps, 6) as eps, (select count(*) from thr where e > eps) as outliers from grid""",
)
def dbscan_sweep_eps(spark, folder):
    df = plane(spark, folder)
    po = settle(noise.candidates(df, PLANE, noise.feature_means(df, PLANE)))
    out = noise.sweep_eps(po, PLANE, int(po.count() * 0.05))
    return shown(out, "outliers", digits={"eps": 6})


def _divisor_sql(d: int, eps: str = "0.1") -> str:
    near = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= p.eps"
    return f"""po{d} as materialized (select *, {eps} as eps from pl, ce where x >= cx / {d} and y >= cy / {d}),
nb{d} as (select p.id, p.x, p.y, count(*) as n from po{d} p join po{d} q on {near} group by p.id, p.x, p.y),
best{d} as (select p.id, p.x, p.y, max(q.n) as best from po{d} p join nb{d} q on {near} group by p.id, p.x, p.y),
lb{d} as (select x, y, best < (select count(*) from po{d}) - (select ms from star) as noise from best{d}),
cal{d} as (select {d} as div, round(abs(
    coalesce(max(x) filter (not noise), 0) + coalesce(max(y) filter (not noise), 0)
    - coalesce(min(x) filter (noise), 0) - coalesce(min(y) filter (noise), 0)), 6) as cal from lb{d})"""


@query(
    "dbscan_div_score",
    f"""with {PLANE_SQL},
ce as (select avg(x) as cx, avg(y) as cy from pl),
star as (select cast(floor(count(*) * 0.9) as bigint) as ms from pl, ce where x >= cx / 2 and y >= cy / 2),
{', '.join(_divisor_sql(d) for d in noise.DIVISORS)}
{' union all '.join(f'select * from cal{d}' for d in noise.DIVISORS)}""",
)
def dbscan_div_score(spark, folder):
    df = plane(spark, folder)
    centroid = noise.feature_means(df, PLANE)
    n = noise.candidates(df, PLANE, centroid, 2).count()
    out = noise.sweep_divisors(df, PLANE, centroid, 0.1, int(n * 0.9))
    return shown(out, "div", digits={"cal": 6})


@query(
    "dbscan_tune",
    f"""with {SWEEP_MS_SQL},
st as (select m_s, lag(outliers) over (order by m_s) - outliers as d from sweep),
se as (select 2.58 * stddev_pop(d) / sqrt(count(d)) as e from st),
star as (select coalesce((select max(m_s) from st, se where d < e), (select max(m_s) from sweep)) as ms),
dd as materialized (
  select p.id as p, q.id as q,
         sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d from po p cross join po q),
kd as materialized (
  select p, list_sort(list(d))[greatest(1, (select ms from star))] as k from dd group by p),
thr as materialized (
  select dd.p, coalesce(min(greatest(dd.d, kd.k)), 9) as e from dd join kd on kd.p = dd.q group by dd.p),
grid_e as (select unnest([{', '.join(f'{e!r}::double' for e in noise.EPS_GRID)}]) as eps),
sweep_e as materialized (select eps, count(thr.e) as outliers from grid_e left join thr on thr.e > eps group by eps),
st_e as (select eps, lag(outliers) over (order by eps) - outliers as d from sweep_e),
se_e as (select 2.58 * stddev_pop(d) / sqrt(count(d)) as e from st_e),
best_e as materialized (
  select coalesce((select min(eps) from st_e, se_e where d < e), (select min(eps) from sweep_e)) as eps),
ce as (select avg(x) as cx, avg(y) as cy from pl),
{', '.join(_divisor_sql(d, '(select eps from best_e)') for d in noise.DIVISORS)},
cals as ({' union all '.join(f'select * from cal{d}' for d in noise.DIVISORS)})
select round((select eps from best_e), 6) as eps, (select ms from star) as min_samples, round(cx, 6) as center_x,
       round(cy, 6) as center_y, (select div from cals order by cal desc, div limit 1) as optimum_divison
from ce""",
)
def dbscan_tune(spark, folder):
    found = noise.tune(plane(spark, folder), PLANE)
    x, y = (round(found["centroids"][c], 6) for c in PLANE)
    row = [(round(found["eps"], 6), found["min_samples"], x, y, found["optimum_divison"])]
    return spark.createDataFrame(
        row, "eps double, min_samples long, center_x double, center_y double, optimum_divison int"
    )


@query("dbscan_params")
def dbscan_params(spark, folder):
    params = noise.tune(featured(spark, folder), RUN_SCORES)
    row = [(params["eps"], params["min_samples"], params["centroids"], params["optimum_divison"])]
    return spark.createDataFrame(
        row, "eps double, min_samples long, centroids map<string,double>, optimum_divison int"
    )


@query(
    "label_dbscan",
    f"""with {PLANE_SQL},
ce as (select avg(x) as cx, avg(y) as cy from pl),
po as (select * from pl, ce where x >= cx / 14 and y >= cy / 14),
nn as (select count(*) - cast(floor(count(*) * 0.5) as bigint) as ms from po),
nb as (select p.id, p.x, p.y, count(*) as n from po p join po q
       on sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.2 group by p.id, p.x, p.y),
best as (select p.id, max(q.n) as best from po p join nb q
       on sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.2 group by p.id)
select pl.id as "PaymentTransactionId",
       case when best < (select ms from nn) then -1 else 0 end as label_dbscan
from pl left join best using (id)""",
)
def label_dbscan(spark, folder):
    df = plane(spark, folder)
    params = {"eps": 0.2, "centroids": noise.feature_means(df, PLANE)}
    return noise.predict(df, PLANE, params, slack=0.5).select(ID, "label_dbscan")


# ---- detectors ----------------------------------------------------------------------------------


@query("iforest_nodes")
def iforest_nodes(spark, folder):
    train, _ = split(featured(spark, folder))
    return isolation.fit_forest(train, RUN_SCORES).drop("normal")


@query("label_iso")
def label_iso(spark, folder):
    train, test = split(featured(spark, folder))
    nodes = isolation.fit_forest(train, RUN_SCORES).persist()
    return isolation.with_forest_label(test, train, nodes, RUN_SCORES).select(ID, "label_iso")


@query("ext_iforest")
def ext_iforest(spark, folder):
    out = isolation.extended_scores(featured(spark, folder), RUN_SCORES)
    return shown(out, ID, digits={"label_e_iso": 6})


PLANE_TREES = 100
PLANE_SPLIT_SQL = f"""{PLANE_SQL},
parted as (select id, x as x0, y as x1, t < timestamp '{SPLIT_DATE}' as training from pl join txn using (id)),
fitted as (select * from parted where training), scored as (select * from parted)"""


@query(
    "plane_forest_nodes",
    f"""with recursive {PLANE_SPLIT_SQL}, {forest_sql(2, isolation.TREES, isolation.SAMPLE_ROWS)}
select tree, node, "left", "right", size, feature, round(threshold, 9) as threshold from nodes""",
)
def plane_forest_nodes(spark, folder):
    train, _ = split(plane(spark, folder, TIME))
    nodes = isolation.fit_forest(train, PLANE)
    return shown(nodes, "tree", "node", "left", "right", "size", "feature", digits={"threshold": 9})


@query(
    "plane_label_iso",
    f"""with recursive {PLANE_SPLIT_SQL}, {forest_sql(2, isolation.TREES, isolation.SAMPLE_ROWS)},
judged as (select id, score, training from scores join parted using (id)),
edge as (select quantile_cont(score, {1 - isolation.CONTAMINATION}) as cut from judged where training)
select id as "PaymentTransactionId", case when score > cut then -1 else 1 end as label_iso
from judged, edge where not training""",
)
def plane_label_iso(spark, folder):
    train, test = split(plane(spark, folder, TIME))
    nodes = settle(isolation.fit_forest(train, PLANE))
    return isolation.with_forest_label(test, train, nodes, PLANE).select(ID, "label_iso")


@query(
    "plane_ext_forest",
    f"""with recursive {PLANE_SQL}, fitted as (select id, x as x0, y as x1 from pl), scored as (select * from fitted),
{forest_sql(2, PLANE_TREES, isolation.EXTENDED_SAMPLE_ROWS, extended=True)}
select id as "PaymentTransactionId", round(score, 6) as label_e_iso from scores""",
)
def plane_ext_forest(spark, folder):
    out = isolation.extended_scores(plane(spark, folder), PLANE, trees=PLANE_TREES)
    return shown(out, ID, digits={"label_e_iso": 6})


@query("autoencoder_fit")
def autoencoder_fit(spark, folder):
    train, _ = split(featured(spark, folder))
    net = nets.symmetric_net(len(RUN_SCORES))
    return nets.fit_net(train, net, RUN_SCORES)[1]


@query("autoencoder_score")
def autoencoder_score(spark, folder):
    train, test = split(featured(spark, folder))
    net, _ = nets.fit_net(train, nets.symmetric_net(len(RUN_SCORES)), RUN_SCORES)
    return shown(
        nets.with_reconstruction_error(test, net, RUN_SCORES), ID, digits={"anomaly_ae_values": 4}
    )


# A small net whose weights, like the points it is shown, are multiples of powers of two,
# so that single precision adds and multiplies without rounding.
EXACT_WEIGHTS = [[1.5, -0.75, 0.5], [-0.25, 1.25, 0.5]], [0.125, 0.0, -0.5], [[0.5, 0.25], [-0.5, 0.75], [1.0, -1.5]], [0.0, 0.25]
EXACT_NET = nets.Net(
    (2, 3, 2), ("relu", "linear"), weights=np.concatenate([np.ravel(w) for w in EXACT_WEIGHTS]).astype(np.float32)
)
EXACT_STEPS = 1024


def _net_sql() -> str:
    first, bias, second, shift = EXACT_WEIGHTS
    hidden = ", ".join(f"greatest(0, u * {first[0][j]} + v * {first[1][j]} + {bias[j]}) as h{j}" for j in range(3))
    out = [" + ".join(f"h{j} * {second[j][i]}" for j in range(3)) + f" + {shift[i]}" for i in range(2)]
    return f"""points as (
  select id, floor(x * {EXACT_STEPS}) / {EXACT_STEPS} as u, floor(y * {EXACT_STEPS}) / {EXACT_STEPS} as v from pl),
hidden as (select *, {hidden} from points)
select id as "PaymentTransactionId", round((abs({out[0]} - u) + abs({out[1]} - v)) / 2, 6) as anomaly_ae_values
from hidden"""


@query("autoencoder_forward", f"with {PLANE_SQL}, {_net_sql()}")
def autoencoder_forward(spark, folder):
    steps = {c: F.floor(F.col(c) * EXACT_STEPS) / EXACT_STEPS for c in PLANE}
    points = plane(spark, folder).withColumns(steps)
    return shown(nets.with_reconstruction_error(points, EXACT_NET, PLANE), ID, digits={"anomaly_ae_values": 6})


@query("autoencoder_halving")
def autoencoder_halving(spark, folder):
    train, test = split(featured(spark, folder))
    net, _ = nets.fit_net(train, nets.halving_net(len(RUN_SCORES)), RUN_SCORES)
    return shown(
        nets.with_reconstruction_error(test, net, RUN_SCORES), ID, digits={"anomaly_ae_values": 4}
    )


@query(
    "prediction_assemble",
    f"""with {EVENTS}, u as (select avg(a) as mean from txn),
te as (select * from txn where t >= timestamp '2024-01-24')
select id as "PaymentTransactionId", a as "Amount",
       case when c % 2 = 0 then case when a > 3 * mean then -1 else 1 end end as label_iso,
       round(case when m <> 'error' then a / mean end, 6) as anomaly_ae_values
from te, u""",
)
def prediction_assemble(spark, folder):
    df = events(spark, folder)
    _, test = split(df)
    mean = df.agg(F.avg(AMOUNT).alias("m")).scalar()
    iso = test.where(F.col(CUSTOMER) % 2 == 0).select(
        ID, F.when(F.col(AMOUNT) > 3 * mean, -1).otherwise(1).alias("label_iso")
    )
    ae = test.where(F.col(MERCHANT) != "error").select(ID, (F.col(AMOUNT) / mean).alias("anomaly_ae_values"))
    stale = test.withColumn("label_iso", F.lit(0))
    out = score_run.assemble(score_run.assemble(stale, iso, ["label_iso"]), ae, ["anomaly_ae_values"])
    return shown(out, ID, AMOUNT, "label_iso", digits={"anomaly_ae_values": 6})


@query("score_run")
def all_scores(spark, folder):
    df = featured(spark, folder)
    train, test = split(df)
    models = score_run.fit_detectors(df, train, RUN_SCORES, "all")
    out = score_run.score_detectors(models, df, train, test, RUN_SCORES)
    return shown(
        out, ID, "label_iso", "label_dbscan", digits={"label_e_iso": 6, "anomaly_ae_values": 4}
    )


# ---- exploration --------------------------------------------------------------------------------

# Scored transactions for the exploration queries: the features that need no learner, pair counts
# with a rule-based merchant label, and a score and label computed from the amount.
SCORED_SQL = f"""{EVENTS}, {freq_sql('txn', 'fd')}, {slope_sql('fd', 'sl')},
sc as (
  select *, (a - (select min(a) from sl)) / (select max(a) - min(a) from sl) as ae,
         case when a > 3 * (select avg(a) from sl) then -1 else 1 end as iso,
         count(id) over (partition by c, m) as n_pair,
         count(id) over (partition by c, length(m) % 2) as n_label
  from sl)"""


def scored(spark, folder) -> DataFrame:
    df = settle(f.slope(f.frequency_difference(events(spark, folder))))
    mean = df.agg(F.avg(AMOUNT).alias("m")).scalar()
    labels = df.select(MERCHANT).distinct().withColumn("merchant_label", F.length(MERCHANT) % 2)
    df = stats.with_table_min_max(df, AMOUNT, "anomaly_ae_values")
    df = df.withColumn("label_iso", F.when(F.col(AMOUNT) > 3 * mean, -1).otherwise(1))
    return settle(f.merchant_ratio(df, labels))


CM_SQL = f"""{SCORED_SQL}, cm as (
  select c as customer_id, m as merchant_id, max(n_label) as c_m_label_t_count,
         max(n_pair) as c_m_t_count, cast(sum(iso) as bigint) as label_iso from sc group by 1, 2)"""


@query("cm_summary", f"with {CM_SQL} select * from cm")
def cm_summary(spark, folder):
    return explore.pair_summary(scored(spark, folder))


@query(
    "union_train_test",
    f"""with {SCORED_SQL}
select id as "PaymentTransactionId", a as "Amount", case when t < timestamp '2024-01-24' then 0 end as label_iso,
       round(case when t < timestamp '2024-01-24' then slope end, 6) as slope
from sc where a is not null""",
)
def union_train_test(spark, folder):
    train, test = split(scored(spark, folder))
    out = explore.history(train, test, ["slope"], ["label_iso"])
    return shown(out, ID, AMOUNT, "label_iso", digits={"slope": 6})


def _top_sql(key: str, name: str) -> str:
    return f"""with {SCORED_SQL}
select {key} as {name}, round(max(ae), 6) as anomaly_ae_values from sc group by {key}
order by max(ae) desc, {key} limit 100"""


@query("top100_customers", _top_sql("c", CUSTOMER))
def top100_customers(spark, folder):
    out = explore.top_entities(scored(spark, folder), CUSTOMER, "anomaly_ae_values")
    return shown(out, CUSTOMER, digits={"anomaly_ae_values": 6})


@query("top100_merchants", _top_sql("m", MERCHANT))
def top100_merchants(spark, folder):
    out = explore.top_entities(scored(spark, folder), MERCHANT, "anomaly_ae_values")
    return shown(out, MERCHANT, digits={"anomaly_ae_values": 6})


SAMPLE_SQL = f"""{SCORED_SQL}, cut as (select quantile_cont(ae, 0.99) as q from sc),
drawn as (select id from sc order by md5(concat(id, '|0')), id
          limit (select cast(floor(count(*) * 0.2) as bigint) from sc)),
sampled as (select sc.* from sc, cut
            where ae > q or slope > 0 or id in (select id from drawn))"""


@query(
    "biased_sample",
    f"""with {SAMPLE_SQL} select id as "PaymentTransactionId", round(ae, 6) as anomaly_ae_values,
round(slope, 6) as slope from sampled""",
)
def biased_sample(spark, folder):
    out = explore.biased_sample(scored(spark, folder), 0.2)
    return shown(out, ID, digits={"anomaly_ae_values": 6, "slope": 6})


@query(
    "sample_drill",
    f"""with {SAMPLE_SQL},
cm as (select c as customer_id, m as merchant_id, max(n_label) as c_m_label_t_count,
         max(n_pair) as c_m_t_count, cast(sum(iso) as bigint) as label_iso from sc group by 1, 2)
select cm.* from cm where customer_id in (select c from sampled)""",
)
def sample_drill(spark, folder):
    df = scored(spark, folder)
    return explore.of_customers(explore.pair_summary(df), explore.biased_sample(df, 0.2))


@query(
    "sample_history",
    f"""with {SAMPLE_SQL} select id as "PaymentTransactionId", c as customer_id, round(a, 6) as "Amount"
from sc where c in (select c from sampled)""",
)
def sample_history(spark, folder):
    df = scored(spark, folder)
    out = explore.of_customers(df, explore.biased_sample(df, 0.2))
    return shown(out, ID, CUSTOMER, digits={AMOUNT: 6})


@query(
    "scatter",
    f"""with {SCORED_SQL} select id as "PaymentTransactionId", round(score, 6) as c_freq_diff_min_max_p_value,
round(slope, 6) as slope, round(ae, 6) as anomaly_ae_values, iso as label_iso
from sc where m = 'purchase'""",
)
def scatter(spark, folder):
    out = explore.scatter(
        scored(spark, folder), FREQ_SCORE, "slope", "anomaly_ae_values", "label_iso", merchant="purchase"
    )
    return shown(out, ID, "label_iso", digits={FREQ_SCORE: 6, "slope": 6, "anomaly_ae_values": 6})


def _strangest(df: DataFrame):
    """The transaction one would click on: highest score, smallest id."""
    return df.orderBy(F.desc("anomaly_ae_values"), ID).select(ID).first()[0]


CLICKED_SQL = "clicked as (select * from sc order by ae desc, id limit 1)"


@query(
    "drill_ratios",
    f"""with {CM_SQL}, {CLICKED_SQL}
select cm.* from cm where customer_id in (select c from clicked)""",
)
def drill_ratios(spark, folder):
    df = scored(spark, folder)
    return explore.customer_pairs_of(explore.pair_summary(df), df, _strangest(df))


@query(
    "drill_amounts",
    f"""with {SCORED_SQL}, {CLICKED_SQL}
select sc.id as "PaymentTransactionId", strftime(sc.t, {STAMP}) as "Created_Time", sc.a as "Amount"
from sc join clicked k on sc.c = k.c and sc.m = k.m""",
)
def drill_amounts(spark, folder):
    df = scored(spark, folder)
    return shown(explore.pair_history_of(df, _strangest(df), [AMOUNT]), ID, AMOUNT, times=(TIME,))


@query(
    "drill_freq",
    f"""with {SCORED_SQL}, {CLICKED_SQL}
select sc.id as "PaymentTransactionId", strftime(sc.t, {STAMP}) as "Created_Time",
       round(sc.x, 6) as c_freq_diff
from sc join clicked k on sc.c = k.c and sc.m = k.m""",
)
def drill_freq(spark, folder):
    df = scored(spark, folder)
    out = explore.pair_history_of(df, _strangest(df), ["c_freq_diff"])
    return shown(out, ID, digits={"c_freq_diff": 6}, times=(TIME,))


@query(
    "txn_detail",
    f"""with {SCORED_SQL}, {CLICKED_SQL}
select id as "PaymentTransactionId", c as customer_id, m as merchant_id, a as "Amount",
       strftime(t, {STAMP}) as "Created_Time", iso as label_iso, round(ae, 6) as anomaly_ae_values
from clicked""",
)
def txn_detail(spark, folder):
    df = scored(spark, folder)
    out = explore.transaction_detail(df, _strangest(df))
    return shown(
        out, ID, *PAIR, AMOUNT, "label_iso", digits={"anomaly_ae_values": 6}, times=(TIME,)
    )


# ---- model selection ----------------------------------------------------------------------------

REGRESSORS = [HOUR, "customer_freq", "day_diff"]

# The grids of the registered searches.
TREE_GRID = {"maxDepth": [2, 4], "maxIter": [20]}
FOREST_GRID = {"maxDepth": [3, 5], "numTrees": [10]}
LINEAR_GRID = {"regParam": [0.0, 0.1]}
WIDTH_GRID = [(8,), (16, 8)]
NET_EPOCHS = 10
# A setting of boosted trees that may grow far beyond what the rows set aside bear out.
LONG_BOOSTING = {"maxDepth": 4, "maxIter": 200, "stepSize": 0.3}


def _training(spark, folder):
    df = f.frequency_difference(events(spark, folder))
    ready = model_search.assembled(df, REGRESSORS, AMOUNT)
    train, test = split_ratio(ready, 0.8)
    train = model_search.with_folds(settle(train)).persist(StorageLevel.MEMORY_AND_DISK)
    return train, settle(test)


def _board(table: DataFrame) -> DataFrame:
    return shown(table, "family", "params", digits={"mse": 4})


@query("grid_gbt")
def grid_gbt(spark, folder):
    train, _ = _training(spark, folder)
    return _board(model_search.grid_search("gbt", train, TREE_GRID)[0])


@query("gbt_curve")
def gbt_curve(spark, folder):
    train, _ = _training(spark, folder)
    return shown(model_search.boosting_curve(train, LONG_BOOSTING), "round", "kept", digits={"mse": 4})


@query("grid_rf")
def grid_rf(spark, folder):
    train, _ = _training(spark, folder)
    return _board(model_search.grid_search("rf", train, FOREST_GRID)[0])


TRAINING_SQL = f"""{EVENTS}, {freq_sql('txn', 'fd')},
rows_in as (
  select id, hour(t)::double as x0, freq as x1, gap as x2, a as y,
         ('0x' || substr(md5(concat(id, '|1234')), 1, 13))::bigint / 4503599627370496.0::double < 0.8 as training
  from fd where a is not null),
train as (select *, (row_number() over (order by id) - 1) % {model_search.FOLDS} as fold from rows_in where training),
test as (select * from rows_in where not training)"""


def normal_sql() -> str:
    """Penalised normal equations of three standardised features for every fold and penalty, by determinants."""
    at = range(3)
    stats_of = [f"avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}, corr(x{i}, y) as c{i}" for i in at]
    stats_of += [f"corr(x{i}, x{j}) as r{i}{j}" for i in at for j in at if i < j]
    matrix = [["g" if i == j else f"r{min(i, j)}{max(i, j)}" for j in at] for i in at]

    def determinant(m: list[list[str]]) -> str:
        return " + ".join(
            f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})"
            for i in at
        )

    swapped = [[[f"c{i}" if j == k else matrix[i][j] for j in at] for i in at] for k in at]
    solved = ", ".join(f"({determinant(swapped[k])}) / ({determinant(matrix)}) * sy / s{k} as b{k}" for k in at)
    fitted = " + ".join(f"b{i} * (x{i} - m{i})" for i in at)
    return f"""{TRAINING_SQL},
held as (select unnest(range({model_search.FOLDS})) as h), penalty as (select unnest({LINEAR_GRID['regParam']}::double[]) as p),
mo as (select h, avg(y) as my, stddev_pop(y) as sy, {', '.join(stats_of)} from train join held on fold <> h group by h),
solved as (select *, {solved} from (select *, 1 + p / sy as g from mo, penalty)),
errors as (
  select p, h, avg((y - my - ({fitted})) ** 2) as mse
  from solved join train on fold = h group by p, h)"""


@query(
    "grid_glm",
    f"""with {normal_sql()}
select 'glm' as family, '{{''regParam'': ' || p || '}}' as params, round(avg(mse), 4) as mse from errors group by p""",
)
def grid_glm(spark, folder):
    train, _ = _training(spark, folder)
    return _board(model_search.grid_search("glm", train, LINEAR_GRID)[0])


@query("grid_dnn")
def grid_dnn(spark, folder):
    train, _ = _training(spark, folder)
    return _board(model_search.grid_dense(train, REGRESSORS, WIDTH_GRID, NET_EPOCHS)[0])


def _bests(train: DataFrame, families: tuple[str, ...] = ("gbt", "rf", "glm", "dnn")) -> list:
    grids = {"gbt": TREE_GRID, "rf": FOREST_GRID, "glm": LINEAR_GRID}
    return [
        model_search.grid_dense(train, REGRESSORS, WIDTH_GRID, NET_EPOCHS)[1]
        if name == "dnn"
        else model_search.grid_search(name, train, grids[name])[1]
        for name in families
    ]


@query("mse_leaderboard")
def mse_leaderboard(spark, folder):
    train, test = _training(spark, folder)
    return shown(model_search.leaderboard(_bests(train), test), "family", "params", digits={"mse": 4})


# Predictors of the amount as formulas, which the ranking is checked with.
FORMULAS = {"flat": "50", "daytime": "40 + 0.5 * hour", "gap": "45 + 0.01 * day_diff"}


@dataclass
class Formula:
    text: str

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.expr(f"cast({self.text} as double)"))


@query(
    "leaderboard_formulas",
    f"""with {TRAINING_SQL}, fo as (select y, x0 as hour, x2 as day_diff, training from rows_in)
{' union all '.join(
    f"""select '{name}' as family, '{{}}' as params, round(avg((y - ({text})) ** 2) filter (training), 4) as cv_mse,
       round(avg((y - ({text})) ** 2) filter (not training), 4) as mse from fo""" for name, text in FORMULAS.items())}""",
)
def leaderboard_formulas(spark, folder):
    train, test = _training(spark, folder)
    bests = []
    for name, text in FORMULAS.items():
        model = Formula(text)
        bests.append(model_search.Best(name, {}, float(model_search.mse(model.transform(train))), model))
    return shown(model_search.leaderboard(bests, test), "family", "params", digits={"cv_mse": 4, "mse": 4})


@query("stacked")
def stacked(spark, folder):
    train, test = _training(spark, folder)
    bases = _bests(train, ("gbt", "rf", "dnn"))
    stack = model_search.stacked_ensemble(bases, train, REGRESSORS)
    return shown(stack.transform(test), ID, digits={"prediction": 4})


__all__ = ["featured", "plane", "scored"]
