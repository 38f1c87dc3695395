"""SQL of the clustering learners: unrolled seeds, recursive rounds."""

from __future__ import annotations

from oddlot.operators.clusters import (
    FIXED_BITS, KMEANS_ROUNDS, MAX_K, MIXTURE_FLOOR, MIXTURE_PARTS, MIXTURE_STEPS, MIXTURE_TOLERANCE,
)


def kmeans_sql(columns: list[str], max_k: int = MAX_K, points: str = "rfm") -> str:
    """Centres ``fin(k, l, c0, c1, ...)`` of a table of points for every k, as unrolled seeds and recursive rounds."""
    at = [f"x{i}" for i in range(len(columns))]
    xs = ", ".join(at)
    order = f"d desc, {xs}"

    def square(p: str, q: str) -> str:
        return " + ".join(f"({p}.{x} - {q}.{x}) * ({p}.{x} - {q}.{x})" for x in at)

    def mean(p: str) -> str:
        return ", ".join(f"sum({p}.{x}::bigint)::double / count(*) as {x}" for x in at)

    seeds = [f"""seed1 as materialized (select 0 as l, {xs} from (
  select pt.*, {square('pt', 'mid')} as d from pt, mid) order by {order} limit 1)"""]
    for j in range(2, max_k + 1):
        seeds.append(f"""seed{j} as materialized (select * from seed{j - 1} union all (select {j - 1}, {xs} from (
  select pt.{', pt.'.join(at)}, min({square('pt', 's')}) as d from pt, seed{j - 1} s group by pt.{', pt.'.join(at)})
  where d > 0 order by {order} limit 1))""")
    return f"""scale as materialized (
  select pow(2, {FIXED_BITS} - ceil(log2(max(greatest({', '.join(f'abs({c})' for c in columns)}))))) as f from {points}),
pt as materialized (
  select {', '.join(f'floor({c} * f + 0.5) as {x}' for c, x in zip(columns, at))} from {points}, scale),
mid as materialized (select {mean('pt')} from pt),
{', '.join(seeds)},
rounds as (
  select 0 as step, k, l, {xs} from seed{max_k}, (select unnest(range(1, {max_k + 1})) as k)
  where l < k and k <= (select count(*) from seed{max_k})
  union all
  select step + 1, k, l, {xs} from (
    select *, bool_or({' or '.join(f'{x} <> o{x}' for x in at)}) over (partition by k) as moved from (
      select c.step, c.k, c.l, {', '.join(f'c.{x} as o{x}, coalesce(n.{x}, c.{x}) as {x}' for x in at)}
      from rounds c left join (
        select k, best.l as l, {mean('near')} from (
          select p.*, c.k, min({{'d': {square('p', 'c')}, 'l': c.l}}) as best
          from (select row_number() over () as i, * from pt) p, rounds c group by all) near
        group by k, best.l) n on n.k = c.k and n.l = c.l))
  where moved and step < {KMEANS_ROUNDS}),
fin as materialized (
  select k, row_number() over (partition by k order by {xs}) - 1 as l,
         {', '.join(f'{x} / f as c{i}' for i, x in enumerate(at))}
  from rounds join (select k, max(step) as step from rounds group by k) using (k, step), scale),
near as materialized (
  select {points}.*, k, min({{'d': {' + '.join(f'({c} - c{i}) * ({c} - c{i})' for i, c in enumerate(columns))}, 'l': l}}) as best
  from {points}, fin group by all),
sweep as materialized (select k, avg(sqrt(best.d)) as distance from near group by k)"""


def mixture_sql(columns: list[str], parts: int = MIXTURE_PARTS, points: str = "rfm") -> str:
    """Mixture ``mix(j, w, m0, m1, ..., v)`` of a table of points, after ``kmeans_sql`` of the same points."""
    d = len(columns)
    xs = [f"x{i}" for i in range(d)]
    size = " + ".join(f"{x} * {x}" for x in xs)
    away = " + ".join(f"(p.{x} - e.m{i}) * (p.{x} - e.m{i})" for i, x in enumerate(xs))
    near = " + ".join(f"(p.{x} - c.c{i}) * (p.{x} - c.c{i})" for i, x in enumerate(xs))
    sums = ", ".join(f"sum(r * {x}) as s{i}" for i, x in enumerate(xs))
    means = ", ".join(f"s{i} / mass as m{i}" for i in range(d))
    square = " + ".join(f"s{i} / mass * s{i} / mass" for i in range(d))
    moved = f"mass / n as w, {means}, greatest((q / mass - ({square})) / {d}, 0) + {MIXTURE_FLOOR!r} as v"
    mass = f"sum(r) + 10 * pow(2::double, -52) as mass, {sums}, sum(r * ({size})) as q"
    return f"""px as materialized (
  select row_number() over () as i, {', '.join(f'{x} / f as {x}' for x in xs)} from pt, scale),
own as materialized (
  select p.*, min({{'d': {near}, 'l': c.l}}).l as j
  from px p, fin c where c.k = (select max(k) from fin) group by all),
em as (
  select 0 as step, j, {moved}, '-inf'::double as ll, 'inf'::double as gap
  from (select j, (select count(*) from px) as n, {mass} from (select *, 1.0::double as r from own) group by j)
  union all
  select step + 1, j, {moved}, lls / n, abs(lls / n - ll) from (
    select step, j, any_value(ll) as ll, count(*) as n, sum(l) as lls, {mass} from (
      select *, exp(p - l) as r from (
        select *, top + ln(sum(exp(p - top)) over (partition by i)) as l from (
          select *, max(p) over (partition by i) as top from (
            select p.*, e.step, e.j, e.ll, ln(w) - {d / 2} * ln(2 * pi() * v) - ({away}) / (2 * v) as p
            from px p, em e where gap >= {MIXTURE_TOLERANCE!r} and step < {MIXTURE_STEPS}))))
    group by step, j)),
mix as materialized (select * from em where step = (select max(step) from em))"""
