"""SQL that grows the isolation forests: samples by hashed order, cuts by md5 units, recursive levels."""

from __future__ import annotations

from oddlot.detectors.isolation import PATH_BITS, SEED


def forest_sql(d: int, trees: int, rows: int, extended: bool = False, seed: int = SEED) -> str:
    """``nodes`` and ``scores(id, score)`` of a forest.

    Needs the tables ``fitted`` and ``scored`` with ``id`` and ``x0``, ``x1``, ... up to ``d`` columns.
    """
    at = range(d)
    xs = ", ".join(f"x{i}" for i in at)

    def unit(number: int) -> str:
        salt = f"concat('{seed}|', tree, '|', node, '|{number}')"
        return f"(('0x' || substr(md5({salt}), 1, 13))::bigint / 4503599627370496.0::double)"

    def path(size: str) -> str:
        return f"""(case when {size} > 2 then 2 * (ln({size} - 1) + 0.5772156649015329) - 2 * ({size} - 1)::double / {size}
                 when {size} = 2 then 1.0 else 0.0 end)"""

    bits = f"pow(2::double, {PATH_BITS})"
    if extended:
        feature = "-1"
        normals = [f"sqrt(-2 * ln(1 - {unit(3 * i)})) * cos(2 * pi() * {unit(3 * i + 1)})" for i in at]
        cut = " + ".join(f"(l{i} + {unit(3 * i + 2)} * (h{i} - l{i})) * w{i}" for i in at)
        side = " + ".join(f"x{i} * w{i}" for i in at)
    else:
        usable = ", ".join(f"case when h{i} > l{i} then {i} end" for i in at)
        usable = f"list_filter([{usable}], lambda f: f is not null)"
        feature = f"{usable}[1 + floor({unit(0)} * len({usable}))::int]"
        normals = ["0.0"] * d
        cut = "case feature " + " ".join(f"when {i} then l{i} + {unit(1)} * (h{i} - l{i})" for i in at) + " end"
        side = "case feature " + " ".join(f"when {i} then x{i}" for i in at) + " end"
    normals = ", ".join(f"{n} as w{i}" for i, n in enumerate(normals))
    ranges = ", ".join(f"min(x{i}) {{0}} as l{i}, max(x{i}) {{0}} as h{i}" for i in at)
    weights = ", ".join(f"w{i}" for i in at)
    splits = "depth < (select h from total) and size > 1 and (" + " or ".join(f"h{i} > l{i}" for i in at) + ")"
    return f"""total as materialized (
  select n, k, n // k as runs, greatest(1, ceil(log2(greatest(k, 2)))) as h
  from (select count(*) as n, least(count(*), {rows}) as k from fitted)),
draws as (
  select pass, runs, k, {xs},
         row_number() over (partition by pass order by md5(concat(id, '|', {seed} + pass)), id) - 1 as place
  from fitted, total, (select unnest(range({trees})) as pass) where pass * runs < {trees}),
sampled as materialized (
  select pass * runs + place // k as tree, {xs} from draws
  where place // k < runs and pass * runs + place // k < {trees}),
grown as (
  select tree, 0::bigint as node, 0 as depth, {xs} from sampled
  union all
  select tree, 2 * node + case when {side} <= cut then 1 else 2 end, depth + 1, {xs}
  from (select *, {cut} as cut from (select *, {feature} as feature, {normals} from (
    select *, count(*) over node_rows as size, {ranges.format('over node_rows')}
    from grown window node_rows as (partition by tree, node))))
  where {splits}),
inner_nodes as materialized (
  select *, {cut} as cut from (select *, {feature} as feature, {normals} from (
    select tree, node, depth, count(*) as size, {ranges.format('')} from grown group by tree, node, depth))
  where {splits}),
nodes as materialized (
  select tree, node, 2 * node + 1 as "left", 2 * node + 2 as "right", size, feature, cut as threshold from inner_nodes
  union all
  select tree, node, -1, -1, coalesce(size, 0), -1, 0.0
  from (select tree, 2 * node + side as node from inner_nodes, (select unnest([1, 2]) as side)
        union select tree, 0 from sampled) every
  left join (select tree, node, count(*) as size from grown group by tree, node) using (tree, node)
  anti join inner_nodes using (tree, node)),
routed as (
  select id, {xs}, tree, 0::bigint as node, 0 as depth from scored, (select unnest(range({trees})) as tree)
  union all
  select id, {xs}, tree, 2 * node + case when {side} <= cut then 1 else 2 end, depth + 1
  from (select r.id, {', '.join(f'r.x{i}' for i in at)}, tree, node, r.depth, cut, feature, {weights}
        from routed r join inner_nodes using (tree, node))),
scores as materialized (
  select id, pow(2, -(sum(depth + floor({path('size')} * {bits} + 0.5) / {bits}) / {trees})
                    / greatest((select {path('k')} from total), 1e-12)) as score
  from routed join nodes using (tree, node) where nodes."left" < 0 group by id)"""
