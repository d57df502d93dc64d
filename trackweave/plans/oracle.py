"""Building blocks of the SQL that DuckDB checks results with."""

from __future__ import annotations

from trackweave import constants as C
from trackweave.sources import fixtures

TRACKS = fixtures.TRACKS_SQL.replace("\nfrom embeddings", ",\n embedding\nfrom embeddings")
POSITION = "((case split_part(key, ' ', 1) " + " ".join(f"when '{p}' then {s}" for p, s in C.SEMITONES.items()) + " end + case when lower(split_part(key, ' ', 2)) = 'minor' then 3 else 0 end) % 12 * 7) % 12"
RELATIVE = "case when regexp_matches(file_path, '^/music/.+/') then regexp_extract(file_path, '^/music/(.+)/[^/]*$', 1) else '.' end"


def factors(direct_only: bool = False) -> str:
    rows = [f"(cast({f} as double), '{t}')" for f, t in C.TEMPO_FACTORS if not direct_only or t == "direct"]
    return "(values " + ", ".join(rows) + ") f(factor, edge_type)"


def prepared(where: str = "true") -> str:
    return f"select ord, bpm, {POSITION} as pos, cast(embedding as double[]) as e from tracks where {where}"


def pairs(left: str = "prepared", right: str = "prepared", direct_only: bool = False, oriented: bool = True) -> str:
    """Components of all pairs of two relations in some factor's band."""
    pct = "abs(a.bpm - b.bpm * f.factor) / least(a.bpm, b.bpm * f.factor) * 100.0"
    order = "a.ord < b.ord and" if oriented else ""
    return f"""select a.ord as src, b.ord as dst, f.edge_type, least(abs(a.pos - b.pos), 12 - abs(a.pos - b.pos)) / 6.0 as harmonic,
 ({pct}) / 8.0 as tempo, greatest(0.0, least(1.0, (1 - coalesce(list_cosine_similarity(a.e, b.e), 0)) / 2)) as semantic
 from {left} a, {right} b, {factors(direct_only)} where {order} a.bpm > 0 and b.bpm > 0 and {pct} <= 8.0"""


def weight(weights: dict | None = None, penalties: dict | None = None) -> str:
    w = C.WEIGHTS | (weights or {})
    cost = f"(harmonic * {w['harmonic']}::double + tempo * {w['tempo']}::double + semantic * {w['semantic']}::double)"
    for name, value in (penalties or {}).items():
        cost += f" + case when edge_type = '{name}' then {value}::double else 0 end"
    return cost


def with_edges(select: str, recursive: str = "", weights: dict | None = None, penalties: dict | None = None, direct_only: bool = False) -> str:
    """``select`` over ``tracks``, ``edges(src, dst, edge_type, weight, ...)`` and ``adj``."""
    head = "with recursive" if recursive else "with"
    return f"""{head} tracks as ({TRACKS}), prepared as ({prepared()}), parts as materialized ({pairs(direct_only=direct_only)}),
edges as materialized (select *, {weight(weights, penalties)} as weight from parts),
adj as materialized (select src as node, dst as other, weight, edge_type from edges union all select dst, src, weight, edge_type from edges){recursive}
{select}"""


def shortest(sources: str, usable: str = "true") -> str:
    """A recursive relation ``d(leg, node, dist)`` of least costs."""
    return f""", usable as materialized (select * from adj where {usable}),
d(leg, node, dist) using key (leg, node) as (
 select * from (values {sources}) s(leg, node, dist)
 union
 select d.leg, u.other, min(d.dist + u.weight) from d join usable u on d.node = u.node
 left join recurring.d r on r.leg = d.leg and r.node = u.other
 where r.dist is null or d.dist + u.weight < r.dist group by d.leg, u.other)"""


def route(legs: list[tuple[int, int]], select: str) -> str:
    """``select`` over ``way(pos, ord, dist, leg)``: the tracks of the cheapest path through
    the ``legs``, junctions once.  Nodes are followed back from each leg's end, to whichever
    neighbour's least cost and edge make up the node's."""
    sources = ", ".join(f"({i}, {a}::bigint, 0.0::double)" for i, (a, _) in enumerate(legs))
    ends = ", ".join(f"({i}, {b}::bigint)" for i, (_, b) in enumerate(legs))
    more = f""", parents as materialized (select d.leg, d.node, min(u.other) as parent from d join usable u on u.node = d.node join d p on p.leg = d.leg and p.node = u.other
 where d.dist > 0 and p.dist + u.weight = d.dist group by d.leg, d.node),
trail(leg, node, back) as (select leg, node, 0 from (values {ends}) e(leg, node) union all select t.leg, p.parent, t.back + 1 from trail t join parents p on p.leg = t.leg and p.node = t.node),
placed as (select t.leg, t.node, d.dist, row_number() over (partition by t.leg order by t.back desc) - 1 as hops from trail t join d on d.leg = t.leg and d.node = t.node),
way as (select cast(row_number() over (order by leg, hops) - 1 as bigint) as pos, node as ord, leg, dist + coalesce((select sum(e.dist) from (select leg, max(dist) as dist from placed group by leg) e where e.leg < placed.leg), 0) as dist
 from placed where leg = 0 or hops > 0)"""
    return with_edges(select, shortest(sources) + more)


def fuzzy(k: int, rounds: int) -> str:
    """Weights of the fuzzy graph over each track's ``k`` nearest by cosine; the rate of each
    neighbourhood by as many halvings, one relation each."""
    text = f"""with t as ({TRACKS}), v as materialized (select ord, cast(embedding as double[]) as e from t),
pair as materialized (select a.ord as a, b.ord as b, 2 * round((1 - list_cosine_similarity(a.e, b.e)) / 2, 12) as d from v a, v b where a.ord <> b.ord),
best as (select *, row_number() over (partition by a order by d, b) as n from pair),
link as materialized (select distinct least(a, b) as x, greatest(a, b) as y, d from best where n <= {k}),
both_ways as (select x as a, y as b, d from link union all select y, x, d from link),
near as materialized (select a, b, d from (select *, row_number() over (partition by a order by d, b) as n from both_ways) where n <= {k}),
rho as materialized (select a, coalesce(min(d) filter (d > 0), 0) as rho from near group by a),
s0 as (select a, 0.0::double as low, null::double as high, 1.0::double as sigma from rho)"""
    for i in range(rounds):
        text += f""",
t{i} as (select s.a, sum(exp(-greatest(d - rho, 0) / sigma)) > log2({k}) as much from s{i} s join near using (a) join rho using (a) group by s.a),
s{i + 1} as materialized (select a, low, high, case when high is null then sigma * 2 else (low + high) / 2 end as sigma
 from (select a, case when much then low else sigma end as low, case when much then sigma else high end as high, sigma from s{i} join t{i} using (a)))"""
    return text + f""",
one as (select a, b, exp(-greatest(d - rho, 0) / greatest(sigma, 1e-3)) as w from near join rho using (a) join s{rounds} using (a))
select least(a, b) as src, greatest(a, b) as dst, round(sum(w) - case when count(*) = 2 then product(w) else 0 end, 6) as weight from one group by 1, 2"""
