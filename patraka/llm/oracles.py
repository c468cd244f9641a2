"""DuckDB SQL for the training-data queries that SQL can express; written apart from the Spark code.

The others have none: fingerprints (XXH64), suffixes (too slow on whole tables), classifiers, tokenizers,
samplers, approximate search and sentence rules are tested against brute force or the libraries instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from patraka.llm.mix import MOST, NEAR, SCHEDULES, WEIGHTS

SQL: dict[str, str] = {}

SQL["op3_warc"] = """
with own as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as size from pages),
told as (select *, min(page_id) over (partition by body) as first from own)
select page_id, size::bigint as payload_bytes, sha256(body) as payload_digest,
  case when size >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when size >= 100 and page_id <> first then first end as refers_to
from told"""

SQL["op7_embedding_dedup"] = """
with recursive good as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from good),
near as (select a.vec_id as u, b.vec_id as w from normed a join normed b on a.vec_id < b.vec_id and list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
links as (select u, w from near union all select w, u from near),
reach as (select vec_id as u, vec_id as w from embeddings union select r.u, l.w from reach r join links l on r.w = l.u),
lowest as (select u, min(w) as component_id from reach group by u),
counted as (select u, count(*) as n from links group by u)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join lowest l on e.vec_id = l.u left join counted c on e.vec_id = c.u"""


def position(share: str, schedule: Sequence[tuple[float, float]]) -> str:
    """Training time by which a schedule's cumulative demand reaches ``share`` of its whole."""
    knots = list(zip(schedule, schedule[1:]))
    parts = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in knots]
    whole = sum(parts)
    cases, reached = [], whole
    for ((t0, a), (t1, b)), part in reversed(list(zip(knots, parts))):
        reached -= part
        need, slope = f"greatest({share} * {whole}::double - {reached}::double, 0)", (b - a) / (t1 - t0)
        time = f"{t0}::double + coalesce(2 * {need} / nullif({a}::double + sqrt(greatest({a * a}::double + {2 * slope}::double * {need}, 0)), 0), 0)"
        cases.append(f"when {share} * {whole}::double < {reached + part}::double then least({time}, {t1}::double)")
    return f"case {' '.join(reversed(cases))} else {float(schedule[-1][0])}::double end"


_WEIGHT = " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS))
_POSITION = " ".join(f"when {i} then {position('share', s)}" for i, s in enumerate(SCHEDULES))
SQL["op8_source_mix"] = f"""
with recursive sized as (
  select doc_id, source, md5(coalesce(doc_id::varchar, md5(coalesce(text, ''))) || '|mix') as turn,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda w: w <> ''))::bigint as size from documents),
summed as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (select *, row_number() over (order by source nulls last) - 1 as place from summed),
sources as (select *, (case place % {len(WEIGHTS)} {_WEIGHT} end)::double as weight, {MOST}.0::double * source_size as most from placed),
rates as (
  select 0 as step, 0::bigint as n, (select sum(source_size) from sources)::double / (select sum(weight) from sources) as rate
  union all
  select step + 1, above, (total - full_) / rest from (
    select step, n, count(*) filter (weight * rate > most) as above, sum(source_size)::double as total,
      coalesce(sum(most) filter (weight * rate > most), 0) as full_, sum(weight) filter (weight * rate <= most) as rest
    from rates, sources group by step, n, rate)
  where above > n and rest > 0),
aimed as (select s.*, least(most, weight * (select arg_max(rate, step) from rates)) as target from sources s),
queued as (select d.doc_id, d.size, d.turn, a.place, a.source_size, a.target, row_number() over (partition by a.place order by d.turn, d.doc_id, d.size) as nth, count(*) over (partition by a.place) as many
  from sized d join aimed a on d.source is not distinct from a.source),
-- one document after the other, {MOST} times over: what fits the rest of the target is taken, until one doesn't and hardly any is left
walk as (
  select place, any_value(target) as target, any_value(many) as many, 0::bigint as step, 0::bigint as taken, false as fits, false as stopped from queued group by place
  union all
  select place, target, many, step + 1, taken + case when takes then size else 0 end, takes, stopped or (size > target - taken and target - taken <= {NEAR}::double * target) from (
    select w.place, w.target, w.many, w.step, w.taken, w.stopped, q.size, not w.stopped and q.size > 0 and q.size <= w.target - w.taken as takes
    from walk w join queued q on q.place = w.place and q.nth = w.step % w.many + 1 where w.step < {MOST} * w.many)),
taken_up as (select w.place, (w.step - 1) % w.many + 1 as nth, count(*) as fits, min(w.taken) as reached from walk w where w.fits group by 1, 2),
ended as (select place, max(taken) as taken from walk group by place),
-- the rest goes to the one document nearest in size, if that comes nearer to the target
tried as (select q.*, coalesce(t.fits, 0) as fits, t.reached - q.size as first_start, e.taken as sum_taken, q.target - e.taken as gap
  from queued q join ended e using (place) left join taken_up t using (place, nth)),
ranked as (select *, fits < {MOST} and size > 0 and abs(size - gap) < gap as may from tried),
filled as (select *, may and row_number() over (partition by place order by case when may then abs(size - gap) end nulls last, turn, doc_id, size) = 1 as fills from ranked),
shared as (select *, fits + fills::int as copies, coalesce((case when fits > 0 then first_start when fills then sum_taken end)::double / nullif(target, 0), 0) as share from filled)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies::int as copies,
  case when copies > 0 then case place % {len(SCHEDULES)} {_POSITION} end end as first_position
from shared"""
