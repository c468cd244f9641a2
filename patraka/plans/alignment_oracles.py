"""Alignments and lattices as recursive DuckDB SQL, written apart from the Python code.

DuckDB's distance counts bytes, so that every letter beyond ASCII is given a byte that no word holds first;
alignments run on words in that form.
"""

from __future__ import annotations

SYMBOLS = 57  # control characters and capitals, which lower-cased words lack

#: ``utterances`` with words in bytes: human, m1, m2 and m3 as eh, e1, e2 and e3.
ENCODED = f"""
letters as materialized (
  select coalesce(string_agg(c, '' order by c), '') as own, count(*) as n from (select distinct unnest(string_split(array_to_string(human, ''), '')) as c from utterances) where unicode(c) > 126),
alphabet as materialized (
  select own, case when n > {SYMBOLS} then error('more letters than symbols') else
    array_to_string(list_transform(range(1, n + 1), lambda i: chr((case when i <= 26 then 64 + i else i - 26 end)::int)), '') end as said from letters),
encoded as materialized (
  select utt, human, m1, m2, m3, own, said, list_transform(human, lambda w: translate(w, own, said)) as eh, list_transform(m1, lambda w: translate(w, own, said)) as e1,
    list_transform(m2, lambda w: translate(w, own, said)) as e2, list_transform(m3, lambda w: translate(w, own, said)) as e3 from utterances, alphabet)"""


def aligned(name: str, source: str, first: str, second: str) -> str:
    """``name_pairs(utt, x, y)``: the alignment of two lists of ``source`` as two lists with gaps as nulls."""
    cost = "case when a[i + 1] = w then 0.0::double else levenshtein(a[i + 1], w)::double / greatest(length(a[i + 1]), length(w)) end"
    return f"""
{name}_rows as (
  select utt, {first} as a, {second} as b, 0 as i, list_transform(range(0, len({second}) + 1), lambda j: j::double) as line, []::int[][] as turns from {source}
  union all
  select utt, a, b, i + 1, next,
    list_append(turns, list_transform(range(1, len(b) + 1), lambda j: case when next[j + 1] = line[j] + costs[j] then 0 when next[j + 1] = line[j + 1] + 1 then 1 else 2 end))
  from (select *, list_reduce(list_concat([[(i + 1)::double]], list_transform(range(1, len(b) + 1), lambda j: [least(line[j] + costs[j], line[j + 1] + 1)])), lambda done, x: list_append(done, least(x[1], done[-1] + 1))) as next
    from (select *, list_transform(b, lambda w: {cost}) as costs from {name}_rows where i < len(a)))),
{name}_back as (
  select utt, a, b, len(a) as i, len(b) as j, turns, []::varchar[] as x, []::varchar[] as y from {name}_rows where i = len(a)
  union all
  select utt, a, b, case when turn < 2 then i - 1 else i end, case when turn <> 1 then j - 1 else j end, turns,
    list_prepend(case when turn < 2 then a[i] end, x), list_prepend(case when turn <> 1 then b[j] end, y)
  from (select *, case when i = 0 then 2 when j = 0 then 1 else turns[i][j] end as turn from {name}_back where i > 0 or j > 0)),
{name}_pairs as materialized (select utt, x, y from {name}_back where i = 0 and j = 0)"""


def merged(name: str, held: str, k: int) -> str:
    """``name_held(utt, places)``: the places of ``held`` with the sequence of ``name_pairs`` beside the ``k`` before."""
    gap = lambda part: f"list_transform({part}, lambda r: list_append(r, null::varchar))"
    return f"""
{name}_merge as (
  select p.utt, x, y, places, list_transform(places, lambda r: list_filter(r, lambda w: w is not null)[1]) as firsts, 0 as t, 0 as pos, []::varchar[][] as done from {name}_pairs p join {held} h on p.utt = h.utt
  union all
  select utt, x, y, places, firsts, t + 1, case when x[t + 1] is null then pos when met > 0 then pos + met else len(places) end,
    case when x[t + 1] is null then list_append(done, list_append(list_transform(range(0, {k}), lambda i: null::varchar), y[t + 1]))
      when met > 0 then list_append(list_concat(done, {gap('places[pos + 1:pos + met - 1]')}), list_append(places[pos + met], y[t + 1]))
      else list_concat(done, {gap('places[pos + 1:]')}) end
  from (select *, coalesce(list_position(firsts[pos + 1:], x[t + 1]), 0)::int as met from {name}_merge where t < len(x))),
{name}_held as materialized (select utt, list_concat(done, {gap('places[pos + 1:]')}) as places from {name}_merge where t = len(x))"""


def majorities(name: str, held: str, second: str) -> str:
    """``name_in(utt, said, e)``: the most frequent word of each place, the earliest among equals, and the next sequence."""
    best = "list_transform([list_filter(r, lambda w: w is not null)], lambda f: f[list_position(list_transform(f, lambda w: len(list_filter(f, lambda v: v = w))), list_max(list_transform(f, lambda w: len(list_filter(f, lambda v: v = w)))))])[1]"
    return f"{name}_in as materialized (select h.utt, list_transform(places, lambda r: {best}) as said, {second} as e from {held} h join encoded using (utt))"


#: ``lattices(utt, lattice)`` of the human words and m1, m2, m3 in turn.
LATTICES = ",\n".join(
    [
        ENCODED,
        "start_held as (select utt, list_transform(eh, lambda w: [w]) as places from encoded)",
        aligned("one", "encoded", "eh", "e1"),
        merged("one", "start_held", 1),
        majorities("two", "one_held", "e2"),
        aligned("two", "two_in", "said", "e"),
        merged("two", "one_held", 2),
        majorities("three", "two_held", "e3"),
        aligned("three", "three_in", "said", "e"),
        merged("three", "two_held", 3),
        """lattices as materialized (
  select h.utt, list_transform(places, lambda r: list_sort(list_distinct(list_transform(list_filter(r, lambda w: w is not null), lambda w: translate(w, said, own))))) as lattice from three_held h, alphabet)""",
    ]
)
PAIRS = ENCODED + ",\n" + aligned("one", "encoded", "eh", "e1")
