"""DuckDB statements that give the rows of queries that SQL can express."""

from tidewright.sources.tables import CLASSES as _NAMES

CLASSES = ", ".join(_NAMES)

#: A text without blanks, case and marks that aren't between two digits.
_BARE = r"""list_aggregate(list_filter(list_transform(range(1, length({x}) + 1), lambda i: lower(substr({x}, i, 1))
  || case when regexp_matches(substr({x}, i, 1), '[\p{{P}}\p{{S}}\p{{C}}]') and not (i > 1 and regexp_matches(substr({x}, i - 1, 1), '[0-9]') and regexp_matches(substr({x}, i + 1, 1), '[0-9]'))
          or regexp_matches(substr({x}, i, 1), '[\s\p{{Z}}]') then '~drop' else '' end), lambda c: not contains(c, '~drop')), 'string_agg', '')"""

_COPIES = rf"""
with part as (select row_id, unnest(string_split_regex(item, '[;|]')) as t from ratings where patient is not null and physician is not null and item is not null),
bare as (select row_id, {_BARE.format(x="t")} as b from part),
items as (select row_id, string_agg(b, '#' order by b) as k from bare where b is not null and b <> '' group by row_id),
keyed as (select r.row_id, md5(concat_ws('#', {_BARE.format(x="patient")}, physician, coalesce(k, ''), sheet, cast(rated_at as varchar),
    {", ".join(f"coalesce(cast({c} as varchar), '?')" for c in CLASSES.split(", "))})) as k
  from ratings r left join items i on r.row_id = i.row_id where patient is not null and physician is not null and item is not null)
"""

_WORDS = r"""
with words as (select row_id, split, unnest(regexp_extract_all(lower(item_string), '[a-z0-9]+')) as w from study_rows where split is not null),
bag as (select row_id, split, w, count(*) as c from words group by all),
size as (select row_id, sum(c) as n from bag group by row_id),
pairs as (select t.row_id as row_t, e.row_id as row_e, sum(least(t.c, e.c)) as common from bag t join bag e on t.w = e.w and t.split = 'train' and e.split <> 'train' group by all),
near as (select row_t, row_e from pairs join size a on a.row_id = row_t join size b on b.row_id = row_e where 10 * common >= 4 * (a.n + b.n))
"""

_VOTES = """
with held as (select pair_id, category, physician, arg_max(coalesce(vote, -1), (voted_at, loaded_at, label_id)) as vote from observer_votes where physician is not null group by all),
item as (select pair_id, category, count(*) as n, sum(vote) as ones from held where vote >= 0 group by all)
"""



def _rounds(n: int) -> str:
    """Expectation-maximisation in n rounds, each two small tables of parameters and the posteriors that follow."""
    w = "(partition by pair_id, category)"
    out = [f"e0 as materialized (select pair_id, category, physician, vote, count(*) over {w} as n, (sum(vote) over {w} + 0.5) / (count(*) over {w} + 1.0) as p from held where vote >= 0)"]
    for i in range(1, n + 1):
        out.append(f"o{i} as materialized (select physician, (sum(p * vote) + 2) / (sum(p) + 3) as sens, (sum((1 - p) * (1 - vote)) + 2) / (sum(1 - p) + 3) as spec from e{i - 1} group by physician)")
        out.append(f"c{i} as materialized (select category, (sum(p / n) + 1) / (sum(1.0 / n) + 2) as prior from e{i - 1} group by category)")
        odds = f"sum(case when vote = 1 then ln(sens) - ln(1 - spec) else ln(1 - sens) - ln(spec) end) over (partition by pair_id, e.category) + ln(prior) - ln(1 - prior)"
        out.append(f"e{i} as materialized (select pair_id, e.category, e.physician, vote, n, 1 / (1 + exp(-({odds}))) as p from e{i - 1} e join o{i} o on o.physician = e.physician join c{i} c on c.category = e.category)")
    return ",\n".join(out)


SQL = {
    "p4_found": _VOTES.rstrip() + ",\n" + _rounds(25) + "\nselect distinct pair_id, category from e25 where p >= 0.5",
    "p1_found": r"""
with recursive ids as (
  select row_id, n from (select row_id, unnest(['0:' || nullif(regexp_extract(patient_id, '^[^0-9]*?0*([0-9]+?)(\.0+)?[^0-9]*$', 1), ''),
    '1:' || nullif(regexp_extract(author_id, '^[^0-9]*?0*([0-9]+?)(\.0+)?[^0-9]*$', 1), ''), '2:' || nullif(regexp_extract(source_id, '^[^0-9]*?0*([0-9]+?)(\.0+)?[^0-9]*$', 1), '')]) as n from study_rows) where n is not null),
edge as (select distinct a.n as a, b.n as b from ids a join ids b on a.row_id = b.row_id),
reach(a, p) using key (a) as (
  select n as a, min(case when n like '0:%' then cast(substr(n, 3) as bigint) end) as p from ids group by n
  union
  select e.b, min(r.p) from reach r join edge e on e.a = r.a join recurring.reach q on q.a = e.b where r.p is not null and (q.p is null or r.p < q.p) group by e.b)
select i.row_id, min(r.p) as group_no from ids i join reach r on r.a = i.n group by i.row_id""",
    "p3_found": _COPIES + "select first_id, row_id from (select row_id, min(row_id) over (partition by k) as first_id from keyed) where row_id <> first_id",
    "p3_copies": _COPIES + "select min(row_id) as first_id, count(*) as n_copies from keyed group by k",
    "p4_agreement": _VOTES
    + """
select category, n_items, n_votes, observed, expected, case when expected > 0 then 1 - observed / expected end as alpha from (
  select category, count(*) as n_items, cast(sum(n) as bigint) as n_votes, sum(2.0 * ones * (n - ones) / (n - 1)) / sum(n) as observed,
    2.0 * sum(ones) * (sum(n) - sum(ones)) / (sum(n) * (sum(n) - 1.0)) as expected from item where n > 1 group by category)""",
    "p5_found": _WORDS + "select least(row_t, row_e) as row_id_a, greatest(row_t, row_e) as row_id_b from near",
    "p5_links": _WORDS
    + """,
own as (select row_id, any_value(split) as split, string_agg(w, ' ' order by w) as s from words group by row_id),
class as (select s, min(row_id) as class_id from own group by s)
select distinct ce.class_id as class_eval, ct.class_id as class_train, cast(p.common as int) as n_common, cast(a.n + b.n as int) as n_words
from pairs p join size a on a.row_id = row_t join size b on b.row_id = row_e join own t on t.row_id = row_t join class ct on ct.s = t.s join own e on e.row_id = row_e join class ce on ce.s = e.s
where 10 * p.common >= 4 * (a.n + b.n)""",
    "p5_members": _WORDS
    + """,
own as (select row_id, any_value(split) as split, string_agg(w, ' ' order by w) as s from words group by row_id)
select row_id, min(row_id) over (partition by s) as class_id, split = 'train' as in_train from own""",
    "p5_report": _WORDS
    + """,
same as (select distinct e.row_id as row_e from (select row_id, string_agg(w, ' ' order by w) as s from words where split = 'train' group by all) t
  join (select row_id, string_agg(w, ' ' order by w) as s from words where split <> 'train' group by all) e on t.s = e.s),
links as (select row_e, count(*) as links from near group by row_e)
select s.split, s.source_id, count(*) as n_rows, cast(count(x.row_e) as bigint) as n_exact, cast(count(l.row_e) as bigint) as n_overlapping, cast(coalesce(sum(links), 0) as bigint) as n_links
from study_rows s left join same x on x.row_e = s.row_id left join links l on l.row_e = s.row_id where s.split <> 'train' group by s.split, s.source_id""",
}
