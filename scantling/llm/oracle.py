"""SQL of the corpus queries, for those that SQL can express over whole tables."""

from __future__ import annotations

ALNUM = r"replace(replace(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g')), 'ß', 'ss'), 'ς', 'σ')"

_KEYS = rf"""
mail as (
  select sample_id, text, regexp_extract(text, '\A((?:[ \t]*(?:subject|from|to|date)[ \t]*:[^\n]*(?:\n|\z))+)', 1, 'i') as head
  from enron where text is not null),
mail_keys as (
  select 'enron' as dataset, sample_id,
    array_to_string(list_sort(list_transform(list_filter(string_split(head, chr(10)), lambda x: regexp_matches(x, '^[ \t]*(?:subject|from|to|date)[ \t]*:', 'i')), lambda x: {ALNUM.format("x")})), chr(1))
    || chr(2) || {ALNUM.format("text[length(head) + 1:]")} as key
  from mail),
items as (
  select 'sms' as dataset, sample_id, text as t from sms where text is not null
  union all select 'mask', sample_id, proposition from mask where proposition is not null),
parts as (
  select *, list_filter(regexp_split_to_array(t, '[;|]'), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]')) as p from items),
item_keys as (
  select dataset, sample_id,
    case when len(p) > 1 and len(list_filter(p, lambda x: not regexp_matches(x, '^[^\p{{L}}\p{{N}}]*\p{{L}}[\p{{L}}\p{{N}} _-]{{0,40}}:'))) = 0
      then array_to_string(list_sort(list_transform(p, lambda x: {ALNUM.format("x")})), chr(1))
      else {ALNUM.format("t")} end as key
  from parts),
keys as (select * from mail_keys union all select * from item_keys)
"""

P1_FOUND = f"""
with {_KEYS},
firsts as (select *, min(sample_id) over (partition by dataset, key) as a from keys)
select dataset, a as sample_id_a, sample_id as sample_id_b from firsts where sample_id <> a
"""

P1_RECORDS = f"""
with {_KEYS}
select dataset, min(sample_id) as sample_id, count(*) as copies from keys group by dataset, key
"""

P3_FOUND = """
with best as (
  select distinct dataset, model, balance_mode, k, run_id, test_recall_at_1pct_fpr as s from runs
  where s is not null and s::varchar <> 'nan'),
ranked as (
  select *, row_number() over (partition by dataset, model, balance_mode, k order by s desc, run_id) as pos from best),
entries as (
  select vec_id, unnest(range(len(x))) as i, abs(unnest(x)) as v from activations where x is not null),
strong as (
  select *, row_number() over (partition by vec_id order by v desc, i) as pos from entries where v is not null and v::varchar <> 'nan')
select 'runs' as source, concat_ws('|', dataset, model, balance_mode, k) as group_key, cast(pos as int) as pos, run_id as item from ranked where pos <= 3
union all
select 'activations', cast(vec_id as varchar), cast(pos as int), cast(i as varchar) from strong where pos <= 3
"""

P6_FOUND = f"""
with recursive {_KEYS},
nodes as (
  select sample_id, 'q' || category || chr(1) || question_id as k from mask where question_id is not null and category is not null
  union all select sample_id, 'p' || key from keys where dataset = 'mask'),
pairs as (select distinct x.sample_id as u, y.first as v from nodes x join (select k, min(sample_id) as first from nodes group by k) y using (k)),
links as (select u, v from pairs union select v, u from pairs),
reach as (
  select sample_id as node, sample_id as root from mask
  union
  select l.v, r.root from reach r join links l on l.u = r.node where r.root < l.v),
roots as (select node, min(root) as root from reach group by node)
select root as sample_id_a, node as sample_id_b from roots where node <> root
"""

P5_FOUND = r"""
with sides as (
  select distinct model, 'train' as side, unnest(train_pool) as id from splits where dataset = 'enron'
  union select model, 'held', unnest(eval) from splits where dataset = 'enron'
  union select model, 'held', unnest(test) from splits where dataset = 'enron'),
words as (select sample_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from enron where text is not null),
shingles as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) as s from words where len(w) >= 3),
sizes as (select id, count(*) as n from shingles group by id),
common as (select x.id as x, y.id as y, count(*) as c from shingles x join shingles y on x.s = y.s and x.id < y.id group by x.id, y.id),
near as (
  select x, y from common join sizes a on a.id = x join sizes b on b.id = y where c >= 0.6 * (a.n + b.n - c)
  union all select id, id from sizes)
select distinct t.model, least(t.id, h.id) as sample_id_a, greatest(t.id, h.id) as sample_id_b
from sides t join sides h on t.model = h.model and t.side = 'train' and h.side = 'held'
join near on near.x = least(t.id, h.id) and near.y = greatest(t.id, h.id)
union
select t.model, t.id, t.id from sides t join sides h on t.model = h.model and t.id = h.id and t.side = 'train' and h.side = 'held'
join enron on enron.sample_id = t.id
"""

P9_FOUND = r"""
with grams as (
  select 'i' as side, item_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from heldout_items
  union all select 'd', doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') from documents),
runs as (select side, id, unnest(list_transform(range(1, len(w) - 10), lambda i: w[i:i + 11])) as g from grams where len(w) >= 12)
select distinct d.id as doc_id, i.id as item_id from runs d join runs i on d.g = i.g and d.side = 'd' and i.side = 'i'
"""


P9_PASSAGES = r"""
with grams as (
  select 'i' as side, item_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from heldout_items
  union all select 'd', doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') from documents),
runs as (select side, id, unnest(range(1, len(w) - 10)) as at, unnest(list_transform(range(1, len(w) - 10), lambda i: w[i:i + 11])) as g from grams where len(w) >= 12)
select d.id as doc_id, i.id as item_id, count(distinct i.at)::int as windows from runs d join runs i on d.g = i.g and d.side = 'd' and i.side = 'i' group by d.id, i.id
"""

P5_REPORT = r"""
with train as (select distinct model, unnest(train_pool) as id from splits where dataset = 'enron'),
held as (
  select model, 'eval' as split, unnest(eval) as id from splits where dataset = 'enron'
  union select model, 'test', unnest(test) from splits where dataset = 'enron'),
words as (select sample_id as id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from enron where text is not null),
shingles as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) as s from words where len(w) >= 3),
sizes as (select id, count(*) as n from shingles group by id),
common as (select x.id as x, y.id as y, count(*) as c from shingles x join shingles y on x.s = y.s group by x.id, y.id),
near as (select x, y from common join sizes a on a.id = x join sizes b on b.id = y where c >= 0.6 * (a.n + b.n - c)),
links as (
  select h.model, h.split, b.source, h.id, a.w = b.w as same from held h join near on near.y = h.id join train t on t.model = h.model and t.id = near.x
  join words a on a.id = t.id join words b on b.id = h.id)
select model, split, source, count(distinct id) as mails, count(distinct id) filter (same) as exact, count(*) as links from links group by model, split, source
"""

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _p10_shares() -> str:
    from scantling.llm.quality import COMMON, END

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return rf"""
with parts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+') as w, length(regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g')) as dense,
  list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_SPACE}+$', '')), lambda x: x <> '') as lines from documents),
sums as (select *, len(array_to_string(w, '')) as letters from parts)
select doc_id, len(w) as words, case when len(w) > 0 then round(letters / len(w), 6) end as mean_word_length, case when dense > 0 then round((dense - letters) / dense, 6) end as symbol_share,
  case when len(lines) > 0 then round(len(list_filter(lines, lambda x: right(x, 1) in ({", ".join(map(quoted, END))}))) / len(lines), 6) end as line_end_share,
  case when len(w) > 0 then round(len(list_filter(w, lambda x: lower(x) in ({", ".join(map(quoted, sorted(COMMON)))}))) / len(w), 6) end as common_share
from sums
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND, "p1_records": P1_RECORDS, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p6_found": P6_FOUND, "p9_found": P9_FOUND, "p9_passages": P9_PASSAGES, "p10_shares": _p10_shares(),
    }
