"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {
    "op5_quality_rules": r"""
with d as (
    select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (
    select r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l
    from d),
g as (
    select r, unnest(range(1, len(w) - 3)) as p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g
    from w where len(w) >= 5),
m as (select r, p, count(*) over (partition by r, g) as n from g),
c as (
    select r, sum(least(5, coalesce(q - p, 5))) as n_repeat_words
    from (select r, p, lead(p) over (partition by r order by p) as q from m where n > 1) group by r),
x as (
    select doc_id, source, cast(len(w) as bigint) as n_words,
        cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
        cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(len(l) as bigint) as n_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
    from w left join c using (r)),
h as (
    select source, count(*) as n, unnest(['a', 'b', 'c', 'd']) as rule,
        unnest([count(*) filter (n_words < 10), count(*) filter (100 * n_repeat_words > 20 * n_words),
            count(*) filter (10 * n_symbols > word_chars), count(*) filter (10 * n_dup_lines > 3 * n_lines)]) as f
    from x where source is not null group by source),
p as (select rule, sum(f) / sum(n) as m, sum(f * f / n) / sum(n) as s, sum(n) as docs, count(*) as hosts from h group by rule),
s as (select rule, m, s - m * m - (hosts - 1) * m * (1 - m) / docs as v from p),
k as (select rule, m, case when v > 1e-12 then least(greatest(m * (1 - m) / v - 1, 1), 1000) else 1000 end as k from s),
b as (select source, bool_or((f + k * m) / (n + k) > 0.5) as bad from h join k using (rule) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, coalesce(bad, false) as host_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not coalesce(bad, false) as kept
from x left join b using (source)
""",
    "op6_chat_format": r"""
with t as (
    select conv_id, turn, role as speaker, replace(coalesce(text, ''), '<|', '< |') as body from conversations),
p as (select distinct conv_id as c, speaker as perspective from t where speaker is not null and speaker <> 'system'),
x as (
    select conv_id, perspective, turn, speaker, body,
        case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user' end as role,
        case when speaker = perspective then '<|assistant|>' when speaker = 'system' then '<|system|>'
            when speaker is null then '<|user|>' else '<|user name=' || replace(speaker, '<|', '< |') || '|>' end || chr(10) as head
    from t join p on conv_id is not distinct from c),
y as (select *, head || body || '<|end|>' || chr(10) as segment from x),
z as (
    select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective
        order by turn nulls first, speaker nulls first, body rows between unbounded preceding and 1 preceding), 0) as start
    from y)
select conv_id, perspective, turn, speaker, role, segment, cast(start as bigint) as start,
    cast(case when role = 'assistant' then start + length(head) end as bigint) as mask_start,
    cast(case when role = 'assistant' then start + length(segment) end as bigint) as mask_end
from z
""",
}
