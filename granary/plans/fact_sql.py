"""Facts of whole texts in DuckDB SQL: words, runs of digits and numbers as rows with their places."""

from __future__ import annotations

from collections.abc import Sequence

from granary.functions import entities as en
from granary.functions import scalars as fn

BLANK = r"[ \t\n\x0B\f\r]"
MONTHS = "|".join("".join(f"[{c}{c.upper()}]" for c in m) for m in en.MONTHS)
COUNCILS = "|".join((*en.COUNCILS, *en.COUNCIL_NAMES))
# The check digit of n, digit by digit from the last one on.
CHECKED = f"list_reduce(list_prepend(0, list_transform(range(12), lambda i: i * 10 + substr(n, 12 - i, 1)::int)), lambda c, x: substr([{', '.join(map(repr, fn.VERHOEFF_D))}][c + 1], substr([{', '.join(map(repr, fn.VERHOEFF_P))}][x // 10 % 8 + 1], x % 10 + 1, 1)::int + 1, 1)::int) = 0"
# What stands before a number, with the dots inside initials as ~; neighbouring dots need several turns.
JOINED = f"upper(substr(t, greatest(b - {en.LABEL_WINDOW}, 1), least(b - 1, {en.LABEL_WINDOW})))"
for _turn in range(8):
    JOINED = rf"regexp_replace({JOINED}, '(^|[^A-Z])([A-Z])\.([A-Z])($|[^A-Z])', '\1\2~\3\4', 'g')"


def _said(words: Sequence[str], text: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _listed(words: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _around(n: int) -> str:
    return rf"upper(regexp_replace(substr(t, greatest(b - {n}, 1), least(b - 1, {n}) + e - b + {n}), '{BLANK}+', ' ', 'g'))"


def _sorted(values: str) -> str:
    return f"array_to_string(list_sort(list_distinct({values})), ',')"


def _day(y: str, m: str, d: str) -> str:
    return f"(case when length({y}) = 2 then (case when {y} < '80' then '20' else '19' end) || {y} else {y} end) || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"


def _parts(between: str) -> str:
    return f"regexp_replace(regexp_replace(x, '[<>]', '', 'g'), '{between}', '.', 'g')"


def _part(i: int, dotted: str) -> str:
    return f"string_split({dotted}, '.')[{i}]"


#: Mobile numbers and dates as plain patterns have them, then all kinds of facts, each kind sorted.
ENTITIES = rf"""with docs as (select doc_id, coalesce(text, '') as t from documents),
pieces as (select doc_id, unnest(l) as tok, generate_subscripts(l, 1) as i from (select doc_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') as l from docs)),
words as (select *, b + length(tok) as e from (select *, (1 + coalesce(sum(length(tok)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0))::bigint as b, regexp_full_match(tok, '[0-9]+') as digits, lag(tok) over (partition by doc_id order by i) as gap, lag(tok, 2) over (partition by doc_id order by i) as word from pieces)),
marked as (select doc_id, string_agg(case when digits then '<' || tok || '>' when regexp_full_match(tok, '({MONTHS})[A-Za-z]*') then tok when regexp_matches(tok, '^[\p{{L}}\p{{N}}_]') then 'x' else regexp_replace(tok, '[<>]', '~', 'g') end, '' order by i) as s from words group by doc_id),
runs as (select doc_id, min(b) as b, max(e) as e, string_agg('<' || tok || '>', '-' order by i) as run from (select *, sum(case when coalesce(regexp_full_match(word, '[0-9]+') and regexp_full_match(gap, '{BLANK}|-'), false) then 0 else 1 end) over (partition by doc_id order by i) as r from words where digits) group by doc_id, r),
grouped as (select doc_id, regexp_replace(unnest(regexp_extract_all(run, '<[0-9]{{4}}(?:>-<)?[0-9]{{4}}(?:>-<)?[0-9]{{4}}>')), '[^0-9]', '', 'g') as n from runs),
nationals as (select doc_id, {_sorted('list(n)')} as national_ids from grouped where n >= '2' and {CHECKED} group by doc_id),
healths as (select doc_id, {_sorted('list(n)')} as health_ids from (select doc_id, regexp_replace(unnest(regexp_extract_all(run, '<[0-9]{{2}}(?:>-<)?[0-9]{{4}}(?:>-<)?[0-9]{{4}}(?:>-<)?[0-9]{{4}}>')), '[^0-9]', '', 'g') as n from runs join docs using (doc_id) where {_said(en.HEALTH_WORDS, _around(en.HEALTH_WINDOW))}) group by doc_id),
codes as (select doc_id, tok as n, {_around(en.SCHEME_WINDOW)} as near from words join docs using (doc_id) where regexp_full_match(tok, '[A-Z][A-Z0-9]{{7,11}}|[0-9]{{12,15}}')),
schemes as (select doc_id, {_sorted('list(n)')} as scheme_ids from codes where {_said(en.SCHEME_WORDS, 'near')} and n >= 'A' and n not in {_listed(en.NOT_SCHEME_IDS)}
  or n < 'A' and {_said((*en.SCHEME_WORDS, *en.MEMBER_WORDS), 'near')} and not (length(n) = 12 and n >= '2' and {CHECKED}) group by doc_id),
said as (select doc_id, upper(tok) as number, ' ' || trim(regexp_replace(replace(replace({JOINED}, '~', ''), '#', ' # '), '[^\p{{L}}\p{{N}}#]+', ' ', 'g')) as w from words join docs using (doc_id) where regexp_full_match(tok, '[A-Za-z]?[0-9]{{3,7}}') and (gap is null or regexp_matches(gap, '[ \t\n\x0B\f\r.:#/-]$'))),
named as (select doc_id, number, regexp_extract(w, ' ({COUNCILS})( (REG|REGISTRATION|NO|NUMBER|#))*$', 1) as council from said where regexp_matches(w, ' ({COUNCILS})( (REG|REGISTRATION|NO|NUMBER|#))*$| (REG|REGISTRATION)( (NO|NUMBER|#))+$')),
doctors as (select doc_id, {_sorted("list(council || ':' || number)")} as registrations from named a where council <> '' or not exists (select 1 from named b where b.doc_id = a.doc_id and b.number = a.number and b.council <> '') group by doc_id),
dates as (select doc_id, unnest(list_transform(regexp_extract_all(s, '<[0-9]{{4}}>-<[0-9]{{2}}>-<[0-9]{{2}}>'), lambda x: regexp_replace(x, '[<>]', '', 'g'))) as d from marked
  union all select doc_id, case when b <= '12' then {_day('y', 'b', 'a')} when a <= '12' then {_day('y', 'a', 'b')} end as d from (select doc_id, lpad({_part(1, 'x')}, 2, '0') as a, lpad({_part(2, 'x')}, 2, '0') as b, {_part(3, 'x')} as y from (select doc_id, {_parts("[/-]")} as x from (select doc_id, unnest(regexp_extract_all(s, '<[0-9]{{1,2}}>[/.-]<[0-9]{{1,2}}>[/.-]<[0-9]{{2,4}}>')) as x from marked)))
  union all select doc_id, {_day('y', 'm', 'a')} as d from (select doc_id, {_part(1, 'x')} as a, list_position([{', '.join(map(repr, en.MONTHS))}], lower({_part(2, 'x')}[1:3]))::varchar as m, {_part(3, 'x')} as y from (select doc_id, {_parts(BLANK + "+")} as x from (select doc_id, unnest(regexp_extract_all(s, '<[0-9]{{1,2}}>{BLANK}+(?:{MONTHS})[A-Za-z]*{BLANK}+<[0-9]{{2,4}}>')) as x from marked)))),
calendar as (select doc_id, {_sorted('list(d)')} as days from dates where d between '1900-01-01' and '2100-12-31' and length(d) = 10 and try_cast(d as date) is not null group by doc_id),
numbers as (select *, (1 + coalesce(sum(length(tok)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0))::bigint as b from (select doc_id, unnest(l) as tok, generate_subscripts(l, 1) as i from (select doc_id, regexp_extract_all(t, '[0-9][0-9,]*(?:\.[0-9]{{1,2}})?|[^0-9]+') as l from docs))),
paid as (select doc_id, replace(tok, ',', '')::double as v from numbers join docs using (doc_id) where regexp_matches(tok, '^[0-9]') and (regexp_matches(upper(regexp_replace(substr(t, greatest(b - 12, 1), least(b - 1, 12)), ' +$', '')), '(RS|RS\.|INR|₹|RUPEES)$')
  or regexp_matches(upper(regexp_replace(substr(t, b + length(tok), 12), '^ +', '')), '^(/-|RS|INR|RUPEES|ONLY)') and not regexp_matches(substr(t, greatest(b - 1, 1), least(b - 1, 1)), '[\p{{L}}_]'))),
amounts as (select doc_id, array_to_string(list_transform(list_sort(list_distinct(list(v))), lambda v: printf('%.2f', v)), ',') as amounts from paid where v > 0 group by doc_id)
select doc_id, len(regexp_extract_all(t, '[6-9][0-9]{{9}}'))::bigint as n_mobile, len(regexp_extract_all(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))::bigint as n_dates, regexp_extract(t, '[6-9][0-9]{{9}}') as first_mobile,
  coalesce(registrations, '') as registrations, coalesce(national_ids, '') as national_ids, coalesce(scheme_ids, '') as scheme_ids, coalesce(health_ids, '') as health_ids,
  {_sorted("list_transform(list_filter(regexp_extract_all(t, '[0-9]+'), lambda n: regexp_full_match(n, '(91)?[6-9][0-9]{9}')), lambda n: n[-10:])")} as mobiles, coalesce(days, '') as days, coalesce(amounts, '') as amounts
from docs left join doctors using (doc_id) left join nationals using (doc_id) left join schemes using (doc_id) left join healths using (doc_id) left join calendar using (doc_id) left join amounts using (doc_id)"""
