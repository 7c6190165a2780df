"""SQL for the operators' queries that SQL can state."""

from __future__ import annotations

#: Words: runs of anything but ASCII white space.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP10 = rf"""
with t as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as w from documents),
f as (select doc_id, source, text, w, len(w) as n_words from t),
win as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(n_words - 3, 1))) as i from f)),
twice as (select doc_id, g from win group by all having count(*) > 1),
covered as (select doc_id, count(distinct i + k) as n from (select w.doc_id, w.i, unnest(range(0, 5)) as k from win w join twice using (doc_id, g)) group by doc_id),
lines as (select doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from t) where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct l) as n from lines group by doc_id),
base as (
  select f.doc_id, f.source, n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(dup.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
  from f left join dup using (doc_id) left join covered using (doc_id)),
ruled as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base),
hosts as (select source, count(*) as host_docs, sum(base_failed::int)::bigint as host_failures from ruled group by source),
m as (select sum(host_docs)::double as docs, sum(host_failures)::double / sum(host_docs) as mean, count(*)::double as hosts,
  sum(host_docs * (host_failures / host_docs) * (host_failures / host_docs)) / sum(host_docs) as sq from hosts),
v as (select *, mean * (1 - mean) as noise, sq - mean * mean - mean * (1 - mean) * hosts / docs as between_hosts from m),
p as (select mean, greatest(case when between_hosts > 0 then least(noise / between_hosts - 1, docs) else docs end, 1.0) as strength from v)
select r.doc_id, r.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failures,
  round((host_failures + mean * strength) / (host_docs + strength), 9) as host_rate,
  (host_failures + mean * strength) / (host_docs + strength) <= 0.5 as host_ok,
  not base_failed and (host_failures + mean * strength) / (host_docs + strength) <= 0.5 as kept
from ruled r join hosts h on r.source is not distinct from h.source cross join p
"""


#: Terms: words in lower case without the marks around them.
_TERMS = r"""list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: trim(w, '.,;:!?"''()[]{}<>#$%&*|')), lambda w: w <> '')"""

OP4 = rf"""
with t as (select doc_id, {_TERMS} as w from documents),
n as (select count(*) as docs, sum(len(w)) / count(*)::double as mean_length from t),
tf as (select doc_id, term, count(*) as n from (select doc_id, unnest(w) as term from t) group by all),
df as (select term, count(*) as df from tf group by term),
posting as (
  select tf.doc_id, term, tf.n, cast(round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 1000000
    * (tf.n * 2.2 / (tf.n + 1.2 * (0.25 + 0.75 * len(w) / mean_length)))) as bigint) as weight
  from tf join df using (term) join t using (doc_id) cross join n),
scored as (
  select q.doc_id as query_id, d.doc_id, sum(q.n * d.weight) as units
  from posting q join posting d using (term) where q.doc_id % 20 = 0 and q.doc_id <> d.doc_id group by all),
ranked as (select *, row_number() over (partition by query_id order by units desc, doc_id) as rank from scored where units > 0)
select query_id, cast(rank as integer) as rank, doc_id, cast(units as double) / 1000000 as score from ranked where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_search": OP4, "op10_quality": OP10}
