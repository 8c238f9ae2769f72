"""DuckDB SQL of the operators' queries.

Projections, fingerprints (XXH64), byte-wise repeats, models, spans of disguises and samples can't be said in SQL or are too
slow there; those queries are tested against brute force, round trips or held-out accuracy.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
with own as (select doc_id, string_split(coalesce(text, ''), chr(10)) as own from documents),
lines as (select doc_id, unnest(own) as line, generate_subscripts(own, 1) as place from own),
keyed as (select *, regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as key from lines),
common as (select key, max(doc_id) as stays from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select doc_id, line, place, stays is null or stays = doc_id as kept from keyed left join common using (key))
select doc_id, count(*) as n_lines, count(*) filter (not kept) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (kept), '')) as kept_sha256
from marked group by doc_id""",
    "op3_url_filter": rf"""
with pages_ as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
marks as (select doc_id as page_id, min(case when quality = 1 and toxic = 0 then 1 else 0 end) as good from labels where doc_id is not null and quality is not null and toxic is not null group by doc_id),
hosts as (select host, string_split(host, '.') as l, count(*) as n, sum(good) as s from pages_ join marks using (page_id) group by host),
placed as (select host, n, s, l[-1] as suffix, array_to_string(l[-2:], '.') as domain from hosts),
domains as (select domain, suffix, sum(n) as n, sum(s) as s from placed group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(s) as s from domains group by suffix),
root as (select (coalesce(sum(s), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1.0::double) as m from suffixes),
suffix_sums as (select sum(m * (1 - m)) as noise, sum(m * (1 - m) * (n - 1)) as pairs, sum((s - n * m) * (s - n * m) / n) as seen from suffixes, root),
suffix_k as (select round(least(1000.0::double, greatest(1.0::double, coalesce(case when seen > noise then pairs / (seen - noise) - 1 else 1000.0 end, 1000.0))), 6) as ks from suffix_sums),
suffix_m as (select suffix, (ks * m + s) / (ks + n) as ms from suffixes, root, suffix_k),
domain_sums as (select sum(ms * (1 - ms)) as noise, sum(ms * (1 - ms) * (n - 1)) as pairs, sum((s - n * ms) * (s - n * ms) / n) as seen from domains join suffix_m using (suffix)),
domain_k as (select round(least(1000.0::double, greatest(1.0::double, coalesce(case when seen > noise then pairs / (seen - noise) - 1 else 1000.0 end, 1000.0))), 6) as kd from domain_sums),
domain_m as (select domain, suffix, (kd * ms + s) / (kd + n) as md from domains join suffix_m using (suffix), domain_k),
host_sums as (select sum(md * (1 - md)) as noise, sum(md * (1 - md) * (n - 1)) as pairs, sum((s - n * md) * (s - n * md) / n) as seen from placed join domain_m using (domain, suffix)),
host_k as (select round(least(1000.0::double, greatest(1.0::double, coalesce(case when seen > noise then pairs / (seen - noise) - 1 else 1000.0 end, 1000.0))), 6) as kh from host_sums),
host_m as (select host, kh * md + s as a, kh * (1 - md) + n - s as b from placed join domain_m using (domain, suffix), host_k),
asked as (select distinct host, string_split(host, '.') as l from pages_),
known as (
select asked.host, coalesce(a / (a + b), md, ms, root.m) as mean,
coalesce(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), sqrt(coalesce(md, ms, root.m) * (1 - coalesce(md, ms, root.m)) * (1 - (1 - 1 / (kh + 1)) * (case when md is null then 1 - 1 / (kd + 1) else 1 end) * (case when md is null and ms is null then 1 - 1 / (ks + 1) else 1 end)))) as deviation
from asked left join host_m using (host) left join domain_m on domain_m.domain = array_to_string(l[-2:], '.') left join suffix_m on suffix_m.suffix = l[-1], root, suffix_k, domain_k, host_k),
bounds as (select host, mean, least(1.0, mean + 1.645 * deviation) as upper from known),
ruled as (select *, case
when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule from pages_ join bounds using (host))
select page_id, host, path, rule, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block' when upper < 0.5 then 'block' else 'allow' end as verdict, round(mean, 6) as mean, round(upper, 6) as upper from ruled""",
    "op10_decontamination": rf"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as text from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
places as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as text from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct n from windows) where len(w) >= n)),
hits as (select doc_id, item_id, i, n from places join windows using (n, text)),
covered as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from (select distinct doc_id, i, n from hits)) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (doc_id) left join named using (doc_id)""",
}
