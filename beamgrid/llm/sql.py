"""The queries' SQL for DuckDB, where SQL can express them.

op1 (CRC-32), op2 (the tokenizer), op3 and op9 (XXH64) and op6 (name-based UUIDs, base 32) have none; tests hold them against brute force.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_OP4 = r"""
with lowered as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
d as (select row_number() over () r, * from lowered),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select item, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i, w from b where len(w) > 0),
grams as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') g from bw),
sizes as (select distinct n from grams),
dw as (select r, s.n, unnest(range(1, len(w) - s.n + 2)) i, w from d, sizes s where len(w) >= s.n),
hits as (select x.r, x.i, x.n, g.item from (select r, n, i, array_to_string(w[i:i + n - 1], ' ') g from dw) x join grams g on x.g = g.g and x.n = g.n),
covered as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from hits) group by r),
items as (select r, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from hits group by r)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join covered using (r) left join items using (r)
"""

_OP5 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, 12 + length(replace(replace(replace(r, chr(16), chr(16) || '0'), '<|', chr(16) || '1'), chr(10), chr(16) || '2')) + 1
              + length(replace(replace(x, chr(16), chr(16) || '0'), '<|', chr(16) || '1')) + 11 as size from c),
o as (select *, sum(size) over w upto, row_number() over (partition by conv_id order by turn desc nulls last, r desc, x desc) back from e
      window w as (partition by conv_id order by turn nulls first, r, x rows unbounded preceding))
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
       cast(coalesce(sum(length(x)) filter (r = 'assistant'), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
       cast(sum(case when r = 'assistant' or back = 1 then upto else 0 end) as bigint) formatted_chars
from o group by conv_id
"""

_OP7 = rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
sizes as (select unnest([5, 6, 7, 8, 9, 10]) n),
starts as (select r, n, unnest(range(1, len(w) - n + 2)) i, w from d, sizes where len(w) >= n),
keyed as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') g from starts),
twice as (select r, n, i from keyed qualify count(*) over (partition by r, n, g) > 1),
inside as (select distinct r, n, p from (select r, n, unnest(range(i, i + n)) p from twice)),
cover as (select inside.r, inside.n, count(*) words, sum(length(d.w[p])) chars from inside join d using (r) group by all),
lines as (select r, line, nth from (select r, unnest(string_split(x, chr(10))) line, generate_subscripts(string_split(x, chr(10)), 1) nth from d) where regexp_matches(line, '{_WORD}')),
later as (select r, line from lines qualify row_number() over (partition by r, line order by nth) > 1),
dup as (select r, count(*) n_dup, sum(length(array_to_string(regexp_extract_all(line, '{_WORD}'), ''))) chars from later group by r),
m as (select d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) n_symbols,
             coalesce(n_dup, 0) n_dup_lines, coalesce(dup.chars, 0) dup_line_chars,
             coalesce((select words from cover where r = d.r and n = 5), 0) n_repeat_words,
             {", ".join(f"coalesce((select chars from cover where r = d.r and n = {n}), 0) repeat_chars_{n}" for n in range(5, 11))}
      from d left join dup on dup.r = d.r),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
       cast(n_repeat_words as bigint) n_repeat_words, base_failed, cast(dup_line_chars as bigint) dup_line_chars,
       {", ".join(f"cast(repeat_chars_{n} as bigint) repeat_chars_{n}" for n in range(5, 11))},
       not (base_failed or dup_line_chars > 0.3::double * greatest(word_chars, 1)
            {" ".join(f"or repeat_chars_{n} > {limit}::double * greatest(word_chars, 1)" for n, limit in ((5, 0.20), (6, 0.19), (7, 0.18), (8, 0.17), (9, 0.16), (10, 0.15)))}) kept
from j
"""

_OP8 = r"""
with x as (select row_number() over () x, text from (select distinct text from documents where text is not null)),
d as (select row_number() over () r, doc_id, text, x from (select distinct doc_id, text from documents) join x using (text)),
lines as (select r, x, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) nth from d),
words as (select r, x, nth, regexp_extract_all(line, '[^\x20\x09-\x0D]+') w from lines),
tok as (select r, x, nth, case when 2 * len(list_filter(w, lambda v: regexp_matches(v, '[0-9]'))) > len(w) then w
                               else list_transform(w, lambda v: case when regexp_matches(v, '[0-9]') then '<*>' else v end) end t from words),
ln as (select r, x, nth, t, array_to_string(t, ' ') line, len(t) n, array_to_string(t[1:3], ' ') lead from tok where len(t) >= 3),
passages as (select n, line from ln where n > 50 group by n, line having count(distinct x) >= 2),
leaves as (select n, lead from ln group by n, lead having count(distinct x) >= 10),
few as (select ln.* from ln join leaves using (n, lead)),
uniq as (select n, lead, line, any_value(t) t, count(distinct x) docs from few group by n, lead, line),
placed as (select n, lead, line, docs, unnest(t) token, generate_subscripts(t, 1) place from uniq),
fixed as (select n, lead, place, token from placed where token <> '<*>' group by n, lead, place, token having sum(docs) >= 10),
marked as (select p.n, p.lead, p.line, p.place, f.token from placed p left join fixed f using (n, lead, place, token)),
tpl as (select n, lead, line, string_agg(coalesce(token, '<*>'), ' ' order by place) template from marked group by n, lead, line having 2 * count(token) >= any_value(n)),
found as (select few.r, few.x, few.nth, few.n, few.lead, template from few join tpl using (n, lead, line)),
often as (select n, lead, template from found group by n, lead, template having count(distinct x) >= 10),
gone as (select r, nth from found join often using (n, lead, template) union select r, nth from ln join passages using (n, line)),
kept as (select lines.r, string_agg(line, chr(10) order by lines.nth) x, count(*) n from lines left join gone using (r, nth) where gone.r is null group by lines.r),
res as (select d.doc_id, d.text, len(string_split(d.text, chr(10))) n_lines, coalesce(kept.n, 0) n_kept, coalesce(kept.x, '') x from d left join kept using (r))
select documents.doc_id, cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_lines - n_kept, 0) as bigint) n_dropped, cast(length(x) as bigint) kept_chars, sha256(x) kept_sha256
from documents left join res on documents.doc_id is not distinct from res.doc_id and documents.text is not distinct from res.text
"""

_OP10 = r"""
with recursive rules(verdict, rule, h, p) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
cut as (select page_id, url, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
parts as (select row_number() over () r, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1, 's') tail,
                 [x for x in list_concat(
                   [regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'si') for t in regexp_extract_all(html, '<link\b[^>]*>', 0, 'si') if regexp_matches(t, '\brel\s*=\s*["'']?canonical\b', 'si')][1:1],
                   [regexp_extract(t, '\burl\s*=\s*["'']?([^"''\s>;]+)', 1, 'si') for t in regexp_extract_all(html, '<meta\b[^>]*>', 0, 'si') if regexp_matches(t, '\bhttp-equiv\s*=\s*["'']?refresh\b', 'si')][1:1]) if x <> ''] targets
          from cut),
raw as (select host || tail a, url base, host bhost, replace(trim(unnest(targets)), '&amp;', '&') t from parts where host <> ''),
absolute as (select a, case when contains(t, '://') then t when starts_with(t, '//') then split_part(base, '://', 1) || ':' || t
                            when starts_with(t, '/') then split_part(base, '://', 1) || '://' || bhost || t end u from raw),
half as (select a, substr(u, instr(u, '://') + 3) rest from absolute where u is not null),
edge as (select distinct a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1, 's') b from half where regexp_extract(rest, '^[^/?#]*') <> ''),
linked as (select a, b from edge where a <> b union select b, a from edge where a <> b),
node as (select distinct a node, regexp_extract(a, '^[^/?#]*') host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1, 's') path from linked),
node_rule as (select node, arg_max(verdict, length(rule)) verdict from node join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by node),
blocked as (select node from node_rule where verdict = 'block' union select linked.b from blocked join linked on linked.a = blocked.node),
own as (select r, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by r)
select page_id, host, path, own.rule, coalesce(own.verdict, case when blocked.node is not null then 'block' else 'allow' end) verdict
from parts left join own using (r) left join blocked on blocked.node = parts.host || parts.tail
"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": _OP4,
    "op5_prefix_targets": _OP5,
    "op7_repetition": _OP7,
    "op8_log_templates": _OP8,
    "op10_redirect_filter": _OP10,
}
