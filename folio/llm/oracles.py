"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

import re

from . import quality as Q

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = f"""with recursive w as (select doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as x from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
both_ as (select a, b from link union all select b, a from link),
reach as (select a, b from both_ union select r.a, e.b from reach r join both_ e on r.b = e.a),
least_ as (select a, min(b) as b from reach group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(l.b, w.doc_id)) as component_id, w.doc_id = least(w.doc_id, coalesce(l.b, w.doc_id)) as kept from w left join n on n.doc_id = w.doc_id left join least_ l on l.a = w.doc_id"""

OP7 = """with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages), f as (select *, min(page_id) over (partition by d) as first_ from p)
select page_id, n as payload_bytes, d as payload_digest, case when n >= 100 and first_ <> page_id then 'revisit' else 'response' end as record_type, case when n >= 100 and first_ <> page_id then first_ end as refers_to from f"""

OP8 = f"""with l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
k as (select *, {_LOWER.format(t=f"trim(line, {_BLANK})")} as key from l), bad as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
j as (select k.*, bad.key is not null as gone from k left join bad on bad.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from j group by 1"""

_WORDS = "regexp_extract_all(" + _LOWER.format(t="coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10 = f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
bw as (select item_id, least(10, len(w)) as n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) as x from b where len(w) > 0),
sizes as (select distinct n from bw), dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as at_, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as x from d, sizes where len(w) >= n),
h as (select dw.doc_id, dw.n, dw.at_, bw.item_id from dw join bw on bw.n = dw.n and bw.x = dw.x),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(at_, at_ + n)) as p from (select distinct doc_id, at_, n from h)) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from h) group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id"""

_TERMS = "regexp_extract_all(" + _LOWER.format(t="coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""with tf as (select doc_id, t, count(*) as tf from (select doc_id, unnest({_TERMS}) as t from documents) group by 1, 2),
n as (select doc_id, sum(tf) as n from tf group by 1), c as (select count(*) as docs, sum(n) as len from n), m as (select doc_id, 50 + cast(50 * n * docs as bigint) // cast(len as bigint) as m from n, c),
q as (select distinct item_id, unnest({_TERMS}) as t from benchmark),
w as (select t, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from (select t, count(*) as df from tf group by 1), c),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from q join tf using (t) join w using (t) join m using (doc_id) group by 1, 2 having sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 50"""

_NEAREST = "select vec_id, p, arg_min(e, d * 256 + e) as e, min(d) as d from (select vec_id, p, e, sum((x - c) * (x - c)) as d from k join {book} using (p, j) group by 1, 2, 3) group by 1, 2"
_BETTER = "select p, e, j, coalesce(cast(floor(s / n) as bigint), c) as c from {book} left join (select p, e, j, sum(x) as s, count(*) as n from {near} join k using (vec_id, p) group by 1, 2, 3) using (p, e, j)"
OP11 = f"""with fine as (select vec_id, label, embedding as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
k as (select vec_id, label, i // (len(v) // 16) as p, i % (len(v) // 16) as j, cast(floor(256 * cast(v[i + 1] as double)) as bigint) as x from (select *, unnest(range(len(v))) as i from fine)),
b0 as (select p, e - 1 as e, j, x as c from (select *, dense_rank() over (order by vec_id) as e from k) where e <= 64),
n0 as ({_NEAREST.format(book="b0")}), b1 as ({_BETTER.format(book="b0", near="n0")}), n1 as ({_NEAREST.format(book="b1")}), b2 as ({_BETTER.format(book="b1", near="n1")}), n2 as ({_NEAREST.format(book="b2")}),
r as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from n2 group by 1)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(cast(c as varchar), ',' order by p, e, j)) from b2) as codebooks_sha256 from r join fine using (vec_id)"""

_COUNT = "length(line) - length(regexp_replace(line, '[{c}]', '', 'g'))"
_PHRASES = "|".join(re.escape(p).replace("\\ ", " ") for p in Q.PHRASES)
_END = "[" + Q.TERMINAL + "][" + Q.CLOSING.replace("]", "\\]").replace("'", "''") + "\\x20\\x09-\\x0D]*$"
OP12 = f"""with l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
x as (select *, len(regexp_extract_all(line, '{Q.WORD}')) as n, {_COUNT.format(c="^" + chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D")} as size, {_COUNT.format(c=Q.SYMBOLS)} as symbols, {_COUNT.format(c=Q.SEPARATORS)} as separators,
  {_COUNT.format(c="A-Z")} as capitals, {_COUNT.format(c="A-Za-z")} as letters, {_LOWER.format(t="line")} as low, row_number() over (partition by doc_id, line order by pos) > 1 as dup from l),
f as (select *, not regexp_matches(line, '{_END}') or 100 * symbols > {Q.SYMBOLS_PERCENT} * n or (separators >= 2 and {Q.MENU_WORDS} * separators >= n) or 2 * capitals > letters
  or not regexp_matches(line, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]') or (n <= {Q.PHRASE_WORDS} and regexp_matches(low, '{_PHRASES}')) as failed from x),
a as (select doc_id, cast(sum(n) as bigint) as n_words, cast(sum(size) as bigint) as word_chars, cast(sum(symbols) as bigint) as n_symbols, count(*) filter (dup and n > 0) as n_dup_lines, coalesce(sum(size) filter (failed and n > 0), 0) as lost from f group by 1),
w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{Q.WORD}') as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as x from w where len(w) >= 5),
r as (select doc_id, count(distinct i) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as i from (select *, count(*) over (partition by doc_id, x) as c from g) where c > 1) group by 1),
v as (select a.*, coalesce(n_repeat_words, 0) as n_repeat_words, n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words as base_failed from a left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost <= 30 * word_chars as kept from v"""
