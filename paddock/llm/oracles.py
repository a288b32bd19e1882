"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

from paddock.llm.linededup import RUN_WORDS
from paddock.llm.quality import LEAST_WORDS, LEFT_SHARE, LINE_DOCS, LINE_SHARE, MOST_REPEATED

_WS = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '')"

OP2 = rf"""with raw as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
ex as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from raw where text is not null),
ln as (select doc_id, pos, line, len(list_filter(regexp_split_to_array(line, '{_WS}'), lambda x: x <> '')) as words from ex),
pl as (select *, sum(words) over (partition by doc_id order by pos) as ends from ln where words > 0),
ps as (select *, ends - words as starts from pl),
w as (select doc_id, min(pos) over a as first, max(pos) over a as last, max(ends) over a - min(starts) over a as words, list(line) over a as run from ps window a as (partition by doc_id order by starts range between current row and {RUN_WORDS - 1} following)
  union all select doc_id, min(pos) over b, max(pos) over b, max(ends) over b - min(starts) over b, list(line) over b from ps window b as (partition by doc_id order by ends range between {RUN_WORDS - 1} preceding and current row)),
wd as (select distinct doc_id, first, last, array_to_string(run, chr(10)) as run from w where words >= {RUN_WORDS}),
lt as (select *, row_number() over (partition by run order by doc_id, first) as nth, min(doc_id * 1000000 + first) over (partition by run) as origin from wd),
gone as (select distinct doc_id, unnest(range(first, last + 1)) as pos from lt where doc_id * 1000000 + first > origin),
kept as (select ex.doc_id, ex.pos, line, gone.pos is not null as lost from ex left join gone on ex.doc_id = gone.doc_id and ex.pos = gone.pos),
ag as (select doc_id, count(*) as n_lines, count(*) filter (lost) as n_removed, coalesce(string_agg(pos::varchar, ',' order by pos) filter (lost), '') as removed_lines,
  string_agg(line, chr(10) order by pos) filter (not lost) as rest, coalesce(bool_or(not lost and regexp_replace(line, '{_WS}', '', 'g') <> ''), false) as any_left from kept group by doc_id),
fin as (select r.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed_lines, '') as removed_lines, case when r.text is null then null when coalesce(n_removed, 0) = 0 then r.text when any_left then rest else '' end as text from raw r left join ag on r.doc_id = ag.doc_id)
select doc_id, n_lines, n_removed, removed_lines, len({_WORDS}) as words_left, sha256(text) as text_sha256 from fin"""

OP4 = rf"""with d as (select row_number() over () as row, doc_id, text, source, {_WORDS} as ws from documents),
wx as (select row, unnest(ws) as w, unnest(range(len(ws))) as i from d),
win as (select row, i, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from wx window o as (partition by row order by i)),
dup as (select row, i from (select row, i, count(*) over (partition by row, w, w2, w3) as n from win where w3 is not null) where n > 1),
rep as (select row, count(distinct i + k) as n from dup, range(0, 3) as r(k) group by row),
lx as (select row, unnest(string_split(text, chr(10))) as line from d where text is not null),
ly as (select row, line from lx where regexp_replace(line, '{_WS}', '', 'g') <> ''),
dl as (select row, count(*) - count(distinct line) as n from ly group by row),
base as (select d.row, doc_id, source, text, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dl.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from d left join dl on dl.row = d.row left join rep on rep.row = d.row),
dt as (select distinct source, text from documents where text is not null),
nl as (select source, text, lower(unnest(string_split(text, chr(10)))) as l from dt),
nn as (select source, text, trim(regexp_replace(l, '{_WS}', ' ', 'g')) as l, len(list_filter(regexp_split_to_array(l, '{_WS}'), lambda x: x <> '')) as words from nl),
ll as (select source, text, l, sum(words) as words from nn where words > 0 group by 1, 2, 3),
fq as (select source, l, count(*) as n from ll group by 1, 2 having count(*) > {LINE_DOCS}),
hs as (select source, count(distinct text) as host from documents group by 1),
fr as (select fq.source, l from fq join hs on fq.source is not distinct from hs.source where n > host * {LINE_SHARE}),
fl as (select ll.source, text, count(*) as n from ll join fr on fr.l = ll.l and fr.source is not distinct from ll.source group by 1, 2),
dp as (select ll.source, text from ll left join fr on fr.l = ll.l and fr.source is not distinct from ll.source group by 1, 2 having sum(case when fr.l is null then words else 0 end) < sum(words) * {LEFT_SHARE})
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and dp.text is null as kept, coalesce(fl.n, 0) as lines_frequent
from base b left join dp on dp.text = b.text and dp.source is not distinct from b.source left join fl on fl.text = b.text and fl.source is not distinct from b.source"""

_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<SYS>|</SYS>|</?SYS>)', '\1\\.\2', 'g')"

OP7 = rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, lag(role) over (partition by conv_id order by turn) as before from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESCAPED.format("text")}) + case when before = role then 8 else 24 + length({_ESCAPED.format("role")}) end)::bigint as formatted_chars
from t group by conv_id"""

OP11 = f"""with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hexed from pages),
w as (select *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hexed, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  row_number() over (partition by hexed order by page_id nulls last) as nth, first_value(page_id) over (partition by hexed order by page_id nulls last) as origin from p)
select page_id, payload_bytes, payload_digest, case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then origin end as refers_to, null::varchar as problem from w"""

#: CRC-32 by table, bit by bit: each of eight steps halves the remainder.
_STEP = "(case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
_CRC = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: " + _STEP + "))"
OP12 = rf"""with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) as i,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as h, length(coalesce(text, '')) as size from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as donor, xor({_CRC}, 4294967295) % 6 as head from (select distinct conv_id from t)),
u as (select c.conv_id, t.i, t.h, t.size from c join t on t.conv_id = c.donor and t.i <= c.head union all select c.conv_id, 1000000 + t.i, t.h, t.size from c join t on t.conv_id = c.conv_id and t.i > c.head),
r as (select conv_id, row_number() over o as depth, size, string_agg(h, '') over (partition by conv_id order by i rows unbounded preceding) as k from u window o as (partition by conv_id order by i)),
m as (select conv_id, depth, size, k from r union all select conv_id, 0, 0, '' from c),
e as (select conv_id, max(depth) as ends from m group by 1),
n as (select k, depth, min(m.conv_id) as conv_id, count(*) as n_convs, min(size) as size, coalesce(string_agg(m.conv_id::varchar, ',' order by m.conv_id) filter (ends = depth), '') as told from m join e on e.conv_id = m.conv_id group by 1, 2),
kids as (select substr(k, 1, length(k) - 32) as k, count(*) as n_children from n where depth > 0 group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join kids on kids.k = n.k),
up as (select f.*, unnest(range(0, depth + 1)) as d from f),
s as (select substr(k, 1, 32 * d) as k, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * size) as saved_tokens from up group by 1)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(f.told) as ends_sha256
from f join s on s.k = f.k left join f p on f.depth > 0 and p.k = substr(f.k, 1, length(f.k) - 32)"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')"
OP13 = f"""with d as (select row_number() over () as row, doc_id, {_TERMS} as ts from documents),
dn as (select row, doc_id, len(ts) as n, ts from d where len(ts) > 0),
g as (select count(*) as nn, sum(n)::bigint as ll from dn),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
p as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(ts) as term from dn) where term in (select term from q) group by 1, 2, 3, 4),
w as (select term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from p group by 1), g),
sc as (select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))))::bigint as score from q join p using (term) join w using (term), g group by 1, 2, 3),
rk as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from sc where score > 0)
select item_id, rank::int as rank, doc_id, score from rk where rank <= 50"""

ORACLES = {"op2_line_dedup": OP2, "op4_quality": OP4, "op7_chat": OP7, "op11_warc": OP11, "op12_trie": OP12, "op13_search": OP13}
