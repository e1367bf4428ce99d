"""DuckDB SQL with the same rows as those queries that SQL can express, over whole tables."""

from __future__ import annotations

from .license_scan import PHRASES, SHARE, TEMPLATES, WIDTH, _pieces
from .mixing import WORD
from .url_filter import PATTERNS, pattern_regex

_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
starts as (select rid, unnest(range(1, len(w) - 33)) as s from d),
windows as (select d.rid, s.s, md5(array_to_string(w[s.s : s.s + 34], ' ')) as h from d join starts s on s.rid = d.rid),
twice as (select rid, s from (select rid, s, count(*) over (partition by h) as n from windows) t where n > 1),
gone as (select distinct rid, unnest(range(s, s + 35)) as p from twice),
placed as (select d.rid, i.p, d.w[i.p] as word from d, lateral (select unnest(range(1, len(d.w) + 1)) as p) i),
kept as (select p.rid, string_agg(p.word, ' ' order by p.p) as text from placed p anti join gone g on g.rid = p.rid and g.p = p.p group by p.rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from d left join kept k on k.rid = d.rid left join (select rid, count(*) as n from gone group by rid) g on g.rid = d.rid
"""

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP5 = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_SMALL.format("coalesce(text, '')")}, '{_PLAIN}') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_SMALL.format("coalesce(text, '')")}, '{_PLAIN}') as w from benchmark where item_id is not null),
bw as (select distinct item, n, array_to_string(w[s : s + n - 1], ' ') as g from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from b where len(w) > 0) t),
dw as (select rid, n, s, array_to_string(w[s : s + n - 1], ' ') as g from (select d.rid, d.w, k.n, unnest(range(1, len(d.w) - k.n + 2)) as s from d cross join (select distinct n from bw) k) t),
hits as (select dw.rid, dw.s, dw.n, bw.item from dw join bw on bw.n = dw.n and bw.g = dw.g),
covered as (select rid, count(distinct p) as n from (select rid, unnest(range(s, s + n)) as p from hits) t group by rid),
items as (select rid, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct rid, item from hits) t group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n, 0) as bigint) as n_hit, cast(coalesce(i.n, 0) as bigint) as n_items, sha256(coalesce(i.ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from d left join covered c on c.rid = d.rid left join items i on i.rid = d.rid
"""

OP6 = rf"""
with d as (select doc_id, case when source is null then 'n' else 'c' || source end as k, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size,
  substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 3) as slice from documents),
src as (select k, cast(sum(size) as bigint) as source_size from d group by k),
weighed as (select *, [5, 2, 1][(row_number() over (order by k) - 1) % 3 + 1] as weight from src),
totals as (select *, 1.5::double * sum(source_size) over () - 2 * coalesce(sum(source_size) over (order by source_size / weight, k rows between unbounded preceding and 1 preceding), 0) as wanted,
  sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, k rows between unbounded preceding and 1 preceding), 0) as open from weighed),
level as (select *, weight * wanted / open as own, cast(2 * source_size as double) as most from totals),
first_open as (select wanted, open from level where own <= most order by source_size / weight, k limit 1),
aim as (select l.k, l.source_size, case when l.own > l.most then l.most else l.weight * f.wanted / f.open end as target from level l left join first_open f on true),
numbered as (select d.*, row_number() over (partition by k order by size, slice, doc_id) as nth from d),
cut as (select n.doc_id, n.size, a.source_size, a.target, n.nth, coalesce(a.target / nullif(cast(a.source_size as double), 0), 0) as rate,
  cast(('0x' || substr(md5('1:' || n.k), 1, 8)) as bigint) / 4294967296.0::double as start from numbered n join aim a on a.k = n.k)
select doc_id, size, source_size, target, cast(least(floor(start + rate * nth) - floor(start + rate * (nth - 1)), ceil(rate)) as bigint) * size as taken from cut
"""


def _op7(rules) -> str:
    told = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    quoted = [(pattern_regex(p).replace("(?<![a-z0-9])", "(?:)").replace("(?![a-z0-9])", "(?:)"), v) for p, v in PATTERNS]
    # DuckDB's expressions have no look-around; a separator is taken as a character or the end, and for whole words as a boundary
    by_pattern = " ".join(f"when regexp_matches(lower(url), '{p}') then '{v}'" for p, v in ((r.replace("(?:^|$|[^a-z0-9_%.-]|(?:)|(?:))", "(?:^|$|\\b|[^a-z0-9_%.-])"), v) for r, v in sorted(quoted, key=lambda x: x[1], reverse=True)))
    host = _SMALL.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    return f"""
with p as (select row_number() over () as rid, page_id, url, {host} as host, {path} as path from pages),
r(rh, rp, v) as (values {told}),
fits as (select p.rid, r.rh || r.rp as rule, r.v from p join r on (p.host = r.rh or ends_with(p.host, '.' || r.rh)) and starts_with(p.path, r.rp)),
best as (select rid, rule, v from (select *, row_number() over (partition by rid order by length(rule) desc, rule desc) as n from fits) t where n = 1)
select p.page_id, p.host, p.path, b.rule, coalesce(b.v, case {by_pattern} end, 'allow') as verdict from p left join best b on b.rid = p.rid
"""


OP9 = rf"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all({_SMALL.format("coalesce(text, '')")}, '{WORD}') as w from documents),
s as (select distinct rid, array_to_string(w[i : i + 3], ' ') as g from (select rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0) t),
n as (select rid, count(*) as n from s group by rid),
pairs as (select a.rid as x, b.rid as y, count(*) as c from s a join s b on a.g = b.g and a.rid < b.rid group by 1, 2),
links as (select x, y from pairs join n a on a.rid = x join n b on b.rid = y where 100 * c >= 80 * (a.n + b.n - c)),
sides as (select x, y from links union all select y, x from links),
reach as (select rid as x, rid as y from d union select r.x, b.y from reach r join sides b on b.x = r.y),
least as (select r.x, min(e.doc_id) as component_id from reach r join d e on e.rid = r.y group by r.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, l.component_id, d.doc_id = l.component_id as kept from d join least l on l.x = d.rid left join n on n.rid = d.rid
"""


def _op12() -> str:
    told = ", ".join(f"({n}, '{label}', [{', '.join(f"'{w}'" for w in dict.fromkeys(words))}])" for n, label, words in _pieces(TEMPLATES, WIDTH))
    phrases = ", ".join(f"('{phrase}', {len(phrase.split())}, '{label}')" for phrase, label in PHRASES)
    return rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_SMALL.format("coalesce(text, '')")}, '{_PLAIN}') as w from documents),
piece(piece, label, set) as (values {told}),
phrase(phrase, n, label) as (values {phrases}),
base as (select d.rid, p.label, s.s - 1 as place from d cross join phrase p, lateral (select unnest(range(1, len(d.w) - p.n + 2)) as s) s where array_to_string(d.w[s.s : s.s + p.n - 1], ' ') = p.phrase),
based as (select rid, count(*) as n, min(place) as low, max(place) as high, list(distinct label) as labels from base group by rid),
block as (select rid, b, list_distinct(w[b * {WIDTH} + 1 : (b + 2) * {WIDTH}]) as own from (select rid, w, unnest(range(0, (len(w) + {WIDTH - 1}) // {WIDTH})) as b from d) t),
met as (select rid, b, piece, label, set, held / size as share, size from (select rid, b, piece, label, set, len(list_intersect(own, set)) as held, len(set) as size from block cross join piece) t where held >= ceil(size * {SHARE}::double - 1e-9::double)),
best as (select rid, label, share from met x where not exists (select 1 from met y where y.rid = x.rid and abs(y.b - x.b) <= 1 and y.piece <> x.piece and len(list_intersect(x.set, y.set)) >= x.size * {SHARE}::double - 1e-9::double and (y.share > x.share or y.share = x.share and (y.size > x.size or y.size = x.size and y.piece < x.piece)))),
found as (select rid, max(share) as score, list(distinct label) as labels from best group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(b.n, 0) as bigint) as n_base, cast(b.low as bigint) as first_word, cast(b.high as bigint) as last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels, array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(f.labels, []))), ',') as labels, coalesce(f.score, 0::double) as score
from d left join based b on b.rid = d.rid left join found f on f.rid = d.rid
"""


OP13 = rf"""
with recursive crc as (select list(list_reduce(list_prepend(b, range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t from (select unnest(range(256)) as b) s),
runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as r from documents),
small as (select id, {_SMALL.format("r")} as w, count(*) as n from runs where length(r) >= 7 group by all),
hashed as (select w, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [192 + (ord(c)::bigint >> 6), 128 + (ord(c)::bigint & 63)] end))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as h from small cross join crc),
slipped as (select case when h % 31 = 0 then w[: h % length(w)] || w[h % length(w) + 2 :] else w end as word, n from hashed),
voc as (select word, cast(sum(n) as bigint) as n from slipped where length(word) >= 7 group by word having sum(n) >= 2),
less as (select word, i, word[: i - 1] || word[i + 1 :] as v from (select word, unnest(range(1, length(word) + 1)) as i from voc) t),
shorter as (select distinct l.word as a, l.v as b from less l semi join voc on voc.word = l.v),
near as (select a.word as a, b.word as b from less a join less b on a.v = b.v and a.i = b.i and a.word <> b.word union all select a, b from shorter union all select b, a from shorter),
best as (select a, b, n, k from (select a, b, n, row_number() over (partition by a order by n desc, b) as nth, count(*) over (partition by a) as k from near join voc on voc.word = near.b) t where nth = 1),
told as (select v.word, v.n, coalesce(b.k, 0) as n_near, case when b.n >= 10 * v.n then b.b end as form, case when b.n >= 10 * v.n then b.n end as form_n from voc v left join best b on b.a = v.word),
led as (select word, word as root from told union select led.word, told.form from led join told on told.word = led.root where told.form is not null)
select t.word, t.form, (select l.root from led l join told x on x.word = l.root where l.word = t.word and x.form is null) as root, t.n, t.n_near, t.form_n from told t
"""


def oracle_sql(rules) -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op5_decontamination": OP5, "op6_source_mixing": OP6, "op7_url_filters": _op7(rules), "op9_near_dup": OP9, "op12_license_scan": _op12(), "op13_spelling_variants": OP13}
