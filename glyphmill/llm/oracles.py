"""DuckDB's SQL for the queries that it can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"


PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = rf"""
with d as (select doc_id, regexp_extract_all({low('text')}, '{PLAIN}') w from documents), b as (select item_id, regexp_extract_all({low('text')}, '{PLAIN}') w from benchmark),
bw as (select distinct item_id, least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') g from (select item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) i from b where len(w) > 0)),
l as (select distinct n from bw), dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d cross join l where len(w) >= n)),
h as (select doc_id, dw.n, i, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
hw as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from h) group by doc_id),
hi as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated from d left join hw using (doc_id) left join hi using (doc_id)
"""

OP9 = rf"""
with a as (select doc_id, string_split(coalesce(text, ''), chr(10)) p from documents), l as (select doc_id, unnest(p) line, generate_subscripts(p, 1) pos from a),
k as (select *, regexp_replace({low('line')}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') key from l),
c as (select key, max(doc_id) keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
r as (select doc_id, pos, line, keeper is not null and doc_id < keeper gone from k left join c using (key))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from r group by doc_id
"""

OP10 = rf"""
with recursive d as (select doc_id, regexp_extract_all({low('text')}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id), p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
r as (select doc_id, doc_id o from documents union select r.doc_id, l.y from r join l on r.o = l.x)
select r.doc_id, coalesce(any_value(n), 0) n_shingles, min(o) component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""
