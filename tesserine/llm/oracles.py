"""DuckDB SQL that gives the same rows as queries of this folder."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 50 words whose words also start in a document with a smaller doc_id.
SUBSTRINGS = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
s as (select doc_id, unnest(range(1, greatest(1, len(ws) - 48))) as s, ws from w),
h as (select doc_id, s, md5(array_to_string(ws[s:s+49], ' ')) as h from s),
f as (select h, min(doc_id) as f from h group by h),
g as (select distinct doc_id, unnest(range(s, s + 50)) as p from h join f using (h) where doc_id > f),
p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
k as (select doc_id, count(*) as kept, string_agg(word, ' ' order by p) as t from p anti join g using (doc_id, p) group by doc_id)
select doc_id, len(ws) as n_words, len(ws) - coalesce(kept, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join k using (doc_id)
"""

#: Components of documents whose sets of five-word shingles are similar enough.
JACCARD = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as ws from documents),
s as (select distinct doc_id, md5(array_to_string(ws[i:i+4], ' ')) as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) as i from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from w union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, coalesce(n, 0) as n_shingles, m as component_id from w left join n using (doc_id) join (select a as doc_id, min(b) as m from r group by a) using (doc_id)
"""

#: Vectors of one label with cosine 0.98 or more.
VECTORS = """
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0 and list_max(list_transform(embedding, lambda e: abs(e))) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.98),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, e.b from r join e on r.b = e.a),
m as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n from e group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join m using (vec_id) left join n using (vec_id)
"""

ORACLE_SQL = {"op5_fingerprint_index": SUBSTRINGS, "op7_jaccard_join": JACCARD, "op10_multi_index_dedup": VECTORS}
