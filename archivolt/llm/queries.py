"""The queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from archivolt.llm.decontamination import op2_decontamination
from archivolt.llm.exact_spans import op10_suffix_dedup
from archivolt.llm.main_text import op6_main_text
from archivolt.llm.minhash import op4_near_dedup
from archivolt.llm.mixing import MIXING_SQL, op13_mixing
from archivolt.llm.packing import op1_packing
from archivolt.llm.prefix_trie import TRIE_SQL, op11_prefix_trie
from archivolt.llm.quality import op3_quality
from archivolt.llm.sharding import op5_sharding
from archivolt.llm.token_shards import op8_token_shards
from archivolt.llm.topk import op7_topk
from archivolt.llm.toxicity import op9_toxicity
from archivolt.llm.whitening import op12_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_main_text": op6_main_text,
    "op7_topk": op7_topk,
    "op8_token_shards": op8_token_shards,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_mixing": op13_mixing,
}

NEAR_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) g from w),
n as (select doc_id, count(*) n from s group by 1),
c as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
select doc_id, coalesce(n, 0) n_shingles, m component_id, doc_id = m kept
from documents left join n using (doc_id) join (select a doc_id, min(b) m from r group by 1) using (doc_id)"""

TOP_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
           where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 10"""

SPANS_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) b, octet_length(encode(coalesce(text, ''))) n from documents),
p as (select doc_id, i, md5(array_slice(b, i, i + 199)) h from (select doc_id, b, unnest(range(1, n - 198)) i from d where n >= 200)),
twice as (select h from p group by h having count(*) > 1),
s as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) step from p semi join twice using (h)),
g as (select doc_id, i, sum(case when step <= 200 then 0 else 1 end) over (partition by doc_id order by i) g from s),
r as (select doc_id, g, min(i) a, max(i) + 199 z from g group by 1, 2),
k as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 x, a - 1 y from r
      union all select doc_id, coalesce(max(z), 0) + 1, any_value(n) from d left join r using (doc_id) group by 1),
t as (select doc_id, string_agg(case when y >= x then hex(array_slice(b, x, y)) else '' end, '' order by x) kept from k join d using (doc_id) group by 1),
c as (select doc_id, sum(z - a + 1)::bigint n_removed, count(*) n_spans from r group by 1)
select doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(kept)) kept_sha256
from d join t using (doc_id) left join c using (doc_id)"""

ORACLES: dict[str, str] = {
    "op4_near_dedup": NEAR_SQL,
    "op7_topk": TOP_SQL,
    "op10_suffix_dedup": SPANS_SQL,
    "op11_prefix_trie": TRIE_SQL,
    "op13_mixing": MIXING_SQL,
}
