"""The engine's registered queries, each over whole tables, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.functions import text as X
from archivolt.functions.grammar import bodies_of, body_key, extract_citations
from archivolt.operators import dense, evaluation, fusion, leakage, lexical, reports, router, runs, segment, validation
from archivolt.sources import documents as sources
from archivolt.session import materialised, spread, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def customers(spark, d):
    """For work that costs more than moving the rows."""
    return spread(table(spark, d, "customer"))


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

BM25 = rf"""
with d as (select doc_id id, {WORDS} w from documents),
size as (select count(*) n, avg(len(w)) avgdl from d),
post as (select id, term, dl, count(*) tf from (select id, len(w) dl, unnest(w) term from d) group by all),
df as (select term, count(*) df from post group by 1),
q as (select query_id, term, count(*) qtf from (select item_id query_id, unnest({WORDS}) term from benchmark) group by all),
s as (select query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) score
      from q join df using (term) join post using (term), size group by 1, 2),
bm25 as (select *, row_number() over (partition by query_id order by score desc, id) rank from s where score > 0)"""

SHARED = rf"""
, terms as (select distinct item_id query_id, unnest({WORDS}) term from benchmark),
dterms as (select distinct doc_id id, unnest({WORDS}) term from documents),
o as (select query_id, id, count(*)::double score from terms join dterms using (term) group by 1, 2),
shared as (select *, row_number() over (partition by query_id order by score desc, id) rank from o)"""

FUSED = BM25 + SHARED + """
, ranks as (select query_id, id, 'bm25' origin, rank, score from bm25 where rank <= 50 union all select query_id, id, 'dense', rank, score from shared where rank <= 50),
fused as (select query_id, id, round(sum(1.0::double / (60 + rank)), 8) rrf, list_sort(list(distinct origin)) origins,
          max(case when origin = 'dense' then score end) dense_score, max(case when origin = 'bm25' then score end) bm25_score from ranks group by 1, 2)"""

CAPPED = FUSED + """
, cand as (select f.query_id, f.id, f.rrf, d.source doc, d.lang unit, d.source = 'src0' mentioned, d.lang <> 'en' is_norm,
             row_number() over (partition by query_id order by rrf desc, f.id) pos from fused f join documents d on d.doc_id = f.id),
c1 as (select * from (select *, row_number() over (partition by query_id, doc, unit order by pos) t from cand) where t <= 3),
c2 as (select * exclude (t) from (select * exclude (t), row_number() over (partition by query_id, doc order by pos) t from c1) where mentioned or t <= 4)"""


@query(BM25 + " select query_id, rank, id, score from bm25 where rank <= 10")
def bm25_topk(spark, d):
    return lexical.bm25(docs(spark, d), items(spark, d))


@query(rf"select term, count(distinct doc_id) df from (select doc_id, unnest({WORDS}) term from documents) group by 1")
def term_document_frequency(spark, d):
    return lexical.document_frequency(lexical.postings(docs(spark, d)))


@query(rf"""with w as (select item_id query_id, {WORDS} w from benchmark),
p as (select query_id, w[i] word, min(i) - 1 pos from (select query_id, w, unnest(range(1, len(w) + 1)) i from w) group by 1, 2),
df as (select word, count(distinct doc_id) df from (select doc_id, unnest({WORDS}) word from documents) group by 1),
r as (select query_id, pos, word, df, row_number() over (partition by query_id order by df is null, df, pos) t from p left join df using (word))
select query_id, pos, word, coalesce(df, 0) df from r where t <= 10""")
def rare_keywords(spark, d):
    return lexical.rare_words(items(spark, d), docs(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query(rf"""with w as (select distinct unnest({WORDS}) word from benchmark), df as (select word, count(distinct doc_id) df from (select doc_id, unnest({WORDS}) word from documents) group by 1)
select word, coalesce(df, 0) df from w left join df using (word)""")
def word_frequency(spark, d):
    words = items(spark, d).select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return lexical.word_frequency(words, docs(spark, d))


DENSE = """with q as (select vec_id query_id, embedding v from embeddings where {which}),
s as (select query_id, vec_id id, round(list_inner_product(v::double[], embedding::double[]), 8) raw from q, embeddings),
c as (select *, row_number() over (partition by query_id order by raw desc, id) t from s)
select query_id, row_number() over (partition by query_id order by round(raw, 5) desc, id) rank, id, round(raw, 5) score from c where t <= {k}"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(DENSE.format(which="vec_id % 50 = 0", k=10))
def dense_topk(spark, d):
    held = vectors(spark, d)
    return dense.dense_topk(held.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), held)


@query(DENSE.format(which="true", k=3))
def dense_neighbours(spark, d):
    """Every vector asks."""
    held = vectors(spark, d)
    return dense.dense_topk(held.withColumnRenamed("id", "query_id"), held, 3)


def rankings(spark, d):
    """BM25 and the count of shared words, both by one index of the documents."""
    path = work_path(spark, "bm25")
    lexical.save_index(docs(spark, d), path)
    best = lexical.saved_bm25(spark, path, items(spark, d), 50)
    one = best.withColumn("origin", F.lit("bm25")).unionByName(lexical.overlap(spark, path, items(spark, d), 50).withColumn("origin", F.lit("dense")))
    return one.withColumn("weight", F.lit(1.0))


@query(FUSED + " select * from fused")
def rrf_fusion(spark, d):
    return fusion.reciprocal_rank_fusion(rankings(spark, d))


def candidates(spark, d):
    about = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc"), F.col("lang").alias("unit"))
    found = fusion.positions(fusion.reciprocal_rank_fusion(rankings(spark, d))).join(about, "id")
    return found.withColumn("mentioned", F.col("doc") == "src0").withColumn("is_norm", F.col("unit") != "en").withColumn("complementary", F.lit(False))


@query(CAPPED + " select query_id, id, pos from c2")
def diversity_caps(spark, d):
    return fusion.diversity_caps(candidates(spark, d)).select("query_id", "id", "pos")


@query(CAPPED + """, l as (select * from (select *, row_number() over (partition by query_id order by pos) p from c2) where p <= 30),
m as (select *, greatest(0, least(4 - sum((p <= 10 and is_norm)::int) over w, sum((p > 10 and is_norm)::int) over w, sum((p <= 10 and not is_norm)::int) over w)) swap,
      sum((p > 10 and is_norm)::int) over (partition by query_id order by p) i, sum((p <= 10 and not is_norm)::int) over (partition by query_id order by p desc) o from l window w as (partition by query_id))
select query_id, id, row_number() over (partition by query_id order by p) place from m where (p <= 10 and (is_norm or o > swap)) or (p > 10 and is_norm and i <= swap)""")
def norm_quota(spark, d):
    return fusion.with_quota(fusion.diversity_caps(candidates(spark, d))).select("query_id", "id", "place")


@query(FUSED + """, r as (select query_id, id, rrf, id % 97 = 0 direct, round((id * 7919 % 1000) / 1000.0, 5)::double rerank from fused),
p as (select *, row_number() over (partition by query_id order by direct, rrf desc, id) p from r),
t as (select *, case when direct then 0 when p <= 20 then 1 else 2 end tier, case when direct then 1 + rerank when p <= 20 then rerank else rrf * 1e-3 end fin from p)
select query_id, id, tier, row_number() over (partition by query_id order by tier, fin desc, id) pos from t""")
def two_phase_order(spark, d):
    fused = fusion.reciprocal_rank_fusion(rankings(spark, d)).withColumn("direct", F.col("id") % 97 == 0).withColumn("rerank", F.round((F.col("id") * 7919 % 1000) / 1000.0, 5))
    return fusion.two_phase(fused).select("query_id", "id", "tier", "pos")


GRAMS = r"""with b as (select item_id id, {w} w from benchmark), c as (select doc_id id, {w} w from documents),
bg as (select distinct id, array_to_string(w[i:i + 7], ' ') gram from (select id, w, unnest(range(1, len(w) - 6)) i from b)),
cg as (select distinct id, array_to_string(w[i:i + 7], ' ') gram from (select id, w, unnest(range(1, len(w) - 6)) i from c)),
hits as (select bg.id question_id, cg.id chunk_id, count(*) shared from bg join cg using (gram) group by 1, 2)""".replace("{w}", WORDS)


@query(GRAMS + " select * from hits")
def ngram_leakage_hits(spark, d):
    return leakage.shared_grams(items(spark, d), docs(spark, d))


@query(GRAMS + """, n as (select id question_id, count(*) n from bg group by 1),
s as (select chunk_id, bool_or(shared >= 3 and shared >= 0.5 * n) copied, list_sort(list(distinct question_id)) questions from hits join n using (question_id) group by 1)
select chunk_id, case when copied or len(questions) >= 3 then 'grave' else 'review' end severity, questions from s""")
def leakage_severity(spark, d):
    return leakage.severity(items(spark, d), items(spark, d), docs(spark, d))


@query("""select path from (select role || '/' || conv_id || '-' || turn || case when turn % 3 = 0 then '.json' when turn % 3 = 1 then '.md' else '.txt' end path, text from conversations)
where regexp_matches(path, '(json|txt)$') and (contains(substr(text, 1, 20000), ' the ') or contains(substr(text, 1, 20000), 'question'))""")
def bank_marker_scan(spark, d):
    end = F.when(F.col("turn") % 3 == 0, ".json").when(F.col("turn") % 3 == 1, ".md").otherwise(".txt")
    files = table(spark, d, "conversations").select(F.concat("role", F.lit("/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), end).alias("path"), "text")
    return leakage.bank_files(files, [" the ", "question"]).select("path")


def duck_normalise(x: str) -> str:
    for pattern, to in ((r"\r\n?", r"\n"), ("[   \\t]", " "), ("[​‌‍⁠﻿­]", ""), (" +", " "), (" ?\\n ?", r"\n"), ("\\n{3,}", r"\n\n"), ("^[ \\n]+|[ \\n]+$", "")):
        to = to.replace(r"\n", "\n")
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def duck_visible(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "nav", "header", "footer", "form", "aside", "button", "iframe", "svg", "template", "head"):
        x = f"regexp_replace({x}, '(?is)<{tag}[ >].*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<br ?/?>', '\n', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(p|div|h[1-6]|li|ul|ol|table|tr|article|section|main|blockquote|pre)( [^>]*)?>', '\n', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)</t[dh]>', ' ', 'g'), '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def ended(x: str) -> str:
    return f"(select case when y = '' then '' else y || chr(10) end from (select {x} y))"


@query(f"select page_id, case when y = '' then '' else y || chr(10) end text from (select page_id, {duck_normalise(duck_visible('html'))} y from pages)")
def html_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.visible_text(F.col("html")).alias("text"))


@query(f"select doc_id, case when y = '' then '' else y || chr(10) end text from (select doc_id, {duck_normalise('nfc_normalize(text)')} y from documents)")
def text_normalize(spark, d):
    return X.normalised(docs(spark, d)).withColumnRenamed("id", "doc_id")


@query(f"select doc_id, trim(regexp_replace(lower(translate(text, '{X.ACCENTED}', '{X.PLAIN}')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) folded from documents")
def accent_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query("""with l as (select distinct source doc_id, doc_id page, trim(unnest(string_split(text, chr(10)))) line from documents),
p as (select source doc_id, count(distinct doc_id) pages from documents group by 1 having count(distinct doc_id) >= 3)
select doc_id, line from (select doc_id, line, count(*) k from l where length(line) between 1 and 80 group by 1, 2) join p using (doc_id) where k >= ceil(0.02 * pages)""")
def repeated_line_removal(spark, d):
    pages = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return reports.repeated_lines(pages, share=0.02)


WINDOWED = r"""with w as (select doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') w from documents),
p as (select doc_id, w, greatest(ceil((len(w) - 300) / 255.0), 0)::int + 1 parts from w where len(w) > 0),
c as (select doc_id, part, parts, array_to_string(w[(part - 1) * 255 + 1:(part - 1) * 255 + 300], ' ') text from (select *, unnest(range(1, parts + 1)) part from p))"""


def words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), 0).alias("words"))


@query(WINDOWED + " select doc_id, part, parts, text from c")
def fixed_windows(spark, d):
    return segment.fixed_windows(words(spark, d)).withColumn("part", F.col("part").cast("long"))


@query(WINDOWED + """ select doc_id, part, doc_id || '#' || lpad((part - 1)::varchar, 5, '0') chunk_id, b "begin", b + length(text) "end"
from (select *, coalesce(sum(length(text) + 2) over (partition by doc_id order by part rows between unbounded preceding and 1 preceding), 0)::bigint b from c)""")
def chunk_offsets(spark, d):
    parts = segment.fixed_windows(words(spark, d)).withColumn("ord", F.col("part"))
    return segment.with_offsets(parts).select("doc_id", F.col("part").cast("long").alias("part"), "chunk_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


@query("select sha256(text) key, min(doc_id) first_doc, count(*) copies from documents group by 1")
def content_hash_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@query("select count(distinct text) misses from documents where text not in (select text from documents where doc_id % 3 = 0)")
def embedding_cache_misses(spark, d):
    x = table(spark, d, "documents")
    cache = x.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("key")).distinct()
    return sources.cache_misses(x.select("text"), cache).agg(F.count(F.lit(1)).alias("misses"))


SUMMARY = """with s as (select conv_id doc_id, nullif(count(distinct case when turn % 2 = 0 then turn % 7 end), 0) articles, count(*) fragments, sum(length(text))::bigint characters,
 sha256(string_agg(text, chr(10) || chr(10) order by turn)) sha256, list_sort(list(distinct role)) formats, list_sort(list(distinct 'ley|' || turn % 5)) bodies from conversations group by 1)"""


def summary(spark, d):
    chunk = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text", F.when(F.col("turn") % 2 == 0, F.col("turn") % 7).alias("article"), F.col("role").alias("format"),
        F.array(F.concat(F.lit("ley|"), (F.col("turn") % 5).cast("string"))).alias("bodies"),
    )
    return reports.document_summary(chunk)


@query(SUMMARY + " select * from s")
def doc_summary(spark, d):
    return summary(spark, d)


@query(SUMMARY + " select count(*) documents, sum(fragments)::bigint fragments, sum(characters)::bigint characters, sum(coalesce(articles, 0))::bigint articles from s")
def corpus_totals(spark, d):
    return reports.totals(summary(spark, d))


@query("""with a as (select distinct lang area from documents union all select 'none'), t as (select lang area, count(*) items, sum(case when quality = 1 then 1 else 0 end) covered from labels join documents using (doc_id) group by 1),
h as (select lang area, count(*) documents, sum(n_chars) fragments from documents group by 1)
select area, coalesce(items, 0)::bigint items, coalesce(covered, 0)::bigint covered, coalesce(documents, 0)::bigint documents, coalesce(fragments, 0)::bigint fragments,
 round(case when coalesce(items, 0) > 0 then 100.0 * covered::double / items else 0.0 end, 4) share from a left join t using (area) left join h using (area)""")
def area_coverage(spark, d):
    x = table(spark, d, "documents")
    areas = x.select(F.col("lang").alias("area")).distinct().union(spark.createDataFrame([("none",)], "area string"))
    targets = table(spark, d, "labels").join(x.select("doc_id", F.col("lang").alias("area")), "doc_id").select("area", F.lit(1).cast("long").alias("items"), (F.col("quality") == 1).alias("covered"))
    return reports.area_coverage(areas, targets, x.select(F.col("lang").alias("area"), F.col("n_chars").alias("fragments")))


@query("select conv_id doc_id, coalesce(nullif(role, 'system'), '(none)') section, count(*) n from conversations group by 1, 2")
def section_distribution(spark, d):
    return reports.section_distribution(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.nullif("role", F.lit("system")).alias("section")))


@query("""with c as (select conv_id doc_id, count(*) n, count_if(role = 'assistant') r, count_if(role = 'user') u from conversations group by 1)
select doc_id, list_filter([case when r = 0 then 'no_ruling' end, case when r > 0.25 * n then 'ruling_share' end, case when u = 0 then 'no_reasons' end], lambda x: x is not null) alerts
from c where r = 0 or r > 0.25 * n or u = 0""")
def section_alerts(spark, d):
    return reports.section_alerts(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("section")), "assistant", ("user",))


def cited_orders(spark, d):
    """Text with one statute and one article for each order."""
    o = spread(table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", (F.col("o_custkey") % 300).cast("string").alias("a"), (F.col("o_orderkey") % 2000).cast("string").alias("n"), F.year("o_orderdate").cast("string").alias("y"))
    return o.withColumn("text", F.concat(F.lit("Según el art. "), "a", F.lit(" de la Ley "), "n", F.lit(" de "), "y", F.lit(" procede.")))


CODE_OF = "case (o_orderkey % 2000) when 599 then 'codigo_penal' when 906 then 'codigo_procedimiento_penal' when 1564 then 'codigo_general_proceso' when 1437 then 'cpaca' when 1098 then 'codigo_infancia' when 1801 then 'codigo_nacional_policia' when 1952 then 'codigo_disciplinario' when 1480 then 'estatuto_consumidor' end"
CITED = f"""with o as (select o_orderkey id, (o_custkey % 300)::varchar article, {CODE_OF} code, (o_orderkey % 2000)::varchar n, year(o_orderdate)::varchar y, o_custkey, o_orderpriority from orders),
c as (select id, o_custkey, o_orderpriority, article, coalesce(code, 'ley') kind, case when code is null then n end number, case when code is null then y end "year",
 coalesce(code, 'ley') || '|' || case when code is null then n else '' end || '|' || case when code is null then y else '' end body from o)"""


@query(CITED + ' select id, kind, number, "year", article from c')
def citation_extract(spark, d):
    return cited_orders(spark, d).select("id", F.explode(extract_citations("text")).alias("c")).select("id", "c.*")


@query(CITED + """, k as (select p_partkey id, 'ley|' || (p_partkey % 2000) || '|' || (1992 + p_partkey % 7) body, (p_size * 3)::varchar article from part),
h as (select distinct c.id query_id, k.id from c join k on c.body = k.body and c.article = k.article) select query_id, row_number() over (partition by query_id order by id) pos, id from h""")
def citation_router(spark, d):
    chunk = table(spark, d, "part").select(F.col("p_partkey").alias("id"), body_key(F.lit("ley"), (F.col("p_partkey") % 2000).cast("string"), (1992 + F.col("p_partkey") % 7).cast("string")).alias("body"), (F.col("p_size") * 3).cast("string").alias("article"))
    return router.routed(cited_orders(spark, d).select("id", "text"), chunk)


SCORED = CITED + """, s as (select id, o_custkey % 7 = 0 abstained, o_custkey % 11 <> 0 answered, [body] cited, case when id % 3 = 0 then [body] else ['ley|1|1999'] end reference, case when id % 2 = 0 then [body] else [] end supported from c),
t as (select *, answered and not abstained ok from s),
u as (select case when ok then 1 else 0 end n_cited, 1 n_ref, case when ok and id % 3 = 0 then 1 else 0 end hits, case when ok and id % 3 = 0 and id % 2 = 0 then 1 else 0 end hits_supported,
 case when ok and id % 3 = 0 and id % 2 <> 0 then 1 else 0 end hits_unsupported, case when ok and id % 3 <> 0 and id % 2 = 0 then 1 else 0 end wrong, case when ok and id % 3 <> 0 and id % 2 <> 0 then 1 else 0 end unsupported from t),
v as (select count(*) items, sum(n_ref)::bigint n_ref, sum(n_cited)::bigint n_cited, sum(hits)::bigint hits, sum(hits_supported)::bigint hits_supported, sum(hits_unsupported)::bigint hits_unsupported, sum(wrong)::bigint wrong, sum(unsupported)::bigint unsupported from u),
w as (select *, (hits_supported + 0.5::double * hits_unsupported) / n_ref r, unsupported::double / n_cited e from v)
select items, n_ref, n_cited, hits, hits_supported, hits_unsupported, wrong, unsupported, round(r, 4) recall, round(e, 4) unsupported_rate, round(greatest(0, r - 2 * e), 4) "index", round(20 * greatest(0, r - 2 * e), 2) points from w"""


@query(SCORED)
def citation_score(spark, d):
    x = materialised(cited_orders(spark, d).select("id", "o_custkey", bodies_of(extract_citations("text")).alias("cited")), "cited")
    none = F.array().cast("array<string>")
    # what the others refer to is never what they cite, also where that is Ley 1 de 1999
    foreign = F.when(F.array_contains("cited", "ley|1|1999"), "ley|1|1998").otherwise("ley|1|1999")
    key = x.select("id", F.when(F.col("id") % 3 == 0, F.col("cited")).otherwise(F.array(foreign)).alias("reference"))
    answers = x.filter("o_custkey % 11 <> 0").select("id", (F.col("o_custkey") % 7 == 0).alias("abstained"), "cited", F.when(F.col("id") % 2 == 0, F.col("cited")).otherwise(none).alias("supported"))
    return evaluation.citation_index(key, answers)


@query(CITED + """, p as (select distinct 'ley|' || (p_partkey % 2000) || '|' || (1992 + p_partkey % 7) body from part)
select body, count(distinct id) items, list_sort(list(distinct id)) ids, list_sort(list(distinct o_orderpriority)) areas from c where body not in (select body from p) group by 1""")
def coverage_gaps(spark, d):
    asked = router.cited(cited_orders(spark, d).select("id", "text")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("area")), "id")
    present = table(spark, d, "part").select(body_key(F.lit("ley"), (F.col("p_partkey") % 2000).cast("string"), (1992 + F.col("p_partkey") % 7).cast("string")).alias("body"))
    return reports.coverage_gaps(asked.select("id", "area", "body"), present)


@query("""select count(*) n, sum(case when d.doc_id is not null and toxic = 0 and lang = case when quality = 1 then 'en' else 'de' end then 1 else 0 end)::bigint hits,
round(sum(case when d.doc_id is not null and toxic = 0 and lang = case when quality = 1 then 'en' else 'de' end then 1 else 0 end)::double / count(*), 6) accuracy,
round(20 * sum(case when d.doc_id is not null and toxic = 0 and lang = case when quality = 1 then 'en' else 'de' end then 1 else 0 end)::double / count(*), 2) points
from labels l left join (select * from documents where doc_id % 5 <> 0) d using (doc_id)""")
def closed_accuracy(spark, d):
    l = table(spark, d, "labels")  # noqa: E741
    key = l.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "en").otherwise("de").alias("expected"))
    answers = table(spark, d, "documents").filter("doc_id % 5 <> 0").join(l, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("given"), (F.col("toxic") == 1).alias("abstained"))
    return evaluation.closed_accuracy(key, answers)


@query("""with j as (select doc_id % 13 <> 0 answered, toxic = 1 abstained, quality = 1 ok from labels), l as (select case when not answered then 'fn' when abstained and not ok then 'tp' when abstained then 'fp' when ok then 'tn' else 'fn' end x from j),
n as (select count_if(x = 'tp') tp, count_if(x = 'fp') fp, count_if(x = 'tn') tn, count_if(x = 'fn') fn, count(*) items from l)
select tp::bigint tp, fp::bigint fp, tn::bigint tn, fn::bigint fn, items, round((tn + 0.5::double * (tp + fp)) / items, 4) calibration, round(10 * (tn + 0.5::double * (tp + fp)) / items, 2) points from n""")
def selective_confusion(spark, d):
    return evaluation.selective_confusion(table(spark, d, "labels").select((F.col("doc_id") % 13 != 0).alias("answered"), (F.col("toxic") == 1).alias("abstained"), (F.col("quality") == 1).alias("right")))


@query("""with i as (select o_orderpriority area, case when o_orderkey % 5 = 0 then [] when o_orderkey % 2 = 0 then ['a', 'b'] else ['a'] end reference, case when o_custkey % 3 = 0 then ['a', 'c'] when o_custkey % 3 = 1 then ['b'] else [] end found from orders),
j as (select area, len(reference) n, len(list_intersect(reference, found)) f from i where len(reference) > 0)
select area, count(*) items, round(sum((f > 0)::int)::double / count(*), 6) hit_rate, round(sum(f)::double / sum(n), 6) recall from j group by rollup (area)""")
def hit_at_k(spark, d):
    list_ = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reference = F.when(k % 5 == 0, list_()).when(k % 2 == 0, list_("a", "b")).otherwise(list_("a"))
    found = F.when(c % 3 == 0, list_("a", "c")).when(c % 3 == 1, list_("b")).otherwise(list_())
    return evaluation.retrieval_quality(table(spark, d, "orders").select(F.col("o_orderpriority").alias("area"), reference.alias("reference"), found.alias("found")))


@query("select o_orderkey id, pos from (select o_orderkey, row_number() over (order by o_orderkey) pos from orders) where pos between 100 and 1099")
def range_partition(spark, d):
    return runs.position_range(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 100, 1099).select("id", "pos")


@query("select o_orderkey id, pos from (select o_orderkey, row_number() over (order by o_orderkey) pos from orders) where (pos - 1) % 3 = 1")
def stride_partition(spark, d):
    return runs.stride_part(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 2, 3).select("id", "pos")


@query("select c_custkey id from customer where c_custkey not in (select o_custkey from orders)")
def resume_pending(spark, d):
    return runs.pending(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("select o_orderkey id, case when o_orderkey % 4 = 0 then o_totalprice * 2 else o_totalprice end price, case when o_orderkey % 4 = 0 then 'new' else o_orderstatus end status from orders")
def overlay_runs(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    part = base.filter("id % 4 = 0").select("id", (F.col("price") * 2).alias("price"), F.lit("new").alias("status"))
    return runs.overlaid(base, part)


@query("""with r as (select event_type, value as seconds, row_number() over (partition by event_type order by value) - 1 r, count(*) over (partition by event_type) n from events)
select event_type, n, round(avg(seconds), 2) mean, round(max(case when r = n // 2 then seconds end), 2) p50, round(max(case when r = least(n - 1, floor(n * 0.95)::bigint) then seconds end), 2) p95, round(max(seconds), 2) "max" from r group by 1, 2""")
def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "events").select("event_type", F.col("value").alias("seconds")), ["event_type"])


@query("""with r as (select c_custkey id, list_filter([case when c_acctbal < 0 then 'negative_balance' end, case when c_custkey % 50 = 0 then 'name_required' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') then 'segment_unknown' end,
 case when first < c_custkey then 'name_repeated' end], lambda x: x is not null) errors from (select *, min(c_custkey) over (partition by c_nationkey, c_mktsegment, c_acctbal::int) "first" from customer)) select id, errors from r""")
def validation_errors(spark, d):
    by = Window.partitionBy("c_nationkey", "c_mktsegment", F.rint("c_acctbal").cast("int"))  # halves to the even one, as SQL's cast does
    c = table(spark, d, "customer").withColumn("first", F.min("c_custkey").over(by))
    rules = {
        "negative_balance": F.col("c_acctbal") < 0, "name_required": F.col("c_custkey") % 50 == 0, "segment_unknown": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "name_repeated": F.col("first") < F.col("c_custkey"),
    }
    return validation.with_errors(c, rules).select(F.col("c_custkey").alias("id"), "errors")


@query("""with l as (select o_custkey id, o_orderpriority formato, o_orderkey % 12 n_passages, o_orderstatus = 'F' abstencion from orders), e as (select c_custkey id, c_mktsegment formato from customer where c_custkey % 9 <> 0), k as (select id, count(*) k from l group by 1)
select (select count(*) from l) lines, (select count_if(n_passages > 10) from l)::bigint over_ten, (select count_if(abstencion) from l)::bigint abstentions, (select count_if(k > 1) from k)::bigint repeated,
 (select count(*) from e where id not in (select id from k)) missing, (select count(*) from k where id not in (select id from e)) extra, (select count(*) from l join e using (id) where l.formato is distinct from e.formato) wrong_format""")
def submission_checks(spark, d):
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("formato"), (F.col("o_orderkey") % 12).alias("n_passages"), (F.col("o_orderstatus") == "F").alias("abstencion"))
    return validation.delivery(lines, table(spark, d, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("formato")))


@query("select count(*) n, round(sum(coalesce(case when event_id % 7 <> 0 then event_id % 5 / 4.0::double end, 0.0)) / count(*), 4) correctness, round(30.0::double * sum(coalesce(case when event_id % 7 <> 0 then event_id % 5 / 4.0::double end, 0.0)) / count(*), 2) points from events")
def judge_mean(spark, d):
    return evaluation.judge_mean(table(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5 / 4.0).alias("score")))


@query("""with p as (select o_custkey id, max(case when o_orderkey % 3 = 0 then o_totalprice / 600000 end) r, max(o_totalprice / 500000) d, bool_or(o_orderkey % 101 = 0) failed, bool_and(o_orderstatus = 'F') own from orders group by 1)
select id, case when failed then 'failed' when r is not null and r < 0.025 then 'low_relevance' when r is null and d < 0.35 then 'low_similarity' when own then 'model' end reason from p""")
def abstention_decisions(spark, d):
    o = table(spark, d, "orders")
    passages = o.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 600000).alias("score_rerank"), (F.col("o_totalprice") / 500000).alias("score_dense"))
    flags = o.groupBy(F.col("o_custkey").alias("id")).agg(F.bool_or(F.col("o_orderkey") % 101 == 0).alias("failed"), F.bool_and(F.col("o_orderstatus") == "F").alias("model_abstains"))
    return evaluation.abstention(evaluation.relevance(passages).join(flags, "id")).select("id", "reason")


@query("select most, count(*) questions from (select id, max(k) most from (select o_custkey id, o_orderpriority doc, count(*) k from orders group by 1, 2) group by 1) group by 1")
def same_document_histogram(spark, d):
    return evaluation.same_document_histogram(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("doc")))


@query("select o_orderkey id, true same_status, o_orderkey % 6 <> 0 same_price from orders where o_orderkey % 2 = 0")
def reproducibility(spark, d):
    one = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    two = one.filter("id % 2 = 0").withColumn("price", F.when(F.col("id") % 6 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return evaluation.reproduced(one, two, ["status", "price"])


@query("""with w as (select conv_id, turn, row_number() over (partition by conv_id order by turn) i, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) n from conversations), r as (select *, sum(n) over (partition by conv_id order by turn) s from w)
select conv_id, turn, s::bigint words from r where i <= 5 and conv_id % 30 + s <= 400 - 150 - 32""")
def context_fit(spark, d):
    """A window of 400, 150 of it for the output, beside a prompt of up to 30."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), X.word_count(F.col("text")).alias("tokens"))
    kept = fusion.fitted(turns, F.col("query_id") % 30, 400, 150, most=5)
    return kept.select(F.col("query_id").alias("conv_id"), F.col("pos").alias("turn"), F.col("used").alias("words"))


@query("""select conv_id, string_agg('[P' || r || '] ' || text, chr(10) || chr(10) order by r) evidence from (select conv_id, text, row_number() over (partition by conv_id order by turn) r from conversations) group by 1""")
def evidence_blocks(spark, d):
    from archivolt.operators.postprocess import evidence_block

    texts = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("t"))
    return texts.select("conv_id", evidence_block("t").alias("evidence"))


@query("""select page_id, case when page_id % 4 = 0 then 'https://drive.google.com/uc?export=download&id=F' || page_id when page_id % 4 = 1 then 'https://www.dropbox.com/s/' || page_id || '/x.zip?dl=1'
 when page_id % 4 = 2 then 'https://zenodo.org/records/' || page_id || '/files/x.zip?download=1' else url end url from pages""")
def share_links(spark, d):
    k, n = F.col("page_id").cast("string"), F.col("page_id") % 4
    url = F.when(n == 0, F.concat(F.lit("https://drive.google.com/file/d/F"), k, F.lit("/view?usp=sharing"))).when(n == 1, F.concat(F.lit("https://www.dropbox.com/s/"), k, F.lit("/x.zip?dl=0"))).when(n == 2, F.concat(F.lit("https://zenodo.org/records/"), k, F.lit("/files/x.zip?download=1"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", sources.direct_link(url).alias("url"))


@query("select name, round(sum(points), 2) total, sum(case when points is not null then case name when 'closed' then 20.0::double else 30.0::double end end) possible from (select case when event_id % 2 = 0 then 'closed' else 'judge' end name, case when event_id % 3 <> 0 then (event_id % 100) / 4.0::double end points from events) group by 1")
def component_points(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, "closed").otherwise("judge").alias("name"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100 / 4.0).alias("points"))
    one = None
    for name in ("closed", "judge"):
        part = evaluation.total_points(e.filter(F.col("name") == name)).withColumn("name", F.lit(name))
        one = part if one is None else one.unionByName(part)
    return one.select("name", "total", "possible")


# Texts made from keys: what must come out follows from the same keys.


GREEDY = r"""with recursive p as (select doc_id, unnest(l) t, generate_subscripts(l, 1) i from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') l from documents)),
w as (select doc_id, i, t, regexp_extract_all(t, '\S+') w from p),
cut as (select doc_id, i, 0 s, t, len(w) n from w where len(w) <= 300 union all
 select doc_id, i, s, array_to_string(w[s + 1:s + 300], ' '), len(w[s + 1:s + 300]) from (select *, unnest(range(0, greatest(1, len(w) - 45), 255)) s from w where len(w) > 300)),
u as (select doc_id, t, n, row_number() over (partition by doc_id order by i, s) u from cut),
r as (select doc_id, u, 0 part, [{'t': t, 'n': n}] win from u where u = 1 union all
 select r.doc_id, u.u, case when list_sum(list_transform(win, lambda x: x.n)) + u.n <= 300 then part else part + 1 end,
  case when list_sum(list_transform(win, lambda x: x.n)) + u.n <= 300 then list_append(win, {'t': u.t, 'n': u.n})
   else list_append(win[len(win) + 1 - len(list_filter(range(1, len(win) + 1), lambda i: list_sum(list_transform(win[len(win) - i + 1:], lambda x: x.n)) <= 45)):], {'t': u.t, 'n': u.n}) end
 from r join u on u.doc_id = r.doc_id and u.u = r.u + 1)
select doc_id, part, array_to_string(list_transform(win, lambda x: x.t), chr(10)) text from (select *, row_number() over (partition by doc_id, part order by u desc) z from r) where z = 1"""


@query(GREEDY)
def greedy_windows(spark, d):
    return docs(spark, d).select(F.col("id").alias("doc_id"), F.posexplode(segment.windows_of("text")).alias("part", "text"))


def statutes(spark, d):
    """A statute for each customer: articles, a note, a heading and a concordance, in an order that its key decides."""
    k = F.col("c_custkey")
    lines = F.array(
        F.concat(F.lit("LEY "), k.cast("string")), F.when(k % 2 == 0, "TÍTULO I").otherwise("Por la cual se dicta"), F.lit("DISPOSICIONES GENERALES"), F.concat(F.lit("ARTÍCULO "), (k % 9).cast("string"), F.lit("o. Objeto.")), F.col("c_name"),
        F.lit("Notas de vigencia"), F.concat(F.lit("Modificado en "), k.cast("string")), F.lit("Concordancias"), F.lit("Ley 1"), F.concat(F.lit("Artículo "), (k % 9 + 1).cast("string"), F.lit("A. Alcance.")), F.col("c_mktsegment"),
    )
    return customers(spark, d).select(k.alias("doc_id"), F.array_join(lines, "\n").alias("text"))


STATUTES = """with c as (select c_custkey k, c_custkey % 2 = 0 even, c_custkey % 9 a, c_name, c_mktsegment from customer),
s as (select k doc_id, 0 ord, 'preamble' kind, null article, null section, 'LEY ' || k || case when even then '' else chr(10) || 'Por la cual se dicta' || chr(10) || 'DISPOSICIONES GENERALES' end text from c
 union all select k, 1, 'article', a::varchar, case when even then 'TÍTULO I DISPOSICIONES GENERALES' end, 'ARTÍCULO ' || a || 'o. Objeto.' || chr(10) || c_name from c
 union all select k, 2, 'note', a::varchar, case when even then 'TÍTULO I DISPOSICIONES GENERALES' end, 'Notas de vigencia' || chr(10) || 'Modificado en ' || k from c
 union all select k, 3, 'article', (a + 1) || 'A', case when even then 'TÍTULO I DISPOSICIONES GENERALES' end, 'Artículo ' || (a + 1) || 'A. Alcance.' || chr(10) || c_mktsegment from c)"""


@query(STATUTES + " select * from s")
def article_segments(spark, d):
    return segment.statute_segments(statutes(spark, d))


@query("""select c_custkey doc_id, unnest([0, 1, 2, 3, 4, 5]) block, unnest([null, 'ANTECEDENTES', 'CONSIDERACIONES', 'RESUELVE', null, 'ACLARACIÓN DE VOTO']) section,
unnest(['Magistrada ponente', 'I. ANTECEDENTES' || chr(10) || c_name, 'II. CONSIDERACIONES DE LA CORTE' || chr(10) || c_mktsegment, 'RESUELVE' || chr(10) || 'Primero.', 'Notifíquese y cúmplase' || chr(10) || 'Firmas',
 'ACLARACIÓN DE' || chr(10) || 'VOTO DEL MAGISTRADO' || chr(10) || 'fin']) text from customer""")
def judgment_sections(spark, d):
    text = F.concat(F.lit("Magistrada ponente\nI. ANTECEDENTES\n"), F.col("c_name"), F.lit("\nII. CONSIDERACIONES DE LA CORTE\n"), F.col("c_mktsegment"), F.lit("\nRESUELVE\nPrimero.\nNotifíquese y cúmplase\nFirmas\nACLARACIÓN DE\nVOTO DEL MAGISTRADO\nfin"))
    return segment.judgment_sections(customers(spark, d).select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query(STATUTES + """, h as (select *, 'Ley ' || doc_id || ' de 2012' || case kind when 'preamble' then ' (encabezado).' when 'note' then ', artículo ' || article || ' (notas de vigencia y jurisprudencia).' else ', artículo ' || article || '.' end || chr(10) || text whole from s),
o as (select *, coalesce(sum(length(whole) + 2) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint b from h)
select doc_id || '#' || lpad(ord::varchar, 5, '0') chunk_id, doc_id, b "begin", b + length(whole) "end", whole text, kind, article, section, 1 part, 1 parts from o""")
def statute_chunks(spark, d):
    named = statutes(spark, d).select("doc_id", F.lit("ley").alias("type"), F.concat(F.lit("Ley "), F.col("doc_id").cast("string"), F.lit(" de 2012")).alias("name"), "text")
    return segment.chunks(named)


SLOTS = BM25 + """, b as (select query_id, rank pos, id, source doc, source = 'src0' m, source in ('src1', 'src2', 'src3') and source <> 'src0' c, lang <> 'en' is_norm from bm25 join documents on doc_id = id where rank <= 10),
h as (select *, least(2 - sum((pos <= 4 and is_norm)::int) over w, sum((pos > 4 and is_norm)::int) over w, sum((pos <= 4 and not is_norm)::int) over w) swap,
  sum((pos > 4 and is_norm)::int) over (partition by query_id order by pos) i, sum((pos <= 4 and not is_norm)::int) over (partition by query_id order by pos desc) o from b where query_id % 5 = 0 window w as (partition by query_id)),
steps as (
 select query_id, row_number() over (partition by query_id order by phase, round, letter, pos) step, cands, letter from (
  select query_id, 1 phase, 0 round, '' letter, pos, [{'id': id, 'doc': doc, 'm': m, 'c': c}] cands from h where (pos <= 4 and (is_norm or o > greatest(swap, 0))) or (pos > 4 and is_norm and i <= swap)
  union all select query_id, 3, 0, '', pos, [{'id': id, 'doc': doc, 'm': m, 'c': c}] from h
  union all select q, 2, r, letter, 0, cands from (select query_id - query_id % 5 q, substr('ABCD', (query_id % 5)::int, 1) letter, list({'id': id, 'doc': doc, 'm': m, 'c': c} order by pos) cands, unnest([1, 2, 3, 4]) r from b where query_id % 5 <> 0 and pos <= 4 group by 1, 2))),
r as (select query_id, 0::bigint step, []::struct(id bigint, doc varchar, m boolean, c boolean)[] seen, []::varchar[] origins from (select distinct query_id from steps) union all
 select r.query_id, s.step, case when pick is null then seen else list_append(seen, pick) end, case when pick is null then origins else list_append(origins, case when s.letter = '' then 'question' else s.letter end) end
 from r join steps s on s.query_id = r.query_id and s.step = r.step + 1, lateral (select case when len(seen) < 10 then list_filter(s.cands, lambda x: not list_contains(list_transform(seen, lambda y: y.id), x.id)
   and (x.m or len(list_filter(seen, lambda y: y.doc = x.doc)) < 2) and (not x.c or len(list_filter(seen, lambda y: y.c)) < 1))[1] end pick)),
z as (select * from r qualify row_number() over (partition by query_id order by step desc) = 1)
select query_id, unnest(range(1, len(seen) + 1))::int place, unnest(list_transform(seen, lambda x: x.id)) id, unnest(origins) origin from z"""


@query(SLOTS.replace("with d as", "with recursive d as", 1))
def option_slotting(spark, d):
    """With the quota of norms, two passages of a document unless it is mentioned, and one of the complementary ones."""
    about = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc"), (F.col("source") == "src0").alias("mentioned"), F.col("source").isin("src1", "src2", "src3").alias("complementary"), (F.col("lang") != "en").alias("is_norm"))
    best = lexical.bm25(docs(spark, d), items(spark, d), 10).join(about, "id").withColumn("pos", F.col("rank").cast("long"))
    options = best.filter("query_id % 5 <> 0").withColumn("letter", F.substring(F.lit("ABCD"), (F.col("query_id") % 5).cast("int"), F.lit(1))).withColumn("query_id", F.col("query_id") - F.col("query_id") % 5)
    return fusion.slotted(best.filter("query_id % 5 = 0"), options, per_document=2, complementary=1)


@query("""select event_id, '{"id": ' || event_id || ', "type": "' || event_type || '"' || case when event_id % 3 = 0 then '' else ', "props": ' || props end || '}' json from events""")
def json_repair(spark, d):
    from archivolt.functions.json_repair import repaired_json

    end = F.when(F.col("event_id") % 3 == 0, ', "cut": "of').otherwise(F.concat(F.lit(', "props": '), F.col("props"), F.lit("}\n```")))
    made = F.concat(F.lit('<think>x</think>```json\n{"id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('"'), end)
    return table(spark, d, "events").select("event_id", repaired_json(made).alias("json"))


@query("""select o_orderkey id, case when o_orderkey % 2 = 0 then 'Según el art. ' || o_custkey % 300 || ' de la Ley ' || o_orderkey % 2000 || ' de ' || year(o_orderdate) || ' procede.' else 'Según la normativa aplicable procede.' end text from orders""")
def citation_filter(spark, d):
    from archivolt.operators.postprocess import filter_citations

    x = cited_orders(spark, d).withColumn("own", bodies_of(extract_citations("text")))
    return x.select("id", filter_citations("text", F.when(F.col("id") % 2 == 0, F.col("own")).otherwise(F.array().cast("array<string>"))).alias("text"))


from archivolt.plans import cases, storage  # noqa: E402, F401
