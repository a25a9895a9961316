"""Registered queries over files, sinks, streams and saved tables that are made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import spans, validation
from archivolt.plans.catalog import query, table
from archivolt.session import work_path
from archivolt.sources import committed, hash_tree
from archivolt.sources import files as scans
from archivolt.sources.saved_cache import BucketedCache
from archivolt.streaming import resume

#: What a document's file is, by doc_id % 5, in Spark: extension and content.
KIND = "case doc_id % 5 when 1 then '.html' when 2 then '.xyz' when 3 then '.docx' else '.txt' end"
ESCAPED = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
CONTENT = f"case doc_id % 5 when 1 then encode('<html><body><nav>m</nav><p>' || {ESCAPED} || '</p></body></html>', 'UTF-8') when 4 then unhex('EFBBBF') || encode(text, 'UTF-8') else encode(text, 'UTF-8') end"
SCANNED = f"select doc_id, {KIND} as \"extension\", case doc_id % 5 when 2 then 'unsupported' when 3 then 'damaged' else case when trim(text, E' \\n\\t\\r') = '' then 'empty' end end problem, case doc_id % 5 when 1 then chr(10) || text || chr(10) when 2 then '' when 3 then '' else text end as text from (select doc_id, coalesce(text, '') as text from documents)"


def document_files(spark, d) -> str:
    """A folder with a file of each document, in five kinds, some unknown and some damaged."""
    path = work_path(spark, "corpus")
    rows = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    committed.save(rows.select("doc_id", F.expr(KIND).alias("extension"), F.expr(CONTENT).alias("content")), path)
    return path


def by_doc(files):
    return files.withColumn("doc_id", F.regexp_extract("path", r"/(\d+)\.[^/]*$", 1).cast("long"))


@query(SCANNED)
def file_source(spark, d):
    return by_doc(scans.scan(spark, document_files(spark, d))).select("doc_id", "extension", "problem", "text")


@query(f"select * from ({SCANNED}) where \"extension\" = '.html'")
def file_source_pushed(spark, d):
    """The condition on the extension is the listing's: other files aren't opened."""
    return by_doc(scans.scan(spark, document_files(spark, d)).filter("extension = '.html'")).select("doc_id", "extension", "problem", "text")


@query("select event_id, event_type, value from events union all select event_id + 1000000, 'more', null from events where event_type = 'error'")
def committed_lines(spark, d):
    """An output that is written, replaced and appended to."""
    path, events = work_path(spark, "lines"), table(spark, d, "events").select("event_id", "event_type", "value")
    committed.save(events.withColumn("event_type", F.lit("stale")), path, layout="lines")
    committed.save(events, path, layout="lines")
    more = events.filter("event_type = 'error'").select((F.col("event_id") + 1000000).alias("event_id"), F.lit("more").alias("event_type"), F.lit(None).cast("double").alias("value"))
    committed.save(more, path, layout="lines", mode="append")
    return committed.load(spark, path, "event_id long, event_type string, value double")


@query("""with f as (select user_id id, min(event_id) f from events where event_id % 2 = 0 group by 1),
s as (select user_id id, count(*) n from events group by 1)
select s.id, case when f.id is not null then 'first' else 'second' end as wave from s left join f using (id) where s.id % 10 <> 0""")
def streamed_answers(spark, d):
    """Questions in two waves, the second with all of the first again, and a restart between them; those with an id that
    ends in 0 were answered before."""
    at, events = work_path(spark, "stream"), table(spark, d, "events")
    done = events.filter("user_id % 10 = 0").select(F.col("user_id").alias("id")).distinct()
    for wave, part in (("first", events.filter("event_id % 2 = 0")), ("second", events)):
        part.select(F.col("user_id").alias("id")).write.mode("append").json(f"{at}/questions")
        resume.answer_new(spark, f"{at}/questions", "id long", f"{at}/answers", f"{at}/checkpoint", lambda batch, wave=wave: batch.withColumn("wave", F.lit(wave)), done)
    return resume.answers(spark, f"{at}/answers", "id long, wave string").select("id", "wave")


# ---------------------------------------------------------------- caches, trees, spans


@query("""with t as (select text, min(doc_id % 2) half from documents group by 1) select doc_id, length(d.text) size, case when half = 0 then 1 else 2 end as round from documents d join t on t.text is not distinct from d.text where d.text is not null""")
def bucketed_cache(spark, d):
    """Two rounds of misses: even documents, then all, of which only new texts are computed; compacted between."""
    x = table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("key")).filter("text is not null")
    cache = BucketedCache(spark, work_path(spark, "cache"), "size int, round int", 8)
    for turn, part in ((1, x.filter("doc_id % 2 = 0")), (2, x)):
        cache.append(cache.misses(part).select("key", F.length("text").alias("size"), F.lit(turn).alias("round")), turn)
        cache.compact()
    return cache.found(x).select("doc_id", "size", "round")


LEAVES = """b as (select doc_id, encode(coalesce(text, '')) b, octet_length(encode(coalesce(text, ''))) n from documents),
l as (select doc_id, o, sha256(array_slice(b, o + 1, least(o + 4096, n))) h from (select *, unnest(range(0, greatest(n, 1), 4096)) o from b))"""


def texts_in_files(spark, d, text) -> str:
    path = work_path(spark, "texts")
    committed.save(table(spark, d, "documents").select("doc_id", text.alias("text")), path)
    return path


@query(f"with {LEAVES} select doc_id, count(*) ranges, sha256(string_agg(h, '' order by o)) root from l group by 1")
def hash_trees(spark, d):
    hashed = hash_tree.leaves(spark, texts_in_files(spark, d, F.col("text")), 4096)
    return by_doc(hash_tree.roots(hashed.filter("path like '%.txt'"))).select("doc_id", "ranges", "root")


@query("""select doc_id, (n // 4096 * 4096)::bigint as "offset", case when n > 0 and n % 4096 = 0 then 'extra' else 'changed' end problem from (select doc_id, octet_length(encode(coalesce(text, ''))) n from documents where doc_id % 7 = 0)""")
def changed_ranges(spark, d):
    """The range of a file that something was written to."""
    text = F.coalesce("text", F.lit(""))
    both = [by_doc(hash_tree.leaves(spark, texts_in_files(spark, d, t), 4096).filter("path like '%.txt'")).select(F.col("doc_id").alias("path"), "offset", "hash") for t in (text, F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("x"))).otherwise(text))]
    return hash_tree.changed_ranges(*both).withColumnRenamed("path", "doc_id")


PRE = "repeat('ñ ', (c_custkey % 7)::int)"
RULING = "'C-' || (100 + c_custkey % 900) || ' de 1999'"
PLACED = f"""with k as (select c_custkey id, 2 * (c_custkey % 7) p, c_custkey % 4 f, {RULING} r, {PRE} pre from customer),
m as (select id, p "begin", p + case f when 0 then 15 when 1 then 23 else 50 end "end", case f when 2 then ['decision_andina_486||'] else ['codigo_penal||'] end bodies from k where f < 3
union all select id, p + 39, p + 39 + length(r), ['jurisprudencia|C-' || (100 + id % 900) || '|1999'] from k where f = 1)"""


def placed_texts(spark, d):
    """Citations whose forms overlap: a statute that is also a code's name, a code within a longer name, three forms of a
    decision within each other."""
    forms = "case c_custkey % 4 when 0 then 'Ley 599 de 2000' when 1 then 'Código Penal Colombiano y la sentencia ' || r when 2 then 'Decisión 486 de la Comisión de la Comunidad Andina' else 'nada' end"
    k = table(spark, d, "customer").selectExpr("c_custkey", "repeat('ñ ', int(c_custkey % 7)) pre", f"{RULING} r")
    return k.selectExpr("c_custkey id", f"pre || {forms} || '; fin' text")


@query(PLACED + """ select id, "begin"::int "begin", "end"::int "end", bodies from m""")
def merged_spans(spark, d):
    return spans.merged(spans.located(placed_texts(spark, d)))


@query(PLACED + """ select id, pre || case f when 0 then '[codigo_penal]' when 1 then '[codigo_penal] y la sentencia [jurisprudencia]' when 2 then '[decision_andina_486]' else 'nada' end || '; fin' as text from k""")
def spliced_texts(spark, d):
    texts = placed_texts(spark, d)
    kind = F.concat(F.lit("["), F.substring_index(F.col("bodies")[0], "|", 1), F.lit("]"))
    return spans.spliced(texts, spans.merged(spans.located(texts)), kind)


@query("select count(*) lines, count_if(o_orderkey % 50 = 0)::bigint without_id, count_if(o_orderkey % 12 > 10)::bigint over_ten, count_if(o_orderstatus = 'F')::bigint abstentions, count_if(o_orderkey % 3 = 0)::bigint unknown_format, count_if(o_orderkey % 50 <> 0)::bigint reread from orders")
def delivered_lines(spark, d):
    """What was observed beside the sink, and the lines with an id that are read from it again."""
    k, path = F.col("o_orderkey"), work_path(spark, "delivery")
    lines = table(spark, d, "orders").select(F.when(k % 50 != 0, k).alias("id"), F.when(k % 3 == 0, "?").otherwise("multiple_choice").alias("formato"), (k % 12).alias("n_passages"), (F.col("o_orderstatus") == "F").alias("abstencion"))
    seen = validation.delivered(lines, path)
    again = spark.read.schema("id long").json(path).agg(F.count("id").alias("reread"))
    return again.select(*[F.lit(v).cast("long").alias(c) for c, v in seen.items()], "reread")
