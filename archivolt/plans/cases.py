"""More registered queries: texts, files and rows made from keys of the tables, whose results SQL states from the same
keys."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.config import resolved
from archivolt.functions import prompts
from archivolt.functions import text as X
from archivolt.functions.stemming import stemmed
from archivolt.functions.grammar import ALIASES, article_level, bodies_of, body_key, extract_citations, locate_citations
from archivolt.operators import dense, evaluation, fusion, lexical, models, postprocess, reports, router, runs, segment, validation
from archivolt.plans.catalog import BM25, CAPPED, DENSE, WORDS, candidates, cited_orders, customers, docs, items, query, table
from archivolt.session import work_path
from archivolt.sources import committed
from archivolt.sources import documents as sources


def s(column):
    return F.col(column).cast("string")


# ---------------------------------------------------------------- citations


N, Y, A = "(3000 + c_custkey % 1000)", "(1990 + c_custkey % 30)", "(1 + c_custkey % 90)"
#: Eight forms of citing, by the key's remainder: the text, and its citations as (kind, number, year, article).
FORMS = [
    (f"'Sentencia C-' || {N} || ' de ' || {Y} || ' rige.'", [("'jurisprudencia'", f"'C-' || {N}", Y, "null")]),
    (f"'Ley 1480 de 2011. Art. ' || {A} || '.'", [("'estatuto_consumidor'", "null", "null", A)]),
    (f"'artículos ' || {A} || ', ' || ({A} + 100) || ' y ' || ({A} + 200) || ' de la Constitución Política'", [("'constitucion'", "null", "null", a) for a in (A, f"({A} + 100)", f"({A} + 200)")]),
    (f"'la ley 599 y el Decreto Ley ' || {N} || ' de 2012'", [("'codigo_penal'", "null", "null", "null"), ("'decreto'", N, "2012", "null")]),
    (f"'Ver art. ' || {A} || 'A del C.S.T. vigente'", [("'codigo_sustantivo_trabajo'", "null", "null", f"{A} || 'a'")]),
    (f"'Resolución No. ' || {N} || ' de ' || {Y}", [("'resolucion'", N, Y, "null")]),
    (f"'T ' || {N} || '/10'", [("'jurisprudencia'", f"'T-' || {N}", "2010", "null")]),
    ("'nada que citar aquí'", []),
]


def forms_sql() -> str:
    parts = []
    for i, (_, cites) in enumerate(FORMS):
        parts += [f"select c_custkey id, {k} kind, ({n})::varchar number, ({y})::varchar \"year\", ({a})::varchar article from customer where c_custkey % {len(FORMS)} = {i}" for k, n, y, a in cites]
    return " union all ".join(parts)


def cited_texts(spark, d):
    text = F.expr("case " + " ".join(f"when c_custkey % {len(FORMS)} = {i} then {t}" for i, (t, _) in enumerate(FORMS)) + " end")
    return customers(spark, d).select(F.col("c_custkey").alias("id"), text.alias("text"), "c_mktsegment")


@query(f"with f as ({forms_sql()}) select * from f")
def citation_forms(spark, d):
    return cited_texts(spark, d).select("id", F.explode(extract_citations("text")).alias("c")).select("id", "c.*")


@query(f"with f as ({forms_sql()}) select id, count(*) n from f where article is not null group by 1")
def article_citations(spark, d):
    return cited_texts(spark, d).select("id", F.size(article_level(extract_citations("text"))).cast("long").alias("n")).filter("n > 0")


@query("""select c_custkey id, unnest([12, 30]) "begin", unnest([24, 30 + length('C-' || (3000 + c_custkey % 1000) || ' de 1999')])::int "end", unnest(['codigo_civil', 'jurisprudencia']) kind from customer""")
def citation_spans(spark, d):
    text = F.concat(F.lit("Conforme al Código\tCivil y C-"), (3000 + F.col("c_custkey") % 1000).cast("string"), F.lit(" de 1999."))
    text = F.replace(text, F.lit(" y C-"), F.lit(" y va C-"))
    found = customers(spark, d).select(F.col("c_custkey").alias("id"), F.explode(locate_citations(text)).alias("m"))
    return found.select("id", "m.begin", "m.end", "m.kind")


@query("""select c_custkey id, case when c_custkey % 3 = 0 then 'La Ley 3001 de 1999 y el decreto 12 dicen' else 'La Ley 3001 y el decreto 12 dicen' end text from customer""")
def dated_statutes(spark, d):
    own = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("ley|3001|1999"), F.lit("codigo_civil||"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("ley|3001|1999"), F.lit("ley|3001|2000"))).otherwise(F.array().cast("array<string>"))
    return customers(spark, d).select(F.col("c_custkey").alias("id"), postprocess.date_citations(F.lit("La Ley 3001 y el decreto 12 dicen"), own).alias("text"))


@query("""select c_custkey id, 'Vale la Ley ' || (3000 + c_custkey % 1000) || ' de 2001. ' || case when c_custkey % 3 = 0 then 'Según la normativa aplicable rige. ' else '' end || 'Fin.' text from customer""")
def cut_citations(spark, d):
    """Two citations with their leads, side by side, become one replacement."""
    n, k = (3000 + F.col("c_custkey") % 1000).cast("string"), F.col("c_custkey") % 3
    bad = F.when(k == 0, "Según el artículo 5 del Código Penal, la Sentencia de tutela T-9 de 2010 rige. ").otherwise("")
    text = F.concat(F.lit("Vale la Ley "), n, F.lit(" de 2001. "), bad, F.lit("Fin."))
    own = F.array(F.concat(F.lit("ley|"), n, F.lit("|2001")))
    return customers(spark, d).select(F.col("c_custkey").alias("id"), postprocess.filter_citations(text, own).alias("text"))


@query("""select c_custkey id, unnest(['Uno ' || c_name || '.', '¿Dos?', 'Tres; cuatro:', 'Cinco.']) sentence from customer""")
def sentence_split(spark, d):
    text = F.concat(F.lit("Uno "), F.col("c_name"), F.lit(". ¿Dos? Tres; cuatro: Cinco."))
    return customers(spark, d).select(F.col("c_custkey").alias("id"), F.explode(postprocess.sentence_list(text)).alias("sentence"))


@query("""select c_custkey id, case c_custkey % 3 when 0 then 'Uno ' || c_name || '. Dos tres.' when 1 then 'uno dos tres cuatro' else '' end text from customer""")
def limited_texts(spark, d):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Uno "), F.col("c_name"), F.lit(". Dos tres. Cuatro cinco seis. Siete."))).when(k == 1, "uno dos tres cuatro cinco seis").otherwise("")
    return customers(spark, d).select(F.col("c_custkey").alias("id"), postprocess.limit_text(text, 3, 4).alias("text"))


@query(f"with f as ({forms_sql()}), b as (select distinct id, kind || '|' || coalesce(number, '') || '|' || coalesce(\"year\", '') body from f), p as (select 'estatuto_consumidor||' body, 'd1' doc union all select 'codigo_penal||', 'd2' union all select 'codigo_penal||', 'd3') select id query_id, doc from b join p using (body)")
def mentioned_documents(spark, d):
    about = spark.createDataFrame([("estatuto_consumidor||", "d1"), ("codigo_penal||", "d2"), ("codigo_penal||", "d3")], "body string, doc string")
    return router.mentioned(cited_texts(spark, d).select("id", "text"), about)


SUPPORT = f"""with f as ({forms_sql()}), b as (select distinct id, kind || '|' || coalesce(number, '') || '|' || coalesce("year", '') body from f),
p as (select c_custkey id, 1 pos, 'codigo_penal||' body from customer union all select c_custkey, 2, 'estatuto_consumidor||' from customer union all select c_custkey, 3, 'codigo_penal||' from customer)"""


def three_passages(spark, d):
    texts = F.array(F.lit("Dice el Código Penal que sí."), F.lit("Ley 1480 de 2011, art. 3"), F.lit("La ley 599 de 2000 manda"))
    return customers(spark, d).select(F.col("c_custkey").alias("id"), F.posexplode(texts).alias("p", "text")).select("id", (F.col("p") + 1).alias("pos"), "text")


@query(SUPPORT + " select b.id, b.body, coalesce(list_sort(list(pos) filter (pos is not null)), []) passages from b left join p using (id, body) group by 1, 2")
def supporting_passages(spark, d):
    return router.supporting(cited_texts(spark, d).select("id", "text"), three_passages(spark, d))


@query("select c_custkey id, ['codigo_penal||', 'estatuto_consumidor||'] supported from customer")
def evidence_bodies(spark, d):
    return evaluation.evidence_bodies(three_passages(spark, d))


@query(SUPPORT + " select count(*) chunks, count_if(id not in (select id from b where body = 'codigo_penal||'))::bigint as \"without\" from (select c_custkey id from customer)")
def without_own_body(spark, d):
    own = cited_texts(spark, d).select(bodies_of(extract_citations("text")).alias("bodies"), F.array(F.lit("codigo_penal||")).alias("document_bodies"))
    return reports.without_own_body(own)


@query(f"with f as ({forms_sql()}) select count(distinct id) items from f")
def citable_items(spark, d):
    x = cited_texts(spark, d).select("id", bodies_of(extract_citations("text")).alias("reference"))
    return evaluation.citation_index(x, x.select("id", F.lit(False).alias("abstained"), F.col("reference").alias("cited"), F.col("reference").alias("supported"))).select("items")


@query("select o_orderkey id, o_orderkey % 3 <> 0 ok from orders")
def fully_supported(spark, d):
    x = cited_orders(spark, d).withColumn("cited", bodies_of(extract_citations("text")))
    own = F.when(F.col("id") % 3 != 0, F.array_union("cited", F.array(F.lit("codigo_civil||")))).otherwise(F.array(F.lit("codigo_civil||")))
    return x.select("id", (F.size(F.array_except("cited", own)) == 0).alias("ok"))


# ---------------------------------------------------------------- delivery


@query("""select c_custkey id, case c_custkey % 3 when 0 then ['Ley 2 de 2002', 'Ley 1 de 2001, artículo 2'] when 1 then ['Ley 1 de 2001, artículo 2', 'Sentencia C-1 de 2003'] else ['Ley 1 de 2001, artículo 2'] end refs from customer""")
def used_references(spark, d):
    k = F.col("c_custkey") % 3
    passage = lambda text, score, origin: F.struct(F.lit(text).alias("text"), F.lit(score).cast("double").alias("score_rerank"), F.array(F.lit(origin)).alias("origins"))
    passages = F.array(
        F.struct(F.lit("Ley 1 de 2001, artículo 2. (parte 1 de 3)\ncuerpo").alias("text"), F.when(k == 2, 0.1).otherwise(0.9).alias("score_rerank"), F.array(F.lit("bm25")).alias("origins")),
        passage("Ley 2 de 2002 (encabezado).\nx", 0.2, "dense"),
        F.struct(F.lit("Sentencia C-1 de 2003. [HECHOS]\ny").alias("text"), F.lit(None).cast("double").alias("score_rerank"), F.array(F.when(k == 1, "router").otherwise("bm25")).alias("origins")),
    )
    used = F.when(k == 0, F.array(F.lit(2), F.lit(9))).otherwise(F.lit(None).cast("array<int>"))
    return customers(spark, d).select(F.col("c_custkey").alias("id"), postprocess.used_references(passages, used).alias("refs"))


@query("""select c_custkey id, 'Ley ' || c_custkey || ' de 2001, artículo 3' reference from customer""")
def passage_references(spark, d):
    text = F.concat(F.lit("Ley "), s("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, " de 2001, artículo 3. (parte 1 de 2)\ncuerpo").otherwise(" de 2001, artículo 3 (notas de vigencia y jurisprudencia). [HECHOS]"))
    return customers(spark, d).select(F.col("c_custkey").alias("id"), postprocess.passage_reference(text).alias("reference"))


@query("""select c_custkey id, case c_custkey % 3
 when 0 then '{"respuesta_correcta": "A", "justificacion": "Por ' || c_name || '. Fundamento normativo: Ley 1 de 2001.", "descarte_opciones": {"B": "La evidencia recuperada no respalda esta opción.", "C": "No."}}'
 when 1 then '{"respuesta": "Uno ' || c_name || '. Dos.", "palabras_clave": ["a", "b"], "referencia_legal": "Ley 1 de 2001"}'
 else '{"marco_normativo": "Normas aplicables: Ley 1 de 2001.", "analisis": "Caso ' || c_name || '.", "jurisprudencia": "La evidencia recuperada no incluye jurisprudencia pertinente para el caso.", "conclusion": "Caso ' || c_name || '."}' end fields from customer""")
def delivered_answers(spark, d):
    k, name = F.col("c_custkey") % 3, F.col("c_name")
    kind = F.element_at(F.array(*map(F.lit, ("multiple_choice", "semi_open", "open_ended"))), (k + 1).cast("int"))
    item = F.concat(F.lit('{"formato": "'), kind, F.lit('", "opciones": {"A": "x", "B": "y", "C": "z"}}'))
    answer = (
        F.when(k == 0, F.concat(F.lit('{"respuesta_correcta": "A", "justificacion": "Por '), name, F.lit('.", "analisis_opciones": {"A": "Sí.", "C": "No."}}')))
        .when(k == 1, F.concat(F.lit('{"respuesta": "Uno '), name, F.lit('. Dos.", "palabras_clave": ["a", " ", "b"]}')))
        .otherwise(F.concat(F.lit('{"analisis": "Caso '), name, F.lit('."}')))
    )
    passages = F.lit('[{"text": "Ley 1 de 2001 (encabezado).\\nx", "score_rerank": 0.9, "origins": []}]')
    return customers(spark, d).select(F.col("c_custkey").alias("id"), postprocess.delivered_fields(item, answer, passages).alias("fields"))


@query("""select event_id id, 'd' || user_id doc_id, event_id "begin", event_id + 9 "end", event_type "text", round(value / 7.0::double, 4) score from events""")
def delivered_passages(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("d"), s("user_id")).alias("doc_id"), F.col("event_id").alias("begin"), (F.col("event_id") + 9).alias("end"), F.col("event_type").alias("text"), (F.col("value") / 7.0).alias("score"), F.lit("x").alias("other"))
    return postprocess.delivered_passages(e)


@query("""select c_custkey id, case c_custkey % 3 when 0 then c_name when 1 then c_name || ' ' || c_mktsegment else c_name || ' ' || c_mktsegment || '  fin' end answer, case c_custkey % 3 when 0 then c_name when 1 then c_name else c_name || ' ' || c_mktsegment || '  fin' end judged from customer""")
def answer_texts(spark, d):
    k = F.col("c_custkey") % 3
    x = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.element_at(F.array(*map(F.lit, ("multiple_choice", "semi_open", "open_ended"))), (k + 1).cast("int")).alias("formato"), F.col("c_name").alias("justificacion"), F.col("c_name").alias("respuesta"),
        F.col("c_mktsegment").alias("referencia_legal"), F.col("c_name").alias("marco_normativo"), F.col("c_mktsegment").alias("analisis"), F.lit(None).cast("string").alias("jurisprudencia"), F.lit("fin").alias("conclusion"),
    )
    return x.select("id", evaluation.answer_text().alias("answer"), evaluation.answer_text(for_judge=True).alias("judged"))


@query(r"""with t as (select conv_id, turn, 'cabecera ' || turn || chr(10) || text t, regexp_extract_all(text, '\S+') w from conversations)
select conv_id, turn, case when len(w) <= 12 then t else 'cabecera ' || turn || chr(10) || array_to_string(w[1:12], ' ') || ' …' end passage from t""")
def trimmed_passages(spark, d):
    text = F.concat(F.lit("cabecera "), s("turn"), F.lit("\n"), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", postprocess.trimmed_passage(text, 12).alias("passage"))


# ---------------------------------------------------------------- names, headers and titles


@query("""select c_custkey id, case c_custkey % 7 when 0 then 'Constitución Política de Colombia' when 1 then 'Código de prueba (Ley 599 de 2000)' when 2 then 'Código de prueba' when 3 then 'Sentencia C-' || c_custkey || ' de 2002 de la Corte'
 when 4 then 'Ley ' || c_custkey || ' de 1992' when 5 then 'Estatuto de algo (Decreto Ley ' || c_custkey || ' de 1992)' else 'Concepto ' || c_custkey end as name from customer""")
def canonical_names(spark, d):
    k, n = F.col("c_custkey") % 7, s("c_custkey")
    pick = lambda *v: F.element_at(F.array(*v), (k + 1).cast("int"))
    null = F.lit(None).cast("string")
    kind = pick(*map(F.lit, ("constitucion", "codigo", "codigo", "sentencia", "ley", "decreto_ley", "concepto")))
    title = pick(F.lit("x"), F.lit("Código de prueba"), F.lit("Código de prueba"), F.lit("t"), F.concat(F.lit("LEY "), n, F.lit(" de 1992")), F.lit("Estatuto de algo"), F.concat(F.lit("Concepto "), n))
    number = pick(null, F.lit("599"), null, F.concat(F.lit("C-"), n), n, n, null)
    year = pick(null, F.lit("2000"), null, F.lit("2002"), F.lit("1992"), F.lit("1992"), null)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), segment.canonical_name(kind, title, number, year, F.when(k == 3, "Corte"), ALIASES).alias("name"))


def sql_list(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def split_columns(listed: str) -> list[str]:
    """The expressions of a select list whose commas at the top level stand before a name's end."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(listed[begin:i].strip())
            begin = i + 1
    return [*out, listed[begin:].strip()]


def turned(values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))


#: Parts of a header by the key: how it begins, its number, what is tied to the number, and how it ends.
HEADER_PARTS = """(k % 7) % 3 b, case k % 4 when 0 then (k % 900 + 1)::varchar when 1 then (k % 90 + 1) || '.' || (k % 8 + 1) when 2 then (k % 90 + 1) || '-' || (k % 5 + 1) else (k % 9 + 1) || '.' || (k % 7 + 1) || '.' || (k % 3 + 1) end n,
 case k % 5 when 1 then 'o' when 2 then chr((65 + k % 14)::int) when 3 then ' bis' else '' end t, case k % 11 when 0 then '' when 1 then ' de la ley' when 2 then ': texto' else '. Texto' end e"""


@query(f"""with p as (select k, {HEADER_PARTS} from (select c_custkey k from customer))
select k id, case when b = 2 then 'T' else '' end || n || case when k % 5 in (2, 3) then t else '' end article
from p where k % 11 <> 1""")
def article_headers(spark, d):
    """Headers composed of parts by the key; those that go on like a sentence are no headers."""
    parts = HEADER_PARTS.replace("(k % 900 + 1)::varchar", "string(k % 900 + 1)").replace("chr((65 + k % 14)::int)", "char(65 + k % 14)")
    made = table(spark, d, "customer").selectExpr("c_custkey k").filter("k % 11 <> 1").selectExpr("k", *split_columns(parts))
    line = F.expr("case b when 0 then 'Artículo ' when 1 then 'ART. ' else 'ARTICULO TRANSITORIO ' end || n || t || e")
    return made.select(F.col("k").alias("id"), segment.article_id(line).alias("article"))


@query("select c_custkey id from customer where c_custkey % 4 > 0 and c_custkey % 3 = 0")
def headers_in_sentences(spark, d):
    """A number with levels before running text ends at its last separator; one without is no header."""
    line = F.expr("'Artículo ' || case when c_custkey % 4 > 0 then (1 + c_custkey % 9) || '.' || (1 + c_custkey % 8) else '' || c_custkey end || case when c_custkey % 3 = 0 then ' de la ley' else ' x. y' end")
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), segment.article_id(line).alias("article"))
    return found.filter("article is not null and id % 3 = 0").select("id")


#: Section titles by the key: a known phrase, the label before it, its letters and its end.
TITLE_CASES = [("antecedentes procesales", "ANTECEDENTES"), ("consideraciones de la sala", "CONSIDERACIONES"), ("análisis del caso", "CASO CONCRETO"), ("la norma acusada", "NORMA DEMANDADA"), ("concepto del procurador", "CONCEPTO DEL MINISTERIO PÚBLICO"),
    ("salvamento parcial de voto de la magistrada", "SALVAMENTO DE VOTO"), ("resuelve", "RESUELVE"), ("intervenciones en el mar", None), ("competencia", "COMPETENCIA")]
TITLE_LABELS = ["", "II. ", "3) ", "4.2. "]


@query(f"""with k as (select c_custkey id, c_custkey % {len(TITLE_CASES)} t, (c_custkey // 9) % 4 l, (c_custkey // 36) % 2 u from customer)
select id, case when l = 3 or (u = 0 and (l = 0 or t = 5)) then null else ({sql_list([n for _, n in TITLE_CASES])})[t + 1] end title from k""")
def section_titles(spark, d):
    """Titles count in upper case or with a label of one level, those of votes in upper case only."""
    k = table(spark, d, "customer").selectExpr("c_custkey id", f"int(c_custkey % {len(TITLE_CASES)}) t", "int(c_custkey div 9 % 4) l", "int(c_custkey div 36 % 2) u")
    title = F.element_at(F.array(*[F.lit(x) for x, _ in TITLE_CASES]), F.col("t") + 1)
    line = F.concat(F.element_at(F.array(*[F.lit(x) for x in TITLE_LABELS]), F.col("l") + 1), F.when(F.col("u") == 1, F.upper(title)).otherwise(title), F.when(F.col("id") % 2 == 0, ":").otherwise(""))
    return k.select("id", segment.section_title(line).alias("title"))


NUMBER_LINES = ["Página 3", "pág. 12 de 40", "17", "3/9", "17 casos", "Pagina"]


@query(f"select c_custkey id, ([true, true, true, true, false, false])[c_custkey % {len(NUMBER_LINES)} + 1] is_number from customer")
def page_numbers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), turned(NUMBER_LINES).rlike(reports.PAGE_NUMBER).alias("is_number"))


@query("""select c_custkey id, case c_custkey % 3 when 0 then 'Sentencia C-' || c_custkey || ' de 2001' when 1 then 'Acto legislativo ' || c_custkey || ' de 2001' else 'Codigo penal' end as name,
 case c_mktsegment when 'BUILDING' then 'Obra' when 'MACHINERY' then 'Taller' else upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) end area from customer""")
def body_names(spark, d):
    k, n = F.col("c_custkey") % 3, s("c_custkey")
    kind = F.when(k == 0, "jurisprudencia").when(k == 1, "acto_legislativo").otherwise("codigo_penal")
    number, year = F.when(k == 0, F.concat(F.lit("C-"), n)).when(k == 1, n), F.when(k < 2, "2001")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), reports.body_name(kind, number, year).alias("name"), reports.short_area(F.col("c_mktsegment"), {"BUILDING": "obra", "MACHINERY": "taller"}).alias("area"))


# ---------------------------------------------------------------- text functions


@query(r"select doc_id, regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), '^\s+|\s+$', '', 'g') folded from documents")
def unicode_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fold_unicode("text").alias("folded"))


@query(f"select doc_id, lower(translate(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', ' ', 'g'), '{X.ACCENTED}', '{X.PLAIN}')) folded, length(text) n from documents")
def same_length_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", X.same_length_fold(F.col("text")).alias("folded"), F.length("text").cast("long").alias("n"))


@query(r"select conv_id, turn, regexp_replace(replace(text, ' ', '-' || chr(10)), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') joined from conversations")
def joined_hyphens(spark, d):
    text = F.replace(F.col("text"), F.lit(" "), F.lit("-\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.joined_hyphens(text).alias("joined"))


FOLDED = "trim(regexp_replace(lower(translate(text, '{a}', '{p}')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))".replace("{a}", X.ACCENTED).replace("{p}", X.PLAIN)
LEGAL = rf"""list_filter(regexp_extract_all(regexp_replace(regexp_replace({FOLDED}, '\b(c|t|su|sl|sc|sp|stc|stl|ac|au) *-? *0*(\d{{1,5}})\b', '\1-\2', 'g'), '\b(\d+) *(?:o\b|º|°)', '\1', 'g'), '[a-z]{{1,4}}-\d{{1,5}}|\d+(?:[.\-]\d+)*[a-z]?|[a-z]+'),
 lambda w: not list_contains({sql_list(X.STOPWORDS)}, w))"""


def ended(word: str, suffixes: str, least: str = "0") -> str:
    """The longest of the suffixes that ends a word and begins at `least` or later."""
    return f"regexp_extract(substr({word}, {least} + 1), '({'|'.join(suffixes.split())})$')"


def region(word: str) -> str:
    """The length of what comes before the region after the first consonant that follows a vowel."""
    return f"coalesce(nullif(length(regexp_extract({word}, '^[^aeiou]*[aeiou]+[^aeiou]')), 0), length({word}))"


AGENT = "adora ador acion adoras adores aciones ante antes ancia ancias"
DERIVATIONS = f"anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos {AGENT} ucion uciones encia encias amente mente idad idades iva ivo ivas ivos"
#: Endings with an accent are no endings without it.
VERB_ENDINGS = """aremos eremos iremos aba ada ida ara iera ad ed id ase iese aste iste an aban aran ieran asen iesen aron ieron ado ido ando iendo ar er ir as abas adas idas aras ieras ases ieses
 abais arais ierais aseis ieseis asteis isteis ados idos amos imos en es emos"""
#: Stems of the words of a table words(word), by the published rules for words without accents.
STEMS = f"""a as (select distinct word w from words),
m as (select w, {region("w")} r1, case when length(w) <= 2 then length(w)
  when regexp_matches(w, '^.[^aeiou]') then coalesce(nullif(length(regexp_extract(w, '^.[^aeiou]+[aeiou]')), 0), length(w))
  when regexp_matches(w, '^[aeiou]') then coalesce(nullif(length(regexp_extract(w, '^[aeiou]+[^aeiou]')), 0), length(w)) else 3 end rv from a where regexp_matches(w, '^[a-z]+$')),
m2 as (select *, r1 + {region("substr(w, r1 + 1)")} r2, {ended("w", "me se sela selo selas selos la le lo las les los nos")} p from m),
m3 as (select *, {ended("left(w, length(w) - length(p))", "ando iendo ar er ir yendo")} v from m2),
s0 as (select w, r1, r2, rv, case when p <> '' and v <> '' and length(w) - length(p) - length(v) >= rv and (v <> 'yendo' or substr(w, length(w) - length(p) - 5, 1) = 'u') then left(w, length(w) - length(p)) else w end x from m3),
d as (select *, {ended("x", DERIVATIONS)} f from s0),
d2 as (select *, case when f <> '' and length(x) - length(f) >= case when f = 'amente' then r1 else r2 end then left(x, length(x) - length(f)) || case when f in ('ucion', 'uciones') then 'u' when f in ('encia', 'encias') then 'ente' else '' end end y from d),
d3 as (select *, case when f in ({", ".join(f"'{x}'" for x in AGENT.split())}) then {ended("y", "ic")} when f = 'mente' then {ended("y", "ante able ible")} when f in ('idad', 'idades') then {ended("y", "abil ic iv")}
  when f in ('iva', 'ivo', 'ivas', 'ivos') then {ended("y", "at")} when f = 'amente' then {ended("y", "ativ iv os ic ad")} else '' end e from d2),
d4 as (select *, case when y is null then null when length(y) - length(e) >= r2 then left(y, length(y) - length(e)) when e = 'ativ' and length(y) - 2 >= r2 then left(y, length(y) - 2) else y end z from d3),
v as (select *, {ended("x", "ya ye yan yen yeron yendo yo yas yes yais yamos", "rv")} g, {ended("x", VERB_ENDINGS, "rv")} h from d4),
v2 as (select *, case when z is not null then z when g <> '' and substr(x, length(x) - length(g), 1) = 'u' then left(x, length(x) - length(g))
  when h in ('en', 'es', 'emos') and left(x, length(x) - length(h)) like '%gu' then left(x, length(x) - length(h) - 1) when h <> '' then left(x, length(x) - length(h)) else x end t from v),
v3 as (select *, {ended("t", "os a o e")} i from v2),
stems as (select w word, case when i = '' or length(t) - length(i) < rv then t when i = 'e' and left(t, length(t) - 1) like '%gu' and length(t) - 2 >= rv then left(t, length(t) - 2) else left(t, length(t) - length(i)) end term from v3
  union all select w, w from a where not regexp_matches(w, '^[a-z]+$'))"""


@query(f"with w as (select doc_id, unnest({LEGAL}) word from documents), words as (select word from w), {STEMS} select term, count(*) n, count(distinct doc_id) df from w join stems using (word) group by 1")
def legal_terms(spark, d):
    terms = docs(spark, d).select("id", F.explode(X.legal_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("df"))


SPANISH = """abandonadas abandono abogado aceptaremos aclaratorias actuaciones adquiriendo agravantes agua alegatos amablemente amplísimo anticonstitucionalmente aplicables aseguran asistencia averigüe biología
cantándole circunstancialmente comprándoselo constitución constituyendo contribuyeron creería cuyos dándoselas definitivamente derogatorias ejecutoriadas existencias fraudulentamente guerras habitabilidad huyendo
iniciativas jurisprudenciales jurídicas legítimamente logías matándolos obligatoriedad pague paguen persigue posibilidad probatoriamente reivindicativamente responsabilidades revoluciones sentencia siguen
simultáneamente solidaridad sostenible subsidiariamente trabajadoras urgentemente viviendas""".split()


@query(f"with k as (select c_custkey id, {sql_list(SPANISH)}[(c_custkey % {len(SPANISH)})::int + 1] raw from customer), w as (select id, translate(raw, 'áéíóúü', 'aeiouu') || case when id % 3 = 0 then 's' else '' end word from k), words as (select word from w), {STEMS} select id, word, term stem from w join stems using (word)")
def spanish_stems(spark, d):
    raw = F.element_at(F.array(*[F.lit(w) for w in SPANISH]), (F.col("c_custkey") % len(SPANISH) + 1).cast("int"))
    word = F.concat(F.translate(raw, "áéíóúü", "aeiouu"), F.when(F.col("c_custkey") % 3 == 0, "s").otherwise(""))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), word.alias("word"))
    return rows.select("id", "word", stemmed(F.array("word"))[0].alias("stem"))


BM25_TERMS = f"with words as (select unnest({LEGAL}) word from documents union all select unnest({LEGAL}) from benchmark), {STEMS.replace('d as', 'd0 as', 1).replace(' from d)', ' from d0)', 1)}, " + (
    BM25.strip().removeprefix("with ").replace(WORDS, LEGAL)
    .replace("select id, term, dl, count(*) tf from (select id, len(w) dl, unnest(w) term from d)", "select id, term, dl, count(*) tf from (select id, len(w) dl, unnest(w) word from d) join stems using (word)")
    .replace(f"select item_id query_id, unnest({LEGAL}) term from benchmark", f"select query_id, term from (select item_id query_id, unnest({LEGAL}) word from benchmark) join stems using (word)")
)


@query(BM25_TERMS + " select query_id, rank, id, score from bm25 where rank <= 10")
def bm25_legal(spark, d):
    return lexical.bm25(docs(spark, d), items(spark, d), analyser=X.legal_tokens)


@query(BM25 + " select query_id, rank, id, score from bm25 where rank <= 10")
def bm25_saved(spark, d):
    path = work_path(spark, "bm25")
    lexical.save_index(docs(spark, d), path)
    return lexical.saved_bm25(spark, path, items(spark, d))


@query(BM25 + " select count(*) terms, sum(df)::bigint postings from df")
def index_counts(spark, d):
    path = work_path(spark, "bm25")
    lexical.save_index(docs(spark, d), path)
    df = lexical.index_frequency(spark, path)
    return df.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))


@query(r"""select c_custkey id, trim(regexp_replace(lower(translate('Área ' || c_mktsegment || ' N.º ' || c_custkey, 'Á', 'A')), '[^a-z0-9]+', '_', 'g'), '_') slug, sha256(c_name) hash from customer""")
def slugs(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.slug(F.concat(F.lit("Área "), F.col("c_mktsegment"), F.lit(" N.º "), s("c_custkey"))).alias("slug"), F.sha2("c_name", 256).alias("hash"))


# ---------------------------------------------------------------- files


NATION_TEXT = "case when n_nationkey % 5 = 0 then '' else n_name || ' — ' || n_nationkey || chr(10) || 'línea dos' end"


def nation_files(spark, d) -> str:
    """A folder of text files, one for each nation."""
    path = work_path(spark, "files")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.expr(NATION_TEXT.replace("chr(10)", "char(10)")).alias("value"))
    rows.repartition(4, "k").write.partitionBy("k").text(path)
    return path


def key_of(path):
    return F.regexp_extract(path, r"k=(\d+)/", 1).cast("int")


@query(f"select n_nationkey k, case when t = '' then '' else t || chr(10) end as text, case when t = '' then 'no text' end as error from (select n_nationkey, {NATION_TEXT} t from nation)")
def file_scan(spark, d):
    return sources.read_files(spark, nation_files(spark, d)).select(key_of(F.col("path")).alias("k"), "text", "error")


@query(f"select n_regionkey::varchar doc_id, string_agg({NATION_TEXT}, chr(10) || chr(10) order by 'k=' || n_nationkey) as text, count(*) files from nation where n_nationkey % 5 <> 0 group by 1")
def joined_files(spark, d):
    files = sources.read_files(spark, nation_files(spark, d)).withColumn("k", key_of(F.col("path")))
    about = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    return sources.joined_files(files.join(F.broadcast(about), "k"), s("n_regionkey"))


@query(f"select n_nationkey k, sha256({NATION_TEXT} || chr(10)) sha256 from nation")
def file_fingerprints(spark, d):
    found = sources.file_hashes(spark, nation_files(spark, d))
    return found.select(key_of(F.col("file")).alias("k"), "sha256")


@query("select 'k' || n_nationkey as file, case n_nationkey % 3 when 0 then 'missing' when 1 then 'changed' else 'extra' end problem from nation where n_nationkey % 3 < 2 or n_nationkey % 6 = 2")
def frozen_index(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.concat(F.lit("k"), k.cast("string")).alias("file"), F.sha2("n_name", 256).alias("sha256"), k.alias("k"))
    now = rows.filter("k % 3 <> 0").withColumn("sha256", F.when(F.col("k") % 3 == 1, "other").otherwise(F.col("sha256")))
    return sources.changed_files(rows.filter("k % 3 < 2 or k % 6 = 5").select("file", "sha256"), now.select("file", "sha256"))


@query("select 'f' || c_custkey as file from customer where c_custkey not in (select n_nationkey * 3 from nation)")
def missing_files(spark, d):
    listed = table(spark, d, "nation").select(F.concat(F.lit("f"), (F.col("n_nationkey") * 3).cast("string")).alias("file"))
    return runs.pending(table(spark, d, "customer").select(F.concat(F.lit("f"), s("c_custkey")).alias("file")), listed, "file")


@query("select c_custkey::varchar doc_id, case when c_custkey % 2 = 0 then 'a;b, ' || c_name else c_name end titulo, c_mktsegment tipo from customer")
def inventory_scan(spark, d):
    path = work_path(spark, "inventory")
    title = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("a;b, "), F.col("c_name"))).otherwise(F.col("c_name"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("DOC_ID"), F.concat(F.lit(" "), title, F.lit(" ")).alias("Titulo"), F.col("c_mktsegment").alias("tipo"))
    rows.write.option("header", "true").option("sep", ";").option("quoteAll", "true").csv(path)
    return sources.read_inventory(spark, path)


@query("select event_id, event_type, value from events")
def jsonl_round_trip(spark, d):
    path = work_path(spark, "lines")
    sources.write_jsonl(table(spark, d, "events").select("event_id", "event_type", "value"), path)
    spark.createDataFrame([("",), (" ",)], "value string").write.mode("append").text(path)
    return sources.read_jsonl(spark, path, "event_id long, event_type string, value double")


@query("select o_orderkey id, case when o_orderkey % 2 = 0 then 'multiple_choice' else 'semi_open' end format, case when o_orderkey % 2 = 0 and o_orderkey % 6 <> 0 then 'sí ' || o_orderkey end expected from orders where o_orderstatus = 'F'")
def question_bank(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("state"))
    option = lambda text, right: F.struct(text.alias("text"), right.alias("is_correct"))
    closed = o.filter("id % 2 = 0").withColumn("options", F.array(option(F.concat(F.lit("sí "), s("id")), F.lit(True)), option(F.lit("no"), F.col("id") % 6 == 0)))
    free = o.filter("id % 2 = 1").withColumn("format", F.lit("semi_open"))
    return sources.question_bank(closed, free).select("id", "format", "expected")


@query("select distinct c_mktsegment as value from customer")
def listed_values(spark, d):
    path = work_path(spark, "list")
    table(spark, d, "customer").select(F.explode(F.array(F.concat(F.lit("  "), F.col("c_mktsegment")), F.lit("# nota"), F.lit(""))).alias("value")).write.text(path)
    return sources.listed(spark, path)


@query("select conv_id doc_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by 1")
def corpus_texts(spark, d):
    path = work_path(spark, "texts")
    sources.write_texts(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text"), path)
    return committed.load(spark, path, "doc_id long, text string")


@query("select c_custkey id, c_name || ' café' as text from customer")
def byte_decode(spark, d):
    text = F.concat(F.col("c_name"), F.lit(" café"))
    k = F.col("c_custkey") % 3
    content = F.when(k == 0, F.encode(text, "ISO-8859-1")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), sources.decoded(content).alias("text"))


@query("select c_custkey id, 'Hola ' || c_name || chr(10) || 'a ' || c_mktsegment || chr(10) || '[2] nota' as text from customer")
def docx_paragraphs(spark, d):
    return customers(spark, d).select(F.col("c_custkey").alias("id"), sources.docx_texts(sources.made_docx("c_name", "c_mktsegment")).alias("text"))


@query("select page_id, text from (select c_custkey page_id, c_name || ' & co.' || chr(10) || chr(10) || 'x ' || c_mktsegment || chr(10) as text from customer)")
def parsed_pages(spark, d):
    html = F.concat(F.lit("<html><head><title>t</title></head><body><nav>menu</nav><p>"), F.col("c_name"), F.lit(" &amp; co.</p><table><tr><td>x</td><td>"), F.col("c_mktsegment"), F.lit("</td></tr></table><footer>pie</footer></body></html>"))
    return customers(spark, d).select(F.col("c_custkey").alias("page_id"), X.normalise(sources.page_texts(html)).alias("text"))


# ---------------------------------------------------------------- caches, runs and indexes


@query("select event_id id, sha256('{\"model\":\"' || event_type || '\",\"temperature\":0,\"user\":' || user_id || '}') key from events")
def request_keys(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), F.lit(0).alias("temperature"), F.col("user_id").alias("user"))
    return e.select("id", sources.request_key("user", "model", "temperature").alias("key"))


@query("""select event_id id, case when event_id % 4 = 0 then '{"cached": true}' when event_id % 4 = 1 then '{"a": ' || event_id || '}' when event_id % 4 = 2 then '{"b": 1}' end answer, case event_id % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 1 end tries from events""")
def generated_answers(spark, d):
    """From the cache, at once, after a correction, and cut off before a pair was whole."""
    def generate(prompt: str) -> tuple[str, bool]:
        n, kind = int(prompt.split()[0]), int(prompt.split()[0]) % 4
        if kind == 2:
            return ('{"b": 1}' if models.CORRECTION in prompt else "no es JSON"), False
        return (f'```json\n{{"a": {n}}}', False) if kind == 1 else ('{"c": "cor', True)

    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.sha2(s("event_id"), 256).alias("key"), F.concat(s("event_id"), F.lit(" pregunta")).alias("prompt"))
    cache = e.filter("id % 4 = 0").select("key", F.lit('{"cached": true}').alias("answer"))
    return models.generated(e, generate, cache).select("id", "answer", "tries")


@query("select doc_id, case when doc_id % 3 = 0 then n_chars end size from documents")
def cached_values(spark, d):
    x = table(spark, d, "documents")
    cache = x.filter("doc_id % 3 = 0").groupBy(F.sha2("text", 256).alias("key")).agg(F.max("n_chars").alias("size"))
    found = sources.from_cache(x.select("doc_id", "text"), cache)
    return found.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("size")).alias("size"))


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'old' else 'new' end answer from orders")
def resumed_answers(spark, d):
    path = work_path(spark, "answers")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    o.filter("id % 3 = 0").withColumn("answer", F.lit("old")).write.json(path)
    runs.pending(o, spark.read.schema("id long").json(path)).withColumn("answer", F.lit("new")).write.mode("append").json(path)
    return spark.read.schema("id long, answer string").json(path)


@query("with r as (select o_orderkey % 100 id from orders union all select o_orderkey % 7 from orders) select id, count(*) \"count\" from r group by 1 having count(*) > 1")
def merged_runs(spark, d):
    o = table(spark, d, "orders")
    return runs.merged(o.select((F.col("o_orderkey") % 100).alias("id")), o.select((F.col("o_orderkey") % 7).alias("id"), F.lit(1).alias("x")))[1]


@query("select o_orderkey id from orders where o_orderkey in (1, 5, 8, 999999999)")
def only_ids(spark, d):
    return runs.only(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), [1, 5, 8, 999999999])


@query("select o_orderkey id from orders order by o_orderkey limit 25")
def first_items(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).orderBy("id").limit(25)


@query(DENSE.format(which="vec_id % 50 = 0", k=5))
def dense_saved(spark, d):
    path = work_path(spark, "vectors")
    sources.save_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), path)
    held = spark.read.parquet(path)
    return dense.dense_topk(held.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), held, 5)


@query("""with o as (select vec_id - vec_id % 4 id, substr('ABCD', (vec_id % 4)::int + 1, 1) "option", embedding v from embeddings), a as (select vec_id id, embedding a from embeddings where vec_id % 4 = 0),
s as (select id, "option", round(list_inner_product(a::double[], v::double[]) / (sqrt(list_inner_product(a::double[], a::double[])) * sqrt(list_inner_product(v::double[], v::double[]))), 6) cosine from o join a using (id) where "option" <> 'A')
select id, min_by("option", "option") "option", cosine from (select *, max(cosine) over (partition by id) m from s) where cosine = m group by id, cosine""")
def closest_option(spark, d):
    e = table(spark, d, "embeddings")
    letter = F.substring(F.lit("ABCD"), (F.col("vec_id") % 4 + 1).cast("int"), F.lit(1))
    options = e.select((F.col("vec_id") - F.col("vec_id") % 4).alias("id"), letter.alias("option"), F.col("embedding").alias("vec")).filter("option <> 'A'")
    return dense.closest_option(e.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), options)


@query("""with o as (select event_id // 4 id, substr('ABCD', (event_id % 4)::int + 1, 1) "option", case when event_id // 4 % 5 <> 0 then round(value, 0) end score from events)
select id, min("option") "option" from (select *, max(score) over (partition by id) m from o) where m is null or score = m group by 1""")
def fallback_option(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("id"), F.substring(F.lit("ABCD"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1)).alias("option"), "value")
    return models.fallback_option(e.withColumn("score", F.when(F.col("id") % 5 != 0, F.round("value", 0))))


# ---------------------------------------------------------------- models


@query("select item_id id, 64 n, 1.0::double norm from benchmark")
def embedded_texts(spark, d):
    rows = models.embedded(items(spark, d), models.HashedWords)
    return rows.select("id", F.size("vec").cast("long").alias("n"), F.round(dense.norm(F.col("vec")), 4).alias("norm"))


@query(r"""with t as (select doc_id, 'ley ' || source || ' agua' q, list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(text)), '\s+'), lambda w: w <> '')) w from documents)
select doc_id, round(len(list_filter(['ley', source, 'agua'], lambda x: list_contains(w, x))) / 3.0::double, 5) rerank from t join documents using (doc_id)""")
def reranked_texts(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.concat(F.lit("ley "), "source", F.lit(" agua")).alias("question"), "text")
    return models.reranked(x).select("doc_id", "rerank")


@query("select conv_id id, first(text order by turn) respuesta, false abstencion from conversations group by 1 union all select -1, '', true")
def extractive_answers(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    x = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(texts.alias("evidence"))
    return models.extractive_answers(x.union(spark.createDataFrame([(-1, [])], "id long, evidence array<string>")))


@query("select c_custkey id, case when c_custkey % 2 = 0 then 'query: ' || c_name else c_name end q, 'passage: ' || c_name p, c_mktsegment || ' ' || c_name || ' uno' o, c_name || ' ' || c_mktsegment both_ from customer")
def encoder_inputs(spark, d):
    name = F.col("c_name")
    q = F.when(F.col("c_custkey") % 2 == 0, models.prefixed(name, True, "multilingual-e5")).otherwise(models.prefixed(name, True, "bge"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), q.alias("q"), models.prefixed(name, False, "E5-base").alias("p"), models.option_query(name, F.concat(F.lit(" "), F.col("c_mktsegment")), F.array(name, F.lit("uno"))).alias("o"), models.option_query(name, F.col("c_mktsegment")).alias("both_")
    )


@query("select c_custkey id, 'Tema: ' || case when c_custkey % 2 = 0 then 'no indicada' else c_mktsegment end || chr(10) || chr(10) || 'Textos:' || chr(10) || '[P1] ' || c_name || chr(10) || chr(10) || '¿Qué?' || chr(10) || chr(10) || 'Responde en pocas oraciones con palabras clave.' prompt from customer")
def filled_prompts(spark, d):
    places = {"area": F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")), "evidence": F.concat(F.lit("[P1] "), F.col("c_name")), "question": F.lit("¿Qué?"), "options": F.lit(""), "draft": F.lit(None).cast("string")}
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), prompts.prompt(F.lit("semi_open"), places).alias("prompt"))


# ---------------------------------------------------------------- rules


@query("""select c_custkey id, unnest(case when c_custkey % 3 = 0 then ['url', 'nota' || c_custkey % 5] when c_custkey % 3 = 1 then ['titulo'] else [] end) as "column", unnest(case when c_custkey % 3 = 0 then ['required', 'unknown'] when c_custkey % 3 = 1 then ['required'] else [] end) problem from customer""")
def column_checks(spark, d):
    """Header lines with other separators, letters and order."""
    line = F.expr("case c_custkey % 3 when 0 then '\ufeffDOC_ID; Titulo ;nota' || c_custkey % 5 when 1 then 'url,doc_id' else '\"url\",\"TITULO\",\"doc_id\"' end")
    return validation.header_problems(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), line.alias("header")), ["doc_id", "titulo", "url"], ["doc_id", "titulo", "url"])


@query("select o_orderkey id, o_custkey k, f first_row from (select *, min(o_orderkey) over (partition by o_custkey) f from orders) where o_orderkey > f")
def repeated_keys(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    return validation.repeated(o, "k", "id")


@query("select c_custkey id, list_distinct(list_filter([case c_mktsegment when 'BUILDING' then 'civil' when 'MACHINERY' then 'penal' end, 'civil'], lambda x: x is not null))::varchar[] areas from customer where c_mktsegment <> 'MACHINERY' union all select c_custkey, ['penal', 'civil'] from customer where c_mktsegment = 'MACHINERY'")
def aliased_areas(spark, d):
    listed = F.concat(F.lower("c_mktsegment"), F.lit("|  Derecho   Civil |otra"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), validation.aliased(listed, {"building": "civil", "machinery": "penal", "derecho civil": "civil"}).alias("areas"))


INVENTORY_CASES = [("", []), ("MAL ID", ["doc_id_form"]), ("tipo", ["tipo_unknown"]), ("numero", ["numero_required", "anio_required"]), ("anio", ["anio_form"]), ("url", ["url_form"]), ("fecha", ["fecha_form"]), ("fecha2", ["fecha_form"]), ("areas", ["areas_unknown"]), ("vigencia", ["vigencia_unknown"]), ("titulo", ["titulo_required"])]


@query(f"select c_custkey id, ([{', '.join(sql_list(e) + '::varchar[]' for _, e in INVENTORY_CASES)}])[c_custkey % {len(INVENTORY_CASES)} + 1] errors from customer")
def inventory_errors(spark, d):
    case = turned([c for c, _ in INVENTORY_CASES])
    fields = {
        "doc_id": F.when(case == "MAL ID", case).otherwise(F.concat(F.lit("ley-"), s("c_custkey"))), "archivo": F.lit("a.txt"), "titulo": F.when(case == "titulo", " ").otherwise("t"), "tipo": F.when(case == "tipo", "cosa").otherwise("ley"),
        "numero": F.when(case == "numero", "").otherwise("1"), "anio": F.when(case == "numero", "").when(case == "anio", "12").otherwise("2001"), "organo_emisor": F.lit("o"), "fuente": F.lit("f"), "url": F.when(case == "url", "ftp://x").otherwise("https://x"),
        "fecha_consulta": F.when(case == "fecha", "2024-13-01").when(case == "fecha2", "1/2/2024").otherwise("2024-01-31"), "areas": F.when(case == "areas", "civil|mar").otherwise("civil | penal"), "vigencia": F.when(case == "vigencia", "quizas").otherwise("vigente"),
    }
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[c.alias(n) for n, c in fields.items()])
    return validation.with_errors(rows, validation.inventory_rules(["civil", "penal"])).select("id", "errors")


@query("""with l as (select o_orderkey % 500 id, o_orderkey k, o_custkey, row_number() over (partition by o_orderkey % 500 order by o_orderkey) turn from orders)
select k, list_filter([case when turn > 1 then 'id_repeated' end, case when id >= 400 then 'id_unknown' end, case when o_custkey % 5 = 0 then 'format_unknown' end, case when o_custkey % 5 = 1 and o_custkey % 2 = 0 and k % 3 <> 0 then 'justificacion_missing' end,
 case when o_custkey % 5 = 2 and o_custkey % 2 = 0 and k % 3 <> 0 then 'palabras_clave_missing' end, case when k % 3 <> 0 and k % 12 = 0 then 'passages_missing' end, case when k % 12 > 10 then 'passages_over' end], lambda x: x is not null) errors from l""")
def submission_errors(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("id"), F.col("o_orderkey").alias("k"), "o_custkey")
    kind, even = F.col("o_custkey") % 5, F.col("o_custkey") % 2 == 0
    rows = (
        o.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("k"))).withColumn("known", F.col("id") < 400)
        .withColumn("formato", F.when(kind == 0, "otro").when(kind == 1, "multiple_choice").when(kind == 2, "semi_open").otherwise("open_ended")).withColumn("abstencion", F.col("k") % 3 == 0).withColumn("n_passages", F.col("k") % 12)
        .withColumn("justificacion", F.when(even, "").otherwise("x")).withColumn("palabras_clave", F.when(even, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))))
    )
    for name in ("respuesta_correcta", "descarte_opciones", "respuesta", "referencia_legal", "marco_normativo", "analisis", "jurisprudencia", "conclusion"):
        rows = rows.withColumn(name, F.lit("x"))
    return validation.with_errors(rows, validation.submission_rules(o)).select("k", "errors")


@query("select c_custkey id, c_custkey % 4 = 0 ok from customer")
def iso_dates(spark, d):
    dates = F.element_at(F.array(*map(F.lit, ("2024-02-29", "2023-02-29", "2024-1-5", "hoy"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), dates.alias("fecha_consulta"))
    rule = validation.inventory_rules([])["fecha_form"]
    return rows.select("id", (~rule).alias("ok"))


@query("select user_id id, event_type model, event_id, case when event_type not in ('click', 'view') then 'model' when event_id % 3 = 0 then 'temperature' end refused from events")
def allowed_runs(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("model"), "event_id", F.when(F.col("event_id") % 3 == 0, 0.2).otherwise(0.0).alias("temperature"))
    return validation.allowed_runs(e, ("click", "view")).drop("temperature")


@query("""select c_custkey run, unnest(['top_k', 'quota', 'api_key', 'rrf_k', 'temperature']) as name, unnest([case when c_custkey % 3 = 0 then '10' else (c_custkey % 20)::varchar end, '4', case when c_custkey % 2 = 0 then '***' else '' end, '60', '0.0']) as "value" from customer""")
def settings(spark, d):
    """Of each run: a number or a blank for top_k, and a key or none."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run"))
    given = c.select("run", F.lit("top_k").alias("name"), F.when(F.col("run") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), (F.col("run") % 20).cast("string"))).alias("value"))
    given = given.union(c.filter("run % 2 = 0").select("run", F.lit("api_key"), s("run")))
    return resolved(given).filter(F.col("name").isin("top_k", "quota", "api_key", "rrf_k", "temperature"))


@query("""select event_id id, case event_id % 3 when 0 then ['respuesta_correcta'] when 1 then ['palabras_clave', 'referencia_legal'] else ['marco_normativo'] end lacking from events where event_id % 4 > 0
union all select event_id, [] from events where event_id % 4 = 0""")
def output_schemas(spark, d):
    """Fields that answers of three kinds lack."""
    fields = {0: ["analisis_opciones", "justificacion", "pasajes_usados"], 1: ["pasajes_usados", "respuesta"], 2: ["analisis", "jurisprudencia", "conclusion", "pasajes_usados"]}
    k, e = F.col("event_id") % 3, table(spark, d, "events")
    kind = F.when(k == 0, "multiple_choice").when(k == 1, "semi_open").otherwise("open_ended")
    part = F.when(k == 0, F.array(*map(F.lit, fields[0]))).when(k == 1, F.array(*map(F.lit, fields[1]))).otherwise(F.array(*map(F.lit, fields[2])))
    required = validation.required_fields(kind)
    return e.select(F.col("event_id").alias("id"), F.array_except(required, F.when(F.col("event_id") % 4 == 0, required).otherwise(part)).alias("lacking"))


@query("""with k as (select c_custkey r, 'd' || c_custkey % 200 doc, case c_custkey % 4 when 0 then 'C-' || c_custkey when 1 then 'X-1' else c_custkey::varchar end n, case when c_custkey % 4 < 2 then 'sentencia' else 'ley' end t from customer), f as (select *, min(r) over (partition by doc) f from k)
select r as row, doc doc_id, list_filter([case when f < r then 'doc_id_repeated' end, case when r % 4 = 1 then 'numero_form' end, case when r % 5 = 0 then 'archivo_missing' end], lambda x: x is not null) errors, case when f < r then f end first_row from f""")
def inventory_checked(spark, d):
    """Files and folders that a listing has or lacks, numbers of rulings, ids that come again."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    rows = c.select(
        k.alias("row"), F.concat(F.lit("d"), (k % 200).cast("string")).alias("doc_id"), F.concat(F.when(k % 5 == 0, "nada/").otherwise("f/"), k.cast("string"), F.when(k % 2 == 0, "/a.txt").otherwise("")).alias("archivo"),
        F.when(k % 4 < 2, "sentencia").otherwise("ley").alias("tipo"), F.when(k % 4 == 0, F.concat(F.lit("c-"), k.cast("string"))).when(k % 4 == 1, "X-1").otherwise(k.cast("string")).alias("numero"),
        *[F.lit(v).alias(n) for n, v in {"titulo": "t", "anio": "2001", "organo_emisor": "o", "fuente": "f", "url": "https://x", "fecha_consulta": "2024-01-31", "areas": "civil", "vigencia": ""}.items()],
    )
    files = c.select(F.concat(F.lit("f/"), k.cast("string"), F.lit("/a.txt")).alias("path"))
    return validation.inventory(rows, files, ["civil"]).select("row", "doc_id", "errors", "first_row")


@query("""with l as (select doc_id % 40 doc_id, doc_id // 40 page, 'cuerpo ' || doc_id || ' partido ' || doc_id as text from documents), n as (select doc_id, count(*) n from l group by 1)
select doc_id, page, case when n >= 3 then '' else 'CABECERA ' || doc_id || chr(10) end || text as text from l join n using (doc_id)""")
def clean_pages(spark, d):
    """Pages with a repeated head, a page number and a word that a line end breaks."""
    x = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("doc"), F.floor(F.col("doc_id") / 40).alias("page"), s("doc_id").alias("i"))
    text = F.concat(F.lit("CABECERA "), F.col("doc").cast("string"), F.lit("\nPágina "), (F.col("page") % 900 + 1).cast("string"), F.lit("\ncuerpo "), F.col("i"), F.lit(" par-\ntido "), F.col("i"))
    return reports.cleaned_pages(x.select(F.col("doc").alias("doc_id"), "page", text.alias("text")))


# ---------------------------------------------------------------- ranking


@query("""select count(*) n, sum(case when toxic = 0 and lang = case when quality = 1 then 'en' else 'de' end then 1 else 0 end)::bigint hits from labels join documents using (doc_id) where doc_id not in (3, 6, 9, 12)""")
def closed_without_flawed(spark, d):
    l = table(spark, d, "labels")  # noqa: E741
    key = l.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "en").otherwise("de").alias("expected"))
    answers = table(spark, d, "documents").join(l, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("given"), (F.col("toxic") == 1).alias("abstained"))
    return evaluation.closed_accuracy(key, answers, (3, 6, 9, 12)).select("n", "hits")


@query("select c_custkey id, (['constitucion', 'sentencia', 'ley', 'concepto', 'circular', null])[c_custkey % 6 + 1] kind, c_custkey % 6 in (0, 2, 4) is_norm from customer")
def norm_kinds(spark, d):
    kind = turned(["constitucion", "sentencia", "ley", "concepto", "circular", None])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"), fusion.is_norm(kind).alias("is_norm"))


@query(CAPPED + ", c3 as (select *, doc in ('src1', 'src2') and not mentioned counted from c2), c4 as (select *, sum(counted::int) over (partition by query_id order by pos) t from c3) select query_id, id, pos from c4 where not counted or t <= 2")
def complementary_cap(spark, d):
    listed = spark.createDataFrame([("src1",), ("src2",)], "value string")
    marked = fusion.with_complementary(candidates(spark, d).drop("complementary"), listed)
    return fusion.diversity_caps(marked, complementary=2).select("query_id", "id", "pos")


@query("select event_id id, round(value / 1000.0::double, 8) + case when user_id % 2 = 0 then 0.002::double else 0 end + case when user_id % 3 = 0 then 0.01::double else 0 end rrf from events")
def boosted_scores(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(F.col("value") / 1000.0, 8).alias("rrf"), "user_id")
    return fusion.boosted(e, F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0).select("id", "rrf")


@query("""select conv_id doc_id, '| ' || conv_id || ' | ' || replace(first(role || '|' order by turn), '|', '\\|') || ' | — |' line from conversations group by 1""")
def markdown_lines(spark, d):
    x = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.min_by("role", "turn"), F.lit("|")).alias("role"))
    return reports.markdown_rows(x.withColumn("empty", F.lit("")), ["doc_id", "role", "empty"], "doc_id")


@query("""select c_custkey doc_id, '{"doc_id":' || c_custkey || ',"titulo":"' || c_name || '","vigencia":null,"metodo_ingesta":"' || case c_custkey % 3 when 0 then 'parser HTML + texto plano + ' when 1 then 'extraccion de PDF (OCR si no hay capa de texto) + ' else '' end
 || case when c_custkey % 2 = 0 then 'segmentacion por seccion' else 'segmentacion por articulo' end || '"}' entry from customer""")
def manifest_entries(spark, d):
    k = F.col("c_custkey")
    formats = F.when(k % 3 == 0, F.array(F.lit("txt"), F.lit("htm"))).when(k % 3 == 1, F.array(F.lit("pdf"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "customer").select(k.alias("doc_id"), F.col("c_name").alias("titulo"), F.lit(None).cast("string").alias("vigencia"), formats.alias("formats"), F.when(k % 2 == 0, "sentencia").otherwise("ley").alias("type"))
    return reports.manifest(rows, ["doc_id", "titulo", "vigencia"])


@query("select body_key, count(*) n from (select 'ley|' || o_orderkey % 50 || '|' body_key from orders) group by 1")
def body_counts(spark, d):
    key = body_key(F.lit("ley"), (F.col("o_orderkey") % 50).cast("string"), F.lit(None).cast("string"))
    return table(spark, d, "orders").groupBy(key.alias("body_key")).agg(F.count(F.lit(1)).alias("n"))
