"""Summaries and coverage of a corpus, and tables for documents."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the share of ruling sections over which a judgment looks wrong.
RULING_SHARE = 0.25


def document_summary(chunks: DataFrame) -> DataFrame:
    """doc_id, articles (distinct), fragments, characters, sha256 of the text in order, formats and bodies, of
    chunks(doc_id, ord, text, article, format, bodies)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]), "\n\n")
    return chunks.groupBy("doc_id").agg(
        F.nullif(F.countDistinct("article"), F.lit(0)).alias("articles"), F.count(F.lit(1)).alias("fragments"), F.sum(F.length("text")).alias("characters"), F.sha2(text, 256).alias("sha256"),
        F.array_sort(F.collect_set("format")).alias("formats"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bodies")))).alias("bodies"),
    )


def totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("documents"), F.sum("fragments").alias("fragments"), F.sum("characters").alias("characters"), F.sum(F.coalesce("articles", F.lit(0))).alias("articles"))


def area_coverage(areas: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """For each of areas(area): items, covered items and their share, documents and fragments; areas without any stay.

    targets(area, items, covered); documents(area, fragments)."""
    wanted = targets.groupBy("area").agg(F.sum("items").alias("items"), F.sum(F.when(F.col("covered"), F.col("items")).otherwise(0)).alias("covered"))
    held = documents.groupBy("area").agg(F.count(F.lit(1)).alias("documents"), F.sum("fragments").alias("fragments"))
    out = areas.join(wanted, "area", "left").join(held, "area", "left").fillna(0)
    return out.withColumn("share", F.round(F.when(F.col("items") > 0, 100.0 * F.col("covered") / F.col("items")).otherwise(0.0), 4))


def section_distribution(sections: DataFrame, missing: str = "(none)") -> DataFrame:
    return sections.groupBy("doc_id", F.coalesce("section", F.lit(missing)).alias("section")).agg(F.count(F.lit(1)).alias("n"))


def section_alerts(sections: DataFrame, ruling: str = "RESUELVE", reasons: tuple = ("CONSIDERACIONES", "CASO CONCRETO", "PROBLEMA JURÍDICO")) -> DataFrame:
    """doc_id and its alerts: no ruling, a ruling of over a quarter of the sections, no reasons."""
    counts = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("section") == ruling).alias("rulings"), F.count_if(F.col("section").isin(*reasons)).alias("reasons"))
    alerts = F.array_compact(F.array(F.when(F.col("rulings") == 0, "no_ruling"), F.when(F.col("rulings") > RULING_SHARE * F.col("n"), "ruling_share"), F.when(F.col("reasons") == 0, "no_reasons")))
    return counts.select("doc_id", alerts.alias("alerts")).filter("size(alerts) > 0")


def coverage_gaps(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """body, items, ids and areas of wanted(id, area, body) whose body is not in present(body), most items first."""
    lacking = wanted.join(present.select("body").distinct(), "body", "left_anti")
    out = lacking.groupBy("body").agg(F.countDistinct("id").alias("items"), F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("area")).alias("areas"))
    return out.orderBy(F.desc("items"), "body")


def without_own_body(chunks: DataFrame) -> DataFrame:
    """How many chunks do not name a body of their document: chunks(bodies, document_bodies)."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum((~F.arrays_overlap("bodies", "document_bodies")).cast("int")), F.lit(0)).alias("without"))


def repeated_lines(pages: DataFrame, least_pages: int = 3, share: float = 0.6, longest: int = 80) -> DataFrame:
    """doc_id and line of trimmed lines of at most `longest` characters on at least `share` of a document's pages,
    where it has least_pages; pages(doc_id, page, text)."""
    counted = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least_pages)
    line = F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")
    held = pages.select("doc_id", "page", line).filter((F.length("line") > 0) & (F.length("line") <= longest)).groupBy("doc_id", "line").agg(F.countDistinct("page").alias("k"))
    return held.join(counted, "doc_id").filter(F.col("k") >= F.ceil(share * F.col("pages"))).select("doc_id", "line")


PAGE_NUMBER = r"(?iU)^(p[aá]g(ina)?\.?\s*)?\d{1,4}(\s*(/|de)\s*\d{1,4})?$"


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """Pages without repeated lines and page numbers, with words that a line end broke made whole."""
    x = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("n", "raw")).withColumn("line", F.trim("raw"))
    kept = x.filter(~F.col("line").rlike(PAGE_NUMBER)).join(repeated_lines(pages), ["doc_id", "line"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda r: r["raw"]), "\n")
    return kept.groupBy("doc_id", "page").agg(F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2").alias("text"))


def markdown_table(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A Markdown table of a report of at most `most` rows; a longer one is an error, as markdown_rows() is for those."""
    text = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    found = rows.select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows; use markdown_rows()")
    line = lambda values: "| " + " | ".join(values) + " |"
    return "\n".join([line(columns), "|" + "---|" * len(columns), *(line([text(r[c]) for c in columns]) for r in found)])


def with_block(document: str, name: str, body: str) -> str:
    """The document with the text of its block <!-- AUTO:name --> .. <!-- /AUTO:name --> replaced."""
    marks = [f"<!-- AUTO:{name} -->", f"<!-- /AUTO:{name} -->"]
    found = re.compile(f"({re.escape(marks[0])}).*?({re.escape(marks[1])})", re.DOTALL)
    if not found.search(document):
        raise ValueError(f"the document has no block {name}")
    return found.sub(lambda m: f"{m[1]}\n{body}\n{m[2]}", document)


def body_name(kind, number, year):
    """What a body is called in a report."""
    words = F.regexp_replace(kind, "_", " ")
    plain = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, F.length(words)))
    return F.when(kind == "jurisprudencia", F.concat(F.lit("Sentencia "), number, F.lit(" de "), year)).when(number.isNotNull(), F.concat(plain, F.lit(" "), number, F.lit(" de "), year)).otherwise(plain)


def short_area(area, slugs: dict[str, str]):
    """An area's short name with a capital, or its own."""
    short = area
    for name, slug in slugs.items():
        short = F.when(area == name, F.lit(slug)).otherwise(short)
    return F.concat(F.upper(F.substring(short, 1, 1)), F.lower(F.substring(short, 2, F.length(short))))


def cell(value):
    """A value in a Markdown table."""
    text = F.replace(value.cast("string"), F.lit("|"), F.lit("\\|"))
    return F.when(value.isNull() | (text == ""), "—").otherwise(text)


def markdown_rows(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """line of each row of a Markdown table, with its order."""
    return rows.select(order, F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |")).alias("line"))


# How a manifest says that documents were read.
METHODS = ((("html", "htm"), "parser HTML"), (("pdf",), "extraccion de PDF (OCR si no hay capa de texto)"), (("docx",), "extraccion DOCX"), (("txt",), "texto plano"))
BY_SECTION, BY_ARTICLE, SECTIONED = "segmentacion por seccion", "segmentacion por articulo", ("sentencia", "concepto")


def ingestion_method(formats, kind):
    """How documents of these formats (an array) and kind were read and cut."""
    read = [F.when(F.arrays_overlap(formats, F.array(*map(F.lit, names))), F.lit(text)) for names, text in METHODS]
    return F.concat_ws(" + ", *read, F.when(kind.isin(*SECTIONED), BY_SECTION).otherwise(BY_ARTICLE))


def manifest(documents: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id and entry: the JSON object of each of documents(doc_id, formats, type, ..) with columns in the order given
    and metodo_ingesta after them."""
    entry = F.struct(*[F.col(c) for c in columns], ingestion_method(F.col("formats"), F.col("type")).alias("metodo_ingesta"))
    return documents.select("doc_id", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def write_manifest(documents: DataFrame, columns: list[str], path: str, about: dict) -> None:
    """The manifest as JSON lines: what it is about, and then the documents in order."""
    head = documents.sparkSession.createDataFrame([(json.dumps(about, ensure_ascii=False),)], "value string")
    head.write.mode("overwrite").text(f"{path}/about")
    manifest(documents, columns).orderBy("doc_id").select(F.col("entry").alias("value")).write.mode("overwrite").text(f"{path}/documents")
