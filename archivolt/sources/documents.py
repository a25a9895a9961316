"""Sources and sinks: inventories, folders of files, JSON lines, question banks, indexes and caches."""

from __future__ import annotations

import io
import json
import re
import zipfile
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.functions.text import joined_hyphens, normalise

# What is read, what is dropped from pages, and what ends a line there.
EXTENSIONS = (".html", ".htm", ".txt", ".pdf", ".docx")
NOISE = frozenset("script style noscript nav header footer form aside button iframe svg template".split())
BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table section article blockquote pre dd dt dl hr".split())

#: Windows-1252 differs from ISO-8859-1 in the bytes that are controls there.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
SIGNS = bytes(range(0x80, 0xA0)).decode("windows-1252", errors="replace")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of sources: semicolons where the first line has more of them than commas, a byte-order mark or none,
    names in lower case, values trimmed."""
    first = spark.read.text(path).limit(1).first()
    line = (first[0] if first else "").lstrip("﻿")
    rows = spark.read.csv(path, sep=";" if line.count(";") > line.count(",") else ",", header=True, encoding="UTF-8", multiLine=True, escape='"')
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.lstrip("﻿").strip().lower()) for c in rows.columns])


def decoded(contents: Column) -> Column:
    """Bytes as text: without a byte-order mark, UTF-8 where it is valid, else Windows-1252."""
    bare = F.when(F.substring(contents, 1, 3) == F.unhex(F.lit("EFBBBF")), F.substring(contents, 4, 2147483647)).otherwise(contents)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")).otherwise(F.translate(F.decode(bare, "ISO-8859-1"), CONTROLS, SIGNS))


def as_text(content: bytes) -> str:
    bare = content.removeprefix(b"\xef\xbb\xbf")
    try:
        return bare.decode("utf-8")
    except UnicodeDecodeError:
        return bare.decode("windows-1252", errors="replace")


class PageText(HTMLParser):
    """The text of a page's body without noise elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth, self.head = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head += 1
        elif tag in NOISE:
            self.depth += 1
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = 0
        elif tag in NOISE:
            self.depth = max(0, self.depth - 1)
        elif tag in ("td", "th"):
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth and not self.head:
            self.parts.append(data)


def page_text(html: str) -> str:
    page = PageText()
    page.feed(html)
    page.close()
    return "".join(page.parts)


@F.pandas_udf(T.StringType())
def page_texts(html: pd.Series) -> pd.Series:
    """page_text() of each page, by a parser."""
    return html.map(lambda h: page_text(h or ""))


def docx_text(content: bytes) -> str:
    """Paragraphs, table rows with their cells in one line, and numbered notes without separators."""
    def plain(xml: str) -> str:
        return unescape(re.sub(r"<[^>]+>", "", re.sub(r"<w:(?:tab|br)\b[^>]*/>", " ", xml)))

    with zipfile.ZipFile(io.BytesIO(content)) as file:
        body = file.read("word/document.xml").decode()
        out = []
        for part in re.finditer(r"<w:tr\b.*?</w:tr>|<w:p\b(?:[^>]*/>|.*?</w:p>)", body, re.DOTALL):
            cells = re.findall(r"<w:tc\b.*?</w:tc>", part[0], re.DOTALL)
            out.append(" ".join(filter(None, (plain(c).strip() for c in cells))) if cells else plain(part[0]))
        for name in ("footnote", "endnote"):
            if f"word/{name}s.xml" in file.namelist():
                for note in re.finditer(rf"<w:{name}\b([^>]*)>(.*?)</w:{name}>", file.read(f"word/{name}s.xml").decode(), re.DOTALL):
                    number = re.search(r'w:id="(\d+)"', note[1])
                    if number and "eparator" not in note[1] and plain(note[2]).strip():
                        out.append(f"[{number[1]}] {plain(note[2]).strip()}")
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def docx_texts(contents: pd.Series) -> pd.Series:
    return contents.map(docx_text)


@F.pandas_udf(T.BinaryType())
def made_docx(names: pd.Series, cells: pd.Series) -> pd.Series:
    """Small DOCX files with a paragraph, a table row and a note, for trials."""
    def one(name, cell):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f"<w:document><w:p><w:t>Hola {name}</w:t></w:p><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>{cell}</w:t></w:p></w:tc></w:tr></w:document>")
            z.writestr("word/footnotes.xml", '<w:footnotes><w:footnote w:type="separator" w:id="0"><w:t>-</w:t></w:footnote><w:footnote w:id="2"><w:t>nota</w:t></w:footnote></w:footnotes>')
        return out.getvalue()

    return pd.Series([one(n, c) for n, c in zip(names, cells, strict=True)])


def read_files(spark: SparkSession, path: str, pdf_pages: str = "", unknown: str = "error") -> DataFrame:
    """path, text, problem and error of each file below path, with normalised texts; a damaged file, and one of an unknown
    kind (unless unknown is skip), is a row with its problem.

    pdf_pages (module:function, from bytes to the texts of pages) is a parameter, as no PDF reader is at hand here."""
    from archivolt.sources.files import scan

    out = scan(spark, path, pdf=pdf_pages, unknown=unknown)
    return out.select("path", "extension", joined_hyphens(normalise(F.col("text"))).alias("text"), "problem", "error")


def joined_files(files: DataFrame, key: Column) -> DataFrame:
    """One text for each key: its files' texts by lower-cased path, an empty line between."""
    parts = F.array_sort(F.collect_list(F.struct(F.lower("path").alias("path"), F.trim(F.col("text"), F.lit("\n")).alias("text"))))
    return files.filter("text <> ''").groupBy(key.alias("doc_id")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("files"))


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank ones are ignored."""
    return spark.read.schema(schema).json(path).na.drop("all")


def write_jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def question_bank(closed: DataFrame, free: DataFrame) -> DataFrame:
    """Approved questions of both kinds by (format, id), with the one text of the options that is right."""
    right = F.filter("options", lambda o: o["is_correct"])
    one = closed.withColumn("format", F.lit("multiple_choice")).withColumn("expected", F.when(F.size(right) == 1, right[0]["text"]))
    return one.unionByName(free, allowMissingColumns=True).filter("state = 'approved'").orderBy("format", "id")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a small list without blanks and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and value not like '#%'").distinct()


def write_texts(chunks: DataFrame, path: str) -> None:
    """A file for each document with its whole text; what an earlier run left goes when this one is whole."""
    from archivolt.sources.committed import save

    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]), "\n\n")
    save(chunks.groupBy("doc_id").agg(text.alias("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "text"), path)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """key and text of distinct texts whose hash the cache(key, ..) lacks."""
    keyed = texts.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def from_cache(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.withColumn("key", F.sha2("text", 256)).join(cache, "key", "left")


def request_key(*columns: str) -> Column:
    """A hash of a request's canonical JSON: fields by name."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def fingerprint(table: DataFrame) -> str:
    """A hash of a table's content, whatever its order: the sum and the exclusive or of its rows' hashes, and their count."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(table.columns))))
    r = table.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return json.dumps([r["n"], r["x"], str(r["s"])])


def direct_link(url: Column) -> Column:
    """Share links of common stores as links that give the file itself."""
    drive = F.regexp_extract(url, r"drive\.google\.com/(?:file/d/|open\?id=|uc\?.*?id=)([\w-]+)", 1)
    zenodo = F.regexp_extract(url, r"^(https://zenodo\.org/records?/\d+/files/[^?]+)", 1)
    bare = F.regexp_replace(url, r"[?&](?:dl|raw|download|web)=[^&]*", "")
    mark = F.when(bare.contains("?"), "&").otherwise("?")
    return (
        F.when(drive != "", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive)).when(url.rlike(r"^https://(www\.)?dropbox\.com/"), F.concat(bare, mark, F.lit("dl=1")))
        .when(url.rlike(r"^https://[^/]*(sharepoint\.com|1drv\.ms)/"), F.concat(bare, mark, F.lit("download=1"))).when(zenodo != "", F.concat(zenodo, F.lit("?download=1"))).otherwise(url)
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file (its path below `path`) and sha256 of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", f"{path.rstrip('/').rsplit('/', 1)[1]}/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def changed_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """file and problem (missing, changed or extra) where found(file, sha256) is not what manifest(file, sha256) says."""
    both = manifest.select("file", F.col("sha256").alias("wanted")).join(found, "file", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("wanted") != F.col("sha256"), "changed")
    return both.select("file", problem.alias("problem")).filter("problem is not null")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """A dense index: vectors(id, vec) below path."""
    vectors.select("id", "vec").write.mode("overwrite").parquet(path)
