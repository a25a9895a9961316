"""A data source for folders of documents: spark.read.format("corpus_files").load(folder).

Files are listed once, dealt to tasks by their sizes, and read and decoded in the tasks.  Every file gives a row: what
can't be read is a row with the kind of its problem, so one damaged file never ends a scan.  Conditions on `extension`
are taken over by the listing, so files that they leave out aren't opened.

The folder may lie in any store that Arrow's file systems know (local paths, file://, s3://, gs://, hdfs://)."""

from __future__ import annotations

import importlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from archivolt.sources.documents import EXTENSIONS, as_text, docx_text, page_text

SCHEMA = "path string, extension string, bytes long, text string, problem string, error string"
#: Bytes of files that one task reads, and of texts that it hands over at a time.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20

UNSUPPORTED, DAMAGED, EMPTY, UNREADABLE = "unsupported", "damaged", "empty", "unreadable"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""


@dataclass
class Files(InputPartition):
    """What one task reads: (path, size) in order."""

    files: list[tuple[str, int]]


def dealt(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Runs of files of at most `most` bytes together; a larger file is a run of its own.  Opening one counts as 4 KB."""
    out, room = [], 0
    for path, size in files:
        if not out or size + 4096 > room:
            out.append(Files([]))
            room = most
        out[-1].files.append((path, size))
        room -= size + 4096
    return out


def text_of(extension: str, content: bytes, pdf_pages) -> str:
    if extension in (".html", ".htm"):
        return page_text(as_text(content))
    if extension == ".docx":
        return docx_text(content)
    if extension == ".pdf":
        if pdf_pages is None:
            raise ValueError("no reader of PDF pages was given")
        return "\f".join(pdf_pages(content))
    return as_text(content)


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options.get("path") or ""
        self.most = int(options.get("taskbytes", TASK_BYTES))
        self.unknown = options.get("unknown", "error")
        self.pdf = options.get("pdf", "")
        self.listed = options.get("read", "true").lower() == "false"
        self.wanted: set[str] | None = None
        if not self.folder:
            raise ValueError("corpus_files needs a folder: load(path)")
        if self.unknown not in ("error", "skip"):
            raise ValueError(f"unknown is error or skip, not {self.unknown}")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("extension",):
                now = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = now if self.wanted is None else self.wanted & now
            else:
                yield f

    def partitions(self):
        store, at = opened(self.folder)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        found = []
        for x in every:
            hidden = x.path[len(at) :].replace("/.", "/_").find("/_") >= 0  # what writers leave beside their output
            if x.type == fs.FileType.File and not hidden:
                extension = extension_of(x.path)
                if (self.wanted is None or extension in self.wanted) and (self.unknown == "error" or extension in EXTENSIONS):
                    found.append((x.path, x.size or 0))
        return dealt(sorted(found, key=lambda f: (f[0].lower(), f[0])), self.most) or [Files([])]

    def row(self, store: fs.FileSystem, path: str, size: int, pdf_pages) -> tuple:
        extension = extension_of(path)
        if extension not in EXTENSIONS:
            return path, extension, size, "", UNSUPPORTED, f"no reader for {path.rsplit('/', 1)[-1]}"
        try:
            with store.open_input_stream(path) as file:
                content = file.read()
        except OSError as error:
            return path, extension, size, "", UNREADABLE, str(error)
        try:
            text = text_of(extension, content, pdf_pages)
        except Exception as error:  # whatever a parser says of a damaged file
            return path, extension, size, "", DAMAGED, f"{type(error).__name__}: {error}"
        return (path, extension, size, text, None, None) if text.strip() else (path, extension, size, text, EMPTY, "no text")

    def read(self, partition):
        store = opened(self.folder)[0]
        module, _, name = self.pdf.partition(":")
        pdf_pages = getattr(importlib.import_module(module), name) if module else None
        rows, held = [], 0
        for path, size in partition.files:
            rows.append((path, extension_of(path), size, None, None, None) if self.listed else self.row(store, path, size, pdf_pages))
            held += len(rows[-1][3] or "")
            if held > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["path", "extension", "bytes", "text", "problem", "error"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class CorpusFiles(DataSource):
    """path, extension, bytes, text, problem and error of every file below a folder, or of one file.

    Options: taskBytes (bytes of files in a task), unknown (error: files of other kinds are rows with a problem; skip: they
    are left out), read (false: names and sizes only), pdf (module:function, which takes a PDF's bytes and gives the texts of its pages)."""

    @classmethod
    def name(cls):
        return "corpus_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FilesReader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files below path by the data source, which is registered with the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusFiles)
    return spark.read.format("corpus_files").options(**options).load(path)
