"""A data source for outputs that are whole or not there: df.write.format("committed").mode(..).save(folder).

Each task writes below a folder of its own attempt and hands its name and counts over; the commit then writes one small
file, CURRENT, that names the attempts which make the output.  Until it is written the earlier output stays as it was, and
what an overwrite makes stale goes only after it.  An aborted run removes its own attempts alone.  Reading takes what
CURRENT names, so attempts that died, ran twice or came late are never seen.  No file is moved, so a commit takes time
by tasks, not by documents.

Option layout: texts (doc_id and text, or content as bytes, and extension if not .txt: a file <doc_id><extension> for each
row) or lines (any columns as JSON lines)."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from archivolt.sources.files import BATCH_BYTES, opened

CURRENT, INDEX = "_CURRENT", "_files.json"
#: Bytes of a folder, which one task reads again.
FOLDER = 64 << 20


@dataclass
class Attempt(WriterCommitMessage):
    """The folders that a task wrote, with their rows: what the driver holds grows with folders, not with documents."""

    folders: list[tuple[str, int]]


def manifest(store: fs.FileSystem, at: str) -> dict | None:
    """What CURRENT says, or None where nothing has been committed."""
    if store.get_file_info(f"{at}/{CURRENT}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{at}/{CURRENT}") as file:
        return json.loads(file.read())


def plain(value):
    """Values of Arrow as JSON has them."""
    return value if value is None or isinstance(value, bool | int | float | str | list | dict) else str(value)


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, layout: str, overwrite: bool, columns: list[str]):
        self.folder, self.layout, self.overwrite, self.run = folder, layout, overwrite, uuid.uuid4().hex
        if layout not in ("texts", "lines"):
            raise ValueError(f"layout is texts or lines, not {layout}")
        if layout == "texts" and not ("doc_id" in columns and {"text", "content"} & set(columns)):
            raise ValueError("layout texts takes doc_id and text or content")

    def write(self, iterator):
        from pyspark import TaskContext

        store, at = opened(self.folder)
        base = f"run-{self.run}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        done, files, lines, rows, held = Attempt([]), [], None, 0, 0

        def close() -> None:
            """Ends a folder: its list of files is written last."""
            nonlocal files, lines, rows, held
            if lines is not None:
                files.append("lines.jsonl")
                lines.close()
            if rows:
                with store.open_output_stream(f"{at}/{base}-{len(done.folders)}/{INDEX}") as file:
                    file.write(json.dumps(files).encode())
                done.folders.append((f"{base}-{len(done.folders)}", rows))
            files, lines, rows, held = [], None, 0, 0

        for batch in iterator:
            for row in batch.to_pylist():
                folder = f"{at}/{base}-{len(done.folders)}"
                if not rows:
                    store.create_dir(folder, recursive=True)
                if self.layout == "texts":
                    if row["doc_id"] is None:
                        raise ValueError("a document without doc_id has no file")
                    name = quote(str(row["doc_id"]), safe=" ") + (row.get("extension") or ".txt")
                    content = row["content"] or b"" if "content" in row else (row["text"] or "").encode()
                    with store.open_output_stream(f"{folder}/{name}") as file:
                        file.write(content)
                    files.append(name)
                else:
                    lines = lines or store.open_output_stream(f"{folder}/lines.jsonl")
                    content = json.dumps({k: plain(v) for k, v in row.items()}, ensure_ascii=False).encode() + b"\n"
                    lines.write(content)
                rows, held = rows + 1, held + len(content) + 64
                if held > FOLDER:
                    close()
        close()
        return done

    def commit(self, messages):
        store, at = opened(self.folder)
        done = [m for m in messages if m is not None]
        before = manifest(store, at)
        if before and before["layout"] != self.layout and not self.overwrite:
            raise ValueError(f"{self.folder} holds {before['layout']}")
        kept = [] if self.overwrite or not before else before["attempts"]
        now = {"layout": self.layout, "attempts": kept + [{"folder": folder, "rows": rows} for m in done for folder, rows in m.folders]}
        draft = f"{at}/_CURRENT-{self.run}"
        store.create_dir(at, recursive=True)
        with store.open_output_stream(draft) as file:
            file.write(json.dumps(now).encode())
        store.move(draft, f"{at}/{CURRENT}")  # from here on the new output is there
        named = {a["folder"] for a in now["attempts"]}
        stale = {a["folder"].split("/")[0] for a in before["attempts"]} if before else set()
        for run in sorted(stale | {f"run-{self.run}"}):
            here = f"{at}/{run}"
            if store.get_file_info(here).type == fs.FileType.Directory:
                held = store.get_file_info(fs.FileSelector(here))
                gone = [x.path for x in held if f"{run}/{x.base_name}" not in named]
                for path in [here] if len(gone) == len(held) else gone:
                    store.delete_dir(path)

    def abort(self, messages):
        store, at = opened(self.folder)
        if store.get_file_info(f"{at}/run-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/run-{self.run}")


@dataclass
class Part(InputPartition):
    folder: str


class CommittedReader(DataSourceReader):
    def __init__(self, folder: str, schema):
        self.folder, self.schema = folder, schema

    def partitions(self):
        store, at = opened(self.folder)
        now = manifest(store, at)
        if now is None:
            raise FileNotFoundError(f"{self.folder} holds no committed output")
        return [Part(a["folder"]) for a in now["attempts"]] or [Part("")]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        store, at = opened(self.folder)
        kinds, rows, held = to_arrow_schema(self.schema), [], 0
        names = []
        if partition.folder:
            with store.open_input_stream(f"{at}/{partition.folder}/{INDEX}") as file:
                names = json.loads(file.read())
        for name in names:
            path = f"{at}/{partition.folder}/{name}"
            if name.endswith(".jsonl"):
                with store.open_input_stream(path) as file:
                    for line in lines_of(file):
                        rows.append(json.loads(line))
                        held += len(line)
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
            else:
                with store.open_input_stream(path) as file:
                    key = unquote(name.rsplit(".", 1)[0])
                    rows.append({"doc_id": int(key) if pa.types.is_integer(kinds.field("doc_id").type) else key, "text": file.read().decode()})
                held += len(rows[-1]["text"])
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def lines_of(file):
    """Lines of a byte stream, a block at a time."""
    rest = b""
    while block := file.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class Committed(DataSource):
    @classmethod
    def name(cls):
        return "committed"

    def schema(self):
        return "doc_id string, text string"

    def writer(self, schema, overwrite):
        options = {k.lower(): v for k, v in self.options.items()}
        return CommittedWriter(options["path"], options.get("layout", "texts"), overwrite, schema.names)

    def reader(self, schema):
        return CommittedReader({k.lower(): v for k, v in self.options.items()}["path"], schema)


def save(rows: DataFrame, path: str, layout: str = "texts", mode: str = "overwrite") -> None:
    """rows below path, all of them or none."""
    rows.sparkSession.dataSource.register(Committed)
    rows.write.format("committed").option("layout", layout).mode(mode).save(path)


def load(spark: SparkSession, path: str, schema: str = "doc_id string, text string") -> DataFrame:
    """What was committed last below path."""
    spark.dataSource.register(Committed)
    return spark.read.format("committed").schema(schema).load(path)
