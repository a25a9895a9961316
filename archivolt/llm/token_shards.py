"""Training-order materialisation of token ids as fixed-stride binary shards.

The ids of a task's documents follow one another as one stream, which is cut into sequences of a fixed number of
tokens; only a task's last sequence is padded.  A keyed Feistel permutation over the smallest even number of bits that
holds the count, with cycle-walking back into the range, gives every sequence its global slot: a shuffle that needs no
sort of random numbers and can be computed for any slot alone.  Rows are range-partitioned by slot and written to
shards of a fixed number of rows, each `stride` bytes, so that a reader finds slot s at byte (s mod rows) * stride of
shard s div rows and can resume anywhere."""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.shared import dropped, mixed, shared_dir, slices, table, texts_of, written
from archivolt.llm.tokens import Encoder

FEISTEL_ROUNDS = 6
PAD, PADDING = 0, b"\0"
PART_BYTES = 256 << 20  # of shards that one task writes, where there are tasks enough
SAMPLE = 1000  # sequences that the shuffle's compression dictionary is made from
DICTIONARY_BYTES = 1 << 14
COLUMNS = ["n_tokens", "doc_ids", "start", "offsets", "tokens"]
SCHEMA = "n_tokens int, doc_ids array<long>, start long, offsets array<int>, tokens binary"


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 applied to index: Feistel rounds over 2 * half bits, repeated until within range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def id_bytes(tokenizer_path: str) -> int:
    """Bytes that an id of a vocabulary takes: two up to 65,536 ids, else four."""
    with open(tokenizer_path, encoding="utf-8") as file:
        plan = json.load(file)
    most = max([*plan["model"]["vocab"].values(), *(t["id"] for t in plan.get("added_tokens") or [])], default=0)
    return 2 if most < 1 << 16 else 4


def sequences_of(docs: DataFrame, tokenizer_path: str, length: int, width: int = 2) -> DataFrame:
    """n_tokens, doc_ids and offsets (where each document begins in it), start (ids of the first one before it) and
    tokens of each sequence."""

    def cut(batches):
        encoder = Encoder.at(tokenizer_path)

        def sequences(ids, name, start, n, whole):
            """Sequences of a stream of ids, from its stretches (name, start, n); the rest of the stream is kept."""
            count = len(ids) // length if whole else -(-len(ids) // length)
            edges = np.cumsum(n) - n
            # a stretch is cut wherever a sequence begins inside it
            used = min(len(ids), count * length)
            begin = np.unique(np.concatenate([edges[edges < used], np.arange(count) * length]))
            of = np.searchsorted(edges, begin, side="right") - 1
            heads = np.searchsorted(begin, np.arange(count) * length)
            edge = np.append(heads, len(begin)).astype(np.int32)
            names = pa.ListArray.from_arrays(pa.array(edge), name.take(pa.array(of)))
            offsets = pa.ListArray.from_arrays(pa.array(edge), pa.array((begin % length).astype(np.int32)))
            first = start[of[heads]] + begin[heads] - edges[of[heads]]
            raw = ids[:used].astype(f"<u{width}").tobytes()
            for a in range(0, count, 4096):
                b = min(count, a + 4096)
                sizes = np.minimum(length, used - np.arange(a, b) * length).astype(np.int32)
                tokens = [raw[width * k * length : width * (k + 1) * length] for k in range(a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(sizes), names.slice(a, b - a), pa.array(first[a:b]), offsets.slice(a, b - a), pa.array(tokens, pa.binary())], names=COLUMNS)
            last = edges + n > used
            gone = np.maximum(used - edges[last], 0)
            rest[:] = [ids[used:], name.filter(pa.array(last)), start[last] + gone, n[last] - gone]

        rest: list = [np.zeros(0, np.uint32), pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in slices(batches):
            ids, begin = encoder.encode(texts_of(batch.column("text")))
            held, name, start, n = rest
            ids = np.concatenate([held, ids])
            name = pa.concat_arrays([name, batch.column("doc_id")])
            start, n = np.concatenate([start, np.zeros(batch.num_rows, np.int64)]), np.concatenate([n, np.diff(begin)])
            yield from sequences(ids, name, start, n, True)
        yield from sequences(*rest, False)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, SCHEMA)


def dictionary_of(sequences: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample of sequences; empty where there are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["tokens"]) for r in sequences.select("tokens").limit(SAMPLE).collect()]).as_bytes()
    except zstandard.ZstdError:
        return b""


def codec(dictionary: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(1, dict_data=held, write_checksum=False, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=held)


def shard_writer(path: str, rows: int, stride: int, dictionary: bytes):
    """Writes the sequences of a task, in order of their slots, to files of `rows` strides, and gives a row for each.

    Every attempt of a task writes files with names of its own, and only the rows of the attempt that counts, which name
    them, get into the result: an attempt that dies, is late or runs beside another can't touch a file of another's."""

    def write(batches):
        import pyarrow.fs

        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        attempt, now, out, unpack = uuid.uuid4().hex[:12], None, None, codec(dictionary)[1].decompress

        def name(shard: int) -> str:
            return f"shard-{shard:08d}-{attempt}.bin"

        for batch in batches:
            slots = batch.column("slot").to_numpy()
            shard = (slots // rows).tolist()
            tokens = [unpack(t).ljust(stride, PADDING) for t in batch.column("tokens").to_pylist()]
            for s, t in zip(shard, tokens, strict=True):
                if s != now:
                    if out:
                        out.close()
                    now, out = s, store.open_output_stream(f"{folder}/{name(s)}")
                out.write(t)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*COLUMNS[:-1], "slot")), pa.array(shard, pa.int64()), pa.array([zlib.crc32(t) for t in tokens], pa.int64()), pa.array([name(s) for s in shard], pa.string())],
                names=[*COLUMNS[:-1], "slot", "shard", "tokens_crc32", "file"],
            )
        if out:
            out.close()

    return write


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """shard, file, first (slot) and sequences of each shard that was committed below path; other files there are of
    attempts that did not count."""
    return spark.read.schema("shard long, file string, first long, sequences long").json(f"{path}/index")


def materialise(docs: DataFrame, tokenizer_path: str, length: int = 512, rows: int = 8192, key: int = 20260101, path: str | None = None, width: int | None = None) -> DataFrame:
    """Writes all texts of docs(doc_id, text) in training order below path (default: the shared folder).

    Returns a row for each sequence: n_tokens (without padding), doc_ids and offsets (the documents in it and where
    each begins there), start (ids of the first one that lie in sequences before), slot, shard, byte_offset,
    tokens_crc32 (of the stride's bytes) and file.  Each document ends with the end id; a null or empty text is that id alone; a text of any length
    goes on through as many sequences as it needs; repeated rows and equal texts are written each; null doc_ids are
    kept; other columns are ignored; no rows write no shard; ties can't occur, as every sequence has a slot of its own.
    Ids take `width` bytes (by default two up to 65,536 ids of the vocabulary, else four).  Files have the name of their
    attempt, and those that count are named in the result and by shard_files(), so lost executors and repeated attempts
    leave no half shard among them.  Beside the shards, index.json holds what a reader needs."""
    spark = docs.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path or f"{shared_dir(spark)}/archivolt/tokens-{uuid.uuid4().hex}")
    path = str(at.getFileSystem(conf).makeQualified(at).toUri().toString())  # with a scheme, so that all tasks mean one store
    width = width or id_bytes(tokenizer_path)
    stride = width * length
    sequences = written(sequences_of(docs, tokenizer_path, length, width).withColumn("uid", F.monotonically_increasing_id()), "sequences", "zstd")
    # a row's number among all: the rows of the tasks before its own, and its turn there; one count a task
    counts = sorted((r["p"], r["n"]) for r in sequences.groupBy(F.shiftright("uid", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    n, base = 0, {}
    for p, k in counts:
        base[p], n = n, n + k
    shards = -(-n // rows)
    tasks = max(1, min(shards, max(8 * spark.sparkContext.defaultParallelism, -(-n * stride // PART_BYTES))))
    dictionary = dictionary_of(sequences)

    def slot(batches):
        pack = codec(dictionary)[0].compress  # each sequence on its own, as the shuffle parts them
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            at = np.fromiter((base[p] for p in (uid >> 33).tolist()), np.int64, len(uid)) + (uid & (1 << 33) - 1)
            tokens = pa.array([pack(t) for t in batch.column("tokens").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS[:-1]), tokens, pa.array(permuted(at, n, key))], names=[*COLUMNS, "slot"])

    placed = sequences.mapInArrow(slot, f"{SCHEMA}, slot long")
    # slots are spread evenly by the permutation, so the ranges need no sample
    ordered = placed.repartitionById(tasks, (F.floor(F.col("slot") / rows) * tasks / max(1, shards)).cast("int")).sortWithinPartitions("slot")

    done = written(ordered.mapInArrow(shard_writer(path, rows, stride, dictionary), SCHEMA.removesuffix(", tokens binary") + ", slot long, shard long, tokens_crc32 long, file string"), "placed")
    dropped(sequences)
    done.groupBy("shard").agg(F.min("file").alias("file"), F.min("slot").alias("first"), F.count(F.lit(1)).alias("sequences")).write.mode("overwrite").json(f"{path}/index")
    about = {"sequences": n, "length": length, "stride": stride, "rows": rows, "key": key, "pad": PAD, "dtype": f"<u{width}"}
    index = jvm.org.apache.hadoop.fs.Path(f"{path}/index.json")
    stream = index.getFileSystem(conf).create(index, True)
    stream.write(bytearray(json.dumps(about).encode()))
    stream.close()
    out = done.withColumn("byte_offset", F.col("slot") % rows * stride)
    out._archivolt_shards = path
    return out


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_ids", "start", "offsets", "n_tokens", "slot", "shard", "byte_offset", "tokens_crc32", "file")
