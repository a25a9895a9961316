"""Removal of long strings that repeat anywhere in a corpus.

1. Anchors.  Every string of `length` bytes holds one anchor: its least hash of `gram` bytes, the leftmost on ties.
   Equal strings have equal anchors at equal places, so a string whose anchor occurs once cannot repeat.  The strings
   of one anchor lie side by side and make a block of less than two lengths.
2. Blocks that are equal as a whole repeat in all their strings; counting them needs no text.
3. Other blocks of an anchor that occurs again are compared by their bytes.  All blocks of an anchor come to one
   shard; shards hold a bounded number of bytes.  Each shard builds its suffix array (Larsson and Sadakane's
   refinement) and the common prefixes of neighbours (Kasai's bound); neighbours that share `length` bytes repeat.
4. An anchor with more blocks than a shard takes is dealt to as many shards as it needs.  Each of them also packs
   128-bit digests of its different strings, sorted, in ranges of bounded size; where the lists of a range meet, each
   is looked up in the merged one by binary search.  No task ever holds all of an anchor.

Bytes under a repeated string are cut at the end, on the input's positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.shared import dropped, give_back, mixed, slices, table, texts_of, written
from archivolt.llm.suffixes import repeated_starts

GRAM = 32
BASE = 0x9E3779B97F4A7C15
SHARD_BYTES = 1 << 20
WIDE = 2048  # blocks of one anchor beyond which it is dealt to several shards


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the GRAM bytes from each position, by doubling; the last positions are left out."""
    h, size = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)[data], 1
    while size < GRAM:
        h = h[:-size] * power(size) + h[size:]
        size *= 2
    return h


def window_hash(grams: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes from each position, by gram hashes that cover them."""
    out = np.zeros(len(at), np.uint64)
    for shift in [*range(0, length - GRAM, GRAM), length - GRAM]:
        out = out * np.uint64(0xD1B54A32D192ED03) + grams[at + shift]
    return mixed(out)


def anchored(data: np.ndarray, offsets: np.ndarray, length: int):
    """Blocks of all texts in data: text index, start of the first string in it, number of strings, anchor's place in
    the block, anchor hash, block hash."""
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    w = length - GRAM + 1
    if len(data) < length:
        return empty
    grams = gram_hashes(data)
    order = mixed(grams)
    n = len(order)
    pad = -n % w
    full = np.concatenate([order, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 :])
    del full, ahead, behind
    # windows that lie in one text
    size = np.diff(offsets)
    valid = np.zeros(len(least) + 1, np.int8)
    some = size >= length
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, offsets[1:][some] - length + 1, -1)
    inside = np.cumsum(valid[:-1]).astype(bool)
    cut = np.ones(len(least), bool)
    cut[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    cut[offsets[:-1][some]] = True
    first = np.flatnonzero(cut & inside)
    if not len(first):
        return empty
    stop = np.flatnonzero(inside & np.concatenate([cut[1:] | ~inside[1:], [True]]))
    place = np.empty(len(first), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(order, w)
    for a in range(0, len(first), 4096):
        place[a : a + 4096] = first[a : a + 4096] + view[first[a : a + 4096]].argmin(axis=1)
    # where equal hashes follow one another within a run, each in turn is the leftmost
    tied = np.flatnonzero(stop > place)
    if len(tied):
        more_first, more_stop, more_place = [np.delete(first, tied)], [np.delete(stop, tied)], [np.delete(place, tied)]
        for t in tied.tolist():
            same = place[t] + np.flatnonzero(order[place[t] : stop[t] + w] == order[place[t]])
            begin = np.concatenate([[first[t]], same[:-1] + 1])
            keep = begin <= stop[t]
            more_first.append(begin[keep])
            more_stop.append(np.minimum(same[keep], stop[t]))
            more_place.append(same[keep])
        first, stop, place = (np.concatenate(x) for x in (more_first, more_stop, more_place))
        by = np.argsort(first, kind="stable")
        first, stop, place = first[by], stop[by], place[by]
    text = np.searchsorted(offsets, first, side="right") - 1
    count, rel = stop - first + 1, place - first
    block = window_hash(grams, first, length) * np.uint64(BASE) + window_hash(grams, stop, length)
    block = mixed(block + count.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + rel.astype(np.uint64))
    return text, first - offsets[text], count, rel, order[place], block


def anchors_of(docs: DataFrame, length: int) -> DataFrame:
    """anchor, block, doc_id, dg (digest of the text), place (start << 20 | strings << 10 | anchor's place)."""

    def make(batches):
        for batch in slices(batches, 1 << 20):
            texts = texts_of(batch.column("text"))
            data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
            text, first, count, rel, anchor, block = anchored(data[: offsets[-1]], offsets, length)
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), batch.column("doc_id").take(of), batch.column("dg").take(of), pa.array(first << 20 | count << 10 | rel)],
                names=["anchor", "block", "doc_id", "dg", "place"],
            )

    return docs.mapInArrow(make, "anchor long, block long, doc_id long, dg long, place long")


def by_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs(doc_id, dg, ..) joined with rows of the same text, which have one for each (doc_id, dg)."""
    other = rows.withColumnsRenamed({"doc_id": "d", "dg": "g"})
    return docs.join(other.hint("shuffle_hash"), docs.doc_id.eqNullSafe(F.col("d")) & (docs.dg == F.col("g")), how).drop("d", "g")


def ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True))


def with_text(docs: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """The bytes of blocks(anchor, block, doc_id, dg, place); blocks of one text come together, and each text once."""
    asked = blocks.groupBy("doc_id", "dg").agg(F.collect_list(F.struct("anchor", "block", "place")).alias("blocks"))

    def make(batches):
        for batch in slices(batches, 2 << 20):
            texts = texts_of(batch.column("text"))
            data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
            raw, rows = data.tobytes(), []
            for a, asked_here in zip(offsets[:-1].tolist(), batch.column("blocks").to_pylist(), strict=True):
                for x in asked_here:
                    start, strings = a + (x["place"] >> 20), x["place"] >> 10 & 1023
                    rows.append((x["anchor"], x["block"], strings, x["place"] & 1023, raw[start : start + strings - 1 + length]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "block", "strings", "rel", "bytes"])

    found = by_text(docs, asked, "inner").select("blocks", "text")
    return found.mapInArrow(make, "anchor long, block long, strings int, rel int, bytes binary").dropDuplicates(["anchor", "block"])


RUNS = "array<struct<first:int,last:int>>"


def shard_of(rows: list[tuple], length: int):
    """A shard's strings, from rows (anchor, block, strings, rel, bytes): the row and start of each, which repeat
    within the shard, and the shard's bytes with the place of each row."""
    lengths = np.array([len(r[4]) for r in rows])
    begin = np.cumsum(lengths) - lengths
    raw = b"".join(r[4] for r in rows)
    n = np.array([r[2] for r in rows])
    which = np.repeat(np.arange(len(rows)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return which, start, repeated_starts(np.frombuffer(raw, np.uint8), begin[which] + start, length), raw, begin


def runs_of(rows: list[tuple], which: np.ndarray, start: np.ndarray, chosen: np.ndarray) -> list[tuple]:
    """(anchor, block, runs) of the rows that have chosen starts."""
    parts = np.split(start[chosen], np.searchsorted(which[chosen], np.arange(1, len(rows))))
    return [(r[0], r[1], [{"first": a, "last": b} for a, b in ranges(part)]) for r, part in zip(rows, parts, strict=True) if len(part)]


def run_batch(found: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    cols = list(zip(*found, strict=True)) if found else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), kind), strict=True)], names=["anchor", "block", "runs"])


def groups_of(batches, names: list[str], keys: int, least_bytes: int):
    """Lists of rows, cut where the first `keys` columns change, once least_bytes have come together."""
    rows, size, held = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if rows and row[:keys] != held and size >= least_bytes:
                yield rows
                rows, size = [], 0
            held = row[:keys]
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
    if rows:
        yield rows
    give_back()


def in_shards(blocks: DataFrame, length: int) -> DataFrame:
    """anchor, block and runs of starts that repeat; all blocks of an anchor lie in one shard."""

    def make(batches):
        for rows in groups_of(batches, ["anchor", "block", "strings", "rel", "bytes"], 1, SHARD_BYTES):
            which, start, repeat, _, _ = shard_of(rows, length)
            yield run_batch(runs_of(rows, which, start, repeat))

    parts = blocks.repartition("anchor").sortWithinPartitions("anchor", "block")
    return parts.select("anchor", "block", "strings", "rel", "bytes").mapInArrow(make, f"anchor long, block long, runs {RUNS}")


def across_shards(blocks: DataFrame, length: int) -> DataFrame:
    """The same for anchors that are dealt to several shards.

    A shard marks what repeats within it and packs the digests of its different strings, sorted, by range.  A range of
    an anchor holds a bounded number of them; there each shard's list is looked up in the others' by binary search."""
    names = ["anchor", "shard", "block", "strings", "rel", "bytes", "ranges"]
    schema = f"anchor long, block long, runs {RUNS}, `range` int, digests binary, blocks binary, starts binary"
    kinds = pa.schema([("anchor", pa.int64()), ("block", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("range", pa.int32()), ("digests", pa.binary()), ("blocks", pa.binary()), ("starts", pa.binary())])

    def make(batches):
        for group in groups_of(batches, names, 2, 0):
            rows = [(r[0], *r[2:6]) for r in group]
            which, start, repeat, raw, begin = shard_of(rows, length)
            out = [{"anchor": a, "block": b, "runs": r} for a, b, r in runs_of(rows, which, start, repeat)]
            at = (begin[which] + start).tolist()
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in at), ">u8").reshape(-1, 2).astype(np.uint64)
            by = np.lexsort((digest[:, 1], digest[:, 0]))
            different = by[np.concatenate([[True], (digest[by[1:]] != digest[by[:-1]]).any(axis=1)])]
            block = np.array([r[1] for r in rows], np.int64)[which[different]]
            of = (digest[different, 0] % np.uint64(group[0][6])).astype(np.int64)
            for k in np.unique(of).tolist():
                mine = of == k
                out.append({"anchor": rows[0][0], "range": k, "digests": digest[different[mine]].tobytes(), "blocks": block[mine].tobytes(), "starts": start[different[mine]].astype(np.int32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    def merge(batches):
        for group in groups_of(batches, ["anchor", "range", "digests", "blocks", "starts"], 2, 0):
            lists = [np.frombuffer(r[2], np.dtype([("a", "<u8"), ("b", "<u8")])) for r in group]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            every = np.concatenate(lists)
            by = np.lexsort((owner, every["b"], every["a"]))
            merged = every[by]
            first = np.concatenate([[True], merged[1:] != merged[:-1]])
            edges = np.append(np.flatnonzero(first), len(merged))
            found = []
            for r, mine in zip(group, lists, strict=True):
                heads = merged[edges[:-1]]
                place = np.searchsorted(heads["a"], mine["a"])
                while (later := (heads[np.minimum(place, len(heads) - 1)] != mine)).any():  # equal first halves
                    place[later] += 1
                twice = edges[place + 1] - edges[place] > 1
                block, start = np.frombuffer(r[3], np.int64)[twice], np.frombuffer(r[4], np.int32)[twice]
                order = np.lexsort((start, block))
                block, start = block[order], start[order]
                cut = np.flatnonzero(np.diff(block)) + 1
                found += [(r[0], int(b[0]), [{"first": x, "last": y} for x, y in ranges(s)]) for b, s in zip(np.split(block, cut), np.split(start, cut), strict=True) if len(b)]
            yield run_batch(found)

    full = blocks.withColumn("ranges", F.floor(F.col("blocks") * (length - GRAM + 1) / (1 << 18)) + 1).repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "block")
    packed = written(full.select(*names).mapInArrow(make, schema), "packed")
    lists = packed.filter("digests is not null").repartition("anchor", "range").sortWithinPartitions("anchor", "range")
    across = lists.select("anchor", "range", "digests", "blocks", "starts").mapInArrow(merge, f"anchor long, block long, runs {RUNS}")
    return packed.filter("digests is null").select("anchor", "block", "runs").union(across)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, dg and spans (array of first and last start of runs of repeated strings) of the texts that have any;
    docs(doc_id, dg, text), where dg tells the texts of one doc_id apart."""
    anchors = written(anchors_of(docs, length), "anchors")
    # written, so that nothing above the join needs an anchor's rows together and AQE can split a frequent one
    again = written(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("block") != F.max("block")).alias("differ")).filter("n > 1").select("anchor", "differ"), "repeated")
    again_rows = written(anchors.join(again, "anchor"), "again")
    dropped(anchors, again)
    kinds = written(
        again_rows.filter("differ").withColumn("row", F.xxhash64("doc_id", "dg", "place"))
        .groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")),
        "kinds",
    )
    wide = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks"))
    chosen = (
        again_rows.filter("differ").withColumn("row", F.xxhash64("doc_id", "dg", "place"))
        .join(kinds.select("anchor", "block", "row"), ["anchor", "block", "row"]).select("anchor", "block", "doc_id", "dg", "place").dropDuplicates(["anchor", "block"])
    )
    texts = with_text(docs, chosen, length).join(wide, "anchor")
    texts = written(texts.withColumn("shard", F.pmod("block", F.floor((F.col("blocks") - 1) / WIDE) + 1)), "blocks")
    found = in_shards(texts.filter(F.col("blocks") <= WIDE), length)
    dealt = texts.filter(F.col("blocks") > WIDE)
    if not dealt.isEmpty():
        found = found.union(across_shards(dealt, length))
    runs = written(found, "runs")
    by_block = runs.groupBy("anchor", "block").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    # what of a block repeats, one row each: a single join then meets the frequent blocks, which AQE can split
    told = written(
        kinds.join(by_block, ["anchor", "block"], "left").filter("n > 1 or runs is not null").select("anchor", "block", F.when(F.col("n") == 1, F.col("runs")).alias("runs")), "told"
    )
    strings_in = F.shiftright("place", 10).bitwiseAND(F.lit(1023)).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("first"), (strings_in - 1).alias("last")))
    of_one = again_rows.filter("not differ").select("doc_id", "dg", "place", whole.alias("runs"))
    of_more = again_rows.filter("differ").join(told, ["anchor", "block"]).select("doc_id", "dg", "place", F.coalesce("runs", whole).alias("runs"))
    start = F.shiftright("place", 20)
    marks = of_one.union(of_more).select("doc_id", "dg", F.explode("runs").alias("run"), start.alias("start"))
    span = F.struct((F.col("start") + F.col("run.first")).alias("first"), (F.col("start") + F.col("run.last")).alias("last"))
    spans = written(marks.groupBy("doc_id", "dg").agg(F.collect_set(span).alias("spans")), "spans")
    dropped(again_rows, kinds, texts, runs, told)
    return spans


def without_repeats(docs: DataFrame, length: int = 200, extra: str = "", decoded: bool = False) -> DataFrame:
    """Cuts from each text of docs(doc_id, text, ...) the bytes under strings of `length` bytes that begin at another
    place too, in the same row or another.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, which need not be UTF-8 at the cuts) and removed
    (array of first byte, end) for every row; columns named in `extra` follow unchanged.  With `decoded`, kept is a
    string without the characters that were cut in two.  Null texts count as empty; texts shorter than `length` stay
    as they are; texts of any length are read whole; repeated rows lose all of a text that is long enough; null doc_ids
    are kept; no rows give no rows.  Other columns are ignored, and those in `extra` may have any name.  Spans belong to
    a row by its doc_id and a digest of its text.  The result does not depend on order, and there are no ties to break."""
    others = [c for c in extra.split(",") if c]
    held = [f"_{i}" for i in range(len(others))]  # under names of our own, whatever they are called
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(h) for c, h in zip(others, held, strict=True)]).withColumn("dg", F.xxhash64("text"))
    spans = repeated_spans(docs.select("doc_id", "dg", "text"), length)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if decoded else 'binary'}, removed array<struct<first:long,end:long>>" + "".join(f", {h} {types[h]}" for h in held)

    def cut(batches):
        for batch in slices(batches, 2 << 20):
            texts = texts_of(batch.column("text"))
            data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
            raw, rows = data.tobytes(), []
            for i, spans_here in enumerate(batch.column("spans").to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                merged: list[list[int]] = []
                for first, last in sorted((s["first"], s["last"]) for s in spans_here or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last + length)
                    else:
                        merged.append([first, last + length])
                edges = [0, *(x for m in merged for x in m), b - a]
                kept = b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((b - a, b - a - len(kept), len(merged), kept.decode(errors="ignore") if decoded else kept, [{"first": x, "end": y} for x, y in merged]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if decoded else pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), *(batch.column(h) for h in held)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed", *held])

    joined = by_text(docs, spans, "left").select("doc_id", "text", "spans", *held)
    found = joined.mapInArrow(cut, schema)
    return found.select(*found.columns[:6], *[F.col(h).alias(c) for c, h in zip(others, held, strict=True)])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
