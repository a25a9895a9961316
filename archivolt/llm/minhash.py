"""Near-duplicate groups by b-bit MinHash.

Every text becomes a set of word shingles.  Minima of `bands * rows` hash functions are taken; bands of them give the
candidates, their low bits are packed and give a similarity by counting bits, corrected for the low bits that agree by
chance; what stays plausible is confirmed on the full sets.  Equal sets are one node from the start.

Within a bucket not all pairs are listed.  Each member is first compared with the bucket's least node.  When the links
found so far have joined all members into one component, nothing more can be learnt from the bucket.  For the others
the packed low bits of all pairs between different components are compared in blocks inside the tasks, and plausible
ones confirmed there, after further rounds with other leaders as long as a member would meet too many others on
average; only links become rows, and none between different components is left out."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.components import components
from archivolt.llm.shared import dropped, mixed, slices, table, texts_of, written
from archivolt.llm.shingles import shingle_sets

BANDS, ROWS, BITS = 32, 5, 4


def minima(sets: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits) of each non-empty set."""
    draw = np.random.default_rng(20260101)
    flips = draw.integers(0, 1 << 32, n, np.uint32)
    odd = draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    begin = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(begin), n), np.uint32)
    for j in range(n):
        out[:, j] = np.minimum.reduceat((low ^ flips[j]) * odd[j], begin) if len(begin) else 0
    return out


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each value as bit planes: row by row, plane by plane."""
    return np.concatenate([np.packbits((values >> np.uint32(k)) & np.uint32(1), axis=1) for k in range(bits)], axis=1)


def estimated(one: np.ndarray, two: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Similarity from packed low bits: the share of positions that agree in all planes, less what chance gives."""
    planes = (one ^ two).reshape(len(one), bits, -1)
    differ = np.bitwise_count(np.bitwise_or.reduce(planes, axis=1)).sum(axis=1)
    return ((n - differ) / n - 2.0**-bits) / (1 - 2.0**-bits)


def signed(docs: DataFrame, size: int, bands: int, rows: int, bits: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and packed low bits of each row; digest is null without words."""

    def sign(batches):
        for batch in slices(batches, 2 << 20):
            sets, offsets = shingle_sets(texts_of(batch.column("text")), size)
            n = np.diff(offsets)
            values = minima(sets, offsets, bands * rows)
            chain = np.zeros((len(values), bands), np.uint64)
            for r in range(rows):
                chain = chain * np.uint64(0x9E3779B97F4A7C15) + values[:, r::rows].astype(np.uint64)
            keys = mixed(chain + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
            low = packed(values, bits)
            full = np.flatnonzero(n > 0)
            digest, sig, lists, k = [None] * len(n), [None] * len(n), np.zeros(len(n) + 1, np.int32), 0
            for i in full.tolist():
                digest[i] = hashlib.blake2b(sets[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
                sig[i] = low[k].tobytes()
                k += 1
            lists[1:] = np.cumsum(np.where(n > 0, bands, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(lists), pa.array(keys.ravel())), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sig"],
            )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary")


def least_estimate(n: int, bits: int, percent: int) -> float:
    """Six deviations below the similarity asked for."""
    least = percent / 100
    agree = least + (1 - least) * 2.0**-bits
    return least - 6 * (agree * (1 - agree) / n) ** 0.5 / (1 - 2.0**-bits)


def shared_of(one: np.ndarray, two: np.ndarray) -> int:
    every = np.sort(np.concatenate([one, two]))
    return int((every[1:] == every[:-1]).sum())


def across(opened: DataFrame, signed_nodes: DataFrame, sets: DataFrame, n: int, bits: int, percent: int, block: int = 2048, held: int = 1 << 20) -> DataFrame:
    """Links (a, b) that join the components within the buckets of opened(key, node, comp, n_shingles).

    The packed low bits of a bucket are compared in blocks of about `block` members and `held` shingles; a larger
    bucket is dealt to as many tasks as it has pairs of blocks.  A pair belongs to the first band that both nodes
    share.  Members of a plausible pair come together again with their full sets, and a pair is confirmed there unless
    links found before have joined it.  So neither pairs nor more than a block's sets become rows."""
    from_estimate = least_estimate(n, bits, percent)
    total = opened.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / held)).cast("int").alias("blocks"))
    dealt = opened.join(total, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp")
    group = ["key", "i", "j"]
    full = dealt.join(signed_nodes, "node").repartition(*group).sortWithinPartitions(*group)

    def pairs_of(part):
        """(x, ys) of the plausible pairs of a group whose first common band is this bucket's."""
        nodes, comps, sizes, own = (np.array([r[c] for r in part], np.int64) for c in ("node", "comp", "n_shingles", "own"))
        low = np.frombuffer(b"".join(r["sig"] for r in part), np.uint8).reshape(len(part), -1)
        bands = np.frombuffer(b"".join(r["bands"] for r in part), ">i8").astype(np.int64).reshape(len(part), -1)
        at = (bands == part[0]["key"]).argmax(axis=1)
        crossing = part[0]["i"] != part[0]["j"]
        for x in range(len(part) - 1):
            ok = (comps[x + 1 :] != comps[x]) & (np.minimum(sizes[x + 1 :], sizes[x]) * 100 >= np.maximum(sizes[x + 1 :], sizes[x]) * percent)
            if crossing:
                ok &= own[x + 1 :] != own[x]
            rest = x + 1 + np.flatnonzero(ok)
            if len(rest):
                rest = rest[estimated(low[rest], low[x][None], n, bits) >= from_estimate]
            if len(rest):
                rest = rest[~(bands[rest, : at[x]] == bands[x, : at[x]]).any(axis=1)]
            if len(rest):
                yield x, rest, nodes, comps

    def grouped(batches, names, work):
        part, now = [], None
        for batch in batches:
            found = []
            for row in batch.select(names).to_pylist():
                here = (row["key"], row["i"], row["j"])
                if here != now and part:
                    found += work(part)
                    part = []
                now = here
                part.append(row)
            yield found
        if part:
            yield work(part)

    names = [*group, "own", "node", "comp", "n_shingles", "sig", "bands"]
    schema = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("node", pa.int64()), ("comp", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("bands", pa.binary())])

    def taking_part(batches):
        def work(part):
            keep = np.zeros(len(part), bool)
            for x, rest, _, _ in pairs_of(part):
                keep[x] = True
                keep[rest] = True
            return [r for r, k in zip(part, keep.tolist(), strict=True) if k]

        for found in grouped(batches, names, work):
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    def confirm(batches):
        def work(part):
            sets_ = [np.frombuffer(r["set"], np.uint64) for r in part]
            up: dict[int, int] = {}

            def top(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            links = []
            for x, rest, nodes, comps in pairs_of(part):
                for y in rest.tolist():
                    one, two = top(int(comps[x])), top(int(comps[y]))
                    if one != two:
                        both = shared_of(sets_[x], sets_[y])
                        if 100 * both >= percent * (len(sets_[x]) + len(sets_[y]) - both):
                            up[max(one, two)] = min(one, two)
                            links.append((int(nodes[x]), int(nodes[y])))
            return links

        for found in grouped(batches, [*names, "set"], work):
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    some = full.select(*names).mapInArrow(taking_part, "key long, i int, j int, own int, node long, comp long, n_shingles long, sig binary, bands binary")
    whole = some.join(sets, "node").repartition(*group).sortWithinPartitions(*group)
    return whole.select(*names, "set").mapInArrow(confirm, "a long, b long")


def plausible(pairs: DataFrame, sigs: DataFrame, n: int, bits: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose estimate is within six deviations of it."""
    from_estimate = least_estimate(n, bits, percent)
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b"
    )
    sized = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                batch = batch.select(["a", "b"]).filter(pa.array(estimated(one, two, n, bits) >= from_estimate))
            else:
                batch = batch.select(["a", "b"])
            yield batch

    return sized.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity, by whole numbers."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = shared_of(one, two)
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, set): the shingle hashes of nodes(node, node_doc, node_digest), from the texts of docs."""

    def make(batches):
        for batch in slices(batches):
            sets, offsets = shingle_sets(texts_of(batch.column("text")), size)
            rows = [(node, sets[a:b].tobytes()) for node, digest, a, b in zip(batch.column("node").to_pylist(), batch.column("node_digest").to_pylist(), offsets[:-1], offsets[1:], strict=True) if hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() == digest]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "set"])

    found = docs.join(nodes.hint("shuffle_hash"), docs.doc_id.eqNullSafe(nodes.node_doc)).select("node", "node_digest", "text")
    return found.mapInArrow(make, "node long, set binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """Groups the rows of docs(doc_id, text) whose distinct `size`-word shingles have a Jaccard similarity of at least
    percent / 100, directly or through others.

    Returns doc_id, n_shingles, component_id (the least doc_id of the group) and kept for every row.  Null texts,
    empty texts and texts of white space have no shingles and are linked with nothing; equal sets, so also repeated
    rows and texts of equal words, are one group whatever their doc_id; a null doc_id is never a component_id unless
    all of its group are null, and is never kept beside another.  Of rows that share the least doc_id, one is kept per
    row.  Other columns are ignored; texts of any length are read whole; no rows give no rows.  A pair at the very threshold has a chance of (1 - 0.8**rows)**bands to meet in no
    band (3e-6 as set here); longer rows and more bands trade time for it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signs = written(signed(docs, size, bands, rows, bits).withColumn("uid", F.monotonically_increasing_id()), "signs")
    nodes = written(signs.filter("digest is not null").groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("first_doc")), "nodes")
    chosen = written(
        signs.join(nodes.select(F.col("node").alias("uid"), "node"), "uid").select("node", F.col("doc_id").alias("node_doc"), F.col("digest").alias("node_digest"), "n_shingles", "sig", "bands"), "chosen"
    )
    members = chosen.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lead")).filter("m > 1").select("key", "lead")
    buckets = written(members.join(shared, "key").select("key", "node", "n_shingles", "lead"), "buckets")
    sigs = chosen.select("node", "n_shingles", "sig")
    blocks_of = chosen.select("node", "n_shingles", "sig", F.expr("unhex(array_join(transform(bands, b -> lpad(hex(b), 16, '0')), ''))").alias("bands"))
    asked = written(plausible(buckets.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), sigs, bands * rows, bits, percent), "pairs")
    within = buckets.select("node").distinct()
    sets = written(sets_of(docs, chosen.join(within, "node").select("node", "node_doc", "node_digest"), size), "sets")
    links = written(confirmed(asked, sets, percent), "links")
    done, turn = [asked], 0
    rows_in_buckets = buckets.count()
    comps = components(links)
    while True:
        placed = buckets.join(comps.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).filter("k > 1")
        opened = written(placed.join(sizes.select("key", ((F.col("n") * F.col("n") - F.col("sq")) / 2).alias("pairs"), "n"), "key").select("key", "node", "comp", "n_shingles", "pairs", "n"), "open")
        cross = opened.agg(F.sum(F.col("pairs") / F.col("n")).alias("x")).first()["x"] or 0
        last = cross <= 256 * rows_in_buckets or turn >= 12
        if not cross:
            more = None
        elif last:
            more = across(opened, blocks_of, sets, bands * rows, bits, percent)
        else:
            turn += 1
            leads = opened.groupBy("key").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn))).alias("next"))
            pairs = opened.join(leads, "key").filter("next.comp <> comp").select(F.col("next.node").alias("a"), F.col("node").alias("b"))
            more = confirmed(plausible(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sigs, bands * rows, bits, percent), sets, percent)
        done.append(opened)
        if more is not None:
            more = written(more, "links")
            if not more.isEmpty():
                joined = written(links.union(more), "links")
                dropped(links, comps)
                links = joined
                comps = components(links)
            dropped(more)
        if last:
            break
    of_node = nodes.join(comps.select("node", "comp"), "node", "left").select("digest", "first_doc", F.coalesce("comp", "node").alias("comp"))
    least = of_node.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    classes = written(of_node.join(least, "comp").select("digest", "component_id"), "classes")
    out = signs.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    out = written(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near")
    dropped(signs, nodes, chosen, buckets, sets, links, comps, classes, *done)
    return out


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
