"""A trie of conversation prefixes, where each node belongs to the smallest conversation that goes through it.

A conversation that is the smallest member of a node is so of all deeper nodes on its path, so it owns a suffix of the
path.  The words that a subtree saves are then the words of its members' turns less the words of the turns that their
owners own, and its leaves are the owners that end in a leaf: sums over the members of the node's prefix, so one group-by
of all prefixes gives every node, without walks over edges.

Turns become digests and counts of words at the scan; no text is shuffled.  A prefix is known by the exclusive or of the
hashes of its (depth, turn), 128 bits, which a running window gives; a conversation of any length is split in ranges."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.llm.ordered import before_blocks, in_blocks, word_count
from archivolt.llm.shared import table, written

NODE = ["depth", "ka", "kb"]
#: Ids that are joined to one string before they are hashed.
PIECE = 1024
#: Shares that the children of a node are dealt to where they look up its owner.
SALTS = 1024


def turns(conversations: DataFrame) -> DataFrame:
    """conversations as (conv_id, turn, digest, words, uid, block), in ranges of the order (conv_id, turn, digest)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    read = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), word_count(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("uid"))
    small = written(read, "turns")
    return in_blocks(small, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("uid")], "ordered")


def rebuilt(rows: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """steps(conv_id, block, depth, digest, words) and convs(conv_id, length, home): conversation c as the first h turns of
    c - c % family, then its own after the first h, where h = crc32(c) % most.  `home` is c's first range."""
    spans = written(rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")), "spans")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = spans.groupBy("conv_id").agg(F.sum("n").alias("own"), F.min("block").alias("home"))
    head = F.col("conv_id") - F.col("conv_id") % family
    lends = F.when(head == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    heads = own.select(F.col("conv_id").alias("head"), F.col("own").alias("has"))
    known = own.withColumn("head", head).withColumn("h", lends).join(heads, "head", "left").withColumn("k", F.least("h", F.coalesce("has", F.lit(0))))
    convs = written(known.select("conv_id", "home", "head", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), "convs")
    starts = spans.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(convs.select("conv_id", "h", "k"), "conv_id")
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "digest", "uid"))
    placed = written(rows.join(starts, ["conv_id", "block"]).select("conv_id", "block", "digest", "words", "h", "k", (F.col("ahead") + within).alias("at")), "placed")
    kept = placed.filter("at > h").select("conv_id", "block", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), "digest", "words")
    first = placed.filter(F.col("at") < most).select(F.col("conv_id").alias("head"), F.col("at").alias("depth"), "digest", "words")
    lent = convs.filter("k > 0").join(first, "head").filter("depth <= k").select("conv_id", F.lit(-1).alias("block"), "depth", "digest", "words")
    return kept.union(lent), convs.select("conv_id", "length", "home")


def keyed(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, block, depth, its key and its parent's, the words before its last turn,
    and the conversation's length, home and words."""
    # 128 bits of (depth, turn): two hashes that take the digest and the depth in another order
    marked = steps.withColumn("ka", F.xxhash64("depth", "digest")).withColumn("kb", F.xxhash64("digest", F.lit("b"), "depth"))
    sums = {"ka": F.bit_xor, "kb": F.bit_xor, "words": F.sum}
    ahead = before_blocks(marked, ["conv_id"], sums).select("conv_id", "block", *[F.col(c).alias(f"s_{c}") for c in sums])
    whole = marked.groupBy("conv_id", "block").agg(F.sum("words").alias("w")).groupBy("conv_id").agg(F.sum("w").alias("total"))
    about = convs.join(whole, "conv_id", "left").fillna(0, ["total"])
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    paths = marked.join(ahead.join(about, "conv_id"), ["conv_id", "block"]).select(
        "conv_id", "block", F.col("depth").cast("long").alias("depth"), "length", "home", "total", F.col("ka").alias("a"), F.col("kb").alias("b"),
        F.bit_xor("ka").over(upto).bitwiseXOR(F.col("s_ka")).alias("ka"), F.bit_xor("kb").over(upto).bitwiseXOR(F.col("s_kb")).alias("kb"),
        (F.col("s_words") + F.sum("words").over(upto) - F.col("words")).alias("before"),
    )
    roots = about.select("conv_id", F.lit(-2).alias("block"), F.lit(0).cast("long").alias("depth"), "length", "home", "total", *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "ka", "kb", "before")])
    every = paths.union(roots)
    return written(every.select(*[c for c in every.columns if c not in "ab"], F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb")), "prefixes")


def owned(prefixes: DataFrame) -> DataFrame:
    """For every conversation that owns nodes: the depth from which it does, the words before that, whether its end is a
    leaf, and the owner of the node above."""
    nodes = written(
        prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), (F.count(F.lit(1)) == F.count_if(F.col("depth") == F.col("length"))).alias("leaf"), F.min("before").alias("before"), F.min("pa").alias("pa"), F.min("pb").alias("pb")),
        "nodes",
    )
    top = F.min(F.struct("depth", "before", "pa", "pb")).alias("top")
    owners = nodes.groupBy(F.col("owner").alias("conv_id")).agg(top, F.max_by("leaf", "depth").alias("leaf"))
    asks = written(owners.select("conv_id", "leaf", F.col("top.depth").alias("own_from"), F.col("top.before").alias("own_before"), (F.col("top.depth") - 1).alias("depth"), F.col("top.pa").alias("ka"), F.col("top.pb").alias("kb"), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")), "owners")
    above = asks.select(*NODE, "salt").distinct().join(nodes.select(*NODE, F.col("owner").alias("above")), NODE)
    return asks.join(above, [*NODE, "salt"], "left").select("conv_id", "own_from", "own_before", "leaf", "above")


def run_hashes(batches):
    """SHA-256 of the comma-joined pieces of each node, whose rows follow each other in order."""
    key, state, out = None, None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
            if row[:3] == key:
                state.update(b"," + row[3].encode())
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = row[:3], hashlib.sha256(row[3].encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*NODE, "ends_sha256"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], [*NODE, "ends_sha256"])


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """For every node where conversations end: the hash of their ids.  Ids are joined in pieces of at most PIECE within
    their ranges, so that a node of any size is one short stream."""
    ends = prefixes.filter("depth = length").select(*NODE, "home", "conv_id")
    piece = F.floor((F.row_number().over(Window.partitionBy(*NODE, "home").orderBy("conv_id")) - 1) / PIECE)
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    pieces = ends.withColumn("piece", piece).groupBy(*NODE, "home", "piece").agg(ids.alias("ids"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "home", "piece").select(*NODE, "ids").mapInArrow(run_hashes, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The nodes of the trie over conversations(conv_id, turn, role, text), rebuilt so that members of a family share heads:
    c is the first h turns of c - c % family, then its own after its first h, with h = crc32(c) % most (most = 1: as they
    are).

    Returns, for each node, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256.  Turns follow their number, null first, ties by a digest of role and text, repeated rows after each
    other; null role or text is empty; rows with a null conv_id belong to no conversation; a conversation left without
    turns is a member of the root.  Texts of any length are hashed whole, other columns ignored; no rows give no nodes."""
    steps, convs = rebuilt(turns(conversations), family, most)
    prefixes = keyed(steps, convs)
    marks = prefixes.select("conv_id", "block").distinct().join(owned(prefixes), "conv_id", "left")
    marked = prefixes.join(marks, ["conv_id", "block"])
    shared = F.when(F.col("own_from") <= F.col("depth"), 0).otherwise(F.coalesce("own_before", "total") - F.col("before"))
    nodes = marked.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "own_from", "above")).alias("first"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("depth") < F.col("length")) & (F.col("own_from") <= F.col("depth") + 1)).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(shared).alias("saved_tokens"),
    )
    parent = F.when(F.col("depth") > 0, F.when(F.col("first.own_from") < F.col("depth"), F.col("first.conv_id")).otherwise(F.col("first.above")))
    return nodes.join(end_hashes(prefixes), NODE, "left").select(
        F.col("first.conv_id").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


TRIE_SQL = r"""
with recursive t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, digest) p from
  (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) digest
   from conversations where conv_id is not null)),
c as (select distinct conv_id, conv_id - conv_id % 20 head, case when conv_id % 20 = 0 then 0 else
  xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
                  lambda r, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::bigint[], lambda q, i: xor(q >> 1, 3988292384 * (q & 1)), xor(r, x)), 4294967295::bigint), 4294967295::bigint) % 4 end h from t),
r as (select c.conv_id, p, 0 as part, t.role, t.text from c join t on t.conv_id = c.head and p <= h and h > 0
      union all select c.conv_id, p, 1, t.role, t.text from c join t on t.conv_id = c.conv_id and p > h),
s as (select conv_id, row_number() over (partition by conv_id order by part, p) d, role, text from r),
x as (select conv_id, 0 d, '' k, '' up, 0 w from c
      union all select s.conv_id, s.d, md5(x.k || length(role)::varchar || ':' || role || text), x.k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) from s join x on x.conv_id = s.conv_id and s.d = x.d + 1),
l as (select conv_id, max(d) n from x group by 1),
n as (select d, k, any_value(up) up, min(conv_id) o, count(*) n, any_value(w) w, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = l.n), '') ends from x join l using (conv_id) group by 1, 2),
e as (select n.*, (select count(*) from n c where c.d = n.d + 1 and c.up = n.k) kids from n),
u as (select d, k, d td, k tk from n union all select c.d, c.k, u.td, u.tk from u join n c on c.up = u.k and c.d = u.d + 1),
a as (select td, tk, count(*) filter (kids = 0) leaves, sum((n - 1) * w) saved from u join e on e.d = u.d and e.k = u.k group by 1, 2)
select e.o conv_id, e.d::bigint as depth, p.o parent_conv_id, e.n n_convs, e.kids n_children, a.leaves n_leaves, a.saved::bigint saved_tokens, sha256(e.ends) ends_sha256
from e left join e p on p.d = e.d - 1 and p.k = e.up join a on a.td = e.d and a.tk = e.k"""
