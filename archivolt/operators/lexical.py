"""Lexical search: postings, corpus statistics and BM25 for whole batches of queries."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from archivolt.functions.text import tokens
from archivolt.session import materialised, work_path

K1, B = 1.5, 0.75
#: Documents of a block of postings, and blocks of a query that are scored before its threshold is known.
BLOCK, FIRST = 128, 4
#: Blocks that a task scores together: SPAN at least and WIDE times as many at most, with about LOADS tasks a core between;
#: about PACK queries meet them, and CELL sums of documents and queries are held at a time.
SPAN, WIDE, LOADS, PACK, CELL = 16, 16, 4, 1 << 14, 1 << 22


def postings(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """id, term, tf and dl (words of the text) from docs(id, text)."""
    listed = docs.select("id", (tokens(F.col("text")) if words is None else words).alias("words"))
    return listed.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverted(batches, block_rows: int, kind: pa.DataType, number: pa.DataType):
    """Blocks of postings from rows (no, id, words) in the order of no.  A row with a null term has the ids of a block's
    documents and their lengths; one for each term has, of those that hold it, the places in that list and the counts, and
    the counts and lengths that no other has at a greater count and a smaller length."""
    held, own = [], None

    def flush():
        ids, lists = (pa.concat_arrays(c) for c in zip(*held, strict=True))
        words, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        coded = words.dictionary_encode()
        pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
        terms, docs = np.divmod(pairs, len(ids))
        begins = np.flatnonzero(np.diff(terms, prepend=-1))
        # by length, a posting counts where its count is above all of its term before it
        order = np.lexsort((-counts, sizes[docs], terms))
        reached = terms[order] * (counts.max(initial=0) + 1) + counts[order]
        best = order[np.diff(np.maximum.accumulate(reached), prepend=-1) > 0]
        names = pa.concat_arrays([coded.dictionary.take(pa.array(terms[begins])), pa.array([None], pa.string())])

        def lists_of(values: np.ndarray, edges: np.ndarray, of: pa.DataType):
            made = pa.ListArray.from_arrays(pa.array(np.append(edges, len(values)).astype(np.int32)), pa.array(values).cast(of))
            return pa.concat_arrays([made, pa.array([[]], pa.list_(of))])

        whole = lambda values: pa.concat_arrays([pa.nulls(len(begins), pa.list_(values.type)), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), values)])
        tops = np.searchsorted(terms[best], terms[begins])
        columns = [names, pa.array(np.full(len(names), own)), pa.array(np.diff(begins, append=len(pairs)).tolist() + [0], pa.int32())]
        columns += [lists_of(docs, begins, number), lists_of(counts, begins, pa.int32()), lists_of(counts[best], tops, pa.int32()), lists_of(sizes[docs[best]], tops, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, whole(ids), whole(pa.array(sizes))], ["term", "block", "held", "docs", "tfs", "top_tfs", "top_dls", "ids", "dls"])

    for batch in batches:
        of = batch.column("no").to_numpy() // block_rows
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin < end:
                if held and of[begin] != own:
                    yield flush()
                    held.clear()
                own = of[begin]
                held.append((batch.column("id").slice(begin, end - begin), batch.column("words").slice(begin, end - begin)))
    if held:
        yield flush()


def save_index(docs: DataFrame, path: str, analyser=tokens, block: int = BLOCK) -> None:
    """An index of docs(id, text) below path: blocks of postings, each of `block` documents in the order they are read, as
    inverted() has them.

    Each text is read and split once, and blocks are written where it was read; nothing is shuffled.  Documents and words
    in all, document frequencies and impacts come from the blocks.  A null text has no words; ids may be repeated."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType
    listed = docs.select(F.monotonically_increasing_id().alias("no"), "id", analyser(F.col("text")).alias("words"))
    short = block <= 1 << 15
    schema = f"term string, block long, held int, docs array<{'smallint' if short else 'int'}>, tfs array<int>, top_tfs array<int>, top_dls array<bigint>, ids array<{kind.simpleString()}>, dls array<bigint>"
    made = listed.mapInArrow(partial(inverted, block_rows=block, kind=to_arrow_type(kind), number=pa.int16() if short else pa.int32()), schema)
    made.write.mode("overwrite").parquet(f"{path}/postings", compression="zstd")
    about = spark.read.schema(schema).parquet(f"{path}/postings").filter("term is null")
    n, words = F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x))
    about.agg(n.alias("n"), words.alias("words"), F.count(F.lit(1)).alias("blocks")).select("n", F.coalesce(F.try_divide("words", "n"), F.lit(0.0)).alias("avgdl"), "blocks").write.mode("overwrite").parquet(f"{path}/size")


def impact(tf, dl, avgdl):
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def index_frequency(spark: SparkSession, path: str) -> DataFrame:
    """term and df by a saved index."""
    return spark.read.parquet(f"{path}/postings").filter("term is not null").groupBy("term").agg(F.sum("held").alias("df"))


def postings_of(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The rows of a saved index with the terms of asked(term), and those with a null term, which have the documents."""
    index, terms = spark.read.parquet(f"{path}/postings"), asked.select(F.col("term").alias("asked")).distinct()
    terms = terms.union(terms.sparkSession.range(1).select(F.lit(None).cast("string")))
    return index.join(terms, F.col("term").eqNullSafe(F.col("asked")), "left_semi")


def saved_bm25(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, analyser=tokens) -> DataFrame:
    """The k best documents of each query by a saved index.

    The greatest impacts of a block's terms bound the score of its documents.  The k-th score in the blocks with the
    greatest bounds is a query's threshold, and only blocks whose bound reaches it are scored; none that could hold a better
    document is left out."""
    return search_index(spark, path, queries, k, analyser)[0]


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, analyser=tokens, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """saved_bm25() and the pairs of queries and blocks with `scored`, whether their documents were scored.

    There is no table of queries by blocks: bounds are made in the tasks where a span of blocks meets a pack of queries, and
    only the first blocks of each query, then the blocks that any query needs, leave them."""
    size = spark.read.parquet(f"{path}/size").first()
    asked = materialised(asked_terms(queries, analyser), "asked")
    top_ = F.array_max(F.zip_with("top_tfs", "top_dls", lambda tf, dl: impact(tf, dl, F.lit(size["avgdl"]))))
    held = postings_of(spark, path, asked).withColumn("top", top_)
    df = held.filter("term is not null").groupBy("term").agg(F.sum("held").alias("df"))
    idf = F.log1p((F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = materialised(asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")), "weighed")
    spans = spans_of(spark, size["blocks"])
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    best = bounds(weighed, held, spans, first=first).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= first)
    best = materialised(best.select("query_id", "block"), "best")
    # a bound is a sum in another order than the score, which is rounded: a margin of two of its last places
    least = scores(best, weighed, held, size["avgdl"], k, spans).filter(F.col("rank") == k).select("query_id", (F.col("score") - 2e-6).alias("least"))
    least = materialised(least, "least")
    needed = materialised(bounds(weighed, held, spans, least).select("block").distinct(), "needed")
    found = scores(None, weighed, held.join(needed, "block", "left_semi"), size["avgdl"], k, spans, least)
    read = bounds(weighed, held, spans).join(least, "query_id", "left").join(best.withColumn("first", F.lit(True)), ["query_id", "block"], "left")
    return found, read.select("query_id", "block", (F.col("first").isNotNull() | (F.col("bound") >= F.coalesce("least", F.lit(0.0)))).alias("scored"))


def spans_of(spark: SparkSession, blocks: int) -> int:
    """Into how many spans an index of so many blocks is dealt.  Each span meets all queries, so there are no more than keep
    the cores busy, until a span is as wide as a task may hold."""
    wide = blocks // (LOADS * spark.sparkContext.defaultParallelism)
    return 1 + blocks // max(SPAN, min(wide, WIDE * SPAN))


def packs_of(weighed: DataFrame) -> int:
    return 1 + weighed.select("query_id").distinct().count() // PACK


def meeting(weighed: DataFrame, held: DataFrame, spans: int, packs: int, pairs: DataFrame | None = None, least: DataFrame | None = None):
    """held and the queries of weighed by span and pack, for a cogroup: a query goes to every span, or where pairs has a
    block for it."""
    span, pack = F.pmod(F.xxhash64("block"), F.lit(spans)).alias("span"), F.pmod(F.xxhash64("query_id"), F.lit(packs)).alias("pack")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    words = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("words"))
    words = words.select("query_id", F.col("words.term").alias("terms"), F.col("words.weight").alias("weights"))
    if least is not None:
        words = words.join(least, "query_id", "left")
    if pairs is None:
        asked = words.select("*", pack, every(spans).alias("span"))
    else:
        asked = pairs.select("query_id", "block", span, pack).groupBy("span", "pack", "query_id").agg(F.collect_list("block").alias("blocks")).join(words, "query_id")
    dealt = held.select("*", span, every(packs).alias("pack"))
    return dealt.groupBy("span", "pack").cogroup(asked.groupBy("span", "pack"))


def bounds(weighed: DataFrame, held: DataFrame, spans: int, least: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """query_id, block and bound, from the greatest impacts of held: the first of each query in each span, or all.  With
    least(query_id, least) only blocks are returned, those that any query needs."""
    kind = weighed.schema["query_id"].dataType
    heads = held.filter("term is not null").select("term", "block", "top")
    found = meeting(weighed, heads, spans, packs_of(weighed), least=least)
    return found.applyInArrow(partial(bounds_in, first=first, kind=to_arrow_type(kind)), f"query_id {kind.simpleString()}, block long, bound double")


def scores(pairs: DataFrame | None, weighed: DataFrame, held: DataFrame, avgdl: float | None, k: int, spans: int | None = None, least: DataFrame | None = None) -> DataFrame:
    """The k best documents of the blocks of pairs(query_id, block), or of all held; without avgdl a term counts its weight
    alone.  With least(query_id, least), of the blocks of held(.., top) whose bound reaches it.

    A span of blocks and a pack of queries meet in one task, which sums up all terms of its documents and passes on the k
    best of each query, so that no row for a query and a document is shuffled but those.  As a pack holds very many
    queries, postings are dealt about once.  Of held, only the blocks of a pair are."""
    if spans is None:
        spans = 1 + held.filter("term is null").count() // SPAN
    if pairs is not None:
        held = held.join(materialised(pairs.select("block").distinct(), "blocks"), "block", "left_semi")
    kinds = {"query_id": weighed.schema["query_id"].dataType, "id": held.schema["ids"].dataType.elementType}
    schema = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items()) + ", score double"
    best = partial(best_of, k=k, avgdl=avgdl, kinds={name: to_arrow_type(kind) for name, kind in kinds.items()})
    held = held.select("term", "block", "docs", "tfs", "ids", "dls", *(["top"] if least is not None else []))
    found = meeting(weighed, held, spans, packs_of(weighed), pairs, least).applyInArrow(best, schema)
    return top(found.groupBy("query_id", "id").agg(F.round(F.sum("score"), 6).alias("score")), k)


def flat(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks().flatten()


def lengths(table: pa.Table, name: str) -> np.ndarray:
    return pc.list_value_length(table[name]).to_numpy().astype(np.int64)


def by_term(table: pa.Table, names: pa.Array) -> tuple[pa.Table, np.ndarray]:
    """The rows of the terms of names, in that order, and each one's number there."""
    found = table.filter(pc.is_in(table["term"], names)).combine_chunks()
    number = pc.index_in(found["term"], names).to_numpy().astype(np.int64)
    order = np.argsort(number, kind="stable")
    return found.take(pa.array(order)), number[order]


def add_terms(sums: np.ndarray, at: np.ndarray, value: np.ndarray, edges: np.ndarray, asked: pa.Table, names: pa.Array) -> None:
    """Adds to sums(place, query) the weight of each term of a query times its value at the places that hold it: those
    of term n are between edges n and n + 1."""
    word = pc.index_in(flat(asked, "terms"), names).to_numpy().astype(np.int64)
    by = np.argsort(word, kind="stable")
    query, weight, word = np.repeat(np.arange(asked.num_rows), lengths(asked, "terms"))[by], flat(asked, "weights").to_numpy()[by], word[by]
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    for c, d in zip(begins.tolist(), np.append(begins[1:], len(word)).tolist(), strict=True):
        a, b = edges[word[c]], edges[word[c] + 1]
        if a < b:
            sums[at[a:b, None], query[None, c:d]] += value[a:b, None] * weight[None, c:d]


def words_of(asked: pa.Table) -> pa.Array:
    found = pc.unique(flat(asked, "terms"))
    return found.take(pc.sort_indices(found))


def bounds_among(held: pa.Table, number: np.ndarray, blocks: np.ndarray, asked: pa.Table, names: pa.Array) -> np.ndarray:
    """The bound of each of the blocks, which are in order, for each query."""
    sums = np.zeros((len(blocks), asked.num_rows))
    at = np.searchsorted(blocks, held["block"].to_numpy())
    add_terms(sums, at, held["top"].to_numpy(), np.searchsorted(number, np.arange(len(names) + 1)), asked, names)
    return sums


def reached(sums: np.ndarray, asked: pa.Table) -> np.ndarray:
    return (sums > 0) & (sums >= pc.fill_null(asked["least"], 0.0).to_numpy()[None, :])


def bounds_in(held: pa.Table, asked: pa.Table, first: int | None, kind: pa.DataType) -> pa.Table:
    schema = pa.schema([("query_id", kind), ("block", pa.int64()), ("bound", pa.float64())])
    if not held.num_rows or not asked.num_rows:
        return schema.empty_table()
    names = words_of(asked)
    held, number = by_term(held, names)
    blocks = np.unique(held["block"].to_numpy())
    parts = []
    step = max(1, CELL // max(1, len(blocks)))
    for begin in range(0, asked.num_rows, step):
        part = asked.slice(begin, step).combine_chunks()
        sums = bounds_among(held, number, blocks, part, names)
        if "least" in part.column_names:
            row, column = np.flatnonzero(reached(sums, part).any(axis=1)), None
        elif first is None:
            row, column = np.nonzero(sums > 0)
        else:
            row = np.argsort(-sums, axis=0, kind="stable")[:first].ravel("F")
            column = np.repeat(np.arange(part.num_rows), min(first, len(blocks)))
            some = sums[row, column] > 0
            row, column = row[some], column[some]
        ids = pa.nulls(len(row), kind) if column is None else part["query_id"].combine_chunks().take(pa.array(column))
        bound = pa.nulls(len(row), pa.float64()) if column is None else pa.array(sums[row, column])
        parts.append(pa.table([ids, pa.array(blocks[row]), bound], schema=schema))
    return pa.concat_tables(parts)


def best_of(held: pa.Table, asked: pa.Table, k: int, avgdl: float | None, kinds: dict[str, pa.DataType]) -> pa.Table:
    """query_id, id and score (6 decimals) of the k best documents of each query among blocks of postings: asked has the
    terms and weights of each query, and the blocks in which it is asked, or the least bound of those, or neither."""
    schema = pa.schema([*kinds.items(), ("score", pa.float64())])
    if not held.num_rows or not asked.num_rows:
        return schema.empty_table()
    names = words_of(asked)
    about = held.filter(pc.is_null(held["term"])).sort_by("block").combine_chunks()
    held, number = by_term(held, names)
    # a row for each document, block after block; postings in the order of their terms
    blocks, rows_of, counts = about["block"].to_numpy(), lengths(about, "ids"), lengths(held, "docs")
    start, block = np.cumsum(rows_of) - rows_of, np.repeat(np.arange(len(blocks)), rows_of)
    coded, dl = flat(about, "ids").dictionary_encode(null_encoding="encode"), flat(about, "dls").to_numpy()
    doc = np.repeat(start[np.searchsorted(blocks, held["block"].to_numpy())].astype(np.int32), counts)
    doc += flat(held, "docs").to_numpy()
    if avgdl is None:
        value = np.ones(len(doc))
    else:
        value = flat(held, "tfs").to_numpy().astype(np.float64)
        value /= value + (K1 * (1 - B + B * dl / avgdl))[doc]
    edges = np.append(0, np.cumsum(counts))[np.searchsorted(number, np.arange(len(names) + 1))]
    ids, own = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    parts, step = [], max(1, CELL // max(1, len(block)))
    for begin in range(0, asked.num_rows, step):
        part = asked.slice(begin, step).combine_chunks()
        wanted = np.ones((len(blocks), part.num_rows), bool)
        if "blocks" in part.column_names:
            wanted[:] = False
            wanted[np.searchsorted(blocks, flat(part, "blocks").to_numpy()), np.repeat(np.arange(part.num_rows), lengths(part, "blocks"))] = True
        elif "least" in part.column_names:
            wanted = reached(bounds_among(held, number, blocks, part, names), part)
        if not wanted.any():
            continue
        total = np.zeros((len(block), part.num_rows))
        add_terms(total, doc, value, edges, part, names)
        total[~wanted[block]] = 0.0
        if len(ids) < len(own):  # the same id more than once
            summed = np.zeros((len(ids), part.num_rows))
            np.add.at(summed, own, total)
            total, of = summed, np.arange(len(ids))
        else:
            of = own
        total = np.floor(total * 1e6 + 0.5) / 1e6
        rows, columns = [], []
        for q in range(part.num_rows):
            column = total[:, q]
            some = np.flatnonzero(column > 0)
            if len(some) > k:
                some = some[column[some] >= np.partition(column[some], -k)[-k]]
            best = some[np.lexsort((place[of[some]], -column[some]))[:k]]
            rows.append(best)
            columns.append(np.full(len(best), q))
        row, column = np.concatenate(rows), np.concatenate(columns)
        parts.append(pa.table([part["query_id"].combine_chunks().take(pa.array(column)), ids.take(pa.array(of[row])), pa.array(total[row, column])], schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


def overlap(spark: SparkSession, path: str, queries: DataFrame, k: int, analyser=tokens) -> DataFrame:
    """query_id, rank, id and score: how many different words of a query a document holds, by a saved index; the k best."""
    asked = materialised(asked_terms(queries, analyser).select("query_id", "term", F.lit(1.0).alias("weight")), "asked")
    spans = spans_of(spark, spark.read.parquet(f"{path}/size").first()["blocks"])
    return scores(None, asked, postings_of(spark, path, asked), None, k, spans)


def asked_terms(queries: DataFrame, analyser=tokens) -> DataFrame:
    return queries.select(F.col("id").alias("query_id"), F.explode(analyser(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, analyser=tokens) -> DataFrame:
    """The k best documents of each query: query_id, rank, id, score (6 decimals), only positive scores, ties to the
    smaller id.  Repeated query terms add up; analyser turns a text into its terms.  By an index in the shared folder."""
    path = work_path(docs.sparkSession, "bm25")
    save_index(docs, path, analyser)
    return saved_bm25(docs.sparkSession, path, queries, k, analyser)


def top(scored: DataFrame, k: int) -> DataFrame:
    """Ranks (query_id, id, score) by score and id; partial top-k before the shuffle comes with the rank filter."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def word_frequency(words: DataFrame, docs: DataFrame) -> DataFrame:
    """word, df: the rarest token's document count; null without a token, 0 if unseen."""
    df = document_frequency(postings(docs))
    split = words.select("word", F.explode_outer(tokens(F.col("word"))).alias("term"))
    return split.join(df, "term", "left").groupBy("word").agg(F.when(F.count("term") > 0, F.min(F.coalesce("df", F.lit(0)))).alias("df"))


def rare_words(queries: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    """The n rarest words of each query in the order of the text; unseen words come last among them."""
    df = document_frequency(postings(docs))
    placed = queries.select(F.col("id").alias("query_id"), F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    first = placed.groupBy("query_id", "word").agg(F.min("pos").alias("pos")).join(df.withColumnRenamed("term", "word"), "word", "left")
    by = Window.partitionBy("query_id").orderBy(F.col("df").isNull(), "df", "pos")
    return first.withColumn("turn", F.row_number().over(by)).filter(F.col("turn") <= n).select("query_id", "pos", "word", F.coalesce("df", F.lit(0)).alias("df"))
