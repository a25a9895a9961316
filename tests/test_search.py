"""The postings index and dense search against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.operators import dense, lexical

K1, B = 1.5, 0.75


def plain_bm25(docs, queries, k):
    words = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in docs]
    n, avgdl = len(words), sum(len(w) for _, w in words) / max(1, len(words))
    df = collections.Counter(t for _, w in words for t in set(w))
    out = set()
    for q, text in queries:
        asked = collections.Counter(re.findall(r"\w+", (text or "").lower()))
        scored = collections.Counter()
        for i, w in words:
            tf = collections.Counter(w)
            for t, times in asked.items():
                if tf[t]:
                    scored[i] += times * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] / (tf[t] + K1 * (1 - B + B * len(w) / avgdl))
        best = sorted((-round(s, 6), i) for i, s in scored.items() if round(s, 6) > 0)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def some_texts(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(3000)]
    texts = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 3, 20, 60])))) for i in range(n)]
    return texts + [(1000, None), (1001, ""), (1002, "same words"), (1003, "same words"), (1004, "zz " * 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bm25_by_blocks(spark, tmp_path, seed):
    texts = some_texts(seed)
    queries = [(i, t) for i, t in some_texts(seed + 9, 25)] + [(77, "zz w1 w1 w2"), (78, "never"), (79, None)]
    d, q = (spark.createDataFrame(x, "id long, text string").repartition(3) for x in (texts, queries))
    path = str(tmp_path / "index")
    lexical.save_index(d, path, block=8)
    found, blocks = lexical.search_index(spark, path, q, 5, first=1)
    got = {(r.query_id, r["rank"], r.id, r.score) for r in found.collect()}
    want = plain_bm25(texts, queries, 5)
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert sorted(x[3] for x in got) == pytest.approx(sorted(x[3] for x in want), abs=2e-6)
    assert blocks.filter("not scored").count() > 0
    df = {r.term: r.df for r in lexical.index_frequency(spark, path).collect()}
    assert df == collections.Counter(t for _, text in texts for t in set(re.findall(r"\w+", text or "")))


def test_blocks_of_other_topics_are_left_out(spark, tmp_path):
    """Texts of ten topics, which share common words: a question about one is answered from its blocks."""
    r = random.Random(5)
    texts = [(i, " ".join(r.choices([f"topic{i // 100}_{j}" for j in range(30)], k=8) + r.choices([f"common{j}" for j in range(20)], k=30))) for i in range(1000)]
    queries = [(t, f"topic{t}_1 topic{t}_2 common1 common2") for t in range(10)]
    d, q = (spark.createDataFrame(x, "id long, text string").coalesce(1) for x in (texts, queries))
    lexical.save_index(d, str(tmp_path / "index"), block=16)
    found, blocks = lexical.search_index(spark, str(tmp_path / "index"), q, 5)
    assert {(x.query_id, x["rank"], x.id) for x in found.collect()} == {x[:3] for x in plain_bm25(texts, queries, 5)}
    counted = blocks.agg(F.count_if("scored").alias("scored"), F.count("*").alias("every")).first()
    assert counted.scored < 0.2 * counted.every


def test_index_of_texts_with_other_ids_and_of_none(spark, tmp_path):
    d = spark.createDataFrame([("a", "uno dos"), ("b", "dos dos")], "id string, text string")
    q = spark.createDataFrame([("q", "dos")], "id string, text string")
    assert [(r.query_id, r.id) for r in lexical.bm25(d, q).orderBy("rank").collect()] == [("q", "b"), ("q", "a")]
    assert lexical.bm25(d.limit(0), q).count() == 0 and lexical.bm25(d, q.limit(0)).count() == 0


def test_index_reads_a_text_once(spark, tmp_path):
    """The scan of the texts has one tokenizer in its plan, and the search none for the documents."""
    d = spark.createDataFrame(some_texts(3), "id long, text string")
    d.write.parquet(str(tmp_path / "texts"))
    read = spark.read.parquet(str(tmp_path / "texts"))
    lexical.save_index(read, str(tmp_path / "index"))
    found = lexical.saved_bm25(spark, str(tmp_path / "index"), d.limit(3))
    assert str(tmp_path / "texts") not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("cell_bytes", [None, 2000])
def test_dense_grid(spark, cell_bytes):
    r = np.random.default_rng(4)
    base = r.standard_normal((90, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(200 + i, base[0].tolist()) for i in range(40)] + [(500, None)]
    v = spark.createDataFrame(rows, "id long, vec array<float>").repartition(5)
    q = v.filter("id < 60 or id = 500").withColumnRenamed("id", "query_id")
    found = dense.dense_topk(q, v, 4, cell_bytes=cell_bytes)
    got = sorted((x.query_id, x["rank"], x.id, x.score) for x in found.collect())
    want = []
    held = [(i, np.array(x, float)) for i, x in rows if x is not None]
    for i, x in held:
        if i < 60:
            best = sorted((-float(dense.rounded(x @ y, 8)), j) for j, y in held)[:4]
            again = sorted((-float(dense.rounded(np.float64(-s), 5)), j) for s, j in best)
            want += [(i, n, j, -s) for n, (s, j) in enumerate(again, 1)]
    assert got == sorted(want)


def test_dense_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<float>")
    assert dense.dense_topk(none.withColumnRenamed("id", "query_id"), none, 3).count() == 0
    some = spark.createDataFrame([(1, [1.0])], "id long, vec array<float>")
    assert dense.dense_topk(some.withColumnRenamed("id", "query_id"), none, 3).count() == 0
