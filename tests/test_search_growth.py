"""What a search shuffles as its queries grow in number."""

import random

from pyspark.sql import functions as F

from archivolt.operators import lexical
from tests.test_search import plain_bm25


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_postings_are_not_shuffled_again_for_more_queries(spark, tmp_path):
    """Twenty times the queries over the same words: postings, which are most of what is shuffled, are dealt as often."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(r.choices(vocabulary, k=120))) for i in range(1500)]
    asks = [(i, " ".join(r.choices(vocabulary, k=2))) for i in range(1200)]
    d, q = (spark.createDataFrame(x, "id long, text string").coalesce(2) for x in (texts, asks))
    path = str(tmp_path / "index")
    lexical.save_index(d, path)
    for search in (lambda q: lexical.saved_bm25(spark, path, q, 5), lambda q: lexical.overlap(spark, path, q, 5)):
        cost = []
        for some in (q.filter("id < 60 or id >= 1200"), q):
            # words of all queries in both, so that the same postings are asked for
            every = some.union(spark.createDataFrame([(5000, " ".join(vocabulary))], some.schema))
            before = written(spark)
            assert search(every).agg(F.count("*")).first()[0] > 0
            cost.append(written(spark) - before)
        assert cost[1] < 2 * cost[0]


def test_tiles_of_queries_give_the_same(spark, tmp_path, monkeypatch):
    """Few sums at a time and several spans: thresholds and ties as in brute force; a block that no query needs stays."""
    monkeypatch.setattr(lexical, "SPAN", 2)
    monkeypatch.setattr(lexical, "CELL", 40)
    r = random.Random(9)
    texts = [(i, " ".join(r.choices([f"t{i // 60}_{j}" for j in range(9)], k=5) + r.choices([f"c{j}" for j in range(6)], k=6))) for i in range(480)]
    asks = [(i, f"t{i % 8}_{i % 9} t{i % 8}_1 c{i % 6}") for i in range(20)] + [(90, None), (91, "none"), (92, "c1")]
    d, q = (spark.createDataFrame(x, "id long, text string").coalesce(1) for x in (texts, asks))
    path = str(tmp_path / "index")
    lexical.save_index(d, path, block=8)
    found, blocks = lexical.search_index(spark, path, q, 4)
    assert {(x.query_id, x["rank"], x.id) for x in found.collect()} == {x[:3] for x in plain_bm25(texts, asks, 4)}
    counted = blocks.filter("query_id < 90").agg(F.count_if("scored").alias("scored"), F.count("*").alias("every")).first()
    assert counted.scored < 0.4 * counted.every
