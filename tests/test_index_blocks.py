"""What the saved index of postings holds, and what a search moves of it."""

import glob
import os

from pyspark.sql import functions as F

from archivolt.operators import lexical
from tests.test_search import some_texts


def test_blocks_are_written_once_with_places_and_tops(spark, tmp_path):
    """Postings are written where texts are read, each as a place and a count; the tops kept give the greatest impact of all
    postings for any average length."""
    d = spark.createDataFrame(some_texts(4, 200), "id long, text string").repartition(3)
    lexical.save_index(d, str(tmp_path / "index"), block=16)
    assert sorted(map(os.path.basename, glob.glob(str(tmp_path / "index" / "*")))) == ["postings", "size"]
    rows = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert dict(rows.dtypes)["docs"] == "array<smallint>"
    found = rows.collect()
    about = {r.block: r for r in found if r.term is None}
    assert sorted(i for r in about.values() for i in r.ids) == sorted(i for i, _ in some_texts(4, 200))
    for r in found:
        if r.term is not None:
            assert r.held == len(r.docs) == len(r.tfs) and r.ids is None and r.dls is None
            assert len(r.top_tfs) <= r.held
            for avgdl in (0.5, 17.0, 900.0):
                best = max(lexical.impact(tf, about[r.block].dls[at], avgdl) for at, tf in zip(r.docs, r.tfs, strict=True))
                assert best == max(lexical.impact(tf, dl, avgdl) for tf, dl in zip(r.top_tfs, r.top_dls, strict=True))


def test_only_blocks_of_a_pair_are_dealt(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame(some_texts(4, 200), "id long, text string").coalesce(1)
    lexical.save_index(d, str(tmp_path / "index"), block=8)
    asked = spark.createDataFrame([(1, "w1", 1.0), (1, "w2", 1.0)], "query_id long, term string, weight double")
    held = lexical.postings_of(spark, str(tmp_path / "index"), asked)
    monkeypatch.setattr(lexical, "SPAN", 1)
    pairs = spark.createDataFrame([(1, 0), (1, 5)], "query_id long, block long")
    one = lexical.scores(pairs, asked, held, None, 1000).join(held.select("block", F.explode("ids").alias("id")), "id")
    assert {r.block for r in one.select("block").distinct().collect()} <= {0, 5}
    joins = lexical.scores(pairs, asked, held, None, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (block" in joins
