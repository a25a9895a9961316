"""Blocks and packs of queries that are scored together."""

import pytest

from archivolt.operators import lexical
from tests.test_search import plain_bm25, some_texts


def test_spans_and_packs(spark, tmp_path, monkeypatch):
    """Small spans and packs give what one does; only the best of a span are shuffled, not a row for every posting."""
    monkeypatch.setattr(lexical, "SPAN", 3)
    monkeypatch.setattr(lexical, "PACK", 4)
    texts, queries = some_texts(6, 150), [*some_texts(16, 12), (77, "zz w1 w1 w2"), (78, "never"), (79, None)]
    d, q = (spark.createDataFrame(x, "id long, text string").repartition(2) for x in (texts, queries))
    lexical.save_index(d, str(tmp_path / "index"), block=8)
    got = {(r.query_id, r["rank"], r.id, r.score) for r in lexical.saved_bm25(spark, str(tmp_path / "index"), q, 5).collect()}
    want = plain_bm25(texts, queries, 5)
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert sorted(x[3] for x in got) == pytest.approx(sorted(x[3] for x in want), abs=2e-6)
    shared = lexical.overlap(spark, str(tmp_path / "index"), q, 4)
    words = {i: set((t or "").split()) for i, t in texts}
    want = set()
    for i, text in queries:
        best = sorted((-len(words[j] & set(text.split())), j) for j in words if words[j] & set(text.split()))[:4] if text else []
        want |= {(i, r, j, float(-n)) for r, (n, j) in enumerate(best, 1)}
    assert {(r.query_id, r["rank"], r.id, r.score) for r in shared.collect()} == want
    plan = shared._jdf.queryExecution().toString()
    assert "arrays_zip" not in plan and "CoGroups" in plan
