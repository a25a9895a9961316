"""The file source, the committed sink, the stream of answers and saved tables."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from archivolt.sources import committed
from archivolt.sources import documents as sources
from archivolt.sources import files as scans
from archivolt.streaming import resume


def names(root):
    return sorted(f for _, _, found in os.walk(root) for f in found if not f.startswith((".", "_")))


def some_files(at):
    (at / "sub").mkdir(parents=True)
    (at / "a.html").write_text("<html><head><title>t</title></head><body><nav>m</nav><p>Uno &amp; dos</p></body></html>")
    (at / "sub" / "B.TXT").write_bytes("\ufeffcaf\u00e9".encode())
    (at / "sub" / "latin.txt").write_bytes("caf\u00e9 \u201csí\u201d".encode("windows-1252"))
    (at / "c.docx").write_bytes(b"broken")
    (at / "e.jpg").write_bytes(b"x")
    (at / "empty.txt").write_text("  \n")
    (at / "p.pdf").write_bytes(b"%PDF")
    (at / ".hidden").write_text("x")
    with zipfile.ZipFile(at / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>Hola</w:t></w:p></w:document>")


def test_scan(spark, tmp_path):
    some_files(tmp_path)
    got = {r.path.rsplit("/", 1)[1]: r for r in scans.scan(spark, str(tmp_path)).collect()}
    assert {k: r.problem for k, r in got.items()} == {"a.html": None, "B.TXT": None, "latin.txt": None, "c.docx": "damaged", "e.jpg": "unsupported", "empty.txt": "empty", "p.pdf": "damaged", "d.docx": None}
    assert got["a.html"].text == "\nUno & dos\n" and got["B.TXT"].text == "café" and got["latin.txt"].text == "café “sí”" and got["d.docx"].text == "Hola"
    assert "no reader of PDF" in got["p.pdf"].error and got["e.jpg"].extension == ".jpg" and got["c.docx"].bytes == 6
    assert {r.problem for r in scans.scan(spark, f"file://{tmp_path}", unknown="skip").collect()} == {None, "damaged", "empty"}
    one = scans.scan(spark, str(tmp_path / "a.html")).collect()
    assert len(one) == 1 and one[0].extension == ".html"
    assert [r.problem for r in scans.scan(spark, str(tmp_path / "e.jpg")).collect()] == ["unsupported"]


def test_scan_deals_by_size(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.txt").write_text("x" * 50_000)
    df = scans.scan(spark, str(tmp_path), taskBytes=200_000)
    assert df.rdd.getNumPartitions() == 7 and df.count() == 20  # three files a task
    assert scans.dealt([("big", 10**9), ("a", 1), ("b", 1)], 1000)[0].files == [("big", 10**9)]


def test_scan_opens_no_file_that_a_filter_leaves_out(spark, tmp_path):
    some_files(tmp_path)
    os.chmod(tmp_path / "a.html", 0o644)
    reader = scans.FilesReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    other = GreaterThan(("bytes",), 3)
    assert list(reader.pushFilters([In(("extension",), (".html", ".docx")), other, EqualTo(("extension",), ".html")])) == [other]
    assert [f[0].rsplit("/", 1)[1] for p in reader.partitions() for f in p.files] == ["a.html"]
    df = scans.scan(spark, str(tmp_path)).filter("extension in ('.html', '.txt')")
    assert df.count() == 4 and "extension" not in df._jdf.queryExecution().executedPlan().toString().split("Filter (")[-1].split(")")[0]


def test_scan_of_nothing(spark, tmp_path):
    assert scans.scan(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        scans.scan(spark, str(tmp_path / "nowhere")).count()


def pages_of(content):
    return [content.decode(), "two"]


def test_scan_takes_a_reader_of_pages(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"one")
    found = sources.read_files(spark, str(tmp_path), pdf_pages="tests.test_storage:pages_of").collect()
    assert found[0].problem is None and "one" in found[0].text and "two" in found[0].text


def test_decoded(spark):
    every = bytes(range(256))
    cases = [b"", b"caf\xc3\xa9", b"caf\xe9 \x80\x93", b"\xef\xbb\xbfx", b"\xef\xbb\xbf\xe9", every, None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c binary").select(sources.decoded(F.col("c"))).collect()]
    assert got == [None if c is None else sources.as_text(c) for c in cases]


# ---------------------------------------------------------------- committed outputs


def test_committed_texts(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(i, f"text {i}\r\nñ") for i in range(50)] + [(100, None), (101, "")], "doc_id long, text string")
    committed.save(rows.repartition(4), path)
    assert {(r.doc_id, r.text) for r in committed.load(spark, path).collect()} == {(str(r.doc_id), r.text or "") for r in rows.collect()}
    committed.save(rows.limit(3).withColumn("text", F.lit("new")), path)
    assert names(path) == ["0.txt", "1.txt", "2.txt"]  # the stale ones went
    committed.save(spark.createDataFrame([("a/b ..", "x")], "doc_id string, text string"), path, mode="append")
    assert {r.doc_id for r in committed.load(spark, path).collect()} == {"0", "1", "2", "a/b .."} and len(names(path)) == 4


@pytest.mark.parametrize("layout", ["texts", "lines"])
def test_a_failed_task_leaves_the_old_output_whole(spark, tmp_path, layout):
    path = str(tmp_path / "out")
    old = spark.createDataFrame([(i, "old") for i in range(20)], "doc_id long, text string")
    committed.save(old, path, layout=layout)
    before = names(path)

    def broken(batches):
        for at, batch in enumerate(batches):
            yield batch
            if batch.num_rows:
                raise RuntimeError("in mid-write")

    new = old.withColumn("text", F.lit("new")).repartition(4).mapInArrow(broken, old.schema)
    with pytest.raises(Exception, match="in mid-write"):
        committed.save(new, path, layout=layout)
    assert names(path) == before
    assert {r.text for r in committed.load(spark, path, "doc_id long, text string").collect()} == {"old"}
    committed.save(old.withColumn("text", F.lit("third")), path, layout=layout)
    assert {r.text for r in committed.load(spark, path, "doc_id long, text string").collect()} == {"third"} and len(names(path)) == len(before)


def test_attempts_that_were_not_committed_are_not_read(spark, tmp_path):
    path = tmp_path / "out"
    committed.save(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(path))
    late = path / "run-late" / "0-x-0"
    late.mkdir(parents=True)
    (late / "2.txt").write_text("late")
    assert [r.doc_id for r in committed.load(spark, str(path)).collect()] == ["1"]
    with pytest.raises(Exception, match="no committed output"):
        committed.load(spark, str(tmp_path / "other")).collect()


def test_committed_lines_of_any_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(committed, "FOLDER", 300)
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(i, f"ñ \u2028 {i}", [i, None], None) for i in range(30)], "id long, t string, xs array<long>, nothing string")
    committed.save(rows.coalesce(1), path, layout="lines")
    got = committed.load(spark, path, "id long, t string, xs array<long>, nothing string")
    assert sorted(got.collect()) == sorted(rows.collect())
    committed.save(rows.limit(0), path, layout="lines")
    assert got.sparkSession.read.format("committed").schema(rows.schema).load(path).count() == 0


def test_a_document_without_an_id_ends_the_write(spark, tmp_path):
    with pytest.raises(Exception, match="without doc_id"):
        committed.save(spark.createDataFrame([(None, "x")], "doc_id string, text string"), str(tmp_path / "out"))


# ---------------------------------------------------------------- the stream


def test_stream_replaces_a_batch_that_was_cut_off(spark, tmp_path):
    q, out, ck = tmp_path / "q", tmp_path / "out", tmp_path / "ck"
    q.mkdir()
    (q / "0.json").write_text("\n".join(json.dumps({"id": i}) for i in (1, 2, 2, None)))

    def breaks(batch):
        out.mkdir(exist_ok=True)
        (out / "batch=0").mkdir()
        (out / "batch=0" / "part-half.json").write_text('{"id": 1, "answer": "half"}\n')
        raise RuntimeError("cut off")

    run = lambda answer, done=None: resume.answer_new(spark, str(q), "id long", str(out), str(ck), answer, done, files=1)
    with pytest.raises(Exception, match="cut off"):
        run(breaks)
    whole = lambda batch: batch.withColumn("answer", F.lit("x"))
    run(whole)
    (q / "1.json").write_text("\n".join(json.dumps({"id": i}) for i in (2, 3, 4)))
    (q / "2.json").write_text("\n".join(json.dumps({"id": i}) for i in (4, 5, 6)))
    seen = run(whole, spark.createDataFrame([(6,)], "id long"))
    got = sorted((r.id, r.answer) for r in resume.answers(spark, str(out), "id long, answer string").collect())
    assert got == [(i, "x") for i in (1, 2, 3, 4, 5)]
    assert seen["questions"] >= 6
    assert run(whole)["questions"] == 0


# ---------------------------------------------------------------- saved caches, hash trees, spans


def test_bucketed_cache(spark, tmp_path):
    from archivolt.sources.saved_cache import BucketedCache

    cache = BucketedCache(spark, f"file://{tmp_path}/cache", "size int", 4)
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "key string")
    assert sorted(r.key for r in cache.misses(rows).collect()) == ["a", "b"]
    cache.append(cache.misses(rows).withColumn("size", F.lit(1)), 1)
    more = spark.createDataFrame([("b",), ("c",)], "key string")
    assert [r.key for r in cache.misses(more).collect()] == ["c"]
    cache.append(more.withColumn("size", F.lit(2)), 2)  # b twice: the first stays
    cache.compact()
    assert sorted((r.key, r.size) for r in cache.table().collect()) == [("a", 1), ("b", 1), ("c", 2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cache.found(spark.createDataFrame([("a",), ("z",), (None,)], "key string"))
        assert sorted(((r.key or "", r.size) for r in found.collect()), key=str) == sorted([("a", 1), ("z", None), ("", None)], key=str)
        plan = cache.found(more)._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") <= 1, plan  # of the asked rows only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hash_trees(spark, tmp_path):
    import hashlib

    from archivolt.sources import hash_tree

    contents = {"a": b"x" * 1000, "b": b"", "c": bytes(range(256)) * 3}
    (tmp_path / "one").mkdir()
    for name, content in contents.items():
        (tmp_path / "one" / name).write_bytes(content)
    found = hash_tree.leaves(spark, str(tmp_path / "one"), 100)
    hashed = sorted((r.path.rsplit("/", 1)[1], r.offset, r.hash) for r in found.collect())
    assert hashed == sorted((n, o, hashlib.sha256(c[o : o + 100]).hexdigest()) for n, c in contents.items() for o in range(0, max(1, len(c)), 100))

    def root(content, fan):
        level = [hashlib.sha256(content[o : o + 100]).hexdigest() for o in range(0, max(1, len(content)), 100)]
        most = 10  # ranges of the largest file
        while True:
            level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
            most = -(-most // fan)
            if most <= 1:
                return level[0]

    for fan in (3, 1024):
        assert {r.path.rsplit("/", 1)[1]: (r.ranges, r.root) for r in hash_tree.roots(found, fan).collect()} == {n: (max(1, -(-len(c) // 100)), root(c, fan)) for n, c in contents.items()}
    named = lambda df: df.withColumn("path", F.substring_index("path", "/", -1))
    before = spark.createDataFrame(hashed, "path string, offset long, hash string")
    (tmp_path / "one" / "a").write_bytes(b"x" * 150 + b"y" + b"x" * 900)
    (tmp_path / "one" / "b").unlink()
    changed = hash_tree.changed_ranges(before, named(hash_tree.leaves(spark, str(tmp_path / "one"), 100))).collect()
    assert {(r.path, r.offset, r.problem) for r in changed} == {("a", 100, "changed"), ("a", 1000, "extra"), ("b", 0, "missing")}


def test_spans(spark):
    from archivolt.operators import spans

    rows = [(1, 0, 5, "a"), (1, 3, 9, "b"), (1, 9, 12, "a"), (1, 14, 15, "c"), (1, 1, 2, "a"), (2, 4, 6, "z")]
    runs = spans.merged(spark.createDataFrame(rows, "id long, begin int, end int, body string"))
    assert sorted((r.id, r.begin, r.end, r.bodies) for r in runs.collect()) == [(1, 0, 12, ["a", "b"]), (1, 14, 15, ["c"]), (2, 4, 6, ["z"])]
    texts = spark.createDataFrame([(1, "ñ23456789012 4x6"), (2, "0123456"), (3, "nothing"), (4, None)], "id long, text string")
    assert {r.id: r.text for r in spans.spliced(texts, runs, F.lit("_")).collect()} == {1: "_ 4_6", 2: "0123_6", 3: "nothing", 4: None}
    found = spans.located(spark.createDataFrame([(1, "Ley 5 de 2001; ley 5 de 2001"), (2, "nada"), (3, None), (4, "café ley 7 de 1990")], "id long, text string")).collect()
    assert sorted((r.id, r.body) for r in found) == [(1, "ley|5|2001"), (1, "ley|5|2001"), (4, "ley|7|1990")]


def test_gate_lets_all_citations_through(spark):
    from archivolt.functions.grammar import CODES, GRAMMAR, extract_citations, gate

    texts = [p.upper() for ps in CODES.values() for p in ps] + ["LÉY 5 DE 2001", "Léy 5 de 2001", "resolución nº 5 de 2001", "Cо́digo", "C-1 de 2001", "nada", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.g, r.c) for r in df.select("id", gate(F.col("text")).alias("g"), F.size(extract_citations("text")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert (got[i][1] if got[i][1] is not None and got[i][1] > 0 else 0) == len(GRAMMAR.citations(t))
    assert not got[len(texts) - 2][0]


def test_delivered(spark, tmp_path):
    from archivolt.operators import validation

    lines = spark.createDataFrame([(1, "multiple_choice", 11, False), (None, "x", 2, True), (1, None, None, None)], "id long, formato string, n_passages int, abstencion boolean")
    assert validation.delivered(lines, str(tmp_path / "out")) == {"lines": 3, "without_id": 1, "over_ten": 1, "abstentions": 1, "unknown_format": 2}
    expected = spark.createDataFrame([(1, "semi_open"), (2, "semi_open")], "id long, formato string")
    row = validation.delivery(lines, expected).first().asDict()
    assert row == {"lines": 3, "over_ten": 1, "abstentions": 1, "repeated": 1, "missing": 1, "extra": 1, "wrong_format": 2}
    plan = validation.delivery(lines, expected)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2
