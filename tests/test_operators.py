import random

import pytest
from pyspark.sql import functions as F

from archivolt.config import Config
from archivolt.functions.grammar import ALIASES
from archivolt.operators import dense, evaluation, fusion, leakage, models, postprocess, reports, runs, segment, validation
from archivolt.sources import documents as sources


def plain_policy(rows, k, quota):
    """One greedy pass over (pos, doc, unit, mentioned, is_norm), then the quota."""
    unit, doc, kept = {}, {}, []
    for r in sorted(rows):
        _, d, u, mentioned, _ = r
        if unit.get((d, u), 0) >= 3 or (not mentioned and doc.get(d, 0) >= 4):
            continue
        unit[d, u] = unit.get((d, u), 0) + 1
        doc[d] = doc.get(d, 0) + 1
        kept.append(r)
    kept = kept[: 3 * k]
    head, tail = kept[:k], [r for r in kept[k:] if r[4]]
    lacking = max(0, quota - sum(r[4] for r in head))
    others = [r for r in reversed(head) if not r[4]]
    n = min(lacking, len(tail), len(others))
    return sorted([r for r in head if r not in others[:n]] + tail[:n])


def test_caps_and_quota(spark):
    rng, rows, expected = random.Random(3), [], set()
    for q in range(60):
        named = {f"d{i}": rng.random() < 0.2 for i in range(6)}
        mine = [(p, d := f"d{rng.randrange(6)}", f"u{rng.randrange(3)}", named[d], rng.random() < 0.3) for p in range(1, rng.randrange(5, 60))]
        rows += [(q, *r) for r in mine]
        expected |= {(q, r[0]) for r in plain_policy(mine, 5, 2)}
    df = spark.createDataFrame(rows, "query_id long, pos long, doc string, unit string, mentioned boolean, is_norm boolean").withColumn("complementary", F.lit(False))
    got = fusion.with_quota(fusion.diversity_caps(df), 5, 2)
    assert {(r.query_id, r.pos) for r in got.collect()} == expected
    assert fusion.quota_for(5, 5, 10) == 2


def test_slots(spark):
    q = spark.createDataFrame([(1, i, i) for i in range(1, 8)], "query_id long, id long, pos long")
    o = spark.createDataFrame([(1, "A", 1, 1), (1, "A", 20, 2), (1, "B", 20, 1), (1, "B", 21, 2)], "query_id long, letter string, id long, pos long")
    got = [(r.id, r.origin) for r in fusion.slotted(q, o, 8, 2, 2).orderBy("place").collect()]
    assert got == [(1, "question"), (2, "question"), (20, "A"), (21, "B"), (3, "question"), (4, "question"), (5, "question"), (6, "question")]


STATUTE = """LEY 10 DE 2001
Por la cual
TÍTULO I
DISPOSICIONES
ARTÍCULO 1o. Objeto. Uno.
sigue
Notas de vigencia
nota uno
ARTÍCULO 1. Objeto anterior.
viejo
Concordancias
Ley 5
CAPÍTULO II
texto suelto
Artículo 11A. Dos.
ARTÍCULO TRANSITORIO 3o. Tres.
Artículo 5 de la Ley 1 no es título"""


def test_statute(spark):
    got = segment.statute_segments(spark.createDataFrame([(1, STATUTE)], "doc_id long, text string")).orderBy("ord").collect()
    assert [(r.kind, r.article, r.section) for r in got] == [
        ("preamble", None, None), ("article", "1", "TÍTULO I DISPOSICIONES"), ("note", "1", "TÍTULO I DISPOSICIONES"), ("article", "11A", "CAPÍTULO II"), ("article", "T3", "CAPÍTULO II"),
    ]
    assert got[2].text == "Notas de vigencia\nnota uno\nARTÍCULO 1. Objeto anterior.\nviejo"
    assert got[4].text.endswith("no es título")


JUDGMENT = "Magistrado\nI. ANTECEDENTES\na\nla decisión fue\n2.1. Decisión\nCONSIDERACIONES\nb\nRESUELVE\nuno\nRESUELVE\nNotifíquese\nfirma\nSALVAMENTO DE VOTO\nc\nACLARACIÓN DE\nVOTO DE OTRO\nd"


def test_judgment(spark):
    got = segment.judgment_sections(spark.createDataFrame([(1, JUDGMENT)], "doc_id long, text string")).orderBy("block").collect()
    assert [r.section for r in got] == [None, "ANTECEDENTES", "CONSIDERACIONES", "RESUELVE", None, "SALVAMENTO DE VOTO", "ACLARACIÓN DE VOTO"]
    assert got[1].text == "I. ANTECEDENTES\na\nla decisión fue\n2.1. Decisión" and got[4].text == "Notifíquese\nfirma"


def test_article_headers(spark):
    """Every way to begin, tie and end a header, and the same numbers in running text."""
    begins = [("Artículo ", ""), ("ARTICULO\t", ""), ("art. ", ""), ("Artículo transitorio ", "T")]
    numbers, ties = ["7", "88-2", "4.3.2", "31.1-4"], [("", ""), ("º", ""), ("C", "C"), (" ter", " ter"), (". TRANSITORIO", "T")]
    lines = {}
    for begin, early in begins:
        for number in numbers:
            for tie, shown in ties:
                name = ("T" if early or shown == "T" else "") + number + (shown if shown != "T" else "")
                for end in (".", " -", ": De los ríos", "", ". De los ríos"):
                    lines[f"{begin}{number}{tie}{end}"] = name
        lines[f"{begin}7 de la Constitución"] = None
        lines[f"{begin}9876543. Largo"] = None
        lines[f"{begin}4.3 de la Constitución"] = early + "4"  # the separator is a mark
        lines[f"{begin}x"] = lines[f"del {begin}7."] = None
    lines |= {"": None, "Artículo": None, "Artículos 7.": None}
    got = spark.createDataFrame(list(lines), "string").select("value", segment.article_id(F.col("value")).alias("a")).collect()
    assert {r.value: r.a for r in got} == lines


def test_title_phrases():
    assert segment.spelled("[a|b c] {d|e f} g") == ["a d g", "a e f g", "b c d g", "b c e f g", "d g", "e f g"]
    assert segment.SECTION_OF["texto de las normas demandadas"] == "NORMA DEMANDADA" and segment.SECTION_OF["fundamentos"] == "CONSIDERACIONES" and "caso" not in segment.SECTION_OF


@pytest.mark.parametrize("passage, name", [
    ("Ley 7 de 1999, artículo 3. (parte 2 de 9)\n(x)", "Ley 7 de 1999, artículo 3"), ("Ley 7 (encabezado). [HECHOS]", "Ley 7"), ("Ley 7 (parte x de 2) (de 1999)", "Ley 7 (parte x de 2) (de 1999)"),
    ("[A] [B] Ley 7 [C", "Ley 7 [C"), ("", ""), ("...", ""),
])
def test_references(spark, passage, name):
    assert postprocess.reference(passage) == name
    assert spark.createDataFrame([(passage,)], "t string").select(postprocess.passage_reference(F.col("t"))).first()[0] == name


def test_windows(spark):
    def windows(*lines):
        return spark.createDataFrame([("\n".join(lines),)], "t string").select(segment.windows_of("t")).first()[0]

    assert [len(w.split()) for w in windows(*["p " * 100] * 6)] == [300, 300]
    cut = windows(" ".join(map(str, range(1000))))
    assert [w.split()[0] for w in cut] == ["0", "255", "510", "765"] and cut[-1].split()[-1] == "999"
    carried = windows("a " * 280, "b " * 20, "c " * 100)
    assert carried[1].split()[0] == "b" and windows() == [] and windows("", " \u3000 ") == []
    assert spark.createDataFrame([(None,)], "t string").select(segment.windows_of("t")).first()[0] == []


def test_slots_with_caps(spark):
    """Documents have two places unless mentioned, complementary ones one; norms come up by their quota."""
    schema = "query_id long, id long, pos long, doc string, mentioned boolean, complementary boolean, is_norm boolean"
    q = spark.createDataFrame([(1, i, i, "a" if i < 5 else "b", False, False, i in (6, 7)) for i in range(1, 9)], schema)
    o = spark.createDataFrame([(1, "A", 1, 30, "a", True, False), (1, "A", 2, 31, "c", False, True), (1, "B", 1, 32, "d", False, True), (1, "B", 2, 33, "a", False, False), (2, "A", 1, 40, "x", False, False)], "query_id long, letter string, pos long, id long, doc string, mentioned boolean, complementary boolean")
    found = fusion.slotted(q, o, 10, 4, 2, per_document=2, complementary=1).orderBy("query_id", "place").collect()
    assert [(r.id, r.origin) for r in found if r.query_id == 1] == [(1, "question"), (2, "question"), (6, "question"), (7, "question"), (30, "A"), (32, "B")]
    assert [(r.id, r.origin) for r in found if r.query_id == 2] == [(40, "A")]
    assert "Python" not in fusion.slotted(q, o)._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_literal(spark):
    docs = spark.createDataFrame([(1, "ley", "Ley 10 de 2001", STATUTE), (2, "sentencia", "Sentencia C-1 de 2002", JUDGMENT), (3, "circular", "Circular 1 de 2003", "sin artículos\nsolo texto")], "doc_id long, type string, name string, text string")
    got = segment.chunks(docs).collect()
    for doc in {r.doc_id for r in got}:
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.begin)
        whole = "\n\n".join(r.text for r in mine)
        assert all(whole[r.begin : r.end] == r.text for r in mine)
        assert [r.chunk_id for r in mine] == [f"{doc}#{i:05d}" for i in range(len(mine))]
    assert all(r.text.startswith(("Ley 10 de 2001", "Sentencia C-1", "Circular 1")) for r in got)


def test_names(spark):
    rows = [("constitucion", "x", None, None, None), ("codigo", "Código Penal", "599", "2000", None), ("codigo", "Código Civil", None, None, None), ("sentencia", "t", "C-1", "2002", "Corte"), ("ley", "Ley 5 de 1992", "5", "1992", None), ("ley", "Estatuto de algo", "5", "1992", None), ("concepto", "Concepto 3", None, None, None)]
    df = spark.createDataFrame(rows, "k string, t string, n string, y string, i string")
    name = segment.canonical_name(*[F.col(c) for c in "ktnyi"], ALIASES)
    assert [r[0] for r in df.select(name).collect()] == [
        "Constitución Política de Colombia", "Código Penal (Ley 599 de 2000)", "Código Civil", "Sentencia C-1 de 2002 de la Corte", "Ley 5 de 1992", "Estatuto de algo (Ley 5 de 1992)", "Concepto 3",
    ]


def test_leakage_guard(spark):
    words = [f"w{i}" for i in range(40)]
    q = spark.createDataFrame([(1, " ".join(words[:14])), (2, "otra cosa distinta")], "id long, text string")
    a = spark.createDataFrame([(1, " ".join(words[20:32])), (2, "sin")], "id long, text string")
    c = spark.createDataFrame([(10, " ".join(words)), (11, " ".join(words[:8])), (12, "limpio")], "id long, text string")
    got = {r.chunk_id: r.severity for r in leakage.severity(q, a, c).collect()}
    assert got == {10: "grave", 11: "review"}
    with pytest.raises(ValueError):
        leakage.guard(leakage.severity(q, a, c))


def test_inventory(spark, tmp_path):
    head = "doc_id,archivo,titulo,tipo,numero,anio,organo_emisor,fuente,url,fecha_consulta,areas,vigencia,notas"
    bad = "MAL ID,a,t,cosa,,12,o,f,ftp://x,2024-13-01,x|y,quizas,"
    good = "ley-1,a,t,ley,1,2001,o,f,https://x,2024-01-31,civil,vigente,"
    for sep, mark in ((",", ""), (";", "﻿")):
        path = tmp_path / f"inv{ord(sep)}.csv"
        path.write_text(mark + "\n".join(x.replace(",", sep) for x in (head, bad, good)), encoding="utf-8")
        rows = sources.read_inventory(spark, str(path))
        assert rows.columns == head.split(",")
        checked = validation.with_errors(rows, validation.inventory_rules(["civil", "penal"]))
        errors = {r.doc_id: r.errors for r in checked.collect()}
        assert errors["ley-1"] == [] and set(errors["MAL ID"]) == {"doc_id_form", "tipo_unknown", "anio_form", "url_form", "fecha_form", "areas_unknown", "vigencia_unknown"}
        assert validation.clean(checked).count() == 1
    assert validation.missing_columns(rows.drop("url"), ["url"], head.split(",")) == (["url"], [])


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.html").write_text("<html><head><title>t</title></head><body><nav>menu</nav><p>Uno &amp; dos</p><table><tr><td>x</td><td>y</td></tr></table></body></html>")
    (tmp_path / "b.txt").write_bytes("caf\xe9 guion-\nes".encode("windows-1252"))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>Hola</w:t></w:p><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:document>")
        z.writestr("word/footnotes.xml", '<w:footnotes><w:footnote w:type="separator" w:id="0"><w:t>-</w:t></w:footnote><w:footnote w:id="2"><w:t>nota</w:t></w:footnote></w:footnotes>')
    (tmp_path / "e.jpg").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert got["a.html"].text == "Uno & dos\n\nx y\n" and got["b.txt"].text == "café guiones\n"
    assert got["c.docx"].error and got["d.docx"].text == "Hola\na b\n[2] nota\n" and got["e.jpg"].problem == "unsupported"
    joined = sources.joined_files(sources.read_files(spark, str(tmp_path)), F.lit("all")).first()
    assert joined.files == 3 and joined.text.startswith("Uno & dos")


def test_runs(spark):
    items = spark.createDataFrame([(i,) for i in range(17)], "id long")
    parts = [{r.id for r in runs.stride_part(items, "id", k, 3).collect()} for k in (1, 2, 3)]
    assert set.union(*parts) == set(range(17)) and sum(map(len, parts)) == 17
    assert [r.id for r in runs.position_range(items, "id", 16, 99).orderBy("id").collect()] == [15, 16]
    for bad in (lambda: runs.stride_part(items, "id", 0, 3), lambda: runs.position_range(items, "id", 3, 2)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        runs.overlaid(items.withColumn("v", F.lit(1)), spark.createDataFrame([(99, 2)], "id long, v int"))
    both, twice = runs.merged(items, items.filter("id < 2"))
    assert both.count() == 19 and twice.count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, expected string, given string, abstained boolean, answered boolean, right boolean, score double")
    assert evaluation.closed_accuracy(none.select("id", "expected"), none.select("id", "given", "abstained")).first().accuracy == 0
    assert evaluation.selective_confusion(none).first().calibration == 0 and evaluation.judge_mean(none).first().correctness == 0
    assert runs.placed(none.select("id"), "id").count() == 0


def test_models(spark):
    texts = spark.createDataFrame([("ley de aguas",), (None,)], "text string")
    rows = models.embedded(texts, models.HashedWords).collect()
    assert len(rows[0].vec) == 64 and abs(sum(x * x for x in rows[0].vec) - 1) < 1e-5
    assert models.reranked(spark.createDataFrame([("la ley", "ley 1")], "question string, text string")).first().rerank == 0.5

    def calls(question, texts):  # how many texts came together
        return [len(texts) / 10] * len(texts)

    many = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", None), (None, "z"), ("a", "x")], "question string, text string").coalesce(1)
    assert sorted((r.question or "", r.rerank) for r in models.reranked(many, calls).collect()) == [("", 0.1), ("a", 0.3), ("a", 0.3), ("a", 0.3), ("b", 0.1)]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "id long, vec array<double>")
    assert [r.id for r in dense.dense_topk(q, v, 4).orderBy("rank").collect()] == [2, 5, 8, 1]


def test_config():
    c = Config.load({"ARCHIVOLT_TOP_K": "5", "ARCHIVOLT_QUOTA": " ", "ARCHIVOLT_API_KEY": "s"})
    assert c.top_k == 5 and c.quota == 4 and c.shown()["api_key"] == "***"
    c.check()
    with pytest.raises(ValueError):
        Config(temperature=0.1).check()


def test_blocks_and_fingerprint(spark):
    text = "a\n<!-- AUTO:x -->old<!-- /AUTO:x -->\nb"
    once = reports.with_block(text, "x", "new")
    assert reports.with_block(once, "x", "new") == once and "old" not in once
    with pytest.raises(ValueError):
        reports.with_block(text, "y", "")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    assert sources.fingerprint(df) == sources.fingerprint(df.orderBy(F.desc("id"))) != sources.fingerprint(df.limit(1))
    assert reports.markdown_table(df, ["id", "t"]).splitlines()[2:] == ["| 1 | a |", "| 2 |  |"]
