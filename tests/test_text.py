import pytest
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.functions.grammar import GRAMMAR, fold_in_place
from archivolt.functions.json_repair import first_object, whole_pairs
from archivolt.operators.postprocess import NO_RULINGS, NO_SUPPORT, bodies, dated, limited, postprocessed, reference, references, supported_only


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Art. 41 de la Ley 1563 de 2012", {("ley", "1563", "2012", "41")}),
        ("articulo 404 del Codigo Penal", {("codigo_penal", None, None, "404")}),
        ("Sentencia C-355 de 2006", {("jurisprudencia", "C-355", "2006", None)}),
        ("sentencia SU 214 de 16", {("jurisprudencia", "SU-214", "2016", None)}),
        ("Ley 1480 de 2011. Art. 23.", {("estatuto_consumidor", None, None, "23")}),
        ("artículos 13, 15 y 42 de la Constitución Política", {("constitucion", None, None, a) for a in ("13", "15", "42")}),
        ("la ley 599 y el Decreto Ley 19 de 2012", {("codigo_penal", None, None, None), ("decreto", "19", "2012", None)}),
        ("nada que citar", set()),
        (None, set()),
    ],
)
def test_citations(text, expected):
    assert GRAMMAR.citations(text) == expected


def test_spans_hold_for_the_text():
    text = "Según la\tLey 1563 de 2012 y el Código Penal."
    assert len(fold_in_place(text)) == len(text)
    spans = {text[m.begin : m.end] for m in GRAMMAR.mentions(fold_in_place(text))}
    assert {"Ley 1563 de 2012", "Código Penal"} <= spans


def test_unsupported_citations_go():
    supported = bodies("Ley 1563 de 2012")
    assert supported_only("Aplica la Ley 1563 de 2012. También el artículo 5 de la Ley 100 de 1993.", supported) == (
        "Aplica la Ley 1563 de 2012. También la normativa aplicable.", ["Ley 100 de 1993"],
    )
    assert supported_only("", supported) == ("", [])
    assert dated("la Ley 1563 dice", supported) == "la Ley 1563 de 2012 dice"
    assert dated("la Ley 1563 de 2012 dice", supported) == "la Ley 1563 de 2012 dice"


def test_references_and_limits():
    passages = [{"text": "Ley 1 de 2001, artículo 2. (parte 1 de 3)\ncuerpo", "score_rerank": 0.9}, {"text": "Ley 2 de 2002 (encabezado).\nx", "score_rerank": 0.1}]
    assert reference(passages[0]["text"]) == "Ley 1 de 2001, artículo 2"
    assert references(passages, [2, 9]) == ["Ley 2 de 2002", "Ley 1 de 2001, artículo 2"]
    assert limited("Uno dos. Tres cuatro. Cinco.", 2) == "Uno dos. Tres cuatro."
    assert limited("uno dos tres cuatro", 3, 2) == "uno dos"
    out = postprocessed({"formato": "open_ended"}, {"analisis": "Es la Ley 1 de 2001."}, passages)
    assert out["jurisprudencia"] == NO_RULINGS and out["conclusion"] == "Es la Ley 1 de 2001."
    out = postprocessed({"formato": "multiple_choice", "opciones": {"A": "x", "B": "y"}}, {"respuesta_correcta": "A", "justificacion": "Sí."}, passages)
    assert out["descarte_opciones"] == {"B": NO_SUPPORT} and out["justificacion"].startswith("Sí. Fundamento normativo: ")


@pytest.mark.parametrize(
    "text, whole, pairs",
    [
        ('```json\n{"a": 1}\n```', {"a": 1}, {"a": 1}),
        ('<think>{"x": 2}</think> {"a": {"b": [1]}} tail', {"a": {"b": [1]}}, {"a": {"b": [1]}}),
        ('{"a": "x", "b": ["y"], "c": "cut', None, {"a": "x", "b": ["y"]}),
        ('{"a": 12', None, None),
        ("none", None, None),
        (None, None, None),
    ],
)
def test_json(text, whole, pairs):
    assert first_object(text) == whole
    assert whole_pairs(text) == pairs


def test_columns(spark):
    df = spark.createDataFrame([("  Ánimo  x\r\n\r\n\r\n\r\n y​ ",), ("",), (None,), ("uno dos-\ntres",)], "t string")
    got = [r[0] for r in df.select(X.normalise(df.t)).collect()]
    assert got == ["Ánimo x\n\n y\n".replace("\n y", "\ny"), "", None, "uno dos-\ntres\n"]
    assert [r[0] for r in df.select(X.joined_hyphens(df.t)).collect()][3] == "uno dostres"
    assert [r[0] for r in df.select(X.fold(df.t)).collect()][1:] == ["", None, "uno dos- tres"]
    assert [r[0] for r in df.select(X.fold_unicode(df.t)).collect()][0] == "animo x y​"
    words = spark.createDataFrame([("a b c",), ("a",)], "t string")
    assert [r[0] for r in words.select(X.tokens(words.t).alias("w")).select(X.ngrams(F.col("w"), 2)).collect()] == [["a b", "b c"], []]
    legal = spark.createDataFrame([("Artículo 1o. de la SL3385 y 240-1",)], "t string")
    assert legal.select(X.legal_tokens(legal.t, ("de", "la", "y"))).first()[0] == ["articul", "1", "sl-3385", "240-1"]


STEMS = """cheque chequ cheques chequ chica chic toreado tor torneo torne tortillas tortill trabajadoras trabaj tranquilidad tranquil
constitución constitu constituciones constitu jurisprudencia jurisprudent legalmente legal rápidamente rapid cantándole cant biología biolog biologia biologi
sigue sig sigues sig contribuyeron contribu a a el el amablemente amabl revoluciones revolu existencias existent iniciativas inici oí oi""".split()


@pytest.mark.parametrize("word, stem", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, stem):
    from archivolt.functions.stemming import stem_word

    assert stem_word(word) == stem


def test_lists_of_stems(spark):
    from archivolt.functions.stemming import stemmed

    rows = [(["leyes", "c-355", "240-1", None, "x"],), ([],), (None,), (["ñandúes", "leyes"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "w array<string>").coalesce(1).select(stemmed(F.col("w"))).collect()]
    assert got == [["ley", "c-355", "240-1", None, "x"], [], None, ["ñandu", "ley"]]


def test_spaces_and_edges(spark):
    cases = {"a\fb\x0bc": "a b c\n", "　a　\n\x1c b　": "a\nb\n", "　" * 50_000: "", "a" + "　" * 50_000 + "b": "a" + "　" * 50_000 + "b\n", "a\n\n\n\nb\r\nc": "a\n\nb\nc\n", " \n ": "", "": "", "x­y": "xy\n", None: None, "a  b": "a b\n"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(X.spaced(F.col("t"))).collect()] == list(cases.values())
    rows = {r.t for r in X.normalised(spark.createDataFrame([("é",), ("café ",), (None,)], "t string"), "t").collect()}
    assert rows == {"é\n", "café\n", None}
