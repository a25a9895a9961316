"""Text functions as column expressions; what SQL cannot say is a pandas UDF."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.functions.grammar import CHAMBERS
from archivolt.functions.stemming import stemmed

#: Accented Latin letters and what they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

#: What becomes a space, what is trimmed off lines, and what can't be seen.
SPACES = "\u00a0\u2007\u202f\t\f\x0b"
EDGE = r"\x{1c}-\x{1f}\x{85} \x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}"
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

WORD = r"[\p{L}\p{N}_]+"


def lowered(text: Column) -> Column:
    """Lower case by single characters: the JVM makes two of a capital I with a dot, and looks around a sigma."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents; the length stays the same, so offsets stay true."""
    return F.translate(text, ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Lower case, no accents, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(lowered(fold_accents(text)), r"[ \t\n\r\f\x0B]+", " "))


def same_length_fold(text: Column) -> Column:
    return lowered(fold_accents(F.regexp_replace(text, r"[ \t\n\r\f\x0B]", " ")))


#: Texts of these characters alone are folded by fold(): ASCII and the letters it knows.
FOLDED_IN_JVM = rf"^[\x{{0}}-\x{{1B}}\x{{20}}-\x{{7E}}{ACCENTED}]*$"


@F.arrow_udf(T.StringType())
def unmarked(texts: pa.Array) -> pa.Array:
    """Lower case without combining marks after canonical decomposition, with single spaces and none at the ends."""
    def one(text: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        return " ".join(bare.lower().split())

    return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())


def fold_unicode(text: Column | str) -> Column:
    """Like fold, for every script; only texts of other characters than fold() knows leave the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(FOLDED_IN_JVM), fold(text)).otherwise(unmarked(F.when(~text.rlike(FOLDED_IN_JVM), text)))


#: A text of these characters alone is in composed form already.
COMPOSED = r"^[\x{0}-\x{2FF}\x{400}-\x{482}\x{2010}-\x{2027}\x{20AC}\x{4E00}-\x{9FFF}]*$"


@F.arrow_udf(T.StringType())
def composed(texts: pa.Array) -> pa.Array:
    """Texts in canonical composition."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def normalise(text: Column) -> Column:
    """spaced() of the text in canonical composition; only texts that may not be in it leave the JVM."""
    return spaced(F.coalesce(composed(F.when(~text.rlike(COMPOSED), text)), text))


def spaced(text: Column) -> Column:
    """Line ends as \\n, odd spaces as spaces, no invisible characters, lines trimmed with single spaces, at most one
    blank line in a row, one line end at the end, or an empty text."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.translate(x, SPACES + INVISIBLE, " " * len(SPACES))
    x = F.regexp_replace(x, " +", " ")
    x = F.regexp_replace(x, rf"(?<![{EDGE}])[{EDGE}]++\n", "\n")
    x = F.regexp_replace(x, rf"\n[{EDGE}]+", "\n")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    # one line end at the end of what is left, none of an empty text
    x = F.regexp_replace(x, rf"^[{EDGE}\n]+|(?<![{EDGE}\n])[{EDGE}\n]++$", "")
    return F.regexp_replace(F.concat(x, F.lit("\n")), r"^\n$", "")


def normalised(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with normalise() of a column, where only rows that may not be composed go through Python."""
    is_composed = F.coalesce(F.col(column).rlike(COMPOSED), F.lit(True))
    as_is = texts.filter(is_composed).withColumn(column, spaced(F.col(column)))
    return as_is.union(texts.filter(~is_composed).withColumn(column, spaced(composed(F.col(column)))))


def joined_hyphens(text: Column) -> Column:
    """Words broken by a hyphen at the end of a line, whole again."""
    return F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), 0)


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams of an array of words, joined by spaces; none if there are fewer words."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>")))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), 0))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(fold(name), "[^a-z0-9]+", "_"), F.lit("_"))


def visible_text(html: Column) -> Column:
    """Text of regular HTML: no comments and noise elements, block tags as line ends, entities of XML decoded."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "nav", "header", "footer", "form", "aside", "button", "iframe", "svg", "template", "head"):
        x = F.regexp_replace(x, rf"(?is)<{tag}[ >].*?</{tag}>", " ")
    x = F.regexp_replace(x, r"(?i)<br ?/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</?(p|div|h[1-6]|li|ul|ol|table|tr|article|section|main|blockquote|pre)( [^>]*)?>", "\n")
    x = F.regexp_replace(x, r"(?i)</t[dh]>", " ")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return spaced(x)


#: Words without meaning for a search.
STOPWORDS = tuple(
    """a al algo algunas algunos ante antes como con contra cual cuales cuando de del desde donde durante e el ella ellas
    ellos en entre era es esa esas ese eso esos esta estas este esto estos fue fueron ha han hasta la las le les lo los
    mas me mi muy no nos o otra otras otro otros para pero por que quien quienes se sea segun ser si sin sino sobre su sus
    tal tambien te tiene tienen toda todas todo todos tu un una uno unos y ya""".split()
)


#: Bounds of a word of ASCII letters, digits and _; the JVM's own may take letters of other scripts for parts of a word.
BEGIN, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
#: A court id is a chamber and a number; tokens are court ids, numbers with their dots, hyphens and letter, and words.
COURT_ID = rf"{BEGIN}({'|'.join(CHAMBERS)}) *-? *0*(\d{{1,5}}){END}"
LEGAL_TOKEN = "|".join([r"[a-z]{1,4}-\d{1,5}", r"\d+(?:[.\-]\d+)*[a-z]?", "[a-z]+"])


def legal_words(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Folded tokens of legal text: court ids (sl3385 is sl-3385), article numbers, and words that are not stopwords."""
    x = F.regexp_replace(fold(text), COURT_ID, "$1-$2")
    x = F.regexp_replace(x, rf"{BEGIN}(\d+) *(?:o{END}|º|°)", "$1")
    found = F.regexp_extract_all(x, F.lit(LEGAL_TOKEN), 0)
    return F.filter(found, lambda w: ~w.isin(*stopwords)) if stopwords else found


def legal_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """legal_words() with their stems in place of words; identifiers stay."""
    return stemmed(legal_words(text, stopwords))
