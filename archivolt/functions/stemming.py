"""The Snowball stemmer for Spanish, by its published description, over the distinct words of Arrow batches.

A word has three regions: R1 after the first consonant that follows a vowel, R2 likewise within R1, and RV by its first
letters.  Attached pronouns go first, then one suffix (a derivation, a verb's that begins with y, or another verb's), then
what is left at the end, then the accents."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm: vowels, and the suffixes of each step.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
AFTER_VERB = "iéndo ándo ár ér ír ando iendo ar er ir yendo".split()
DERIVED = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AGENTS = "adora ador ación acion adoras adores aciones ante antes ancia ancias".split()
LOGY, UTION, ENCY = "logía logías".split(), "ución ucion uciones".split(), "encia encias".split()
ABILITY, ACTIVE = "idad idades".split(), "iva ivo ivas ivos".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
E_VERBS = "en es éis emos".split()
VERBS = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos
    eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese
    aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras
    ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos
    iésemos ásemos""".split()
ENDS, E_ENDS = "os a o á í ó".split(), "e é".split()

PLAIN = str.maketrans("áéíóú", "aeiou")
AFTER_VOWEL = re.compile(f"[{VOWELS}][^{VOWELS}]")


def any_of(*lists: list[str]) -> re.Pattern:
    """The longest of the suffixes: a search for one that ends the word finds the earliest beginning first."""
    return re.compile("(?:" + "|".join(x for one in lists for x in one) + ")$")


PRONOUN, VERB_BEFORE, SUFFIX = any_of(PRONOUNS), any_of(AFTER_VERB), any_of(DERIVED, AGENTS, LOGY, UTION, ENCY, ABILITY, ACTIVE, ["amente", "mente"])
Y_VERB, VERB, END = any_of(Y_VERBS), any_of(E_VERBS, VERBS), any_of(ENDS, E_ENDS)
#: What else goes before a derivation that was taken off, where it lies in R2.
ALSO = {**dict.fromkeys(AGENTS, ("ic",)), "mente": ("ante", "able", "ible"), **dict.fromkeys(ABILITY, ("abil", "ic", "iv")), **dict.fromkeys(ACTIVE, ("at",)), "amente": ("iv", "os", "ic", "ad")}
#: What stands in for a derivation.
INSTEAD = {**dict.fromkeys(LOGY, "log"), **dict.fromkeys(UTION, "u"), **dict.fromkeys(ENCY, "ente")}


def regions(word: str) -> tuple[int, int, int]:
    """Where R1, R2 and RV begin."""
    first = AFTER_VOWEL.search(word)
    r1 = first.end() if first else len(word)
    second = AFTER_VOWEL.search(word, r1)
    is_vowel = [c in VOWELS for c in word[:2]]
    rv = len(word)
    if len(word) > 2:
        if not is_vowel[1]:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), rv)
        elif is_vowel[0]:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), rv)
        else:
            rv = 3
    return r1, second.end() if second else len(word), rv


def without(word: str, endings: tuple[str, ...], least: int) -> str:
    """word without the one of endings that it has, where that begins at `least` or later."""
    for ending in endings:
        if word.endswith(ending) and len(word) - len(ending) >= least:
            return word[: -len(ending)]
    return word


def without_pronoun(word: str, rv: int) -> str:
    found = PRONOUN.search(word)
    verb = VERB_BEFORE.search(word[: found.start()]) if found else None
    if not verb or verb.start() < rv or verb[0] == "yendo" and word[verb.start() - 1] != "u":
        return word
    return word[: verb.start()] + verb[0].translate(PLAIN)


def without_derivation(word: str, r1: int, r2: int) -> str | None:
    """None where no derivation was taken off."""
    found = SUFFIX.search(word)
    if not found or found.start() < (r1 if found[0] == "amente" else r2):
        return None
    bare = word[: found.start()] + INSTEAD.get(found[0], "")
    shorter = without(bare, ALSO.get(found[0], ()), r2)
    return without(shorter, ("at",), r2) if found[0] == "amente" and bare.endswith("iv") and shorter != bare else shorter


def without_verb(word: str, rv: int) -> str:
    found = Y_VERB.search(word, rv)
    if found and word[found.start() - 1 : found.start()] == "u":
        return word[: found.start()]
    found = VERB.search(word, rv)
    if not found:
        return word
    bare = word[: found.start()]
    return bare[:-1] if found[0] in E_VERBS and bare.endswith("gu") else bare


def without_end(word: str, rv: int) -> str:
    found = END.search(word)
    if not found or found.start() < rv:
        return word
    bare = word[: found.start()]
    return bare[:-1] if found[0] in E_ENDS and bare.endswith("gu") and len(bare) - 1 >= rv else bare


@functools.lru_cache(maxsize=1 << 16)
def stem_word(word: str) -> str:
    """The stem of a word in lower case."""
    r1, r2, rv = regions(word)
    word = without_pronoun(word, rv)
    derived = without_derivation(word, r1, r2)
    word = without_verb(word, rv) if derived is None else derived
    return without_end(word, rv).translate(PLAIN)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(words: pa.Array) -> pa.Array:
    """Lists of words with each word of letters alone as its stem; each distinct word of a batch is stemmed once."""
    coded = words.flatten().dictionary_encode()
    stems = pa.array([w if w is None or not w.isalpha() else stem_word(w) for w in coded.dictionary.to_pylist()], pa.string())
    flat = stems.take(coded.indices) if len(coded) else pa.array([], pa.string())
    sizes = [0 if n is None else n for n in pa.compute.list_value_length(words).to_pylist()]
    offsets = [0]
    for n in sizes:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=words.is_null() if words.null_count else None)
