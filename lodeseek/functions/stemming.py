"""English words for ranking: stop-words left out, the others by their stem.

Stems are those of the second version of Porter's English algorithm (Snowball), from its published
rules. Words are runs of a-z and 0-9, so rules about apostrophes have nothing to do.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# English words that tell nothing of a text's subject.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their "
    "theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)
# Fixed values of the algorithm: words with stems of their own, words that stay from the start or after the plural, and regions that begin late.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
LATE = ("gener", "commun", "arsen")
# Fixed values of the algorithm: suffixes and what takes their place, in the first region and in the second.
DERIVED = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
ADJECTIVAL = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
RESIDUAL = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])\Z")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z")
_VOWEL = re.compile(r"[aeiouy]")


def _longest(word: str, suffixes) -> str | None:  # noqa: ANN001  any collection of texts
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


def _after(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _singular(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _without_tense(w: str, r1: int) -> str:
    if ended := _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        rest = w[: -len(ended)]
        if ended.startswith("eed"):
            return rest + "ee" if len(rest) >= r1 else w
        if not _VOWEL.search(rest):
            return w
        if rest.endswith(("at", "bl", "iz")):
            return rest + "e"
        if _DOUBLE.search(rest):
            return rest[:-1]
        return rest + "e" if len(rest) <= r1 and _SHORT_END.search(rest) else rest
    return w


def _derived(w: str, r1: int, r2: int) -> str:
    ended = _longest(w, DERIVED)
    if ended and len(w) - len(ended) >= r1:
        rest = w[: -len(ended)]
        if not (ended == "ogi" and not rest.endswith("l") or ended == "li" and rest[-1:] not in tuple("cdeghkmnrt")):
            w = rest + DERIVED[ended]
    ended = _longest(w, ADJECTIVAL)
    if ended and len(w) - len(ended) >= (r2 if ended == "ative" else r1):
        w = w[: -len(ended)] + ADJECTIVAL[ended]
    ended = _longest(w, RESIDUAL)
    if ended and len(w) - len(ended) >= r2 and (ended != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(ended)]
    return w


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters, and those with other letters than a-z, stay or lose endings like any."""
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y that begins the word or follows a vowel is a consonant, Y.
    w = re.sub(r"(?<=[aeiouy])y", "Y", ("Y" + word[1:]) if word[0] == "y" else word)
    late = next((x for x in LATE if w.startswith(x)), None)
    r1 = len(late) if late else _after(w, 0)
    r2 = _after(w, r1)
    w = _singular(w)
    if w not in AFTER_PLURAL:
        w = _without_tense(w, r1)
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
            w = w[:-1] + "i"
        w = _derived(w, r1, r2)
        if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
            w = w[:-1]
    return w.replace("Y", "y")


def english(words: list[str]) -> list[str]:
    """The stems of words that aren't stop-words, in order."""
    return [stem(x) for x in words if x not in STOP_WORDS]


@F.arrow_udf(ArrayType(StringType()))
def _stems(words: pa.Array) -> pa.Array:
    """Stems of each list's words; each distinct word of a batch is looked at once."""
    coded = words.flatten().dictionary_encode()
    told = pa.array([stem(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    at = 0
    offsets = [0]
    for n in words.value_lengths().to_pylist():
        at += n or 0
        offsets.append(at)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), told.cast(pa.string()), mask=words.is_null() if words.null_count else None)


def english_terms(terms: Column) -> Column:
    """The stems of an array of words without its stop-words. Stop-words are left out by Spark, stems come in Arrow batches."""
    return _stems(F.filter(terms, lambda x: ~x.isin(*STOP_WORDS)))
