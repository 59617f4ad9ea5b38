"""Text cleanup, HTML to text, token estimates, tokens of full-text search and their stems."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .titles import squeeze, strip

# Words of no weight in English full-text search.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def word_array(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) > 0)


def token_estimate(c: Column) -> Column:
    """Tokens by words and by characters, the mean of both; null and empty count 0."""
    words, chars = F.size(word_array(c)), F.length(c)
    by_words = F.floor(words * F.lit(1.33)) + 1
    by_chars = F.floor(chars / F.lit(4.0)) + 1
    return F.when(F.length(c) > 0, F.greatest(F.lit(1), F.floor((by_words + by_chars) / F.lit(2.0)))).otherwise(0).cast("int")


def clean_text(c: Column) -> Column:
    """No NULs, single spaces, at most one blank line, nothing at the ends."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(m: re.Match) -> str:
    # html.unescape would take the start of an unknown name for a known one
    return html.unescape(m[0]) if m[1][0] == "#" else html.entities.html5.get(m[1] + ";", m[0])


@F.pandas_udf(StringType())
def _unescape_closed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or "&" not in t else _CLOSED.sub(_closed, t))


def unescape(c: Column, known: dict[str, str] | None = None, closed: bool = False) -> Column:
    """Character references resolved, with ``closed`` only those that a semicolon ends; with ``known`` (entity to text) on the JVM, without Python."""
    if known is None:
        return _unescape_closed(c) if closed else _unescape(c)
    for entity, text in known.items():
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def html_to_text(c: Column, known: dict[str, str] | None = None) -> Column:
    """Without scripts, styles and tags."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?is)<script.*?</script>", ""), r"(?is)<style.*?</style>", "")
    return clean_text(unescape(F.regexp_replace(c, r"<[^>]+>", " "), known))


def html_snippet(c: Column, known: dict[str, str] | None = None, closed: bool = False) -> Column:
    """Tags as spaces, all white space squeezed; scripts are not told apart."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "), known, closed))


def html_heading(c: Column, known: dict[str, str] | None = None) -> Column:
    """Text of the first h1 to h3, or null."""
    inner = F.regexp_extract(c, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1)
    found = html_to_text(inner, known)
    return F.when(F.length(found) > 0, found)


def lexemes(c: Column) -> Column:
    """Lower-case word tokens in order; their positions count from 1."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)


_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Suffixes of the English stemmer's steps and what they become.
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
    ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_ODD = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def stem(word: str) -> str:
    """The English (Porter2) stem of a lower-case word, after the published algorithm."""
    if len(word) <= 2:
        return word
    if word in _ODD:
        return _ODD[word]
    if word in _SAME:
        return word
    w = word.lstrip("'")
    w = re.sub(rf"(^|[{_VOWEL}])y", r"\1Y", w)
    region = re.match(r"(gener|commun|arsen)", w)
    first = region.end() if region else (m.end() if (m := re.search(rf"[{_VOWEL}][^{_VOWEL}]", w)) else len(w))
    second = first + m.end() if (m := re.search(rf"[{_VOWEL}][^{_VOWEL}]", w[first:])) else len(w)

    def in1(suffix: str) -> bool:
        return len(w) - len(suffix) >= first

    def in2(suffix: str) -> bool:
        return len(w) - len(suffix) >= second

    def short(x: str) -> bool:
        return first >= len(x) and bool(re.search(rf"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$|^[{_VOWEL}][^{_VOWEL}]$", x))

    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{_VOWEL}].+s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            if suffix in ("eed", "eedly"):
                if in1(suffix):
                    w = w[: -len(suffix)] + "ee"
            elif re.search(rf"[{_VOWEL}]", w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for suffix, by in _STEP2:
        if w.endswith(suffix):
            if in1(suffix):
                w = w[: -len(suffix)] + by
            break
    else:
        if w.endswith("ogi") and in1("ogi") and w.endswith("logi"):
            w = w[:-1]
        elif w.endswith("li") and in1("li") and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for suffix, by in _STEP3:
        if w.endswith(suffix):
            if in1(suffix):
                w = w[: -len(suffix)] + by
            break
    else:
        if w.endswith("ative") and in2("ative"):
            w = w[:-5]
    for suffix in _STEP4:
        if w.endswith(suffix):
            if in2(suffix):
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith(("sion", "tion")) and in2("ion"):
            w = w[:-3]
    if w.endswith("e") and (in2("e") or (in1("e") and not re.search(rf"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$|^[{_VOWEL}][^{_VOWEL}]$", w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and in2("l"):
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of an array of tokens, each distinct one once a batch; stop words become null and keep their place."""
    known: dict[str, str | None] = dict.fromkeys(STOP_WORDS)

    def one(w: str) -> str | None:
        if w not in known:
            known[w] = stem(w)
        return known[w]

    return words.map(lambda ws: None if ws is None else [one(w) for w in ws])
