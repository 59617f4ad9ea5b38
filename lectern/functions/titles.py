"""Title cleaning and normalization. Everything is a Column but word segmentation and casing (one Arrow function)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import KNOWN_EXTENSIONS, NUMBERED_WORDS, PHRASES, SMALL_WORDS, WORD_CASES

_EXT = "|".join(sorted((x[1:] for x in KNOWN_EXTENSIONS), key=lambda x: (-len(x), x)))

#: Default vocabulary of the segmenter beside ``WORD_CASES`` and ``SMALL_WORDS``; a parameter wherever it is used.
WORDS = tuple(
    "automate boring stuff edition guide complete wiring survival secrets math concepts every data scientist should know "
    "science engineering electronics learning machine deep network networks system systems design pattern patterns "
    "programming computer software hardware circuit circuits sensor sensors project projects hand book handbook manual "
    "beginner beginners advanced practical introduction fundamentals essentials cook cookbook recipes modern art how your "
    "home garden gardening water air power energy music sound audio build building make maker makers first second third "
    "black decker and quick start step time real world open source code coding web cloud security hacking ethical test testing "
    "model models language natural analysis statistics algebra calculus physics chemistry biology astronomy space rocket "
    "mind life work business money finance history philosophy psychology thinking habits world guide's you".split()
)


def any_of(patterns: Iterable[str]) -> str:
    """One pattern, any case, that is found where any of ``patterns`` is: most texts hold none of a long table, and are done after one search."""
    parts = [f"(?:{p})" for p in patterns]
    return ("(?i)\\b(?:" if all(p.startswith(r"(?:\b") for p in parts) else "(?i)(?:") + "|".join(parts) + ")"


def squeeze(c: Column) -> Column:
    """White space runs (Unicode) as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def base_name(c: Column) -> Column:
    """What follows the last slash, trailing slashes aside."""
    return F.regexp_extract(F.regexp_replace(c, r"/+$", ""), r"([^/]*)$", 1)


def strip_extensions(c: Column) -> Column:
    """Known extensions off the end, as often as there are any; a name that is nothing but an extension stays."""
    return strip(F.regexp_replace(c, rf"(?is)(?<=[^./\s])(\s*\.({_EXT}))+\s*$", ""))


def strip_copy_suffix(c: Column) -> Column:
    """`` (1)`` to ``(99)``, and a bare trailing number unless a word before it takes numbers."""
    c = strip(F.regexp_replace(c, r"(?U)[\s_]*\([1-9]\d?\)$", ""))
    last = F.regexp_extract(c, r"(?U)^(?s:(.*?))[\s_]+([1-9]\d?)$", 1)
    word = F.regexp_replace(F.lower(F.regexp_extract(F.regexp_replace(last, r"_", " "), r"(?U)(\S+)\s*$", 1)), r"\.+$", "")
    numbered = c.rlike(r"(?U)[\s_]+[1-9]\d?$") & (F.length(last) > 0)
    return F.when(numbered & ~word.isin(*NUMBERED_WORDS), strip(last)).otherwise(c)


def split_camel_case(c: Column) -> Column:
    c = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1 $2")


def collapse_doubled_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"(\.[a-zA-Z0-9]+)\1+$", "$1")


def extension_of(c: Column) -> Column:
    """The suffix of a file name: from the last dot, unless that begins or ends the name."""
    return F.regexp_extract(base_name(c), r"(?s)^[^.].*?(\.[^.]+)$|^\.+[^.].*?(\.[^.]+)$", 1)


def stem_of(c: Column) -> Column:
    name = base_name(c)
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+$", "")


@lru_cache(maxsize=4)
def _costs(words: tuple[str, ...]) -> dict[str, float]:
    """A cost by rank for each word (Zipf), small words cheapest."""
    order = list(dict.fromkeys([*SMALL_WORDS, *(w for w in WORD_CASES if w.isalpha()), *words]))
    n = len(order)
    return {w: math.log((i + 1) * math.log(n)) for i, w in enumerate(order)}


@lru_cache(maxsize=1 << 15)
def segment(token: str, words: tuple[str, ...] = WORDS) -> str:
    """A long lower-case token as the cheapest chain of known words; digits and unknown stretches stay together."""
    if len(token) < 7 or re.fullmatch(r"[0-9a-f]{20,}", token) or token.isdigit() or not token.islower():
        return token
    costs, dear = _costs(words), 12.0
    best = [(0.0, 0)]
    for i in range(1, len(token) + 1):
        options = []
        for j in range(max(0, i - 24), i):
            part = token[j:i]
            if part in costs:
                options.append((best[j][0] + costs[part], j))
            elif part.isdigit() or re.fullmatch(r"\d+(st|nd|rd|th)", part):
                options.append((best[j][0] + 2.0, j))
            else:
                options.append((best[j][0] + dear * (i - j), j))
        best.append(min(options))
    parts, i, unknown = [], len(token), 0
    while i:
        j = best[i][1]
        parts.append(token[j:i])
        unknown += 0 if token[j:i] in costs or token[j:i][0].isdigit() else i - j
        i = j
    return " ".join(reversed(parts)) if unknown * 4 <= len(token) else token


@lru_cache(maxsize=1 << 15)
def _cased(word: str) -> str:
    core = word.lower().strip("(),:;\"'?!")
    if core in WORD_CASES:
        head, tail = re.match(r"[(\"']*", word)[0], re.search(r"[)\",:;!'.?]*$", word)[0]
        return head + WORD_CASES[core] + (tail if len(tail) < len(word) else "")
    if re.search(r"[a-z][A-Z]|^[A-Z]{2,}$", word) and not word.isupper():
        return word
    return re.sub(r"[A-Za-z]", lambda m: m[0].upper(), word.lower() if word.islower() or word.istitle() else word, count=1)


def title_case(text: str) -> str:
    """Words capitalized, words with a spelling of their own in it, small words small inside."""
    if text.isupper() and len(text.split()) > 1:
        text = text.lower()
    words = [_cased(w) for w in text.split()]
    for i, w in enumerate(words):
        core = re.sub(r"\W", "", w).lower()
        if core not in SMALL_WORDS or core in WORD_CASES:
            continue
        head, tail = re.match(r"\W*", w)[0], re.search(r"\W*$", w)[0]
        if i == 0:
            words[i] = head + core.capitalize() + tail
        elif i < len(words) - 1 and not words[i - 1].endswith((":", "-", "—", "?", "!")):
            words[i] = head + core + tail
    return " ".join(words)


def _segment_and_case(words: tuple[str, ...]):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else title_case(" ".join(segment(x, words) for x in re.split(r"[_\s]+", t) if x)))

    return run


def clean_title(c: Column, words: tuple[str, ...] = WORDS) -> Column:
    """A raw file name or list line as a title. A null stays null."""
    # The steps' patterns and their order.
    c = strip(c)
    for a in "!+-":
        c = F.replace(c, F.lit("\\" + a), F.lit(a))
    c = F.regexp_replace(c, r"(?U)^(?:[\-_*•\s]|📂|📁|📄)+", "")
    c = F.regexp_replace(c, r"(?U)^\[[^\]]+\]\s*", "")
    c = strip_copy_suffix(strip_extensions(c))
    c = strip(F.regexp_replace(c, r"(?iU)[\s_-]+[a-f0-9]{32}$", ""))
    c = strip(F.regexp_replace(c, r"(?iU)[\s_-]*_?preview$", ""))
    c = strip(F.regexp_replace(c, r"(?i)[-_](master|main)$", ""))
    c = F.regexp_replace(c, r"(?<!\d)(?<![Cc])\+(?!\+)", " ")
    c = F.regexp_replace(c, r"([A-Za-z0-9])_\s+([A-Za-z0-9])", "$1: $2")
    c = F.regexp_replace(c, r"([A-Za-z0-9])\s+_\s*([A-Za-z0-9])", "$1: $2")
    c = F.regexp_replace(c, r"(?<=\S)-(?=\S)", " ")
    c = F.when(c.contains(" ") | c.contains("_"), c).otherwise(split_camel_case(c))
    c = _segment_and_case(words)(c)
    c = F.when(c.rlike(any_of(p[0] for p in PHRASES)), reduce(lambda x, p: F.regexp_replace(x, "(?i)" + p[0], p[1]), PHRASES, c)).otherwise(c)
    for pattern, by in ((r"(?U)\s*:\s*", ": "), (r"(?U)\s*,\s*", ", "), (r"(?U)\s+-\s+", " - "), (r"(?U)\s*—\s*", " — ")):
        c = F.regexp_replace(c, pattern, by)
    return squeeze(c)


def normal_key(cleaned: Column) -> Column:
    """The key of a cleaned title: no copy suffix, lower case, punctuation as spaces."""
    key = squeeze(F.regexp_replace(F.lower(strip_copy_suffix(cleaned)), r"(?U)[^\w\s]", " "))
    return F.when(F.length(key) > 0, key).otherwise(strip(F.lower(cleaned)))


def normalize_title(c: Column, words: tuple[str, ...] = WORDS) -> Column:
    return normal_key(clean_title(c, words))
