"""Rule-based metadata as Columns: file types, publishers, editions, years, authors, taxonomy, media, summaries, ISBNs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import FILE_TYPES, KNOWN_AUTHORS, NON_AUTHORS, PAGE_PUBLISHERS, TAXONOMY, TAXONOMY_ELSE, TITLE_PUBLISHERS, UNINFORMATIVE
from .titles import any_of, base_name, squeeze, stem_of, strip

TAXONOMY_FIELDS = ("domain", "subject", "subfield", "genre", "target_audience", "key_concepts", "topics")
# What counts as a book number in running text.
ISBN_13 = r"\b(97[89][-\s]?[0-9]{1,5}[-\s]?[0-9]{1,7}[-\s]?[0-9]{1,7}[-\s]?[0-9])\b"
ISBN_10 = r"\b([0-9]{1,5}[-\s]?[0-9]{1,7}[-\s]?[0-9]{1,7}[-\s]?[0-9xX])\b"


def first_match(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first pattern found (any case), else null."""
    first = reduce(lambda other, row: F.when(text.rlike("(?i)" + row[1]), row[0]).otherwise(other), reversed(table), F.lit(None).cast("string"))
    return F.when(text.rlike(any_of(row[1] for row in table)), first)


def nonblank(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(F.length(c) > 0, c)


def file_info(name: Column) -> Column:
    """``struct(file_type, extension)`` of a path or name."""
    base = base_name(name)
    low = F.lower(base)
    ext = F.when(low.endswith(".csv.docx"), ".csv.docx").when(low.endswith(".tar.gz"), ".tar.gz").otherwise(F.lower(F.regexp_extract(base, r"(?s)(?<=.)(\.[^.]+)$", 1)))
    ext = F.when(F.length(ext) == F.length(base), "").otherwise(ext)
    known = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    kind = F.when(ext == ".csv.docx", "Word (DOCX)").when(ext == ".tar.gz", "TAR.GZ Archive")
    kind = kind.when(known[ext].isNotNull(), known[ext]).when(ext.rlike(r"^\.[^.]{1,4}$"), F.upper(F.substring(ext, 2, 10))).otherwise("Directory / Folder")
    return F.struct(kind.alias("file_type"), F.when(kind == "Directory / Folder", "").otherwise(ext).alias("extension"))


def publisher(raw: Column, clean: Column) -> Column:
    return first_match(F.concat_ws(" ", F.coalesce(raw, F.lit("")), F.coalesce(clean, F.lit(""))), TITLE_PUBLISHERS)


def page_publisher(text: Column) -> Column:
    return first_match(text, PAGE_PUBLISHERS)


def subtitle(title: Column) -> Column:
    """After the first colon, else after the first spaced hyphen unless a few prefixes say otherwise."""
    by_colon = F.when(title.contains(":"), nonblank(strip(F.regexp_extract(title, r"(?s)^[^:]*:(.*)$", 1))))
    head = F.lower(strip(F.substring_index(title, " - ", 1)))
    # The prefixes.
    by_dash = F.when(title.contains(" - ") & ~head.isin("udemy", "statement", "2024"), nonblank(strip(F.regexp_extract(title, r"(?s)^.*?\s-\s(.*)$", 1))))
    return F.when(title.contains(":"), by_colon).otherwise(by_dash)


def ordinal(n: Column) -> Column:
    """``1st``, ``2nd``, ..., teens with ``th`` only from 11 to 13 themselves."""
    last = n % 10
    end = F.when(n.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def edition_info(raw: Column, clean: Column) -> Column:
    """``struct(revision, edition)``."""
    title = F.lower(F.concat_ws(" ", raw, clean))
    # The patterns.
    nth, pack, version = (nonblank(F.regexp_extract(title, "(?i)" + p, 1)).cast("int") for p in (r"\b(\d+)(?:st|nd|rd|th)\s+(?:edition|ed)\b", r"\bpack[-_\s]*(\d+)\b", r"\bv(\d+)\b"))
    label = F.when(nth.isNotNull(), F.concat(ordinal(nth), F.lit(" Edition"))).when(pack.isNotNull(), F.concat(F.lit("Pack "), pack.cast("string")))
    label = label.when(version.isNotNull(), F.concat(F.lit("Version "), version.cast("string"), F.lit(".0"))).otherwise("1st Edition")
    return F.struct(F.coalesce(nth, pack, version, F.lit(1)).alias("revision"), label.alias("edition"))


def published_year(raw: Column, clean: Column) -> Column:
    """An ISO date of the raw title, else its last bracketed year, else the last year of the clean one (1950 to 2030)."""
    iso = nonblank(F.replace(F.regexp_extract(raw, r"\b((?:19\d\d|20\d\d)[-_](?:0[1-9]|1[0-2])[-_](?:0[1-9]|[12]\d|3[01]))\b", 1), F.lit("_"), F.lit("-")))
    last = lambda years: F.when(F.size(F.filter(years, lambda y: y.cast("int").between(1950, 2030))) > 0, F.try_element_at(F.filter(years, lambda y: y.cast("int").between(1950, 2030)), F.lit(-1)))
    bracketed = F.regexp_extract_all(F.concat(F.lit(" "), raw, F.lit(" ")), F.lit(r"[\(\[\s_-](19\d\d|20\d\d)[\)\]\s_.-]"), 1)
    bare = F.regexp_extract_all(clean, F.lit(r"\b(19\d\d|20\d\d)\b"), 1)
    return F.coalesce(iso, last(bracketed), last(bare))


def author(raw: Column, clean: Column) -> Column:
    """A bracketed prefix that names a person, else ``by First Last``, else an author known by a word of the title."""
    tag = strip(F.regexp_extract(raw, r"^\s*\[([^\]]+)\]", 1))
    low = F.lower(tag)
    # The marks of a site, and the patterns.
    site = reduce(lambda x, y: x | y, [low.contains(t) for t in ("http", "www.", ".com", ".org")])
    fits = (F.length(tag) > 0) & ~low.isin(*NON_AUTHORS) & ~site & ~tag.rlike(r"^\d+$")
    byline = nonblank(F.regexp_extract(clean, r"\bby\s+([A-Z][a-z]+(?:\s+[A-Z][a-z.]+){1,3})\b", 1))
    both = F.concat_ws("\n", clean, raw)
    known = first_match(both, tuple((name, rf"\b{re.escape(word)}\b") for word, name in KNOWN_AUTHORS))
    return F.coalesce(F.when(fits, tag), byline, known)


def taxonomy(raw: Column, clean: Column) -> Column:
    """The labels of the first rule that fits, as a struct."""
    text = F.lower(F.concat_ws(" ", clean, raw))
    row = lambda values: F.struct(*[F.lit(v).alias(n) for v, n in zip(values, TAXONOMY_FIELDS, strict=True)])
    rules = [(r[0].replace(r"\/", "/"), r[1:]) for r in TAXONOMY]
    first = reduce(lambda other, r: F.when(text.rlike("(?i)" + r[0]), row(r[1])).otherwise(other), reversed(rules), row(TAXONOMY_ELSE))
    return F.when(text.rlike(any_of(r[0] for r in rules)), first).otherwise(row(TAXONOMY_ELSE))


def media_class(raw: Column, clean: Column, file_type: Column) -> Column:
    """``struct(media_type, is_collection)`` by the first test that holds."""
    text = F.lower(F.concat_ws(" ", clean, raw))
    any_ = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    # The words of each class.
    course, pack = any_("udemy", "bootcamp", "course", "tutorial"), any_("pack", "collection", "130+")
    project = any_("manifest", "specification", "architecture") | (file_type == "Markdown")
    bom, money = any_("bom", ".csv", "datasheet"), any_("statement", "bill", "1040", "invoice")
    folder = file_type == "Directory / Folder"
    kind = F.when(course, "Course / Video Series").when(pack, "Collection / Resource Pack").when(project, "Project Documentation / Manifest")
    kind = kind.when(bom, "Hardware Specification / BOM").when(money, "Financial Record / Document").when(folder, "Directory / Resource Pack").otherwise("Book / Ebook")
    flag = F.when(course, any_("bootcamp", "pack", "collection").cast("int")).when(pack, 1).when(project | bom | money, 0).when(folder, 1).otherwise(0)
    return F.struct(kind.alias("media_type"), flag.alias("is_collection"))


def summary(title: Column, sub: Column, author_: Column, publisher_: Column, published: Column, edition: Column, media: Column, domain: Column, subject: Column, subfield: Column, genre: Column) -> Column:
    """A sentence or two about a record, by kind of media."""
    opt = lambda before, c, after="": F.when(F.length(c) > 0, F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    sub, by, from_, out = opt(" (", sub, ")"), opt(" by ", author_), opt(" from ", publisher_), opt(", released in ", published)
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # The sentences.
    bundle = t("Comprehensive resource bundle and reference collection focusing on ", title, sub, from_, out, ". Covers key principles, curated documentation, and multi-part assets across ", subfield, " within ", domain, ".")
    course = t("Structured educational course and instructional video curriculum covering ", title, sub, by, from_, ". Designed to build practical mastery and hands-on proficiency in ", subfield, ".")
    project = t("System architecture blueprint and diagnostic specification for ", title, sub, ". Details functional protocols, instrumentation pipelines, and execution frameworks in ", domain, ".")
    money = t("Official fiscal documentation and financial statement record regarding ", title, out, ".")
    other = t("A comprehensive ", F.lower(genre), " on ", title, sub, " (", edition, ")", by, from_, out, ". Explores foundational principles, technical methodologies, and practical applications in ", subject, " and ", subfield, ".")
    return F.when(media.contains("Collection") | media.contains("Pack"), bundle).when(media.contains("Course"), course).when(media.contains("Documentation"), project).when(media.contains("Financial"), money).otherwise(other)


def is_uninformative(title: Column) -> Column:
    """Whether a title tells nothing: null, blank, a date, a number, a hash, a generic name, two characters or fewer."""
    whole = strip(F.coalesce(title, F.lit("")))
    stem = strip(stem_of(whole))
    out = (F.length(whole) == 0) | (F.length(stem) <= 2) | stem.rlike(r"^[\d\s\-_.]+$")
    for pattern, any_case in UNINFORMATIVE:
        p = ("(?i)" if any_case else "") + pattern
        out = out | stem.rlike(p) | whole.rlike(p)
    return out


def clean_isbn(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[-\s]", ""))


def isbn_valid(c: Column) -> Column:
    """By length and characters; no checksum."""
    x = clean_isbn(c)
    return x.rlike(r"^97[89]\d{10}$") | x.rlike(r"^\d{9}[\dX]$")


def find_isbn(text: Column) -> Column:
    """The first valid 13-digit number, else the first valid 10-digit one."""
    pick = lambda p: F.try_element_at(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), 1), clean_isbn), isbn_valid), F.lit(1))
    return F.coalesce(pick(ISBN_13), pick(ISBN_10))


def pdf_year(c: Column) -> Column:
    return nonblank(F.regexp_extract(c, r"((?:19|20)\d{2})", 1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two titles' sets of lower-case words; 0 where either has none."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def accepts_open_library(query: Column, title: Column) -> Column:
    q, t = F.lower(query), F.lower(F.coalesce(title, F.lit("")))
    return (jaccard(query, title) >= 0.35) | q.contains(t) | t.contains(q)


def accepts_crossref(query: Column, title: Column) -> Column:
    return jaccard(query, title) >= 0.4


def search_query(title: Column) -> Column:
    """Up to six words to look a title up by, or null where it is not worth it."""
    q = strip(title)
    # What is not looked up, and what is left out of a query, in order.
    reject = q.rlike(r"^[\d\s\-_.]+$") | q.rlike(r"(?i)^[0-9a-f]{16,}")
    reject = reject | q.rlike(r"(?i)\b(statement|invoice|bill|1040|tax|manifest|diagnostic\s+ecosystem|bom|two\s+kings\s+manual|202403|202407|12251)\b")
    for pattern in (r"(?i)^Udemy\s*-\s*", r"\[[^\]]+\]", r"(?i)\b(\d+)(?:st|nd|rd|th)\s+(?:edition|ed)\b", r"(?i)\b(?:pack|collection)[-_\s]*\d+\b", r"\b(19\d\d|20\d\d)\b"):
        q = F.regexp_replace(q, pattern, "")
    words = F.filter(F.split(squeeze(F.regexp_replace(q, r"(?U)[^\w\s]", " ")), " "), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$"))
    return F.when(~reject & (F.size(words) >= 2), F.array_join(F.slice(words, 1, 6), " "))


def metadata_passage(c: dict[str, Column]) -> Column:
    """``Label: value`` parts of what is not blank, in a fixed order, joined by bars."""
    # Labels and their columns, in order.
    labels = (
        ("Subtitle", "subtitle"), ("Author", "author"), ("Publisher", "publisher"), ("Published", "published"), ("Edition", "edition"), ("Domain", "domain"), ("Subject", "subject"),
        ("Subfield", "subfield"), ("Genre", "genre"), ("Topics", "topics"), ("Key Concepts", "key_concepts"), ("Target Audience", "target_audience"), ("Summary", "summary"),
    )
    title = F.coalesce(nonblank(c["clean_title"]), nonblank(c["raw_title"]) if "raw_title" in c else F.lit(None), F.lit("Unknown"))
    parts = [F.concat(F.lit("Title: "), title)]
    parts += [F.when(F.length(c[k].cast("string")) > 0, F.concat(F.lit(f"{label}: "), c[k].cast("string"))) for label, k in labels if k in c]
    return F.concat_ws(" | ", *parts)
