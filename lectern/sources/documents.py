"""Document readers: files to arrays of pages, and front matter. Bytes are opened by tasks, one file at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import clean_isbn, find_isbn, is_uninformative, isbn_valid, nonblank, page_publisher, pdf_year
from ..functions.text import clean_text, html_heading, html_to_text
from ..functions.titles import squeeze, strip

PAGES = "array<struct<page_number:int,text:string,section_title:string>>"
TEXT_SUFFIXES = ("txt", "md", "markdown", "rst", "json", "csv", "py")
_RAW = "path string, page_number int, raw string"


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``(path, suffix, content)`` of files on any store that Spark reads."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "content")


def sections(text: Column) -> Column:
    """Markdown split at headings: numbered parts with the heading above each; without any, one page."""
    clean = clean_text(F.regexp_replace(text, "\r\n?", "\n"))
    marked = F.regexp_replace(clean, r"(?m)^(#+\s+.+)$", "\u0001$1\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda p: F.length(p) > 0)
    start = F.struct(F.lit(None).cast("string").alias("heading"), F.array().cast(PAGES).alias("pages"))
    folded = F.aggregate(
        parts,
        start,
        lambda acc, p: F.when(p.startswith("#"), F.struct(strip(F.regexp_replace(p, "^#+", "")).alias("heading"), acc["pages"].alias("pages"))).otherwise(
            F.struct(acc["heading"].alias("heading"), F.concat(acc["pages"], F.array(F.struct((F.size(acc["pages"]) + 1).alias("page_number"), p.alias("text"), acc["heading"].alias("section_title")))).alias("pages"))
        ),
    )["pages"]
    whole = F.array(F.struct(F.lit(1).alias("page_number"), clean.alias("text"), F.lit(None).cast("string").alias("section_title"))).cast(PAGES)
    return F.when(F.length(clean) == 0, F.array().cast(PAGES)).when(F.size(folded) > 0, folded).otherwise(whole)


def text_pages(rows: DataFrame) -> DataFrame:
    """``(path, pages)`` of text and Markdown files."""
    return rows.where(F.col("suffix").isin(*TEXT_SUFFIXES)).select("path", sections(F.make_valid_utf8(F.col("content").cast("string"))).alias("pages"))


def _epub_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.lower().endswith((".html", ".xhtml", ".htm")))
                    rows = [(path, i, z.read(n).decode("utf-8", "replace")) for i, n in enumerate(names, 1)]
            except (zipfile.BadZipFile, KeyError, OSError):
                pass
            yield pd.DataFrame(rows, columns=["path", "page_number", "raw"])


def epub_pages(rows: DataFrame) -> DataFrame:
    """One page a chapter with text, numbered by its place among all; its first heading is the section."""
    raw = rows.where(F.col("suffix").isin("epub", "ibooks")).select("path", "content").mapInPandas(_epub_members, _RAW)
    page = F.struct("page_number", html_to_text(F.col("raw")).alias("text"), html_heading(F.col("raw")).alias("section_title"))
    return raw.select("path", page.alias("p")).where(F.length("p.text") > 0).groupBy("path").agg(F.array_sort(F.collect_list("p")).cast(PAGES).alias("pages"))


def _pdf_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        from pypdf import PdfReader
    except ImportError:
        PdfReader = None
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            try:
                for i, page in enumerate(PdfReader(io.BytesIO(content)).pages if PdfReader else [], 1):
                    try:
                        rows.append((path, i, page.extract_text() or ""))
                    except Exception:
                        continue
            except Exception:
                rows = []
            yield pd.DataFrame(rows, columns=["path", "page_number", "raw"])


def pdf_pages(rows: DataFrame) -> DataFrame:
    """One page for each PDF page with text; needs pypdf on the workers, without it there are no pages."""
    raw = rows.where("suffix = 'pdf'").select("path", "content").mapInPandas(_pdf_texts, _RAW)
    page = F.struct("page_number", clean_text(F.col("raw")).alias("text"), F.lit(None).cast("string").alias("section_title"))
    return raw.select("path", page.alias("p")).where(F.length("p.text") > 0).groupBy("path").agg(F.array_sort(F.collect_list("p")).cast(PAGES).alias("pages"))


def document_pages(rows: DataFrame, max_pages: int | None = None) -> DataFrame:
    """``(path, pages)`` by suffix; other files have none. Only pages up to the number ``max_pages`` are kept, if it is given."""
    out = text_pages(rows).union(epub_pages(rows)).union(pdf_pages(rows))
    if max_pages is None:
        return out
    return out.withColumn("pages", F.filter("pages", lambda p: p["page_number"] <= max_pages)).where(F.size("pages") > 0)


def _opf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tags = ("title", "creator", "publisher", "date", "language", "description", "identifier")
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            found: dict[str, list[str]] = {t: [] for t in tags}
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    at = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode("utf-8", "replace")) if "META-INF/container.xml" in names else None
                    opf = at[1] if at and at[1] in names else next((n for n in names if n.endswith(".opf")), None)
                    for e in ElementTree.fromstring(z.read(opf)).iter() if opf else ():
                        tag = e.tag.rpartition("}")[2]
                        if tag in found and (e.text or "").strip():
                            found[tag].append(e.text.strip())
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, OSError):
                pass
            rows.append((path, *[next(iter(found[t]), None) for t in tags[:-1]], " ".join(found["identifier"])))
        yield pd.DataFrame(rows, columns=["path", *tags])


def epub_front_matter(rows: DataFrame) -> DataFrame:
    """Dublin Core of EPUB packages: title, author, publisher, published, language, summary, isbn."""
    raw = rows.where(F.col("suffix").isin("epub", "ibooks")).select("path", "content").mapInPandas(_opf, "path string, title string, creator string, publisher string, date string, language string, description string, identifier string")
    year = F.coalesce(nonblank(F.regexp_extract("date", r"\b((?:19|20)\d{2})\b", 1)), F.col("date"))
    about = nonblank(squeeze(F.regexp_replace("description", r"<[^>]+>", " ")))
    number = F.coalesce(find_isbn(F.col("identifier")), F.when(isbn_valid(F.col("identifier")), clean_isbn(F.col("identifier"))))
    return raw.select("path", "title", F.col("creator").alias("author"), "publisher", year.alias("published"), "language", about.alias("summary"), number.alias("isbn"), F.lit("epub_opf").alias("source"))


# Titles and authors that tools write, and years, editions and bylines of front matter.
_TOOL_TITLES = r"(?i)(microsoft\s+word|untitled|latex\s+to\s+pdf|adobe\s+acrobat|indd)"
_TOOL_AUTHORS = r"(?i)(adobe|acrobat|word|latex|canva|microsoft|print|publisher)"
_YEAR = r"(?i)(?:First\s+published|Published\s+in|Published|Copyright\s+©|Copyright|©)\s*(?:in)?\s*(?:[A-Za-z]+\s+)?(19\d\d|20\d\d)"
_EDITION = r"(?i)\b(First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|\d+(?:st|nd|rd|th))\s+Edition\b"
_BYLINE = r"\b(?:Written\s+by|By)\s+([A-Z][A-Za-z\s.,&]+?)(?:\r|\n|Published|Packt|O'Reilly|Wiley|$)"
_NOISE = r"(?i)^(packt>|packt|o'reilly|wiley|manning|chapter|\d+|page\s+\d+|www\..+)$"
_NTH = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def page_front_matter(meta: DataFrame) -> DataFrame:
    """Rules over ``(path, info map<string,string>, first_page, text)``: metadata first, then what the pages say."""
    info = lambda k: F.col("info")[k]
    title = F.when(~is_uninformative(info("Title")) & ~info("Title").rlike(_TOOL_TITLES), strip(info("Title")))
    author = F.when(~is_uninformative(info("Author")) & ~info("Author").rlike(_TOOL_AUTHORS), strip(info("Author")))
    about = F.when((F.length(info("Subject")) > 5) & ~is_uninformative(info("Subject")), strip(info("Subject")))
    year = F.coalesce(pdf_year(info("CreationDate")), pdf_year(info("ModDate")), nonblank(F.regexp_extract("text", _YEAR, 1)))
    made_by = F.concat_ws(" ", F.coalesce(info("Producer"), F.lit("")), F.coalesce(info("Creator"), F.lit("")))
    word = F.lower(F.regexp_extract("text", _EDITION, 1))
    nth = F.coalesce(nonblank(F.regexp_extract(word, r"^(\d+)", 1)).cast("int"), F.create_map(*[F.lit(x) for i, w in enumerate(_NTH, 1) for x in (w, i)])[word])
    label = F.concat(nth.cast("string"), F.when(nth == 1, "st").when(nth == 2, "nd").when(nth == 3, "rd").otherwise("th"), F.lit(" Edition"))
    lines = F.filter(F.transform(F.split("first_page", r"\r\n|\r|\n"), strip), lambda x: (F.length(x) > 2) & ~x.rlike(_NOISE))
    one, two = F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2))
    by_line = strip(F.regexp_extract("text", _BYLINE, 1))
    by_line = F.when(F.length(by_line).between(4, 59) & ~by_line.rlike(r"(?i)(packt|press|wiley|media)"), by_line)
    sub = F.when(title.isNull() & (F.length(two) > 5) & ~F.lower(two).startswith("by "), two)
    return meta.select(
        "path", F.coalesce(title, one).alias("title"), sub.alias("subtitle"), F.coalesce(author, by_line).alias("author"), F.coalesce(page_publisher(made_by), page_publisher(F.col("text"))).alias("publisher"),
        year.alias("published"), find_isbn(F.col("text")).alias("isbn"), nth.alias("revision"), label.alias("edition"), about.alias("summary"), F.lit("pdf_front_matter").alias("source"),
    )


def _pdf_info(max_pages: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                info, texts = {}, []
                try:
                    reader = PdfReader(io.BytesIO(content)) if PdfReader else None
                    info = {str(k).lstrip("/"): str(v) for k, v in (reader.metadata or {}).items()} if reader else {}
                    texts = [p.extract_text() or "" for p in reader.pages[:max_pages]] if reader else []
                except Exception:
                    pass
                rows.append((path, info, texts[0] if texts else "", "\n".join(texts)))
            yield pd.DataFrame(rows, columns=["path", "info", "first_page", "text"])

    return run


def pdf_front_matter(rows: DataFrame, max_pages: int = 5) -> DataFrame:
    """Front matter of PDF files: bytes to the info dictionary and first pages in Python, all rules as Columns."""
    meta = rows.where("suffix = 'pdf'").select("path", "content").mapInPandas(_pdf_info(max_pages), "path string, info map<string,string>, first_page string, text string")
    return page_front_matter(meta)


def front_matter_of(paths: DataFrame, rows: DataFrame, max_pages: int = 5) -> DataFrame:
    """Front matter of every one of ``paths(path)``; one that is not among ``rows`` gets a row that says so."""
    gone = paths.select("path").distinct().join(rows.select("path"), "path", "left_anti").select("path", F.lit("file_not_found").alias("source"))
    return front_matter(rows, max_pages).unionByName(gone, allowMissingColumns=True)


def front_matter(rows: DataFrame, max_pages: int = 5) -> DataFrame:
    """Front matter by suffix; other files get a row that says so."""
    other = rows.where(~F.coalesce(F.col("suffix"), F.lit("")).isin("pdf", "epub", "ibooks")).select("path", F.lit("unsupported_format").alias("source"))
    return pdf_front_matter(rows, max_pages).unionByName(epub_front_matter(rows), allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
