from pyspark.sql import functions as F

from lectern.functions import metadata as M
from lectern.functions import text as T
from lectern.operators.enrich import FRONT_SCHEMA, LOOKUP_SCHEMA, enrich, lookups_to_fetch


def one(spark, build, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(build(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first().x


def test_html(spark):
    assert one(spark, T.html_snippet, "<p>This is a <b>great</b> book overview.<br>Contains technical details.</p>") == "This is a great book overview. Contains technical details."
    assert one(spark, T.html_to_text, "<p>This is <strong>important</strong> text.<script>alert(1)</script></p>") == "This is important text."


def test_references_cut_off_before_their_semicolon(spark, tmp_path):
    import duckdb

    from lectern.oracle import ORACLE_SQL
    from lectern.queries import QUERIES

    pages = [(1, "<p>a &amp; b &amp</p>&copy; 1 &middot; &quot;x&quot"), (2, "&am<p>&amp;amp; &amp;copy; &ampx; &nosuch;</p>"), (3, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["html_unescaped"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.sql(ORACLE_SQL["html_unescaped"]).fetchall())
    assert got[0] == (1, 'a & b &amp © 1 · "x&quot')
    assert one(spark, lambda c: T.unescape(c, closed=True), "&#38;&#x26;&lt;&eacute; &eacute") == "&&<é &eacute"
    assert one(spark, T.unescape, "&eacute &amp") == "é &"


def test_file_info(spark):
    want = {"book.pdf": ("PDF", ".pdf"), "manifest.md": ("Markdown", ".md"), "synth_bom.csv.docx": ("Word (DOCX)", ".csv.docx"), "course_pack_folder": ("Directory / Folder", ""), "x.abc": ("ABC", ".abc"), ".hidden": ("Directory / Folder", "")}
    for name, pair in want.items():
        assert tuple(one(spark, M.file_info, name)) == pair, name


def test_authors(spark):
    assert one(spark, M.author, "[Frank D. Petruzella] Electric Motors.pdf", "Electric Motors") == "Frank D. Petruzella"
    assert one(spark, M.author, "x", "The Art of Electronics") == "Paul Horowitz & Winfield Hill"
    assert one(spark, M.author, "Digital Fundamentals Floyd.pdf", "Digital Fundamentals Floyd") == "Thomas L. Floyd"
    assert one(spark, M.author, "[ WebToolTip.com ] A", "A Book by Jane Roe") == "Jane Roe"
    assert one(spark, M.author, "[Udemy] A", "A") is None


def test_editions(spark):
    assert tuple(one(spark, M.edition_info, "Book 3rd Edition", "")) == (3, "3rd Edition")
    assert tuple(one(spark, M.edition_info, "x pack-5", "")) == (5, "Pack 5")
    assert tuple(one(spark, M.edition_info, "x", "111th ed")) == (111, "111st Edition")
    assert tuple(one(spark, M.edition_info, "x v7", "")) == (7, "Version 7.0")


def test_taxonomy_and_media(spark):
    t = one(spark, M.taxonomy, "Agentic AI in practice", "Agentic AI in Practice")
    assert (t.domain, t.subject) == ("Computer Science & Artificial Intelligence", "Artificial Intelligence & Machine Learning")
    assert tuple(one(spark, M.media_class, "a book", "A Book", "PDF")) == ("Book / Ebook", 0)
    assert tuple(one(spark, M.media_class, "Udemy python", "Udemy Python", "PDF")) == ("Course / Video Series", 0)
    assert tuple(one(spark, M.media_class, "130+ things", "130+ Things", "PDF")) == ("Collection / Resource Pack", 1)


def test_uninformative(spark):
    yes = ["20240319.pdf", "2024-03-19", "0123456789abcdef0123", "untitled.pdf", "scan", "packt_20240319", "12", "", None, "123e4567-e89b-12d3-a456-426614174000", "free-learning.pdf", "1-2 3", "ab"]
    no = ["The Art of Electronics", "Python 3", "AWS Certification", "abc", "Clean Code.pdf", "2024 Report"]
    assert all(one(spark, M.is_uninformative, x) for x in yes)
    assert not any(one(spark, M.is_uninformative, x) for x in no)


def test_isbn(spark):
    assert [one(spark, M.isbn_valid, x) for x in ("978-1-80461-123-4", "0-13-110362-8", "12345")] == [True, True, False]
    assert one(spark, M.find_isbn, "see ISBN 978-1-80461-123-4 and 0-13-110362-8") == "9781804611234"


def test_jaccard(spark):
    assert one(spark, M.jaccard, "Clean Code", "clean CODE") == 1.0
    assert one(spark, M.jaccard, "a b", "c d") == 0.0
    assert one(spark, M.jaccard, "", "c d") == 0.0


def test_enrich_precedence(spark):
    books = spark.createDataFrame([(1, "20240319", "20240319.pdf", "/b/20240319.pdf", 1), (2, "Deep Learning by Jane Roe", "Deep Learning by Jane Roe", None, 0)], "id long, clean_title string, raw_title string, source_path string, in_directory int")
    front = spark.createDataFrame([("/b/20240319.pdf", "Hands-On Artificial Intelligence for IoT", None, "A. Kapoor", None, "2019", None, "9781788836067", 4, None, "short", "pdf_front_matter")], FRONT_SCHEMA)
    cache = spark.createDataFrame([("deep learning by jane roe", True, (None, None, None, "MIT Press", "2016", "de", "x" * 30, "OpenLibrary", 3))], LOOKUP_SCHEMA)
    got = {r.id: r for r in enrich(books, front, cache).collect()}
    assert got[1].clean_title == "Hands-On Artificial Intelligence for IoT"
    assert (got[1].author, got[1].published, got[1].revision, got[1].edition, got[1].source) == ("A. Kapoor", "2019", 4, "4th Edition", "pdf_front_matter")
    assert got[1].summary.startswith("A comprehensive")
    assert (got[2].author, got[2].publisher, got[2].language, got[2].edition, got[2].summary) == ("Jane Roe", "MIT Press", "de", "3th Edition", "x" * 30)
    assert lookups_to_fetch(books, cache).count() == 0


def test_stems():
    want = {"running": "run", "generously": "generous", "happily": "happili", "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "knack": "knack", "consistency": "consist", "flies": "fli", "cries": "cri", "ties": "tie"}
    assert {w: T.stem(w) for w in want} == want
