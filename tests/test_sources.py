import io
import sqlite3
import zipfile

from pyspark.sql import functions as F

from lectern.sources import documents as D
from lectern.sources import sinks, sqlite, titles
from lectern.sources.store import Store
from lectern.streaming.incremental import merge_stream


def test_lists_and_directories(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# comment\n\nme@host % ls\n_Book_list\nalpha_book.pdf\nAlpha Book\nbeta.epub\n")
    got = {r.normalized_title: r for r in titles.list_titles(spark, str(tmp_path / "list.txt")).collect()}
    assert set(got) == {"alpha book", "beta"} and got["alpha book"].raw_title == "alpha_book.pdf"
    d = tmp_path / "dir"
    (d / "sub").mkdir(parents=True)
    for n in ("alpha-book.pdf", ".hidden", "20240319.pdf"):
        (d / n).write_text("x")
    entries = titles.list_directory(spark, str(d))
    assert {r.name for r in entries.collect()} == {"alpha-book.pdf", "20240319.pdf", "sub"}
    front = spark.createDataFrame([(str(d / "20240319.pdf"), "Hands-On Artificial Intelligence for IoT")], "path string, title string")
    assert "Hands-On Artificial Intelligence for IoT" in {r.clean_title for r in titles.directory_titles(entries, front).collect()}
    names = titles.load_titles(spark, str(d))
    assert ".hidden" in {r.name for r in names.collect()}
    f = titles.filename_records(spark.createDataFrame([("my_book.pdf.pdf",), ("# no",), ("",)], "name string")).collect()
    assert [(r.cleaned_title, r.extension) for r in f] == [("my book", ".pdf")]


def epub(opf=True):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("ch2.xhtml", "<h2>Two</h2><p>Second &amp; last.</p>")
        z.writestr("ch1.xhtml", "<html><style>x</style></html>")
        if opf:
            z.writestr("META-INF/container.xml", '<container><rootfile full-path="a.opf"/></container>')
            z.writestr("a.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Title</dc:title><dc:creator>Ann</dc:creator><dc:date>2024-05-01</dc:date><dc:identifier>urn:isbn:9781804619999</dc:identifier></package>')
    return b.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "b.md").write_bytes(b"intro\r\n# One\nbody one\n## Two\nbody two\n")
    (tmp_path / "c.txt").write_text("plain text")
    (tmp_path / "d.bin").write_text("x")
    rows = D.files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: [tuple(p) for p in r.pages] for r in D.document_pages(rows).collect()}
    assert got == {"a.epub": [(2, "Two Second & last.", "Two")], "b.md": [(1, "intro", None), (2, "body one", "One"), (3, "body two", "Two")], "c.txt": [(1, "plain text", None)]}
    fm = {r.path.rsplit("/", 1)[1]: r for r in D.epub_front_matter(rows).collect()}
    assert (fm["a.epub"].title, fm["a.epub"].author, fm["a.epub"].published, fm["a.epub"].isbn) == ("A Title", "Ann", "2024", "9781804619999")
    assert fm["bad.epub"].title is None


def test_page_front_matter(spark):
    meta = spark.createDataFrame([("p", {"Title": "Microsoft Word - x", "Author": "Adobe", "CreationDate": "D:20210304"}, "Packt>\nA Real Title\nIts long subtitle\n", "By Jane Roe\nThird Edition\nISBN 978-1-80461-123-4 O'Reilly Media")], "path string, info map<string,string>, first_page string, text string")
    r = D.page_front_matter(meta).first()
    assert (r.title, r.subtitle, r.author, r.publisher, r.published, r.revision, r.edition, r.isbn) == ("A Real Title", "Its long subtitle", "Jane Roe", "O'Reilly Media", "2021", 3, "3rd Edition", "9781804611234")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "b.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT, price REAL)")
        c.executemany("INSERT INTO books VALUES (?, ?, ?)", [(i, f"t{i}", i / 2) for i in range(1, 21)])
    df = sqlite.read_sqlite(spark, path, partitions=3)
    assert df.count() == 20 and df.agg(F.sum("price")).first()[0] == 105.0
    assert [r.id for r in sqlite.read_sqlite(spark, path, limit=2).collect()] == [1, 2]
    sqlite.write_sqlite(df, path, "copy")
    assert sqlite.read_sqlite(spark, path, "copy").count() == 20


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'b "q"', None), (1, "a", 3)], "id long, t string, n int")
    sinks.write_csv(df, str(tmp_path / "o"), single=True)
    text = next((tmp_path / "o").glob("part*.csv")).read_text()
    assert text == 'id,t,n\n1,a,3\n2,"b ""q""",\n'


def test_stream_merges_twice(spark, tmp_path):
    src, schema = str(tmp_path / "in"), spark.createDataFrame([(1, "a")], "id long, t string").schema
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src)
    merge_stream(spark, src, schema, str(tmp_path / "t"), "id", str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, "z")], schema).write.mode("append").parquet(src)
    merge_stream(spark, src, schema, str(tmp_path / "t"), "id", str(tmp_path / "cp")).awaitTermination()
    store = Store(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, store.read("rows").collect())) == [(1, "a"), (2, "z")] and store.manifest()["properties"] == {"batch:rows": 1}
    assert sorted(map(tuple, store.read("rows", as_of=1).collect())) == [(1, "a"), (2, "b")]


def test_front_matter_by_suffix(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.bin").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r for r in D.front_matter(D.files(spark, str(tmp_path))).collect()}
    assert got["a.epub"].title == "A Title" and got["b.bin"].source == "unsupported_format"


def test_schema(spark):
    from lectern import schema as S

    assert len(S.BOOKS) == 26
    df = spark.createDataFrame([(1, "t", 2.5)], "id long, clean_title string, extra double")
    assert S.conform(df, defaults=S.DEFAULTS).first().language == "en" and S.conform(df).schema.fieldNames() == S.BOOKS.fieldNames()
    assert ("extra", "unknown") in S.differences(df) and ("author", "missing") in S.differences(df)
    assert S.differences(S.create(spark)) == [] and "extra" in S.add_missing(df).columns
    chunks = spark.createDataFrame([(1,), (2,)], "book_id long")
    assert [r.book_id for r in S.orphans(chunks, df).collect()] == [2] and S.drop_orphans(chunks, df).count() == 1


def test_cli_reconcile(spark, tmp_path, capsys):
    from lectern.cli import main

    (tmp_path / "list").write_text("alpha_book.pdf\nbeta.pdf\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "Alpha Book.epub").write_text("x")
    main(["reconcile", "--list", str(tmp_path / "list"), "--directory", str(tmp_path / "d")])
    assert "Matched: 1 (50.0%)" in capsys.readouterr().out
