"""Title functions: golden pairs of the catalog's own examples."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import titles as N


def run(spark, build, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


GOLDEN = {
    "📂 Project Manifest_ The Cybernetic Instrument.pdf": "Project Manifest: The Cybernetic Instrument",
    "150survivalsecrets.pdf": "150 Survival Secrets",
    "- Pay Bill.pdf": "Pay Bill",
    "15mathconceptseverydatascientistshouldknow (1).pdf": "15 Math Concepts Every Data Scientist Should Know",
    "automatetheboringstuffwithpython3rdedition.pdf": "Automate the Boring Stuff with Python 3rd Edition",
    "aws_certification_paths.pdf": "AWS Certification Paths",
    "all-in-one-electronics-guide.pdf": "All-in-One Electronics Guide",
    "Bayesian Statistics for Beginners - a step-by-step approach.pdf": "Bayesian Statistics for Beginners - A Step-by-Step Approach",
    "[ WebToolTip.com ] How To Clear Your Mind and Organize Your Life (2026)": "How to Clear Your Mind and Organize Your Life (2026)",
    "blackanddeckercompleteguidetowiring_preview.pdf": "Black & Decker Complete Guide to Wiring",
    "adafruit-ccs811-air-quality-sensor.pdf.pdf": "Adafruit Ccs811 Air Quality Sensor",
}


def test_clean_title(spark):
    got = run(spark, N.clean_title, list(GOLDEN) + [None, "", "  "])
    assert dict(zip(GOLDEN, got)) == GOLDEN
    assert got[-3:] == [None, "", ""]


@pytest.mark.parametrize("raw, want", [("book.pdf", "book"), ("sensor.pdf.pdf", "sensor"), ("archive.csv.docx", "archive"), ("simple_title", "simple_title"), (".pdf", ".pdf")])
def test_strip_extensions(spark, raw, want):
    assert run(spark, N.strip_extensions, [raw]) == [want]


def test_normalize(spark):
    got = run(spark, N.normalize_title, ["9781806029570 2.pdf", "9781806029570.pdf", "The Art of Electronics (1).pdf", "the art of electronics"])
    assert got[0] == got[1] == "9781806029570"
    assert got[2] == got[3]


def test_copy_suffix(spark):
    assert run(spark, N.strip_copy_suffix, ["A Title (12)", "A Title 2", "Volume 2", "Part. 3", "A_Book_1", "A_Title_1", "A 100"]) == ["A Title", "A Title", "Volume 2", "Part. 3", "A_Book_1", "A_Title", "A 100"]


def test_camel(spark):
    assert run(spark, N.split_camel_case, ["ESP32Guide", "CamelCaseTitle", "HTMLBook"]) == ["ESP32 Guide", "Camel Case Title", "HTML Book"]
