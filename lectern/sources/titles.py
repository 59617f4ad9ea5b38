"""Title sources: list files and directories, first record per normalized key."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import is_uninformative
from ..functions.titles import base_name, clean_title, collapse_doubled_extension, extension_of, normal_key, normalize_title, stem_of, strip
from ..operators.reconcile import first_per_key


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, line)`` of text files; a file's line order is kept."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.select("file", F.posexplode(F.split("value", r"\r\n|\r|\n", -1)).alias("pos", "line"))


def title_lines(lines: DataFrame) -> DataFrame:
    """Lines that are titles: not blank, no comment, no list marker, no shell prompt."""
    line = strip(F.col("line"))
    prompt = line.contains("@") & line.rlike(r"[%$>]")
    return lines.withColumn("line", line).where((F.length("line") > 0) & ~F.col("line").startswith("#") & (F.col("line") != "_Book_list") & ~prompt)


def records(lines: DataFrame, path: str) -> DataFrame:
    """``(clean_title, raw_title, normalized_title, source_path)``, the first of each key; the key comes from the raw line."""
    rows = title_lines(lines).select("pos", F.col("line").alias("raw_title"), clean_title(F.col("line")).alias("clean_title"), normalize_title(F.col("line")).alias("normalized_title"))
    rows = rows.where(F.length("clean_title") > 0).withColumn("source_path", F.lit(path))
    return first_per_key(rows, "normalized_title", "pos").select("clean_title", "raw_title", "normalized_title", "source_path")


def list_titles(spark: SparkSession, path: str) -> DataFrame:
    return records(raw_lines(spark, path), path)


def list_directory(spark: SparkSession, path: str, recursive: bool = False, include_dirs: bool = True, hidden: bool = False) -> DataFrame:
    """``(name, path, is_dir)`` of a mounted directory, in name order. Names only; contents are read by tasks."""
    rows = []
    for at, dirs, files in os.walk(path):
        names = [(n, False) for n in files] + ([(n, True) for n in dirs] if include_dirs else [])
        rows += [(n, os.path.join(at, n), d) for n, d in sorted(names) if hidden or not n.startswith(".")]
        if not recursive:
            break
        dirs[:] = sorted(d for d in dirs if hidden or not d.startswith("."))
    return spark.createDataFrame(rows, "name string, path string, is_dir boolean")


def directory_titles(entries: DataFrame, front_matter: DataFrame | None = None) -> DataFrame:
    """Records of directory entries; where a cleaned title tells nothing, ``front_matter(path, title)`` may have a better one.

    The key is made from the cleaned title, which is thus cleaned twice.
    """
    rows = entries.select("path", F.col("name").alias("raw_title"), clean_title(F.col("name")).alias("clean_title"))
    if front_matter is not None:
        rows = rows.join(front_matter.select("path", F.col("title").alias("found")), "path", "left")
        better = is_uninformative(F.col("clean_title")) & ~is_uninformative(F.col("found"))
        rows = rows.withColumn("clean_title", F.when(better, clean_title(F.col("found"))).otherwise(F.col("clean_title"))).drop("found")
    rows = rows.where(F.length("clean_title") > 0).withColumn("normalized_title", normalize_title(F.col("clean_title")))
    return first_per_key(rows, "normalized_title", "path").select("clean_title", "raw_title", "normalized_title", F.col("path").alias("source_path"))


def filename_records(names: DataFrame, name: str = "name") -> DataFrame:
    """``(original_filename, cleaned_title, extension)`` of names; doubled extensions collapse."""
    c = collapse_doubled_extension(strip(F.col(name)))
    title = strip(F.regexp_replace(F.regexp_replace(stem_of(c), "[_-]", " "), r"\s+", " "))
    return names.where((F.length(strip(F.col(name))) > 0) & ~strip(F.col(name)).startswith("#")).select(F.col(name).alias("original_filename"), title.alias("cleaned_title"), extension_of(c).alias("extension"))


def load_titles(spark: SparkSession, path: str) -> DataFrame:
    """Names from a directory's files or a text file's lines."""
    if os.path.isdir(path):
        return list_directory(spark, path, include_dirs=False, hidden=True).select("name")
    return raw_lines(spark, path).select(F.col("line").alias("name"))


__all__ = ["base_name", "directory_titles", "filename_records", "list_directory", "list_titles", "load_titles", "normal_key", "raw_lines", "records", "title_lines"]
