"""Cited passages, a context within a budget of characters, and a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import strip

# The texts of a context and a prompt.
NOTHING = "No relevant context passages found in database."
INSTRUCTION = (
    "You are an expert technical AI research assistant. Answer the user's question accurately "
    "and concisely using only the retrieved library passages below. Always cite your source "
    "book titles and page numbers when stating facts."
)
HEAD, FOOT = "=== RETRIEVED LIBRARY CONTEXT ===", "=" * 33


def citation(title: Column, author: Column, section: Column, page: Column) -> Column:
    """``《title》 | by author | Section: section | p. page``; blank parts and page 0 are left out."""
    part = lambda before, c: F.when(F.length(c.cast("string")) > 0, F.concat(F.lit(before), c.cast("string")))
    return F.concat_ws(" | ", F.concat(F.lit("《"), title, F.lit("》")), part("by ", author), part("Section: ", section), F.when(page != 0, F.concat(F.lit("p. "), page.cast("string"))))


def context(results: DataFrame, rank: str, cited: str, content: str, most: int = 8000) -> DataFrame:
    """One row ``(context)`` of a bounded ranked list: a prefix of passages within the budget, the first always."""
    entry = F.concat(F.lit("--- [Passage "), F.col("n").cast("string"), F.lit("] "), F.col(cited), F.lit(" ---\n"), strip(F.col(content)), F.lit("\n"))
    by = Window.orderBy(rank)
    rows = results.withColumn("n", F.row_number().over(by)).withColumn("entry", entry)
    rows = rows.withColumn("used", F.sum(F.length("entry")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("n") == 1) | (F.col("used") <= most))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "\n")
    return rows.agg(F.count("*").alias("_n"), text.alias("context")).select(F.when(F.col("_n") > 0, F.col("context")).otherwise(NOTHING).alias("context"))


def prompt(contexts: DataFrame, question: str, instruction: str = INSTRUCTION) -> DataFrame:
    return contexts.select(F.concat(F.lit(f"{instruction}\n\n{HEAD}\n"), F.col("context"), F.lit(f"\n{FOOT}\n\nUser Question: {question}\n\nAnswer:")).alias("prompt"))
