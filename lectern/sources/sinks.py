"""Exports: CSV, text, JSON reports, search results. Files go where Spark writes them; reports are bounded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: str = "id", single: bool = False) -> None:
    """Header, minimal quoting, null as empty, ordered by id: range-partitioned files in order, or one for small tables."""
    out = df.orderBy(order)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def json_report(summary: DataFrame, statuses: DataFrame) -> DataFrame:
    """One JSON object a line: the summary first, then a line for each record with its status."""
    head = summary.select(F.to_json(F.struct(F.lit("summary").alias("kind"), *[c for c in summary.columns if c != "match_rate"], F.round("match_rate", 2).alias("match_rate_percent"))).alias("value"))
    rows = statuses.select(F.to_json(F.struct(F.col("status").alias("kind"), "list", "dir")).alias("value"))
    return head.union(rows)


def report_text(summary: DataFrame, statuses: DataFrame, preview: int = 10) -> str:
    """A console report: totals, rates, and a few titles of each status."""
    s = summary.first()
    out = [f"Listed: {s['total_list']}", f"In directory: {s['total_dir']}", f"Matched: {s['matched']} ({s['match_rate']:.1f}%)", f"Missing: {s['missing_from_dir']}", f"Unlisted: {s['unlisted_in_dir']}"]
    for status, side in (("missing", "list"), ("unlisted", "dir")):
        rows = statuses.where(F.col("status") == status).select(f"{side}.clean_title").orderBy("clean_title").limit(preview).collect()
        out += [f"{status}:"] + [f"  - {r[0]}" for r in rows]
    return "\n".join(out)


def rounded(results: DataFrame, places: int = 4) -> DataFrame:
    """Search results with their scores rounded."""
    return results.withColumns({c: F.round(c, places) for c in ("similarity", "rank", "score") if c in results.columns})


def result_lines(results: DataFrame, title: str = "clean_title", score: str = "score", body: str = "content", width: int = 160) -> DataFrame:
    """Search results as lines of four decimals and an excerpt."""
    excerpt = F.regexp_replace(F.substring(F.col(body), 1, width), r"\s+", " ")
    return results.select(F.concat(F.format_number(score, 4), F.lit("  "), F.col(title), F.lit("  "), excerpt).alias("line"))
