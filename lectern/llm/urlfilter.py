"""URL filter: rules first, then a character language-model ratio, in DataFrame functions only.

URLs that a rule decides train two variable-order Markov models, of accepted and of rejected URLs: the chance of
a character interpolates contexts of 0 to ``ORDER`` characters (Witten-Bell: an order is trusted by its count
against its number of distinct followers). A URL's score is the log-likelihood difference of all its characters, from
the scheme to the fragment, over their number. One part in ``HELD`` of the rule-decided URLs, by a digest, trains nothing and
calibrates the threshold, in the middle of the widest gap between scores at the least sum of both error rates; where it lacks accepted or rejected ones the threshold is 0.

Everything is counted on distinct windows (a context with its character): windows are pre-aggregated with class
counts, each distinct window is scored once, and URLs meet the scores in one join, the few windows that a large share of them holds by broadcast.
Scores are whole millionths, so sums do not depend on order. The threshold and the sums over all windows reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, join_counted, tasks

ORDER = 4
#: Bins of a hundredth of a nat a character for calibration.
BIN = 10_000
MICRO = 1_000_000
ALPHABET = 256
#: One rule-decided URL in so many is held out for calibration.
HELD = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's string and verdict, null where none fits."""
    out_rule, out_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out_rule = F.when(fits, rule_host + rule_path).otherwise(out_rule)
        out_verdict = F.when(fits, verdict).otherwise(out_verdict)
    return out_rule, out_verdict


def _windows(text: Column, order: int) -> Column:
    """Each character of the text and its end mark with up to ``order`` characters before it."""
    marked = F.concat(text, F.lit("\n"))
    return F.transform(F.sequence(F.lit(1), F.length(marked)), lambda i: F.substring(marked, F.greatest(F.lit(1), i - order), F.least(i, F.lit(order + 1))))


def _scored_windows(windows: DataFrame, order: int) -> DataFrame:
    """``windows(window, n, good, bad)``, counts by class -> ``(window, n, score)``, millionths of the log ratio."""
    out = windows.select("window", "n", F.lit(1.0 / ALPHABET).alias("p_good"), F.lit(1.0 / ALPHABET).alias("p_bad"))
    for o in range(order + 1):
        # windows at the start of a text are shorter: they take part in the orders that they have
        gram = F.substring("window", -(o + 1), o + 1)
        grams = windows.where(F.length("window") > o).groupBy(gram.alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        sums = [F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.sum((F.col("good") > 0).cast("long")).alias("t_good"), F.sum((F.col("bad") > 0).cast("long")).alias("t_bad")]
        if o:
            context = F.substring("gram", 1, o)
            table = grams.withColumn("context", context).join(grams.groupBy(context.alias("context")).agg(*sums), "context").drop("context")
        else:  # one context, the empty one
            table = grams.withColumns({name: F.lit(value or 0) for name, value in grams.agg(*sums).first().asDict().items()})
        out = out.withColumn("gram", F.when(F.length("window") > o, gram)).join(table, "gram", "left")
        steps = []
        for k in ("good", "bad"):
            n, t, p = F.col(f"n_{k}"), F.col(f"t_{k}"), F.col(f"p_{k}")
            steps.append(F.when(n > 0, (F.col(k) + t * p) / (n + t)).otherwise(p).alias(f"p_{k}"))
        out = out.select("window", "n", *steps)
    return out.select("window", "n", F.round(F.log(F.col("p_good") / F.col("p_bad")) * MICRO).cast("long").alias("score"))


def _threshold(bins: DataFrame) -> int | None:
    """The bin from which URLs are allowed; ``bins(bin, good, bad)`` is bounded by the range of scores.

    All cuts between two occupied bins cost the same: of the widest such gap at the least cost, the middle.
    """
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    low = F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin") - 1)
    x = bins.select("bin", low.alias("low"), F.coalesce(F.sum("good").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("caught"), F.sum("good").over(every).alias("n_good"), F.sum("bad").over(every).alias("n_bad"))
    cost = F.col("lost") / F.col("n_good") + (F.col("n_bad") - F.col("caught")) / F.col("n_bad")
    best = x.where("n_good > 0 and n_bad > 0").select("bin", "low", cost.alias("cost")).orderBy("cost", F.col("low") - F.col("bin"), "bin").first()
    return best and (best["low"] + best["bin"] + 1) // 2


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """``pages(page_id, url, ...)`` -> ``(page_id, host, path, rule, verdict, score)``, a row for each input row.

    A null url, or one without ``://``, has an empty host and path and fits no rule; the model judges it by its
    characters like any other (a null url by none). ``score`` is the model's difference in millionths of a nat a character, null
    where a rule decides. Where rules accept or reject nothing there is no model and what no rule decides is allowed.
    Equal URLs are scored once. Extra columns are not read; an empty table gives an empty table.
    """
    url = F.col("url").cast("string")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("text"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = cut(parsed.select("page_id", "text", "host", "path", rule.alias("rule"), verdict.alias("by_rule")))
    held = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long") % HELD == 0
    texts = judged.groupBy("text").agg(F.sum((F.coalesce("by_rule", F.lit("")) == "allow").cast("long")).alias("good"), F.sum((F.coalesce("by_rule", F.lit("")) == "block").cast("long")).alias("bad"))
    texts = cut(texts.select("*", held.alias("held"), F.monotonically_increasing_id().alias("id")))
    # dealt out anew: a few small files would be one task, and each row becomes as many as it has characters
    train = [F.when(F.col("held"), 0).otherwise(F.col(c)).alias(c) for c in ("good", "bad")]
    each = texts.repartition(tasks(pages.sparkSession), "id").select("id", *train, F.explode(_windows(F.col("text"), order)).alias("window"))
    windows = cut(each.groupBy("window").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    scores = cut(_scored_windows(windows, order))
    # the planner takes exploded rows to be as small as their texts: never broadcast them
    own = each.groupBy("id", "window").agg(F.count("*").alias("times")).hint("merge")
    met = join_counted(own, scores, ["window"])
    scored = cut(met.groupBy("id").agg(F.sum(F.col("times") * F.col("score")).alias("total"), F.sum("times").alias("n")).join(texts, "id"))
    discard(windows, scores)
    mean = F.col("total") / F.col("n")
    decided = scored.where("good + bad > 0").withColumn("bin", F.floor(mean / BIN))
    trained = decided.where("not held").agg(F.sum("good"), F.sum("bad")).first()
    by_model = F.lit("allow")
    if all(trained):
        least = _threshold(decided.where("held").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
        by_model = F.when(F.floor(mean / BIN) >= (least or 0), "allow").otherwise("block")
    model = scored.select("text", by_model.alias("by_model"), F.round(mean, 3).alias("score"))
    out = judged.join(model, "text", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_model", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
