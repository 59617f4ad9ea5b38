"""Line dedup over the line-ID sequences of all documents, by prefix doubling, in DataFrame functions only.

The sequence of a document is the IDs of its lines that have words; its suffixes are ordered by their lines' IDs. Doubling
ranks them by their first 1, 2, 4, ... lines: the rank of 2**(k+1) lines is the rank, in a range sort of all distinct ones, of the
pair of ranks of its halves. A pair that occurs once in the corpus parts its suffix from all others, so the suffix's
place is found and its common prefixes with its neighbours are shorter: it is dropped.

Suffixes that agree in a prefix are neighbours, an interval of the order whose common prefix is that long. Two ranks of one
level, of overlapping blocks, tell whether a prefix of any length is common. Each suffix gets the interval of the shortest
prefix that holds ``least_words`` words; its first member in the order (doc_id, line) stays, all others are later copies. The
interval's members are then told apart by their next lines, as far as these add fewer than ``least_words``, which gives
every later copy the whole length of its longest match with an earlier one (longer matches are covered by the intervals of
their own later suffixes). The union of these maximal runs is deleted. Intervals are formed by equal ranks and not by a walk
over neighbours, since that would need the whole order in one pass.

Counts come before each shuffle, and rows of a hot line or prefix are never gathered: they meet its rank by broadcast. Only
rows of repeated lines go beyond the first count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, discard, join_counted, text_of

LEAST_WORDS = 50


def _name(*parts: Column | str) -> Column:
    """A 128-bit name of binary parts."""
    return F.unhex(F.md5(F.concat(*parts)))


def _sequences(docs: DataFrame) -> DataFrame:
    """``(d, t, pos, raw, w, id)``: one row for each line with words; ``raw`` counts all lines of the text from 0."""
    lines = F.transform(F.split(text_of(), "\n", -1), lambda x, i: F.struct(i.alias("raw"), F.regexp_count(x, F.lit(WORD)).alias("w"), x.alias("line")))
    solid = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("t"), F.filter(lines, lambda x: x["w"] > 0).alias("lines"))
    each = solid.select("d", "t", F.posexplode("lines").alias("pos", "x"))
    return each.select("d", "t", "pos", "x.raw", "x.w", _name(F.col("x.line").cast("binary")).alias("id"))


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number ``n`` of their rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (stored) whose keys occur more than once, with their ``rank`` in the keys' order for the keys.

    Ranks come from one range sort of the distinct keys, stored before they are used: they ascend, with gaps.
    """
    ranks = cut(_counts(rows, keys).sort(*keys).withColumn("rank", F.monotonically_increasing_id()))
    out = cut(join_counted(rows, ranks, keys).drop(*keys))
    discard(ranks, rows)
    return out


def _firsts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (stored) whose keys occur more than once, with the key's ``first`` place in the order (doc_id, text, line)."""
    place = F.struct(F.col("d").isNull().alias("no"), "d", "t", "pos")
    return join_counted(rows, cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")), keys)


def _later() -> Column:
    return ~(F.col("first.d").eqNullSafe(F.col("d")) & (F.col("first.t") == F.col("t")) & (F.col("first.pos") == F.col("pos")))


def _intervals(rows: DataFrame, least: int) -> DataFrame:
    """Each line's shortest stretch of repeated lines with ``least`` words, and the lines after it that may extend it."""
    by_doc = Window.partitionBy("d", "t")
    before = F.coalesce(F.sum("w").over(by_doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = by_doc.orderBy("before").rangeBetween(0, least - 1)
    after = F.struct("pos", "raw", "rank", (F.col("before") + F.col("w")).alias("end"))
    x = rows.withColumn("before", before.cast("long")).select(
        "*",
        F.max("pos").over(ahead).alias("last"),
        F.max("raw").over(ahead).alias("raw_last"),
        F.count("*").over(ahead).alias("lines"),
        F.max(F.col("before") + F.col("w")).over(ahead).alias("end"),
        F.collect_list(after).over(ahead).alias("near"),
    )
    x = x.withColumn("next", F.first("near").over(by_doc.orderBy("pos").rangeBetween(1, 1)))
    x = x.where((F.col("lines") == F.col("last") - F.col("pos") + 1) & (F.col("end") - F.col("before") >= least))
    own_end = F.col("before") + F.col("w")
    tail = F.filter(F.coalesce("next", F.array().cast("array<struct<pos:int,raw:int,rank:bigint,end:bigint>>")), lambda v: (v["pos"] > F.col("last")) & (v["end"] - own_end < least))
    tail = F.filter(tail, lambda v, i: v["pos"] == F.col("last") + 1 + i)
    return x.select("d", "t", "pos", "raw", "rank", "last", "raw_last", "lines", tail.alias("tail"))


def _levels(rows: DataFrame, most_lines: int) -> list[DataFrame]:
    """Ranks of the prefixes of 1, 2, 4, ... lines from each place, up to ``most_lines``; only prefixes that occur more than once."""
    out = [rows.select("d", "t", "pos", "rank")]
    while 2 ** len(out) <= most_lines:
        half = 2 ** (len(out) - 1)
        right = F.first("rank").over(Window.partitionBy("d", "t").orderBy("pos").rangeBetween(half, half))
        pairs = out[-1].select("d", "t", "pos", F.col("rank").alias("left"), right.alias("right")).where("right is not null")
        out.append(_ranked(cut(pairs), ["left", "right"]))
    return out


#: What names an interval: its length in lines and the ranks of two blocks that cover it, one at either end.
_INTERVAL = ["lines", "left", "right"]


def _named(intervals: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Intervals with the ranks of their two blocks; a stretch of which a block occurs once has no copy and is left out."""
    named = intervals.where("lines = 1").withColumns({"left": F.col("rank"), "right": F.col("rank")})
    for k in range(1, len(levels)):
        own = intervals.where((F.col("lines") >= 2**k) & (F.col("lines") < 2 ** (k + 1)))
        left = levels[k].withColumnRenamed("rank", "left")
        right = levels[k].select("d", "t", (F.col("pos") + 2**k - 1).alias("last"), F.col("rank").alias("right"))
        for other, key in ((left, "pos"), (right, "last")):
            other = other.select(F.col("d").alias("od"), F.col("t").alias("ot"), F.col(key).alias("ok"), other.columns[-1])
            own = own.join(other, F.col("d").eqNullSafe(F.col("od")) & (F.col("t") == F.col("ot")) & (F.col(key) == F.col("ok"))).drop("od", "ot", "ok")
        named = named.unionByName(own)
    return named.drop("rank")


def deleted_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(d, t, runs)``: the deleted stretches of lines of each document that has any, in order, both ends included."""
    # rows equal in id and text are one document
    rows = cut(_ranked(cut(_sequences(docs)), ["id"]).repartition("d", "t").dropDuplicates(["d", "t", "pos"]))
    intervals = cut(_intervals(rows, least_words))
    most = intervals.agg(F.max("lines")).first()[0] or 0
    repeated = cut(_firsts(cut(_named(intervals, _levels(rows, most))), _INTERVAL))
    runs = repeated.where(_later()).select("d", "t", "pos", "last", F.col("raw").alias("begin"), F.col("raw_last").alias("end"))
    # members of an interval by their next lines: the common prefix grows as long as an earlier member goes along
    step = repeated.where(F.size("tail") > 0).drop("first").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("tail"))))
    along = F.transform(F.slice("tail", 1, F.col("k")), lambda v: v["rank"].cast("string"))
    name = _name(F.concat_ws(",", *[F.col(c).cast("string") for c in _INTERVAL], along).cast("binary"))
    longer = step.select("d", "t", "pos", "raw", F.element_at("tail", F.col("k"))["pos"].alias("last"), F.element_at("tail", F.col("k"))["raw"].alias("end"), name.alias("longer"))
    longer = _firsts(cut(longer), ["longer"]).where(_later()).select("d", "t", "pos", "last", F.col("raw").alias("begin"), "end")
    by_doc = Window.partitionBy("d", "t").orderBy("pos", "last")
    all_ = runs.union(longer).withColumn("reach", F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    all_ = all_.withColumn("run", F.sum(F.when(F.col("pos") <= F.col("reach") + 1, 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = all_.groupBy("d", "t", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return merged.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its later copies of repeated line runs, and ``n_lines``, ``n_deleted``, ``runs``.

    A run is a stretch of lines that occurs earlier in the same lines, in order of (doc_id, text hash, line),
    and holds ``least_words`` words or more; its first copy stays. Lines without words do not break a run, and go
    if they stand between two lines that go. A null text stays null; a text of which all lines go becomes empty; no row is
    dropped. A null doc_id comes last in the order. Rows equal in doc_id and text are one document and keep the
    same lines. Texts are taken whole, however long, and an empty table gives an empty table. All columns of ``docs`` are kept; ``n_lines``, ``n_deleted`` and ``runs`` replace any of these names.
    """
    found = deleted_runs(docs, least_words)
    names = [n for n in docs.columns if n not in ("n_lines", "n_deleted", "runs")]
    keyed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("long").alias("kd"), F.xxhash64(text_of()).alias("kt"))
    joined = keyed.join(found, F.col("kd").eqNullSafe(F.col("d")) & (F.col("kt") == F.col("t")), "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    runs = F.coalesce("runs", F.array().cast("array<struct<begin:int,end:int>>"))
    kept = F.filter(lines, lambda x, i: ~F.exists(runs, lambda r: (r["begin"] <= i) & (i <= r["end"])))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    deleted = F.aggregate(runs, F.lit(0), lambda acc, r: acc + r["end"] - r["begin"] + 1)
    columns = [text.alias("text") if n == "text" else F.col("row")[n].alias(n) for n in names]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"), runs.alias("runs"))
