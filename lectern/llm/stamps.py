"""Times written in mixed forms and zones, brought to UTC by enumerating offsets.

A wall time has no offset of its own, so each distinct offset that its zone ever has is subtracted from it and the
candidates are rendered back in the zone. One candidate that renders as the wall time is its instant. None means that the
zone's clocks skip it (a gap), two that they show it twice (an overlap); then the two offsets next to the change decide, and
the one after it is taken. In a gap these are the pair of offsets that render each other: subtracting either lands on
the other side of the change.

Dates like ``03/04/2024`` have two readings. Those that have only one vote for their order in their source; votes are added
up by source before any row meets them, and rows of hot sources meet their votes by broadcast (``join_counted``). Zones
are found by a distinct, kept if the JVM knows them (so at most as many as it has), and their offsets are
read off one instant a day over all years that a stamp may name. No row travels but those that wait for votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted

SECOND = 1_000_000
DAY = 86_400
#: Days since 1970 between which zones' offsets are looked up: all of 2000 to 2099 and two more at either end.
FIRST_DAY, LAST_DAY = 10_955, 47_483
#: How many times the other's votes an order needs more than.
TIMES = 10

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SPACE = r"[\x20\x09-\x0D]"
_Y, _N, _60 = "(20[0-9][0-9])", "([0-9][0-9])", "([0-5][0-9])"
#: Named groups of the pattern, in order.
PARTS = ("y1", "m1", "d1", "y2", "m2", "d2", "d3", "m3", "y3", "d4", "b4", "y4", "p", "q", "y5", "h", "i", "s", "half", "z", "sign", "oi")
PATTERN = (
    rf"^(?:{_Y}-{_N}-{_N}|{_Y}{_N}{_N}|{_N}[.]{_N}[.]{_Y}|{_N} ({'|'.join(MONTHS)}) {_Y}|{_N}/{_N}/{_Y})"
    rf"(?:[T\x20]{_N}:{_60}(?::{_60})?(?:\x20?([AP])M)?(?:\x20?(?:(Z)|([+-](?:0[0-9]|1[0-4])):?{_60}))?)?\z"
)
#: What a stamp is cut into: of groups that stand for one thing one has matched, so that they are put together.
FIELDS = ("y1 y2 y3 y4 y5", "m1 m2 m3 q", "d1 d2 d3 d4 p", "b4", "p", "q", "h", "i", "s", "half", "z sign", "oi")


def zone_offsets(zones: DataFrame) -> DataFrame:
    """``zones(zone)`` -> ``(zone, offsets)``: a row for each zone that the JVM knows, with its distinct offsets in seconds.

    The number of rows is bounded by the number of zones that there are. Null and unknown zones have no row.
    """
    spark = zones.sparkSession
    names = sorted(str(x) for x in spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    known = zones.select("zone").distinct().where(F.col("zone").isin(names))
    days = known.select("zone", F.explode(F.sequence(F.lit(FIRST_DAY), F.lit(LAST_DAY))).alias("day"))
    return days.groupBy("zone").agg(F.sort_array(F.collect_set(_offset(F.col("day").cast("long") * DAY * SECOND, F.col("zone")))).alias("offsets"))


def _offset(utc_us: Column, zone: Column) -> Column:
    """Seconds that the zone's clocks are ahead of UTC at an instant."""
    return ((F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone)) - utc_us) / SECOND).cast("long")


def tried_offsets(wall_us: Column, zone: Column, offsets: Column) -> Column:
    """Every offset of the zone with the one that its clocks have where it puts the wall time: structs of ``o`` and ``back``."""
    return F.transform(offsets, lambda o: F.struct(o.alias("o"), _offset(wall_us - o * SECOND, zone).alias("back")))


def deciding(tried: Column) -> tuple[Column, Column]:
    """The offset that holds, and whether the zone's clocks show the time ``once``, skip it (``gap``) or repeat it (``overlap``)."""
    fits = F.filter(tried, lambda x: x["o"] == x["back"])
    # in a gap each of the two offsets next to the change renders as the other; the later one is ahead
    across = F.filter(tried, lambda x: (x["o"] > x["back"]) & F.exists(tried, lambda y: (y["o"] == x["back"]) & (y["back"] == x["o"])))
    after = F.when(F.size(fits) > 0, F.array_min(fits)["o"]).otherwise(F.array_max(across)["o"])
    return after, F.when(F.size(fits) == 0, "gap").when(F.size(fits) == 1, "once").otherwise("overlap")


def parsed(stamps: DataFrame) -> DataFrame:
    """``stamps(stamp_id, source, zone, raw)`` -> ``(stamp_id, source, zone, epoch_us, slashed, given, time_us, other_us)``.

    ``time_us`` is the time as if at UTC, or at the stamp's own offset where it is ``given``; of a slashed date the reading with the
    day first, and ``other_us`` the one with the month first. All are null where no form fits or there is no such time.
    """
    text = F.regexp_replace(F.col("raw").cast("string"), rf"^{SPACE}+|{SPACE}+\z", "")
    rows = stamps.select(F.col("stamp_id").cast("long").alias("stamp_id"), F.col("source").cast("string").alias("source"), F.col("zone").cast("string").alias("zone"), text.alias("text"))
    text = F.col("text")
    epoch = F.when(text.rlike(r"^[0-9]{10}\z"), text.cast("long") * SECOND).when(text.rlike(r"^[0-9]{13}\z"), text.cast("long") * 1000)
    marks = F.regexp_replace(text, PATTERN, ",".join("".join(f"${PARTS.index(n) + 1}" for n in names.split()) for names in FIELDS))
    part = {names.split()[0]: F.col("parts")[i] for i, names in enumerate(FIELDS)}
    rows = rows.select("stamp_id", "source", "zone", epoch.alias("epoch_us"), F.when(text.rlike(PATTERN), F.split(marks, ",")).alias("parts"))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    month = F.when(part["b4"] == "", part["m1"]).otherwise(two((F.instr(F.lit("".join(MONTHS)), part["b4"]) + 2) / 3))
    h = part["h"].try_cast("int")
    hour = F.when(part["half"] == "", part["h"]).when(h.between(1, 12), two(h % 12 + F.when(part["half"] == "P", 12).otherwise(0)))
    offset = F.when(part["z"] == "", "Z").when(part["oi"] == "", part["z"]).otherwise(F.concat(part["z"], F.lit(":"), part["oi"]))
    clock = F.when(part["h"] == "", "00:00:00Z").otherwise(F.concat(hour, F.lit(":"), part["i"], F.lit(":"), F.when(part["s"] == "", "00").otherwise(part["s"]), offset))
    rows = rows.select("stamp_id", "source", "zone", "epoch_us", "parts", month.alias("month"), clock.alias("clock"))
    at = lambda m, d: F.unix_micros(F.concat(part["y1"], F.lit("-"), m, F.lit("-"), d, F.lit(" "), F.col("clock")).try_cast("timestamp"))
    slashed = F.coalesce(part["p"] != "", F.lit(False))
    other = F.when(part["p"] != "", at(part["p"], part["q"]))
    return rows.select("stamp_id", "source", "zone", "epoch_us", slashed.alias("slashed"), (part["z"] != "").alias("given"), at(F.col("month"), part["d1"]).alias("time_us"), other.alias("other_us"))


def normalise(stamps: DataFrame, times: int = TIMES) -> DataFrame:
    """``stamps(stamp_id, source, zone, raw, ...)`` -> ``(stamp_id, utc_us, rule, ambiguous, wall)``, a row for each input row.

    ``rule`` is ``epoch``, ``plain``, ``votes`` or ``default`` (day first) for slashed dates of two readings, and ``bad``: null,
    empty and impossible stamps, other forms, and times without an offset whose zone is null or unknown. Bad stamps never vote
    and have a null ``utc_us``. A null source is a source of its own; even votes mean day first. ``wall`` says whether the zone's
    clocks show the time ``once``, skip it (``gap``) or repeat it (``overlap``), null where an offset or epoch is given. Repeated rows
    vote each and come out each; ids may be null. Extra columns are not read; an empty table gives an empty table.
    """
    rows = parsed(stamps)
    offsets = cut(zone_offsets(stamps.select(F.col("zone").cast("string").alias("zone"))))
    placed = rows.join(F.broadcast(offsets), "zone", "left")  # at most one row for each zone that there is
    no_time = F.col("time_us").isNull() & F.col("other_us").isNull()
    bad = F.col("epoch_us").isNull() & (no_time | (~F.col("given") & F.col("offsets").isNull()))
    two = ~bad & F.coalesce(F.col("time_us") != F.col("other_us"), F.lit(False))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    own = ("stamp_id", "zone", "offsets", "given", "epoch_us", "bad")
    seen = cut(placed.withColumns({"bad": F.coalesce(bad, F.lit(True)), "two": F.coalesce(two, F.lit(False)), "key": key}).select(*own, "time_us", "other_us", "slashed", "two", "key"))
    voter = F.col("slashed") & ~F.col("bad")
    by_day, by_month = voter & F.col("other_us").isNull(), voter & F.col("time_us").isNull()
    sums = [F.sum(c.cast("long")).alias(n) for c, n in ((F.col("two"), "n"), (by_day, "day_votes"), (by_month, "month_votes"))]
    votes = cut(seen.groupBy("key").agg(*sums).where("n > 0"))
    month_wins = F.col("month_votes") > times * F.col("day_votes")
    won = month_wins | (F.col("day_votes") > times * F.col("month_votes"))
    asked = join_counted(seen.where("two"), votes, ["key"]).select(*own, F.when(month_wins, F.col("other_us")).otherwise(F.col("time_us")).alias("wall_us"), F.when(won, "votes").otherwise("default").alias("rule"))
    plain = F.when(F.col("bad"), "bad").when(F.col("epoch_us").isNotNull(), "epoch").otherwise("plain")
    others = seen.where("not two").select(*own, F.coalesce("time_us", "other_us").alias("wall_us"), plain.alias("rule"))
    return _instants(asked.unionByName(others))


def _instants(rows: DataFrame) -> DataFrame:
    free = ~F.col("bad") & F.col("epoch_us").isNull() & ~F.col("given")
    tried = rows.select("*", F.when(free, tried_offsets(F.col("wall_us"), F.col("zone"), F.col("offsets"))).alias("tried"))
    after, shown = deciding(F.col("tried"))
    out = tried.select("*", F.when(F.col("tried").isNotNull(), after).alias("after"), F.when(F.col("tried").isNotNull(), shown).alias("wall"))
    utc = F.coalesce("epoch_us", F.col("wall_us") - F.coalesce("after", F.lit(0)) * SECOND)
    ambiguous = F.col("rule").isin("votes", "default") | F.coalesce(F.col("wall") != "once", F.lit(False))
    return out.select("stamp_id", F.when(~F.col("bad"), utc).alias("utc_us"), "rule", ambiguous.alias("ambiguous"), "wall")
