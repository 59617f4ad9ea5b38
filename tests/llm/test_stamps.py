"""Mixed timestamps against a plain parser and the fold rule of Python's own zones."""

import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lectern.llm.stamps import MONTHS, normalise, zone_offsets

KIND = "stamp_id long, source string, zone string, raw string"
UTC = timezone.utc
ZONES = ("UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "Pacific/Apia", "Africa/Casablanca", "America/Sao_Paulo")
DATES = (r"(?P<y>20\d\d)-(?P<m>\d\d)-(?P<d>\d\d)", r"(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)", r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>20\d\d)", rf"(?P<d>\d\d) (?P<b>{'|'.join(MONTHS)}) (?P<y>20\d\d)", r"(?P<p>\d\d)/(?P<q>\d\d)/(?P<y>20\d\d)")
TIME = r"(?:[T ](?P<h>\d\d):(?P<i>\d\d)(?::(?P<s>\d\d))?(?: ?(?P<half>[AP])M)?(?: ?(?:(?P<z>Z)|(?P<sign>[+-])(?P<oh>\d\d):?(?P<oi>\d\d)))?)?"


def micros(t):
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def read(raw):
    """(epoch in microseconds) or (readings, offset or None), else None; readings are day first and month first."""
    x = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch(r"[0-9]{10}|[0-9]{13}", x):
        return int(x) * (1_000_000 if len(x) == 10 else 1000)
    for form in DATES:
        if not (m := re.fullmatch(form + TIME, x, re.A)):
            continue
        g = m.groupdict()
        h, i, s = (int(g[k] or 0) for k in "his")
        if g["half"]:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + 12 * (g["half"] == "P")
        offset = 0 if g["z"] else None
        if g["sign"]:
            if int(g["oh"]) > 14 or int(g["oi"]) > 59:
                return None
            offset = (int(g["oh"]) * 60 + int(g["oi"])) * (-1 if g["sign"] == "-" else 1)
        month = MONTHS.index(g["b"]) + 1 if g.get("b") else int(g.get("m") or 0)
        orders = [(int(g["q"]), int(g["p"])), (int(g["p"]), int(g["q"]))] if g.get("p") else [(month, int(g["d"]))]
        found = []
        for mo, d in orders:
            try:
                found.append(datetime(int(g["y"]), mo, d, h, i, s))
            except ValueError:
                found.append(None)
        return (found, offset) if any(found) else None
    return None


def expected(rows):
    seen = {}
    usable = lambda r, x: x is not None and (isinstance(x, int) or x[1] is not None or r[2] in ZONES)
    parsed = [x if usable(r, x) else None for r, x in ((r, read(r[3])) for r in rows)]
    for r, x in zip(rows, parsed, strict=True):
        if isinstance(x, tuple) and len(x[0]) == 2 and None in x[0]:
            seen.setdefault(r[1], [0, 0])[x[0][0] is None] += 1
    for r, x in zip(rows, parsed, strict=True):
        if x is None or isinstance(x, int):
            yield (x, "bad" if x is None else "epoch", False)
            continue
        found, offset = x
        rule, at = "plain", found[0] or found[-1]
        if len(found) == 2 and None not in found and found[0] != found[1]:
            day, month = seen.get(r[1], [0, 0])
            rule = "votes" if day > 10 * month or month > 10 * day else "default"
            at = found[1] if month > 10 * day else found[0]
        if offset is not None:
            yield (micros(at.replace(tzinfo=UTC)) - offset * 60_000_000, rule, rule != "plain")
            continue
        early, late = (at.replace(tzinfo=ZoneInfo(r[2]), fold=k) for k in (0, 1))
        yield (micros(late.astimezone(UTC)), rule, rule != "plain" or early.utcoffset() != late.utcoffset())


def stamps():
    rng = random.Random(13)
    near = {"Europe/Berlin": ["2024-03-31 02", "2024-10-27 02"], "America/New_York": ["2024-03-10 02", "2024-11-03 01"], "Australia/Lord_Howe": ["2024-10-06 02", "2024-04-07 01"], "Pacific/Apia": ["2011-12-30 12", "2011-12-31 00"], "Africa/Casablanca": ["2024-03-10 02", "2024-04-14 02"], "America/Sao_Paulo": ["2018-11-04 00", "2018-02-17 23"]}
    out = []
    for k in range(4000):
        zone, source = rng.choice(ZONES), rng.choice(["a", "b", "c", None, ""])
        t = datetime(2000, 1, 1) + timedelta(seconds=rng.randrange(100 * 365 * 86400 - 86400 * 30))
        date = rng.choice(["%Y-%m-%d", "%Y%m%d", "%d.%m.%Y", f"%d {MONTHS[t.month - 1]} %Y", "%d/%m/%Y" if source in ("a", None) or k % 13 == 0 else "%m/%d/%Y"])
        time = rng.choice(["", " %H:%M", "T%H:%M:%S", " %I:%M %p", "T%I:%M:%S%p"])
        raw = t.strftime(date + time) + (rng.choice(["", "", "", "Z", " Z", "+05:30", "-0800", " +1459"]) if time else "")
        if zone in near and k % 3 == 0:
            raw = f"{rng.choice(near[zone])}:{rng.randrange(60):02}" + rng.choice(["", ":59"])
        if k % 11 == 0:
            at = rng.randrange(len(raw))
            raw = raw[:at] + rng.choice(["", "9", " ", "x", "/"]) + raw[at + 1 :]
        out.append((k, source, zone, rng.choice(["", " ", "\t"]) + raw + rng.choice(["", "\n"])))
    odd = ["", None, " ", "1700000000", "1700000000123", "17000000001", "2024-02-30", "2023-02-29", "2024-01-01 24:00", "2024-01-01 23:60", "2024-01-01 23:59:60", "2024-01-01 00:30 AM", "2024-01-01 12:30 AM", "2024-01-01 12:30PM", "2024-01-01 13:00 PM", "2024-01-01 10:00+1500", "2024-01-01 10:00 +14:59", "2024-01-01 10:00+05:60", "2024-01-01T10:00:00 am", "31/12/2024", "12/31/2024", "31/31/2024", "05/05/2024", "1999-01-01", "01 jan 2024", "01 Jan 2024 05:06:07", "2024-01-01 10:00 ", "٢024-01-01", "2024-01-01,,,,", ",,,,,,,,,,,", "2024-01-01 10:00  Z", "2024-01-01T", "2024-01-01\n\n", "2024-01-01 " * 40_000]
    out += [(10_000 + i, "odd", "Europe/Berlin", x) for i, x in enumerate(odd)]
    out += [(20_000, "z", None, "2024-01-01 10:00"), (20_001, "z", "Nowhere/Else", "2024-01-01 10:00"), (20_002, "z", None, "2024-01-01 10:00Z"), (20_003, "z", "Nowhere/Else", "31/12/2024"), (20_004, "z", "UTC", "03/04/2024"), (None, "z", "UTC", "04.03.2024"), (20_004, "z", "UTC", "03/04/2024")]
    return out


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_by_brute_force(spark, session_zone):
    rows = stamps()
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame(rows, KIND).withColumns({"utc_us": F.lit("clash"), "key": F.lit(1)})
        got = [((r.stamp_id if r.stamp_id is not None else -1), r.utc_us, r.rule, r.ambiguous) for r in normalise(df).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    want = [((r[0] if r[0] is not None else -1), *x) for r, x in zip(rows, expected(rows), strict=True)]
    assert {"bad", "epoch", "plain", "votes", "default"} == {x[2] for x in want} and sum(x[3] for x in want) > 200
    assert sorted(got, key=str) == sorted(want, key=str)


def test_gaps_overlaps_and_hot_sources(spark):
    rows = [(1, "a", "Europe/Berlin", "2024-03-31 02:30"), (2, "a", "Europe/Berlin", "2024-10-27 02:30"), (3, "a", "Europe/Berlin", "2024-10-27 03:00"), (4, "a", "Pacific/Apia", "2011-12-30 10:00"), (5, "a", "Europe/Berlin", "2024-10-27 02:30Z")]
    got = {r.stamp_id: (r.wall, r.ambiguous) for r in normalise(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: ("gap", True), 2: ("overlap", True), 3: ("once", False), 4: ("gap", True), 5: (None, False)}
    # sources too many to be hot, beside one that is
    many = [(i, f"s{i}" if i > 3000 else "hot", "UTC", "03/04/2024") for i in range(5000)] + [(9000 + i, "hot", "UTC", "03/25/2024") for i in range(11)] + [(9999, "hot", "UTC", "25/03/2024")]
    got = normalise(spark.createDataFrame(many, KIND)).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in got} == {"votes": 3001, "default": 1999, "plain": 12}


def test_empty_and_offsets(spark):
    assert normalise(spark.createDataFrame([], KIND)).count() == 0
    got = {r.zone: r.offsets for r in zone_offsets(spark.createDataFrame([("Europe/Berlin",), ("Asia/Kolkata",), (None,), ("x",), ("Australia/Lord_Howe",)], "zone string")).collect()}
    assert got == {"Europe/Berlin": [3600, 7200], "Asia/Kolkata": [19800], "Australia/Lord_Howe": [37800, 39600]}
