"""Mixed timestamps: the automaton against a regular expression, zones against folds, votes and odd rows."""

import datetime as dt
import random
import re
import zoneinfo

import numpy as np
import pyarrow as pa
import pytest

from stratalex.llm import stamps as st

DATES = r"(?:(?P<y1>20\d\d)-(?P<m1>\d\d)-(?P<d1>\d\d)|(?P<y2>20\d\d)(?P<m2>\d\d)(?P<d2>\d\d)|(?P<d3>\d\d)\.(?P<m3>\d\d)\.(?P<y3>20\d\d)|(?P<d4>\d\d) (?P<b4>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (?P<y4>20\d\d)|(?P<a>\d\d)/(?P<b>\d\d)/(?P<y5>20\d\d))"
WHOLE = re.compile(DATES + r"(?:[T ](?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d))?(?: ?(?P<half>[AP])M)?(?: ?(?:(?P<z>Z)|(?P<sign>[+-])(?P<oh>\d\d):?(?P<om>\d\d)))?)?", re.ASCII)


def instants(raw, zone):
    """Either ('epoch', us), or the day-first and month-first (us, doubtful) of a slashed stamp, or one of another; None is impossible."""
    raw = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch(r"\d{10}", raw, re.ASCII):
        return "epoch", int(raw) * 10**6
    if re.fullmatch(r"\d{13}", raw, re.ASCII):
        return "epoch", int(raw) * 1000
    m = WHOLE.fullmatch(raw)
    if not m:
        return "bad", None
    g = m.groupdict()
    h, mi, s, oh, om = (int(g[k] or 0) for k in ("h", "mi", "s", "oh", "om"))
    if g["half"]:
        if not 1 <= h <= 12:
            return "bad", None
        h = h % 12 + 12 * (g["half"] == "P")
    if oh > 14 or om > 59:
        return "bad", None

    def at(y, mo, d):
        try:
            wall = dt.datetime(int(y), int(mo), int(d), h, mi, s)
        except ValueError:
            return None
        if g["z"] or g["sign"]:
            wall -= dt.timedelta(hours=oh, minutes=om) * (-1 if g["sign"] == "-" else 1)
            return round((wall - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6, False
        try:
            own = zoneinfo.ZoneInfo(zone) if zone else None
        except Exception:
            own = None
        if own is None:
            return None
        # an offset of fold 0 is the one before a change, of fold 1 the one after
        a, b = (wall.replace(tzinfo=own, fold=f).utcoffset() for f in (0, 1))
        return round((wall - b - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6, a != b

    if g["a"]:
        return "slashed", (at(g["y5"], g["b"], g["a"]), at(g["y5"], g["a"], g["b"]))
    month = 1 + "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split().index(g["b4"]) if g["b4"] else g["m1"] or g["m2"] or g["m3"]
    found = at(g["y1"] or g["y2"] or g["y3"] or g["y4"], month, g["d1"] or g["d2"] or g["d3"] or g["d4"])
    return ("plain", found) if found else ("bad", None)


def plain(rows):
    """(utc_us, rule, ambiguous) of rows (source, zone, raw)."""
    votes, seen = {}, [(s, instants(r, z)) for s, z, r in rows]
    for s, (kind, x) in seen:
        if kind == "slashed" and (x[0] is None) != (x[1] is None):
            votes.setdefault(s, [0, 0])[x[0] is None] += 1
    out = []
    for s, (kind, x) in seen:
        if kind == "epoch":
            out.append((x, "epoch", False))
        elif kind == "plain":
            out.append((x[0], "plain", x[1]))
        elif kind == "slashed" and (x[0] or x[1]):
            if x[0] and x[1] and x[0][0] != x[1][0]:
                d, m = votes.get(s, [0, 0])
                out.append((x[1][0] if m > 10 * d else x[0][0], "votes" if m > 10 * d or d > 10 * m else "default", True))
            else:
                out.append(((x[0] or x[1])[0], "plain", (x[0] or x[1])[1]))
        else:
            out.append((None, "bad", False))
    return out


ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "Pacific/Apia", "Africa/Casablanca", "No/Where", "", None, "../x"]


def made(rng, n):
    pick = rng.choice
    two = lambda lo, hi: f"{rng.randint(lo, hi):02d}"
    out = []
    for _ in range(n):
        y = pick(["20" + two(0, 99), "2024", "1999", "2100"])
        m, d = two(0, 13), two(0, 32)
        b = pick([*st.MONTHS, "jan", "JAN", "Jam"])
        date = pick([f"{y}-{m}-{d}", f"{y}{m}{d}", f"{d}.{m}.{y}", f"{d} {b} {y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{two(1, 12)}/{two(1, 12)}/{y}"])
        time = pick(["", "", pick("T ") + two(0, 24) + ":" + two(0, 60) + pick(["", ":" + two(0, 60)]) + pick(["", " AM", "PM", " PM"]) + pick(["", "", "Z", " Z", "+05:30", " -0800", "+1500", "-14:60", "+5"])])
        text = pick(["", " ", "\t", "\x0b\r\n"]) + date + time + pick(["", " ", "\n", "x", " "] if rng.random() < 0.2 else [""])
        if rng.random() < 0.1:
            text = pick([None, "", " ", "0", "17041049231", str(rng.randint(10**9, 10**10 - 1)), str(rng.randint(10**12, 10**13 - 1)), "１２３４５６７８９０", text[:-1]])
        out.append((pick(["a", "b", "c", None]), pick(ZONES), text))
    return out


def test_the_automaton_reads_what_the_pattern_reads():
    rows = made(random.Random(5), 30_000)
    found = st.parse(pa.array([r for _, _, r in rows], pa.string()), pa.array([z for _, z, _ in rows], pa.string()))
    kinds = {0: 0, 1: 0, 2: 0, 3: 0}
    for i, (s, z, raw) in enumerate(rows):
        kind, x = instants(raw, z)
        rule = int(found["rule"][i])
        kinds[rule] += 1
        if kind == "slashed":
            a, b = x
            want = 0 if a is None and b is None else 3 if a and b and a[0] != b[0] else 2
            assert rule == want, rows[i]
            assert found["vote"][i] == (0 if (a is None) == (b is None) else 1 if a else -1)
            if want:
                assert (found["first"][i], found["doubtful"][i]) == (a or b), rows[i]
            if want == 3:
                assert found["month_first"][i] == b[0]
        else:
            assert rule == {"bad": 0, "epoch": 1, "plain": 2}[kind], rows[i]
            assert not found["vote"][i]
            if kind == "epoch":
                assert found["first"][i] == x
            if kind == "plain":
                assert (found["first"][i], found["doubtful"][i]) == x, rows[i]
    assert min(kinds.values()) > 100


@pytest.mark.parametrize("zone", [z for z in ZONES if z and "/" in z and z[0] not in ".N"])
def test_every_change_of_a_zone(zone):
    """Walls around each change, to the second."""
    own = zoneinfo.ZoneInfo(zone)
    since, until, offsets = st.changes(zone)
    walls = np.unique(np.concatenate([since - 1, since, until - 1, until, (since + until) // 2]))
    walls = walls[(walls > 946684800) & (walls < 4102444800)]
    utc, known, doubtful = st.placed(walls, pa.array([zone] * len(walls)), np.arange(len(walls)))
    assert known.all()
    for w, u, x in zip(walls.tolist(), utc.tolist(), doubtful.tolist()):
        wall = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=w)
        a, b = (round(wall.replace(tzinfo=own, fold=f).utcoffset().total_seconds()) for f in (0, 1))
        assert (u, x) == (w - b, a != b), (zone, wall)


def test_votes_and_odd_rows(spark):
    rng = random.Random(7)
    rows = made(rng, 3000)
    # ten to one is not over ten times, eleven to one is
    rows += [("ten", "UTC", "13/01/2024")] * 10 + [("ten", "UTC", "01/13/2024"), ("ten", "UTC", "01/02/2024")]
    rows += [("eleven", "UTC", "01/13/2024")] * 11 + [("eleven", "UTC", "13/01/2024"), ("eleven", "UTC", "01/02/2024"), ("eleven", "UTC", "02/02/2024")]
    rows += [("one", "UTC", "01/13/2024"), ("one", None, "01/02/2024"), ("one", None, "01/02/2024 00:00Z"), ("", "UTC", "01/13/2024"), ("", "UTC", "01/02/2024"), (None, "UTC", "01/02/2024")]
    # what is impossible has no vote
    rows += [("bad", "UTC", "01/13/2024 24:00"), ("bad", None, "01/13/2024"), ("bad", "UTC", "01/02/2024"), ("long", "UTC", " " * 100_000 + "2024-01-02" + "\n" * 100_000), ("long", "UTC", "2" * 1_000_000)]
    table = [(i if i % 50 else None, *r, "x") for i, r in enumerate(rows)]
    stamps = spark.createDataFrame(table, "stamp_id long, source string, zone string, raw string, `utc.us` string").repartition(5)
    for size in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            got = st.normalise(stamps)
            assert got.columns == ["stamp_id", "source", "zone", "raw", "utc.us", "_stamp"]
            have = sorted((tuple(r[:4]) + tuple(r[5]) for r in got.collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        want = sorted(((t[0], t[1], t[2], t[3], *p) for t, p in zip(table, plain(rows))), key=str)
        assert have == want
    assert st.normalise(stamps.limit(0)).count() == 0
    assert {r._stamp.rule for r in st.normalise(stamps.where("raw is null")).collect()} == {"bad"}
    with pytest.raises(ValueError):
        st.normalise(stamps, into="raw")
