import datetime as dt
import random

from pyspark.sql import functions as F

from runweave.operators import concurrency, intervals

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "machine string, a timestamp_ntz, b timestamp_ntz, s long, e long, slice long, island long"


def rows_of(rnd, n, hot=0.5):
    out = []
    for _ in range(n):
        m = "hot" if rnd.random() < hot else rnd.choice(["x", "y", None])
        a = T0 + dt.timedelta(minutes=rnd.randrange(6000))
        b = a + dt.timedelta(minutes=rnd.choice([-5, 0, 1, 5, 30, 300]))
        out.append((m, rnd.choice([a, a, a, None]), rnd.choice([b, b, b, None]), 1, 2, 3, 4))
    return out + out[: n // 4]


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def merged(rows):
    by = {}
    for m, a, b, *_ in rows:
        if m is not None and a is not None and b is not None and b > a:
            by.setdefault(m, []).append((us(a), us(b)))
    out = {}
    for m, spans in by.items():
        have = []
        for a, b in sorted(spans):
            if have and a <= have[-1][1]:
                have[-1][1] = max(have[-1][1], b)
            else:
                have.append([a, b])
        out[m] = have
    return out


def test_gaps_and_periods_equal_a_plain_merge(spark):
    rows = rows_of(random.Random(5), 600)
    df = spark.createDataFrame(rows, SCHEMA)
    exp = merged(rows)
    args = (df, F.col("machine"), F.col("a"), F.col("b"))
    got = {tuple(r) for r in intervals.periods(*args).collect()}
    assert got == {(m, a, b) for m, ps in exp.items() for a, b in ps}
    gaps = {tuple(r) for r in intervals.gaps(*args, slice_us=7 * 60_000_000).collect()}
    assert gaps == {(m, p[1], q[0]) for m, ps in exp.items() for p, q in zip(ps, ps[1:])}


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    args = (df, F.col("machine"), F.col("a"), F.col("b"))
    assert intervals.gaps(*args).count() == intervals.periods(*args).count() == concurrency.peak(df, F.col("a"), F.col("b")).count() == 0


def test_peak_of_the_known_case(spark):
    at = lambda h, m: T0 + dt.timedelta(hours=h, minutes=m)
    rows = [("m", at(2, 0), at(3, 0)), ("m", at(2, 10), at(2, 40)), ("m", at(2, 20), at(2, 25)), ("m", at(3, 0), at(3, 10)), ("m", at(2, 15), None)]
    df = spark.createDataFrame(rows, "machine string, a timestamp_ntz, b timestamp_ntz")
    assert concurrency.peak(df, F.col("a"), F.col("b")).collect()[0].asDict() == {"in_flight": 3, "at_us": us(at(2, 20))}


def test_as_of_and_covering_equal_brute_force(spark):
    rnd = random.Random(9)
    keys = ["hot"] * 5 + ["k1", "k2", None]
    left = [(i, rnd.choice(keys), rnd.randrange(10**12)) for i in range(300)]
    right = [(rnd.choice(keys), rnd.randrange(10**12)) for _ in range(300)]
    right += right[:40]
    l, r = spark.createDataFrame(left, "id long, key string, at long"), spark.createDataFrame(right, "key string, at long")
    got = {x["id"]: x["previous"] for x in concurrency.as_of(l, r).collect()}
    for i, k, t in left:
        if k is not None:
            assert got[i] == max((a for kk, a in right if kk == k and a <= t), default=None)
    spans = [(rnd.choice(keys[:-1]), a, a + rnd.randrange(10**11)) for a in (rnd.randrange(10**12) for _ in range(200))]
    c = concurrency.count_covering(l.where("key is not null"), spark.createDataFrame(spans, "key string, a long, b long"))
    n = {x["id"]: x["n"] for x in c.collect()}
    for i, k, t in left:
        if k is not None:
            assert n[i] == sum(kk == k and a <= t <= b for kk, a, b in spans)
