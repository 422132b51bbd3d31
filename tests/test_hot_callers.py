"""Limits with one caller that sends most requests: as a plain loop counts them, and no window by caller alone."""

import datetime
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from dossier.operators import accounting

START = datetime.datetime(2024, 1, 1, 22, 58)


def sample():
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), START + datetime.timedelta(seconds=rng.choice([0, 1, 59, 60, 3600, rng.randrange(9000)])), rng.random() < 0.4) for i in range(900)]
    return rows + [(1000, "a", None, True), (1001, None, None, False), (1002, "once", START, False)]


def made(spark):
    return spark.createDataFrame(sample(), "id int, caller string, ts timestamp_ntz, ok boolean").repartition(5)


def in_order():
    return sorted(sample(), key=lambda r: (r[2] is not None, r[2] or START, r[0]))


def windows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"windowspecdefinition\((\w+)#\d+(?:L)?, (\w+)", plan)


def test_minutes_and_hours(spark):
    got = accounting.rate_limited(made(spark), caller="caller", ts="ts", order=["ts", "id"])
    counts, want = defaultdict(int), {}
    for i, c, t, _ in in_order():
        for kind, cut in (("m", 16), ("h", 13)):
            counts[kind, c, str(t)[:cut]] += 1
        minute, hour = counts["m", c, str(t)[:16]], counts["h", c, str(t)[:13]]
        want[i] = (minute, hour, minute <= 5 and hour <= 30)
    assert {r.id: (r.minute_count, r.hour_count, r.allowed) for r in got.collect()} == want
    assert windows(got) and ("caller", "ts") not in windows(got)


def test_lifetime_quota(spark):
    got = accounting.within_quota(made(spark), visitor="caller", order=["ts", "id"], consumes=F.col("ok"))
    used, want = defaultdict(int), {}
    for i, c, _, ok in in_order():
        want[i] = (min(used[c], 10), used[c] < 10)
        used[c] += ok
    assert {r.id: (r.used, r.reserved) for r in got.collect()} == want and got.columns == ["id", "caller", "ts", "ok", "used", "reserved"]


def test_health_over_hours(spark):
    rare = made(spark).withColumn("ok", F.col("ok") & (F.col("id") % 7 == 0))
    got = accounting.provider_health(rare, provider="caller", ts="ts", order=["ts", "id"], ok=F.col("ok"))
    streak, want = defaultdict(int), {}
    for i, c, _, ok in in_order():
        streak[c] = 0 if ok and i % 7 == 0 else streak[c] + 1
        want[i] = (streak[c], streak[c] >= 3)
    assert {r.id: (r.streak, r.degraded) for r in got.collect()} == want
    assert max(w[0] for w in want.values()) > 10 and windows(got) and ("caller", "ts") not in windows(got)
