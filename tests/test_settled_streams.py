"""Streams of requests in any order against the batch operators, and against a plain fold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dossier.operators import accounting
from dossier.streaming import accounting as stream
from dossier.streaming import settled

T0 = dt.datetime(2024, 1, 1, 10, 0)
END = ("~", -1, T0 + dt.timedelta(days=3), T0 + dt.timedelta(days=3))


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


@pytest.fixture(scope="module")
def session(spark):
    mine = spark.newSession()
    mine.conf.set("spark.sql.streaming.stateStore.providerClass", settled.STORE)
    return mine


def streamed(session, folder, batches, schema):
    """A stream that reads one batch after the other."""
    for n, rows in enumerate(batches):
        session.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{n}")
    return session.readStream.schema(session.read.parquet(f"{folder}/b0").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*/*.parquet")


def test_limits_of_shuffled_requests(session, tmp_path):
    """Batches overlap in time by up to nine minutes; every request is decided as in the batch operator."""
    made = [(f"c{k % 3 if k % 2 else 0}", k, at(0, (k * 37) % 7000), at(0, (k * 37) % 7000 + (k * 7919) % 540)) for k in range(150)]
    made.sort(key=lambda r: r[3])
    schema = "caller string, event_id long, ts timestamp_ntz, arrived timestamp_ntz"
    source = streamed(session, tmp_path / "in", [made[i : i + 50] for i in range(0, 150, 50)] + [[END]], schema)
    got = stream.run_available(settled.rate_limited(source, per_minute=1, per_hour=20), "settled")
    want = accounting.rate_limited(session.createDataFrame(made, schema), caller="caller", ts="ts", order=["ts", "event_id"], per_minute=1, per_hour=20)
    key = lambda df: sorted(map(tuple, df.select("caller", "event_id", "ts", "minute_count", "hour_count", "allowed").collect()))
    assert not got.where("is_late").count() and key(got) == key(want)


def test_late_requests_count_in_their_own_window(session, tmp_path):
    first = [("c", 1, at(0), at(0)), ("c", 2, at(0, 30), at(1)), ("c", 3, at(40), at(40))]
    late = [("c", 4, at(0, 10), at(41)), ("c", 5, at(39, 59), at(41)), ("c", None, at(1), at(41)), ("c", 6, None, at(41))]
    source = streamed(session, tmp_path / "in", [first, late, [END]], "caller string, event_id long, ts timestamp_ntz, arrived timestamp_ntz")
    got = stream.run_available(settled.rate_limited(source), "late")
    assert sorted((r.event_id, r.minute_count, r.hour_count, r.is_late) for r in got.where("caller = 'c'").collect()) == [
        (1, 1, 1, False), (2, 2, 2, False), (3, 1, 5, False), (4, 3, 3, True), (5, 1, 4, False)]


def test_refunds_after_before_and_long_after_their_request(session, tmp_path):
    row = lambda n, minute, arrived, refund=False: ("v", n, at(minute), at(arrived), refund)
    batches = [
        [row(1, 0, 0), row(2, 1, 1), row(3, 2, 3, True)],  # the refund of 3 comes before 3
        [row(3, 2, 4), row(2, 5, 5, True), row(4, 6, 6)],  # that of 2 while 2 waits
        [row(5, 30, 30), row(6, 31, 31)],
        [row(1, 60, 60, True), row(7, 61, 61)],  # that of 1 long after
        [(*END, False)],
    ]
    source = streamed(session, tmp_path / "in", batches, "visitor string, event_id long, ts timestamp_ntz, arrived timestamp_ntz, is_refund boolean")
    got = stream.run_available(settled.within_quota(source, quota=2), "refunds")
    # 1 and 4 consume; 5 and 6 are refused; 7 is settled after 1 was given back
    assert sorted((r.event_id, r.used, r.reserved) for r in got.where("visitor = 'v'").collect()) == [
        (1, 0, True), (2, 1, True), (3, 1, True), (4, 1, True), (5, 2, False), (6, 2, False), (7, 1, True)]


def test_settled_query_against_its_sql(spark, oracle, same):
    from conftest import TESTDATA

    from dossier.plans import catalogue

    got = catalogue.QUERIES["rate_limit_settled"](spark, f"{TESTDATA}/sf0.001").toPandas()
    assert len(got)
    same(got, oracle(catalogue.ORACLES["rate_limit_settled"]))
