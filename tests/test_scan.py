"""Scans in ranges against the same done row by row, with keys that lie in many ranges."""

import datetime
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import evaluate as E
from fieldtrust.operators import extract as X
from fieldtrust.operators import ops as O
from fieldtrust.operators import scan

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture(params=[1, 3, 11])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_sums_and_previous(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", i, rng.choice([None, 1, 5]), str(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, n long, v string").repartition(4)
    got = {r.id: (r.total, r.rank) for r in scan.running_sums(df, [F.desc("id")], {"total": "n", "rank": None}).collect()}
    total = 0
    for rank, (_, i, n, _) in enumerate(reversed(rows), 1):
        total += n or 0
        assert got[i] == (total, rank)
    previous, want = {}, {}
    for k, i, _, v in rows:
        want[i] = previous.get(k)
        previous[k] = v
    assert {r.id: r.before for r in scan.with_previous(df, ["k"], ["id"], {"before": "v"}).collect()} == want
    assert scan.running_sums(df.where("false"), ["id"], {"n2": "n"}).count() == 0 == scan.with_previous(df.where("false"), ["k"], ["id"], {"before": "v"}).count()


def events(rng, keys, n, gap):
    """Three quarters of the rows are of one key."""
    now = dict.fromkeys(keys, 0.0)
    for i in range(n):
        k = keys[0] if i % 4 else rng.choice(keys)
        now[k] += rng.choice([0, rng.expovariate(1 / gap), gap])
        yield k, i, at(round(now[k], 3))


@pytest.mark.parametrize("gap", [2, 15, 40])
def test_buckets_of_a_hot_key(spark, ranges, gap):
    rows = list(events(random.Random(gap), ["hot", "b", "c", None], 600, gap)) + [("hot", 1000, None), ("hot", 1001, None)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp").repartition(5)
    want, state = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[2] or at(10**9), r[1])):
        tokens, seen = state.get(k, (Fraction(5), None))
        if t is not None and seen is not None:
            tokens = min(Fraction(5), tokens + Fraction(int((t - seen) / datetime.timedelta(microseconds=1)), 60_000_000) * 5)
        ok = tokens >= 1
        want[i] = (ok, 0.0 if ok else float((1 - tokens) * 12))
        state[k] = (tokens - ok, t or seen)
    got = O.rate_limit(df, 5)
    assert {r.event_id: (r.allowed, pytest.approx(r.wait_seconds, abs=1e-9)) for r in got.collect()} == want
    assert all(r.allowed and r.wait_seconds == 0 for r in O.rate_limit(df, 0).collect())


def test_a_stretch_is_summed_up_for_every_level():
    rng = random.Random(9)
    for _ in range(60):
        rate, token = rng.choice([1, 3, 7]), 60
        cap = rng.randint(1, 6) * token
        stretch, times = O.BucketStretch(rate, cap, token), [0]
        for _ in range(rng.randint(1, 40)):
            times.append(times[-1] + rng.choice([0, 1, 5, 30, 200]))
        for t in times:
            stretch.add({"micros": t})
        for level in range(cap + 1):
            have, seen = level, -4
            for t in times:
                have = min(cap, have + (t - seen) * rate)
                have, seen = have - token * (have >= token), t
            assert stretch.through((level, -4)) == (have, times[-1])
        assert len(stretch.pieces) < 40


@pytest.mark.parametrize("gap", [600, 7000, 50_000])
def test_windows_of_a_hot_key(spark, ranges, gap):
    rng = random.Random(gap)
    rows = [("t", k, t, i, rng.choice("xy"), rng.choice([None, t + datetime.timedelta(seconds=rng.choice([0, 5, gap * 3]))]), rng.choice([None, True, True, False])) for k, i, t in events(rng, [1, 2, 3], 500, gap)]
    df = spark.createDataFrame(rows, "tenant_id string, key long, ts timestamp, request_id long, hash string, done_at timestamp, ok boolean").repartition(4)
    day = datetime.timedelta(hours=24)
    want, plain, state, simple = {}, {}, {}, {}
    for _, k, t, i, h, done, ok in sorted(rows, key=lambda r: (r[2], r[3])):
        until, first, answered = state.get(k, (None, None, None))
        if until is None or t >= until:
            state[k] = (min(t + day, done) if ok is False and done else t + day, h, done)
            want[i] = "run"
        else:
            want[i] = "conflict" if h != first else "replay" if answered and answered <= t else "in_progress"
        since, first = simple.get(k, (None, None))
        if since is None or t >= since + day:
            simple[k], plain[i] = (t, h), "run"
        else:
            plain[i] = "replay" if h == first else "conflict"
    assert {r.request_id: r.verdict for r in O.idempotent(df).collect()} == want
    assert {r.request_id: r.verdict for r in O.idempotent(df.drop("done_at", "ok")).collect()} == plain


def test_a_hot_key_lies_in_many_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        hot = spark.range(8000).selectExpr("'k' AS key", "id AS event_id", "timestamp_seconds(id * 10) AS ts")
        placed = scan.in_ranges(hot, ["key", "ts", "event_id"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(placed) == 8 and max(r["count"] for r in placed) < 2500
        got = O.rate_limit(hot, 3)
        assert got.where("allowed").count() == 4002 and got.count() == 8000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_audit_chains_over_ranges(spark, ranges):
    log = O.append_audit(spark.range(300).selectExpr("CASE WHEN id % 5 = 0 THEN 'b' ELSE 'a' END AS tenant_id", "id", "'body ' || id AS body")).repartition(3)
    assert {(r.tenant_id, r.intact, r.first_bad) for r in O.verify_audit(log).collect()} == {("a", True, None), ("b", True, None)}
    bad = {
        "body": (log.withColumn("body", F.when(F.col("id") == 151, "x").otherwise(F.col("body"))), 151),
        "gone": (log.where("id <> 151"), 152),
        "null": (log.withColumn("hash", F.when(F.col("id") == 151, None).otherwise(F.col("hash"))), 151),
    }
    for table, first in bad.values():
        assert {(r.tenant_id, r.first_bad) for r in O.verify_audit(table).collect()} == {("a", first), ("b", None)}


def test_thresholds_by_group(spark, ranges):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.random(), 1) for _ in range(300)]
    rows = [(g, p, int(rng.random() < p)) for g, p, _ in rows] + [("never", 0.9, 0), ("nulls", None, 1)]
    got = {r.grp: (r.tau, r.coverage) for r in E.choose_thresholds(spark.createDataFrame(rows, "grp string, p double, y int"), 0.8).collect()}
    for g in ("a", "b", None, "never", "nulls"):
        own = [(p, y) for k, p, y in rows if k == g]
        found = (1.01, 0.0)
        for tau in sorted({round(p, 4) for p, _ in own if p is not None}):
            taken = [y for p, y in own if p is not None and p >= tau]
            if taken and sum(taken) / len(taken) >= 0.8:
                found = (tau, len(taken) / len(own))
                break
        assert got[g] == pytest.approx(found)


def test_occluded_fields(spark):
    fields = [("c", "plain", 0.1, 0.1, 0.3, 0.2), ("c", "two", 0.5, 0.5, 0.7, 0.6), ("c", "out", 0.95, 0.1, 1.05, 0.2), ("c", "null", None, 0.1, 0.2, 0.2), ("c", "line", 0.1, 0.1, 0.1, 0.2), ("d", "alone", 0.5, 0.5, 0.7, 0.6), ("e", "edge", 0.0, 0.0, 0.4, 0.4)]
    # two obstacles that cover the same fifth, and a third beside them; half of them out of the picture; exactly a quarter
    obstacles = [("c", 0.5, 0.4, 0.54, 0.9), ("c", 0.5, 0.45, 0.54, 0.8), ("c", 0.5, 0.45, 0.54, 0.8), ("c", 0.1, 0.1, 0.14, 0.15), ("c", None, 0.0, 1.0, 1.0), ("e", 0.2, 0.2, 0.9, 0.9)]
    got = {r.field: (round(r.visible, 6), round(r.covered, 6), r.unreadable) for r in X.occluded_fields(spark.createDataFrame(fields, "capture string, field string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(obstacles, "capture string, ox0 double, oy0 double, ox1 double, oy1 double"), ["capture"]).collect()}
    assert got == {"plain": (1, 0.1, False), "two": (1, 0.2, False), "out": (0.5, 0, True), "null": (0, 0, True), "line": (0, 0, True), "alone": (1, 0, False), "edge": (1, 0.25, True)}
