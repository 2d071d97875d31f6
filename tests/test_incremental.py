import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from manualmill.operators.incremental import ChangeFeed, IncrementalJob, changed_slugs, clean_etag, instant

LOG = "rec_id bigint, slug string, etag string, last_modified string, sha256 string, ingested_at string, arrived_at timestamp"
RUNS = "run_id int, started_at timestamp, status string"
T0 = datetime(2025, 1, 1)


def brute(log, runs):
    norm = lambda s: (s or "").strip().lower() or None
    tag = lambda s: (s or "").strip().removeprefix("W/").strip('"') or None

    def when(s):
        for f in ("%a, %d %b %Y %H:%M:%S GMT", "%A, %d-%b-%y %H:%M:%S GMT", "%Y-%m-%dT%H:%M:%SZ"):
            try:
                return datetime.strptime(s or "", f)
            except ValueError:
                pass

    def differ(a, b):
        for k, f in ((4, norm), (2, tag), (3, when)):
            x, y = f(a[k]), f(b[k])
            if x is not None and y is not None:
                return x != y
        return True

    ok = sorted([r for r in runs if r[2] == "ok" and r[1]], key=lambda r: (r[1], r[0]))
    out = set()
    for k, (run, at, _) in enumerate(ok):
        for slug in {r[1] for r in log if r[1]}:
            seen = lambda t: max((r for r in log if r[1] == slug and r[6] <= t), key=lambda r: (r[5] or "", r[0]), default=None)
            now, before = seen(at), seen(ok[k - 1][1]) if k else None
            if now and (before is None or (now[0] != before[0] and differ(now, before))):
                out.add((run, slug))
    return out


def data(seed):
    rng = random.Random(seed)
    log, runs = [], []
    for k in range(250):
        at = T0 + timedelta(hours=rng.randrange(1000))
        made = at - timedelta(hours=rng.randrange(200))
        tags = [None, "", '"a"', 'W/"a"', "a", '"b"']
        dates = [None, "", "Mon, 06 Jan 2025 10:00:00 GMT", "Monday, 06-Jan-25 10:00:00 GMT", "2025-01-06T10:00:00Z", "2025-01-07T10:00:00Z"]
        log.append((k, f"s{rng.randrange(8)}" if rng.random() > 0.3 else "hot", rng.choice(tags), rng.choice(dates), rng.choice([None, None, "AB", "ab", "cd"]), made.strftime("%Y-%m-%dT%H:%M:%SZ"), at))
    log += log[:20]
    for k in range(12):
        runs.append((k, T0 + timedelta(hours=rng.randrange(1100)), rng.choice(["ok", "ok", "failed", "aborted"])))
    return log, runs


@pytest.mark.parametrize("seed", range(4))
def test_changed_slugs_are_those_of_brute_force(spark, seed):
    log, runs = data(seed)
    rows = changed_slugs(spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS)).select("run_id", "slug").collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == brute(log, runs)


def test_nulls_ties_and_empty_tables(spark):
    log = [(1, None, None, None, None, "x", T0), (None, "s", None, None, None, "x", T0), (2, "s", None, None, None, None, None), (3, "t", None, None, None, None, T0)]
    runs = [(2, T0, "ok"), (1, T0, "ok"), (3, None, "ok"), (4, T0, None)]
    frame, when = spark.createDataFrame(log, LOG + ""), spark.createDataFrame(runs, RUNS)
    assert [tuple(r) for r in changed_slugs(frame, when).collect()] == [(1, "t", 3)]
    assert changed_slugs(frame.limit(0), when).count() == 0 and changed_slugs(frame, when.limit(0)).count() == 0
    clash = frame.withColumns({"n": F.lit(1), "r": F.lit(2), "now": F.lit(3), "prev": F.lit(4), "run_id": F.lit(5)})
    assert changed_slugs(clash, when).count() == 1
    many = spark.createDataFrame([(k, T0 + timedelta(minutes=k), "ok") for k in range(30_000)], RUNS)
    assert [tuple(r) for r in changed_slugs(frame, many).collect()] == [(0, "t", 3)]


@pytest.mark.parametrize("seed", range(2))
def test_feed_run_by_run_and_all_at_once(spark, tmp_path, seed):
    log, runs = data(seed)
    frame = spark.createDataFrame(log, LOG)
    at_once = ChangeFeed(spark, str(tmp_path / "once"))
    assert at_once.catch_up(frame, spark.createDataFrame(runs, RUNS)) is not None
    assert at_once.catch_up(frame, spark.createDataFrame(runs, RUNS)) is None
    step = ChangeFeed(spark, str(tmp_path / "steps"))
    for k in range(3, len(runs) + 3, 3):
        known = sorted(runs, key=lambda r: r[1])[:k]
        seen = max(r[1] for r in known)
        # What arrives after the last known run is not in the log yet.
        step.catch_up(spark.createDataFrame([r for r in log if r[6] <= seen], LOG), spark.createDataFrame(known, RUNS))
    want = brute(log, runs)
    for feed in (at_once, step):
        got = [(r.run_id, r.slug) for r in feed.changes().collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_feed_survives_a_lost_run(spark, tmp_path, monkeypatch):
    log, runs = data(7)
    frame, all_runs = spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS)
    feed = ChangeFeed(spark, str(tmp_path / "feed"))
    assert feed.changes().count() == 0
    half = sorted(runs, key=lambda r: r[1])[:6]
    feed.catch_up(frame, spark.createDataFrame(half, RUNS))
    before = feed.changes().count()

    def lost(self, commit):
        raise RuntimeError("driver lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(IncrementalJob, "_publish", lost)
        with pytest.raises(RuntimeError):
            feed.catch_up(frame, all_runs)
    assert feed.changes().count() == before  # the output without a commit is never read
    ChangeFeed(spark, str(tmp_path / "feed")).catch_up(frame, all_runs)
    assert {(r.run_id, r.slug) for r in feed.changes().collect()} == brute(log, runs)


def test_watermark_in_any_time_zone(spark, tmp_path):
    """Neither another session time zone nor the repeated hour of autumn skips or repeats a row."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    log = spark.range(240).select("id", F.timestamp_micros(F.lit(1_762_056_000_000_000) + F.col("id") * 60_000_000).alias("seq"))  # across 2025-11-02 06:00 UTC
    try:
        for kind in ("timestamp", "timestamp_ntz"):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            rows = log.withColumn("seq", F.col("seq").cast(kind))
            rows.write.parquet(str(tmp_path / kind))
            job, done = IncrementalJob(spark, str(tmp_path / f"job-{kind}"), "seq"), 0
            for k, tz in enumerate(("UTC", "America/New_York", "Asia/Tokyo", "America/New_York", "UTC")):
                spark.conf.set("spark.sql.session.timeZone", tz)
                job.run(spark.read.parquet(str(tmp_path / kind)).where(F.col("id") < 48 * (k + 1)), lambda d: d)
                got = sorted(r.id for r in job.output().select("id").collect())
                assert got == list(range(48 * (k + 1))), (kind, tz)
            with pytest.raises(ValueError):
                job.run(spark.range(1).withColumnRenamed("id", "seq"), lambda d: d)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_notations(spark):
    rows = [("Mon, 16 Dec 2024 22:38:41 GMT",), ("Monday, 16-Dec-24 22:38:41 GMT",), ("2024-12-16T22:38:41Z",), ("Mon Dec 16 22:38:41 2024",), ("soon",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(instant(F.col("s"))).collect()]
    assert got[:4] == [datetime(2024, 12, 16, 22, 38, 41)] * 4 and got[4:] == [None] * 3
    tags = [('W/"a"',), ('"a"',), ("a",), ('""',), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(tags, "s string").select(clean_etag(F.col("s"))).collect()] == ["a"] * 3 + [None] * 3


def test_job_neither_skips_nor_repeats(spark, tmp_path):
    log = spark.range(100).withColumnRenamed("id", "seq")
    job = IncrementalJob(spark, str(tmp_path / "job"), "seq")
    assert job.output() is None
    first = job.run(log.where("seq < 40"), lambda d: d)
    assert (first.number, first.low, first.high) == (1, None, "39")
    assert job.run(log.where("seq < 40"), lambda d: d) is None

    def dies(d):
        d.write.parquet(str(tmp_path / "half"))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        job.run(log, dies)
    again = IncrementalJob(spark, str(tmp_path / "job"), "seq")
    assert again.run(log, lambda d: d).low == "39"
    assert sorted(r[0] for r in again.output().collect()) == list(range(100))
    assert IncrementalJob(spark, str(tmp_path / "job2"), "seq").run(log.limit(0), lambda d: d) is None


def test_a_second_run_at_the_same_time_can_not_commit(spark, tmp_path):
    log = spark.range(10).withColumnRenamed("id", "seq")
    a, b = (IncrementalJob(spark, str(tmp_path / "job"), "seq") for _ in range(2))

    def late(d):
        b.run(log, lambda x: x)
        return d

    with pytest.raises(Exception, match="exists"):
        a.run(log, late)
    assert len(a.commits()) == 1 and a.output().count() == 10
