"""Problem 2: processing only new or changed records.

IncrementalJob is a run over what was added since the last committed one: a high
watermark on the log's commit sequence, an upper limit fixed at the start, and an
output that becomes visible in one step with the new watermark, so that a run that
dies has done nothing and the next one repeats nothing.  ChangeFeed is the job
for the log of manifest records: it commits what each successful run had to process together
with the records that are current then, from which the next commit goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

from ..session import checkpointed
from .ordering import numbered

#: Stretches of runs up to this number are broadcast (some 60 bytes each), more are joined by shuffle.
BROADCAST_STRETCHES = 200_000


def clean_sha(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.lower(F.trim(c)))


def clean_etag(c: Column) -> Column:
    """Without a leading W/ and the quotes; NULL if nothing is left."""
    e = F.regexp_replace(F.trim(c), r'^W/|^w/', "")
    e = F.regexp_replace(e, r'^"|"$', "")
    return F.when(e != "", e)


# The notations of HTTP dates, and ISO 8601.
_DATE_FORMATS = {
    r"^\w{3}, \d{1,2} \w{3} \d{4} ": (r"^\w{3}, ", "d MMM yyyy HH:mm:ss"),
    r"^\w{6,9}, \d{1,2}-\w{3}-\d{2} ": (r"^\w+, ", "d-MMM-yy HH:mm:ss"),
    r"^\w{3} \w{3} +\d{1,2} [\d:]+ \d{4}$": (r"^\w{3} ", "MMM d HH:mm:ss yyyy"),
}


def instant(c: Column) -> Column:
    """The instant that a Last-Modified value names in any of its notations, as timestamp; NULL for none or an unknown one."""
    text = F.regexp_replace(F.trim(c), r"\s+", " ")
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(text))
    out = iso
    for form, (lead, pattern) in _DATE_FORMATS.items():
        body = F.regexp_replace(F.regexp_replace(text, lead, ""), r" (GMT|UTC|Z|\+0000)$", "")
        out = F.coalesce(out, F.when(text.rlike(form), F.try_to_timestamp(body, F.lit(pattern))))
    return out


def differ(a: Column, b: Column) -> Column:
    """Do two records, structs with sha, etag and modified, hold different contents?  Lacking values pass the question on."""
    both = lambda f: a[f].isNotNull() & b[f].isNotNull()
    return (
        F.when(both("sha"), a["sha"] != b["sha"])
        .when(both("etag"), a["etag"] != b["etag"])
        .when(both("modified"), a["modified"] != b["modified"])
        .otherwise(F.lit(True))
    )


def _day(c: Column, kind: DataType) -> Column:
    """Number of the day of a point in time; never falls as time goes on, whatever the session's time zone."""
    return F.unix_date(c.cast("date")) if isinstance(kind, TimestampNTZType) else F.floor(F.unix_micros(c) / 86_400_000_000).cast("int")


def _aligned(log: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataType]:
    """Both tables with their times in one type: their own if it is the same, else timestamps."""
    a, b = log.schema["arrived_at"].dataType, runs.schema["started_at"].dataType
    if isinstance(a, TimestampNTZType) and isinstance(b, TimestampNTZType):
        return log, runs, a
    to = F.col("arrived_at").cast("timestamp"), F.col("started_at").cast("timestamp")
    return log.withColumn("arrived_at", to[0]), runs.withColumn("started_at", to[1]), TimestampType()


def intervals(runs: DataFrame) -> DataFrame:
    """(n, run_id, low, high): the interval of each successful run, from the start of the one before (NULL: none) to its own.

    Runs without run_id or started_at are ignored; of runs that started at one instant the smallest run_id has the work.
    """
    done = runs.where("status = 'ok' AND started_at IS NOT NULL AND run_id IS NOT NULL")
    done = done.groupBy(F.col("started_at").alias("high")).agg(F.min("run_id").alias("run_id"))
    done = numbered(done, [], ["high"], "n")
    before = done.select((F.col("n") + 1).alias("n"), F.col("high").alias("low"))
    return done.join(before, "n", "left").select("n", "run_id", "low", "high")


def placed(log: DataFrame, spans: DataFrame, kind: DataType) -> DataFrame:
    """The rows of log that arrived in one of the intervals, with its n and run_id: an as-of join.

    Intervals are cut at days, so that it is an equi-join on the day with a range check, however many runs there are.
    """
    first = log.agg(F.min(_day(F.col("arrived_at"), kind))).first()[0]
    low, high = F.coalesce(_day(F.col("low"), kind), F.lit(first)), _day(F.col("high"), kind)
    cut = spans.where(low <= high).select("n", "run_id", "low", "high", F.explode(F.sequence(low, high)).alias("_day"))
    if cut.limit(BROADCAST_STRETCHES + 1).count() <= BROADCAST_STRETCHES:
        cut = F.broadcast(cut)
    rows = log.withColumn("_day", _day(F.col("arrived_at"), kind)).join(cut, "_day")
    return rows.where((F.col("low").isNull() | (F.col("arrived_at") > F.col("low"))) & (F.col("arrived_at") <= F.col("high")))


def states(log: DataFrame, runs: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(run_id, slug, rec_id, changed, last, now): for each successful run the slugs of which a record arrived in its
    interval, their current record (now), whether it is new or differs in content from that of the run before, and
    whether no later run of the table has one.

    prior is (slug, now): the current records at the run before the first of runs.  Records are reduced to the
    greatest (ingested_at, rec_id) of each slug and run with map-side combine, so a hot slug leaves at most one row for
    each run; a running maximum over the runs of a slug then gives its current record.

    Records without slug, rec_id or arrived_at are ignored; a NULL ingested_at is older than any other; rows that are
    given twice count once.  Lacking and empty values are the same.
    """
    record = F.struct(
        F.coalesce("ingested_at", F.lit("")).alias("at"), F.col("rec_id"), clean_sha(F.col("sha256")).alias("sha"),
        clean_etag(F.col("etag")).alias("etag"), F.col("last_modified"),
    )
    seen = log.where("slug IS NOT NULL AND rec_id IS NOT NULL AND arrived_at IS NOT NULL").select("slug", "arrived_at", record.alias("r"))
    seen, spans, kind = _aligned(seen, runs)
    first = placed(seen, intervals(spans), kind).groupBy("slug", "n", "run_id").agg(F.max("r").alias("r"))
    if prior is not None:
        first = checkpointed(first)
        known = prior.join(first.select("slug").distinct(), "slug", "left_semi")
        first = first.unionByName(known.select("slug", F.lit(-1).cast("bigint").alias("n"), F.lit(None).cast("int").alias("run_id"), F.col("now").alias("r")))
    w = Window.partitionBy("slug").orderBy("n")
    rows = first.withColumn("now", F.max("r").over(w)).withColumn("prev", F.lag("now").over(w)).withColumn("last", F.lead("n").over(w).isNull())
    a, b = (F.struct(F.col(f"{x}.sha"), F.col(f"{x}.etag"), instant(F.col(f"{x}.last_modified")).alias("modified")) for x in ("now", "prev"))
    changed = F.col("prev").isNull() | ((F.col("prev.rec_id") != F.col("now.rec_id")) & differ(a, b))
    return rows.where("n >= 0").select("run_id", "slug", F.col("now.rec_id").alias("rec_id"), changed.alias("changed"), "last", "now")


def changed_slugs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, slug, rec_id): states() that changed, for a whole log at once and without a commit."""
    return states(log, runs).where("changed").select("run_id", "slug", "rec_id")


@dataclass(frozen=True)
class Commit:
    """One finished run: it covers sequence values above low (NULL: from the start) up to high, texts of type kind."""

    number: int
    low: str | None
    high: str
    path: str
    at: str
    kind: str = ""


class IncrementalJob:
    """Runs of a transformation over what was added since the last committed run.

    The sequence column must be monotonic in the order of commits: once a value is visible, no row with a smaller or equal
    value is added later (an offset, a version or a commit timestamp).  A run reads the greatest value once, at its
    start; rows that come in meanwhile belong to the next run.  Its output goes to a folder of its own, which nobody
    reads until the file with the new watermark and the folder's name appears by one atomic rename that fails
    if another run was quicker.  A run that dies before that leaves only a folder that is never read.
    """

    def __init__(self, spark: SparkSession, folder: str, sequence: str) -> None:
        self.spark, self.folder, self.sequence = spark, folder.rstrip("/"), sequence
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def commits(self) -> list[Commit]:
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return []
        names = sorted(str(f.getPath().getName()) for f in self._fs.listStatus(at))
        done = [n for n in names if n.endswith(".json")]
        if not done:
            return []
        rows = self.spark.read.text([f"{self.folder}/commits/{n}" for n in done], wholetext=True).collect()
        return sorted((Commit(**json.loads(r[0])) for r in rows), key=lambda c: c.number)

    def _publish(self, commit: Commit) -> None:
        jvm = self.spark.sparkContext._jvm
        name = f"{commit.number:010d}.json"
        temp = self._path(f"{self.folder}/commits/_{name}.{datetime.now(timezone.utc).timestamp()}")
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(commit.__dict__).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self._conf)
        final = self._path(f"{self.folder}/commits/{name}")
        context.rename(context.makeQualified(temp), context.makeQualified(final), options)

    def _mark(self, kind: DataType) -> tuple[Callable[[Column], Column], Callable[[str], Column]]:
        """How a value of the sequence is written as text and read again, without loss and in any session time zone."""
        if isinstance(kind, TimestampType):
            return lambda c: F.unix_micros(c).cast("string"), lambda text: F.timestamp_micros(F.lit(int(text)))
        return lambda c: c.cast("string"), lambda text: F.lit(text).cast(kind)

    def watermark(self, kind: DataType) -> str | None:
        """The text of the last committed limit; an error if it was written for another type of sequence."""
        earlier = self.commits()
        if earlier and earlier[-1].kind != kind.simpleString():
            raise ValueError(f"the watermark is of type {earlier[-1].kind or 'unknown'}, the sequence of type {kind.simpleString()}")
        return earlier[-1].high if earlier else None

    def run(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame], limit: DataFrame | None = None) -> Commit | None:
        """Process what is new and commit it; None if nothing is.

        The upper limit is the greatest value of the sequence, or that of limit (one row, one column, of the same
        type): then the run covers everything up to it and commits even if no record is there.  It is read once, here.
        """
        column = F.col(self.sequence)
        kind = source.schema[self.sequence].dataType
        write, read = self._mark(kind)
        earlier = self.commits()
        low = self.watermark(kind)
        new = source if low is None else source.where(column > read(low))
        top = new.agg(F.max(column).alias("m")) if limit is None else limit.toDF("m")
        top = top.where("m IS NOT NULL") if low is None else top.where(F.col("m") > read(low))
        found = top.select(write(F.col("m"))).first()
        if found is None:
            return None
        high = found[0]
        number = earlier[-1].number + 1 if earlier else 1
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
        path = f"{self.folder}/data/{number:010d}-{stamp}"
        transform(new.where(column <= read(high))).write.parquet(path)
        commit = Commit(number, low, high, path, stamp, kind.simpleString())
        self._publish(commit)
        return commit

    def output(self) -> DataFrame | None:
        """Everything committed so far; None before the first commit."""
        done = self.commits()
        return self.spark.read.parquet(*[c.path for c in done]) if done else None


class ChangeFeed:
    """The slugs that each successful run must process, committed run by run or many runs at a time.

    A commit covers the log above the watermark up to the start of the last successful run that is known when it
    begins.  Runs that failed or were aborted commit nothing, so what they saw falls to the next successful one.
    A commit holds, besides the changes, the records that are current at its upper limit, so no later one reads the
    log below its watermark again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.job = IncrementalJob(spark, folder, "arrived_at")

    def catch_up(self, log: DataFrame, runs: DataFrame) -> Commit | None:
        """Process the successful runs that are not committed yet; None if there is none."""
        log, runs, kind = _aligned(log, runs)
        low = self.job.watermark(kind)
        _, read = self.job._mark(kind)
        due = runs.where("status = 'ok' AND started_at IS NOT NULL AND run_id IS NOT NULL")
        due = due if low is None else due.where(F.col("started_at") > read(low))
        earlier = self.job.output()
        prior = None
        if earlier is not None:
            prior = earlier.where("last").groupBy("slug").agg(F.max("now").alias("now"))
        return self.job.run(log, lambda new: states(new, due, prior), due.agg(F.max("started_at")))

    def changes(self) -> DataFrame:
        """(run_id, slug, rec_id) of everything committed; none before the first commit."""
        out = self.job.output()
        if out is None:
            return self.job.spark.createDataFrame([], "run_id int, slug string, rec_id bigint")
        return out.where("changed").select("run_id", "slug", "rec_id")
