"""Job bookkeeping over an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["pending", "running"]
RECENT = 10
SAFE = r"^[A-Za-z0-9][A-Za-z0-9_-]*$"


def clamp(progress: Column) -> Column:
    return F.greatest(F.lit(0.0e0), F.least(F.lit(1.0e0), progress))


def latest(events: DataFrame) -> DataFrame:
    """The last state of each job from ``job_id, event_id, at, status, progress``, and when it began; deleted jobs are gone."""
    last = F.max_by(F.struct("status", "progress"), F.struct("at", "event_id"))
    rows = events.groupBy("job_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), last.alias("s"))
    return rows.select("job_id", "created_at", "updated_at", F.col("s.status").alias("status"), clamp(F.col("s.progress")).alias("progress")).where("status <> 'deleted'")


def changes(events: DataFrame, columns: list[str]) -> DataFrame:
    """The state of each job from events whose null columns leave what was: for each column the last that isn't null."""
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "event_id"))) for c in columns}
    return events.groupBy("job_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), *(v.alias(c) for c, v in last.items()))


def admitted(requests: DataFrame, jobs: DataFrame, most: int) -> DataFrame:
    """Add ``admitted`` to ``request_id``: the first requests, in order, while fewer than ``most`` jobs run or wait."""
    busy = jobs.agg(F.count_if(F.col("status").isin(ACTIVE)).alias("busy"))
    first = requests.orderBy("request_id").limit(most).select("request_id").withColumn("n", F.row_number().over(Window.orderBy("request_id")))  # at most as many as there is room
    taken = first.join(F.broadcast(busy), F.col("n") + F.col("busy") <= most).select("request_id", F.lit(True).alias("admitted"))
    return requests.join(F.broadcast(taken), "request_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def artefacts(jobs: DataFrame, uploads: str, outputs: str) -> DataFrame:
    """``job_id, folder``: what is deleted with a job; ids that aren't safe names have none."""
    safe = jobs.where(F.col("job_id").rlike(SAFE))
    return safe.select("job_id", F.explode(F.array(*(F.concat(F.lit(r.rstrip("/") + "/"), F.col("job_id")) for r in (uploads, outputs)))).alias("folder"))


def recent(jobs: DataFrame, n: int = RECENT) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(n)


def active(jobs: DataFrame, most: int) -> DataFrame:
    """How many jobs run or wait, and whether another may come."""
    return jobs.agg(F.count_if(F.col("status").isin(ACTIVE)).alias("active")).withColumn("may_start", F.col("active") < most)


def expired(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Jobs begun before the cutoff; none if retention is off."""
    return jobs.where(F.lit(hours > 0) & (F.col("created_at") < now - F.expr(f"interval {hours} hours")))


def orphans(folders: DataFrame, jobs: DataFrame, now: Column, hours: int, grace_minutes: int = 10) -> DataFrame:
    """Folders ``name, changed_at`` of no job that are older than the cutoff and the grace before it."""
    old = folders.where(F.lit(hours > 0) & (F.col("changed_at") < now - F.expr(f"interval {hours * 60 + grace_minutes} minutes")))
    return old.join(jobs.select(F.col("job_id").alias("name")), "name", "left_anti")


def public(jobs: DataFrame) -> DataFrame:
    """What clients see: paths become flags."""
    flags = {f"has_{k}": F.col(f"{k}_path").isNotNull() for k in ("text", "audio", "pdf")}
    return jobs.withColumns(flags).drop("text_path", "audio_path", "pdf_path")


def restore_if_absent(known: DataFrame, found: DataFrame) -> DataFrame:
    return known.unionByName(found.join(known.select("job_id"), "job_id", "left_anti").select(known.columns))


def first_of_each(found: DataFrame) -> DataFrame:
    """One row a job id, that of the least path; ids that aren't safe names are left out."""
    one = Window.partitionBy("job_id").orderBy("path")
    safe = found.where(F.col("job_id").rlike(SAFE))
    return safe.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
