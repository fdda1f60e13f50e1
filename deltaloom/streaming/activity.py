"""Job logs: replay and tail up to the first terminal event, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def until_terminal(log: DataFrame, job: str, seq: str, terminal: str) -> DataFrame:
    """Each job's events up to its first terminal one, that included.

    The first terminal event of a job is one small row, met by a join, so a
    long log is not gathered.
    """
    last = log.where(F.col(terminal)).groupBy(F.col(job).alias("_job")).agg(F.min(seq).alias("_last"))
    return log.join(last, F.col(job) == F.col("_job"), "left").where(F.col("_last").isNull() | (F.col(seq) <= F.col("_last"))).drop("_job", "_last")


def jobs_state(stream: DataFrame, job: str = "job_id", delay: str = "10 minutes") -> DataFrame:
    """Running state of each job from a stream ``(job_id, seq, event_name, ts)``."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), job).agg(
        F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.bool_or(F.col("event_name").isin("completed", "failed")).alias("ended"))


def normalize_lines(lines: DataFrame) -> DataFrame:
    """JSON event lines of tools -> ``(job_id, seq, event_name, message)``; other lines are messages as they are."""
    v = F.try_parse_json("line")
    get = lambda p: F.try_variant_get(v, p, "string")
    kind = F.coalesce(get("$.type"), F.lit("text"))
    message = F.coalesce(get("$.message"), get("$.text"), get("$.item.text"), get("$.item.command"), F.col("line"))
    level = F.when(kind.isin("error", "turn.failed"), "error").otherwise("info")
    return lines.select("job_id", "seq", kind.alias("event_name"), level.alias("level"), message.alias("message"))


def latest_by_seq(log: DataFrame, job: str, seq: str) -> DataFrame:
    w = Window.partitionBy(job).orderBy(F.desc(seq))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
