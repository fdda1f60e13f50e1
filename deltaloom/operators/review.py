"""Requests to a reviewer, checks of its answers, and what an edit changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

CRITERIA = 5


def refinement_request(groups: DataFrame, files: DataFrame, infra: DataFrame) -> DataFrame:
    """One JSON request a change: its groups with their files, and its infrastructure."""
    f = files.groupBy("diff_id", "group_id").agg(F.sort_array(F.collect_list("path")).alias("files"))
    g = groups.join(f, ["diff_id", "group_id"],
        "left").groupBy("diff_id").agg(F.sort_array(F.collect_list(F.struct("review_order", "group_id", "name", "files"))).alias("groups"))
    i = infra.groupBy("diff_id").agg(F.sort_array(F.collect_list("path")).alias("infrastructure"))
    j = g.join(i, "diff_id", "left")
    return j.select("diff_id", F.to_json(F.struct("groups", F.coalesce("infrastructure", F.array().cast("array<string>")).alias("infrastructure"))).alias("request"))


def judge_problems(answers: DataFrame) -> DataFrame:
    """``answers(answer_id, criterion, score, overall)`` -> what is wrong with each answer.

    A score outside 1 to 5, fewer criteria than asked, or an overall value more
    than a half away from the mean.
    """
    per = answers.groupBy("answer_id").agg(
        F.count_if((F.col("score") < 1) | (F.col("score") > 5)).alias("out_of_range"), F.count_distinct("criterion").alias("criteria"),
            F.avg("score").alias("mean"), F.max("overall").alias("overall"))
    checks = F.array(
        F.when(F.col("out_of_range") > 0, "score out of range"), F.when(F.col("criteria") < CRITERIA, "criterion missing"),
            F.when(F.abs(F.col("mean") - F.col("overall")) > 0.5, "overall off the mean"))
    return per.select("answer_id", F.explode(F.array_compact(checks)).alias("problem"))


def moved_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(diff_id, path, group_id)`` twice -> the files whose group changed, came or went."""
    j = before.select("diff_id", "path", F.col("group_id").alias("from_group")).join(after.select("diff_id", "path",
        F.col("group_id").alias("to_group")), ["diff_id", "path"], "full_outer")
    return j.where(~F.col("from_group").eqNullSafe(F.col("to_group")))


def activity_summary(entries: DataFrame) -> DataFrame:
    """Counts of a job's entries by level, with its last message."""
    return entries.groupBy("job_id").agg(F.count("*").alias("entries"), F.count_if(F.col("level") == "error").alias("errors"),
        F.max_by("message", "seq").alias("last_message"))


#: the form of a reviewer's answer
REFINEMENT = (
    "splits array<struct<source_group_id:string,new_groups:array<struct<name:string,files:array<string>>>,reason:string>>, "
    "merges array<struct<group_ids:array<string>,merged_name:string,reason:string>>, re_ranks array<struct<group_id:string,new_position:bigint,reason:string>>, "
    "reclassifications array<struct<file:string,from_group_id:string,to_group_id:string,reason:string>>, reasoning string"
)


def parse_refinement(answers: DataFrame, response: str = "response") -> tuple[dict[str, DataFrame], DataFrame]:
    """``answers(diff_id, response)`` -> the operations as ``refine.apply`` takes them, and ``(diff_id, response)`` of answers without a JSON object.

    The object may stand in prose or in a code fence; what it lacks is empty.
    """
    read = answers.withColumn("r", F.from_json(text.json_in(response), REFINEMENT))
    got = read.where("r is not null").select("diff_id", "r.*")
    each = lambda c: got.select("diff_id", F.posexplode(c).alias("ord", "x"))
    parts = each("splits").select("diff_id", "ord", F.col("x.source_group_id").alias("source"), F.posexplode("x.new_groups").alias("new_pos", "g"))
    return {
        "splits": parts.select("diff_id", "ord", "source", "new_pos", F.col("g.name").alias("new_name"), F.posexplode("g.files").alias("file_pos", "path")),
        "merges": each("merges").select("diff_id", "ord", F.col("x.merged_name").alias("merged_name"),
            F.posexplode("x.group_ids").alias("pos", "group_id")).select("diff_id", "ord", "pos", "group_id", "merged_name"),
        "ranks": each("re_ranks").select("diff_id", "ord", "x.group_id", "x.new_position"),
        "moves": each("reclassifications").select("diff_id", "ord", F.col("x.file").alias("path"), F.col("x.from_group_id").alias("from_group"),
            F.col("x.to_group_id").alias("to_group")),
    }, read.where("r is null").select("diff_id", response)


def lint_expectations(wanted: DataFrame, changed: DataFrame, key: str = "target") -> DataFrame:
    """``wanted(target, kind, check_id, path)`` against the files of a target -> ``(target, path, problem)``.

    A path that did not change, one that should lie both in the infrastructure and not, and a check that names one file twice or alone.
    """
    w = wanted.select(key, "kind", "check_id", "path")
    lost = w.select(key, "path").distinct().join(changed.select(key, "path"), [key, "path"], "left_anti").withColumn("problem", F.lit("not among the changed files"))
    both = w.where(F.col("kind").endswith("infrastructure")).groupBy(key, "path").agg(F.count_distinct("kind").alias("n")).where("n > 1").select(key,
        "path", F.lit("infrastructure and not").alias("problem"))
    pairs = w.where(F.col("kind").endswith("group")).groupBy(key, "kind", "check_id").agg(F.min("path").alias("path"), F.count("*").alias("n"),
        F.count_distinct("path").alias("d"))
    return lost.unionByName(both).unionByName(pairs.where("d < n or d < 2").select(key, "path",
        F.lit("a check of fewer files than it names").alias("problem")).distinct())
