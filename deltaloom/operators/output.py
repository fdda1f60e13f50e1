"""The nested result of an analysis, its summary and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(groups: DataFrame) -> DataFrame:
    """``groups(diff_id, name, n_files)`` -> counts and an ordered listing of each change."""
    rows = F.sort_array(F.collect_list(F.struct("name", "n_files")))
    return groups.groupBy("diff_id").agg(F.count("*").alias("total_groups"), F.sum("n_files").alias("total_files"), rows.alias("r")).select(
        "diff_id", "total_groups", "total_files",
            F.array_join(F.transform("r", lambda x: F.concat(x["name"], F.lit(":"), x["n_files"].cast("string"))), ",").alias("listing"))


def nested(ranked: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a change: its groups in review order, each with its files and edges.

    ``ranked(diff_id, group_id, name, score, review_order)``, ``files(diff_id, group_id, path,
    flow_position, role, additions, deletions)``, ``edges(diff_id, group_id, src, dst, edge_type)``.
    """
    f = files.groupBy("diff_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("flow_position", "path", "role", "additions", "deletions"))).alias("files"))
    e = edges.groupBy("diff_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "edge_type"))).alias("edges"))
    g = ranked.join(f, ["diff_id", "group_id"], "left").join(e, ["diff_id", "group_id"], "left")
    row = F.struct("review_order", "group_id", "name", "score", F.coalesce("files", F.array().cast(f.schema["files"].dataType)).alias("files"),
        F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"))
    return g.groupBy("diff_id").agg(F.sort_array(F.collect_list(row)).alias("groups"), F.count("*").alias("total_groups"))


def to_json(result: DataFrame) -> DataFrame:
    return result.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def mermaid(edges: DataFrame) -> DataFrame:
    """``(group_id, src, dst, edge_type)`` of files -> a flow chart of each group; the first label of an edge counts."""
    e = edges.where("src <> dst").groupBy("group_id", "src", "dst").agg(F.min("edge_type").alias("label"))
    line = F.format_string('  "%s" -->|%s| "%s"', "src", "label", "dst")
    return e.groupBy("group_id").agg(F.concat(F.lit("graph TD\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("chart"))
