"""File trees, workspace packages, stored graphs and target lists."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.graph import known_edges


def source_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, source)`` of the text files below ``root``; a zero byte or invalid UTF-8 makes a file binary."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    text = F.col("content").cast("string")
    clean = raw.where(F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0")))
    lead = F.concat(F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/"), F.lit("/"))
    return clean.select(F.replace(F.regexp_replace("path", "^file:/*", "/"), lead, F.lit("")).alias("path"), text.alias("source"))


def workspace_packages(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """``files(path, source)`` -> ``(package, entry)`` of package manifests: ``main``, else src/index.ts, else index.ts."""
    from .config import glob_regex

    m = files.where(paths.file_name("path") == "package.json").select(paths.directory("path").alias("dir"), F.from_json("source", "name string, main string").alias("j"))
    if globs:
        keep = F.lit(False)
        for g in globs:
            if (r := glob_regex(g)) is not None:
                keep = keep | F.col("dir").rlike(r)
        m = m.where(keep)
    m = m.where("j.name is not null").select("dir", F.col("j.name").alias("package"), F.regexp_replace("j.main", r"^\./", "").alias("main"))
    under = lambda x: F.when(F.col("dir") == "", x).otherwise(F.concat(F.col("dir"), F.lit("/"), x))
    tries = F.array(*[F.struct(F.lit(i).alias("pos"), under(x).alias("try")) for i, x in enumerate((F.col("main"), F.lit("src/index.ts"), F.lit("index.ts")))])
    known = files.select(F.col("path").alias("known")).distinct()
    hit = m.select("package", F.inline(tries)).join(known, F.col("try") == F.col("known"))
    return hit.groupBy("package").agg(F.min_by("try", "pos").alias("entry"))


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored graph; edges that lead nowhere are left out."""
    v = spark.read.parquet(f"{path}/vertices")
    return v, known_edges(spark.read.parquet(f"{path}/edges"), v)


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation targets of a TOML list; the files of its ``include_dir`` follow in the order of their names."""
    base = Path(path)
    first = tomllib.loads(base.read_text())
    rows = list(first.get("repos", []))
    if "include_dir" in first:
        for p in sorted((base.parent / first["include_dir"]).glob("*.toml")):
            rows += tomllib.loads(p.read_text()).get("repos", [])
    if any(not r.get("name") for r in rows) or len({r["name"] for r in rows}) < len(rows):
        raise ValueError("every target needs a name of its own")
    return spark.createDataFrame([(r["name"], r.get("language"), r.get("range"), list(r.get("languages", []))) for r in rows],
        "name string, language string, range string, languages array<string>")
