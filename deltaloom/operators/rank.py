"""Risk, surface, composite score and review order of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"risk": 0.35, "centrality": 0.25, "surface_area": 0.20, "uncertainty": 0.20}
RISK = {"has_schema": 0.3, "has_api": 0.25, "has_auth": 0.35, "has_migration": 0.3}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def risk_score(flags: dict[str, Column]) -> Column:
    """Sum of the weights of the flags that hold, at most one; null flags don't hold."""
    return clamp(sum((F.when(F.coalesce(flags[k], F.lit(False)), w).otherwise(0.0) for k, w in RISK.items() if k in flags), F.lit(0.0)))


def surface_area(additions: Column, deletions: Column, max_lines: int = 1000) -> Column:
    top = F.lit(float(1 + max(max_lines, 1)))
    return clamp(F.log(1.0 + additions + deletions) / F.log(top))


def composite(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the clamped features; 0 if the weights sum to zero. NaN counts as zero."""
    weights = weights or WEIGHTS
    total = sum(weights.values())
    if total == 0:
        return F.lit(0.0)
    return clamp(sum((clamp(F.nanvl(F.coalesce(features[k].cast("double"), F.lit(0.0)), F.lit(0.0))) * w for k, w in weights.items()), F.lit(0.0)) / total)


def group_features(files: DataFrame, keys: list[str]) -> DataFrame:
    """Ranking inputs of each group: ``files`` has the keys, additions, deletions and the flags.

    Schema, API and auth hold if any file has them; test only if all have.
    """
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return files.groupBy(*keys).agg(
        any_of("is_schema").alias("has_schema"), any_of("is_api").alias("has_api"), any_of("is_auth").alias("has_auth"),
        F.coalesce(F.every("is_test"), F.lit(False)).alias("test_only"),
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("n_files"),
    )


def rank_groups(groups: DataFrame, diff: str, group: str, weights: dict[str, float] | None = None, max_lines: int = 1000) -> DataFrame:
    """Adds the features, ``score`` and ``review_order`` (1.. within each diff, score descending, then id)."""
    risk = risk_score({"has_schema": F.col("has_schema"), "has_api": F.col("has_api"), "has_auth": F.col("has_auth")})
    out = groups.withColumns({
        "risk": risk, "centrality": F.lit(0.5), "surface_area": surface_area(F.col("additions"), F.col("deletions"), max_lines),
        "uncertainty": F.when(F.col("test_only"), 0.1).otherwise(0.5),
    })
    out = out.withColumn("score", F.round(composite({k: F.col(k) for k in WEIGHTS}, weights), 6))
    return out.withColumn("review_order", F.row_number().over(Window.partitionBy(diff).orderBy(F.desc("score"), F.col(group).cast("string"))).cast("long"))
