"""Scores of groupings: metrics, thresholds, golden constraints, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import clamp

THRESHOLDS = {"max_groups": 200, "max_infra_ratio": 0.35, "max_singleton_ratio": 0.50}
# fixed values: weights by (density limit given, goldens given)
WEIGHTS = {
    (False, False): {"group_count": 0.35, "infra": 0.25, "singleton": 0.20, "accounting": 0.20},
    (False, True): {"group_count": 0.20, "infra": 0.15, "singleton": 0.15, "accounting": 0.10, "golden": 0.40},
    (True, False): {"group_count": 0.20, "density": 0.20, "infra": 0.20, "singleton": 0.20, "accounting": 0.20},
    (True, True): {"group_count": 0.15, "density": 0.15, "infra": 0.10, "singleton": 0.10, "accounting": 0.10, "golden": 0.40},
}
EVAL_WEIGHTS = {"coherence": 0.25, "entrypoints": 0.20, "ordering": 0.15, "risk": 0.15, "languages": 0.15, "accounting": 0.10}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def threshold_score(actual: Column, limit: float) -> Column:
    """1 up to the limit, then down to 0 in proportion; at a limit of 1 or more at once."""
    span = max(1.0 - limit, 2.220446049250313e-16)
    return F.when(actual <= limit, 1.0).otherwise(clamp(1.0 - (actual - limit) / span))


def metrics(files: DataFrame, key: str = "target") -> DataFrame:
    """``files(target, group_id, path)``, null group: infrastructure -> sizes, ratios and accounting per target."""
    per_group = files.groupBy(key, "group_id").agg(F.count("*").alias("n"), F.count_distinct("path").alias("d"))
    paths = files.groupBy(key).agg(F.count("*").alias("entries"), F.count_distinct("path").alias("total_files"))
    grouped = F.col("group_id").isNotNull()
    out = per_group.groupBy(key).agg(
        F.count_if(grouped).alias("total_groups"), F.sum(F.when(~grouped, F.col("n")).otherwise(0)).alias("infra_files"),
        F.count_if(grouped & (F.col("n") == 1)).alias("singleton_groups"), F.coalesce(F.max(F.when(grouped, F.col("n"))), F.lit(0)).alias("max_group_size"),
        F.sum(F.when(grouped, F.col("n")).otherwise(0)).alias("grouped_files"))
    out = out.join(paths, key)
    return out.select(
        key, "total_files", "total_groups", "infra_files", "singleton_groups", "max_group_size",
            ratio(F.col("grouped_files"), F.col("total_groups")).alias("avg_group_size"),
        ratio(F.col("infra_files"), F.col("total_files")).alias("infra_ratio"), ratio(F.col("singleton_groups"), F.col("total_groups")).alias("singleton_ratio"),
        (ratio(F.col("total_groups"), F.col("total_files")) * 1000).alias("groups_per_1000_files"), (F.col("entries") == F.col("total_files")).alias("files_accounted"))


def score(measured: DataFrame, thresholds: dict | None = None, golden: str | None = None) -> DataFrame:
    """Adds the scores and ``overall``; ``golden`` names a column of golden scores if there are any."""
    t = THRESHOLDS | (thresholds or {})
    density = t.get("max_groups_per_1000_files")
    parts = {
        "group_count": F.when(F.col("total_groups") <= t["max_groups"], 1.0).otherwise(clamp(F.lit(float(t["max_groups"])) / F.col("total_groups"))),
        "infra": threshold_score(F.col("infra_ratio"), t["max_infra_ratio"]), "singleton": threshold_score(F.col("singleton_ratio"), t["max_singleton_ratio"]),
        "accounting": F.when(F.col("files_accounted"), 1.0).otherwise(0.0),
    }
    if density is not None:
        parts["density"] = threshold_score(F.col("groups_per_1000_files"), density)
    if golden:
        parts["golden"] = F.col(golden)
    weights = WEIGHTS[(density is not None, golden is not None)]
    overall = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
    return measured.withColumns({f"{k}_score": F.round(v, 6) for k, v in parts.items()} | {"overall": F.round(overall, 6)})


def golden_checks(locations: DataFrame, constraints: DataFrame) -> DataFrame:
    """``locations(path, place)``, ``constraints(check_id, kind, path)`` -> each check's verdict.

    ``same``: all members lie in one place; ``separate``: each in another. A
    member that lies nowhere fails its check.
    """
    j = constraints.join(locations, "path", "left")
    agg = j.groupBy("check_id", "kind").agg(F.count("*").alias("members"), F.count_if(F.col("place").isNull()).alias("missing"),
        F.count_distinct("place").alias("places"))
    good = (F.col("missing") == 0) & F.when(F.col("kind") == "same", F.col("places") == 1).otherwise(F.col("places") == F.col("members"))
    return agg.withColumn("satisfied", good)


def overall_eval(scores: DataFrame) -> DataFrame:
    return scores.withColumn("overall", F.round(sum((F.col(k) * w for k, w in EVAL_WEIGHTS.items()), F.lit(0.0)), 6))


def regressions(history: DataFrame, series: str, order: str, value: str, tolerance: float = 0.05) -> DataFrame:
    """Each run against the one before it in its series."""
    before = F.lag(value).over(Window.partitionBy(series).orderBy(order))
    return history.withColumn("previous", before).withColumn("regressed", F.coalesce(F.col("previous") - F.col(value) > tolerance, F.lit(False)))


def judge_scores(answers: DataFrame) -> DataFrame:
    """Scores of 1 to 5 as 0 to 1."""
    return answers.withColumn("normalized", (F.col("score") - 1) / 4.0)


def coherence(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Per target the weighted best match of expected groups.

    ``files(target, group_id, path)``, null group: infrastructure; ``expected(target,
    exp_id, needle, must)``: what a group's paths should (or should not) contain.
    """
    met = files.join(expected, "target").where(F.contains("path", F.col("needle")))
    hit = met.select("target", "exp_id", "group_id", "needle", "must").distinct()
    total = expected.groupBy("target", "exp_id").agg(F.count_if("must").alias("want"), F.count_if(~F.col("must")).alias("avoid"))
    per = hit.groupBy("target", "exp_id", "group_id").agg(F.count_if("must").alias("have"), F.count_if(~F.col("must")).alias("bad")).join(total, ["target", "exp_id"])
    one = F.greatest(F.lit(0.0), ratio(F.col("have"), F.col("want")) - 0.5 * ratio(F.col("bad"), F.col("avoid")))
    best = per.groupBy("target", "exp_id").agg(
        F.max(F.when(F.col("group_id").isNotNull(), one)).alias("best"), F.max(F.when(F.col("group_id").isNull() & (F.col("have") > 0), F.col("have"))).alias("leaked"))
    j = total.join(best, ["target", "exp_id"], "left")
    value = F.when(F.col("want") == 0, 0.0).otherwise(F.coalesce("best", F.lit(0.0)))
    capped = F.when(F.col("leaked").isNotNull(), F.least(value, 1.0 - F.col("leaked") / F.col("want"))).otherwise(value)
    weight = F.greatest(F.col("want"), F.lit(1))
    return j.groupBy("target").agg(F.round(F.sum(capped * weight) / F.sum(weight), 6).alias("coherence"))


def entrypoint_accuracy(entrypoints: DataFrame, expected: DataFrame) -> DataFrame:
    """``entrypoints(target, file, type)``, ``expected(target, exp_id, file_contains, type)`` -> matched share."""
    found = expected.join(entrypoints.select("target", "type", "file"),
        ["target", "type"]).where(F.contains("file", F.col("file_contains"))).select("target", "exp_id").distinct().withColumn("ok", F.lit(1.0))
    return expected.join(found, ["target", "exp_id"], "left").groupBy("target").agg(F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 6).alias("entrypoints"))


def review_ordering(orders: DataFrame, constraints: DataFrame) -> DataFrame:
    """``orders(target, path, review_order)``, ``constraints(target, c_id, higher, lower)`` -> satisfied share.

    A missing lower file satisfies, a missing higher one does not.
    """
    c = constraints.join(orders.select("target", F.col("path").alias("higher"), F.col("review_order").alias("h")), ["target", "higher"], "left")
    c = c.join(orders.select("target", F.col("path").alias("lower"), F.col("review_order").alias("l")), ["target", "lower"], "left")
    ok = F.when(F.col("h").isNull(), 0.0).when(F.col("l").isNull() | (F.col("h") <= F.col("l")), 1.0).otherwise(0.0)
    return c.groupBy("target").agg(F.round(F.avg(ok), 6).alias("ordering"))


def risk_reasonableness(groups: DataFrame) -> DataFrame:
    """``groups(target, group_id, risk, review_order, n_files)`` -> 1 less a quarter for each bad value and a tenth for equal orders."""
    bad = F.sum(((F.col("risk") < 0) | (F.col("risk") > 1)).cast("int") + (F.col("review_order") < 1).cast("int") + (F.col("n_files") == 0).cast("int"))
    return groups.groupBy("target").agg(F.round(F.greatest(F.lit(0.0), 1.0 - 0.25 * bad - F.when(F.count_distinct("review_order") < F.count("*"),
        0.1).otherwise(0.0)), 6).alias("risk"))


def language_recall(detected: DataFrame, expected: DataFrame) -> DataFrame:
    found = expected.join(detected.select("target", "language").distinct().withColumn("ok", F.lit(1.0)), ["target", "language"], "left")
    return found.groupBy("target").agg(F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 6).alias("languages"))


def corpus_balance(targets: DataFrame, least: int) -> DataFrame:
    """Languages with fewer targets than they need."""
    return targets.groupBy("language").agg(F.count("*").alias("n")).where(F.col("n") < least)


def file_locations(files: DataFrame, infra: DataFrame, key: str = "target") -> DataFrame:
    """``(target, path, place, is_infra)``: the group of a file, else ``infra:n:name`` of its n-th sub-group by name, else ``infra``.

    ``files(target, group_id, path)``, ``infra(target, path, sub_group)``.
    """
    order = F.dense_rank().over(Window.partitionBy(key).orderBy("sub_group")) - 1
    subs = infra.where("sub_group is not null").withColumn("place", F.concat(F.lit("infra:"), order.cast("string"), F.lit(":"), "sub_group"))
    both = subs.select(key, "path", "place").unionByName(infra.where("sub_group is null").select(key, "path", F.lit("infra").alias("place")))
    # what a sub-group names counts before the bare list
    both = both.groupBy(key, "path").agg(F.max("place").alias("place"))
    return files.select(key, "path", F.col("group_id").cast("string").alias("place"),
        F.lit(False).alias("is_infra")).unionByName(both.withColumn("is_infra", F.lit(True)))


def destinations(locations: DataFrame, key: str = "target") -> DataFrame:
    """``(target, groups, destinations)``: groups, and groups with the parts of the infrastructure."""
    return locations.groupBy(key).agg(
        F.count_distinct(F.when(~F.col("is_infra"), F.col("place"))).alias("groups"), F.count_distinct("place").alias("destinations"))


def accounting(locations: DataFrame, expected: DataFrame, key: str = "target") -> DataFrame:
    """``expected(target, total_files, expected_files, min_groups, max_groups)`` -> ``(target, accounting)``: 1, less a
    half for a wrong number of files, a half for files that lie nowhere, a quarter for a number of groups out of range."""
    n = locations.groupBy(key).agg(F.count("*").alias("held"), F.count_distinct(F.when(~F.col("is_infra"), F.col("place"))).alias("n_groups"))
    j = expected.join(n, key, "left").na.fill(0, ["held", "n_groups"])
    off = lambda c, w: F.when(c, w).otherwise(0.0)
    lost = off(F.col("total_files") != F.col("expected_files"), 0.5) + off(F.col("held") != F.col("total_files"),
        0.5) + off(~F.col("n_groups").between(F.col("min_groups"), F.col("max_groups")), 0.25)
    return j.select(key, F.greatest(F.lit(0.0), 1.0 - lost).alias("accounting"))


def expectations(locations: DataFrame, deleted: DataFrame, wanted: DataFrame, bounds: DataFrame, key: str = "target") -> DataFrame:
    """``(target, kind, check_id, satisfied)`` of each check of a target.

    ``wanted(target, kind, check_id, path)``: ``same_group``: all in one place that has a name; ``separate_group``:
    all in different places; ``infrastructure``, ``non_infrastructure``: of one path each, or it is in ``deleted(target, path)``.
    ``bounds(target, kind, value)``: ``group_count_min`` holds for all destinations, ``group_count_max`` for groups; their ``check_id`` is -1. A path that lies nowhere fails.
    """
    j = wanted.join(locations, [key, "path"], "left").join(deleted.select(key, "path").distinct().withColumn("deleted", F.lit(True)), [key, "path"], "left")
    agg = j.groupBy(key, "kind", "check_id").agg(
        F.count("*").alias("n"), F.count("place").alias("found"), F.count_distinct("place").alias("places"), F.count_if("is_infra").alias("infra"),
        F.count_if(F.col("place") == "infra").alias("bare"), F.count("deleted").alias("gone"))
    whole = F.col("found") == F.col("n")
    ok = (
        F.when(F.col("kind") == "same_group", whole & (F.col("places") == 1) & (F.col("bare") == 0)).when(F.col("kind") == "separate_group",
            whole & (F.col("places") == F.col("n")))
        .when(F.col("kind") == "infrastructure", (F.col("infra") == F.col("n")) | (F.col("gone") > 0))
        .otherwise((whole & (F.col("infra") == 0)) | ((F.col("found") == 0) & (F.col("gone") > 0)))
    )
    counted = bounds.join(destinations(locations, key), key, "left").na.fill(0, ["groups", "destinations"])
    held = F.when(F.col("kind") == "group_count_min", F.col("destinations") >= F.col("value")).otherwise(F.col("groups") <= F.col("value"))
    return agg.select(key, "kind", "check_id", ok.alias("satisfied")).unionByName(counted.select(key, "kind",
        F.lit(-1).cast(agg.schema["check_id"].dataType).alias("check_id"), held.alias("satisfied")))


def uncovered(changed: DataFrame, locations: DataFrame, deleted: DataFrame | None = None, key: str = "target") -> DataFrame:
    """Changed files that lie in no place, deleted ones aside."""
    out = changed.select(key, "path").distinct().join(locations, [key, "path"], "left_anti")
    return out if deleted is None else out.join(deleted, [key, "path"], "left_anti")


def deleted_paths(changes: DataFrame) -> DataFrame:
    """``(diff_id, path)`` of deleted files: by status, or without a new path."""
    gone = (F.col("status") == "Deleted") | F.col("new_path").isNull() if "status" in changes.columns else F.col("new_path").isNull()
    return changes.where(gone & F.col("old_path").isNotNull()).select("diff_id", F.col("old_path").alias("path")).distinct()
