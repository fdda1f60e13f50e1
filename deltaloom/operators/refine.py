"""Edits of a grouping as tables: reclassify, split, merge, re-rank; repair and checks; manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def normalize_name(c):
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def repair_ids(ops: DataFrame, groups: DataFrame, column: str = "group_id") -> DataFrame:
    """A group's name where its id should stand is replaced by the id; ``repaired`` says so."""
    named = groups.groupBy(normalize_name(F.col("name")).alias("r_name")).agg(F.min("group_id").alias("r_id"))
    ids = groups.select(F.col("group_id").alias("r_known")).distinct()
    j = ops.join(ids, F.col(column) == F.col("r_known"), "left").join(named, normalize_name(F.col(column)) == F.col("r_name"), "left")
    fixed = F.when(F.col("r_known").isNull() & F.col("r_id").isNotNull(), F.col("r_id")).otherwise(F.col(column))
    return j.select(*[F.col(c) for c in ops.columns if c != column], fixed.alias(column), (F.col("r_known").isNull() & F.col("r_id").isNotNull()).alias("repaired"))


def unknown_groups(ops: DataFrame, groups: DataFrame, column: str = "group_id") -> DataFrame:
    """Warnings: the operations whose group does not exist."""
    return ops.join(groups.select(F.col("group_id").alias(column)), column, "left_anti").withColumn("reason", F.lit("unknown group"))


def reclassify(files: DataFrame, moves: DataFrame) -> DataFrame:
    """``files(group_id, path)``, ``moves(ord, path, from_group, to_group)``: the last valid move of a file counts."""
    valid = moves.join(files.select(F.col("group_id").alias("from_group"), "path"), ["from_group", "path"], "left_semi")
    last = valid.groupBy("path", F.col("from_group").alias("group_id")).agg(F.max_by("to_group", "ord").alias("to_group"))
    return files.join(last, ["path", "group_id"], "left").select(F.coalesce("to_group", "group_id").alias("group_id"), "path")


def split(files: DataFrame, splits: DataFrame) -> DataFrame:
    """``splits(source, new_ord, path)`` -> the files of split groups under ``group_refined_{n}``, the others as they are.

    A split whose new groups leave out a file of the source is not applied.
    """
    listed = splits.select(F.col("source").alias("group_id"), "path").distinct()
    left_out = files.join(splits.select(F.col("source").alias("group_id")).distinct(), "group_id", "left_semi").join(listed, ["group_id", "path"],
        "left_anti").select("group_id").distinct()
    good = splits.withColumnRenamed("source", "group_id").join(left_out, "group_id", "left_anti")
    return files.join(good, ["group_id", "path"], "left").select(F.coalesce(F.concat(F.lit("group_refined_"), F.col("new_ord").cast("string")),
        "group_id").alias("group_id"), "path")


def merge(files: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges(merge_ord, pos, group_id)``: members go to the first listed group."""
    first = merges.groupBy("merge_ord").agg(F.min_by("group_id", "pos").alias("into"))
    to = merges.join(first, "merge_ord").groupBy("group_id").agg(F.min_by("into", "merge_ord").alias("into"))
    return files.join(to, "group_id", "left").select(F.coalesce("into", "group_id").alias("group_id"), "path")


def rerank(groups: DataFrame, ranks: DataFrame) -> DataFrame:
    """``groups(diff_id, group_id, review_order)``, ``ranks(group_id, new_position)`` -> order 1.. by (position, id)."""
    j = groups.join(ranks, "group_id", "left").withColumn("key", F.coalesce("new_position", "review_order"))
    return j.select("diff_id", "group_id", F.row_number().over(Window.partitionBy("diff_id").orderBy("key", "group_id")).cast("long").alias("review_order"))


#: what operations call the infrastructure files
INFRASTRUCTURE = "infrastructure"


def problems(groups: DataFrame, files: DataFrame, ops: dict[str, DataFrame]) -> DataFrame:
    """``(diff_id, op, ord, reason)``: the first reason for which each operation can't be applied.

    ``groups(diff_id, group_id, ..)``, ``files(diff_id, group_id, path, ..)``, infrastructure files under
    ``INFRASTRUCTURE``. ``ops``: ``splits(diff_id, ord, source, new_pos, new_name, file_pos, path)``,
    ``merges(diff_id, ord, pos, group_id, merged_name)``, ``ranks(diff_id, ord, group_id, new_position)``,
    ``moves(diff_id, ord, path, from_group, to_group)``; ``ord`` numbers the operations of a kind.
    """
    ids = groups.select("diff_id", F.col("group_id").alias("k")).distinct()
    held = files.select("diff_id", F.col("group_id").alias("h_group"), F.col("path").alias("h_path")).distinct()

    def knows(df, column, name):
        known = ids.select(F.col("diff_id").alias("k_diff"), F.col("k").alias(name))
        return df.join(known, (F.col("diff_id") == F.col("k_diff")) & (F.col(column) == F.col(name)), "left").drop("k_diff")

    def holds(df, group, path):
        return df.join(held.withColumnRenamed("diff_id", "h_diff"),
            (F.col("diff_id") == F.col("h_diff")) & (F.col(group) == F.col("h_group")) & (F.col(path) == F.col("h_path")), "left").drop("h_diff")

    text = lambda *x: F.concat(*[F.lit(v[1:]) if v[:1] == "'" else F.col(v) for v in x])
    first = lambda df, op, order: df.where("reason is not null").groupBy("diff_id", "ord").agg(F.min_by("reason", order).alias("reason")).select(
        "diff_id", F.lit(op).alias("op"), "ord", "reason")
    splits = holds(knows(ops["splits"], "source", "known"), "source", "path")
    listed = splits.withColumn("reason", F.when(F.col("known").isNull(), text("'unknown source_group_id ", "source")).when(
        F.col("h_path").isNull(), text("'split of ", "source", "' names a file it lacks: ", "path")))
    bad = first(listed, "Split", F.struct("new_pos", "file_pos"))
    asked = ops["splits"].select("diff_id", "ord", "source").distinct()
    named = ops["splits"].select("diff_id", "ord", F.col("path").alias("h_path")).distinct()
    lost = asked.join(held.withColumnRenamed("h_group", "source"), ["diff_id", "source"]).join(named, ["diff_id", "ord", "h_path"], "left_anti")
    lost = lost.groupBy("diff_id", "ord", "source").agg(F.array_join(F.array_sort(F.collect_list("h_path")), ", ").alias("missing"))
    lost = lost.join(bad.select("diff_id", "ord"), ["diff_id", "ord"], "left_anti").select("diff_id", F.lit("Split").alias("op"), "ord",
        text("'split of ", "source", "' leaves out: ", "missing").alias("reason"))
    merges = knows(ops["merges"], "group_id", "known").withColumn("reason", F.when(F.col("known").isNull(), text("'merge names an unknown group: ", "group_id")))
    ranks = knows(ops["ranks"], "group_id", "known").withColumn("reason", F.when(F.col("known").isNull(), text("'re-rank names an unknown group: ", "group_id")))
    moves = holds(knows(knows(ops["moves"], "from_group", "from_known"), "to_group", "to_known"), "from_group", "path")
    unknown = lambda c, k: F.col(k).isNull() & (F.col(c) != INFRASTRUCTURE)
    moves = moves.withColumn("reason", F.when(unknown("from_group", "from_known"), text("'reclassify from an unknown group: ", "from_group")).when(
        unknown("to_group", "to_known"), text("'reclassify to an unknown group: ", "to_group")).when(F.col("h_path").isNull(),
            text("'reclassify: ", "path", "' is not in ", "from_group")))
    return bad.unionByName(lost).unionByName(first(merges, "Merge", F.col("pos"))).unionByName(first(ranks, "ReRank",
        F.lit(0))).unionByName(first(moves, "Reclassify", F.lit(0)))


_KINDS = {"splits": "Split", "merges": "Merge", "ranks": "ReRank", "moves": "Reclassify"}
_NAMES = {"splits": ("source",), "merges": ("group_id",), "ranks": ("group_id",), "moves": ("from_group", "to_group")}


def validate(groups: DataFrame, files: DataFrame, ops: dict[str, DataFrame]) -> DataFrame:
    """``(diff_id, op, ord, reason)``: of each change the first problem, splits before merges, re-ranks and moves."""
    order = F.struct(F.array_position(F.array(*[F.lit(k) for k in _KINDS.values()]), F.col("op")).alias("kind"), "ord")
    return problems(groups, files, ops).groupBy("diff_id").agg(F.min_by(F.struct("op", "ord", "reason"), order).alias("p")).select("diff_id", "p.*")


def repair(groups: DataFrame, ops: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Operations with groups' names replaced by their ids, and a warning for each replacement."""
    named = groups.groupBy("diff_id", normalize_name(F.col("name")).alias("r_name")).agg(F.max_by("group_id", F.struct(F.length("group_id"), "group_id")).alias("r_id"))
    known = groups.select(F.col("diff_id").alias("r_diff"), F.col("group_id").alias("r_known")).distinct()
    out, warnings = {}, None
    for kind, df in ops.items():
        for column in _NAMES[kind]:
            j = df.join(known, (F.col("diff_id") == F.col("r_diff")) & (F.col(column) == F.col("r_known")), "left")
            j = j.join(named.withColumnRenamed("diff_id", "n_diff"), (F.col("diff_id") == F.col("n_diff")) & (normalize_name(F.col(column)) == F.col("r_name")), "left")
            wrong = F.col("r_known").isNull() & (F.col(column) != INFRASTRUCTURE) & F.col("r_id").isNotNull()
            said = j.where(wrong).select("diff_id", F.lit(_KINDS[kind]).alias("op"), "ord",
                F.concat(F.lit(f"{column} "), F.col(column), F.lit(" -> "), "r_id").alias("reason")).distinct()
            warnings = said if warnings is None else warnings.unionByName(said)
            df = j.withColumn(column, F.when(wrong, F.col("r_id")).otherwise(F.col(column))).select(*ops[kind].columns)
        out[kind] = df
    return out, warnings


def sanitize(groups: DataFrame, files: DataFrame, ops: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Operations without those that can't be applied, and a warning for each that went."""
    bad = materialize(problems(groups, files, ops))
    return {k: df.join(bad.where(F.col("op") == _KINDS[k]).select("diff_id", "ord"), ["diff_id", "ord"], "left_anti") for k, df in ops.items()}, bad


def apply(groups: DataFrame, files: DataFrame, edges: DataFrame, ops: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``groups, files, edges`` after valid operations: moves, splits, merges, re-ranks, in this order.

    ``groups(diff_id, group_id, name, entry_file, risk, review_order)``, ``files(diff_id, group_id,
    path, flow_position, role, additions, deletions)``, ``edges(diff_id, group_id, src, dst, edge_type)``. A file's
    first move out of a group counts, as it is gone then; what comes from or
    goes to the infrastructure has its role and no counts. Groups left empty
    go. A split's groups list their files, hold no edges, and the one with the
    entry point's file has the entry point. A merged group has the id of the
    first one listed, the first entry point, all files and edges in the order of the groups, no risk.
    The order is dense, by the place asked for, then by id; new groups come first.
    """
    infra = F.col("group_id") == INFRASTRUCTURE
    # moves
    ranked = ops["moves"].withColumn("nth", F.row_number().over(Window.partitionBy("diff_id", "path", "from_group").orderBy("ord")))
    moves = ranked.where((F.col("nth") == 1) | (F.col("from_group") == INFRASTRUCTURE)).select("diff_id", "path",
        F.col("from_group").alias("group_id"), "to_group", "ord")
    gone = moves.select("diff_id", "path", "group_id").distinct()
    stay = files.join(gone, ["diff_id", "path", "group_id"], "left_anti").withColumn("after", F.lit(-1).cast("long"))
    moved = files.join(moves, ["diff_id", "path", "group_id"])
    plain = (F.col("group_id") == INFRASTRUCTURE) | (F.col("to_group") == INFRASTRUCTURE)
    moved = moved.select(
        "diff_id", F.col("to_group").alias("group_id"), "path", "flow_position", F.when(plain, "Infrastructure").otherwise(F.col("role")).alias("role"),
        F.when(plain, 0).otherwise(F.col("additions")).cast("long").alias("additions"),
            F.when(plain, 0).otherwise(F.col("deletions")).cast("long").alias("deletions"), F.col("ord").cast("long").alias("after"))
    now = stay.select(*moved.columns).unionByName(moved)
    place = F.row_number().over(Window.partitionBy("diff_id", "group_id").orderBy("after", "flow_position", "path"))
    now = now.withColumn("at", place.cast("long")).drop("after", "flow_position")
    alive = groups.join(now.select("diff_id", "group_id").distinct(), ["diff_id", "group_id"], "left_semi")
    alive = alive.withColumn("pos", F.row_number().over(Window.partitionBy("diff_id").orderBy(F.length("group_id"), "group_id")).cast("long"))
    # splits
    applied = ops["splits"].join(alive.select("diff_id", F.col("group_id").alias("source"), "entry_file", "risk"), ["diff_id", "source"])
    heads = applied.select("diff_id", "ord", "source", "new_pos", "new_name", "risk").distinct()
    heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("diff_id").orderBy("ord", "new_pos")).cast("long")).withColumn("new_id",
        F.concat(F.lit("group_refined_"), F.col("nth").cast("string")))
    parts = applied.join(heads.select("diff_id", "ord", "new_pos", "new_id", "nth"), ["diff_id", "ord", "new_pos"])
    entry = parts.groupBy("diff_id", "new_id").agg(F.max(F.when(F.col("path") == F.col("entry_file"), F.col("entry_file"))).alias("entry_file"))
    own = now.select("diff_id", F.col("group_id").alias("source"), "path", "role", "additions", "deletions")
    split_files = parts.select("diff_id", "source", "new_id", "path", "file_pos").join(own, ["diff_id", "source", "path"], "left").select(
        "diff_id", F.col("new_id").alias("group_id"), "path", F.coalesce("role", F.lit("Infrastructure")).alias("role"),
            F.coalesce("additions", F.lit(0).cast("long")).alias("additions"),
        F.coalesce("deletions", F.lit(0).cast("long")).alias("deletions"), F.col("file_pos").cast("long").alias("at"))
    now, alive, applied, split_files = (materialize(x) for x in (now, alive, applied, split_files))
    sources = applied.select("diff_id", F.col("source").alias("group_id")).distinct()
    zero = F.lit(0).cast("long").alias("review_order")
    made = heads.join(entry, ["diff_id", "new_id"]).select(
        "diff_id", F.col("new_id").alias("group_id"), F.col("new_name").alias("name"), "entry_file", "risk", zero, (F.lit(1 << 32) + F.col("nth")).alias("pos"))
    alive = alive.join(sources, ["diff_id", "group_id"], "left_anti").select(*made.columns).unionByName(made)
    now = now.join(sources, ["diff_id", "group_id"], "left_anti").unionByName(split_files)
    edges = edges.join(sources, ["diff_id", "group_id"], "left_anti")
    # merges, folded over each group in their order: its id, its place among the groups, and the places it had before
    listed = ops["merges"].groupBy("diff_id", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "group_id"))).alias("m"),
        F.first("merged_name").alias("merged_name"))
    listed = listed.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("m.group_id").alias("ids"), "merged_name"))).alias("merges"))
    state = F.struct(F.col("group_id").alias("id"), F.lit(None).cast("string").alias("name"), F.array("pos").alias("key"))
    folded = F.aggregate(
        F.coalesce("merges", F.array().cast(listed.schema["merges"].dataType)), state,
        lambda s, m: F.when(F.array_contains(m["ids"], s["id"]), F.struct(
            m["ids"][0].alias("id"), m["merged_name"].alias("name"), F.concat(F.array((F.lit(1 << 40) + m["ord"]).cast("long")), s["key"]).alias("key"))).otherwise(s))
    to = alive.join(listed, "diff_id", "left").withColumn("s", folded).select(*alive.columns, F.col("s.id").alias("to_id"),
        F.col("s.name").alias("to_name"), F.col("s.key").alias("key"))
    merged = to.groupBy("diff_id", "to_id").agg(
        F.min_by(F.struct("name", "entry_file", "risk", "review_order"), "key").alias("g"), F.max("to_name").alias("to_name"),
        F.min_by("entry_file", F.when(F.col("entry_file").isNotNull(), F.col("key"))).alias("entry_file"))
    is_new = F.col("to_name").isNotNull()
    out = merged.select(
        "diff_id", F.col("to_id").alias("group_id"), F.coalesce("to_name", "g.name").alias("name"), "entry_file",
            F.when(is_new, F.lit(0.0)).otherwise(F.col("g.risk")).alias("risk"),
        F.when(is_new, F.lit(0)).otherwise(F.col("g.review_order")).cast("long").alias("review_order"))
    route = materialize(to.select("diff_id", "group_id", "to_id", "key"))
    grouped = now.where(~infra).join(route, ["diff_id", "group_id"]).select("diff_id", F.col("to_id").alias("group_id"), "path", "role", "additions",
        "deletions", "key", "at")
    left = now.where(infra).select("diff_id", "group_id", "path", "role", "additions", "deletions", F.array().cast("array<bigint>").alias("key"),
        F.lit(0).cast("long").alias("at")).distinct()
    grouped = grouped.unionByName(left)
    # the places before a merge count from the last one on
    order = Window.partitionBy("diff_id", "group_id").orderBy(F.slice("key", 2, 1000), "at", "path")
    new_files = grouped.withColumn("flow_position", (F.row_number().over(order) - 1).cast("long")).drop("key", "at")
    new_edges = edges.join(route.drop("key"), ["diff_id", "group_id"]).select("diff_id", F.col("to_id").alias("group_id"), "src", "dst", "edge_type")
    # re-ranks
    asked = ops["ranks"].groupBy("diff_id", "group_id").agg(F.max_by("new_position", "ord").alias("new_position"))
    out = out.join(asked, ["diff_id", "group_id"], "left").withColumn("wanted", F.coalesce("new_position", "review_order"))
    dense = F.row_number().over(Window.partitionBy("diff_id").orderBy("wanted", "group_id")).cast("long")
    return {"groups": out.withColumn("review_order", dense).drop("wanted", "new_position"), "files": new_files, "edges": new_edges}


def apply_lenient(groups: DataFrame, files: DataFrame, edges: DataFrame, ops: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Repaired and without what can't be applied, then ``apply``; with the warnings ``(diff_id, op, ord, reason)`` of both."""
    ops, repaired = repair(groups, ops)
    # each step reads the operations several times over
    ops, repaired = {k: materialize(df) for k, df in ops.items()}, materialize(repaired)
    ops, dropped = sanitize(groups, files, ops)
    ops, dropped = {k: materialize(df) for k, df in ops.items()}, materialize(dropped)
    return apply(groups, files, edges, ops), repaired.unionByName(dropped)


def import_manifest(manifest: DataFrame, known: DataFrame) -> DataFrame:
    """``manifest(group, path)``, ``known(path, role, risk)`` -> each group's files, known files and risk.

    Files that are not known have the role Utility; the risk is the sum of the known risks over all files.
    """
    j = manifest.join(known, "path", "left")
    return j.groupBy("group").agg(
        F.count("*").alias("n_files"), F.count("role").alias("n_known"), F.count_if(F.coalesce("role", F.lit("Utility")) == "Utility").alias("n_utility"),
        F.round(F.sum(F.coalesce("risk", F.lit(0.0))) / F.count("*"), 6).alias("risk"))


def export_manifest(files: DataFrame) -> DataFrame:
    """``(group_id, name, review_order, path)`` -> one row a group with its ordered files."""
    return files.groupBy("group_id", "name", "review_order").agg(F.sort_array(F.collect_list("path")).alias("files"))
