"""The whole analysis of changes: files in, ranked review groups out.

Every table carries ``diff_id``; one call analyses any number of changes. A
very large change is cut into partitions, each clustered by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import calls, paths
from .operators import cluster, entrypoints, evaluate, graph, output, rank, reach, refine, review
from .sources import config as conf
from .sources.parse import parse
from .sources.shared import materialize

#: changes of that many files are clustered by partition
LARGE_DIFF = 2000
#: stands for a slash within a change's id, so that the first part of a path is the change's
_SLASH = "\u0002"
#: between a change's key and a partition's name
_PART = "\u0001"


def _key(diff: str = "diff_id") -> Column:
    return F.translate(F.col(diff).cast("string"), "/", _SLASH)


class Engine:
    """Holds the configuration; every method takes and returns tables."""

    def __init__(self, config: dict | None = None, packages: DataFrame | None = None, frameworks: DataFrame | None = None):
        """``packages(package, entry)``: workspace packages, entries with the change's key before them;
        ``frameworks(pattern, name)``: the dictionary of frameworks, else the common ones."""
        self.config = config or conf.DEFAULTS
        self.packages, self.frameworks = packages, frameworks

    def facts(self, changes: DataFrame) -> DataFrame:
        """Parsed facts of each changed file; ``file`` is its path under the change's key, unique over all changes."""
        path = F.coalesce("new_path", "old_path", F.lit("<unknown>"))
        files = changes.select("diff_id", path.alias("own_path"), F.coalesce("new_content", "old_content").alias("source"), "additions", "deletions")
        files = files.where(~conf.is_ignored(F.col("own_path"), self.config))
        first = files.groupBy("diff_id", "own_path").agg(F.min(F.struct("source", "additions", "deletions")).alias("x")).select("diff_id", "own_path", "x.*")
        keyed = first.withColumn("file", F.concat(_key(), F.lit("/"), "own_path"))
        # the texts go through the parser once; its rows meet the rest by file
        parsed = parse(keyed.select(F.col("file").alias("path"), "source")).withColumnRenamed("path", "p_file")
        stats = keyed.select("diff_id", F.col("own_path").alias("path"), "file", "additions", "deletions")
        return materialize(parsed.join(stats, F.col("p_file") == F.col("file")).drop("p_file"))

    def analyze(self, changes: DataFrame, max_hops: int | None = None) -> DataFrame:
        """``changes(diff_id, old_path, new_path, old_content, new_content, additions, deletions)`` -> one nested row a change."""
        t = self.tables(changes, max_hops)
        groups = output.nested(t["groups"].select("diff_id", "group_id", "name", "score", "review_order"), t["files"], t["edges"])
        return t["summary"].join(groups, "diff_id", "left").withColumn("total_groups", F.coalesce("total_groups", F.lit(0)))

    def tables(self, changes: DataFrame, max_hops: int | None = None) -> dict[str, DataFrame]:
        """``facts, entrypoints, groups, files, edges, infrastructure, summary``, each with ``diff_id``."""
        facts = self.facts(changes)
        marked = facts.withColumnsRenamed({"path": "own_path", "file": "path"})
        vertices, edges = graph.build(marked, self.packages)
        vertices, edges = materialize(vertices), materialize(edges)
        keyed = facts.select("diff_id", "path", "file")
        size = F.count("*").over(Window.partitionBy("diff_id"))
        cut = paths.partition_key("path")
        files = keyed.withColumn("large", size >= LARGE_DIFF)
        unit = F.when(F.col("large"), F.concat(_key(), F.lit(_PART), cut["bucket"])).otherwise(_key())
        files = materialize(files.select("diff_id", "path", "file", "large", unit.alias("unit"), (F.col("large") & cut["is_infra"]).alias("infra")))
        entries = materialize(entrypoints.detect(marked).join(keyed, "file").select("diff_id", "path", "file", "symbol", "entrypoint_type"))
        open_ = files.where("not infra")
        placed = self._with_entries(open_, entries, edges, vertices, max_hops)
        placed = materialize(placed.unionByName(self._without_entries(open_.join(placed.select("unit").distinct(), "unit", "left_anti"), edges, vertices, max_hops)))
        # a group's number within its change: as the groups of a unit are numbered, or over all partitions by name
        member = placed.where("grp is not null").join(files.select("unit", "diff_id", "large", "path", "file"), ["unit", "path"])
        heads = member.groupBy("diff_id", "unit", "large", "grp", "name").agg(F.min_by("path", F.struct("late", "distance", "path")).alias("first"),
            F.first("entry_file").alias("entry_file"))
        number = F.row_number().over(Window.partitionBy("diff_id").orderBy(F.when(F.col("large"), F.col("name")), F.when(F.col("large"), F.col("first")), "unit", "grp"))
        heads = materialize(heads.withColumn("group_id", F.concat(F.lit("group_"), number.cast("string"))))
        order = Window.partitionBy("unit", "grp").orderBy("late", "distance", "path")
        member = member.drop("name", "entry_file").withColumn("flow_position", (F.row_number().over(order) - 1).cast("long"))
        member = member.join(heads.select("unit", "grp", "group_id", "name", "entry_file"), ["unit", "grp"])
        role = F.when(F.col("path") == F.col("entry_file"), "Entrypoint").when(F.col("kind") == "rescued",
            "Infrastructure").when(F.col("kind") == "test", "Test").otherwise(paths.role("path"))
        stats = facts.select("file", "additions", "deletions")
        grouped = materialize(member.join(stats, "file").select("diff_id", "group_id", "path", "file", "flow_position", role.alias("role"), "additions", "deletions"))
        # lines are counted into the files after ranking, so that the score knows a group's paths alone
        feats = rank.group_features(grouped.withColumns(paths.risk_flags("path")), ["diff_id", "group_id"]).withColumns({"additions": F.lit(0), "deletions": F.lit(0)})
        groups = rank.rank_groups(feats, "diff_id", "group_id", self.config.get("ranking")).join(heads.select("diff_id", "group_id", "name"), ["diff_id", "group_id"])
        ends = {x: vertices.select(F.col("id").alias(x), F.col("file").alias(f"{x}_file")) for x in ("src", "dst")}
        of_files = edges.join(ends["src"], "src").join(ends["dst"], "dst")
        held = grouped.select("diff_id", "group_id", "file")
        inner = of_files.join(held.withColumnRenamed("file", "src_file"), "src_file").join(
            held.select(F.col("group_id").alias("g2"), F.col("diff_id").alias("d2"), F.col("file").alias("dst_file")), "dst_file")
        own = lambda c: F.substr(c, F.instr(c, "/") + 1)
        inner = inner.where("group_id = g2 and diff_id = d2").select("diff_id", "group_id", own("src").alias("src"), own("dst").alias("dst"), "edge_type")
        left = files.where("infra").select("diff_id", "path").unionByName(placed.where("grp is null").join(files, ["unit", "path"]).select("diff_id", "path"))
        near = of_files.join(keyed.select("diff_id", F.col("file").alias("src_file"), F.col("path").alias("a")),
            "src_file").join(keyed.select(F.col("file").alias("dst_file"), F.col("path").alias("b")), "dst_file")
        infra = cluster.infra_groups(left, near.select("diff_id", F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        return {"facts": facts, "entrypoints": entries, "files": grouped.drop("file"), "groups": groups, "edges": inner, "infrastructure": infra,
            "summary": self._summary(facts)}

    def _reach(self, starts: DataFrame, edges: DataFrame, vertices: DataFrame, max_hops: int | None) -> DataFrame:
        """``starts(entry, node)`` -> least ``(entry, file, distance)`` of the files whose vertices are reached."""
        near = reach.reachability(edges, starts, max_hops)
        return near.join(vertices.select(F.col("id").alias("node"), "file"), "node").groupBy("entry", "file").agg(F.min("distance").alias("distance"))

    def _with_entries(self, files: DataFrame, entries: DataFrame, edges: DataFrame, vertices: DataFrame, max_hops: int | None) -> DataFrame:
        """``(unit, path, grp, name, entry_file, distance, late, kind)`` of the units that have entry points; ``grp`` null: infrastructure."""
        own = entries.join(files.select("file", "unit"), "file")
        number = F.row_number().over(Window.partitionBy("unit").orderBy("path", "symbol")).cast("long")
        own = materialize(own.select("unit", "file", "path", "symbol", "entrypoint_type", number.alias("nth")))
        entry = F.concat_ws("::", "file", "symbol")
        starts = own.select(entry.alias("entry"), F.explode(F.array(F.col("file"), entry)).alias("node"))
        met = self._reach(starts, edges, vertices, max_hops).join(own.select(entry.alias("entry"), "unit", "nth"), "entry")
        met = met.join(files.select("unit", "file", "path"), ["unit", "file"]).select("unit", "path", "distance", "nth")
        # the file of an entry point is its own, whatever the graph holds
        met = met.unionByName(own.select("unit", "path", F.lit(0).cast("long").alias("distance"), "nth"))
        near = met.groupBy("unit", "path").agg(F.min(F.struct("distance", "nth")).alias("b")).select("unit", "path", "b.*")
        near = materialize(near)
        moved = cluster.move_tests(near.select(F.col("unit").alias("diff_id"), F.col("nth").alias("group_id"),
            "path")).select(F.col("diff_id").alias("unit"), "path", F.col("group_id").alias("nth"))
        used = moved.select("unit", "nth").distinct().withColumn("grp", F.row_number().over(Window.partitionBy("unit").orderBy("nth")).cast("long"))
        reached = materialize(near.select("unit", "path", "distance").join(moved, ["unit", "path"]).join(used, ["unit", "nth"]).select("unit", "path", "grp", "distance"))
        names = own.join(used, ["unit", "nth"]).select("unit", "grp", F.col("path").alias("entry_file"),
            paths.group_name("path", "symbol", "entrypoint_type").alias("name"))
        rest = files.select("unit", "path").join(own.select("unit").distinct(), "unit", "left_semi").join(reached, ["unit", "path"], "left_anti")
        groups = reached.select(F.col("unit").alias("diff_id"), F.col("grp").alias("group_id"), "path")
        saved = materialize(cluster.rescue(rest.select(F.col("unit").alias("diff_id"), "path"), groups))
        all_groups = groups.unionByName(saved.where("group_id is not null").select("diff_id", "group_id", "path"))
        tests = cluster.late_tests(saved.where("group_id is null").select("diff_id", "path"), all_groups).withColumnRenamed("group_id", "test_group")
        late = saved.join(tests, ["diff_id", "path"], "left").select(
            F.col("diff_id").alias("unit"), "path", F.coalesce("group_id", "test_group").alias("grp"), F.lit(0).cast("long").alias("distance"),
            F.when(F.col("group_id").isNotNull() & paths.is_fixture_source("path"), 1).when(F.col("group_id").isNotNull(), 2).otherwise(3).alias("late"),
            F.when(F.col("group_id").isNotNull(), "rescued").when(F.col("test_group").isNotNull(), "test").alias("kind"))
        members = materialize(reached.withColumns({"late": F.lit(0), "kind": F.lit("reached")}).unionByName(late))
        joined = cluster.merge_by_stem(members.where("grp is not null").select(F.col("unit").alias("diff_id"), F.col("grp").alias("group_id"), "path"))
        joined = joined.select(F.col("diff_id").alias("unit"), F.col("group_id").alias("to_grp"), "path")
        out = members.join(joined, ["unit", "path"], "left")
        # what comes from a merged group stands behind the files of the group that stays
        out = out.withColumn("late", F.when(F.col("grp") == F.col("to_grp"),
            F.col("late")).otherwise(F.col("late") + 10 * F.col("grp"))).withColumn("grp", F.coalesce("to_grp", "grp"))
        return out.join(names, ["unit", "grp"], "left").select("unit", "path", "grp", "name", "entry_file", "distance", F.col("late").cast("long").alias("late"), "kind")

    def _without_entries(self, files: DataFrame, edges: DataFrame, vertices: DataFrame, max_hops: int | None) -> DataFrame:
        """The same of units without an entry point: what is connected, then directories; the rest is infrastructure."""
        f = files.withColumns({"project": paths.is_fixture_project("path"), "root": paths.fixture_root("path"), "fixture": paths.is_fixture_source("path")})
        rooted = F.max(F.col("fixture").cast("int")).over(Window.partitionBy("unit", "root")) == 1
        f = materialize(f.withColumn("source", cluster.is_source("path") | (F.col("project") & rooted)).select("unit", "path", "file", "source"))
        source = f.where("source")
        none = F.lit(None).cast("string")
        columns = [F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("late")]
        infra = f.where("not source").select("unit", "path", F.lit(None).cast("long").alias("grp"), none.alias("name"), none.alias("entry_file"),
            *columns, F.lit("reached").alias("kind"))
        if source.isEmpty():
            return infra
        near = self._reach(source.select(F.col("file").alias("entry"), F.col("file").alias("node")), edges, vertices, max_hops)
        near = near.join(source.select(F.col("file").alias("entry"), F.col("unit").alias("diff_id"), "path"), "entry").join(
            source.select("file", F.col("unit").alias("u2"), F.col("path").alias("other")), "file").where("diff_id = u2").select("diff_id", "path", "other")
        linked = materialize(cluster.connected_groups(near, source.select(F.col("unit").alias("diff_id"), "path")))
        alone = source.select(F.col("unit").alias("diff_id"), "path").join(linked.select("diff_id", "path"), ["diff_id", "path"], "left_anti")
        by_dir = cluster.directory_groups(alone)
        by_dir = by_dir.withColumn("grp", F.dense_rank().over(Window.partitionBy("diff_id").orderBy("name")).cast("long")).withColumn("has_entry", F.lit(False))
        by_dir = cluster.consolidate(by_dir.select("diff_id", "grp", "name", "has_entry", "path"))
        both = linked.select("diff_id", F.concat(F.lit("c"), "component").alias("g"), "name",
            "path").unionByName(by_dir.select("diff_id", F.concat(F.lit("d"), F.col("grp").cast("string")).alias("g"), "name", "path"))
        first = both.groupBy("diff_id", "g", "name").agg(F.min("path").alias("first"))
        ranked = first.withColumn("grp", F.row_number().over(Window.partitionBy("diff_id").orderBy("first", "name")).cast("long"))
        grouped = both.join(ranked.select("diff_id", "g", "grp"), ["diff_id", "g"])
        return infra.unionByName(grouped.select(F.col("diff_id").alias("unit"), "path", "grp", "name", none.alias("entry_file"), *columns,
            F.lit("reached").alias("kind")))

    def _summary(self, facts: DataFrame) -> DataFrame:
        """``(diff_id, total_files, languages, frameworks)``."""
        known = self.frameworks if self.frameworks is not None else facts.sparkSession.createDataFrame(calls.FRAMEWORKS, "pattern string, name string")
        found = calls.frameworks(facts.select(F.col("diff_id").alias("target"), F.explode("imports.source").alias("source")), known)
        found = found.groupBy(F.col("target").alias("diff_id")).agg(F.array_sort(F.collect_set("name")).alias("frameworks"))
        languages = F.array_sort(F.collect_set(F.when(F.col("language") != "Unknown", F.lower("language"))))
        none = F.array().cast("array<string>")
        return facts.groupBy("diff_id").agg(F.count("*").alias("total_files"), languages.alias("languages")).join(found, "diff_id",
            "left").withColumn("frameworks", F.coalesce("frameworks", none))

    def refine(self, tables: dict[str, DataFrame], provider) -> tuple[dict[str, DataFrame], DataFrame]:
        """Asks a reviewer for edits of each change's groups and applies what can be applied: the new tables, and the warnings.

        ``provider``: rows ``(key, prompt)`` to ``(key, response)``, see ``sources.providers``. A change without a usable answer stays as it is.
        """
        groups, infra = tables["groups"], tables["infrastructure"].select("diff_id", "path")
        asked = review.refinement_request(groups, tables["files"], infra).select(F.col("diff_id").cast("string").alias("key"), F.col("request").alias("prompt"))
        ids = groups.select("diff_id", F.col("diff_id").cast("string").alias("key")).distinct()
        ops, _ = review.parse_refinement(materialize(provider(asked).join(ids, "key").select("diff_id", "response")))
        entry = tables["files"].where("role = 'Entrypoint'").groupBy("diff_id", "group_id").agg(F.min_by("path", "flow_position").alias("entry_file"))
        g = groups.join(entry, ["diff_id", "group_id"], "left").select("diff_id", "group_id", "name", "entry_file", F.col("score").alias("risk"), "review_order")
        none = F.lit(0).cast("long")
        files = tables["files"].select("diff_id", "group_id", "path", "flow_position", "role", "additions", "deletions").unionByName(
            infra.select("diff_id", F.lit(refine.INFRASTRUCTURE).alias("group_id"), "path", none.alias("flow_position"),
                F.lit("Infrastructure").alias("role"), none.alias("additions"), none.alias("deletions")))
        return refine.apply_lenient(g, files, tables["edges"], ops)

    def export_manifest(self, tables: dict[str, DataFrame]) -> DataFrame:
        """One row a group, with its ordered files."""
        files = tables["files"].select("diff_id", "group_id", "path")
        groups = tables["groups"].select("diff_id", "group_id", "name", "review_order")
        return files.join(groups, ["diff_id", "group_id"]).groupBy("diff_id", "group_id", "name", "review_order").agg(F.sort_array(F.collect_list("path")).alias("files"))

    def evaluate(self, tables: dict[str, DataFrame], thresholds: dict | None = None) -> DataFrame:
        """Metrics and scores of each change's grouping."""
        placed = tables["files"].select(F.col("diff_id").alias("target"), "group_id", "path")
        infra = tables["infrastructure"].select(F.col("diff_id").alias("target"), F.lit(None).cast("string").alias("group_id"), "path")
        return evaluate.score(evaluate.metrics(placed.unionByName(infra)), thresholds)
