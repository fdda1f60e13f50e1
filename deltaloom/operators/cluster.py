"""Assignment of changed files to review groups, and what happens to the rest.

All tables carry a ``diff_id``, so one job clusters any number of changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.shared import materialize

SMALL_GROUP = 5
MERGED_AT_ONCE = 12


def assign(reach: DataFrame) -> DataFrame:
    """``reach(diff_id, entry, path, distance)`` -> each file at its nearest entry point, the first of equals."""
    return reach.groupBy("diff_id", "path").agg(F.min(F.struct("distance", "entry")).alias("b")).select("diff_id", "path",
        F.col("b.entry").alias("entry"), F.col("b.distance").alias("distance"))


def positions(assigned: DataFrame) -> DataFrame:
    """Adds ``flow_position``, from 0 by (distance, path) within each group."""
    w = Window.partitionBy("diff_id", "entry").orderBy("distance", "path")
    return assigned.withColumn("flow_position", (F.row_number().over(w) - 1).cast("long"))


def directory_groups(files: DataFrame) -> DataFrame:
    """``(diff_id, path)`` -> the group of each file's directory, named by it, with the group's size."""
    d = files.select("diff_id", "path").distinct().withColumn("name", paths.parent_dir("path"))
    return d.join(d.groupBy("diff_id", "name").agg(F.count("*").alias("n_files")), ["diff_id", "name"]).select("diff_id", "name", "path", "n_files")


def merge_level(files: DataFrame, depth: int) -> DataFrame:
    """One level of consolidation: ``files(diff_id, grp, name, has_entry, path)``.

    Groups without an entry point and of at most ``SMALL_GROUP`` files, all
    under one prefix of ``depth`` directories, are merged with those of the
    same prefix; where more than ``MERGED_AT_ONCE`` share it, by the directory
    of their first file instead. The first group's key and name stay.
    """
    pre = files.withColumn("prefix", paths.dir_prefix("path", depth))
    groups = pre.groupBy("diff_id", "grp", "name", "has_entry").agg(
        F.count("*").alias("n"), F.count("prefix").alias("with_prefix"), F.min("prefix").alias("lo"), F.max("prefix").alias("hi"), F.min("path").alias("first_path"))
    fit = ~F.col("has_entry") & (F.col("n") <= SMALL_GROUP) & (F.col("with_prefix") == F.col("n")) & (F.col("lo") == F.col("hi"))
    open_ = groups.where(fit)
    size = open_.groupBy("diff_id", "lo").agg(F.count("*").alias("members")).withColumnRenamed("lo", "b_lo").withColumnRenamed("diff_id", "b_diff")
    sub = F.when(F.contains("first_path", F.lit("/")), paths.directory("first_path")).otherwise(F.col("first_path"))
    bucketed = open_.join(size, (F.col("diff_id") == F.col("b_diff")) & (F.col("lo") == F.col("b_lo"))).withColumn("bucket",
        F.when(F.col("members") <= MERGED_AT_ONCE, F.concat(F.lit("p:"), "lo")).otherwise(F.concat(F.lit("d:"), "lo", F.lit(":"), sub)))
    lead = bucketed.groupBy("diff_id", "bucket").agg(F.min(F.struct("grp", "name")).alias("lead"))
    moved = bucketed.join(lead, ["diff_id", "bucket"]).select("diff_id", "grp", F.col("lead.grp").alias("to_grp"), F.col("lead.name").alias("to_name"))
    return files.join(moved, ["diff_id", "grp"], "left").select("diff_id", F.coalesce("to_grp", "grp").alias("grp"),
        F.coalesce("to_name", "name").alias("name"), "has_entry", "path")


def consolidate(files: DataFrame) -> DataFrame:
    """All levels, from six directories up to the root; ``grp`` is renumbered by name after each."""
    for depth in range(6, -1, -1):
        files = renumber(materialize(merge_level(files, depth)))
    return materialize(files)


def renumber(files: DataFrame) -> DataFrame:
    """``grp`` becomes the 1-based rank of (name, old grp) within the change."""
    groups = files.select("diff_id", "grp", "name").distinct()
    w = Window.partitionBy("diff_id").orderBy("name", "grp")
    new = groups.withColumn("new_grp", F.row_number().over(w).cast("long")).select("diff_id", "grp", "new_grp")
    return files.join(new, ["diff_id", "grp"]).select("diff_id", F.col("new_grp").alias("grp"), "name", "has_entry", "path")


def nearest_directory(files: DataFrame, grouped: DataFrame, least: int = 2) -> DataFrame:
    """``files(diff_id, path)`` -> the group that shares the most leading directories, at least ``least``; ties: the first.

    Leading directories are exploded to prefixes and met by equality.
    """
    def spread(df, *keep):
        parts = F.split("path", "/")
        deep = F.explode(F.sequence(F.lit(least), F.size(parts) - 1)).alias("depth")
        d = df.where(F.size(parts) > least).select(*keep, "path", deep)
        return d.select(*keep, "path", "depth", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/").alias("prefix"))

    groups = spread(grouped, "diff_id", "group_id").select("diff_id", "group_id", "depth", "prefix").distinct()
    best = groups.groupBy("diff_id", "depth", "prefix").agg(F.min("group_id").alias("group_id"))
    met = spread(files, "diff_id").join(best, ["diff_id", "depth", "prefix"])
    return met.groupBy("diff_id", "path").agg(F.max_by("group_id", "depth").alias("group_id"), F.max("depth").alias("shared"))


def topic_affinity(files: DataFrame, grouped: DataFrame) -> DataFrame:
    """``files(diff_id, path)`` -> the group one of whose files shares the most topic tokens.

    Accepted at two tokens or more, or at one if no other group has as many; ties of more go to the first.
    """
    def spread(df, *keep):
        return df.select(*keep, "path", F.explode(paths.topic_tokens("path")).alias("token"))

    a = spread(files, "diff_id")
    b = spread(grouped, "diff_id", "group_id").withColumnRenamed("path", "other")
    shared = a.join(b, ["diff_id", "token"]).groupBy("diff_id", "path", "group_id", "other").agg(F.count("*").alias("n"))
    per_group = shared.groupBy("diff_id", "path", "group_id").agg(F.max("n").alias("n"))
    best = per_group.groupBy("diff_id", "path").agg(F.max(F.struct("n", (-F.col("group_id")).alias("neg"))).alias("b"), F.max("n").alias("top"))
    tied = per_group.join(best.select("diff_id", "path", "top"), ["diff_id", "path"]).where("n = top").groupBy("diff_id", "path").agg(F.count("*").alias("ties"))
    return best.join(tied, ["diff_id", "path"]).where("top >= 2 or ties = 1").select("diff_id", "path", (-F.col("b.neg")).alias("group_id"),
        F.col("top").alias("overlap"))


def move_tests(grouped: DataFrame) -> DataFrame:
    """Test files move to the group of the implementation with their stem; the last implementation of a stem counts."""
    g = grouped.select("diff_id", "group_id", "path", paths.is_test_file("path").alias("is_test"), paths.test_impl_stem("path").alias("stem"),
        paths.bare_stem("path").alias("bare"))
    impl = g.where("not is_test")
    by_stem = impl.groupBy("diff_id", "stem").agg(F.max_by("group_id", "path").alias("to_stem"))
    by_bare = impl.where("bare <> ''").groupBy("diff_id", "bare").agg(F.max_by("group_id", "path").alias("to_bare"))
    j = g.join(by_stem, ["diff_id", "stem"], "left").join(by_bare, ["diff_id", "bare"], "left")
    return j.select("diff_id", "path", "is_test", F.when(F.col("is_test"), F.coalesce("to_stem", "to_bare", "group_id")).otherwise(F.col("group_id")).alias("group_id"))


def common_prefix(files: DataFrame, keys: list[str]) -> DataFrame:
    """The longest path of directories that all files of a key share, with a slash at its end; ``Mixed`` for none.

    The least and the greatest path share what all of them share.
    """
    ends = files.groupBy(*keys).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    lo, hi = F.split("lo", "/"), F.split("hi", "/")
    depth = F.aggregate(
        F.sequence(F.lit(0), F.size(lo) - 1), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct((s.n + F.when(s.on & (F.get(lo, i) == F.coalesce(F.get(hi, i),
            F.lit(""))) & (i < F.size(lo) - 1) & (i < F.size(hi) - 1), 1).otherwise(0)).alias("n"),
                              (s.on & (F.get(lo, i) == F.coalesce(F.get(hi, i), F.lit("")))).alias("on")), lambda s: s.n)
    shared = F.array_join(F.slice(lo, F.lit(1), depth), "/")
    return ends.select(*keys, F.when(depth > 0, F.concat(shared, F.lit("/"))).otherwise("Mixed").alias("prefix"))


def infra_groups(files: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(diff_id, path)`` -> ``category`` and ``sub_group``: by category; then files that ``edges(diff_id, src,
    dst)`` of files connect, named by their common directory; then by directory of two or more; then the rest."""
    from . import reach

    f = files.select("diff_id", "path").distinct().withColumn("category", paths.category("path")).withColumn("dir", paths.parent_dir("path"))
    titles = F.create_map(*[F.lit(x) for kv in paths.CATEGORY_TITLES.items() for x in kv])
    f = f.withColumn("prefix", F.lit(None).cast("string"))
    if edges is not None:
        open_ = f.where("category = 'Unclassified'").select("diff_id", "path")
        node = lambda c: F.concat(F.col("diff_id").cast("string"), F.lit("/"), F.col(c))
        inner = edges.select("diff_id", F.col("src").alias("path"), "dst").join(open_, ["diff_id", "path"], "left_semi")
        inner = inner.select("diff_id", F.col("path").alias("src"), F.col("dst").alias("path")).join(open_, ["diff_id", "path"], "left_semi").where("src <> path")
        links = materialize(inner.select(node("src").alias("src"), node("path").alias("dst")).distinct())
        if not links.isEmpty():
            comp = reach.components(links, links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
            joined = open_.withColumn("node", node("path")).join(comp, "node").select("diff_id", "component", "path")
            named = joined.join(common_prefix(joined, ["diff_id", "component"]), ["diff_id", "component"]).select("diff_id", "path", F.col("prefix").alias("by_edge"))
            f = f.drop("prefix").join(named, ["diff_id", "path"], "left").withColumnRenamed("by_edge", "prefix")
    rest = (F.col("category") == "Unclassified") & F.col("prefix").isNull()
    count = f.where(rest).groupBy("diff_id", "dir").agg(F.count("*").alias("n")).where("n >= 2")
    j = f.join(count, ["diff_id", "dir"], "left")
    shared = rest & F.col("n").isNotNull()
    grouped = shared | F.col("prefix").isNotNull()
    return j.select(
        "diff_id", "path", F.when(grouped, "DirectoryGroup").otherwise(F.col("category")).alias("category"),
        F.when(F.col("prefix").isNotNull(), F.col("prefix")).when(shared, F.col("dir")).otherwise(F.element_at(titles, F.col("category"))).alias("sub_group"))


def late_tests(files: DataFrame, grouped: DataFrame) -> DataFrame:
    """Test files that were left over -> the group of an implementation with their stem, the last one that has it."""
    impl = grouped.where(~paths.is_test_file("path")).select("diff_id", "group_id", paths.test_impl_stem("path").alias("stem"))
    last = impl.groupBy("diff_id", "stem").agg(F.max("group_id").alias("group_id"))
    open_ = files.where(paths.is_test_file("path") & paths.category("path").isin("Unclassified", "DirectoryGroup"))
    return open_.select("diff_id", "path", paths.test_impl_stem("path").alias("stem")).join(last, ["diff_id", "stem"]).select("diff_id", "path", "group_id")


def is_source(path: str = "path") -> Column:
    """Whether a file counts as source where a change has no entry point."""
    kind, like = paths.category(path), paths.is_config_like(path)
    soft = ~kind.isin("Infrastructure", "Unclassified", "DirectoryGroup")
    plain = kind.isin("Unclassified", "DirectoryGroup")
    return paths.is_fixture_source(path) | (~like & (plain | (soft & paths.has_source_extension(path) & ~paths.is_top_level_doc(path))))


def connected_groups(near: DataFrame, files: DataFrame) -> DataFrame:
    """Files of changes without entry points that reach one another: ``(diff_id, path, component, name)``.

    ``near(diff_id, path, other)``: what each file reaches, either way; groups of one file don't appear.
    """
    from . import reach

    node = lambda c: F.concat(F.col("diff_id").cast("string"), F.lit("/"), F.col(c))
    both = near.join(files.select("diff_id", "path"), ["diff_id", "path"], "left_semi").join(files.select("diff_id", F.col("path").alias("other")),
        ["diff_id", "other"], "left_semi")
    links = materialize(both.where("path <> other").select(node("path").alias("src"), node("other").alias("dst")).distinct())
    if links.isEmpty():
        return files.where("false").select("diff_id", "path", F.lit("").alias("component"), F.lit("").alias("name"))
    comp = reach.components(links, links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    member = files.withColumn("node", node("path")).join(comp, "node").select("diff_id", "path", "component")
    first = member.groupBy("diff_id", "component").agg(F.min("path").alias("first"))
    label = F.when(F.contains("first", F.lit("/")), paths.file_name(paths.directory("first"))).otherwise("root")
    return member.join(first, ["diff_id", "component"]).select("diff_id", "path", "component", F.concat(label, F.lit(" (connected)")).alias("name"))


def partitions(files: DataFrame) -> DataFrame:
    """Partition key of each file of a very large change."""
    return files.select("diff_id", "path", *[c.alias(n) for n, c in paths.partition_key("path").items()])


def exact_directory(files: DataFrame, grouped: DataFrame) -> DataFrame:
    """The group with the most files in the file's own directory, if no other has as many."""
    count = grouped.withColumn("dir", paths.parent_dir("path")).groupBy("diff_id", "dir", "group_id").agg(F.count("*").alias("n"))
    best = count.groupBy("diff_id", "dir").agg(F.max("n").alias("top"))
    first = count.join(best, ["diff_id", "dir"]).where("n = top").groupBy("diff_id", "dir").agg(F.count("*").alias("ties"),
        F.min("group_id").alias("group_id")).where("ties = 1")
    return files.withColumn("dir", paths.parent_dir("path")).join(first, ["diff_id", "dir"]).select("diff_id", "path", "group_id")


def rescue(files: DataFrame, grouped: DataFrame) -> DataFrame:
    """``files(diff_id, path)`` that no entry point reached -> ``(diff_id, path, group_id)``, null: infrastructure.

    Sources under a fixture root go together: to the group with the most of the root's
    sources, if no other has as many, else to the nearest directory of the
    first of them, else to the largest group; a fixture's project files
    follow. Documentation goes by topic, else to the largest group (the last of
    equals) if it describes code; schemas and generated code by topic; plain
    source by the nearest directory, then by topic, native source at last by
    its exact directory. The rest stays infrastructure.
    """
    docs = F.sum(paths.is_root_docs_page("path").cast("int")).over(Window.partitionBy("diff_id"))
    f = files.select("diff_id", "path").distinct().withColumns({"kind": paths.category("path"), "like": paths.is_config_like("path"), "root_docs": docs})
    f = f.withColumn("fallback", paths.is_doc_fallback("path", F.col("root_docs")))
    near = nearest_directory(files, grouped).select("diff_id", "path", F.col("group_id").alias("near"))
    topic = topic_affinity(files, grouped).select("diff_id", "path", F.col("group_id").alias("topic"))
    same = exact_directory(files, grouped).select("diff_id", "path", F.col("group_id").alias("same"))
    sizes = grouped.groupBy("diff_id", "group_id").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("diff_id").agg(F.max(F.struct("n", "group_id")).alias("b")).select("diff_id", F.col("b.group_id").alias("largest"))
    j = f.join(near, ["diff_id", "path"], "left").join(topic, ["diff_id", "path"], "left").join(same, ["diff_id", "path"], "left").join(largest, "diff_id", "left")
    j = j.withColumns({"root": paths.fixture_root("path"), "fixture": paths.is_fixture_source("path"), "project": paths.is_fixture_project("path")})
    held = grouped.where(paths.is_fixture_source("path")).groupBy("diff_id", paths.fixture_root("path").alias("root"), "group_id").agg(F.count("*").alias("n"))
    top = held.groupBy("diff_id", "root").agg(F.max("n").alias("n"))
    by_root = held.join(top, ["diff_id", "root", "n"]).groupBy("diff_id", "root").agg(F.count("*").alias("ties"),
        F.min("group_id").alias("by_root")).where("ties = 1").drop("ties")
    first = j.where("fixture").groupBy("diff_id", "root").agg(F.min_by(F.coalesce("near", "largest"), "path").alias("by_first"))
    j = j.join(by_root, ["diff_id", "root"], "left").join(first, ["diff_id", "root"], "left")
    native = F.lower(F.substring_index("path", ".", -1)).isin("c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "h++")
    to = (
        F.when(F.col("fixture"), F.coalesce("by_root", "by_first"))
        .when(F.col("project") & (F.col("by_root").isNotNull() | F.col("by_first").isNotNull()), F.coalesce("by_root", "by_first"))
        .when(F.col("kind") == "Documentation", F.coalesce("topic", F.when(F.col("fallback"), F.col("largest"))))
        .when(F.col("kind").isin("Schema", "Generated"), F.col("topic")).when((F.col("kind") != "Unclassified") | F.col("like"), None)
        .otherwise(F.coalesce("near", "topic", F.when(native, F.col("same"))))
    )
    return j.select("diff_id", "path", to.alias("group_id"))


def merge_by_directory(files: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(diff_id, group_id, path)`` of groups without an entry point: the two first small groups that have files
    of one directory are merged, under the first's id, until no directory has two.

    A round makes all merges whose two groups have no earlier one to wait for.
    """
    now = files.select("diff_id", "group_id", "path")
    for _ in range(max_rounds):
        small = now.groupBy("diff_id", "group_id").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL_GROUP).select("diff_id", "group_id")
        held = now.where(F.contains("path", F.lit("/"))).join(small, ["diff_id", "group_id"], "left_semi").select("diff_id",
            paths.directory("path").alias("dir"), "group_id").distinct()
        order = F.row_number().over(Window.partitionBy("diff_id", "dir").orderBy("group_id"))
        two = held.withColumn("nth", order).where("nth <= 2").groupBy("diff_id", "dir").agg(F.min("group_id").alias("a"),
            F.max("group_id").alias("b")).where("a <> b").select("diff_id", "a", "b").distinct()
        ends = two.select("diff_id", F.explode(F.array("a", "b")).alias("g"), F.struct("a", "b").alias("pair")).groupBy("diff_id", "g").agg(F.min("pair").alias("first"))
        one = lambda c: ends.select("diff_id", F.col("g").alias(c), F.col("first").alias(f"{c}_first"))
        pairs = materialize(two.join(one("a"), ["diff_id", "a"]).join(one("b"), ["diff_id", "b"]).where("a_first = struct(a, b) and b_first = struct(a, b)").select(
            "diff_id", F.col("b").alias("group_id"), F.col("a").alias("into")))
        if pairs.isEmpty():
            return now
        now = materialize(now.join(pairs, ["diff_id", "group_id"], "left").select("diff_id", F.coalesce("into", "group_id").alias("group_id"), "path"))
    raise RuntimeError(f"not settled after {max_rounds} rounds")


def merge_by_stem(files: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(diff_id, group_id, path)``: groups are merged while a stem lies in exactly two of them, once as a test
    and once not. ``merge_by_directory`` is the rule for groups without an entry point.

    Merging never undoes such a pair, so the order of merges does not change
    the outcome and all pairs of a round are merged at once, as components.
    The larger group's id stays; of equals the implementation's.
    """
    from . import reach

    now = materialize(files.select("diff_id", "group_id", "path", paths.bare_stem("path").alias("stem"), paths.is_test_file("path").alias("test")))
    for _ in range(max_rounds):
        s = now.where("stem <> ''").groupBy("diff_id", "stem").agg(
            F.count_distinct("group_id").alias("groups"), F.min(F.when(F.col("test"), F.col("group_id"))).alias("t"),
                F.min(F.when(~F.col("test"), F.col("group_id"))).alias("i"))
        pairs = materialize(s.where("groups = 2 and t is not null and i is not null and t <> i").select("diff_id", "t", "i").distinct())
        if pairs.isEmpty():
            break
        node = lambda c: F.concat(F.col("diff_id").cast("string"), F.lit("/"), F.col(c).cast("string"))
        nodes = now.select(node("group_id").alias("node")).distinct()
        comp = reach.components(pairs.select(node("t").alias("src"), node("i").alias("dst")), nodes)
        sizes = now.groupBy("diff_id", "group_id").agg(F.count("*").alias("n"), F.count_if(~F.col("test")).alias("impl")).withColumn("node", node("group_id"))
        lead = sizes.join(comp, "node").groupBy("component").agg(F.max_by("group_id", F.struct("n", "impl", "node")).alias("to_group"))
        to = comp.join(lead, "component").select("node", "to_group")
        now = materialize(now.withColumn("node", node("group_id")).join(to, "node").select("diff_id", F.col("to_group").alias("group_id"), "path", "stem", "test"))
    return now.select("diff_id", "group_id", "path")
