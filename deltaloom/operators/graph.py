"""Symbol graph: import and call resolution, vertices and edges, data flow, symbol diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calls, paths

# fixed values: what an import may leave off its target, best first
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/index.tsx")
WORKSPACE_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")


def _first_candidate(wanted: DataFrame, keys: list[str], files: DataFrame, suffixes) -> DataFrame:
    """``wanted(keys.., resolved)`` -> the first existing candidate of each key."""
    tries = F.array(*[F.struct(F.lit(i).alias("pos"), F.concat("resolved", F.lit(s)).alias("candidate")) for i, s in enumerate(suffixes)])
    spread = wanted.select(*keys, F.inline(tries))
    known = files.select(F.col("path").alias("known")).distinct()
    return spread.join(known, F.col("candidate") == F.col("known")).groupBy(*keys).agg(F.min_by("candidate", "pos").alias("target"))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(importer, source)`` -> ``(importer, source, target)`` of relative imports that meet a file."""
    joined = F.concat(paths.parent_dir("importer"), F.lit("/"), paths.relative_import("source"))
    wanted = imports.where(F.startswith("source", F.lit("."))).select("importer", "source", paths.normalize(joined).alias("resolved")).distinct()
    return _first_candidate(wanted, ["importer", "source"], files, SUFFIXES)


def resolve_workspace(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """Bare imports: the package of that name, else the longest package whose name is a prefix up to a slash.

    The prefixes of the import are exploded and met by equality, so no range join is needed.
    """
    bare = imports.where(~F.startswith("source", F.lit("."))).select("source").distinct()
    parts = F.split("source", "/")
    prefixes = bare.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("prefix"))
    known = files.select(F.col("path").alias("known")).distinct()
    met = prefixes.join(packages.select(F.col("package").alias("prefix"), "entry"), "prefix")
    exact = met.where("prefix = source").join(known, F.col("entry") == F.col("known"), "left_semi").groupBy("source").agg(F.min("entry").alias("exact"))
    best = met.where("prefix <> source").groupBy("source").agg(F.max_by(F.struct("prefix", "entry"), F.length("prefix")).alias("b"))
    root = paths.parent_dir(paths.parent_dir("b.entry"))
    deep = best.select("source", F.concat(root, F.lit("/"), F.substr("source", F.length("b.prefix") + 2)).alias("resolved"))
    deep = _first_candidate(deep, ["source"], files, WORKSPACE_SUFFIXES).withColumnRenamed("target", "deep")
    found = bare.join(exact, "source", "left").join(deep, "source", "left").select("source", F.coalesce("exact", "deep").alias("target")).where("target is not null")
    return imports.select("importer", "source").distinct().join(found, "source").select("importer", "source", "target")


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """Relative resolution first, workspace packages else; unresolved imports come with a null target."""
    near = resolve_relative(imports, files).withColumnRenamed("target", "near")
    far = resolve_workspace(imports, files, packages).withColumnRenamed("target", "far")
    return imports.select("importer", "source").distinct().join(near, ["importer", "source"], "left").join(far, ["importer", "source"], "left").select(
        "importer", "source", F.coalesce("near", "far").alias("target"))


def import_map(names: DataFrame) -> DataFrame:
    """``names(file, local, target, import_pos, name_pos)``: of one local name the last import wins."""
    w = Window.partitionBy("file", "local").orderBy(F.desc("import_pos"), F.desc("name_pos"))
    return names.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file", "local", "target")


def nodes(modules: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(id, name, file, kind)``: a module for each file and its definitions; the first of one id stays."""
    first = modules.select(F.col("path").alias("id"), paths.file_stem("path").alias("name"), F.col("path").alias("file"),
        F.lit("Module").alias("kind"), F.lit(-1).alias("pos"))
    rest = definitions.select(F.concat_ws("::", "path", "name").alias("id"), "name", F.col("path").alias("file"), "kind", "pos")
    best = F.min(F.struct("pos", "name", "file", "kind")).alias("b")
    return first.unionByName(rest).groupBy("id").agg(best).select("id", "b.name", "b.file", "b.kind")


def known_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges both of whose ends are vertices; repeated edges stay, edges to themselves go."""
    a, b = vertices.select(F.col("id").alias("src")), vertices.select(F.col("id").alias("dst"))
    return edges.where("src <> dst").join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "edge_type")


def call_edges(calls_: DataFrame, imported: DataFrame, vertices: DataFrame) -> DataFrame:
    """``calls(file, caller, callee)`` -> Calls edges.

    A caller that is no vertex stands for its module. An imported name ends the
    search, even if no edge comes of it; then what stands before the first dot,
    if it is imported: the member of that module, else the module; then a
    symbol of the file. A member that is the caller itself goes on to the next step.
    """
    known = vertices.select(F.col("id").alias("k"))
    own_caller = F.concat_ws("::", "file", "caller")
    dot = F.instr("callee", ".")
    base = calls_.select(
        "file", F.when(F.col("caller").isNotNull(), own_caller).alias("named"), "callee",
        F.when(dot > 0, F.substring_index("callee", ".", 1)).alias("receiver"), F.substr("callee", dot + 1).alias("method"))
    names = imported.select("file", F.col("local").alias("callee"), F.col("target").alias("direct"))
    modules = imported.select("file", F.col("local").alias("receiver"), F.col("target").alias("module"))
    j = base.join(names, ["file", "callee"], "left").join(modules, ["file", "receiver"], "left")
    j = j.withColumns({"via": F.concat_ws("::", "module", "method"), "own": F.concat_ws("::", "file", "callee")})
    for k, column in (("k0", "named"), ("k1", "via"), ("k2", "own"), ("k3", "module"), ("k4", "direct")):
        j = j.join(known.withColumnRenamed("k", k), F.col(column) == F.col(k), "left")
    src = F.coalesce("k0", "file")
    other = lambda c: F.when(F.col(c) != src, F.col(c))
    dst = F.when(F.col("direct").isNotNull(), F.col("k4")).otherwise(F.coalesce(other("k1"), F.when(F.col("module").isNotNull(), other("k3")), other("k2")))
    return known_edges(j.select(src.alias("src"), dst.alias("dst"), F.lit("Calls").alias("edge_type")).where("dst is not null"), vertices)


def import_edges(names: DataFrame, resolved: DataFrame, reexports: DataFrame, vertices: DataFrame) -> DataFrame:
    """``names(importer, source, name, whole)`` -> Imports edges from a module; ``name`` null: imported for its effect.

    A symbol of the target; else, for default and namespace imports (``whole``), the
    target itself; else the symbol where the target re-exports it from,
    one step on. ``resolved(importer, source, target)`` covers re-exports too;
    ``reexports(file, name, source)``. Repeated imports give repeated edges.
    """
    known = vertices.select(F.col("id").alias("k"))
    met = resolved.where("target is not null")
    j = names.join(met, ["importer", "source"])
    j = j.withColumn("symbol", F.when(F.col("name").isNotNull(), F.concat_ws("::", "target", "name")))
    j = j.join(known, F.col("symbol") == F.col("k"), "left")
    onward = reexports.select(F.col("file").alias("importer"), "name", "source").join(met, ["importer", "source"]).select(
        F.col("importer").alias("r_file"), F.col("name").alias("r_name"), F.concat_ws("::", "target", "name").alias("beyond")).distinct()
    direct = F.when(F.col("k").isNotNull(), F.col("k")).when(F.col("name").isNull() | F.col("whole"), F.col("target"))
    first = j.select(F.col("importer").alias("src"), direct.alias("dst"), "target", "name")
    second = first.where("dst is null").join(onward, (F.col("target") == F.col("r_file")) & (F.col("name") == F.col("r_name"))).select("src",
        F.col("beyond").alias("dst"))
    edges = first.where("dst is not null").select("src", "dst").unionByName(second).withColumn("edge_type", F.lit("Imports"))
    return known_edges(edges, vertices)


def extends_edges(bases: DataFrame, imported: DataFrame, vertices: DataFrame) -> DataFrame:
    """``bases(file, type, base)`` -> Extends edges to an imported base, else to one of the same file."""
    j = bases.join(imported.select("file", F.col("local").alias("base"), F.col("target").alias("far")), ["file", "base"], "left")
    dst = F.coalesce("far", F.concat_ws("::", "file", "base"))
    return known_edges(j.select(F.concat_ws("::", "file", "type").alias("src"), dst.alias("dst"), F.lit("Extends").alias("edge_type")), vertices)


def build(parsed: DataFrame, packages: DataFrame | None = None, extends: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parsed files, with paths unique over all changes -> the symbol graph: ``vertices(id, name, file, kind)``
    and ``edges(src, dst, edge_type)``: Imports, Calls and what the call patterns add; with ``extends`` also Extends.

    Files of different changes don't see each other: the first part of a path is the change's.
    """
    spark = parsed.sparkSession
    definitions = parsed.select("path", F.posexplode("definitions").alias("pos", "d")).select("path", "pos", "d.name", "d.kind")
    vertices = nodes(parsed, definitions)
    statements = parsed.select(F.col("path").alias("importer"), F.posexplode("imports").alias("import_pos", "i")).select("importer", "import_pos", "i.*")
    exports = parsed.select(F.col("path").alias("file"), F.explode("exports").alias("e")).select("file", "e.*")
    again = exports.where("is_reexport and source is not null").select("file", "name", "source")
    sources = statements.select("importer", "source").union(again.select("file", "source")).distinct()
    if packages is None:
        packages = spark.createDataFrame([], "package string, entry string")
    resolved = resolve_imports(sources, parsed.select("path"), packages)
    resolved = resolved.where(F.substring_index("importer", "/", 1) == F.substring_index("target", "/", 1))
    whole = F.col("is_default") | F.col("is_namespace")
    names = statements.select("importer", "import_pos", "source", whole.alias("whole"), "is_default", "is_namespace",
        F.posexplode_outer("names").alias("name_pos", "n")).select(
        "importer", "import_pos", "source", "whole", "is_default", "is_namespace", "name_pos", F.col("n.name").alias("name"), F.col("n.alias").alias("alias"))
    defined = definitions.select(F.col("path").alias("target"), "name", F.lit(True).alias("defined")).distinct()
    bound = names.where("name is not null").join(resolved, ["importer", "source"]).join(defined, ["target", "name"], "left")
    symbol = F.concat_ws("::", "target", "name")
    target = F.when(F.col("is_namespace"), F.col("target")).when(F.col("defined"), symbol).when(F.col("is_default"), F.col("target")).otherwise(symbol)
    imported = import_map(bound.select(F.col("importer").alias("file"), F.coalesce("alias", "name").alias("local"), target.alias("target"), "import_pos", "name_pos"))
    sites = parsed.select(F.col("path").alias("file"), F.explode("call_sites").alias("c")).select("file",
        F.col("c.containing_function").alias("caller"), "c.callee", "c.line")
    edges = import_edges(names.select("importer", "source", "name", "whole"), resolved, again, vertices).unionByName(call_edges(sites, imported, vertices)).unionByName(
        enrich(heuristic_edges(sites), vertices))
    if extends:
        bases = parsed.select(F.col("path").alias("file"), F.explode("bases").alias("b")).select("file", F.col("b.type").alias("type"), F.col("b.base").alias("base"))
        edges = edges.unionByName(extends_edges(bases, imported, vertices))
    return vertices, edges


def heuristic_edges(call_sites: DataFrame) -> DataFrame:
    """``(file, caller, callee, line)`` -> the calls that meet a pattern."""
    return call_sites.withColumn("pattern", calls.pattern("callee")).where("pattern is not null")


def enrich(heuristics: DataFrame, vertices: DataFrame) -> DataFrame:
    """Typed edges from a symbol to its own module; of unknown symbols and of logging nothing is left."""
    own = heuristics.select(F.concat_ws("::", "file", "caller").alias("src"), F.col("file").alias("dst"), calls.edge_type("pattern").alias("edge_type"))
    return known_edges(own.where("edge_type is not null"), vertices)


def data_flow(assignments: DataFrame, calls_: DataFrame) -> DataFrame:
    """Producer to consumer within a file and scope (null scopes are one): a variable is an argument."""
    a = assignments.select("file", F.col("scope").alias("a_scope"), F.col("variable").alias("via"), F.col("callee").alias("producer"))
    c = calls_.select(F.col("file").alias("c_file"), F.col("scope").alias("c_scope"), F.col("callee").alias("consumer"), F.explode("arguments").alias("argument"), "line")
    on = (F.col("file") == F.col("c_file")) & F.col("a_scope").eqNullSafe(F.col("c_scope")) & (F.col("via") == F.col("argument")) & (F.col("producer") != F.col("consumer"))
    return a.join(c, on).select("file", F.col("a_scope").alias("scope"), "producer", "consumer", "via", "line")


def symbol_diff(old: DataFrame, new: DataFrame, keys: tuple = ("file", "name", "kind")) -> DataFrame:
    """Added, Removed, or Modified where the span's length differs; the first of repeated keys counts."""
    def one(df, tag):
        best = F.min_by((F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1), "start_line")
        return df.groupBy(*[F.col(k).alias(k) for k in keys]).agg(best.alias(tag))

    j = one(old, "old_lines").join(one(new, "new_lines"), list(keys), "full_outer")
    kind = F.when(F.col("old_lines").isNull(), "Added").when(F.col("new_lines").isNull(), "Removed").when(F.col("old_lines") != F.col("new_lines"), "Modified")
    return j.withColumn("change", kind).where("change is not null")


def internal_edges(edges: DataFrame, group_files: DataFrame) -> DataFrame:
    """Edges both of whose ends are files of one group."""
    a = group_files.select("group_id", F.col("path").alias("src"))
    b = group_files.select(F.col("group_id").alias("g2"), F.col("path").alias("dst"))
    return edges.join(a, "src").join(b, "dst").where("group_id = g2").select("group_id", "src", "dst", "edge_type")
