"""Every registered query of the engine and its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calls as call_rules
from ..functions import paths, text
from ..operators import cluster, evaluate, graph, rank, reach, refine, similarity
from ..sources.shared import materialize, table
from . import fixtures
from . import oracles as o
from .adapters import CALLS_SQL, FILES_SQL, GRAPH_SQL, call_sites, changed_files, keys_graph

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- paths ------------------------------------------------------------------------

@query(f"WITH {FILES_SQL} SELECT doc_id, path, {o.LANGUAGE} AS language FROM files")
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return changed_files(spark, sf).select("doc_id", "path", paths.language("path").alias("language"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, path, {o.CATEGORY} AS category, {o.CONFIG_LIKE} AS config_like, {o.TOP_DOC} AS top_level_doc, {o.rule(paths.TRUE_INFRA)} AS true_infra FROM files""")
def classify_paths(spark, sf):
    return changed_files(spark, sf).select(
        "doc_id", "path", paths.category("path").alias("category"), paths.is_config_like("path").alias("config_like"),
            paths.is_top_level_doc("path").alias("top_level_doc"),
        paths.is_true_infrastructure("path").alias("true_infra"))


@query(f"WITH {FILES_SQL} SELECT doc_id, path, {o.ROLE} AS role, {o.TEST_FILE} AS is_test_file FROM files")
def file_roles(spark, sf):
    return changed_files(spark, sf).select("doc_id", "path", paths.role("path").alias("role"), paths.is_test_file("path").alias("is_test_file"))


@query(f"""WITH {FILES_SQL} SELECT diff_id, count(*) AS n_files, bool_or({o.rule(paths.RISK_SCHEMA)}) AS has_schema, bool_or({o.rule(paths.RISK_AUTH)}) AS has_auth,
  bool_or({o.rule(paths.RISK_API)}) AS has_api, bool_and({o.rule(paths.RISK_TEST)}) AS test_only FROM files GROUP BY diff_id""")
def risk_flags_by_path(spark, sf):
    f = changed_files(spark, sf).withColumns(paths.risk_flags("path"))
    return rank.group_features(f, ["diff_id"]).select("diff_id", "n_files", "has_schema", "has_auth", "has_api", "test_only")


@query(f"WITH {FILES_SQL} SELECT doc_id, path, {o.BARE} AS bare_stem, {o.IMPL} AS test_impl_stem FROM files")
def stems(spark, sf):
    return changed_files(spark, sf).select("doc_id", "path", paths.bare_stem("path").alias("bare_stem"), paths.test_impl_stem("path").alias("test_impl_stem"))


@query(f"WITH {FILES_SQL} SELECT doc_id, path, array_to_string(list_sort({o.TOPICS}), ' ') AS tokens FROM files")
def topic_tokens(spark, sf):
    return changed_files(spark, sf).select("doc_id", "path", F.array_join(F.array_sort(paths.topic_tokens("path")), " ").alias("tokens"))


@query(f"""WITH {FILES_SQL}, c AS (SELECT *, {o.CONFIG_LIKE} AS cl, {o.CATEGORY} AS cat, string_split(path, '/') AS p FROM files)
SELECT diff_id, bucket, is_infra, count(*) AS n_files FROM (SELECT diff_id, cl OR cat <> 'Unclassified' AS is_infra,
  CASE WHEN cl THEN 'config-like' WHEN cat = 'TestUtil' THEN 'test-util' WHEN cat <> 'Unclassified' THEN lower(cat) WHEN p[1] = '' THEN 'root'
    WHEN p[1] IN {o.names(paths.WORKSPACE_ROOTS)} AND len(p) >= 3 AND NOT contains(p[2], '.') AND NOT contains(p[3], '.') AND p[2] IN {o.names(paths.CONTAINERS)} THEN p[1] || '/' || p[2] || '/' || p[3]
    WHEN p[1] IN {o.names(paths.WORKSPACE_ROOTS)} AND len(p) >= 2 AND NOT contains(p[2], '.') THEN p[1] || '/' || p[2] ELSE p[1] END AS bucket FROM c) GROUP BY ALL""")
def large_diff_partitions(spark, sf):
    return cluster.partitions(changed_files(spark, sf)).groupBy("diff_id", "bucket", "is_infra").agg(F.count("*").alias("n_files"))


# --- ranking ----------------------------------------------------------------------

_RANK_SQL = """
WITH g AS (
  SELECT c_mktsegment AS diff_id, c_nationkey AS group_id, bool_or(l_returnflag = 'R') AS has_schema, bool_or(o_orderpriority = '1-URGENT') AS has_api,
         bool_or(l_linestatus = 'F' AND l_quantity > 49) AS has_auth, bool_and(l_returnflag = 'N') AS test_only,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions, count(*) AS n_files
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
f AS (
  SELECT *, least(1.0, CASE WHEN has_schema THEN 0.3 ELSE 0 END + CASE WHEN has_api THEN 0.25 ELSE 0 END + CASE WHEN has_auth THEN 0.35 ELSE 0 END)::DOUBLE AS risk,
         0.5::DOUBLE AS centrality, greatest(0.0, least(1.0, ln(1.0 + additions + deletions) / ln(100001.0)))::DOUBLE AS surface_area, CASE WHEN test_only THEN 0.1 ELSE 0.5 END::DOUBLE AS uncertainty FROM g),
s AS (SELECT *, round((0.35 * risk + 0.25 * centrality + 0.20 * surface_area + 0.20 * uncertainty) / (0.35 + 0.25 + 0.20 + 0.20), 6) AS score FROM f)
SELECT diff_id, group_id, has_schema, has_api, has_auth, test_only, additions, deletions, n_files, risk, centrality, round(surface_area, 6) AS surface_area, uncertainty, score,
       row_number() OVER (PARTITION BY diff_id ORDER BY score DESC, CAST(group_id AS VARCHAR)) AS review_order FROM s"""


@query(_RANK_SQL)
def rank_groups(spark, sf):
    """Flagship: each market segment is a change, its nations are groups, its lines files."""
    files = (
        table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_mktsegment").alias("diff_id"), F.col("c_nationkey").alias("group_id"), (F.col("l_returnflag") == "R").alias("is_schema"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_api"),
                ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 49)).alias("is_auth"), (F.col("l_returnflag") == "N").alias("is_test"),
                F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))
    )
    out = rank.rank_groups(rank.group_features(files, ["diff_id", "group_id"]), "diff_id", "group_id", max_lines=100_000)
    return out.withColumn("surface_area", F.round("surface_area", 6))


# --- calls and graph --------------------------------------------------------------

@query(f"WITH {CALLS_SQL}, p AS (SELECT *, {o.PATTERN} AS pattern FROM calls) SELECT event_id, callee, pattern, {o.EDGE} AS edge_type FROM p")
def call_patterns(spark, sf):
    return call_sites(spark, sf).select("event_id", "callee", call_rules.pattern("callee").alias("pattern")).withColumn("edge_type", call_rules.edge_type("pattern"))


@query(f"""WITH {CALLS_SQL}, p AS (SELECT *, {o.PATTERN} AS pattern FROM calls), e AS (SELECT file || '::' || caller AS src, file AS dst, {o.EDGE} AS edge_type FROM p WHERE caller IS NOT NULL)
SELECT src, dst, edge_type, count(*) AS n FROM e WHERE edge_type IS NOT NULL GROUP BY ALL""")
def enrich_edges(spark, sf):
    c = call_sites(spark, sf)
    files = c.select(F.col("file").alias("path")).distinct()
    defs = c.where("caller is not null").select(F.col("file").alias("path"), F.col("caller").alias("name"), F.lit("Function").alias("kind"),
        F.lit(0).alias("pos")).distinct()
    return graph.enrich(graph.heuristic_edges(c), graph.nodes(files, defs)).groupBy("src", "dst", "edge_type").agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS_SQL},
sym AS (SELECT DISTINCT file || '::' || caller AS id FROM calls WHERE caller IS NOT NULL UNION SELECT DISTINCT file FROM calls),
imp AS (SELECT file, local, target FROM (SELECT file, 'f' || (line % 9) AS local, 'src/m' || (line % 43) || '.ts::f' || (line % 7) AS target, row_number() OVER (PARTITION BY file, 'f' || (line % 9) ORDER BY line DESC, event_id DESC) AS n FROM calls) WHERE n = 1),
c AS (SELECT file, CASE WHEN caller IS NULL THEN file ELSE file || '::' || caller END AS src, 'f' || (event_id % 11) || CASE WHEN event_id % 3 = 0 THEN '.f' || (event_id % 4) ELSE '' END AS callee FROM calls),
r AS (SELECT c.*, d.target AS direct, m.target AS module, split_part(callee, '.', -1) AS method FROM c LEFT JOIN imp d ON d.file = c.file AND d.local = c.callee
      LEFT JOIN imp m ON m.file = c.file AND contains(callee, '.') AND m.local = split_part(callee, '.', 1)),
t AS (SELECT src, CASE WHEN direct IS NOT NULL THEN direct WHEN module IS NOT NULL THEN coalesce((SELECT id FROM sym WHERE id = module || '::' || method), module) ELSE (SELECT id FROM sym WHERE id = r.file || '::' || callee) END AS dst FROM r)
SELECT src, dst, 'Calls' AS edge_type, count(*) AS n FROM t WHERE dst IS NOT NULL AND src <> dst AND dst IN (SELECT id FROM sym) AND src IN (SELECT id FROM sym) GROUP BY ALL""")
def call_edges(spark, sf):
    c = call_sites(spark, sf)
    files = c.select(F.col("file").alias("path")).distinct()
    defs = c.where("caller is not null").select(F.col("file").alias("path"), F.col("caller").alias("name"), F.lit("Function").alias("kind"),
        F.lit(0).alias("pos")).distinct()
    target = F.format_string("src/m%d.ts::f%d", F.col("line") % 43, F.col("line") % 7)
    names = graph.import_map(c.select("file", F.concat(F.lit("f"), F.col("line") % 9).alias("local"), target.alias("target"),
        F.col("line").alias("import_pos"), F.col("event_id").alias("name_pos")))
    callee = F.concat(F.lit("f"), (F.col("event_id") % 11).cast("string"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(".f"), (F.col("event_id") % 4).cast("string"))).otherwise(""))
    out = graph.call_edges(c.select("file", "caller", callee.alias("callee")), names, graph.nodes(files, defs))
    return out.groupBy("src", "dst", "edge_type").agg(F.count("*").alias("n"))


_IMPORTS_SQL = f"""WITH {FILES_SQL}, known AS (SELECT DISTINCT path FROM files),
imp AS (SELECT DISTINCT path AS importer, '../' || regexp_replace(regexp_extract(path, '[^/]*/[^/]*$'), '\\.[a-z]*$', '') AS source FROM files WHERE regexp_matches(path, '^[^/]+/[^/]+/')),
res AS (SELECT importer, source, regexp_replace(regexp_extract(importer, '^(.*)/[^/]*$', 1), '/?[^/]*$', '') AS up, substr(source, 4) AS rest FROM imp),
cand AS (SELECT importer, source, s.pos, CASE WHEN up = '' THEN rest ELSE up || '/' || rest END || s.suffix AS candidate FROM res,
  (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(graph.SUFFIXES))}) s(pos, suffix)),
hit AS (SELECT importer, source, arg_min(candidate, pos) AS target FROM cand WHERE candidate IN (SELECT path FROM known) GROUP BY 1, 2)
SELECT imp.importer, imp.source, target FROM imp LEFT JOIN hit USING (importer, source)"""


@query(_IMPORTS_SQL)
def import_resolution(spark, sf):
    f = changed_files(spark, sf).select("path").distinct()
    source = F.concat(F.lit("../"), F.regexp_replace(paths.short_label("path"), r"\.[a-z]*$", ""))
    imports = f.where(F.size(F.split("path", "/")) > 2).select(F.col("path").alias("importer"), source.alias("source"))
    # such a source has dots at its start only as far as '..' goes: it is a path already, as in TypeScript
    wanted = imports.select("importer", "source", paths.normalize(F.concat(paths.parent_dir("importer"), F.lit("/"), "source")).alias("resolved"))
    hit = graph._first_candidate(wanted, ["importer", "source"], f, graph.SUFFIXES)
    return imports.join(hit, ["importer", "source"], "left")


@query("""WITH pk AS (SELECT DISTINCT '@' || source || CASE WHEN doc_id % 3 = 0 THEN '/' || lang ELSE '' END AS package FROM documents),
s AS (SELECT DISTINCT '@' || source || '/' || lang || '/x' || (doc_id % 5) AS source FROM documents)
SELECT s.source, arg_max(package, length(package)) AS package FROM s JOIN pk ON starts_with(s.source, package || '/') GROUP BY 1""")
def workspace_longest_prefix(spark, sf):
    d = table(spark, sf, "documents")
    packages = d.select(F.concat(F.lit("@"), "source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), "lang")).otherwise("")).alias("package")).distinct()
    wanted = d.select(F.concat(F.lit("@"), "source", F.lit("/"), "lang", F.lit("/x"), (F.col("doc_id") % 5).cast("string")).alias("source")).distinct()
    parts = F.split("source", "/")
    pre = wanted.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("package"))
    return pre.join(packages, "package").groupBy("source").agg(F.max_by("package", F.length("package")).alias("package"))


@query(f"WITH {GRAPH_SQL} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def symbol_graph_nodes(spark, sf):
    e = keys_graph(spark, sf)
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


@query(f"WITH {GRAPH_SQL}, v AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey FROM region) SELECT * FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def symbol_graph_edges(spark, sf):
    v = (
        table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
        .unionByName(table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
        .unionByName(table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id")))
    )
    return graph.known_edges(keys_graph(spark, sf), v)


@query("""WITH a AS (SELECT user_id AS file, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS scope, 'v' || (event_id % 6) AS variable, 'p' || (event_id % 5) AS callee FROM events),
c AS (SELECT user_id AS file, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS scope, 'p' || (event_id % 4) AS callee, unnest(['v' || (event_id % 6), 'v' || (event_id % 10)]) AS argument, event_id AS line FROM events)
SELECT a.file, a.scope, a.callee AS producer, c.callee AS consumer, a.variable AS via, c.line FROM a JOIN c ON a.file = c.file AND a.scope IS NOT DISTINCT FROM c.scope AND a.variable = c.argument AND a.callee <> c.callee""")
def data_flow_edges(spark, sf):
    e = table(spark, sf, "events")
    mod = lambda p, k: F.concat(F.lit(p), (F.col("event_id") % k).cast("string"))
    a = e.select(F.col("user_id").alias("file"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("scope"),
        mod("v", 6).alias("variable"), mod("p", 5).alias("callee"))
    c = e.select(F.col("user_id").alias("file"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("scope"), mod("p", 4).alias("callee"),
        F.array(mod("v", 6), mod("v", 10)).alias("arguments"), F.col("event_id").alias("line"))
    return graph.data_flow(a, c)


@query("""WITH old AS (SELECT p_brand AS file, p_name AS name, p_type AS kind, p_size AS n FROM part WHERE p_partkey % 7 <> 0),
new AS (SELECT p_brand AS file, p_name AS name, p_type AS kind, p_size + CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END AS n FROM part WHERE p_partkey % 11 <> 0),
a AS (SELECT file, name, kind, arg_min(n + 1, start) AS n FROM (SELECT file, name, kind, n, n AS start FROM old) GROUP BY ALL), b AS (SELECT file, name, kind, arg_min(n + 1, start) AS n FROM (SELECT file, name, kind, n, n AS start FROM new) GROUP BY ALL)
SELECT coalesce(a.file, b.file) AS file, coalesce(a.name, b.name) AS name, coalesce(a.kind, b.kind) AS kind, a.n AS old_lines, b.n AS new_lines,
  CASE WHEN a.n IS NULL THEN 'Added' WHEN b.n IS NULL THEN 'Removed' ELSE 'Modified' END AS change
FROM a FULL JOIN b ON a.file = b.file AND a.name = b.name AND a.kind = b.kind WHERE a.n IS NULL OR b.n IS NULL OR a.n <> b.n""")
def symbol_diff(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), "p_partkey", "p_size")
    new_size = F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 3).otherwise(0)
    old = p.where("p_partkey % 7 <> 0").select("file", "name", "kind", F.col("p_size").alias("start_line"), (2 * F.col("p_size")).alias("end_line"))
    new = p.where("p_partkey % 11 <> 0").select("file", "name", "kind", new_size.alias("start_line"), (2 * new_size).alias("end_line"))
    return graph.symbol_diff(old, new)


@query(f"""WITH {GRAPH_SQL}, g AS (SELECT 'c' || c_custkey AS path, c_nationkey % 5 AS group_id FROM customer UNION ALL SELECT 'n' || n_nationkey, n_nationkey % 5 FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey % 5 FROM region)
SELECT a.group_id, e.src, e.dst, e.edge_type FROM edges e JOIN g a ON a.path = e.src JOIN g b ON b.path = e.dst AND a.group_id = b.group_id""")
def internal_edges(spark, sf):
    g = (
        table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), (F.col("c_nationkey") % 5).alias("group_id"))
        .unionByName(table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("path"), (F.col("n_nationkey") % 5).alias("group_id")))
        .unionByName(table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("path"), (F.col("r_regionkey") % 5).alias("group_id")))
    )
    return graph.internal_edges(keys_graph(spark, sf), g)


# --- reachability -----------------------------------------------------------------

# each part's number leads to half of it, so every part has a way to the first one; parts of size 1 are entry points
_STEPS_SQL = """step AS (SELECT 'p' || p_partkey AS src, 'p' || (p_partkey // 2) AS dst FROM part WHERE p_partkey > 1),
start AS (SELECT 'p' || p_partkey AS entry FROM part)"""


def _steps(spark, sf):
    p = table(spark, sf, "part")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    steps = p.where("p_partkey > 1").select(name(F.col("p_partkey")).alias("src"), name(F.floor(F.col("p_partkey") / 2)).alias("dst"), F.lit("Calls").alias("edge_type"))
    start = p.select(name(F.col("p_partkey")).alias("entry"), "p_size")
    return steps, start.select("entry", F.col("entry").alias("node"), "p_size")


def _walk(name: str, src: str, dst: str, cost: int, start: str = "start") -> str:
    return f"""{name}(entry, node, d) AS (SELECT entry, entry, 0::BIGINT FROM {start} UNION SELECT {name}.entry, step.{dst}, {name}.d + {cost} FROM {name} JOIN step ON step.{src} = {name}.node)"""


@query(f"WITH RECURSIVE {_STEPS_SQL}, {_walk('w', 'src', 'dst', 1)} SELECT entry, node, min(d) AS distance FROM w GROUP BY 1, 2")
def reachability_forward(spark, sf):
    steps, start = _steps(spark, sf)
    return reach.distances(steps, start)


@query(f"WITH RECURSIVE {_STEPS_SQL}, {_walk('w', 'dst', 'src', 2)} SELECT entry, node, min(d) AS distance FROM w GROUP BY 1, 2")
def reachability_reverse(spark, sf):
    steps, start = _steps(spark, sf)
    return reach.distances(steps, start, 2, True)


_MERGED_SQL = f"""{_STEPS_SQL}, one AS (SELECT 'p' || p_partkey AS entry FROM part WHERE p_size = 1), {_walk('w', 'src', 'dst', 1, 'one')}, {_walk('x', 'dst', 'src', 2, 'one')},
m AS (SELECT entry, node, min(d) AS distance FROM (SELECT * FROM w UNION ALL SELECT * FROM x) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_MERGED_SQL} SELECT * FROM m")
def reachability_merged(spark, sf):
    steps, start = _steps(spark, sf)
    return reach.reachability(steps, start.where("p_size = 1"))


@query(f"WITH RECURSIVE {_STEPS_SQL}, {_walk('w', 'src', 'dst', 1).replace('= w.node', '= w.node WHERE w.d < 10')} SELECT entry, node, min(d) AS distance FROM w GROUP BY 1, 2 HAVING min(d) > 0")
def call_chain_depth(spark, sf):
    steps, start = _steps(spark, sf)
    return reach.call_chain(steps, start)


@query(f"""WITH RECURSIVE {_MERGED_SQL}, a AS (SELECT node AS path, entry, distance, row_number() OVER (PARTITION BY node ORDER BY distance, entry) AS n FROM m)
SELECT path, entry, distance, row_number() OVER (PARTITION BY entry ORDER BY distance, path) - 1 AS flow_position FROM a WHERE n = 1""")
def assign_argmin(spark, sf):
    steps, start = _steps(spark, sf)
    near = reach.reachability(steps, start.where("p_size = 1")).select(F.lit(1).alias("diff_id"), "entry", F.col("node").alias("path"), "distance")
    return cluster.positions(cluster.assign(near)).select("path", "entry", "distance", "flow_position")


_NEAR = 0.35
_PAIRS_SQL = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {_NEAR})"""


@query(f"""WITH RECURSIVE {_PAIRS_SQL}, both_ways AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM r JOIN both_ways p ON p.a = r.node)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def components(spark, sf):
    v = table(spark, sf, "embeddings")
    e = similarity.similar_pairs(v, _NEAR).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return reach.components(e, v.select(F.col("vec_id").alias("node")))


# --- grouping ---------------------------------------------------------------------

@query(f"""WITH {FILES_SQL}, d AS (SELECT DISTINCT diff_id, path, CASE WHEN contains(path, '/') THEN {o.DIR} ELSE '.' END AS name FROM files)
SELECT diff_id, name, path, count(*) OVER (PARTITION BY diff_id, name) AS n_files FROM d""")
def directory_groups(spark, sf):
    return cluster.directory_groups(changed_files(spark, sf))


@query(f"""WITH {FILES_SQL}, d AS (SELECT DISTINCT diff_id, path, CASE WHEN contains(path, '/') THEN {o.DIR} ELSE '.' END AS name FROM files),
g AS (SELECT diff_id, name, count(*) AS n, min(path) AS first_path, min(string_split(path, '/')[1]) AS prefix FROM d GROUP BY ALL),
f AS (SELECT *, n <= 5 AND contains(first_path, '/') AS fit FROM g), b AS (SELECT *, count(*) FILTER (fit) OVER (PARTITION BY diff_id, prefix, fit) AS members FROM f),
k AS (SELECT *, CASE WHEN NOT fit THEN 'own:' || name WHEN members <= 12 THEN 'p:' || prefix ELSE 'd:' || name END AS bucket FROM b),
l AS (SELECT diff_id, name, min(name) OVER (PARTITION BY diff_id, bucket) AS merged FROM k)
SELECT d.diff_id, d.path, l.merged AS name FROM d JOIN l USING (diff_id, name)""")
def consolidate_level(spark, sf):
    d = cluster.directory_groups(changed_files(spark, sf)).select("diff_id", F.col("name").alias("grp"), "name", F.lit(False).alias("has_entry"), "path")
    return cluster.merge_level(d, 1).select("diff_id", "path", "name")


@query()
def consolidate_all(spark, sf):
    d = cluster.directory_groups(changed_files(spark, sf)).select("diff_id",
        F.dense_rank().over(Window.partitionBy("diff_id").orderBy("name")).cast("long").alias("grp"), "name", F.lit(False).alias("has_entry"), "path")
    return cluster.consolidate(d).select("diff_id", "grp", "name", "path")


_SPLIT_SQL = f"""{FILES_SQL}, u AS (SELECT DISTINCT diff_id, path FROM files),
gr AS (SELECT diff_id, path, CAST(length(path) % 7 AS BIGINT) AS group_id FROM u WHERE length(path) % 3 <> 0), loose AS (SELECT diff_id, path FROM u WHERE length(path) % 3 = 0)"""


def _split(spark, sf):
    u = changed_files(spark, sf).select("diff_id", "path").distinct().withColumn("n", F.char_length("path"))
    return u.where("n % 3 = 0").select("diff_id", "path"), u.where("n % 3 <> 0").select("diff_id", "path", (F.col("n") % 7).cast("long").alias("group_id"))


@query(f"""WITH {_SPLIT_SQL}, pa AS (SELECT diff_id, path, unnest(range(2, len(string_split(path, '/')))) AS depth FROM loose), pb AS (SELECT diff_id, group_id, path, unnest(range(2, len(string_split(path, '/')))) AS depth FROM gr),
xa AS (SELECT *, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS prefix FROM pa), xb AS (SELECT diff_id, depth, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS prefix, min(group_id) AS group_id FROM pb GROUP BY ALL)
SELECT diff_id, path, arg_max(group_id, depth) AS group_id, CAST(max(depth) AS INT) AS shared FROM xa JOIN xb USING (diff_id, depth, prefix) GROUP BY 1, 2""")
def nearest_directory(spark, sf):
    return cluster.nearest_directory(*_split(spark, sf))


@query(f"""WITH {_SPLIT_SQL}, ta AS (SELECT diff_id, path, unnest({o.TOPICS}) AS token FROM loose), tb AS (SELECT diff_id, group_id, path AS other, unnest({o.TOPICS}) AS token FROM gr),
n AS (SELECT ta.diff_id, ta.path, group_id, other, count(*) AS n FROM ta JOIN tb USING (diff_id, token) GROUP BY ALL), g AS (SELECT diff_id, path, group_id, max(n) AS n FROM n GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY diff_id, path ORDER BY n DESC) AS rk FROM g)
SELECT diff_id, path, min(group_id) AS group_id, max(n) AS overlap FROM r WHERE rk = 1 GROUP BY 1, 2 HAVING max(n) >= 2 OR count(*) = 1""")
def topic_affinity(spark, sf):
    return cluster.topic_affinity(*_split(spark, sf))


@query(f"""WITH {_SPLIT_SQL}, s AS (SELECT *, {o.TEST_FILE} AS is_test, {o.IMPL} AS stem, {o.BARE} AS bare FROM gr),
st AS (SELECT diff_id, stem, arg_max(group_id, path) AS g FROM s WHERE NOT is_test GROUP BY ALL), ba AS (SELECT diff_id, bare, arg_max(group_id, path) AS g FROM s WHERE NOT is_test AND bare <> '' GROUP BY ALL)
SELECT s.diff_id, path, is_test, CASE WHEN is_test THEN coalesce(st.g, ba.g, group_id) ELSE group_id END AS group_id FROM s LEFT JOIN st USING (diff_id, stem) LEFT JOIN ba ON ba.diff_id = s.diff_id AND ba.bare = s.bare""")
def test_pairs(spark, sf):
    return cluster.move_tests(_split(spark, sf)[1])


@query(f"""WITH {FILES_SQL}, f AS (SELECT DISTINCT diff_id, path, {o.CATEGORY} AS category, CASE WHEN contains(path, '/') THEN {o.DIR} ELSE '.' END AS dir FROM files),
c AS (SELECT *, count(*) FILTER (category = 'Unclassified') OVER (PARTITION BY diff_id, dir) AS n FROM f)
SELECT diff_id, path, CASE WHEN category = 'Unclassified' AND n >= 2 THEN 'DirectoryGroup' ELSE category END AS category,
  CASE WHEN category = 'Unclassified' AND n >= 2 THEN dir ELSE CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.CATEGORY_TITLES.items())} END END AS sub_group FROM c""")
def infra_groups(spark, sf):
    return cluster.infra_groups(changed_files(spark, sf))


@query(f"""WITH {_SPLIT_SQL}, d AS (SELECT diff_id, CASE WHEN contains(path, '/') THEN {o.DIR} ELSE '.' END AS dir, group_id, count(*) AS n FROM gr GROUP BY ALL),
t AS (SELECT *, rank() OVER (PARTITION BY diff_id, dir ORDER BY n DESC) AS rk FROM d), one AS (SELECT diff_id, dir, min(group_id) AS group_id FROM t WHERE rk = 1 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT l.diff_id, l.path, one.group_id FROM (SELECT *, CASE WHEN contains(path, '/') THEN {o.DIR} ELSE '.' END AS dir FROM loose) l JOIN one ON one.diff_id = l.diff_id AND one.dir = l.dir""")
def exact_directory(spark, sf):
    return cluster.exact_directory(*_split(spark, sf))


@query()
def rescue_cascade(spark, sf):
    return cluster.rescue(*_split(spark, sf))


@query()
def stem_merges(spark, sf):
    return cluster.merge_by_stem(_split(spark, sf)[1])


# a file for each user whose functions are the types of the user's events; what the rules find follows from the path alone
@query("""WITH f AS (SELECT DISTINCT user_id, event_type FROM events), p AS (SELECT user_id, event_type, CASE user_id % 4 WHEN 0 THEN 'app/src/routes/u' || user_id || '.ts' WHEN 1 THEN 'tools/u' || user_id || '.go' WHEN 2 THEN 'tests/test_u' || user_id || '.py' ELSE 'web/pages/u' || user_id || '.tsx' END AS file FROM f)
SELECT file, event_type AS symbol, 'HttpRoute' AS entrypoint_type FROM p WHERE user_id % 4 = 0 UNION ALL SELECT DISTINCT file, 'main', 'CliCommand' FROM p WHERE user_id % 4 = 1
UNION ALL SELECT file, 'test_' || event_type, 'TestFile' FROM p WHERE user_id % 4 = 2 UNION ALL SELECT DISTINCT file, 'Page', 'HttpRoute' FROM p WHERE user_id % 4 = 3""")
def entrypoints_dedup(spark, sf):
    from ..operators import entrypoints

    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("names"))
    kind, u = F.col("user_id") % 4, F.col("user_id").cast("string")
    path = F.when(kind == 0, F.concat(F.lit("app/src/routes/u"), u, F.lit(".ts"))).when(kind == 1, F.concat(F.lit("tools/u"), u, F.lit(".go"))).when(
        kind == 2, F.concat(F.lit("tests/test_u"), u, F.lit(".py"))).otherwise(F.concat(F.lit("web/pages/u"), u, F.lit(".tsx")))
    named = F.transform("names", lambda n: F.when(kind == 1, F.lit("main")).when(kind == 2, F.concat(F.lit("test_"), n)).otherwise(n))
    line = F.lit(1).alias("line")
    none = F.lit(None).cast("string")
    facts = e.select(
        path.alias("path"), paths.language(path).alias("language"),
        F.transform(named, lambda n: F.struct(n.alias("name"), F.lit("Function").alias("kind"), F.lit(1).alias("start_line"),
            F.lit(2).alias("end_line"))).alias("definitions"),
        F.array().cast("array<struct<source:string,names:array<struct<name:string,alias:string>>,is_default:boolean,is_namespace:boolean,line:int>>").alias("imports"),
        F.when(kind == 3, F.array(F.struct(F.lit("Page").alias("name"), F.lit(True).alias("is_default"), F.lit(False).alias("is_reexport"), none.alias("source"), line)))
        .otherwise(F.array().cast("array<struct<name:string,is_default:boolean,is_reexport:boolean,source:string,line:int>>")).alias("exports"),
        F.array().cast("array<struct<callee:string,line:int,containing_function:string,arguments:array<string>>>").alias("call_sites"))
    # pages are judged by their default export; their functions are no entry points
    return entrypoints.detect(facts)


_IMPORTS = ("express", "next/router", "nextcloud", "org.springframework.web.bind", "org.springframework", "Illuminate\\Http\\Request",
    "github.com/gin-gonic/gin", "actix_web::App", "react-domain", "@effect/platform", "django.db", "Microsoft.AspNetCore.Mvc")


# every document imports three of these; a pattern is the whole source, or goes on with a separator
@query(f"""WITH dict(pattern, name) AS (VALUES {', '.join('(' + o.q(a) + ', ' + o.q(b) + ')' for a, b in call_rules.FRAMEWORKS)}), s(i, source) AS (VALUES {', '.join(f'({i}, {o.q(x)})' for i, x in enumerate(_IMPORTS))}),
d AS (SELECT DISTINCT source AS target, (doc_id * m) % {len(_IMPORTS)} AS i FROM documents, (VALUES (1), (2), (5)) k(m) WHERE lang <> 'es' OR doc_id % {len(_IMPORTS)} < 3)
SELECT DISTINCT target, name FROM d JOIN s USING (i) JOIN dict ON s.source = pattern OR (starts_with(s.source, pattern) AND substr(s.source, length(pattern) + 1, 1) IN ('/', '.', ':', chr(92)))""")
def frameworks(spark, sf):
    names = F.array(*[F.lit(x) for x in _IMPORTS])
    d = table(spark, sf, "documents").where((F.col("lang") != "es") | (F.col("doc_id") % len(_IMPORTS) < 3))
    d = d.select(F.col("source").alias("target"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("m"), "doc_id")
    i = d.select("target", F.get(names, (F.col("doc_id") * F.col("m") % len(_IMPORTS)).cast("int")).alias("source")).distinct()
    return call_rules.frameworks(i, spark.createDataFrame(call_rules.FRAMEWORKS, "pattern string, name string"))


@query(f"""WITH {FILES_SQL}, f AS (SELECT diff_id AS target, path, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 4 END AS group_id FROM files),
x(exp_id, needle, must) AS (VALUES (1, 'service', TRUE), (1, 'route', TRUE), (1, '.md', FALSE), (2, 'test', TRUE), (2, 'config', FALSE)),
t AS (SELECT exp_id, count(*) FILTER (must) AS want, count(*) FILTER (NOT must) AS avoid FROM x GROUP BY 1), h AS (SELECT DISTINCT target, exp_id, group_id, needle, must FROM f JOIN x ON contains(path, needle)),
p AS (SELECT target, exp_id, group_id, count(*) FILTER (must) AS have, count(*) FILTER (NOT must) AS bad FROM h GROUP BY ALL),
b AS (SELECT target, exp_id, max(greatest(0, have::DOUBLE / want - 0.5 * bad / avoid)) FILTER (group_id IS NOT NULL) AS best, max(have) FILTER (group_id IS NULL AND have > 0) AS leaked FROM p JOIN t USING (exp_id) GROUP BY 1, 2),
j AS (SELECT tg.target, t.exp_id, want, coalesce(best, 0) AS v, leaked FROM (SELECT DISTINCT target FROM f) tg CROSS JOIN t LEFT JOIN b ON b.target = tg.target AND b.exp_id = t.exp_id)
SELECT target, round(CAST(sum(CASE WHEN leaked IS NULL THEN v ELSE least(v, 1 - leaked::DOUBLE / want) END * want) / sum(want) AS DOUBLE), 6) AS coherence FROM j GROUP BY 1""")
def group_coherence(spark, sf):
    f = changed_files(spark, sf).select(F.col("diff_id").alias("target"), "path", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 4).alias("group_id"))
    x = F.array(*[F.struct(F.lit(e).alias("exp_id"), F.lit(n).alias("needle"), F.lit(m).alias("must")) for e, n,
        m in ((1, "service", True), (1, "route", True), (1, ".md", False), (2, "test", True), (2, "config", False))])
    return evaluate.coherence(f, f.select("target").distinct().select("target", F.inline(x)))


@query("""WITH o AS (SELECT n_regionkey AS target, n_name AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS ro FROM nation),
c AS (SELECT a.n_regionkey AS target, a.n_nationkey AS c_id, a.n_name AS higher, b.n_name AS lower FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 3) % 25)
SELECT c.target, round(avg(CASE WHEN h.ro IS NULL THEN 0.0 WHEN l.ro IS NULL OR h.ro <= l.ro THEN 1.0 ELSE 0.0 END), 6) AS ordering FROM c LEFT JOIN o h ON h.target = c.target AND h.path = higher LEFT JOIN o l ON l.target = c.target AND l.path = lower GROUP BY 1""")
def review_ordering(spark, sf):
    n = table(spark, sf, "nation")
    orders = n.select(F.col("n_regionkey").alias("target"), F.col("n_name").alias("path"),
        F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("n_nationkey"))).alias("review_order"))
    other = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("lower"))
    c = n.withColumn("k", F.col("n_nationkey") * 3 % 25).join(other, "k").select(F.col("n_regionkey").alias("target"),
        F.col("n_nationkey").alias("c_id"), F.col("n_name").alias("higher"), "lower")
    return evaluate.review_ordering(orders, c)


@query("""WITH r AS (SELECT p_partkey AS k, (p_partkey // 3) % 25 AS diff_id, 'src/routes/r' || p_partkey || '.ts' AS path FROM part WHERE p_partkey % 3 = 0),
g AS (SELECT *, 'group_' || row_number() OVER (PARTITION BY diff_id ORDER BY path) AS group_id FROM r)
SELECT diff_id, group_id, FALSE AS has_schema, TRUE AS has_api, FALSE AS has_auth, FALSE AS test_only, 0 AS additions, 0 AS deletions, 1 + (SELECT count(*) FROM part p WHERE p.p_partkey = k + 1) AS n_files,
  0.25::DOUBLE AS risk, 0.5::DOUBLE AS centrality, 0.0::DOUBLE AS surface_area, 0.5::DOUBLE AS uncertainty, 0.3125::DOUBLE AS score, row_number() OVER (PARTITION BY diff_id ORDER BY group_id) AS review_order,
  'f' || k || ' (r' || k || ') route' AS name FROM g""")
def analyze(spark, sf):
    """The engine from sources to ranked groups, 25 changes: every third part is a route that calls the next one's service; the third is a workflow."""
    from ..engine import Engine

    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size")
    k, after, kind = F.col("k").cast("string"), (F.col("k") + 1).cast("string"), F.col("k") % 3
    path = F.when(kind == 0, F.concat(F.lit("src/routes/r"), k, F.lit(".ts"))).when(kind == 1,
        F.concat(F.lit("src/services/s"), k, F.lit(".ts"))).otherwise(F.concat(F.lit(".github/workflows/w"), k, F.lit(".yml")))
    route = F.concat(F.lit("import { f"), after, F.lit(" } from '../services/s"), after, F.lit("';\n\nexport function f"), k,
        F.lit("(a: string) {\n  return f"), after, F.lit("(a);\n}\n"))
    service = F.concat(F.lit("export function f"), k, F.lit("(a: string) {\n  return a;\n}\n"))
    body = F.when(kind == 0, route).when(kind == 1, service).otherwise("on: push\n")
    none = F.lit(None).cast("string")
    changes = p.select((F.floor(F.col("k") / 3) % 25).alias("diff_id"), none.alias("old_path"), path.alias("new_path"), none.alias("old_content"),
        body.alias("new_content"),
                       F.col("p_size").cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions"))
    return Engine().tables(changes)["groups"]


# --- similarity -------------------------------------------------------------------

@query(f"WITH {_PAIRS_SQL} SELECT a, b, round(s, 4) AS similarity FROM pairs")
def similar_pairs(spark, sf):
    return similarity.similar_pairs(table(spark, sf, "embeddings"), _NEAR).withColumn("similarity", F.round("similarity", 4))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 4) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, 1, 2 LIMIT 20""")
def pairwise_topk(spark, sf):
    return similarity.nearest_pairs(table(spark, sf, "embeddings"), 20).withColumn("similarity", F.round("similarity", 4))


@query("SELECT label AS grp, CAST(pos - 1 AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def centroids(spark, sf):
    return similarity.centroids(table(spark, sf, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


@query()
def greedy_merge(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("diff_id"), F.floor(F.col("vec_id") / 3).alias("grp"), "embedding")
    return similarity.greedy_merge(v, _NEAR)


# --- text -------------------------------------------------------------------------

@query("""WITH n AS (SELECT doc_id, text, CASE WHEN strlen(text) <= 4000 THEN NULL ELSE list_max(list_filter(range(0, 4001), lambda k: strlen(substr(text, 1, k)) <= 4000)) END AS n FROM documents),
h AS (SELECT doc_id, text, n, substr(text, 1, CAST(n AS INT)) AS head FROM n)
SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, sha256(CASE WHEN n IS NULL THEN text ELSE CASE WHEN contains(head, chr(10)) THEN regexp_extract(head, '^(.*)\n[^\n]*$', 1, 's') ELSE head END
  || chr(10) || chr(10) || '... [truncated: input exceeded 1000 token budget]' END) AS cut_sha256 FROM h""")
def token_budget(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.estimate_tokens("text").alias("tokens"), F.sha2(text.truncate("text", 1000), 256).alias("cut_sha256"))


def _redacted_sql(i: int, prefix: str, name: str) -> str:
    """One prefix: what stands before the first token too short for a key is replaced, the rest stays."""
    rest = text.KEY_LETTERS - len(prefix)
    word = r"[\p{L}\p{N}_-]"
    return f"""h{i} AS (SELECT doc_id, x, regexp_matches(x, '{prefix}{word}{{0,{rest - 1}}}([^\\p{{L}}\\p{{N}}_-]|$)') AS has, regexp_extract(x, '^(.*?){prefix}{word}{{0,{rest - 1}}}([^\\p{{L}}\\p{{N}}_-].*)?$', 1, 's') AS head FROM t{i}),
t{i + 1} AS (SELECT doc_id, regexp_replace(CASE WHEN has THEN head ELSE x END, '{prefix}{word}{{{rest},}}', '{name}', 'g') || CASE WHEN has THEN substr(x, length(head) + 1) ELSE '' END AS x FROM h{i})""".replace("\\\\", "\\")


_LEADS = ("key sk-ant-abcdef12345 and ", "sk-proj-ABCdef_99 sk-short sk-later-than-that ", "AIzaSyA1234567 ", "")


@query(f"""WITH w AS (SELECT doc_id, CASE doc_id % 4 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LEADS))} END || text AS x FROM documents),
b AS (SELECT doc_id, x, CASE WHEN strlen(x) <= 500 THEN length(x) ELSE list_max(list_filter(range(0, 501), lambda k: strlen(substr(x, 1, k)) <= 500)) END AS n FROM w),
t0 AS (SELECT doc_id, substr(x, 1, CAST(n AS INT)) AS x FROM b), {', '.join(_redacted_sql(i, p, n) for i, (p, n) in enumerate(text.KEY_PREFIXES))}
SELECT doc_id, x AS redacted FROM t{len(text.KEY_PREFIXES)}""")
def redaction(spark, sf):
    lead = F.get(F.array(*[F.lit(x) for x in _LEADS]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf, "documents").select("doc_id", text.redact(F.concat(lead, "text")).alias("redacted"))


@query(r"""WITH p AS (SELECT a.doc_id, string_split(regexp_replace(a.text, '\n$', ''), chr(10)) AS old, string_split(regexp_replace(b.text, '\n$', ''), chr(10)) AS new FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, array_to_string(list_filter(new, lambda x: NOT list_contains(old, x)), chr(10)) AS added, CAST(len(list_filter(old, lambda x: NOT list_contains(new, x))) AS BIGINT) AS removed FROM p""")
def line_diff(spark, sf):
    d = table(spark, sf, "documents")
    j = d.select("doc_id", F.col("text").alias("old")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new")), "doc_id")
    out = text.line_diff("old", "new")
    return j.select("doc_id", F.array_join(out["added"], "\n").alias("added"), out["removed"].alias("removed"))


@query("SELECT n_regionkey AS diff_id, sha256(coalesce(NULL, 'none') || chr(10) || min(n_name) || chr(10) || string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS cache_key FROM nation GROUP BY 1")
def cache_key(spark, sf):
    from ..sources.caches import cache_key as key

    n = table(spark, sf, "nation")
    return n.groupBy(F.col("n_regionkey").alias("diff_id")).agg(key(F.lit(None).cast("string"), F.min("n_name"), "n_name").alias("cache_key"))


# --- refinement -------------------------------------------------------------------

_GROUPS_SQL = "gf AS (SELECT 'group_' || (c_nationkey % 9) AS group_id, 'f' || c_custkey AS path, c_custkey FROM customer)"


def _group_files(spark, sf):
    return table(spark, sf, "customer").select(F.concat(F.lit("group_"), (F.col("c_nationkey") % 9).cast("string")).alias("group_id"),
        F.concat(F.lit("f"), "c_custkey").alias("path"), "c_custkey")


@query(f"""WITH {_GROUPS_SQL}, mv AS (SELECT c_custkey AS ord, path, CASE WHEN c_custkey % 2 = 0 THEN group_id ELSE 'group_0' END AS from_group, 'group_' || (c_custkey % 4) AS to_group FROM gf WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey + 1000000, path, group_id, 'infra' FROM gf WHERE c_custkey % 15 = 0),
l AS (SELECT path, from_group, arg_max(to_group, ord) AS to_group FROM mv GROUP BY 1, 2)
SELECT coalesce(l.to_group, gf.group_id) AS group_id, gf.path FROM gf LEFT JOIN l ON l.path = gf.path AND l.from_group = gf.group_id""")
def refine_reclassify(spark, sf):
    g = _group_files(spark, sf)
    own = F.when(F.col("c_custkey") % 2 == 0, F.col("group_id")).otherwise("group_0")
    moves = g.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("ord"), "path", own.alias("from_group"),
        F.concat(F.lit("group_"), (F.col("c_custkey") % 4).cast("string")).alias("to_group")).unionByName(
        g.where("c_custkey % 15 = 0").select((F.col("c_custkey") + 1000000).alias("ord"), "path", F.col("group_id").alias("from_group"),
            F.lit("infra").alias("to_group")))
    return refine.reclassify(g.select("group_id", "path"), moves)


@query(f"""WITH {_GROUPS_SQL}, sp AS (SELECT group_id AS source, c_custkey % 2 + CASE group_id WHEN 'group_1' THEN 0 ELSE 2 END AS new_ord, path FROM gf WHERE group_id = 'group_1' OR (group_id = 'group_2' AND c_custkey % 10 <> 3)),
bad AS (SELECT DISTINCT gf.group_id FROM gf JOIN (SELECT DISTINCT source FROM sp) s ON s.source = gf.group_id LEFT JOIN sp ON sp.source = gf.group_id AND sp.path = gf.path WHERE sp.path IS NULL)
SELECT CASE WHEN sp.path IS NOT NULL AND gf.group_id NOT IN (SELECT group_id FROM bad) THEN 'group_refined_' || sp.new_ord ELSE gf.group_id END AS group_id, gf.path FROM gf LEFT JOIN sp ON sp.source = gf.group_id AND sp.path = gf.path""")
def refine_split(spark, sf):
    g = _group_files(spark, sf)
    sp = g.where("group_id = 'group_1' or (group_id = 'group_2' and c_custkey % 10 <> 3)").select(
        F.col("group_id").alias("source"), (F.col("c_custkey") % 2 + F.when(F.col("group_id") == "group_1", 0).otherwise(2)).alias("new_ord"), "path")
    return refine.split(g.select("group_id", "path"), sp)


_MERGES = ((1, 0, "group_3"), (1, 1, "group_5"), (2, 0, "group_7"), (2, 1, "group_1"), (2, 2, "group_2"))


@query(f"""WITH {_GROUPS_SQL}, m(merge_ord, pos, group_id) AS (VALUES {', '.join(map(str, _MERGES))}), t AS (SELECT group_id, first_value(group_id) OVER (PARTITION BY merge_ord ORDER BY pos) AS into_id FROM m)
SELECT coalesce(into_id, gf.group_id) AS group_id, path FROM gf LEFT JOIN t ON t.group_id = gf.group_id""")
def refine_merge(spark, sf):
    return refine.merge(_group_files(spark, sf).select("group_id", "path"), spark.createDataFrame(_MERGES, "merge_ord int, pos int, group_id string"))


@query("""WITH g AS (SELECT n_regionkey AS diff_id, 'group_' || n_nationkey AS group_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS ro FROM nation), r AS (SELECT 'group_' || n_nationkey AS group_id, 1 AS p FROM nation WHERE n_nationkey % 4 = 3)
SELECT diff_id, g.group_id, row_number() OVER (PARTITION BY diff_id ORDER BY coalesce(p, ro), g.group_id) AS review_order FROM g LEFT JOIN r ON r.group_id = g.group_id""")
def refine_rerank(spark, sf):
    n = table(spark, sf, "nation").withColumn("group_id", F.concat(F.lit("group_"), "n_nationkey"))
    g = n.select(F.col("n_regionkey").alias("diff_id"), "group_id",
        F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).cast("long").alias("review_order"))
    return refine.rerank(g, n.where("n_nationkey % 4 = 3").select("group_id", F.lit(1).cast("long").alias("new_position")))


@query("""WITH g AS (SELECT 'group_' || n_nationkey AS group_id, n_name AS name FROM nation), op AS (SELECT s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'group_' || s_nationkey WHEN 1 THEN (SELECT '  ' || lower(n_name) FROM nation WHERE n_nationkey = s_nationkey) ELSE 'group_' || (s_nationkey + 20) END AS group_id FROM supplier),
rp AS (SELECT ord, coalesce(a.group_id, b.group_id, op.group_id) AS group_id, a.group_id IS NULL AND b.group_id IS NOT NULL AS repaired FROM op LEFT JOIN g a ON a.group_id = op.group_id LEFT JOIN g b ON lower(trim(b.name)) = lower(trim(op.group_id)))
SELECT ord, group_id, repaired, CASE WHEN group_id IN (SELECT group_id FROM g) THEN NULL ELSE 'unknown group' END AS reason FROM rp""")
def refine_sanitize_warnings(spark, sf):
    n = table(spark, sf, "nation")
    g = n.select(F.concat(F.lit("group_"), "n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    s = table(spark, sf, "supplier").join(n.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 3
    gid = F.when(k == 0, F.concat(F.lit("group_"), "s_nationkey")).when(k == 1,
        F.concat(F.lit("  "), F.lower("n_name"))).otherwise(F.concat(F.lit("group_"), (F.col("s_nationkey") + 20).cast("string")))
    fixed = refine.repair_ids(s.select(F.col("s_suppkey").alias("ord"), gid.alias("group_id")), g)
    bad = refine.unknown_groups(fixed, g).select("ord", "reason")
    return fixed.join(bad, "ord", "left").select("ord", "group_id", "repaired", "reason")


@query("""WITH m AS (SELECT o_orderpriority AS "group", 'f' || o_custkey AS path FROM orders), k AS (SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'Handler' ELSE 'Utility' END AS role, (c_custkey % 10) / 10.0 AS risk FROM customer WHERE c_custkey % 3 <> 0)
SELECT "group", count(*) AS n_files, count(role) AS n_known, count(*) FILTER (coalesce(role, 'Utility') = 'Utility') AS n_utility, round(CAST(sum(coalesce(risk, 0)) AS DOUBLE) / count(*), 6) AS risk FROM m LEFT JOIN k USING (path) GROUP BY 1""")
def manifest_import(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("group"), F.concat(F.lit("f"), "o_custkey").alias("path"))
    k = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("f"), "c_custkey").alias("path"),
        F.when(F.col("c_custkey") % 2 == 0, "Handler").otherwise("Utility").alias("role"), ((F.col("c_custkey") % 10) / 10).alias("risk"))
    return refine.import_manifest(m, k)


# --- evaluation -------------------------------------------------------------------

_METRICS_SQL = """e AS (SELECT label AS target, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 37 END AS group_id, vec_id AS path FROM embeddings),
p AS (SELECT target, group_id, count(*) AS n FROM e GROUP BY ALL),
mt AS (SELECT target, CAST(sum(n) AS BIGINT) AS total_files, count(group_id) AS total_groups, CAST(coalesce(sum(n) FILTER (group_id IS NULL), 0) AS BIGINT) AS infra_files, count(*) FILTER (group_id IS NOT NULL AND n = 1) AS singleton_groups,
  coalesce(max(n) FILTER (group_id IS NOT NULL), 0) AS max_group_size, coalesce(sum(n) FILTER (group_id IS NOT NULL), 0) AS grouped FROM p GROUP BY target),
mm AS (SELECT target, total_files, total_groups, infra_files, singleton_groups, max_group_size, CASE WHEN total_groups = 0 THEN 0 ELSE grouped::DOUBLE / total_groups END AS avg_group_size, infra_files::DOUBLE / total_files AS infra_ratio,
  CASE WHEN total_groups = 0 THEN 0 ELSE singleton_groups::DOUBLE / total_groups END AS singleton_ratio, total_groups::DOUBLE / total_files * 1000 AS groups_per_1000_files, TRUE AS files_accounted FROM mt)"""


def _metric_files(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").alias("target"),
        F.when(F.col("vec_id") % 4 != 0, F.col("vec_id") % 37).alias("group_id"), F.col("vec_id").alias("path"))


@query(f"WITH {_METRICS_SQL} SELECT * FROM mm")
def repo_metrics(spark, sf):
    return evaluate.metrics(_metric_files(spark, sf))


@query(f"""WITH {_METRICS_SQL}, s AS (SELECT target, CASE WHEN total_groups <= 20 THEN 1.0 ELSE greatest(0, least(1, 20.0 / total_groups)) END::DOUBLE AS gc, CASE WHEN infra_ratio <= 0.2 THEN 1.0 ELSE greatest(0, least(1, 1 - (infra_ratio - 0.2) / 0.8)) END::DOUBLE AS i,
  CASE WHEN singleton_ratio <= 0.3 THEN 1.0 ELSE greatest(0, least(1, 1 - (singleton_ratio - 0.3) / 0.7)) END::DOUBLE AS sg, CASE WHEN groups_per_1000_files <= 400 THEN 1.0 ELSE 0.0 END::DOUBLE AS dn FROM mm)
SELECT target, round(gc, 6) AS group_count_score, round(i, 6) AS infra_score, round(sg, 6) AS singleton_score, 1.0::DOUBLE AS accounting_score, dn AS density_score, round(0.2 * gc + 0.2 * dn + 0.2 * i + 0.2 * sg + 0.2, 6) AS overall FROM s""")
def repo_scores(spark, sf):
    m = evaluate.metrics(_metric_files(spark, sf))
    limits = {"max_groups": 20, "max_infra_ratio": 0.2, "max_singleton_ratio": 0.3, "max_groups_per_1000_files": 400}
    return evaluate.score(m, limits).select("target", "group_count_score", "infra_score", "singleton_score", "accounting_score", "density_score", "overall")


@query("""WITH loc AS (SELECT doc_id AS path, quality * 2 + toxic AS place FROM labels), c AS (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS check_id, CASE WHEN floor(doc_id / 5) % 2 = 0 THEN 'same' ELSE 'separate' END AS kind, doc_id AS path FROM documents)
SELECT check_id, kind, count(*) AS members, count(*) FILTER (place IS NULL) AS missing, count(DISTINCT place) AS places, count(*) FILTER (place IS NULL) = 0 AND CASE WHEN kind = 'same' THEN count(DISTINCT place) = 1 ELSE count(DISTINCT place) = count(*) END AS satisfied FROM c LEFT JOIN loc USING (path) GROUP BY 1, 2""")
def golden_checks(spark, sf):
    loc = table(spark, sf, "labels").select(F.col("doc_id").alias("path"), (F.col("quality") * 2 + F.col("toxic")).alias("place"))
    k = F.floor(F.col("doc_id") / 5)
    c = table(spark, sf, "documents").select(k.alias("check_id"), F.when(k % 2 == 0, "same").otherwise("separate").alias("kind"), F.col("doc_id").alias("path"))
    return evaluate.golden_checks(loc, c)


# a target for each change; each of the five scorers over its files, then the weighted mean
_SCORES_SQL = f"""{FILES_SQL}, u AS (SELECT DISTINCT diff_id AS target, path FROM files), t AS (SELECT DISTINCT target FROM u),
e AS (SELECT DISTINCT diff_id AS target, path AS file, CASE doc_id % 3 WHEN 0 THEN 'HttpRoute' WHEN 1 THEN 'CliCommand' ELSE 'TestFile' END AS type FROM files),
ex(exp_id, part, type) AS (VALUES (1, 'routes', 'HttpRoute'), (2, 'main', 'CliCommand'), (3, 'test', 'TestFile')),
s1 AS (SELECT target, avg(CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.target = t.target AND e.type = ex.type AND contains(e.file, ex.part)) THEN 1.0 ELSE 0.0 END) AS entrypoints FROM t CROSS JOIN ex GROUP BY 1),
o AS (SELECT target, path, row_number() OVER (PARTITION BY target ORDER BY path DESC) AS ro FROM u), c(higher, lower) AS (VALUES ('README.md', 'Makefile'), ('CHANGELOG.md', 'README.md'), ('Dockerfile', 'src/none.ts')),
s2 AS (SELECT t.target, avg(CASE WHEN h.ro IS NULL THEN 0.0 WHEN l.ro IS NULL OR h.ro <= l.ro THEN 1.0 ELSE 0.0 END) AS ordering FROM t CROSS JOIN c LEFT JOIN o h ON h.target = t.target AND h.path = higher LEFT JOIN o l ON l.target = t.target AND l.path = lower GROUP BY 1),
g AS (SELECT diff_id AS target, length(path) % 4 AS group_id, avg(additions) / 50 AS risk, count(*) AS n FROM files GROUP BY 1, 2), gr AS (SELECT *, CASE WHEN group_id = 3 THEN 0 ELSE group_id + 1 END AS ro FROM g),
s3 AS (SELECT target, greatest(0, 1 - 0.25 * sum(CAST(risk < 0 OR risk > 1 AS INT) + CAST(ro < 1 AS INT)) - CASE WHEN count(DISTINCT ro) < count(*) THEN 0.1 ELSE 0 END) AS risk FROM gr GROUP BY 1),
la AS (SELECT DISTINCT target, {o.LANGUAGE} AS language FROM u), le(language) AS (VALUES ('TypeScript'), ('Python'), ('Go'), ('Ruby')),
s4 AS (SELECT t.target, avg(CASE WHEN la.language IS NULL THEN 0.0 ELSE 1.0 END) AS languages FROM t CROSS JOIN le LEFT JOIN la ON la.target = t.target AND la.language = le.language GROUP BY 1),
f AS (SELECT diff_id AS target, path, doc_id % 4 AS group_id FROM files), x(needle) AS (VALUES ('service'), ('route')), h AS (SELECT target, group_id, count(DISTINCT needle) AS have FROM f JOIN x ON contains(path, needle) GROUP BY ALL),
s5 AS (SELECT t.target, coalesce(max(have), 0) / 2.0 AS coherence FROM t LEFT JOIN h USING (target) GROUP BY 1)"""


@query(f"""WITH {_SCORES_SQL} SELECT target, round(CAST(0.25 * round(coherence, 6) + 0.2 * round(entrypoints, 6) + 0.15 * round(ordering, 6) + 0.15 * round(risk, 6) + 0.15 * round(languages, 6) + 0.1 AS DOUBLE), 6) AS overall
FROM s1 JOIN s2 USING (target) JOIN s3 USING (target) JOIN s4 USING (target) JOIN s5 USING (target)""")
def eval_scores(spark, sf):
    files = materialize(changed_files(spark, sf).withColumnRenamed("diff_id", "target"))
    u = files.select("target", "path").distinct()
    targets = u.select("target").distinct()

    def each(*values, names):
        return targets.select("target", F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(v, names)]) for v in values])))

    kind = F.when(F.col("doc_id") % 3 == 0, "HttpRoute").when(F.col("doc_id") % 3 == 1, "CliCommand").otherwise("TestFile")
    s = evaluate.entrypoint_accuracy(files.select("target", F.col("path").alias("file"), kind.alias("type")),
        each((1, "routes", "HttpRoute"), (2, "main", "CliCommand"), (3, "test", "TestFile"), names=("exp_id", "file_contains", "type")))
    orders = u.withColumn("review_order", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("path"))))
    s = s.join(evaluate.review_ordering(orders, each((1, "README.md", "Makefile"), (2, "CHANGELOG.md", "README.md"), (3, "Dockerfile", "src/none.ts"),
        names=("c_id", "higher", "lower"))), "target")
    g = files.groupBy("target", (F.char_length("path") % 4).alias("group_id")).agg((F.avg("additions") / 50).alias("risk"), F.count("*").alias("n_files"))
    s = s.join(evaluate.risk_reasonableness(g.withColumn("review_order", F.when(F.col("group_id") == 3, 0).otherwise(F.col("group_id") + 1))), "target")
    s = s.join(evaluate.language_recall(u.select("target", paths.language("path").alias("language")),
        each(("TypeScript",), ("Python",), ("Go",), ("Ruby",), names=("language",))), "target")
    grouped = files.select("target", "path", (F.col("doc_id") % 4).alias("group_id"))
    s = s.join(evaluate.coherence(grouped, each((1, "service", True), (1, "route", True), names=("exp_id", "needle", "must"))), "target")
    return evaluate.overall_eval(s.withColumn("accounting", F.lit(1.0))).select("target", "overall")


# groups by the length of a path, a fifth of the files in the infrastructure, checks of neighbours in the order of paths
_PLACED_SQL = f"""{FILES_SQL}, u AS (SELECT DISTINCT diff_id AS target, path, {o.CATEGORY} AS category FROM files),
n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY path) - 1 AS rn FROM u), infra AS (SELECT target, path, CASE WHEN category <> 'Unclassified' THEN category END AS sub_group FROM u WHERE length(path) % 5 = 0),
sub AS (SELECT target, path, 'infra:' || (dense_rank() OVER (PARTITION BY target ORDER BY sub_group) - 1) || ':' || sub_group AS place FROM infra WHERE sub_group IS NOT NULL),
loc AS (SELECT target, path, 'g' || (length(path) % 3) AS place, FALSE AS is_infra FROM u WHERE length(path) % 5 <> 0 AND rn_of(path) UNION ALL SELECT target, path, place, TRUE FROM sub UNION ALL SELECT target, path, 'infra', TRUE FROM infra WHERE sub_group IS NULL)""".replace(" AND rn_of(path)", " AND length(path) % 7 <> 0")


def _placed(spark, sf):
    u = changed_files(spark, sf).select(F.col("diff_id").alias("target"), "path").distinct().withColumn("n", F.char_length("path"))
    kind = paths.category("path")
    infra = u.where("n % 5 = 0").select("target", "path", F.when(kind != "Unclassified", kind).alias("sub_group"))
    files = u.where("n % 5 <> 0 and n % 7 <> 0").select("target", F.concat(F.lit("g"), (F.col("n") % 3).cast("string")).alias("group_id"), "path")
    return u, evaluate.file_locations(files, infra)


@query(f"WITH {_PLACED_SQL} SELECT * FROM loc")
def file_locations(spark, sf):
    return _placed(spark, sf)[1]


@query(f"WITH {_PLACED_SQL} SELECT target, count(DISTINCT place) FILTER (NOT is_infra) AS groups, count(DISTINCT place) AS destinations FROM loc GROUP BY 1")
def review_destinations(spark, sf):
    return evaluate.destinations(_placed(spark, sf)[1])


@query(f"WITH {_PLACED_SQL} SELECT target, path FROM u WHERE (target, path) NOT IN (SELECT target, path FROM loc) AND path NOT LIKE '%.md'")
def uncovered_files(spark, sf):
    u, loc = _placed(spark, sf)
    return evaluate.uncovered(u, loc, u.where("path like '%.md'"))


@query(f"""WITH {_PLACED_SQL}, e AS (SELECT target, count(*) AS total FROM u GROUP BY 1), h AS (SELECT target, count(*) AS held, count(DISTINCT place) FILTER (NOT is_infra) AS g FROM loc GROUP BY 1)
SELECT target, CAST(greatest(0, 1 - CASE WHEN target % 2 = 1 THEN 0.5 ELSE 0 END - CASE WHEN coalesce(held, 0) <> total THEN 0.5 ELSE 0 END - CASE WHEN coalesce(g, 0) BETWEEN 1 AND 2 THEN 0 ELSE 0.25 END) AS DOUBLE) AS accounting FROM e LEFT JOIN h USING (target)""")
def file_accounting(spark, sf):
    u, loc = _placed(spark, sf)
    n = u.groupBy("target").agg(F.count("*").alias("total_files"))
    return evaluate.accounting(loc, n.select("target", "total_files", (F.col("total_files") - F.col("target") % 2).alias("expected_files"),
        F.lit(1).alias("min_groups"), F.lit(2).alias("max_groups")))


@query(f"""WITH {_PLACED_SQL}, k AS (SELECT target, CASE (rn // 2) % 4 WHEN 0 THEN 'same_group' WHEN 1 THEN 'separate_group' WHEN 2 THEN 'infrastructure' ELSE 'non_infrastructure' END AS kind, rn // 2 AS check_id, path, rn FROM n),
w AS (SELECT target, kind, check_id, path FROM k WHERE kind LIKE '%group' OR rn % 2 = 0), d AS (SELECT target, path FROM n WHERE rn % 3 = 0),
j AS (SELECT w.*, loc.place, loc.is_infra, d.path IS NOT NULL AS gone FROM w LEFT JOIN loc USING (target, path) LEFT JOIN d USING (target, path)),
a AS (SELECT target, kind, check_id, count(*) AS n, count(place) AS found, count(DISTINCT place) AS places, count(*) FILTER (is_infra) AS infra, count(*) FILTER (place = 'infra') AS bare, count(*) FILTER (gone) AS gone FROM j GROUP BY ALL),
b AS (SELECT t.target, count(DISTINCT place) FILTER (NOT is_infra) AS g, count(DISTINCT place) AS dest FROM (SELECT DISTINCT target FROM u) t LEFT JOIN loc USING (target) GROUP BY 1)
SELECT target, kind, check_id, CASE kind WHEN 'same_group' THEN found = n AND places = 1 AND bare = 0 WHEN 'separate_group' THEN found = n AND places = n WHEN 'infrastructure' THEN infra = n OR gone > 0 ELSE (found = n AND infra = 0) OR (found = 0 AND gone > 0) END AS satisfied FROM a
UNION ALL SELECT target, 'group_count_min', -1, dest >= 5 FROM b UNION ALL SELECT target, 'group_count_max', -1, g <= 2 FROM b""")
def golden_expectations(spark, sf):
    u, loc = _placed(spark, sf)
    n = u.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("path")) - 1).withColumn("check_id", F.floor(F.col("rn") / 2))
    kind = F.get(F.array(*[F.lit(x) for x in ("same_group", "separate_group", "infrastructure", "non_infrastructure")]), (F.col("check_id") % 4).cast("int"))
    wanted = n.withColumn("kind", kind).where(F.col("kind").endswith("group") | (F.col("rn") % 2 == 0))
    bounds = u.select("target").distinct().select("target",
        F.inline(F.array(F.struct(F.lit("group_count_min").alias("kind"), F.lit(5).alias("value")),
            F.struct(F.lit("group_count_max").alias("kind"), F.lit(2).alias("value")))))
    return evaluate.expectations(loc, n.where("rn % 3 = 0"), wanted, bounds)


@query("""WITH h AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS run, round(avg(o_totalprice) / 1000000, 6) AS score FROM orders GROUP BY 1, 2)
SELECT series, run, score, lag(score) OVER w AS previous, coalesce(lag(score) OVER w - score > 0.005, FALSE) AS regressed FROM h WINDOW w AS (PARTITION BY series ORDER BY run)""")
def regression_check(spark, sf):
    h = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"),
        F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.round(F.avg("o_totalprice") / 1000000, 6).alias("score"))
    return evaluate.regressions(h, "series", "run", "score", 0.005)


@query("SELECT source, doc_id, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS kept_bytes, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) > 20000 AS evicted FROM documents")
def lru_eviction(spark, sf):
    from ..sources.caches import evictions

    return evictions(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20000)


# --- streams ----------------------------------------------------------------------

@query("""WITH j AS (SELECT conv_id, turn, role, turn >= 3 AS terminal FROM conversations)
SELECT conv_id, turn, role FROM (SELECT *, coalesce(sum(CAST(terminal AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM j) WHERE ended = 0""")
def job_log_terminal(spark, sf):
    from ..streaming.activity import until_terminal

    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.col("turn") >= 3).alias("terminal"))
    return until_terminal(c, "conv_id", "turn", "terminal").select("conv_id", "turn", "role")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows_tumbling(spark, sf):
    from ..streaming.windows import counts

    return counts(table(spark, sf, "events"), "1 hour")


@query("""SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2""")
def event_windows_sliding(spark, sf):
    from ..streaming.windows import counts

    return counts(table(spark, sf, "events"), "1 hour", "30 minutes")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '2 hours' THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_windows_session(spark, sf):
    from ..streaming.windows import sessions

    return sessions(table(spark, sf, "events"), "2 hours")


# --- output -----------------------------------------------------------------------

@query("""WITH g AS (SELECT c_nationkey AS group_id, count(*) AS n_files, CAST(sum(CAST(c_acctbal > 0 AS INT)) AS BIGINT) AS positive FROM customer GROUP BY 1)
SELECT n_regionkey AS diff_id, count(*) AS total_groups, CAST(sum(n_files) AS BIGINT) AS total_files, string_agg(n_name || ':' || n_files, ',' ORDER BY n_name) AS listing FROM g JOIN nation ON n_nationkey = group_id GROUP BY 1""")
def nested_output(spark, sf):
    from ..operators.output import summarize

    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_files"))
    g = c.join(table(spark, sf, "nation"), "n_nationkey").select(F.col("n_regionkey").alias("diff_id"), F.col("n_name").alias("name"), "n_files")
    return summarize(g)


@query("SELECT 'src/p' || p_partkey || '.py' AS path, 'Python' AS language, 'ast' AS parse_tier, 2 AS definitions, 2 AS imports, 2 AS calls, 1 AS assignments FROM part")
def parse_facts(spark, sf):
    """Facts of small sources made for each part."""
    from ..sources.parse import parse

    p = table(spark, sf, "part")
    body = F.concat(F.lit("import os\nfrom app."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))),
        F.lit(" import load as fetch\n\nclass Part"), F.col("p_partkey").cast("string"),
                    F.lit("(Base):\n    def run(self):\n        x = fetch(self.name)\n        return os.path.join(x)\n"))
    facts = parse(p.select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("source")))
    return facts.select("path", "language", "parse_tier", F.size("definitions").alias("definitions"), F.size("imports").alias("imports"),
        F.size("call_sites").alias("calls"), F.size("assignments").alias("assignments"))


# --- fixtures with stated results ---------------------------------------------------

def _facts(spark):
    from ..sources.parse import parse

    return parse(fixtures.sources(spark))


@query(fixtures.values(fixtures.rows(fixtures.DEFINITIONS), "path VARCHAR, name VARCHAR, kind VARCHAR, start_line INTEGER, end_line INTEGER"))
def parse_definitions(spark, sf):
    return _facts(spark).select("path", F.inline("definitions"))


@query(fixtures.values(fixtures.rows(fixtures.IMPORTS), "path VARCHAR, source VARCHAR, named VARCHAR, is_default BOOLEAN, is_namespace BOOLEAN, line INTEGER"))
def parse_imports(spark, sf):
    i = _facts(spark).select("path", F.inline("imports"))
    named = F.array_join(F.transform("names", lambda n: F.concat(n["name"], F.coalesce(F.concat(F.lit(" as "), n["alias"]), F.lit("")))), ", ")
    return i.select("path", "source", named.alias("named"), "is_default", "is_namespace", "line")


@query(fixtures.values(fixtures.rows(fixtures.EXPORTS), "path VARCHAR, name VARCHAR, is_default BOOLEAN, source VARCHAR, line INTEGER"))
def parse_exports(spark, sf):
    return _facts(spark).select("path", F.inline("exports")).select("path", "name", "is_default", "source", "line")


@query(fixtures.values(fixtures.rows(fixtures.CALLS), "path VARCHAR, callee VARCHAR, line INTEGER, containing_function VARCHAR, args VARCHAR"))
def parse_calls(spark, sf):
    return _facts(spark).select("path", F.inline("call_sites")).select("path", "callee", "line", "containing_function", F.array_join("arguments", "; ").alias("args"))


@query(fixtures.values(fixtures.rows(fixtures.ASSIGNMENTS), "path VARCHAR, variable VARCHAR, callee VARCHAR, line INTEGER, containing_function VARCHAR"))
def parse_assignments(spark, sf):
    return _facts(spark).select("path", F.inline("assignments")).select("path", "variable", "callee", "line", "containing_function")


@query(fixtures.values(fixtures.rows(fixtures.BASES), "path VARCHAR, type VARCHAR, base VARCHAR"))
def class_bases(spark, sf):
    return _facts(spark).select("path", F.inline("bases")).select("path", "type", "base")


@query(fixtures.values(fixtures.ANALYSIS, "diff_id VARCHAR, kind VARCHAR, subject VARCHAR, said VARCHAR"))
def analyze_fixtures(spark, sf):
    """The engine over the small changes: all that it says of them, in rows of text."""
    from ..engine import Engine

    t = Engine().tables(fixtures.changes(spark))

    def rows(df, kind, subject, *said):
        parts = [F.lit(x[1:]) if x[:1] == "'" else F.col(x).cast("string") for x in said]
        return df.select("diff_id", F.lit(kind).alias("kind"), subject.alias("subject"), F.concat(*parts).alias("said"))

    out = rows(t["summary"].withColumn("found", F.array_join("frameworks", ", ")), "summary", F.array_join("languages", ", "), "total_files", "' files; ", "found")
    out = out.unionByName(rows(t["entrypoints"], "entry", F.concat_ws("::", "path", "symbol"), "entrypoint_type"))
    out = out.unionByName(rows(t["groups"], "group", F.col("group_id"), "name", "'; ", "review_order", "'; ", "score"))
    out = out.unionByName(rows(t["files"], "file", F.col("path"), "group_id", "'; ", "flow_position", "'; ", "role", "'; +", "additions", "' -", "deletions"))
    out = out.unionByName(rows(t["edges"], "edge", F.concat_ws(" -> ", "src", "dst"), "edge_type"))
    return out.unionByName(rows(t["infrastructure"], "infra", F.col("path"), "sub_group"))


@query(fixtures.values(fixtures.REFINED, "kind VARCHAR, subject VARCHAR, said VARCHAR"))
def refine_lenient(spark, sf):
    """A review's operations, repaired, checked and applied in order, with the warnings."""
    out, warnings = refine.apply_lenient(*fixtures.refinement(spark))

    def rows(df, kind, subject, *said):
        return df.select(F.lit(kind).alias("kind"), subject.alias("subject"),
            F.concat_ws("; ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in said]).alias("said"))

    found = rows(warnings, "warning", F.concat_ws(" ", "op", F.col("ord").cast("string")), "reason")
    found = found.unionByName(rows(out["groups"], "group", F.col("group_id"), "name", "entry_file", "risk", "review_order"))
    found = found.unionByName(rows(out["files"], "file", F.col("path"), "group_id", "flow_position", "role", "additions", "deletions"))
    return found.unionByName(rows(out["edges"], "edge", F.concat_ws(" -> ", "src", "dst"), "group_id", "edge_type"))


# --- calls, imports, reports --------------------------------------------------------

@query(f"""WITH {CALLS_SQL} SELECT DISTINCT callee, CAST(CASE WHEN regexp_matches(lower(callee), '{'|'.join(call_rules.MAPPERS)}') THEN 0.95 WHEN regexp_matches(lower(string_split(callee, '.')[1]), '{'|'.join(call_rules.STORE_RECEIVERS)}') THEN 0.9
WHEN {o._SQLW} OR {o._SQLR} THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence FROM calls""")
def db_confidence(spark, sf):
    return call_sites(spark, sf).select("callee").distinct().select("callee", call_rules.confidence("callee").alias("confidence"))


@query(fixtures.values(fixtures.imported(), "path VARCHAR, source VARCHAR, kind VARCHAR, local VARCHAR, remote VARCHAR, line INTEGER"))
def imported_names(spark, sf):
    from ..functions import ir

    return ir.imported_names(_facts(spark))


@query(fixtures.values(fixtures.rows(fixtures.DEFINITIONS), "path VARCHAR, name VARCHAR, kind VARCHAR, start_line INTEGER, end_line INTEGER"))
def ir_round_trip(spark, sf):
    from ..functions import ir

    return ir.from_ir(ir.to_ir(_facts(spark))).select("path", F.inline("definitions"))


@query(fixtures.values(fixtures.ENTRYPOINTS, "file VARCHAR, symbol VARCHAR, entrypoint_type VARCHAR"))
def entrypoint_rules(spark, sf):
    from ..operators import entrypoints
    from ..sources.parse import parse

    made = spark.createDataFrame(list(fixtures.ENTRY_SOURCES.items()), "path string, source string")
    return entrypoints.detect(parse(made))


@query("""SELECT conv_id AS job_id, turn AS seq, 'id: ' || turn || chr(10) || 'event: ' || e || chr(10) || 'data: {"role":"' || role || '","n":' || length(text) || '}' || chr(10) || chr(10) AS wire, e = 'completed' AS terminal
FROM (SELECT *, CASE role WHEN 'system' THEN 'job_started' WHEN 'user' THEN 'activity' ELSE 'completed' END AS e FROM conversations)""")
def sse_events(spark, sf):
    from ..operators import report

    name = F.when(F.col("role") == "system", "job_started").when(F.col("role") == "user", "activity").otherwise("completed")
    return report.sse(table(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), name.alias("event_name"),
        "role", F.char_length("text").alias("n")))


@query(f"WITH {FILES_SQL} SELECT diff_id, lang_of.k AS kind, CAST(greatest(sum(additions + deletions), 1) AS BIGINT) AS weight FROM files, LATERAL (SELECT {o.CATEGORY} AS k) lang_of GROUP BY 1, 2")
def group_weights(spark, sf):
    from ..operators import report

    return report.weights(changed_files(spark, sf).withColumn("kind", paths.category("path")), ["diff_id", "kind"])


@query("""WITH s AS (SELECT source AS target, round(avg(n_chars % 100) / 100, 4) AS overall, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT row_number() OVER (ORDER BY overall DESC, target) - 1 AS k,
  target || ' ' || printf('%.4f', overall) || ' ' || CASE WHEN overall >= 0.8 THEN 'good' WHEN overall >= 0.6 THEN 'fair' ELSE 'poor' END || ' n=' || printf('%.2f', n::DOUBLE) AS line FROM s)
SELECT CAST(k AS INT) AS line_no, line FROM l UNION ALL SELECT CAST(count(*) AS INT), 'mean ' || printf('%.4f', avg(overall)) || ' of ' || count(*) FROM s""")
def score_report(spark, sf):
    from ..operators import report

    # as in SQL the double is scaled and then rounded; round(x, 4) takes the shortest decimal for it, and another side where that ends in 5
    overall = F.round(F.avg(F.col("n_chars") % 100) / 100 * 10000) / 10000
    s = table(spark, sf, "documents").groupBy(F.col("source").alias("target")).agg(overall.alias("overall"), F.count("*").alias("n"))
    return report.text_report(s)


@query("""WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS o FROM nation)
SELECT n_regionkey AS diff_id, 'Say in a few sentences what this change does, group by group.' || chr(10) || string_agg(o || '. ' || n_name || ' (g' || n_nationkey || ', ' || coalesce(n, 0) || ' files)', chr(10) ORDER BY o) AS prompt FROM g LEFT JOIN n ON c_nationkey = n_nationkey GROUP BY 1""")
def overview_prompts(spark, sf):
    from ..operators import report

    g = table(spark, sf, "nation").select(F.col("n_regionkey").alias("diff_id"),
        F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("group_id"), F.col("n_name").alias("name"),
                                          F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).alias("review_order"))
    files = table(spark, sf, "customer").select(F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("group_id"),
        F.col("c_custkey").alias("path")).join(g.select("diff_id", "group_id"), "group_id")
    return report.overview_prompt(g, files)


@query("""SELECT doc_id % 50 AS k, count(*) AS asked, count(*) FILTER (doc_id % 3 = 0) AS held FROM documents GROUP BY 1""")
def vector_cache(spark, sf):
    """Documents whose text is in the store of vectors, and the others."""
    from ..sources.caches import cached_vectors, vector_keys

    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("|"), F.col("doc_id").cast("string")).alias("text"))
    store = vector_keys(d.where("doc_id % 3 = 0")).select("key", F.array(F.lit(1.0)).alias("vector"))
    held, missing = cached_vectors(d, store)
    both = held.select("doc_id", F.lit(1).alias("held")).unionByName(missing.select(F.substring_index("text", "|", -1).cast("long").alias("doc_id"),
        F.lit(0).alias("held")))
    return both.groupBy((F.col("doc_id") % 50).alias("k")).agg(F.count("*").alias("asked"), F.sum("held").alias("held"))


from . import surface  # noqa: E402, F401 - registers its queries here
