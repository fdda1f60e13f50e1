"""The driver's tables seen as changes, files, calls and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import table

#: path patterns of a mixed repository; {n} is a small number, {s} the document's source
PATTERNS = (
    "src/routes/users_{n}.ts", "src/services/{s}/user.service.ts", "src/{s}/repo_{n}.py", "docs/guide/{s}.md", "README.md",
        "packages/{s}/package.json", "packages/ui/{s}/index.tsx",
    "migrations/00{n}_init.sql", "src/{s}/__tests__/user_{n}.test.ts", "tests/test_{s}.py", "app/api/{s}/route.ts", ".github/workflows/ci_{n}.yml",
        "terraform/{s}/main.tf", "src/schemas/{s}.schema.json",
    "scripts/build_{n}.sh", "deploy/{s}.yaml", "docs/content/{s}.md", "src/docs/{s}/with_state.md", ".eslintrc.{n}", "src/generated/{s}.pb.go",
        "cmd/{s}/main.go", "crates/core/src/{s}.rs",
    "src/main/java/com/{s}/UserController.java", "src/test/java/com/{s}/UserControllerTest.java", "lib/{s}/settings.py", "config/app.config.ts",
        "vendor/{s}/lib_{n}.js", "fixtures/{s}.json",
    "services/workers/{s}/handler.ts", "apps/web/pages/{s}.tsx", "Dockerfile", "k8s/{s}/deployment.yaml", "src/auth/{s}/acl_{n}.go",
        "src/utils/helper_{n}.js", "proto/{s}.proto",
    "docs/user/{s}.rst", "src/{s}/Model_{n}.cs", "Makefile", "src/{s}/db/entity_{n}.kt", "www/docs/{s}.mdx", "src/{s}/Ünïcode_{n}.PY", "CHANGELOG.md",
)
CALLEES = (
    "console.log", "logger.info", "process.env.HOME", "os.environ['A']", "config.get", "config.getter", "axios.get", "fetch", "fetchAll",
        "requests.post.x", "items.push", "JSON.parse", "bus.emit", "queue.publish",
    "socket.on", "worker.consume", "userRepo.save", "prisma.user.findMany", "x.find", "cache.get", "db.query", "SELECT a FROM b", "INSERT INTO t",
        "session.execute", "map.get", "orders.where", "dotenv", "dotenv.config",
    "model.update", "client.fetch", "a.b.send", "plain",
)


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(diff_id, doc_id, path, additions, deletions)``: a file for each document, a change for each source."""
    patterns = F.array(*[F.lit(p) for p in PATTERNS])
    path = F.element_at(patterns, (F.col("doc_id") % len(PATTERNS) + 1).cast("int"))
    path = F.replace(F.replace(path, F.lit("{n}"), (F.col("doc_id") % 13).cast("string")), F.lit("{s}"), F.col("source"))
    return table(spark, sf_dir, "documents").select(
        F.substr("source", F.lit(4)).cast("long").alias("diff_id"), "doc_id", path.alias("path"), (F.col("n_chars") % 97).alias("additions"),
            (F.col("n_chars") % 31).alias("deletions"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, file, caller, callee, line)``: a call for each event."""
    names = F.array(*[F.lit(c) for c in CALLEES])
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("src/m"), (F.col("user_id") % 40).cast("string"), F.lit(".ts")).alias("file"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string"))).alias("caller"),
        F.element_at(names, (F.col("event_id") % len(CALLEES) + 1).cast("int")).alias("callee"), (F.col("event_id") % 500).cast("int").alias("line"))


def keys_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, edge_type)``: customers and suppliers to nations to regions."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"),
        F.lit("Calls").alias("edge_type"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"),
        F.lit("Imports").alias("edge_type"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"),
        F.lit("Calls").alias("edge_type"))
    return c.unionByName(s).unionByName(n)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: the same tables for the SQL oracle, as common table expressions
FILES_SQL = f"""files AS (
  SELECT CAST(substr(source, 4) AS BIGINT) AS diff_id, doc_id,
         replace(replace(list_extract({_sql_list(PATTERNS)}, CAST(doc_id % {len(PATTERNS)} AS INT) + 1), '{{n}}', CAST(doc_id % 13 AS VARCHAR)), '{{s}}', source) AS path,
         n_chars % 97 AS additions, n_chars % 31 AS deletions
  FROM documents)"""
CALLS_SQL = f"""calls AS (
  SELECT event_id, 'src/m' || (user_id % 40) || '.ts' AS file, CASE WHEN event_id % 5 <> 0 THEN 'f' || (event_id % 7) END AS caller,
         list_extract({_sql_list(CALLEES)}, CAST(event_id % {len(CALLEES)} AS INT) + 1) AS callee, CAST(event_id % 500 AS INT) AS line
  FROM events)"""
GRAPH_SQL = """edges AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'Calls' AS edge_type FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'Imports' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'Calls' FROM nation)"""
