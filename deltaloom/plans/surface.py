"""Queries over names, configuration, reviews, comments and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import cluster, entrypoints, evaluate, output, refine, review, similarity
from ..sources import caches, config
from ..sources.files import workspace_packages
from ..sources.shared import table
from ..streaming import activity
from . import fixtures
from . import oracles as o
from .adapters import FILES_SQL, changed_files
from .catalogue import query

# --- names and paths ----------------------------------------------------------------

_KINDS = [*paths.GROUP_SUFFIXES, "Other"]


@query(f"""WITH {FILES_SQL}, e AS (SELECT DISTINCT path, doc_id % {len(_KINDS)} AS k, CASE doc_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN regexp_extract(path, '([^/.]*)[^/]*$', 1) ELSE 'run' || doc_id % 3 END AS symbol FROM files),
n AS (SELECT *, regexp_extract(path, '([^/.]*)[^/]*$', 1) AS stem, list_extract({[*paths.GROUP_SUFFIXES.values(), '']}, CAST(k AS INT) + 1) AS suffix FROM e)
SELECT path, symbol, k, CASE WHEN symbol = stem OR symbol IN ('default', 'module') THEN stem ELSE symbol || ' (' || stem || ')' END || ' ' || suffix AS name FROM n""")
def group_names(spark, sf):
    f = changed_files(spark, sf).select("path", (F.col("doc_id") % len(_KINDS)).alias("k"), "doc_id")
    symbol = F.when(F.col("doc_id") % 4 == 0, "default").when(F.col("doc_id") % 4 == 1,
        paths.file_stem("path")).otherwise(F.concat(F.lit("run"), (F.col("doc_id") % 3).cast("string")))
    kind = F.get(F.array(*[F.lit(x) for x in _KINDS]), F.col("k").cast("int"))
    return f.select("path", symbol.alias("symbol"), "k", kind.alias("kind")).distinct().select("path", "symbol", "k",
        paths.group_name("path", "symbol", "kind").alias("name"))


@query(f"""WITH {FILES_SQL}, p AS (SELECT DISTINCT path FROM files)
SELECT path, array_to_string(list_slice(string_split(path, '/'), greatest(len(string_split(path, '/')) - 1, 1), len(string_split(path, '/'))), '/') AS label,
  replace(replace(replace(replace(path || '<&">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
  regexp_matches(path, '(^|/)[Ff]ixtures?/') AND contains(path, 'fixtures/') AS fixture FROM p""")
def labels_and_html(spark, sf):
    p = changed_files(spark, sf).select("path").distinct()
    return p.select("path", paths.short_label("path").alias("label"), text.html_escape(F.concat("path", F.lit('<&">'))).alias("html"),
        paths.fixture_root("path").isNotNull().alias("fixture"))


@query(f"""WITH {FILES_SQL}, p AS (SELECT DISTINCT path FROM files)
SELECT path, regexp_matches(path, '(?i)[.](test|spec)[.]|_test[.]|__tests__/|/tests?/|^tests?/|_tests[.]rs$') OR regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '(^|/)(Test[^/]*|[^/]*Tests?)[.](java|kt)$')
  OR regexp_matches(path, 'Tests?[.](cs|php|swift)$') OR regexp_matches(path, '_spec[.]rb$') OR regexp_matches(path, '(?i)/spec/.*[.]rb$') OR regexp_matches(path, '_tests[.](c|cpp|cc)$') OR regexp_matches(path, 'Test[.](cpp|cc)$')
  OR regexp_matches(path, '(^|/)(Test[^/]*|[^/]*(Tests?|Spec|Suite))[.]scala$') AS is_test FROM p""")
def test_paths(spark, sf):
    return changed_files(spark, sf).select("path").distinct().select("path", entrypoints.is_test_path().alias("is_test"))


_CONFIG = {"ignore": {"paths": ["docs/**", "**/*.lock", "vendor/*/lib_[0-4].js"]}, "layers": {"api": "src/routes/**", "data": "src/**/repo_*.py",
    "web": "{apps,packages}/**", "all": "src/*"},
           "entrypoints": {"http": ["src/routes/*.ts"], "cli": ["cmd/**/main.go"]}}


@query(f"""WITH {FILES_SQL}, p AS (SELECT DISTINCT path FROM files)
SELECT path, regexp_matches(path, '^docs/') OR regexp_matches(path, '[.]lock$') OR regexp_matches(path, '^vendor/[^/]*/lib_[0-4][.]js$') AS ignored,
  CASE WHEN regexp_matches(path, '^src/[^/]*$') THEN 'all' WHEN starts_with(path, 'src/routes/') THEN 'api' WHEN regexp_matches(path, '^src/(.*/)?repo_[^/]*[.]py$') THEN 'data' WHEN regexp_matches(path, '^(apps|packages)/') THEN 'web' END AS layer,
  regexp_matches(path, '^src/routes/[^/]*[.]ts$') OR regexp_matches(path, '^cmd/(.*/)?main[.]go$') AS entrypoint FROM p""")
def config_paths(spark, sf):
    p = changed_files(spark, sf).select("path").distinct()
    c = F.col("path")
    return p.select("path", config.is_ignored(c, _CONFIG).alias("ignored"), config.layer(c, _CONFIG).alias("layer"),
        config.is_entrypoint_file(c, _CONFIG).alias("entrypoint"))


@query(f"""WITH {FILES_SQL}, u AS (SELECT DISTINCT diff_id, path FROM files WHERE length(path) % 2 = 0), s AS (SELECT diff_id, string_split(path, '/') AS p, path FROM u),
d AS (SELECT diff_id, depth, count(DISTINCT array_to_string(list_slice(p, 1, depth), '/')) AS n, bool_and(len(p) > depth) AS deep, min(array_to_string(list_slice(p, 1, depth), '/')) AS head FROM s, range(1, 6) r(depth) GROUP BY ALL),
ok AS (SELECT diff_id, max(depth) AS depth FROM d WHERE n = 1 AND deep GROUP BY 1)
SELECT u.diff_id, coalesce(max(d.head) || '/', 'Mixed') AS prefix FROM (SELECT DISTINCT diff_id FROM u) u LEFT JOIN ok USING (diff_id) LEFT JOIN d ON d.diff_id = u.diff_id AND d.depth = ok.depth GROUP BY 1""")
def common_prefixes(spark, sf):
    u = changed_files(spark, sf).select("diff_id", "path").distinct().where(F.char_length("path") % 2 == 0)
    return cluster.common_prefix(u, ["diff_id"])


@query("""WITH p AS (SELECT n_nationkey, 'pkg-' || lower(replace(n_name, ' ', '-')) AS package, 'packages/' || n_nationkey AS dir, n_regionkey FROM nation)
SELECT package, dir || CASE n_regionkey WHEN 0 THEN '/lib/main.js' WHEN 1 THEN '/src/index.ts' ELSE '/index.ts' END AS entry FROM p WHERE n_regionkey < 4""")
def workspace_entries(spark, sf):
    n = table(spark, sf, "nation").select(
        F.concat(F.lit("packages/"), F.col("n_nationkey").cast("string")).alias("dir"),
            F.concat(F.lit("pkg-"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("package"), "n_regionkey")
    main = F.when(F.col("n_regionkey") == 0, F.lit("./lib/main.js"))
    manifest = n.select(F.concat("dir", F.lit("/package.json")).alias("path"), F.to_json(F.struct(F.col("package").alias("name"), main.alias("main"))).alias("source"))
    entry = F.when(F.col("n_regionkey") == 0, "/lib/main.js").when(F.col("n_regionkey") == 1, "/src/index.ts").when(F.col("n_regionkey") < 4, "/index.ts")
    code = n.where(entry.isNotNull()).select(F.concat("dir", entry).alias("path"), F.lit("x").alias("source"))
    return workspace_packages(manifest.unionByName(code))


# --- text in answers ------------------------------------------------------------------

@query("""SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE '{"id": ' || doc_id || ', "of": {"lang": "' || lang || '"}}' END AS found FROM documents""")
def json_in_answers(spark, sf):
    d = table(spark, sf, "documents")
    j = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "of": {"lang": "'), "lang", F.lit('"}}'))
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), j, F.lit("\n```\nDone."))).when(k == 1,
        F.concat(F.lit("The answer "), j, F.lit(" as asked."))).when(k == 2, j).otherwise("no object here")
    return d.select("doc_id", text.json_in(said).alias("found"))


@query("SELECT doc_id, NOT regexp_matches(left(text, 200), '[`$|;&<>]') AS plain, strlen(text) <= 10485760 AS fits FROM documents")
def safe_commands(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.is_plain_command(F.substring("text", 1, 200)).alias("plain"), text.fits("text").alias("fits"))


# --- vectors ----------------------------------------------------------------------------

@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_of_neighbours(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    j = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return j.select("vec_id", F.round(similarity.cosine("embedding", "next"), 6).alias("similarity"))


# --- graphs and manifests ------------------------------------------------------------------

@query(r"""WITH e AS (SELECT n_regionkey AS group_id, n_name AS src, 'R' || (n_nationkey % 3) AS dst, CASE WHEN n_nationkey % 2 = 0 THEN 'Calls' ELSE 'Imports' END AS t FROM nation
UNION ALL SELECT n_regionkey, n_name, 'R' || (n_nationkey % 3), 'Reads' FROM nation UNION ALL SELECT n_regionkey, n_name, n_name, 'Calls' FROM nation),
d AS (SELECT group_id, src, dst, min(t) AS t FROM e WHERE src <> dst GROUP BY 1, 2, 3), l AS (SELECT group_id, '  "' || src || '" -->|' || t || '| "' || dst || '"' AS line FROM d)
SELECT group_id, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS chart FROM l GROUP BY 1""")
def mermaid_charts(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_name").alias("src"),
        F.concat(F.lit("R"), (F.col("n_nationkey") % 3).cast("string")).alias("dst"), "n_nationkey")
    e = n.withColumn("edge_type", F.when(F.col("n_nationkey") % 2 == 0, "Calls").otherwise("Imports")).drop("n_nationkey")
    both = e.unionByName(e.withColumn("edge_type", F.lit("Reads"))).unionByName(e.withColumns({"dst": F.col("src"), "edge_type": F.lit("Calls")}))
    return output.mermaid(both)


@query(f"""WITH {FILES_SQL}, u AS (SELECT DISTINCT diff_id, path FROM files)
SELECT diff_id || '/' || CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS group_id, array_to_string(list_sort(list(path)), ',') AS listed FROM u GROUP BY 1""")
def exported_manifest(spark, sf):
    u = changed_files(spark, sf).select("diff_id", "path").distinct()
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    g = u.select(F.concat(F.col("diff_id").cast("string"), F.lit("/"), top).alias("group_id"), top.alias("name"), F.col("diff_id").alias("review_order"), "path")
    return refine.export_manifest(g).select("group_id", F.array_join("files", ",").alias("listed"))


# --- reviews -----------------------------------------------------------------------------------

@query("""WITH a AS (SELECT source AS answer_id, doc_id % 5 AS criterion, 1 + n_chars % 6 AS score, 3 AS overall FROM documents WHERE doc_id % 7 < 5),
p AS (SELECT answer_id, count(*) FILTER (score < 1 OR score > 5) AS bad, count(DISTINCT criterion) AS c, avg(score) AS m, max(overall) AS ov FROM a GROUP BY 1)
SELECT answer_id, 'score out of range' AS problem FROM p WHERE bad > 0 UNION ALL SELECT answer_id, 'criterion missing' FROM p WHERE c < 5 UNION ALL SELECT answer_id, 'overall off the mean' FROM p WHERE abs(m - ov) > 0.5""")
def judge_problems(spark, sf):
    a = table(spark, sf, "documents").where("doc_id % 7 < 5").select(
        F.col("source").alias("answer_id"), (F.col("doc_id") % 5).alias("criterion"), (1 + F.col("n_chars") % 6).alias("score"), F.lit(3).alias("overall"))
    return review.judge_problems(a)


@query("SELECT doc_id, 1 + n_chars % 5 AS score, (n_chars % 5) / 4.0::DOUBLE AS normalized FROM documents")
def judge_scores(spark, sf):
    return evaluate.judge_scores(table(spark, sf, "documents").select("doc_id", (1 + F.col("n_chars") % 5).alias("score")))


@query(f"""WITH {FILES_SQL}, u AS (SELECT DISTINCT diff_id, path, length(path) % 3 AS a, CASE WHEN length(path) % 5 <> 0 THEN length(path) % 3 + CASE WHEN length(path) % 4 = 0 THEN 1 ELSE 0 END END AS b FROM files)
SELECT diff_id, path, CAST(a AS VARCHAR) AS from_group, CAST(b AS VARCHAR) AS to_group FROM u WHERE a IS DISTINCT FROM b""")
def moved_files(spark, sf):
    u = changed_files(spark, sf).select("diff_id", "path").distinct().withColumn("n", F.char_length("path"))
    before = u.select("diff_id", "path", (F.col("n") % 3).cast("long").alias("group_id"))
    after = u.where("n % 5 <> 0").select("diff_id", "path", (F.col("n") % 3 + (F.col("n") % 4 == 0).cast("int")).cast("long").alias("group_id"))
    return review.moved_files(before, after).select("diff_id", "path", F.col("from_group").cast("string").alias("from_group"),
        F.col("to_group").cast("string").alias("to_group"))


@query("""WITH g AS (SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_nationkey % 4 <> 0), f AS (SELECT c_nationkey, 'f' || c_custkey AS path FROM customer WHERE c_custkey % 10 = 0), i AS (SELECT n_regionkey, n_name AS path FROM nation WHERE n_nationkey % 4 = 0),
gf AS (SELECT n_regionkey, n_nationkey, n_name, list_sort(list(path) FILTER (path IS NOT NULL)) AS files FROM g LEFT JOIN f ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT n_regionkey AS diff_id, CAST(count(*) AS INT) AS n_groups, string_agg(n_name || ':' || coalesce(len(files), 0), ',' ORDER BY n_nationkey) AS groups, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM i WHERE i.n_regionkey = gf.n_regionkey), '') AS infrastructure FROM gf GROUP BY 1""")
def refinement_requests(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("diff_id"), F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    g = n.where("group_id % 4 <> 0").withColumn("review_order", F.col("group_id"))
    files = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("group_id"),
        F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path")).join(n.select("diff_id", "group_id"), "group_id")
    out = review.refinement_request(g, files, n.where("group_id % 4 = 0").select("diff_id", F.col("name").alias("path")))
    read = F.from_json("request", "groups array<struct<review_order:bigint,group_id:bigint,name:string,files:array<string>>>, infrastructure array<string>")
    return out.select("diff_id", read.alias("r")).select(
        "diff_id", F.size("r.groups").alias("n_groups"),
            F.array_join(F.transform("r.groups", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(F.size(x["files"]), F.lit(0)).cast("string"))),
                ",").alias("groups"),
        F.array_join(F.array_sort("r.infrastructure"), ",").alias("infrastructure"))


# --- comments, keys and logs ----------------------------------------------------------------------

@query(r"""WITH c AS (SELECT conv_id % 20 AS analysis, conv_id || '-' || turn AS id, turn, role, 'said ' || turn || chr(10) || 'by ' || role AS text, conv_id FROM conversations),
b AS (SELECT analysis, printf('%06d', turn) AS created_at, id, CASE WHEN turn % 2 = 0 THEN 'src/' || role || '.ts:' || (turn + 1) || '-' || (turn + 3) ELSE 'g' || conv_id END
  || CASE WHEN role = 'user' THEN chr(10) || '```' || chr(10) || 'x = ' || turn || chr(10) || '```' ELSE '' END || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') AS block FROM c)
SELECT analysis, string_agg(block, chr(10) || chr(10) ORDER BY created_at, id) AS export FROM b GROUP BY 1""")
def exported_comments(spark, sf):
    c, t = table(spark, sf, "conversations"), F.col("turn")
    placed = F.when(t % 2 == 0, F.concat(F.lit("src/"), "role", F.lit(".ts")))
    at = lambda k: F.when(t % 2 == 0, t + k).cast("int")
    rows = c.select(
        (F.col("conv_id") % 20).alias("analysis"), F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string")).alias("id"),
            F.concat(F.lit("g"), F.col("conv_id").cast("string")).alias("group_id"), placed.alias("file_path"),
        at(1).alias("start_line"), at(3).alias("end_line"), F.when(F.col("role") == "user", F.concat(F.lit("x = "), t.cast("string"))).alias("selected_code"),
        F.concat(F.lit("said "), t.cast("string"), F.lit("\nby "), "role").alias("text"), F.format_string("%06d", "turn").alias("created_at"))
    return caches.export_comments(rows)


@query("""WITH r AS (SELECT doc_id, sha256('m' || chr(10) || lang || chr(10) || source) AS key FROM documents), c AS (SELECT DISTINCT key FROM r WHERE doc_id % 3 = 0)
SELECT doc_id, CASE WHEN r.key IN (SELECT key FROM c) THEN 'answer to ' || left(r.key, 6) END AS response FROM r""")
def replayed_answers(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", caches.request_key(F.lit("m"), "lang", "source").alias("key"))
    cassettes = r.where("doc_id % 3 = 0").select("key").distinct().select("key", F.concat(F.lit("answer to "), F.substring("key", 1, 6)).alias("response"))
    return caches.replay(r, cassettes, strict=False).select("doc_id", "response")


@query("""WITH s AS (SELECT doc_id AS id, lang AS body FROM documents), ch AS (SELECT doc_id * 2 AS id, source AS body, doc_id AS seq, doc_id % 5 = 0 AS deleted FROM documents),
a AS (SELECT id, body, -1 AS seq, FALSE AS deleted FROM s UNION ALL SELECT * FROM ch), l AS (SELECT id, arg_max(body, seq) AS body, arg_max(deleted, seq) AS deleted FROM a GROUP BY 1)
SELECT id, body FROM l WHERE NOT deleted""")
def comment_store(spark, sf):
    d = table(spark, sf, "documents")
    store = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("body"))
    changes = d.select((F.col("doc_id") * 2).alias("id"), F.col("source").alias("body"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 5 == 0).alias("deleted"))
    return caches.upsert(store, changes, "id", "seq")


@query("""WITH l AS (SELECT user_id AS job_id, event_id AS seq, event_id % 4 AS k, event_type FROM events)
SELECT job_id, seq, CASE k WHEN 0 THEN event_type WHEN 1 THEN 'error' ELSE 'text' END AS event_name, CASE WHEN k = 1 OR (k = 0 AND event_type = 'error') THEN 'error' ELSE 'info' END AS level,
  CASE k WHEN 0 THEN 'm' || seq WHEN 1 THEN 'bad' WHEN 2 THEN 'cmd' || seq ELSE 'plain ' || event_type END AS message FROM l""")
def normalized_lines(spark, sf):
    k, seq = F.col("event_id") % 4, F.col("event_id").cast("string")
    line = F.when(k == 0, F.concat(F.lit('{"type":"'), "event_type", F.lit('","message":"m'), seq, F.lit('"}'))).when(k == 1, '{"type":"error","text":"bad"}').when(
        k == 2, F.concat(F.lit('{"item":{"command":"cmd'), seq, F.lit('"}}'))).otherwise(F.concat(F.lit("plain "), "event_type"))
    return activity.normalize_lines(table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.alias("line")))


@query("""SELECT user_id AS job_id, count(*) AS entries, count(*) FILTER (event_type = 'error') AS errors, arg_max(event_type, event_id) AS last_message FROM events GROUP BY 1""")
def activity_summaries(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.col("event_type").alias("message"))
    return review.activity_summary(e)


@query("""SELECT n_regionkey AS diff_id, 'pkg/' || n_name || '/svc.test.ts' AS path, n_nationkey + 100 AS group_id FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_regionkey, 'pkg/' || n_name || '/svc_test.go', n_nationkey + 100 FROM nation WHERE n_nationkey % 2 = 1""")
def late_tests(spark, sf):
    """Every nation has an implementation twice; a test of it goes to the later group, one of another name nowhere."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("diff_id"), F.concat(F.lit("pkg/"), "n_name", F.lit("/")).alias("d"),
        F.col("n_nationkey").alias("k"))
    test = F.when(F.col("k") % 2 == 0, "svc.test.ts").otherwise("svc_test.go")
    tests = n.select("diff_id", F.concat("d", test).alias("path")).unionByName(n.select("diff_id", F.concat("d", F.lit("other.spec.ts")).alias("path")))
    impl = n.select("diff_id", F.concat("d", F.lit("svc.ts")).alias("path"), F.col("k").alias("group_id")).unionByName(n.select("diff_id",
        F.concat("d", F.lit("svc.go")).alias("path"), (F.col("k") + 100).alias("group_id")))
    return cluster.late_tests(tests, impl)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type FROM r WHERE n = 1""")
def latest_events(spark, sf):
    return activity.latest_by_seq(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""WITH t AS (SELECT lang AS language, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT language, count(*) AS n FROM t GROUP BY 1 HAVING count(*) < 21""")
def corpus_balance(spark, sf):
    return evaluate.corpus_balance(table(spark, sf, "documents").select(F.col("lang").alias("language"), "source").distinct(), 21)




@query(fixtures.values(fixtures.PARSED_ANSWERS, "diff_id VARCHAR, kind VARCHAR, ord INTEGER, said VARCHAR"))
def parsed_answers(spark, sf):
    ops, lost = review.parse_refinement(spark.createDataFrame(fixtures.ANSWERS, "diff_id string, response string"))
    out = lost.select("diff_id", F.lit("none").alias("kind"), F.lit(-1).alias("ord"), F.col("response").alias("said"))
    for kind, df in ops.items():
        said = F.concat_ws("; ", *[F.col(c).cast("string") for c in df.columns if c not in ("diff_id", "ord")])
        out = out.unionByName(df.select("diff_id", F.lit(kind).alias("kind"), "ord", said.alias("said")))
    return out


@query("""WITH w AS (SELECT n_regionkey AS target, CASE n_nationkey % 4 WHEN 0 THEN 'same_group' WHEN 1 THEN 'infrastructure' WHEN 2 THEN 'non_infrastructure' ELSE 'separate_group' END AS kind, n_nationkey // 8 AS check_id, substr(n_name, 1, 6) AS path FROM nation),
c AS (SELECT n_regionkey AS target, substr(n_name, 1, 6) AS path FROM nation WHERE n_nationkey % 3 <> 0), p AS (SELECT target, kind, check_id, min(path) AS path, count(*) AS n, count(DISTINCT path) AS d FROM w WHERE kind LIKE '%group' GROUP BY 1, 2, 3)
SELECT DISTINCT target, path, 'not among the changed files' AS problem FROM w WHERE (target, path) NOT IN (SELECT target, path FROM c) UNION ALL
SELECT target, path, 'infrastructure and not' FROM w WHERE kind LIKE '%infrastructure' GROUP BY 1, 2 HAVING count(DISTINCT kind) > 1 UNION ALL SELECT DISTINCT target, path, 'a check of fewer files than it names' FROM p WHERE d < n OR d < 2""")
def linted_expectations(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("target"), "n_nationkey", F.substring("n_name", 1, 6).alias("path"))
    k = F.col("n_nationkey") % 4
    kind = F.when(k == 0, "same_group").when(k == 1, "infrastructure").when(k == 2, "non_infrastructure").otherwise("separate_group")
    return review.lint_expectations(n.select("target", kind.alias("kind"), F.floor(F.col("n_nationkey") / 8).alias("check_id"), "path"),
        n.where("n_nationkey % 3 <> 0").select("target", "path"))
