"""Laws and hand-written cases of the operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import calls, paths, text
from deltaloom.operators import cluster, evaluate, graph, output, rank, reach, refine, similarity
from deltaloom.sources import caches, parse
from deltaloom.streaming import activity, windows


def values(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()


@pytest.mark.parametrize("path,want", [
    ("Dockerfile", "Infrastructure"), ("a/.env.local", "Infrastructure"), ("src/resources/db/x.sql", "Migration"), ("src/types/user.ts", "Schema"), ("db/migrations/1.py", "Migration"),
    ("scripts/a.py", "Script"), ("deploy/x.yaml", "Deployment"), ("docs/a.md", "Documentation"), ("docs/content/a.html", "Unclassified"), ("axum/src/docs/a.md", "Unclassified"),
    (".eslintrc", "Lint"), ("a/test-utils/x.ts", "TestUtil"), ("a/generated/x.ts", "Generated"), ("src/a.ts", "Unclassified"), ("", "Unclassified"),
])
def test_category(spark, path, want):
    assert values(spark, [(path,)], "p string", c=paths.category("p"))[0].c == want


def test_path_scalars(spark):
    rows = [("a/b/../c/./d.ts",), ("x.test.ts",), ("src/FooTests.java",), ("lib/test_util.py",), ("pkg/index.ts",), ("one",), (None,)]
    got = values(spark, rows, "p string", n=paths.normalize("p"), b=paths.bare_stem("p"), t=paths.test_impl_stem("p"), d=paths.parent_dir("p"), l=paths.language("p"))
    assert [r.n for r in got][:2] == ["a/c/d.ts", "x.test.ts"]
    assert [r.b for r in got] == ["d", "x", "foo", "util", "", "one", None]
    assert [r.t for r in got][1:4] == [":x", "src:Foo", "lib:util"]
    assert [r.d for r in got][4:6] == ["pkg", "."]
    dots = values(spark, [(".a.b",), ("..a",), ("...u.h",), (".",), ("a.b",), ("..",)], "s string", r=paths.relative_import("s"))
    assert [r.r for r in dots] == ["./a/b", "../a", "../../u/h", ".", "a.b", ".."]


def test_topics_and_names(spark):
    got = values(spark, [("docs/guide/2auth-flow/login_page.test.ts", "login", "HttpRoute")], "p string, s string, k string", t=paths.topic_tokens("p"), g=paths.group_name("p", "s", "k"))[0]
    assert set(got.t) == {"login", "page", "auth", "flow"} and got.g == "login (login_page) route"


@pytest.mark.parametrize("callee,want", [
    ("console.log", "Logging"), ("process.envX", "ConfigRead"), ("config.getter", None), ("config.get.x", "ConfigRead"), ("fetch", "HttpCall"), ("fetchAll", None), ("axios.get", "HttpCall"),
    ("users.find", None), ("bus.emit", "EventEmission"), ("x.on", "EventHandling"), ("userRepo.save", "Persistence"), ("x.save", None), ("prisma.user.findMany", "DatabaseRead"),
    ("cache.get", None), ("INSERT INTO a", "Persistence"), ("select 1", "DatabaseRead"), ("JSON.parse", None),
])
def test_call_pattern(spark, callee, want):
    assert values(spark, [(callee,)], "c string", p=calls.pattern("c"))[0].p == want


def test_scores(spark):
    base = "a boolean, b boolean, c boolean"
    s = lambda a, b, c: values(spark, [(a, b, c)], base, s=F.round(rank.composite({"risk": rank.risk_score({"has_schema": F.col("a"), "has_api": F.col("b"), "has_auth": F.col("c")}), "centrality": F.lit(0.5), "surface_area": F.lit(0.0), "uncertainty": F.lit(0.5)}), 6))[0].s
    assert s(False, True, False) == 0.3125 and s(False, False, False) == 0.225 and s(True, True, False) == 0.4175 and s(None, None, None) == 0.225
    assert values(spark, [(1,)], "x int", s=rank.composite({k: F.lit(float("nan")) for k in rank.WEIGHTS}))[0].s == 0.0
    assert values(spark, [(1,)], "x int", s=rank.composite({k: F.lit(1.0) for k in rank.WEIGHTS}, {k: 0.0 for k in rank.WEIGHTS}))[0].s == 0.0
    t = values(spark, [(0.35,), (0.675,), (1.0,), (2.0,)], "x double", s=F.round(evaluate.threshold_score(F.col("x"), 0.35), 6), d=evaluate.threshold_score(F.col("x"), 1.5))
    assert [r.s for r in t] == [1.0, 0.5, 0.0, 0.0] and [r.d for r in t] == [1.0, 1.0, 1.0, 0.0]


def test_text_scalars(spark):
    got = values(spark, [("é" * 10 + "\nab",), ("short",), (None,)], "t string", c=text.truncate("t", 3), n=text.estimate_tokens("t"))
    assert got[0].c.startswith("é" * 6 + "\n\n...") and got[0].n == 6 and got[1].c == "short" and got[2].c is None
    d = text.line_diff("a", "b")
    r = values(spark, [("x\ny\n", "y\nz\nz\n")], "a string, b string", added=d["added"], removed=d["removed"])[0]
    assert r.added == ["z", "z"] and r.removed == 1
    j = values(spark, [('so:\n```json\n{"a": 1}\n```',), ('x {"b": {}} y',), ("none",)], "t string", j=text.json_in("t"))
    assert [x.j and json.loads(x.j) for x in j] == [{"a": 1}, {"b": {}}, None]


def test_distances_of_a_chain(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "Calls") for i in range(6)] + [("n6", "n0", "Calls"), ("n0", "n1", "Imports")], "src string, dst string, edge_type string")
    s = spark.createDataFrame([("n0", "n0")], "entry string, node string")
    fwd = {r.node: r.distance for r in reach.distances(e, s).collect()}
    assert fwd == {f"n{i}": i for i in range(7)}
    both = {r.node: r.distance for r in reach.reachability(e, s).collect()}
    assert both["n6"] == 2 and both["n3"] == 3 and both["n0"] == 0
    assert {r.node for r in reach.call_chain(e, s, 2).collect()} == {"n1", "n2"}
    assert reach.distances(e.where("false"), s).count() == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    nodes = [*range(60), *range(100, 131)]
    root = {n: n for n in nodes}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = reach.components(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r.node: r.component for r in got.collect()} == root


def test_consolidation_keeps_every_file_once(spark):
    rng = random.Random(4)
    files = sorted({"/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + f"/f{i}.ts" for i in range(80)} | {f"root{i}" for i in range(3)})
    d = spark.createDataFrame([(1, p) for p in files], "diff_id long, path string")
    g = cluster.directory_groups(d).select("diff_id", F.dense_rank().over(__import__("pyspark").sql.Window.partitionBy("diff_id").orderBy("name")).cast("long").alias("grp"), "name", F.lit(False).alias("has_entry"), "path")
    out = cluster.consolidate(g).collect()
    assert sorted(r.path for r in out) == files
    assert len({r.grp for r in out}) < len({r.grp for r in g.collect()})


def test_symbol_graph(spark):
    files = spark.createDataFrame([("a.ts",), ("b.ts",), ("lib/index.ts",), ("pkg/x/src/index.ts",), ("pkg/x/util.ts",)], "path string")
    imports = spark.createDataFrame([("a.ts", "./b"), ("a.ts", "./lib"), ("a.ts", "@m/x"), ("a.ts", "@m/x/util"), ("a.ts", "react"), ("lib/index.ts", "../b")], "importer string, source string")
    packages = spark.createDataFrame([("@m/x", "pkg/x/src/index.ts"), ("@m", "none.ts")], "package string, entry string")
    got = {(r.importer, r.source): r.target for r in graph.resolve_imports(imports, files, packages).collect()}
    assert got[("a.ts", "./b")] == "b.ts" and got[("a.ts", "./lib")] == "lib/index.ts" and got[("lib/index.ts", "../b")] == "b.ts"
    assert got[("a.ts", "@m/x")] == "pkg/x/src/index.ts" and got[("a.ts", "@m/x/util")] == "pkg/x/util.ts" and got[("a.ts", "react")] is None
    defs = spark.createDataFrame([("a.ts", "f", "Function", 0), ("a.ts", "f", "Class", 1), ("b.ts", "g", "Function", 0)], "path string, name string, kind string, pos int")
    v = graph.nodes(files, defs)
    assert {r.id: r.kind for r in v.collect()}["a.ts::f"] == "Function" and v.count() == 7
    c = spark.createDataFrame([("a.ts", "f", "g"), ("a.ts", None, "B.g"), ("a.ts", "f", "f"), ("b.ts", "g", "nothing")], "file string, caller string, callee string")
    names = spark.createDataFrame([("a.ts", "g", "b.ts::g"), ("a.ts", "B", "b.ts")], "file string, local string, target string")
    assert {(r.src, r.dst) for r in graph.call_edges(c, names, v).collect()} == {("a.ts::f", "b.ts::g"), ("a.ts", "b.ts::g")}


def test_similarity(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pairs = v.alias("a").join(v.alias("b"), F.col("a.vec_id") < F.col("b.vec_id")).select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"), F.col("a.embedding").alias("x"), F.col("b.embedding").alias("y"))
    want = {(r.i, r.j) for r in pairs.withColumn("s", similarity.cosine("x", "y")).where("s >= 0.4").collect()}
    for block in (1024, 7):
        similarity.BLOCK = block
        got = {(r.a, r.b) for r in similarity.similar_pairs(v, 0.4).collect()}
        assert got == want
    similarity.BLOCK = 1024


def test_refinement(spark):
    f = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "c"), ("g3", "d")], "group_id string, path string")
    moves = spark.createDataFrame([(1, "a", "g1", "g2"), (2, "a", "g1", "g3"), (3, "c", "g9", "g1")], "ord int, path string, from_group string, to_group string")
    assert {tuple(r) for r in refine.reclassify(f, moves).collect()} == {("g3", "a"), ("g1", "b"), ("g2", "c"), ("g3", "d")}
    half = spark.createDataFrame([("g1", 1, "a")], "source string, new_ord int, path string")
    assert {tuple(r) for r in refine.split(f, half).collect()} == {tuple(r) for r in f.collect()}
    whole = spark.createDataFrame([("g1", 1, "a"), ("g1", 2, "b")], "source string, new_ord int, path string")
    assert ("group_refined_2", "b") in {tuple(r) for r in refine.split(f, whole).collect()}
    m = spark.createDataFrame([(1, 0, "g2"), (1, 1, "g3")], "merge_ord int, pos int, group_id string")
    assert {tuple(r) for r in refine.merge(f, m).collect()} == {("g1", "a"), ("g1", "b"), ("g2", "c"), ("g2", "d")}


def test_output(spark):
    ranked = spark.createDataFrame([(1, "g1", "one", 0.5, 1), (1, "g2", "two", 0.4, 2)], "diff_id long, group_id string, name string, score double, review_order long")
    files = spark.createDataFrame([(1, "g1", "b", 1, "Test", 1, 0), (1, "g1", "a", 0, "Handler", 2, 1)], "diff_id long, group_id string, path string, flow_position long, role string, additions long, deletions long")
    edges = spark.createDataFrame([(1, "g1", "a", "b", "Calls")], "diff_id long, group_id string, src string, dst string, edge_type string")
    out = json.loads(output.to_json(output.nested(ranked, files, edges)).first().json)
    assert [g["group_id"] for g in out["groups"]] == ["g1", "g2"] and [x["path"] for x in out["groups"][0]["files"]] == ["a", "b"] and out["groups"][1]["files"] == []
    assert '"a" -->|Calls| "b"' in output.mermaid(edges).first().chart


def test_stores(spark, tmp_path):
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, text string")
    ch = spark.createDataFrame([("a", "x", 1, False), ("a", "y", 2, False), ("b", None, 1, True), ("c", "n", 1, False)], "id string, text string, ord long, deleted boolean")
    assert {tuple(r) for r in caches.upsert(store, ch, "id", "ord").collect()} == {("a", "y"), ("c", "n")}
    req = spark.createDataFrame([("k1",), ("k2",)], "key string")
    tape = spark.createDataFrame([("k1", "yes")], "key string, response string")
    assert {tuple(r) for r in caches.replay(req, tape, strict=False).collect()} == {("k1", "yes"), ("k2", None)}
    with pytest.raises(Exception, match="no recorded answer"):
        caches.replay(req, tape).collect()
    p = str(tmp_path / "h")
    caches.append_history(spark.createDataFrame([("t1", 0.5)], "run string, score double"), p)
    (tmp_path / "h" / "broken.json").write_text('{"run": "t2", "sco\n')
    assert [tuple(r) for r in caches.load_history(spark, p, "run string, score double").where("run is not null").collect()] == [("t1", 0.5)]


def test_parse_python_and_lines(spark):
    src = [
        ("m.py", "import a.b as c\nfrom ..x import y as z, w\n\n@deco\ndef f():\n    v = g(1)\n    return h.i(v)\n\nclass K(B):\n    async def m(self):\n        r = await q()\n"),
        ("bad.py", "def (:\n"), ("none.py", None),
        ("a.ts", "import { x } from './b'\nexport function load(id) {\n  const r = fetchIt(id) // call(1)\n  return r\n}\nexport const run = async (a) => {\n  go('f(x)')\n}\n"),
        ("m.go", 'import "net/http"\nfunc Serve() {\n\tx := http.NewMux()\n}\ntype T struct {\n}\n'), ("x.zig", "fn a() {}"),
    ]
    got = {r.path: r for r in parse.parse(spark.createDataFrame(src, "path string, source string")).collect()}
    m = got["m.py"]
    assert [(d.name, d.kind, d.start_line) for d in m.definitions] == [("f", "Function", 4), ("K", "Class", 9), ("m", "Function", 10)]
    assert [(i.source, [(n.name, n.alias) for n in i.names]) for i in m.imports] == [("a.b", [("a.b", "c")]), ("..x", [("y", "z"), ("w", None)])]
    assert {(c.callee, c.containing_function) for c in m.call_sites} >= {("g", "f"), ("h.i", "f"), ("q", "m")}
    assert {(a.variable, a.callee) for a in m.assignments} == {("v", "g"), ("r", "q")}
    assert got["bad.py"].error == "SyntaxError" and got["none.py"].error and not got["x.zig"].definitions
    t = got["a.ts"]
    assert [i.source for i in t.imports] == ["./b"] and {d.name for d in t.definitions} >= {"load", "run"} and {e.name for e in t.exports} == {"load", "run"}
    assert {(c.callee, c.containing_function) for c in t.call_sites} == {("fetchIt", "load"), ("go", "run")}
    assert {d.name: d.kind for d in got["m.go"].definitions} == {"Serve": "Function", "T": "Class"} and got["m.go"].imports[0].source == "net/http"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    stream = windows.distinct_events(windows.watched(spark, folder, events.schema), "3650 days")
    q = windows.counts(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in windows.counts(events, "1 hour").collect()}


def test_activity(spark):
    log = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False)], "job long, seq long, terminal boolean")
    assert {(r.job, r.seq) for r in activity.until_terminal(log, "job", "seq", "terminal").collect()} == {(1, 0), (1, 1), (2, 0)}
    lines = spark.createDataFrame([("j", 0, '{"type": "error", "message": "m"}'), ("j", 1, "plain")], "job_id string, seq long, line string")
    assert [(r.event_name, r.level, r.message) for r in activity.normalize_lines(lines).orderBy("seq").collect()] == [("error", "error", "m"), ("text", "info", "plain")]


def test_stem_merges_and_rescue(spark):
    g = spark.createDataFrame([(1, 1, "a/user.ts"), (1, 1, "a/x.ts"), (1, 2, "t/user.test.ts"), (1, 3, "t/pay.test.ts"), (1, 4, "b/pay.ts"), (1, 4, "b/cart.ts"), (1, 5, "t/cart.test.ts"), (1, 6, "c/index.ts"), (2, 2, "t/user.test.ts")], "diff_id long, group_id long, path string")
    got = {(r.diff_id, r.path): r.group_id for r in cluster.merge_by_stem(g).collect()}
    assert got[(1, "a/user.ts")] == got[(1, "t/user.test.ts")] == 1 and got[(1, "t/pay.test.ts")] == got[(1, "b/pay.ts")] == got[(1, "t/cart.test.ts")] == 4
    assert got[(1, "c/index.ts")] == 6 and got[(2, "t/user.test.ts")] == 2 and len(got) == 9
    grouped = spark.createDataFrame([(1, 1, "src/auth/login/a.ts"), (1, 1, "src/auth/login/b.ts"), (1, 2, "src/pay/card/x.ts")], "diff_id long, group_id long, path string")
    loose = spark.createDataFrame([(1, p) for p in ("src/auth/other/z.ts", "package.json", "docs/tutorial/intro.md", "docs/x.md", "zzz/q.ts", "src/schemas/card_pay.ts", "README.md")], "diff_id long, path string")
    to = {r.path: r.group_id for r in cluster.rescue(loose, grouped).collect()}
    assert to == {"src/auth/other/z.ts": 1, "package.json": None, "docs/tutorial/intro.md": 1, "docs/x.md": None, "zzz/q.ts": None, "src/schemas/card_pay.ts": 2, "README.md": None}


def test_comments(spark):
    c = spark.createDataFrame([("h", "2", "code", "g", "a.ts", 1, 3, "x = 1", "why\nso", "t2"), ("h", "1", "group", "g", None, None, None, None, "all", "t1")],
                              "analysis string, id string, type string, group_id string, file_path string, start_line int, end_line int, selected_code string, text string, created_at string")
    assert caches.export_comments(c).first().export == "g\n> all\n\na.ts:1-3\n```\nx = 1\n```\n> why\n> so"


def test_data_flow_of_parsed_files(spark):
    src = [("a.py", "def f():\n    x = load(1)\n    y = save(x, key=x)\n    done(y)\n"), ("b.ts", "function g() {\n  const r = fetchIt(id, 'a,b')\n  go(r, [1, 2])\n}\n")]
    p = parse.parse(spark.createDataFrame(src, "path string, source string"))
    got = {(r.file, r.producer, r.consumer, r.via) for r in graph.data_flow(*parse.data_flow_tables(p)).collect()}
    assert got == {("a.py", "load", "save", "x"), ("a.py", "save", "done", "y"), ("b.ts", "fetchIt", "go", "r")}
    assert {(r.path, r.name, r.family) for r in parse.symbols(p).collect()} == {("a.py", "f", "function"), ("b.ts", "g", "function"), ("b.ts", "r", "constant")}


def test_workspace_and_files(spark, tmp_path):
    from deltaloom.sources import files

    tree = {"packages/a/package.json": '{"name": "@m/a", "main": "./lib/x.js"}', "packages/a/lib/x.js": "x", "packages/b/package.json": '{"name": "@m/b"}', "packages/b/src/index.ts": "y",
            "other/package.json": '{"name": "o"}', "other/index.ts": "z", "broken/package.json": "{"}
    for p, t in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "bin.dat").write_bytes(b"\0\1")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    got = files.source_files(spark, str(tmp_path))
    assert {r.path: r.source for r in got.collect()} == tree
    assert {tuple(r) for r in files.workspace_packages(got).collect()} == {("@m/a", "packages/a/lib/x.js"), ("@m/b", "packages/b/src/index.ts"), ("o", "other/index.ts")}
    assert {r.package for r in files.workspace_packages(got, ["packages/*"]).collect()} == {"@m/a", "@m/b"}


def test_stored_graph_and_targets(spark, tmp_path):
    from deltaloom.sources import files

    v = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b", "Calls"), ("a", "b", "Calls"), ("a", "c", "Calls")], "src string, dst string, edge_type string")
    files.save_graph(v, e, str(tmp_path / "g"))
    assert files.load_graph(spark, str(tmp_path / "g"))[1].count() == 2
    (tmp_path / "more").mkdir()
    (tmp_path / "t.toml").write_text('include_dir = "more"\n[[repos]]\nname = "one"\nlanguage = "go"\n')
    (tmp_path / "more/b.toml").write_text('[[repos]]\nname = "two"\n')
    assert [r.name for r in files.targets(spark, str(tmp_path / "t.toml")).collect()] == ["one", "two"]
    (tmp_path / "more/c.toml").write_text('[[repos]]\nname = "two"\n')
    with pytest.raises(ValueError):
        files.targets(spark, str(tmp_path / "t.toml"))


def test_review(spark):
    from deltaloom.operators import review

    a = spark.createDataFrame([(1, c, 4, 4.0) for c in "abcde"] + [(2, "a", 6, 2.0)], "answer_id int, criterion string, score int, overall double")
    assert {(r.answer_id, r.problem) for r in review.judge_problems(a).collect()} == {(2, "score out of range"), (2, "criterion missing"), (2, "overall off the mean")}
    b = spark.createDataFrame([(1, "a", "g1"), (1, "b", "g1")], "diff_id long, path string, group_id string")
    c = spark.createDataFrame([(1, "a", "g1"), (1, "b", "g2"), (1, "c", "g2")], "diff_id long, path string, group_id string")
    assert {(r.path, r.from_group, r.to_group) for r in review.moved_files(b, c).collect()} == {("b", "g1", "g2"), ("c", None, "g2")}
    g = spark.createDataFrame([(1, "g1", "n", 1)], "diff_id long, group_id string, name string, review_order long")
    out = json.loads(review.refinement_request(g, b, b.where("false")).first().request)
    assert out["groups"][0]["files"] == ["a", "b"] and out["infrastructure"] == []
