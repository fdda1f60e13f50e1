"""A small repository from its commits to ranked groups."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from deltaloom.engine import Engine
from deltaloom.operators import entrypoints, output
from deltaloom.sources import config, git, parse


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(d), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (d / "README.md").write_text("# x\n")
    run("add", "-A")
    run("commit", "-qm", "base")
    files = {
        "src/routes/users.ts": "import { listUsers } from '../services/user'\nimport express from 'express'\nrouter.get('/users', list)\nexport function list(req) {\n  return listUsers()\n}\n",
        "src/services/user.ts": "import { find } from '../repo/user'\nexport function listUsers() {\n  return find()\n}\n",
        "src/repo/user.ts": "export function find() {\n  return db.query('x')\n}\n",
        "src/other/lone.ts": "export const a = 1\n", "package.json": "{}\n", "docs/guide.md": "text\n", "tests/user.test.ts": "import { listUsers } from '../src/services/user'\n",
    }
    for p, t in files.items():
        (d / p).parent.mkdir(parents=True, exist_ok=True)
        (d / p).write_text(t)
    (d / "bin.dat").write_bytes(b"\0\1")
    run("checkout", "-qb", "feature")
    run("add", "-A")
    run("commit", "-qm", "feature")
    (d / "new.py").write_text("a = 1\nb = 2\n")
    return str(d)


def test_git_sources(spark, repo):
    d = git.diff_refs(spark, repo, "main", "feature")
    rows = {r.new_path: r for r in d.collect()}
    assert len(rows) == 7 and "bin.dat" not in rows and rows["src/repo/user.ts"].additions == 3 and rows["src/repo/user.ts"].status == "Added"
    assert git.diff_range(spark, repo, "main..feature").count() == 7
    with pytest.raises(ValueError):
        git.diff_range(spark, repo, "main...x..y")
    assert [(r.new_path, r.additions) for r in git.diff_worktree(spark, repo).collect()] == [("new.py", 2)]
    empty = git.diff_refs(spark, repo, "feature", "feature")
    work, fell = git.with_worktree_fallback(spark, repo, empty)
    assert fell and work.count() == 1
    assert git.diff_merge_base(spark, repo, "main", "feature").count() == 7
    assert git.file_at(repo, "main", "README.md") == "# x\n" and git.file_at(repo, "main", "none") is None
    assert [(r.name, r.is_current) for r in git.branches(spark, repo).collect()] == [("feature", True), ("main", False)] and git.default_branch(repo) == "main"
    patch = git.file_diff(d, "src/repo/user.ts")
    assert patch.startswith("--- /dev/null\n+++ b/src/repo/user.ts\n@@ -0,0 +1,3 @@\n+export function find() {") and git.file_diff(d, "none") is None
    assert rows["src/repo/user.ts"].hunks[0].new_lines == 3 and rows["src/repo/user.ts"].new_content.startswith("export function find")
    assert git.current_branch(repo) == "feature" and git.workdir(repo).endswith(repo.rsplit("/", 1)[-1]) and not git.is_linked(repo)
    assert [(r.branch, r.is_main) for r in git.worktrees(spark, repo).collect()] == [("feature", True)]
    assert git.diff_staged(spark, repo).count() == 0 and git.diff_unstaged(spark, repo).count() == 0


def test_analysis(spark, repo):
    d = git.diff_refs(spark, repo, "main", "feature").withColumn("diff_id", F.lit(1).cast("long"))
    two = d.unionByName(d.withColumn("diff_id", F.lit(2).cast("long")))
    t = Engine().tables(two)
    files = {(r.diff_id, r.path): r for r in t["files"].collect()}
    infra = {(r.diff_id, r.path): r.category for r in t["infrastructure"].collect()}
    for k in (1, 2):
        one = {files[(k, p)].group_id for p in ("src/routes/users.ts", "src/services/user.ts", "src/repo/user.ts")}
        assert len(one) == 1 and files[(k, "src/routes/users.ts")].role == "Entrypoint" and files[(k, "src/repo/user.ts")].flow_position > 0
        assert infra[(k, "package.json")] == "Infrastructure" and infra[(k, "docs/guide.md")] == "Documentation"
        assert infra[(k, "src/other/lone.ts")] == "Unclassified"
        # every file once
        assert sorted([p for i, p in files if i == k] + [p for i, p in infra if i == k]) == sorted(r.new_path for r in d.collect())
    assert {r.files_accounted for r in Engine().evaluate(t).collect()} == {True}
    assert sum(len(r.files) for r in Engine().export_manifest(t).collect()) == len(files)
    out = output.to_json(Engine().analyze(two)).collect()
    assert len(out) == 2 and "users" in out[0].json
    orders = t["groups"].where("diff_id = 1").orderBy("review_order").collect()
    assert [r.review_order for r in orders] == list(range(1, len(orders) + 1)) and orders[0].score >= orders[-1].score


def test_entrypoints(spark):
    src = [
        ("app/api/x/route.ts", "export function GET(r) {\n}\nexport function helper() {\n}\n"), ("src/a.ts", "import express from 'express'\nfunction setup() {\n  app.get('/x', h)\n}\n"),
        ("api/views.py", "from flask import Flask\ndef show():\n    pass\ndef _hidden():\n    pass\n"), ("cmd/main.go", 'import "net/http"\nfunc main() {\n\thttp.HandleFunc("/", h)\n}\n'),
        ("src/test_x.py", "def test_one():\n    pass\n"), ("tests/helpers.ts", "x()\n"), ("src/jobs/w.ts", "import { Worker } from 'bullmq'\nexport function processJob() {\n}\n"), ("bin/tool.ts", "const x = 1\n"),
        ("app/controllers/users_controller.rb", "class UsersController\n  def index\n  end\n  def initialize\n  end\nend\n"), ("pages/home.tsx", "export default function Home() {\n}\n"), ("lib/plain.ts", "export const y = 2\n"),
    ]
    got = {(r.file, r.symbol): r.entrypoint_type for r in entrypoints.detect(parse.parse(spark.createDataFrame(src, "path string, source string"))).collect()}
    assert got[("app/api/x/route.ts", "GET")] == "HttpRoute" and ("app/api/x/route.ts", "helper") not in got
    assert got[("src/a.ts", "setup")] == "HttpRoute" and got[("api/views.py", "show")] == "HttpRoute" and ("api/views.py", "_hidden") not in got
    assert got[("cmd/main.go", "main")] == "HttpRoute" and got[("src/test_x.py", "test_one")] == "TestFile" and got[("tests/helpers.ts", "helpers")] == "TestFile"
    assert got[("src/jobs/w.ts", "processJob")] == "QueueConsumer" and got[("bin/tool.ts", "tool")] == "CliCommand"
    assert got[("app/controllers/users_controller.rb", "index")] == "HttpRoute" and got[("pages/home.tsx", "Home")] == "HttpRoute"
    assert not any(f == "lib/plain.ts" for f, _ in got)


def test_config(spark, tmp_path):
    assert config.load(str(tmp_path / "none.toml")) == config.DEFAULTS
    c = config.from_text('[ignore]\npaths = ["dist/**", "**/*.lock", "bad["]\n[layers]\nweb = "src/web/**"\napi = "src/**"\n[ranking]\nrisk = 0.5\n')
    assert c["ranking"]["risk"] == 0.5 and c["ranking"]["centrality"] == 0.25
    with pytest.raises(ValueError):
        config.from_text("[ranking]\nrisk = -1.0\n")
    rows = [("dist/a/b.js",), ("x/y.lock",), ("y.lock",), ("src/web/a.ts",), (".deltaloom/c",)]
    got = spark.createDataFrame(rows, "p string").select(config.is_ignored(F.col("p"), c).alias("i"), config.layer(F.col("p"), c).alias("l")).collect()
    assert [r.i for r in got] == [True, True, True, False, True] and got[3].l == "api"


def test_analysis_without_entry_points(spark):
    rows = [(5, None, p, None, "x = 1", 1, 0) for p in ("lib/a/one.rs", "lib/a/two.rs", "lib/b/three.rs", "deep/x/y/z.rs", "Makefile", "lib/a/one_test.rs".replace("_test", "_more"))]
    changes = spark.createDataFrame(rows, "diff_id long, old_path string, new_path string, old_content string, new_content string, additions long, deletions long")
    t = Engine().tables(changes)
    files = {r.path: r.group_id for r in t["files"].collect()}
    assert len(files) == 5 and files["lib/a/one.rs"] == files["lib/a/two.rs"] == files["lib/a/one_more.rs"]
    assert [r.path for r in t["infrastructure"].collect()] == ["Makefile"]
    assert Engine().analyze(changes.where("false")).collect() == []


def test_review_of_an_analysis(spark, repo):
    """A recorded answer splits a group; a change without an answer stays."""
    from deltaloom.sources import providers

    d = git.diff_refs(spark, repo, "main", "feature").withColumn("diff_id", F.lit(7).cast("long"))
    engine = Engine()
    t = engine.tables(d)
    first = t["files"].where("group_id = 'group_1'").orderBy("flow_position").collect()
    parts = [[first[0].path], [r.path for r in first[1:]]]
    said = json.dumps({"splits": [{"source_group_id": t["groups"].where("group_id = 'group_1'").first()["name"], "new_groups": [{"name": f"part {i}", "files": x} for i, x in enumerate(parts)]}]})
    out, warnings = engine.refine(t, providers.recorded(spark.createDataFrame([("7", said)], "key string, response string")))
    got = {(r.group_id, r.path) for r in out["files"].collect() if r.group_id.startswith("group_refined")}
    assert got == {("group_refined_1", parts[0][0]), *(("group_refined_2", p) for p in parts[1])}
    assert [r.reason.split(" -> ")[-1] for r in warnings.collect()] == ["group_1"]
    assert [r["name"] for r in out["groups"].orderBy("review_order").collect()][:2] == ["part 0", "part 1"]
    asked = spark.createDataFrame([("a", "hello"), ("b", "x")], "key string, prompt string")
    assert {r.key: r.response for r in providers.command("cat")(asked).collect()} == {"a": "hello", "b": "x"}
    assert all(r.response is None and r.error for r in providers.command("no-such-program-here")(asked).collect())
    with pytest.raises(ValueError):
        providers.command("cat; rm x")
    with pytest.raises(ValueError):
        providers.create(providers.Settings("http"))
