"""Operators without a SQL form against plain Python that takes one step at a time."""

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.functions import paths
from deltaloom.operators import cluster, similarity
from deltaloom.plans import catalogue
from deltaloom.plans.adapters import changed_files

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def split(spark):
    return catalogue._split(spark, SF)


def facts(df):
    docs = F.sum(paths.is_root_docs_page("path").cast("int")).over(cluster.Window.partitionBy("diff_id"))
    f = df.select("diff_id", "path").distinct().withColumn("root_docs", docs)
    return {(r.diff_id, r.path): r for r in f.select(
        "diff_id", "path", paths.category("path").alias("kind"), paths.is_config_like("path").alias("like"), paths.is_doc_fallback("path", F.col("root_docs")).alias("fallback"),
        paths.topic_tokens("path").alias("topics"), paths.is_fixture_source("path").alias("fixture"), paths.is_fixture_project("path").alias("project"),
        paths.fixture_root("path").alias("root"), paths.bare_stem("path").alias("stem"), paths.is_test_file("path").alias("test")).collect()}


def folder(path):
    return path.rsplit("/", 1)[0] if "/" in path else "."


def unique_best(counts):
    top = max(counts.values(), default=0)
    best = [g for g, n in counts.items() if n == top and n]
    return best[0] if len(best) == 1 else None


def test_rescue(spark, split):
    loose, grouped = split
    loose, grouped = loose.cache(), grouped.cache()
    mine, known = facts(loose), facts(grouped)
    groups = defaultdict(lambda: defaultdict(list))
    for r in grouped.collect():
        groups[r.diff_id][r.group_id].append(r.path)
    want = {}
    for diff in {d for d, _ in mine}:
        held = dict(sorted(groups[diff].items()))

        def nearest(path):
            best, deep = None, 1
            for g, members in held.items():
                for other in members:
                    n = 0
                    for a, b in zip(path.split("/")[:-1], other.split("/")[:-1]):
                        if a != b:
                            break
                        n += 1
                    if n > deep:
                        best, deep = g, n
            return best

        def topic(path):
            own = set(mine[diff, path].topics)
            score = {g: max(len(own & set(known[diff, m].topics)) for m in members) for g, members in held.items()}
            top = max(score.values(), default=0)
            best = [g for g, n in score.items() if n == top]
            return best[0] if top >= 2 or (top == 1 and len(best) == 1) else None

        largest = max(held, key=lambda g: (len(held[g]), g)) if held else None
        memo = {}
        for path in sorted(p for d, p in mine if d == diff):
            f = mine[diff, path]
            by_root = unique_best({g: sum(known[diff, m].fixture and known[diff, m].root == f.root for m in members) for g, members in held.items()}) if f.root else None
            if f.fixture:
                memo[f.root] = want[diff, path] = next((x for x in (memo.get(f.root), by_root, nearest(path), largest) if x is not None), None)
        for path in sorted(p for d, p in mine if d == diff and not mine[d, p].fixture):
            f = mine[diff, path]
            by_root = unique_best({g: sum(known[diff, m].fixture and known[diff, m].root == f.root for m in members) for g, members in held.items()}) if f.root else None
            if f.project and (memo.get(f.root) is not None or by_root is not None):
                to = memo.get(f.root) if memo.get(f.root) is not None else by_root
            elif f.kind == "Documentation":
                to = topic(path)
                to = largest if to is None and f.fallback else to
            elif f.kind in ("Schema", "Generated"):
                to = topic(path)
            elif f.kind != "Unclassified" or f.like:
                to = None
            else:
                to = nearest(path)
                to = topic(path) if to is None else to
                if to is None and path.rsplit(".", 1)[-1].lower() in ("c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "h++"):
                    to = unique_best({g: sum(folder(m) == folder(path) for m in members) for g, members in held.items()})
            want[diff, path] = to
    got = {(r.diff_id, r.path): r.group_id for r in cluster.rescue(loose, grouped).collect()}
    assert got == want and len({v for v in got.values()}) > 3


def test_fixture_trees_go_together(spark):
    grouped = spark.createDataFrame([(1, 1, "tests/fixtures/shop/a.ts"), (1, 1, "tests/fixtures/shop/b.ts"), (1, 2, "tests/fixtures/shop/c.ts"), (1, 3, "src/x/y.ts")], "diff_id long, group_id long, path string")
    loose = spark.createDataFrame([(1, p) for p in ("tests/fixtures/shop/d.ts", "tests/fixtures/shop/package.json", "tests/fixtures/bank/z.py", "tests/fixtures/bank/tsconfig.base.json", "tests/fixtures/note.ts")], "diff_id long, path string")
    got = {r.path: r.group_id for r in cluster.rescue(loose, grouped).collect()}
    assert got["tests/fixtures/shop/d.ts"] == got["tests/fixtures/shop/package.json"] == 1
    assert got["tests/fixtures/bank/z.py"] == got["tests/fixtures/bank/tsconfig.base.json"] == 1  # the nearest directory's first group
    assert paths is not None and got["tests/fixtures/note.ts"] == 1


def test_stem_merges(spark, split):
    grouped = split[1].cache()
    known = facts(grouped)
    now = defaultdict(set)
    for r in grouped.collect():
        now[r.diff_id, r.group_id].add(r.path)
    while True:
        where = defaultdict(set)
        for (d, g), members in now.items():
            for p in members:
                if known[d, p].stem:
                    where[d, known[d, p].stem].add((g, known[d, p].test))
        pair = next(((d, gs) for (d, _), gs in sorted(where.items()) if len({g for g, _ in gs}) == 2 and {t for _, t in gs} == {True, False}
                     and min(g for g, t in gs if t) != min(g for g, t in gs if not t)), None)
        if pair is None:
            break
        d, gs = pair
        a, b = sorted({g for g, _ in gs})
        now[d, a] |= now.pop((d, b))
    got = defaultdict(set)
    for r in cluster.merge_by_stem(grouped).collect():
        got[r.diff_id, r.group_id].add(r.path)
    parts = lambda x: {(d, frozenset(v)) for (d, _), v in x.items()}
    assert parts(got) == parts(now)


def test_merges_by_directory(spark):
    rows = [(1, 1, "a/x"), (1, 2, "a/y"), (1, 2, "b/y"), (1, 3, "b/z"), (1, 4, "c/z"), (1, 5, "c/q"), (1, 6, "top"), (2, 9, "a/x"), (3, 1, "k/0"), *[(3, 2, f"k/{i}") for i in range(1, 8)]]
    got = defaultdict(set)
    for r in cluster.merge_by_directory(spark.createDataFrame(rows, "diff_id long, group_id long, path string")).collect():
        got[r.diff_id, r.group_id].add(r.path)
    assert {k: len(v) for k, v in got.items()} == {(1, 1): 4, (1, 4): 2, (1, 6): 1, (2, 9): 1, (3, 1): 1, (3, 2): 7}


def test_consolidation(spark):
    files = [(r.diff_id, r.path) for r in changed_files(spark, SF).select("diff_id", "path").distinct().collect()]
    want = {}
    for diff in {d for d, _ in files}:
        own = defaultdict(list)
        for p in sorted(p for d, p in files if d == diff):
            own[folder(p)].append(p)
        groups = [(name, members) for name, members in sorted(own.items())]
        for depth in range(6, -1, -1):
            prefix = lambda p: ("" if "/" not in p else None) if depth == 0 else ("/".join(p.split("/")[:depth]) if len(p.split("/")) > depth else None)  # noqa: B023, E731
            buckets = defaultdict(list)
            for i, (name, members) in enumerate(groups):
                seen = {prefix(p) for p in members}
                if len(members) <= cluster.SMALL_GROUP and len(seen) == 1 and None not in seen:
                    buckets[seen.pop()].append(i)
            lead = {}
            for at in buckets.values():
                if len(at) <= cluster.MERGED_AT_ONCE:
                    parts = [at]
                else:
                    by = defaultdict(list)
                    for i in at:
                        first = min(groups[i][1])
                        by[folder(first) if "/" in first else first].append(i)
                    parts = by.values()
                for part in parts:
                    for i in part:
                        lead[i] = min(part)
            merged = defaultdict(list)
            for i, (name, members) in enumerate(groups):
                merged[lead.get(i, i)] += members
            groups = sorted(((groups[i][0], m) for i, m in merged.items()), key=lambda g: g[0])
        for name, members in groups:
            for p in members:
                want[diff, p] = name
    got = {(r.diff_id, r.path): r.name for r in catalogue.QUERIES["consolidate_all"](spark, SF).collect()}
    assert got == want and len(set(got.values())) < len({folder(p) for _, p in files})


def test_greedy_merge(spark):
    rows = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.vec_id < 240]
    by = defaultdict(list)
    for v, label, e in rows:
        by[label, v // 3].append(e)
    want = {}
    for diff in {d for d, _ in by}:
        groups = {g: ([sum(x) for x in zip(*m)], len(m), [g]) for (d, g), m in sorted(by.items()) if d == diff}

        def alike(a, b):
            dot = sum(x * y for x, y in zip(a, b))
            n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            return dot / n if n else 0.0

        while True:
            small = [g for g, (_, n, _) in sorted(groups.items()) if n <= 5]
            best = max(((alike(groups[a][0], groups[b][0]), -i, -j, a, b) for i, a in enumerate(small) for j, b in enumerate(small) if i < j), default=None)
            if best is None or best[0] < 0.35:
                break
            a, b = best[3:]
            x, n, m = groups.pop(b)
            groups[a] = ([p + q for p, q in zip(groups[a][0], x)], groups[a][1] + n, groups[a][2] + m)
        for g, (_, _, members) in groups.items():
            for k in members:
                want[diff, k] = g
    df = spark.createDataFrame([(label, v // 3, e) for v, label, e in rows], "diff_id long, grp long, embedding array<double>")
    got = {(r.diff_id, r.grp): r.merged for r in similarity.greedy_merge(df, 0.35).collect()}
    assert got == want and Counter(got.values()).most_common(1)[0][1] > 1


def test_greedy_merge_copies_and_nulls(spark):
    # copies are merged in the order of ids; no group goes for a null in its vector, its id or its change's id
    one, other = [1.0, 2.0, 2.0], [2.0, -2.0, 1.0]
    rows = [(1, g, one) for g in (9, 3, 5, 7, 1, 11, 13)] + [(1, 4, None), (1, None, other), (1, 6, [0.0, None, 3.0])]
    rows += [(None, 1, other), (None, 2, other), (2, 1, None), *[(3, 1, one)] * 6, (3, 2, one), (3, 3, one), (3, 3, None)]
    df = spark.createDataFrame(rows, "diff_id long, grp long, embedding array<double>")
    want = {(1, g): 1 for g in (1, 3, 5, 7, 9, 11)} | {(1, g): g for g in (4, 6, 13, None)}
    want |= {(None, 1): 1, (None, 2): 1, (2, 1): 1, (3, 1): 1, (3, 2): 2, (3, 3): 2}
    got = similarity.greedy_merge(df, 0.8).collect()
    assert {(r.diff_id, r.grp): r.merged for r in got} == want and len(got) == len(want)


def test_greedy_merge_holds_no_matrix_of_pairs():
    rng = np.random.default_rng(5)

    def stepwise(x, n, threshold, small):
        x, n, into, alive = x.copy(), n.tolist(), np.arange(len(x)), np.ones(len(x), bool)
        while True:
            some = [i for i in range(len(x)) if alive[i] and n[i] <= small]
            u = similarity._unit(x[some])
            s = np.round(u @ u.T, 12)
            s[np.tri(len(some), dtype=bool)] = -2
            p = int(s.argmax()) if len(some) > 1 else -1
            if p < 0 or s.flat[p] < threshold:
                return into
            a, b = some[p // len(some)], some[p % len(some)]
            x[a], n[a], alive[b] = x[a] + x[b], n[a] + n[b], False
            into[into == b] = a

    for k in range(60):  # whole numbers: with copies, opposites and zeros
        m, d = rng.integers(1, 60), rng.integers(1, 8)
        x, n = (rng.normal(size=(m, d)) if k % 2 else rng.integers(-1, 2, (m, d)).astype(float)), rng.integers(1, 8, m)
        threshold, small = rng.choice([-2, 0, 0.35, 0.75]), rng.integers(1, 12)
        assert (similarity._merge(x, n, threshold, small) == stepwise(x, n, threshold, small)).all()
    x, n = rng.normal(size=(10_000, 16)), np.ones(10_000, np.int64)  # similarities of all pairs would take 800 MB
    tracemalloc.start()
    into = similarity._merge(x, n, 0.75, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(set(into.tolist())) < 5000
