"""File changes of a git repository as a table.

The driver asks git twice for a comparison: which files differ, with the ids of
their blobs, and where (hunks and line counts, read line by line). Contents are
read where the rows are, by one ``cat-file`` process for each partition; the
repository lies on a path that all executors see.
"""

from __future__ import annotations

import difflib
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "old_path string, new_path string, old_content string, new_content string, hunks array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int>>, "
    "status string, additions bigint, deletions bigint, is_binary boolean"
)
_LISTED = "old_path string, new_path string, old_blob string, new_blob string, hunks array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int>>, status string, additions bigint, deletions bigint"
STATUS = {"A": "Added", "M": "Modified", "D": "Deleted", "R": "Renamed", "C": "Copied"}
#: files whose contents one partition reads
FILES_PER_PARTITION = 500
#: stands for the id of a blob that is not in the store: the file of the work tree
WORK = "work"


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout


def _decoded(raw: bytes | None) -> tuple[str | None, bool]:
    """The text of a blob, and whether it is binary: a zero byte or no UTF-8."""
    if raw is None:
        return None, False
    if b"\0" in raw:
        return None, True
    try:
        return raw.decode(), False
    except UnicodeDecodeError:
        return None, True


def _work(repo: str, path: str) -> bytes | None:
    try:
        with open(f"{repo}/{path}", "rb") as f:
            return f.read()
    except OSError:
        return None


class _Blobs:
    """One ``git cat-file --batch`` process, asked blob by blob."""

    def __init__(self, repo: str):
        self.process = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __call__(self, blob: str) -> bytes | None:
        self.process.stdin.write(f"{blob}\n".encode())
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) != 3:
            return None
        raw = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return raw

    def close(self):
        self.process.stdin.close()
        self.process.wait()


_HUNK = re.compile(rb"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _sections(repo: str, args: list[str]) -> Iterator[tuple[list, int, int]]:
    """Hunks, added and removed lines of each file of a patch, in its order; the patch is read as it comes."""
    with subprocess.Popen(["git", "-C", repo, "diff", "-U3", *args], stdout=subprocess.PIPE) as p:
        now, old, new = None, 0, 0
        for line in p.stdout:
            if old > 0 or new > 0:  # within a hunk
                c = line[:1]
                old, new = old - (c in b"- "), new - (c in b"+ ")
                now[1] += c == b"+"
                now[2] += c == b"-"
            elif m := _HUNK.match(line):
                four = tuple(int(x) if x is not None else 1 for x in m.groups())
                now[0].append(four)
                old, new = four[1], four[3]
            elif line.startswith(b"diff --git "):
                if now is not None:
                    yield tuple(now)
                now = [[], 0, 0]
        if now is not None:
            yield tuple(now)


def _listed(repo: str, args: list[str], renames: bool, untracked: bool) -> list[tuple]:
    flags = ["-M", "-C"] if renames else ["--no-renames"]
    raw = git(repo, "diff", "--raw", "-z", "--no-abbrev", *flags, *args).decode().split("\0")
    changed, i = [], 0
    while i + 1 < len(raw):
        _, _, old, new, code = raw[i].lstrip(":").split()
        moved = code[0] in "RC"
        paths = (raw[i + 1], raw[i + 2]) if moved else (raw[i + 1], raw[i + 1])
        i += 3 if moved else 2
        changed.append((code[0], *paths, old, new))
    rows, seen = [], set()
    blob = lambda x: WORK if not x.strip("0") else x
    for (code, a, b, old, new), (hunks, adds, dels) in zip(changed, _sections(repo, [*flags, *args])):
        if code not in STATUS:
            continue
        seen.add(b)
        rows.append((None if code == "A" else a, None if code == "D" else b, None if code == "A" else blob(old), None if code == "D" else blob(new),
            hunks, STATUS[code], adds, dels))
    if untracked:
        for p in git(repo, "ls-files", "--others", "--exclude-standard", "-z").decode().split("\0"):
            if p and p not in seen:
                rows.append((None, p, None, WORK, [], "Added", None, 0))
    return sorted(rows, key=lambda r: r[1] or r[0])


def _diff(spark: SparkSession, repo: str, args: list[str], renames: bool, untracked: bool) -> DataFrame:
    rows = _listed(repo, args, renames, untracked)
    parts = max(1, -(-len(rows) // FILES_PER_PARTITION))
    listed = spark.createDataFrame(rows, _LISTED).repartition(parts)

    def read(frames):
        blobs = _Blobs(repo)
        try:
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    both, binary = [], False
                    for path, blob in ((r.old_path, r.old_blob), (r.new_path, r.new_blob)):
                        text, no_text = _decoded(None if blob is None else _work(repo, path) if blob == WORK else blobs(blob))
                        binary |= no_text
                        both.append(text)
                    if binary or (r.additions is None or pd.isna(r.additions)) and both[1] is None:
                        continue
                    lines = r.additions
                    if lines is None or pd.isna(lines):  # an untracked file: all of its lines
                        lines = len(both[1].split("\n")) - both[1].endswith("\n") if both[1] else 0
                    out.append((r.old_path, r.new_path, *both, r.hunks, r.status, int(lines), int(r.deletions), False))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ("old_path", "new_path", "old_content", "new_content", "hunks", "status",
                    "additions", "deletions", "is_binary")])
        finally:
            blobs.close()

    return listed.mapInPandas(read, SCHEMA).orderBy(F.coalesce("new_path", "old_path"))


def diff_refs(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    return _diff(spark, repo, [base, head], True, False)


def diff_range(spark: SparkSession, repo: str, spec: str) -> DataFrame:
    parts = spec.split("..")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"not a range: {spec}")
    return diff_refs(spark, repo, *parts)


def diff_staged(spark: SparkSession, repo: str) -> DataFrame:
    return _diff(spark, repo, ["--cached"], False, False)


def diff_unstaged(spark: SparkSession, repo: str) -> DataFrame:
    return _diff(spark, repo, [], False, False)


def diff_worktree(spark: SparkSession, repo: str, base: str = "HEAD") -> DataFrame:
    """A tree against the work tree, untracked files included."""
    return _diff(spark, repo, [base], True, True)


def merge_base(repo: str, a: str, b: str) -> str:
    return git(repo, "merge-base", a, b).decode().strip()


def diff_merge_base(spark: SparkSession, repo: str, base: str, head: str, worktree: bool = False) -> DataFrame:
    root = merge_base(repo, base, head)
    return diff_worktree(spark, repo, root) if worktree else diff_refs(spark, repo, root, head)


def with_worktree_fallback(spark: SparkSession, repo: str, changes: DataFrame) -> tuple[DataFrame, bool]:
    """The comparison, or the work tree's changes if the comparison is empty and they are not."""
    if not changes.isEmpty():
        return changes, False
    work = diff_worktree(spark, repo)
    return (changes, False) if work.isEmpty() else (work, True)


def file_at(repo: str, ref: str, path: str) -> str | None:
    """The text of a file at a ref; null if there is none or it is binary."""
    try:
        return _decoded(git(repo, "show", f"{ref}:{path}"))[0]
    except subprocess.CalledProcessError:
        return None


def file_diff(changes: DataFrame, path: str, context: int = 3) -> str | None:
    """The unified diff of one file of a comparison, null if it did not change."""
    row = changes.where((F.col("new_path") == path) | (F.col("old_path") == path)).select("old_path", "new_path", "old_content", "new_content").first()
    if row is None:
        return None
    lines = lambda t: (t or "").splitlines(keepends=True)
    names = [f"a/{row.old_path}" if row.old_path else "/dev/null", f"b/{row.new_path}" if row.new_path else "/dev/null"]
    return "".join(x if x.endswith("\n") else f"{x}\n" for x in difflib.unified_diff(lines(row.old_content), lines(row.new_content), *names, n=context))


def current_branch(repo: str) -> str | None:
    """The branch that is checked out, null where the head is detached."""
    name = git(repo, "rev-parse", "--abbrev-ref", "HEAD").decode().strip()
    return None if name == "HEAD" else name


def workdir(repo: str) -> str:
    return git(repo, "rev-parse", "--show-toplevel").decode().strip()


def is_linked(repo: str) -> bool:
    """Whether the path is a linked work tree and not the main one."""
    own, common = (git(repo, "rev-parse", "--path-format=absolute", x).decode().strip() for x in ("--git-dir", "--git-common-dir"))
    return own != common


def worktrees(spark: SparkSession, repo: str) -> DataFrame:
    """``(path, head, branch, is_main)`` of all work trees, the main one first."""
    rows = []
    for block in git(repo, "worktree", "list", "--porcelain").decode().split("\n\n"):
        f = dict(x.partition(" ")[::2] for x in block.splitlines())
        if "worktree" in f:
            rows.append((f["worktree"], f.get("HEAD"), f.get("branch", "").removeprefix("refs/heads/") or None, not rows))
    return spark.createDataFrame(rows, "path string, head string, branch string, is_main boolean")


def branches(spark: SparkSession, repo: str) -> DataFrame:
    """``(name, is_current, has_upstream, ahead, behind)``, the current one first."""
    rows = []
    for line in git(repo, "for-each-ref", "--format=%(refname:short)%00%(HEAD)%00%(upstream:short)", "refs/heads").decode().splitlines():
        name, head, upstream = line.split("\0")
        ahead, behind = map(int, git(repo, "rev-list", "--left-right", "--count", f"{name}...{upstream}").split()) if upstream else (0, 0)
        rows.append((name, head == "*", bool(upstream), ahead, behind))
    rows.sort(key=lambda r: (not r[1], r[0]))
    return spark.createDataFrame(rows, "name string, is_current boolean, has_upstream boolean, ahead int, behind int")


def default_branch(repo: str) -> str | None:
    names = git(repo, "for-each-ref", "--format=%(refname:short)", "refs/heads").decode().split()
    return next((n for n in ("main", "master", "develop") if n in names), names[0] if names else None)
