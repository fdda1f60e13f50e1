"""Line dedup by pairwise alignment of overlapping documents.

Lines are hashed to 128 bits. Seeds are hashes of adjacent lines, joined until
they reach ``BLOCK_CHARS`` characters (a long line is a seed by itself): the
shortest run from each line on, and the shortest one up to each line. A seed
links each document that holds it to the first that does, the one with the
least ``(doc_id, row)``. That is enough, however common or rare a seed is:
any block of ``BLOCK_CHARS`` that a document shares with an earlier one is
covered by such seeds, and the first holder of each seed holds it as well. So
the pairs grow with the number of seeds and not with the square of a group.

Each pair is aligned by patience diff: lines that occur once in both, their
longest increasing run, and the same again between those; equal ends first,
and where no line occurs once in both, the longest common run. Then the seeds
that the order of the alignment left out, as their passage was moved or stands
in the later document several times, are matched wherever they stand. Common
blocks of at least ``BLOCK_CHARS`` characters are deleted from the later document.

So a line goes if and only if it stands in a run of adjacent lines of at least
``BLOCK_CHARS`` characters that an earlier document holds too. All is judged on
the input: a block may be deleted in favour of a document that loses it to a
yet earlier one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, trimmed

BLOCK_CHARS = 100
_ROWS = "rid long, doc_id long, lines array<binary>, sizes array<int>"


def _hash_lines(batches):
    digest = xxhash.xxh3_128_digest
    for b in batches:
        lines, sizes = [], []
        for t in b.column(2).cast(pa.binary()).to_pylist():
            own = [x.strip() for x in t.split(b"\n")]
            lines.append([digest(x) for x in own])
            sizes.append([len(x) for x in own])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(lines, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))],
            ["rid", "doc_id", "lines", "sizes"])


def _longest(a: list, b: list, i: int, m: int, j: int, n: int) -> tuple[int, int, int]:
    """Longest common run of ``a[i:m]`` and ``b[j:n]``, the first of them in b: ``(start in a, start in b, length)``.

    By the suffix automaton of ``a[i:m]``, in time linear in both.
    """
    step: list[dict] = [{}]
    link, length, end = [-1], [0], [i]
    last = 0
    for x in range(i, m):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(x + 1)
        p = last
        while p >= 0 and a[x] not in step[p]:
            step[p][a[x]] = new
            p = link[p]
        if p >= 0:
            q = step[p][a[x]]
            if length[q] > length[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and step[p].get(a[x]) == q:
                    step[p][a[x]] = twin
                    p = link[p]
                link[q] = q = twin
            link[new] = q
        last = new
    best, state, k = (i, j, 0), 0, 0
    for y in range(j, n):
        while state and b[y] not in step[state]:
            state = link[state]
            k = length[state]
        if b[y] in step[state]:
            state, k = step[state][b[y]], k + 1
        if k > best[2]:
            best = (end[state] - k, y + 1 - k, k)
    return best


def patience(a: list, b: list, sizes: list | None = None, least: int = 0) -> list[tuple[int, int, int]]:
    """Common blocks ``(start in a, start in b, length)`` of a patience diff, in order.

    With the ``sizes`` of b's lines, blocks that don't reach ``least`` may be left out.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i == m or j == n:
            continue
        once: dict = {}
        for x in range(i, m):
            once[a[x]] = -1 if a[x] in once else x
        seen: dict = {}
        for y in range(j, n):
            if once.get(b[y], -1) >= 0:
                seen[b[y]] = -1 if b[y] in seen else y
        shared = [(once[k], y) for k, y in seen.items() if y >= 0]  # by place in b
        if not shared:
            # the equal ends are gone, so that a block in here doesn't go on outside
            if sizes is None or sum(sizes[y] for y in range(j, n) if b[y] in once) >= least:
                x, y, k = _longest(a, b, i, m, j, n)
                if k:
                    pairs += [(x + z, y + z) for z in range(k)]
                    todo += [(i, x, j, y), (x + k, m, y + k, n)]
            continue
        tops: list[int] = []
        ends: list[int] = []
        back = [-1] * len(shared)
        for k, (x, _) in enumerate(shared):
            p = bisect_left(tops, x)
            back[k] = ends[p - 1] if p else -1
            if p == len(tops):
                tops.append(x)
                ends.append(k)
            else:
                tops[p], ends[p] = x, k
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(shared[k])
            k = back[k]
        for x, y in reversed(chain):
            todo.append((i, x, j, y))
            pairs.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, m, j, n))
    pairs.sort()
    blocks: list[list[int]] = []
    for x, y in pairs:
        if blocks and x == blocks[-1][0] + blocks[-1][2] and y == blocks[-1][1] + blocks[-1][2]:
            blocks[-1][2] += 1
        else:
            blocks.append([x, y, 1])
    return [tuple(z) for z in blocks]


def _spans(sizes: list[int], block_chars: int) -> list[tuple[int, int]]:
    """The shortest runs of lines from and up to each line that reach ``block_chars``."""
    to, n = list(accumulate(sizes, initial=0)), len(sizes)
    spans = {(s, bisect_left(to, to[s] + block_chars)) for s in range(n)} | {(bisect_right(to, to[e] - block_chars) - 1, e) for e in range(1, n + 1)}
    return sorted(x for x in spans if 0 <= x[0] < x[1] <= n)


def _seeds(block_chars: int):
    """``(rid, doc_id, seed, s, e)``: each seed of a document once, where it first stands."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for rid, doc_id, lines, sizes in zip(*(b.column(i).to_pylist() for i in range(4))):
                seen: set = set()
                for s, e in _spans(sizes, block_chars):
                    seed = digest(b"".join(lines[s:e]))
                    if seed not in seen:
                        seen.add(seed)
                        for c, v in zip(out, (rid, doc_id, seed, s, e)):
                            c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["rid", "doc_id", "seed", "s", "e"])

    return run


def common(a: list, b: list, sizes: list, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Line ranges of ``b``, which may overlap, that a pair's alignment finds in ``a``.

    ``seeds`` are ranges of b that a is known to hold; ``sizes`` those of b's lines.
    """
    if a == b:
        return [(0, len(b))] if sum(sizes) >= least else []
    found = [(s, s + n) for _, s, n in patience(a, b, sizes, least) if sum(sizes[s:s + n]) >= least]
    free = np.ones(len(b) + 1, bool)
    for s, e in found:
        free[s:e] = False
    where: dict = {}
    for y, x in enumerate(b):
        where.setdefault(x, []).append(y)
    for s, e in seeds:
        n = e - s
        for y in where[b[s]]:
            if free[y:y + n].any() and b[y:y + n] == b[s:e]:
                found.append((y, y + n))
    return found


def _align(block_chars: int):
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], []]
            for i in range(b.num_rows):
                rid, first, lines, sizes, seeds = (b.column(c)[i].as_py() for c in range(5))
                for s, e in common(first, lines, sizes, [(x["s"], x["e"]) for x in seeds], block_chars):
                    for c, v in zip(out, (rid, s, e)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["b_rid", "s", "e"])

    return run


def _delete(batches):
    for b in batches:
        texts, gone = [], []
        for t, blocks in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            own = t.split("\n")
            keep = np.ones(len(own), bool)
            for x in blocks or ():
                keep[x["s"]:x["e"]] = False
            texts.append("\n".join([x for x, k in zip(own, keep) if k]) if blocks else t)
            gone.append(int((~keep).sum()))
        cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), b.column(4), pa.array(gone, pa.int64()), *b.columns[5:]]
        yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "text", "n_lines", "n_removed", "row"][:len(cols)])


def common_blocks(base: DataFrame, block_chars: int) -> DataFrame:
    """``(b_rid, s, e)``: line ranges to delete; ``base`` has rid, doc_id, text and is written."""
    rows = materialize(base.select("rid", "doc_id", "text").mapInArrow(trimmed(_hash_lines), _ROWS))
    seeds = rows.mapInArrow(trimmed(_seeds(block_chars)), "rid long, doc_id long, seed binary, s int, e int")
    # written out, so that the join below reads two plain exchanges and a common seed's rows can be split
    firsts = materialize(
        seeds.groupBy(F.col("seed").alias("f_seed")).agg(F.min(F.struct("doc_id", "rid")).alias("f"), F.count("*").alias("n"))
        .where("n > 1").select("f_seed", F.col("f.rid").alias("f_rid")))
    # a pair's seeds are no more than twice the later document's lines
    pairs = (
        seeds.join(firsts, F.col("seed") == F.col("f_seed")).where("f_rid <> rid").select("f_rid", F.col("rid").alias("b_rid"), "s", "e")
        .groupBy("f_rid", "b_rid").agg(F.collect_list(F.struct("s", "e")).alias("seeds"))
    )
    pairs = materialize(pairs)
    early = rows.select(F.col("rid").alias("e_rid"), F.col("lines").alias("e_lines"))
    later = rows.select(F.col("rid").alias("l_rid"), F.col("lines").alias("l_lines"), "sizes")
    return (
        pairs.join(later, F.col("b_rid") == F.col("l_rid")).join(early, F.col("f_rid") == F.col("e_rid"))
        .select("b_rid", "e_lines", "l_lines", "sizes", "seeds").mapInArrow(trimmed(_align(block_chars)), "b_rid long, s int, e int")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, rows: bool = False) -> DataFrame:
    """``(rid, doc_id, text, n_lines, n_removed)``, one row for each input row.

    ``text`` is without the deleted lines; with ``rows`` also ``row``, the
    input's columns as a struct, whatever their names. ``rid`` is the number
    that the row got. ``n_lines`` counts what ``\\n`` parts, so an empty or null
    text is one empty line, which is never deleted; null texts come back empty.
    Lines are compared without white space at their ends. Of repeated rows the
    first stays, the others lose all blocks of ``block_chars``. A null id is
    earlier than any other. An empty table gives an empty table.
    """
    base = numbered(docs, id_col, text_col, rows)
    blocks = common_blocks(base, block_chars).groupBy("b_rid").agg(F.collect_list(F.struct("s", "e")).alias("blocks"))
    joined = base.join(blocks, F.col("rid") == F.col("b_rid"), "left").select(
        "rid", "doc_id", "text", "blocks", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), *["row"] * rows)
    out = joined.select("rid", "doc_id", "text", "n_lines", F.lit(0).cast("long").alias("n_removed"), *["row"] * rows).schema
    return joined.mapInArrow(trimmed(_delete), out)
