"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of word characters. Documents and test items that
share a five-token seed are paired; of each pair the longest common unmarked
token strings are found by running Karp-Rabin hashes, marked in both, and the
search goes on among what is unmarked until no match of five tokens is left.
The tiles may lie in any order, so a reordered passage counts in full. A pair
is a finding if tiles cover at least ``COVERAGE`` of the item's tokens.

The seeds of the items are counted first. Up to ``BROADCAST_SEEDS`` they are
broadcast, and each document is scanned and tiled where it lies. Beyond that,
seeds meet in a shuffled join, and the texts of the pairs are joined to it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, trimmed, two_columns

SEED = 5
COVERAGE = 0.8
#: seed rows (item, place) that are broadcast; about 100 bytes each in a worker
BROADCAST_SEEDS = 1 << 20

_FOUND = ["rid", "doc_id", "item_id", "n_covered", "n_tokens"]
_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15


def tokenize(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of ``n`` symbols, by doubling."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    size = 1
    while size < n:
        m = min(size, n - size)
        h = h[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
        size += m
    return h


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Places where ``n`` unmarked symbols start."""
    c = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(c[n:] - c[:-n] == 0) if len(marked) >= n else np.zeros(0, np.int64)


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(start in item, start in doc, length)``, longest first.

    Among matches of one length the first in the item, then in the document,
    is marked first.
    """
    used_i, used_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []

    def matches(n: int):
        i, d = _free(used_i, n), _free(used_d, n)
        if not len(i) or not len(d):
            return []
        hi, hd = _rolling(item, n)[i], _rolling(doc, n)[d]
        d = d[np.isin(hd, hi)]
        if not len(d):
            return []
        where: dict[bytes, list[int]] = {}
        for y in d.tolist():
            where.setdefault(doc[y:y + n].tobytes(), []).append(y)
        return [(x, where[k]) for x in i.tolist() if (k := item[x:x + n].tobytes()) in where]  # the symbols themselves are compared

    low = least
    top = min(len(item), len(doc))
    while top >= low:
        best, found = 0, []
        a, b = low, top
        while a <= b:  # a match of n symbols holds one of n - 1
            n = (a + b) // 2
            if got := matches(n):
                best, found, a = n, got, n + 1
            else:
                b = n - 1
        if not best:
            break
        for x, places in found:
            if used_i[x:x + best].any():
                continue
            for y in places:
                if not used_d[y:y + best].any():
                    used_i[x:x + best] = used_d[y:y + best] = True
                    tiles.append((x, y, best))
                    break
        top = best
    return tiles


class _Items:
    """The broadcast form of the items: vocabulary, token ids and seed places."""

    def __init__(self, rows):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items, seeds, owners = [], [], [], []
        for item_id, tokens in rows:
            x = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens], np.int64)
            h = np.unique(_rolling(x, SEED))
            owners.append(np.full(len(h), len(self.items)))
            seeds.append(h)
            self.ids.append(item_id)
            self.items.append(x)
        seeds, owners = (np.concatenate(a) if a else np.zeros(0, np.uint64) for a in (seeds, owners))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], owners[order]

    def near(self, x: np.ndarray):
        """Items that share a seed with the document, and the places of their seeds in it."""
        h = _rolling(x, SEED)
        a, b = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        at = np.flatnonzero(b > a)
        found: dict[int, list[int]] = {}
        for p in at.tolist():
            for o in self.owners[a[p]:b[p]].tolist():
                found.setdefault(o, []).append(p)
        return found


def _around(x: np.ndarray, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that seeds cover, a symbol of its own between separate runs, and their places."""
    keep = np.zeros(len(x), bool)
    for p in places:
        keep[p:p + SEED] = True
    at = np.flatnonzero(keep)
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(x[at], cut, -1), np.insert(at, cut, -1)


def _scan(shared, coverage: float):
    def run(batches):
        items = shared.value
        get = items.vocabulary.get
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for rid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = tokenize(text)
                # words that no item has are all different from any item's word
                x = np.fromiter((get(w, -2) for w in words), np.int64, len(words))
                for o, places in items.near(x).items():
                    item = items.items[o]
                    tiles = tile(item, _around(x, places)[0])
                    covered = sum(t[2] for t in tiles)
                    if covered >= coverage * len(item):
                        for c, v in zip(out, (rid, doc_id, items.ids[o], covered, len(item))):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], _FOUND)

    return run


def _seed_rows(batches):
    """(rid, seed) of each text; tokens are hashed, as there is no common vocabulary."""
    import xxhash

    for b in batches:
        rids, seeds = [], []
        for rid, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            x = np.array([xxhash.xxh3_64_intdigest(w) for w in tokenize(text)], np.uint64)
            h = np.unique(_rolling(x, SEED))
            rids.append(np.full(len(h), rid))
            seeds.append(h.view(np.int64))
        if rids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rids), pa.int64()), pa.array(np.concatenate(seeds), pa.int64())], ["rid", "seed"])


def _tile_pairs(coverage: float):
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i in range(b.num_rows):
                rid, doc_id, item_id, text, item_text = (b.column(c)[i].as_py() for c in range(5))
                one = _Items([(item_id, tokenize(item_text))])
                x = np.array([one.vocabulary.get(w, -2) for w in tokenize(text)], np.int64)
                places = one.near(x).get(0)
                if places:
                    covered = sum(t[2] for t in tile(one.items[0], _around(x, places)[0]))
                    if covered >= coverage * len(one.items[0]):
                        for c, v in zip(out, (rid, doc_id, item_id, covered, len(one.items[0]))):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], _FOUND)

    return run


def _findings(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS, written: bool = False,
) -> DataFrame:
    """Findings with the row number; ``written``: ``docs`` is what ``numbered`` gave, so that the numbers mean something outside."""
    spark = docs.sparkSession
    tests = two_columns(benchmark, item_id_col, item_text_col)
    out = ", ".join(f"{c} long" for c in _FOUND)
    # no more seeds than half the characters: a bound that needs no Python
    size = tests.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size // 2 <= broadcast_seeds:
        items = spark.sparkContext.broadcast(_Items([(r.doc_id, tokenize(r.text)) for r in tests.collect()]))
        base = docs if written else two_columns(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
        return base.select("rid", "doc_id", "text").mapInArrow(trimmed(_scan(items, coverage)), out)
    tests = numbered(tests, "doc_id", "text")
    base = docs.select("rid", "doc_id", "text") if written else numbered(docs, id_col, text_col)
    wanted = materialize(tests.mapInArrow(trimmed(_seed_rows), "rid long, seed long")).withColumnRenamed("rid", "t_rid").withColumnRenamed("seed", "t_seed")
    pairs = (
        base.mapInArrow(trimmed(_seed_rows), "rid long, seed long").join(wanted, F.col("seed") == F.col("t_seed"))
        .select(F.col("rid").alias("p_rid"), "t_rid").distinct()
    )
    texts = tests.select(F.col("rid").alias("i_rid"), F.col("doc_id").alias("item_id"), F.col("text").alias("item_text"))
    return (
        pairs.join(texts, F.col("t_rid") == F.col("i_rid")).join(base, F.col("p_rid") == F.col("rid"))
        .select("rid", "doc_id", "item_id", "text", "item_text").mapInArrow(trimmed(_tile_pairs(coverage)), out)
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id, n_covered, n_tokens)``, a row for each finding.

    An item of fewer than five tokens has no seed and is found nowhere; nor is
    a null or empty text. Repeated rows of either table give repeated findings.
    A null id comes back null. Either table empty: an empty table. Extra
    columns are pruned. Options: ``coverage``, ``id_col``, ``text_col``,
    ``item_id_col``, ``item_text_col``, ``broadcast_seeds``.
    """
    return _findings(docs, benchmark, **options).drop("rid")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a test item, all columns as they are.

    Null and empty texts stay; so do all rows if ``benchmark`` is empty. Of
    repeated rows all go or none. Options as for ``contaminated``.
    """
    placed = numbered(docs, options.pop("id_col", "doc_id"), options.pop("text_col", "text"), rest=True)
    found = _findings(placed, benchmark, written=True, **options).select(F.col("rid").alias("found_rid")).distinct()
    return placed.join(found, F.col("rid") == F.col("found_rid"), "left_anti").select("row.*")
