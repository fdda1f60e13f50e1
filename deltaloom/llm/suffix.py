"""Exact removal of repeated byte strings by bounded interval expansion.

A byte goes if a string of ``length`` (200) bytes that covers it also starts
anywhere else in the corpus. Two equal strings must meet, so:

1. Winnowing. Of the 64-byte grams in each 200-byte window the one with the
   least hash (the last of equals) is the window's anchor. Equal windows have
   equal anchors. Windows in a row with one anchor make a segment. Only
   anchors that occur twice matter further.
2. Segments that are equal as a whole (128-bit digest) are covered wholly.
3. The distinct segments of an anchor are brought together. Their
   Burrows-Wheeler transform is built, and backward extension, breadth first,
   derives the longest common prefixes by increasing value: the suffixes that
   start with ``cw`` have a boundary wherever the occurrences of ``c`` before
   them are parted by a boundary among the suffixes that start with ``w``. It
   stops at ``length``: what no boundary parts by then shares that many bytes.
4. An anchor with more than ``BLOCK_SEGMENTS`` distinct segments would make a
   block without bound. The windows of its segments are compared by 128-bit
   digests, counted map-side first. This is exact too; no window is dropped.
5. Covered spans are merged per document and cut out.

Only documents that hold a repeated anchor move their (compressed) text on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, trimmed

LENGTH = 200
GRAM = 64
BLOCK_SEGMENTS = 2048
BLOCK_SYMBOLS = 600_000
#: windows of one document that are winnowed at a time; memory is some 60 bytes for each
STRETCH = 1 << 22
_PLACE = 24

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)


def _grams(a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams by doubling the length."""
    h, n, i = _BYTE[a], 1, 0
    while n < k:
        m = min(n, k - n)
        h = h[:-m] * _STEP[i] + h[m:]
        n, i = n + m, i + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n < w:
        m = min(n, w - n)
        x = np.minimum(x[:-m], x[m:])
        n += m
    return x


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text index, start, windows, anchor) of all segments, as arrays."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate(([0], np.cumsum(sizes)))
    if len(buf) < length:
        return (np.zeros(0, np.int64),) * 4
    h = _grams(buf, gram)
    mask = np.uint64((1 << _PLACE) - 1)
    key = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    anchor = (mask - (_sliding_least(key, length - gram + 1) & mask)).astype(np.int64)
    delta = np.zeros(len(buf) + 1, np.int64)
    whole = sizes >= length
    np.add.at(delta, off[:-1][whole], 1)
    np.add.at(delta, off[1:][whole] - length + 1, -1)
    v = np.flatnonzero(np.cumsum(delta)[:len(anchor)])  # windows that lie within one text
    if not len(v):
        return (np.zeros(0, np.int64),) * 4
    q = anchor[v]
    cut = np.flatnonzero((q[1:] != q[:-1]) | (v[1:] != v[:-1] + 1)) + 1
    s = v[np.concatenate(([0], cut))]
    n = np.diff(np.concatenate(([0], cut, [len(v)])))
    text = np.searchsorted(off, s, "right") - 1
    return text, s - off[text], n, h[anchor[s]].view(np.int64)


def _winnow(length: int):
    def run(batches):
        for b in batches:
            rids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            group: list = []
            held = 0

            def out(group):
                t, s, n, a = segments([x for _, _, x in group], length)
                rid = np.array([r for r, _, _ in group], np.int64)
                base = np.array([o for _, o, _ in group], np.int64)
                return pa.RecordBatch.from_arrays([pa.array(rid[t]), pa.array((s + base[t]) * 256 + n), pa.array(a)], ["rid", "at", "anchor"])

            for rid, text in zip(rids, texts):
                for o in range(0, max(1, len(text) - length + 1), STRETCH):  # a very long text in stretches that share length - 1 bytes
                    part = text[o:o + STRETCH + length - 1]
                    if held + len(part) > STRETCH + length - 1 and group:
                        yield out(group)
                        group, held = [], 0
                    group.append((rid, o, part))
                    held += len(part)
            if group:
                yield out(group)

    return run


def _compress(batches):
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [z.compress(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["rid", "z"])


def _digests(length: int):
    """(anchor, d1, d2, rid, at) of the listed segments of each text."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                text, at = z.decompress(b.column(1)[i].as_py()), np.array(b.column(2)[i].as_py(), np.int64)
                d = b"".join([xxhash.xxh3_128_digest(text[s:s + n + length - 1]) for s, n in zip((at >> 8).tolist(), (at & 255).tolist())])
                d = np.frombuffer(d, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column(3)[i].values, pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(len(at), b.column(0)[i].as_py())), pa.array(at)],
                    ["anchor", "d1", "d2", "rid", "at"])

    return run


def _cut_out(length: int):
    """(anchor, hot, single, rid, at, bytes) of the representatives listed for each text."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                text, reps = z.decompress(b.column(1)[i].as_py()), b.column(2)[i].as_py()
                rows = [(r["anchor"], r["hot"], r["single"], r["at"], text[r["at"] >> 8:(r["at"] >> 8) + (r["at"] & 255) + length - 1]) for r in reps]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.bool_()),
                     pa.array([b.column(0)[i].as_py()] * len(rows), pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                    ["anchor", "hot", "single", "rid", "at", "bytes"])

    return run


def _suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling from seven symbols of nine bits."""
    n = len(x)
    padded = np.concatenate((x, np.zeros(7, np.int64)))
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i:i + n]
    h = 7
    while True:
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new + 1
        after = np.zeros(n, np.int64)
        if h < n:
            after[:-h] = rank[h:]
        key = rank * (n + 1) + after
        h *= 2


def repeated_starts(x: np.ndarray, length: int) -> np.ndarray:
    """Which places of the symbol array start ``length`` symbols that start elsewhere too.

    ``x`` holds small positive integers. Boundaries of the suffix array are
    found by increasing common prefix: level 0 parts the first symbols; a
    boundary found at one level is extended backwards by each symbol that
    occurs in the interval it opens, at the symbol's first occurrence there.
    """
    x = np.append(x, 0)  # the end, least and alone of its kind
    n = len(x)
    flags = np.zeros(n, bool)
    if n < 3:
        return flags[:-1]
    sa = _suffix_array(x)
    bwt = x[sa - 1].astype(np.uint16)
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    before = np.full(n, -1, np.int64)  # the place of the same symbol's last occurrence in the transform
    same = bwt[by[1:]] == bwt[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    apart = np.zeros(n + 1, bool)
    first = x[sa]
    apart[0] = apart[n] = True
    apart[1:n] = first[1:] != first[:-1]
    new = np.flatnonzero(apart[:n])
    for _ in range(1, length):
        ends = np.flatnonzero(apart)
        size = ends[np.searchsorted(ends, new, "right")] - new
        total = int(size.sum())
        if not total:
            break
        opened = np.repeat(new, size)
        q = opened + np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        k = lf[q[before[q] < opened]]
        k = k[~apart[k]]
        if not len(k):
            break
        apart[k] = True
        new = np.sort(k)
    shared = ~apart[:n]
    shared[:-1] |= ~apart[1:n]
    flags[sa[shared]] = True
    return flags[:-1]


def _spans(starts: np.ndarray, length: int):
    """Runs of flagged starts -> (first byte, end byte) of what they cover."""
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))] + length


def _expand(length: int):
    """Blocks of whole anchors -> covered spans of the segments that occur once."""

    def block(anchor, single, rid, at, data):
        sizes = np.array([len(d) + 1 for d in data])
        ends = np.cumsum(sizes)
        x = np.frombuffer(b"".join([d + b"\0" for d in data]), np.uint8).astype(np.int64) + 2
        x[ends - 1] = 1  # parts the segments; no text byte maps to it
        flags = repeated_starts(x, length)
        out: list = [[], [], []]
        for i in np.flatnonzero(single):
            a = np.flatnonzero(flags[ends[i] - sizes[i]:ends[i] - sizes[i] + (at[i] & 255)])
            if len(a):
                s, e = _spans(a + (at[i] >> 8), length)
                out[0].append(np.full(len(s), rid[i]))
                out[1].append(s)
                out[2].append(e)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["rid", "s", "e"])

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        size = 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for row in zip(*cols):
                if size > BLOCK_SYMBOLS and row[0] != held[0][-1]:
                    yield from block(*held)
                    held, size = [[], [], [], [], []], 0
                for c, v in zip(held, row):
                    c.append(v)
                size += len(row[4])
        if held[0]:
            yield from block(*held)

    return run


def _windows(length: int):
    """(w1, w2, rid, pos, single) of every window of the segments of a hot anchor."""

    def run(batches):
        for b in batches:
            for single, rid, at, data in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                n = at & 255
                d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i:i + length]) for i in range(n)]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(n, rid)), pa.array((at >> 8) + np.arange(n)), pa.array(np.full(n, single))],
                    ["w1", "w2", "rid", "pos", "single"])

    return run


def _remove(length: int):
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i in range(b.num_rows):
                text = z.decompress(b.column(1)[i].as_py())
                kept, last, gone, runs = [], 0, 0, 0
                for s, e in sorted((r["s"], r["e"]) for r in b.column(2)[i].as_py()):
                    if s > last or not runs:
                        kept.append(text[last:s])
                        gone, runs, last = gone + e - s, runs + 1, e
                    elif e > last:
                        gone, last = gone + e - last, e
                kept.append(text[last:])
                for c, v in zip(out, (b.column(0)[i].as_py(), gone, runs, b"".join(kept))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                ["cut_rid", "cut_bytes", "cut_runs", "kept"])

    return run


def covered_spans(docs: DataFrame, length: int, block_segments: int) -> tuple[DataFrame, DataFrame]:
    """``(rid, s, e)`` byte spans to remove, and ``(rid, z)`` texts that may have some."""
    segs = materialize(docs.select("rid", "text").mapInArrow(trimmed(_winnow(length)), "rid long, at long, anchor long"))
    # written out, so that the join below reads two plain exchanges and its hot anchors can be split
    twice = materialize(segs.groupBy(F.col("anchor").alias("again")).count().where("count > 1").select("again"))
    listed = (
        segs.join(twice, F.col("anchor") == F.col("again")).groupBy(F.col("rid").alias("l_rid"))
        .agg(F.collect_list(F.struct("at", "anchor")).alias("l"))  # bounded by the text's own length
        .select("l_rid", F.col("l.at").alias("at"), F.col("l.anchor").alias("anchor"))
    )
    packed = docs.select("rid", "text").mapInArrow(trimmed(_compress), "rid long, z binary")
    texts = materialize(packed.join(listed, F.col("rid") == F.col("l_rid")).select("rid", "z", "at", "anchor"))
    rows = materialize(texts.mapInArrow(trimmed(_digests(length)), "anchor long, d1 long, d2 long, rid long, at long"))
    distinct = materialize(rows.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("first")))
    copies = distinct.where("n > 1").select(F.col("anchor").alias("c"), F.col("d1").alias("c1"), F.col("d2").alias("c2"))
    s = F.shiftright("at", 8)
    whole = rows.join(copies, (F.col("anchor") == F.col("c")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))).select(
        "rid", s.alias("s"), (s + F.col("at").bitwiseAND(255) + (length - 1)).alias("e"))
    mixed = materialize(distinct.groupBy(F.col("anchor").alias("m")).agg(F.count("*").alias("k")).where("k > 1"))
    reps = (
        distinct.join(mixed, F.col("anchor") == F.col("m"))
        .groupBy(F.col("first.rid").alias("r_rid"))
        .agg(F.collect_list(F.struct("anchor", (F.col("k") > block_segments).alias("hot"), (F.col("n") == 1).alias("single"), F.col("first.at").alias("at"))).alias("reps"))
    )
    cut = materialize(texts.join(reps, F.col("rid") == F.col("r_rid")).select("rid", "z", "reps").mapInArrow(
        trimmed(_cut_out(length)), "anchor long, hot boolean, single boolean, rid long, at long, bytes binary"))
    columns = ["anchor", "single", "rid", "at", "bytes"]
    matched = (
        cut.where("not hot").select(*columns).repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(trimmed(_expand(length)), "rid long, s long, e long")
    )
    windows = cut.where("hot").select(*columns).mapInArrow(trimmed(_windows(length)), "w1 long, w2 long, rid long, pos long, single boolean")
    windows = materialize(windows)
    again = materialize(windows.groupBy(F.col("w1").alias("a1"), F.col("w2").alias("a2")).count().where("count > 1").select("a1", "a2"))
    exact = windows.where("single").join(again, (F.col("w1") == F.col("a1")) & (F.col("w2") == F.col("a2"))).select(
        "rid", F.col("pos").alias("s"), (F.col("pos") + length).alias("e"))
    return whole.unionByName(matched).unionByName(exact), texts.select("rid", "z")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block_segments: int = BLOCK_SEGMENTS, texts: bool = False
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row for each input row.

    With ``texts`` also ``kept``, the remaining bytes (binary, as a cut may
    part a character). A null text is empty: nothing is removed. Repeated rows
    are copies of one another like any other two rows, so if long enough they
    lose all. An empty table gives an empty table. Extra columns are pruned.
    """
    if not GRAM + 8 <= length <= GRAM + 254:  # a segment's windows are counted in eight bits
        raise ValueError(f"length from {GRAM + 8} to {GRAM + 254}")
    base = numbered(docs, id_col, text_col)
    spans, held = covered_spans(base, length, block_segments)
    merged = spans.groupBy(F.col("rid").alias("m_rid")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # bounded by the text's own length
    done = held.join(merged, F.col("rid") == F.col("m_rid")).select("rid", "z", "spans").mapInArrow(
        trimmed(_remove(length)), "cut_rid long, cut_bytes long, cut_runs long, kept binary")
    done = done.withColumn("cut_sha", F.sha2("kept", 256))
    done = done if texts else done.drop("kept")
    whole = base.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                        *[F.col("text").cast("binary").alias("whole")] * texts)
    out = whole.join(done, F.col("rid") == F.col("cut_rid"), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("cut_bytes", zero).alias("n_removed"), F.coalesce("cut_runs", zero).alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"), *[F.coalesce("kept", "whole").alias("kept")] * texts)
