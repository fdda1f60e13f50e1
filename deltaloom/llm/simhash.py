"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most ``THRESHOLD`` = 4 bits differ in
at most one bit in one of three blocks (21 + 21 + 22 bits, padded to 22). In
the 22-bit space of a block the anchors are the codewords of the direct product
of the Hamming codes [15, 11] and [7, 4]: covering radius 1 + 1 = 2, 2**15
anchors. Each fingerprint has its nearest anchor as its home, and is replicated
to every anchor within the covering radius plus the block's threshold (2 + 1)
that can be home to a point within that threshold - 11 at most, as the other
anchors in the ball are home to no point near enough. Then, per anchor, its
home fingerprints are compared in all 64 bits with the replicas. Any linked
pair meets at the home of either of them.

An anchor with many homes is cut into parts of some ``HOMES_PER_PART``; its
replicas go to each part, where only the homes are held and the replicas
stream by. Each part returns spanning forests of its links and not the links,
so a family of near copies yields rows in proportion to its size.

``near_groups`` and ``near_dedup`` link by the similarity of five-word shingle
sets instead: wider fingerprints meet at anchors in the same way, a looser
number of bits makes candidates, and the sets themselves decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, trimmed, two_columns
from .components import components

THRESHOLD = 4
SHINGLE = 4
HOMES_PER_PART = 4096
HOT_ANCHORS = 100_000
#: (first bit, bits) of the three blocks
BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stops = ends[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for a in range(0, n, 1 << 15):
        h = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[a:a + (1 << 15)], stops[a:a + (1 << 15)])])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        seen: dict[str, int] = {}
        out = []
        for t in b.column(1).to_pylist():
            if (x := seen.get(t)) is None:
                x = fingerprint(t)
                seen[t] = x = x - (1 << 64) if x >> 63 else x
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])


def _syndrome(x: np.ndarray, bits: int) -> np.ndarray:
    """Hamming syndrome: the xor of the (1-based) places of the set bits."""
    s = np.zeros(x.shape, np.int64)
    for i in range(bits):
        s ^= ((x >> i) & 1) * (i + 1)
    return s


def _nearest(x: np.ndarray) -> np.ndarray:
    """The anchor nearest to each 22-bit point: decode 15 and 7 bits apart."""
    lo, hi = x & 0x7FFF, x >> 15
    s = _syndrome(lo, 15)
    lo = np.where(s > 0, lo ^ (1 << np.maximum(s - 1, 0)), lo)
    s = _syndrome(hi, 7)
    hi = np.where(s > 0, hi ^ (1 << np.maximum(s - 1, 0)), hi)
    return lo | (hi << 15)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, anchor key (block in the high bits) and whether it is the home."""
    rows, keys, home = [], [], []
    u = fps.astype(np.uint64)
    for b, (first, bits) in enumerate(BLOCKS):
        x = ((u >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        near = np.stack([_nearest(x)] + [_nearest(x ^ (1 << i)) for i in range(22)], axis=1)
        own = near[:, 0].copy()
        near.sort(axis=1)
        first_seen = np.ones(near.shape, bool)
        first_seen[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(first_seen)
        rows.append(r)
        keys.append(near[r, c] | (b << 22))
        home.append(near[r, c] == own[r])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _replicate(batches):
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            fps = b.column(0).slice(at, 2000).to_numpy(zero_copy_only=False)
            r, k, h = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fps[r]), pa.array(h)], ["anchor", "fp", "home"])


def _forest(homes: np.ndarray, others: np.ndarray, home_words: np.ndarray, other_words: np.ndarray, threshold: int):
    """Spanning forest of the links between homes and others, as (u, v) pairs; the words are rows of fingerprints."""
    nodes, inv = np.unique(np.concatenate([homes, others]), return_inverse=True)
    h, o = inv[:len(homes)], inv[len(homes):]
    label = np.arange(len(nodes))
    step = max(1, (1 << 20) // max(1, len(o)))
    for s in range(0, len(h), step):
        differ = np.zeros((len(h[s:s + step]), len(o)), np.int16)
        for w in range(home_words.shape[1]):
            differ += np.bitwise_count(home_words[s:s + step, w][:, None] ^ other_words[:, w][None, :])
        i, j = np.nonzero(differ <= threshold)
        i, j = h[s + i], o[j]
        keep = i != j
        i, j = i[keep], j[keep]
        while True:
            p, q = label[i], label[j]
            apart = p != q
            if not apart.any():
                break
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(up := label[label], label):
                label = up
    linked = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[label[linked]]


def _by_anchor(compare, finish=None):
    """Runs over rows ``(anchor, part, home, ..)`` sorted so that a group's homes come first.

    ``compare(homes, rows)`` gets a group's homes with some of its rows, the
    homes themselves in the first call; only the homes are held while the
    others stream by. ``finish()`` follows a group's last rows. Both may return
    a record batch.
    """

    def run(batches):
        held: list = []  # rows of the last group, as long as all of them are homes
        homes, key = None, None

        def ready(result):
            return (result,) if result is not None and result.num_rows else ()

        def end():
            nonlocal homes, key
            closed, homes, key = homes is not None, None, None
            return ready(finish()) if closed and finish else ()

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            if not len(cols[0]):
                continue
            cols, held = [np.concatenate(x) for x in zip(held, cols)] if held else cols, []
            anchor, part, home = cols[:3]
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = [0, *cut.tolist(), len(anchor)]
            for s, e in zip(bounds, bounds[1:]):
                rows = [x[s:e] for x in cols[2:]]
                if key != (anchor[s], part[s]):
                    yield from end()
                    if e == len(anchor) and rows[0].all():
                        held = [x[s:] for x in cols]
                        break
                    if e - s == 1 or not rows[0][0]:
                        continue
                    key, homes = (anchor[s], part[s]), [x[rows[0]] for x in rows]
                yield from ready(compare(homes, rows))
        if held and len(held[0]) > 1:
            yield from end()
            homes = held[2:]
            yield from ready(compare(homes, homes))
        yield from end()

    return run


def _links(threshold: int):
    """(u, v) of spanning forests; rows are ``(.., home, node, words..)``, the node of a bare fingerprint is itself."""

    def compare(homes, rows):
        words = [np.stack(x[2:] or x[1:2], axis=1).view(np.uint64) for x in (homes, rows)]
        u, v = _forest(homes[1], rows[1], *words, threshold)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return _by_anchor(compare)


def _in_parts(spread: DataFrame, key: str, *more: str) -> DataFrame:
    """``(anchor, part, home, key, ..)``: the homes of a hot anchor are dealt over parts, and its replicas go to each.

    There is at most one hot anchor for ``HOMES_PER_PART`` homes. They are
    counted before they are broadcast; more than ``HOT_ANCHORS`` are joined.
    """
    hot = materialize(
        spread.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOMES_PER_PART)
        .select(F.col("anchor").alias("hot_anchor"), F.ceil(F.col("n") / HOMES_PER_PART).cast("int").alias("parts")))
    n_hot = hot.count()
    if n_hot == 0:
        return spread.select("anchor", F.lit(0).alias("part"), "home", key, *more)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    own = F.pmod(F.xxhash64(key), parts).cast("int")
    return (
        spread.join(F.broadcast(hot) if n_hot <= HOT_ANCHORS else hot, F.col("anchor") == F.col("hot_anchor"), "left")
        # a replica meets the homes of each part; a home is compared in its own part and stands as a replica in the others
        .select("anchor", "home", key, *more, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        .select("anchor", "part", (F.col("home") & (F.col("own") == F.col("part"))).alias("home"), key, *more)
    )


def _grouped(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, fp, root, component_id)``: the groups with their fingerprints; see ``simhash_groups``."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the covering holds for thresholds of 0 to 4")
    fps = materialize(two_columns(docs, id_col, text_col).mapInArrow(trimmed(_fingerprints), "doc_id long, fp long"))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    spread = distinct.select("fp").mapInArrow(trimmed(_replicate), "anchor long, fp long, home boolean")
    dealt = _in_parts(spread, "fp")
    edges = _grouped(dealt).mapInArrow(trimmed(_links(threshold)), "u long, v long")
    roots = components(edges)
    ids = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = materialize(ids.groupBy(F.col("root").alias("least_root")).agg(F.min("first_id").alias("component_id")))
    classes = ids.join(least, F.col("root") == F.col("least_root")).select(F.col("fp").alias("class_fp"), "root", "component_id")
    return fps.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "root", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each input row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the least
    doc_id among the documents reachable over links of at most ``threshold``
    (4 or less) differing bits. A null or wordless text has fingerprint zero,
    which is linked like any other. A null doc_id keeps its row and counts in
    no minimum; where a component has only null ids, ``component_id`` is null.
    Repeated rows and ids stay as they are. Extra columns are pruned.
    """
    return simhash_classes(docs, id_col, text_col, threshold).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- the wide fingerprint: candidates for a similarity of shingle sets ---

#: 64-bit words of the wide fingerprint, and words of its shingles
WIDE, WIDE_SHINGLE = 4, 5
SIMILARITY = 0.8
#: members of a family that one block of it holds, and blocks to which a larger family is cut as long as none exceeds LARGEST_BLOCK
BLOCK, BLOCKS_IN_FAMILY, LARGEST_BLOCK = 1024, 16, 1 << 16
#: deviations beyond the mean number of differing bits at the similarity that still make a candidate
DEVIATIONS = 3.0
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def wide_threshold(similarity: float, bits: int = 64 * WIDE) -> int:
    """Differing bits of a candidate: the mean at this Jaccard similarity of equally large sets, and ``DEVIATIONS`` more."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(bits * p + DEVIATIONS * (bits * p * (1 - p)) ** 0.5))


def shingle_set(text: str, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words: of the whole sequence; none: empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, stops)]), ">u8").astype(np.uint64))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """``WIDE`` words of 64 bits over a shingle set."""
    ones = np.zeros(64 * WIDE, np.int64)
    for a in range(0, len(h), 1 << 13):
        x = h[a:a + (1 << 13), None] * _MIX[None, :]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(x), 8 * WIDE), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(">u8").astype(np.uint64)


_WIDE_COLUMNS = [f"f{i}" for i in range(WIDE)]
_WIDE_ROW = ", ".join(f"{c} long" for c in _WIDE_COLUMNS)


def _wide_fingerprints(batches):
    """(rid, doc_id, s1, s2, words..): s1 and s2 are the 128-bit digest of the shingle set."""
    for b in batches:
        seen: dict[str, tuple] = {}
        out = []
        for t in b.column(2).to_pylist():
            if (x := seen.get(t)) is None:
                h = shingle_set(t)
                seen[t] = x = (*np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8").tolist(), *wide_fingerprint(h).view(np.int64).tolist())
            out.append(x)
        cols = list(zip(*out)) or [()] * (2 + WIDE)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols]], ["rid", "doc_id", "s1", "s2", *_WIDE_COLUMNS])


def _wide_replicate(batches):
    """(anchor, home, node, words..): each word's blocks have anchors of their own."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            c = b.slice(at, 1000)
            node = c.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([c.column(1 + i).to_numpy(zero_copy_only=False) for i in range(WIDE)], axis=1)
            for w in range(WIDE):
                r, k, h = anchors(x[:, w])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k | (w << 24)), pa.array(h), pa.array(node[r]), *[pa.array(x[r, i]) for i in range(WIDE)]], ["anchor", "home", "node", *_WIDE_COLUMNS])


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "set"])


def _verified(threshold: int, similarity: float):
    """(u, v) of links that span the classes of a cell: two blocks ``i`` and ``j`` of a family, or one with itself.

    Of pairs whose fingerprints differ in at most ``threshold`` bits, nearest
    first, the sets are compared, unless the two are of one class already.
    """

    def cell(rows):
        node, own = np.concatenate(rows["node"]), np.concatenate(rows["own"])
        x = np.concatenate(rows["words"]).view(np.uint64)
        sets = rows["set"]
        i, j = rows["cell"][1:]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: list = []
        step = max(1, (1 << 20) // max(1, len(right)))
        for s in range(0, len(left), step):
            some = left[s:s + step]
            differ = np.zeros((len(some), len(right)), np.int16)
            for w in range(WIDE):
                differ += np.bitwise_count(x[some, w][:, None] ^ x[right, w][None, :])
            p, q = np.nonzero(differ <= threshold)
            bits, p, q = differ[p, q], some[p], right[q]
            keep = p < q if i == j else p != q
            found.append((bits[keep], p[keep], q[keep]))
        bits, p, q = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int16),) * 3
        order = np.lexsort((q, p, bits))
        label = list(range(len(node)))

        def find(k):
            while label[k] != k:
                label[k] = label[label[k]]
                k = label[k]
            return k

        u, v = [], []
        for a, b in zip(p[order].tolist(), q[order].tolist()):
            ra, rb = find(a), find(b)
            if ra == rb:
                continue
            m, n = len(sets[a]), len(sets[b])
            if min(m, n) >= similarity * max(m, n):
                both = int(np.isin(sets[a], sets[b], assume_unique=True, kind="sort").sum()) if m <= n else int(np.isin(sets[b], sets[a], assume_unique=True, kind="sort").sum())
                if both >= similarity * (m + n - both):
                    label[max(ra, rb)] = min(ra, rb)
                    u.append(int(node[a]))
                    v.append(int(node[b]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches):
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            fam, i, j, own, node = (b.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            words = np.stack([b.column(5 + w).to_numpy(zero_copy_only=False) for w in range(WIDE)], axis=1)
            sets = [np.frombuffer(t, np.uint64) for t in b.column(5 + WIDE).to_pylist()]
            cut = np.flatnonzero((fam[1:] != fam[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = [0, *cut.tolist(), len(fam)]
            for s, e in zip(bounds, bounds[1:]):
                key = (int(fam[s]), int(i[s]), int(j[s]))
                if held and held["cell"] != key:
                    yield cell(held)
                    held = {}
                if not held:
                    held = {"cell": key, "node": [], "own": [], "words": [], "set": []}
                for c, value in (("node", node), ("own", own), ("words", words)):
                    held[c].append(value[s:e])
                held["set"] += sets[s:e]
        if held:
            yield cell(held)

    return run


def near_classes(base: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(rid, doc_id, root)`` for a table ``(rid, doc_id, text)`` as ``numbered`` gives it.

    Documents with equal shingle sets are one node. Nodes meet at anchors of
    their wide fingerprints; those at most ``wide_threshold(similarity)`` bits
    apart are candidates, of which an anchor returns a spanning forest. So
    candidates fall into families. Within a family, cut into blocks that meet
    two by two, every pair at most that many bits apart is a link if its sets'
    Jaccard similarity reaches the limit; a cell returns links that span its
    classes and skips pairs that are of one class already. Nothing here grows
    with the pairs of a group but the comparisons of fingerprints.
    """
    prints = materialize(base.select("rid", "doc_id", "text").mapInArrow(trimmed(_wide_fingerprints), f"rid long, doc_id long, s1 long, s2 long, {_WIDE_ROW}"))
    nodes = materialize(prints.groupBy("s1", "s2", *_WIDE_COLUMNS).agg(F.min("rid").alias("node")))
    spread = nodes.select("node", *_WIDE_COLUMNS).mapInArrow(trimmed(_wide_replicate), f"anchor long, home boolean, node long, {_WIDE_ROW}")
    limit = wide_threshold(similarity)
    near = _grouped(_in_parts(spread, "node", *_WIDE_COLUMNS)).mapInArrow(trimmed(_links(limit)), "u long, v long")
    families = components(near).select(F.col("node").alias("m_node"), F.col("root").alias("fam"))
    # written out: the members' numbers are broadcast if they are few, and then no text moves
    members = materialize(nodes.join(families, F.col("node") == F.col("m_node")).drop("m_node", "s1", "s2"))
    sets = base.join(members.select("node"), F.col("rid") == F.col("node"), "left_semi").select("rid", "text").mapInArrow(trimmed(_sets), "s_node long, set binary")
    n = F.col("n")
    block = F.least(F.greatest(F.lit(BLOCK), F.ceil(n / BLOCKS_IN_FAMILY)), F.lit(LARGEST_BLOCK))
    cut = materialize(members.groupBy(F.col("fam").alias("c_fam")).agg(F.count("*").alias("n")).select("c_fam", F.ceil(n / block).cast("int").alias("blocks")))
    dealt = members.join(cut, F.col("fam") == F.col("c_fam")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = materialize(dealt.join(sets, F.col("node") == F.col("s_node")).select("fam", "blocks", "own", "node", *_WIDE_COLUMNS, "set"))
    # every block meets itself and each other block once
    cells = dealt.select("fam", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "own", "node", *_WIDE_COLUMNS, "set").select(
        "fam", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", *_WIDE_COLUMNS, "set")
    links = cells.repartition("fam", "i", "j").sortWithinPartitions("fam", "i", "j").mapInArrow(trimmed(_verified(limit, similarity)), "u long, v long")
    roots = components(links).select(F.col("node").alias("r_node"), "root")
    of = nodes.join(roots, F.col("node") == F.col("r_node"), "left").select(
        F.col("s1").alias("n1"), F.col("s2").alias("n2"), F.coalesce("root", "node").alias("root"))
    return prints.join(of, (F.col("s1") == F.col("n1")) & (F.col("s2") == F.col("n2"))).select("rid", "doc_id", "root")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(rid, doc_id, root)``: groups of documents whose five-word shingle sets are similar.

    ``root`` is the least ``rid`` of the group. Equal texts are always linked;
    null and wordless texts are equal, a text of one to four words has itself as its only
    shingle. Repeated rows and null ids keep their rows. An empty table gives
    an empty table. Extra columns are pruned.
    """
    return near_classes(numbered(docs, id_col, text_col), similarity)


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``near_groups``: the one with the least id, null ids last, all columns as they are.

    Of rows with the same least id the first stays.
    """
    placed = numbered(docs, id_col, text_col, rest=True)
    classes = near_classes(placed, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    first = classes.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.rid").alias("first_rid"))
    # written out: what goes is less than what stays, and is broadcast by its size if there is little of it
    gone = materialize(classes.join(first, F.col("rid") == F.col("first_rid"), "left_anti").select(F.col("rid").alias("gone_rid")))
    return placed.join(gone, F.col("rid") == F.col("gone_rid"), "left_anti").select("row.*")
