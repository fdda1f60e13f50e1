"""Vectors of files: similar pairs, centroids, clusters.

Pairs are found by blocks: rows are dealt to blocks by a hash of their id,
each pair of blocks meets in one group, and a matrix product gives its
similarities, of which only those over the threshold leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a block, blocks as long as none exceeds LARGEST_BLOCK rows, and values of a product that are held at once
BLOCK, BLOCKS, LARGEST_BLOCK, PRODUCT = 1024, 64, 1 << 16, 1 << 22


def cosine(a: str, b: str):
    """Cosine as a Column; 0 for empty vectors, unequal lengths and zero norms."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0) | size.isNull(), 0.0).otherwise(dot / size)


def _unit(vectors) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", top: int | None = None) -> DataFrame:
    """``(a, b, similarity)`` with ``a < b`` of all pairs of at least ``threshold``; null vectors pair with nothing.

    With ``top`` only so many of each pair of blocks, the most similar ones.

    Vectors have one length. Repeated ids are compared with others and not with each other.
    """
    n = vectors.count()
    # a row is copied to at most BLOCKS cells, as long as a block of that size can be held
    blocks = max(1, -(-n // min(max(BLOCK, -(-n // BLOCKS)), LARGEST_BLOCK)))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # every block meets itself and each other block once
    spread = rows.select("id", "v", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    spread = spread.select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(batches):
        held, key = ([], [], []), None

        def out(group):
            ids, own = np.concatenate(group[0]), np.concatenate(group[2])
            i, j = key
            x = _unit(np.concatenate(group[1]))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                return None
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            step = max(1, PRODUCT // len(right))
            for at in range(0, len(left), step):
                some = left[at:at + step]
                s = x[some] @ x[right].T
                p, q = np.nonzero(s >= threshold - 1e-12)
                a, b, s = ids[some[p]], ids[right[q]], s[p, q]
                keep = (a < b) if i == j else (a != b)
                a, b, s = a[keep], b[keep], s[keep]
                best = tuple(np.concatenate(c) for c in zip(best, (np.minimum(a, b), np.maximum(a, b), s)))
                if top is not None and len(best[2]) > top:
                    order = np.lexsort((best[1], best[0], -best[2]))[:top]
                    best = tuple(c[order] for c in best)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["a", "b", "similarity"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            cut = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(ids)]
            for s, e in zip(cut, cut[1:]):
                if (i[s], j[s]) != key:
                    if held[0] and (r := out(held)) is not None:
                        yield r
                    held, key = ([], [], []), (i[s], j[s])
                for c, v in zip(held, (ids[s:e], x[s:e], own[s:e])):
                    c.append(v)
        if held[0] and (r := out(held)) is not None:
            yield r

    return spread.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(compare, "a long, b long, similarity double")


def top_pairs(pairs: DataFrame, k: int = 20) -> DataFrame:
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(k)


def nearest_pairs(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` most similar pairs of all; every pair of blocks hands on its own ``k`` and no more."""
    return top_pairs(similar_pairs(vectors, -1.0, id_col, vector_col, top=k), k)


def centroids(vectors: DataFrame, group_col: str, vector_col: str = "embedding") -> DataFrame:
    """Mean vector of each group as ``(group, pos, mean)`` rows; null vectors don't count."""
    return vectors.select(F.col(group_col).alias("grp"), F.posexplode(vector_col)).groupBy("grp", "pos").agg(F.avg(F.col("col").cast("double")).alias("mean"))


def _merge(x: np.ndarray, n: np.ndarray, threshold: float, small: int) -> np.ndarray:
    """For groups with sums ``x`` and sizes ``n`` the place of the group that each ends in.

    A row holds its nearest row among the later ones. If that one has gone or
    moved, the similarity still bounds the row's from above, and the row is
    compared anew only when it comes first. So memory is in proportion to the
    rows, and a merge costs a few products of the matrix with one row.
    Similarities are compared to 12 digits, for copies to be equal.
    """
    into, place = np.arange(len(n)), np.flatnonzero(n <= small)
    u, n = _unit(x[place]), n[place].copy()
    u[~np.isfinite(u).all(1)] = 0
    norm = np.linalg.norm(x[place], axis=1)
    left = m = len(place)
    best, near, sure, gone = np.full(m, -np.inf), np.zeros(m, np.int64), np.ones(m, bool), np.zeros(m)
    step = max(1, min(BLOCK, PRODUCT // max(1, m)))
    for at in range(0, m - 1, step):
        s = np.round(u[at:at + step] @ u[at:].T, 12)
        s[np.tri(*s.shape, dtype=bool)] = -np.inf
        k = s.argmax(1)
        best[at:at + step], near[at:at + step] = s[np.arange(len(k)), k], at + k
    while m > 1:
        a = int(best.argmax())
        if not best[a] >= threshold:
            break
        if not sure[a]:
            s = np.round(u[a:] @ u[a], 12) + gone[a:]
            s[0] = -np.inf
            k = int(s.argmax())
            best[a], near[a], sure[a] = s[k], a + k, True
            continue
        b = int(near[a])
        into[place[b]] = place[a]
        n[a] += n[b]
        sure[(near == a) | (near == b)] = False
        gone[b], best[b] = -np.inf, -np.inf
        if n[a] > small:
            gone[a], best[a] = -np.inf, -np.inf
        else:
            total = u[a] * norm[a] + u[b] * norm[b]
            u[a], norm[a] = _unit(total[None])[0], np.linalg.norm(total)
            s = np.round(u @ u[a], 12) + gone
            s[a] = -np.inf
            k = a + int(s[a:].argmax())
            best[a], near[a], sure[a] = s[k], k, True
            more = (s[:a] > best[:a]) & (gone[:a] == 0)
            # an equal one comes first if it stands earlier; where the nearest is not known, it is found when its turn comes
            more |= (s[:a] == best[:a]) & (gone[:a] == 0) & sure[:a] & (near[:a] > a)
            rows = np.flatnonzero(more)
            best[rows], near[rows], sure[rows] = s[rows], a, True
        left -= 1 + (n[a] > small)
        if left < m * 3 // 4:
            keep = np.flatnonzero(gone == 0)
            moved = np.zeros(m, np.int64)
            moved[keep] = np.arange(len(keep))
            near = moved[near[keep]]
            u, norm, n, place, best, sure, gone = u[keep], norm[keep], n[keep], place[keep], best[keep], sure[keep], gone[keep]
            m = left
    # a group is merged into an earlier one, which may have gone into a still earlier one
    for k in np.flatnonzero(into != np.arange(len(into))):
        into[k] = into[into[k]]
    return into


def greedy_merge(members: DataFrame, threshold: float = 0.75, small: int = 5) -> DataFrame:
    """``members(diff_id, grp, embedding)`` -> ``(diff_id, grp, merged)``.

    The most similar pair of groups of at most ``small`` files, at or over the
    threshold, is merged and its centroid taken anew, until none is left; of
    equal pairs the first by the groups' ids. A null vector counts as a file and
    adds nothing. The merges of a change depend on one another, so each change
    is one task: its files stream by, and its groups' sums and sizes are held.
    """
    # the number is named, since few bytes are long work here and partitions aren't to be put together
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = members.select(F.col("diff_id").cast("long").alias("diff_id"), F.col("grp").cast("long").alias("grp"), F.col("embedding").alias("v"))

    def vectors(column):
        """As doubles; nulls are zeros."""
        filled = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        values = pc.fill_null(column.flatten(), 0).to_numpy(zero_copy_only=False)
        x = np.zeros((len(column), len(values) // max(1, len(filled))))
        if len(filled):
            x[filled] = values.reshape(len(filled), -1)
        return x

    def summed(grp, none, n, x):
        """Neighbours of one group as one row."""
        at = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (none[1:] != none[:-1]))))
        return (grp, none, n, x) if len(at) == len(grp) else (grp[at], none[at], np.add.reduceat(n, at), np.add.reduceat(x, at))

    def run(batches):
        held, key = [], None

        def out():
            wide = max(h[3].shape[1] for h in held)
            x = np.concatenate([h[3] if h[3].shape[1] else np.zeros((len(h[3]), wide)) for h in held])
            grp, none, n, x = summed(*(np.concatenate([h[c] for h in held]) for c in range(3)), x)
            held.clear()
            into = _merge(x, n, threshold, small)
            diff = pa.array(np.full(len(grp), key[0]), mask=np.full(len(grp), key[1]))
            return pa.RecordBatch.from_arrays([diff, pa.array(grp, mask=none), pa.array(grp[into], mask=none[into])], ["diff_id", "grp", "merged"])

        for batch in batches:
            if not batch.num_rows:
                continue
            (d, lost), (grp, none) = ((pc.fill_null(c, 0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)) for c in batch.columns[:2])
            x = vectors(batch.column(2))
            cut = [0, *(np.flatnonzero((d[1:] != d[:-1]) | (lost[1:] != lost[:-1])) + 1).tolist(), len(d)]
            for s, e in zip(cut, cut[1:]):
                if (d[s], lost[s]) != key:
                    if held:
                        yield out()
                    key = (d[s], lost[s])
                held.append(summed(grp[s:e], none[s:e], np.ones(e - s, np.int64), x[s:e]))
        if held:
            yield out()

    return files.repartition(parts, "diff_id").sortWithinPartitions("diff_id", "grp").mapInArrow(run, "diff_id long, grp long, merged long")
