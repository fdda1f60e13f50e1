"""Best-fit packing of tokenised documents into sequences.

Bulk-synchronous best-fit. Pieces and gaps have sizes of 1 to ``capacity``, so
range-sorting them deals them into at most ``capacity`` size classes, which are
held as runs (class, first rank, count). Each round takes the pieces of one
size, from the longest down: the successor sweep finds the smallest gap class
that holds them, rank resolves conflicts (the i-th piece of the class takes the
i-th gap; pieces left over go to the next gap class, and at last to new
sequences), the gaps are updated, and the next round begins. What a round sees
are the runs of the classes, whose number is bounded by the capacity and not by
the data. All row-level work is distributed: the class counts, the rank of each
piece within its class, and the look-up of the rank's place.

The rank is dealt over hash parts within a class (row number in the part plus
the counts of the parts before), as many as the class has pieces for, so one
size with a third of all pieces is no single task.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trimmed, two_columns
from .tokens import encoder, encoder_with_offsets, splits_at_space

CAPACITY = 2048
#: pieces of pre-tokens whose ids a worker keeps, some 140 MB
CACHED_PIECES = 800_000
#: bytes of text that are split and looked up together; one text may be longer
BLOCK_BYTES = 24 << 20
#: tokens that are gathered together
GATHERED = 1 << 20
#: pieces that one part of a size class holds on average
RANKED = 500

# For ASCII text the vocabulary's own splitter, on lower case: what it gives are whole pieces of any pre-token.
_FINE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def _encode_words(words: list[bytes], path: str, joined: int = 256) -> list[bytes]:
    """The ids of each word as little-endian 32-bit strings; many words to a call, parted by their offsets."""
    texts = [w.decode() for w in words]
    parts = [texts[i:i + joined] for i in range(0, len(texts), joined)]
    out: list[bytes] = []
    for part, (ids, offsets) in zip(parts, encoder_with_offsets(path)([" ".join(p) for p in parts])):
        starts = np.cumsum([0] + [len(x) + 1 for x in part])
        cut = (np.searchsorted(np.array([o for o, _ in offsets], np.int64), starts) * 4).tolist()
        raw = np.array(ids, "<u4").tobytes()
        out += [raw[a:b] for a, b in zip(cut, cut[1:])]
    return out


class _Whole:
    """The ids of texts of a vocabulary whose pieces take in white space."""

    def __init__(self, path: str):
        self.encode = encoder(path)

    def documents(self, texts: pa.Array):
        for at in range(0, len(texts), 200):
            for ids in self.encode(texts.slice(at, 200).to_pylist()):
                yield np.array(ids, "<u4")


class _Words:
    """The ids of the pieces of pre-tokens that a worker has met."""

    def __init__(self, path: str):
        self.path, self.pieces = path, {}
        # only vocabularies that lower-case may be asked for lower-cased pieces
        self.fine = encoder(path)(["AbC dE"]) == encoder(path)(["abc de"])

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each of these distinct words."""
        known = self.pieces
        if len(known) > CACHED_PIECES:
            known.clear()
        if self.fine:
            # special strings are matched before anything is split, so words that may hold one stay whole
            parts = [(w.lower(),) if w.isalpha() else _FINE.findall(w.lower()) if w.isascii() and b"<|" not in w else (w,) for w in words]
        else:
            parts = [(w,) for w in words]
        need = list(set(chain.from_iterable(parts)).difference(known))
        for i in range(0, len(need), 8192):
            known.update(zip(need[i:i + 8192], _encode_words(need[i:i + 8192], self.path)))
        return [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in parts]

    def documents(self, texts: pa.Array):
        """The ids of each text as a 32-bit array."""
        lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.indices.to_numpy()
        ids = self.ids(coded.dictionary.cast(pa.binary()).to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        arena = np.frombuffer(b"".join(ids), "<u4")
        base, doc = ends[0], 0
        while doc < len(ends) - 1:
            # documents whose words are few enough to gather at once, one at least
            last = max(doc + 1, int(np.searchsorted(ends, ends[doc] + GATHERED // 4, "right")) - 1)
            w = words[ends[doc] - base:ends[last] - base]
            n = size[w]
            upto = np.concatenate(([0], np.cumsum(n)))
            tokens = arena[np.repeat(first[w] - upto[:-1], n) + np.arange(upto[-1])]
            cut = upto[ends[doc:last + 1] - ends[doc]]
            for a, b in zip(cut.tolist(), cut[1:].tolist()):
                yield tokens[a:b]
            doc = last


_cache: dict[str, _Words | _Whole] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        known = _cache.get(path) or _cache.setdefault(path, _Words(path) if splits_at_space(path) else _Whole(path))
        end = end_id.to_bytes(4, "little")
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            docs = b.column(0).to_pylist()
            block = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                for doc, ids in zip(docs[at:to], known.documents(b.column(1).slice(at, to - at)) if to > at else ()):
                    raw = ids.tobytes() + end
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[start:start + 4 * capacity]
                        for col, v in zip(out, (doc, piece, start // 4, len(cut) // 4, zlib.crc32(cut))):
                            col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(sizes: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """size -> (first rank, first sequence, offset) of its runs, ranks ascending.

    ``sizes`` is the number of pieces of each size. Gaps are runs of sequences
    with the same room; a run is split where a round uses only a part of it.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, count)
    out, opened = {}, 0
    for size in sorted(sizes, reverse=True):
        left, rank, runs = sizes[size], 0, []
        while left:
            room = next((g for g in range(size, capacity + 1) if gaps.get(g)), None)
            if room is None:
                # new sequences: at once as many as hold the rest, filled one piece a round
                first, count, room = opened, -(-left // (capacity // size)), capacity
                opened += count
            else:
                first, count = gaps[room].pop()
            used = min(left, count)
            if used < count:
                gaps.setdefault(room, []).append((first + used, count - used))
            runs.append((rank, first, capacity - room))
            if room > size:
                gaps.setdefault(room - size, []).append((first, used))
            left, rank = left - used, rank + used
        out[size] = tuple(np.array(x, np.int64) for x in zip(*runs))
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row
    for each piece. A document is its ids and then ``end_id``; a null or empty
    text is ``end_id`` alone. Only documents longer than ``capacity`` are cut.
    Repeated rows and null ids are packed like any other, each on its own. An
    empty table gives an empty table. Extra columns are pruned.
    """
    spark = docs.sparkSession
    made = two_columns(docs, id_col, text_col).mapInArrow(trimmed(_pieces(tokenizer_path, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # numbered as it is written, so that rows that are equal in all else are dealt apart too
    pieces = materialize(made.withColumn("row", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    placed = spark.sparkContext.broadcast(plan(sizes, capacity))
    # at most `capacity` rows: a size with very many pieces has as many parts
    parts = spark.createDataFrame([(n, -(-k // RANKED)) for n, k in sizes.items()], "p_length long, parts int")
    dealt = pieces.join(F.broadcast(parts), F.col("length") == F.col("p_length")).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    before = (
        dealt.groupBy("length", "part").count()
        .withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("length").alias("c_length"), F.col("part").alias("c_part"), "before")
    )
    ranked = (
        dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1)
        .join(before, (F.col("length") == F.col("c_length")) & (F.col("part") == F.col("c_part")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    )

    def place(batches):
        at = placed.value
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                here = np.nonzero(size == s)[0]
                ranks, first, offset = at[int(s)]
                i = np.searchsorted(ranks, rank[here], "right") - 1
                seq[here] = first[i] + rank[here] - ranks[i]
                off[here] = offset[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
