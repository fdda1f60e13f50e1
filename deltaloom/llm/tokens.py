"""Token counts: pieces once per distinct pre-token, joined to frequencies.

A pre-token is a run of bytes without ASCII white space. The vocabularies'
normalisers and splitters never join across ASCII white space, so a text's
pieces are those of its pre-tokens one after the other; the library itself
counts each distinct pre-token, special strings inside it included.

1. One scan sums the corpus frequency of each pre-token (map-side first).
2. The library counts the pieces of each distinct pre-token, once.
3. The most frequent pre-tokens, at most ``HEAD_WORDS`` of them and
   ``HEAD_BYTES`` bytes in all, are broadcast: this is the join's hot side, and
   its bound does not depend on the data. A second scan sums them in place and
   leaves each document's frequencies of the others, which meet the vocabulary
   in a shuffled join. No pre-token left there has a large share of the rows,
   since all more frequent ones are in the broadcast part.
4. Pieces times frequency are summed per document. No ids are materialised.
"""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed, two_columns

HEAD_WORDS = 1 << 18
HEAD_BYTES = 16 << 20
#: distinct pre-tokens that a task holds before it hands on its partial counts
HELD_WORDS = 400_000

_encoders: dict = {}


def encoder(path: str):
    """``list[str] -> list[list[int]]`` for a tokenizer file; one per process."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = lambda texts: sp.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _encoders[path] = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _encoders[path]


def encoder_with_offsets(path: str):
    """``list[str] -> list[(ids, offsets)]`` for a ``tokenizers`` .json file; one per process."""
    key = (path, "offsets")
    if key not in _encoders:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _encoders[key] = lambda texts: [(e.ids, e.offsets) for e in t.encode_batch(texts, add_special_tokens=False)]
    return _encoders[key]


#: texts whose pieces tell whether a vocabulary joins over white space: words, digits, signs, line ends, runs of spaces, other scripts
PROBES = ("the cat sat", "a  b", "1 2 3", "x\ny", "one,\ttwo .", "  lead", "tail ", "é ü", "日本 語", "don 't", "a\n\nb", "don't I'll", "( ) [ ]", "AB cd Ef")


def splits_at_space(path: str) -> bool:
    """Whether a text's pieces are those of its runs without white space, one after the other, as far as ``PROBES`` show."""
    encode = encoder(path)
    parts = [t.split() for t in PROBES]
    alone = [sum(encode(p), []) for p in parts]
    return [list(x) for x in encode(list(PROBES))] == alone


def _vocabulary(batches):
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for t in b.column(1).cast(pa.binary()).to_pylist():
            held.update(t.split())
        if len(held) > HELD_WORDS:
            yield out()
            held.clear()
    yield out()


def _count_pieces(path: str):
    def run(batches):
        encode = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                c = b.slice(at, 5000)
                ids = encode([w.decode() for w in c.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(map(len, ids), pa.int64())], ["word", "n", "pieces"])

    return run


def _frequencies(head):
    """(rid, doc_id, n_bytes, known, word, freq): known pieces stand in a document's first row."""

    def run(batches):
        get = head.value.get
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for rid, doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                words = t.split()
                known = list(map(get, words))
                rest = Counter([w for w, k in zip(words, known) if k is None]) if None in known else ()
                m = max(1, len(rest))
                cols[0] += [rid] * m
                # what a document has once stands in its first row; elsewhere nothing, which packs better
                cols[1] += [doc] + [None] * (m - 1)
                cols[2] += [len(t)] + [0] * (m - 1)
                cols[3] += [sum(filter(None, known))] + [0] * (m - 1)
                # a key with a space is no pre-token and spreads the documents that need no join
                cols[4] += rest or [b" %d" % rid]
                cols[5] += rest.values() if rest else [0]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["rid", "doc_id", "n_bytes", "known", "word", "freq"])

    return run


def _head(vocabulary: DataFrame) -> tuple[int, dict]:
    """The least frequency of the broadcast part, and the part itself."""
    classes = (
        vocabulary.groupBy(F.floor(F.log2("n")).cast("int").alias("k"))
        .agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    )  # at most 63 rows
    least, words, size = 1 << 62, 0, 0
    for k, w, s in sorted(map(tuple, classes), reverse=True):
        words, size = words + w, size + s
        if words > HEAD_WORDS or size > HEAD_BYTES:
            break
        least = 1 << k
    rows = vocabulary.where(F.col("n") >= least).select("word", "pieces").toArrow()
    return least, dict(zip(rows.column("word").to_pylist(), rows.column("pieces").to_pylist()))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row for each input row.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows and ids, and
    null ids, keep their own rows. An empty table gives an empty table. Extra
    columns are pruned. ``tokenizer_path`` is a ``tokenizers`` .json file or a
    sentencepiece .model; where its pieces take in white space
    (``splits_at_space``), each text is given to the library as a whole.
    """
    if tokenizer_path.endswith(".model") or not splits_at_space(tokenizer_path):
        return count_tokens_whole(docs, tokenizer_path, limit, id_col, text_col)
    spark = docs.sparkSession
    base = two_columns(docs, id_col, text_col)
    totals = base.mapInArrow(trimmed(_vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = materialize(totals.mapInArrow(trimmed(_count_pieces(tokenizer_path)), "word binary, n long, pieces long"))
    least, known = _head(vocabulary)
    head = spark.sparkContext.broadcast(known)
    rows = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(
        trimmed(_frequencies(head)), "rid long, doc_id long, n_bytes long, known long, word binary, freq long")
    rare = vocabulary.where(F.col("n") < least).select(F.col("word").alias("v_word"), "pieces")
    joined = rows.join(rare, F.col("word") == F.col("v_word"), "left")
    return (
        joined.groupBy("rid").agg(
            F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("known") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def count_tokens_whole(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns, each text given to the library as a whole.

    For vocabularies whose pieces take in white space, as sentencepiece's do.
    """

    def run(batches):
        encode = encoder(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                ids = encode(c.column(1).to_pylist())
                size = [len(t) for t in c.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(size, pa.int64()), pa.array(map(len, ids), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = two_columns(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
