"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and pairs of adjacent words, letter case kept, are hashed into
``BUCKETS`` buckets. Two multinomials are counted: of the raw corpus (every
n-gram of every document) and of the trusted target (the documents labelled
good and not toxic, of which at most ``TARGET_DOCUMENTS``, those with the least hash
of their id; a bound on the fit, not on the scoring). The target is smoothed
towards the corpus with ``PSEUDO`` counts a bucket, so that a bucket seen a few
times says next to nothing, in the target or not. A document's score is the
mean log ratio of its n-grams, summed in 2**-20 units as integers so that
neither the order of rows nor the partitioning can change a verdict. It is
kept if the base rules pass and the score is at least ``THRESHOLD``.

All of it is DataFrame and SQL functions. Counting explodes the n-grams into
``BUCKETS`` sums; scoring is done within each row, on a literal array of
``BUCKETS`` weights, so that no row is exploded or joined and the verdict is a
plain column of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, two_columns

BUCKETS = 1 << 16
TARGET_DOCUMENTS = 20_000
PSEUDO = 10.0
THRESHOLD = -0.15
UNIT = 1 << 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = "[" + WORD[2:]


def _barrier(df: DataFrame, **columns) -> DataFrame:
    """Add columns that later expressions read and don't compute again."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds ``hashes``, a 64-bit hash of each word, and the five base counts to a table with ``text``.

    ``n_repeat_words``: the three-word windows are hashed to 64 bits. Where two
    are equal they are sorted with their places; neighbours of one hash are
    repeats, and the union of their words is counted. n log n in the document's length.
    """
    out = _barrier(docs, words=_words(), lines=F.split("text", "\n"))
    out = _barrier(
        out, hashes=F.transform("words", lambda w: F.xxhash64(w)), word_chars=F.char_length(F.array_join("words", "")),
        worded=F.filter("lines", lambda x: x.rlike(WORD[:-1])))
    out = _barrier(out.drop("words", "lines"), n=F.size("hashes"), grams=F.when(F.size("hashes") > 2, _windows(3)).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = _barrier(out, ordered=F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    repeats = F.sort_array(F.filter(
        "ordered", lambda x, j: (x.h == F.get("ordered", j - 1).h) | (F.coalesce(F.get("ordered", j + 1).h == x.h, F.lit(False)))).i)
    covered = F.aggregate(
        repeats, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda s, i: F.struct((i + 3).alias("end"), (s.total + i + 3 - F.greatest(i, s.end)).alias("total")), lambda s: s.total)
    plain = F.col("text")
    for x in "#*$%&|<>":
        plain = F.replace(plain, F.lit(x), F.lit(""))
    return out.select(
        *docs.columns, "hashes", F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(plain)).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("ordered") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def _windows(size: int, hashes: str = "hashes"):
    """Hashes of all runs of ``size`` words."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))


def _words():
    return F.filter(F.split("text", _SPACE), lambda w: w != "")


def _bucket(h):
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pairs(hashes: str = "hashes"):
    return F.when(F.size(hashes) > 1, _windows(2, hashes)).otherwise(F.array().cast("array<bigint>"))


def weights(docs: DataFrame, labels: DataFrame, good: str = "quality", bad: str = "toxic") -> DataFrame:
    """``(bucket, weight long)``: the log ratio of target to corpus, in units of 2**-20.

    ``docs`` has doc_id and text. A bucket that no document has gives no row.
    No trusted document: an empty table, so that every score is zero.
    """
    trusted = (F.col(good).cast("int") == 1) & (F.coalesce(F.col(bad).cast("int"), F.lit(0)) == 0)
    target = (
        labels.where(trusted).select(F.col("doc_id").cast("long").alias("good_id")).where("good_id is not null").distinct()
        .orderBy(F.xxhash64("good_id"), "good_id").limit(TARGET_DOCUMENTS)
    )
    known = (
        docs.join(F.broadcast(target), F.col("doc_id") == F.col("good_id"), "left")
        .select(F.col("good_id").isNotNull().cast("long").alias("good"), _words().alias("words"))
    )
    hashed = _barrier(known, hashes=F.transform("words", lambda w: F.xxhash64(w)))
    counted = (
        hashed.select("good", F.explode(F.concat("hashes", _pairs())).alias("h")).select("good", _bucket(F.col("h")).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("hit"))
    )
    counts = materialize(counted)  # at most BUCKETS rows
    raw, hit = counts.agg(F.sum("raw"), F.sum("hit")).first()
    if not hit:
        return counts.where("false").select("bucket", F.lit(0).cast("long").alias("weight"))
    ratio = F.log((F.col("hit") + PSEUDO) / (F.col("raw") * F.lit(hit / raw) + PSEUDO))
    return counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("weight"))


def _literal(table: DataFrame):
    """The weights as one constant array; at most ``BUCKETS`` rows come to the driver."""
    values = [0] * BUCKETS
    for bucket, weight in table.collect():
        values[bucket] = weight
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def quality(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rows: bool = False
) -> DataFrame:
    """Counts, score and verdict, one row for each input row.

    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept)``; with ``rows`` also ``row``, the input's columns
    as a struct, whatever their names. A null text has no words, so the base
    rules reject it. Repeated rows and null ids are judged each on their own.
    An empty table gives an empty table; without trusted documents the base
    rules alone decide. A null label is no label.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    weight = _literal(weights(two_columns(docs, id_col, text_col), labels))
    counted = base_counts(docs.select(F.col(id_col).cast("long").alias("doc_id"), text, *own))
    summed = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.get(weight, _bucket(h)))
    total = summed("hashes") + summed(_pairs())
    scored = _barrier(counted.drop("text"), total=total, grams=F.greatest(2 * F.col("n_words") - 1, F.lit(1).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id", *BASE, failed.alias("base_failed"), (F.col("total") / F.col("grams") / UNIT).alias("score"),
        (~failed & (F.col("total") >= F.lit(round(threshold * UNIT)) * F.col("grams"))).alias("kept"), *["row"] * rows,
    )


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all columns as they are."""
    return quality(docs, labels, rows=True, **options).where("kept").select("row.*")
