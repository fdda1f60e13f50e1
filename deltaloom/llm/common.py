"""Shared helpers: column handling, and the library's cuts in the shared folder."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, release, shared_dir, shared_path, table

__all__ = ["WORD", "materialize", "numbered", "release", "shared_dir", "shared_path", "table", "trimmed", "two_columns"]

#: a word, as the query contracts state it
WORD = r"[^\x20\x09-\x0D]+"


def two_columns(df: DataFrame, id_col: str, text_col: str, null_text: str | None = "") -> DataFrame:
    """``(doc_id long, text string)`` whatever else ``df`` carries.

    Every other column, also one whose name differs only by case, is pruned
    here, so no operator-internal column can clash with it.
    """
    text = F.col(text_col).cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def numbered(df: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """``(rid, doc_id, text)``, and with ``rest`` all of the row's columns as a struct ``row``.

    Rows are numbered once and written with their numbers. How a table is cut
    into partitions, and so what ``monotonically_increasing_id`` gives, may
    differ from scan to scan; whoever joins by ``rid`` has to start from here.
    """
    rid = F.monotonically_increasing_id().alias("rid")
    if not rest:
        return materialize(two_columns(df, id_col, text_col).select(rid, "doc_id", "text"), "zstd")
    written = materialize(df.select(rid, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), "zstd")
    own = {c.lower(): F.col("row").getField(c) for c in df.columns}
    text = F.coalesce(own[text_col.lower()].cast("string"), F.lit(""))
    return written.select("rid", own[id_col.lower()].cast("long").alias("doc_id"), text.alias("text"), "row")


def trimmed(run):
    """A function over Arrow batches that gives memory back when its partition is done.

    Workers are kept for further tasks and stages; what allocators hold back
    would count against the executor all that time.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return whole
