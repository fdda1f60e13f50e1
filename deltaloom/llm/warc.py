"""WARC records and a Merkle fixity audit of replicas.

Pages become response records, dealt to archives by ranges of ``ARCHIVE_PAGES``
page ids, in id order and at gapless offsets. A range with many more rows than
ids (an id that repeats) is dealt over parts, so no archive grows without
bound. A replica keeps each record's place: the archive, the part and the
offset that its index states. So a record that was lost or added moves no other.

The tree is built over ordered offset ranges. A leaf is what stands at one
offset; ``RANGE`` bytes make a node, ``FANOUT`` neighbouring nodes the next one,
up to a root for each archive part, then parts, then archives, in the same way
up to one root. An audit compares the roots of two replicas and goes down
only into nodes that differ, to the offsets that do.

All of it is DataFrame functions, both replicas in one table. No group is
larger than the fan-out, the distinct offsets of a range, or a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ARCHIVE_PAGES = 1000
FANOUT = 16
#: bytes under one node of the first level; records have headers, so some hundreds start there
RANGE = 1 << 16
#: the mandatory date of records whose fetch time the table does not hold
DATE = "1970-01-01T00:00:00Z"
_NO_ID = 1 << 40
_ADDRESS = ("archive", "part", "node")


def stored(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_pages: int = ARCHIVE_PAGES, date: str = DATE
) -> DataFrame:
    """``(rid, archive, part, page_id, url, length, sha256, record)``; ``record`` is the bytes of a WARC/1.1 response.

    Written once, so that a row's ``rid`` and part stay as they are. A null url
    or html is empty; pages without an id are dealt by a hash of their url and
    html to archives beyond all others. Repeated rows are records of their own.
    """
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (url_col, html_col))
    page = F.col(id_col).cast("long")
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), html)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("-")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).cast("binary")
    rows = materialize(
        pages.select(
            F.monotonically_increasing_id().alias("rid"),
            F.coalesce(F.floor(page / archive_pages), _NO_ID + F.pmod(F.xxhash64(url, html), F.lit(1 << 16))).cast("long").alias("archive"),
            page.alias("page_id"), url.alias("url"), record.alias("record"))
        .withColumns({"length": F.octet_length("record").cast("long"), "sha256": F.sha2("record", 256)}), "zstd")
    full = materialize(
        rows.groupBy(F.col("archive").alias("full")).agg(F.ceil(F.count("*") / archive_pages).cast("int").alias("parts")).where("parts > 2"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid"), F.col("parts")))
    return rows.join(full, F.col("archive") == F.col("full"), "left").select(
        "rid", "archive", part.cast("int").alias("part"), "page_id", "url", "length", "sha256", "record")


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``offset``, the place in the part; ties of the id go by url, digest and row."""
    order = Window.partitionBy("archive", "part").orderBy("page_id", "url", "sha256", "rid")
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def records(pages: DataFrame, **columns) -> DataFrame:
    """``(archive, part, offset, page_id, length, record)``: what is written, in the order of the offsets."""
    return placed(stored(pages, **columns)).select("archive", "part", "offset", "page_id", "length", "record")


def digests(rows: DataFrame) -> DataFrame:
    """``(archive, part, offset, page_id, length, sha256)`` of what ``records`` gives, or a replica of it holds.

    ``length`` is that of the bytes; digests are taken where they lie. A null record counts as empty.
    """
    record = F.coalesce("record", F.lit(b""))
    return rows.select("archive", "part", "offset", "page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha256"))


def _leaves(rows: DataFrame, side: int) -> DataFrame:
    """One row for each offset: what stands there, how often, and a digest of that which no order changes."""
    return rows.groupBy("archive", "part", "offset").agg(
        F.min("page_id").alias("page_id"), F.min("length").alias("length"), F.min("sha256").alias("sha256"),
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64("length", "sha256").cast("decimal(38,0)")).cast("string"),
                           F.min("sha256"), F.max("sha256"), F.min("length").cast("string"), F.max("length").cast("string")), 256).alias("hash"),
    ).withColumn("side", F.lit(side))


def _up(nodes: DataFrame, phase: str) -> DataFrame:
    """The parents of nodes: the digest of the children in order, the child's place with it."""
    if phase == "offset":
        at, address = F.col("offset"), ["archive", "part", F.floor(F.col("offset") / RANGE).cast("long").alias("node")]
    else:
        at = F.col(phase)
        # the last step of the archives joins what lies on both sides of zero
        above = F.lit(0) if phase == "top" else F.floor(F.col(phase) / FANOUT)
        at = F.col("archive") if phase == "top" else at
        phase = "archive" if phase == "top" else phase
        address = [above.cast("long").alias(c) if c == phase else F.col(c).cast("long").alias(c) for c in _ADDRESS]
    children = F.array_sort(F.collect_list(F.struct(at.alias("at"), "hash")))
    return nodes.groupBy("side", *address).agg(children.alias("c")).select(
        "side", *_ADDRESS, F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["hash"])), "|"), 256).alias("hash"))


def _phases(leaves: DataFrame) -> list[str]:
    """Which coordinate each level above the leaves folds."""
    offset, part, low, high = leaves.agg(F.max("offset"), F.max("part"), F.min("archive"), F.max("archive")).first()
    out, top = ["offset"], offset // RANGE
    while top > 0:
        out.append("node")
        top //= FANOUT
    while part > 0:
        out.append("part")
        part //= FANOUT
    while low < -1 or high > 0:
        out.append("archive")
        low, high = low // FANOUT, high // FANOUT
    return [*out, "top"]


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(archive, part, offset, page_id, length, expected, actual, state)``: the places at which
    two replicas differ; ``state`` is damaged, missing or extra.

    Both tables as ``digests`` gives them. A place that holds several records is
    one row, with the least digest of each side. Equal replicas, and two empty ones, give an
    empty table. ``page_id`` and ``length`` are the first replica's, where it has the record.
    """
    leaves = materialize(_leaves(first, 0).unionByName(_leaves(second, 1)))
    key = ["archive", "part", "offset"]
    sides = [
        F.max(F.when(F.col("side") == s, F.struct("page_id", "length", "sha256", "hash"))).alias(x) for s, x in ((0, "a"), (1, "b"))
    ]

    def differing(nodes: DataFrame, address: list[str]) -> DataFrame:
        two = [F.max(F.when(F.col("side") == s, F.col("hash"))).alias(x) for s, x in ((0, "x"), (1, "y"))]
        return nodes.groupBy(*address).agg(*two).where(~F.col("x").eqNullSafe(F.col("y"))).select(*address)

    def found(rows: DataFrame) -> DataFrame:
        state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("damaged")
        one = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("page_id", "length")]
        return rows.groupBy(*key).agg(*sides).where("a is null or b is null or a.hash <> b.hash").select(
            *key, *one, F.col("a.sha256").alias("expected"), F.col("b.sha256").alias("actual"), state.alias("state"))

    if leaves.isEmpty():
        return found(leaves)
    phases, levels = _phases(leaves), [leaves]
    for phase in phases:
        levels.append(materialize(_up(levels[-1], phase)))
    differ = materialize(differing(levels[-1], list(_ADDRESS)))
    for phase, nodes in zip(phases[::-1], levels[-2::-1]):
        if differ.isEmpty():
            return found(leaves.where("false"))
        folded = {"offset": "node", "top": "archive"}.get(phase, phase)
        above = F.lit(0) if phase == "top" else F.floor(F.col(phase) / (RANGE if phase == "offset" else FANOUT))
        parents = differ.select(*[F.col(c).alias(f"d_{c}") for c in _ADDRESS])
        own = [above.cast("long") if c == folded else F.col(c) for c in _ADDRESS]
        below = nodes.join(parents, [o == F.col(f"d_{c}") for o, c in zip(own, _ADDRESS)], "left_semi")
        if phase == "offset":
            return found(below)
        differ = materialize(differing(below, list(_ADDRESS)))
