"""Keyed stores as tables: cache keys, eviction, replayed answers, comments, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cache_key(base: Column, head: Column, path) -> Column:
    """An aggregate: SHA-256 over base, head and the sorted paths, each with a line end behind it."""
    none = lambda c: F.coalesce(c, F.lit("none"))
    listed = F.array_join(F.sort_array(F.collect_list(path)), "\n")
    return F.sha2(F.concat(none(base), F.lit("\n"), none(head), F.lit("\n"), listed, F.lit("\n")), 256)


def content_key(path, source) -> Column:
    """SHA-256 of path, a zero byte and the source."""
    return F.sha2(F.concat(F.col(path).cast("binary"), F.lit(b"\0"), F.col(source).cast("binary")), 256)


def evictions(entries: DataFrame, store: str, age: str, size: str, limit: int) -> DataFrame:
    """Entries of each store, newest first, with the running size; those past the limit go."""
    w = Window.partitionBy(store).orderBy(F.desc(age)).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("kept_bytes", F.sum(size).over(w)).withColumn("evicted", F.col("kept_bytes") > limit)


def misses(wanted: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(store.select(key), key, "left_anti")


def replay(requests: DataFrame, cassettes: DataFrame, key: str = "key", strict: bool = True) -> DataFrame:
    """Recorded answers of requests; a request without one is an error if ``strict``, else null."""
    j = requests.join(cassettes.select(key, "response"), key, "left")
    if strict:
        j = j.withColumn("response", F.coalesce("response", F.raise_error(F.concat(F.lit("no recorded answer for "), key)).cast("string")))
    return j


def request_key(*parts) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def template_key(template: str) -> Column:
    """The digest by which answers to an older wording of a prompt are told apart."""
    return F.sha2(F.lit(template), 256)


def recorded(requests: DataFrame, cassettes: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """The cassettes with the new ``answers(key, response)`` to requests that had none; what was recorded stays."""
    new = misses(requests, cassettes, key).join(answers, key)
    return cassettes.select(key, "response").unionByName(new.select(key, "response"))


def vector_keys(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``key``, the digest under which a text's vector is stored; a null text has none."""
    return texts.withColumn("key", F.sha2(F.col(text_col).cast("string"), 256))


def cached_vectors(texts: DataFrame, store: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts whose vector ``store(key, vector)`` holds, with it, and the distinct texts still to be embedded."""
    keyed = vector_keys(texts, text_col)
    held = store.groupBy("key").agg(F.first("vector").alias("vector"))
    missing = keyed.join(held, "key", "left_anti").where("key is not null").groupBy("key").agg(F.first(text_col).alias(text_col))
    return keyed.join(held, "key"), missing


def upsert(store: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Store and changes, the last change of each key; changes with ``deleted`` take the key away."""
    both = store.withColumns({order: F.lit(-1).cast("long"), "deleted": F.lit(False)}).unionByName(changes)
    best = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), order).alias("b"))
    return best.where("not b.deleted").select(key, *[f"b.{c}" for c in store.columns if c != key])


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def load_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are none are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "version string, groups array<struct<name:string,files:array<string>,review_order:bigint,description:string>>, unassigned_files array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_comments(comments: DataFrame) -> DataFrame:
    """Review comments of a file or group as text, in the order of their creation."""
    place = F.when(F.col("start_line").isNotNull(),
        F.format_string("%s:%d-%d", "file_path", "start_line", F.coalesce("end_line", "start_line"))).otherwise(F.coalesce("file_path", "group_id"))
    code = F.when(F.col("selected_code").isNotNull(), F.concat(F.lit("\n```\n"), "selected_code", F.lit("\n```"))).otherwise("")
    block = F.concat(place, code, F.lit("\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    rows = F.sort_array(F.collect_list(F.struct("created_at", "id", block.alias("block"))))
    return comments.groupBy("analysis").agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias("export"))
