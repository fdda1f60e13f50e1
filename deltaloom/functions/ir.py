"""Projections of parsed facts: names that imports bind, lists of names, the typed form of a file's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import _c

FUNCTIONS, CONSTANTS = ("Function",), ("Constant",)


def local_name(name) -> Column:
    """What an imported name is called in the file."""
    return F.coalesce(_c(name)["alias"], _c(name)["name"])


def remote_name(name, is_default: Column) -> Column:
    """What it is called where it comes from; a default import's is ``default``."""
    return F.when(is_default, F.lit("default")).otherwise(_c(name)["name"])


def specifier(name, is_default: Column, is_namespace: Column, names: Column) -> Column:
    """SideEffect, Namespace, Default or Named; of a default import only the first name is the default."""
    first = F.get(names, F.lit(0))["name"] == _c(name)["name"]
    return F.when(F.size(names) == 0, "SideEffect").when(is_namespace, "Namespace").when(is_default & first, "Default").otherwise("Named")


def imported_names(parsed: DataFrame) -> DataFrame:
    """``(path, source, kind, local, remote, line)``: a row for each name that a file imports, one for an import without names."""
    i = parsed.select("path", F.posexplode("imports").alias("pos", "i")).select("path", "pos", "i.*")
    n = i.withColumn("all", F.col("names")).select("*", F.explode_outer("names").alias("n"))
    kind = specifier("n", F.col("is_default"), F.col("is_namespace"), F.col("all"))
    return n.select("path", "source", kind.alias("kind"), local_name("n").alias("local"), remote_name("n", kind == "Default").alias("remote"), "line")


def names_of(parsed: DataFrame) -> DataFrame:
    """``(path, definitions, exports, sources)``: the file's names as lists, in their order."""
    return parsed.select(
        "path", F.transform("definitions", lambda d: d["name"]).alias("definitions"), F.transform("exports", lambda e: e["name"]).alias("exports"),
        F.transform("imports", lambda i: i["source"]).alias("sources"))


def to_ir(parsed: DataFrame) -> DataFrame:
    """Definitions parted by kind, and calls with the arguments that the file's data flow knows."""
    part = lambda keep: F.filter("definitions", keep)
    return parsed.select(
        "path", "language", part(lambda d: d["kind"].isin(*FUNCTIONS)).alias("functions"), part(lambda d: ~d["kind"].isin(*FUNCTIONS, *CONSTANTS)).alias("types"),
        part(lambda d: d["kind"].isin(*CONSTANTS)).alias("constants"), "imports", "exports", "call_sites", "assignments", "bases")


def from_ir(ir: DataFrame) -> DataFrame:
    """The inverse of ``to_ir``: definitions in the order of their lines, of one line functions before types before constants."""
    whole = F.concat("functions", "types", "constants")
    placed = F.transform(whole, lambda d, i: F.struct(d["start_line"].alias("at"), i.alias("i"), d.alias("d")))
    return ir.select("path", "language", F.transform(F.array_sort(placed), lambda x: x["d"]).alias("definitions"), "imports", "exports", "call_sites",
        "assignments", "bases")
