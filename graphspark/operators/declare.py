"""Grouping discovered declarations, and running state over ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_types(parts: DataFrame) -> DataFrame:
    """Declarations (qualified_name, path, line, is_partial) as one row per type: its first part by path, and whether it is partial."""
    grouped = parts.groupBy("qualified_name").agg(F.min_by(F.struct("path", "line"), F.struct("path", "line")).alias("_first"), F.count(F.lit(1)).alias("parts"), F.max("is_partial").alias("_flag"))
    return grouped.select("qualified_name", F.col("_first.path").alias("path"), F.col("_first.line").alias("line"), "parts", ((F.col("parts") > 1) | F.col("_flag")).alias("is_partial"))


def merge_methods(found: DataFrame) -> DataFrame:
    """Methods (type, kind, name, arity, signatures, path, line, column) once per identity, with the first place."""
    key = F.concat_ws(":", "kind", "name", F.col("arity").cast("string"), F.array_join("signatures", "|"))
    return found.groupBy("type", key.alias("method_key")).agg(F.min(F.struct("path", "line", "column")).alias("place"), F.count(F.lit(1)).alias("declarations"))


def merge_members(found: DataFrame) -> DataFrame:
    """Members (type, kind, name, path, line, column) once per kind and name of a type, with the first place."""
    return found.groupBy("type", F.concat_ws(":", "kind", "name").alias("member_key")).agg(F.min(F.struct("path", "line", "column")).alias("place"), F.count(F.lit(1)).alias("declarations"))


def bodies(found: DataFrame) -> DataFrame:
    """Declarations (kind, has_body, ...) whose bodies are read: methods and constructors, not accessors, local functions or top-level code."""
    return found.filter(F.col("kind").isin("method", "constructor") & F.col("has_body"))


def method_signature(type_path: Column, name: Column, arity: Column, parameters: Column) -> Column:
    """Type.Name`arity(a, b)"""
    generic = F.when(arity > 0, F.concat(F.lit("`"), arity.cast("string"))).otherwise(F.lit(""))
    return F.concat(type_path, F.lit("."), name, generic, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))


def combine_namespace(parent: Column, name: Column) -> Column:
    """A nested namespace's full name; a name that already starts with its parent's stays; blank is <global>."""
    p, n = F.trim(F.coalesce(parent, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    joined = F.when(p == "", n).when((n == p) | F.startswith(n, F.concat(p, F.lit("."))), n).when(n == "", p).otherwise(F.concat(p, F.lit("."), n))
    return F.when(joined == "", "<global>").otherwise(joined)


def qualified_name(namespace: Column, declaring: Column, name: Column, arity: Column) -> Column:
    own = F.when(arity > 0, F.concat(name, F.lit("`"), arity.cast("string"))).otherwise(name)
    space = F.when(F.coalesce(namespace, F.lit("")).isin("", "<global>"), own).otherwise(F.concat(namespace, F.lit("."), own))
    return F.when(declaring.isNotNull(), F.concat(declaring, F.lit("."), own)).otherwise(space)


def accessibility_of(modifiers: Column) -> Column:
    """From a list of modifiers; internal without any."""
    has = lambda m: F.array_contains(modifiers, m)
    return (
        F.when(has("public"), "public").when(has("protected") & has("internal"), "protectedinternal").when(has("private") & has("protected"), "privateprotected")
        .when(has("protected"), "protected").when(has("private"), "private").otherwise("internal")
    )


def integral_constant(text: Column) -> Column:
    """Decimal, hexadecimal or binary text with underscores as a long; null for anything else."""
    clean = F.lower(F.regexp_replace(F.trim(text), "_", ""))
    return (
        F.when(clean.rlike(r"^0x[0-9a-f]{1,15}$"), F.conv(F.substring(clean, 3, 20), 16, 10).cast("long")).when(clean.rlike(r"^0b[01]{1,62}$"), F.conv(F.substring(clean, 3, 64), 2, 10).cast("long"))
        .when(clean.rlike(r"^[+-]?[0-9]{1,18}$"), clean.cast("long"))
    )


def enum_values(members: DataFrame) -> DataFrame:
    """members (enum, ordinal, initializer) with constant: a running count that explicit numbers set.

    Islands start at every initializer; within one, values count up from its number. After an initializer that
    is not a number, the next member starts again at 0.
    """
    order = Window.partitionBy("enum").orderBy("ordinal")
    island = F.count("initializer").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = members.withColumn("_island", island)
    inside = Window.partitionBy("enum", "_island").orderBy("ordinal")
    base, step = F.first("initializer").over(inside), F.row_number().over(inside) - 1
    number = F.when(base.isNull(), step).when(integral_constant(base).isNull(), step - 1).otherwise(integral_constant(base) + step)
    return marked.withColumn("constant", F.when(F.col("initializer").isNotNull() & integral_constant(F.col("initializer")).isNull(), F.trim("initializer")).otherwise(number.cast("string"))).drop("_island")


def sections(lines: DataFrame, file: str, number: str, text: str, header: str) -> DataFrame:
    """lines with section (how many headers, by regular expression, stand at or above the line) and is_header."""
    here = F.col(text).rlike(header)
    running = F.sum(here.cast("int")).over(Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("*", here.alias("is_header"), running.alias("section"))


def ini_sections(lines: DataFrame) -> DataFrame:
    """(file, section, name, path, url) of lines (file, n, text) of [kind "name"] sections; the last value of a key holds, and the first section of each path."""
    cut = sections(lines, "file", "n", "text", r"^\s*\[")
    key, value = F.lower(F.regexp_extract("text", r"^\s*([^=]*?)\s*=", 1)), F.regexp_extract("text", r"^[^=]*=\s*(.*?)\s*$", 1)
    pairs = cut.filter("section > 0").select("file", "section", "n", "is_header", key.alias("k"), value.alias("v"), "text")

    def pick(name: str) -> Column:
        own = ~F.col("is_header") & (F.col("k") == name)
        return F.max_by(F.when(own, F.col("v")), F.when(own, F.col("n")))

    title = F.max(F.when(F.col("is_header"), F.regexp_extract("text", r'"([^"]*)"', 1)))
    found = pairs.groupBy("file", "section").agg(title.alias("name"), pick("path").alias("path"), pick("url").alias("url")).filter("path IS NOT NULL")
    return found.groupBy("file", F.lower("path").alias("_p")).agg(F.min_by(F.struct("section", "name", "path", "url"), "section").alias("_s")).select("file", "_s.*")
