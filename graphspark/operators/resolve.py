"""Resolving type names against the declared types, and the edges that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import could_be_external, plain_reference

NOT_FOUND = "type-not-found"


def candidates(reference: Column, namespace: Column, imports: Column, aliases: Column) -> Column:
    """Qualified names to try, best first: alias-expanded as it stands, in the own namespace, in each import (sorted)."""
    plain = plain_reference(reference)
    head, rest = F.substring_index(plain, ".", 1), F.regexp_replace(plain, r"^[^.]*\.", "")
    expanded = F.when(F.contains(plain, F.lit(".")) & F.array_contains(F.map_keys(aliases), head), F.concat(F.element_at(aliases, head), F.lit("."), rest)).otherwise(plain)
    global_ = F.coalesce(namespace, F.lit("")).isin("", "<global>")
    local = F.when(~global_, F.array(F.concat(namespace, F.lit("."), expanded))).otherwise(F.array().cast("array<string>"))
    imported = F.transform(F.array_sort(imports), lambda i: F.concat(i, F.lit("."), expanded))
    return F.concat(F.array(expanded), local, imported)


def resolve_names(references: DataFrame, types: DataFrame) -> DataFrame:
    """references (ref_id, reference, namespace, imports, aliases) with type_id, or null.

    A qualified name is looked up first; failing that, a simple name that exactly one type has. Both are
    equi-joins; the number of rows tried is that of the imports.
    """
    tried = references.select("ref_id", F.posexplode(candidates(F.col("reference"), F.col("namespace"), F.col("imports"), F.col("aliases"))).alias("_rank", "qualified_name"))
    by_name = types.select("qualified_name", F.col("type_id").alias("_id"))
    exact = tried.join(by_name, "qualified_name").groupBy("ref_id").agg(F.min_by("_id", "_rank").alias("_exact"))
    simple = types.groupBy(F.regexp_replace(F.element_at(F.split("qualified_name", r"\."), -1), "`.*$", "").alias("_simple")).agg(F.count(F.lit(1)).alias("_n"), F.first("type_id").alias("_only"))
    unique = simple.filter("_n = 1").drop("_n")
    named = references.withColumn("_simple", F.element_at(F.split(plain_reference(F.col("reference")), r"\."), -1))
    joined = named.join(exact, "ref_id", "left").join(unique, "_simple", "left")
    return joined.withColumn("type_id", F.coalesce("_exact", "_only")).drop("_exact", "_only", "_simple")


def link_outcome(resolved: DataFrame) -> DataFrame:
    """Adds outcome (internal, external, unresolved), target_id and target_type of resolved references.

    A plain dotted name that no type has gets a stub; other text gets a placeholder keyed by reason and text.
    Ids are functions of their keys, so no table of known stubs is kept.
    """
    plain = plain_reference(F.col("reference"))
    text = F.trim("reference")
    outcome = F.when(F.col("type_id").isNotNull(), "internal").when(could_be_external(plain), "external").otherwise("unresolved")
    target = (
        F.when(F.col("type_id").isNotNull(), F.col("type_id")).when(could_be_external(plain), stable_id("external-type-stub", plain))
        .otherwise(stable_id("unresolved-type-reference", F.concat(F.lit(NOT_FOUND + ":"), text)))
    )
    kinds = F.when(outcome == "internal", "type-declaration").when(outcome == "external", "external-type-stub").otherwise("unresolved-type-reference")
    return resolved.select("*", outcome.alias("outcome"), target.alias("target_id"), kinds.alias("target_type"))


def member_type_links(linked: DataFrame) -> DataFrame:
    """Member types: unresolved ones make no edge (a diagnostic only)."""
    return linked.filter("outcome <> 'unresolved'").select("ref_id", "target_id")


def signature_links(linked: DataFrame, p: str) -> DataFrame:
    """Return, parameter and extended types: the edge itself and a dependency of the method, both also for placeholders."""
    edge = linked.select(F.col("ref_id").alias("s"), F.lit(f"core:{p}").alias("p"), F.col("target_id").alias("o"))
    return edge.unionByName(linked.select(F.col("method_id").alias("s"), F.lit("core:dependsOnTypeDeclaration").alias("p"), F.col("target_id").alias("o")))


def base_links(linked: DataFrame, p: str) -> DataFrame:
    """Base types and interfaces (source_id, target_id) as triples: every outcome has its edge, to a stub or placeholder if need be."""
    return linked.select(F.col("source_id").alias("s"), F.lit(f"core:{p}").alias("p"), F.col("target_id").alias("o"))


def declaring_type_links(types: DataFrame) -> DataFrame:
    """types (type_id, qualified_name, declaring_name) as triples from nested types to the types that declare them."""
    outer = types.select(F.col("qualified_name").alias("declaring_name"), F.col("type_id").alias("o"))
    return types.join(outer, "declaring_name").select(F.col("type_id").alias("s"), F.lit("core:hasDeclaringType").alias("p"), "o")


def unwrapped(type_text: Column) -> Column:
    """The type that arrays, pointers, nullables and type arguments are made of; null for dynamic and blank text."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(type_text), r"(\s*(\[[\s,]*\]|\*|\?))+$", ""), r"<.*>", ""))
    return F.when((bare != "") & (bare != "dynamic"), F.regexp_replace(bare, "global::", ""))


def body_targets(uses: DataFrame, types: DataFrame) -> DataFrame:
    """uses (method_id, type_text) with target_id: the declared type of that name, else a stub; what could be neither is dropped."""
    named = uses.withColumn("qualified_name", unwrapped(F.col("type_text"))).join(types.select("qualified_name", "type_id"), "qualified_name", "left")
    stub = F.when(could_be_external(F.col("qualified_name")), stable_id("external-type-stub", F.col("qualified_name")))
    return named.withColumn("target_id", F.coalesce("type_id", stub)).filter("target_id IS NOT NULL").drop("qualified_name", "type_id")


def fallback_diagnostics(linked: DataFrame) -> DataFrame:
    return linked.filter("outcome = 'unresolved'").select(F.lit("type:resolution:fallback").alias("code"), F.trim("reference").alias("message"))
