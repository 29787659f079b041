"""Relations between methods, members and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.kinds import resolution_status
from ..schema import RELATIONS
from .closure import base_types, implemented_interfaces
from .edges import edges
from .joins import nearest

# How a reference to a member is used, and whether it reads or writes.
ACCESS = [("read", True, False), ("assign", False, True), ("compound-assign", True, True), ("increment", True, True), ("ref-argument", True, True), ("out-argument", False, True), ("nameof", False, False)]


def simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def match_key(methods: DataFrame) -> DataFrame:
    """Methods of kind `method` with the key on which overrides and implementations match."""
    key = F.concat_ws("::", simple_name(F.col("name")), F.col("arity").cast("string"), F.array_join("signatures", "|"))
    return methods.filter("kind = 'method'").withColumn("match_key", key)


def implements_methods(methods: DataFrame, inherits: DataFrame, implements: DataFrame, types: DataFrame) -> DataFrame:
    """(method_id, target_id): methods of a type and the interface methods they implement.

    A name with an interface in front matches that interface only, by its full or last name.
    """
    keyed = match_key(methods)
    mine = keyed.select("method_id", "type_id", "match_key", F.when(F.contains("name", F.lit(".")), F.regexp_replace("name", r"\.[^.]*$", "")).alias("qualifier"))
    theirs = keyed.select(F.col("method_id").alias("target_id"), F.col("type_id").alias("interface_id"), "match_key")
    pairs = implemented_interfaces(inherits, implements).select(F.col("s").alias("type_id"), F.col("o").alias("interface_id"))
    names = types.select(F.col("type_id").alias("interface_id"), F.col("qualified_name").alias("_name"))
    found = mine.join(pairs, "type_id").join(theirs, ["interface_id", "match_key"]).join(names, "interface_id")
    fits = F.col("qualifier").isNull() | (F.col("qualifier") == F.col("_name")) | (simple_name(F.col("qualifier")) == simple_name(F.col("_name")))
    return found.filter(fits).select("method_id", "target_id").distinct()


def overridden_methods(methods: DataFrame, inherits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(method_id, target_id) of overrides and the nearest base method they match, and the overrides that match none."""
    keyed = match_key(methods)
    mine = keyed.filter("is_override").select("method_id", "type_id", "match_key")
    theirs = keyed.select(F.col("method_id").alias("target_id"), F.col("type_id").alias("base_id"), "match_key")
    above = base_types(inherits).select(F.col("s").alias("type_id"), F.col("o").alias("base_id"), "depth", "trail")
    found = nearest(mine.join(above, "type_id").join(theirs, ["base_id", "match_key"]), ["method_id"], [F.col("depth"), F.col("trail"), F.col("base_id"), F.col("target_id")])
    links = found.select("method_id", "target_id")
    return links, mine.join(links, "method_id", "left_anti").select("method_id")


def pick_overload(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (call_id, type_id, name, arity, param_types) with method_id if exactly one method fits.

    A single method by name, arity and number of parameters is taken; of several, the one with these
    parameter types. Constructors are never targets.
    """
    own = methods.filter("kind = 'method'").select("type_id", simple_name(F.col("name")).alias("name"), "arity", F.size("signatures").alias("_n"), F.array_join("signatures", "|").alias("_sig"), "method_id")
    asked = calls.select("call_id", "type_id", "name", "arity", F.size("param_types").alias("_n"), F.array_join("param_types", "|").alias("_want"))
    found = asked.join(own, ["type_id", "name", "arity", "_n"])
    exact = F.col("_sig") == F.col("_want")
    picked = found.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("_all"), F.min("method_id").alias("_any"), F.count(F.when(exact, 1)).alias("_same"), F.min(F.when(exact, F.col("method_id"))).alias("_one")
    )
    chosen = F.when(F.col("_all") == 1, F.col("_any")).when(F.col("_same") == 1, F.col("_one"))
    return calls.join(picked.select("call_id", chosen.alias("method_id")), "call_id", "left")


def call_outcomes(calls: DataFrame) -> DataFrame:
    """calls (symbol_bound, containing_type, internal, method_id) with outcome and reason.

    internal; external; or unresolved for a symbol that is not bound, has no containing type, or belongs to a
    declared type none of whose methods fits.
    """
    reason = (
        F.when(~F.col("symbol_bound"), "symbol-unresolved").when(F.col("containing_type").isNull(), "missing-containing-type")
        .when(F.col("internal") & F.col("method_id").isNull(), "internal-target-unmatched")
    )
    outcome = F.when(reason.isNotNull(), "unresolved").when(F.col("internal"), "internal").otherwise("external")
    return calls.select("*", outcome.alias("outcome"), reason.alias("reason"))


def call_triples(judged: DataFrame) -> DataFrame:
    """Calls (source_method_id, outcome, reason, method_id, external_type, target_text) as one triple per invocation.

    An unresolved call leads to a placeholder keyed by its reason and text, an external one to its type's stub.
    """
    target = (
        F.when(F.col("outcome") == "internal", F.col("method_id")).when(F.col("outcome") == "external", stable_id("external-type-stub", F.col("external_type")))
        .otherwise(stable_id("unresolved-call-target", F.concat("reason", F.lit(":"), F.trim("target_text"))))
    )
    return judged.select(F.col("source_method_id").alias("s"), F.lit("core:calls").alias("p"), target.alias("o"))


def call_diagnostics(judged: DataFrame) -> DataFrame:
    """(code, message) of calls that led nowhere."""
    unmatched = F.col("reason") == "internal-target-unmatched"
    code = F.when(unmatched, "method:call:internal-target-unmatched").otherwise("method:call:resolution:failed")
    return judged.filter("outcome = 'unresolved'").select(code.alias("code"), F.concat_ws(": ", "source_method_id", "reason", "target_text").alias("message"))


def access_edges(accesses: DataFrame) -> DataFrame:
    """accesses (method_id, member_id, is_field, access_kind) as distinct (s, p, o) reads and writes."""
    table = accesses.sparkSession.createDataFrame(ACCESS, "access_kind string, reads boolean, writes boolean")
    kind = F.when(F.col("is_field"), "Field").otherwise("Property")
    verbs = F.filter(F.array(F.when(F.col("reads"), F.lit("reads")), F.when(F.col("writes"), F.lit("writes"))), lambda v: v.isNotNull())
    spread = accesses.join(F.broadcast(table), "access_kind").select("method_id", "member_id", kind.alias("_kind"), F.explode(verbs).alias("_verb"))
    return spread.select(F.col("method_id").alias("s"), F.concat(F.lit("core:"), "_verb", "_kind").alias("p"), F.col("member_id").alias("o")).distinct()


def members_at(accesses: DataFrame, members: DataFrame) -> DataFrame:
    """Accesses joined to the member declared at their target's file, line and column."""
    return accesses.join(members, ["path", "line", "column"])


def body_dependencies(uses: DataFrame) -> DataFrame:
    """Type uses in bodies (method_id, target_id, in_nameof), once per body and target, those in nameof left out."""
    return uses.filter("NOT in_nameof").select("method_id", "target_id").distinct()


def method_relations(triples: DataFrame, methods: DataFrame, metadata: DataFrame) -> DataFrame:
    """All relations of declared methods: kind, source, target method or member or external type, status, reason.

    Rows are distinct; seq (the first triple's) keeps the order of relations that compare equal.
    """
    meta = metadata.select(F.col("id").alias("o"), F.col("name").alias("_name"), "entity_type", "external_assembly_name", "resolution_reason")
    parts = []
    for kind, p in RELATIONS.items():
        parts.append(edges(triples, p.removeprefix("core:")).withColumn("kind", F.lit(kind)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.join(methods.select(F.col("method_id").alias("s")), "s", "left_semi").join(meta, "o", "left")
    call, to_method = F.col("kind") == "Calls", F.coalesce(F.col("entity_type") == "method-declaration", F.lit(False))
    linked = F.col("kind").isin("ImplementsMethod", "OverridesMethod") | (call & to_method)
    outside = call & ~to_method

    def text(c: str) -> Column:
        return F.when(outside & (F.trim(c) != ""), F.col(c))

    return every.select(
        "kind", F.col("s").alias("source_method_id"), F.when(linked, F.col("o")).alias("target_method_id"),
        F.when(~linked & ~call, F.col("o")).alias("target_member_id"), F.when(outside, F.col("o")).alias("external_type_id"),
        F.when(outside, F.coalesce("_name", "o")).alias("external_type_name"), text("external_assembly_name").alias("external_assembly_name"),
        resolution_status(F.col("entity_type")).alias("status"), text("resolution_reason").alias("reason"), "seq",
    )
