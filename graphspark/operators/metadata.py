"""The entity pivot: literals of an entity as one wide row, the last value of each predicate winning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_bool, parse_int

#: Column, predicate, default, parser.
_TEXT = {
    "entity_type": ("entityType", ""), "discovery_method": ("discoveryMethod", ""), "file_kind": ("fileKind", ""), "head_branch": ("headBranch", ""),
    "mainline_branch": ("mainlineBranch", ""), "commit_sha": ("commitSha", ""), "committed_at_utc": ("committedAtUtc", ""), "author_name": ("authorName", ""),
    "author_email": ("authorEmail", ""), "target_branch": ("targetBranch", ""), "submodule_url": ("submoduleUrl", ""), "type_kind": ("typeKind", ""),
    "member_kind": ("memberKind", ""), "method_kind": ("methodKind", ""), "accessibility": ("accessibility", ""), "declared_type_text": ("hasDeclaredTypeText", None),
    "return_type_text": ("hasReturnTypeText", None), "parameter_name": ("parameterName", ""), "constant_value": ("constantValue", None),
    "external_assembly_name": ("externalAssemblyName", ""), "resolution_reason": ("resolutionReason", ""),
}
_INT = {"edit_count": ("editCount", 0), "source_branch_file_commit_count": ("sourceBranchFileCommitCount", 0), "arity": ("arity", 0), "parameter_ordinal": ("parameterOrdinal", -1)}
_BOOL = {"is_solution_member": "isSolutionMember", "is_merge_to_mainline": "isMergeToMainline", "is_partial_type": "isPartialType", "is_extension_method": "isExtensionMethod"}


def _last(p: str) -> Column:
    """The value of the predicate's last triple, in one pass with the others."""
    here = F.col("p") == f"core:{p}"
    return F.max_by(F.when(here, F.coalesce("o_value", F.lit(""))), F.when(here, F.col("seq")))


def entity_metadata(triples: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """id, name, path and the other scalar columns (or those named), for entities with any literal.

    One aggregation by subject gives all columns; predicates not asked for are filtered out before it, but
    an entity whose literals are all of other predicates still gets its row.
    """
    wanted = set(columns) if columns is not None else {*_TEXT, *_INT, *_BOOL}
    picked: list[Column] = [F.coalesce(_last("hasName"), F.col("s")).alias("name"), F.coalesce(_last("hasPath"), F.col("s")).alias("path")]
    for name, (p, default) in _TEXT.items():
        if name in wanted:
            picked.append((_last(p) if default is None else F.coalesce(_last(p), F.lit(default))).alias(name))
    for name, (p, default) in _INT.items():
        if name in wanted:
            picked.append(F.coalesce(parse_int(_last(p), default), F.lit(default)).alias(name))
    for name, p in _BOOL.items():
        if name in wanted:
            picked.append(parse_bool(_last(p)).alias(name))
    return triples.filter(F.col("o_kind") == "L").groupBy("s").agg(*picked).withColumnRenamed("s", "id")
