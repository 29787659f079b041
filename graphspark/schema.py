"""The triple table, its predicates, and the ontology check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("s", T.StringType(), False),
    T.StructField("p", T.StringType(), False),
    T.StructField("o_kind", T.StringType(), False),
    T.StructField("o_id", T.StringType()),
    T.StructField("o_value", T.StringType()),
])

# The predicates of the graph, by topic.
PREDICATES = tuple(
    f"core:{name}"
    for name in (
        "contains referencesPackage entityType hasName hasPath discoveryMethod targetFramework hasPackageReference "
        "hasDeclaredVersion hasResolvedVersion fileKind isSolutionMember headBranch mainlineBranch hasHistoryEvent commitSha "
        "committedAtUtc authorName authorEmail editCount lastChangeCommitSha lastChangedAtUtc lastChangedBy isMergeToMainline "
        "targetBranch sourceBranchFileCommitCount hasSubmodule submoduleUrl containsNamespace containsType containsMember "
        "containsMethod declaresNamespace declaresType declaresMember declaresMethod declarationKind typeKind memberKind "
        "methodKind accessibility hasNamespace hasDeclaringType hasDeclaredType hasDeclaredTypeText hasReturnType "
        "hasReturnTypeText hasMethodParameter parameterOrdinal parameterName constantValue declarationSourceLocation "
        "resolutionStatus isPartialType arity genericParameter genericConstraint inherits implements implementsMethod "
        "overridesMethod calls readsProperty writesProperty readsField writesField isExtensionMethod extendsType "
        "dependsOnTypeDeclaration dependsOnTypeInMethodBody externalAssemblyName resolutionReason"
    ).split()
)
#: In the ontology, but emitted by nothing.
ONTOLOGY_ONLY = ("core:references",)

RELATIONS = {
    "ImplementsMethod": "core:implementsMethod", "OverridesMethod": "core:overridesMethod", "Calls": "core:calls",
    "ReadsProperty": "core:readsProperty", "WritesProperty": "core:writesProperty", "ReadsField": "core:readsField", "WritesField": "core:writesField",
}


def is_a(p: str) -> Column:
    """Whether a triple's predicate is the named one; pushes down to a scan of stored triples."""
    if f"core:{p}" not in PREDICATES:
        raise ValueError(f"no predicate {p}")
    return F.col("p") == f"core:{p}"


def ontology_problems(version: str | None, ids: list[str | None]) -> list[str]:
    """What is wrong with an ontology: a blank version or a blank predicate id."""
    found = [] if (version or "").strip() else ["ontology:version:missing"]
    return found + ["ontology:predicate:id:missing" for i in ids if not (i or "").strip()]
