"""Queries by name, and SQL fragments that their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that checks it."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LITERALS = (
    "entityType hasName hasPath discoveryMethod fileKind isSolutionMember headBranch mainlineBranch editCount commitSha committedAtUtc authorName authorEmail "
    "isMergeToMainline targetBranch sourceBranchFileCommitCount submoduleUrl typeKind memberKind methodKind accessibility isPartialType arity hasDeclaredTypeText "
    "hasReturnTypeText parameterOrdinal parameterName constantValue externalAssemblyName resolutionReason isExtensionMethod"
).split()


def graph(spark: SparkSession, sf_dir: str, *predicates: str, subjects: tuple[str, ...] = ()) -> DataFrame:
    return fixture.triples(spark, sf_dir, *predicates, subjects=subjects)


def with_graph(*predicates: str, meta: dict[str, str] | None = None, subjects: tuple[str, ...] = (), more: str = "") -> str:
    """WITH ... for DuckDB: triples, and meta(id, name, path, entity_type, ...) with `meta` as column: predicate."""
    names = {"entity_type": "entityType", **(meta or {})}
    wanted = dict.fromkeys([*predicates, "hasName", "hasPath", *names.values()])
    columns = "".join(f", coalesce(arg_max(o_value, seq) FILTER (p = 'core:{p}'), '') AS {c}" for c, p in names.items())
    pivot = f"meta AS (SELECT s AS id, coalesce(arg_max(o_value, seq) FILTER (p = 'core:hasName'), s) AS name, coalesce(arg_max(o_value, seq) FILTER (p = 'core:hasPath'), s) AS path{columns} FROM triples WHERE o_kind = 'L' GROUP BY s)"
    return f"WITH {fixture.triples_sql(*wanted, subjects=subjects)}, {pivot}{', ' + more if more else ''}"


def edge(p: str) -> str:
    """A table of the distinct edges of a predicate, as a subquery."""
    return f"(SELECT s, o_id AS o, min(seq) AS seq FROM triples WHERE p = 'core:{p}' AND o_kind = 'E' GROUP BY ALL)"


STATUS = (
    "CASE WHEN {0} IN ('type-declaration', 'method-declaration', 'member-declaration') THEN 'Resolved' WHEN {0} IN ('external-type-stub', 'external-method-stub', 'external-member-stub') "
    "THEN 'ExternalStub' WHEN {0} = 'unresolved-type-reference' THEN 'SourceTextFallback' ELSE 'Unresolved' END"
)
