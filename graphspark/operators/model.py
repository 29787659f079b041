"""The read model: tables of a repository's structure, projected from triples.

Every function takes the triples and the entity metadata and returns a DataFrame; lists inside rows are
ordered arrays. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import ACCESSIBILITY, MEMBER_KIND, METHOD_KIND, TYPE_KIND, named, resolution_status
from ..functions.text import location, parse_location, parse_utc
from .edges import caseless_set, edges, first, last, literals, ordered, typed


def of_type(metadata: DataFrame, entity_type: str) -> DataFrame:
    return metadata.filter(F.col("entity_type") == entity_type)


def repository(metadata: DataFrame) -> DataFrame:
    return of_type(metadata, "repository").select("id", "name", "path", "head_branch", "mainline_branch")


def contained(triples: DataFrame, metadata: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent_id, child_id) of contains edges between entities of two types."""
    pairs = edges(triples, "contains").select(F.col("s").alias("parent_id"), F.col("o").alias("child_id"))
    return typed(typed(pairs, "parent_id", metadata, parent), "child_id", metadata, child)


def solutions(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Solutions of the repository, with their projects by path."""
    own = contained(triples, metadata, "repository", "solution").select(F.col("child_id").alias("id"))
    inside = contained(triples, metadata, "solution", "project").join(metadata.select(F.col("id").alias("child_id"), F.col("path").alias("_path")), "child_id")
    lists = inside.groupBy(F.col("parent_id").alias("id")).agg(ordered([F.col("_path")], F.col("child_id")).alias("project_ids"))
    empty = F.array().cast("array<string>")
    return own.join(metadata.select("id", "name", "path"), "id").join(lists, "id", "left").withColumn("project_ids", F.coalesce("project_ids", empty))


def projects(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Projects in the repository or in a solution, once each, with frameworks and package ids."""
    direct, inside = contained(triples, metadata, "repository", "project"), contained(triples, metadata, "solution", "project")
    ids = direct.unionByName(inside).select(F.col("child_id").alias("id")).distinct()
    frameworks = caseless_set(literals(triples, "targetFramework"), "s", "v").groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_list("v")).alias("target_frameworks"))
    used = project_packages(triples, metadata).join(metadata.select(F.col("id").alias("package_id"), F.col("name").alias("_name")), "package_id")
    packages_ = used.groupBy(F.col("project_id").alias("id")).agg(ordered([F.col("_name")], F.col("package_id")).alias("package_ids"))
    empty = F.array().cast("array<string>")
    out = ids.join(metadata.select("id", "name", "path", "discovery_method"), "id").join(frameworks, "id", "left").join(packages_, "id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("target_frameworks", "package_ids")})


def project_packages(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    pairs = edges(triples, "referencesPackage").select(F.col("s").alias("project_id"), F.col("o").alias("package_id"))
    return typed(pairs, "project_id", metadata, "project")


def memberships(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """(package_id, project_id, versions) of every package reference; its first package and first versions hold."""
    held = edges(triples, "hasPackageReference").select(F.col("s").alias("project_id"), F.col("o").alias("reference_id"))
    held = typed(typed(held, "project_id", metadata, "project"), "reference_id", metadata, "package-reference")
    target = typed(edges(triples, "referencesPackage"), "s", metadata, "package-reference")
    target = first(target, "s", "o").select(F.col("s").alias("reference_id"), F.col("o").alias("package_id"))
    versions = first_versions(triples).select(F.col("s").alias("reference_id"), "declared_version", "resolved_version")
    return held.join(target, "reference_id").join(versions, "reference_id", "left").select("package_id", "project_id", "reference_id", "declared_version", "resolved_version")


def first_versions(triples: DataFrame) -> DataFrame:
    """The first declared and the first resolved version of every subject."""
    here = triples.filter(F.col("p").isin("core:hasDeclaredVersion", "core:hasResolvedVersion") & (F.col("o_kind") == "L"))

    def pick(p: str):
        own = F.col("p") == f"core:{p}"
        return F.min_by(F.when(own, F.coalesce("o_value", F.lit(""))), F.when(own, F.col("seq")))

    return here.groupBy("s").agg(pick("hasDeclaredVersion").alias("declared_version"), pick("hasResolvedVersion").alias("resolved_version"))


def package_versions(triples: DataFrame, p: str) -> DataFrame:
    """(s, v): versions as a set that ignores letter case, of subjects of any type."""
    return caseless_set(literals(triples, p), "s", "v")


def packages(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Packages that some project references, with versions and memberships by (path, name, id)."""
    ids = project_packages(triples, metadata).select(F.col("package_id").alias("id")).distinct()
    ids = typed(ids, "id", metadata, "package")
    about = metadata.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), F.col("path").alias("project_path"))
    members = memberships(triples, metadata).join(about, "project_id")
    row = F.struct("project_path", "project_name", "project_id", "declared_version", "resolved_version")
    lists = members.groupBy(F.col("package_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("memberships"))
    out = ids.join(metadata.select("id", "name", F.col("path").alias("canonical_key")), "id").join(lists, "id", "left")
    for p, column in (("hasDeclaredVersion", "declared_versions"), ("hasResolvedVersion", "resolved_versions")):
        versions = package_versions(triples, p).groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_list("v")).alias(column))
        out = out.join(versions, "id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out


def file_events(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """(file_id, event columns): a file's history, joined to the events' metadata."""
    pairs = edges(triples, "hasHistoryEvent").select(F.col("s").alias("file_id"), F.col("o").alias("id"))
    columns = ["id", "entity_type", "commit_sha", "committed_at_utc", "author_name", "author_email", "is_merge_to_mainline", "target_branch", "source_branch_file_commit_count"]
    found = pairs.join(metadata.select(*columns), "id").filter("entity_type = 'file-history-event'")
    return found.withColumn("committed", parse_utc(F.col("committed_at_utc"))).drop("entity_type")


def files(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files of the repository with their newest change (by time, then commit) and number of edits.

    The newest change is an aggregate over the events, not a sort of each file's history; an edit count of
    zero gives way to the number of events.
    """
    ids = contained(triples, metadata, "repository", "file").select(F.col("child_id").alias("id"))
    newest = F.struct((-F.unix_micros(F.col("committed"))).alias("t"), F.col("commit_sha").alias("sha"))
    change = F.struct("commit_sha", "committed_at_utc", "author_name", "author_email")
    history = file_events(triples, metadata).groupBy(F.col("file_id").alias("id")).agg(F.min_by(change, newest).alias("last_change"), F.count(F.lit(1)).alias("events"))
    out = ids.join(metadata.select("id", "name", "path", "file_kind", "is_solution_member", F.col("edit_count").alias("_edits")), "id").join(history, "id", "left")
    edits = F.when(F.col("_edits") > 0, F.col("_edits").cast("long")).otherwise(F.coalesce("events", F.lit(0)))
    return out.select("id", "name", "path", "file_kind", "is_solution_member", edits.alias("edit_count"), "last_change")


def ranked_events(triples: DataFrame, metadata: DataFrame, merges_only: bool = False) -> DataFrame:
    """Events with their rank in their file: newest first, then by commit."""
    from pyspark.sql import Window

    found = file_events(triples, metadata)
    if merges_only:
        found = found.filter("is_merge_to_mainline")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("committed"), "commit_sha", "id")))


def submodules(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    ids = edges(triples, "hasSubmodule").select(F.col("o").alias("id")).distinct()
    return ids.join(of_type(metadata, "submodule").select("id", "name", "path", F.col("submodule_url").alias("url")), "id")


def locations(triples: DataFrame) -> DataFrame:
    """(s, path, line, column): well-formed source locations, once each."""
    parsed = literals(triples, "declarationSourceLocation").select("s", parse_location(F.col("v")).alias("_l")).filter("_l IS NOT NULL")
    return parsed.select("s", "_l.path", "_l.line", "_l.column").distinct()


def location_lists(triples: DataFrame) -> DataFrame:
    """(id, locations): each entity's locations by path, line and column, as texts."""
    rows = F.array_sort(F.collect_list(F.struct("path", "line", "column")))
    return locations(triples).groupBy(F.col("s").alias("id")).agg(F.transform(rows, lambda x: location(x["path"], x["line"], x["column"])).alias("locations"))


def declaration_files(triples: DataFrame, p: str) -> DataFrame:
    """(id, file_id): the files that declare an entity."""
    return edges(triples, p).select(F.col("o").alias("id"), F.col("s").alias("file_id"))


def namespaces(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Namespaces with parent (the last edge holds), children and types by path."""
    inside = edges(triples, "containsNamespace")
    ids = of_type(metadata, "namespace").select("id").unionByName(typed(inside, "o", metadata, "namespace").select(F.col("o").alias("id"))).distinct()
    about = metadata.select(F.col("id").alias("o"), F.col("path").alias("_path"))
    parents = last(typed(inside, "s", metadata, "namespace").withColumnRenamed("s", "parent_id"), "o", "parent_id").withColumnRenamed("o", "id")
    children = typed(inside, "s", metadata, "namespace").join(about, "o").groupBy(F.col("s").alias("id")).agg(ordered([F.col("_path")], F.col("o")).alias("child_ids"))
    types_ = typed(edges(triples, "containsType"), "s", metadata, "namespace").join(about, "o").groupBy(F.col("s").alias("id")).agg(ordered([F.col("_path")], F.col("o")).alias("type_ids"))
    out = ids.join(metadata.select("id", "name", "path"), "id").join(parents, "id", "left").join(children, "id", "left").join(types_, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("child_ids", "type_ids")})


def reference_rows(triples: DataFrame, metadata: DataFrame, p: str) -> DataFrame:
    """(s, target_id, text, status) of type references by a predicate; the text is the target's name."""
    about = metadata.select(F.col("id").alias("o"), F.col("name").alias("_name"), "entity_type")
    found = edges(triples, p).join(about, "o", "left")
    return found.select("s", F.col("o").alias("target_id"), F.coalesce("_name", "o").alias("text"), resolution_status(F.col("entity_type")).alias("status"), "seq")


def types(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Types with namespace and declaring type (the first edges hold), kind, accessibility and reference lists."""
    own = of_type(metadata, "type-declaration").select(
        "id", "name", "path", named(F.col("type_kind"), TYPE_KIND).alias("kind"), named(F.col("accessibility"), ACCESSIBILITY).alias("accessibility"), "arity", "is_partial_type"
    )
    holders = edges(triples, "containsType")
    space = first(typed(holders, "s", metadata, "namespace").withColumnRenamed("s", "namespace_id"), "o", "namespace_id").withColumnRenamed("o", "id")
    outer = first(edges(triples, "hasDeclaringType"), "s", "o").select(F.col("s").alias("id"), F.col("o").alias("declaring_type_id"))
    out = own.join(space, "id", "left").join(outer, "id", "left")
    for p, column in (("inherits", "bases"), ("implements", "interfaces")):
        rows = F.array_sort(F.collect_list(F.struct("text", "target_id", "status")))
        out = out.join(reference_rows(triples, metadata, p).groupBy(F.col("s").alias("id")).agg(rows.alias(column)), "id", "left")
    for p, column in (("genericParameter", "generic_parameters"), ("genericConstraint", "generic_constraints")):
        out = out.join(literals(triples, p).groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set("v")).alias(column)), "id", "left")
    return out


def members(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Members with declaring type (those without one are dropped) and declared type: the edge, else the text."""
    own = of_type(metadata, "member-declaration").select(
        "id", "name", "path", named(F.col("member_kind"), MEMBER_KIND).alias("kind"), named(F.col("accessibility"), ACCESSIBILITY).alias("accessibility"), "declared_type_text", "constant_value"
    )
    holder = first(edges(triples, "containsMember").withColumnRenamed("s", "type_id"), "o", "type_id").withColumnRenamed("o", "id")
    refs = reference_rows(triples, metadata, "hasDeclaredType")
    best = refs.groupBy(F.col("s").alias("id")).agg(F.min_by(F.struct("target_id", "text", "status"), "seq").alias("_ref"))
    return _with_reference(own.join(holder, "id").join(best, "id", "left"), "declared_type", "declared_type_text")


def _with_reference(df: DataFrame, out: str, text: str) -> DataFrame:
    has_text = F.trim(F.coalesce(text, F.lit(""))) != ""
    return df.select(
        *[c for c in df.columns if c not in ("_ref", text)], F.col("_ref.target_id").alias(f"{out}_id"),
        F.when(F.col("_ref").isNotNull(), F.col("_ref.text")).when(has_text, F.col(text)).alias(out),
        F.when(F.col("_ref").isNotNull(), F.col("_ref.status")).when(has_text, "SourceTextFallback").alias(f"{out}_status"),
    )


def parameters(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """(method_id, id, ordinal, name, type...): parameters of methods; the type is the edge, else the text."""
    pairs = edges(triples, "hasMethodParameter").select(F.col("s").alias("method_id"), F.col("o").alias("id"))
    own = pairs.join(of_type(metadata, "method-parameter").select("id", F.col("parameter_ordinal").alias("ordinal"), "name", "declared_type_text"), "id")
    best = reference_rows(triples, metadata, "hasDeclaredType").groupBy(F.col("s").alias("id")).agg(F.min_by(F.struct("target_id", "text", "status"), "seq").alias("_ref"))
    return _with_reference(own.join(best, "id", "left"), "type", "declared_type_text")


def methods(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Methods with declaring type (those without one are dropped), return type and parameter types in order."""
    own = of_type(metadata, "method-declaration").select(
        "id", "name", F.col("path").alias("signature"), named(F.col("method_kind"), METHOD_KIND).alias("kind"), named(F.col("accessibility"), ACCESSIBILITY).alias("accessibility"),
        "arity", "is_extension_method", "return_type_text",
    )
    holder = first(edges(triples, "containsMethod").withColumnRenamed("s", "type_id"), "o", "type_id").withColumnRenamed("o", "id")
    best = reference_rows(triples, metadata, "hasReturnType").groupBy(F.col("s").alias("id")).agg(F.min_by(F.struct("target_id", "text", "status"), "seq").alias("_ref"))
    listed = parameters(triples, metadata).groupBy(F.col("method_id").alias("id")).agg(ordered([F.col("ordinal"), F.col("name")], F.coalesce("type", F.lit("unknown"))).alias("parameter_types"))
    out = _with_reference(own.join(holder, "id").join(best, "id", "left"), "return_type", "return_type_text").join(listed, "id", "left")
    return out.withColumn("parameter_types", F.coalesce("parameter_types", F.array().cast("array<string>")))
