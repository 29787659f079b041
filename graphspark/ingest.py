"""One run over a repository: facts to triples, triples to the read model, the model to pages, and publication.

What only a compiler knows (calls, accesses, types used in bodies) comes in as rows of `bound`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ids
from .functions.text import directory_of, file_kind, file_name, location, looks_like_interface, plain_reference
from .operators import declare, emit, joins, model, pages, publish, relations, render, resolve, usage
from .operators.metadata import entity_metadata
from .sinks import publisher
from .sources import csharp, git, readers
from .storage import stored

#: What `bound` holds: triples without their numbers.
FACTS = "s string, p string, o_kind string, o_id string, o_value string"
_READ = (".cs", ".csproj", ".sln", ".slnx", ".gitmodules")


def repository_id(name: str) -> str:
    return "repository:" + hashlib.sha256(f"repository:{name}".encode()).hexdigest()


class Facts:
    """Facts of several families, numbered in the end by family, then by key, then as they were named."""

    def __init__(self):
        self.parts: list[DataFrame] = []

    def add(self, rows: DataFrame, subject: Column, *facts: Column, key: Column | None = None) -> None:
        spread = rows.select(subject.alias("s"), F.lit(len(self.parts)).alias("family"), (subject if key is None else key).alias("key"), F.posexplode(F.array(*facts)).alias("i", "f"))
        self.parts.append(spread.select("family", "key", "i", "s", "f.p", "f.o_kind", "f.o_id", "f.o_value"))

    def add_edges(self, rows: DataFrame) -> None:
        """Rows (s, p, o)."""
        self.parts.append(rows.select(F.lit(len(self.parts)).alias("family"), F.col("s").alias("key"), F.lit(0).alias("i"), "s", "p", F.lit("E").alias("o_kind"), F.col("o").alias("o_id"), F.lit(None).cast("string").alias("o_value")))

    def triples(self, bound: DataFrame | None) -> DataFrame:
        parts = self.parts
        if bound is not None:
            parts = [*parts, bound.select(F.lit(len(parts)).alias("family"), F.col("s").alias("key"), F.lit(0).alias("i"), "s", "p", "o_kind", "o_id", "o_value")]
        every = reduce(DataFrame.unionByName, parts)
        # A literal without a value is a fact that a row does not have.
        real = every.filter("o_id IS NOT NULL OR o_value IS NOT NULL")
        numbered = publish.ranked(real, ["family", "key", "i", "p", "o_id", "o_value"], "seq")
        return stored(numbered.select(F.col("seq").cast("long").alias("seq"), "s", "p", "o_kind", "o_id", "o_value"), "run-triples", "p")


def _entities(facts: Facts, rows: DataFrame, kind: str, id_: str, name: str, path: str, *more: Column) -> None:
    facts.add(rows, F.col(id_), *emit.entity(kind, F.col(name), F.col(path)), *more)


def _structure(spark: SparkSession, root: str, name: str, texts: DataFrame, tracked: list[str], facts: Facts) -> DataFrame:
    """Repository, files, history, solutions, projects, packages and submodules; returns the projects."""
    own = F.lit(repository_id(name))
    mainline = git.mainline_branch(root)
    facts.add(spark.range(1), own, *emit.entity("repository", F.lit(name), F.lit(name)), emit.literal("headBranch", F.lit(git.head_branch(root))), emit.literal("mainlineBranch", F.lit(mainline)))
    linked = stored(readers.solution_projects(texts), "run-solutions")
    found = texts.filter(F.lower("path").endswith(".csproj"))
    projects = stored(readers.project_facts(found).withColumn("id", ids.stable_id("project", F.col("path"))), "run-projects")
    members = joins.under_any(spark.createDataFrame([(p,) for p in tracked], "path string"), "path", linked.select(directory_of(F.col("project_path")).alias("_d")), "_d").withColumn("member", F.lit(True))
    files = spark.createDataFrame([(p,) for p in tracked], "path string").join(members, "path", "left").withColumn("id", ids.stable_id("file", F.col("path"))).withColumn("name", file_name(F.col("path")))
    _entities(facts, files, "file", "id", "name", "path", emit.literal("fileKind", file_kind(F.col("path"))), emit.literal("isSolutionMember", F.coalesce("member", F.lit(False))))
    facts.add(files, own, emit.edge("contains", F.col("id")), key=F.col("path"))

    history = git.history(spark, root, tracked)
    merges = stored(git.mainline_merges(spark, root, tracked, mainline), "run-merges")
    fresh = merges.select("path", "sha", "parents").collect()  # one row per mainline merge and file
    counted = readers.source_branch_commits(git.branch_commits(spark, root, [(r.path, r.sha, list(r.parents)) for r in fresh]), merges)
    events = readers.file_history(history, counted).withColumn("id", ids.stable_id("file-history-event", F.concat_ws(":", "path", "sha")))
    merged = lambda c: F.when(F.col("is_merge"), c)
    _entities(
        facts, events, "file-history-event", "id", "sha", "path", emit.literal("commitSha", F.col("sha")), emit.literal("committedAtUtc", F.col("ts_utc")), emit.literal("authorName", F.col("author_name")), emit.literal("authorEmail", F.col("author_email")),
        emit.literal("isMergeToMainline", merged(F.lit("true"))), emit.literal("targetBranch", merged(F.lit(mainline))), emit.literal("sourceBranchFileCommitCount", merged(F.coalesce("source_commit_count", F.lit(0)))),
    )
    facts.add(events, ids.stable_id("file", F.col("path")), emit.edge("hasHistoryEvent", F.col("id")), key=F.concat_ws(":", "path", "sha"))

    solutions = readers.discover_solutions(texts).withColumn("id", ids.stable_id("solution", F.col("path"))).withColumn("name", file_name(F.col("path")))
    _entities(facts, solutions, "solution", "id", "name", "path")
    facts.add(solutions, own, emit.edge("contains", F.col("id")), key=F.col("path"))
    held = linked.join(projects.select(F.col("path").alias("project_path"), "id"), "project_path")
    facts.add(held, ids.stable_id("solution", F.col("solution_path")), emit.edge("contains", F.col("id")), key=F.concat_ws(":", "solution_path", "project_path"))
    _entities(facts, projects, "project", "id", "name", "path", emit.literal("discoveryMethod", F.lit("fallback")))
    facts.add(projects.join(held.select("id"), "id", "left_anti"), own, emit.edge("contains", F.col("id")), key=F.col("path"))
    facts.add(projects.select("id", F.posexplode("target_frameworks").alias("n", "v")), F.col("id"), emit.literal("targetFramework", F.col("v")), key=F.concat_ws(":", "id", F.lpad(F.col("n").cast("string"), 4, "0")))

    locks = [(p, text) for p in (r.path for r in found.select("path").collect()) if (text := _lock_text(root, p))]
    resolved = readers.resolved_packages(spark.createDataFrame(locks, "project_path string, text string")).select("project_path", "package_key", "resolved_version")
    asked = readers.package_references(found).withColumn("package_key", F.lower("package_id"))
    references = asked.join(resolved, ["project_path", "package_key"], "left").groupBy("project_path", "package_key").agg(F.min("package_id").alias("package_id"), F.min("declared_version").alias("declared_version"), F.min("resolved_version").alias("resolved_version"))
    references = stored(references.withColumn("key", F.concat_ws(":", "project_path", "package_key")).withColumn("id", ids.stable_id("package-reference", F.col("key"))).withColumn("package", ids.stable_id("package", F.col("package_key"))), "run-references")
    _entities(facts, references.groupBy("package", "package_key").agg(F.min("package_id").alias("name")), "package", "package", "name", "package_key")
    versions = (emit.literal("hasDeclaredVersion", F.col("declared_version")), emit.literal("hasResolvedVersion", F.col("resolved_version")))
    _entities(facts, references, "package-reference", "id", "package_id", "key", emit.edge("referencesPackage", F.col("package")), *versions)
    facts.add(references, F.col("package"), *versions, key=F.col("key"))
    facts.add(references, ids.stable_id("project", F.col("project_path")), emit.edge("hasPackageReference", F.col("id")), emit.edge("referencesPackage", F.col("package")), key=F.col("key"))

    modules = readers.submodules(texts.filter("path = '.gitmodules'")).withColumn("id", ids.stable_id("submodule", F.col("path")))
    _entities(facts, modules, "submodule", "id", "name", "path", emit.literal("submoduleUrl", F.col("url")))
    facts.add(modules, own, emit.edge("hasSubmodule", F.col("id")), key=F.col("path"))
    return projects


def _lock_text(root: str, project: str) -> str | None:
    lock = Path(root, project).parent / "obj/project.assets.json"
    return lock.read_text(errors="replace") if lock.is_file() else None


def _place(of: str) -> tuple[Column, ...]:
    return emit.literal("declarationSourceLocation", location(F.col("path"), F.col("line"), F.col("column"))), emit.edge(f"declares{of}", F.col("id"))


def _declarations(found: DataFrame, projects: DataFrame, facts: Facts) -> DataFrame:
    """Namespaces, types, members, methods and the links between them; returns the diagnostics."""
    spaces = found.filter("fact = 'namespace'").select("name", "path", "line", "column")
    used = found.filter("fact = 'type'").select(F.col("namespace").alias("name"))
    chain = spaces.select("name").union(used).filter("name <> '<global>'").distinct().select(F.split("name", r"\.").alias("parts"))
    chain = chain.select(F.explode(F.transform("parts", lambda x, i: F.array_join(F.slice("parts", F.lit(1), i + 1), "."))).alias("name")).distinct()
    named = stored(chain.withColumn("id", ids.stable_id("namespace", ids.namespace_key(F.col("name")))), "run-namespaces")
    _entities(facts, named, "namespace", "id", "name", "name")
    parent = ids.stable_id("namespace", ids.namespace_key(F.regexp_replace("name", r"\.[^.]*$", "")))
    facts.add(named.filter("name LIKE '%.%'"), parent, emit.edge("containsNamespace", F.col("id")), key=F.col("name"))
    _declared_in(facts, spaces.join(named, "name"), "Namespace")

    assemblies = joins.assembly_of(found.select("path").distinct(), "path", projects.select(F.col("path").alias("project_path"), F.col("name").alias("assembly_name")))
    parts = found.filter("fact = 'type'").join(assemblies, "path").withColumn("qualified_name", declare.qualified_name(F.col("namespace"), F.col("declaring_type"), F.col("name"), F.col("arity")))
    merged = declare.merge_types(parts.select("qualified_name", "path", "line", "is_partial")).select("qualified_name", "path", "line", F.col("is_partial").alias("partial"))
    first = parts.join(merged, ["qualified_name", "path", "line"]).dropDuplicates(["qualified_name"])
    types = stored(first.withColumn("id", ids.stable_id("type-declaration", ids.type_key(F.col("assembly_name"), F.col("namespace"), F.col("qualified_name")))), "run-types")
    _entities(
        facts, types, "type-declaration", "id", "name", "qualified_name", emit.literal("typeKind", F.col("kind")), emit.literal("accessibility", F.col("accessibility")), emit.literal("arity", F.col("arity")),
        emit.literal("isPartialType", F.when(F.col("partial"), "true")),
    )
    facts.add(types.select("id", F.explode("generics").alias("g")), F.col("id"), emit.literal("genericParameter", F.col("g")), key=F.concat_ws(":", "id", "g"))
    facts.add(parts.join(by_name_of(types), "qualified_name").select("type_id", F.explode("constraints").alias("c")).distinct(), F.col("type_id"), emit.literal("genericConstraint", F.col("c")), key=F.concat_ws(":", "type_id", "c"))
    space = ids.stable_id("namespace", ids.namespace_key(F.col("namespace")))
    facts.add(types.filter("namespace <> '<global>'"), space, emit.edge("containsType", F.col("id")), key=F.col("qualified_name"))
    by_name = by_name_of(types)
    _declared_in(facts, parts.select("qualified_name", "path", "line", "column").join(by_name.withColumnRenamed("type_id", "id"), "qualified_name"), "Type")
    facts.add_edges(resolve.declaring_type_links(types.select(F.col("id").alias("type_id"), "qualified_name", F.col("declaring_type").alias("declaring_name"))))

    in_types = found.join(by_name.withColumnRenamed("qualified_name", "declaring_type"), "declaring_type")
    members = _members(facts, in_types.filter("fact = 'member'"))
    methods, parameters = _methods(facts, in_types.filter("fact = 'method'"))
    linked = _links(facts, parts.join(by_name, "qualified_name"), members, methods, parameters, types)
    inherits, implements = (linked.filter(f"role = '{r}' AND outcome = 'internal'").select(F.col("source_id").alias("s"), F.col("target_id").alias("o")).distinct() for r in ("inherits", "implements"))
    matched = methods.select("method_id", "type_id", "name", "kind", "arity", "signatures", "is_override")
    overrides, unmatched = relations.overridden_methods(matched, inherits)
    implementing = relations.implements_methods(matched, inherits, implements, types.select(F.col("id").alias("type_id"), "qualified_name"))
    for p, rows in (("implementsMethod", implementing), ("overridesMethod", overrides)):
        facts.add_edges(rows.select(F.col("method_id").alias("s"), F.lit(f"core:{p}").alias("p"), F.col("target_id").alias("o")))
    lost = unmatched.select(F.lit("method:relationship:override:unresolved").alias("code"), F.col("method_id").alias("message"))
    return resolve.fallback_diagnostics(linked).unionByName(lost)


def by_name_of(types: DataFrame) -> DataFrame:
    return types.select("qualified_name", F.col("id").alias("type_id"), F.col("assembly_name").alias("assembly"))


def _declared_in(facts: Facts, rows: DataFrame, of: str) -> None:
    """Source locations of entities (id, path, line, column) and the files that declare them."""
    place, edge = _place(of)
    key = F.concat_ws(":", "id", "path", F.lpad(F.col("line").cast("string"), 9, "0"), F.lpad(F.col("column").cast("string"), 6, "0"))
    facts.add(rows, F.col("id"), place, key=key)
    facts.add(rows, ids.stable_id("file", F.col("path")), edge, key=key)


def _members(facts: Facts, found: DataFrame) -> DataFrame:
    constants = found.filter("kind = 'enum-member'").select(F.col("declaring_type").alias("enum"), (F.col("line").cast("long") * 100_000 + F.col("column")).alias("ordinal"), F.col("constant").alias("initializer"))
    counted = declare.enum_values(constants).select(F.col("enum").alias("declaring_type"), "ordinal", F.col("constant").alias("counted"))
    valued = found.withColumn("ordinal", F.col("line").cast("long") * 100_000 + F.col("column")).join(counted, ["declaring_type", "ordinal"], "left")
    valued = valued.withColumn("value", F.when(F.col("kind") == "enum-member", F.col("counted")).otherwise(F.col("constant")))
    row = Window.partitionBy("type_id", "kind", "name").orderBy("path", "line", "column")
    first = valued.withColumn("_r", F.row_number().over(row)).filter("_r = 1")
    members = stored(first.withColumn("id", ids.stable_id("member-declaration", ids.member_key(F.col("type_id"), F.col("kind"), F.col("name")))), "run-members")
    _entities(
        facts, members.withColumn("_path", F.concat_ws(".", "declaring_type", "name")), "member-declaration", "id", "name", "_path", emit.literal("memberKind", F.col("kind")), emit.literal("accessibility", F.col("accessibility")),
        emit.literal("hasDeclaredTypeText", F.col("type_text")), emit.literal("constantValue", F.col("value")),
    )
    facts.add(members, F.col("type_id"), emit.edge("containsMember", F.col("id")), key=F.concat_ws(":", "type_id", "id"))
    _declared_in(facts, found.join(members.select("type_id", "kind", "name", "id"), ["type_id", "kind", "name"]), "Member")
    return members


def _methods(facts: Facts, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods once per identity, and their parameters."""
    keyed = found.withColumn("id", ids.stable_id("method-declaration", ids.method_key(F.col("assembly"), F.col("declaring_type"), F.col("name"), F.col("arity"), F.col("parameters"))))
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("path", "line", "column"))).filter("_r = 1")
    shown = declare.method_signature(F.col("declaring_type"), F.col("name"), F.col("arity"), F.col("parameters"))
    methods = stored(first.withColumns({"method_id": F.col("id"), "signature": shown, "signatures": F.col("parameters")}), "run-methods")
    _entities(
        facts, methods, "method-declaration", "id", "name", "signature", emit.literal("methodKind", F.col("kind")), emit.literal("accessibility", F.col("accessibility")), emit.literal("arity", F.col("arity")),
        emit.literal("hasReturnTypeText", F.col("type_text")), emit.literal("isExtensionMethod", F.when(F.col("is_extension"), "true")),
    )
    facts.add(methods, F.col("type_id"), emit.edge("containsMethod", F.col("id")), key=F.concat_ws(":", "type_id", "id"))
    _declared_in(facts, keyed, "Method")
    spread = methods.select("method_id", "type_id", "namespace", "path", "imports", "aliases", "is_extension", F.posexplode(F.arrays_zip("parameters", "parameter_names")).alias("n", "x")).select("*", F.col("x.parameters").alias("type_text"), F.col("x.parameter_names").alias("name"))
    parameters = stored(spread.withColumn("id", ids.stable_id("method-parameter", ids.parameter_key(F.col("method_id"), F.col("n"), F.col("name")))), "run-parameters")
    _entities(facts, parameters, "method-parameter", "id", "name", "name", emit.literal("parameterOrdinal", F.col("n")), emit.literal("parameterName", F.col("name")), emit.literal("hasDeclaredTypeText", F.col("type_text")))
    facts.add(parameters, F.col("method_id"), emit.edge("hasMethodParameter", F.col("id")), key=F.concat_ws(":", "method_id", "id"))
    return methods, parameters


def _links(facts: Facts, parts: DataFrame, members: DataFrame, methods: DataFrame, parameters: DataFrame, types: DataFrame) -> DataFrame:
    """Resolves every reference to a type, and adds the edges and the stubs; returns (role, source_id, outcome, target_id, ...)."""
    based = parts.filter("kind <> 'enum'").select("type_id", "namespace", "imports", "aliases", "kind", F.posexplode("bases").alias("n", "reference"), F.col("bases"))
    head = F.get(F.filter("bases", lambda b: ~looks_like_interface(b)), F.lit(0))
    role = F.when(F.col("kind") == "interface", "inherits").when((F.col("kind") != "struct") & (F.col("reference") == head), "inherits").otherwise("implements")
    none = F.lit(None).cast("string")
    # Members and methods carry no namespace of their own: it is their type's.
    spaces = types.select(F.col("id").alias("type_id"), F.col("namespace").alias("_space"))

    def of(rows: DataFrame, role_: str, source: str, method: Column) -> DataFrame:
        return rows.join(spaces, "type_id").select(F.lit(role_).alias("role"), F.col(source).alias("source_id"), method.alias("method_id"), F.col("type_text").alias("reference"), F.col("_space").alias("namespace"), "imports", "aliases")

    wanted = [
        based.select(role.alias("role"), F.col("type_id").alias("source_id"), none.alias("method_id"), "reference", "namespace", "imports", "aliases"), of(members, "member", "id", none),
        of(methods, "return", "method_id", F.col("method_id")), of(parameters, "parameter", "id", F.col("method_id")), of(parameters.filter("is_extension AND n = 0"), "extends", "method_id", F.col("method_id")),
    ]
    # Parts of a type in several files see the imports and aliases of all of them; of an alias given twice the greatest name holds.
    every = reduce(DataFrame.unionByName, wanted).filter("trim(coalesce(reference, '')) <> ''").groupBy("role", "source_id", "method_id", "reference", "namespace").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("imports")))).alias("imports"), F.array_sort(F.flatten(F.collect_list(F.map_entries("aliases")))).alias("pairs")
    )
    aliases = F.map_from_entries(F.filter("pairs", lambda x, i: F.coalesce(F.get("pairs", i + 1)["key"] != x["key"], F.lit(True))))
    asked = every.withColumn("ref_id", F.sha2(F.concat_ws("|", "role", "source_id", "namespace", "reference"), 256)).withColumn("aliases", aliases).drop("pairs")
    linked = stored(resolve.link_outcome(resolve.resolve_names(asked, types.select("qualified_name", F.col("id").alias("type_id")))), "run-links")
    as_source = linked.withColumn("ref_id", F.col("source_id"))
    for p in ("inherits", "implements"):
        facts.add_edges(resolve.base_links(linked.filter(F.col("role") == p), p))
    facts.add_edges(resolve.member_type_links(as_source.filter("role = 'member'")).select(F.col("ref_id").alias("s"), F.lit("core:hasDeclaredType").alias("p"), F.col("target_id").alias("o")))
    for name, p in (("return", "hasReturnType"), ("parameter", "hasDeclaredType"), ("extends", "extendsType")):
        facts.add_edges(resolve.signature_links(as_source.filter(F.col("role") == name), p))
    kept = linked.filter("outcome <> 'internal' AND NOT (role = 'member' AND outcome = 'unresolved')")
    stubs = kept.groupBy("target_id", "target_type").agg(F.min(F.when(F.col("outcome") == "external", plain_reference(F.col("reference"))).otherwise(F.trim("reference"))).alias("name"))
    for kind, more in (("external-type-stub", ()), ("unresolved-type-reference", (emit.literal("resolutionReason", F.lit(resolve.NOT_FOUND)),))):
        _entities(facts, stubs.filter(F.col("target_type") == kind), kind, "target_id", "name", "name", *more)
    return linked


@dataclass
class Found:
    """The triples of a repository, and what went wrong on the way (code, message)."""

    repository: str
    triples: DataFrame
    diagnostics: DataFrame


def discover(spark: SparkSession, root: str, bound: DataFrame | None = None) -> Found:
    """All facts of the git repository at root; bound (FACTS) adds those that need a compiler."""
    name = Path(root).resolve().name
    if not Path(root).is_dir():
        none, _ = publisher.no_run(spark)
        return Found(repository_id(name), none, spark.createDataFrame([("repository:path:not-found", root)], "code string, message string"))
    tracked, facts = git.tracked_paths(root), Facts()
    texts = stored(git.head_texts(spark, root, [p for p in tracked if p.lower().endswith(_READ)]), "run-texts")
    projects = _structure(spark, root, name, texts, tracked, facts)
    found = stored(csharp.declarations(texts.filter(F.lower("path").endswith(".cs"))), "run-declarations")
    diagnostics = _declarations(found, projects, facts)
    own = [("repository:dirty-working-tree", root)] if git.is_dirty(root) else []
    return Found(repository_id(name), facts.triples(bound), diagnostics.unionByName(spark.createDataFrame(own, "code string, message string")))


def pages_of(found: Found, most_merges: int | None = None) -> DataFrame:
    """All pages (relative_path, title, markdown) of a repository's triples, by path."""
    t, repo = found.triples, F.lit(found.repository)
    m = stored(entity_metadata(t), "run-metadata")
    tables = {
        "solutions": model.solutions(t, m), "projects": model.projects(t, m), "packages": model.packages(t, m), "namespaces": model.namespaces(t, m), "types": model.types(t, m), "members": model.members(t, m),
        "methods": model.methods(t, m), "files": model.files(t, m), "submodules": model.submodules(t, m),
    }
    tables = {k: stored(df, f"run-{k}") for k, df in tables.items()}
    repository, types, methods, files, projects = model.repository(m), tables["types"], tables["methods"], tables["files"], tables["projects"]
    dotted = F.regexp_replace("path", r"\.", "/")
    method_page = F.concat(F.regexp_replace(F.substring_index("signature", "(", 1), r"\.", "/"), F.lit("("), F.regexp_replace("signature", r"^[^(]*\(", ""))
    candidates = [
        pages.named_candidates(repository, "repositories", "name", "path"), pages.named_candidates(tables["solutions"], "solutions", "name", "path"), pages.named_candidates(projects, "projects", "name", "path"),
        pages.named_candidates(tables["packages"], "packages", "name", "canonical_key"), pages.plain_candidates(tables["namespaces"], "namespaces", dotted), pages.plain_candidates(types, "types", dotted),
        pages.plain_candidates(methods, "methods", method_page), pages.plain_candidates(files, "files", F.col("path")),
    ]
    ordered = [c.select("id", "candidate", "fallback", F.concat(F.lit(f"{i}|"), "candidate", F.lit("|"), "id").alias("n")) for i, c in enumerate(candidates)]
    paths = stored(pages.unique_paths(reduce(DataFrame.unionByName, ordered), "n"), "run-paths")

    locations = stored(model.locations(t), "run-locations")
    uses = _Usage(t, m, tables)
    moved = stored(relations.method_relations(t, methods.select(F.col("id").alias("method_id")), m), "run-relations")
    members = tables["members"].join(pages.read_write_counts(tables["members"].select(F.col("id").alias("member_id"), "kind"), moved).select(F.col("member_id").alias("id"), "read_count", "write_count"), "id")
    branches = repository.first()
    at = {"id": repo, "head_branch": F.lit(branches.head_branch if branches else ""), "mainline_branch": F.lit(branches.mainline_branch if branches else "")}
    counts = {k.title(): tables[k] for k in ("solutions", "projects", "packages", "files", "namespaces", "types", "methods")}
    unknown = render.unknown_page(*uses.unknown, paths, found.repository)
    return render.assembled(
        render.repository_page(repository, counts, tables["solutions"], tables["namespaces"], types, tables["submodules"], paths), render.solution_pages(tables["solutions"], projects, paths, repo),
        render.project_pages(projects, tables["packages"], paths, repo), render.package_pages(tables["packages"], paths, repo, *uses.flat), unknown, render.namespace_pages(tables["namespaces"], types, paths, repo),
        render.type_pages(types, members, methods, uses.rollup, tables["packages"], paths, repo), render.method_pages(methods, types, moved, tables["members"], locations, paths, repo),
        render.file_pages(files, model.ranked_events(t, m, True), _symbols(t, tables, locations, paths), paths, at, most_merges), _index(repository, tables, paths),
    )


class _Usage:
    """Uses of packages from declarations and from bodies: flat tables, unknown ones and the rollup by type."""

    def __init__(self, t: DataFrame, m: DataFrame, tables: dict[str, DataFrame]):
        methods = tables["methods"].select(F.col("id").alias("method_id"), "type_id", "signature")
        types = tables["types"].select(F.col("id").alias("type_id"), "name", "namespace_id")
        spaces = tables["namespaces"].select(F.col("id").alias("namespace_id"), "name")
        packages = tables["packages"].select(F.col("id").alias("package_id"), "name", "canonical_key")
        placed = model.declaration_files(t, "declaresMethod").select(F.col("id").alias("method_id"), "file_id")
        projects = tables["projects"].select(F.col("id").alias("project_id"), F.col("path").alias("project_path"), F.col("name").alias("project_name"))
        of = stored(joins.source_project(placed, tables["files"].select(F.col("id").alias("file_id"), "path"), projects), "run-project-of")
        kinds = ["dependsOnTypeDeclaration", "dependsOnTypeInMethodBody"]
        counted = stored(usage.counted_uses(t, kinds, methods, m), "run-uses")
        held = model.memberships(t, m).select("project_id", "package_id").distinct()
        attributed = stored(usage.attributions(counted, methods, of, held, packages), "run-attributed")
        parts = [attributed.filter(F.col("p") == f"core:{p}") for p in kinds]
        self.flat = [stored(usage.usage_flat(a, methods, types, spaces), "run-flat") for a in parts]
        self.unknown = [stored(usage.unknown_flat(a, packages, methods, types, spaces), "run-unknown") for a in parts]
        self.rollup = usage.type_rollup(*self.flat, *self.unknown)


def _symbols(t: DataFrame, tables: dict[str, DataFrame], locations: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """For each heading of a file page the lines (file_id, rank, line) of what the file declares."""
    files, out = tables["files"].select(F.col("id").alias("file_id"), "path"), {}
    alias = render.method_alias(F.col("name"), F.col("kind"), F.col("arity"), F.col("parameter_types"))
    for heading, about in (("Namespaces", tables["namespaces"].select("id", "name")), ("Types", tables["types"].select("id", "name")), ("Members", tables["members"].select("id", "name")), ("Methods", tables["methods"].select("id", alias.alias("name")))):
        links = pages.backlinks(model.declaration_files(t, f"declares{heading[:-1]}"), locations, files, about)
        shown = links.join(paths.select("id", F.col("path").alias("_page")), "id", "left")
        label = F.when(F.col("_page").isNull(), F.col("name")).otherwise(render.wiki_link(F.col("_page"), F.col("name")))
        out[heading] = shown.select("file_id", "rank", F.concat(F.lit("- "), label).alias("line"))
    return out


def _index(repository: DataFrame, tables: dict[str, DataFrame], paths: DataFrame) -> DataFrame:
    """The index page: a table for each kind of entity that has pages."""
    titles = ["Repositories", *(k.title() for k in ("solutions", "projects", "packages", "namespaces", "types", "methods", "files"))]
    named = {"Repositories": repository, "Packages": tables["packages"].withColumnRenamed("canonical_key", "path"), "Methods": tables["methods"].withColumnRenamed("signature", "path")}
    rows = render.index_rows({title: (named[title] if title in named else tables[title.lower()]).select("id", "name", "path") for title in titles}, paths)
    heads = rows.sparkSession.createDataFrame([(i, title) for i, title in enumerate(titles)], "section_no int, section string")
    lines = heads.select("section_no", F.lit(0).alias("o"), F.lit("").alias("path"), F.lit("").alias("name"), F.lit("").alias("id"), F.concat(F.lit("\n## "), "section", F.lit("\n| name | path | id | page |\n| --- | --- | --- | --- |")).alias("line"))
    lines = lines.unionByName(rows.select("section_no", F.lit(1).alias("o"), "path", "name", "id", F.col("row").alias("line")))
    body = render.bullets(lines.withColumn("owner", F.lit("index")), "owner", F.col("line"), [F.col(c) for c in ("section_no", "o", "path", "name", "id")], "lines")
    placed = body.withColumns({"_page": F.lit("index/repository-index.md"), "_title": F.lit("Repository Index")})
    return render.page(placed, "_page", "_title", [("entity_type", F.lit("index"))], [F.array(F.lit("# Repository Index")), F.col("lines")])


def ingest(spark: SparkSession, options: dict, bound: DataFrame | None = None) -> publisher.Published:
    """The verb `ingest`: discovers, renders and publishes; options as cli.options gives them. The result's exit_code follows the run."""
    found = discover(spark, options["path"], bound)
    diagnostics = stored(found.diagnostics, "run-diagnostics")
    failed = not Path(options["path"]).is_dir()
    pages_ = spark.createDataFrame([], "relative_path string, title string, markdown string") if failed else stored(pages_of(found, options["max_merge_entries_per_file"]), "run-pages")
    out = publisher.publish(found.triples, pages_, diagnostics, Path(options["output"]), failed, repository_id=found.repository)
    runs = spark.createDataFrame([(failed or not out.succeeded, sum(out.diagnostics.values()), bool(options["allow_partial_success"]))], "failed boolean, diagnostics long, allow_diagnostics boolean")
    out.exit_code = publish.exit_code(runs).first().code
    return out
