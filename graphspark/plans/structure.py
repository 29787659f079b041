"""Queries over repository structure: identities, pivots, projects, packages, files, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import edges as E
from ..operators import emit, joins, model
from ..operators.metadata import entity_metadata
from . import fixture
from .registry import edge, graph, query, with_graph

BASE = ("entityType", "hasName", "hasPath")


@query("SELECT c_custkey, 'file:' || sha256('file:src/c' || c_custkey || '.cs') AS id, 'literal:' || upper(sha256(c_name)) AS name_id FROM customer")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit(".cs"))
    return customer.select("c_custkey", ids.stable_id("file", path).alias("id"), ids.literal_id(F.col("c_name")).alias("name_id"))


@query("""
SELECT seq + CAST(c_custkey AS BIGINT) * 10 AS seq, 'file:' || sha256('file:' || c_custkey) AS s, p, o_kind, o_id, o_value FROM customer,
LATERAL (SELECT 0 AS seq, 'core:entityType' AS p, 'L' AS o_kind, NULL::VARCHAR AS o_id, 'file' AS o_value UNION ALL SELECT 1, 'core:hasName', 'L', NULL, c_name
UNION ALL SELECT 2, 'core:hasPath', 'L', NULL, 'src/' || c_custkey UNION ALL SELECT 3, 'core:contains', 'E', 'nation:' || sha256('nation:' || c_nationkey), NULL) f""")
def triples_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    facts = [*emit.entity("file", F.col("c_name"), F.concat(F.lit("src/"), key)), emit.edge("contains", ids.stable_id("nation", F.col("c_nationkey").cast("string")))]
    return emit.triples_of(c, ids.stable_id("file", key), facts, F.col("c_custkey") * 10)


@query(f"WITH {fixture.triples_sql()} SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT coalesce(o_id, o_value)) AS objects, max(seq) AS last_seq FROM triples GROUP BY p")
def triples_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.predicate_counts(fixture.plain(spark, sf_dir), list(dict.fromkeys(f"core:{f.p}" for f in fixture.FACTS)))


_REPO_META = {"head_branch": "headBranch", "mainline_branch": "mainlineBranch", "edits": "editCount", "member": "isSolutionMember"}


@query(with_graph(meta=_REPO_META, subjects=("repository", "file", "solution", "project")) + """
SELECT id, name, path, entity_type, head_branch, mainline_branch, coalesce(try_cast(trim(edits) AS INTEGER), 0) AS edit_count, lower(trim(member)) = 'true' AS is_solution_member FROM meta""")
def entity_pivot_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir, *BASE, *_REPO_META.values(), subjects=("repository", "file", "solution", "project"))
    return entity_metadata(t, ["entity_type", "head_branch", "mainline_branch", "edit_count", "is_solution_member"])


@query(f"WITH {fixture.triples_sql('hasDeclaredVersion', 'hasResolvedVersion')}" + """
SELECT s, arg_min(o_value, seq) FILTER (p = 'core:hasDeclaredVersion') AS declared_version, arg_min(o_value, seq) FILTER (p = 'core:hasResolvedVersion') AS resolved_version FROM triples GROUP BY s""")
def version_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.first_versions(graph(spark, sf_dir, "hasDeclaredVersion", "hasResolvedVersion"))


@query(f"WITH {fixture.triples_sql('hasDeclaredVersion')} SELECT s, arg_min(o_value, seq) AS v FROM triples GROUP BY s, lower(o_value)")
def version_set_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.package_versions(graph(spark, sf_dir, "hasDeclaredVersion"), "hasDeclaredVersion")


@query(with_graph("dependsOnTypeDeclaration", subjects=("method-declaration",)) + f" SELECT * FROM {edge('dependsOnTypeDeclaration')} e")
def edges_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.edges(graph(spark, sf_dir, "dependsOnTypeDeclaration"), "dependsOnTypeDeclaration")


_SP = ("repository", "solution", "project")


def _structure(spark: SparkSession, sf_dir: str, *predicates: str, subjects: tuple[str, ...] = (), columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    t = graph(spark, sf_dir, *BASE, *predicates, subjects=subjects)
    return t, entity_metadata(t, ["entity_type", *(columns or [])])


@query(with_graph("contains", subjects=_SP) + f"""
SELECT m.id, m.name, m.path, coalesce((SELECT string_agg(p.id, ',' ORDER BY p.path) FROM {edge('contains')} c JOIN meta p ON p.id = c.o AND p.entity_type = 'project' WHERE c.s = m.id), '') AS project_ids
FROM {edge('contains')} e JOIN meta r ON r.id = e.s AND r.entity_type = 'repository' JOIN meta m ON m.id = e.o AND m.entity_type = 'solution'""")
def contains_solution_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = _structure(spark, sf_dir, "contains", subjects=_SP)
    return model.solutions(t, m).withColumn("project_ids", F.array_join("project_ids", ","))


_PROJECTS = ("contains", "discoveryMethod", "targetFramework", "referencesPackage")


@query(with_graph(*_PROJECTS, meta={"discovery_method": "discoveryMethod"}, subjects=(*_SP, "package")) + f"""
SELECT m.id, m.name, m.path, m.discovery_method,
 coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT arg_min(o_value, seq) AS v FROM triples t WHERE t.p = 'core:targetFramework' AND t.s = m.id GROUP BY lower(o_value))), '') AS target_frameworks,
 coalesce((SELECT string_agg(k.id, ',' ORDER BY k.name, k.id) FROM {edge('referencesPackage')} r JOIN meta k ON k.id = r.o WHERE r.s = m.id), '') AS package_ids
FROM (SELECT DISTINCT e.o FROM {edge('contains')} e JOIN meta r ON r.id = e.s WHERE r.entity_type IN ('repository', 'solution')) x JOIN meta m ON m.id = x.o AND m.entity_type = 'project'""")
def projects_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = _structure(spark, sf_dir, *_PROJECTS, subjects=(*_SP, "package"), columns=["discovery_method"])
    return model.projects(t, m).withColumns({c: F.array_join(c, ",") for c in ("target_frameworks", "package_ids")})


_MEMBERSHIP = ("hasPackageReference", "referencesPackage", "hasDeclaredVersion", "hasResolvedVersion")
_PKG = ("project", "package", "package-reference")
_MEMBERSHIP_SQL = f"""
held AS (SELECT e.s AS project_id, e.o AS reference_id FROM {edge('hasPackageReference')} e JOIN meta a ON a.id = e.s AND a.entity_type = 'project' JOIN meta b ON b.id = e.o AND b.entity_type = 'package-reference'),
target AS (SELECT e.s AS reference_id, arg_min(e.o, e.seq) AS package_id FROM {edge('referencesPackage')} e JOIN meta a ON a.id = e.s AND a.entity_type = 'package-reference' GROUP BY 1),
versions AS (SELECT s AS reference_id, arg_min(o_value, seq) FILTER (p = 'core:hasDeclaredVersion') AS declared_version, arg_min(o_value, seq) FILTER (p = 'core:hasResolvedVersion') AS resolved_version
    FROM triples WHERE p IN ('core:hasDeclaredVersion', 'core:hasResolvedVersion') GROUP BY 1),
members AS (SELECT package_id, project_id, reference_id, declared_version, resolved_version FROM held JOIN target USING (reference_id) LEFT JOIN versions USING (reference_id))"""


@query(with_graph(*_MEMBERSHIP, subjects=_PKG, more=_MEMBERSHIP_SQL) + " SELECT * FROM members")
def package_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.memberships(*_structure(spark, sf_dir, *_MEMBERSHIP, subjects=_PKG))


@query(with_graph(*_MEMBERSHIP, subjects=_PKG, more=_MEMBERSHIP_SQL) + f"""
SELECT m.id, m.name, m.path AS canonical_key, (SELECT count(*) FROM members x WHERE x.package_id = m.id) AS memberships,
 (SELECT string_agg(p.path || ':' || coalesce(x.declared_version, ''), ',' ORDER BY p.path, p.name, p.id) FROM members x JOIN meta p ON p.id = x.project_id WHERE x.package_id = m.id) AS listed,
 coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT arg_min(o_value, seq) AS v FROM triples t WHERE t.p = 'core:hasDeclaredVersion' AND t.s = m.id GROUP BY lower(o_value))), '') AS declared_versions
FROM (SELECT DISTINCT e.o FROM {edge('referencesPackage')} e JOIN meta a ON a.id = e.s AND a.entity_type = 'project') x JOIN meta m ON m.id = x.o AND m.entity_type = 'package'""")
def packages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model.packages(*_structure(spark, sf_dir, *_MEMBERSHIP, subjects=_PKG))
    listed = F.array_join(F.transform("memberships", lambda x: F.concat(x["project_path"], F.lit(":"), F.coalesce(x["declared_version"], F.lit("")))), ",")
    return found.select("id", "name", "canonical_key", F.size("memberships").cast("long").alias("memberships"), listed.alias("listed"), F.array_join("declared_versions", ",").alias("declared_versions"))


_FILES = ("contains", "isSolutionMember", "editCount", "hasHistoryEvent", "commitSha", "committedAtUtc", "authorName", "authorEmail", "isMergeToMainline", "targetBranch", "sourceBranchFileCommitCount")
_FILE_COLUMNS = ["file_kind", "is_solution_member", "edit_count", "commit_sha", "committed_at_utc", "author_name", "author_email", "is_merge_to_mainline", "target_branch", "source_branch_file_commit_count"]
_FILE_META = {"edits": "editCount", "member": "isSolutionMember", "sha": "commitSha", "happened_at": "committedAtUtc", "author": "authorName", "merge": "isMergeToMainline", "branch": "targetBranch", "commits": "sourceBranchFileCommitCount"}
_FILE_SUBJECTS = ("repository", "file", "file-history-event")
_EVENTS_SQL = f"""
happened AS (SELECT e.s AS file_id, m.id, m.sha, m.happened_at, m.author, m.merge, m.branch, m.commits, coalesce(try_cast(m.happened_at AS TIMESTAMPTZ), TIMESTAMPTZ '0001-01-01 00:00:00Z') AS committed
    FROM {edge('hasHistoryEvent')} e JOIN meta m ON m.id = e.o AND m.entity_type = 'file-history-event')"""


@query(with_graph(*_FILES, meta=_FILE_META, subjects=_FILE_SUBJECTS, more=_EVENTS_SQL + f""",
newest AS (SELECT file_id, sha, happened_at, author, row_number() OVER (PARTITION BY file_id ORDER BY committed DESC, sha) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM happened)""") + f"""
SELECT m.id, m.path, lower(trim(m.member)) = 'true' AS is_solution_member,
 CASE WHEN coalesce(try_cast(trim(m.edits) AS INTEGER), 0) > 0 THEN try_cast(trim(m.edits) AS BIGINT) ELSE coalesce(h.n, 0) END AS edit_count, h.sha AS last_sha, h.happened_at AS last_at
FROM {edge('contains')} e JOIN meta m ON m.id = e.o AND m.entity_type = 'file' LEFT JOIN newest h ON h.file_id = m.id AND h.r = 1""")
def file_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model.files(*_structure(spark, sf_dir, *_FILES, subjects=_FILE_SUBJECTS, columns=_FILE_COLUMNS))
    return found.select("id", "path", "is_solution_member", "edit_count", F.col("last_change.commit_sha").alias("last_sha"), F.col("last_change.committed_at_utc").alias("last_at"))


def _ranked(where: str) -> str:
    return with_graph(*_FILES, meta=_FILE_META, subjects=_FILE_SUBJECTS, more=_EVENTS_SQL) + f"""
SELECT file_id, sha AS commit_sha, happened_at AS committed_at_utc, author AS author_name, CAST(row_number() OVER (PARTITION BY file_id ORDER BY committed DESC, sha, id) AS INTEGER) AS rank FROM happened {where}"""


def _events(spark: SparkSession, sf_dir: str, merges: bool) -> DataFrame:
    t, m = _structure(spark, sf_dir, *_FILES, subjects=_FILE_SUBJECTS, columns=_FILE_COLUMNS)
    return model.ranked_events(t, m, merges).select("file_id", "commit_sha", "committed_at_utc", "author_name", "rank")


@query(_ranked(""))
def file_history_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, False)


@query(_ranked("WHERE lower(trim(merge)) = 'true' QUALIFY rank <= 2"))
def file_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, True).filter("rank <= 2")


@query("""WITH f AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'a/b.CS' WHEN 1 THEN 'a/x.csproj' WHEN 2 THEN 'Directory.Build.props' WHEN 3 THEN 'docs/READ.md' WHEN 4 THEN 'c.yml' WHEN 5 THEN 'LICENSE' ELSE 'all.slnx' END AS path FROM customer)
SELECT c_custkey, path, CASE lower(regexp_extract(path, '\\.[^./]*$')) WHEN '.cs' THEN 'dotnet-source' WHEN '.sln' THEN 'solution' WHEN '.slnx' THEN 'solution' WHEN '.csproj' THEN 'project' WHEN '.props' THEN 'msbuild'
 WHEN '.targets' THEN 'msbuild' WHEN '.md' THEN 'documentation' WHEN '.json' THEN 'configuration' WHEN '.yaml' THEN 'configuration' WHEN '.yml' THEN 'configuration' ELSE 'other' END AS kind FROM f""")
def file_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = ["a/b.CS", "a/x.csproj", "Directory.Build.props", "docs/READ.md", "c.yml", "LICENSE", "all.slnx"]
    path = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return c.select("c_custkey", path.alias("path")).withColumn("kind", text.file_kind(F.col("path")))


@query("""WITH f AS (SELECT c_custkey, 'src/R' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '.cs' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT 'SRC/r' || n_regionkey || '/N' || n_nationkey AS dir FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'src/r1/n1/c' || c_custkey || '.CS' FROM customer WHERE c_custkey % 5 = 0)
SELECT c_custkey, path FROM f WHERE EXISTS (SELECT 1 FROM d WHERE lower(path) = lower(dir) OR starts_with(lower(path), lower(dir) || '/'))""")
def solution_member_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixture.views(spark, sf_dir)
    files = v["v_customer"].selectExpr("ck AS c_custkey", "'src/R' || rk || '/n' || nk || '/c' || ck || '.cs' AS path")
    dirs = v["v_nation"].filter("nk % 2 = 0").selectExpr("'SRC/r' || rk || '/N' || nk AS dir").unionByName(v["v_customer"].filter("ck % 5 = 0").selectExpr("'src/r1/n1/c' || ck || '.CS' AS dir"))
    return joins.under_any(files, "path", dirs, "dir")


@query(with_graph("hasSubmodule", meta={"url": "submoduleUrl"}, subjects=("repository", "submodule")) + f" SELECT m.id, m.name, m.path, m.url FROM (SELECT DISTINCT o FROM {edge('hasSubmodule')}) e JOIN meta m ON m.id = e.o AND m.entity_type = 'submodule'")
def submodules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.submodules(*_structure(spark, sf_dir, "hasSubmodule", "submoduleUrl", subjects=("repository", "submodule"), columns=["submodule_url"]))


@query(with_graph(meta=_REPO_META, subjects=("repository",)) + " SELECT id, name, path, head_branch, mainline_branch FROM meta WHERE entity_type = 'repository'")
def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.repository(_structure(spark, sf_dir, "headBranch", "mainlineBranch", subjects=("repository",), columns=["head_branch", "mainline_branch"])[1])
