"""Queries over rendered pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model, pages, publish, render
from . import fixture
from .registry import query
from .structure import _structure


def _paths(df: DataFrame, directory: str) -> DataFrame:
    return pages.unique_paths(pages.named_candidates(df.select("id", "name", "path"), directory, "name", "path"), "path").select("id", "path")


@query("""WITH n AS (SELECT n_nationkey AS k, n_name AS nm, 'src/r' || n_regionkey || '/n' || n_nationkey || '/p.csproj' AS path, n_regionkey AS rk FROM nation),
s AS (SELECT 'solution:' || sha256('solution:r' || r_regionkey || '.sln') AS id, r_name AS nm, 'r' || r_regionkey || '.sln' AS path, r_regionkey AS rk FROM region)
SELECT 'solutions/' || replace(nm, ' ', '-') || '.md' AS relative_path, nm AS title, '---' || chr(10) || 'entity_id: ' || id || chr(10) || 'entity_type: solution' || chr(10) || 'repository_id: repo' || chr(10) || 'solution_name: ' || nm || chr(10) || 'solution_path: ' || path || chr(10) || '---' || chr(10) || chr(10)
 || '# Solution: ' || nm || chr(10) || chr(10) || '- Path: `' || path || '`' || chr(10) || '- Projects: ' || (SELECT count(*) FROM n WHERE n.rk = s.rk) || chr(10) || chr(10) || '## Projects' || chr(10)
 || (SELECT string_agg('- [[projects/' || replace(nm, ' ', '-') || '|' || nm || ']]', chr(10) ORDER BY path) FROM n WHERE n.rk = s.rk) AS markdown FROM s""")
def solution_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = _structure(spark, sf_dir, "contains", subjects=("repository", "solution", "project"))
    solutions, projects = model.solutions(t, m), model.of_type(m, "project").select("id", "name", "path")
    paths = _paths(solutions, "solutions").unionByName(_paths(projects, "projects"))
    return render.solution_pages(solutions, projects, paths, F.lit("repo"))


@query("""WITH p AS (SELECT 'solutions/' || replace(r_name, ' ', '-') || '.md' AS relative_path FROM region UNION ALL SELECT 'namespaces/Shop/R' || n_regionkey || '/N' || n_nationkey || '.md' FROM nation
UNION ALL SELECT 'namespaces/Shop/R' || r_regionkey || '.md' FROM region UNION ALL SELECT 'namespaces/Shop.md') SELECT CAST(row_number() OVER (ORDER BY relative_path) AS BIGINT) AS n, relative_path FROM p""")
def pages_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = _structure(spark, sf_dir, "containsNamespace", "containsType", "typeKind", "accessibility", "arity", "isPartialType", subjects=("namespace", "type-declaration"), columns=["type_kind", "accessibility", "arity", "is_partial_type"])
    every = render.assembled(solution_pages(spark, sf_dir), _namespace_pages(t, m))
    return publish.ranked(every.select("relative_path"), ["relative_path"], "n").select(F.col("n").cast("long").alias("n"), "relative_path")


def _index_sql() -> str:
    """The index's rows of every kind of entity: section, kind of entity, source view, key, name, path and page without its ending."""
    f, types, methods = fixture, f"{fixture.TYPE}", fixture.METHOD
    kinds = [
        ("Repositories", "repository", "v_repo", f.REPO, f.REPO, f.REPO, "'repositories/tpch'"), ("Solutions", "solution", "v_region", f.SOLUTION, "nm", f.SOLUTION, "'solutions/' || replace(nm, ' ', '-')"),
        ("Projects", "project", "(SELECT rk, nk, nm FROM v_nation)", f.PROJECT, "nm", f.PROJECT, "'projects/' || replace(nm, ' ', '-')"), ("Projects", "project", "v_region", f.REGION_PROJECT, "'root-' || nm", f.REGION_PROJECT, "'projects/root-' || replace(nm, ' ', '-')"),
        ("Packages", "package", "v_package", "lower(nm)", "nm", "lower(nm)", "'packages/' || replace(nm, '#', '-')"),
        ("Namespaces", "namespace", "v_repo", f.SPACE0, f.SPACE0, f.SPACE0, "'namespaces/Shop'"), ("Namespaces", "namespace", "v_region", f.SPACE1, f.SPACE1, f.SPACE1, "'namespaces/Shop/R' || rk"), ("Namespaces", "namespace", "v_nation", f.SPACE2, f.SPACE2, f.SPACE2, "'namespaces/Shop/R' || rk || '/N' || nk"),
        ("Types", "type-declaration", "v_supplier", types, "'S' || sk", types, "'types/Shop/R' || rk || '/N' || nk || '/S' || sk"),
        ("Methods", "method-declaration", "v_order", methods, "'M' || ok", types + " || '.M' || ok || '(int)'", "'methods/Shop/R' || rk || '/N' || nk || '/S' || sk || '/M' || ok"),
        ("Files", "file", "v_customer", f.CUSTOMER_FILE, "'c' || ck || ext", f.CUSTOMER_FILE, f"'files/' || {f.CUSTOMER_FILE}"), ("Files", "file", "v_supplier", f.SUPPLIER_FILE, "'s' || sk || '.cs'", f.SUPPLIER_FILE, f"'files/' || {f.SUPPLIER_FILE}"),
    ]
    numbers = {title: i for i, title in enumerate(dict.fromkeys(k[0] for k in kinds))}
    rows = [
        f"SELECT {numbers[title]} AS section_no, '{title}' AS section, {name} AS name, '| ' || {name} || ' | ' || {path} || ' | `{kind}:' || sha256('{kind}:' || {key}) || '` | [[' || {page} || '|' || {name} || ']] |' AS row FROM {view}"
        for title, kind, view, key, name, path, page in kinds
    ]
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in fixture.VIEWS.items()) + " " + " UNION ALL ".join(rows)


@query(_index_sql())
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"Repositories": "repository", "Solutions": "solution", "Projects": "project", "Packages": "package", "Namespaces": "namespace", "Types": "type-declaration", "Methods": "method-declaration", "Files": "file"}
    _, m = _structure(spark, sf_dir, subjects=tuple(kinds.values()))
    tables = {title: model.of_type(m, kind).select("id", "name", "path") for title, kind in kinds.items()}
    dotted = F.regexp_replace("path", r"\.", "/")
    own = {"Namespaces": dotted, "Types": dotted, "Methods": F.regexp_replace(F.substring_index("path", "(", 1), r"\.", "/"), "Files": F.col("path")}
    candidates = [pages.plain_candidates(t, k.lower(), own[k]) if k in own else pages.named_candidates(t, k.lower(), "name", "path") for k, t in tables.items()]
    paths = pages.unique_paths(reduce(DataFrame.unionByName, [c.select("id", "path", "candidate", "fallback") for c in candidates]), "path").select("id", "path")
    return render.index_rows(tables, paths).select("section_no", "section", "name", "row")


@query("""SELECT 'namespaces/Shop/R' || rk || '/N' || nk || '.md' AS relative_path, (SELECT count(*) FROM supplier WHERE s_nationkey = nk) AS types, true AS has_parent FROM (SELECT n_regionkey AS rk, n_nationkey AS nk FROM nation)
UNION ALL SELECT 'namespaces/Shop/R' || r_regionkey || '.md', (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND s_suppkey % 9 = 0), true FROM region UNION ALL SELECT 'namespaces/Shop.md', 0, false""")
def namespace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = _structure(spark, sf_dir, "containsNamespace", "containsType", "typeKind", "accessibility", "arity", "isPartialType", subjects=("namespace", "type-declaration"), columns=["type_kind", "accessibility", "arity", "is_partial_type"])
    found = _namespace_pages(t, m)
    return found.select("relative_path", F.regexp_count("markdown", F.lit(r"\[\[types/")).cast("long").alias("types"), F.contains("markdown", F.lit("- Parent: [[")).alias("has_parent"))


def _namespace_pages(t: DataFrame, m: DataFrame) -> DataFrame:
    spaces, types = model.namespaces(t, m), model.types(t, m)
    a = pages.plain_candidates(spaces.select("id", "path"), "namespaces", F.regexp_replace("path", r"\.", "/"))
    b = pages.plain_candidates(types.select("id", "path"), "types", F.regexp_replace("path", r"\.", "/"))
    paths = pages.unique_paths(a.unionByName(b), "id").select("id", "path")
    return render.namespace_pages(spaces, types, paths, F.lit("repo"))


@query("""WITH f AS (SELECT c_custkey AS ck, n_regionkey AS rk, n_nationkey AS nk, CASE substr(c_mktsegment, 1, 1) WHEN 'A' THEN '.cs' WHEN 'B' THEN '.md' WHEN 'F' THEN '.json' WHEN 'H' THEN '.CSPROJ' ELSE '.txt' END AS ext FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'files/src/r' || rk || '/n' || nk || '/c' || ck || ext || '.md' AS relative_path, least(2, (SELECT count(*) FROM events WHERE user_id = ck AND event_type = 'purchase')) AS merges FROM f
UNION ALL SELECT 'files/src/r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey || '.cs.md', 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .structure import _FILE_COLUMNS, _FILE_SUBJECTS, _FILES

    t, m = _structure(spark, sf_dir, *_FILES, subjects=_FILE_SUBJECTS, columns=_FILE_COLUMNS)
    files = model.files(t, m)
    paths = pages.unique_paths(pages.plain_candidates(files.select("id", "path"), "files", F.col("path")), "id").select("id", "path")
    merges = model.ranked_events(t, m, True)
    none = files.select(F.col("id").alias("file_id"), F.lit(1).alias("rank"), F.lit("").alias("line")).filter("false")
    branches = {"id": F.lit("repo"), "head_branch": F.lit("main"), "mainline_branch": F.lit("main")}
    found = render.file_pages(files, merges, {"Types": none, "Methods": none}, paths, branches, most=2)
    return found.select("relative_path", F.regexp_count("markdown", F.lit("- merge_commit: ")).cast("long").alias("merges"))
