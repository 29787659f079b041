"""Reading a repository's files into tables of facts.

Text goes in as a DataFrame (path, text) from spark.read (binaryFile or text, with recursiveFileLookup); XML, JSON
and line formats are taken apart by built-in functions, so only the C# scanner and git run Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import directory_of, file_stem, utc_text
from ..operators.declare import ini_sections
from ..operators.joins import under_any


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text) of the files under root whose names match; path is relative to root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    prefix = F.length(F.lit(root.rstrip("/") + "/"))
    full = F.regexp_replace("path", "^file:/+", "/")
    return found.select(full.alias("_full"), "content").select(F.substring("_full", prefix + 1, F.length("_full")).alias("path"), F.decode("content", "UTF-8").alias("text"))


def without(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """files that are not in or under an excluded directory (column path), letter case ignored."""
    hits = under_any(files.select("path"), "path", excluded.select(F.col("path").alias("_d")), "_d")
    return files.join(hits, "path", "left_anti")


def discover_solutions(files: DataFrame) -> DataFrame:
    """Solution files once each, letter case ignored; an empty result is a diagnostic for the caller."""
    own = files.filter(F.lower("path").rlike(r"\.slnx?$"))
    return own.groupBy(F.lower("path").alias("_k")).agg(F.min("path").alias("path")).select("path")


def _resolved(base: Column, relative: Column) -> Column:
    """A path relative to a directory, with . and .. taken out."""
    joined = F.split(F.regexp_replace(F.when(base == "", relative).otherwise(F.concat(base, F.lit("/"), relative)), r"\\", "/"), "/")
    step = F.aggregate(
        joined, F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(step, "/")


def solution_projects(files: DataFrame) -> DataFrame:
    """(solution_path, project_path) of .slnx files (projects directly under the root) and .sln files."""
    xml = files.filter(F.lower("path").endswith(".slnx"))
    # Malformed text gives nulls, as a row of its own; xpath would end the job.
    listed = F.from_xml("text", "Project array<struct<_Path: string>>", {"mode": "PERMISSIVE"})["Project"]
    a = xml.select(F.col("path").alias("solution_path"), F.explode(F.transform(listed, lambda x: x["_Path"])).alias("_r"))
    sln = files.filter(F.lower("path").endswith(".sln"))
    b = sln.select(F.col("path").alias("solution_path"), F.explode(F.regexp_extract_all("text", F.lit(r'Project\("\{[^}]*\}"\)\s*=\s*"[^"]*",\s*"([^"]*)"'), 1)).alias("_r"))
    every = a.union(b).filter(F.lower("_r").endswith(".csproj"))
    return every.select("solution_path", _resolved(directory_of(F.col("solution_path")), F.col("_r")).alias("project_path")).distinct()


def target_frameworks(single: Column, many: Column) -> Column:
    """The frameworks of both elements: split at ;, trimmed, sorted, once each letter case ignored."""
    parts = F.filter(F.transform(F.split(F.concat_ws(";", single, many), ";"), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(parts, lambda x, i: F.array_position(F.transform(parts, F.lower), F.lower(x)) == (i + 1).cast("long"))
    return F.array_sort(kept)


def _well_formed(text: Column) -> Column:
    """Whether a text is one Project element that an XML parser reads to its end."""
    shape = text.rlike(r"(?s)^\ufeff?\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<Project\b([^<>]*/>|.*</Project\s*>)\s*(<!--.*?-->\s*)*$")
    parsed = F.from_xml(text, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(shape & parsed["_bad"].isNull(), F.lit(False))


def _unescaped(text: Column) -> Column:
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(mark))
    return text


def project_facts(projects: DataFrame) -> DataFrame:
    """(path, name, target_frameworks) of project files; text that is no project keeps its file name only."""
    clean = F.when(_well_formed(F.col("text")), F.regexp_replace("text", r"(?s)<!--.*?-->", "")).otherwise(F.lit(""))
    x = projects.select("path", clean.alias("_x"))

    def text_of(tag: str) -> Column:
        return F.trim(_unescaped(F.regexp_extract("_x", rf"<{tag}(?:\s[^<>]*)?>([^<]*)</", 1)))

    name = F.when(text_of("AssemblyName") != "", text_of("AssemblyName")).otherwise(file_stem(F.col("path")))
    return x.select("path", name.alias("name"), target_frameworks(text_of("TargetFramework"), text_of("TargetFrameworks")).alias("target_frameworks"))


def package_references(projects: DataFrame) -> DataFrame:
    """(project_path, package_id, declared_version): Include, else Update; the Version attribute, else the element."""
    clean = F.when(_well_formed(F.col("text")), F.col("text")).otherwise(F.lit(""))
    items = F.regexp_extract_all(clean, F.lit(r"(?s)(<PackageReference\b[^>]*?/>|<PackageReference\b[^>]*?[^/]>.*?</PackageReference>)"), 1)
    rows = projects.select(F.col("path").alias("project_path"), F.explode(items).alias("_i"))

    def attribute(n: str) -> Column:
        return F.nullif(F.regexp_extract("_i", rf'^<PackageReference\b[^>]*\b{n}\s*=\s*"([^"]*)"', 1), F.lit(""))

    element = F.nullif(F.trim(F.regexp_extract("_i", r"(?s)<Version>(.*?)</Version>", 1)), F.lit(""))
    found = rows.select("project_path", F.coalesce(attribute("Include"), attribute("Update")).alias("package_id"), F.coalesce(attribute("Version"), element).alias("declared_version"))
    return found.filter("package_id IS NOT NULL")


def resolved_packages(lock_files: DataFrame) -> DataFrame:
    """(project_path, package_key, package_id, resolved_version) of project.assets.json files (project_path, text); the last of a key holds."""
    libraries = F.from_json("text", "libraries map<string, struct<type: string>>")["libraries"]
    rows = lock_files.select("project_path", F.posexplode(F.map_entries(libraries)).alias("n", "e")).filter("e.value.type = 'package' AND contains(e.key, '/')")
    split = rows.select("project_path", "n", F.split("e.key", "/", 2).alias("k"))
    return split.groupBy("project_path", F.lower(F.col("k")[0]).alias("package_key")).agg(F.max_by(F.col("k")[0], "n").alias("package_id"), F.max_by(F.col("k")[1], "n").alias("resolved_version"))


def history_lines(lines: DataFrame) -> DataFrame:
    """Lines of five fields separated by U+001F as sha, author_name, author_email, ts_utc, parents; others are dropped."""
    parts = F.split("line", "\u001f")
    rows = lines.withColumn("_f", parts).filter(F.size("_f") == 5)
    keep = [c for c in lines.columns if c != "line"]
    parents = F.filter(F.split(F.col("_f")[4], " "), lambda x: x != "")
    return rows.select(*keep, F.col("_f")[0].alias("sha"), utc_text(F.col("_f")[1]).alias("ts_utc"), F.col("_f")[2].alias("author_name"), F.col("_f")[3].alias("author_email"), parents.alias("parents"))


def file_history(followed: DataFrame, mainline_merges: DataFrame) -> DataFrame:
    """A file's own commits and, behind them, the mainline merges not among them (path, sha, ord, parents, ...)."""
    merges = mainline_merges.filter(F.size("parents") >= 2)
    fresh = merges.join(followed.select("path", "sha"), ["path", "sha"], "left_anti")
    return followed.withColumn("is_merge", F.lit(False)).unionByName(fresh.withColumn("is_merge", F.lit(True)), allowMissingColumns=True)


def source_branch_commits(commits: DataFrame, merges: DataFrame) -> DataFrame:
    """merges (path, sha, ...) with how many distinct commits (merge_sha, path, sha) the merged branch had for the file."""
    counted = commits.groupBy("path", F.col("merge_sha").alias("sha")).agg(F.count_distinct("sha").alias("source_commit_count"))
    return merges.join(counted, ["path", "sha"], "left").withColumn("source_commit_count", F.coalesce("source_commit_count", F.lit(0)))


def submodules(files: DataFrame) -> DataFrame:
    """(file, section, name, path, url) of .gitmodules files (path, text)."""
    return ini_sections(files.select(F.col("path").alias("file"), F.posexplode(F.split("text", r"\r?\n")).alias("n", "text")))


def ontology(files: DataFrame) -> DataFrame:
    """(version, ids) of ontology texts: a version line and `- id: x` lines."""
    version = F.nullif(F.trim(F.regexp_extract("text", r"""(?m)^version:\s*["']?([^"'\r\n]*)""", 1)), F.lit(""))
    return files.select("path", version.alias("version"), F.regexp_extract_all("text", F.lit(r"""(?m)^\s*-\s*id:\s*["']?([^"'\s]*)"""), 1).alias("ids"))
