"""Adjacency, backlinks and page paths: what rendering needs of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import directory_of, page_path, path_ancestors, path_segment
from ..storage import stored

FAR = 2_147_483_647


def adjacent(pairs: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """(key, values): distinct partners in order; use it with the columns swapped for the reverse direction."""
    best = pairs.select(key, value, *[o.alias(f"_o{i}") for i, o in enumerate(order)]).distinct()
    rows = F.array_sort(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], value)))
    return best.groupBy(key).agg(F.transform(rows, lambda x: x[value]).alias(f"{value}s"))


def read_write_counts(members: DataFrame, relations: DataFrame) -> DataFrame:
    """members (member_id, kind) with the numbers of distinct methods that read and write them; zeros stay."""
    of = relations.filter("target_member_id IS NOT NULL").select(F.col("target_member_id").alias("member_id"), "source_method_id", F.col("kind").startswith("Reads").alias("_reads"))
    counted = of.distinct().groupBy("member_id").agg(F.count(F.when(F.col("_reads"), 1)).alias("read_count"), F.count(F.when(~F.col("_reads"), 1)).alias("write_count"))
    out = members.join(counted, "member_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("read_count", "write_count")})


def backlinks(declared: DataFrame, locations: DataFrame, files: DataFrame, about: DataFrame) -> DataFrame:
    """declared (id, file_id) as (file_id, id, line, column, name, rank): entities of a file by their first place in it.

    Entities without a place in the file come last.
    """
    placed = declared.distinct().join(files.select("file_id", "path"), "file_id")
    where = locations.groupBy(F.col("s").alias("id"), "path").agg(F.min(F.struct("line", "column")).alias("_at"))
    joined = placed.join(where, ["id", "path"], "left").join(about.select("id", "name"), "id")
    row = joined.select("file_id", "id", F.coalesce("_at.line", F.lit(FAR)).alias("line"), F.coalesce("_at.column", F.lit(FAR)).alias("column"), "name")
    return row.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy("line", "column", "name", "id")))


def primary_project(locations: DataFrame, projects: DataFrame) -> DataFrame:
    """The project of each type (s): its first declaration place, by path, line and column, that a project holds.

    Of several projects the one with the longest *project path* wins, then by path.
    """
    owners = projects.withColumn("_dir", directory_of(F.col("project_path")))
    spread = locations.select("path").distinct()

    keyed = spread.withColumn("_dir", F.explode(path_ancestors(F.col("path")))).join(owners.filter("_dir <> ''"), "_dir")
    best = keyed.groupBy("path").agg(F.min_by(F.struct("project_id", "project_path"), F.struct(-F.length("project_path"), "project_path", "project_id")).alias("_p"))
    found = locations.join(best, "path")
    return found.groupBy("s").agg(F.min_by("_p", F.struct("path", "line", "column")).alias("_p")).select("s", "_p.*")


def named_candidates(entities: DataFrame, directory: str, name: str, context: str) -> DataFrame:
    """entities with first and second choice of a page path: directory/name.md and directory/name--context.md."""
    stem = F.when(path_segment(F.col(name)) == "", "entity").otherwise(path_segment(F.col(name)))
    more = path_segment(F.regexp_replace(F.col(context), r"[/\\]", "-"))
    suffix = F.when(more == "", "context").otherwise(more)
    return entities.select("*", F.concat(F.lit(f"{directory}/"), stem, F.lit(".md")).alias("candidate"), F.concat(F.lit(f"{directory}/"), stem, F.lit("--"), suffix, F.lit(".md")).alias("fallback"))


def plain_candidates(entities: DataFrame, directory: str, path: Column) -> DataFrame:
    candidate = F.concat(F.lit(f"{directory}/"), page_path(path), F.lit(".md"))
    return entities.select("*", candidate.alias("candidate"), candidate.alias("fallback"))


def unique_paths(candidates: DataFrame, order: str) -> DataFrame:
    """candidates (id, candidate, fallback, `order`) with a path that no other has, letter case ignored.

    The first to want a path gets it; later ones get their fallback, numbered --2, --3, ... where that is
    taken. A numbered path may clash with one that another entity wants as it is: such rows are settled again,
    as later arrivals, until none clash. Each round only handles the rows still open.
    """

    candidates = candidates.select("id", "candidate", "fallback", F.col(order).alias("_order"))
    order = "_order"
    first = Window.partitionBy(F.lower("candidate")).orderBy(order)
    ranked = candidates.withColumn("_n", F.row_number().over(first))
    done = stored(ranked.filter("_n = 1").select("id", F.col("candidate").alias("path"), order), "paths")
    open_ = stored(ranked.filter("_n > 1").select("id", "fallback", order, F.lit(0).alias("_from")), "paths-open")
    while not open_.isEmpty():
        taken = done.select(F.lower("path").alias("_path")).distinct()
        stem = F.regexp_replace("fallback", r"\.md$", "")
        turn = Window.partitionBy(F.lower("fallback")).orderBy(order)
        k = F.row_number().over(turn) + F.col("_from")
        wanted = open_.withColumn("_k", k).withColumn("path", F.when(F.col("_k") == 1, F.col("fallback")).otherwise(F.concat(stem, F.lit("--"), F.col("_k").cast("string"), F.lit(".md"))))
        free = wanted.withColumn("_path", F.lower("path")).join(taken, "_path", "left_anti")
        settled = stored(free.withColumn("_w", F.row_number().over(Window.partitionBy("_path").orderBy(order))).filter("_w = 1").select("id", "path", order), "paths")
        left = open_.join(settled.select("id"), "id", "left_anti")
        reached = wanted.groupBy(F.lower("fallback").alias("_f")).agg(F.max("_k").alias("_most"))
        open_ = stored(left.withColumn("_f", F.lower("fallback")).join(reached, "_f").select("id", "fallback", order, F.col("_most").alias("_from")), "paths-open")
        done = stored(done.unionByName(settled), "paths")
    return done.select("id", "path")
