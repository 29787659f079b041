"""GraphML tables, the run manifest's counts, and checks of rendered pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hashed, literal_id
from ..schema import is_a
from ..storage import stored

FAR = 1 << 30


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with dense positions 1, 2, ... in a total order, without a single-task sort.

    Rows are range-partitioned and sorted; each partition's size is counted, and prefix sums over the sizes
    turn places inside partitions into places overall. The sizes are one row per partition.
    """

    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    inside = parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), "_part").withColumn(out, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def _bucket(key: Column) -> Column:
    """The start of a node's key, up to three characters of its hash: rises with the key, and is known without a sort."""
    return F.regexp_extract(key, "(?s)^[^:]*:([^:]*:)?.{0,3}", 0)


def _numbered(rows: DataFrame, keys: DataFrame, order: list[str], out: str) -> DataFrame:
    """rows with dense positions in a total order that begins with their `bucket`; keys has the bucket of every row.

    Buckets are counted first (one row each), so that sorted rows need not be stored to be numbered.
    """
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("bucket", F.coalesce(F.sum("_n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    return placed.join(F.broadcast(before), "bucket").withColumn(out, F.col("_place") + F.col("_before"))


def numbered_nodes(triples: DataFrame, id_of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Nodes by key. Where the triples' ids stand for others, id_of gives these, after nodes are made distinct and dealt."""
    ends = F.array(F.struct(F.lit("entity").alias("kind"), F.col("s").alias("v")), F.struct(F.when(F.col("o_kind") == "E", "entity").otherwise("literal").alias("kind"), F.when(F.col("o_kind") == "E", F.col("o_id")).otherwise(F.coalesce("o_value", F.lit(""))).alias("v")))
    nodes = triples.select(F.explode(ends).alias("x")).select("x.*").distinct()
    label = F.when(F.col("kind") == "entity", id_of(F.col("v"))).otherwise(F.col("v"))
    key = F.when(F.col("kind") == "entity", F.concat(F.lit("entity:"), id_of(F.col("v")))).otherwise(literal_id(F.col("v")))
    dealt = stored(nodes.withColumn("bucket", _bucket(key)), "nodes")
    # The hash is taken again on the far side, which is cheaper than to carry it there.
    found = _numbered(dealt.repartition("bucket").withColumn("key", key), dealt, ["key"], "n")
    return found.select(F.format_string("n%06d", "n").alias("node_id"), "key", "kind", label.alias("label"))


def numbered_edges(triples: DataFrame, id_of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One edge per triple, ordered by subject, predicate, object and seq; id_of as for numbered_nodes()."""
    source = F.concat(F.lit("entity:"), id_of(F.col("s")))
    target = F.when(F.col("o_kind") == "E", F.concat(F.lit("entity:"), id_of(F.col("o_id")))).otherwise(literal_id(F.coalesce("o_value", F.lit(""))))
    dealt = triples.withColumn("bucket", _bucket(source))
    edges = dealt.repartition("bucket").withColumns({"source": source, "target": target}).select("bucket", "source", F.col("p").alias("predicate"), "target", "seq")
    found = _numbered(edges, dealt.select("bucket"), ["source", "predicate", "target", "seq"], "n")
    return found.select(F.format_string("e%06d", "n").alias("edge_id"), "source", "predicate", "target", "seq")


def numbered_bundles(bundles: list, rows_each: int = 800_000) -> DataFrame:
    """The edges of numbered_edges() from bundles of facts that are still to be written out (fixture.Bundle), nulls last.

    A bundle's row is dealt by the start of its subject's key and its edges are made where they are sorted. There are as many
    partitions as leave about rows_each edges to one, so that it is sorted in memory.
    """
    types = sorted({b.type for b in bundles}, key=lambda t: f"{t}:")
    longs = sorted({c for b in bundles for c in b.rows.columns if c[0] == "n"})
    texts = sorted({c for b in bundles for c in b.rows.columns if c[0] == "s"})

    def sha(t: str, key: str) -> str:
        return f"sha2(CAST('{t}:' || {key} AS BINARY), 256)"

    def dealt(view: str) -> DataFrame:
        """A row for each row and subject of a view that has facts, with their number."""
        ours = [(i, b) for i, b in enumerate(bundles) if b.view == view]
        columns = ours[0][1].rows.columns
        rows = ours[0][1].rows
        if ours[0][1].about:  # read twice; once stored, the shuffles of its joins are done with
            rows = stored(rows, view)
        ends = []
        for i, b in ours:
            # Three digits of the hash; a key of null comes last.
            start = f"coalesce({types.index(b.type)} * 4096 + CAST(conv(substr({sha(b.type, b.subject)}, 1, 3), 16, 10) AS INT), {len(types) * 4096})"
            ends.append(f"named_struct('bucket', {start}, 'bundle', {i}, 'many', {' + '.join(f'CASE WHEN {f[0]} THEN 1 ELSE 0 END' if f[0] else '1' for f in b.facts)})")
        rest = [c if c in columns else f"CAST(NULL AS {'BIGINT' if c[0] == 'n' else 'STRING'}) AS {c}" for c in longs + texts]
        return rows.selectExpr(f"inline(array({', '.join(ends)}))", *rest).filter("many > 0")

    def fact(f: tuple) -> str:
        where, p, target, value, seq = f
        made = f"named_struct('predicate', 'core:{p}', 'entity', {str(target is not None).lower()}, 'v', CAST({f"'{target}:' || " if target else ""}{value} AS STRING), 'seq', {seq})"
        return f"CASE WHEN {where} THEN {made} END" if where else made

    def chosen(made: list[str]) -> str:
        return "CASE " + " ".join(f"WHEN bundle = {i} THEN {x}" for i, x in enumerate(made)) + " END"

    every = reduce(DataFrame.unionByName, [dealt(v) for v in dict.fromkeys(b.view for b in bundles)])
    sizes = every.groupBy("bucket").agg(F.sum("many").alias("_n"))
    before = sizes.select("bucket", F.coalesce(F.sum("_n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    parts = max(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(b.about for b in bundles) // rows_each + 1)
    source = f"'entity:' || {chosen([repr(b.type) for b in bundles])} || ':' || sha2(CAST({chosen([f"'{b.type}:' || {b.subject}" for b in bundles])} AS BINARY), 256) AS source"
    # All facts together are too much for one generated method. The function on an array, never true, keeps this step out of whole-stage code, so that its code is split.
    facts = chosen([f"array({', '.join(map(fact, b.facts))})" for b in bundles]).replace("CASE ", "CASE WHEN exists(array(bundle), x -> x < 0) THEN NULL ", 1)
    made = every.repartition(parts, "bucket").selectExpr("bucket", source, f"{facts} AS facts").select("bucket", "source", F.explode("facts").alias("e")).filter("e IS NOT NULL").select("bucket", "source", "e.*")
    target = F.when(F.col("entity"), F.concat(F.lit("entity:"), hashed(F.col("v")))).otherwise(literal_id(F.coalesce("v", F.lit(""))))
    made = made.select("bucket", "source", "predicate", target.alias("target"), "seq")
    order = [F.asc_nulls_last(c) for c in ("source", "predicate", "target", "seq")]
    placed = made.withColumn("_place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    found = placed.join(F.broadcast(before), "bucket").withColumn("n", F.col("_place") + F.col("_before"))
    return found.select(F.format_string("e%06d", "n").alias("edge_id"), "source", "predicate", "target", "seq")


def diagnostics_by_code(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("code").agg(F.count(F.lit(1)).alias("count"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(relative_path, n, text): the lines of each page."""
    return pages.select("relative_path", F.posexplode(F.split("markdown", r"\r?\n")).alias("n", "text"))


def front_matter(pages: DataFrame) -> DataFrame:
    """(relative_path, key, value) of the lines between the first two ---; a page without both has none.

    The last value of a repeated key holds.
    """
    lines = page_lines(pages).withColumn("mark", F.rtrim(F.col("text")) == "---")
    ends = lines.groupBy("relative_path").agg(F.max(F.when(F.col("n") == 0, F.col("mark"))).alias("opens"), F.min(F.when(F.col("mark") & (F.col("n") > 0), F.col("n"))).alias("close"))
    inside = lines.join(ends.filter("opens AND close IS NOT NULL"), "relative_path").filter("n > 0 AND n < close AND contains(text, ':')")
    pairs = inside.select("relative_path", "n", F.trim(F.substring_index("text", ":", 1)).alias("key"), F.trim(F.regexp_replace("text", r"^[^:]*:", "")).alias("value"))
    return pairs.groupBy("relative_path", "key").agg(F.max_by("value", "n").alias("value"))


def section_lines(pages: DataFrame, heading: str) -> DataFrame:
    """(relative_path, n, text): the lines after a heading, up to the next heading of its level or above."""
    level = len(heading) - len(heading.lstrip("#"))
    lines = page_lines(pages)
    starts = lines.filter(F.rtrim(F.col("text")) == heading).groupBy("relative_path").agg(F.min("n").alias("start"))
    after = lines.join(starts, "relative_path").filter("n > start")
    ends = after.filter(F.col("text").rlike(f"^#{{1,{level}}} ")).groupBy("relative_path").agg(F.min("n").alias("stop"))
    return after.join(ends, "relative_path", "left").filter(F.col("n") < F.coalesce("stop", F.lit(FAR))).select("relative_path", "n", "text")


def link_violations(pages: DataFrame, required: DataFrame, heading: str) -> DataFrame:
    """(relative_path, problem) for required pages: page-missing, section-missing, no-links or plain-bullet."""
    there = required.join(pages.select("relative_path"), "relative_path", "left_semi")
    missing = required.join(pages.select("relative_path"), "relative_path", "left_anti").select("relative_path", F.lit("page-missing").alias("problem"))
    has = page_lines(pages).filter(F.rtrim(F.col("text")) == heading).select("relative_path").distinct()
    unsectioned = there.join(has, "relative_path", "left_anti").select("relative_path", F.lit("section-missing").alias("problem"))
    bullets = section_lines(pages.join(there, "relative_path", "left_semi"), heading).filter(F.col("text").startswith("- "))
    counted = bullets.groupBy("relative_path").agg(F.count(F.lit(1)).alias("bullets"), F.count(F.when(~F.col("text").startswith("- [["), 1)).alias("plain"))
    judged = there.join(has, "relative_path", "left_semi").join(counted, "relative_path", "left")
    empty = judged.filter("bullets IS NULL").select("relative_path", F.lit("no-links").alias("problem"))
    plain = judged.filter("plain > 0").select("relative_path", F.lit("plain-bullet").alias("problem"))
    return missing.union(unsectioned).union(empty).union(plain)


def exit_code(runs: DataFrame) -> DataFrame:
    """runs (failed, diagnostics, allow_diagnostics, ...) with code: 1 for a failed run; 2 for one with diagnostics unless they are allowed; else 0."""
    return runs.withColumn("code", F.when(F.col("failed"), 1).when((F.col("diagnostics") > 0) & ~F.col("allow_diagnostics"), 2).otherwise(0))


def method_counts(declares: DataFrame) -> DataFrame:
    """(file_id, methods): different methods that each file declares, of rows (file_id, method_id) with repeats."""
    return declares.groupBy("file_id").agg(F.countDistinct("method_id").alias("methods"))


def branch_of(triples: DataFrame, repository_id: str, p: str) -> str:
    """The first literal of the repository's predicate, or `unknown` if there is none or it is blank."""
    found = triples.filter(is_a(p) & (F.col("s") == repository_id) & (F.col("o_kind") == "L")).agg(F.min_by("o_value", "seq").alias("v")).first().v
    return found if (found or "").strip() else "unknown"
