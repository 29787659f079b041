"""Transitive closure by levels: each round joins the newest pairs only with the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def closure(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(s, o, depth, trail) for every o reachable from s by (s, o) edges, depth the least number of edges.

    trail is the edges' numbers (column seq, where there is one) along the way, the least of all ways that are
    as short: at a depth, a walk that takes edges in their order meets the nodes by trail. A node on a cycle
    reaches itself. Rounds are as many as the longest shortest path (or limit). Every round's pairs are written
    to the shared folder; those found before are taken out by an anti join with one table, which is
    written anew when the rounds since have made it twice as large.
    """
    seq = F.col("seq") if "seq" in edges.columns else F.lit(0)
    steps = stored(edges.groupBy("s", "o").agg(F.min(seq.cast("long")).alias("seq")), "closure-edges")
    newest = stored(steps.select("s", "o", F.lit(1).alias("depth"), F.array("seq").alias("trail")), "closure")
    whole, fresh, depth = newest, [], 1
    size = added = 0
    while limit is None or depth < limit:
        depth += 1
        reach = newest.select("s", F.col("o").alias("_via"), "trail").join(steps.select(F.col("s").alias("_via"), "o", "seq"), "_via")
        reach = reach.groupBy("s", "o").agg(F.min(F.concat("trail", F.array("seq"))).alias("trail"))
        for known in (whole, *fresh):
            reach = reach.join(known.select("s", "o"), ["s", "o"], "left_anti")
        newest = stored(reach.select("s", "o", F.lit(depth).alias("depth"), "trail"), "closure")
        count = newest.count()
        if not count:
            break
        fresh.append(newest)
        size, added = size or whole.count(), added + count
        if added > size:
            whole, fresh, size, added = stored(reduce(DataFrame.unionByName, (whole, *fresh)), "closure"), [], size + added, 0
    return reduce(DataFrame.unionByName, (whole, *fresh))


def base_types(inherits: DataFrame) -> DataFrame:
    """All base types of each type, nearest first by depth and trail."""
    return closure(inherits)


def implemented_interfaces(inherits: DataFrame, implements: DataFrame) -> DataFrame:
    """(s, o): a type's interfaces, those of all its base types, and those interfaces' parents."""
    above = closure(inherits)
    owners = above.select("s", F.col("o").alias("_base")).unionByName(implements.select("s").distinct().withColumn("_base", F.col("s")))
    direct = owners.join(implements.select(F.col("s").alias("_base"), "o"), "_base").select("s", "o").distinct()
    parents = direct.select("s", F.col("o").alias("_i")).join(above.select(F.col("s").alias("_i"), "o"), "_i").select("s", "o")
    return direct.unionByName(parents).distinct()
