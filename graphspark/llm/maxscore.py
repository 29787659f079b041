"""Exact top-k by MaxScore over shards.

A component of a vector is a term whose weight in a document is that document's component. In a shard, a
term's contribution to a query's score lies between bounds from the least and greatest component held there;
what it can add above its least contribution is its gain. Terms of small gain whose gains together cannot
lift a document over the k-th best score so far are non-essential. The essential terms' postings are
traversed for all documents of the shard; the other terms are then probed in groups, largest gain first,
for those documents only that their bounds still leave competitive. The shards' best are merged by score.

Candidates are dealt by hash to shards of about SHARD rows and queries to blocks of about BLOCK rows, so that
a task holds one shard and one block whatever the table's size. Nothing is broadcast or collected.

Components are scaled to floor(256 * x) and scored in whole numbers: in floating point where it holds every sum exactly,
which vectors of small components make sure of, else (vectors with a large component, as a rule none) in Python's
integers over the whole shard. A score beyond a long's range counts as the end of that range. Vectors of fewer
components count as padded by zeros.

Nulls and edge cases: a vector that is null or holds a null or non-finite component takes no part, nor does
a row without an id; an empty vector scores 0 with all; a query's own rows are those of the same id; of
several rows of one query id the smallest vector is the query; equal scores go to the smaller id; repeated
candidate rows are each ranked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCALE = 256
SHARD = 4096
BLOCK = 1024
SEEDS = 256
GROUP = 16
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """The vector as doubles, or null if it takes no part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite, vector.cast("array<double>"))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    sizes = pa.compute.list_value_length(vectors).to_numpy()
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = pa.compute.list_flatten(vectors).to_numpy()
    return out


def _whole(rows: np.ndarray) -> np.ndarray:
    """The scaled components as Python's integers; a double beyond 2^53 is whole."""
    return np.array([[math.floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def best_of_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of rows of a shard, each query's k best among them."""
    bound = int((2**53 // max(1, queries.shape[1])) ** 0.5) // SCALE - 1
    small_q, small_r = (np.abs(x).max(axis=1, initial=0) <= bound for x in (queries, rows))
    found = _best_of_small(query_ids[small_q], np.floor(queries[small_q] * SCALE), ids[small_r], np.floor(rows[small_r] * SCALE), k) if small_q.any() and small_r.any() else []
    # Pairs of which either has a large component.
    for of_q, of_r in ((small_q, ~small_r), (~small_q, np.ones_like(small_r))):
        if of_q.any() and of_r.any():
            whole = _whole(rows[of_r])
            for query_id, query in zip(query_ids[of_q].tolist(), _whole(queries[of_q])):
                scores = whole @ query
                found += [(query_id, i, max(-_LONG - 1, min(_LONG, s))) for i, s in zip(ids[of_r].tolist(), scores.tolist()) if i != query_id]
    return found


def _best_of_small(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Each query's k best rows, ties to smaller ids, of scaled components whose sums of products floating point holds exactly."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    least, most = rows.min(axis=0), rows.max(axis=0)
    high = np.maximum(queries * least, queries * most)
    low = np.minimum(queries * least, queries * most)
    gains = high - low
    seeds = queries @ rows[:SEEDS].T
    seeds[query_ids[:, None] == ids[None, :SEEDS]] = -np.inf
    floor = np.sort(seeds, axis=1)[:, -k] if seeds.shape[1] >= k else np.full(len(queries), -np.inf)
    by_gain = np.argsort(gains, axis=1, kind="stable")  # smallest first
    reach = low.sum(axis=1)[:, None] + np.cumsum(np.take_along_axis(gains, by_gain, axis=1), axis=1)
    spare = (reach < floor[:, None]).sum(axis=1)  # so many terms are non-essential
    rank = np.empty_like(by_gain)
    np.put_along_axis(rank, by_gain, np.arange(queries.shape[1])[None, :].repeat(len(queries), axis=0), axis=1)
    essential = rank >= spare[:, None]
    out = []
    step = max(1, (1 << 20) // max(1, len(rows)))
    for at in range(0, len(queries), step):
        partial = np.where(essential, queries, 0)[at : at + step] @ rows.T
        for j, scores in enumerate(partial, at):
            others = by_gain[j, : spare[j]][::-1]
            rest = high[j, others].sum()
            live = np.flatnonzero((scores + rest >= floor[j]) & (ids != query_ids[j]))
            found = scores[live]
            for g in range(0, len(others), GROUP):
                dims = others[g : g + GROUP]
                found = found + rows[np.ix_(live, dims)] @ queries[j, dims]
                rest -= high[j, dims].sum()
                stay = found + rest >= floor[j]
                live, found = live[stay], found[stay]
            top = np.lexsort((ids[live], -found))[:k]
            out += [(int(query_ids[j]), int(ids[i]), int(s)) for i, s in zip(live[top], found[top])]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best among all other rows."""
    rows = vectors.withColumn("_query", is_query).select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v"), "_query").filter("id IS NOT NULL AND v IS NOT NULL")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_query"), 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    shards, blocks, width = max(1, -(-sizes.n // SHARD)), max(1, -(-sizes.q // BLOCK)), max(1, sizes.width or 1)
    everywhere = F.sequence(F.lit(0), F.lit(blocks - 1))
    candidates = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(everywhere).alias("block"))
    asked = rows.filter("_query").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = best_of_shard(left["id"].to_numpy(), _matrix(left["v"], width), right["id"].to_numpy(), _matrix(right["v"], width), k)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})


    merged = asked.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInArrow(best, "query_id long, vec_id long, score long")
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = {
    "op4_maxscore": """
    WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score FROM usable q, usable d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """
}
