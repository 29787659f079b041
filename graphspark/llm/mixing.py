"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the text volume over its present share. A document gets a
Poisson-distributed number of copies whose mean is its source's rate: the distribution function is inverted
at a uniform number hashed from a seed and the document's id, so the same document always gets the same
count. Copies are dealt out by a hash of (seed, id, copy) and sorted by it within partitions, which puts
them in a uniformly random global order.

The driver gets one row of counts per *named* source and one for all the others, so what it holds is bounded
by the weights given, however many sources the data has; rates reach the rows as literals without a join.

Nulls and edge cases: a null source belongs to the others; a null or empty text has size 0 and follows its
source's rate; a null id counts as the empty id; repeated rows have equal counts; a source of weight 0 or a
class without text is dropped or left out by its rate 0; an empty table gives no rows; other columns pass
through, and those named like the three added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table

#: Shares of the text volume. All sources not named share OTHERS.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.1, "src4": 0.1}
OTHERS = 0.4
SEED = "mix-1"
ADDED = ("copy", "n_copies", "shuffle_key")


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where 53-bit uniform numbers can't tell it from 1."""
    if rate <= 0:
        return []
    out, total, k = [], 0.0, 0
    while total < 1 - 2.0**-53:
        term = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        total += term
        if k > rate and term < 1e-18:
            break
        out.append(total)
        k += 1
    return out


def _hashed(bits: int, *parts: Column | str) -> Column:
    """The first bits of SHA-256 of the parts joined by colons, as a long."""
    text = F.concat_ws(":", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, bits // 4), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float], others: float, epochs: float, source_col: str, text_col: str) -> dict[str | None, float]:
    """The mean number of copies by named source; None stands for the others."""
    named = F.when(F.col(source_col).isin(list(weights)), F.col(source_col)) if weights else F.lit(None).cast("string")
    sizes = docs.select(named.alias("s"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n")).groupBy("s").agg(F.sum("n").alias("n"))
    found = {r.s: r.n for r in sizes.collect() if r.n}
    total, share = sum(found.values()), sum(weights.get(s, others) for s in found)
    return {s: epochs * total * weights.get(s, others) / share / n if share else 0.0 for s, n in found.items()}


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, others: float = OTHERS, epochs: float = 1.0, seed: str = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The documents' columns and copy (from 0), n_copies and shuffle_key, one row per copy, in shuffled order.

    epochs is the output's text volume over the input's.
    """
    weights = WEIGHTS if weights is None else weights
    docs = docs.drop(*ADDED)
    by_source = rates(docs, weights, others, epochs, source_col, text_col)
    u = spare(docs, "_u")
    uniform = (_hashed(52, seed, F.col(id_col)) + F.lit(0.5)) / F.lit(float(1 << 52))

    def copies(rate: float) -> Column:
        steps = F.array(*[F.lit(x) for x in poisson_cdf(rate)]).cast("array<double>")
        return F.size(F.filter(steps, lambda step: step < F.col(u)))

    count = copies(by_source.get(None, 0.0))
    for source, rate in by_source.items():
        if source is not None:
            count = F.when(F.col(source_col).eqNullSafe(source), copies(rate)).otherwise(count)
    for source in weights.keys() - by_source.keys():
        count = F.when(F.col(source_col).eqNullSafe(source), F.lit(0)).otherwise(count)
    counted = docs.withColumn(u, uniform).withColumn("n_copies", count).drop(u).filter("n_copies > 0")
    spread = counted.withColumn("copy", F.explode(F.expr("sequence(0, n_copies - 1)")))
    keyed = spread.withColumn("shuffle_key", _hashed(60, seed, F.col(id_col), F.col("copy")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*docs.columns, *ADDED)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in [*WEIGHTS.items(), ("", OTHERS)])
    names = ", ".join(f"'{s}'" for s in WEIGHTS)
    return f"""
    WITH weights(cls, weight) AS (VALUES {values}),
    docs AS (SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '' END AS cls,
        (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
    sizes AS (SELECT cls, sum(coalesce(length(text), 0))::BIGINT AS n FROM docs GROUP BY cls HAVING sum(coalesce(length(text), 0)) > 0),
    rates AS (SELECT cls, (SELECT sum(n) FROM sizes)::DOUBLE * weight / (SELECT sum(weight) FROM sizes JOIN weights USING (cls)) / n AS rate FROM sizes JOIN weights USING (cls)),
    steps AS (SELECT cls, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY cls ORDER BY k) AS cdf FROM rates, generate_series(0, 120) g(k)),
    counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM steps s WHERE s.cls = d.cls AND s.cdf < d.u)::INTEGER AS n_copies FROM docs d)
    SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, n_copies,
        ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
    FROM counted, generate_series(0, n_copies - 1) c(copy) WHERE n_copies > 0
    """


SQL = {"op1_mixing": _sql()}
