"""Selecting edges and values from triples, with the rules for repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import is_a

_BITS = 62


def edges(triples: DataFrame, p: str) -> DataFrame:
    """Distinct (s, o, seq) of a predicate between entities; seq is the first."""
    return raw_edges(triples, p).groupBy("s", "o").agg(F.min("seq").alias("seq"))


def raw_edges(triples: DataFrame, p: str) -> DataFrame:
    """(s, o, seq) with repeats, for counting."""
    return triples.filter(is_a(p) & (F.col("o_kind") == "E")).select("s", F.col("o_id").alias("o"), "seq")


def literals(triples: DataFrame, p: str) -> DataFrame:
    return triples.filter(is_a(p) & (F.col("o_kind") == "L")).select("s", F.coalesce("o_value", F.lit("")).alias("v"), "seq")


def first(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value of the least seq for each key."""
    return df.groupBy(key).agg(F.min_by(value, "seq").alias(value))


def last(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, "seq").alias(value))


def caseless_set(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values of each key ignoring letter case, in the spelling seen first; blank ones are dropped."""
    kept = df.filter(F.trim(value) != "")
    return kept.groupBy(key, F.lower(value).alias("_fold")).agg(F.min_by(value, "seq").alias(value)).drop("_fold")


def typed(df: DataFrame, column: str, metadata: DataFrame, entity_type: str) -> DataFrame:
    """The rows whose column is an entity of the type."""
    return df.join(metadata.filter(F.col("entity_type") == entity_type).select(F.col("id").alias(column)), column, "left_semi")


def ordered(by: list[Column], item: Column) -> Column:
    """Collect items in the order of `by` (an aggregate); both are structs' fields, so ties are broken by the item."""
    collected = F.array_sort(F.collect_list(F.struct(*[b.alias(f"_{i}") for i, b in enumerate(by)], item.alias("item"))))
    return F.transform(collected, lambda x: x["item"])


def predicate_counts(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(p, triples, subjects, objects, last_seq) of the named predicates, with exact numbers of different subjects and objects.

    Each subject and each object is shuffled once with the set of its predicates as bits, not once per predicate.
    """
    ids = {p: i for i, p in enumerate(predicates)}
    words = range(0, len(predicates), _BITS)
    none = F.lit(0).cast("long")

    def bits(w: int) -> Column:
        found = F.create_map(*[x for p in predicates[w : w + _BITS] for x in (F.lit(p), F.lit(1 << ids[p] - w).cast("long"))])
        return F.coalesce(F.element_at(found, F.col("p")), none)

    def end(kind: Column, v: Column, subject: bool, object_: bool) -> Column:
        masks = [(F.col(f"w{w}") if mine else none).alias(f"{role}{w}") for role, mine in (("s", subject), ("o", object_)) for w in words]
        return F.struct(kind.alias("kind"), v.alias("v"), (none if subject or object_ else F.col("seq")).alias("seq"), *masks)

    # A literal may read like an entity's id, so they are told apart by kind. The rows of a predicate itself bring its number and last seq.
    rows = F.array(end(F.lit("E"), F.col("s"), True, False), end(F.col("o_kind"), F.coalesce("o_id", "o_value"), False, True), end(F.lit("P"), F.col("p"), False, False))
    spread = triples.select("*", *[bits(w).alias(f"w{w}") for w in words]).select(F.explode(rows).alias("x")).select("x.*").filter("v IS NOT NULL")
    masks = [f"{role}{w}" for role in "so" for w in words]
    once = spread.groupBy("kind", "v").agg(F.max("seq").alias("seq"), F.count(F.when(F.col("kind") == "P", 1)).alias("n"), *[F.bit_or(m).alias(m) for m in masks])

    def has(role: str, p: str) -> Column:
        return F.col(f"{role}{ids[p] // _BITS * _BITS}").bitwiseAND(F.lit(1 << ids[p] % _BITS).cast("long")) != 0

    each = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), has("s", p).alias("s"), has("o", p).alias("o")) for p in predicates]), lambda x: x["s"] | x["o"])
    itself = F.array(F.struct(F.col("v").alias("p"), F.lit(False).alias("s"), F.lit(False).alias("o")))
    return once.select("n", "seq", F.explode(F.when(F.col("kind") == "P", itself).otherwise(each)).alias("x")).groupBy("x.p").agg(
        F.sum("n").alias("triples"), F.count(F.when(F.col("x.s"), 1)).alias("subjects"), F.count(F.when(F.col("x.o"), 1)).alias("objects"), F.max("seq").alias("last_seq")
    )
