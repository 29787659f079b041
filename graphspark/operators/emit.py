"""Building triples from rows of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..schema import PREDICATES


def literal(p: str, value: Column) -> Column:
    return F.struct(F.lit(_known(p)).alias("p"), F.lit("L").alias("o_kind"), F.lit(None).cast("string").alias("o_id"), value.cast("string").alias("o_value"))


def edge(p: str, target: Column) -> Column:
    return F.struct(F.lit(_known(p)).alias("p"), F.lit("E").alias("o_kind"), target.alias("o_id"), F.lit(None).cast("string").alias("o_value"))


def _known(p: str) -> str:
    if f"core:{p}" not in PREDICATES:
        raise ValueError(f"no predicate {p}")
    return f"core:{p}"


def entity(entity_type: str, name: Column, path: Column) -> list[Column]:
    """The three facts that every entity has."""
    return [literal("entityType", F.lit(entity_type)), literal("hasName", name), literal("hasPath", path)]


def triples_of(rows: DataFrame, subject: Column, facts: list[Column], seq: Column) -> DataFrame:
    """One triple per row and fact; seq numbers the row's first fact, the others follow it."""
    spread = rows.select(subject.alias("s"), seq.cast("long").alias("_seq"), F.posexplode(F.array(*facts)).alias("_i", "_f"))
    return spread.select((F.col("_seq") + F.col("_i")).alias("seq"), "s", "_f.p", "_f.o_kind", "_f.o_id", "_f.o_value")


def entity_id(entity_type: str, natural_key: Column) -> Column:
    return stable_id(entity_type, natural_key)
