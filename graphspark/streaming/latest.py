"""Entity values kept current from a stream of triples (an extension: the graph itself is built in batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_values(stream: DataFrame) -> DataFrame:
    """(s, p, value, seq): the last value of every entity and predicate so far; write it in update or complete mode.

    The state is one row per entity and predicate, as large as the table it stands for.
    """
    values = stream.filter(F.col("o_kind") == "L").select("s", "p", "o_value", "seq")
    return values.groupBy("s", "p").agg(F.max_by("o_value", "seq").alias("value"), F.max("seq").alias("seq"))
