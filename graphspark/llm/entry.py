"""The training-data queries and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, maxscore, mixing, urlfilter
from .chat import op8_chat
from .maxscore import op4_maxscore
from .mixing import op1_mixing
from .orderhash import op5_orderhash
from .packing import op6_packing
from .ppm import op7_ppm
from .quality import op10_quality
from .simhash import op2_simhash
from .urlfilter import op3_urlfilter
from .warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_simhash, op3_urlfilter, op4_maxscore, op5_orderhash, op6_packing, op7_ppm, op8_chat, op9_warc, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {**mixing.SQL, **urlfilter.SQL, **maxscore.SQL, **chat.SQL}
