"""Packing by concatenate-and-cut.

All documents' token ids form one long stream which fixed windows cut into sequences. A first pass
tokenizes every document once and writes the ids with running totals inside each partition; prefix sums
over the partitions' totals then place every partition in the stream, and a second pass cuts the ids at
window borders without touching the text again. Only the last sequence can be short.

Nulls and edge cases: a null or empty text is the end token alone; a null id is kept as null; repeated
rows are packed as often as they occur; an empty table gives no pieces; columns beside the two named ones
are ignored. A text of any length is encoded whole and stored in rows of at most CHUNK ids, so a piece
may also end where such a row ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

CHUNK = 1 << 16
_STORED = "part long, start long, doc_id long, doc_start long, doc_tokens long, n long, ids binary"


@cache
def load_encoder(json_path: str, ranks_path: str | None, pattern: str | None) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids that the tokenizer in json_path gives, an added token's string being that token's id.

    With ranks_path (the same vocabulary as merge ranks) the faster byte-pair encoder is used, and the
    tokenizer itself for a text on which that one gives up (runs of a million spaces); both give the same
    ids, which tests/llm check over every code point.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    added = tokenizer.get_added_tokens_decoder()
    # Only plain added tokens cut a text where their string stands and nowhere else.
    if not ranks_path or any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
        return whole
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    special = {t.content: i for i, t in added.items()}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def fast(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return whole(text)

    return fast


def default_encoder() -> tuple[str, str, str]:
    """Arguments of load_encoder() for the public byte-level vocabulary."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def _tokenized(encoder: tuple, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(*encoder)
        part, position = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4")
        schema = pa.schema([("part", pa.int64()), ("start", pa.int64()), ("doc_id", pa.int64()), ("doc_start", pa.int64()), ("doc_tokens", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                for at in range(0, len(ids), CHUNK):
                    piece = ids[at : at + CHUNK]
                    rows.append((part, position + at, doc_id.as_py(), at, len(ids), len(piece), piece.tobytes()))
                position += len(ids)
                held += len(ids)
                if held >= 16 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def tokenize(docs: DataFrame, encoder: tuple | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored row per document (or per CHUNK ids of it): its partition, the ids before it there, its ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_tokenized(encoder or default_encoder(), end_id), _STORED), "tokens")


def pack(docs: DataFrame, window: int = 2048, encoder: tuple | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) that fill windows of `window` ids.

    ids holds the piece's token ids as little-endian unsigned 32-bit numbers.
    """
    stored = tokenize(docs, encoder, end_id, id_col, text_col)
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per input partition: small whatever the text volume, so one task sums it and it is broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(bases), "part").select(
        "doc_id", "doc_start", "doc_tokens", "ids", (F.col("base") + F.col("start")).alias("at"), "n"
    )
    w = F.lit(window).cast("long")
    cut = placed.select("*", F.explode(F.expr(f"sequence(at div {window}L, (at + n - 1) div {window}L)")).alias("sequence_id"))
    first = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * w - F.col("at"))
    last = F.least(F.col("n"), (F.col("sequence_id") + 1) * w - F.col("at"))
    return cut.select(
        "doc_id", (F.col("doc_start") + first).alias("start"), (last - first).alias("length"), "doc_tokens", "sequence_id",
        (F.col("at") + first - F.col("sequence_id") * w).alias("offset"),
        F.substring("ids", (first * 4 + 1).cast("int"), ((last - first) * 4).cast("int")).alias("ids"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
