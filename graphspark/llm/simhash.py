"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint bit gets a non-zero vector of radius + 1 bits; table v (every non-zero v) masks in the
bits whose vector has an odd product with v. The bits in which two fingerprints within the radius differ
span a space of at most `radius` dimensions, so some v is orthogonal to it: the pair agrees on all of v's mask and
meets in table v. Nothing within the radius can be missed.

Links are sought between distinct fingerprints, so copies are never expanded. A bucket of at most
PAIRS_UP_TO fingerprints compares its pairs. A larger one lists each member's one-flip neighbours among the
bits its mask leaves out: two members are within two bits exactly if they share a neighbour (or are one
themselves), and a neighbour has at most one member per open bit, so the work is linear in the bucket.

Nulls and edge cases: a null, empty or blank text has fingerprint 0 and links like any other; texts of one
or two words are one shingle; a row with a null id gets a fingerprint and its component's smallest id
(null if the component has no id); repeated rows and repeated ids are kept; an empty table gives no rows;
columns beside the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, spare, table
from .components import components

BITS = 64
RADIUS = 2
PAIRS_UP_TO = 32


def fingerprint(hashes: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """The fingerprint, an array of one unsigned number, of 64-bit hashes: a bit is set if it is in over half of them."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = np.asarray(hashes[at : at + step], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def _fingerprints(width: int, seed: int):
    from xxhash import xxh64_intdigest

    def hashes(text: bytes | None) -> list[int]:
        words = (text or b"").lower().split()
        if len(words) < width:
            return [xxh64_intdigest(b" ".join(words), seed)] if words else []
        return [xxh64_intdigest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)))]

    def majority(per_doc: list[list[int]]) -> np.ndarray:
        """The fingerprints, as unsigned numbers, of documents given by their shingles' hashes."""
        sizes = np.array([len(x) for x in per_doc])
        out = np.zeros(len(per_doc), dtype=np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.fromiter((h for x in per_doc for h in x), dtype="<u8", count=int(sizes.sum()))
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            out[full] = np.packbits(counts * 2 > sizes[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[np.ndarray] = []
            held: list[list[int]] = []
            total = 0
            for text in batch.column(1).cast(pa.binary()):
                found = hashes(text.as_py())
                if total + len(found) > 1 << 17 and held:
                    done.append(majority(held))
                    held, total = [], 0
                if len(found) > 1 << 17:
                    done.append(fingerprint(found))
                else:
                    held.append(found)
                    total += len(found)
            if held:
                done.append(majority(held))
            prints = np.concatenate(done).view(np.int64) if done else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=[batch.schema.names[0], "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its 64-bit SimHash as a signed long: a bit is set if it is in over half of the shingles' XXH64."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(width, seed), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of which any `radius` bits are all left out by at least one."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size)]


def _neighbours(mask: int) -> Column:
    """The fingerprint and all that differ from it in one bit that the mask leaves out."""
    flips = [_signed(1 << i) for i in range(BITS) if not mask >> i & 1]
    return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])


def near_pairs(prints: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp` that join the same groups as all pairs within RADIUS.

    Up to PAIRS_UP_TO members a bucket gives every pair within the radius; a larger one links the members
    that meet at a neighbour to the smallest of them. Every link given is within the radius.
    """
    masks = covering_masks(RADIUS)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(tables).alias("k")).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(keyed.join(sizes, ["t", "key"]), "simhash-buckets")
    few = members.filter(F.col("n") <= PAIRS_UP_TO)
    pairs = (
        few.alias("x").join(few.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )
    near = F.when(F.col("t") == 0, _neighbours(masks[0]))
    for t, m in enumerate(masks[1:], 1):
        near = near.when(F.col("t") == t, _neighbours(m))
    spread = members.filter(F.col("n") > PAIRS_UP_TO).select("t", "key", "fp", F.explode(near).alias("z"))
    met = spread.groupBy("t", "key", "z").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    many = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.union(many).distinct()


def _by_print(stored: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable through links from each distinct one."""
    prints = materialize(stored.select("fp").distinct(), "simhash-prints")
    roots = components(near_pairs(prints)).select(F.col("node").alias("fp"), "root")
    return prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id: the smallest id among all documents reachable through links."""
    stored = materialize(fingerprints(docs, width, seed, id_col, text_col), "simhash")
    firsts = stored.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = materialize(firsts.join(_by_print(stored), "fp"), "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return stored.join(named, "fp").select("doc_id", "fp", "component_id")


def _text_key(text_col: str) -> Column:
    """128 bits of hash by which equal texts are known, a null apart from an empty text."""
    text = F.col(text_col).cast("string")
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.isNull().alias("none"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=None, **options) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id stays, then the smallest text; nulls last.

    groups(keyed, **options) gives (key, root) for every distinct text of keyed (key, text); by default those that
    SimHash links. Ids only choose within a group: rows whose id is null or repeated belong where their text does.
    """
    own_key, won_id, place = (spare(docs, c) for c in ("_key", "_id", "_place"))
    keyed = docs.withColumn(own_key, _text_key(text_col))
    rows = keyed.select(F.col(id_col).cast("long").alias("id"), F.col(own_key).alias("key"), F.col(text_col).cast("string").alias("text"))
    roots = (groups or _simhash_groups)(rows.select("key", "text"), **options)
    rooted = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")).join(roots, "key")
    rooted = materialize(rooted, "dedup-rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    tied = rooted.join(best, "root").filter(F.col("first").eqNullSafe(F.col("best")))
    tied = materialize(tied.select("root", "key", "first"), "dedup-best")
    many = tied.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    open_ = tied.join(many, "root").select("root", "key")
    # Only groups whose smallest id has several texts need these compared.
    text = F.struct(F.col("text").isNull().alias("none"), "text", "key")
    chosen = rows.select("key", "text").join(open_, "key").groupBy("root").agg(F.min(text).alias("t")).select(F.col("t.key").alias("key"))
    sole = tied.join(many, "root", "left_anti").select("key")
    won = sole.union(chosen).join(tied.select("key", "first"), "key").select(F.col("key").alias(own_key), F.col("first.id").alias(won_id))
    # A plain equality on the key, by which the window then finds the texts already dealt: they are shuffled once.
    kept = keyed.join(won, own_key).filter(F.col(id_col).cast("long").eqNullSafe(F.col(won_id)))
    ranked = kept.withColumn(place, F.row_number().over(Window.partitionBy(own_key).orderBy(F.lit(0))))
    return ranked.filter(F.col(place) == 1).select(*docs.columns)


def _simhash_groups(keyed: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    rows = keyed.mapInArrow(_fingerprints(width, seed), "key struct<a: long, b: long, none: boolean>, fp long")
    stored = materialize(rows.distinct(), "simhash")
    return stored.join(_by_print(stored), "fp").select("key", "root")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
