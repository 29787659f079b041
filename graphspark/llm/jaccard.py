"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least `least`.

Texts of equal sets are one member. Pairs are proposed by SimHash (fingerprints of the shingles within op2's radius,
by its covering masks) and, since similar texts mostly differ by more bits than that, also by MinHash bands
(BANDS of ROWS values: a pair at 0.8 meets in no band once in 7 million pairs). Each pair proposed is judged on
the full sets, so no link is an estimate. A first round judges SimHash's pairs and links a bucket's members to its
smallest one, which settles groups of copies in linear work. In buckets still of several groups, a second compares
pairs across groups: all of them in buckets of up to FEW members, in larger ones those that can be similar by what
their sets hold. There, shingles of at most RARE of the members are rare. In the order of their counts, two similar
sets share one of the first n - ceil(least * n) + 1 shingles of each: a rare one, by which such pairs are found (at
most RARE partners for each), or else they share common shingles only, and both have enough of these. Members with
enough are first linked to the bucket's member with the fewest rare ones, the likeliest origin of a group of edited
copies; pairs that can be similar across the groups that are left are all judged. Quadratic are only members that
share mostly common shingles and yet aren't similar; none is dropped.

Nulls and edge cases: null, empty and blank texts have the empty set and are one group; texts shorter than a
shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .simhash import fingerprint, near_pairs

BANDS, ROWS = 40, 5
FEW, RARE = 16, 16
_AT_ONCE = 1 << 10
_KEY = "key struct<a: long, b: long, none: boolean>"


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    found = {xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))} if words else ()
    return np.sort(np.fromiter(found, dtype="<u8", count=len(found)))


def _sketched(width: int):
    from xxhash import xxh64_intdigest

    draw = np.random.default_rng(42)
    mixed, odd = (draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    odd |= np.uint64(1)

    def bands(found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(0, dtype=np.int64)
        parts = [((found[at : at + _AT_ONCE, None] ^ mixed) * odd).min(axis=0) for at in range(0, len(found), _AT_ONCE)]
        least = np.minimum.reduce(parts).reshape(BANDS, ROWS)
        return np.array([xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), width) for text in batch.column(1).cast(pa.binary())]
            ids = np.array([xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            prints = np.concatenate([np.zeros(0, dtype="<u8"), *(fingerprint(s) for s in sets)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["key", "member", "n", "fp", "bands"]
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text.as_py(), width).tobytes() for text in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["member", "set"])

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sets = [np.frombuffer(x.as_py(), "<i8") for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], names=["member", "h"])


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b, m, n) of members (member, n, fp) that SimHash links: of equal fingerprints each with the smallest, of near ones the smallest of each; a < b."""
    first = prints.groupBy("fp").agg(F.min(F.struct("member", "n")).alias("first"))
    same = prints.join(first, "fp").filter("member <> first.member").select(F.col("first.member").alias("a"), F.col("member").alias("b"), F.col("first.n").alias("m"), "n")
    near = near_pairs(first.select("fp"))
    for c in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")), c)
    lesser, greater = F.least("_a", "_b"), F.greatest("_a", "_b")
    return same.union(near.select(lesser["member"].alias("a"), greater["member"].alias("b"), lesser["n"].alias("m"), greater["n"].alias("n")))


def _held_by_few(members: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Of members (member, n) with their sets: (member, n, some, common), how many of its shingles others have too and how many more than RARE have, and
    (member, h), the rare shingles of several members among the first n - ceil(least * n) + 1 of each, rarest first."""
    held = materialize(sets.join(members.select("member"), "member").select("member", "set").mapInArrow(_held, "member long, h long"), "jaccard-held")
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.min("member").alias("member")).filter(F.col("f") <= RARE)
    counts = materialize(counts.select("f", F.when(F.col("f") > 1, F.col("h")).alias("h"), F.when(F.col("f") == 1, F.col("member")).alias("member")), "jaccard-counts")
    rare = materialize(held.join(counts.filter("f > 1").select("h", "f"), "h"), "jaccard-rare")
    alone = counts.filter("f = 1").groupBy("member").agg(F.count(F.lit(1)).alias("alone"))
    known = members.join(alone, "member", "left").join(rare.groupBy("member").agg(F.count(F.lit(1)).alias("rare")), "member", "left").fillna(0, ["alone", "rare"])
    known = materialize(known.select("member", "n", (F.col("n") - F.col("alone")).alias("some"), (F.col("n") - F.col("alone") - F.col("rare")).alias("common")), "jaccard-known")
    placed = rare.withColumn("place", F.row_number().over(Window.partitionBy("member").orderBy("f", "h"))).join(known, "member")
    first = placed.filter(F.col("place") <= F.col("some") - F.ceil(F.lit(least) * F.col("n") - 1e-6) + 1)
    return known, materialize(first.select("member", "h"), "jaccard-first")


def similar_groups(keyed: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(key, root) for every distinct text of keyed (key, text): texts linked by similarity share the root."""
    sketches = materialize(keyed.mapInArrow(_sketched(width), f"{_KEY}, member long, n long, fp long, bands array<long>"), "jaccard-sketches")
    near = F.least("m", "n") >= F.lit(least) * F.greatest("m", "n") - 1e-9
    prints = materialize(sketches.groupBy("member").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("fp").alias("fp")), "jaccard-prints")
    proposed = materialize(simhash_pairs(prints.select("member", "n", "fp")).filter(near).select("a", "b"), "jaccard-simhash")
    one = sketches.groupBy("member").agg(F.min(F.struct("key", "n", "bands")).alias("s")).select("member", "s.n", "s.key", F.explode("s.bands").alias("band"))
    one = materialize(one, "jaccard-bands")
    buckets = one.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("member", "n")).alias("first")).filter("size > 1")
    met = materialize(one.join(buckets, "band").select("band", "member", "n", "key", "first"), "jaccard-met")
    ends = proposed.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    wanted = met.select("member", "key").union(prints.join(ends, "member").select("member", "key")).distinct()
    texts = keyed.join(wanted, "key").dropDuplicates(["member"]).select("member", "text")
    sets = materialize(texts.mapInArrow(_sets(width), "member long, set binary"), "jaccard-sets")

    def judged(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("member").alias("a"), F.col("set").alias("x")), sets.select(F.col("member").alias("b"), F.col("set").alias("y"))
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return rows.mapInArrow(_similar(least), "a long, b long")

    starred = met.filter("member <> first.member").select(F.col("first.member").alias("a"), F.col("member").alias("b"), F.col("first.n").alias("m"), "n").filter(near)
    starred = materialize(starred.select("a", "b").union(proposed).distinct(), "jaccard-starred")
    links = materialize(judged(starred), "jaccard-links")
    roots = components(links)
    rooted = met.select("band", "member", "n").join(roots.select(F.col("node").alias("member"), "root"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("band", "size")
    rest = materialize(rooted.join(split, "band"), "jaccard-rest")
    few, many = rest.filter(F.col("size") <= FEW), rest.filter(F.col("size") > FEW)
    across = (F.col("a") < F.col("b")) & (F.col("root") != F.col("other"))

    def met_by(rows: DataFrame, by: str, *more: str) -> DataFrame:
        """Pairs of rows (by, member, n, root, *more) that share `by`: a, n, root and b, m, other, the second's of `more` with an underscore."""
        names = {"member": "b", "n": "m", "root": "other"} | {c: f"_{c}" for c in more}
        return rows.withColumnRenamed("member", "a").join(rows.withColumnsRenamed(names), by)

    def reach(x: str, y: str):
        """Whether two sets of n and m shingles can be similar if they share no more than x, or y, of theirs."""
        return F.least(x, y) * (1 + least) >= F.lit(least) * (F.col("n") + F.col("m")) - 1e-6

    known, first = _held_by_few(many.select("member", "n").distinct(), sets, least)
    groups = many.select("member", "root").distinct()
    rare = met_by(first.join(known, "member").join(groups, "member").select("h", "member", "n", "root", "some"), "h", "some")
    rare = rare.filter(across & near & reach("some", "_some")).select("a", "b")
    enough = known.filter(F.col("common") >= F.lit(least) * F.col("n") - 1e-6).select("member", "common")
    alike = materialize(many.select("band", "member", "n", "root").join(enough, "member"), "jaccard-alike")
    centre = alike.groupBy("band").agg(F.min(F.struct((F.col("n") - F.col("common")).alias("own"), F.col("member").alias("centre"), F.col("n").alias("m"), F.col("common").alias("_common"), F.col("root").alias("other"))).alias("c"))
    drawn = alike.join(centre, "band").select("member", "n", "root", "common", "c.*").filter((F.col("root") != F.col("other")) & near & reach("common", "_common"))
    drawn = drawn.select(F.least("member", "centre").alias("a"), F.greatest("member", "centre").alias("b")).distinct()
    drawn = materialize(drawn.join(starred, ["a", "b"], "left_anti"), "jaccard-drawn")
    links = materialize(links.union(judged(drawn)), "jaccard-links")
    roots = components(links).withColumnRenamed("node", "member")
    alike = alike.drop("root").join(roots, "member", "left").withColumn("root", F.coalesce("root", "member"))
    alike = met_by(materialize(alike.select("band", "member", "n", "root", "common"), "jaccard-alike"), "band", "common")
    alike = alike.filter(across & near & reach("common", "_common")).select("a", "b")
    crossing = met_by(few.select("band", "member", "n", "root"), "band").filter(across & near).select("a", "b").union(rare).union(alike).distinct()
    more = judged(crossing.join(starred.union(drawn), ["a", "b"], "left_anti"))
    roots = components(links.union(more)).select(F.col("node").alias("member"), "root")
    return sketches.select("key", "member").distinct().join(roots, "member", "left").select("key", F.coalesce("root", "member").alias("root"))
