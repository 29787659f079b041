"""Document fingerprints by Order MinHash, in DataFrame operations only.

A text is the list of its K-word windows, each numbered by its earlier occurrences, so that repeats count. A word of
more than LONG_WORD characters counts as its characters, which serves texts without spaces.
One 64-bit hash of (window, number) gives a class, one of CLASSES (the first bits: one permutation per class,
as in one-permutation hashing), and a rank inside it. Each class selects its PICKS smallest members, puts
them back in text order and hashes the tuple: moving a passage changes the order and so the hash, which
makes the fingerprint follow edit distance and not just shared content. Two fingerprints' likeness is the
share of classes with equal hashes among the classes that either text fills; two empty texts have 1.

All steps are linear in the text but for two sorts of an array of longs. Arrays that a later step indexes
are columns of their own, each used at least twice, so that the optimizer does not inline them into loops.

Neighbours in id order are found with one shuffle of the texts: ids are cut into buckets by approximate
quantiles (subdivided evenly), each bucket also receives the first row of the bucket after it, and a
window inside each bucket looks one row ahead.

Nulls and edge cases: a null text is empty; an empty or blank text has the empty fingerprint; fewer than K
words are one window; rows without an id come after all others; rows that share an id follow one another by
a hash of their text; a single row is its own successor; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 3
PICKS = 2
LONG_WORD = 24
CLASS_BITS = 6
CLASSES = 1 << CLASS_BITS
#: Bits of a long that hold a window's place in the text; the others hold its hash.
PLACE = 28
_LOW = (1 << PLACE) - 1
#: Buckets of neighbours per shuffle partition, and the most that quantiles define directly.
SPREAD = 8
QUANTILES = 1024


def with_order_minhash(df: DataFrame, text_col: str, out: str, k: int = K) -> DataFrame:
    """df with column out: an ascending array of longs, each a filled class (upper half) and its tuple's hash (lower)."""
    rest = [F.col(c) for c in df.columns]
    word = ", ".join(f"get(_words, i + {j})" for j in range(k))
    own = f"shiftright(v, {64 - CLASS_BITS})"

    def step(frame: DataFrame, **columns: str) -> DataFrame:
        return frame.select(*rest, *[F.expr(e).alias(c) for c, e in columns.items()])

    frame = step(df, _words=f"filter(split({text_col}, '\\\\s+'), w -> w <> '')")
    frame = step(frame, _words=f"if(exists(_words, w -> length(w) > {LONG_WORD}), flatten(transform(_words, w -> if(length(w) > {LONG_WORD}, split(w, ''), array(w)))), _words)")
    frame = step(frame, _n=f"if(size(_words) = 0, 0, greatest(1, size(_words) - {k - 1}))", _words="_words")
    frame = step(frame, _sorted=f"sort_array(transform(if(_n = 0, array(), sequence(0, _n - 1)), i -> (xxhash64({word}) & ~{_LOW}L) | i))")
    frame = step(
        frame, _sorted="_sorted", _n="size(_sorted)",
        _runs=f"filter(if(size(_sorted) = 0, array(), sequence(0, size(_sorted) - 1)), i -> i = 0 or shiftright(get(_sorted, i), {PLACE}) <> shiftright(get(_sorted, i - 1), {PLACE}))",
    )
    frame = step(frame, _sorted="_sorted", _number="flatten(transform(_runs, (s, j) -> sequence(0, coalesce(get(_runs, j + 1), _n) - s - 1)))")
    frame = step(
        frame,
        _members=f"sort_array(zip_with(_sorted, _number, (x, o) -> (xxhash64(shiftright(coalesce(x, 0L), {PLACE}), coalesce(o, 0)) & ~{_LOW}L) | (coalesce(x, 0L) & {_LOW}L)))",
    )
    frame = step(frame, _picked=f"filter(_members, (v, i) -> i < {PICKS} or shiftright(get(_members, i - {PICKS}), {64 - CLASS_BITS}) <> {own})")
    firsts = f"filter(if(size(_picked) = 0, array(), sequence(0, size(_picked) - 1)), i -> i = 0 or shiftright(get(_picked, i), {64 - CLASS_BITS}) <> shiftright(get(_picked, i - 1), {64 - CLASS_BITS}))"
    frame = step(frame, _picked="_picked", _firsts=firsts)
    chosen = f"filter(slice(_picked, i + 1, {PICKS}), v -> {own} = shiftright(get(_picked, i), {64 - CLASS_BITS}))"
    ordered = f"array_sort({chosen}, (a, b) -> cast(sign((a & {_LOW}L) - (b & {_LOW}L)) as int))"
    mixed = f"aggregate({ordered}, 42L, (seed, v) -> xxhash64(seed, shiftright(v, {PLACE})))"
    tuples = f"transform(_firsts, i -> shiftleft(shiftright(get(_picked, i), {64 - CLASS_BITS}) + {CLASSES // 2}, 32) | ({mixed} & 4294967295L))"
    return step(frame, **{out: tuples})


def as_text(hashes: str) -> Column:
    """The fingerprint as text: for each filled class two hex digits and eight of its hash."""
    return F.lower(F.array_join(F.transform(hashes, lambda t: F.lpad(F.hex(t), 10, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """The share of equal hashes among the classes that a or b fills; 1 if neither fills any."""
    def filled(c: str) -> Column:
        return F.transform(c, lambda t: F.shiftright(t, 32))

    either = F.size(F.array_union(filled(a), filled(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _bucket(docs: DataFrame, id_col: str, wanted: int) -> tuple[Column, int]:
    """A column that numbers about `wanted` even ranges of ids, largest ids first; ids that are null come last."""
    cells = max(1, min(wanted, QUANTILES))
    shares = [i / cells for i in range(1, cells)] or [0.5]
    found = docs.agg(F.percentile_approx(id_col, shares, cells * 20).alias("q"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    if found.lo is None:
        return F.lit(0), 1
    cuts = sorted(set(found.q) - {found.lo}, reverse=True)
    fine = -(-wanted // (len(cuts) + 1))
    edges = F.array(*[F.lit(x).cast("long") for x in cuts]).cast("array<long>")
    cell = F.size(F.filter(edges, lambda q: q > F.col(id_col)))
    top = F.coalesce(F.get(edges, cell - 1) - 1, F.lit(found.hi))
    low = F.coalesce(F.get(edges, cell), F.lit(found.lo))
    inside = F.least(F.lit(fine - 1), ((top - F.col(id_col)) / ((top - low + 1) / fine)).cast("int")) if fine > 1 else F.lit(0)
    return F.when(F.col(id_col).isNull(), F.lit((len(cuts) + 1) * fine)).otherwise(cell * fine + inside), (len(cuts) + 1) * fine + 1


def with_next(docs: DataFrame, take: list[str], id_col: str, tie_col: str) -> DataFrame:
    """docs with next_<c> for every c in take: the values of the following row by descending id; the last row's is the first."""
    spark = docs.sparkSession
    bucket, _ = _bucket(docs, id_col, SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.withColumn("_bucket", bucket)
    order = F.struct(F.col(id_col).isNull(), -F.col(id_col), F.col(tie_col))
    heads = rows.groupBy("_bucket").agg(F.min(order).alias("_head"))
    # One row per bucket, whose number is a multiple of the shuffle partitions': one task orders them, and they are broadcast.
    everywhere = Window.orderBy("_bucket")
    ahead = F.lag("_bucket").over(everywhere)
    last = F.max("_bucket").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("_bucket", "_head", F.coalesce(ahead, last).alias("_receiver"))
    joined = rows.join(F.broadcast(heads), "_bucket")
    here = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest"))
    there = F.struct(F.col("_receiver").alias("b"), F.lit(True).alias("guest"))
    dealt = joined.withColumn("_at", F.explode(F.when(order == F.col("_head"), F.array(here, there)).otherwise(F.array(here))))
    dealt = dealt.select(*docs.columns, F.col("_at.b").alias("_b"), F.col("_at.guest").alias("_guest"))
    row = Window.partitionBy("_b").orderBy("_guest", F.col(id_col).desc_nulls_last(), tie_col)
    return dealt.select(*docs.columns, "_guest", *[F.lead(c).over(row).alias(f"next_{c}") for c in take]).filter("not _guest").drop("_guest")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last third is the start of the next document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_order_minhash(rows.withColumn("tie", F.xxhash64("text")), "text", "omh")
    near = with_next(rows, ["text", "omh"], "doc_id", "tie")
    sized = near.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))")
    texts = sized.select("doc_id", "n_chars", "omh", "next_omh", edited.alias("edited"))
    hashed = texts.select("doc_id", "n_chars", "omh", "next_omh", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    done = with_order_minhash(hashed, "edited", "edited_omh")
    return done.select(
        "doc_id", "n_chars", "edited_sha256", as_text("omh").alias("fingerprint"), as_text("edited_omh").alias("edited_fingerprint"),
        likeness("omh", "edited_omh").alias("near_edited"), likeness("omh", "next_omh").alias("near_next"),
    )


def op5_orderhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))
