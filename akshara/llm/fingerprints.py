"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A fingerprint is the sorted array of the k smallest distinct 48-bit hashes of a
text's word shingles. The bottom k of a union follows from the two sketches, so
sketches merge, and of its members those in both give the resemblance. A text
with fewer words than a shingle has one shingle, all its words; a null, empty or
blank text has an empty fingerprint, which is like another empty one (1) and
unlike any other (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from akshara.llm._frames import NO_ID, field, let, partitions

K, SHINGLE = 256, 5
BITS = 48
BLANK = " \t\n\x0b\x0c\r"
#: Buckets of neighbouring documents for each shuffle partition.
PER_PARTITION = 4


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


def shingle_hashes(w: Column, shingle: int = SHINGLE) -> Column:
    """Hash of each shingle of an array of words, with repeats."""
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(shingle - 1), F.lit(1)))
    hashes = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, F.lit(shingle))), 64 - BITS))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(hashes)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    return let(words(text), lambda w: bottom(shingle_hashes(w, shingle), k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact where neither has more than k shingles in all."""
    both = merge(a, b, k)
    shared = lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return let(both, shared)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.array_max(a))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    n = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), n / distinct_shingles(a, k)))


def merged_fingerprints(df: DataFrame, keys: list[str], sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """The fingerprint of each group of fingerprints: keys and sketch. Salted, so that no task gets more than k hashes of a key and salt at a time."""
    rows = df.select(*[field(c) for c in keys], F.explode(field(sketch_col)).alias("__hash"))
    rows = rows.distinct().withColumn("__salt", F.pmod("__hash", F.lit(salts)))
    at = Window.partitionBy(*[field(c) for c in keys], "__salt").orderBy("__hash")
    rows = rows.withColumn("__rank", F.row_number().over(at)).where(F.col("__rank") <= k)
    return rows.groupBy(*[field(c) for c in keys]).agg(F.slice(F.sort_array(F.collect_list("__hash")), 1, k).alias("sketch"))


def bucket_bounds(ids: DataFrame, n: int) -> list[int]:
    """First ids of about n buckets of neighbouring ids, all of them ids that occur."""
    shares = [i / n for i in range(n)]
    cuts = ids.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 20 * n))).alias("q")).first().q
    cuts = sorted(set(cuts or []))
    if not cuts:
        return []
    first = ids.groupBy(bucket_of(F.col("id"), cuts).alias("b")).agg(F.min("id").alias("id"))
    return sorted(r.id for r in first.collect())


def bucket_of(x: Column, bounds: list[int]) -> Column:
    """How many bounds are x or less, by binary search."""
    table = F.lit(bounds).cast("array<bigint>")
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda p, s: F.when(F.get(table, p + s - F.lit(1)) <= x, p + s).otherwise(p))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", derived=None) -> DataFrame:
    """id, text and next_text: the text of the next document by ascending id (of the last: the first), ties by text, a null id first.

    Documents are dealt to buckets of neighbouring ids, by one shuffle; the
    first document of each bucket also ends the one before it, so no task sees
    all rows. derived: a function of the text that gives a column computed once
    a row, returned as derived and next_derived.
    """
    spark = docs.sparkSession
    raw = field(id_col).cast("long")
    ids = docs.select(F.coalesce(raw, F.lit(NO_ID)).alias("id"))
    bounds = bucket_bounds(ids, PER_PARTITION * partitions(spark))
    rows = docs.select(F.coalesce(raw, F.lit(NO_ID)).alias("id"), raw.alias("own_id"), F.coalesce(field(text_col), F.lit("")).alias("text"))
    m = max(1, len(bounds))
    rows = rows.withColumn("bucket", bucket_of(F.col("id"), bounds or [NO_ID]) - 1)
    opens = F.get(F.lit(bounds or [NO_ID]).cast("array<bigint>"), F.col("bucket")) == F.col("id")
    here, before = F.struct(F.col("bucket"), F.lit(False).alias("echo")), F.struct(F.pmod(F.col("bucket") - 1, F.lit(m)).alias("bucket"), F.lit(True).alias("echo"))
    rows = rows.select("id", "own_id", "text", F.explode(F.when(opens, F.array(here, before)).otherwise(F.array(here))).alias("place"))
    rows = rows.select("id", "own_id", "text", "place.bucket", "place.echo").repartition(partitions(spark), "bucket")
    if derived is not None:
        rows = rows.withColumn("derived", derived(F.col("text")))
    at = Window.partitionBy("bucket").orderBy("echo", "id", "text")
    extra = [F.lead("derived").over(at).alias("next_derived")] if derived is not None else []
    out = rows.select("*", F.lead("text").over(at).alias("next_text"), *extra).where(~F.col("echo"))
    return out.select(F.col("own_id").alias("id"), "text", "next_text", *(["derived", "next_derived"] if extra else []))


def edited(text: Column, next_text: Column) -> Column:
    """text with its last half of code points (rounded down) replaced by the first as many of next_text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(next_text, half))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_chars, sketch, edited_text, edited_sketch, near_edited, near_next and n_shingles (estimated).

    Null texts count as empty; rows of equal id are documents of their own,
    ordered by text. Other columns are not kept.
    """
    rows = with_next(docs, id_col, text_col, lambda t: fingerprint(t, k, shingle))
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", fingerprint(F.col("edited_text"), k, shingle))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.col("derived").alias("sketch"),
        "edited_text",
        "edited_sketch",
        resemblance(F.col("derived"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("derived"), F.col("next_derived"), k).alias("near_next"),
        distinct_shingles(F.col("derived"), k).alias("n_shingles"),
    )


def as_text(sketch: Column) -> Column:
    """A fingerprint as a string: its hashes in decimal, joined by spaces."""
    return F.array_join(sketch.cast("array<string>"), " ")


SKETCH = T.ArrayType(T.LongType())
