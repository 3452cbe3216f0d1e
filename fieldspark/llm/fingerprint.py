"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 32-bit hashes of a text's five-word shingles. Sketches of parts
merge into the sketch of the whole, and estimate resemblance, containment and the number of distinct shingles.

Edge cases: a text of fewer than five words has its whole word sequence as one shingle; a null or empty text, or one of
white space only, has an empty sketch, which is like another empty one (1.0) and unlike any other (0.0); repeated rows
and equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

K, SHINGLE, RANGE = 128, 5, 2**32


def with_sketch(df: DataFrame, text: Column, out: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """`df` with the sketch of `text` (array of long) as column `out`; nothing is shuffled."""
    df = df.withColumn("__fs_h", F.transform(words(text), lambda w: F.xxhash64(w)))
    size = F.size("__fs_h")
    at = lambda i, d: F.get(F.col("__fs_h"), i + d)
    low = lambda h: h.bitwiseAND(F.lit(RANGE - 1))
    many = F.transform(F.sequence(F.lit(0), size - n), lambda i: low(F.xxhash64(*[at(i, d) for d in range(n)])))
    one = F.array(low(F.xxhash64(F.col("__fs_h"))))
    made = F.when(size >= n, many).when(size > 0, one).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, bottom(made, k)).drop("__fs_h")


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch per key. Hashes are made distinct and cut to k by partial aggregates, so a hot key is no burden."""
    each = df.select(key, F.explode(sketch).alias("h")).distinct()
    first = Window.partitionBy(key).orderBy("h")
    return each.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes that both sketches hold."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles; exact while the sketch isn't full."""
    full = (F.lit(float(k)) - 1) * F.lit(float(RANGE)) / F.greatest(F.array_max(a), F.lit(1))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too; 1.0 for an empty a."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_text(sketch: Column) -> Column:
    """Eight lower-case hex digits for each hash, in order."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.substring(F.hex(h + F.lit(RANGE)), 2, 8)), ""))


def next_in_order(df: DataFrame, key: str, carry: list[str], tie: str, parts: int | None = None) -> DataFrame:
    """`df` with next_<c> for each column of `carry`: that of the next row by descending key (nulls last; after the last row: the first).

    Rows are dealt into runs of the key by its quantiles, which are values of the key itself. The first rows of each run
    are also sent to the run before, and the first of all to the last run, so each run finds its successors alone.
    """
    parts = parts or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = F.coalesce(F.col(key), F.lit(-(2**63)))
    low = df.select(k.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000).alias("q"), F.max("k").alias("top")).first()
    cuts, top = sorted(set(low["q"] or [])), low["top"]
    cut = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    df = df.withColumn("__fs_k", k)
    run = F.size(F.filter(cut, lambda c: c >= F.col("__fs_k")))
    df = df.withColumn("__fs_run", run)
    guests = F.array(
        F.struct(F.col("__fs_run").alias("run"), F.lit(0).alias("guest")),
        F.when(F.array_contains(cut, F.col("__fs_k")), F.struct((F.col("__fs_run") - 1).alias("run"), F.lit(1).alias("guest"))),
        F.when(F.col("__fs_k") == F.lit(top), F.struct(F.lit(len(cuts)).alias("run"), F.lit(2).alias("guest"))),
    )
    df = df.withColumn("__fs_at", F.explode(F.filter(guests, lambda g: g.isNotNull()))).drop("__fs_run")
    order = Window.partitionBy("__fs_at.run").orderBy(F.col("__fs_at.guest"), F.col("__fs_k").desc(), F.col(tie))
    df = df.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry})
    return df.filter(F.col("__fs_at.guest") == 0).drop("__fs_at", "__fs_k")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the start of the next document."""
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = with_sketch(df, F.col("t"), "sketch", k).withColumn("tie", F.xxhash64("t"))
    df = next_in_order(df, "doc_id", ["t", "sketch"], "tie")
    n = F.length("t")
    m = F.floor(n / F.lit(3)).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), n - m), F.substring(F.col("next_t"), F.lit(1), m)))
    df = with_sketch(df, F.col("edited"), "edited_sketch", k)
    return df.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_distinct"), containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_contained"),
    )
