"""Benchmark decontamination, in DataFrame functions only.

Words are lower-cased runs of letters and digits. A benchmark item's windows are its runs of `size` words; an item of
fewer words is one window. The windows' 64-bit hashes are a broadcast hash set; every word window of every document is
looked up in it while the text is scanned, and hits are verified word for word against the benchmark's windows. Nothing
of a document but its narrow row and its hits is shuffled, and a window that many documents hold costs only its hits.

The set's size is counted: up to BROADCAST_KEYS hashes are broadcast (64 bits each); a larger set is joined by shuffle.
Lengths of windows are at most `size` different ones.

Edge cases: a null, empty or wordless text has no words and no hits; a null or wordless item has no windows; repeated items
of one id are one item; an item of null id marks words, but is neither listed nor counted; repeated documents are told
apart row by row, whatever their id; an empty table of documents gives an empty result, an empty benchmark no hits; other
columns are ignored by hits() and kept by decontaminate(), names that start with __fs_ excepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, let, materialise, with_small

#: Words in lower-cased text, and the same runs in text as it is.
LOWER_WORD, ANY_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Hashes that may be broadcast: about 64 MB as a set of longs.
BROADCAST_KEYS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case; other letters stay. Spark's lower() does the same where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def item_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(LOWER_WORD), F.lit(0)), F.array().cast("array<string>"))


def _gram(words: Column, at: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def _key(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def benchmark_grams(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(gram, n, key, item): the distinct windows of each item, as words joined by spaces, their numbers of words and hashes."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), item_words(F.col(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    rows = rows.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    key = F.coalesce(*[F.when(F.col("n") == k, _key(F.col("w"), F.col("at"), k)) for k in range(1, size + 1)])
    return rows.select(_gram(F.col("w"), F.col("at"), F.col("n")).alias("gram"), "n", key.alias("key"), "item").distinct()


def scan(docs: DataFrame, grams: DataFrame, text: str, keep: list[Column], size: int = WINDOW) -> DataFrame:
    """A row for each document (__fs_at = -1, with `keep` and n_words), and one for each window whose hash is in the set.

    Rows of one document have one __fs_row. To be written before it is used: rows are numbered as they are read.
    """
    keys = grams.select("n", "key").distinct()
    sizes = sorted(r["n"] for r in keys.select("n").distinct().collect())  # `size` numbers at most
    df = docs.select(*keep, F.monotonically_increasing_id().alias("__fs_row"), item_words(F.col(f"`{text}`")).alias("__fs_w"))
    kept = [c for c in df.columns if c not in ("__fs_row", "__fs_w")]
    df = df.select("*", F.explode(F.sequence(F.lit(-1), F.size("__fs_w") - 1)).alias("__fs_at"))
    at, words, total = F.col("__fs_at"), F.col("__fs_w"), F.size("__fs_w")
    windows = [F.struct(F.lit(n).alias("n"), F.when((at >= 0) & (at + n <= total), _key(words, at, n)).alias("key")) for n in sizes]
    if len(windows) > 1:
        df = df.select("*", F.inline(F.filter(F.array(*windows), lambda x: x["key"].isNotNull() | ((at < 0) & (x["n"] == sizes[0])))).alias("__fs_n", "__fs_key"))
    else:
        one = windows[0] if windows else F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("key"))
        df = df.select("*", one["n"].alias("__fs_n"), one["key"].alias("__fs_key"))
    found = keys.select(F.col("key").alias("__fs_key"), F.col("n").alias("__fs_m")).dropDuplicates(["__fs_key"])
    small = found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    df = df.join(F.broadcast(found) if small else found, "__fs_key", "left").filter((F.col("__fs_at") < 0) | F.col("__fs_m").isNotNull())
    of_doc = lambda c: F.when(at < 0, c)
    return df.select("__fs_row", at.alias("__fs_at"), "__fs_n", *[of_doc(F.col(f"`{c}`")).alias(c) for c in kept],
                     of_doc(total.cast("long")).alias("n_words"), F.when(at >= 0, _gram(words, at, F.col("__fs_n"))).alias("__fs_gram"))


def _covered(runs: Column) -> Column:
    """Places in the union of runs (at, n), sorted by at."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = F.greatest(s["end"], x["at"] + x["n"])
        return F.struct(end.alias("end"), (s["n"] + end - F.greatest(s["end"], x["at"])).alias("n"))

    return F.aggregate(runs, start, step)["n"]


def hits(scanned: DataFrame, grams: DataFrame) -> DataFrame:
    """(__fs_row, n_hit, runs, items) of each document of a scan (written) with verified hits; runs (at, n) in order, items sorted as strings."""
    rows = scanned.filter(F.col("__fs_at") >= 0).select("__fs_row", F.col("__fs_at").alias("at"), F.col("__fs_n").alias("n"), F.col("__fs_gram").alias("gram"))
    known = grams.groupBy("gram").agg(F.min(F.lit(True)).alias("known"))
    true = with_small(rows.alias("r"), known.alias("k"), F.col("r.gram") == F.col("k.gram"), "inner").select("__fs_row", "at", "n", "r.gram")
    runs = true.groupBy("__fs_row", "at").agg(F.max("n").alias("n")).groupBy("__fs_row").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))
    each = true.select("__fs_row", "gram").distinct()
    items = with_small(each.alias("r"), grams.select("gram", "item").alias("k"), F.col("r.gram") == F.col("k.gram"), "inner")
    items = items.groupBy("__fs_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return runs.join(items, "__fs_row").select("__fs_row", _covered(F.col("runs")).alias("n_hit"), "runs", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of every document."""
    grams = materialise(benchmark_grams(benchmark, size=size), "grams")
    scanned = materialise(scan(docs, grams, text, [F.col(f"`{key}`").alias("doc_id")], size), "scanned")
    found = materialise(hits(scanned, grams), "hits")
    rows = with_small(scanned.filter(F.col("__fs_at") < 0).alias("d"), found.alias("h"), F.col("d.__fs_row") == F.col("h.__fs_row"))
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"))


def without_runs(text: Column, runs: Column) -> Column:
    """The text without the words of `runs` and what stands between them; what stands before and after a run stays."""
    words = F.regexp_extract_all(text, F.lit(ANY_WORD), F.lit(0))
    gaps = F.split(text, ANY_WORD)

    def body(hit: Column) -> Column:
        def pieces(w: Column) -> Column:
            inside = lambda i: F.get(hit, i) & F.coalesce(F.get(hit, i - 1), F.lit(False))
            one = lambda i: F.concat(F.when(inside(i), F.lit("")).otherwise(F.get(gaps, i)), F.when(F.get(hit, i), F.lit("")).otherwise(F.get(w, i)))
            return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), one), ""), F.get(gaps, F.size(w)))

        return let(words, pieces)

    # Runs are sorted; the end of those up to a place decides whether it is inside one.
    marks = let(F.map_from_entries(runs), lambda m: F.aggregate(
        F.sequence(F.lit(0), F.size(words) - 1), F.struct(F.lit(0).alias("end"), F.array().cast("array<boolean>").alias("hit")),
        lambda s, i: let(F.greatest(s["end"], F.coalesce(i + m[i], F.lit(0))), lambda end: F.struct(end.alias("end"), F.array_append(s["hit"], i < end).alias("hit"))))["hit"])
    return F.when(F.size(words) > 0, let(marks, body)).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", size: int = WINDOW) -> DataFrame:
    """`docs` without the documents that have hits, or with the hit spans cut out of their texts (`remove="spans"`)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    names = [f"__fs_c{i}" for i in range(len(docs.columns))]
    grams = materialise(benchmark_grams(benchmark, size=size), "grams")
    scanned = materialise(scan(docs, grams, text, [c.alias(a) for c, a in zip(columns_of(docs), names)], size), "scanned")
    found = materialise(hits(scanned, grams), "hits")
    rows = scanned.filter(F.col("__fs_at") < 0)
    if remove == "documents":
        rows = with_small(rows.alias("d"), found.select("__fs_row").alias("h"), F.col("d.__fs_row") == F.col("h.__fs_row"), "left_anti")
        return rows.select(*[F.col(a).alias(c) for a, c in zip(names, docs.columns)])
    rows = with_small(rows.alias("d"), found.alias("h"), F.col("d.__fs_row") == F.col("h.__fs_row"))
    cut = {c: F.when(F.col("runs").isNull(), F.col(a)).otherwise(without_runs(F.col(a), F.col("runs"))) if c == text else F.col(a) for a, c in zip(names, docs.columns)}
    return rows.select(*[x.alias(c) for c, x in cut.items()])
