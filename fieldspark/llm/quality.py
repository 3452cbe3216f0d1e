"""Host-level quality rules, in DataFrame functions only.

Each document is measured once. Failures of the rules are summed for each host (partial sums before the shuffle, so a
host with a third of all rows is no burden), each host's failure rate is shrunk towards a beta prior that is fitted to
all hosts by the method of moments, and the verdicts on hosts are joined back to the documents.

Edge cases: a null or empty text has no words and fails the base rule; a null host is a host of its own; repeated rows
are judged alike, row by row; an empty table gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, let, materialise, with_small, words

#: Rules that mark a single document, beside the base rule.
RULES = ("symbols", "lines", "length", "capitals")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def _covered(windows: Column, width: int) -> Column:
    """Positions covered by windows (given by their hashes, in order) whose hash occurs at least twice."""

    def starts(p: Column) -> Column:
        near = lambda e, k, d: F.coalesce(F.get(p, k + d)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, lambda e, k: near(e, k, -1) | near(e, k, 1)), lambda e: e["i"]))

    def cover(s: Column) -> Column:
        steps = F.transform(s, lambda e, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - e, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(pairs, starts), cover))


def document_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns of FEATURES (long) added, in place of any of these names; nothing is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in FEATURES]
    df = docs.select(*keep, t.alias("__fs_t"), words(t).alias("__fs_w"))
    df = df.select(*keep, "__fs_t", "__fs_w", F.transform("__fs_w", lambda w: F.xxhash64(w)).alias("__fs_h"),
                   F.filter(F.split("__fs_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__fs_l"))
    n = F.size("__fs_h")
    at = lambda i, d: F.get(F.col("__fs_h"), i + d)
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, d) for d in range(WINDOW)]))
    df = df.withColumn("__fs_r", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    letters = lambda unwanted: F.length(F.regexp_replace("__fs_t", unwanted, ""))
    made = {
        "n_words": n,
        "word_chars": F.length(F.array_join("__fs_w", "")),
        "n_symbols": letters(r"[^#*$%&|<>]+"),
        "n_lines": F.size("__fs_l"),
        "n_dup_lines": F.size("__fs_l") - F.size(F.array_distinct("__fs_l")),
        "n_repeat_words": _covered(F.col("__fs_r"), WINDOW),
        "n_capitals": letters(r"\P{Lu}+"),
    }
    return df.select(*keep, *[made[k].cast("long").alias(k) for k in FEATURES])


def rule_failures(max_symbols: float = 0.1, max_dup_lines: float = 0.3, mean_length: tuple = (2.0, 15.0), max_capitals: float = 0.4) -> dict[str, Column]:
    """The base rule and the rules of RULES as boolean columns over FEATURES; ratios of an empty text don't fail."""
    c = F.col
    base = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    return {
        "base": base,
        "symbols": c("n_symbols") > max_symbols * c("n_words"),
        "lines": c("n_dup_lines") > max_dup_lines * c("n_lines"),
        "length": (c("word_chars") < mean_length[0] * c("n_words")) | (c("word_chars") > mean_length[1] * c("n_words")),
        "capitals": c("n_capitals") > max_capitals * c("word_chars"),
    }


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = 0.5, **thresholds) -> DataFrame:
    """One row per host: documents, failures by rule, shrunk rate by rule, and whether any shrunk rate is over `limit`.

    The prior of a rule is the beta distribution with the mean and the (weighted) variance of the hosts' rates; its
    strength is kept within 1 and 1,000,000 documents. Only these fixed few sums reach the driver.
    """
    fails = rule_failures(**thresholds)
    counts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(v.cast("long")).alias(f"fails_{k}") for k, v in fails.items()])
    counts = materialise(counts, "hosts")
    total = counts.agg(F.sum("host_docs").alias("n"), *[F.sum(f"fails_{k}").alias(k) for k in fails]).first()
    n = total["n"] or 0
    means = {k: (total[k] / n if n else 0.0) for k in fails}
    spread = counts.agg(*[F.sum(F.col("host_docs") * F.pow(F.col(f"fails_{k}") / F.col("host_docs") - F.lit(m), 2)).alias(k) for k, m in means.items()]).first()
    rates = []
    for k, m in means.items():
        v = (spread[k] or 0.0) / n if n else 0.0
        strength = min(max(m * (1 - m) / v - 1 if v > 0 else 1e6, 1.0), 1e6)
        rates.append(((F.col(f"fails_{k}") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))).alias(f"rate_{k}"))
    hosts = counts.select("*", *rates)
    return hosts.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{k}") for k in fails]) > F.lit(limit))


def judge(measured: DataFrame, host: str = "source", limit: float = 0.5, hosts: DataFrame | None = None, **thresholds) -> DataFrame:
    """`measured` (from document_features) with base_failed, failed (names of failed rules), host_rate_<rule>, host_rejected and kept.

    A document is kept if it passes the base rule and every rule of RULES, and its host isn't rejected.
    """
    fails = rule_failures(**thresholds)
    hosts = host_verdicts(measured, host, limit, **thresholds) if hosts is None else hosts
    side = hosts.select(F.col("host").alias("__fs_host"), F.col("host_rejected"), *[F.col(f"rate_{k}").alias(f"host_rate_{k}") for k in fails])
    failed = F.filter(F.array(*[F.when(fails[k], F.lit(k)) for k in RULES]), lambda x: x.isNotNull())
    df = measured.withColumns({"base_failed": fails["base"], "failed": failed})
    df = with_small(df, side, df[host].eqNullSafe(side["__fs_host"])).drop("__fs_host")
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0) & ~F.coalesce("host_rejected", F.lit(False)))


def reject_documents(docs: DataFrame, text: str = "text", host: str = "source", **options) -> DataFrame:
    """The rows of `docs` that judge() keeps, columns unchanged. Hosts are judged from narrow rows; texts are never shuffled."""
    rows = docs.select(F.struct(*columns_of(docs)).alias("__fs_row"), F.col(host).alias("__fs_host_of"), F.col(text).alias("__fs_text"))
    narrow = materialise(document_features(rows.drop("__fs_row"), "__fs_text").drop("__fs_text"), "features")
    hosts = host_verdicts(narrow, "__fs_host_of", **options)
    # The row number keeps the filter above the measuring: pushed below, it would measure again for every word.
    measured = document_features(rows, "__fs_text").withColumn("__fs_row_number", F.monotonically_increasing_id())
    return judge(measured, "__fs_host_of", hosts=hosts, **options).filter(F.col("kept") & (F.col("__fs_row_number") >= 0)).select("__fs_row.*")
