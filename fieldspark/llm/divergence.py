"""Divergence of sources within a language, from count-level bitmaps.

A group is a (lang, source). Its bitmap of a count has one bit for each kept term that occurs so often in the group; the
bitmaps are stored as a table, by language and part of the terms. For two groups, AND and popcount of their bitmaps give
the number of terms in each joint cell (count here, count there), which is multiplied by the cell's divergence; cells with
a zero on either side follow by complement, from the bitmaps' own sizes. All arithmetic is in integers.

Terms are counted in each task before they are shuffled, with at most MOST_TERMS entries at hand, so a hot source or term
arrives as one row a task. Parts hold PART_TERMS terms, fewer where a language has many sources, so that a part fits a
task. Terms of a part are ordered by frequency, so the 64 terms of a word of bits have few different counts.

Edge cases: null text, lang or source are ''; a text without terms, or an empty one, counts for its group only; repeated
rows are documents of their own; a very long text is counted piece by piece; a language without kept terms gives 0 for
each pair of its sources; a source alone in its language has no pairs; ties are ranked by item; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, with_small

#: Lower-case letters and bytes of non-ASCII characters stay, A-Z become lower case, anything else ends a term.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: (group, term) counts that a task holds before it sends them; bytes of a text that are split at a time.
MOST_TERMS, PIECE = 1 << 19, 1 << 22
#: Terms of a part, and cells (terms x sources) of a part at most.
PART_TERMS, PART_CELLS = 1 << 11, 1 << 22
#: Pairs of words of bits, or of sources, that are compared at a time.
AT_ONCE = 1 << 21
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, piece by piece."""
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].translate(TERM_BYTES)
        end = len(piece) if at + PIECE >= len(text) else piece.rfind(b" ") + 1
        rest = piece[end:]
        yield piece[:end].split()


def count_terms(docs: DataFrame) -> DataFrame:
    """Occurrences `n` of each term in each group, and the number `docs` of the group's documents with it; docs: (lang, source, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen, held = defaultdict(Counter), defaultdict(Counter), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in n.items():
                d = seen[lang, source]
                size = len(c)
                columns = ([lang] * size, [source] * size, pa.array(list(c), pa.binary()).cast(pa.string()), list(c.values()), [d[t] for t in c])
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, COUNTS)], schema=COUNTS)

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                own, mine, distinct = n[lang, source], seen[lang, source], set()
                held -= len(own)
                for terms in terms_of(text.as_py()):
                    own.update(terms)
                    distinct.update(terms)
                mine.update(distinct)
                held += len(own)
                if held >= MOST_TERMS:
                    yield from rows()
                    n, seen, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows()

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    # One shuffle by the coarser key serves these sums and the windows over (lang, term) that follow.
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_cells(counts: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of terms in at least so many documents of the language; `first` marks one row a term."""
    of_term = Window.partitionBy("lang", "term")
    cells = counts.withColumns({"in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": F.col("source") == F.min("source").over(of_term)})
    return cells.filter(F.col("in_docs") >= least_docs).drop("in_docs", "docs")


def group_totals(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v, sources) for every group that occurs; a table of one row a group."""
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("first"), 1)).alias("v"))
    groups = docs.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("none"))
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.join(docs.select("lang", "source").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang")
    zero = {c: F.coalesce(c, "none") for c in ("total", "lang_total", "v")}
    return groups.withColumns(zero).drop("none")


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(1,000,000,000 (count + 2) / (total + 2 v)) as a long; null where v is 0 and nothing was counted."""
    exact = lambda c: c.cast("decimal(20,0)")
    ratio = F.call_function("div", F.lit(10**9).cast("decimal(12,0)") * exact(count + 2), F.nullif(exact(total + 2 * v), F.lit(0).cast("decimal(20,0)")))
    return ratio + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def count_levels(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The bitmaps: (lang, part, source, n, first, bits, terms).

    Bit k of `bits`, counted from word `first` (64 bits, little-endian), is the part's term 64 * first + k; terms are
    numbered by falling frequency in the language. `terms` is the number of the part's terms.
    """
    size = F.greatest(F.lit(64), F.least(F.lit(PART_TERMS), F.floor(F.lit(PART_CELLS) / F.col("sources"))))
    langs = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.max(F.col("v") / size))).cast("int").alias("parts"))
    dealt = with_small(cells.alias("c"), langs.alias("l"), F.col("c.lang") == F.col("l.lang"), "inner")
    dealt = dealt.select("c.lang", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part"), "source", "term", "n", "lang_n")

    def build(t: pa.Table) -> pa.Table:
        terms, source = t["term"].combine_chunks().dictionary_encode(), t["source"].combine_chunks().dictionary_encode()
        names, code, n = terms.dictionary, terms.indices.to_numpy(), t["n"].to_numpy()
        total = np.zeros(len(names), np.int64)
        total[code] = t["lang_n"].to_numpy()
        number = np.empty(len(names), np.int64)
        number[np.lexsort((np.array(names.to_pylist()), -total))] = np.arange(len(names))
        group, at = source.indices.to_numpy(), number[code]
        order = np.lexsort((at, n, group))
        group, n, at = group[order], n[order], at[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(n) != 0)])
        firsts, bits = [], []
        for own in np.split(at, starts[1:]):
            low = int(own[0]) // 64
            words = np.zeros(int(own[-1]) // 64 - low + 1, "<u8")
            np.bitwise_or.at(words, own // 64 - low, np.uint64(1) << (own % 64).astype(np.uint64))
            firsts.append(low)
            bits.append(words.tobytes())
        same = lambda c: [t[c][0].as_py()] * len(starts)
        return pa.table({"lang": same("lang"), "part": pa.array(same("part"), pa.int32()), "source": source.dictionary.take(pa.array(group[starts])), "n": n[starts],
                         "first": pa.array(firsts, pa.int32()), "bits": pa.array(bits, pa.binary()), "terms": pa.array([len(names)] * len(starts), pa.int64())})

    return dealt.groupBy("lang", "part").applyInArrow(build, "lang string, part int, source string, n long, first int, bits binary, terms long")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def part_divergences(source: np.ndarray, p: np.ndarray, zero: np.ndarray, rows: list[tuple[int, bytes]], terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For one part: (a, b, sum of divergences over its terms) of all pairs a < b of sources, in runs of a.

    Bitmap i belongs to source[i] (ascending), has the share p[i] and the (first word, bits) rows[i]; zero[s] is the share
    of terms that source s lacks.
    """
    words = [np.frombuffer(bits, "<u8") for _, bits in rows]
    level = np.repeat(np.arange(len(rows)), [len(w) for w in words])
    place = np.concatenate([np.zeros(0, np.int64), *[first + np.arange(len(w)) for (first, _), w in zip(rows, words)]])
    bits = np.concatenate([np.zeros(0, "<u8"), *words])
    full = np.flatnonzero(bits)
    full = full[np.lexsort((level[full], place[full]))]
    level, place, bits = level[full], place[full], bits[full]
    cuts = np.flatnonzero(np.diff(place)) + 1 if len(place) else np.zeros(0, np.int64)
    size = np.bincount(level, np.bitwise_count(bits), len(rows)).astype(np.int64)  # terms of each bitmap
    n = len(zero)
    step = max(1, AT_ONCE // max(1, n))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        base = _gap(zero[lo:hi, None], zero[None, :])
        out = terms * base
        # One side has the term, the other is taken to lack it.
        for own in np.array_split(np.arange(len(rows)), max(1, len(rows) * max(hi - lo, 1) // AT_ONCE)):
            np.add.at(out.T, source[own], size[own, None] * (_gap(p[own, None], zero[None, lo:hi]) - base.T[source[own]]))
        mine = np.flatnonzero((source >= lo) & (source < hi))
        for own in np.array_split(mine, max(1, len(mine) * n // AT_ONCE)):
            np.add.at(out, source[own] - lo, size[own, None] * (_gap(p[own, None], zero[None, :]) - base[source[own] - lo]))
        # Joint cells: both sides have the term.
        for word, of in zip(np.split(bits, cuts), np.split(level, cuts)):
            left = np.flatnonzero((source[of] >= lo) & (source[of] < hi))
            for own in np.array_split(left, max(1, len(left) * len(of) // AT_ONCE)):
                i, j = np.nonzero((word[own, None] & word[None, :]) * (source[of[own], None] < source[of][None, :]))
                a, b = of[own[i]], of[j]
                sa, sb = source[a], source[b]
                f = _gap(p[a], p[b]) - _gap(p[a], zero[sb]) - _gap(zero[sa], p[b]) + _gap(zero[sa], zero[sb])
                np.add.at(out, (sa - lo, sb), np.bitwise_count(word[own[i]] & word[j]).astype(np.int64) * f)
        a, b = np.nonzero(np.arange(lo, hi)[:, None] < np.arange(n)[None, :])
        yield a + lo, b, out[a, b]


def pair_divergences(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each two sources of a language in both directions, the divergence summed over all kept terms."""
    parts = levels.groupBy("lang", "part").agg(F.first("terms").alias("terms"))
    # Each group is told in each part what share a term has that it lacks.
    absent = parts.join(groups, "lang").select("lang", "part", "source", F.lit(0).cast("long").alias("n"), F.lit(0).alias("first"), F.lit(None).cast("binary").alias("bits"), "terms", "total", "v")
    known = with_small(levels.alias("b"), groups.alias("g"), (F.col("b.lang") == F.col("g.lang")) & (F.col("b.source") == F.col("g.source")), "inner")
    rows = known.select("b.lang", "part", "b.source", "n", "first", "bits", "terms", "total", "v").unionByName(absent)
    rows = rows.select("lang", "part", "source", "n", "first", "bits", "terms", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = pa.Table.from_batches(list(batches)).to_pandas(types_mapper={pa.string(): pd.ArrowDtype(pa.string())}.get)
        names, code = np.unique(df["source"].to_numpy(object), return_inverse=True)
        df = df.assign(code=code).sort_values(["code", "n"])
        none, some = df[df["bits"].isna()], df[df["bits"].notna()]
        lang, names = df["lang"].iloc[0], pa.array(names, pa.string())
        for a, b, value in part_divergences(some["code"].to_numpy(np.int64), some["p"].to_numpy(np.int64), none["p"].to_numpy(np.int64), list(zip(some["first"], some["bits"])), int(df["terms"].iloc[0])):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value)], ["lang", "source", "item", "value"])

    found = rows.groupBy("lang", "part").applyInArrow(compare, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("lang", "source", "item", "value"), F.struct("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")))
    bare = groups.filter(F.col("v") == 0).select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter(F.col("source") != F.col("item"))
    return found.select(both).unionByName(bare.withColumn("value", F.lit(0).cast("long")))


def term_divergences(cells: DataFrame, groups: DataFrame, top: int = 10) -> DataFrame:
    """(lang, source, item, value, rank): the terms by which a group stands out most from its language."""
    rows = with_small(cells.alias("c"), groups.alias("g"), (F.col("c.lang") == F.col("g.lang")) & (F.col("c.source") == F.col("g.source")), "inner")
    rows = rows.select("c.lang", "c.source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    rows = rows.filter(F.col("p") > F.col("q")).select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(rows).filter(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    """`rows` with their rank in (lang, source); under a limit Spark cuts each task's rows before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit_sources(docs: DataFrame, least_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the language, part `term` the group's `top` terms."""
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang), ("source", source), ("text", text))])
    cells = materialise(kept_cells(count_terms(docs), least_docs), "cells")
    groups = materialise(group_totals(docs.drop("text"), cells), "groups")
    levels = materialise(count_levels(cells, groups), "levels")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(ranked(pair_divergences(levels, groups)), "pair").unionByName(columns(term_divergences(cells, groups, top), "term"))
