"""Exact Jaccard self-join of documents' word n-grams with a token-group matrix, and the components of its links.

A document's set holds its distinct five-word shingles (64-bit hashes). Equal sets are one class. Two sets of similarity
t or more share a token among the first n - ceil(t * n) + 1 of each (in any one order of all tokens), so only those tokens
are indexed. Every token of the corpus is counted, and the order puts rare tokens first: a passage that many documents
repeat indexes nothing unless a document has little else.

1. Groups: each class is compared with one leader, of the tokens that it indexes, and those that link form groups.
2. Matrix: for every group, the union of its members' indexed tokens. A query is counted against every other group that
   shares a token; a group is opened only if the count allows a member to be similar enough. A pair's own count is bounded
   the same way, and the pairs that are left are compared exactly.

Work follows the tokens that different groups share, not the pairs within a group: copies meet their leader only.

Edge cases: a null text, or one without words, has an empty set and is linked with nothing; with fewer than five words the
whole word sequence is the one shingle; repeated rows and equal texts are one class; a null doc_id takes part with its
text but is never a component's id unless all ids in it are null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import columns_of, materialise, small_batches, with_small

SHINGLE, PERCENT = 5, 80
#: A token may be frequent from this count on. Tokens in the table of levels, and frequent tokens that it is made of, at most.
LEAST_COUNT, LEVELS, MOST_FREQUENT = 4, 1 << 23, 1 << 20
#: An indexed token is rare if at most so many sets index it. Bits of the table of texts that occur in pairs.
RARE, TABLE_BITS = 16, 1 << 24
#: Bytes of text that are turned into sets at a time.
AT_ONCE = 1 << 20

_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]).cumprod(dtype=np.uint64)


class Shingler:
    """Shingle sets of texts: sorted distinct 64-bit hashes. Words are hashed by differences of a running polynomial."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if len(self.up) < len(b) + 1:
            self.up, self.down = _powers(_ODD, len(b) + 1), _powers(_INVERSE, len(b) + 1)
        run = np.concatenate([[np.uint64(0)], np.cumsum(_mix(b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], dtype=np.uint64)])
        edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        word = _mix((run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64))
        doc_end = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(start, doc_end)
        odd = [np.uint64(pow(_ODD, k, 1 << 64)) for k in range(2, 2 + SHINGLE)]
        n = max(0, len(word) - SHINGLE + 1)
        whole = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            whole += word[k : k + n] * odd[k]
        whole = _mix(whole)
        first = 0
        for last in upto:
            if last - first >= SHINGLE:
                yield np.unique(whole[first : last - SHINGLE + 1])
            elif last > first:
                h = np.uint64(last - first)
                for k in range(last - first):
                    h = h + word[first + k] * odd[k]
                yield _mix(np.array([h]))
            else:
                yield np.zeros(0, np.uint64)
            first = last

    def __call__(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        waiting: list[bytes] = []
        size = 0
        with np.errstate(over="ignore"):
            for t in texts:
                waiting.append((t or b"").lower())  # of bytes: A-Z only
                size += len(waiting[-1])
                if size >= AT_ONCE:
                    yield from self._sets(waiting)
                    waiting, size = [], 0
            if waiting:
                yield from self._sets(waiting)


def set_id(tokens: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def index_size(n: int) -> int:
    """How many of a set's first tokens must be indexed: n - ceil(0.8 n) + 1."""
    return n - -(-PERCENT * n // 100) + 1


def _least(a: Column, b: Column) -> Column:
    """The smallest overlap of sets of these sizes that links them: 100 * i >= 80 * (a + b - i)."""
    return F.ceil(F.lit(PERCENT) * (a + b) / F.lit(100 + PERCENT))


def _room(n: Column) -> Column:
    """Tokens of a set that aren't indexed."""
    return F.ceil(F.lit(PERCENT) * n / F.lit(100)) - 1


def _sizes(nq: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The part of the range low to high of the sizes that a set of size nq can be linked with."""
    return F.greatest(low, F.ceil(PERCENT * nq / 100)), F.least(high, F.floor(100 * nq / PERCENT))


def _opens(c: Column, nq: Column, low: Column, high: Column) -> Column:
    """Whether a group of sizes low to high that has c of a set's indexed tokens may hold a member that is similar enough.

    Without the ceilings the bound is highest at an end of the range; they move it by less than one token to either side.
    """
    small, large = _sizes(nq, low, high)
    able = lambda n: c + 1 + F.greatest(_room(nq), _room(n)) >= _least(nq, n)
    return (small <= large) & (able(small) | able(large))


def _pack(tokens: np.ndarray) -> bytes:
    """Ascending 32-bit integers, repeats among them, as compressed differences."""
    return zlib.compress(np.diff(tokens, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


OUTLINE = "doc_id long, h long, crc long, sid long, n long, part int, blob binary"


def _outlines(parts: int):
    """A function for mapInArrow: (doc_id, h, text) to (doc_id, h, crc, sid, n), and rows of the task's tokens by part.

    Tokens are counted by the upper 32 bits of their hashes; a set counts once a batch.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("crc", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])

    def table(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def counted(tokens: list[np.ndarray]) -> pa.RecordBatch:
        t = np.sort(np.concatenate(tokens))
        ends = np.searchsorted(t, np.array([-(-i * 2**32 // parts) for i in range(1, parts)], np.uint64))
        cut = [(i, x) for i, x in enumerate(np.split(t, ends)) if len(x)]
        return table(part=[i for i, _ in cut], blob=[_pack(x) for _, x in cut])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        sets, waiting, held = Shingler(), [], 0
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            sids, sizes, seen = [], [], set()
            for s in sets(texts):
                sids.append(set_id(s))
                sizes.append(len(s))
                if len(s) and sids[-1] not in seen:
                    seen.add(sids[-1])
                    waiting.append((s >> np.uint64(32)).astype(np.uint32))
                    held += len(s)
                    if held >= 1 << 23:
                        yield counted(waiting)
                        waiting, held = [], 0
            yield table(doc_id=b.column("doc_id"), h=b.column("h"), crc=[zlib.crc32(t or b"") for t in texts], sid=sids, n=sizes)
        if waiting:
            yield counted(waiting)

    return run


def _frequent(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part of all tokens: those that occur LEAST_COUNT times or more, packed by the logarithm of their count."""
    t = np.sort(np.concatenate([_unpack(x) for x in pdf["blob"]]))
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    count = np.diff(np.append(first, len(t)))
    token, log = t[first], np.log2(count).astype(int)
    rows = [(k, len(own), own.astype("<u4").tobytes()) for k in range(int(np.log2(LEAST_COUNT)), 64) if len(own := token[log == k])]
    return pd.DataFrame(rows, columns=["log", "n", "tokens"])


def token_levels(outlines: DataFrame) -> np.ndarray:
    """Levels of frequency by the lower bits of a token's upper 32: 0 for rare tokens, one more for each fourfold count.

    The table is of fixed size. The count from which a token isn't rare is the smallest power of two that leaves at most
    MOST_FREQUENT tokens, so no more than these reach the driver. Levels decide an order only, so collisions do no harm.
    """
    spark = outlines.sparkSession
    blobs = outlines.filter(F.col("blob").isNotNull()).select("part", "blob")
    found = materialise(blobs.groupBy("part").applyInPandas(_frequent, "log int, n long, tokens binary"), "frequent")
    sizes = {r["log"]: r["n"] for r in found.groupBy("log").agg(F.sum("n").alias("n")).collect()}
    least = min((k for k in sizes if sum(n for j, n in sizes.items() if j >= k) <= MOST_FREQUENT), default=64)
    table = np.zeros(LEVELS, np.uint8)
    for r in found.filter(F.col("log") >= least).select("log", "tokens").toLocalIterator():
        at = np.frombuffer(bytes(r["tokens"]), "<u4") % LEVELS
        table[at] = np.maximum(table[at], 1 + (r["log"] - least) // 2)
    return table


def _indexed(table: np.ndarray):
    """A function for mapInPandas: (text) to (sid, n, tokens): each set's indexed tokens, rare ones first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Shingler()
        for pdf in batches:
            rows, seen = [], set()
            for s in sets([None if t is None else t.encode("utf-8") for t in pdf["text"]]):
                sid = set_id(s)
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                level = table[(s >> np.uint64(32)) % np.uint64(LEVELS)]
                first = s[np.argsort(level, kind="stable")[: index_size(len(s))]]
                rows.append((sid, len(s), first.astype(np.int64)))
            yield pd.DataFrame(rows, columns=["sid", "n", "tokens"])

    return run


def bit_table(values: DataFrame, column: str, bits: int = TABLE_BITS) -> np.ndarray:
    """A table of `bits` bits, of which those at the column's values (0 to bits - 1) are set. Its size doesn't depend on the data's."""
    v = F.col(column)
    rows = values.groupBy(F.bitmap_bucket_number(v).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("b")).collect()
    table = np.zeros(bits // 8 + 4096, np.uint8)
    for r in rows:
        # Bucket k holds values (k - 1) * 32768 + 1 ... for positive ones, 0 and below in bucket 0 and less.
        table[r["k"] * 4096 : (r["k"] + 1) * 4096] |= np.frombuffer(bytes(r["b"]), np.uint8)
    return table


def _in_table(table: np.ndarray, value: int) -> bool:
    """Whether a value (0 to bits - 1) was set by bit_table(), to which it was given plus 1."""
    return bool(table[((value >> 15) + 1) * 4096 + ((value & 32767) >> 3)] >> (value & 7) & 1)


def _whole(table: np.ndarray):
    """A function for mapInPandas: (text) to (sid, tokens) of the texts whose crc is in the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Shingler()
        for pdf in batches:
            own = [t for t in (b"" if t is None else t.encode("utf-8") for t in pdf["text"]) if _in_table(table, zlib.crc32(t) % TABLE_BITS)]
            rows, seen = [], set()
            for s in sets(own):
                sid = set_id(s)
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    rows.append((sid, s.astype("<u8").tobytes()))
            yield pd.DataFrame(rows, columns=["sid", "tokens"])

    return run


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs (a, b) whose sets ta and tb are similar enough."""
    for pdf in batches:
        keep = []
        for x, y in zip(pdf["ta"], pdf["tb"]):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pdf.loc[np.array(keep, bool), ["a", "b"]]


def _verify(docs: DataFrame, outlines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones of `pairs` (a, b: set ids). Only sets that occur in a pair are built again and shuffled."""
    ids = materialise(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), "pair-sets")
    texts = outlines.join(ids, "sid", "left_semi").select((F.col("crc") % TABLE_BITS + 1).alias("x"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(texts, "x"))  # of fixed size

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _whole(shared.value)(batches)

    sets = docs.select("text").mapInPandas(whole, "sid long, tokens binary")
    with small_batches(docs.sparkSession):
        sets = materialise(sets.join(ids, "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens")), "sets")
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a")
    both = both.join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    with small_batches(docs.sparkSession):
        return materialise(both.select("a", "b", "ta", "tb").mapInPandas(_linked, "a long, b long"), "links")


def indexed_entries(docs: DataFrame, outlines: DataFrame) -> DataFrame:
    """(token, sid, n, rare, odd, usual): indexed tokens that several sets index, one row per set and token.

    `rare`: at most RARE sets index the token. Of each set: `usual` indexed tokens are shared and not rare, `odd` are the rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(token_levels(outlines))  # of fixed size

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _indexed(shared.value)(batches)

    sets = docs.select("text").mapInPandas(indexed, "sid long, n long, tokens array<long>")
    with small_batches(docs.sparkSession):
        sets = materialise(sets.groupBy("sid").agg(F.first(F.struct("n", "tokens")).alias("x")).select("sid", "x.n", "x.tokens"), "indexed")
    entries = sets.select("sid", "n", F.explode("tokens").alias("token"))
    sharing = materialise(entries.groupBy("token").agg(F.count(F.lit(1)).alias("sharing")).filter("sharing > 1"), "sharing")
    entries = materialise(entries.join(sharing, "token").select("token", "sid", "n", (F.col("sharing") <= RARE).alias("rare")), "shared")
    of_set = entries.groupBy("sid").agg(F.count(F.lit(1)).alias("shared"), F.sum((~F.col("rare")).cast("long")).alias("usual"))
    entries = entries.join(of_set, "sid")
    indexed_tokens = F.col("n") - _room(F.col("n"))
    return materialise(entries.select("token", "sid", "n", "rare", (indexed_tokens - F.col("usual")).alias("odd"), "usual", (1000 * F.col("shared") / indexed_tokens).cast("int").alias("central")), "entries")


def leader_pairs(entries: DataFrame) -> DataFrame:
    """At most one pair (a, b) for a set b: with the leader that leads the most of its tokens.

    The set that shares the largest part of its tokens leads a token: of near copies, the one that was edited least.
    """
    lead = F.max(F.struct("central", F.xxhash64("sid").alias("o"), "sid", "n")).alias("lead")
    leads = materialise(entries.groupBy("token").agg(lead).select("token", F.col("lead.sid").alias("a"), F.col("lead.n").alias("na")), "leads")
    led = entries.select("token", F.col("sid").alias("b"), "n").join(leads, "token").filter(f"a <> b AND 100 * least(na, n) >= {PERCENT} * greatest(na, n)")
    led = led.groupBy("b", "a").agg(F.count(F.lit(1)).alias("c"))
    return materialise(led.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"), "pairs")


def open_pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups that the matrix can't rule out, each once.

    A query's tokens meet the groups' unions in two ways. By rare tokens: the count of rare tokens in common, and all
    usual ones that both may have, bound the overlap. By usual tokens only: of two linked sets that share no rare indexed
    token, the one whose index ends first has none of its odd tokens in common, so its size without these bounds the overlap.
    """
    sizes = materialise(groups.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "group-sizes")
    entries = entries.drop("central").join(groups.withColumnRenamed("id", "sid"), "sid", "left").join(sizes, "component", "left")
    entries = entries.withColumns({"g": F.coalesce("component", F.col("sid")), "members": F.coalesce("members", F.lit(1))}).drop("component")
    entries = materialise(entries, "grouped")
    several = entries.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1").select("token")
    entries = materialise(entries.join(several, "token", "left_semi"), "matrix")
    rest = F.col("n") - F.col("odd")
    cell = [F.min("n").alias("low"), F.max("n").alias("high"), F.max("usual").alias("most"), F.max(rest).alias("rest")]
    matrix = entries.groupBy("token", "g", "members", "rare").agg(*cell)
    q = entries.select("token", "rare", F.col("sid").alias("q"), F.col("n").alias("nq"), F.col("usual").alias("uq"), rest.alias("restq"), F.col("g").alias("gq"), F.col("members").alias("mq"))
    c, whole = F.col, ["low", "high", "most"]
    small, large = _sizes(c("nq"), c("low"), c("high"))
    # Of two groups, the members of the smaller one are queries to the other: that finds all pairs between them.
    fits = ((c("mq") < c("members")) | ((c("mq") == c("members")) & (c("gq") < c("g")))) & (small <= large)
    met = lambda part, on: q.filter(part).drop("rare").join(matrix.filter(part).drop("rare").withColumnRenamed("token", "of"), (c("token") == c("of")) & on).groupBy("q", "nq", "uq", "g").agg(F.count(F.lit(1)).alias("c"), *[(F.min if x == "low" else F.max)(x).alias(x) for x in whole])
    by_rare = met("rare", fits).withColumn("c", c("c") + F.least("uq", "most"))
    by_usual = met("NOT rare", fits & (_least(c("nq"), small) <= F.greatest("restq", "rest")))
    hits = by_rare.unionByName(by_usual).filter(_opens(c("c"), c("nq"), c("low"), c("high")))
    hits = materialise(hits.groupBy(c("q").alias("a"), c("nq").alias("na"), c("g").alias("of")).agg(F.max("c").alias("c")), "hits")
    members = entries.select(c("sid").alias("b"), c("n").alias("nb"), "g").distinct()
    # A group's count is at least that of each of its members, so it bounds the pair's, too.
    able = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (c("c") + F.greatest(_room(c("na")), _room(c("nb"))) >= _least(c("na"), c("nb")))
    return materialise(hits.join(members, (c("of") == c("g")) & able).select("a", "b"), "open-pairs")


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, sid, n) of every row of `docs` (doc_id, text), h a hash of its text, and links (a, b) that connect all similar sets."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").mapInArrow(_outlines(parts), OUTLINE)
    with small_batches(docs.sparkSession, 4000):
        rows = materialise(rows, "outlines")
    outlines = rows.filter(F.col("blob").isNull())
    entries = indexed_entries(docs, rows)
    links = _verify(docs, outlines, leader_pairs(entries))
    groups = materialise(connected_components(links, "a", "b"), "groups")
    pairs = open_pairs(entries, groups)
    if not pairs.isEmpty():
        links = links.unionByName(_verify(docs, outlines, pairs))
    return outlines.select("doc_id", "h", "sid", "n"), links


def labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h, n, label) of every row: rows of one label are one component; an empty set's label is null."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows, links = similar_sets(docs)
    joined = materialise(connected_components(links, "a", "b"), "components")
    side = joined.select(F.col("id").alias("of"), "component")
    rows = with_small(rows, side, rows["sid"] == side["of"]).withColumn("label", F.coalesce("component", F.col("sid")))
    return materialise(rows.select("doc_id", "h", "n", "label"), "labelled")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = labelled(docs, key, text)
    shared = rows.filter(F.col("label").isNotNull()).groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    shared = materialise(shared, "shared")
    rows = with_small(rows, shared, rows["label"] == shared["of"])
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of `docs`, columns unchanged: of the smallest id (null ids are last), then the smallest hash of a text.

    Rows are told apart by id and text, null ids included; of rows that are equal in both, one stays. Rows without words
    are in no component and all stay.
    """
    rows = labelled(docs, key, text).filter(F.col("label").isNotNull())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    several = rows.groupBy("label").agg(F.min(rank).alias("x"), F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("label").alias("of"), "x")
    several = materialise(several, "several")
    rows = with_small(rows, several, rows["label"] == several["of"], "inner")
    first = F.col("doc_id").eqNullSafe(F.col("x.id")) & (F.col("h") == F.col("x.h"))
    of_row = materialise(rows.groupBy(F.col("doc_id").alias("__fs_id"), F.col("h").alias("__fs_of")).agg(F.max(first).alias("__fs_first"), F.count(F.lit(1)).alias("__fs_m")), "kept")
    df = docs.withColumns({"__fs_key": F.col(key), "__fs_h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    on = lambda side: df["__fs_key"].eqNullSafe(side["__fs_id"]) & (df["__fs_h"] == side["__fs_of"])
    columns = columns_of(docs)
    alone = of_row.filter("NOT __fs_first OR __fs_m > 1")
    once = with_small(df, alone, on(alone), "left_anti").select(*columns)
    twice = of_row.filter("__fs_first AND __fs_m > 1")
    if twice.isEmpty():
        return once
    some = with_small(df, twice, on(twice), "left_semi").dropDuplicates(["__fs_key", "__fs_h"])
    return once.unionByName(some.select(*columns))
