"""Documents as numbered words: each block of documents has its own dictionary, and values of words come back by block.

A value of every distinct word of the corpus (a count, a score, token ids) is needed by every document. The dictionary
may be too large to broadcast, and rows of (document, word) too many to shuffle. So each task numbers the words of its
block of documents: documents become packed word numbers, and only the block's distinct words are shuffled. Blocks are
closed at BLOCK_WORDS distinct words or BLOCK_TOKENS words, so a block's rows fit a task whatever the input's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise_by, small_batches

BLOCK_WORDS, BLOCK_TOKENS, CHUNK = 1 << 19, 1 << 23, 1 << 14
#: Bytes of text that are split at a time. Rows of results that leave Python at a time, so that the JVM holds few of them outside its heap.
SLICE, RESULTS = 12 << 20, 512
NUMBERED = "block long, doc_id long, flag boolean, ids binary, base int, words array<binary>, counts array<long>, part int, grams binary, gram_counts binary"
ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("flag", pa.bool_()), ("ids", pa.binary()), ("base", pa.int32()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("part", pa.int32()), ("grams", pa.binary()), ("gram_counts", pa.binary())])


class Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        got = self[word] = len(self)
        return got


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between slices; workers live as long as the application
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def distinct(pieces: pa.Array) -> tuple[list, np.ndarray]:
    """The distinct values, and the place of each piece's among them."""
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([(x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type)) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def parts_of(spark, tasks: int = 1) -> int:
    """Parts of the space of words or grams, where those of all blocks meet: in proportion to the tasks of a shuffle, one for so many."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")) // tasks)


def number_words(docs: DataFrame, split: Callable[[Numbers], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]], name: str, gather: Callable, most: int = SLICE, batch: int = 10_000) -> DataFrame:
    """`docs` (doc_id, flag, text) as a table of NUMBERED rows, in files by block.

    Rows with `ids` are documents: their word numbers, packed. Rows with `words` are parts of a block's dictionary: words
    base, base + 1, ..., and how often each occurs in documents whose flag is set. `split(numbers)` is called once a block
    and gives the function from an array of texts (no nulls) to their word numbers, one after the other, and each text's
    number of words. `gather(numbers)` is called once a block, too, and gives an object that is told all texts, by
    add(texts, flags), and says at the block's end, by close(), which further rows (part, grams, gram_counts) the block
    sends; it has `dictionary` if these rows stand in place of the block's dictionary. `most`: bytes of text that are split
    at a time, `batch`: rows that go to Python at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0

        def opened() -> tuple:
            numbers = Numbers()
            return numbers, split(numbers), np.zeros(0, np.int64), 0, gather(numbers)

        def closed() -> Iterator[pa.RecordBatch]:
            words = [] if more.dictionary else [w.encode("utf-8") for w in numbers]
            n = np.pad(counts[: len(words)], (0, max(0, len(words) - len(counts))))
            for i in range(0, len(words), CHUNK):
                yield batch_of(ROWS, block=[part << 24 | k], base=[i], words=[words[i : i + CHUNK]], counts=[n[i : i + CHUNK]])
            for row in more.close():
                yield batch_of(ROWS, block=[part << 24 | k], **{c: [x] for c, x in zip(("part", "grams", "gram_counts"), row)})

        numbers, cut, counts, seen, more = opened()
        for b in slices(batches, most):
            texts, flags = b.column("text"), b.column("flag").to_numpy(zero_copy_only=False).astype(bool)
            ids, n = cut(texts)
            more.add(texts, flags)
            seen += len(ids)
            if flags.any() and not more.dictionary:
                counts = np.pad(counts, (0, max(0, len(numbers) - len(counts))))
                counts += np.bincount(ids[np.repeat(flags, n)], minlength=len(counts))
            ends = np.cumsum(n)
            packed = [pack_numbers(ids[i:j]) for i, j in zip((ends - n).tolist(), ends.tolist())]
            yield batch_of(ROWS, block=np.full(len(n), part << 24 | k), doc_id=b.column("doc_id"), flag=b.column("flag"), ids=packed)
            if len(numbers) >= BLOCK_WORDS or seen >= BLOCK_TOKENS:
                yield from closed()
                k += 1
                numbers, cut, counts, seen, more = opened()
        yield from closed()

    rows = docs.select("doc_id", "flag", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, NUMBERED)
    with small_batches(docs.sparkSession, batch):
        return materialise_by(rows, "block", name)


def dictionary(numbered: DataFrame) -> DataFrame:
    """Rows of (block, place, word, n): each block's distinct words."""
    rows = numbered.filter(F.col("words").isNotNull())
    rows = rows.select("block", "base", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w"))
    return rows.select("block", (F.col("base") + F.col("i")).cast("int").alias("place"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))


def apply_values(numbered: DataFrame, values: DataFrame, pack: Callable[[pd.DataFrame], list[bytes]], use: Callable[[pd.DataFrame, np.ndarray, list[list[bytes]], pd.DataFrame], pa.Table], schema: str, more: DataFrame | None = None, keep_word: bool = False) -> DataFrame:
    """One row per document by `use(documents, places, packed)`, where values of all its block's words are at hand.

    `values` has a row for each distinct word. `pack` turns rows of (block, place, values) into a few byte strings;
    `use` gets them in a list per part, with the places of the parts' words one after the other, and the rows of `more`
    (block, grams, logs) that belong to the block. With `keep_word`, `pack` sees the words too.
    """
    rows = dictionary(numbered).drop("n").join(values, "word")
    rows = rows if keep_word else rows.drop("word")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, g in pdf.groupby("block"):
                yield pd.DataFrame({"block": [block], "places": [pack_numbers(g["place"].to_numpy("<i4"))], "data": [pack(g)]})

    parts = rows.mapInPandas(packed, "block long, places binary, data array<binary>")
    if more is not None:
        parts = parts.withColumns({"grams": F.lit(None).cast("binary"), "logs": F.lit(None).cast("binary")}).unionByName(more.withColumns({"places": F.lit(None).cast("binary"), "data": F.lit(None).cast("array<binary>")}))
    return _meet(numbered, parts, use, schema)


def _meet(numbered: DataFrame, parts: DataFrame, use: Callable, schema: str) -> DataFrame:
    """A block's documents and its words' values in one task; the documents' table is bucketed by block already."""

    def meet(docs: pa.Table, parts: pa.Table) -> pa.Table:
        docs, parts = docs.to_pandas(), parts.to_pandas()
        mine = parts[parts["places"].notna()]
        places = np.concatenate([np.zeros(0, np.int32), *[unpack(x).astype(np.int32) for x in mine["places"]]])
        out = use(docs, places, mine["data"].to_list(), parts[parts["places"].isna()])
        return pa.Table.from_batches(out.to_batches(max_chunksize=RESULTS), out.schema)

    # A null beside an id would make pandas hold both as floats.
    docs = numbered.filter(F.col("ids").isNotNull()).select("block", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "flag", "ids")
    return docs.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(meet, schema)


def ids_of(docs: pd.DataFrame) -> pd.array:
    """The ids of a block's documents, null ones included."""
    return pd.arrays.IntegerArray(docs["doc_id"].to_numpy(np.int64), docs["no_id"].to_numpy(bool))


class BlockWords:
    """A block's distinct words, dealt by part: what a block sends in place of a dictionary. Their places travel along."""

    dictionary = True

    def __init__(self, numbers: Numbers, parts: int) -> None:
        self.numbers, self.parts = numbers, parts

    def add(self, texts: pa.Array, flags: np.ndarray) -> None:
        pass

    def close(self) -> list[tuple[int, bytes, bytes]]:
        words = [w.encode("utf-8") for w in self.numbers]
        part = np.fromiter((zlib.crc32(w) % self.parts for w in words), np.int32, len(words))
        order = np.argsort(part, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(at):
                out.append((int(part[at[0]]), pack_words([words[i] for i in at]), pack_numbers(at)))
        return out


def pack_words(words: list[bytes]) -> bytes:
    return zlib.compress(np.array([len(words), *map(len, words)], "<i4").tobytes() + b"".join(words), 1)


def unpack_words(packed: bytes) -> list[bytes]:
    raw = zlib.decompress(packed)
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<i4", n, 4)) + 4 * (n + 1)
    return [raw[i:j] for i, j in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


CODED = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("data", pa.list_(pa.binary()))])


def apply_codes(numbered: DataFrame, encode: Callable[[Column], Column], use: Callable, schema: str, parts: int) -> DataFrame:
    """apply_values() for a table numbered with BlockWords, with values (array<int>) that follow from a word alone.

    All blocks' words of a part meet in one task; `encode` (an expression of an array of words) runs over each distinct
    word once (each of its tasks unpacks the rank map, so there are only `parts` of them), and `use` gets, for each block, the values' lengths and the values one after the other, packed. Words are
    shuffled once, and their values once.
    """
    arrays = "blocks array<long>, places array<binary>, which array<binary>, words array<binary>"

    def union(g: pd.DataFrame) -> pd.DataFrame:
        numbers, which = {}, []
        for x in g["grams"]:
            words = unpack_words(x)
            which.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
        places, words, rows = [unpack(x) for x in g["gram_counts"]], list(numbers), []
        for lo in range(0, len(words), CHUNK):  # a row holds so many distinct words at most
            own = [(k, p[o], w[o] - np.uint32(lo)) for k, p, w in zip(g["block"], places, which) if (o := (w >= lo) & (w < lo + CHUNK)).any()]
            rows.append(([k for k, *_ in own], [pack_numbers(p) for _, p, _ in own], [pack_numbers(w) for *_, w in own], words[lo : lo + CHUNK]))
        return pd.DataFrame(rows, columns=["blocks", "places", "which", "words"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                values = b.column("values")[i].values
                at, flat = values.offsets.to_numpy().astype(np.int64), values.values.to_numpy(zero_copy_only=False).astype(np.uint32)
                rows = [(k, p, unpack(w)) for k, p, w in zip(*(b.column(c)[i].as_py() for c in ("blocks", "places", "which")))]
                data = []
                for _, _, w in rows:
                    n = at[w + 1] - at[w]
                    data.append([zlib.compress(n.astype("<u4").tobytes(), 1), pack_numbers(flat[ranges(at[w], n)])])
                yield batch_of(CODED, block=[k for k, _, _ in rows], places=[p for _, p, _ in rows], data=data)

    words = numbered.filter(F.col("grams").isNotNull()).select("part", "block", "grams", "gram_counts").repartition(parts, "part")
    # A stage of its own, so that a task has one Python process at a time; and each row, of CHUNK words at most, is as much work.
    words = words.groupBy("part").applyInPandas(union, arrays).repartition(parts)
    coded = words.select("blocks", "places", "which", encode(F.col("words")).alias("values"))
    return _meet(numbered, coded.mapInArrow(deal, "block long, places binary, data array<binary>"), use, schema)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., start + n - 1 for each pair, one after the other."""
    total = int(n.sum())
    kind = np.int32 if total < 2**31 and (not len(start) or int(start.max()) < 2**31) else np.int64
    out = np.repeat((start - (np.cumsum(n) - n)).astype(kind), n)
    out += np.arange(total, dtype=kind)
    return out


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Compressed little-endian 32-bit integers, the lowest bytes of all first."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
