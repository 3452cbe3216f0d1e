"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on the document id.

Documents are dealt to runs of ascending ids, encoded, sorted within the run and written as one ORC folder per run. Each
row holds the ids, their number and the ids before it in its run; a run's own start is the sum of the runs before it, so
a reader can start at any file and stripe. A lookup by id skips runs by folder, stripes by statistics and Bloom filter.

Edge cases: a null or empty text has only the end id; a null doc_id comes first; rows of a repeated id are neighbours,
shorter first; an empty table gives an empty result; other columns are dropped; special tokens' strings in a text give
the special tokens' ids, as in the library.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import ranges, slices
from .common import scratch_path

END_ID = 1
#: Words that are encoded together, as one text. Bytes of text that are split at a time.
TOGETHER, AT_ONCE = 500, 12 << 20
#: Pieces of words whose ids a Python worker keeps for later slices and tasks, and letters that such a piece may have; others are encoded in each slice anew.
KEPT, SHORT = 400_000, 64
#: ASCII marks. What may stand before such marks and be told apart from them: ASCII that ends with a letter or digit, or
#: Latin letters, all composed, each of which is one letter in lower case (so without U+0130).
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HEAD = r"^(?:[\x00-\x7F]*[A-Za-z0-9]|[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)?$"
TAIL = r"(?P<tail>[!-/:-@\[-`{-~]+)$"


class Words:
    """The ids of words by a tokenizer whose ids of a text are those of its words in order."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[v for k, v in ids.items() if k.endswith("</w>")]] = True
        self.known, self.flat, self.n = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """__call__() for an array of words, by their pieces.

        Case makes no difference to the tokenizer, and marks after a letter or digit are a piece of their own. So a word is
        a head in lower case and a tail of marks, where HEAD says that this is exact, and each piece is encoded once.
        """
        heads = pc.ascii_rtrim(words, characters=MARKS)
        split = pc.match_substring_regex(heads, HEAD)
        tailed = pc.and_(split, pc.not_equal(pc.binary_length(heads), pc.binary_length(words))).to_numpy(zero_copy_only=False)
        tails = pc.struct_field(pc.extract_regex(words.filter(pa.array(tailed)), TAIL), "tail")
        heads = pc.if_else(split, pc.ascii_lower(heads), words)
        pieces = pa.concat_arrays([heads, tails.cast(heads.type)]).dictionary_encode()
        flat, n = self.look_up(pieces.dictionary.to_pylist())
        of = pieces.indices.to_numpy()
        which = np.full((len(words), 2), len(n), np.int64)  # the last value is an empty one
        which[:, 0], which[tailed, 1] = of[: len(words)], of[len(words) :]
        n = np.append(n, 0)
        size = n[which]
        return flat[ranges((np.cumsum(n) - n)[which.ravel()], size.ravel())], size.sum(axis=1)

    def look_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """__call__() for distinct pieces, of which those that are kept aren't encoded again."""
        at = np.array([self.known.get(x, -1) for x in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        short = np.array([len(pieces[i]) <= SHORT for i in new.tolist()], bool)
        new = np.concatenate([new[short], new[~short]])
        at[new] = len(self.n) + np.arange(len(new))
        flat, n = self([pieces[i] for i in new.tolist()])
        more = min(int(short.sum()), max(0, KEPT - len(self.n)))
        self.known.update(zip([pieces[i] for i in new[:more].tolist()], at[new[:more]].tolist()))
        flat, n = np.concatenate([self.flat, flat]), np.concatenate([self.n, n])
        ends = np.cumsum(n)
        kept = len(self.n) + more
        self.flat, self.n = flat[: ends[kept - 1] if kept else 0].copy(), n[:kept].copy()
        return flat[ranges((ends - n)[at], n[at])], n[at]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and each word's number of ids.

        Letters, and letters with one mark after them, are one and two pieces to the tokenizer, each of which ends with
        an id that ends a word. So such words are encoded together, and told apart by these ids.
        """
        pieces = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            if w.isascii():
                pieces[i] = 1 if w.isalpha() else 2 if w[:-1].isalpha() and not w[-1].isalnum() else 0
            else:
                pieces[i] = w.isalpha() and is_normalized("NFC", w) and w.lower().isalpha()
        n, found = np.zeros(len(words), np.int64), [None] * len(words)
        plain, other = np.flatnonzero(pieces), np.flatnonzero(pieces == 0).tolist()
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        coded = []
        for group, ids in zip(groups, self.encode([" ".join([words[i] for i in g]) for g in groups])):
            ids = np.array(ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(pieces[group]) - 1
            if last[-1] + 1 != len(cuts):
                other += group.tolist()
                continue
            n[group] = np.diff(cuts[last], prepend=0)
            coded.append((group, ids))
        for i, ids in zip(other, self.encode([words[i] for i in other])):
            n[i], found[i] = len(ids), ids
        start = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), np.int32)
        for group, ids in coded:
            flat[ranges(start[group], n[group])] = ids
        if other:
            at = np.array(other)
            flat[ranges(start[at], n[at])] = np.fromiter(chain.from_iterable(found[i] for i in other), np.int32, int(n[at].sum()))
        return flat, n


@cache
def kept_words(vocabulary: str) -> Words:
    """Words of a vocabulary, once a Python worker."""
    return Words(vocabulary)


def encode_slice(words: Words, texts: pa.Array, special: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with its end id, one after the other, and each text's number of ids."""
    whole = pc.match_substring(texts, special)
    lists = pc.ascii_split_whitespace(pc.if_else(whole, pa.scalar(""), texts))
    coded = lists.flatten().dictionary_encode()
    odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    flat, n = words.of(coded.dictionary)
    texts_ids = words.encode([texts[int(i)].as_py() for i in odd])
    # Values: the distinct words, the end id, then the texts that hold a special token.
    flat = np.concatenate([flat, np.array([end_id], np.int32), np.fromiter(chain.from_iterable(texts_ids), np.int32)])
    n = np.concatenate([n, [1], np.fromiter(map(len, texts_ids), np.int64, len(texts_ids))]).astype(np.int64)
    start, bounds = np.cumsum(n) - n, lists.offsets.to_numpy().astype(np.int64)
    which = coded.indices.to_numpy().astype(np.int64)
    which[bounds[:-1][odd]] = len(coded.dictionary) + 1 + np.arange(len(odd))  # such a text is one empty word here
    which = np.insert(which, bounds[1:], len(coded.dictionary))
    size = n[which]
    ends = np.cumsum(size)[bounds[1:] + np.arange(len(texts))]
    return flat[ranges(start[which], size)], np.diff(ends, prepend=0)


def encode_texts(vocabulary: str, end_id: int = END_ID, special: str = "<|"):
    """A function for mapInArrow: (doc_id, run, text) to (doc_id, run, n_tokens, ids).

    This tokenizer drops white space, and neither its normaliser nor its splitter looks across ASCII white space, so
    the ids of a text are those of its words in order, and each distinct piece of a slice's words is encoded once (once a
    Python worker, while it keeps them). Texts that may hold a special token (all start with `special`) are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = kept_words(vocabulary)
        for b in slices(batches, AT_ONCE):
            flat, n = encode_slice(words, b.column("text"), special, end_id)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("run"), pa.array(n), ids], ["doc_id", "run", "n_tokens", "ids"])

    return run


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", runs: int | None = None) -> None:
    """Write the ids of all documents, in ascending order of the key, as ORC below `path`."""
    runs = runs or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 10_000)).first()[0]
    cut = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<bigint>")
    run = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(cut, lambda c: c < F.col("doc_id"))))
    coded = ids.withColumn("run", run).select("doc_id", "run", "text").mapInArrow(encode_texts(vocabulary), "doc_id long, run int, n_tokens long, ids array<int>")
    order = Window.partitionBy("run").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    coded = coded.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    coded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("compression", "snappy").partitionBy("run").orc(path)


def read_token_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids, run of all documents. The starts of runs come from a read of two narrow columns."""
    schema = "doc_id long, n_tokens long, ids array<int>, before long, run int"
    df = spark.read.schema(schema).orc(path)
    starts = df.groupBy("run").agg(F.sum("n_tokens").alias("n"))
    starts = starts.withColumn("run_start", F.sum("n").over(Window.orderBy("run")) - F.col("n")).drop("n")
    df = df.join(F.broadcast(starts), "run")  # one row per run, a number that the writer's `runs` bounds
    return df.select("doc_id", (F.col("run_start") + F.col("before")).alias("start"), "n_tokens", "ids", "run")


def find_token_ids(spark, path: str, doc_id: int) -> DataFrame:
    """The row of one document: the filter is pushed to the stripes' statistics and Bloom filters."""
    return read_token_ids(spark, path).filter(F.col("doc_id") == F.lit(doc_id))


def with_crc32(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64()), b.column("run")], ["doc_id", "start", "n_tokens", "ids_crc32", "run"])

    return df.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, run int")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents' ids and read them back: doc_id, start, n_tokens, ids_crc32, run."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, vocabulary)
    return with_crc32(read_token_ids(docs.sparkSession, path))
