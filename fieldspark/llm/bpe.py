"""Byte-level BPE by Spark's higher-order functions, over the distinct words of the corpus.

Words are pieces of text as the tokenizer's pattern cuts them. Each distinct word is encoded once: its bytes are an array
of one-byte pieces, and a fold merges the neighbours of lowest rank until none is in the rank map, a literal. The ranks
of neighbours are kept beside the pieces, so a merge looks up two ranks only. Bytes are written as the 256 characters of
ISO-8859-1, which lets Spark's string functions join and compare them. A word of over CUT bytes is cut, the cuts are merged
by themselves, and at each seam the last pieces before and the first after it are merged anew: where the outer ones come
out as they were, the whole is what merging the whole word gives, as pieces are right if each two neighbours merge to
themselves; otherwise more pieces, and in the end both sides, are merged anew. Decoding joins the binary pieces of the ids.

Edge cases: a null or empty text has no tokens; repeated rows are encoded alike; a word without spaces of any length is
one word, in time that grows with its length; an empty table gives an empty result; special tokens' strings
are plain text; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import json
import string
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BlockWords, Numbers, apply_codes, distinct, ids_of, number_words, parts_of, ranges, unpack
from .common import let

#: Buckets of the rank map: a lookup in a map is a scan, so the literal is an array of small maps, found by crc32.
BUCKETS, NEVER = 1 << 14, 2**31 - 1
#: Longer words are cut into so many bytes, and so many cuts are joined at a time. Pieces on either side of a seam that are merged anew.
CUT, SEAMS = 64, (6, 48)
#: Ids that are decoded at a time. Bytes of text that are split at a time.
AT_ONCE, SLICE = 1 << 16, 6 << 20
#: Any white space before a space. Marks of which one after letters is a word of the pattern by itself.
SPACES = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
MARKS = frozenset(string.punctuation)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file (part of the installation, of fixed size)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal: array<map<piece, rank>>; the optimiser folds the parsing into a constant."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        s = piece.decode("latin-1")
        buckets[zlib.crc32(s.encode("utf-8")) % BUCKETS][s] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def encode_words(words: Column, literal: Column) -> Column:
    """The ids (array<array<int>>) of words (array<binary>). The literal stands in the expression once."""
    none = F.array().cast("array<int>")

    def all_words(ranks: Column) -> Column:
        rank = lambda s: F.get(ranks, F.crc32(s).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))[s]
        cost = lambda s: F.coalesce(rank(s), F.lit(NEVER))

        def state_of(pieces: Column, costs: Column) -> Column:
            return let(costs, lambda c: F.struct(pieces.alias("p"), c.alias("r"), F.array_min(c).alias("m")))

        def step(state: Column, _: Column) -> Column:
            p, r, m = state["p"], state["r"], state["m"]

            def at(k: Column) -> Column:
                def put(new: Column) -> Column:
                    # Built place by place: a concatenation of arrays costs several times as much.
                    places = F.sequence(F.lit(0), F.size(p) - 2)
                    pieces = F.transform(places, lambda i: F.when(i < k, F.get(p, i)).when(i > k, F.get(p, i + 1)).otherwise(new))
                    right, left = lambda i: cost(F.concat(new, F.get(p, i + 2))), lambda i: cost(F.concat(F.get(p, i), new))
                    costs = F.transform(places, lambda i: F.when(i < k - 1, F.get(r, i)).when(i > k, F.get(r, i + 1)).when(i == k, right(i)).otherwise(left(i)))
                    return state_of(pieces, costs)

                return let(F.concat(F.get(p, k), F.get(p, k + 1)), put)

            return F.when(m == NEVER, state).otherwise(let(F.array_position(r, m).cast("int") - 1, at))

        def merged(text: Column) -> Column:
            n = F.length(text)
            chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(1)))
            pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, cost(F.substring(text, i, F.lit(2)))).otherwise(F.lit(NEVER)))
            return F.aggregate(F.sequence(F.lit(1), n - 1), state_of(chars, pairs), step)["p"]

        def joined(left: Column, right: Column) -> Column:
            def within(k: int) -> Column:
                a, b = F.greatest(F.size(left) - k, F.lit(0)), F.least(F.lit(k), F.size(right))

                def spliced(m: Column) -> Column:
                    # Pieces are right if each two neighbours are, and these come from runs of merges of their own.
                    fits = ((a == 0) | (F.get(m, F.lit(0)) == F.get(left, a))) & ((b == F.size(right)) | (F.get(m, F.size(m) - 1) == F.get(right, b - 1)))
                    return F.when(fits, F.concat(F.slice(left, 1, a), m, F.slice(right, b + 1, F.size(right))))

                return let(merged(F.array_join(F.concat(F.slice(left, a + 1, k), F.slice(right, 1, k)), "")), spliced)

            return F.coalesce(*[within(k) for k in SEAMS], merged(F.array_join(F.concat(left, right), "")))

        def all_joined(parts: Column) -> Column:
            return F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), joined)

        def long(text: Column) -> Column:
            cut = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), merged)
            groups = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CUT).cast("int")), lambda g: all_joined(F.slice(c, g * CUT + 1, CUT)))
            return let(let(cut, groups), all_joined)

        def fold(text: Column) -> Column:
            return F.transform(F.when(F.length(text) <= CUT, merged(text)).otherwise(long(text)), rank)

        def whole(text: Column) -> Column:
            return F.when(F.length(text) == 0, none).otherwise(let(rank(text), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(fold(text))))

        return F.transform(words, lambda w: let(F.decode(w, "ISO-8859-1"), whole))

    return let(literal, all_words)


def pattern_words(pattern: str) -> Callable[[Numbers], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]]:
    """A splitter of texts by the tokenizer's pattern.

    Where every space stands between two characters that aren't white space, no word of the pattern reaches over a space
    other than by starting with it, so the stretches between spaces are cut one by one, each distinct one of a slice once.
    """

    def split(numbers: Numbers) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
        import regex

        find = regex.compile(pattern).findall

        def number(stretch: str, space: bool) -> list[int]:
            lead = " " + stretch if space else stretch
            if stretch.isalpha():  # letters alone are one word of the pattern
                return [numbers[lead]]
            if stretch[-1:] in MARKS and stretch[:-1].isalpha():
                return [numbers[lead[:-1]], numbers[stretch[-1]]]
            return [numbers[w] for w in find(lead)]

        def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            whole = pc.or_(pc.match_substring_regex(texts, SPACES), pc.starts_with(texts, " "))
            lists = pc.split_pattern(pc.if_else(whole, pa.scalar(""), texts), " ")
            places, of = distinct(lists.flatten())
            starts = lists.offsets.to_numpy().astype(np.int64)
            # Values: first pieces of texts, which no space precedes, then the distinct others, then texts that are cut whole.
            firsts, first_of = distinct(lists.flatten().take(pa.array(starts[:-1])))
            odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            use = np.zeros(len(places), bool)
            later = np.ones(len(of), bool)
            later[starts[:-1]] = False
            use[of[later]] = True
            values = [number(x, False) for x in firsts] + [number(x, True) if u else [] for x, u in zip(places, use.tolist())]
            values += [[numbers[w] for w in find(texts[int(i)].as_py())] for i in odd]
            which = of + np.int32(len(firsts))
            which[starts[:-1]] = first_of
            which[starts[:-1][odd]] = len(firsts) + len(places) + np.arange(len(odd))
            n = np.fromiter(map(len, values), np.int64, len(values))
            flat, start = np.fromiter(chain.from_iterable(values), np.uint32, int(n.sum())), np.cumsum(n) - n
            del lists, places, values, of
            size = n[which]
            return flat[ranges(start[which], size)], np.add.reduceat(size, starts[:-1]) if len(texts) else np.zeros(0, np.int64)

        return words

    return split


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for) of every text."""
    spark = docs.sparkSession
    parts = parts_of(spark, 4)
    rows = docs.select(F.col(key).alias("doc_id"), F.lit(False).alias("flag"), F.col(text).alias("text"))
    numbered = number_words(rows, pattern_words(pattern), "words", lambda numbers: BlockWords(numbers, parts), SLICE, 2000)
    ranks = read_ranks(ranks_path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shared = spark.sparkContext.broadcast(pieces)  # the vocabulary, of fixed size
    literal = rank_map(ranks)
    del ranks, pieces

    def use(docs: pd.DataFrame, places: np.ndarray, values: list[list[bytes]], _: pd.DataFrame) -> pa.Table:
        n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(zlib.decompress(v[0]), "<u4").astype(np.int64) for v in values]])
        flat = np.concatenate([np.zeros(0, np.uint32), *[unpack(v[1]) for v in values]])
        start, length = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        start[places], length[places] = np.cumsum(n) - n, n
        del values
        n_tokens, ids_sha, back_sha, kept, binary = [], [], [], [], shared.value
        for packed in docs["ids"]:
            w = unpack(packed)
            ids = flat[ranges(start[w], length[w])].astype("<u4")
            n_tokens.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            back = hashlib.sha256()
            for i in range(0, len(ids), AT_ONCE):
                back.update(b"".join(map(binary.__getitem__, ids[i : i + AT_ONCE].tolist())))
            back_sha.append(back.hexdigest())
            if keep_ids:
                kept.append(ids.astype(np.int32))
        out = {"doc_id": pa.array(ids_of(docs), pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(back_sha, pa.string())}
        if keep_ids:  # one flat array; lists of Python numbers would take thirty times as much
            offsets = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *kept])))
        return pa.table(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return apply_codes(numbered, lambda words: encode_words(words, literal), use, schema + ", ids array<int>" * keep_ids, parts)


def piece_list(ranks: dict[bytes, int]) -> Column:
    """The pieces in rank order as a literal: array<string>, a byte a character."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of ids (array<int>), given piece_list(); null for null ids. In one expression, so for texts that fit a row twice over."""
    return let(pieces, lambda p: F.encode(F.array_join(F.transform(ids, lambda i: F.get(p, i)), ""), "ISO-8859-1"))
