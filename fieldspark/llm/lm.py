"""A context-tree weighting model of bytes, trained on the corpus, with code lengths for every text.

A text is coded as its lower-cased words, each ended by a space, then one end symbol. A byte is eight binary decisions,
one at each node of the byte's bit tree. Each decision has a context tree over the up to DEPTH bytes before it (before
the text stand a space and zeros). Every context node holds a Krichevsky-Trofimov estimate; its weighted probability is
half its own estimate and half the product of its children's. A decision's probability mixes the estimates of all depths
on its path by those weights, up to the deepest context that training has seen.

Each task counts the distinct grams (context and byte) of its block of documents. They are dealt by the last two bytes of
the context, so whole subtrees meet in a task, whatever the size of the corpus; the nodes of depth 0 and 1 (at most
257 * 255 counters) are summed on the driver. The probabilities of a block's grams come back to the block.

Edge cases: a null or empty text is one end symbol; a null id belongs to training; with no training text every decision
has probability one half; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Numbers, apply_values, dictionary, distinct, ids_of, number_words, parts_of, unpack
from .common import id_remainder, materialise

DEPTH, END, BYTE = 5, b"\n", np.uint64(8)
#: Coded bytes that are turned into grams at a time.
AT_ONCE = 1 << 22


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series at x + 7."""
    y, shift = x + 7.0, np.ones_like(x)
    for i in range(7):
        shift *= x + i
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def coded(words: list[bytes]) -> bytes:
    """The bytes of a text: DEPTH bytes of lead, then its words (the last is END), each but END followed by a space."""
    return b"\0" * (DEPTH - 1) + b" " + b" ".join(words)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every coded byte: DEPTH bytes of context and the byte itself as one integer, and the number of its text."""
    n = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    key = np.zeros(len(b) - DEPTH, np.uint64)
    for i in range(DEPTH + 1):
        key = key << BYTE | b[i : i + len(key)]
    of = np.repeat(np.arange(len(n)), n)[DEPTH:]
    inside = np.arange(DEPTH, len(b)) - np.repeat(np.cumsum(n) - n, n)[DEPTH:] >= DEPTH
    return key[inside], of[inside]


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a gram: decided by the last two bytes of its context."""
    two = (keys >> BYTE) & np.uint64(0xFFFF)
    return ((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(keys))


def _squeeze(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes(), 1)


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), "<u8"), dtype=np.uint64)


class BlockGrams:
    """The distinct grams of a block of documents, with their counts in the training documents."""

    dictionary = False

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.texts: list[bytes] = []
        self.flags: list[bool] = []
        self.waiting, self.keys, self.counts = 0, [], []

    def add(self, texts: pa.Array, flags: np.ndarray) -> None:
        for text, flag in zip(texts.cast(pa.binary()).to_pylist(), flags.tolist()):
            self.texts.append(coded([*text.lower().split(), END]))
            self.flags.append(flag)
            self.waiting += len(self.texts[-1])
            if self.waiting >= AT_ONCE:
                self._count()

    def _count(self) -> None:
        if self.texts:
            keys, of = grams(self.texts)
            at, found = pd.factorize(keys)
            self.keys.append(found)
            self.counts.append(np.bincount(at, np.array(self.flags, float)[of], len(found)))
            if len(self.keys) >= 8:
                keys, counts = _merge(self.keys, self.counts)
                self.keys, self.counts = [keys], [counts]
        self.texts, self.flags, self.waiting = [], [], 0

    def close(self) -> list[tuple[int, bytes, bytes]]:
        self._count()
        keys, counts = _merge(self.keys, self.counts)
        part, counts = _part(keys, self.parts), counts.astype("<u4")
        order = np.argsort(part, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(at):
                out.append((int(part[at[0]]), _squeeze(keys[at]), zlib.compress(counts[at].tobytes(), 1)))
        return out


class Level:
    """The nodes of one context depth: grams cut to that depth, and for each of the eight bits the nodes over them.

    `keys` are ascending (context, byte) integers with counts `n`; nodes of bit t are runs of keys with equal upper bits.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys, self.n = keys, n
        self.starts, self.of, self.zeros, self.ones, self.weighted, self.stop = [], [], [], [], [], []
        for t in range(8):
            upper = keys >> np.uint64(8 - t)
            new = np.concatenate([[True], upper[1:] != upper[:-1]]) if len(keys) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            ones = n * (keys >> np.uint64(7 - t) & np.uint64(1))
            total, one = (np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (n, ones))
            self.starts.append(starts)
            self.of.append(np.cumsum(new) - 1)
            self.zeros.append(total - one)
            self.ones.append(one)

    def weigh(self, below: Level | None, up: np.ndarray | None) -> None:
        """Weighted probabilities, from the level below whose keys have the places `up` in this one."""
        for t in range(8):
            own = log_kt(self.zeros[t], self.ones[t])
            if below is None:
                self.weighted.append(own)
                self.stop.append(np.ones(len(own)))
            else:
                parent = self.of[t][up[below.starts[t]]]
                total = np.bincount(parent, below.weighted[t], len(own))
                self.weighted.append(np.logaddexp(own, total) - np.log(2))
                self.stop.append(np.exp(own - np.log(2) - self.weighted[t]))


def levels(keys: np.ndarray, counts: np.ndarray, shallowest: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels from DEPTH down to `shallowest`, and the places of each level's keys in the next shallower one."""
    out, ups = [Level(keys, counts)], []
    out[0].weigh(None, None)
    for depth in range(DEPTH - 1, shallowest - 1, -1):
        short = out[-1].keys & np.uint64((1 << (8 * depth + 8)) - 1)
        found, up = np.unique(short, return_inverse=True)
        out.append(Level(found, np.bincount(up, out[-1].n, len(found))))
        out[-1].weigh(out[-2], up)
        ups.append(up)
    return out, ups


def log_probabilities(keys: np.ndarray, counts: np.ndarray, tops: tuple) -> np.ndarray:
    """log10 of the probability of every gram's byte. `tops` has the sums of depth 0 and 1 (see train_tops)."""
    (r0, r1, stop0), (n0, n1, stop1) = tops
    tree, ups = levels(keys, counts, 2)
    total = np.zeros(len(keys))
    for t in range(8):
        shallow = tree[-1].keys
        bit = (shallow >> np.uint64(7 - t) & np.uint64(1)).astype(bool)
        prefix = (np.uint64(1 << t) | (shallow & np.uint64(255)) >> np.uint64(8 - t)).astype(np.int64)
        one = (shallow >> BYTE & np.uint64(255)).astype(np.int64) * 256 + prefix
        kt = lambda a0, a1, bit: (np.where(bit, a1, a0) + 0.5) / (a0 + a1 + 1.0)
        # done: what depths up to here give; rest: the weight of deeper ones; last: the answer if none is deeper.
        own = kt(r0[prefix], r1[prefix], bit)
        done, rest, last = stop0[prefix] * own, 1 - stop0[prefix], own
        own, seen = kt(n0[one], n1[one], bit), n0[one] + n1[one] > 0
        last = np.where(seen, done + rest * own, last)
        done, rest = done + rest * stop1[one] * own, rest * (1 - stop1[one])
        for i in range(len(tree) - 1, -1, -1):
            level = tree[i]
            if i < len(tree) - 1:
                done, rest, last = done[ups[i]], rest[ups[i]], last[ups[i]]
            at = level.of[t]
            bit = (level.keys >> np.uint64(7 - t) & np.uint64(1)).astype(bool)
            a0, a1, stop = level.zeros[t][at], level.ones[t][at], level.stop[t][at]
            own, seen = kt(a0, a1, bit), a0 + a1 > 0
            last = np.where(seen, done + rest * own, last)
            done, rest = done + rest * stop * own, rest * (1 - stop)
        total += np.log10(last)
    return total


def _part_rows(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _merge([_keys(x) for x in g["grams"]], [np.frombuffer(zlib.decompress(x), "<u4") for x in g["gram_counts"]])


def train_tops(sent: DataFrame) -> tuple:
    """Depths 0 and 1: zeros, ones and weight of the own estimate, as arrays by bits so far (and by the byte before)."""

    def sums(g: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _part_rows(g)
        keys, counts = keys[counts > 0], counts[counts > 0]
        level = levels(keys, counts, 2)[0][-1]
        out = []
        for t in range(8):
            first = level.keys[level.starts[t]]
            node = (first >> BYTE & np.uint64(255)).astype(np.int64) * 256 + (np.uint64(1 << t) | (first & np.uint64(255)) >> np.uint64(8 - t)).astype(np.int64)
            out.append(pd.DataFrame({"node": node, "n0": level.zeros[t], "n1": level.ones[t], "below": level.weighted[t]}).groupby("node", as_index=False).sum())
        return pd.concat(out)

    top = sent.groupBy("part").applyInPandas(sums, "node long, n0 double, n1 double, below double")
    top = top.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toPandas()  # at most 65,536 rows
    node = top["node"].to_numpy(np.int64)
    n0, n1, below = (np.bincount(node, top[c].to_numpy(float), 1 << 16) for c in ("n0", "n1", "below"))
    own = log_kt(n0, n1)
    weighted = np.where(n0 + n1 > 0, np.logaddexp(own, below) - np.log(2), 0.0)
    stop1 = np.exp(own - np.log(2) - weighted)
    r0, r1 = n0.reshape(256, 256).sum(0), n1.reshape(256, 256).sum(0)
    own = log_kt(r0, r1)
    stop0 = np.exp(own - np.logaddexp(own, weighted.reshape(256, 256).sum(0)))
    return (r0, r1, stop0), (n0, n1, stop1)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_bits_per_byte of every text."""
    rows = docs.select(F.col(key).alias("doc_id"), (id_remainder(F.col(key), folds) != 0).alias("flag"), F.col(text).alias("text"))

    parts = max(256, parts_of(docs.sparkSession))

    def split(numbers: Numbers):
        end = END.decode()

        def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            pieces = lists.flatten()
            real = pc.binary_length(pieces).to_numpy() > 0  # white space at an end of a text leaves an empty piece
            found, of = distinct(pieces)
            number = np.fromiter((numbers[w] if w else 0 for w in found), np.uint32, len(found))
            n = np.diff(np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()])
            out = np.insert(number[of[real]], np.cumsum(n), np.uint32(numbers[end]))
            return out, n + 1

        return words

    numbered = number_words(rows, split, "lm-words", lambda numbers: BlockGrams(parts))
    words = materialise(dictionary(numbered).groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    known = words.filter("n > 0").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    n, v = known["n"] or 0, known["v"]
    sent = numbered.filter(F.col("grams").isNotNull()).select("part", "block", "grams", "gram_counts")
    tops = train_tops(sent)

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _part_rows(g)
        logs = log_probabilities(keys, counts, tops).astype("<f4")
        found = [zlib.compress(logs[np.searchsorted(keys, _keys(x))].tobytes(), 1) for x in g["grams"]]
        return pd.DataFrame({"block": g["block"], "grams": g["grams"], "logs": found})

    answers = sent.groupBy("part").applyInPandas(answer, "block long, grams binary, logs binary")

    def pack(g: pd.DataFrame) -> list[bytes]:
        return [zlib.compress(x, 1) for x in (g["n"].to_numpy("<i8").tobytes(), np.array([len(w) for w in g["word"]], "<i4").tobytes(), b"".join(g["word"]))]

    def use(docs: pd.DataFrame, places: np.ndarray, parts: list[list[bytes]], found: pd.DataFrame) -> pa.Table:
        count, words, at = np.zeros(len(places), np.int64), [b""] * len(places), 0
        for packed in parts:
            c, sizes, together = map(zlib.decompress, packed)
            ends = np.cumsum(np.frombuffer(sizes, "<i4"))
            mine = places[at : at + len(ends)]
            count[mine] = np.frombuffer(c, "<i8")
            for place, i, j in zip(mine, ends - np.frombuffer(sizes, "<i4"), ends):
                words[place] = together[i:j]
            at += len(ends)
        keys = np.concatenate([np.zeros(0, np.uint64), *map(_keys, found["grams"])])
        logs = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(zlib.decompress(x), "<f4") for x in found["logs"]]])
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order].astype(float)
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        out, texts, waiting, scores = [], [], 0, []

        def flush() -> None:
            nonlocal texts, waiting
            if texts:
                k, of = grams(texts)
                where, distinct = pd.factorize(k)
                scores.append(np.bincount(of, logs[np.searchsorted(keys, distinct)][where], len(texts)))
            texts, waiting = [], 0

        for w in map(unpack, docs["ids"]):
            texts.append(coded(list(map(words.__getitem__, w.tolist()))))
            waiting += len(texts[-1])
            out.append((len(w), int((count[w] > 0).sum()), n, float(base[w].sum()), len(texts[-1]) - DEPTH))
            if waiting >= AT_ONCE:
                flush()
        flush()
        table = pd.DataFrame(out, columns=["n_tokens", "n_known", "train_tokens", "base_score", "coded"])
        table["score"] = np.concatenate(scores)
        table["code_bits_per_byte"] = -table["score"] * np.log2(10) / table.pop("coded")
        table.insert(0, "held_out", ~docs["flag"].astype(bool).to_numpy())
        table.insert(0, "doc_id", ids_of(docs))
        return pa.Table.from_pandas(table, preserve_index=False)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, code_bits_per_byte double"
    return apply_values(numbered, words, pack, use, schema, answers, keep_word=True)
