"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte gets a language distribution from two recurrent passes, one from each side, over windows of WINDOW bytes; a
document's probabilities are its bytes' log-probabilities, summed, divided by the square root of their number (bytes of a
text aren't independent) and turned into a distribution again. Windows start from a zero state, so all windows of all texts of a batch advance side by side, one byte a step. The network is trained in
numpy by backpropagation through time on a bounded sample of labelled documents.

Edge cases: a null text or one without a letter is `und` with score 0; text that isn't a multiple of the window is padded
and the padding ignored; with no labelled row every document is `und`; repeated rows get equal results; an empty table
gives an empty result. Labels, sources and ids are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, id_remainder

WINDOW, HIDDEN = 64, 8
#: The training sample: at most so many documents a language, and windows a document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 4
UNKNOWN = "und"


def training_sample(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", most: int = SAMPLE_DOCS, seed: int = 7) -> list[tuple[str, list[bytes]]]:
    """(label, windows) of at most `most` documents for each label: SAMPLE_WINDOWS windows at most, from anywhere in the text.

    Documents and windows are chosen by hashes of id and text, so copies of a row count once and null ids are no matter. The
    counts of labels (a few rows) set the share of each label's hash range that is read, and ranks are taken within it, so
    that `most` rows a label, and of these only the windows, reach the driver.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), (F.xxhash64(F.col(key), F.col(text), F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)).alias("u"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("u").alias("n")).collect()}
    if not counts:
        return []
    limit = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, 2 * most / n + 20 / n))) for k, n in sorted(counts.items())])
    raw = F.encode("text", "UTF-8")
    places = F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda i: F.pmod(F.xxhash64("u", i), F.ceil(F.octet_length("text") / WINDOW)))
    windows = F.transform(F.array_distinct(places), lambda k: F.substring(raw, (k * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    few = rows.filter((F.col("u") < limit) & (F.octet_length("text") > 0)).groupBy("label", "u").agg(F.min(windows).alias("windows"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("u"))).filter(F.col("r") <= most)
    return [(r["label"], [bytes(w) for w in r["windows"]]) for r in sorted(few.collect(), key=lambda r: (r["label"], r["u"]))]


def _windows(text: bytes) -> np.ndarray:
    """Rows of WINDOW bytes; the last row is padded with zeros."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def train(sample: list[tuple[str, list[bytes]]], epochs: int = 12, batch: int = 64, rate: float = 0.01, hidden: int = HIDDEN, seed: int = 3) -> dict:
    """Fit the network: byte table and recurrent weights for each direction, and the output layer. Adam, fixed seed."""
    labels = sorted({a for a, _ in sample})
    rng = np.random.default_rng(seed)
    x, y = [], []
    for label, windows in sample:
        x += [_windows(w)[0] for w in windows]
        y += [labels.index(label)] * len(windows)
    x, y = np.array(x), np.array(y)
    h, k = hidden, len(labels)
    p = {}
    for d in ("f", "b"):
        p[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * h))
        p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        p[f"c{d}"] = np.zeros(h)
    p["V"], p["v"] = rng.normal(0, 0.3, (2 * h, k)), np.zeros(k)
    m, s, step = {n: np.zeros_like(a) for n, a in p.items()}, {n: np.zeros_like(a) for n, a in p.items()}, 0
    weight = 1.0 / np.maximum(np.bincount(y, minlength=k), 1)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            own = order[i : i + batch]
            g = _gradients(p, x[own], y[own], h, weight[y[own]] / weight[y[own]].sum())
            step += 1
            now = rate * (1 - epoch / epochs)
            for n in p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                s[n] = 0.999 * s[n] + 0.001 * g[n] ** 2
                p[n] -= now * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)
    return {n: a.astype(np.float32) for n, a in p.items()} | {"labels": labels}


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, h: int, weight: np.ndarray) -> dict:
    """Gradients of the cross entropy of every byte's label, by backpropagation through time."""
    n, T = x.shape
    state, kept = {}, {}
    for d in ("f", "b"):
        hs, cache, prev = np.zeros((T, n, h)), {}, np.zeros((n, h))
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a, u = p[f"E{d}"][x[:, t]], prev @ p[f"U{d}"]
            z, r = _sigmoid(a[:, :h] + u[:, :h]), _sigmoid(a[:, h : 2 * h] + u[:, h : 2 * h])
            inner = u[:, 2 * h :] + p[f"c{d}"]
            c = np.tanh(a[:, 2 * h :] + r * inner)
            cache[t] = (prev, z, r, inner, c)
            prev = hs[t] = z * prev + (1 - z) * c
        state[d], kept[d] = hs, cache
    both = np.concatenate([state["f"], state["b"]], 2)
    logits = both @ p["V"] + p["v"]
    q = np.exp(logits - logits.max(2, keepdims=True))
    q /= q.sum(2, keepdims=True)
    q[:, np.arange(n), y] -= 1
    q *= (weight[None, :] * (x.T > 0) / T)[:, :, None]
    g = {name: np.zeros_like(a) for name, a in p.items()}
    g["V"], g["v"] = np.einsum("tni,tnk->ik", both, q), q.sum((0, 1))
    up = q @ p["V"].T
    for d, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        carry = np.zeros((n, h))
        for t in range(T - 1, -1, -1) if d == "f" else range(T):
            prev, z, r, inner, c = kept[d][t]
            dh = up[t][:, cols] + carry
            dz, dc = dh * (prev - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            dr = dc * inner * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(g[f"E{d}"], x[:, t], np.concatenate([dz, dr, dc], 1))
            g[f"U{d}"] += prev.T @ du
            g[f"c{d}"] += (dc * r).sum(0)
            carry = dh * z + du @ p[f"U{d}"].T
    return g


def _states(net: dict, x: np.ndarray, d: str, out: np.ndarray) -> None:
    """Add the logits' part of direction `d` for bytes x (steps, rows) to out (steps, labels, rows)."""
    h = net["U" + d].shape[0]
    table, U, c, V = np.ascontiguousarray(net["E" + d].T), np.ascontiguousarray(net["U" + d].T), net["c" + d][:, None], np.ascontiguousarray(net["V"][:h].T if d == "f" else net["V"][h:].T)
    table[: 2 * h] *= 0.5
    U[: 2 * h] *= 0.5
    T, n = x.shape
    prev = np.zeros((h, n), np.float32)
    for t in range(T) if d == "f" else range(T - 1, -1, -1):
        a, u = np.take(table, x[t], axis=1), U @ prev
        gates = a[: 2 * h]
        gates += u[: 2 * h]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, cand = gates[:h], u[2 * h :]
        cand += c
        cand *= gates[h:]
        cand += a[2 * h :]
        np.tanh(cand, out=cand)
        prev -= cand
        prev *= z
        prev += cand
        out[t] += V @ prev


def predict(net: dict, texts: list[bytes]) -> np.ndarray:
    """Language probabilities (rows, labels) of texts: every byte is labelled, and the log-probabilities are pooled."""
    k, rows = len(net["labels"]), [_windows(t) for t in texts]
    n = np.array([len(r) for r in rows])
    x = np.concatenate(rows) if len(rows) else np.zeros((0, WINDOW), np.uint8)
    total = np.zeros((len(texts), k))
    of = np.repeat(np.arange(len(texts)), n)
    for i in range(0, len(x), 4096):
        part = np.ascontiguousarray(x[i : i + 4096].T).astype(np.intp)
        logits = np.repeat(np.broadcast_to(net["v"][None, :, None], (WINDOW, k, 1)), part.shape[1], axis=2).astype(np.float32)
        for d in ("f", "b"):
            _states(net, part, d, logits)
        logits -= np.log(np.exp(logits - (top := logits.max(1, keepdims=True))).sum(1, keepdims=True)) + top
        logits *= (part > 0)[:, None, :]
        each = logits.sum(0)
        for j in range(k):
            total[:, j] += np.bincount(of[i : i + 4096], each[j], len(texts))
    size = np.array([max(1, len(t)) for t in texts])
    p = np.exp((total - total.max(1, keepdims=True)) / np.sqrt(size)[:, None]) if len(texts) else total
    return p / p.sum(1, keepdims=True) if len(texts) else p


def identify(docs: DataFrame, net: dict, text: str = "text", found: str = "found") -> DataFrame:
    """`docs` with found (lang_pred, score from 0 to 1). `net` is of fixed size and travels with the function; only texts go to Python."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b]
            known = [bool(net["labels"]) and any(map(str.isalpha, t)) for t in texts]
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            own = [i for i, ok in enumerate(known) if ok]
            for lo in range(0, len(own), 512):
                some = own[lo : lo + 512]
                p = predict(net, [texts[i].encode("utf-8") for i in some])
                for i, j, s in zip(some, p.argmax(1), p.max(1)):
                    pred[i], score[i] = net["labels"][j], float(s)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    # A function that may differ from call to call isn't called again for a filter on its result.
    return docs.withColumn(found, run.asNondeterministic()(F.col(text)))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", folds: int = 5) -> dict:
    """The network, from documents whose id isn't held out."""
    sample = training_sample(docs.filter(id_remainder(F.col(key), folds) != 0), text, label, key)
    return train(sample) if sample else {"labels": []}


def predict_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text."""
    net = fit(docs, key, text, label, folds)
    rows = docs.select(F.col(key).alias("doc_id"), (id_remainder(F.col(key), folds) == 0).alias("held_out"), F.col(text).alias("text"))
    return identify(rows, net).select("doc_id", "held_out", "found.lang_pred", "found.score")


def reject_unknown(docs: DataFrame, text: str = "text", least: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` in a language that the network knows (score of at least `least`), columns unchanged."""
    net = fit(docs, text=text, **options)
    known = (F.col("__fs_found.lang_pred") != UNKNOWN) & (F.col("__fs_found.score") >= least)
    return identify(docs, net, text, "__fs_found").filter(known).select(*columns_of(docs))
