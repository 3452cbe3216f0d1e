"""Source divergence, whitening and decontamination against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import decontamination, divergence, entries, whitening

from ..oracle import assert_same, connect
from .test_operators import frame, prose


@pytest.fixture(scope="module")
def docs():
    """Texts of few words, so that terms are kept; nulls, empty texts, repeated rows, a long text, a hot source, sources alone."""
    rng = random.Random(5)
    vocabulary = [prose(rng, 1) for _ in range(90)] + ["Ünd", "ÉTÉ", "don't", "x1y", "日本語"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    rows = [(i, text(rng.randint(0, 60)), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)]
    rows += [(200, None, "en", "a"), (201, "", "en", "d"), (202, "12 ... 34", "en", "e"), (None, text(30), "", ""), (203, text(4000), "en", "b"), (204, "rare words only", "xx", "a"), (205, "others", "xx", "b"), (206, "alone here", "yy", "a")]
    return rows + [(207, text(40), "en", "é")] * 12


def brute_audit(rows, least=10, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(terms(text))
        seen[lang].update(set(terms(text)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in seen[lang].items() if d >= least]
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}],
                     "term": [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                for rank, (v, item) in enumerate(sorted(items)[: None if part == "pair" else top], 1):
                    out.add((lang, s, part, item.decode(), -v, rank))
    return out


def test_audit_is_brute_force(spark, docs):
    got = [tuple(r) for r in divergence.audit_sources(frame(spark, docs).repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(docs)


def test_audit_in_small_pieces(spark, docs, monkeypatch):
    """Many parts, runs of pairs, flushes in the middle of a batch and of a text give the same."""
    for name, value in (("MOST_TERMS", 7), ("PIECE", 11), ("AT_ONCE", 16), ("PART_TERMS", 64), ("PART_CELLS", 64)):
        monkeypatch.setattr(divergence, name, value)
    assert {tuple(r) for r in divergence.audit_sources(frame(spark, docs), least_docs=2).collect()} == brute_audit(docs, least=2)


def test_bitmaps_hold_the_counts(spark, docs):
    df = frame(spark, docs).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    cells = divergence.kept_cells(divergence.count_terms(df)).cache()
    levels = divergence.count_levels(cells, divergence.group_totals(df, cells)).collect()
    bits = Counter()
    for r in levels:
        words = np.frombuffer(bytes(r["bits"]), "<u8")
        assert words[0] and words[-1] and 64 * (r["first"] + len(words)) < r["terms"] + 64
        bits[r["lang"], r["source"], r["n"]] += int(np.bitwise_count(words).sum())
    assert bits == Counter((r["lang"], r["source"], r["n"]) for r in cells.collect())


def test_audit_of_nothing(spark, docs):
    assert divergence.audit_sources(frame(spark, [])).count() == 0
    assert divergence.audit_sources(frame(spark, [(1, None, None, None)])).count() == 0


def test_terms_across_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    text = "Abcdefgh é日本x, y" + "z" * 20
    assert [t for piece in divergence.terms_of(text.encode()) for t in piece] == [t.encode() for t in ("abcdefgh", "é日本x", "y" + "z" * 20)]


# Whitening.


def vectors(rng, n, dims=6):
    rows = [(i, [float(x) for x in rng.normal(size=dims) @ np.diag(np.arange(1, dims + 1)) * 0.1], 1) for i in range(n)]
    return rows + [(1000 + i, rows[0][1], 2) for i in range(n // 2)] + [(1, rows[1][1], 3)] * 3


ODD = [(1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (4, [float("nan")] * 6, 1), (5, [float("inf")] + [0.0] * 5, 1), (6, [-float("inf")] + [0.0] * 5, 1)]


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_is_brute_force(spark, weights):
    rows = vectors(np.random.default_rng(3), 80) + [(None, [0.5, -0.25, 0.1, 0.0, 1 / 64, -1 / 64], 1)]
    table = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<float>, n int").withColumn("x", F.lit(1)).repartition(5)
    got = whitening.whiten(table, most=4, weights=weights).collect()
    ids = [r[0] for r in rows]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v, _ in rows], object)
    fit = x if weights == "count" else np.array([list(t) for t in {tuple(v) for v in x}], object)
    n, s = len(fit), fit.sum(0)
    centred = (fit.astype(float) - 1e6) - (np.array(s / n - 1000000, float))
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    y = ((x.astype(float) - 1e6) - np.array(s / n - 1000000, float)) @ v[:, :4] / np.sqrt(e[:4])
    sign = {}
    want = Counter((i, c + 1, n, int(((n * a - s) ** 2).sum()), round(abs(b[c]), 6)) for i, a, b in zip(ids, x, y) for c in range(4))
    assert want == Counter((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6)) for r in got)
    at = {i: b for i, b in zip(ids, y)}
    for r in got:
        b = at[r["vec_id"]][r["component"] - 1]
        if abs(b) > 1e-6:
            assert sign.setdefault(r["component"], np.sign(b * r["whitened"])) == np.sign(b * r["whitened"])
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([r[:2] for r in ODD], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, schema)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [i / 64, 1.0]) for i in range(5)], schema)).collect()
    assert len(flat) == 10 and all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in flat)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_large_deviations_are_exact(spark):
    rows = [(i, [float(i * 25_000), -float(i)]) for i in range(40)]
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((40 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert max(want.values()) > 2**60
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == want


# Decontamination.


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(6)
    items = [(str(i), prose(rng, 14)) for i in range(12)] + [("b", "Only, these four WORDS"), ("b", "Only, these four WORDS"), ("é", "word"), ("none", None), ("empty", " ... "), (None, prose(rng, 11)), ("10x", prose(rng, 10))]
    w = items[0][1].split()
    shared = [("s1", " ".join(w[:12]) + " end"), ("s2", "start " + " ".join(w[1:11]))]
    rows = [(i, prose(rng, rng.randint(0, 50)), "en", "a") for i in range(30)]
    rows += [(40 + i, f"{prose(rng, 9)} -- {t.upper() if i % 2 and t.isascii() else t}; {prose(rng, 5)} {t}", "en", "b") for i, (_, t) in enumerate(items) if t]
    rows += [(60, None, "en", "a"), (61, "", "en", "a"), (62, "?!", "en", "a"), (None, items[3][1], "en", "a"), (63, " ".join(w[:9]), "en", "a"), (64, " ".join([*w, *w[5:], *w[2:]]), "en", "a"), (65, prose(rng, 3000) + " only These, four\nwords " + prose(rng, 3000), "en", "c")]
    rows += [(66, items[5][1], "en", "a")] * 3 + [(66, "another text of this id, word", "en", "a")]
    return rows, items + shared


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, size=10):
    w = words_of(text)
    places, ids = set(), set()
    for item, t in items:
        b = words_of(t)
        n = min(size, len(b))
        for window in {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    places.update(range(i, i + n))
                    ids.add(item)
    return w, places, sorted(ids - {None})


def bench(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id string, text string, key string")


@pytest.mark.parametrize("keys", [decontamination.BROADCAST_KEYS, 3])
def test_contamination_is_brute_force(spark, leaks, monkeypatch, keys):
    monkeypatch.setattr(decontamination, "BROADCAST_KEYS", keys)
    rows, items = leaks
    want = Counter()
    for i, t, *_ in rows:
        w, places, ids = brute_hits(t, items)
        want[i, len(w), len(places), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(places)] += 1
    got = decontamination.contamination(frame(spark, rows).repartition(3), bench(spark, items)).drop("items")
    assert Counter(tuple(r) for r in got.collect()) == want


def test_one_length_of_windows(spark, leaks):
    rows, items = leaks[0], [x for x in leaks[1] if len(words_of(x[1])) >= 10]
    got = decontamination.contamination(frame(spark, rows), bench(spark, items)).collect()
    assert Counter((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in got) == Counter((i, len(p), tuple(ids)) for i, t, *_ in rows for _, p, ids in [brute_hits(t, items)])


def test_nothing_to_find(spark, leaks):
    rows, items = leaks
    got = decontamination.contamination(frame(spark, rows), bench(spark, [("a", None), ("b", "")])).collect()
    assert len(got) == len(rows) and not any(r["contaminated"] for r in got)
    assert decontamination.contamination(frame(spark, []), bench(spark, items)).count() == 0


def test_documents_and_spans_are_removed(spark, leaks):
    rows, items = leaks
    df = frame(spark, rows)
    left = decontamination.decontaminate(df, bench(spark, items))
    assert left.columns == df.columns
    assert Counter(r["text"] for r in left.collect()) == Counter(t for _, t, *_ in rows if not brute_hits(t, items)[1])
    cut = decontamination.decontaminate(df, bench(spark, items), remove="spans")
    assert cut.columns == df.columns

    def plain(text):
        _, places, _ = brute_hits(text, items)
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        drop = set()
        for i in places:
            drop.update(range(found[i].start(), found[i + 1].start() if i + 1 in places else found[i].end()))
        return text and "".join(c for k, c in enumerate(text) if k not in drop)

    assert Counter(r["text"] for r in cut.collect()) == Counter(plain(t) for _, t, *_ in rows)


def test_main_paths_are_native(spark, sf):
    for name in ("op13_decontamination",):
        plan = entries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op11_count_bitmaps", "op13_decontamination"])
def test_same_as_sql(spark, sf, name):
    assert_same(entries.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(entries.SQL[name]).df())
