"""The training-data operators against brute force, libraries and edge cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from fieldspark.llm import bpe, fingerprint, html, jaccard, langid, lm, mixing, orcids, quality, sharding

WS = b" \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, block long, ids string, run string, h string, label string, n_words string, target string, kept string, cut string"


def frame(spark, rows, schema=SCHEMA):
    """(doc_id, text, lang, source) rows, with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, "w", 1, "i", "r", "h", "l", "n", "t", "k", "c") for r in rows], schema)


def prose(rng, n, syllables=("an", "ther", "ing", "ou", "é", "st", "re")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty, white space, ties, repeated rows, near copies, a very long text, a very long word."""
    rng = random.Random(1)
    base = prose(rng, 120)
    rows = [(None, "no id here " * 5, "en", "a"), (1, None, "en", None), (2, "", None, "a"), (3, " \n\t ", "en", "a"), (4, "12 34 !!", "en", "b"), (5, "one two", "de", "b"), (6, "One TWO", "de", "b")]
    rows += [(7, "same row", "en", "c")] * 3 + [(10 + i, base, "en", "c") for i in range(4)]
    words = base.split()
    for i in range(4):
        w = list(words)
        w[10 + 20 * i] = f"changed{i}"
        rows.append((20 + i, " ".join(w), "en", "c"))
    rows += [(30, prose(rng, 6000), "fr", "d"), (31, "x" * 3000, "en", "d"), (32, "a  b\n\n c d it's 1,234 ñandú 日本", "es", "e")]
    rows += [(40 + i, prose(rng, 30 + i), rng.choice(["en", "de"]), rng.choice("abcde")) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def tokens(text):
    return (text or "").encode().split()


# 1. Quality rules.


def repeated(words, w=8):
    seen = defaultdict(list)
    for i in range(len(words) - w + 1):
        seen[tuple(words[i : i + w])].append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + w)})


def test_features_are_brute_force(spark, odd_rows):
    rng = random.Random(4)
    rows = odd_rows + [(900, "a b c d e f g h i " * 5 + "tail\n" * 4, "en", "z"), (901, " ".join(rng.choice("ab") for _ in range(300)), "en", "z"), (902, "x | y # z\nx | y # z\n\n\n", "en", "z")]
    got = Counter(tuple(r) for r in quality.document_features(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for i, t, *_ in rows:
        t, w = t or "", tokens(t)
        lines = [x for x in t.split("\n") if x.encode().split()]
        want[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated(w)] += 1
    assert got == want


def test_hosts_are_judged(spark):
    good, bad = prose(random.Random(2), 50), "word | word | # # " * 9
    rows = [(i, good if i % 10 else bad, "en", "fine") for i in range(60)] + [(100 + i, bad if i % 8 else good, "en", "junk") for i in range(60)] + [(200, good, "en", None)]
    out = {r["doc_id"]: r for r in quality.judge(quality.document_features(frame(spark, rows))).collect()}
    assert out[1]["kept"] and not out[0]["kept"] and not out[100]["kept"] and out[100]["host_rejected"] and out[200]["kept"]
    kept = quality.reject_documents(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


# 2. Context-tree weighting.


def ctw_bits(train, text, depth):
    """log2 of the probability of a text's bytes, by direct recursion over stored nodes."""
    counts = defaultdict(lambda: [0, 0])
    lead = b"\0" * (depth - 1) + b" "
    for t in train:
        b = lead + t
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                c, node = b[i - d : i], 1
                for k in range(7, -1, -1):
                    bit = b[i] >> k & 1
                    counts[c, node][bit] += 1
                    node = node * 2 + bit
    children = defaultdict(list)
    for c, node in counts:
        if c:
            children[c[1:], node].append((c, node))
    weighted = {}
    kt = lambda a, b: float(lm.log_kt(np.array([float(a)]), np.array([float(b)]))[0])
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        weighted[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(weighted[c] for c in children[key])) - np.log(2)
    total, b = 0.0, lead + text
    for i in range(depth, len(b)):
        node = 1
        for k in range(7, -1, -1):
            bit, p = b[i] >> k & 1, None
            for d in range(depth, -1, -1):
                key = (b[i - d : i], node)
                a = counts.get(key, [0, 0])
                if sum(a) or d == 0:
                    own = (a[bit] + 0.5) / (sum(a) + 1)
                    stop = 1.0 if d == depth else np.exp(kt(*a) - np.log(2) - weighted.get(key, 0.0))
                    p = own if p is None else stop * own + (1 - stop) * p
            total += np.log2(p)
            node = node * 2 + bit
    return total


def test_scores_are_context_tree_weighting(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 12, ("an", "th", "e")), "en", "s") for i in range(14)] + [(50, None, "en", "s")]
    got = {r["doc_id"]: r for r in lm.score_documents(frame(spark, rows)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    norm = lambda t: b" ".join([*tokens((t or "").lower()), b"\n"])
    train = [norm(t) for i, t, *_ in rows if not held(i)]
    count = Counter(w for i, t, *_ in rows if not held(i) for w in [*tokens((t or "").lower()), b"\n"])
    N, V = sum(count.values()), len(count)
    for i, t, *_ in rows:
        w = [*tokens((t or "").lower()), b"\n"]
        assert got[i]["held_out"] == held(i) and got[i]["train_tokens"] == N and got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(x in count for x in w)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((count[x] + 0.1) / (N + 0.1 * (V + 1))) for x in w))
        assert got[i]["score"] == pytest.approx(ctw_bits(train, norm(t), lm.DEPTH) * np.log10(2), rel=1e-4)


# 3. Language identification.


def test_gradients_are_numeric():
    rng = np.random.default_rng(0)
    h, k = 3, 2
    p = {"Ef": rng.normal(size=(256, 9)), "Uf": rng.normal(size=(3, 9)), "cf": rng.normal(size=3), "Eb": rng.normal(size=(256, 9)), "Ub": rng.normal(size=(3, 9)), "cb": rng.normal(size=3), "V": rng.normal(size=(6, k)), "v": np.zeros(k)}
    x, y, w = rng.integers(1, 4, (2, 5)).astype(np.uint8), np.array([0, 1]), np.array([0.5, 0.5])

    def loss():
        g = 0.0
        for n in range(2):
            states = {}
            for d in ("f", "b"):
                prev, out = np.zeros(h), {}
                for t in range(5) if d == "f" else range(4, -1, -1):
                    a, u = p["E" + d][x[n, t]], prev @ p["U" + d]
                    z, r = 1 / (1 + np.exp(-(a + u)[:h])), 1 / (1 + np.exp(-(a + u)[h : 2 * h]))
                    c = np.tanh(a[2 * h :] + r * (u[2 * h :] + p["c" + d]))
                    prev = out[t] = z * prev + (1 - z) * c
                states[d] = out
            for t in range(5):
                l = np.concatenate([states["f"][t], states["b"][t]]) @ p["V"] + p["v"]
                g -= w[n] / 5 * (l[y[n]] - np.log(np.exp(l).sum()))
        return g

    g = langid._gradients(p, x, y, h, w)
    for name, at in (("Ef", (1, 4)), ("Uf", (2, 7)), ("cb", (1,)), ("Eb", (2, 8)), ("Ub", (0, 3)), ("V", (4, 1)), ("v", (1,))):
        before = p[name][at]
        p[name][at] = before + 1e-5
        up = loss()
        p[name][at] = before - 1e-5
        down = loss()
        p[name][at] = before
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-9)


def test_sample_of_copies_and_null_ids(spark):
    """A table whose ids are all null, with one text in most rows: the sample holds different texts, and no more than asked for."""
    rows = [(None, "the same text again " * 9, "en", "a")] * 900 + [(None, f"a text of its own {i} " * 9, k, "a") for i in range(400) for k in ("en", "de")] + [(7, "ein Text " * 30, "de", "a")] * 600
    sample = langid.training_sample(frame(spark, rows), most=50)
    assert {k: sum(1 for x, _ in sample if x == k) for k in ("de", "en")} == {"de": 50, "en": 50}
    assert sum(1 for _, w in sample if w[0].startswith((b"the same", b"again", b"text again"))) <= 1


def test_prediction_is_the_plain_network():
    """predict() against one byte after the other in float64, windows apart."""
    rng, h, k = np.random.default_rng(1), 4, 3
    net = {f"{n}{d}": rng.normal(size=s) for d in "fb" for n, s in (("E", (256, 3 * h)), ("U", (h, 3 * h)), ("c", h))} | {"V": rng.normal(size=(2 * h, k)), "v": rng.normal(size=k)}
    net = {n: a.astype(np.float32) for n, a in net.items()} | {"labels": ["x", "y", "z"]}
    texts = [b"a", "é ñandú ".encode() * 20, b"z" * langid.WINDOW, bytes(range(1, 200)) * 3]

    def plain(text):
        total = np.zeros(k)
        for lo in range(0, len(text), langid.WINDOW):
            w = list(text[lo : lo + langid.WINDOW].ljust(langid.WINDOW, b"\0"))
            states = {}
            for d in "fb":
                prev, states[d] = np.zeros(h), {}
                for t in range(len(w)) if d == "f" else range(len(w) - 1, -1, -1):
                    a, u = net["E" + d][w[t]].astype(float), prev @ net["U" + d].astype(float)
                    z, r = 1 / (1 + np.exp(-(a + u)[:h])), 1 / (1 + np.exp(-(a + u)[h : 2 * h]))
                    c = np.tanh(a[2 * h :] + r * (u[2 * h :] + net["c" + d]))
                    prev = states[d][t] = z * prev + (1 - z) * c
            for t in range(len(text[lo : lo + langid.WINDOW])):
                l = np.concatenate([states["f"][t], states["b"][t]]) @ net["V"] + net["v"]
                total += l - np.log(np.exp(l).sum())
        p = np.exp((total - total.max()) / np.sqrt(len(text)))
        return p / p.sum()

    assert np.allclose(langid.predict(net, texts), [plain(t) for t in texts], atol=1e-4)


def test_training_reads_whole_texts(spark):
    """Languages that differ only after a long common beginning are learned; no window is longer than WINDOW."""
    rng = random.Random(3)
    rows = [(i, "common words " * 400 + prose(rng, 3000, {"xx": ("an", "ther"), "yy": ("ué", "ión")}[k]), k, "s") for i in range(40) for k in ["xx" if i % 2 else "yy"]]
    sample = langid.training_sample(frame(spark, rows))
    assert len(sample) == 40 and all(1 <= len(w) <= langid.SAMPLE_WINDOWS and all(0 < len(x) <= langid.WINDOW for x in w) for _, w in sample)
    texts = {t.encode() for _, t, *_ in rows}
    late = [x for _, ws in sample for x in ws if b"common" not in x]
    assert len(late) > 60 and all(any(x in t for t in texts) for x in late)


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pred = langid.predict_documents(docs).filter("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id")
    r = pred.filter("lang IS NOT NULL AND lang_pred <> 'und'").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("ok")).first()
    assert r["n"] > 50 and r["ok"] > 0.9


def test_languages_are_told_apart(spark, empty):
    rng = random.Random(6)
    kinds = {"xx": ("an", "ther", "ing"), "yy": ("ué", "ión", "ar"), "zz": ("sch", "ver", "ü")}
    rows = [(i, prose(rng, 60, kinds[k]), k, "s") for i in range(240) for k in [rng.choice(list(kinds))]] + [(900, None, "xx", "s"), (901, "123 456", "yy", "s"), (902, "", None, None)]
    got = {r["doc_id"]: r for r in langid.predict_documents(frame(spark, rows)).collect()}
    held = [r for r in rows[:240] if got[r[0]]["held_out"]]
    assert len(held) > 20 and np.mean([got[i]["lang_pred"] == k for i, _, k, _ in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert langid.predict_documents(empty).count() == 0


# 4. HTML.


def test_main_text(spark):
    page = lambda n: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class='promo-box'>Buy</div><div><p>All pages say this.</p><p>Body {n} &amp; more<br>text <b>bold<p>Second&nbsp;block {n} <script>var a='</p>'</script>end</div><form>Mail</form><div id=comments><p>Nice</p></div><footer>(c)</footer></body></html>"
    rows = [(i, "http://h.example/%d" % i, page(i)) for i in range(8)] + [(100, None, None), (101, "http://z/", ""), (102, "http://h.example/x", "<p>cut off <a hre"), (103, "http://w/", "<header>top</header><article><header><h1>Title</h1></header><p>Only</article><p>after")]
    got = {r["page_id"]: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Body 3 & more text bold\n\nSecond block 3 end" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"] == "" and got[101]["text"] == "" and got[102]["text"] == "cut off" and got[103]["text"] == "Title\n\nOnly"
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_is_of_different_pages(spark):
    """A text on two of four pages stays; so does an article of which most of the host's pages are copies or near copies."""
    body = lambda *ps: "<body><div>" + "".join(f"<p>{p}</p>" for p in ("Same on all.", *ps)) + "</div></body>"
    rows = [(i, "http://four/%d" % i, body(f"Own {i} a", f"Own {i} b", *(["On two"] if i < 2 else []))) for i in range(4)]
    article = [f"Paragraph {k}" for k in range(20)]
    rows += [(100 + i, "http://copied/%d" % i, body(*article)) for i in range(10)]
    rows += [(200 + i, "http://copied/n%d" % i, body(*article[:i], f"changed {i}", *article[i + 1 :])) for i in range(10)]
    rows += [(300 + i, "http://copied/o%d" % i, body(f"Other {i} a", f"Other {i} b")) for i in range(5)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[0] == ["Own 0 a", "Own 0 b", "On two"] and got[2] == ["Own 2 a", "Own 2 b"]
    assert all(got[100 + i] == article for i in range(10))
    assert all(got[200 + i] == [*article[:i], f"changed {i}", *article[i + 1 :]] for i in range(10))
    assert all(got[300 + i] == [f"Other {i} a", f"Other {i} b"] for i in range(5))


def test_names_of_content_stay(spark):
    """Classes that hold a telling word beside others are content, as is one that holds all the page's text; telling names go."""
    rows = []
    for i in range(6):
        own = [f"First {i} of the page", f"Second {i} of the page"]
        for k, (open_, close) in enumerate((("<div class='social-science'>", "</div>"), ("<div id='market-share'>", "</div>"), ("<article><div class='related-work'>", "</div></article>"), ("<div class='notice'>", "</div>"), ("<section class='SearchTheory'>", "</section>"))):
            rows.append((10 * k + i, f"http://names{k}/{i}", f"<body><div class='ad-slot-{i}'>Buy {i}</div><div id='cookieNotice'>Take {i}</div>{open_}<p>{own[0]}</p><p>{own[1]}</p>{close}<div class='comment-list'>Nice {i}</div></body>"))
    rows.append((100, "http://bare/", "<body><div class='advert'>Buy this</div></body>"))
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got.pop(100) == "" and len(got) == 30
    assert all(t == f"First {i % 10} of the page\n\nSecond {i % 10} of the page" for i, t in got.items() if i < 30 or i >= 40)
    assert all(f"First {i % 10} of the page\n\nSecond" in t and "Buy" not in t and "Nice" not in t for i, t in got.items())


def test_small_hosts_lose_what_all_pages_have(spark):
    """Menus without telling classes go from hosts of two and three pages as from one of eight; what differs, or what a page has alone, stays."""
    rows = []
    for n in (1, 2, 3, 8):
        for i in range(n):
            menu, foot = "".join(f"<div>{x}</div>" for x in ("Home", "Products", "About us", "Jobs", "Press", "Contact")), "<div class=q3>All rights reserved</div>"
            rows.append((10 * n + i, f"http://of{n}/{i}", f"<html><body><div class=q1>{menu}</div><div class=q2><p>Text {n} {i} that is longer than the menu</p><p>More of {n} {i}, too</p></div>{foot}</body></html>"))
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[10 * n + i] == f"Text {n} {i} that is longer than the menu\n\nMore of {n} {i}, too" for n in (2, 3, 8) for i in range(n))
    assert got[10].startswith("Home\n\nProducts")


def brute_extraction(pages):
    """Texts of pages given as nested [label, texts, children] of one host: a text is template if enough of the pages it is aligned with have it.

    Alignment here is by the path of labels, which on generated pages (each label once below its parent) is the largest matching.
    """

    def walk(t, path=()):
        path += (t[0],)
        yield from ((path, x) for x in t[1])
        for c in t[2]:
            yield from walk(c, path)

    found = [list(walk(p)) for p in pages]
    out = []
    for k, own in enumerate(found):
        others = [set(f) for n, f in enumerate(found) if n != k and [x for _, x in f] != [x for _, x in own]]
        keep = [x for path, x in own if sum((path, x) in o for o in others) < min(html.LEAST_PAGES, len(found)) - 1]
        out.append("\n\n".join(keep or [x for _, x in own]))
    return out


def test_extraction_is_brute_force(spark):
    """Generated hosts of two to nine pages of one layout, with template and own texts in every node."""
    rng = random.Random(31)
    rows, want = [], {}
    for host in range(25):
        labels = iter(range(1000))

        def layout(depth):
            kind = rng.choice(["template", "own", "both", "none"])
            return (f"n{next(labels)}", kind, [layout(depth - 1) for _ in range(rng.randrange(3))] if depth else [])

        root = ("root", "own", [layout(3) for _ in range(4)])

        def page(t, i):
            texts = [f"Template of {host} {t[0]}"] * (t[1] in ("template", "both")) + [f"Page {i} of {host} says {t[0]} at some length, so that pages differ."] * (t[1] in ("own", "both"))
            return [t[0], texts, [page(c, i) for c in t[2]]]

        def write(t):
            return f"<div class={t[0]}>" + "".join(f"<br>{x}<hr>" for x in t[1]) + "".join(map(write, t[2])) + "</div>"

        pages = [page(root, i) for i in range(rng.randint(2, 9))]
        for i, text in enumerate(brute_extraction(pages)):
            want[100 * host + i] = text
            rows.append((100 * host + i, f"https://u@Host{host}.example:80/{i}", f"<body>{write(pages[i])}</body>"))
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


def test_every_layout_has_references(spark):
    """Each of 12 layouts of a host has a text of its own that is template, with pages of one shape and of several."""
    rows = []
    for k in range(12):
        for i in range(6):
            more = "".join(f"<div class=x{i}><p>Part {k} {i} {n}</p></div>" for n in range(i)) if k % 2 else ""
            rows.append((k * 100 + i, f"http://many/{k}/{i}", f"<html><body><div class=l{k}><div class=t{k}><p>Of layout {k}</p></div><div class=c{k}><p>First {k} {i}</p><p>Second {k} {i}</p>{more}</div></div></body></html>"))
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == 72
    for k in range(12):
        for i in range(6):
            assert got[k * 100 + i].split("\n\n")[:2] == [f"First {k} {i}", f"Second {k} {i}"] and "Of layout" not in got[k * 100 + i]


def test_simple_tree_matching():
    a = [(0, "r"), (1, "x"), (2, "p"), (1, "y"), (1, "z")]
    b = [(0, "r"), (1, "w"), (1, "x"), (2, "q"), (2, "p"), (1, "z")]
    assert html.match(a, b) == [0, 2, 4, -1, 5]
    assert html.match(a, [(0, "s")]) == [-1] * 5


def largest_matching(a, b):
    """The number of nodes of a largest simple tree matching, by plain recursion over nested trees."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + largest_matching(x, y))
    return best[-1][-1] + 1


def test_matching_is_largest_on_random_trees():
    rng = random.Random(21)

    def tree(depth):
        return (rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else [])

    def flat(t, d=0):
        return [(d, t[0]), *[x for c in t[1] for x in flat(c, d + 1)]]

    found = {True: 0, False: 0}
    for _ in range(300):
        a, b = ("r", [tree(3) for _ in range(3)]), ("r", [tree(3) for _ in range(3)])
        s, t = flat(a), flat(b)
        up = lambda f: [next((k for k in range(i - 1, -1, -1) if f[k][0] == d - 1), -1) for i, (d, _) in enumerate(f)]
        ua, ub = up(s), up(t)
        for most in (html.MOST_WORK, 0):
            m = html.match(s, t, most)
            own = [(i, j) for i, j in enumerate(m) if j >= 0]
            assert all(s[i] == t[j] for i, j in own) and [j for _, j in own] == sorted({j for _, j in own}) and all(i == 0 or m[ua[i]] == ub[j] for i, j in own)
            most_of_all = largest_matching(a, b)
            assert len(own) == most_of_all if most else len(own) <= most_of_all
            found[bool(most)] += len(own)
    assert found[False] >= 0.7 * found[True], found


def test_long_rows_match_as_far_as_they_can():
    """Rows of unlike siblings beyond the exact matching's steps: as many matches as the exact one has, and at once for 20,000 siblings."""
    rng = random.Random(3)
    row = lambda n: [(0, "r"), *[(1, rng.choice("abcdefgh")) for _ in range(n)]]
    for n in (0, 1, 7, 60, 300):
        a, b = row(n), row(n)
        near = [x for x in a if x[0] == 0 or rng.random() > 0.05]
        for other in (b, near):
            m = html.match(a, other, 0)
            own = [(i, j) for i, j in enumerate(m) if j >= 0]
            assert all(a[i] == other[j] for i, j in own) and [j for _, j in own] == sorted({j for _, j in own})
            assert len(own) == sum(j >= 0 for j in html.match(a, other, 10**9))
    a = row(20_000)
    b = [x for x in a if x[0] == 0 or rng.random() > 0.02]
    assert sum(j >= 0 for j in html.match(a, b)) == len(b)


def test_deep_and_wide_pages(spark):
    """5,000 nested blocks, 20,000 siblings that alternate, and a host without telling classes, within seconds."""
    deep = "<div>" * 5000 + "<p>Deep text" + "</div>" * 5000
    wide = lambda i: "<body>" + "".join(f"<p>P {i} {k}</p><div>D {i} {k}</div>" for k in range(10_000)) + "</body>"
    rows = [(i, "http://deep/", deep) for i in range(5)] + [(10 + i, "http://wide/", wide(i)) for i in range(5)]
    menu = "<div class=q1><div>Start</div><div>Shop</div></div>"
    rows += [(30 + i, "http://plain/%d" % i, f"<html><body>{menu}<div class=q2><p>Text {i} one</p><p>Text\u200b {i}\u00a0two</p></div><div class=q3>All rights kept</div></body></html>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got[0] == "Deep text" and got[10].count("\n\n") == 19_999 and got[14].startswith("P 4 0\n\nD 4 0\n\nP 4 1")
    assert got[33] == "Text 3 one\n\nText\u200b 3 two"


# 5. Sharding.


def test_shards(spark, odd, odd_rows, empty):
    rows = odd_rows + [(2000 + i, "hot " * 30, "en", "a") for i in range(200)]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    slots, load, where = defaultdict(list), Counter(), defaultdict(set)
    for r in sorted(got, key=lambda r: r["slot"]):
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = zlib.crc32(b"hot " * 30)
    assert all(len(s) == 1 for (crc, _), s in where.items() if crc != hot)
    for s in slots:  # slots follow the curve
        curve = [r["curve"] for r in sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])]
        assert curve == sorted(curve)
    assert sharding.shard_documents(empty).count() == 0


def test_shards_are_balanced(spark):
    """Near-equal bytes, with a hot text of many bytes, one of most rows and few bytes, and a long text among others."""
    rng = random.Random(17)
    rows = [(i, prose(rng, rng.randint(20, 60)), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}") for i in range(3000)]
    rows += [(10_000 + i, None if i % 2 else "", "en", "a") for i in range(9000)] + [(30_000 + i, "hot text " * 20, "en", "b") for i in range(600)] + [(50_000, prose(rng, 2000), "fr", "c")]
    got = sharding.shard_documents(frame(spark, rows).repartition(7)).collect()
    load, empty_in, curve = Counter(), set(), defaultdict(list)
    for r in sorted(got, key=lambda r: r["slot"]):
        load[r["shard"]] += r["size"]
        curve[r["shard"]].append(r["curve"])
        if r["size"] == 1:
            empty_in.add(r["shard"])
    share = sum(load.values()) / 8
    assert len(got) == len(rows) and len(load) == 8 and len(empty_in) == 1
    assert max(abs(x - share) for x in load.values()) <= share / 32
    assert all(c == sorted(c) for c in curve.values())


def test_hilbert_is_a_curve():
    n = 8
    x = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(n)] * 3, indexing="ij")])
    i = sharding.hilbert_index(x, 3)
    assert sorted(i) == list(range(n**3))
    steps = np.abs(np.diff(x[:, np.argsort(i)], axis=1)).sum(0)
    assert (steps == 1).all()


# 6. Jaccard join.


def jaccard_components(rows):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w := [x.lower() for x in tokens(t)]) >= 5 else frozenset([tuple(w)] if w else [])) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    first = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            first[find(k)].append(i)
    return Counter((i, len(s), min(first[find(k)], default=None)) for k, (i, s) in enumerate(sets))


def test_components_are_brute_force(spark, odd_rows):
    rng = random.Random(8)
    rows = list(odd_rows)
    passage = prose(rng, 60)
    rows += [(300 + i, prose(rng, 25) + " " + passage + " " + prose(rng, 25), "en", "p") for i in range(25)]
    seed = prose(rng, 90).split()
    for i in range(40):  # near copies of near copies
        seed = list(seed)
        seed[rng.randrange(90)] = f"w{rng.randrange(10**6)}"
        rows.append((500 + i, " ".join(seed), "en", "q"))
    got = Counter(tuple(r) for r in jaccard.components(frame(spark, rows).repartition(5)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_components(rows)


def test_groups_open_for_sizes_between(spark):
    """A group is opened if a member of any size in its range can be similar enough, as one of 109 in 108 to 110 is for 100 and 6 tokens."""
    up = lambda x, d: -(-x // d)
    can = lambda c, q, n: 80 * q <= 100 * n and 80 * n <= 100 * q and c + max(up(80 * q, 100), up(80 * n, 100)) - 1 >= up(80 * (q + n), 180)
    assert [can(6, 100, n) for n in (108, 109, 110)] == [False, True, False]
    rows = [(c, q, low, high) for q in (13, 57, 100, 101) for c in range(1, 13) for low in range(up(80 * q, 100) - 1, 100 * q // 80 + 2) for high in range(low, 100 * q // 80 + 2)]
    df = spark.createDataFrame(rows, "c long, nq long, low long, high long")
    got = {tuple(r)[:4]: r["o"] for r in df.withColumn("o", jaccard._opens(*[F.col(x) for x in ("c", "nq", "low", "high")])).collect()}
    assert all(got[r] for r in rows if any(can(r[0], r[1], n) for n in range(r[2], r[3] + 1))) and got[6, 100, 108, 110] and not all(got.values())


def test_links_at_the_bound(spark):
    """Sets of 21, 22, 24 and 25 shingles, pairs of exactly 0.8 among them, documents in partitions of their own."""
    rng = random.Random(11)
    rows = []
    for k in range(12):
        w = [f"{rng.randrange(10**9)}" for _ in range(60)]
        text = lambda n, at: " ".join(w[at : at + n + 4])
        rows += [(10 * k, text(20, 5), "en", "s"), (10 * k + 1, text(25, 0), "en", "s"), (10 * k + 2, text(25, 4), "en", "s"), (10 * k + 3, text(21, 3), "en", "s"), (10 * k + 4, text(22, 7), "en", "s"), (10 * k + 5, text(24, 9), "en", "s")]
    rng.shuffle(rows)
    want = jaccard_components(rows)
    assert len({c for _, _, c in want}) < len(rows)
    got = Counter(tuple(r) for r in jaccard.components(frame(spark, rows).repartition(24)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want


def test_frequent_tokens_keep_links(spark, monkeypatch):
    """With every shared token frequent and none rare, and with the other way round, the components are the same."""
    rng = random.Random(12)
    passage = prose(rng, 80)
    rows = [(i, prose(rng, 8 + i % 9) + " " + passage + " " + prose(rng, 8), "en", "p") for i in range(60)]
    base = prose(rng, 100).split()
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(100)] = f"w{rng.randrange(9)}"
        rows.append((100 + i, " ".join(w), "en", "q"))
    want = jaccard_components(rows)
    for rare in (0, 3, 10**6):
        monkeypatch.setattr(jaccard, "RARE", rare)
        got = Counter(tuple(r) for r in jaccard.components(frame(spark, rows).repartition(6)).select("doc_id", "n_shingles", "component_id").collect())
        assert got == want, rare


def test_ids_stay_integers(spark):
    """Ids over 2^53 beside a null id, through every operator that carries ids in Python."""
    big = 2**53 + 1
    rows = [(big, prose(random.Random(1), 30), "en", "a"), (None, "no id", "en", "a"), (big + 2, None, "en", "a")]
    docs = frame(spark, rows).coalesce(1)
    want = {big, None, big + 2}
    assert {r["doc_id"] for r in jaccard.components(docs).collect()} == want
    assert {r["doc_id"] for r in lm.score_documents(docs).collect()} == want
    assert {r["doc_id"] for r in bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()} == want
    assert {r["doc_id"] for r in orcids.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).collect()} == want
    assert {r["doc_id"] for r in langid.predict_documents(docs).collect()} == want
    pages = spark.createDataFrame([(big, "u", "<p>x"), (None, "u", "<p>y")], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html.extract_pages(pages).collect()} == {big, None}


def test_one_of_each_group_stays(spark, odd, odd_rows, empty):
    kept = jaccard.keep_one(odd)
    want = {c for (i, n, c) in jaccard_components(odd_rows) if i is not None and n} | {i for i, t, *_ in odd_rows if not tokens(t)}
    got = Counter(r["doc_id"] for r in kept.collect())
    assert set(got) - {None} == want and max(got.values()) == 1 and kept.columns == odd.columns
    assert jaccard.components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_null_and_repeated_ids_are_told_apart(spark):
    """Near copies without an id go; texts that share an id with others, but have no copy, stay."""
    rng = random.Random(5)
    base = prose(rng, 200).split()
    near = lambda i: " ".join([*base[:i], f"new{i}", *base[i + 1 :]])
    rows = [(5, near(40), "en", "a"), (None, near(10), "en", "a"), (None, near(60), "en", "a"), (5, "another text of id five that has no copy at all", "en", "a"), (9, near(20), "en", "a"), (9, "and another text of id nine that has no copy", "en", "a"), (7, "one row twice in the table with the same id", "en", "a"), (7, "one row twice in the table with the same id", "en", "a")]
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(frame(spark, rows).repartition(3)).collect())
    assert got == Counter([(5, rows[0][1]), (5, rows[3][1]), (9, rows[5][1]), (7, rows[6][1])])


# 7. Byte-level BPE.


def test_ids_are_tiktokens(spark, odd, odd_rows, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter(tuple(r) for r in bpe.encode_documents(odd, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_long_words_are_tiktokens(spark):
    """Words of many cuts, with seams inside pieces, runs of one letter, and letters that never merge."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    some = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    texts = [some("abcdefghijklmnopqrstuvwxyz", 50_000), "a" * 9001, "ab" * 4000, "aaab" * 2000, "=" * 3000, some(["the", "ing", "tion", "ñ", "an"], 3000), some([chr(0x4E00 + i) for i in range(2000)], 1500)]
    texts += [some("ab", rng.randint(60, 140)) for _ in range(60)] + [some(["an", "ther", "é", "st"], rng.randint(15, 70)) for _ in range(60)]
    got = bpe.encode_documents(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), path, public_tokenizers.PATTERN, keep_ids=True).cache()
    assert {r["doc_id"]: list(r["ids"]) for r in got.collect()} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    back = got.select("doc_id", bpe.decode_ids(F.col("ids"), bpe.piece_list(ranks)).alias("b")).collect()
    assert {r["doc_id"]: bytes(r["b"]).decode() for r in back} == dict(enumerate(texts))


def test_splitter_is_the_pattern():
    import pyarrow as pa
    import regex

    rng = random.Random(9)
    parts = ["a", "été", "Word", "42", "'s", "it's", ",", "...", "!", " ", " ", " ", "  ", "   ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\x0b", "日本", "x1", "don't", "end.", "²", "½", "_", "\U0001f600"]
    texts = ["", " ", "a", " a", "a "] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)] + [" ".join(rng.choice(parts[:9]) for _ in range(8)) for _ in range(500)]
    numbers = bpe.Numbers()
    flat, n = bpe.pattern_words(public_tokenizers.PATTERN)(numbers)(pa.array(texts))
    names, find = list(numbers), regex.compile(public_tokenizers.PATTERN).findall
    for t, own in zip(texts, np.split(flat, np.cumsum(n)[:-1])):
        assert [names[i] for i in own] == find(t), t


# 8. ORC.


def test_orc_round_trip(spark, odd_rows, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(13)
    parts = ["Word", "été", "İstanbul", "e\u0301t", "it's", "rock'n'roll", "end.", "x,", "café!", "4", "a1", "...", "'s", "'", "ﬁ", "日本。", "\U0001f600", "\u00a0", "a\u00a0b", "\u2003x", "naïve?", "ŉ", "ǅ,", "_", "a_"]
    odd_rows = odd_rows + [(700, "hello <|endoftext|> world", "en", "a"), (701, "<|startoftext|>", "en", "a"), (702, "a<|b|> <|endoftext", "en", "a"), (703, "\t lead and trail \n", "en", "a")]
    odd_rows += [(710 + i, "".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "", "  "]) for _ in range(30)), "en", "a") for i in range(60)]
    odd = frame(spark, odd_rows).repartition(3)
    orcids.write_token_ids(odd, str(tmp_path / "ids"), path)
    got = orcids.read_token_ids(spark, str(tmp_path / "ids")).collect()
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in odd_rows]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert orcids.find_token_ids(spark, str(tmp_path / "ids"), 5).count() == 1
    assert orcids.round_trip(empty, path).count() == 0


def test_orc_pieces(monkeypatch):
    """Each piece of words is encoded once, whatever its case, marks and slice, and the ids are the library's."""
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    words = orcids.Words(path)
    asked, encode = [], words.encode
    monkeypatch.setattr(words, "encode", lambda texts: asked.extend(w for t in texts for w in t.split(" ")) or encode(texts))
    for text in ("Tree tree TREE, tree. Über,", "tree? (tree) tree!!! über, über. über", "TREE. tree, !!!"):
        flat, _ = orcids.encode_slice(words, pa.array([text]), "<|", 1)
        assert flat.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    for piece in ("tree", ",", ".", "!!!"):
        assert asked.count(piece) == 1, piece
    rng = random.Random(4)
    parts = ["a", "Z", "é", "É", "ß", "İ", "Σ", "ς", "e\u0301", "\u0301", "ǅ", "ª", "×", "ﬁ", "日", "ก็", "4", "²", "½", "'", "'s", "'LL", ",", ".", "!", "<", "|", "\x00", "\x1c", "\x7f", "\u00a0", "\u0338", "\u212b", "가", "\u11a8", "\U0001f600"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(6)) for _ in range(3000)] + ["", "x" * 500 + "."]
    texts = [t for t in texts if "<|" not in t]
    for kept in (10**6, 50, 0):
        monkeypatch.setattr(orcids, "KEPT", kept)
        words = orcids.Words(path)
        for own in (texts[:1000], [""], texts[1000:]):
            flat, n = orcids.encode_slice(words, pa.array(own), "<|", 1)
            assert len(words.n) == len(words.known) <= kept
            for t, ids in zip(own, np.split(flat, np.cumsum(n)[:-1])):
                assert ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids + [1], t


# 9. Mixing.


def test_mix(spark, odd_rows, empty):
    rng = random.Random(5)
    rows = [r for r in odd_rows if r[0] is not None] + [(5000 + i, prose(rng, rng.randint(5, 40)), "en", rng.choice(["s1", "s2", "s3", None])) for i in range(600)]
    sizes = frame(spark, rows).withColumn("size", mixing.word_count(F.col("text"))).drop("text")
    plan = mixing.mix_plan(sizes)
    out = mixing.mix(sizes, plan).collect()
    assert len(out) == len(rows)
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        p = per[r["source"]]
        p[0], p[1], p[2] = p[0] + r["size"], p[1] + r["taken"], r["target"]
    total = sum(p[0] for p in per.values())
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # reshare the excess by weight until no target is above
        rest = total - sum(target.values())
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * per[s][0] + 1e-9}
        if not over:
            break
        target.update({s: 3 * per[s][0] for s in over})
        open_ -= over
    target.update({s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_})
    for s, (size, taken, t) in per.items():
        assert t == pytest.approx(target[s])
        assert abs(taken - t) <= max(40, 0.6 * max(len(tokens(x[1])) for x in rows if x[3] == s))
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(sizes, mixing.mix_plan(sizes)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}
    none = empty.drop("text")
    assert mixing.mix(none, mixing.mix_plan(none)).count() == 0
    # Certain documents: the odds of the others are set anew until none reaches one.
    sizes = spark.createDataFrame([(i, "abc"[i % 3], int(rng.paretovariate(0.7)) + i % 2) for i in range(900)] + [(-1, None, 0)], "doc_id long, source string, size long")
    plan, rows_of = mixing.mix_plan(sizes), defaultdict(list)
    for r in mixing.mix(sizes, plan).collect():
        rows_of[r["source"]].append(r)
    some = 0
    for p in plan.collect():
        own = [r["size"] for r in rows_of[p["mix_source"]] if r["size"]]
        left, sure = p["remain"], set()
        while left > 0 and (more := {x for x in set(own) - sure if x * left >= sum(y * y for y in own if y not in sure)}):
            sure |= more
            left = p["remain"] - sum(y for y in own if y in sure)
        assert p["least_sure"] == (min(sure) if sure else None)
        assert p["share"] == pytest.approx(left / sum(y * y for y in own if y not in sure) if set(own) - sure else 0.0)
        assert all(r["copies"] == p["whole"] + 1 for r in rows_of[p["mix_source"]] if r["size"] in sure)
        some += len(sure)
    assert some
    mixed = mixing.mixed_documents(frame(spark, rows))
    assert mixed.count() == sum(r["copies"] for r in out)


# 10. Fingerprints.


def sketch(text):
    def h(data, seed):
        v = xxhash.xxh64_intdigest(data, seed)
        return v

    w = [h(x, 42) for x in tokens(text)]
    chain = lambda part: __import__("functools").reduce(lambda s, x: h(x.to_bytes(8, "little"), s), part, 42)
    s = {chain(w[i : i + 5]) & 0xFFFFFFFF for i in range(len(w) - 4)} if len(w) >= 5 else ({chain(w) & 0xFFFFFFFF} if w else set())
    return sorted(s)[: fingerprint.K]


def likeness(a, b):
    u = sorted(set(a) | set(b))[: fingerprint.K]
    return 1.0 if not u else len(set(u) & set(a) & set(b)) / len(u)


def test_fingerprints(spark, odd_rows, empty):
    rows = [r for r in {r[0]: r for r in odd_rows if r[0] is not None}.values()]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(frame(spark, rows).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", nxt[1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + u[:m]
        g = got[r[0]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sketch(t), sketch(edited), sketch(u)
        assert g["fingerprint"] == "".join(f"{x:08x}" for x in a) and g["edited_fingerprint"] == "".join(f"{x:08x}" for x in b)
        assert g["near_edited"] == pytest.approx(likeness(a, b)) and g["near_next"] == pytest.approx(likeness(a, c))
    assert fingerprint.fingerprint_edits(empty).count() == 0


def test_order_of_null_and_repeated_ids(spark, odd_rows):
    """Null ids are last, equal ids are ordered by their texts' hashes; the last row is followed by the first."""
    rows = [r for r in odd_rows if r[0] is None or r[0] < 40] + [(None, "another without id", "en", "a"), (30, "the same id again", "en", "a"), (30, "", "en", "a")]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    want = Counter()
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", nxt[1] or ""
        m = len(t) // 3
        want[r[0], len(t), hashlib.sha256((t[: len(t) - m] + u[:m]).encode()).hexdigest()] += 1
    got = fingerprint.fingerprint_edits(frame(spark, rows).repartition(3)).select("doc_id", "n_chars", "edited_sha256").collect()
    assert Counter(tuple(r) for r in got) == want


def test_sketches_merge(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i % 2, prose(rng, 200)) for i in range(6)], "g long, t string")
    parts = fingerprint.with_sketch(df, F.col("t"), "s")
    whole = {r["g"]: r["s"] for r in fingerprint.merge_sketches(parts, "g", "s").collect()}
    for g, rows in ((g, [r["s"] for r in parts.collect() if r["g"] == g]) for g in (0, 1)):
        assert whole[g] == sorted({x for s in rows for x in s})[: fingerprint.K]


# All stages.


def test_any_column_names(spark, odd):
    """Columns with dots, backticks and spaces in their names pass through every filtering stage."""
    docs = odd.withColumns({"a.b": F.lit(1), "doc_id.x": F.lit("y"), "c`d": F.lit(2), "e f": F.lit(None).cast("string")})
    for stage in (quality.reject_documents, langid.reject_unknown, jaccard.keep_one, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r["a.b"] == 1 and r["doc_id.x"] == "y" and r["c`d"] == 2 and r["e f"] is None for r in rows)
