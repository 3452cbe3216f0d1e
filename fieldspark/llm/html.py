"""Main text of web pages by wrapper induction.

Pages become small trees of block elements in which runs of like siblings are one node. A page is aligned with a few
reference pages of its host, of the pages of like frame (the upper labels of the tree) and of those of equal shape, so that
each layout of a host has references. Alignment is simple tree matching; block texts that stay the same in most of the
aligned pages are template, and what varies is content. Pages count by their distinct texts, and neither a reference nor
its near copies count for its own blocks, so that an article that is copied often stays whole. Menus, adverts and footers
that vary from page to page can't be told so; they are left out by what names them: their element, their role, or a class
or id all of whose parts name such a place (`ad`, `promo-box`, `cookie-notice`, but not `social-science`); names that may
mean content, too (`related`, `share`), only decide if other text is left on the page. Where a page marks its article, only the article counts.

Edge cases: a null or empty html has an empty text; a null url's pages form a host of their own; a block is
template if LEAST_PAGES different pages have it, or all pages of a host of fewer, but two; a single page has no template;
pages that have four fifths of their text in common are near copies and keep what they share; a page all of whose text is
template keeps it; markup cut off at the end of a page is dropped; repeated rows get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_small

REFERENCES, LEAST_PAGES, SHARE = 3, 4, 0.75
#: Pages with so many hundredths of their text in common, by blocks, are near copies. Depth of a page's frame. Kinds of groups.
NEAR, FRAME, LEVELS = 80, 3, 3
#: Steps that an exact matching of two pages may take; bits of the table by which two longer rows of children are matched.
MOST_WORK, MOST_BITS = 200_000, 1 << 29

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output progress q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words of class or id that are never part of the main text; words that may stand beside these in a name.
NOT_MAIN = frozenset("nav footer aside form script style noscript template iframe svg math canvas object select button textarea dialog menu head title audio video map noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies disqus respond share sharing social related "
    "recommended newsletter subscribe subscription signup login search pagination pager widget widgets toolbar".split()
)
#: Those of WORDS that also name content: they decide only if other text is left on the page.
WEAK = frozenset("notice notices alert respond reply replies share sharing social related recommended search header masthead promotion signup login subscribe subscription widget widgets overlay modal popup".split())
BESIDE = frozenset(
    "a area bar block body bottom box button buttons center col column container content cta divider fixed form global group head holder home icon icons img image inline inner item items js label left "
    "link links list lower main message messages middle mobile modules module msg outer page pane panel part placeholder primary region right row secondary section site slot small space sticky strip sub thread "
    "text title top unit upper user users view wrap wrapper x y z".split()
)
#: A start tag that ends an open paragraph or like item.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


#: How sure it is that a node isn't content: if other text is left, or anyway.
MAYBE, SURELY = 1, 2


def named_boilerplate(name: str) -> int:
    """How surely a class or id (as written) names no content: all its parts, numbers aside, belong to WORDS or BESIDE, and one to WORDS."""
    parts = {x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x}
    words = parts & WORDS
    return 0 if not words or parts - WORDS - BESIDE else MAYBE if words <= WEAK else SURELY


class Node:
    """A block element: its label, children, whether it can't be content, and its own texts with their page order."""

    __slots__ = ("label", "children", "dropped", "texts")

    def __init__(self, label: str, dropped: int) -> None:
        self.label, self.dropped = label, dropped
        self.children: list[Node] = []
        self.texts: list[tuple[int, str]] = []


def _kind(tag: str, attributes: str, inside: bool) -> tuple[str, int]:
    """The label of a start tag, and how sure it is that it can't be content; `inside` an article a header may hold its title."""
    first, drop = "", SURELY if tag in NOT_MAIN or (tag == "header" and not inside) else 0
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            low = value.lower()
            if name == "role":
                drop = max(drop, SURELY * (low in ROLES))
            elif name == "hidden" or (name == "aria-hidden" and low == "true") or (name == "style" and "display:none" in low.replace(" ", "")):
                drop = SURELY
            elif name in ("class", "id"):
                first = first or low.split(" ")[0]
                if tag == "article":
                    drop = max(drop, SURELY * (not {"comment", "reply"}.isdisjoint(re.split(r"[^a-z]+", low))))
                elif tag not in ("html", "body", "main"):
                    drop = max(drop, *map(named_boilerplate, value.split()), 0)
    return (f"{tag}.{first}" if first else tag), drop


def parse(html: str) -> tuple[Node, bool]:
    """The page's block tree, and whether it marks an article (or main part) that has text."""
    root = Node("#page", 0)
    stack: list[tuple[str, Node, bool]] = [("#page", root, False)]
    parts: list[str] = []
    order, skip_inline, pos, end = 0, [], 0, len(html)
    marked = False

    def flush() -> None:
        nonlocal order, marked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                node = stack[-1][1]
                node.texts.append((order, text))
                order += 1
                marked |= stack[-1][2] and not node.dropped

    while pos < end:
        at = html.find("<", pos)
        if at < 0:
            if not skip_inline:
                parts.append(html[pos:])
            break
        if at > pos and not skip_inline:
            parts.append(html[pos:at])
        m = TOKEN.match(html, at)
        if m is None:
            if not skip_inline:
                parts.append("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = m[3].lower() if m[3] else None
        if tag is None:
            if m[1] and not skip_inline:
                parts.append(m[1].replace("&", "&amp;"))
            continue
        if not m[5]:
            break  # the page is cut off within a tag
        closing = bool(m[2])
        if not closing and tag in RAW:
            close = re.compile(rf"</{tag}\s*>?", re.I).search(html, pos)
            pos = close.end() if close else end
            parts.append(" ")
            continue
        if tag in INLINE or (tag not in CLOSES and "-" in tag):
            if tag in ("br", "img", "wbr", "input"):
                parts.append(" " if tag == "br" else "")
            elif closing:
                if skip_inline and skip_inline[-1] == tag:
                    skip_inline.pop()
            elif skip_inline and skip_inline[-1] == tag or (m[4] and _kind(tag, m[4], True)[1] and not m[4].rstrip().endswith("/")):
                skip_inline.append(tag)
            continue
        skip_inline.clear()
        flush()
        if closing:
            if any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag in VOID:
            continue
        if stack[-1][0] == "p":
            stack.pop()
        ends = CLOSES.get(tag)
        if ends and stack[-1][0] in ends:
            stack.pop()
        above = stack[-1]
        label, drop = _kind(tag, m[4], above[2])
        node = Node(label, max(drop, above[1].dropped))
        above[1].children.append(node)
        if not m[4].rstrip().endswith("/") or tag in ("p", "div", "article", "section", "main", "body"):
            stack.append((tag, node, above[2] or tag in ("article", "main")))
    flush()
    return root, marked


def collapse(node: Node) -> list:
    """[label, texts, children], with runs of like-labelled siblings as one child that has the texts of all."""

    def merged(nodes: list[Node]) -> list:
        return [nodes[0].label, [(i, t, nodes[0].dropped) for n in nodes for i, t in n.texts], []]

    top = merged([node])
    todo = [(top, [node])]
    while todo:
        out, nodes = todo.pop()
        runs: list[list[Node]] = []
        for c in (c for n in nodes for c in n.children):
            if runs and runs[-1][-1].label == c.label and runs[-1][-1].dropped == c.dropped:
                runs[-1].append(c)
            else:
                runs.append([c])
        for r in runs:
            out[2].append(merged(r))
            todo.append((out[2][-1], r))
    return top


def shape(tree: list, depth: int = 0) -> list[tuple[int, str]]:
    """The labels of a collapsed tree in page order, with their depths."""
    out, stack = [], [(tree, depth)]
    while stack:
        t, d = stack.pop()
        out.append((d, t[0]))
        stack.extend((c, d + 1) for c in reversed(t[2]))
    return out


def slots(tree: list) -> list[list]:
    """The texts of each node, in the order of shape()."""
    out, stack = [], [tree]
    while stack:
        t = stack.pop()
        out.append(t[1])
        stack.extend(reversed(t[2]))
    return out


def common_row(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two rows, by bit-parallel steps: a row of len(a) bits for each member of b."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    now, rows = full, []
    for y in b:
        met = now & where.get(y, 0)
        now = ((now + met) | (now - met)) & full
        rows.append(now)  # a zero bit: the sequence grows at this place of a
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> (i - 1) & 1:
            i -= 1
            out.append((i, j))
    return out[::-1]


def match(a: list[tuple[int, str]], b: list[tuple[int, str]], most: int = MOST_WORK) -> list[int]:
    """Simple tree matching: for each node of shape `a` the matched node of shape `b`, or -1.

    Nodes match if their labels are equal and their parents match; children match in order, so that the matching is largest.
    Equal subtrees at either end of two rows of children match at once, which is always part of a largest matching. Where
    the rest would take more than `most` steps, each two rows of children are matched by a longest common row of equal
    subtrees and, between these, of equal labels; rows of more than MOST_BITS pairs in order, each child with the first
    like one that is left.
    """

    def children(s: list[tuple[int, str]]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in s]
        path: list[int] = []
        for i, (d, _) in enumerate(s):
            del path[d:]
            if path:
                out[path[-1]].append(i)
            path.append(i)
        return out

    ca, cb, out = children(a), children(b), [-1] * len(a)
    if not a or not b or a[0] != b[0]:
        return out
    names: dict[tuple, int] = {}

    def subtrees(s: list[tuple[int, str]], c: list[list[int]]) -> list[int]:
        of = [0] * len(s)
        for i in range(len(s) - 1, -1, -1):
            of[i] = names.setdefault((s[i], *[of[x] for x in c[i]]), len(names))
        return of

    na, nb = subtrees(a, ca), subtrees(b, cb)
    size = [1] * len(a)
    for i in range(len(a) - 1, -1, -1):
        size[i] += sum(size[x] for x in ca[i])

    def ends(i: int, j: int) -> tuple[int, int, int]:
        """How many children of i and j are equal at the start, and where the unequal middles end."""
        x, y, k = ca[i], cb[j], 0
        while k < len(x) and k < len(y) and na[x[k]] == nb[y[k]]:
            k += 1
        p, q = len(x), len(y)
        while p > k and q > k and na[x[p - 1]] == nb[y[q - 1]]:
            p, q = p - 1, q - 1
        return k, p, q

    # Pairs that a largest matching may need, parents first; equal subtrees need none below them.
    pairs, work = {(0, 0): None}, 0
    for i, j in (order := [(0, 0)]):
        if na[i] != nb[j]:
            k, p, q = pairs[i, j] = ends(i, j)
            work += (p - k) * (q - k)
            if work > most:
                break
            for x in ca[i][k:p]:
                for y in cb[j][k:q]:
                    if a[x] == b[y] and (x, y) not in pairs:
                        pairs[x, y] = None
                        order.append((x, y))
    exact, known = work <= most, {}
    if exact:
        for i, j in reversed(order):
            if na[i] == nb[j]:
                known[i, j] = (size[i], None)
                continue
            k, p, q = pairs[i, j]
            x, y = ca[i][k:p], cb[j][k:q]
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for m in range(1, len(x) + 1):
                for n in range(1, len(y) + 1):
                    best[m][n] = max(best[m - 1][n], best[m][n - 1], best[m - 1][n - 1] + known.get((x[m - 1], y[n - 1]), (0,))[0])
            same = sum(size[c] for c in ca[i][:k] + ca[i][p:])
            known[i, j] = (best[-1][-1] + same + 1, best)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        if na[i] == nb[j]:
            todo += zip(ca[i], cb[j])
            continue
        k, p, q = ends(i, j)
        todo += [*zip(ca[i][:k], cb[j][:k]), *zip(ca[i][p:], cb[j][q:])]
        x, y = ca[i][k:p], cb[j][k:q]
        if exact:
            best, m, n = known[i, j][1], len(x), len(y)
            while m and n:
                pair = (x[m - 1], y[n - 1])
                if pair in known and best[m][n] == best[m - 1][n - 1] + known[pair][0]:
                    todo.append(pair)
                    m, n = m - 1, n - 1
                elif best[m][n] == best[m - 1][n]:
                    m -= 1
                else:
                    n -= 1
        elif len(x) * len(y) <= MOST_BITS:
            # Equal subtrees first, then equal labels between them.
            i0 = j0 = 0
            for m, n in [*common_row([na[c] for c in x], [nb[c] for c in y]), (len(x), len(y))]:
                todo += [(x[i0 + k], y[j0 + l]) for k, l in common_row([a[c] for c in x[i0:m]], [b[c] for c in y[j0:n]])]
                if m < len(x):
                    todo.append((x[m], y[n]))
                i0, j0 = m + 1, n + 1
        else:
            places: dict[tuple, list[int]] = {}
            for n, c in enumerate(y):
                places.setdefault(b[c], []).append(n)
            after = 0
            for c in x:
                own = places.get(a[c], [])
                at = bisect_left(own, after)
                if at < len(own):
                    todo.append((c, y[own[at]]))
                    after = own[at] + 1
    return out


def host_of(url: Column) -> Column:
    """The host of a url: what stands between // (if any) and the next slash, lower-case, without user and port; null: ''."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|^//", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*", 0), r"^.*@", ""), r":\d*$", ""))


def _name(*parts) -> int:
    """A 64-bit name of a value."""
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def groups_of(host: str, s: list[tuple[int, str]]) -> list[int]:
    """The groups whose references a page of shape `s` is aligned with: its host's, its frame's (the upper labels) and its shape's."""
    return [_name(0, host), _name(1, host, [x for x in s if x[0] <= FRAME]), _name(2, host, s)]


def _outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for host, html in zip(pdf["host"], pdf["html"]):
            tree = collapse(parse(html or "")[0])
            s, found = shape(tree), slots(tree)
            texts = sorted((o, t) for x in found for o, t, out in x if not out)
            hashes = [sorted({crc32(t.encode("utf-8")) for _, t, _ in x}) for x in found]
            own = sorted({len(t) << 32 | crc32(t.encode("utf-8")) for _, t in texts})
            rows.append((host, _name([t for _, t in texts]), _name(s, hashes), groups_of(host, s), [d for d, _ in s], [x for _, x in s], hashes, own))
        yield pd.DataFrame(rows, columns=["host", "key", "whole", "groups", "depths", "labels", "hashes", "own"])


OUTLINE = "depths array<int>, labels array<string>, hashes array<array<long>>, own array<long>"


class Matcher:
    """match() with a memory: pages of a host share few shapes."""

    def __init__(self) -> None:
        self.known: dict = {}

    def __call__(self, a: tuple, b: tuple) -> list[int]:
        if len(self.known) > 20_000:
            self.known.clear()
        if a == b:
            return list(range(len(a)))
        if (a, b) not in self.known:
            self.known[a, b] = match(list(a), list(b))
        return self.known[a, b]


def near_copy(a: set[int], b: set[int]) -> bool:
    """Whether two pages' block texts (hashes below their lengths) are copies or near copies of each other, by length."""
    size = lambda x: sum(t >> 32 for t in x)
    return 100 * size(a & b) >= NEAR * size(a | b)


def induce(pages: DataFrame) -> DataFrame:
    """One row per group (see groups_of()) of `pages` (host, html): references, an array of (depths, labels), and template hashes by node.

    Pages of equal text count once. References of a group are its pages with the lowest of REFERENCES hashes of their text,
    found by partial aggregates. Every page is aligned with those of its groups of which it isn't a near copy; equal block
    texts of matched nodes are counted within a batch before they are shuffled.
    """
    outlines = pages.select("host", "html").mapInPandas(_outline, "host string, key long, whole long, groups array<long>, " + OUTLINE)
    page = ["depths", "labels", "hashes", "own"]
    outlines = outlines.groupBy("host", "key").agg(F.min(F.struct("whole", "groups", *page)).alias("p"))
    outlines = materialise(outlines.select("host", "key", "p.groups", *[f"p.{c}" for c in page]), "outlines")
    of_group = outlines.select("host", "key", F.posexplode("groups").alias("level", "g")).groupBy("host", "level", "g")
    lows = [F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("o"), "key"))["key"] for i in range(REFERENCES)]
    # A host of few pages has its own references, too; a few pages of a large host don't.
    enough = F.col("pages") >= F.when(F.col("level") == 0, 2).otherwise(LEAST_PAGES)
    chosen = materialise(of_group.agg(F.count(F.lit(1)).alias("pages"), F.array_distinct(F.array(*lows)).alias("keys")).filter(enough), "groups")
    # A frame's or shape's group that holds the whole host would only repeat the host's.
    whole = chosen.filter("level = 0").select("host", F.col("pages").alias("all_pages"))
    chosen = chosen.join(whole, "host").filter("level = 0 OR pages < all_pages")
    picked = materialise(chosen.select("g", "pages", F.col("host").alias("ref_host"), F.posexplode("keys").alias("ref", "ref_key")), "picked")
    refs = with_small(outlines, picked, (outlines["host"] == picked["ref_host"]) & (outlines["key"] == picked["ref_key"]), "inner")
    refs = refs.groupBy("g", "pages").agg(F.array_sort(F.collect_list(F.struct("ref", *page))).alias("refs"))  # at most REFERENCES
    refs = materialise(refs, "references")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit = Matcher()
        for pdf in batches:
            same, met = Counter(), Counter()
            for g, depths, labels, hashes, own, refs in zip(pdf["g"], pdf["depths"], pdf["labels"], pdf["hashes"], pdf["own"], pdf["refs"]):
                tree, own = tuple(zip(map(int, depths), labels)), set(map(int, own))
                for ref in refs:
                    if near_copy(own, set(map(int, ref["own"]))):
                        continue
                    r = ref["ref"]
                    for i, j in enumerate(fit(tree, tuple(zip(map(int, ref["depths"]), ref["labels"])))):
                        if j >= 0:
                            met[g, r, j] += 1
                            if len(hashes[i]) and len(ref["hashes"][j]):
                                for h in set(map(int, hashes[i])) & set(map(int, ref["hashes"][j])):
                                    same[g, r, j, h] += 1
            rows = [(g, r, j, None, n) for (g, r, j), n in met.items()] + [(g, r, j, x, n) for (g, r, j, x), n in same.items()]
            yield pd.DataFrame(rows, columns=["g", "ref", "node", "hash", "n"]).astype({"hash": "Int64"})

    side = refs.select(F.col("g").alias("of"), "refs")
    member = outlines.select(F.explode("groups").alias("g"), *page)
    member = with_small(member, side, member["g"] == side["of"], "inner").select("g", *page, "refs")
    counts = member.mapInPandas(count, "g long, ref int, node int, hash long, n long").groupBy("g", "ref", "node", "hash").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "matches")
    total = counts.filter(F.col("hash").isNull()).select("g", "ref", "node", F.col("n").alias("met"))
    const = counts.filter(F.col("hash").isNotNull()).join(total, ["g", "ref", "node"])
    const = const.join(refs.select("g", "pages"), "g").filter((F.col("n") >= F.least(F.lit(LEAST_PAGES), "pages") - 1) & (F.col("n") >= F.lit(SHARE) * F.col("met")))
    const = const.groupBy("g").agg(F.collect_list(F.struct("ref", "node", "hash")).alias("template"))  # within the references' texts
    trees = F.transform("refs", lambda x: F.struct(x["ref"].alias("ref"), x["depths"].alias("depths"), x["labels"].alias("labels")))
    return materialise(refs.join(const, "g").select("g", trees.alias("refs"), "template"), "wrappers")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages as trees with the names of their groups."""
    for pdf in batches:
        trees, groups = [], []
        for host, html in zip(pdf["host"], pdf["html"]):
            root, marked = parse(html or "")
            tree = collapse(root)
            s = shape(tree)
            trees.append(pickle.dumps((s, slots(tree), marked)))
            groups.append(groups_of(host, s))
        out = pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "tree": trees})
        for k in range(LEVELS):
            out[f"g{k}"] = [g[k] for g in groups]
        yield out


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fit = Matcher()
    for pdf in batches:
        texts = []
        for packed, *wrappers in zip(pdf["tree"], *[pdf[f"w{k}"] for k in range(LEVELS)]):
            s, found_in, marked = pickle.loads(packed)
            fixed: dict[int, set[int]] = {}
            own = tuple(s)
            for wrapper in wrappers:
                if wrapper is None:
                    continue
                by: dict[tuple[int, int], set[int]] = {}
                for t in wrapper["template"]:
                    by.setdefault((t["ref"], t["node"]), set()).add(t["hash"])
                for ref in wrapper["refs"]:
                    for i, j in enumerate(fit(own, tuple(zip(map(int, ref["depths"]), ref["labels"])))):
                        if (ref["ref"], j) in by:
                            fixed.setdefault(i, set()).update(by[ref["ref"], j])
            kept: list[tuple[int, str]] = []
            content: list[tuple[int, str]] = []
            named: list[tuple[int, str]] = []
            path: list[str] = []
            for i, ((d, label), found) in enumerate(zip(s, found_in)):
                del path[d:]
                path.append(label)
                if found and (not marked or any(re.match(r"(article|main)(\.|$)", x) for x in path)):
                    drop = fixed.get(i, ())
                    content += (some := [(o, t) for o, t, out in found if not out])
                    kept += [(o, t) for o, t in some if not drop or crc32(t.encode("utf-8")) not in drop]
                    named += [(o, t) for o, t, out in found if out == MAYBE and crc32(t.encode("utf-8")) not in drop]
            texts.append("\n\n".join(t for _, t in sorted(kept or content or named)))
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # Ids travel as text: pandas would hold those beside a null as floats.
    rows = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    wrappers = induce(rows)
    df = rows.mapInPandas(_read, "page_id string, url string, tree binary, " + ", ".join(f"g{k} long" for k in range(LEVELS)))
    for k in range(LEVELS):
        side = wrappers.select(F.col("g").alias(f"of{k}"), F.struct("refs", "template").alias(f"w{k}"))
        df = with_small(df, side, F.col(f"g{k}") == F.col(f"of{k}")).drop(f"of{k}", f"g{k}")
    found = df.mapInPandas(_extract, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema[key].dataType))
