"""Main text of HTML pages by wrapper induction.

Pages of a host are aligned with one reference page of it (of the median node count, not empty or cut)
by simple tree matching: nodes of equal tag match, and a dynamic program over their children finds the largest ordered
mapping. A reference node whose text is the same in nearly all different pages of the host is template;
the slots whose text varies are content. The host's content slot is the reference node that most pages have as the
lowest one over all their varying text but what is marked up as a menu, header, footer, sidebar, notice,
advert, form or comment; the blocks under the node that matches it in a page, without template and marked
parts, are the text. A page that has no such node, or whose host has too few pages to tell, falls back on its
article or main element.

Only skeletons of pages (tags, depths, text hashes) are shuffled for the alignment, and hosts with very
many pages are looked up by broadcast. A page's template nodes and slot come back to it by a join.

Defined results: a null or empty page has empty text; a host with few different pages has no template;
equal pages count once; rows with the same id each get a result; broken markup is closed as browsers do,
and a tag that the page's end cuts short is dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import in_blocks, lookup, materialize

#: A host has a template if it has so many different pages; a node is template if so large a share has its text.
LEAST_PAGES = 4
TEMPLATE_SHARE = 0.9
#: Deeper nodes count as of this depth in the alignment.
MOST_DEPTH = 400
#: Pairs of nodes below the compared siblings, after which the rest are weighed by shape; longer lists are aligned in stretches.
EXACT_CELLS = 1 << 18
STRETCH = 2048

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend option tbody td tfoot th thead title tr".split()) | {"dd", "dt"}
ENDS_BEFORE = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
}
DROPPED = frozenset("nav footer aside form button select textarea menu dialog object canvas audio video head search".split()) | RAW
# Words in class, id and role that mark what is no article text.
MARKS = frozenset("ad ads adv nav navigation menu footer sidebar aside complementary notice alert contentinfo search form login signup widget toolbar pager pagination copyright overlay modal toast gdpr hidden".split())
MARK_STARTS = tuple("advert sponsor promo banner cookie consent popup newsletter subscri comment disqus replies share social related recommend breadcrumb sidebar navbar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>?)|</[^a-zA-Z][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Page:
    """The nodes of a page in page order, and its texts and block bounds as items (node, text or None)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.marked = ["#root"], [0], [0], [False]
        self.items: list[tuple[int, str | None]] = []
        self._open = [0]
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            tag = _TAG.search(source, at)
            if tag is None:
                self._text(source[at:])
                return
            if tag.start() > at:
                self._text(source[at : tag.start()])
            at = tag.end()
            name = tag[2]
            if name is None:
                continue
            if not tag[4]:
                cut = source.find(">", tag.start(3))  # an open quote: the tag ends at the first bracket
                if cut < 0:
                    return
                at = cut + 1
            name = name.lower()
            if tag[1]:
                self._end(name)
                continue
            attributes = source[tag.start(3) : at - 1]
            self._start(name, attributes)
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                self._end(name)

    def _text(self, text: str) -> None:
        self.items.append((self._open[-1], entities.unescape(text)))

    def _bound(self, name: str) -> None:
        if name in BLOCKS:
            self.items.append((0, None))

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._close({"p"}, {"button", "table", "td", "th", "caption", "object", "template"})
        if name in ENDS_BEFORE:
            self._close(*ENDS_BEFORE[name])
        if name in ("br", "wbr"):
            if name == "br":
                self.items.append((self._open[-1], " "))
            return
        self._bound(name)
        parent = self._open[-1]
        self.tags.append(name)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.marked.append(_is_marked(name, attributes))
        if name not in VOID and not (attributes.endswith("/") and name in RAW):
            self._open.append(len(self.tags) - 1)

    def _close(self, names: set[str], limits: set[str]) -> None:
        """End the outermost open element of names above the innermost of limits."""
        for k in range(len(self._open) - 1, 0, -1):
            name = self.tags[self._open[k]]
            if name in limits:
                return
            if name in names:
                self._pop(k)
                return

    def _end(self, name: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == name:
                self._pop(k)
                return
        if name == "p":
            self._bound(name)

    def _pop(self, k: int) -> None:
        for node in self._open[k:]:
            self._bound(self.tags[node])
        del self._open[k:]

    def dropped(self) -> list[bool]:
        """Of each node whether it or one above it is marked up as no article text."""
        dropped, held = [False] * len(self.tags), [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            up = self.parents[k]
            held[k] = held[up] or self.tags[up] in ("article", "main")
            own = self.marked[k] or self.tags[k] in DROPPED or self.tags[k] == "header" and not held[k]
            dropped[k] = dropped[up] or own and self.tags[k] not in ("body", "html")
        return dropped

    def tagged(self, dropped: list[bool]) -> list[int]:
        """The article elements that aren't dropped, or the main ones where there are none."""
        found = {t: [k for k, own in enumerate(self.tags) if own == t and not dropped[k]] for t in ("article", "main")}
        return found["article"] or found["main"]

    def text(self, template: frozenset[int] = frozenset(), slot: int | None = None) -> str:
        """The blocks under slot (without one: the article's), without the own texts of template nodes."""
        dropped = self.dropped()
        chosen = set(self.tagged(dropped)) if slot is None else {slot}
        inside = [not chosen] * len(self.tags)
        for k in range(1, len(self.tags)):
            inside[k] = inside[k] or k in chosen or inside[self.parents[k]]
        blocks, now = [], []
        for node, text in self.items:
            if text is None:
                blocks.append("".join(now))
                now = []
            elif inside[node] and not dropped[node] and node not in template:
                now.append(text)
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)

    def skeleton(self) -> np.ndarray:
        """Of each node in page order: tag hash, depth, text hash (0 without text), and 1 if it is dropped or 2 if it is the
        one element that the page's tags name as its content."""
        own: list[list[str]] = [[] for _ in self.tags]
        for node, text in self.items:
            if text is not None:
                own[node].append(text)
        texts = [" ".join("".join(t).split()) for t in own]
        out = np.zeros((len(self.tags), 4), np.int64)
        out[:, 0] = pd.util.hash_array(np.array(self.tags, dtype=object), categorize=False).view(np.int64)
        out[:, 1] = np.minimum(self.depths, MOST_DEPTH)
        hashes = pd.util.hash_array(np.array(texts, dtype=object), categorize=False).view(np.int64)
        out[:, 2] = np.where(np.array([bool(t) for t in texts]), hashes | 1, 0)
        dropped = self.dropped()
        out[:, 3] = dropped
        tagged = self.tagged(dropped)
        if len(tagged) == 1:
            out[tagged[0], 3] = 2
        return out


def _is_marked(name: str, attributes: str) -> bool:
    if not attributes or name in ("body", "html", "article", "main"):
        words = [w for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id") for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())] if name in ("article",) else []
        return any(w.startswith("comment") for w in words)
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if any(w in MARKS or w.startswith(MARK_STARTS) for w in _WORD.findall(value)):
            return True
    return False


def _children(skeleton: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(len(skeleton))]
    last = [0] * (MOST_DEPTH + 2)
    for k, depth in enumerate(skeleton[:, 1].tolist()):
        if k:
            out[last[max(0, depth - 1)]].append(k)
        last[depth] = k
    return out


def _classes(page: np.ndarray, reference: np.ndarray) -> list[tuple[list, list, list, list, list]]:
    """Of both pages: children, text tokens, classes, shapes and sizes of the nodes. Subtrees of equal tags and texts have one
    class, those of equal tags one shape. A text that the other page doesn't have can match nothing, so all such texts of a
    page are one token: what varies between pages doesn't make classes of its own."""
    known: dict[tuple, int] = {}
    common = set(page[:, 2].tolist()) & set(reference[:, 2].tolist()) | {0}
    out = []
    for side, missing in ((page, 2), (reference, 4)):  # hashes of texts are odd or 0
        below, tags = _children(side), side[:, 0].tolist()
        texts = [t if t in common else missing for t in side[:, 2].tolist()]
        classes, shapes, sizes = ([0] * len(side) for _ in range(3))
        for k in range(len(side) - 1, -1, -1):
            own = below[k]
            classes[k] = known.setdefault((tags[k], texts[k], *[classes[c] for c in own]), len(known))
            shapes[k] = known.setdefault((tags[k], None, *[shapes[c] for c in own]), len(known))
            sizes[k] = 1 + sum(sizes[c] for c in own)
        out.append((below, texts, classes, shapes, sizes))
    return out


def _best_mapping(weights: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs of the largest ordered mapping of rows to columns; of equally large ones the one of earliest places."""
    n, m = weights.shape
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        with_it = np.where(weights[i] > 0, best[i, :-1] + weights[i], 0)
        np.maximum.accumulate(np.maximum(best[i, 1:], with_it), out=best[i + 1, 1:])
    i, j, chosen = n, m, []
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen.append((i, j))
    return int(best[n, m]), chosen


def _best_mapping_small(weights: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """As _best_mapping, faster for few cells."""
    best = [[0] * (len(weights[0]) + 1)]
    for row in weights:
        above, line, left = best[-1], [0], 0
        for j, w in enumerate(row):
            left = max(above[j + 1], left, above[j] + w if w else 0)
            line.append(left)
        best.append(line)
    i, j, chosen = len(weights), len(weights[0]), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen.append((i, j))
    return best[-1][-1], chosen


def _by_shape(page: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Weights of pairs of subtrees by their (tag, text, class, shape, size) alone."""
    tags, texts, classes, shapes, _ = (x[:, None] == y[None, :] for x, y in zip(page, reference))
    sizes = page[4][:, None]
    return np.where(tags, np.where(classes, 3 * sizes, np.where(shapes, 2 * sizes, 2) + texts), 0)


def align(page: np.ndarray, reference: np.ndarray, exact_cells: int | None = EXACT_CELLS, stretch: int = STRETCH) -> list[tuple[int, int]]:
    """Pairs (node, reference node) of the largest mapping by simple tree matching: a pair weighs 2, equal texts 1 more.

    Lists of siblings lose their equal heads and tails first (no mapping is larger without those pairs), and a pair of
    classes is weighed once. Where exact_cells pairs of their children (None: any number) don't reach any more, a pair of subtrees not weighed yet
    counts by its shape: 3 a node where all is equal, 2 a node where the tags are, else by its two roots alone; subtrees so
    paired are still aligned in themselves. Two lists of more than stretch ** 2 pairs are aligned in stretches at like places.
    So the time and memory for a page grow with its nodes, not with the square of a list."""
    if page[0, 0] != reference[0, 0]:
        return []
    (below, texts, classes, shapes, sizes), (rbelow, rtexts, rclasses, rshapes, rsizes) = _classes(page, reference)
    tags, rtags = page[:, 0].tolist(), reference[:, 0].tolist()
    page_side, reference_side = (np.array(x, np.int64) for x in ((tags, texts, classes, shapes, sizes), (rtags, rtexts, rclasses, rshapes, rsizes)))
    left = exact_cells
    known: dict[tuple[int, int], int] = {}
    paths: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def weigh(a: int, b: int) -> int:
        """The weight of a pair with the best mapping of its children, whose places are left in paths."""
        nonlocal left
        key = classes[a], rclasses[b]
        if key in known:
            return known[key]
        total = 3 if texts[a] == rtexts[b] else 2
        xs, ys = below[a], rbelow[b]
        head, tail, least = 0, 0, min(len(xs), len(ys))
        while head < least and classes[xs[head]] == rclasses[ys[head]]:
            head += 1
        while tail < least - head and classes[xs[-1 - tail]] == rclasses[ys[-1 - tail]]:
            tail += 1
        chosen = [(k, k) for k in range(head)] + [(len(xs) - k, len(ys) - k) for k in range(1, tail + 1)]
        total += sum(3 * sizes[xs[i]] for i, _ in chosen)
        n, m = len(xs) - head - tail, len(ys) - head - tail
        cuts = math.ceil(math.sqrt(n * m) / stretch)
        for k in range(cuts):
            i0, i1, j0, j1 = (head + size * at // cuts for size in (n, m) for at in (k, k + 1))
            if i0 == i1 or j0 == j1:
                continue
            us = {classes[x]: x for x in xs[i0:i1]}
            vs = {rclasses[y]: y for y in ys[j0:j1]}
            nested = sum(len(below[x]) for x in us.values()) * sum(len(rbelow[y]) for y in vs.values())
            exact = left is None or nested <= left
            if exact and left is not None:
                left -= nested
            one_by_one = exact and (nested > 0 or len(us) * len(vs) <= 400)
            if one_by_one:
                pair = {(c, d): 0 if tags[x] != rtags[y] else weigh(x, y) if below[x] and rbelow[y] else 3 if texts[x] == rtexts[y] else 2 for c, x in us.items() for d, y in vs.items()}
            if one_by_one and (i1 - i0) * (j1 - j0) <= 400:
                more, mapped = _best_mapping_small([[pair[classes[x], rclasses[y]] for y in ys[j0:j1]] for x in xs[i0:i1]])
            else:
                rows, columns = ({c: k for k, c in enumerate(of)} for of in (us, vs))
                table = np.array(list(pair.values())).reshape(len(us), len(vs)) if one_by_one else _by_shape(page_side[:, list(us.values())], reference_side[:, list(vs.values())])
                more, mapped = _best_mapping(table[[rows[classes[x]] for x in xs[i0:i1]]][:, [columns[rclasses[y]] for y in ys[j0:j1]]])
            total += more
            chosen += [(i0 + i, j0 + j) for i, j in mapped]
        known[key], paths[key] = total, chosen
        return total

    found, todo = [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        found.append((a, b))
        if below[a] and rbelow[b]:
            weigh(a, b)
            todo += [(below[a][i], rbelow[b][j]) for i, j in paths[classes[a], rclasses[b]]]
    return found


def _parents(skeleton: np.ndarray) -> list[int]:
    out = [0] * len(skeleton)
    for k, own in enumerate(_children(skeleton)):
        for child in own:
            out[child] = k
    return out


def _text_places(page: np.ndarray, pairs: dict[int, int], same: set[int]) -> list[int]:
    """Where the page's texts that aren't dropped lie in the reference: the node that matches, or matches the nearest
    one above; as -1 - node if the text is that of the matching node, so that it may be template."""
    parents, out = _parents(page), []
    for k in range(len(page)):
        if page[k, 2] and page[k, 3] != 1:
            at = k
            while at not in pairs:
                at = parents[at]
            out.append(-1 - pairs[k] if k in same else pairs[at])
    return out


def _lowest_over(nodes: set[int], parents: list[int]) -> int | None:
    """The lowest node that all of nodes are, or are under; parents come before their children."""
    held = set(nodes)
    last = [-k for k in held]
    heapq.heapify(last)
    while len(held) > 1:
        node = -heapq.heappop(last)
        held.remove(node)
        up = parents[node]
        if up not in held:
            held.add(up)
            heapq.heappush(last, -up)
    return held.pop() if held else None


def _cut(text: str) -> bool:
    """Whether the page ends inside a tag, or html or body is opened and never closed."""
    low = text.lower()
    return low.rfind("<") > low.rfind(">") or any(f"<{t}" in low and f"</{t}" not in low for t in ("html", "body"))


def _skeletons(pages: DataFrame, url_col: str, text_col: str) -> DataFrame:
    """(__key, host, nodes, cut, print, skeleton) of each page."""
    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_blocks(texts):
                found = [Page(t or "").skeleton() for t in texts[a:b]]
                prints = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(s) for s in found], pa.int32()), pa.array([_cut(t or "") for t in texts[a:b]], pa.bool_()), pa.array(prints, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                    ["__key", "host", "nodes", "cut", "print", "skeleton"],
                )

    return pages.select("__key", host.alias("host"), text_col).mapInArrow(run, "__key long, host string, nodes int, cut boolean, print long, skeleton binary")


def _alignments(pages: DataFrame) -> DataFrame:
    """(host, print, own, reference, same, places, tagged): matching nodes of each different page and its reference, those
    with equal texts, where its texts lie (_text_places), and the one element that its tags name as content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[], [], [], []]
            tagged = []
            for page, reference in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = (np.frombuffer(x, np.int64).reshape(-1, 4) for x in (page, reference))
                pairs = dict(align(a, b))
                same = {i for i, j in pairs.items() if a[i, 2] and a[i, 2] == b[j, 2]}
                for part, values in zip(parts, (list(pairs), list(pairs.values()), [pairs[i] for i in same], _text_places(a, pairs, same))):
                    part.append(values)
                tagged.append(next(iter(np.flatnonzero(a[:, 3] == 2).tolist()), None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int32())) for x in parts), pa.array(tagged, pa.int32())], ["host", "print", "own", "reference", "same", "places", "tagged"])

    return pages.select("host", "print", "skeleton", "reference").mapInArrow(run, "host string, print long, own array<int>, reference array<int>, same array<int>, places array<int>, tagged int")


def _page_slots(aligned: DataFrame) -> DataFrame:
    """(host, slot): of each page the lowest reference node over all its texts that aren't template. aligned: with the
    host's template nodes and the reference's skeleton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for places, nodes, reference in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if reference not in known:
                    known.clear()
                    known[reference] = _parents(np.frombuffer(reference, np.int64).reshape(-1, 4))
                template = set(nodes or ())
                varying = {p if p >= 0 else -1 - p for p in places if p >= 0 or -1 - p not in template}
                out.append(_lowest_over(varying, known[reference]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], ["host", "slot"])

    return aligned.select("host", "places", "nodes", "reference_skeleton").mapInArrow(run, "host string, slot int")


def template_nodes(pages: DataFrame, url_col: str, text_col: str) -> DataFrame:
    """(__key, template, slot): the template nodes and the content slot's node of each page that isn't read the same without. pages: with __key."""
    every = materialize(_skeletons(pages, url_col, text_col), "skeletons")
    different = materialize(every.groupBy("host", "print").agg(F.min("nodes").alias("nodes"), F.min("__key").alias("__key"), F.min("cut").alias("cut")), "different")
    # the reference is a page of the median node count; empty and cut ones only where a host has no other
    whole = (F.col("nodes") > 1) & ~F.col("cut")
    middle = F.coalesce(F.percentile_approx(F.when(whole, F.col("nodes")), 0.5), F.percentile_approx("nodes", 0.5))
    sizes = different.groupBy("host").agg(F.count("*").alias("pages"), middle.alias("middle")).where(F.col("pages") >= LEAST_PAGES)
    sizes = materialize(sizes.withColumn("n", F.col("pages")), "sizes")
    away = F.shiftleft(F.abs(F.col("nodes") - F.col("middle")).cast("long"), 32) + F.pmod(F.col("print"), F.lit(1 << 32)) + F.when(whole, 0).otherwise(1 << 62)
    hosts = lookup(different, sizes, "host", "n").where("pages is not null").groupBy("host").agg(F.max("pages").alias("pages"), F.min_by("print", away).alias("print"))
    hosts = materialize(hosts, "hosts")
    once = every.dropDuplicates(["__key"]).join(different.join(hosts.select("host"), "host").select("__key"), "__key", "left_semi")
    once = materialize(once.select("host", "print", "skeleton"), "pages")
    references = materialize(hosts.join(once, ["host", "print"]).select("host", "pages", F.col("skeleton").alias("reference")), "references")
    aligned = materialize(_alignments(lookup(once, references, "host", "pages")), "aligned")
    counts = aligned.select("host", F.explode("same").alias("node")).groupBy("host", "node").count()
    common = counts.join(hosts.select("host", "pages"), "host").where(F.col("count") >= TEMPLATE_SHARE * F.col("pages"))
    common = common.groupBy("host").agg(F.collect_set("node").alias("nodes"))
    templates = materialize(references.select("host", "pages", F.col("reference").alias("reference_skeleton")).join(common, "host", "left"), "templates")
    met = materialize(lookup(aligned, templates, "host", "pages"), "met")
    # the slot that most pages have, of equally common ones the one further up
    votes = _page_slots(met).where("slot is not null").groupBy("host", "slot").count()
    slots = votes.groupBy("host").agg(F.max_by("slot", F.shiftleft("count", 32) - F.col("slot")).alias("slot"), F.sum("count").alias("votes"))
    met = lookup(met.drop("reference_skeleton", "places"), materialize(slots, "slots"), "host", "votes")
    pairs = F.filter(F.arrays_zip("own", "reference"), lambda p: F.array_contains("nodes", p["reference"]) & F.array_contains("same", p["reference"]))
    root = F.get("own", F.array_position("reference", F.col("slot")).cast("int") - 1)
    of_print = met.select("host", "print", F.transform(pairs, lambda p: p["own"]).alias("template"), F.when(F.array_contains("reference", F.col("slot")), root).alias("slot"), "tagged")
    # a page without template nodes whose slot is the element that its tags name too reads the same without a row here
    of_print = of_print.where((F.size("template") > 0) | (F.col("slot").isNotNull() & ~F.col("slot").eqNullSafe(F.col("tagged")))).drop("tagged")
    return materialize(every.select("__key", "host", "print").join(of_print, ["host", "print"]).select("__key", "template", "slot").dropDuplicates(["__key"]), "template")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    keyed = pages.select(id_col, url_col, text_col, F.xxhash64(url_col, text_col).alias("__key"))
    joined = keyed.join(template_nodes(keyed, url_col, text_col), "__key", "left")
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, templates, slots = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for a, b in in_blocks(sources):
                texts = [Page(t or "").text(frozenset(x or ()), k) for t, x, k in zip(sources[a:b], templates[a:b], slots[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return joined.select(id_col, url_col, text_col, "template", "slot").mapInArrow(run, f"{kinds}, text string, n_chars long")
