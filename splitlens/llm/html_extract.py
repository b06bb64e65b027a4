"""HTML extraction: boosted trees over DOM nodes, decoded along the tree.

Every element is a node with features: its kind, tokens of its class, id and role, what its
ancestors are, its depth, its place among its siblings, and the text, links and tags of its
subtree. Gradient-boosted trees give each node log-odds of being main text. They learn from weak
labels: nodes whose markup says what they are (``article``, ``nav``, class ``ad``), from a
bounded sample of pages and from a few seed pages. There are two ensembles. One sees names and
kinds and decides where a node or an ancestor is named; the other sees kinds, density and place
alone, carries pages without telling markup, and counts a little everywhere.

Decoding chooses for every node whether it is open or dropped, so that the sum of the log-odds is
largest and no node is open below a dropped one. It is one pass up and one pass down each page's
tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Pages that training reads at most.
SAMPLE = 400
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
#: Pages are parsed in parts of about this size, or one by one.
PART_BYTES = 1 << 20

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements whose text is not shown as part of a page's text.
_UNSEEN = set("head script style template noscript iframe object svg math canvas audio video select option datalist textarea title noembed noframes".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag closes, if it is open within the given containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tbody": ({"tbody", "thead", "tr"}, {"table"}), "tfoot": ({"tbody", "tr"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_BOILER_TAGS = set("nav footer aside form menu dialog button input label fieldset".split())
_BOILER_TOKENS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb "
                     "breadcrumbs toolbar tabs pagination pager header masthead footer contentinfo copyright legal sidebar aside complementary related "
                     "recommended trending widget notice notification cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription "
                     "paywall form search login signin signup comment comments commentlist reply replies respond disqus discussion share sharing social "
                     "hidden invisible skip".split())
_CONTENT_TOKENS = set("article articlebody content entry main post story".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Pages with the label of the nodes that their markup leaves unknown.
SEEDS = [
    ("<body><header class=top><a href=/>Home</a></header><nav><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></nav><main><h1>A title of some length</h1>"
    "<p>The first paragraph of a story tells what happened, where, and to whom it did.</p><p>Another one follows, with more words, and commas, and a full stop.</p>"
    "<aside>Related: <a href=3>other story</a></aside></main><section class=comments><h2>Comments</h2><p>I do not agree with this at all, it was a long day.</p></section>"
    "<footer>&copy; All rights reserved. <a href=4>Imprint</a></footer></body>", -1),
    ("<body><div id=cookie-notice>We use cookies. <button>Accept</button></div><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div class=post><h2>Heading here</h2>"
    "<div class=entry><p>Some long running text that fills a whole paragraph, as stories do, with sentences. It goes on.</p><ul><li>A point that is made here.</li>"
    "<li>And the next point, which is longer.</li></ul><form><label>Mail</label><input></form></div></div><div class='sidebar widget'><p>Popular: <a href=5>this</a></p></div>"
    "<div class=ad>Buy this now.</div><div id=comments><article><p>First comment by a reader, quite long, with an opinion in it.</p></article></div></body>", -1),
    ("<body><article><header><h1>Title</h1></header><p>Text with a <a href=1>link</a> inside and enough words around it to be a paragraph of prose.</p><blockquote>A quote, "
    "taken from elsewhere.</blockquote><div class=advertisement><p>Sponsored message of the day.</p></div><p>The end of the text, in one more paragraph.</p></article>"
    "<div role=navigation><a href=2>Next</a></div><form><p>Sign up for our letter today.</p></form></body>", -1),
    ("Plain text without any markup, as some pages are. It is all there is.", 1), ("<p>Short.</p>", 1), ("<body>Loose text, and more.<p>And a paragraph.</p></body>", 1),
    ("<div><h2>Title</h2><p>One paragraph, alone on its page, with a stop.</p><p>And one more.</p></div>", 1), ("<h1>Only a title</h1>", 1),
]


class Page:
    """A page's nodes and text pieces, in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.hidden = ["html"], [-1], [()], [False]
        self.text: list[tuple[int, int, str]] = []  # (block, node, text)
        self.places: dict[str, list[int]] = {}  # of the open tags in the stack, so that none is searched for
        stack, block, at = [0], 0, 0
        n = len(source)
        while at < n:
            lt = source.find("<", at)
            m = None
            while lt >= 0:
                m = _TAG.match(source, lt)
                if m:
                    break
                lt = source.find("<", lt + 1)
            if (lt if m else n) > at and not self.hidden[stack[-1]]:
                self.text.append((block, stack[-1], html.unescape(source[at:lt if m else n])))
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:  # end tag
                if name in _BLOCK:
                    block += 1
                outer = () if name in ("table", "body", "html") else ("table", "body")
                self._close(stack, (name,), outer)
                continue
            if name in ("html", "body") and name in self.tag[:3]:
                continue
            if name in _BLOCK:
                block += 1
                self._close(stack, {"p"}, {"table", "td", "th", "button", "object"})
            if name in _HEADING:
                self._close(stack, _HEADING, {"div", "section", "article", "td", "body"})
            if name in _CLOSES:
                self._close(stack, *_CLOSES[name])
            if name in _VOID:
                if not self.hidden[stack[-1]]:
                    self.text.append((block, stack[-1], " " if name == "br" else ""))
                continue
            tokens, unseen = self._attributes(m[3]) if len(m[3]) > 1 else ((), False)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.tokens.append(tokens)
            self.hidden.append(unseen or name in _UNSEEN or self.hidden[stack[-1]])
            if name in _RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
            elif not m[0].endswith("/>") or name in _BLOCK or name == "a":
                self.places.setdefault(name, []).append(len(stack))
                stack.append(len(self.tag) - 1)

    def _last(self, names) -> int:
        """The highest place of an open element of these names, 0 without any."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def _close(self, stack: list[int], names, within) -> None:
        """Close the last open element of ``names`` and all in it, if it is not outside of one of
        ``within``."""
        place = self._last(names)
        if place and place >= self._last(within):
            while len(stack) > place:
                self.places[self.tag[stack.pop()]].pop()

    @staticmethod
    def _attributes(source: str) -> tuple[tuple, bool]:
        tokens: list[str] = []
        unseen = False
        for m in _ATTRIBUTE.finditer(source):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                tokens += [t.lower() for t in _TOKEN.findall(html.unescape(value))]
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                unseen = True
        return tuple(tokens), unseen


_KINDS = [{"p"}, _HEADING, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"a"}, {"div", "section", "span"}, {"blockquote", "pre", "figure"}]
#: Features that names give; the first ``EVIDENCE`` say what a node or an ancestor is.
NAMED, EVIDENCE = 8, 6
#: What density and place count where there is evidence.
LITTLE = 0.25
N_FEATURES = NAMED + len(_KINDS) + 14


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """A row per node, and weak labels (1 main text, 0 not, -1 unknown)."""
    n = len(page.tag)
    parent = page.parent
    own, links, stops, pieces = ([0] * n for _ in range(4))
    inside_link = [False] * n
    depth = [0] * n
    for i in range(1, n):
        inside_link[i] = page.tag[i] == "a" or inside_link[parent[i]]
        depth[i] = depth[parent[i]] + 1
    first_at = [0] * n
    total = 0
    for _, i, t in page.text:
        size = len(t) - t.count(" ") - t.count("\n")
        if size:
            if not pieces[i]:
                first_at[i] = total
            own[i] += size
            pieces[i] += 1
            links[i] += size * inside_link[i]
            stops[i] += t.count(".") + t.count(",")
            total += size
    sub, sub_links, sub_stops, nodes, paragraphs, heads = own[:], links[:], stops[:], [1] * n, [int(t == "p") for t in page.tag], [t in ("main", "h1") for t in page.tag]
    children = [0] * n
    before: list[int] = [0] * n
    same = [0] * n
    seen: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        before[i] = children[p]
        children[p] += 1
        seen[p, page.tag[i]] = seen.get((p, page.tag[i]), 0) + 1
    for i in range(1, n):
        same[i] = seen[parent[i], page.tag[i]]
    start = [total] * n
    for i in range(n - 1, -1, -1):
        if pieces[i]:
            start[i] = min(start[i], first_at[i])
        if i:
            p = parent[i]
            sub[p] += sub[i]
            sub_links[p] += sub_links[i]
            sub_stops[p] += sub_stops[i]
            nodes[p] += nodes[i]
            paragraphs[p] += paragraphs[i]
            heads[p] = heads[p] or heads[i]
            start[p] = min(start[p], start[i])
    rows, labels = np.zeros((n, N_FEATURES)), np.full(n, -1)
    above_boiler, above_content = [False] * n, [False] * n
    for i in range(1, n):
        tag, tokens, p = page.tag[i], page.tokens[i], parent[i]
        told = () if tag in ("body", "html") or heads[i] else tokens
        # a heading's class often says that it heads a section
        bad = sum(t in _BOILER_TOKENS and not (tag in _HEADING and t in ("header", "masthead")) for t in told)
        good = sum(t in _CONTENT_TOKENS for t in tokens) if tag not in ("body", "html") else 0
        top = tag == "header" and not above_content[p]
        boiler = bool(bad) or tag in _BOILER_TAGS or top
        content = (bool(good) or tag in ("article", "main")) and not bad
        up_bad, up_good = above_boiler[p], above_content[p]
        above_boiler[i], above_content[i] = up_bad or boiler, up_good or content
        rows[i, :NAMED] = (tag in _BOILER_TAGS or top, bad, good, tag in ("article", "main"), up_bad, up_good, tag == "header", len(tokens))
        if boiler or up_bad:
            labels[i] = 0
        elif (content or up_good) and tag != "header":
            labels[i] = 1
        for k, kind in enumerate(_KINDS):
            rows[i, NAMED + k] = tag in kind
        whole = max(1, total)
        rows[i, NAMED + len(_KINDS):] = (
            depth[i], before[i], children[p], same[i], np.log1p(sub[i]), np.log1p(own[i]), sub_links[i] / max(1, sub[i]), sub[i] / nodes[i], np.log1p(nodes[i]),
            paragraphs[i], 100 * sub_stops[i] / max(1, sub[i]), sub[i] / whole, start[i] / whole, (start[i] + sub[i]) / whole)
    return rows, labels


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees for the log loss: trees of ``DEPTH`` levels on quantile bins. Without
    examples the log-odds are 0 everywhere."""
    empty = {"base": 0.0, "feature": np.zeros((0, 2 ** DEPTH - 1), np.int64), "cut": np.zeros((0, 2 ** DEPTH - 1)), "leaf": np.zeros((0, 2 ** DEPTH))}
    if not len(y):
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = min(max(y.mean(), 0.02), 0.98)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    out = {k: [] for k in ("feature", "cut", "leaf")}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, np.inf)
        for level in range(DEPTH):
            width = 2 ** level
            best = np.full(width, 1e-6)
            pick_f, pick_b = np.zeros(width, np.int64), np.full(width, BINS + 1)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                key = node * (BINS + 1) + binned[:, f]
                sums = [np.bincount(key, w, minlength=width * (BINS + 1)).reshape(width, -1) for w in (g, h)]
                left_g, left_h = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
                all_g, all_h = (s.sum(axis=1, keepdims=True) for s in sums)
                gain = left_g ** 2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g ** 2 / (all_h + 1)
                gain[:, len(cuts[f]):] = 0
                b = gain.argmax(axis=1)
                value = gain[np.arange(width), b]
                better = value > best
                best[better], pick_f[better], pick_b[better] = value[better], f, b[better]
            for w in range(width):
                feature[width - 1 + w] = pick_f[w]
                if pick_b[w] <= BINS:
                    cut[width - 1 + w] = cuts[pick_f[w]][pick_b[w]]
            node = 2 * node + (binned[np.arange(len(y)), pick_f[node]] > pick_b[node])
        leaf = np.bincount(node, g, minlength=2 ** DEPTH) / (np.bincount(node, h, minlength=2 ** DEPTH) + 1)
        score += RATE * leaf[node]
        for k, v in (("feature", feature), ("cut", cut), ("leaf", RATE * leaf)):
            out[k].append(v)
    return {"base": base} | {k: np.array(v) for k, v in out.items()}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        out += leaf[node - (2 ** DEPTH - 1)]
    return out


def decode(parent: list[int], weight: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Which nodes are open: the choice of largest total log-odds (open counts plus, dropped
    minus) without an open node below a dropped one. The root is open."""
    n = len(parent)
    value = weight * odds
    kept, dropped = value.copy(), -value
    for i in range(n - 1, 0, -1):
        kept[parent[i]] += max(kept[i], dropped[i])
        dropped[parent[i]] += dropped[i]
    open_ = np.ones(n, bool)
    for i in range(1, n):
        open_[i] = open_[parent[i]] and kept[i] >= dropped[i]
    return open_


def main_text(page: Page, odds: np.ndarray) -> str:
    """The blocks of open nodes, in page order."""
    carrier = list(range(len(page.tag)))  # inline elements go with their block, unless named as something else
    for i in range(1, len(carrier)):
        if page.tag[i] not in _BLOCK and page.tag[i] not in _BOILER_TAGS and not any(t in _BOILER_TOKENS for t in page.tokens[i]):
            carrier[i] = carrier[page.parent[i]]
    own = np.zeros(len(carrier))
    for _, i, t in page.text:
        own[carrier[i]] += len(t.strip())
    weight = np.where(own > 0, 1 + np.log1p(own), np.where(np.array(carrier) == np.arange(len(carrier)), 0.25, 0.0))
    open_ = decode(page.parent, weight, odds)
    blocks: dict[int, list[str]] = {}
    for block, i, t in page.text:
        if open_[carrier[i]] and odds[carrier[i]] >= 0:
            blocks.setdefault(block, []).append(t)
    return "\n".join(x for x in (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items())) if x)


def learn(x: np.ndarray, y: np.ndarray) -> dict:
    """Both ensembles, from labelled nodes."""
    named = x[:, :EVIDENCE].any(axis=1)
    kinds = NAMED + len(_KINDS)
    return {"names": fit(x[named, :kinds], y[named]), "shape": fit(x[:, NAMED:], y)}


def odds_of(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of each node."""
    shape = log_odds(model["shape"], x[:, NAMED:])
    names = log_odds(model["names"], x[:, :NAMED + len(_KINDS)])
    return np.where(x[:, :EVIDENCE].any(axis=1), names + LITTLE * shape, shape)


def _labelled(text: str | None, rest: int = -1) -> tuple[np.ndarray, np.ndarray]:
    x, y = features(Page(text or ""))
    y = np.where(y < 0, rest, y)
    return x[y >= 0], y[y >= 0].astype(np.int64)


def sample(pages: DataFrame, limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Labelled nodes of at most ``limit`` pages, the first by a hash of page_id, and of the seed
    pages, which count as often as 50 pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_labelled(t) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())],
                                             names=["page_id", "x", "y"])

    picked = pages.select("page_id", "html").where("html is not null").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(limit)
    found = sorted(picked.mapInArrow(run, "page_id long, x binary, y binary").collect(), key=lambda r: (str(r.page_id), bytes(r.x)))
    seeds = [_labelled(*seed) for seed in SEEDS] * max(1, 50 // len(SEEDS))
    x = [a for a, _ in seeds] + [np.frombuffer(r.x).reshape(-1, N_FEATURES) for r in found]
    y = [b for _, b in seeds] + [np.frombuffer(r.y, np.int64) for r in found]
    return np.concatenate(x), np.concatenate(y).astype(float)


def texts_of(sources: list[str | None], model: dict) -> list[str]:
    pages = [Page(s or "") for s in sources]
    rows = [features(p)[0] for p in pages]
    odds = odds_of(model, np.concatenate([*rows, np.zeros((0, N_FEATURES))]))
    cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return [main_text(p, odds[a:b]) for p, a, b in zip(pages, cut[:-1], cut[1:])]


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    The whole html is read. Character references are decoded, white space within a block becomes
    one space, blocks are trimmed and joined by line ends in page order. Null and empty html, and
    pages without main text, give ''. Broken markup is closed as browsers do for the common
    cases; a page cut off in a tag keeps what stands before it. Other columns are not read.
    """
    model = model or learn(*sample(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = W.text_bytes(batch.column("html"))
            for lo, hi in W.chunks(offs, PART_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = texts_of(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
