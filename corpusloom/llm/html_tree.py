"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node that is content or not.  A node's own features and its parent's state (potentials for parent and
child) give the model; messages passed from the leaves up and from the root down give each node's exact marginal.  The
weights are fitted by the gradient of the likelihood, observed minus expected counts, both from the same messages, on
labelled pages: layouts written out below with their labels, and a bounded number of given pages whose own markup names
the article.  Among a node's features is where it stands: inside an article or not, and in which part beside one.  A block of
text belongs to the output if the marginal of its block element is at least one half (exactly one half counts).

White space inside a block (a paragraph, heading, list item, …) is one space, character references are decoded, blocks
are joined by line feeds in page order.  Inputs: null pages are empty and give an empty text; repeated rows are read
each; an empty table gives no rows; other columns are ignored; unclosed, unknown and broken tags are read as they come; pages
of any length and depth are read whole, level by level.
"""

from __future__ import annotations

import html
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 11
MAX_PAGES = 300
# Names of HTML, fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe".split())
# Skipped with what they hold, but only where they have an end tag; these may nest.
_SKIPPED = frozenset("noscript svg template select".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_PARAGRAPH = _BLOCK - frozenset("body head html button caption legend option tbody td tfoot th thead tr li dd dt summary".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol menu dl table".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SLASH_IN_VALUE = re.compile(r"""=\s*[^\s"'=]*/\Z""")
_WORD = re.compile(r"[a-z]+|[0-9]+")
# What a page's own markup says about parts that are not the article, for labelling given pages.
_ASIDE_TAGS = frozenset("nav header footer aside form button script style noscript menu dialog".split())
_ASIDE_NAMES = frozenset("ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert sidebar widget menu nav navigation breadcrumb breadcrumbs header footer comment comments reply share social related newsletter subscribe popup modal".split())

_CONTENT_NAMES = frozenset("article content entry post story main".split())


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    return attributes.endswith("/") and not _SLASH_IN_VALUE.search(attributes)


def _raw_end(source: str, name: str, at: int) -> int | None:
    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
    return end.end() if end else None


def _skipped_ends(source: str) -> dict[int, int]:
    """Where the elements of ``_SKIPPED`` that have an end tag begin and end: an end tag belongs to the last one still open."""
    ends, opened, at = {}, {name: [] for name in _SKIPPED}, 0
    unclosed = set()
    for match in _TAG.finditer(source):
        if match.start() < at:
            continue
        name = (match.group(2) or match.group(5) or "").lower()
        closing, attributes = match.group(1) or match.group(4), match.group(3) or match.group(6) or ""
        if name in _RAW and not closing and name not in unclosed and not (opened["svg"] and _self_closed(attributes)):
            end = _raw_end(source, name, match.end())
            if end is None:
                unclosed.add(name)
            else:
                at = end
        elif name in _SKIPPED and closing:
            if opened[name]:
                ends[opened[name].pop()] = match.end()
        elif name in _SKIPPED and not (name == "svg" and _self_closed(attributes)):
            opened[name].append(match.start())
    return ends


class Page:
    """Elements in page order with their parents, and blocks of text with the element they stand in."""

    def __init__(self, source: str):
        self.tags, self.names, self.parent, self.depth = ["#page"], [()], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self.pieces: list[tuple[int, str]] = []
        stack, parts, where, at = [0], [], 0, 0
        skipped: dict[int, int] | None = None

        def flush() -> None:
            nonlocal parts
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    # Inline elements are judged with the block they stand in.
                    block = where
                    while block and self.tags[block] not in _BLOCK:
                        block = self.parent[block]
                    self.blocks.append((block, text))
                    self.pieces.append((where, text))
                parts = []

        for match in _TAG.finditer(source):
            start = match.start()
            if start < at:
                continue
            if start > at:
                piece = source[at:start]
                if not parts:
                    where = stack[-1]
                parts.append(piece)
            at = match.end()
            name = match.group(2) or match.group(5)
            if not name:
                continue
            name = name.lower()
            if match.group(1) or match.group(4):
                if name in _BLOCK:
                    flush()
                for i in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[i]] == name:
                        del stack[i:]
                        break
                    if name not in _BLOCK and self.tags[stack[i]] in _BLOCK:
                        break
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in _BLOCK:
                flush()
                self._close_implied(stack, name)
            node = len(self.tags)
            self.tags.append(name)
            attributes = match.group(3) or match.group(6) or ""
            self.names.append(tuple(dict.fromkeys(w for found in _NAMES.findall(attributes) for w in _WORD.findall(("".join(found)).lower()))) if "=" in attributes else ())
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            if name in _RAW:
                # Nothing inside these is text of the page.
                at = _raw_end(source, name, at) or len(source)
            elif name in _SKIPPED:
                if not (name == "svg" and _self_closed(attributes)):
                    skipped = _skipped_ends(source) if skipped is None else skipped
                    # Without an end tag only the tag itself is skipped.
                    at = skipped.get(start, at)
            elif name not in _VOID and not attributes.endswith("/"):
                stack.append(node)
        if at < len(source):
            if not parts:
                where = stack[-1]
            rest = source[at:]
            # A tag cut off at the end of the page is not text.
            parts.append(re.sub(r"<[/!a-zA-Z][^>]*\Z", "", rest))
        flush()

    def _close_implied(self, stack: list[int], name: str) -> None:
        ends = {"p"} if name in _CLOSES_PARAGRAPH or name in _SAME else set()
        ends |= _SAME.get(name, set())
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[i]]
            if tag in ends:
                del stack[i:]
            elif tag in _LISTS or (tag in _BLOCK and tag not in ("p", *ends) and name not in _SAME):
                break


def _contexts(page: Page) -> list[tuple[bool, str]]:
    """Whether a node is inside an article (or a part named like one), and the outermost part beside the article that it is in."""
    out: list[tuple[bool, str]] = []
    for node, tag in enumerate(page.tags):
        within, beside = out[page.parent[node]] if node else (False, "")
        names = () if tag in ("html", "body") else page.names[node]
        away, own = any(name in _ASIDE_NAMES for name in names), any(name in _CONTENT_NAMES for name in names)
        if not beside:
            if tag in _ASIDE_TAGS:
                beside = tag
            elif away and not own:
                beside = "named"
            elif away:
                beside = "mixed"
        out.append((within or tag in ("article", "main") or (own and not away), beside))
    return out


def _bucket(value: float, *steps: float) -> int:
    return sum(value >= s for s in steps)


_hashed: dict[str, int] = {}


def _feature(name: str) -> int:
    at = _hashed.get(name)
    if at is None:
        at = zlib.crc32(name.encode()) % FEATURES
        if len(_hashed) < 100_000:
            _hashed[name] = at
    return at


def _features(page: Page) -> tuple[list[int], list[int]]:
    """Feature numbers of all nodes one after the other, and how many each node has."""
    n = len(page.tags)
    text, linked, stops = [0] * n, [0] * n, [0] * n
    contexts = _contexts(page)
    for node, block in page.pieces:
        text[node] += len(block)
        stops[node] += block.count(".") + block.count(",")
        if page.tags[node] == "a":
            linked[node] += len(block)
    total = max(1, sum(text))
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        text[up] += text[node]
        stops[up] += stops[node]
        linked[up] += text[node] if page.tags[node] == "a" else linked[node]
    out, count = [], []
    for node, tag in enumerate(page.tags):
        size = text[node]
        shape = (_bucket(size, 1, 25, 80, 250, 1000), _bucket(linked[node] / size if size else 0, 0.2, 0.6), _bucket(stops[node] / size if size else 0, 0.005, 0.02), _bucket(size / total, 0.02, 0.2, 0.5))
        found = [_feature(f"tag {tag}"), _feature(f"under {page.tags[page.parent[node]]} {tag}"), _feature(f"shape {shape}"), _feature(f"{tag} shape {shape[:2]}")]
        found += [_feature(f"context {contexts[node]}"), _feature(f"beside {bool(contexts[node][1])}"), _feature(f"context {contexts[node]} shape {shape[0]}")]
        for name in page.names[node]:
            found.append(_feature(f"name {name}"))
        out += found
        count.append(len(found))
    return out, count


class Forest:
    """The nodes of several pages, ready for message passing level by level."""

    def __init__(self, pages: list[Page]):
        features, counts, parents, depths, base = [], [], [], [], 0
        self.first = []
        for page in pages:
            found, count = _features(page)
            features += found
            counts += count
            parents += [base + p for p in page.parent]
            depths += page.depth
            self.first.append(base)
            base += len(page.tags)
        self.features, self.parent, depth = np.array(features, np.int64), np.array(parents, np.int64), np.array(depths, np.int64)
        self.node = np.repeat(np.arange(base), counts)
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2)) if base else [0]
        self.levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.n = base

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content per node, and joint probabilities (parent state, state) per node; roots have none."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.node, weights=weights[self.features], minlength=self.n)
        inside = own.copy()  # own score and all messages from below
        up = np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp(pair[:, 0][None, :] + inside[level, :1], pair[:, 1][None, :] + inside[level, 1:])
            np.add.at(inside, self.parent[level], up[level])
        whole = inside.copy()
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            above = whole[self.parent[level]] - up[level]  # the parent without what this child told it
            both = above[:, :, None] + pair[None] + inside[level][:, None, :]
            top = both.max(axis=(1, 2), keepdims=True)
            joint[level] = np.exp(both - top)
            joint[level] /= joint[level].sum(axis=(1, 2), keepdims=True)
            down = np.logaddexp(above[:, 0, None] + pair[0][None], above[:, 1, None] + pair[1][None])
            down -= down.max(axis=1, keepdims=True)
            whole[level] = inside[level] + down
        top = whole.max(axis=1, keepdims=True)
        p = np.exp(whole - top)
        return p[:, 1] / p.sum(axis=1), joint


def fit(pages: list[Page], labels: list[list[int]], steps: int = 120, rate: float = 0.25, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of (parent state, state) by gradient ascent on the likelihood of the labels."""
    forest = Forest(pages)
    y = np.array([label for page in labels for label in page])
    child = np.concatenate(forest.levels[1:]) if len(forest.levels) > 1 else np.zeros(0, np.int64)
    weights, pair = np.zeros(FEATURES), np.zeros((2, 2))
    seen_pair = np.zeros((2, 2))
    np.add.at(seen_pair, (y[forest.parent[child]], y[child]), 1)
    seen = np.bincount(forest.features, weights=y[forest.node], minlength=FEATURES)
    square_w, square_p = np.full(FEATURES, 1e-3), np.full((2, 2), 1e-3)
    for _ in range(steps):
        p, joint = forest.marginals(weights, pair)
        g = (seen - np.bincount(forest.features, weights=p[forest.node], minlength=FEATURES)) / len(pages) - ridge * weights
        h = (seen_pair - joint[child].sum(axis=0)) / len(pages) - ridge * pair
        square_w, square_p = square_w + g * g, square_p + h * h
        weights += rate * g / np.sqrt(square_w)
        pair += rate * h / np.sqrt(square_p)
    return weights, pair


def own_labels(page: Page) -> list[int] | None:
    """Labels from the page's own markup: inside its only article (or main) and in nothing that names itself otherwise."""
    for tag in ("article", "main"):
        if page.tags.count(tag) == 1:
            break
    else:
        return None
    inside, beside = [False] * len(page.tags), [False] * len(page.tags)
    for node in range(1, len(page.tags)):
        up = page.parent[node]
        inside[node] = inside[up] or page.tags[node] == tag
        beside[node] = beside[up] or page.tags[node] in _ASIDE_TAGS or any(name in _ASIDE_NAMES for name in page.names[node])
    return [int(a and not b) for a, b in zip(inside, beside, strict=True)]


_LONG = "The river had risen in the night, and by the morning the lower meadow was under water. Nobody had seen it so high since the old bridge was taken away."
_SHORT = "It was a quiet year for the valley, all told."
# Layouts of whole pages; the content stands between the braces.
_SHELLS = (
    "<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav>{}<footer>&copy; All rights reserved</footer></body>",
    "<body><header><h1>The Daily Page</h1><div class=menu><a href=/>News</a><a href=/s>Sports</a></div></header>{}<aside class=sidebar><h3>Popular</h3><ul><li><a href=/1>Ten things</a></li><li><a href=/2>Seven more</a></li></ul></aside><footer><p>Imprint</p></footer></body>",
    "<body><div id=cookie-notice class=banner><p>We use cookies to make this page better for you.</p><button>Accept</button></div><div class=header><a href=/>Home</a></div>{}<div class=footer><a href=/c>Contact</a> | <a href=/p>Privacy</a></div></body>",
    "<body><div class=ad>Buy now, only this week, at a very low price.</div>{}<div class=comments><h3>Comments</h3><div class=comment><p>I do not agree with this at all, and I will say why in a moment.</p></div></div><form class=newsletter><label>Your address</label><input><button>Subscribe</button></form></body>",
    "<body><div class=nav><ul><li><a href=/x>Start</a><li><a href=/y>Archive</a></ul></div><div class=notice>This page moves to a new address soon.</div>{}<section class=related><h2>Read next</h2><p><a href=/z>Another story of the river and its bridges</a></p></section><footer>Contact us</footer></body>",
)
_CONTENTS = ("<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class=content>{}</div>", "<div id=post class='entry post-content'><section>{}</section></div>", "<div>{}</div>", "<article><header class=title>{}</header></article>")
_BODIES = (
    f"<h1>High water</h1><p>{_LONG}</p><p>{_SHORT}</p>",
    f"<h1>High water</h1><p><b>{_SHORT}<br><p>{_LONG}</p><p>{_LONG} {_LONG}</p>",
    f"<h2>Notes</h2><p>{_LONG} <a href=/b>The bridge</a> was mended.</p><ul><li>{_SHORT}</li><li>{_LONG}</li></ul><blockquote>{_SHORT}</blockquote>",
    f"<h1>Short</h1><p>{_SHORT}</p>",
    f"<h1>Numbers</h1><table><tr><td>Year</td><td>{_SHORT}</td></tr></table><p>{_LONG}</p><div class=ad>An offer, only for readers of this page.</div><p>{_LONG}</p>",
)


# Parts beside the article, and what may stand in them: as long and as plain as the article's own text.
_PARTS = (
    "<nav>{}</nav>", "<div class=nav>{}</div>", "<header>{}</header>", "<div id=header>{}</div>", "<footer>{}</footer>", "<div class=footer>{}</div>", "<aside>{}</aside>", "<aside class=sidebar>{}</aside>",
    "<div class=sidebar>{}</div>", "<div class=widget>{}</div>", "<form>{}</form>", "<div class=cookie-notice>{}</div>", "<div class=ad>{}</div>", "<div class='sponsored promo'>{}</div>", "<div id=comments><ol><li>{}</li></ol></div>",
    "<section class=comments>{}</section>", "<section class=comments><article class=comment>{}</article></section>", "<div class=related>{}</div>", "<div class=newsletter>{}</div>", "<div class=share>{}</div>", "<div class=popup>{}</div>",
    "<dialog>{}</dialog>", "<menu>{}</menu>", "<div class='alert banner'>{}</div>",
)
_FILLINGS = (
    f"<p>{_LONG}</p>", f"<p>{_LONG} {_SHORT}</p><p>{_LONG}</p>", "<ul><li><a href=/1>Ten things</a></li><li><a href=/2>Seven more</a></li></ul>", f"<h3>More</h3><p>{_SHORT}</p>", _SHORT, f"<div><div><p>{_LONG}</p></div></div>",
)
_ARTICLES = (
    "<article>{0}{1}</article>", "<main><article>{0}{1}</article></main>", "<main>{0}{1}</main>", "<div class=content>{0}{1}</div>", "<article><header><h1>High water</h1></header>{0}{1}</article>",
    "<div id=post class='entry post-content'><section>{0}{1}</section></div>",
)
_TEXTS = (
    *_BODIES,
    f"<h1>Links</h1><p>{_LONG}</p><ul><li><a href=/1>The bridge</a></li><li>{_SHORT}</li><li><a href=/2>The meadow</a></li></ul>",
    f"<h1>Figure</h1><p>{_LONG}</p><figure><img src=a><figcaption>{_SHORT}</figcaption></figure><pre>a = 1</pre><ol><li>One</li><li>Two</li></ol>",
    f"<h1>Table</h1><table><tr><th>Year</th><th>Height</th></tr><tr><td>1900</td><td><a href=/3>Two</a></td></tr></table><dl><dt>Bank</dt><dd>{_SHORT}</dd></dl><p>{_SHORT}</p>",
)


def _labelled(source: str) -> tuple[Page, list[int]]:
    """A page whose content stands between the markers x-begin and x-end, without what stands between x-off and x-on."""
    page = Page("<html><head><title>t</title></head>" + source + "</html>")
    labels, within, beside = [], False, False
    for node, tag in enumerate(page.tags):
        within, beside = (within or tag == "x-begin") and tag != "x-end", (beside or tag == "x-off") and tag != "x-on"
        labels.append(int(within and not beside and "ad" not in page.names[node] and not tag.startswith("x-")))
        if tag.startswith("x-"):
            page.tags[node] = "wbr"  # the markers are no part of the page
    return page, labels


def labelled_pages() -> list[tuple[Page, list[int]]]:
    """The layouts above with their labels: every shell with every body, and every part before, behind and in an article."""
    mark = lambda text: f"<x-begin></x-begin>{text}<x-end></x-end>"
    out = [_labelled(shell.format(mark(content.format(body)))) for shell, content, body in itertools.product(_SHELLS, _CONTENTS[:-1], _BODIES)]
    turn = itertools.count()
    for part, filling, place in itertools.product(_PARTS, _FILLINGS, ("before", "behind", "in")):
        if place == "in" and "header" in part:  # the header of an article is its own
            continue
        k = next(turn)
        beside = f"<x-off></x-off>{part.format(filling)}<x-on></x-on>"
        article = _ARTICLES[k % len(_ARTICLES)].format(_TEXTS[k % len(_TEXTS)], beside if place == "in" else "")
        article = mark(article)
        body = {"before": beside + article, "behind": article + beside, "in": article}[place]
        out.append(_labelled("<body><nav><a href=/>Home</a></nav>" * (k % 2) + "<body>" * (1 - k % 2) + body + "<footer>Imprint</footer></body>"))
    return out


def train_tree_model(pages: DataFrame, max_pages: int = MAX_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the labelled layouts and from at most ``max_pages`` of the given pages, those whose key hashes lowest."""
    chosen = pages.filter("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    # At most max_pages keys; a repeated key may bring more rows.
    rows = pages.join(F.broadcast(chosen.distinct()), "page_id", "left_semi").select("html").limit(max_pages).collect()
    given = [(page, labels) for page in (Page(row["html"] or "") for row in rows) if (labels := own_labels(page))]
    every = labelled_pages() + given
    return fit([page for page, _ in every], [labels for _, labels in every])


def extract(pages: list[Page], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    if not pages:
        return []
    forest = Forest(pages)
    content = forest.marginals(weights, pair)[0] >= 0.5
    return ["\n".join(text for node, text in page.blocks if content[first + node]) for page, first in zip(pages, forest.first, strict=True)]


def _extract_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pair = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = extract([Page(source or "") for source in pc.fill_null(part.column(2), "").to_pylist()], weights, pair)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""
    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    model = pages.sparkSession.sparkContext.broadcast(train_tree_model(typed, max_pages))  # a fixed number of weights
    return typed.mapInArrow(_extract_rows(model), "page_id long, url string, text string, n_chars long")
