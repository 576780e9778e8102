"""HTML extraction by a tree-structured graphical model over the DOM.

Every block element is a variable: content or not. Its own evidence (tag, class and id words, how much text it holds
and how much of that is links) is a log-linear potential, and each parent and child share a potential by the child's
kind. Sum-product messages go up the tree and down again; they give the exact marginal of every element, and text is
kept where its element's marginal is at least one half. All weights are trained on labelled pages by the gradient of
the exact likelihood, whose expectations come from the same messages.

The tables hold no labelled pages. ``labelled_pages`` makes them from seeded templates with menus, headers, footers,
sidebars, notices, adverts, forms and reader comments around articles of many shapes; other labelled pages can be given
to ``train``: pages whose elements carry ``data-content="1"`` or ``"0"``.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm.markup import RAW, attributes, decoded, tokens
from driftfield.llm.shared import arrow_mapped, byte_sizes, slices, texts_of

#: Elements that are blocks, that have no end, whose inside is no text, and what a start tag closes.
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
SILENT = frozenset("head iframe math noembed noframes noscript object script style svg template title".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
APART_TAGS = frozenset("nav header footer aside form menu fieldset button select dialog textarea".split())

_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Tree:
    """The block elements of a page in page order: parent, tag, names, and text runs as (element, text, in a link)."""

    def __init__(self, page: str):
        self.parent, self.tag, self.names, self.label = [-1], ["body"], [""], [None]
        self.runs: list[tuple[int, str, bool]] = []
        self._parse(page)

    def _parse(self, page: str) -> None:
        """Open elements are kept by depth and, for each tag, as a list of depths, so that no tag has to search them."""
        stack, depths, link, skip, runs = [0], {}, False, 0, self.runs

        def close(depth: int) -> None:
            while len(stack) > depth:
                depths[self.tag[stack.pop()]].pop()

        def last(tags: tuple[str, ...]) -> int:
            return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

        for text, tag, end, rest in tokens(page):
            if not tag:
                if not skip:
                    runs.append((stack[-1], text, link))
            elif tag in SILENT:
                if tag not in RAW:
                    skip = max(0, skip - 1) if end else skip + 1 if not rest.endswith("/") else skip
            elif tag == "body":  # what comes before it has no text
                skip = 0
                if not end:
                    self._name(0, rest)
            elif tag == "a":
                link = not end
            elif tag == "br":
                runs.append((stack[-1], " ", link))
            elif tag in BLOCKS and tag != "html":
                runs.append((stack[-1], " ", False))
                link = False
                if end:
                    if depths.get(tag):
                        close(depths[tag][-1])
                    continue
                if self.tag[stack[-1]] == "p" and len(stack) > 1 and tag not in ("option", "button", "select", "textarea"):
                    close(len(stack) - 1)
                if tag in CLOSES and (k := last(CLOSES[tag])) > last(LIMITS[tag]):
                    close(k)
                self.parent.append(stack[-1])
                self.tag.append(tag)
                self.names.append("")
                self.label.append(None)
                self._name(len(self.tag) - 1, rest)
                if tag not in ("textarea", "hr") and not rest.endswith("/"):
                    depths.setdefault(tag, []).append(len(stack))
                    stack.append(len(self.tag) - 1)

    def _name(self, i: int, rest: str) -> None:
        if rest:
            own = dict(attributes(rest))
            self.names[i] = " ".join(own[k] for k in own if k in ("class", "id", "role"))
            if own.get("data-content") in ("0", "1"):
                self.label[i] = int(own["data-content"])

    def text(self, keep: list[bool]) -> str:
        return " ".join("".join([decoded(x) if keep[i] else " " for i, x, _ in self.runs]).split())


def evidence(tree: Tree) -> list[list[str]]:
    """Names of the features of every element."""
    n = len(tree.tag)
    words, linked = [0] * n, [0] * n
    for i, x, link in tree.runs:
        if len(x) > 1:
            k = x.count(" ") + 1
            words[i] += k
            if link:
                linked[i] += k
    all_words, all_linked = words[:], linked[:]
    for i in range(n - 1, 0, -1):
        all_words[tree.parent[i]] += all_words[i]
        all_linked[tree.parent[i]] += all_linked[i]
    out = []
    for i in range(n):
        w, share = all_words[i], all_linked[i] / all_words[i] if all_words[i] else 0.0
        out.append(["bias", f"tag={tree.tag[i]}", f"words={0 if not w else min(5, 1 + int(math.log2(w) / 1.5))}", f"links={min(3, int(share * 4))}", *({f"name={x.lower()}" for x in _PART.findall(tree.names[i])} if tree.names[i] else [f"plain={tree.tag[i]}"])])
    return out


def kind(tag: str) -> int:
    """Of an element as a child: text, set apart by its tag, or a container."""
    return 0 if tag in TEXT_TAGS else 1 if tag in APART_TAGS else 2


def _join(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class Model:
    """Weights of features, and of (parent's state, child's state) for each kind of child."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs

    def beliefs(self, tree: Tree, own: list[float]) -> tuple[list[float], list[list[float]]]:
        """Marginal of every element, and log-odds-free joint beliefs of every element with its parent (four values each)."""
        n, parent = len(own), tree.parent
        b0, b1 = [0.0] * n, list(own)
        m0, m1 = [0.0] * n, [0.0] * n
        pairs = [self.pairs[kind(t)] for t in tree.tag]
        for i in range(n - 1, 0, -1):
            p, (t00, t01, t10, t11) = parent[i], pairs[i]
            m0[i], m1[i] = _join(b0[i] + t00, b1[i] + t01), _join(b0[i] + t10, b1[i] + t11)
            b0[p] += m0[i]
            b1[p] += m1[i]
        joint: list[list[float]] = [[0.0] * 4] * n
        full0, full1 = b0[:], b1[:]
        for i in range(1, n):
            p, (t00, t01, t10, t11) = parent[i], pairs[i]
            a0, a1 = full0[p] - m0[i], full1[p] - m1[i]
            joint[i] = [a0 + t00 + b0[i], a0 + t01 + b1[i], a1 + t10 + b0[i], a1 + t11 + b1[i]]
            full0[i], full1[i] = _join(joint[i][0], joint[i][2]), _join(joint[i][1], joint[i][3])
        odds = [full1[i] - full0[i] for i in range(n)]
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in odds], joint

    def marginals(self, tree: Tree) -> list[float]:
        get = self.weights.get
        return self.beliefs(tree, [sum(get(f, 0.0) for f in fs) for fs in evidence(tree)])[0]

    def extract(self, page: str | None) -> str:
        """Main text of a page; empty for a null or empty one."""
        if not page:
            return ""
        tree = Tree(page)
        keep = [m >= 0.5 for m in self.marginals(tree)]
        return tree.text(keep)


def train(pages: Iterable[str], rounds: int = 140, rate: float = 1.0, decay: float = 1e-3) -> Model:
    """A model from pages whose block elements carry labels; an element without one has its parent's."""
    data = []
    for page in pages:
        tree = Tree(page)
        y = [tree.label[0] or 0]
        for i in range(1, len(tree.tag)):
            y.append(tree.label[i] if tree.label[i] is not None else y[tree.parent[i]])
        data.append((tree, evidence(tree), y))
    weights = dict.fromkeys((f for _, fs, _ in data for x in fs for f in x), 0.0)
    pairs = [[0.0] * 4 for _ in range(3)]
    squares = dict.fromkeys(weights, 1e-8)
    pair_squares = [[1e-8] * 4 for _ in range(3)]
    total = max(1, sum(len(y) for _, _, y in data))
    for _ in range(rounds):
        model, grad, pair_grad = Model(weights, pairs), dict.fromkeys(weights, 0.0), [[0.0] * 4 for _ in range(3)]
        for tree, features, y in data:
            marginal, joint = model.beliefs(tree, [sum(weights[f] for f in fs) for fs in features])
            for i, fs in enumerate(features):
                g = (y[i] - marginal[i]) / total
                for f in fs:
                    grad[f] += g
                if i:
                    top = max(joint[i])
                    e = [math.exp(x - top) for x in joint[i]]
                    z, at = sum(e), pair_grad[kind(tree.tag[i])]
                    for s in range(4):
                        at[s] -= e[s] / z / total
                    at[2 * y[tree.parent[i]] + y[i]] += 1 / total
        for f in weights:
            g = grad[f] - decay * weights[f] / 10
            squares[f] += g * g
            weights[f] += rate * g / math.sqrt(squares[f])
        for k in range(3):
            for s in range(4):
                g = pair_grad[k][s] - decay * pairs[k][s] / 10
                pair_squares[k][s] += g * g
                pairs[k][s] += rate * g / math.sqrt(pair_squares[k][s])
    return Model(weights, pairs)


#: Names that templates give to elements of content, and to what is set apart. They are examples to learn from, not rules.
CONTENT_NAMES = ["article", "article-body", "post", "post-content", "entry-content", "story", "content", "main-content", "article__text", "page-body", "text", "content-wrapper"]
APART_NAMES = {
    "menu": ["menu", "nav", "main-nav", "navbar", "breadcrumbs", "top-menu", "pagination", "tabs"], "header": ["header", "site-header", "masthead", "top-bar", "logo", "branding"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom-links"], "side": ["sidebar", "side", "related", "related-posts", "widget", "trending", "recommended", "most-read", "tags", "share", "social-links"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "message"], "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "promotion", "banner", "teaser"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact-form"], "comments": ["comments", "comment-list", "comment", "reader-comments", "replies", "discussion", "responses", "user-comments"],
}


def labelled_pages(n: int = 240, seed: int = 7) -> list[str]:
    """Pages from templates: the same seed makes the same pages. Elements of the article are labelled 1, all others 0."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9)))

    def sentence(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", "", "!"])

    def prose(a: int, b: int) -> str:
        s = sentence(a, b)
        return f"{sentence(1, 5)} <a href='#'>{word()}</a> {s}" if rng.random() < 0.15 else f"<b>{word()}</b> {s}<br>" if rng.random() < 0.15 else s

    def element(tag: str, y: int, inner: str, name: str = "") -> str:
        how = f' class="{name}"' if name and rng.random() < 0.7 else f' id="{name}"' if name else ""
        return f'<{tag}{how} data-content="{y}">{inner}</{tag}>'

    def links(y: int = 0) -> str:
        return element("ul", y, "".join(element("li", y, f"<a href='/{word()}'>{sentence(1, 3)}</a>") for _ in range(rng.randint(2, 8))))

    def paragraph() -> str:
        r = rng.random()
        if r < 0.76:
            return element("p", 1, prose(*rng.choice([(1, 3), (4, 12), (15, 60), (30, 120)])))
        if r < 0.84:
            return element(rng.choice(["h2", "h3"]), 1, sentence(1, 7))
        if r < 0.89:
            return element(rng.choice(["ul", "ol"]), 1, "".join(element("li", 1, prose(2, 14)) for _ in range(rng.randint(1, 5))))
        if r < 0.93:
            return element("blockquote", 1, element("p", 1, prose(5, 30)) if rng.random() < 0.6 else prose(5, 30))
        if r < 0.95:
            return element("pre", 1, sentence(4, 20))
        if r < 0.97:
            return element("table", 1, "".join(element("tr", 1, element("td", 1, sentence(1, 3)) + element("td", 1, sentence(1, 4))) for _ in range(rng.randint(1, 4))))
        return element("figure", 1, element("figcaption", 1, sentence(3, 12)))

    def apart(what: str) -> str:
        name = rng.choice(APART_NAMES[what])
        plain = rng.random() < 0.45  # told by the tag alone
        named = "" if plain else name
        if what == "menu":
            return element("nav" if plain else rng.choice(["nav", "div"]), 0, links(), named)
        if what == "header":
            return element("header" if plain else rng.choice(["header", "div"]), 0, rng.choice([element("h1", 0, sentence(1, 4)), element("p", 0, sentence(2, 8)), sentence(1, 4), element("div", 0, links())]) + (links() if rng.random() < 0.4 else ""), named)
        if what == "footer":
            return element("footer" if plain else rng.choice(["footer", "div"]), 0, rng.choice([f"&copy; {word()} &middot; {sentence(2, 20)}", element("p", 0, sentence(3, 25)), links()]), named)
        if what == "side":
            return element("aside" if plain else rng.choice(["aside", "div", "section"]), 0, rng.choice([element("h3", 0, sentence(1, 4)) + links(), element("p", 0, sentence(3, 40)), sentence(2, 15)]), named)
        if what == "form":
            return element("form", 0, rng.choice([element("p", 0, sentence(2, 12)), f"<label>{sentence(1, 3)}</label><input type=text>"]) + element("button", 0, word()), named)
        if what == "comments":
            inner = element("h3", 0, sentence(1, 3)) + "".join(element(rng.choice(["div", "li", "article"]), 0, element("p", 0, sentence(3, 40)), "comment") for _ in range(rng.randint(1, 4)))
            return element(rng.choice(["section", "div", "ol"]), 0, inner, name)
        return element(rng.choice(["div", "div", "section", "aside"]), 0, rng.choice([sentence(2, 25), element("p", 0, sentence(3, 30)), element("p", 0, sentence(3, 20)) + f"<a href='#'>{word()}</a>"]), name)

    pages = []
    for _ in range(n):
        body = [paragraph() for _ in range(rng.choice([1, 2, 3, 5, 8, 14]))]
        for what in ("ad", "side", "form", "notice"):  # inside the article, too, some is set apart
            if rng.random() < 0.12:
                body.insert(rng.randint(0, len(body)), apart(what))
        head = element("h1", 1, sentence(1, 10)) if rng.random() < 0.85 else ""
        if head and rng.random() < 0.15:
            head = element("header", 1, head)
        if rng.random() < 0.1:
            body.append(apart("comments"))
        r = rng.random()
        name = rng.choice(CONTENT_NAMES) if rng.random() < 0.6 or r >= 0.6 else ""
        core = element("article" if r < 0.5 else "main" if r < 0.6 else rng.choice(["div", "section"]), 1, head + "".join(body), name)
        if rng.random() < 0.25:
            core = element(rng.choice(["main", "div"]), 1, core, rng.choice(["", *CONTENT_NAMES]))
        around = {"menu": 0.85, "header": 0.5, "notice": 0.4, "ad": 0.6}, {"ad": 0.3, "side": 0.55, "comments": 0.45, "form": 0.35, "footer": 0.9, "notice": 0.2}
        before, after = ("".join(apart(w) for w, p in side.items() if rng.random() < p) for side in around)
        if rng.random() < 0.12:  # an article and nothing around it
            before = after = ""
        page = before + core + after
        if rng.random() < 0.3:
            page = f'<div class="{rng.choice(["page", "wrapper", "container", "site"])}" data-content="0">{page}</div>'
        pages.append(f'<!DOCTYPE html><html><head><title>{word()}</title></head><body data-content="0">{page}</body></html>')
    for _ in range(n // 12):  # pages that are the article and nothing else
        pages.append(f'<html><body data-content="1">{"".join(paragraph() for _ in range(rng.randint(1, 6)))}</body></html>')
    return pages


@functools.cache
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, payload: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole page; empty for null and empty pages, and for those without content.

    White space in a block becomes one blank, blocks follow in page order after one blank each, references are decoded.
    One row for every input row, repeated ones included; an empty table gives an empty result; an input column called like
    the text is replaced. Pages of any length and nesting take time in proportion to their length.
    """
    model = model or default_model()
    weights, pairs = model.weights, model.pairs  # a few thousand numbers

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        own = Model(weights, pairs)
        for a, b in slices(byte_sizes(columns[0]), 2 << 20):
            yield a, b, [pa.array([own.extract(x) for x in texts_of(columns[0].slice(a, b - a))], pa.string())]

    return arrow_mapped(pages, [payload], [T.StructField(text, T.StringType())], make)
