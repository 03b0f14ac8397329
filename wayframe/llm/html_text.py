"""Main text of web pages: a linear-chain conditional random field over the page's leaf blocks.

A page becomes the sequence of its text blocks (text between block-level tags).  Each block has features of its
ancestor tags, of their class, id and role words, and of its text.  The model, two labels with weights per
feature and per transition, is trained on labelled pages by gradient ascent on the likelihood
(forward-backward) and decoded by Viterbi.  Training takes about a second on the driver, from a fixed
set of pages; the weights are a few hundred numbers, sent with the task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayframe.llm import labelled_pages

# Element names of HTML by how they shape text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SPACING = frozenset(("br", "img", "input"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title head template noscript iframe object svg canvas audio video select textarea option datalist".split())
HEAD_PARTS = frozenset("title meta link base script style noscript template".split())
#: What an opening tag ends when it is still open.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
#: These open tags keep an opening tag from ending one outside of them.
WALLS = frozenset("article section div main aside nav header footer table ul ol dl blockquote form body html".split())
TAGS = "nav header footer aside form main article section figure table ul ol dl blockquote pre dialog button h1 h2 h3 p li".split()
#: Words in class, id and role by what they say about a block.
WORDS = {
    "comment": r"comments?|disqus|discuss(?:ion)?|repl(?:y|ies)|respond|reviews?|feedback|testimonials?",
    "nav": r"nav(?:bar|igation)?|menu|breadcrumbs?|topbar|toolbar|pagination|pager|tabs",
    "ad": r"ads?|advert\w*|sponsor\w*|promo\w*|banner",
    "side": r"side(?:bar)?|widget|rail|related|recommend\w*|complementary|share|social|tags",
    "notice": r"cookie\w*|consent|notice|alert\w*|popup|modal|dialog|overlay|gdpr|newsletter|subscribe\w*|signup|login|search",
    "foot": r"foot(?:er)?|copyright|legal|contentinfo",
    "head": r"head(?:er)?|masthead|banner|byline|meta",
    "main": r"main|content|article|post|entry|story|body|text",
}
_WORDS = {k: re.compile(rf"(?:^|[\s_-])(?:{v})(?:$|[\s_-])", re.I) for k, v in WORDS.items()}
_CUT = re.compile(r"</?[a-zA-Z]")
_RIGHTS = re.compile(r"\W*(?:©|\(c\)|copyright\b)", re.I)
_TRAIL = re.compile(r"\s[|>›»·/]\s")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Blocks(HTMLParser):
    """Blocks of a page as (text, features of the ancestors, share of link characters, marked)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, tuple[str, ...], float, bool]] = []
        self._open: list[tuple[str, tuple[str, ...], bool]] = []  # tag, features, marked
        self._text: list[str] = []
        self._linked = self._links = self._silent = 0

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                features, near = [], ""
                for _, f, _m in self._open:
                    features += f
                    near = next((x for x in reversed(f) if x[:3] != "in:" or x in ("in:nav", "in:header", "in:footer", "in:aside", "in:form", "in:main", "in:article", "in:dialog", "in:button")), near)
                block = next((t for t, _, _m in reversed(self._open) if t not in INLINE), "")
                own = tuple(sorted({*features, f"near {near}", f"own {block}"}))
                self.blocks.append((text, own, self._linked / max(1, sum(map(len, self._text))), any(m for _, _, m in self._open)))
            self._text.clear()
        self._linked = 0

    def _pop_to(self, i: int) -> None:
        for tag, _, _m in self._open[i:]:
            self._links -= tag == "a"
            self._silent -= tag in SILENT
        del self._open[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SPACING:
            self._text.append(" ")
        elif tag not in INLINE:
            self._flush()
        for old in ENDS.get(tag, ()):
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i][0] == old:
                    self._pop_to(i)
                    break
                if self._open[i][0] in WALLS:
                    break
        if tag not in HEAD_PARTS and self._open and self._open[-1][0] == "head":
            self._pop_to(len(self._open) - 1)  # a page may leave its head open
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        said = " ".join(a.get(k, "") for k in ("class", "id", "role"))
        f = [f"in:{tag}"] if tag in TAGS else []
        if said.strip():
            f += [k for k, p in _WORDS.items() if p.search(said)]
        if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
            f.append("hidden")
        self._open.append((tag, tuple(f), "data-main" in a))
        self._links += tag == "a"
        self._silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                self._pop_to(i)
                break

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self._text.append(data)
            if self._links:
                self._linked += len(data)


def blocks_of(html: str) -> list[tuple[str, tuple[str, ...], float, bool]]:
    p = _Blocks()
    p.feed(html)
    if _CUT.match(p.rawdata):  # what is left of a tag that the end of the page cuts off
        p.rawdata = ""
    p.close()
    p._flush()
    # where a page names its article, what stands beside it is marked
    if not any("in:article" in f or "in:main" in f for _, f, _, _ in p.blocks):
        return p.blocks
    return [(t, f if "in:article" in f or "in:main" in f else tuple(sorted({*f, "beside"})), x, m) for t, f, x, m in p.blocks]


def shape(text: str, linked: float) -> tuple[str, ...]:
    """Features of a block's own text."""
    return (
        f"length {min(4, int(math.log2(len(text) + 1)) // 2)}",
        "links" if linked > 0.6 else "some links" if linked > 0.1 else "no links",
        "ends" if text[-1] in ".!?:" else "open",
        *(("rights",) if _RIGHTS.match(text) else ()),
        # signs between short phrases, as in trails of links; prose with such signs is longer or ends like a sentence
        *(("trail",) if len(text) < 100 and text[-1] not in ".!?:" and _TRAIL.search(text) else ()),
    )


class Model:
    """Weights of a two-label chain: 1 is article text."""

    def __init__(self, names: list[str], weights: np.ndarray, steps: np.ndarray, first: np.ndarray):
        self.of = {n: i for i, n in enumerate(names)}
        self.weights, self.steps, self.first = weights, steps, first
        self._paths: dict[tuple[str, ...], tuple[float, float]] = {}

    def _sum(self, names: tuple[str, ...]) -> tuple[float, float]:
        if names not in self._paths:
            if len(self._paths) > 100_000:
                self._paths.clear()
            rows = [self.of[n] for n in names if n in self.of]
            s = self.weights[rows].sum(axis=0) if rows else np.zeros(2)
            self._paths[names] = (float(s[0]), float(s[1]))
        return self._paths[names]

    def decode(self, blocks: list[tuple[str, tuple[str, ...], float, bool]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        back: list[tuple[int, int]] = []
        (t00, t01), (t10, t11) = self.steps.tolist()
        s0, s1 = self.first.tolist()
        for i, (text, path, linked, _) in enumerate(blocks):
            a, b = self._sum(path), self._sum(shape(text, linked))
            if i:
                back.append((int(s1 + t10 > s0 + t00), int(s1 + t11 > s0 + t01)))
                s0, s1 = max(s0 + t00, s1 + t10), max(s0 + t01, s1 + t11)
            s0, s1 = s0 + a[0] + b[0], s1 + a[1] + b[1]
        y = [int(s1 > s0)]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]


def train(pages: list[list[tuple[str, tuple[str, ...], float, bool]]], rounds: int = 300, rate: float = 0.1, shrink: float = 0.01) -> Model:
    """Maximum likelihood with a Gaussian prior, by Adam on the exact gradient; all pages side by side."""
    pages = [p for p in pages if p]
    names = sorted({n for p in pages for text, path, linked, _ in p for n in (*path, *shape(text, linked))})
    of = {n: i for i, n in enumerate(names)}
    n, t = len(pages), max(len(p) for p in pages)
    x = np.zeros((n, t, len(names)))
    y = np.zeros((n, t), int)
    real = np.zeros((n, t), bool)
    for i, p in enumerate(pages):
        for j, (text, path, linked, marked) in enumerate(p):
            x[i, j, [of[k] for k in (*path, *shape(text, linked))]] = 1
            y[i, j], real[i, j] = marked, True
    hot = np.eye(2)[y] * real[:, :, None]
    pair = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum(axis=(0, 1))
    theta = np.zeros(2 * len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    cut = lambda z: (z[: 2 * len(names)].reshape(-1, 2), z[-6:-2].reshape(2, 2), z[-2:])
    lse = lambda z, axis: z.max(axis=axis) + np.log(np.exp(z - z.max(axis=axis, keepdims=True)).sum(axis=axis))
    for k in range(1, rounds + 1):
        w, steps, first = cut(theta)
        e = x @ w
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = first + e[:, 0]
        for j in range(1, t):
            alpha[:, j] = np.where(real[:, j, None], lse(alpha[:, j - 1, :, None] + steps, 1) + e[:, j], alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            beta[:, j] = np.where(real[:, j + 1, None], lse(steps + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2), beta[:, j + 1])
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + steps + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        g = np.concatenate([np.einsum("ntf,ntl->fl", x, hot - node).ravel(), (pair - edge.sum(axis=(0, 1))).ravel(), (hot[:, 0] - node[:, 0]).sum(axis=0)]) / n - shrink * theta / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(names, *(np.array(a) for a in cut(theta)))


_trained: list[Model] = []


def model() -> Model:
    """The model of the labelled pages, trained once per process."""
    if not _trained:
        _trained.append(train([blocks_of(p) for p in labelled_pages.filled()]))
    return _trained[0]


def main_text(html: str | None, crf: Model) -> str:
    blocks = blocks_of(html) if html else []
    return " ".join(b[0] for b, y in zip(blocks, crf.decode(blocks)) if y)


def extract(pages: DataFrame, crf: Model | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null, empty or textless page has an empty text; a page of any length is read as a whole.  Broken markup is read as far as it goes: tags may be left
    open, references cut off.  Rows are read one by one, so null and repeated ids give rows like others; an empty table
    gives none; other columns are ignored.
    """
    crf = crf or model()
    parts = (list(crf.of), crf.weights, crf.steps, crf.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*parts)
        for b in batches:
            text = [main_text(h, own) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
