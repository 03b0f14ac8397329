"""Labelled pages on which the block model is trained.

SKELETONS are page layouts; an element marked ``data-main`` holds article text.  Each layout is filled several
times: {t} a heading, {p} a paragraph, {s} a short phrase, {c} a copyright line.  Text comes from a seeded generator of
made-up words, so that nothing but structure and shape of text can be learnt.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

SKELETONS = (
    "<body><nav><ul><li><a href='#'>{s}</a></li><li><a href='#'>{s}</a></li><li><a href='#'>{s}</a></li></ul></nav><div class='ad'>{p}</div><article data-main><h1>{t}</h1><p>{p}</p><p><b>{t}<br><p>{p}</p><p>{s}</p><p>{p}</p></article><footer>&copy; {s} &middot; {p}</footer></body>",
    "<body><header><a href='/'>{s}</a><p>{s}</p></header><nav><a href='#'>{s}</a> | <a href='#'>{s}</a></nav><main><article><div data-main><h1>{t}</h1><p>{p}</p><h2>{t}</h2><p>{p}</p><ul><li>{s}</li><li>{p}</li></ul><blockquote>{p}</blockquote></div></article><aside><h3>{s}</h3><ul><li><a href='#'>{t}</a></li><li><a href='#'>{t}</a></li></ul></aside></main><footer><p>{s}</p><a href='#'>{s}</a></footer></body>",
    "<body><div class='cookie-notice' role='dialog'>{p}<button>{s}</button></div><div id='header'><h2>{s}</h2></div><div id='menu'><a href='#'>{s}</a><a href='#'>{s}</a></div><div id='content'><div data-main><h1>{t}</h1><p>{p}</p><p>{p}</p><pre>{p}</pre><p>{s}</p></div></div><div id='comments'><h3>{s}</h3><div class='comment'><b>{s}</b><p>{p}</p></div><div class='comment'><p>{p}</p></div><form action='/c'><label>{s}</label><textarea></textarea><button>{s}</button></form></div><div id='footer'>{p}</div></body>",
    "<body><div class='navbar'><ul><li>{s}</li><li>{s}</li></ul></div><div class='sidebar'><p>{p}</p><a href='#'>{s}</a></div><div class='post-content' data-main><h1>{t}</h1><p>{p}</p><figure><figcaption>{s}</figcaption></figure><p>{p}</p><table><tr><th>{s}</th><td>{s}</td></tr><tr><td>{s}</td><td>{s}</td></tr></table><p>{p}</p></div><div class='related'><h4>{s}</h4><a href='#'>{t}</a><a href='#'>{t}</a></div><section class='comments'><article class='comment'><p>{p}</p></article><article><p>{p}</p></article></section></body>",
    "<body><form class='search'><input><button>{s}</button></form><article><header><h1 data-main>{t}</h1><p>{s}</p></header><div data-main><p>{p}</p></div><div class='advertisement'><p>{p}</p></div><div data-main><p>{p}</p><p>{p}</p></div><div class='share'><a href='#'>{s}</a></div><aside>{p}</aside><div data-main><h2>{t}</h2><p>{p}</p><ol><li>{p}</li><li>{s}</li></ol></div><section id='comments'><h3>{s}</h3><p>{p}</p><p>{p}</p></section><footer>{s}</footer></article></body>",
    "<body><div class='banner ad-slot'>{s}</div><div class='topbar'>{s} <a href='#'>{s}</a></div><main data-main><h1>{t}</h1><p>{p}</p><p>{p}</p><p>{s}</p></main><div class='newsletter'><p>{p}</p><form><input><button>{s}</button></form></div><footer><ul><li><a href='#'>{s}</a></li><li><a href='#'>{s}</a></li></ul><p>{p}</p></footer></body>",
    "<body><div role='navigation'><a href='#'>{s}</a></div><div role='alert' class='notice'>{p}</div><div role='main'><section data-main><h1>{t}</h1><p>{p}</p><h3>{t}</h3><p>{p}</p><dl><dt>{s}</dt><dd>{p}</dd></dl></section></div><div role='complementary'>{p}</div><div role='contentinfo'>{p}</div></body>",
    "<body><p><a href='#'>{s}</a> <a href='#'>{s}</a> <a href='#'>{s}</a></p><div data-main><h1>{t}</h1><p>{p}</p><p>{p}</p><p>{p}</p></div><p><a href='#'>{s}</a> <a href='#'>{s}</a></p><p>&copy; {s}</p></body>",
    "<body><nav class='breadcrumb'>{s} &gt; {s}</nav><div class='article-body' data-main><p>{p}</p><p>{p}</p></div><div class='promo'>{p}</div><div class='article-body' data-main><p>{p}</p></div><div class='subscribe-box'><p>{p}</p></div><div id='disqus_thread'><p>{p}</p><p>{s}</p></div><div class='site-footer'>{p}<a href='#'>{s}</a></div></body>",
    "<body><div hidden>{p}</div><div style='display:none'>{p}</div><nav><p>{p}</p></nav><article data-main><p>{s}</p><p>{s}</p><h1>{t}</h1><div>{p}</div><p>{c}</p><div>{p}</div></article><aside><p>{p}</p><p>{p}</p></aside><footer><p>{p}</p></footer></body>",
    "<body><article data-main><h1>{t}</h1><p>{p} <a href='#'>{s}</a> {p}</p><p><a href='#'>{t}</a></p><p>{s}</p></article></body>",
    "<body data-main><h1>{t}</h1><p>{p}</p><p>{s}</p><p>{p}</p></body>",
    "<p data-main>{p}</p><p data-main>{s}</p><div data-main>{p}</div>",
    "<div data-main><p>{p}</p></div>",
    "<body><div class='x'><a href='#'>{s}</a> / <a href='#'>{s}</a></div><main><article data-main><header><h1>{t}</h1></header><p>{p}</p><h2>{t}</h2><p>{p}</p></article></main><div class='reviews'><h3>{s}</h3><p>{p}</p><p>{p}</p></div><div class='x'>{c}</div></body>",
    "<body><div><a href='#'>{s}</a> | <a href='#'>{s}</a> | {s}</div><main data-main><h1>{t}</h1><p>{p}</p><section><h2>{t}</h2><p>{p}</p><p>{s}</p></section></main><div><h3>{s}</h3><p>{p}</p><p>{p}</p></div><div>{c}</div></body>",
    "<body><div class='x'><div data-main><h1>{t}</h1><p>{p}</p><p>{p}</p></div></div><div class='x'><p>{c}</p></div></body>",
    "<body><div id='wrap'><article data-main><h1>{t}</h1><div>{p}</div><div>{s}</div></article><section><h3>{s}</h3><p>{p}</p></section><p>{c}</p></div></body>",
    "<body><header><h1>{s}</h1><nav><a href='#'>{s}</a></nav></header><div class='entry' data-main><h2>{t}</h2><p>{p}</p><p>{p}</p></div><div class='popup modal'><p>{p}</p></div><div class='user-comments'><ul><li>{p}</li><li>{p}</li></ul></div><footer>{s}</footer></body>",
)
ROUNDS = 12
#: One text in so many holds signs that trails of links and copyright lines hold, too.
SIGNS, EVERY = ("|", "|", ">", "©", "·", "/"), 5
_SYLLABLES = ("an", "be", "ci", "do", "el", "fu", "gra", "hi", "jo", "ke", "lu", "mi", "no", "or", "pe", "qui", "ra", "so", "tu", "ve")


def filled(rounds: int = ROUNDS, seed: int = 7) -> Iterator[str]:
    """The pages, article text being marked by data-main."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def signed(text: str) -> str:
        """The text, or in one of EVERY cases with a sign between many of its words."""
        if r.randrange(EVERY):
            return text
        sign, share = r.choice(SIGNS), r.choice((0.1, 0.5, 1.0))
        return " ".join(f"{w} {sign}" if r.random() < share else w for w in text.split(" "))

    def text(kind: str) -> str:
        if kind == "s":
            return " ".join(word() for _ in range(r.randint(1, 5))).capitalize() + r.choice(("", "", "."))
        if kind == "c":
            return r.choice(("© ", "&copy; ", "Copyright ", "(c) ")) + f"{r.randint(1995, 2030)} " + " ".join(word() for _ in range(r.randint(1, 5))) + r.choice((".", "", ". All rights reserved.", " | " + word()))
        if kind == "t":
            return signed(" ".join(word() for _ in range(r.randint(2, 12))).capitalize() + r.choice(("", ".")))
        return signed(" ".join(" ".join(word() for _ in range(r.randint(3, 16))).capitalize() + "." for _ in range(r.choice((1, 1, 2, 3, 6, 12)))))

    for _ in range(rounds):
        for page in SKELETONS:
            yield re.sub(r"\{([tpsc])\}", lambda m: text(m[1]), page)
