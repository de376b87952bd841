"""Labelled pages for the extraction model, made by rule from a list of page parts."""

from __future__ import annotations

import random

# Class or id names that pages give to their parts.
CHROME = {
    "nav": ["nav", "navbar", "menu", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "site-nav", "navigation", "pagination", "tabs", "toc"],
    "header": ["header", "site-header", "masthead", "banner", "topbar", "page-header", "logo", "branding"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "legal", "bottom", "colophon"],
    "aside": ["sidebar", "aside", "widget", "related", "related-posts", "recommended", "popular", "secondary", "rail", "trending", "tags"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsense", "ad-slot", "outbrain"],
    "notice": ["cookie", "cookie-notice", "consent", "gdpr", "notice", "popup", "modal", "alert", "newsletter", "subscribe", "overlay", "paywall"],
    "form": ["search", "search-form", "login", "signup", "contact-form", "subscribe-form"],
    "comments": ["comments", "comment", "comment-list", "respond", "discussion", "disqus", "replies", "reply", "reader-comments", "user-comments", "comments-area", "disqus_thread", "comment-section"],
    "share": ["share", "social", "share-buttons", "social-links", "sharing", "follow", "toolbar", "meta-links"],
}
CONTENT = ["content", "article", "article-body", "entry", "entry-content", "post", "post-body", "post-content", "story", "main-content", "text", "body-copy", ""]
WORDS = "the of and to in a is that it for was on are as with be by this from der die und das mit de la le les des en un une el los que se con river market paper garden window people country water history number system report science morning music road winter village letter house field story engine"


def _sentence(r: random.Random, low: int, high: int, stop: str = ".") -> str:
    words = [r.choice(WORDS.split()) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + stop


def _links(r: random.Random, n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{_sentence(r, 1, 3, "")}</a></{tag}>' for i in range(n))


def _part(r: random.Random, kind: str) -> str:
    name = r.choice(CHROME[kind])
    how = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} x{r.randint(1, 9)}"', ""]) if kind in ("nav", "header", "footer", "aside", "form") else r.choice([f' class="{name}"', f' id="{name}"'])
    line = lambda: _sentence(r, 3, 14)
    if kind in ("ad", "notice", "footer") and how and r.random() < 0.5:
        return _prose_part(r, kind, how)
    if kind == "nav":
        tag = "nav" if not how else r.choice(["nav", "div", "ul"])
        body = f"<ul>{_links(r, r.randint(2, 8))}</ul>" if tag != "ul" else _links(r, r.randint(2, 8))
    elif kind == "header":
        tag, body = ("header" if not how else r.choice(["header", "div"])), r.choice([f"<a href='/'>{line()}</a>", f"<p>{line()}</p><ul>{_links(r, 3)}</ul>", f"<h1><a href='/'>{_sentence(r, 1, 3, '')}</a></h1><p>{line()}</p>", f"<h2>{_sentence(r, 1, 3, '')}</h2>", f"<h1>{_sentence(r, 1, 3, '')}</h1>", f"<h1>{_sentence(r, 1, 3, '')}</h1><p>{line()}</p>"])
    elif kind == "footer":
        tag, body = ("footer" if not how else r.choice(["footer", "div"])), r.choice([f"&copy; site.example &middot; {line()}", f"<p>&copy; 2020 {line()}</p>", f"<ul>{_links(r, 4)}</ul><p>{line()}</p>", line()])
    elif kind == "aside":
        tag, body = ("aside" if not how else r.choice(["aside", "div", "section"])), r.choice([f"<h3>{_sentence(r, 1, 3, '')}</h3><ul>{_links(r, 4)}</ul>", f"<h3>{_sentence(r, 1, 3, '')}</h3><p>{line()}</p>", f"<p>{line()}</p><p><a href='/x'>{line()}</a></p>", f"<p>{_sentence(r, 20, 40)}</p>"])
    elif kind == "form":
        tag, body = "form", f'<label>{_sentence(r, 1, 3, "")}</label><input name="q"><p>{line()}</p><button>{_sentence(r, 1, 2, "")}</button>'
    elif kind == "comments":
        if r.random() < 0.4:
            return _prose_part(r, kind, how)
        tag, body = r.choice(["div", "section", "ol"]), f"<h3>{_sentence(r, 1, 2, '')}</h3>" + "".join(f'<{t} class="comment"><p>{_sentence(r, 5, 40)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] * r.randint(1, 4))
    elif kind == "share":
        tag, body = r.choice(["div", "ul", "p"]), "".join(f'<a href="/s{i}">{_sentence(r, 1, 2, "")}</a> ' for i in range(r.randint(2, 5)))
    else:
        tag, body = r.choice(["div", "section", "aside", "p"]), r.choice([line(), f"<p>{line()}</p>", f"<p>{_sentence(r, 10, 30)}</p>", f'<a href="/y">{line()}</a>', f"<h4>{_sentence(r, 1, 3, '')}</h4><p>{line()}</p>"])
    if tag == "p":
        body = body.replace("<p>", "").replace("</p>", " ").replace("<h4>", "").replace("</h4>", " ")
    return f'<{tag}{how} data-label="0">{body}</{tag}>'


def _prose_part(r: random.Random, kind: str, how: str) -> str:
    """A part that reads like content, one or more paragraphs, and only its name or role tells."""
    prose = [_sentence(r, 8, 60) for _ in range(r.choice([1, 1, 2, 3]))]
    if kind == "footer":
        prose[0] = r.choice(["&copy; 2021 ", "Copyright ", ""]) + prose[0]
    body = r.choice([prose[0], "".join(f"<p>{x}</p>" for x in prose), "".join(f"<div><p>{x}</p></div>" for x in prose)])
    role = ' role="alert"' if kind == "notice" and r.random() < 0.5 else ""
    tag = r.choice(["div", "div", "section"])
    return f'<{tag}{how}{role} data-label="0">{body}</{tag}>'


def _odd_name(r: random.Random) -> str:
    """A name that says nothing, as style tools and templates make them."""
    return r.choice(["c{}", "css-{}x", "sc-{}", "x{}f", "block-{}", "col-md-{}", "m-{}", "_{}q", "row{}", "view-{}"]).format(r.randint(1, 99))


def _linked(r: random.Random) -> str:
    return f'<a href="/{r.randint(1, 99)}">{_sentence(r, 2, 9, "")}</a>'


def _odd_block(r: random.Random) -> str:
    """Content in rarer shapes: paragraphs of links, lists of links, plain nested blocks, details, formulas, definitions."""
    words = lambda a, b: _sentence(r, a, b)
    return r.choice([
        lambda: f"<p>{words(2, 6)} {_linked(r)} {_linked(r)} {words(1, 4)} {_linked(r)}</p>",
        lambda: f"<p>{_linked(r)}, {_linked(r)} {words(3, 8)}</p>",
        lambda: f"<p>{_linked(r)} and {_linked(r)}.</p>",
        lambda: "<ul>" + "".join(f"<li>{_linked(r)}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
        lambda: "<ol>" + "".join(f"<li>{_linked(r)} {words(3, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ol>",
        lambda: f'<div class="{_odd_name(r)}"><div><div>{words(12, 50)}</div><div>{words(8, 40)}</div></div></div>',
        lambda: f"<div><div>{words(12, 60)}</div><div>{words(12, 60)}</div></div>",
        lambda: f"<details><summary>{words(2, 6)}</summary><p>{words(10, 40)}</p></details>",
        lambda: f"<p>{words(6, 15)} <math><mi>x</mi><mo>+</mo><mn>1</mn></math> {words(6, 20)}</p>",
        lambda: f"<dl><dt>{words(1, 3)}</dt><dd>{words(5, 20)}</dd><dt>{words(1, 3)}</dt><dd>{words(5, 20)}</dd></dl>",
        lambda: f'<section class="{_odd_name(r)}"><h2>{words(2, 5)}</h2><p>{words(15, 60)}</p><p>{words(15, 60)}</p></section>',
    ])()


def _odd_page(r: random.Random) -> str:
    """A page whose content has no telling names or elements, only its text and place."""
    plain = r.choice(["p", "p", "div"])  # some pages know no paragraphs
    blocks = [f"<{plain}>{_sentence(r, 30, 90)}</{plain}>" if r.random() < 0.6 else _odd_block(r) for _ in range(r.randint(1, 7))] + [f"<{plain}>{_sentence(r, 25, 70)}</{plain}>"]
    r.shuffle(blocks)
    body = "".join(blocks)
    for _ in range(r.randint(0, 3)):
        body = f'<div{r.choice(["", f" class={chr(34)}{_odd_name(r)}{chr(34)}", f" id={chr(34)}{_odd_name(r)}{chr(34)}"])}>{body}</div>'
    around = [_part(r, k) for k in r.sample(["nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "share"], r.randint(0, 3))]
    cut = r.randint(0, len(around))
    name = f' class="{_odd_name(r)}"' if r.random() < 0.6 else ""
    return f'<html><body>{"".join(around[:cut])}<div{name} data-label="1">{body}</div>{"".join(around[cut:])}</body></html>'


def _content(r: random.Random) -> str:
    blocks = [f"<h1>{_sentence(r, 2, 9, r.choice(['', '.']))}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 10)):
        blocks.append(r.choices([
            f"<p>{_sentence(r, 12, 60, r.choice(['.', '.', '.', '', '|', '!!']))}</p>", f"<p>{_sentence(r, 1, 8)}</p>", f"<p><b>{_sentence(r, 1, r.choice([20, 90]), r.choice(['.', '']))}<br>" + r.choice(["", f"<p>{_sentence(r, 10, 50)}</p>"]), f"<h2>{_sentence(r, 1, 5, '')}</h2>",
            f"<ul><li>{_sentence(r, 3, 12)}</li><li>{_sentence(r, 3, 12)}</li></ul>", f"<blockquote>{_sentence(r, 8, 30)}</blockquote>", f"<p>{_sentence(r, 6, 20)} <a href='/z'>{_sentence(r, 1, 3, '')}</a> {_sentence(r, 6, 20)}</p>",
            f"<table><tr><td>{_sentence(r, 1, 4, '')}</td><td>{_sentence(r, 1, 6, '')}</td></tr></table>", f"<pre>{_sentence(r, 5, 15)}</pre>", f"<div>{_sentence(r, 10, 40)}</div>", f"<figure><figcaption>{_sentence(r, 4, 12)}</figcaption></figure>",
        ], [10, 5, 3, 2, 1.5, 1, 2, 1, 0.5, 1, 0.5])[0])
        if r.random() < 0.25:
            blocks.append(_odd_block(r))
        if r.random() < 0.2:
            blocks.append(_part(r, r.choice(["ad", "share", "aside", "notice", "notice", "comments", "footer", "form"])))
    name = r.choice(CONTENT)
    how = f' {r.choice(["class", "id"])}="{name}"' if name else ""
    tag = r.choice(["article", "article", "main", "div", "section"])
    body = "".join(blocks)
    if r.random() < 0.2:
        body = f'<div class="{r.choice(CONTENT)}">{body}</div>'
    if r.random() < 0.2:
        body = f"<header>{body.partition('</h1>')[0]}</h1></header>{body.partition('</h1>')[2]}" if body.startswith("<h1>") else body
    inner = f'<{tag}{how} data-label="1">{body}</{tag}>'
    return f'<main data-label="{r.choice("01")}">{inner}</main>' if tag == "article" and r.random() < 0.2 else inner


def labelled_pages(n: int = 1200, seed: int = 7) -> list[str]:
    """n pages whose parts carry data-label; the parts around the content come in random choice and order, and a quarter of the pages name nothing."""
    out = []
    for i in range(n):
        r = random.Random(seed * 100_003 + i)
        if i % 4 == 3:
            out.append(_odd_page(r))
            continue
        before = [_part(r, k) for k in r.sample(["nav", "header", "ad", "notice", "form", "nav", "share"], r.randint(0, 4))]
        after = [_part(r, k) for k in r.sample(["footer", "aside", "comments", "ad", "share", "notice", "form", "nav"], r.randint(0, 4))]
        middle = _content(r)
        bare = r.random()
        if bare < 0.06:  # no element around the content
            start = middle.index(">") + 1
            middle = middle[start : middle.rindex("</")]
            out.append(f'<html><head><title>{_sentence(r, 2, 6)}</title></head><body data-label="1">{"".join(before[:1])}{middle}{"".join(after[:1])}</body></html>')
            continue
        if bare < 0.30:  # a fragment, or text alone
            out.append(f'<body data-label="1">{r.choice([_sentence(r, 3, 40), f"<p>{_sentence(r, 2, 30)}<p>{_sentence(r, 2, 30)}", f"<p>{_sentence(r, 1, 6)}</p>", f"<div><p>{_sentence(r, 3, 30)}</p></div>", f"<div><p>{_sentence(r, 2, 6, '')}</p></div>"])}</body>')
            continue
        page = "".join(before) + middle + "".join(after)
        if r.random() < 0.3:
            page = f'<div class="{r.choice(["wrapper", "container", "page", "site", "row", "layout"])}">{page}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{_sentence(r, 2, 6)}</title><style>p{{margin:0}}</style></head><body>{page}</body></html>")
    return out
