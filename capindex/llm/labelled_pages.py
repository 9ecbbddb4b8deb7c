"""Labelled pages to train the extraction model on: random pages of many layouts, whose blocks say in an attribute
``data-main`` whether they are main text. A block without the attribute is like its parent; the root is not."""

from __future__ import annotations

import random
import re

PARTS = "ba ce di fo gu la me ni ro su ta ve wi xo ya zen kor mal tis per lun gar".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(PARTS) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random) -> str:
    words = [_word(r) for _ in range(r.randint(3, 18))]
    if len(words) > 6 and r.random() < 0.5:
        words[3] += ","
    return " ".join(words).capitalize() + r.choice("...?!")


def _prose(r: random.Random, low: int = 1, high: int = 6) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(low, high)))


def _title(r: random.Random) -> str:
    return " ".join(_word(r) for _ in range(r.randint(2, 9))).capitalize() + r.choice(["", "."])


def _name(r: random.Random, *names: str) -> str:
    """A class or id of one of the names, or of none: layouts without telling names are to be learned too."""
    if r.random() < 0.2:
        return f' class="{r.choice("abcdefgh")}{r.randint(1, 99)}"' if r.random() < 0.5 else ""
    name = r.choice(names)
    extra = r.choice(["", "", "-box", "_wrap", "-inner", " col-8", " clearfix"])
    return f' {r.choice(["class", "class", "id"])}="{name}{extra}"'


def _links(r: random.Random, low: int = 3, high: int = 9) -> str:
    return "".join(f'<li><a href="/{_word(r)}">{_title(r) if r.random() < 0.4 else _word(r)}</a>{r.choice(["</li>", ""])}'
                   for _ in range(r.randint(low, high)))


def _menu(r: random.Random) -> str:
    inner = f"<ul>{_links(r)}</ul>" if r.random() < 0.7 else " | ".join(f'<a href="#">{_word(r)}</a>' for _ in range(r.randint(3, 7)))
    tag = r.choice(["nav", "nav", "div"])
    return f'<{tag}{_name(r, "nav", "menu", "navbar", "breadcrumb", "topnav")}>{inner}</{tag}>'


def _header(r: random.Random) -> str:
    tag = r.choice(["header", "header", "div"])
    inner = r.choice([f"<h1>{_title(r)}</h1>", f"<h2>{_title(r)}</h2><p>{_sentence(r)}</p>", f"<p>{_title(r)}</p>", f"{_title(r)}"])
    return f'<{tag}{_name(r, "header", "masthead", "site-header", "topbar", "branding")}>{inner}{_menu(r) if r.random() < 0.5 else ""}</{tag}>'


def _footer(r: random.Random) -> str:
    tag = r.choice(["footer", "footer", "div"])
    inner = r.choice([f"&copy; {_word(r)}.example &middot; {_prose(r, 1, 2)}", f"<p>&copy; 20{r.randint(10, 29)} {_title(r)}</p><ul>{_links(r)}</ul>",
                      f"<p>{_prose(r, 1, 3)}</p>"])
    return f'<{tag}{_name(r, "footer", "site-footer", "copyright", "legal", "colophon")}>{inner}</{tag}>'


def _sidebar(r: random.Random, mark: str = "") -> str:
    tag = r.choice(["aside", "aside", "div"])
    name = _name(r, "sidebar", "related", "widget", "rail", "recommended", "trending")
    inner = r.choice([f"<h3>{_title(r)}</h3><ul>{_links(r)}</ul>", f"<p>{_prose(r, 1, 3)}</p>", f"<h4>{_title(r)}</h4><p>{_prose(r, 1, 2)}</p>"])
    return f"<{tag}{name}{mark}>{inner}</{tag}>"


def _advert(r: random.Random, mark: str = "") -> str:
    tag = r.choice(["div", "div", "aside", "section", "p"])
    names = ("ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement")
    name = f' class="{r.choice(names)}"' if tag in ("p", "section") else _name(r, *names)
    inner = r.choice([_prose(r, 1, 2), f'<a href="#">{_title(r)}</a>', _prose(r, 1, 3) if tag == "p" else f"<p>{_prose(r, 1, 2)}</p>"])
    return f"<{tag}{name}{mark}>{inner}</{tag}>"


def _notice(r: random.Random, mark: str = "") -> str:
    name = r.choice(["cookie", "notice", "consent", "alert", "popup", "modal", "newsletter", "banner", "gdpr", "subscribe", "paywall"])
    tag = r.choice(["div", "section"])
    return f'<{tag} class="{name}"{mark}><p>{_prose(r, 1, 3)}</p></{tag}>'


def _form(r: random.Random, mark: str = "") -> str:
    return (f"<form{_name(r, 'search', 'login', 'signup', 'contact')}{mark}><label>{_title(r)}</label><input type=text>"
            f"<p>{_sentence(r)}</p><button>{_word(r)}</button></form>")


def _share(r: random.Random, mark: str = "") -> str:
    return f'<div class="{r.choice(["share", "social", "tags", "byline", "meta"])}"{mark}>{" ".join(f"<a href=#>{_word(r)}</a>" for _ in range(4))}</div>'


def _comments(r: random.Random, mark: str = "") -> str:
    tag = r.choice(["section", "div", "div", "ol"])
    name = r.choice(["comments", "comment-list", "discussion", "responses", "reader-comments", "disqus", "replies"])
    each = r.choice(["div", "li", "article", "p"])
    if tag == "ol":
        each = "li"
    inner = "".join(
        f'<{each} class="{r.choice(["comment", "reply", "comment-body", "response"])}">' + (
            _prose(r, 1, 4) if each == "p" or r.random() < 0.4 else f"<p>{_prose(r, 1, 4)}</p>") + f"</{each}>" for _ in range(r.randint(1, 5)))
    head = f"<h3>{_title(r)}</h3>" if tag != "ol" and r.random() < 0.6 else ""
    return f'<{tag} {r.choice(["class", "id"])}="{name}"{mark}>{head}{inner}</{tag}>'


def _plain(body: str) -> str:
    """Texts that don't look like prose: main text is what the page puts there, however it is written."""
    return re.sub(r"[.!?,]", "", body)


def _article(r: random.Random) -> str:
    parts = [f"<h1>{_title(r)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
        k, close = r.random(), r.choice(["</p>", "</p>", ""])
        if k < 0.72:
            bold = r.choice(["", "", "<b>", "<i>x</i> ", "<br>"])
            link = f' <a href="/{_word(r)}">{_word(r)}</a> {_sentence(r)}' if r.random() < 0.3 else ""
            parts.append(f"<p>{bold}{_prose(r, 1, 8)}{link}{close}")
        elif k < 0.80:
            parts.append(f"<h{r.randint(2, 4)}>{_title(r)}</h2>")
        elif k < 0.86:
            parts.append("<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif k < 0.89:
            parts.append(f"<blockquote>{r.choice(['', '<p>'])}{_prose(r)}</blockquote>")
        elif k < 0.92:
            parts.append("<table>" + "".join(f"<tr><td>{_word(r)}</td><td>{_sentence(r)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
        elif k < 0.95:
            parts.append(f"<figure><img src=x><figcaption>{_sentence(r)}</figcaption></figure>")
        elif k < 0.97:
            parts.append(f"<pre>{_prose(r, 1, 2)}</pre>")
        else:
            parts.append(f"<div>{_prose(r)}</div>")
    if r.random() < 0.15:
        parts = [_plain(p) for p in parts]
    off = ' data-main="0"'
    for make, chance in ((_advert, 0.25), (_sidebar, 0.12), (_share, 0.15), (_form, 0.08), (_notice, 0.08)):
        if r.random() < chance:
            parts.insert(r.randint(0, len(parts)), make(r, off))
    if r.random() < 0.12:
        parts.append(_comments(r, off))
    body = "".join(parts)
    on = ' data-main="1"'
    k = r.random()
    if k < 0.5:
        return f"<article{on}>{body}</article>"
    if k < 0.62:
        return f"<main{on}>{body}</main>"
    if k < 0.72:
        return f'<div class="wrap"><article{on}{_name(r, "post", "entry")}><div class="{r.choice(["entry-content", "post-body", "x1"])}">{body}</div></article></div>'
    return f'<div{on}{_name(r, "content", "article", "post", "story", "entry-content", "main-text", "article-body")}>{body}</div>'


def labelled_page(r: random.Random) -> str:
    before = [f(r) for f, p in ((_header, 0.6), (_menu, 0.7), (_advert, 0.5), (_notice, 0.3), (_form, 0.2)) if r.random() < p]
    after = [f(r) for f, p in ((_sidebar, 0.5), (_comments, 0.4), (_advert, 0.3), (_form, 0.2), (_share, 0.2), (_notice, 0.15)) if r.random() < p]
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.2:
        before.append(_sidebar(r))
    inner = "".join(before) + _article(r) + "".join(after) + (_footer(r) if r.random() < 0.85 else "")
    if r.random() < 0.25:
        inner = f'<div class="{r.choice(["container", "page", "wrapper", "site", "p9"])}">{inner}</div>'
    head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{_title(r)}</title><style>p{{margin:0}}</style></head>"
    return f"{head}<body>{inner}</body></html>" if r.random() < 0.9 else inner


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]
