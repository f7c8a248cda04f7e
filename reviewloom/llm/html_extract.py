"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between the bounds of block elements. A block's features are
bits: which elements stand above it, what the words of their classes, ids and roles say, its own element,
its length, links and wording, and what it is beside the other blocks of its page. Viterbi decoding labels the blocks as
content or not. Text of noscript, template and iframe is no text of the page: browsers that run scripts don't show it.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import crf
from .shared import map_texts

BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
#: their text is never shown as text of the page, or stands for a script
SKIPPED = frozenset("head script style noscript template iframe title".split())
#: any other element ends a head that was not closed
IN_HEAD = frozenset("head base link meta script style title template noscript".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an opening element closes open ones of these, up to the nearest of the bounds
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_ENDS = BLOCK - {"button", "label", "option", "select", "textarea", "li", "td", "th", "tr"}

ABOVE = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "table", "ul", "ol", "dl", "figure", "dialog", "a", "menu", "blockquote", "details"]
OWN = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "div", "blockquote", "pre", "button", "label", "option", "legend", "figcaption", "dt", "dd", "section", "article", "main", "body", "summary"]
KEYWORDS = {
    "advert": "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc tabs links skip",
    "head": "header masthead topbar logo branding hero",
    "foot": "footer copyright legal contentinfo imprint bottom",
    "side": "sidebar side widget widgets related recommended recommendation popular trending aside rail complementary teaser more tags tag",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall toast disclaimer warning info",
    "comment": "comment comments commentlist disqus reply replies discussion respond responses reactions feedback",
    "share": "share sharing social follow buttons tools meta byline author date",
    "form": "form search login signup register contact survey poll",
    "text": "content article post entry story body main text page maincontent articlebody",
}
WORDS = {w: k for k, ws in KEYWORDS.items() for w in ws.split()}
SAID = ["©", "copyright", "all rights reserved", "cookie", "subscribe", "newsletter", "sign up", "log in", "privacy", "advert", "sponsored", "comments", "reply", "share this", "read more"]

NAMES = [f"in_{x}" for x in ABOVE] + [f"word_{k}" for k in KEYWORDS] + ["hidden", "nearest_text", "nearest_other"] + [f"is_{x}" for x in OWN]
NAMES += ["is_other", "chars_20", "chars_80", "chars_300", "chars_more", "links_some", "links_most", "stop", "piped", "said", "copyright", "first_block", "bias"]
#: what a block is beside the others of its page: its length by the longest one's, links and prose next to it, its place and that of the first h1
BESIDE = ["longest", "half", "tenth", "by_links", "by_prose", "last_block", "before_h1", "after_h1", "no_h1", "prose", "first_prose", "last_prose"]
#: a block without a tag or word that says what it is, on a page where none says that it is the text: these bits weigh on their own there
LOOSE = ["chars_20", "chars_80", "chars_300", "chars_more", "links_some", "links_most", "stop", "piped", "said", "copyright", "first_block", "is_p", "is_h1", "is_h2", "is_h3", "is_li", "is_td", "is_div", "in_table", *BESIDE]
NAMES += [*BESIDE, "loose", *[f"loose_{x}" for x in LOOSE]]
BIT = {n: 1 << i for i, n in enumerate(NAMES)}
_ABOVE = {x: BIT[f"in_{x}"] for x in ABOVE}
_OWN = {x: BIT[f"is_{x}"] for x in OWN}
_KIND = {k: BIT[f"word_{k}"] for k in KEYWORDS}
_NEAREST = BIT["nearest_text"] | BIT["nearest_other"]

_SAYS = sum(BIT[f"in_{x}"] for x in ("nav", "header", "footer", "aside", "form", "article", "main", "dialog", "menu")) | _NEAREST | sum(_KIND.values()) | BIT["hidden"]
_TEXT = BIT["in_article"] | BIT["in_main"] | BIT["nearest_text"]
_LOOSE = [(BIT[x], BIT[f"loose_{x}"]) for x in LOOSE]

#: what marks content in labelled pages (a private character): no feature sees it
MARK = "\ue000"
#: ends of sentences; an empty text has none
STOPS = tuple(".!?…\"'”»:;")

_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
#: a tag up to its end; a quote that never closes stops quoting: then the next way of reading is taken for the rest of the page
_TAGS = [re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)(" + part + r")>") for part in ("(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", "(?:[^>\"]++|\"[^\"]*+\")*+", "(?:[^>']++|'[^']*+')*+", "[^>]*+")]
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*+>", re.I) for tag in RAW}
_LONG_NUMBER = re.compile(r"&#0*([0-9]{8,});?")
_ATTR = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: what stands between the entries of a menu in one line
_PIPE = re.compile(r"\s[|·•»›/]\s")
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _context(tag: str, attrs: str) -> tuple[int, int]:
    """Bits that an element adds to all below it, and what its own words say of it (nearest)."""
    return _short_context(tag, attrs) if len(attrs) < 400 else _any_context(tag, attrs)


def _any_context(tag: str, attrs: str) -> tuple[int, int]:
    bits, near = _ABOVE.get(tag, 0), 0
    if attrs:
        kinds = set()
        for _, value in _ATTR.findall(attrs):
            kinds |= {WORDS.get(w.lower()) for w in _SPLIT.findall(value)}
        kinds.discard(None)
        for k in kinds:
            bits |= _KIND[k]
        if kinds:
            near = BIT["nearest_text"] if kinds == {"text"} else BIT["nearest_other"]
        if _HIDDEN.search(attrs):
            bits |= BIT["hidden"]
    if tag in ("article", "main"):
        near = near or BIT["nearest_text"]
    elif tag in ("nav", "aside", "footer", "form", "dialog", "header"):
        near = BIT["nearest_other"]
    return bits, near


_short_context = functools.lru_cache(maxsize=65536)(_any_context)


def decoded(text: str) -> str:
    """Text with its character references decoded; a number beyond all code points is U+FFFD."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text))


def blocks(page: str) -> list[tuple[int, str]]:
    """(feature bits, text) of the leaf blocks of a page, in page order; texts are decoded and trimmed, never empty.

    The time is linear in the page's length, however its markup is broken: open elements are found by their names, and
    what can't be closed is looked for once.
    """
    out: list[tuple[int, str]] = []
    # (tag, bits, skipped) of open elements, the places of each name, and those of block elements
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    places: dict[str, list[int]] = {}
    block_places: list[int] = []
    text: list[str] = []
    links = [0]
    state = [0, ""]  # bits and nearest block element where the run of text began

    def flush() -> None:
        if not text:
            return
        got = " ".join(decoded("".join(text)).split())
        text.clear()
        n_link, links[0] = links[0], 0
        if not got:
            return
        bits, own = state
        n = len(got)
        bits |= _OWN.get(own, BIT["is_other"]) | BIT["bias"]
        bits |= BIT["chars_20" if n < 20 else "chars_80" if n < 80 else "chars_300" if n < 300 else "chars_more"]
        if 2 * n_link > n:
            bits |= BIT["links_most"]
        elif n_link:
            bits |= BIT["links_some"]
        if got.rstrip(MARK)[-1:] in STOPS:
            bits |= BIT["stop"]
        if got.startswith("©") or got[:9].lower() == "copyright":
            bits |= BIT["copyright"]
        if n < 300 and _PIPE.search(got):
            bits |= BIT["piped"]
        if n < 300 and any(w in got.lower() for w in SAID):
            bits |= BIT["said"]
        if not out:
            bits |= BIT["first_block"]
        out.append((bits, got))

    def add(piece: str) -> None:
        if not piece:
            return
        if stack[-1][0] == "head" and not piece.isspace():  # text can't stand in a head
            drop_to(len(stack) - 1)
        top = stack[-1]
        if top[2]:
            return
        if not text:
            if piece.isspace():
                return
            state[0] = top[1]
            state[1] = stack[block_places[-1]][0] if block_places else ""
        if top[1] & _ABOVE["a"]:
            links[0] += len(piece)
        text.append(piece)

    def drop_to(i: int) -> None:
        while len(stack) > i:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in BLOCK:
                block_places.pop()

    def pop_to(i: int) -> None:
        if block_places and block_places[-1] >= i:
            flush()
        drop_to(i)

    last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
    at, end, last_end, way = 0, len(page), page.rfind(">") + 1, 0
    while at < end:
        m = _START.search(page, at, last_end)
        if m is None:  # no tag is closed any more; a comment is cut off
            cut = page.find("<!--", max(at, last_end))
            add(page[at:] if cut < 0 else page[at:cut])
            break
        add(page[at : m.start()])
        if m[0] == "<!--":
            close = page.find("-->", m.end())
            at = end if close < 0 else close + 3
            continue
        if not m[0][-1].isalpha():
            at = page.find(">", m.end()) + 1 or end
            continue
        while (tagged := _TAGS[way].match(page, m.start())) is None:
            way += 1
        at = tagged.end()
        tag, attrs = tagged[2].lower(), tagged[3]
        if tagged[1]:
            if places.get(tag):
                pop_to(places[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if places.get("head") and tag not in IN_HEAD and last(("template", "noscript")) < places["head"][-1]:
            drop_to(places["head"][-1])
        if tag in BLOCK:
            flush()
            if tag in CLOSES:
                own, bounds = CLOSES[tag]
                if (i := last(own)) > last(bounds):
                    drop_to(i)
            if tag in _P_ENDS and block_places and stack[block_places[-1]][0] == "p":
                drop_to(block_places[-1])
        if tag in VOID:
            continue
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        bits, near = _context(tag, attrs.strip())
        over = stack[-1][1]
        if near:
            over = over & ~_NEAREST | near
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            block_places.append(len(stack))
        stack.append((tag, over | bits, stack[-1][2] or tag in SKIPPED))
        if tag in RAW:  # nothing inside is markup
            close = _ENDS[tag].search(page, at, last_end)
            inner = page[at : close.start() if close else end]
            if tag == "textarea":
                add(inner)
            pop_to(len(stack) - 1)
            at = close.end() if close else end
    flush()
    return beside(out)


def beside(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Blocks with the bits that depend on the other blocks of their page."""
    if not found:
        return found
    most, n = max(len(t) for _, t in found), len(found)
    h1 = next((i for i, (b, _) in enumerate(found) if b & BIT["is_h1"]), None)
    told = any(b & _TEXT for b, _ in found)
    prose = [len(t) >= 80 and not b & BIT["links_most"] for b, t in found]
    links = [bool(b & BIT["links_most"]) for b, _ in found]
    out = []
    for i, (b, t) in enumerate(found):
        size = len(t)
        b |= BIT["longest" if size == most else "half" if 2 * size >= most else "tenth"] if 10 * size >= most else 0
        near = [j for j in (i - 1, i + 1) if 0 <= j < n]
        b |= BIT["by_links"] * any(links[j] for j in near) | BIT["by_prose"] * any(prose[j] for j in near) | BIT["last_block"] * (i == n - 1)
        b |= BIT["prose"] * prose[i] | BIT["first_prose"] * (i == 0 and prose[i]) | BIT["last_prose"] * (i == n - 1 and prose[i])
        b |= BIT["no_h1" if h1 is None else "before_h1" if i < h1 else "after_h1"]
        if not told and not b & _SAYS:
            b |= BIT["loose"]
            for own, loose in _LOOSE:
                if b & own:
                    b |= loose
        out.append((b, t))
    return out


def vector(bits: int) -> list[int]:
    return [bits >> i & 1 for i in range(len(NAMES))]


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages of many layouts, made from a seed. Content blocks carry MARK: these are the labels."""
    r = random.Random(seed)
    syll = "an ba co de el fi go hu in jo ka lu mi no op pa qui ro sa ti un ve wo xi yo za".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return some(4, 22).capitalize() + r.choice("....?!")

    def prose(a=1, b=8) -> str:
        return " ".join(sentence() for _ in range(r.randint(a, b)))

    def el(tag, inner, *names):
        name = r.choice([x for x in names]) if names else ""
        return f"<{tag}{f' {r.choice(["class", "class", "id"])}="{name}"' if name else ''}>{inner}</{tag}>"

    def link_list(k):
        return "".join(f'<li><a href="/{word()}">{some(1, 4)}</a></li>' for _ in range(k))

    def menu():
        body = r.choice([f"<ul>{link_list(r.randint(2, 9))}</ul>", " ".join(f'<a href="#">{some(1, 3)}</a>' for _ in range(r.randint(2, 8)))])
        return r.choice([el("nav", body), el("nav", body, "navbar", "main-nav"), el("div", body, "menu", "nav", "navigation", "breadcrumb", "pagination"), f'<div role="navigation">{body}</div>'])

    def header():
        body = r.choice(["", menu()]) + r.choice([el("h1", some(1, 3)), el("h2", some(1, 4)), el("div", some(1, 4), "logo", "branding"), el("p", sentence()), ""]) + r.choice(["", el("p", sentence(), "tagline")])
        return r.choice([el("header", body), el("header", body, "masthead", "site-header"), el("div", body, "header", "masthead", "topbar")])

    def advert():
        body = r.choice([some(2, 12), sentence(), prose(1, 3), el("p", sentence()), f'<a href="#">{some(2, 6)}</a>', el("span", sentence())])
        return r.choice([el("div", body, "ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo-box"), el("aside", body, "ad", "advertisement"), el("section", body, "sponsored", "promo"), el("p", body, "ad", "advert")])

    def side():
        body = "".join(r.choice([el("h3", some(1, 4)), f"<ul>{link_list(r.randint(2, 6))}</ul>", el("p", prose(1, 3)), el("p", some(2, 8))]) for _ in range(r.randint(1, 5)))
        return r.choice([el("aside", body), el("aside", body, "sidebar"), el("div", body, "sidebar", "related", "widget", "popular-posts", "right-rail"), el("section", body, "related", "recommended")])

    def notice():
        body = r.choice([el("p", prose(1, 3)), sentence(), el("p", r.choice(["We use cookies. ", ""]) + sentence()) + "<button>OK</button>"])
        return r.choice([el("div", body, "cookie-banner", "cookie-notice", "notice", "alert", "consent", "newsletter", "popup", "paywall"), f'<div role="alert">{body}</div>', el("section", body, "notice", "newsletter-signup"), el("dialog", body), el("p", sentence(), "notice", "alert")])

    def form():
        body = r.choice(["", el("label", some(1, 3))]) + '<input type="text">' + r.choice([el("button", some(1, 2)), f"<select><option>{word()}</option><option>{word()}</option></select>", el("p", sentence()) + el("button", word()), f"<textarea>{some(1, 6)}</textarea>"])
        return r.choice([el("form", body), el("form", body, "search", "login"), el("div", el("form", body), "search-box", "contact")])

    def comments():
        one = lambda: r.choice([el("p", prose(1, 4)), el("div", el("b", word()) + el("p", prose(1, 5)), "comment", "reply"), el("li", prose(1, 4)), el("article", el("p", prose(1, 4)), "comment"), el("blockquote", prose(1, 3))])
        body = r.choice([el("h2", "Comments"), el("h3", some(1, 3)), ""]) + "".join(one() for _ in range(r.randint(1, 6)))
        return r.choice([el("section", body, "comments", "comment-list", "discussion", "reader-comments"), el("div", body, "comments", "disqus", "respond", "user-comments"), el("ol", body, "commentlist", "comments")])

    def footer():
        body = r.choice(["&copy; ", "Copyright ", "© ", ""]) + r.choice([some(1, 4) + " &middot; " + prose(1, 2), some(2, 8), prose(1, 3), el("p", prose(1, 3)) + f"<ul>{link_list(r.randint(1, 6))}</ul>"])
        return r.choice([el("footer", body), el("footer", body, "site-footer"), el("div", body, "footer", "copyright", "legal")])

    def share():
        return el(r.choice(["div", "ul"]), "".join(f'<a href="#">{some(1, 2)}</a> ' for _ in range(r.randint(2, 5))), "share", "social-buttons", "share-tools")

    def piece():
        if r.random() < 0.12:  # wording alone doesn't tell an article's paragraph from a notice
            return el("p", r.choice(["All rights reserved.", "Copyright " + some(1, 3), some(1, 4) + " cookie " + sentence(), "Reply " + sentence(), sentence(), some(2, 6).capitalize() + "."]) + MARK)
        k = r.random()
        mid = r.choice(["", "", f' <a href="#">{some(1, 3)}</a> ' + some(1, 5), f" <b>{some(1, 3)}</b> {some(1, 4)}", "<br>" + sentence(), " &amp; " + some(1, 3)])
        if k < 0.62:
            t = prose() + mid + MARK
            return r.choice([f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<div>{t}</div>"])
        if k < 0.72:
            return el(r.choice(["h2", "h3", "h4"]), some(1, 7) + MARK)
        if k < 0.80:
            return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(el("li", r.choice([some(1, 8), sentence(), prose(1, 3), f'<a href="#">{some(1, 4)}</a> {some(3, 9)}']) + MARK) for _ in range(r.randint(2, 6))) + f"</{t}>"
        if k < 0.86:
            return el("blockquote", r.choice([prose(1, 3) + MARK, el("p", prose(1, 3) + MARK)]))
        if k < 0.90:
            return el("pre", some(3, 20) + MARK)
        if k < 0.94:
            return "<table>" + "".join("<tr>" + "".join(el("td", some(1, 5) + MARK) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.97:
            return el("figure", el("figcaption", sentence() + MARK))
        return el("p", some(1, 5) + MARK)

    def article():
        title = el(r.choice(["h1", "h1", "h2"]), some(2, 12) + MARK)
        if r.random() < 0.15:
            title = el("header", title)
        parts = [title] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            parts.append(piece())
            if r.random() < 0.12:
                parts.append(r.choice([advert, notice, share, side, form])())
        if r.random() < 0.15:
            parts.append(r.choice([share, comments, side, footer])())
        body = "".join(parts)
        wrap = r.choice([lambda b: el("article", b)] * 5 + [lambda b: el("main", el("article", b)), lambda b: el("main", b), lambda b: el("div", b, "content", "post", "entry-content", "article-body", "story"), lambda b: el("div", b), lambda b: el("section", b), lambda b: el("article", el("div", b, "body", "text"), "post")])
        return wrap(body)

    pages = []
    for _ in range(n):
        before = [f() for f in (header, menu, advert, notice, form, side) if r.random() < 0.45]
        after = [f() for f in (advert, side, comments, notice, form, share, menu) if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(footer())
        mid = article()
        if r.random() < 0.3:
            mid = el("div", mid + "".join(after), "wrapper", "page", "container")
            after = []
        pages.append(f"<html><head><title>{some(1, 6)}</title></head><body>" + "".join(before) + mid + "".join(after) + r.choice(["</body></html>", ""]))
    return pages


#: layouts of pages that don't say what their parts are
LAYOUTS = ("divs", "nested", "table", "bare", "breaks")


def loose_pages(n: int, seed: int, layouts: tuple[str, ...] = LAYOUTS) -> list[str]:
    """Pages without tags, classes or roles that tell text from the rest (classes, if any, are no words), made from a seed, with MARK as in labelled_pages.

    The rest is menus (links or words), search and login lines, imprints; the article has a title or none, paragraphs, headings, lists.
    """
    r = random.Random(seed)
    syll = "ab be cir do en fa gri he is jo kel lo mau ne or pe qua ra sti tu um vel wi ys zo".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.choice((1, 2, 2, 3, 4))))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda a, b: " ".join(some(5, 24).capitalize() + r.choice("...?!") for _ in range(r.randint(a, b)))
    own = {}

    def div(inner, tag="div"):
        kind = r.choice(own["kinds"])
        return f"<{tag}{f' class="{kind}"' if kind else ''}>{inner}</{tag}>"

    link = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'

    def menu():
        k = r.randint(2, 8)
        return r.choice([lambda: " ".join(link() for _ in range(k)), lambda: " | ".join(link() for _ in range(k)), lambda: " ".join(some(1, 1).capitalize() for _ in range(min(k, 5))), lambda: f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(k))}</ul>", lambda: some(1, 2)])()

    def tail():
        return r.choice([lambda: r.choice(["&copy; ", "Copyright ", "© 20" + str(r.randint(10, 29)) + " "]) + some(1, 5) + r.choice(["", ".", ". " + some(2, 5).capitalize() + "."]), lambda: " | ".join(some(1, 1).capitalize() for _ in range(r.randint(2, 4))), lambda: " ".join(link() for _ in range(r.randint(1, 5))), lambda: some(1, 4) + " " + link()])()

    def paragraph():
        k = r.random()
        if k < 0.72:
            return r.choice([prose(1, 3), prose(1, 6), prose(2, 8)]) + r.choice(["", "", " " + link() + " " + prose(1, 1)]) + MARK
        return (some(2, 9).capitalize() + r.choice([".", "", ":"]) if k < 0.86 else prose(1, 1)) + MARK

    def article(tag):
        parts = [f"<{(h := r.choice(['h1', 'h1', 'h1', 'h2', 'h3']))}>{some(1, 9)}{MARK}</{h}>"] if r.random() < 0.55 else []
        parts.append(f"<{tag}>{prose(1, 5)}{MARK}</{tag}>")
        for _ in range(r.choice((0, 0, 1, 2, 4, 7))):
            k = r.random()
            if k < 0.1:
                parts.append(f"<{(h := r.choice(['h2', 'h3']))}>{some(1, 6)}{MARK}</{h}>" + f"<{tag}>{prose(1, 4)}{MARK}</{tag}>")
            elif k < 0.18:
                parts.append("<ul>" + "".join(f"<li>{r.choice([some(2, 8), prose(1, 2)])}{MARK}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            else:
                parts.append(f"<{tag}>{paragraph()}</{tag}>")
        return "".join(parts)

    def page(layout):
        own["kinds"] = [None] if r.random() < 0.5 else [word() for _ in range(4)]
        if layout == "bare":
            return article("p") if r.random() < 0.5 else "".join(f"<p>{prose(1, 4)}{MARK}</p>" for _ in range(r.choice((1, 1, 2, 3))))
        tops, tails = [menu() for _ in range(r.choice((0, 0, 1, 1, 2)))], [tail() for _ in range(r.choice((0, 1, 1, 1, 2)))]
        if layout == "breaks":  # a paragraph ends at an empty line
            text = article("p").replace("<p>", "").replace("</p>", "<br><br>")
            return "".join(map(div, tops)) + div(text) + "".join(map(div, tails))
        if layout == "table":
            cell, row = (lambda x: div(x, "td")), (lambda x: f"<tr>{x}</tr>")
            body = article(r.choice(["p", "p", "div"])) if r.random() < 0.7 else r.choice([f"<h1>{some(1, 6)}{MARK}</h1>", ""]) + prose(2, 9) + MARK
            rows = [row(cell(x)) for x in tops[:1]] + [row("".join(map(cell, tops[1:])) + cell(body))] + [row(cell(x)) for x in tails]
            return "<table>" + "".join(rows) + "</table>"
        tag = r.choice(["p", "div"])
        body = div(article(tag))
        if layout == "nested":
            body = div(body) if r.random() < 0.5 else div(div(menu()) * (r.random() < 0.3) + body)
        around = "".join(div(x, r.choice(["div", "div", "p"])) for x in tops), "".join(div(x, r.choice(["div", "div", "p"])) for x in tails)
        return around[0] + body + around[1] if r.random() < 0.7 else div(around[0] + body + around[1])

    out = []
    for i in range(n):
        body = page(layouts[i % len(layouts)])
        out.append(r.choice([f"<html><head><title>{some(1, 5)}</title></head><body>{body}</body></html>", f"<body>{body}", body]))
    return out


def fit(pages: list[str], **options) -> dict:
    """A model from labelled pages: content blocks carry MARK in their text."""
    sequences = []
    for page in pages:
        got = blocks(page)
        if got:
            sequences.append((np.array([vector(b) for b, _ in got]), np.array([int(MARK in t) for _, t in got])))
    return crf.fit(sequences, **options)


@functools.lru_cache(maxsize=1)
def default_model(pages: int = 500, loose: int = 600, seed: int = 8) -> dict:
    """The model fitted on `pages` labelled pages of many layouts, and `loose` ones that don't say what their parts are."""
    return fit(labelled_pages(pages, seed) + loose_pages(loose, seed), steps=150)


class Extractor:
    def __init__(self, model: dict):
        self.emit, self.step, self.start = model["emit"], model["step"].tolist(), model["start"].tolist()
        self.scores: dict[int, tuple[float, float]] = {}

    def score(self, bits: int) -> tuple[float, float]:
        if bits not in self.scores:
            self.scores[bits] = tuple((np.array(vector(bits)) @ self.emit).tolist())
        return self.scores[bits]

    def labels(self, page: str) -> list[tuple[int, str]]:
        """(label, text) of each block; 1 is content."""
        got = blocks(page)
        if not got:
            return []
        return list(zip(crf.viterbi([self.score(b) for b, _ in got], self.step, self.start), [t for _, t in got]))

    def text(self, page: str) -> str:
        return "\n".join(t for k, t in self.labels(page) if k)


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_text(pages: DataFrame, model: dict | None = None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row`, text (the content blocks, one a line) and n_chars (its code points).

    Null and empty pages, and pages without content, give an empty text. Whole pages are read in linear time, whatever
    their length; markup that is cut off or wrongly nested is read as far as it goes.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def make():
        extract = Extractor(held.value)

        def work(texts):
            got = [extract.text(t) for t in texts.to_pylist()]
            return [pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())]

        return work

    return map_texts(pages, html_col, make, _OUT, keep)
