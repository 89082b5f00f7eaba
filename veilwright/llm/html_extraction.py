"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into a tree of elements as far as needed to know each text block's ancestors:
comments and declarations are skipped, scripts, styles and other elements that show no text are
left out with all they hold, elements that HTML closes by itself are closed. A block is a run of
text between borders of block elements; its white space becomes single spaces.

Each block has binary features of its ancestors (tag, role, and words of class and id) and of its
text (length, links, end, signs). The field scores a block as main text or not by these and by
the block before; Viterbi finds the best sequence. It is trained by gradient ascent of the
likelihood on pages that `labelled_pages()` makes with known labels: articles in many layouts with
menus, headers, footers, sidebars, notices, adverts, forms and comments around and inside.

Open elements are kept with their places by tag, and an ancestor's features are taken over once,
so that a page takes time in proportion to its length, however deep it nests.

Null and empty pages give an empty text, an empty table gives none. Rows are independent: repeated
rows and pages give equal texts; very long pages are read whole; of equally good label sequences
the one with less main text is taken. Other columns pass through, a column named as the result is
replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm._common import map_rows, table

TRAIN_PAGES = 400
SEED = 20
#: Start tags whose features a worker remembers.
SEEN_ELEMENTS = 1 << 14
#: Characters of attributes from which a start tag is not remembered.
LONG_ATTRIBUTES = 1 << 10
SILENT = frozenset("script style noscript template head title svg annotation annotation-xml iframe object embed canvas audio video select datalist textarea button option map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An element that opens closes these where they are open in the same part.
CLOSES = {t: frozenset(["p"]) for t in BLOCK - {"html", "body"}} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "tbody": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p"]), "thead": frozenset(["caption", "p"]), "tfoot": frozenset(["thead", "tbody", "tr", "td", "th", "p"]), "body": frozenset(["head"]),
}
#: An element that opens closes nothing outside of these.
SCOPE = frozenset("ul ol dl table article section aside nav div main form body header footer fieldset blockquote".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_NAME = re.compile(r"[a-z]+")
_SPLIT_CASE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(SEEN_ELEMENTS)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """The features that an element gives all blocks in it."""
    found = [f"t:{tag}"] if tag in BLOCK and tag not in ("html", "body", "div", "p") else []
    if "=" in attributes:
        for name, a, b, c in _ATTR.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
                found += [f"w:{w}" for w in dict.fromkeys(_NAME.findall(_SPLIT_CASE.sub(" ", entities.unescape(a or b or c)).lower()))]
    return tuple(found)


class Stack:
    """The open elements, with the places of each tag, of block elements and of scopes."""

    def __init__(self):
        self.items: list[tuple[str, tuple[str, ...], bool]] = []  # tag, features of it and all above, no text in it
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def push(self, tag: str, marks: tuple[str, ...], silent: bool) -> None:
        at = len(self.items)
        self.items.append((tag, marks, silent))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in SCOPE:
            self.scopes.append(at)

    def pop(self) -> str:
        tag = self.items.pop()[0]
        if tag:
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()
        return tag

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def forget(self, tag: str) -> None:
        """The innermost one of a tag counts as closed, though others are open in it."""
        at = self.places[tag].pop()
        self.items[at] = ("", *self.items[at][1:])

    def closed_by(self, tag: str) -> int | None:
        """The outermost element of the present scope that an opening tag closes."""
        base = self.scopes[-1] if self.scopes else -1
        firsts = [p[i] for t in CLOSES.get(tag, ()) if (p := self.places.get(t)) and (i := bisect_right(p, base)) < len(p)]
        return min(firsts, default=None)


def blocks(page: str | None, known=None) -> list[tuple[str, tuple[str, ...], str, float]]:
    """(text, ancestors' features, own tag, share of its characters in links) of each block. known: the features that matter."""
    page = page or ""
    found: list[tuple[str, tuple[str, ...], str, float]] = []
    stack = Stack()
    items = stack.items
    text: list[str] = []
    linked, links, at, size = 0, 0, 0, len(page)

    def flush():
        nonlocal linked
        if text:
            whole = entities.unescape("".join(text))
            flat = " ".join(whole.split())
            if flat:
                tag = items[stack.blocks[-1]][0] if stack.blocks else ""
                found.append((flat, items[-1][1] if items else (), tag, linked / max(1, len(whole))))
            text.clear()
        linked = 0

    def close(upto: int, flushing: bool):
        """Closes the elements from a place on."""
        nonlocal links
        while len(items) > upto:
            if flushing and items[-1][0] in BLOCK:
                flush()
            if stack.pop() == "a":
                links -= 1

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            if not (items and items[-1][2]):
                text.append(page[at:lt])
                if links:
                    linked += lt - at
            at = lt
            continue
        m = _TAG.match(page, at)
        if not m:
            if not (items and items[-1][2]):
                text.append("<")
            at += 1
            continue
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            k = stack.last(tag)
            if tag == "br":
                text.append(" ")
            elif k < 0:
                if tag == "p":
                    flush()
            elif tag in BLOCK or tag in SILENT:
                close(k, True)
            elif not stack.blocks or stack.blocks[-1] < k:
                close(k, False)
            elif tag == "a":
                links = max(0, links - 1)
                stack.forget(tag)
            continue
        if tag in ("br", "hr", "wbr"):
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in VOID:
            continue
        silent = bool(items and items[-1][2])
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if m[3].endswith("/>") and tag not in BLOCK:
            continue
        if tag in BLOCK:
            upto = stack.closed_by(tag)
            flush()
            if upto is not None:
                close(upto, False)
        if tag == "a":
            links += 1
        above = items[-1][1] if items else ()
        own = _marks(tag, m[3]) if len(m[3]) < LONG_ATTRIBUTES else _marks.__wrapped__(tag, m[3])
        marks = tuple(x for x in own if (known is None or x in known) and x not in above)
        stack.push(tag, above + marks if marks else above, silent or tag in SILENT)
    flush()
    return found


def features(page: list[tuple[str, tuple[str, ...], str, float]]) -> list[list[str]]:
    out = []
    for text, marks, tag, linked in page:
        n = len(text)
        f = ["bias", f"own:{tag}", f"len:{min(8, n.bit_length())}"]
        f += marks
        if linked > 0.5:
            f.append("links")
        if text[-1] in ".!?…":
            f.append("stop")
        if text[0] in "©®" or "©" in text[:40]:
            f.append("rights")
        out.append(f)
    return out


class Field:
    """Two labels (1: main text); weights of features and of neighbouring labels."""

    def __init__(self, index: dict[str, int], weights, steps):
        self.weights = {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-6}
        self.steps = steps

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        get = self.weights.get
        (s00, s01), (s10, s11) = self.steps
        back, a, b = [], 0.0, 0.0
        for k, f in enumerate(page):
            e = 0.0
            for x in f:
                e += get(x, 0.0)
            if not k:
                a, b = 0.0, e
                continue
            from0, from1 = a + s01, b + s11
            to0 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10)
            to1 = (0, from0) if from0 > from1 else (1, from1)
            back.append((to0[0], to1[0]))
            a, b = to0[1], to1[1] + e
        label = int(b > a)
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Gradient ascent (Adagrad) of the labels' likelihood, page by page, by forward and backward sums."""
    index: dict[str, int] = {}
    rows = [([np.array([index.setdefault(x, len(index)) for x in f]) for f in fs], np.array(ys)) for fs, ys in pages]
    w, steps = np.zeros(len(index)), np.zeros((2, 2))
    gw, gs = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            fs, ys = rows[r]
            n = len(ys)
            if not n:
                continue
            e = np.zeros((n, 2))
            e[:, 1] = [w[f].sum() for f in fs]
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = e[0]
            for k in range(1, n):
                fwd[k] = e[k] + np.logaddexp(fwd[k - 1][0] + steps[0], fwd[k - 1][1] + steps[1])
            for k in range(n - 2, -1, -1):
                x = e[k + 1] + bwd[k + 1]
                bwd[k] = np.logaddexp(steps[:, 0] + x[0], steps[:, 1] + x[1])
            total = np.logaddexp(*fwd[-1])
            p = np.exp(fwd + bwd - total)
            up = np.zeros(len(index))
            for k in range(n):
                np.add.at(up, fs[k], ys[k] - p[k, 1])
            ups = np.zeros((2, 2))
            for k in range(1, n):
                pair = np.exp(fwd[k - 1][:, None] + steps + (e[k] + bwd[k])[None, :] - total)
                ups -= pair
                ups[ys[k - 1], ys[k]] += 1
            up -= decay * w
            ups -= decay * steps
            gw += up * up
            gs += ups * ups
            w += rate * up / np.sqrt(gw)
            steps += rate * ups / np.sqrt(gs)
    return Field(index, w, steps.tolist())


# --- labelled pages ---------------------------------------------------------------------------

_SYLLABLES = "the an er in re on at en nd st or te es ti ha de la que ment eau ie sch un ge ver cion do ra lo as co ou ch".split()


def labelled_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Pages of invented text in varied layouts, with each block's label."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: some(3, 18).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])
    prose = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 6, 10])))
    pick = rng.choice
    mark = "\x02"  # before each block of main text, so that its label is known after parsing

    def wrap(tag: str, names: list[str], inside: str) -> str:
        attr = "" if not names or rng.random() < 0.15 and tag != "div" else f' {pick(["class", "class", "class", "id"])}="{pick(names)}"'
        return f"<{tag}{attr}>{inside}</{tag}>"

    def menu():
        items = "".join(f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(rng.randint(2, 9)))
        return wrap(pick(["nav", "nav", "div"]), ["nav", "menu", "navigation", "navbar", "breadcrumb", "main-menu", "topnav"], f"<ul>{items}</ul>")

    def header():
        return wrap(pick(["header", "header", "div"]), ["header", "site-header", "masthead", "banner", "top", "branding"], f"<div>{some(1, 5)}</div>" + (menu() if rng.random() < 0.4 else "") + (f"<p>{sentence()}</p>" if rng.random() < 0.4 else ""))

    def footer():
        return wrap(pick(["footer", "footer", "div"]), ["footer", "site-footer", "page-footer", "bottom", "copyright"], pick(["&copy; ", "© ", "", "Copyright "]) + some(2, 6) + pick([". ", " &middot; "]) + sentence() + (f"<p>{prose()}</p>" if rng.random() < 0.3 else ""))

    def side():
        inside = "".join(pick([f"<h3>{some(1, 4)}</h3>", f"<p>{prose()}</p>", f"<ul><li><a href='#'>{some(2, 6)}</a></li><li>{some(1, 5)}</li></ul>"]) for _ in range(rng.randint(1, 4)))
        return wrap(pick(["aside", "aside", "div"]), ["sidebar", "side", "related", "widget", "aside", "right-sidebar", "recommended", "most-read", "trending"], inside)

    def notice():
        return wrap(pick(["div", "div", "section", "dialog"]), ["cookie", "notice", "cookie-banner", "consent", "alert", "gdpr-notice", "popup", "modal", "newsletter", "subscribe", "message"], f"<p>{prose()}</p>" + pick(["", f"<button>{some(1, 2)}</button>", f"<a href='#'>{word()}</a>"]))

    def advert():
        return wrap(pick(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adbox", "promotion", "sponsor"], pick([prose(), f"<p>{prose()}</p>", f"<a href='#'>{some(2, 9)}</a>"]))

    def form():
        names = ["form", "search", "login", "signup", "subscribe-form", "contact"]
        return wrap("form", names, f"<label>{some(1, 4)}</label><input name=q><p>{sentence()}</p><select><option>{word()}</option></select>{pick(['', f'<fieldset><legend>{word()}</legend>{some(1, 4)}</fieldset>'])}<button>{word()}</button>")

    def replies():
        one = lambda: wrap(pick(["div", "li", "article", "p"]), ["comment", "comment-body", "reply", "comment-item"], pick([prose(), f"<p>{prose()}</p>", f"<b>{word()}</b><p>{prose()}</p>"]))
        return wrap(pick(["section", "div", "ol", "div"]), ["comments", "comment-list", "discussion", "responses", "reader-comments", "replies", "disqus"], pick(["", f"<h2>{some(1, 3)}</h2>"]) + "".join(one() for _ in range(rng.randint(1, 5))))

    def social():
        return wrap("div", ["share", "social", "share-buttons", "tags", "byline-tools", "pagination"], "".join(f"<a href='#'>{word()}</a> " for _ in range(rng.randint(2, 5))))

    def inline(x: str) -> str:
        words = x.split(" ")
        i = rng.randrange(len(words))
        words[i] = pick(["<b>{}</b>", "<em>{}</em>", "<a href='/x'>{}</a>", "<span class=x>{}</span>", "{}<br>", "<strong>{}", "{}&amp;", "<i>{}</i>", "{}", "{}"]).format(words[i])
        return mark + " ".join(words)

    def content() -> str:
        r = rng.random()
        if r < 0.7:
            return f"<p>{inline(prose())}" + ("</p>" if rng.random() < 0.9 else "")
        if r < 0.8:
            return f"<h2>{inline(some(1, 8))}</h2>"
        if r < 0.88:
            return "<ul>" + "".join(f"<li>{inline(pick([some(1, 9), sentence()]))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if r < 0.92:
            return f"<blockquote><p>{inline(prose())}</p></blockquote>"
        if r < 0.95:
            return f"<pre>{inline(some(3, 20))}</pre>"
        if r < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{inline(some(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        return f"<figure><figcaption>{inline(sentence())}</figcaption></figure>"

    def article() -> str:
        parts = [f"<h1>{inline(some(2, 12))}</h1>"] if rng.random() < 0.85 else []
        parts += [content() for _ in range(rng.choice([1, 2, 4, 6, 10, 16]))]
        for extra, chance in ((advert, 0.3), (side, 0.15), (social, 0.15), (replies, 0.15), (form, 0.1), (notice, 0.12), (menu, 0.05), (footer, 0.08)):
            if rng.random() < chance:
                parts.insert(rng.randint(1, len(parts)), extra())
        inside = "".join(parts)
        kind = rng.random()
        if kind < 0.5:
            return wrap("article", ["post", "article", "entry", "story", "hentry"], inside)
        if kind < 0.65:
            return wrap("main", ["content", "main", "main-content"], pick([inside, f"<article>{inside}</article>"]))
        if kind < 0.9:
            return f'<div {pick(["class", "id"])}="{pick(["content", "article", "post", "entry-content", "article-body", "story", "post-content", "main", "text", "body-text"])}">{inside}</div>'
        return f"<div>{inside}</div>"

    pages = []
    for _ in range(count):
        before = [f() for f, chance in ((header, 0.5), (menu, 0.7), (notice, 0.25), (advert, 0.5), (form, 0.2), (side, 0.15)) if rng.random() < chance]
        after = [f() for f, chance in ((replies, 0.35), (side, 0.35), (advert, 0.3), (social, 0.2), (form, 0.2), (notice, 0.15), (footer, 0.8)) if rng.random() < chance]
        rng.shuffle(before)
        page = f"<!DOCTYPE html><html><head><title>{some(1, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(before)}{article()}{''.join(after)}" + ("</body></html>" if rng.random() < 0.9 else "")
        found = blocks(page)
        pages.append((page.replace(mark, ""), [int(mark in b[0]) for b in found]))
    return pages


@cache
def trained() -> Field:
    return train([(features(blocks(page)), labels) for page, labels in labelled_pages()])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, field.weights)
    return "\n\n".join(b[0] for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text", field: Field | None = None) -> DataFrame:
    """Adds the main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())

    def make():
        known = shared.value
        return lambda x: (main_text(x, known),)

    return map_rows(pages, [html], pa.schema([(out, pa.string())]), f"{out} string", make)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
SQL: dict[str, str] = {}
