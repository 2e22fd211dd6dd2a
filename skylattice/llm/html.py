"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the text between block-level tags, in page order. Scripts, styles, markup comments, form
controls and drawings are no text. Each block has features from the tags around it (their names, the words of their
class, id and role, the last word of each apart from those before it, and whether main text lies within what is beside
it or the other way round), from its own tag, and from its text. Nothing is dropped for one name, nor for being hidden:
these are features like others. A conditional random field labels every block as main text or not; its
weights, also those of neighbouring labels, are trained here on labelled pages by gradient ascent on the likelihood,
and Viterbi decoding gives the best labelling of a page. The main text is the blocks labelled so.

The labelled pages are generated: articles in several layouts, with the furniture that pages have around and inside
them, each block's label known. Names mislead in some of them: articles whose classes speak of sidebars and headers,
and furniture named after the article it belongs to.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of HTML.
BLOCK_TAGS = frozenset(
    "html body head title p div section article main header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr "
    "td th caption h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption form fieldset address hr details summary center "
    "dialog menu hgroup".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no text, and no tag, up to their end tag; without one, to the end of the page.
RAW_TAGS = frozenset("script style".split())
#: The same where they have an end tag; else only the tag is left out.
RAW_IF_CLOSED = frozenset("iframe textarea".split())
#: Form parts have no text; left open, they end with their parent, or where a block or the same part starts.
FORM_PARTS = frozenset("button select option optgroup datalist".split())
#: What stands in these is no text if they have an end tag in their parent; else they are like other elements.
REPLACED = frozenset("template svg canvas".split())
#: Elements that end when another block starts in them.
ENDS_AT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 dt dd".split())

#: Elements and names that stand for what isn't main text.
TAGS_BESIDE = {"before": ("nav", "header", "aside", "form"), "inside": ("aside", "aside", "form", "nav"), "after": ("footer", "aside", "nav", "form")}
NAMES_BESIDE = {
    "menu": ("menu", "nav", "navbar", "navigation", "topbar", "topnav", "breadcrumb", "breadcrumbs", "pagination", "toc"),
    "edges": ("header", "footer", "banner", "masthead", "copyright", "contentinfo", "complementary", "bottom"),
    "sidebar": ("sidebar", "widget", "related", "recommended", "more", "latest", "popular", "aside"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "adslot"),
    "notice": ("notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "disclaimer"),
    "social": ("share", "social", "follow", "tags", "author", "meta"),
    "comments": ("comments", "comment", "commentlist", "responses", "replies", "discussion", "disqus"),
}
#: Names that stand for main text, and words before a name that only say whether a page has such a thing.
NAMES_MAIN = "article content post entry main story body text prose".split()
NAMES_APART = "has with no without hide show is".split()
_MAIN = frozenset(NAMES_MAIN)
_APART = frozenset(NAMES_APART)
_BESIDE = frozenset(x for names in NAMES_BESIDE.values() for x in names)
#: Longer names are also known by their start, as in sidebarright.
_STARTS = tuple(sorted(x for x in _BESIDE if len(x) >= 6))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\x22']++|\x22[^\x22]*+(?:\x22|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
#: A slash that closes the element at once, and is no part of an unquoted value.
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")
_UNDISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    __slots__ = ("text", "tag", "path", "linked", "hidden")

    def __init__(self, text: str, tag: str, path: tuple[str, ...], linked: int, hidden: bool = False):
        self.text, self.tag, self.path, self.linked, self.hidden = text, tag, path, linked, hidden


@lru_cache(maxsize=1 << 14)
def _named(attributes: str) -> tuple[tuple[str, ...], str]:
    """Features of an element's class, id and role, and whether they stand for main text (m) or what is beside it (b)."""
    hints, kinds = [], set()
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if not words or words[0] in _APART:
                continue
            head = words[-1]
            hints += [f"head={head}", *(f"part={w}" for w in words[:-1])]
            if head in _BESIDE or len(words) == 1 and head.startswith(_STARTS):
                kinds.add("b")
            elif head in _MAIN:
                kinds.add("m")
    return tuple(dict.fromkeys(hints)), kinds.pop() if len(kinds) == 1 else ""


_TAG_KINDS = {"nav": "b", "aside": "b", "footer": "b", "form": "b", "article": "m", "main": "m"}


@lru_cache(maxsize=1 << 14)
def _longer(path: tuple[str, ...], tag: str, attributes: str) -> tuple[str, ...]:
    """The way to an element: first the order of main text and what is beside it, the last two of them; then features."""
    hints, kind = _named(attributes) if tag not in ("html", "body") else ((), "")
    order, *rest = path or ("order=",)
    for k in (_TAG_KINDS.get(tag, ""), kind):
        if k and order[-1] != k:
            order = f"order={(order[6:] + k)[-2:]}"
    return tuple(dict.fromkeys((order, *rest, f"in={tag}", *hints)))


@lru_cache(maxsize=1 << 14)
def _hides(attributes: str) -> bool:
    """Whether an element is hidden: by ``hidden``, by ``aria-hidden`` or by its style; words in other values don't count."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and _UNDISPLAYED.search(value):
            return True
    return False


@lru_cache(maxsize=1 << 10)
def _either(tag: str, parent: str) -> re.Pattern:
    return re.compile(rf"<(/?)({re.escape(tag)}|{re.escape(parent)})(?=[\s/>])", re.I)


def _closed(page: str, at: int, tag: str, parent: str) -> bool:
    """Whether an element's end tag comes before its parent's, and before the same element starts again."""
    depth = 0
    for m in _either(tag, parent).finditer(page, at):
        if m[2].lower() == tag:
            return bool(m[1])
        depth += -1 if m[1] else 1
        if depth < 0:
            return False
    return False


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, character references decoded, white space made single."""
    page = page or ""
    out: list[Block] = []
    # tag, whether it has no text (1) or is hidden (2), the way to it, nearest block, whether blocks stay inside
    stack: list[tuple[str, int, tuple[str, ...], str, bool]] = []
    parts: list[str] = []
    linked, at, depth_of_links, hidden, unseen = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, _, path, tag, _ = stack[-1] if stack else ("", False, (), "body", False)
            out.append(Block(text, tag, path, linked, bool(unseen)))
        linked = 0

    def pop() -> None:
        nonlocal depth_of_links, hidden, unseen
        tag, how, _, _, _ = stack.pop()
        depth_of_links -= tag == "a"
        hidden -= how & 1
        unseen -= how >> 1

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text = entities.unescape(raw)
            parts.append(text)
            if depth_of_links:
                linked += len(text.strip())

    raw_until, open_to_end = 0, set()
    for m in _TOKEN.finditer(page):
        if m.start() < raw_until:
            continue
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            if any(x[0] == tag for x in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in BLOCK_TAGS:
            flush()
            while stack and stack[-1][0] not in BLOCK_TAGS and not stack[-1][4]:  # inline elements left open end with their block
                pop()
            if stack and (stack[-1][0] in ENDS_AT_BLOCK or tag == stack[-1][0] == "li"):
                pop()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS or _EMPTY.search(m[3]):
            continue
        if tag in RAW_TAGS or tag in RAW_IF_CLOSED:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if tag not in open_to_end else None
            if end or tag in RAW_TAGS:
                at = raw_until = end.end() if end else len(page)
            else:
                open_to_end.add(tag)
            parts.append(" ")
            continue
        how, stays = 2 * (bool(m[3]) and _hides(m[3])), False
        if how and tag in BLOCK_TAGS and not unseen:
            flush()
        if tag in FORM_PARTS or tag in REPLACED:
            parts.append(" ")
            if tag in FORM_PARTS and stack and (stack[-1][0] == tag or (stack[-1][0] == "option" and tag == "optgroup")):
                pop()
            stays = tag != "option" and _closed(page, at, tag, stack[-1][3] if stack else "body")
            how |= stays or tag in FORM_PARTS
        _, _, path, near, _ = stack[-1] if stack else ("", False, (), "body", False)
        stack.append((tag, how, _longer(path, tag, m[3]), tag if tag in BLOCK_TAGS else near, stays))
        depth_of_links += tag == "a"
        hidden += how & 1
        unseen += how >> 1
    add(page[at:])
    flush()
    return out


@lru_cache(maxsize=1 << 14)
def _structure(tag: str, path: tuple[str, ...]) -> tuple[str, ...]:
    beside = any(x[:5] == "head=" and (x[5:] in _BESIDE or x[5:].startswith(_STARTS)) for x in path)
    tagged = any(x in ("in=nav", "in=aside", "in=footer", "in=header", "in=form") for x in path)
    return (f"tag={tag}", *path, "a name beside" if beside else "no name beside", "a tag beside" if tagged else "no tag beside")


def features(page_blocks: list[Block]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """For each block the names of the features that hold: those of the tags, those of the text and place."""
    out = []
    for i, b in enumerate(page_blocks):
        text, words, share = b.text, b.text.count(" ") + 1, b.linked / len(b.text)
        out.append(
            (
                _structure(b.tag, b.path),
                (
                    "words=1" if words == 1 else "words=2-4" if words < 5 else "words=5-9" if words < 10 else "words=10-24" if words < 25 else "words=25+",
                    "links=0" if share == 0 else "links<1/3" if share < 0.33 else "links<3/4" if share < 0.75 else "links=most",
                    "ends a sentence" if text[-1] in ".!?…\"”»" else "ends otherwise",
                    "hidden" if b.hidden else "",
                    "copyright" if "©" in text or "ll rights reserved" in text else "",
                    "separators" if text.count("|") + text.count("·") + text.count("»") >= 2 else "",
                    "first" if i == 0 else "",
                    "last" if i == len(page_blocks) - 1 else "",
                ),
            )
        )
    return out


class Crf:
    """Weights of features by label (0 other, 1 main) and of neighbouring labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps
        self.sums: dict[tuple[str, ...], tuple[float, float]] = {}

    def _sum(self, own: tuple[str, ...]) -> tuple[float, float]:
        known = self.sums.get(own)
        if known is None:
            if len(self.sums) > 1 << 16:
                self.sums.clear()
            known = self.sums[own] = tuple(self.weights[[self.names[f] for f in own if f in self.names]].sum(0).tolist())
        return known

    def scores(self, page: list[tuple]) -> list[tuple[float, float]]:
        """Each block's log score of either label."""
        out = []
        for structure, rest in page:
            (a0, a1), (b0, b1) = self._sum(structure), self._sum(rest)
            out.append((a0 + b0, a1 + b1))
        return out

    def viterbi(self, page: list[tuple]) -> list[int]:
        """The best labelling; of equal ones, the one with label 0 first."""
        if not page:
            return []
        emit, ((s00, s01), (s10, s11)) = self.scores(page), self.steps.tolist()
        (best0, best1), back = emit[0], []
        for e0, e1 in emit[1:]:
            from0, from1 = best1 + s10 > best0 + s00, best1 + s11 > best0 + s01
            best0, best1 = (best1 + s10 if from0 else best0 + s00) + e0, (best1 + s11 if from1 else best0 + s01) + e1
            back.append((from0, from1))
        label = int(best1 > best0)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def fit(pages: list[list[tuple]], labels: list[list[int]], rounds: int = 70, rate: float = 0.5, penalty: float = 0.003) -> Crf:
    """Maximises the penalised conditional likelihood with forward-backward gradients and adaptive steps."""
    names: dict[str, int] = {}
    for page in pages:
        for structure, rest in page:
            for f in filter(None, (*structure, *rest)):
                names.setdefault(f, len(names))
    lengths = np.array([len(page) for page in pages])
    keep = np.flatnonzero(lengths)  # pages without blocks tell nothing
    pages, labels, lengths = [pages[i] for i in keep], [labels[i] for i in keep], lengths[keep]
    rows = [[names[f] for f in filter(None, (*structure, *rest))] for page in pages for structure, rest in page]
    feature = np.array([f for row in rows for f in row])
    row_of = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    starts = np.concatenate([[0], np.cumsum([len(row) for row in rows])[:-1]])
    page_of = np.repeat(np.arange(len(pages)), lengths)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    n, longest = len(pages), int(lengths.max())
    truth = np.array([y for page in labels for y in page])
    # A page is a row of ``longest`` places; what is beyond its end changes nothing.
    held = np.arange(longest)[None, :] < lengths[:, None]
    real = np.zeros((len(rows), 2))
    real[np.arange(len(rows)), truth] = 1
    seen_steps = np.zeros((2, 2))
    np.add.at(seen_steps, (truth[:-1][page_of[:-1] == page_of[1:]], truth[1:][page_of[:-1] == page_of[1:]]), 1)
    theta = np.zeros(2 * len(names) + 4)
    squares = np.full(len(theta), 1e-8)
    for _ in range(rounds):
        w, t = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[page_of, place] = np.add.reduceat(w[feature], starts, axis=0)
        forward, backward = emit.copy(), np.zeros((n, longest, 2))
        for i in range(1, longest):
            ahead = emit[:, i] + np.logaddexp(forward[:, i - 1, :1] + t[0], forward[:, i - 1, 1:] + t[1])
            forward[:, i] = np.where(held[:, i, None], ahead, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            ahead = emit[:, i + 1] + backward[:, i + 1]
            both = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
            backward[:, i] = np.where(held[:, i + 1, None], both, 0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        single = np.exp(forward + backward - whole[:, None, None])
        delta = real - single[page_of, place]
        grad_w = np.stack([np.bincount(feature, delta[row_of, k], len(names)) for k in (0, 1)], axis=1)
        pairs = forward[:, :-1, :, None] + t + (emit + backward)[:, 1:, None, :] - whole[:, None, None, None]
        grad_t = seen_steps - np.exp(pairs[held[:, 1:]]).sum(0)
        gradient = (np.concatenate([grad_w.reshape(-1), grad_t.reshape(-1)]) - penalty * theta) / n
        squares += gradient**2
        theta += rate * gradient / np.sqrt(squares)
    return Crf(names, theta[:-4].reshape(-1, 2).copy(), theta[-4:].reshape(2, 2).copy())


# --- labelled pages

MAIN = "\x01"
#: Labelled pages that the model is fitted to, and the seed of their generator.
PAGES, SEED = 500, 11


def labelled_page(r: random.Random) -> str:
    """A page in which every piece of main text starts with ``MAIN``."""
    syllables = "an ber cal de en fir go hal in jo ka lo mer no or pa qui ra sol ti un ver wa zen".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return words(1, 14).capitalize() + r.choice("...!?")

    def prose(a: int = 1, b: int = 6) -> str:
        text = " ".join(sentence() for _ in range(r.randint(a, b)))
        if r.random() < 0.3:
            text = text.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        if r.random() < 0.15:
            text = text.replace(" ", r.choice([" &amp; ", "%%% ", " | ", "*** "]))
        return text

    def links(n: int, sep: str = "", item: str = '<li><a href="/x">{}</a></li>') -> str:
        return sep.join(item.format(words(1, 3)) for _ in range(n))

    def misleading() -> str:
        """A name of the article's own that has a word for something else in it."""
        beside = r.choice(NAMES_BESIDE[r.choice(list(NAMES_BESIDE))])
        of = word()
        return r.choice([f"{beside}-{r.choice(NAMES_MAIN)}", f"{beside}-{of}-{r.choice(NAMES_MAIN)}", f"{beside}-{of}", f"{r.choice(NAMES_APART)}-{beside}", f"{of} {beside}-{of}"])

    def main_block() -> str:
        made = plain_block()
        if r.random() < 0.12:
            made = made.replace(">", f' class="{r.choice([misleading(), word(), r.choice(NAMES_MAIN)])}">', 1)
        if r.random() < 0.03:
            made = made.replace(">", r.choice([" hidden>", ' style="display:none">']), 1)
        if r.random() < 0.03:
            tag = r.choice(["noscript", "object", "details", "figure"])
            made = f"<{tag}>{made}</{tag}>"
        return made

    def plain_block() -> str:
        kind = r.random()
        if kind < 0.1:
            return f"<h2>{MAIN}{words(1, 6)}</h2>"
        if kind < 0.16:
            return "<ul>" + "".join(f"<li>{MAIN}{prose(1, 1)}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if kind < 0.2:
            return f"<blockquote>{MAIN}{prose(1, 2)}</blockquote>"
        if kind < 0.24:
            return f"<pre>{MAIN}{words(3, 20)}</pre>"
        if kind < 0.28:
            return "<table><tr>" + "".join(f"<td>{MAIN}{words(1, 2)}</td>" for _ in range(r.randint(2, 4))) + "</tr></table>"
        if kind < 0.4:
            return f"<p><b>{MAIN}{prose(1, 2)}<br>"
        if kind < 0.5:
            return f"<p>{MAIN}{word().capitalize()}.</p>"
        return f"<p>{MAIN}{prose()}" + r.choice(["</p>", "</p>", "</p>", ""])

    def furniture(place: str) -> str:
        made = plain_furniture(place)
        return made.replace(">", r.choice([" hidden>", ' style="display:none">', ' aria-hidden="true">']), 1) if r.random() < 0.08 else made

    def plain_furniture(place: str) -> str:
        """What isn't main text: by an element made for it, or by a name; its content is of any kind."""
        content = r.choice(
            [
                lambda: f"<p>{prose(1, 3)}</p>", lambda: f"<h3>{words(1, 3)}</h3><p>{prose(1, 2)}</p>", lambda: prose(1, 2), lambda: f"<ul>{links(r.randint(2, 7))}</ul>",
                lambda: f"<h4>{words(1, 3)}</h4><ul>{links(3)}</ul>", lambda: links(r.randint(2, 6), r.choice([" ", " | ", " &raquo; "]), "<a href=/x>{}</a>"),
                lambda: f"<div>{prose(1, 2)}</div>", lambda: f"<span>{words(1, 4)}</span>",
            ]
        )
        kind = r.random()
        if kind < 0.35:
            tag = r.choice(TAGS_BESIDE[place])
            if tag == "form":
                return f"<form><label>{words(1, 4)}</label><p>{prose(1, 2)}</p><input name=q><button>{word()}</button></form>"
            return f"<{tag}>{content()}</{tag}>"
        if kind < 0.5 and place != "before":
            comment = lambda: f'<div class="{r.choice(["comment", "reply", "comment-body", ""])}"><span class="author">{word()}</span><p>{prose(1, 3)}</p></div>'
            name = r.choice(NAMES_BESIDE["comments"])
            tag = r.choice(["section", "div", "ol"])
            return f'<{tag} class="{name}"><h3>{words(1, 2)}</h3>' + "".join(comment() for _ in range(r.randint(1, 4))) + f"</{tag}>"
        if kind < 0.52 and place != "inside":
            return f"<noscript>{prose(1, 1)}</noscript>"
        if kind < 0.6 and place == "after":
            return f'<footer>&copy; {words(1, 3)} &middot; {prose(1, 1)}</footer>'
        name = r.choice(NAMES_BESIDE[r.choice([k for k in NAMES_BESIDE if k != "comments"])])
        before = r.choice(["site-", "page-", "top-", f"{r.choice(NAMES_MAIN)}-", "", "", "", ""])
        name = before + name + ("" if r.random() < 0.7 else r.choice([" box", "_wrapper" if not before else "", "-1", f" {word()}"]))
        tag = r.choice(["div", "div", "div", "section", "p"])
        how = r.choice(["class", "class", "id", "role"])
        return f'<{tag} {how}="{name}">{prose(1, 2) if tag == "p" else content()}</{tag}>'

    opening, closing = r.choice(
        [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"),
         ('<div class="post-body entry">', "</div>"), ("<main><article>", "</article></main>"), ('<div class="article-text">', "</div>"), ("<div>", "</div>"),
         ('<div role="main">', "</div>"), ('<section class="post"><div class="post-content">', "</div></section>"), ('<div class="wrap"><div class="body story">', "</div></div>"), ("", "")]
    )
    if opening and r.random() < 0.3:  # a wrapper of the whole, or the article itself, is named after something else too
        name = misleading()
        opening, closing = r.choice([(f'<div class="{name}">{opening}', f"{closing}</div>"), (f'{opening}<div class="{name}">', f"</div>{closing}"), (f'<div class="{name}">', "</div>")])
    body = [f"<h1>{MAIN}{words(1, 9)}{r.choice(['', '.', '&amp;'])}</h1>"] * r.choice([0, 1, 1, 1]) + [main_block() for _ in range(r.randint(1, 12))]
    for _ in range(r.choice([0, 0, 1, 2, 3])):
        body.insert(r.randint(1, len(body)), furniture("inside"))
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    most = r.choice([0, 2, 4, 4])
    before, after = ("".join(furniture(place) for _ in range(r.randint(0, most))) for place in ("before", "after"))
    if r.random() < 0.2:
        before, after = f'<div class="{misleading()}">{before}', f"{after}</div>"
    return r.choice([head, head, ""]) + before + opening + "".join(body) + closing + after + r.choice(["</body></html>", ""])


@lru_cache(maxsize=1)
def model(n: int = PAGES, seed: int = SEED) -> Crf:
    """The field fitted to ``n`` generated pages; made once a process."""
    r = random.Random(seed)
    pages, labels = [], []
    for _ in range(n):
        found = blocks(labelled_page(r))
        labels.append([int(b.text.startswith(MAIN)) for b in found])
        for b in found:
            b.text = b.text.removeprefix(MAIN) or "."
        pages.append(features(found))
    return fit(pages, labels)


def main_text(page: str | None, crf: Crf) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, crf.viterbi(features(found))) if label)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: ``page_id``, ``url``, ``text`` (main blocks joined by line ends, empty if none), ``n_chars``.

    Null html is an empty page. Blocks are never cut or dropped for their size. Repeated rows are each extracted, null
    ids and urls stay; an empty table gives no rows; other columns are not looked at.
    """
    crf = model()

    @F.pandas_udf(T.StringType())
    def text_of(parts: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, crf) for p in parts], dtype=object)

    return pages.select("page_id", "url", text_of(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
