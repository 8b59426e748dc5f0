"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (text between block-level tags) with the tags,
classes and ids above them. Each block has features of its ancestors and of its
text; the field labels the sequence main text or not, with transition weights
between neighbours, and Viterbi decodes it. It is trained here, by gradient on
the exact likelihood, on labelled pages that ``labelled_pages`` makes from a
seeded grammar of layouts (none of them is taken from the data).

Scripts, styles, comments and other markup never become blocks. Character
references are decoded, white space inside a block becomes one space, blocks are
joined by one space in page order. Defined results: null or empty html and pages
without main text give the empty text; cut-off pages are read as far as they go;
blocks and pages of any length are read whole; of two equally good sequences of labels
the one with less main text is taken; repeated rows keep a row each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.batches import map_columns, strings

#: Elements whose content isn't text of the page: those that only their own end tag ends, and those of parsed
#: content, which may nest; one of these without an end tag is skipped as a tag alone.
RAW = frozenset("script style noscript textarea title iframe".split())
HIDDEN = frozenset("template object svg select datalist button audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that features name; a page's other tags only build the tree.
TAGS = "article main nav header footer aside form section div ul ol li table p h1 h2 h3 h4 blockquote pre figure figcaption dl fieldset dialog menu address details".split()
#: Parts of class and id values (and roles) that features name.
HINTS = (
    "ad ads advert advertisement adsense sponsor sponsored promo banner cookie consent gdpr notice alert popup modal overlay comment comments reply disqus sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager share social related recommended more footer foot bottom header head top masthead logo search login form newsletter subscribe signup tags meta byline copyright legal "
    "article post entry content story text main body blog page hentry"
).split()

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_TAG = re.compile(r"""(?P<comment><!--)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|$)|<[!?/][^>]*(?:>|$)""", re.S)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_HINT_BIT = {t: 1 << (len(TAGS) + i) for i, t in enumerate(HINTS)}
_N_ABOVE = len(TAGS) + len(HINTS)
#: What holds main text, and what inside it doesn't: together one feature, "in the main part and in nothing else".
_HOLDS = _TAG_BIT["article"] | _TAG_BIT["main"] | sum(_HINT_BIT[h] for h in "article post entry content story hentry".split())
_ASIDE = sum(_TAG_BIT[t] for t in "nav footer aside form dialog menu".split()) | sum(_HINT_BIT[h] for h in HINTS[: HINTS.index("article")] if h not in ("header", "head", "top", "meta", "byline", "more"))
#: Bits of the text: length steps, links, marks.
_LENGTHS = (15, 40, 90, 200, 500)
TEXT_BITS = [*(f"longer{n}" for n in _LENGTHS), "mostly_link", "some_link", "ends_sentence", "has_comma", "copyright", "rights_in_short", "rights_in_long", "digits", "parent_li", "cookie_word_in_short", "cookie_word_in_long", "short_caps", "plainly_main"]
N_FEATURES = _N_ABOVE + len(TEXT_BITS)
_COOKIE = re.compile(r"\b(?:cookies?|consent|subscribe|newsletter|sign up|log ?in|advertis\w+|sponsored)\b", re.I)
_DIGITS = re.compile(r"\d")
_RIGHTS = re.compile(r"©|\(c\)|all rights reserved|copyright", re.I)


def leaf_blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, ancestor bits, text bits) of each leaf block in page order."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int]] = []  # tag, bits of it and of all above
    text: list[str] = []
    link, linked, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                above = stack[-1][1] if stack else 0
                plainly = bool(above & _HOLDS) and not above & _ASIDE
                out.append((words, above, _text_bits(words, linked, bool(stack) and stack[-1][0] == "li", plainly)))
            text.clear()
        linked = 0

    while at < n:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece  # a reference never goes on behind a tag
            text.append(piece)
            if link:
                linked += len(piece)
        if m is None:
            break
        if m["comment"]:
            at = _COMMENT.match(page, m.start()).end()
            continue
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag or m[8] == "":
            continue  # a declaration, or a tag that the end of the page cuts off
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        if tag == "a":
            link = 0 if closing else 1
            continue
        if closing:
            if tag in BLOCK:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if depth >= 0 or tag == "p":  # a lone </p> is an empty paragraph
                    flush()
                    link = 0
                if depth >= 0:
                    del stack[depth:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in HIDDEN:
            at = at if attributes.endswith("/") and tag == "svg" else _behind(page, tag, at)
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        link = 0
        if tag in VOID:
            continue
        # A new block ends an open paragraph; a new item ends the one before it.
        if stack and stack[-1][0] == "p":
            stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            stack.pop()
        bits = (stack[-1][1] if stack else 0) | _TAG_BIT.get(tag, 0)
        for v in _ATTR.findall(attributes):
            for part in _PART.findall("".join(v).lower()):
                bits |= _HINT_BIT.get(part, 0)
        stack.append((tag, bits))
    flush()
    return out


def _behind(page: str, tag: str, at: int) -> int:
    """Where an element whose start tag ends at ``at`` is over; ``at`` itself if nothing ends it."""
    depth = 1
    for m in _within(tag).finditer(page, at):
        if m[0][1] == "/":
            depth -= 1
        elif m[0][-2:] != "/>":
            depth += 1
        if depth == 0:
            return m.end()
    return at


@lru_cache(maxsize=64)
def _within(tag: str) -> re.Pattern:
    return re.compile(rf"""</?{re.escape(tag)}(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.I)


def _text_bits(words: str, linked: int, in_item: bool, plainly: bool) -> int:
    size = len(words)
    rights, cookie, short = _RIGHTS.search(words) is not None, _COOKIE.search(words) is not None, size <= _LENGTHS[3]
    flags = [size > n for n in _LENGTHS]
    flags += [linked * 2 > size, linked * 5 > size, words[-1] in ".!?\"”»:", "," in words, "©" in words, rights and short, rights and not short, len(_DIGITS.findall(words)) * 4 > size]
    flags += [in_item, cookie and short, cookie and not short, size < 40 and words.isupper(), plainly]
    return sum(1 << i for i, f in enumerate(flags) if f)


def vector(above: int, own: int) -> np.ndarray:
    bits = above | own << _N_ABOVE
    return np.array([bits >> i & 1 for i in range(N_FEATURES)], np.float64)


class Field:
    """Weights of features for main text against the rest, of transitions, of the first label."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray, first: np.ndarray):
        self.weights, self.bias, self.moves, self.first = weights, bias, moves, first
        self.seen: dict[tuple[int, int], float] = {}

    @classmethod
    def fit(cls, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300) -> Field:
        """pages: (features by block, labels 0 or 1)."""
        n, t, d = len(pages), max(len(y) for _, y in pages), pages[0][0].shape[1]
        x, y, on = np.zeros((n, t, d)), np.zeros((n, t), int), np.zeros((n, t), bool)
        for i, (f, lab) in enumerate(pages):
            x[i, : len(lab)], y[i, : len(lab)], on[i, : len(lab)] = f, lab, True
        last = on.sum(1) - 1
        w, b, a, s = np.zeros(d), 0.0, np.zeros((2, 2)), np.zeros(2)
        acc = [np.full(d, 1e-6), 1e-6, np.full((2, 2), 1e-6), np.full(2, 1e-6)]
        rows = np.arange(n)
        for _ in range(rounds):
            e = np.zeros((n, t, 2))
            e[:, :, 1] = x @ w + b
            fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            fwd[:, 0] = e[:, 0] + s
            for k in range(1, t):
                fwd[:, k] = np.where(on[:, k, None], np.logaddexp(fwd[:, k - 1, 0, None] + a[0], fwd[:, k - 1, 1, None] + a[1]) + e[:, k], fwd[:, k - 1])
            z = np.logaddexp(fwd[rows, last, 0], fwd[rows, last, 1])
            for k in range(t - 2, -1, -1):
                nxt = e[:, k + 1] + bwd[:, k + 1]
                step = np.stack([np.logaddexp(nxt[:, 0] + a[i, 0], nxt[:, 1] + a[i, 1]) for i in (0, 1)], axis=1)
                bwd[:, k] = np.where(on[:, k + 1, None], step, 0)
            post = np.exp(fwd + bwd - z[:, None, None]) * on[:, :, None]
            diff = (post[:, :, 1] - y * on) / n
            gw, gb = np.einsum("nt,ntd->d", diff, x) + 1e-4 * w, diff.sum()
            pair = on[:, 1:]
            ga = np.zeros((2, 2))
            for i in (0, 1):
                for j in (0, 1):
                    p = np.exp(fwd[:, :-1, i] + a[i, j] + e[:, 1:, j] + bwd[:, 1:, j] - z[:, None]) * pair
                    ga[i, j] = (p - ((y[:, :-1] == i) & (y[:, 1:] == j) & pair)).sum() / n + 1e-4 * a[i, j]
            gs = np.array([(post[:, 0, i] - (y[:, 0] == i)).sum() / n for i in (0, 1)])
            for i, g in enumerate((gw, gb, ga, gs)):
                acc[i] = acc[i] + g * g
            w = w - 0.5 * gw / np.sqrt(acc[0])
            b = b - 0.5 * gb / np.sqrt(acc[1])
            a = a - 0.5 * ga / np.sqrt(acc[2])
            s = s - 0.5 * gs / np.sqrt(acc[3])
        return cls(w, float(b), a, s)

    def emission(self, above: int, own: int) -> float:
        key = (above, own)
        if key not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = float(vector(above, own) @ self.weights) + self.bias
        return self.seen[key]

    def decode(self, blocks: list[tuple[str, int, int]]) -> list[bool]:
        """Viterbi: whether each block is main text."""
        if not blocks:
            return []
        (a00, a01), (a10, a11) = self.moves.tolist()
        back, zero, one = [], 0.0, 0.0
        for i, (_, above, own) in enumerate(blocks):
            e = self.emission(above, own)
            if i == 0:
                zero, one = self.first[0], self.first[1] + e
                continue
            z0, z1, o0, o1 = zero + a00, one + a10, zero + a01, one + a11
            back.append((z1 > z0, o1 > o0))
            zero, one = max(z0, z1), max(o0, o1) + e
        out = [one > zero]
        for from_zero, from_one in reversed(back):
            out.append(from_one if out[-1] else from_zero)
        return out[::-1]

    def extract(self, page: str) -> str:
        blocks = leaf_blocks(page)
        return " ".join(b[0] for b, keep in zip(blocks, self.decode(blocks), strict=True) if keep)


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Made-up pages of many layouts, with the label of each leaf block."""
    rng = random.Random(seed)
    syllables = "ka lo mi ren sta vo tur ben dal es in or ut pla gre no si fa ju wex".split()

    def words(a: int, b: int) -> str:
        out = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))
        return out[:1].upper() + out[1:]

    def prose() -> str:
        t = ". ".join(words(3, 18) for _ in range(rng.randint(1, 6))) + rng.choice([".", ".", ".", "", "!"])
        if rng.random() < 0.3:
            t = t.replace(" ", f" <a href='/x'>{words(1, 2)}</a> ", 1)
        if rng.random() < 0.3:
            t = t.replace(" ", ", ", 2)
        return rng.choice([t, t, t, t.upper(), f"<b>{t}</b>", t.replace(" ", "!! ")])

    def many(make, a: int, b: int) -> list[tuple[str, int]]:
        return [x for _ in range(rng.randint(a, b)) for x in make()]

    def block(tag: str, inner: str, label: int, attr: str = "") -> list[tuple[str, int]]:
        return [(f"<{tag}{attr}>{inner}</{tag}>", label)]

    def wrap(tag: str, parts: list[tuple[str, int]], attr: str = "") -> list[tuple[str, int]]:
        return [(f"<{tag}{attr}>", -1), *parts, (f"</{tag}>", -1)]

    def named(*names: str) -> str:
        return f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'

    def links() -> list[tuple[str, int]]:
        return wrap("ul", many(lambda: block("li", f"<a href='/p'>{words(1, 3)}</a>", 0), 2, 8))

    def junk() -> list[tuple[str, int]]:
        kind = rng.randrange(13)
        p = lambda: block("p", prose(), 0)
        if kind == 0:
            return wrap("nav", links())
        if kind == 1:
            return wrap("div", links(), named("menu", "nav-bar", "breadcrumbs", "navigation", "share-links", "pagination"))
        if kind == 2:
            return wrap("header", block("div", words(1, 4), 0, named("logo", "site-header", "masthead")) + (links() if rng.random() < 0.5 else []))
        if kind == 3:
            return wrap("aside", block("h3", words(1, 3), 0) + many(p, 0, 2))
        if kind == 4:
            return block("div", prose(), 0, named("ad", "ads", "advert", "ad-banner", "sponsored", "promo"))
        if kind == 5:
            return wrap("div", many(p, 1, 3), named("sidebar", "widget", "side-bar", "related-posts", "recommended"))
        if kind == 6:
            return block("div", "We use cookies. " + prose(), 0, named("cookie-notice", "consent", "gdpr-banner", "notice", "alert"))
        if kind == 7:
            return wrap("form", block("p", rng.choice([words(1, 4), prose()]), 0), named("search", "login-form", "newsletter", "subscribe"))
        if kind == 8:
            return wrap(rng.choice(["div", "section"]), block("h3", words(1, 2), 0) + many(p, 1, 5), named("comments", "comment-list", "disqus"))
        if kind == 9:
            return wrap("ol", many(lambda: wrap("li", many(p, 1, 2), ' class="comment"'), 1, 3), named("comments", "commentlist"))
        if kind == 10:
            return wrap("div", many(p, 1, 2), named("footer", "site-footer", "copyright", "legal"))
        if kind == 11:
            return block("p", f"&copy; 2020 {words(1, 3)}. All rights reserved", 0)
        return wrap("dialog", many(p, 1, 2), named("modal", "popup", "overlay"))

    def body() -> list[tuple[str, int]]:
        p = lambda: block("p", prose(), 1)
        out = block(rng.choice(["h1", "h1", "h2"]), words(2, 9), 1) if rng.random() < 0.8 else []
        if out and rng.random() < 0.15:
            out = wrap("header", out)
        for _ in range(rng.randint(1, 5)):
            kind = rng.randrange(10)
            if kind < 6:
                out += many(p, 1, 4)
            elif kind == 6:
                out += wrap(rng.choice(["ul", "ol"]), many(lambda: block("li", prose(), 1), 1, 4))
            elif kind == 7:
                out += wrap("blockquote", many(p, 1, 2))
            elif kind == 8:
                out += block("h2", words(1, 6), 1) + many(p, 1, 2)
            else:
                out += wrap("table", wrap("tr", many(lambda: block("td", words(1, 4), 1), 1, 4)))
        if rng.random() < 0.3:
            out += block("p", rng.choice(["All rights reserved.", "All rights reserved", f"Copyright {words(1, 3)}.", f"&copy; {words(1, 4)}", f"Subscribe to {words(2, 6)}.", f"Cookies {words(2, 6)}.", words(1, 2)]), 1)
        if rng.random() < 0.25:
            at = len(out)
            out = out[:at] + junk() + many(p, 0, 2)
        return out

    pages = []
    for _ in range(n):
        holder = rng.randrange(8)
        main = body()
        if holder < 4:
            main = wrap("article", main, rng.choice(["", named("post", "entry", "story")]))
        elif holder == 4:
            main = wrap("main", main)
        elif holder < 7:
            main = wrap("div", main, named("content", "article-body", "post-content", "entry", "story-text", "main"))
        if rng.random() < 0.1:  # a page that is nothing but text
            plain = many(lambda: block("p", prose(), 1), 1, 3)
            pages.append(("".join(x for x, _ in plain), [lab for _, lab in plain]))
            continue
        parts = many(junk, 0, 4)
        foot = wrap("footer", block(rng.choice(["p", "div"]), f"&copy; {words(1, 4)} &middot; {prose()}", 0)) if rng.random() < 0.7 else []
        whole = [*parts, *main, *many(junk, 0, 3), *foot]
        page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join(x for x, _ in whole) + "</body></html>"
        pages.append((page, [lab for _, lab in whole if lab >= 0]))
    return pages


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field fitted on the made-up pages; the same in every process."""
    data = []
    for page, labels in labelled_pages():
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            data.append((np.stack([vector(a, o) for _, a, o in blocks]), np.array(labels)))
    return Field.fit(data)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        found = [shared.value.extract(p) for p in strings(batch["html"])]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": found, "n_chars": [len(t) for t in found]}

    return map_columns(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
