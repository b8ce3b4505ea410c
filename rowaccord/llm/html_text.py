"""Main text of web pages by union-free wrapper inference.

Pages of one host come from one template. A page is a stream of tags and texts; repeated neighbouring groups are
folded into one repeated group, and the folded streams of a group of pages of a host are aligned one after the other. Where
they agree stays as it is, texts that differ become slots, and what only some of them have becomes optional: the result
is a regular expression without unions, the wrapper. Texts that are equal in all aligned pages belong to the template;
the smallest container that holds all slots of running text, which are not links, is the content. Template texts are left
out outside it, and in it where they fill a whole container, such as a menu or a notice. Near copies among the pages are
left out before, since what they share is not the template's.

The wrapper chooses the content of every page. ``article`` and ``main`` are a hint beside it: where most of the slots'
text lies in them, the content is theirs, and one that a page has outside the content is taken too. They decide alone
only for a page without a wrapper. In the content, elements that are no running text by their meaning (menus, forms,
adverts, comments and so on) are left out, and nothing else is.

All pages of a host are dealt to such groups, each of them gives a wrapper, and the host's is what most pages vote for:
no page is left out, and no group grows with the host. All pages are extracted, each by itself.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, settled

#: Pages of a host that are aligned with each other, on average: their hash deals them to groups.
GROUP = 6
#: Aligned pages whose runs of so many words are equal to this share are near copies.
RUN, NEAR = 5, 0.8
#: Pages that must agree before a container with equal texts is left out of the content.
ENOUGH = 3
#: All wrappers together are sent to each task up to this size; beyond it they are joined by host.
SENT_BYTES = 16 << 20

# Elements and words of the HTML standard and of common page templates.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
NO_TEXT = RAW | {
    "head", "title", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "audio", "video",
}
NO_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
NO_TEXT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer",
    "comment", "comments", "disqus", "share", "social", "newsletter", "subscribe", "popup", "modal", "related", "masthead",
}
#: What readers wrote is hidden however much it is.
READERS = {"comment", "comments", "disqus"}
#: Words that hide inline elements too; the others may name a part of a sentence there.
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo"}
#: Beside these words in one class name the others say how a page is laid out or filed, not what the element is.
LAYOUT = {"no", "non", "not", "has", "with", "without", "free", "category", "tag"}
#: Class names or ids of the content: beside them only whole names hide.
CONTENT = {"content", "main", "article", "story", "post", "entry"}
#: Elements that mark the content by their meaning; the outermost one counts, with all that lies in it.
HINTS = {"article", "main"}
#: Never hidden by the words of their class or id: these often name the page's layout or the post's kind.
NEVER_HIDDEN = {"html", "body"} | HINTS
CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Blocks of a text: neighbours of the same kind share one path, so none of them stands for the content.
BLOCKS = {
    "address", "blockquote", "caption", "dd", "details", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "hgroup", "li", "ol", "p", "pre", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that part a page; lists are menus where they hold links.
CONTAINERS = {"div", "section", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

OPEN, CLOSE, TEXT = 0, 1, 2
Event = tuple[int, str, str]  # kind, symbol or text, element name


def _words(named: list[str]) -> set[str]:
    """The hiding words among class names and ids: whole ones, and parts between hyphens and underscores."""
    whole = NO_TEXT_WORDS.intersection(named)
    if whole or not CONTENT.isdisjoint(named):
        return whole
    parts = [re.split("[-_]+", n) for n in named]
    parts = [[*p, "".join(p)] for p in parts if LAYOUT.isdisjoint(p)]
    return {w for p in parts for w in p if w in NO_TEXT_WORDS}


def _symbol(name: str, attributes: str) -> tuple[str, str]:
    """See ``_labelled``; short attributes repeat from page to page."""
    return _repeated(name, attributes) if len(attributes) <= 200 else _labelled(name, attributes)


def _labelled(name: str, attributes: str) -> tuple[str, str]:
    """Name with its first class or id, and a mark.

    ``!`` for no running text by its attributes, ``=`` for what readers wrote by a class name, ``?`` for others by one.
    """
    if not attributes.strip(" /"):
        return name, ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    label = (found.get("class") or found.get("id") or "").split()
    words = _words(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
    hidden = found.get("role", "").lower() in NO_TEXT_ROLES or "hidden" in re.split(r"\s+", _ATTRIBUTE.sub("", attributes).lower().strip(" /"))
    # A page's own number or the like in the label of its article keeps no pages apart.
    symbol = f"{name}.{re.sub('[0-9]+', '0', label[0])}" if label and name not in HINTS else name
    if hidden:
        return symbol, "!"
    if name == "article" and not READERS.isdisjoint(label):
        return symbol, "="
    if name in INLINE:
        words &= ADVERTS
    elif name in BLOCKS:
        words = words - {"related"}
    return symbol, "" if name in NEVER_HIDDEN or not words else "=" if words & READERS else "?"


_repeated = functools.lru_cache(maxsize=4096)(_labelled)


def events(page: str) -> list[Event]:
    """The page as a well-formed stream, see ``_marked``.

    An element that a class name hides holds no more than half of the text, and of the text in ``article`` and ``main``;
    what readers wrote is hidden unless it is all there is.
    """
    found = list(_marked(page))
    begun: list[tuple[int, int, int]] = []  # the index of each open element, and the texts before it
    spans: list[tuple[int, int, int, int]] = []  # begin, end and texts of elements that a class name hides
    total = hinted = hidden = hints = 0
    for i, (kind, value, name) in enumerate(found):
        if kind == TEXT:
            held = 0 if hidden else len(value.strip())
            total += held
            hinted += held if hints else 0
        elif kind == OPEN:
            begun.append((i, total, hinted))
            hidden += value[0] == "!"
            hints += value in HINTS
        else:
            hidden -= value[0] == "!"
            hints -= value in HINTS
            start, before, hinted_before = begun.pop()
            if value[0] in "?=":
                spans.append((start, i, total - before, hinted - hinted_before))
    readers = sum(held for start, _, held, _ in spans if found[start][1][0] == "=")
    for start, end, held, in_hints in spans:
        for i in (start, end):
            kind, value, name = found[i]
            shown = held == total if value[0] == "=" else 2 * held > total - readers or 2 * in_hints > hinted
            found[i] = kind, value[1:] if shown else f"!{value[1:]}", name
    return found


def _marked(page: str) -> Iterator[Event]:
    """The page as a well-formed stream: implied ends are added, ends without a beginning are dropped.

    Inline elements vanish, hidden ones with their text, ``br`` and the like become white space. Elements that are no
    running text have the symbol prefix ``!``, those that only a class name says this of ``?`` or ``=``. Text in links is
    marked by the name ``a``.
    """
    stack: list[tuple[str, str]] = []
    at, size = 0, len(page)
    muted: list[str] = []  # a hidden inline element, and those of its name in it
    block, link = 0, ""  # number of open elements around the hidden one, and whether a link is open

    def close(upto: int) -> Iterator[Event]:
        while len(stack) > upto:
            name, symbol = stack.pop()
            yield CLOSE, symbol, name

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at and not muted:
            yield TEXT, page[at : m.start()], link
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if muted:
                if name == muted[0]:
                    muted = muted[1:] if m[1] else [*muted, name]
            elif not m[1] and _symbol(name, m[3])[1]:
                muted, block = [name], len(stack)
            if name == "a":
                link = "" if m[1] or not re.search(r"\bhref\b", m[3], re.I) else "a"
            continue
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None:
                yield from close(k)
                if len(stack) < block:
                    muted = []
            continue
        if name in VOID:
            yield TEXT, " ", link
            continue
        ends = {"p"} if name in CLOSES_P else SELF_CLOSING.get(name, ())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                yield from close(i)
                if len(stack) < block:
                    muted = []
                break
            if stack[i][0] not in ("p", *SELF_CLOSING):
                break
        symbol, mark = _symbol(name, m[3])
        symbol = f"{'!' if name in NO_TEXT else mark}{symbol}"
        yield OPEN, symbol, name
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            yield CLOSE, symbol, name
        elif m[3].endswith("/") and name in ("svg", "path"):
            yield CLOSE, symbol, name
        else:
            stack.append((name, symbol))
    if at < size and not muted and (rest := re.sub(r"<[a-zA-Z/!][^>]*\Z", "", page[at:])):
        yield TEXT, rest, link
    yield from close(0)


def clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


# ---- wrappers --------------------------------------------------------------------------

# A stream's item: (symbol, text). Tags are "<p" and "</p", texts are "#" and those of links "#a", repeated groups
# "(<p # </p)+", their texts joined by ``JOIN``.
Item = tuple[str, str]
JOIN = "\x1f"


def stream(page: str) -> list[Item]:
    out: list[Item] = []
    text: list[str] = []
    linked: list[str] = []
    hidden = 0

    def flush() -> None:
        if not text:
            return
        if found := clean("".join(text)):
            out.append(("#a" if linked and 2 * len(clean("".join(linked))) > len(found) else "#", found))
        text.clear()
        linked.clear()

    for kind, value, name in events(page):
        if kind == TEXT:
            if not hidden:
                text.append(value)
                if name == "a":
                    linked.append(value)
            continue
        if value[0] == "!":
            hidden += 1 if kind == OPEN else -1
            continue
        if not hidden:
            flush()
            out.append((("<" if kind == OPEN else "</") + value, ""))
    flush()
    return fold(out)


def fold(items: list[Item], longest: int = 12) -> list[Item]:
    """Replace neighbouring groups with equal symbols by one repeated group, short groups first."""
    for size in range(1, longest + 1):
        out: list[Item] = []
        symbols = [s for s, _ in items]
        i = 0
        while i < len(items):
            group = symbols[i : i + size]
            n = 1
            if i + size < len(items) and symbols[i] == symbols[i + size]:
                while symbols[i + n * size : i + (n + 1) * size] == group:
                    n += 1
            if n > 1 and _balanced(group):
                texts = JOIN.join(t for _, t in items[i : i + n * size] if t)
                out.append((f"({' '.join(group)})+", texts))
                i += n * size
            elif out and out[-1][0][0] == "(" and len(group) == size and out[-1][0] == f"({' '.join(group)})+":
                out[-1] = (out[-1][0], JOIN.join([out[-1][1], *(t for _, t in items[i : i + size] if t)]))
                i += size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _balanced(group: list[str]) -> bool:
    depth = 0
    for s in group:
        depth += s.startswith("<") - 2 * s.startswith("</")
        if depth < 0:
            return False
    return depth == 0


class Part:
    """One item of a wrapper: its texts in the pages so far, and in how many pages it was."""

    __slots__ = ("pages", "symbol", "texts")

    def __init__(self, symbol: str, texts: list[str], pages: int):
        self.symbol, self.texts, self.pages = symbol, texts, pages


def align(wrapper: list[Part], items: list[Item]) -> list[Part]:
    """Merge a stream into a wrapper along a longest common subsequence of their symbols."""
    out: list[Part] = []
    i = k = 0
    for x, y in [*common([p.symbol for p in wrapper], [s for s, _ in items]), (len(wrapper), len(items))]:
        out += wrapper[i:x]
        out += [Part(symbol, [text], 1) for symbol, text in items[k:y]]
        if x < len(wrapper):
            out.append(Part(wrapper[x].symbol, [*wrapper[x].texts, items[y][1]], wrapper[x].pages + 1))
        i, k = x + 1, y + 1
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, in linear memory: halves of ``a`` meet where their lengths add up to most."""
    out: list[tuple[int, int]] = []
    ends: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, n, k, m = work.pop()
        while i < n and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < n and k < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            ends.append((n, m))
        if i == n or k == m:
            continue
        if n - i == 1:
            if (at := next((y for y in range(k, m) if b[y] == a[i]), None)) is not None:
                out.append((i, at))
            continue
        half = (i + n) // 2
        before = prefix_lengths(a[i:half], b[k:m])
        after = prefix_lengths(a[half:n][::-1], b[k:m][::-1])[::-1]
        cut = k + int((before + after).argmax())
        work += [(half, n, cut, m), (i, half, k, cut)]
    return sorted(out + ends)


def prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``; a number's bits stand for ``b``'s items."""
    places: dict[str, int] = {}
    for symbol in set(a).intersection(b):
        mask = np.fromiter((x == symbol for x in b), dtype=bool, count=len(b))
        places[symbol] = int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")
    every = (1 << len(b)) - 1
    row = every
    for symbol in a:
        if mask := places.get(symbol, 0):
            same = row & mask
            row = ((row + same) | (row - same)) & every
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def unlike(streams: list[list[Item]]) -> list[list[Item]]:
    """The streams without near copies of earlier ones, by the shares of their word runs."""
    kept: list[list[Item]] = []
    known: list[tuple[Counter[tuple[str, ...]], int]] = []
    for items in streams:
        words = [w for _, t in items for w in t.split()]
        runs = Counter(zip(*(words[i:] for i in range(RUN))) if len(words) >= RUN else [tuple(words)])
        n = max(1, len(words) - RUN + 1)
        if not any(_alike(runs, n, *other) for other in known):
            kept.append(items)
            known.append((runs, n))
    return kept


def _alike(a: Counter, n: int, b: Counter, m: int) -> bool:
    """Whether two multisets of ``n`` and ``m`` members share ``NEAR`` of their union; sizes far apart decide at once."""
    if min(n, m) < NEAR * max(n, m):
        return False
    both = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
    return both >= NEAR * (n + m - both)


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages: its expression, the symbol path of the content, and the template's texts.

    ``pages`` is the number of pages that are no near copies. ``tagged`` says that the content lies in the ``article`` and ``main`` elements; where these have no path in common,
    ``root`` is empty. Of a single page nothing is known to differ, so there they count however little they hold.
    """
    different = list(dict.fromkeys(pages))
    if not different:
        return {"expression": "", "root": [], "template": [], "tagged": True, "pages": 0}
    streams = unlike([stream(p) for p in different])
    first, *others = streams
    wrapper = [Part(s, [t], 1) for s, t in first]
    for items in others:
        wrapper = align(wrapper, items)
    n = len(streams)
    words, template, path, slots = [], [], [], []
    for p in wrapper:
        constant = n > 1 and p.pages == n and len(set(p.texts)) == 1
        holds = "#" in p.symbol
        plain = p.symbol in ("#", "#a")
        shown = p.symbol.replace("#a", "#")
        words.append(f"({shown})?" if p.pages < n else "#PCDATA" if plain and not constant else p.texts[0] if plain else shown)
        if p.symbol.startswith("</"):
            if path:
                path.pop()
        elif p.symbol.startswith("<"):
            path.append(p.symbol[1:])
        elif holds and constant:
            template += p.texts[0].split(JOIN)
        elif holds:
            # A repeated group of whole articles is folded: its elements follow the path.
            group = [] if plain else [x[1:] for x in p.symbol.strip("(")[:-2].split() if x[:1] == "<" and x[1:2] != "/"]
            within = path + (group[:1] if group[:1] and group[0] in HINTS else [])
            # A text that is equal in all pages that have it is no sign of the content. The page's own header is no running text.
            same = p.pages > 1 and len(set(p.texts)) == 1
            if not same and not (HINTS.isdisjoint(within) and any(x.split(".")[0] == "header" for x in within)):
                slots.append((within, sum(map(len, p.texts)), "#" in re.split("[ ()+]+", p.symbol)))
    # Texts of links lead away from the content; only where there is nothing else are they it.
    slots = [(at, w) for at, w, running in slots if running] or [(at, w) for at, w, _ in slots]
    hinted = [(at, w) for at, w in slots if not HINTS.isdisjoint(at)]
    tagged = bool(hinted) and (n == 1 or 2 * sum(w for _, w in hinted) > sum(w for _, w in slots))
    root = content_root([_upto_hint(at) if tagged else at for at, _ in (hinted if tagged else slots)])
    if tagged and HINTS.isdisjoint(root):
        root = []
    return {"expression": " ".join(words), "root": _upto_hint(root), "template": template, "tagged": tagged, "pages": n}


def _upto_hint(path: list[str]) -> list[str]:
    """A path as far as its outermost ``article`` or ``main``, which is taken whole."""
    return path[: next((i + 1 for i, x in enumerate(path) if x in HINTS), len(path))]


def content_root(paths: list[list[str]]) -> list[str]:
    """The path of the smallest container that holds all of them, never of a block such as a paragraph or a list."""
    root: list[str] = []
    for level in zip(*paths):
        if len(set(level)) > 1 or level[0].split(".")[0] in BLOCKS:
            break
        root.append(level[0])
    return root


# ---- extraction ------------------------------------------------------------------------


def extract(page: str | None, wrapper: dict | None = None) -> str:
    """The main text of one page: blocks in page order, parted by an empty line."""
    if not page:
        return ""
    found = events(page)
    wrapper = wrapper or {"root": [], "template": [], "tagged": True, "pages": 0}
    root, template = wrapper["root"], set(wrapper["template"])
    if template and wrapper["pages"] >= ENOUGH:
        found = _without_fixed(found, template)
    # Without a path, a content that does not lie in tags is the whole page.
    texts = _blocks(found, root, template) if root or wrapper["tagged"] else []
    return "\n\n".join(texts or _blocks(found, None, template) or _blocks(found, None, set()))


def _without_fixed(found: list[Event], template: set[str]) -> list[Event]:
    """The events with containers hidden that hold template texts only, lists if these are links.

    A container of one heading stays: articles of a host may share headings.
    """
    out = list(found)
    begun: list[list] = []  # index, blocks, whether all are the template's, length of all texts and of links, whether one is no heading
    text: list[str] = []
    linked = hidden = 0

    def flush() -> None:
        nonlocal linked
        if (block := clean("".join(text))) and begun:
            heading = found[begun[-1][0]][2] in HEADINGS
            begun[-1] = _added(begun[-1], [0, 1, block in template, len(block), linked, not heading])
        text.clear()
        linked = 0

    for i, (kind, value, name) in enumerate(found):
        if kind == TEXT:
            if not hidden:
                text.append(value)
                linked += len(value.strip()) if name == "a" else 0
            continue
        flush()
        hidden += (value[0] == "!") * (1 if kind == OPEN else -1)
        if kind == OPEN:
            begun.append([i, 0, True, 0, 0, False])
            continue
        own = begun.pop()
        fixed = own[1] and own[2] and own[5] and (name in CONTAINERS or name in ("ul", "ol") and 2 * own[4] > own[3])
        if fixed and value[0] != "!":
            for k in (own[0], i):
                out[k] = found[k][0], f"!{value}", name
        if begun:
            begun[-1] = _added(begun[-1], own)
    return out


def _added(a: list, b: list) -> list:
    return [a[0], a[1] + b[1], a[2] and b[2], a[3] + b[3], a[4] + b[4], a[5] or b[5]]


def _blocks(found: list[Event], root: list[str] | None, template: set[str]) -> list[str]:
    """The blocks in the elements at ``root``, and in ``article`` and ``main`` elements outside them less the template.

    All of a page that is no template where ``root`` is None.
    """
    out: list[str] = []
    text: list[str] = []
    path: list[str] = []
    begun: tuple[int, bool] | None = None  # depth of the element that began the content, and whether it is at the root
    headers: list[int] = []  # depths of the page's own headers
    hidden = 0

    def flush() -> None:
        if (block := clean("".join(text))) and (begun is not None and begun[1] or block not in template):
            out.append(block)
        text.clear()

    for kind, value, name in found:
        if kind == TEXT:
            if not hidden and not headers and (begun is not None or root is None):
                text.append(value)
            continue
        flush()
        if kind == OPEN:
            hidden += value[0] == "!"
            path.append(value)
            if not hidden and begun is None and root is not None and (path == root or name in HINTS):
                begun = (len(path), path == root or not root)
                headers.clear()
            # The header of a page is no running text; an article's own header holds its title.
            own = begun is None or HINTS.isdisjoint(path) and path[begun[0] - 1] in ("html", "body")
            if name == "header" and own:
                headers.append(len(path))
        else:
            if begun is not None and begun[0] == len(path):
                begun = None
            if headers and headers[-1] == len(path):
                headers.pop()
            hidden -= value[0] == "!"
            path.pop()
    flush()
    return out


# ---- Spark -----------------------------------------------------------------------------


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]*:?//([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """One row (host, wrapper as JSON) per host with at least one page, from all its different pages.

    A page's hash deals it to a group of about ``group`` pages of its host, and each group gives a wrapper. The content is
    where the groups of most pages have it, ties by text; a text is the template's if it is that of groups with more
    than half of the pages. ``pages`` counts those that agree on each such text. Near copies within a group count as one page.
    """
    rows = pages.select("host", "html", F.xxhash64("html").alias("h")).where("html is not null and html <> ''")
    # Hosts of a single group need no entry.
    many = rows.groupBy("host").agg(F.countDistinct("h").alias("n")).where(F.col("n") > group)
    many = settled(many.select("host", F.ceil(F.col("n") / group).alias("groups")), "html-hosts")
    # Pages are shuffled once, by host and group: a join by host would leave all pages of a host in one task.
    if (many.agg(F.sum(F.length("host"))).first()[0] or 0) <= SENT_BYTES:
        many = F.broadcast(many)
    dealt = rows.join(many, "host", "left").withColumn("dealt", F.expr("coalesce(pmod(h, groups), 0)"))
    # Copies of a page meet before the shuffle already.
    groups = dealt.groupBy("host", "dealt").agg(F.array_sort(F.collect_set(F.struct("h", "html")))["html"].alias("html"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = [infer(x) for x in batch["html"]]
        content = [json.dumps({"root": w["root"], "tagged": w["tagged"]}) for w in found]
        return {"host": batch["host"], "content": content, "template": [w["template"] for w in found], "n": [w["pages"] for w in found]}

    votes = by_batch(groups.select("host", "html"), run, "host string, content string, template array<string>, n bigint")
    votes = settled(votes, "html-groups")
    per_content = votes.groupBy("host", "content").agg(F.sum("n").alias("n"))
    best = per_content.groupBy("host").agg(F.max(F.struct("n", "content"))["content"].alias("content"), F.sum("n").alias("every"))
    texts = votes.select("host", "n", F.explode(F.array_distinct("template")).alias("text"))
    texts = texts.groupBy("host", "text").agg(F.sum("n").alias("n")).join(best.select("host", "every"), "host").where("2 * n > every")
    kept = texts.groupBy("host").agg(F.array_sort(F.collect_list("text")).alias("template"), F.min("n").alias("agree"))
    content = F.from_json("content", "root array<string>, tagged boolean")
    wrapper = F.struct(
        content["root"].alias("root"),
        F.coalesce("template", F.array().cast("array<string>")).alias("template"),
        content["tagged"].alias("tagged"),
        F.coalesce("agree", "every").alias("pages"),
    )
    return best.join(kept, "host", "left").select("host", F.to_json(wrapper).alias("wrapper"))


@functools.lru_cache(maxsize=4096)
def _parsed(wrapper: str) -> dict:
    return json.loads(wrapper)


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP
) -> DataFrame:
    """One row (id, url, text, n_chars) per page, from its whole HTML.

    Null and empty pages have the text "". A null url belongs to the host "". Repeated rows give repeated results,
    null ids are kept, other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(
        pages[id_col].alias("id"),
        pages[url_col].cast("string").alias("url"),
        host_of(pages[url_col].cast("string")).alias("host"),
        pages[html_col].cast("string").alias("html"),
    )
    known = settled(wrappers(rows, group), "html-wrappers")
    size = known.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    if size <= SENT_BYTES:
        sent = {r["host"]: r["wrapper"] for r in known.collect()}
    else:
        sent, rows = None, rows.join(known, "host", "left")

    def run(batch: dict[str, list]) -> dict[str, list]:
        own = batch["wrapper"] if sent is None else [sent.get(h) for h in batch["host"]]
        texts = [extract(p, _parsed(w) if w else None) for p, w in zip(batch["html"], own, strict=True)]
        return {"id": batch["id"], "url": batch["url"], "text": texts, "n": [len(t) for t in texts]}

    kind = rows.schema["id"].dataType.simpleString()
    out = by_batch(rows, run, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
