"""A tolerant reader of HTML: elements by their path, and the text blocks below one of them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import xxhash

#: Elements whose content is not markup.
RAW = "script|style|textarea|iframe|noembed|noframes|xmp"
#: Each branch that has begun ends at its sign or at the page's end, and a quote that nothing closes is a character, so no part is read twice.
PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)[^>]*(?:>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![^\s=/\"'])([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that break a line of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that an opening one of these ends, up to the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that are never main text, wherever they stand.
ASIDE = frozenset("head nav aside footer noscript template svg math button select object canvas audio video map dialog menu".split())
#: Words of class, id and role that name what is not main text, unless it turns out to hold the page (see events).
HINTS = frozenset("ad ads adv advert advertisement adverts alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies search share sharing sidebar sponsor sponsored subscribe subscription toolbar widget".split())
NAMES = re.compile(r"[a-z0-9]+")


def named(attributes: str) -> tuple[str, bool, bool]:
    """The class of an element, whether its names say that it is not main text, and whether its role says that it is."""
    if "=" not in attributes:
        return "", False, False
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    return " ".join(sorted(found.get("class", "").split())), not HINTS.isdisjoint(NAMES.findall(names)), found.get("role", "").lower() == "main"


#: The path of a page's root.
ROOT = 0


def signed(h: int) -> int:
    """An unsigned 64-bit number as a long."""
    return h - (1 << 64) if h >> 63 else h


class Element:
    """An element: its path (a hash of its names and its parent's path), whether it or one above it is aside from main text, and its text so far."""

    __slots__ = ("above", "aside", "chars", "depth", "doubted", "hard", "headed", "hinted", "inside", "linked", "main", "name", "path", "place", "plain", "shaded")

    def __init__(self, name: str, kind: str, above: "Element | None", hinted: bool, main: bool, place: int):
        self.name, self.above, self.hinted, self.main, self.place = name, above, hinted, main, place
        self.path = ROOT if above is None else signed(xxhash.xxh64_intdigest(f"{name}.{kind}", above.path & 0xFFFFFFFFFFFFFFFF))
        self.depth = 0 if above is None else above.depth + 1
        self.aside = self.doubted = self.headed = False
        self.hard = name in ASIDE or (above is not None and above.hard)
        self.linked = name == "a" or (above is not None and above.linked)
        self.inside = name in ("article", "main") or (above is not None and above.inside)
        self.shaded = self.hard or (above is not None and above.shaded)  # here or above, hard or doubted
        self.chars = 0  # characters below that are main text and not of links
        self.plain = 0  # characters below that are neither of links nor in ASIDE


def events(html: str) -> list[tuple[str, Element, str]]:
    """("open", element, ""), ("text", innermost element, text), ("break", element, name) and ("close", element, "") in page order.

    What is aside is decided when the page is read. Names, <form> and <header> only raise a doubt, and the element stays
    if it holds the page: its main element, its article if no other stands free (one with an h1, or with more text than
    stands free), or, where no article or main stands free, most of the text outside of links; a <header> also stays with an
    h1 that is not a link.
    """
    found = list(_read(html))
    free = 0
    for kind, e, text in found:
        if kind == "text":
            if not e.hard and not e.linked and (n := sum(map(len, text.split()))):
                e.plain += n
                free += 0 if e.shaded else n
        elif kind == "close" and e.above is not None and not e.hard:
            e.above.plain += e.plain
            e.above.headed |= e.headed or (e.name == "h1" and e.plain > 0)
    opened = [e for kind, e, _ in found if kind == "open"]
    held: set[int] = set()
    if any(e.doubted for e in opened):
        own = [e for e in opened if e.main and e.name != "article" and not e.hard]
        articles = [e for e in opened if e.name == "article" and e.plain and not e.hard and not e.hinted]
        if articles and all(e.shaded for e in articles):
            largest = max(articles, key=lambda e: (e.headed, e.plain))
            own += [largest] if largest.headed or largest.plain > free else []
        for e in own:
            while e is not None and e.place not in held:
                held.add(e.place)
                e = e.above
    whole = found[-1][1].plain  # of the root, which closes last
    free_main = any(e.main and e.plain and not e.shaded for e in opened)
    for e in opened:
        stays = not e.doubted or e.place in held or (2 * e.plain > whole and not free_main) or (e.name == "header" and not e.hinted and e.headed)
        e.aside = e.hard or e.above.aside or not stays
    return found


def _read(html: str) -> Iterator[tuple[str, Element, str]]:
    """The events of a page, before it is known what is aside."""
    stack: list[Element] = [Element("", "", None, False, False, 0)]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each name, where it is open in the stack
    place = 0

    def close(down_to: int) -> Iterator[tuple[str, Element, str]]:
        while len(stack) > down_to:
            e = stack.pop()
            if stack:
                places[e.name].pop()
            yield "close", e, ""

    def nearest(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    for m in PIECE.finditer(html):
        if text := m["text"]:
            yield "text", stack[-1], text
        elif tag := m["tag"]:
            tag = tag.lower()
            if tag in VOID:
                yield "break", stack[-1], tag
                continue
            if tag in BLOCKS and places["p"]:  # an open paragraph ends, with what is open inside it
                yield from close(places["p"][-1])
            if tag in ENDS:
                ended, bounds = ENDS[tag]
                if (k := nearest(ended)) > nearest(bounds):
                    yield from close(k)
            kind, hinted, main = named(m["attributes"])
            place += 1
            element = Element(tag, kind, stack[-1], hinted, tag in ("article", "main") or main, place)
            if tag not in ("html", "body", "article", "main"):  # a page's own frame stays, whatever it is called
                element.doubted = hinted or tag == "form" or (tag == "header" and not stack[-1].inside)
                element.shaded |= element.doubted
            places[tag].append(len(stack))
            stack.append(element)
            yield "open", element, ""
            if m["attributes"].endswith("/") and tag in ("svg", "math"):
                yield from close(len(stack) - 1)
        elif (end := m["end"]) and places[end := end.lower()]:
            yield from close(places[end][-1])
    yield from close(0)


def blocks(page: list[tuple[str, Element, str]], wanted: set[int] | None = None) -> Iterator[tuple[Element, str]]:
    """Text blocks of a page's events that are not aside, in page order, each with the element it begins in; of wanted paths only (None: all)."""
    parts: list[str] = []
    first: Element | None = None
    depth = 1 if wanted is None else 0
    for kind, element, text in page:
        if kind == "text":
            if depth and not element.aside:
                if first is None and not text.isspace():
                    first = element
                parts.append(text)
            continue
        if kind == "break":
            if text == "br":
                parts.append(" ")
            ends = text == "hr"
        else:
            ends = element.name in BLOCKS or element.aside
        if ends and parts:
            if joined := " ".join(unescape("".join(parts)).split()):
                yield first, joined
            parts.clear()
            first = None
        if kind != "break" and wanted is not None and element.path in wanted and not element.aside:
            depth += 1 if kind == "open" else -1
    if joined := " ".join(unescape("".join(parts)).split()):
        yield first, joined


def block_token(element: Element, text: str) -> int:
    """A block's token: its words where they stand."""
    return signed(xxhash.xxh64_intdigest(text, element.path & 0xFFFFFFFFFFFFFFFF))
