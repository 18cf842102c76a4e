"""Splitting a page into leaf blocks, each with the path of elements around it."""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from dataclasses import dataclass

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LABEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements that break a line of text; all others are part of a line.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea title audio video noframes".split())
#: An opening tag that ends an open element of these kinds, unless one of the stops lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Where a silent element of the head ends at the latest. A script or style may name these tags.
PAST_HEAD = r"(?=</head\s*>|<body\b)"
#: Elements from the outermost that a block's path names; deeper ones are open, too, but not named.
DEEPEST = 256


@dataclass(frozen=True)
class Block:
    """A leaf block; ``article`` is the number of the outermost open ``article`` on the page, 0 outside."""

    path: tuple[str, ...]
    text: str
    link_share: float
    article: int = 0


def labels(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role: ``div.site.menu``."""
    if not attributes:
        return tag
    words = [w.lower() for m in NAMED.finditer(attributes) for w in LABEL.findall(html.unescape(m[1]))]
    return ".".join([tag, *dict.fromkeys(words)]) if words else tag


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, their text decoded and white space made single.

    Null and empty pages have none. Broken markup is read as far as it goes:
    missing ends are implied, stray ends ignored, comments and scripts that
    never end hide the rest. ``head`` ends at whatever cannot belong to it, so
    its tags may be left out; what is silent in it is skipped by itself.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[str] = []
    path: list[str] = []
    # places of the open elements of each name in the stack, so that no tag searches a deep stack
    places: defaultdict[str, list[int]] = defaultdict(list)
    held: list[str] = []
    linked, in_link, at, articles = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(tuple(path), text, min(1.0, linked / len(text)), articles if places["article"] else 0))
            held.clear()
        linked = 0

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()].pop()
        del path[k:]

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            # each run of text by itself: a reference does not go on behind a tag
            shown = html.unescape(raw) if "&" in raw else raw
            held.append(shown)
            if in_link:
                linked += len(shown.strip())

    while True:
        found = TOKEN.search(page, at)
        take(page[at:found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        closing = bool(found[1] or found[4])
        attributes = found[3] or found[6] or ""
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                own = rf"</{tag}\s*>" + (f"|{PAST_HEAD}" if tag in ("title", "noscript") else "")
                end = re.compile(own, re.I).search(page, at) or re.compile(PAST_HEAD, re.I).search(page, at)
                at = end.end() if end else len(page)
            held.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCK:
            flush()
            if closing:
                if places[tag]:
                    cut(places[tag][-1])
            else:
                if stack and stack[-1] == "p":
                    cut(len(stack) - 1)
                ended, stops = ENDS.get(tag, ((), ()))
                stop = max((places[t][-1] for t in stops if places[t]), default=-1)
                cut(min((places[t][k] for t in ended if (k := bisect(places[t], stop)) < len(places[t])), default=len(stack)))
                if tag != "hr" and not attributes.endswith("/"):
                    articles += tag == "article" and not places["article"]
                    if len(stack) < DEEPEST:
                        path.append(labels(tag, attributes))
                    places[tag].append(len(stack))
                    stack.append(tag)
    flush()
    return out
