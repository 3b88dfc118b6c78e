"""HTML as a sequence of text blocks with the path of containers they stand in."""

from __future__ import annotations

import re
from html import unescape

# Element kinds of the HTML standard that this reader tells apart.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: What an opening tag ends if it is open, and what that search does not leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_NUMBER = re.compile(r"\d+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _label(name: str, attributes: str) -> str:
    """An element's name with its class, id and role; digits are one sign, so that ids do not tell pages apart."""
    if not attributes or attributes.isspace():
        return name
    words = []
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            words += value.replace("/", "-").split()
        elif key == "role":
            words.append(f"role-{value}")
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            words.append("hidden")
    return ".".join([name, *sorted(set(_NUMBER.sub("0", w) for w in words))])


def blocks(html: str | None, skip: frozenset[str] = frozenset()) -> tuple[list[tuple[str, str]], list[str]]:
    """Text blocks as (path, text), and the paths of all containers in the order in which they open.

    Inline elements are no containers, but text in one that is hidden, or that its class names an advert
    (``skip``), is left out. Character references are decoded piece by piece, so markup within one leaves
    it as it stands. Comments, declarations and raw text elements give no text. A
    start tag ends open elements as the standard has it; an end tag without its start is ignored;
    what is open at the end ends there. White space within a block is one space.
    """
    if not html:
        return [], []
    found: list[tuple[str, str]] = []
    opened: list[str] = []
    stack: list[tuple[str, str]] = [("", "")]  # name, path
    parts: list[str] = []
    at, size = 0, len(html)

    inline: list[str] = []  # open inline elements from one on whose text is left out

    def take(text: str) -> None:
        if not inline:
            parts.append(unescape(text))

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((stack[-1][1], text))
            parts.clear()

    def close(names: set[str] | frozenset[str], within: set[str] | frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in within:
                return
            if stack[k][0] in names:
                del stack[k:]
                return

    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            take(html[at:])
            break
        if m.start() > at:
            take(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                if name in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(name) :]
                continue
            inline.clear()
            flush()
            close({name})
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name not in VOID and (inline or skip.intersection(_label(name, m[3]).split(".")[1:])):
                inline.append(name)
            continue
        if name in RAW:
            end = _END[name].search(html, at)
            at = size if end is None else end.start()
            continue
        inline.clear()
        flush()
        if name in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "li", "dd", "div", "article", "section"})
        if name in ENDS:
            close(*ENDS[name])
        if name == "hr" or name in VOID:
            continue
        path = f"{stack[-1][1]}/{_label(name, m[3])}"
        stack.append((name, path))
        opened.append(path)
    flush()
    return found, opened
