"""Leaf blocks of a web page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Element classes of the HTML standard.
SECTIONING = frozenset("article aside dialog footer form header main nav".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style title textarea iframe".split())
FOREIGN = ("svg", "math")  # in these, a start tag ending in "/>" is an empty element
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul xmp".split()
)
#: a start tag ends open elements of the first set, unless one of the second stands between
ENDS_OPEN = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = BLOCK - frozenset("body button caption head html legend optgroup option tbody td tfoot th thead tr".split())
PARAGRAPH_SCOPE = frozenset("button caption object table td th".split())

_TOKENS = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment may end at once, as in <!-->, or with --!>
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in (*RAW_TEXT, "xmp")}


@dataclass
class Block:
    text: str  # white space as one space, references decoded
    leaf: str  # innermost block-level element
    marks: frozenset[str]  # ancestors' tags, "#"-words of their class, id and role
    inner: frozenset[str]  # those of the innermost ancestor that sections or has such words
    linked: int  # characters inside links


def _marks(name: str, attributes: str) -> set[str]:
    marks = {name}
    if attributes:
        for match in _ATTRIBUTE.finditer(attributes):
            value = match[2] or match[3] or match[4]
            if match[1].lower() == "hidden":
                marks.add("#hidden")
            elif value:
                marks.update("#" + w.lower() for w in _WORD.findall(value))
    return marks


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. Scripts, styles, comments, titles, form fields and frames are no blocks.

    All other elements are read by their tags, also svg, math, noscript and template; the content of xmp is text as it stands.
    """
    blocks: list[Block] = []
    # (tag, marks of it and its ancestors, innermost block-level element, marks of the innermost section)
    stack: list[tuple[str, frozenset[str], str, frozenset[str]]] = [("", frozenset(), "", frozenset())]
    open_tags: Counter = Counter()
    pieces: list[str] = []
    linked = 0
    where: tuple[str, frozenset[str], str, frozenset[str]] | None = None

    def flush() -> None:
        nonlocal pieces, linked, where
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and where is not None:
                blocks.append(Block(text, where[2], where[1], where[3], linked))
            pieces, linked, where = [], 0, None

    def pop_to(depth: int) -> None:
        for name, *_ in stack[depth:]:
            open_tags[name] -= 1
        del stack[depth:]

    def end_open(names: set[str], scope) -> None:
        if any(open_tags[n] for n in names):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in names:
                    pop_to(depth)
                    return
                if stack[depth][0] in scope:
                    return

    at, size = 0, len(page)
    while at < size:
        token = _TOKENS.match(page, at)
        at = token.end()
        text = token["text"]
        if text is not None:
            if where is None and not text.isspace():
                where = stack[-1]
            pieces.append(text)
            if open_tags["a"]:
                linked += len(text.strip())
            continue
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if name in BLOCK:
                flush()
            if open_tags[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                if any(tag in BLOCK for tag, *_ in stack[depth + 1 :]):
                    flush()
                pop_to(depth)
            continue
        if token["attributes"].endswith("/") and (name in FOREIGN or any(open_tags[n] for n in FOREIGN)):
            continue
        if name in RAW_TEXT:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else size
            continue
        if name in BLOCK:
            flush()
            if name in ENDS_PARAGRAPH:
                end_open({"p"}, PARAGRAPH_SCOPE)
            if name in ENDS_OPEN:
                end_open(*ENDS_OPEN[name])
        elif name == "br":
            pieces.append(" ")
        if name not in VOID:
            _, marks, block, inner = stack[-1]
            own = _marks(name, token["attributes"])
            if name in SECTIONING or (len(own) > 1 and name in BLOCK):
                inner = frozenset(own)
            stack.append((name, marks | own if not own <= marks else marks, name if name in BLOCK else block, inner))
            open_tags[name] += 1
        if name == "xmp":
            end = _RAW_END[name].search(page, at)
            text, at = page[at : end.start() if end else size], end.start() if end else size
            if not text.isspace():
                where = stack[-1]
            pieces.append(text.replace("&", "&amp;"))
            if open_tags["a"]:
                linked += len(text.strip())
    flush()
    return blocks
