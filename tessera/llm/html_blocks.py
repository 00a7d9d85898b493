"""Pages as sequences of leaf blocks: the text between block-level tags, with the path of elements above it.

References are decoded, white space inside a block is one space, comments and elements that hold no text of the page
(scripts, styles, form controls, the head) are left out. Unclosed elements end as HTML ends them: text or a tag that can't
be in a head closes the head, a block an open paragraph, an item the item before it, an end tag everything opened since
its start tag. So do left-out elements, but for `RAW` ones, whose text is no markup: without an end tag these reach to the
page's end, and so does an unfinished tag or comment. Nesting beyond `DEEPEST` elements is flattened, as browsers do: a deeper
element takes the place of the one before it, its text stays. With that, a page takes time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title".split())
RAW_IF_CLOSED = frozenset("noscript iframe".split())
UNNESTED = RAW_IF_CLOSED | frozenset("button select".split())  # a start tag ends an open one
FOREIGN = frozenset("svg math".split())
SILENT = frozenset("noscript template select button svg iframe object canvas audio video math".split())
# Left-out elements that an end tag of another element inside a line doesn't end.
WALLS = frozenset("noscript template select button iframe object".split())
# Start tags that end an open svg or math, unless one of `INSIDE` is open in it.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
DEEPEST = 512
SCOPES = frozenset("ul ol table dl select article section main div body aside nav header footer form".split())
CLOSES_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption body html option optgroup legend summary".split())

# Atomic groups: no position is tried twice, and a quote without its like is searched for once.
_NAME = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)")
_TAG_END = re.compile(r"(?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_EDGE = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW | RAW_IF_CLOSED}
_ATTR = re.compile(r"([^\s/=>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]\S*+)))?+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")


def _raw_end(page: str, at: int, name: str) -> int | None:
    """Where an element of mere text that starts before `at` ends; None if it is taken as an element like others."""
    for edge in _EDGE[name].finditer(page, at):
        if edge[1]:
            return edge.end()
        if name in RAW_IF_CLOSED:
            return None
    return len(page) if name in RAW else None


@dataclass(eq=False)
class Node:
    """An element above blocks, by name and .class-or-id words; elements alike under one parent are one node."""

    label: str
    parent: Node | None
    depth: int
    below: dict[str, Node] = field(default_factory=dict)

    def child(self, label: str) -> Node:
        found = self.below.get(label)
        if found is None:
            found = self.below[label] = Node(label, self, self.depth + 1)
        return found


@dataclass
class Block:
    text: str
    node: Node
    linked: int = 0  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """The labels of the elements above, outermost first."""
        out, node = [], self.node
        while node.parent is not None:
            out.append(node.label)
            node = node.parent
        return tuple(reversed(out))


def _label(name: str, attrs: str) -> str:
    if not attrs.strip():
        return name
    words, hidden = [], False
    for key, double, single, bare in _ATTR.findall(attrs):
        key, value = key.lower(), double or single or bare
        if key in ("class", "id", "role"):
            words += [w.lower() for w in _PART.findall(value)]
        elif key == "hidden":
            hidden |= value.lower() != "false"
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "style":
            hidden |= bool(_HIDDEN_STYLE.search(value))
    return name + "".join(f".{w}" for w in [*words, *["hidden"] * hidden])


def _closes_itself(attrs: str) -> bool:
    """The tag ends with a slash that isn't part of an unquoted value."""
    value = attrs[attrs.rfind("=") + 1 :].strip() if "=" in attrs else ""
    return attrs.endswith("/") and (not value or any(c in "\"'" or c.isspace() for c in value))


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    page = page or ""
    out: list[Block] = []
    root = Node("", None, 0)
    stack: list[tuple[str, Node]] = []  # names, and the last element up to there that has a part in paths
    parts: list[str] = []
    linked = 0
    links = 0
    opened: Counter[str] = Counter()  # of the names on the stack
    quiet: int | None = None  # place in the stack of the outermost left-out element

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else root, min(linked, len(text))))
            parts.clear()
        linked = 0

    def drop_to(i: int) -> None:
        opened.subtract(n for n, _ in stack[i:])
        del stack[i:]

    def pop_to(i: int) -> None:
        nonlocal links
        links -= sum(n == "a" for n, _ in stack[i:])
        drop_to(i)

    def push(name: str, label: str) -> None:
        if len(stack) >= DEEPEST and (quiet is None or quiet < len(stack) - 1):
            (pop_to if quiet is None else drop_to)(len(stack) - 1)
        above = stack[-1][1] if stack else root
        opened[name] += 1
        stack.append((name, above.child(label) if name in BLOCKS or "." in label else above))

    def end_head(name: str = "") -> None:
        """Closes an open head before text or a start tag that it can't hold; an unclosed noscript in it too."""
        nonlocal quiet
        if quiet is not None and (name == "body" or stack[quiet][0] == "noscript") and quiet and stack[quiet - 1][0] == "head":
            drop_to(quiet - 1)
            quiet = None
        elif quiet is None and stack and stack[-1][0] == "head":
            drop_to(len(stack) - 1)

    def closed_by(name: str) -> int | None:
        """The place in the stack of the element that an end tag closes."""
        for i in range(len(stack) - 1 if opened[name] else -1, -1, -1):
            if stack[i][0] == name:
                return i
            if (stack[i][0] in SCOPES or stack[i][0] in WALLS) and name not in BLOCKS and name not in SILENT and name != "head":
                return None
        return None

    def broken_out(name: str) -> int | None:
        """The place in the stack of the left-out element that a start tag ends."""
        if name in UNNESTED:
            return next((i for i in range(quiet, len(stack)) if stack[i][0] == name), None)
        place = None
        if name in BREAKS_OUT:
            for i in range(len(stack) - 1, quiet - 1, -1):
                if stack[i][0] in INSIDE:
                    break
                if stack[i][0] in FOREIGN:
                    place = i
        return place

    at = done = 0
    while (start := page.find("<", at)) >= 0:
        found = _NAME.match(page, start)
        if found:
            closing = _TAG_END.match(page, found.end())
            end = closing.end() if closing else len(page)
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 2) + 3
        elif page.startswith("<![CDATA[", start):
            end = page.find("]]>", start) + 3
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start) + 1
        else:
            at = start + 1
            continue
        end = end if end > start else len(page)
        piece = page[done:start]
        if piece.strip():
            end_head()
        if piece and quiet is None:
            parts.append(piece)
            if links:
                linked += len(piece)
        at = done = end
        if not found or not closing:
            continue
        name = found["name"].lower()
        attrs = page[found.end() : end - 1].rstrip()
        block = name in BLOCKS
        if found["end"]:
            place = closed_by(name)
            if quiet is not None:
                if place is None:
                    continue
                if place >= quiet:
                    drop_to(place)
                    quiet = quiet if place > quiet else None
                    continue
                drop_to(quiet)
                quiet = None
            if block or name == "head":
                flush()
            if place is not None:
                pop_to(place)
            continue
        if name not in IN_HEAD:
            end_head(name)
        if quiet is not None and (place := broken_out(name)) is not None:
            drop_to(place)
            quiet = quiet if place > quiet else None
        if quiet is not None or name in SILENT or name in RAW:
            if name in _EDGE and not any(n in FOREIGN for n, _ in stack[len(stack) if quiet is None else quiet :]) and (end := _raw_end(page, at, name)) is not None:
                at = done = end
            elif name not in VOID and not _closes_itself(attrs):
                push(name, name)
                quiet = len(stack) - 1 if quiet is None else quiet
            continue
        if block or name in ("head", "body"):
            flush()
        if name in VOID:
            continue
        if name in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        for closing in CLOSES.get(name, ()):
            for i in range(len(stack) - 1 if opened[closing] else -1, -1, -1):
                if stack[i][0] == closing:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if not attrs.endswith("/"):
            push(name, _label(name, attrs))
            links += name == "a"
    if page[done:].strip():
        end_head()
    if quiet is None:
        parts.append(page[done:])
    else:
        drop_to(quiet)
    flush()
    return out
