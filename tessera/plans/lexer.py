"""Tokens of the query language: keywords in any case, literals, parameters and the operators of the full-text part."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset(
    "select from where group by having order asc desc delete distinct as and or not between in like escape is null empty "
    "member of elements join inner left right full outer cross fetch exists all any some indices true false "
    "avg count max min sum to within box circle polygon distance score version filtering".split()
)

_PARTS = [
    ("space", r"\s+"),
    ("float", r"(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?|\d+[eE][+-]?\d+[fFdD]?|\d+[fFdD](?![\w])"),
    ("hex", r"0[xX][0-9a-fA-F]+[lL]?"),
    ("int", r"\d+[lL]?"),
    ("string", r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\""),
    ("name", r"[A-Za-z_$][\w$]*|`[^`]+`"),
    ("op", r"<->|<=|>=|<>|!=|&&|\|\||[=<>(){}\[\],.:?*+\-#~^!/]"),
]
_SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PARTS))


class QuerySyntaxError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, keyword, int, float, string, regexp, op, end
    text: str
    at: int
    value: object = None

    def is_(self, *texts: str) -> bool:
        return self.kind in ("op", "keyword") and self.text in texts


def tokens(query: str) -> list[Token]:
    """All tokens of a query and an end token. A slash after a colon or an occur sign starts a regular expression."""
    out: list[Token] = []
    at = 0
    while at < len(query):
        if query[at] == "/" and out and out[-1].is_(":", "(", "+", "-", "#", "!", "&&", "||", "and", "or", "not"):
            end = at + 1
            while end < len(query) and query[end] != "/":
                end += 2 if query[end] == "\\" else 1
            if end >= len(query):
                raise QuerySyntaxError(f"unterminated regular expression at {at}")
            out.append(Token("regexp", query[at : end + 1], at, query[at + 1 : end].replace("\\/", "/")))
            at = end + 1
            continue
        found = _SCAN.match(query, at)
        if not found:
            raise QuerySyntaxError(f"unexpected {query[at]!r} at {at}")
        kind, text = found.lastgroup, found.group()
        if kind == "space":
            pass
        elif kind == "name" and text.lower() in KEYWORDS:
            out.append(Token("keyword", text.lower(), at, text))
        elif kind == "name":
            out.append(Token("name", text, at, text.strip("`")))
        elif kind == "string":
            out.append(Token("string", text, at, text[1:-1].replace(text[0] * 2, text[0])))
        elif kind == "float":
            out.append(Token("float", text, at, float(text.rstrip("fFdD"))))
        elif kind == "hex":
            out.append(Token("int", text, at, int(text.rstrip("lL"), 16)))
        elif kind == "int":
            digits = text.rstrip("lL")
            octal = len(digits) > 1 and digits[0] == "0" and set(digits) <= set("01234567")
            out.append(Token("int", text, at, int(digits, 8) if octal else int(digits)))
        else:
            out.append(Token("op", text, at))
        at = found.end()
    out.append(Token("end", "", len(query)))
    return out
