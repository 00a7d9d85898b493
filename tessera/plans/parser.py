"""Recursive descent from tokens to a Statement."""

from __future__ import annotations

from functools import lru_cache

from tessera.plans.ast import (
    Agg, And, Between, Boost, Compare, Const, Distance, FullText, In, IsEmpty, IsNull, Join, Knn, Like, MemberOf, Meta, Not,
    Occur, Or, Order, Param, Path, Regexp, Statement, Term, TextRange, Within,
)
from tessera.plans.lexer import QuerySyntaxError, Token, tokens

AGGREGATES = ("avg", "count", "max", "min", "sum")
COMPARISONS = {"=": "=", "<>": "!=", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


class _Parser:
    def __init__(self, query: str):
        self.query, self.all, self.i, self.positional = query, tokens(query), 0, 0

    # tokens
    @property
    def now(self) -> Token:
        return self.all[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.all[min(self.i + n, len(self.all) - 1)]

    def take(self, *texts: str) -> Token | None:
        if self.now.is_(*texts):
            self.i += 1
            return self.all[self.i - 1]
        return None

    def need(self, *texts: str) -> Token:
        return self.take(*texts) or self.fail(f"expected {' or '.join(texts)}")

    def fail(self, why: str):
        raise QuerySyntaxError(f"{why}, found {self.now.text or 'the end'!r} at {self.now.at} in: {self.query}")

    def name(self) -> str:
        if self.now.kind not in ("name", "keyword"):
            self.fail("expected a name")
        self.i += 1
        return str(self.all[self.i - 1].value)

    def path(self) -> Path:
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        return Path(tuple(parts))

    # statements
    def statement(self) -> Statement:
        s = Statement("")
        if self.take("delete"):
            s.delete = True
        elif self.take("select"):
            s.distinct = bool(self.take("distinct"))
            s.select = [self.selected()]
            while self.take(","):
                s.select.append(self.selected())
        self.need("from")
        s.entity = str(self.path())
        if self.take("as"):
            s.alias = self.name()
        elif self.now.kind == "name":
            s.alias = self.name()
        while self.now.is_("join", "inner", "left", "right", "full", "cross"):
            s.joins.append(self.join())
        if self.take("where"):
            s.where = self.either()
        if self.take("group"):
            self.need("by")
            s.group = [self.path()]
            while self.take(","):
                s.group.append(self.path())
        if self.take("having"):
            s.having = self.either()
        if self.take("order"):
            self.need("by")
            s.order = [self.ordering()]
            while self.take(","):
                s.order.append(self.ordering())
        if self.now.kind != "end":
            self.fail("expected the end of the query")
        return s

    def join(self) -> Join:
        kind = self.take("inner", "left", "right", "full", "cross")
        self.take("outer")
        self.need("join")
        self.take("fetch")
        path = self.path()
        self.take("as")
        return Join(path, self.name(), kind.text if kind else "inner")

    def selected(self):
        expression = self.scalar()
        named = self.name() if self.take("as") else None
        return expression, named

    def ordering(self) -> Order:
        key = self.scalar()
        return Order(key, bool(self.take("desc")) or (self.take("asc") and False) or False)

    def scalar(self):
        """A path, an aggregate, a metadata projection or a distance."""
        if self.ahead().is_("(") and self.now.kind == "keyword":
            if word := self.take(*AGGREGATES):
                self.need("(")
                distinct = bool(self.take("distinct"))
                path = None if self.take("*") else self.path()
                self.need(")")
                return Agg(word.text, path, distinct)
            if word := self.take("score", "version"):
                self.need("(")
                self.path()
                self.need(")")
                return Meta(word.text)
            if self.take("distance"):
                self.need("(")
                path = self.path()
                self.need(",")
                lat = self.value()
                self.need(",")
                lon = self.value()
                unit = self.name() if self.take(",") else "m"
                self.need(")")
                return Distance(path, lat, lon, unit)
        if self.ahead().is_("("):
            self.fail("function not supported")
        return self.path()

    # values
    def value(self):
        sign = -1 if self.take("-") else 1
        token = self.now
        if token.kind in ("int", "float"):
            self.i += 1
            return sign * token.value
        if sign < 0:
            self.fail("expected a number")
        if token.kind == "string":
            self.i += 1
            return token.value
        if token.is_("true", "false", "null"):
            self.i += 1
            return {"true": True, "false": False, "null": None}[token.text]
        if self.take(":"):
            return Param(self.name())
        if self.take("?"):
            self.positional += 1
            if self.now.kind == "int":
                self.i += 1
                return Param(str(self.all[self.i - 1].value))
            return Param(str(self.positional))
        self.fail("expected a value")

    def values(self, closing: str) -> tuple:
        out = []
        while not self.take(closing):
            out.append(self.value())
            if not self.now.is_(closing):
                self.need(",")
        return tuple(out)

    # conditions
    def either(self):
        parts = [self.both()]
        while self.take("or", "||"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.negation()]
        while self.take("and", "&&"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation(self):
        if self.take("not", "!"):
            return Not(self.negation())
        if sign := self.take("+", "-", "#"):
            return Occur(sign.text, self.negation())
        return self.condition()

    def condition(self):
        if self.take("("):
            inside = self.either()
            self.need(")")
            return Boost(inside, float(self.number())) if self.take("^") else inside
        if self.now.is_("true", "false") and not self.ahead().is_(".", *COMPARISONS):
            return Const(self.value())
        if self.now.kind in ("int", "float", "string") or self.now.is_(":", "?"):
            value = self.value()
            if self.take("member"):
                self.need("of")
                return MemberOf(value, self.path())
            op = self.need(*COMPARISONS)
            flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
            return Compare(flipped.get(op.text, COMPARISONS[op.text]), self.scalar(), value)
        left = self.scalar()
        if op := self.take(*COMPARISONS):
            right = self.value()
            if right is None:
                return IsNull(left) if op.text == "=" else Not(IsNull(left))
            return Compare(COMPARISONS[op.text], left, right)
        if self.take(":"):
            return FullText(left, self.text_clause())
        if self.take("<->"):
            return self.knn(left)
        if self.take("within"):
            return self.within(left)
        negated = bool(self.take("not"))
        found = self.tail(left)
        return Not(found) if negated else found

    def tail(self, left):
        if self.take("between"):
            low = self.value()
            self.need("and")
            return Between(left, low, self.value())
        if self.take("in"):
            if self.take("("):
                return In(left, self.values(")"))
            return In(left, (self.value(),))
        if self.take("like"):
            pattern = self.value()
            return Like(left, pattern, self.value() if self.take("escape") else "\\")
        if self.take("is"):
            negated = bool(self.take("not"))
            found = IsEmpty(left) if self.take("empty") else self.need("null") and IsNull(left)
            return Not(found) if negated else found
        self.fail("expected a comparison")

    def number(self):
        value = self.value()
        return value if isinstance(value, (int, float)) else self.fail("expected a number")

    def knn(self, path: Path) -> Knn:
        vector = self.values("]") if self.take("[") else self.value()
        self.need("~")
        k = self.value()
        return Knn(path, vector, k, self.either() if self.take("filtering") else None)

    def within(self, path: Path) -> Within:
        shape = self.need("circle", "box", "polygon").text
        self.need("(")
        args = []
        while not self.take(")"):
            if self.take("("):
                args.append(self.values(")"))
            elif self.now.kind == "name":
                args.append(self.name())
            else:
                args.append(self.value())
            if not self.now.is_(")"):
                self.need(",")
        return Within(path, shape, tuple(args))

    # full text
    def text_either(self):
        parts = [self.text_both()]
        while self.take("or", "||") or not (self.now.is_(")", "and", "&&", "^") or self.now.kind == "end"):
            parts.append(self.text_both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def text_both(self):
        parts = [self.text_clause()]
        while self.take("and", "&&"):
            parts.append(self.text_clause())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def text_clause(self):
        if sign := self.take("+", "-", "#"):
            return Occur(sign.text, self.text_clause())
        if self.take("not", "!"):
            return Not(self.text_clause())
        if self.take("("):
            found = self.text_either()
            self.need(")")
        elif opening := self.take("[", "{"):
            low = None if self.take("*") else self.value()
            self.need("to", ",")
            high = None if self.take("*") else self.value()
            closing = self.need("]", "}")
            found = TextRange(low, high, opening.text == "[", closing.text == "]")
        elif self.now.kind == "regexp":
            self.i += 1
            found = Regexp(self.all[self.i - 1].value)
        else:
            value = self.value()
            slop = None
            if self.take("~"):
                slop = int(self.number()) if self.now.kind == "int" else 2
            found = Term(value, slop)
        return Boost(found, float(self.number())) if self.take("^") else found


@lru_cache(maxsize=200)
def parse(query: str) -> Statement:
    """The statement of a query; the last 200 are remembered."""
    return _Parser(query).statement()
