"""Statements to DataFrames. Conditions are two-valued: a comparison with null is false, and its negation true."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fulltext, spatial, vector
from tessera.plans.ast import (
    Agg, And, Between, Boost, Compare, Const, Distance, FullText, In, IsEmpty, IsNull, Knn, Like, MemberOf, Meta, Not, Occur, Or,
    Param, Path, Regexp, Statement, Term, TextRange, Within,
)
from tessera.plans.catalog import Entity

SCORE, VERSION = "_score", "_version"


class QueryError(ValueError):
    """A query that can be read but not answered."""


def definite(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


class Compiler:
    def __init__(self, statement: Statement, entity: Entity, params: dict):
        self.s, self.entity, self.params = statement, entity, params
        self.aliases = {j.alias: self.strip(j.path).parts for j in statement.joins}
        self.knn: Knn | None = None

    # names and values
    def strip(self, path: Path) -> Path:
        parts = path.parts
        return Path(parts[1:]) if len(parts) > 1 and parts[0] == self.s.alias and parts[0] not in self.entity.df.columns else path

    def bind(self, value):
        if isinstance(value, Param):
            if value.name not in self.params:
                raise QueryError(f"Query parameter '{value.name}' was not set")
            return self.params[value.name]
        return value

    def kind(self, parts: tuple[str, ...]) -> T.DataType:
        """The type at a path, elements of arrays looked through."""
        kind: T.DataType = self.entity.df.schema
        for p in parts:
            while isinstance(kind, T.ArrayType):
                kind = kind.elementType
            if not isinstance(kind, T.StructType) or p not in kind.names:
                raise QueryError(f"no attribute {'.'.join(parts)} in {self.entity.name}")
            kind = kind[p].dataType
        return kind

    def alias_of(self, path: Path) -> str | None:
        return path.parts[0] if path.parts[0] in self.aliases else None

    def full(self, path: Path) -> tuple[str, ...]:
        path = self.strip(path)
        alias = self.alias_of(path)
        return self.aliases[alias] + path.parts[1:] if alias else path.parts

    def literal(self, value, kind: T.DataType) -> Column:
        value = self.bind(value)
        if isinstance(value, Column):
            return value
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.lit(value)
        if isinstance(value, str) and re.fullmatch(r"\d{17}", value):
            value = dt.datetime.strptime(value[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%d %H:%M:%S.") + value[14:] + ("Z" if isinstance(kind, T.TimestampType) else "")
        return F.lit(value).cast(kind)

    def anywhere(self, parts: tuple[str, ...], test: Callable[[Column], Column], base: Column | None = None, kind: T.DataType | None = None) -> Column:
        """test holds for the value at a path, or for any one of them where the path leads through arrays."""
        kind = kind if kind is not None else self.entity.df.schema
        at = base
        for i, p in enumerate(parts):
            if isinstance(kind, T.ArrayType):
                rest, inner = parts[i:], kind.elementType
                return definite(F.exists(at, lambda e: self.anywhere(rest, test, e, inner)))
            if not isinstance(kind, T.StructType) or p not in kind.names:
                raise QueryError(f"no attribute {'.'.join(parts)} in {self.entity.name}")
            at = F.col(f"`{p}`") if at is None else at[p]
            kind = kind[p].dataType
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
            return definite(F.exists(at, lambda e: definite(test(e))))
        return definite(test(at))

    def project(self, path: Path) -> Column:
        """The value at a path; of repeated values the first."""
        parts, kind, at = self.full(path), self.entity.df.schema, None
        if parts[0] in self.entity.points and len(parts) == 1:
            lat, lon = self.entity.points[parts[0]]
            return F.struct(F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))
        for p in parts:
            if isinstance(kind, T.ArrayType):
                at, kind = F.get(at, 0), kind.elementType
            if not isinstance(kind, T.StructType) or p not in kind.names:
                raise QueryError(f"no attribute {'.'.join(parts)} in {self.entity.name}")
            at, kind = (F.col(f"`{p}`") if at is None else at[p]), kind[p].dataType
        if isinstance(kind, T.ArrayType) and ".".join(parts) not in self.entity.similarity:
            at = F.get(at, 0)
        marker = self.entity.nulls.get(".".join(parts))
        return F.nullif(at, F.lit(marker)) if marker is not None else at

    def point(self, path: Path) -> tuple[Column, Column]:
        parts = self.full(path)
        name = ".".join(parts)
        if name in self.entity.points:
            lat, lon = self.entity.points[name]
            return F.col(lat), F.col(lon)
        kind = self.kind(parts)
        if isinstance(kind, T.StructType) and {"latitude", "longitude"} <= set(kind.names):
            return F.col(name)["latitude"], F.col(name)["longitude"]
        raise QueryError(f"{name} is not a spatial attribute")

    def distance(self, d: Distance) -> Column:
        return spatial.haversine(*self.point(d.path), self.bind(d.lat), self.bind(d.lon)) / spatial.unit(d.unit)

    # conditions
    def test(self, node, kind: T.DataType) -> Callable[[Column], Column]:
        """A leaf condition as a test of one value."""
        if isinstance(node, Compare):
            right = self.literal(node.right, kind)
            ops = {"=": lambda c: c == right, "!=": lambda c: c != right, "<": lambda c: c < right, "<=": lambda c: c <= right, ">": lambda c: c > right, ">=": lambda c: c >= right}
            return ops[node.op]
        if isinstance(node, Between):
            low, high = self.literal(node.low, kind), self.literal(node.high, kind)
            return lambda c: (c >= low) & (c <= high)
        if isinstance(node, In):
            values = [self.bind(v) for v in node.values]
            flat = [x for v in values for x in (v if isinstance(v, (list, tuple, set)) else [v])]
            return lambda c: c.isin(*[self.literal(v, kind) for v in flat])
        if isinstance(node, Like):
            pattern, escape = self.bind(node.pattern), node.escape
            return lambda c: F.like(c, F.lit(pattern), F.lit(escape))
        return lambda c: c.isNull()

    def condition(self, node) -> Column:
        if isinstance(node, Const):
            return F.lit(node.value)
        if isinstance(node, And):
            return self.conjunction(node.parts)
        if isinstance(node, Or):
            return reduce(or_, map(self.condition, node.parts))
        if isinstance(node, Not):
            return ~self.condition(node.part)
        if isinstance(node, Occur):
            found = self.condition(node.part)
            return ~found if node.sign == "-" else found
        if isinstance(node, Boost):
            return self.condition(node.part)
        if isinstance(node, FullText):
            found = self.text_count(node) > 0
            hint = self.text_hint(node)
            return found if hint is None else hint & found
        if isinstance(node, Within):
            return self.within(node)
        if isinstance(node, Knn):
            self.knn = node
            return F.lit(True)
        if isinstance(node, MemberOf):
            return self.anywhere(self.full(node.path), lambda c: c == self.literal(node.value, self.kind(self.full(node.path))))
        if isinstance(node, IsEmpty):
            return definite(F.size(F.col(".".join(self.full(node.path)))) == 0)
        if isinstance(node, Compare) and isinstance(node.left, (Agg, Meta, Distance)):
            return definite(self.test(node, T.DoubleType())(self.scalar(node.left)))
        path = node.left if isinstance(node, Compare) else node.path
        if not isinstance(path, Path):
            return definite(self.test(node, T.DoubleType())(self.scalar(path)))
        if isinstance(node, Compare) and node.op == "!=" and self.alias_of(self.strip(path)):
            return ~self.condition(Compare("=", path, node.right))
        parts = self.full(path)
        if isinstance(node, Compare) and node.op == "=" and isinstance(self.bind(node.right), str) and self.entity.analyzers.get(".".join(parts)) == "lowercase":
            return self.anywhere(parts, lambda c: F.lower(c) == F.lit(self.bind(node.right).lower()))
        return self.anywhere(parts, self.test(node, self.kind(parts)))

    def conjunction(self, parts: tuple) -> Column:
        """Positive leaves on one nested join alias hold for the same element; everything else stands alone."""
        together: dict[str, list] = {}
        alone = []
        for node in parts:
            path = getattr(node, "left", None) if isinstance(node, Compare) else getattr(node, "path", None) if isinstance(node, (Between, In, Like, IsNull)) else None
            alias = self.alias_of(self.strip(path)) if isinstance(path, Path) else None
            if alias and ".".join(self.aliases[alias]) in self.entity.nested and not (isinstance(node, Compare) and node.op == "!="):
                together.setdefault(alias, []).append((node, self.strip(path)))
            else:
                alone.append(self.condition(node))
        for alias, nodes in together.items():
            collection = self.aliases[alias]
            element = self.kind(collection)
            element = element.elementType if isinstance(element, T.ArrayType) else element
            alone.append(definite(F.exists(F.col(".".join(collection)), self.same_element(collection, element, nodes))))
        return reduce(and_, alone)

    def same_element(self, collection: tuple[str, ...], element: T.DataType, nodes: list) -> Callable[[Column], Column]:
        return lambda e: reduce(and_, [self.anywhere(p.parts[1:], self.test(n, self.kind(collection + p.parts[1:])), e, element) for n, p in nodes])

    def within(self, node: Within) -> Column:
        lat, lon = self.point(node.path)
        args = [tuple(map(self.bind, a)) if isinstance(a, tuple) else self.bind(a) for a in node.args]
        if node.shape == "circle":
            return definite(spatial.in_circle(lat, lon, args[0], args[1], args[2] * spatial.unit(args[3] if len(args) > 3 else "m")))
        if node.shape == "box":
            return definite(spatial.in_box(lat, lon, *args))
        return definite(spatial.in_polygon(lat, lon, [tuple(map(float, a)) for a in args]))

    # full text
    def text_count(self, node: FullText) -> Column:
        """Matches of a full-text predicate; over 0 where it holds."""
        name = ".".join(self.full(node.path))
        analyzer = self.entity.analyzers.get(name)
        if not analyzer:
            raise QueryError(f"{name} is not a full-text attribute of {self.entity.name}")
        return F.coalesce(self.counted(node.clause, F.col(name), analyzer), F.lit(0))

    def counted(self, clause, value: Column, analyzer: str) -> Column:
        """The count of a clause. A lambda binds the tokens, so that a row's text is analyzed once, not for every use of a token."""
        return F.get(F.transform(F.array(fulltext.ANALYZERS[analyzer](value)), lambda tokens: self.clause(clause, tokens, value, analyzer)), 0)

    def text_hint(self, node: FullText) -> Column | None:
        """A cheap condition that every match meets: its words are somewhere in the text. Rows without them aren't analyzed."""
        name = ".".join(self.full(node.path))
        analyzer = self.entity.analyzers.get(name)
        if analyzer not in ("standard", "simple", "whitespace"):
            return None
        value = F.col(name) if analyzer == "whitespace" else F.lower(F.col(name))

        def needs(clause) -> Column | None:
            if isinstance(clause, Boost) or (isinstance(clause, Occur) and clause.sign != "-"):
                return needs(clause.part)
            if isinstance(clause, And):
                parts = [p for p in map(needs, clause.parts) if p is not None]
                return reduce(and_, parts) if parts else None
            if isinstance(clause, Or):
                parts = [needs(p) for p in clause.parts]
                if any(isinstance(p, Occur) for p in clause.parts) or any(p is None for p in parts):
                    return None
                return reduce(lambda a, b: a | b, parts)
            word = getattr(clause, "value", None)
            if isinstance(clause, (Not, Occur, Regexp, TextRange)) or word is None:
                return None
            word = self.bind(word)
            words = fulltext.analyze_words(word, analyzer) if isinstance(word, str) else []
            plain = bool(words) and not any(c in w for w in words for c in "*?") and (len(words) > 1 or not clause.slop)
            return reduce(and_, [value.contains(w) for w in words]) if plain else None

        return needs(node.clause)

    def clause(self, clause, tokens: Column, value: Column, analyzer: str) -> Column:
        if isinstance(clause, Boost):
            return self.clause(clause.part, tokens, value, analyzer)
        if isinstance(clause, Occur):
            return self.clause(Not(clause.part) if clause.sign == "-" else clause.part, tokens, value, analyzer)
        if isinstance(clause, Not):
            return F.when(F.coalesce(self.clause(clause.part, tokens, value, analyzer), F.lit(0)) > 0, 0).otherwise(1)
        if isinstance(clause, (And, Or)):
            counts = [F.coalesce(self.clause(p, tokens, value, analyzer), F.lit(0)) for p in clause.parts]
            if isinstance(clause, And):
                return F.least(*counts)
            # Signed clauses must all hold; without a positive one, so must one of the others.
            signed = [c for p, c in zip(clause.parts, counts, strict=True) if isinstance(p, Occur)]
            free = [c for p, c in zip(clause.parts, counts, strict=True) if not isinstance(p, Occur)]
            positive = any(isinstance(p, Occur) and p.sign != "-" for p in clause.parts)
            needed = signed + ([reduce(lambda a, b: a + b, free)] if free and not positive else [])
            return F.least(*needed) if len(needed) > 1 else needed[0]
        if isinstance(clause, Regexp):
            return fulltext.count_matching(tokens, lambda t: t.rlike(f"^(?:{clause.value})$"))
        if isinstance(clause, TextRange):
            low, high = self.bind(clause.low), self.bind(clause.high)
            items = tokens if isinstance(low, str) or isinstance(high, str) else F.array(value)

            def inside(t: Column) -> Column:
                tests = [F.lit(True)]
                if low is not None:
                    tests.append(t >= low if clause.with_low else t > low)
                if high is not None:
                    tests.append(t <= high if clause.with_high else t < high)
                return reduce(and_, tests)

            return fulltext.count_matching(items, inside)
        value_ = self.bind(clause.value)
        if not isinstance(value_, str):
            return F.when(value == F.lit(value_), 1).otherwise(0)
        words = fulltext.analyze_words(value_, analyzer)
        if not words:
            return F.lit(0)
        if len(words) == 1:
            return fulltext.term_count(tokens, words[0], analyzer, clause.slop)
        return fulltext.phrase_count(tokens, words, analyzer, clause.slop or 0)

    def score(self, node, factor: float = 1.0) -> Column:
        """Sum over matching full-text clauses of their boosted, saturated frequencies; filters and negations add nothing."""
        if isinstance(node, (And, Or)):
            return reduce(lambda a, b: a + b, [self.score(p, factor) for p in node.parts])
        if isinstance(node, Boost):
            return self.score(node.part, factor * node.factor)
        if isinstance(node, Occur):
            return self.score(node.part, factor) if node.sign == "+" else F.lit(0.0)
        if isinstance(node, FullText):
            return self.clause_score(node.clause, F.col(".".join(self.full(node.path))), self.entity.analyzers.get(".".join(self.full(node.path)), "standard"), factor)
        return F.lit(0.0)

    def clause_score(self, clause, value: Column, analyzer: str, factor: float) -> Column:
        if isinstance(clause, Boost):
            return self.clause_score(clause.part, value, analyzer, factor * clause.factor)
        if isinstance(clause, (And, Or)):
            return reduce(lambda a, b: a + b, [self.clause_score(p, value, analyzer, factor) for p in clause.parts])
        if isinstance(clause, Occur):
            return self.clause_score(clause.part, value, analyzer, factor) if clause.sign == "+" else F.lit(0.0)
        if isinstance(clause, Not):
            return F.lit(0.0)
        return fulltext.saturated(self.counted(clause, value, analyzer)) * factor

    # projections
    def scalar(self, item) -> Column:
        if isinstance(item, Path):
            return self.project(item)
        if isinstance(item, Distance):
            return self.distance(item)
        if isinstance(item, Meta):
            if item.name == "score":
                return F.col(SCORE)
            return F.col(self.entity.version) if self.entity.version else F.lit(None).cast("long")
        return F.col(self.agg_name(item))

    def label(self, item) -> str:
        if isinstance(item, Path):
            return ".".join(self.strip(item).parts)
        if isinstance(item, Agg):
            return self.agg_name(item)
        return item.name if isinstance(item, Meta) else "distance"

    def agg_name(self, a: Agg) -> str:
        whole = a.path is None or (len(a.path.parts) == 1 and a.path.parts[0] == self.s.alias)
        return f"{a.name}({'distinct ' if a.distinct else ''}{'*' if whole else '.'.join(self.strip(a.path).parts)})"

    def aggregate(self, a: Agg) -> Column:
        if a.path is None or (len(a.path.parts) == 1 and a.path.parts[0] == self.s.alias):
            return F.count(F.lit(1))
        kind, value = self.kind(self.full(a.path)), self.project(a.path)
        if a.name == "count":
            return F.count_distinct(value) if a.distinct else F.count(value)
        if a.distinct:
            raise QueryError(f"{a.name} of distinct values is not supported")
        if a.name in ("sum", "avg") and not isinstance(kind, T.NumericType):
            raise QueryError(f"{a.name} needs a number, {self.label(a.path)} is {kind.simpleString()}")
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.name](value)

    # plans
    def matched(self) -> DataFrame:
        """The entity's rows that match WHERE, with a score column where one is asked for or made."""
        s, df = self.s, self.entity.df
        where = self.condition(s.where) if s.where is not None else None
        if self.knn:
            df = self.nearest(df, self.knn)
        elif any(isinstance(x, Meta) and x.name == "score" for x in [e for e, _ in s.select] + [o.key for o in s.order]):
            df = df.withColumn(SCORE, self.score(s.where).cast("float") if s.where is not None else F.lit(0.0).cast("float"))
        return df if where is None else df.filter(where)

    def nearest(self, df: DataFrame, knn: Knn) -> DataFrame:
        name = ".".join(self.full(knn.path))
        similarity = self.entity.similarity.get(name)
        if not similarity:
            raise QueryError(f"{name} is not a vector attribute of {self.entity.name}")
        goal = knn.vector if isinstance(knn.vector, tuple) else self.bind(knn.vector)
        goal = [self.bind(x) for x in goal]
        k = int(self.bind(knn.k))
        if knn.filtering is not None:
            df = df.filter(self.condition(knn.filtering))
        d = vector.distance(F.col(name), goal, similarity)
        tie = [F.col(self.entity.key)] if self.entity.key else []
        top = df.filter(F.col(name).isNotNull()).withColumn("_distance", d).orderBy(vector.nearest_first(F.col("_distance"), similarity), *tie).limit(k)
        return top.withColumn(SCORE, vector.score(F.col("_distance"), similarity)).drop("_distance")

    def plan(self) -> DataFrame:
        s = self.s
        df = self.matched()
        aggregates = [x for x in self.all_aggregates()]
        if aggregates or s.group:
            return self.grouped(df, aggregates)
        keys = {}
        for o in s.order:
            keys.setdefault(o.key, o.descending)
        if keys:
            df = df.orderBy(*[self.scalar(k).desc() if desc else self.scalar(k).asc() for k, desc in keys.items()])
        elif self.knn:
            df = df.orderBy(F.col(SCORE).desc(), *([F.col(self.entity.key)] if self.entity.key else []))
        if s.select and not (len(s.select) == 1 and isinstance(s.select[0][0], Path) and s.select[0][0].parts == (s.alias,)):
            columns = [self.scalar(e).alias(named or self.label(e)) if not (isinstance(e, Path) and e.parts == (s.alias,)) else F.struct(*self.entity.df.columns).alias(named or s.alias) for e, named in s.select]
            df = df.select(*columns)
        elif SCORE in df.columns and SCORE not in self.entity.df.columns:
            df = df.drop(SCORE)
        return df.distinct() if s.distinct else df

    def all_aggregates(self) -> list[Agg]:
        found: dict[Agg, None] = {}

        def walk(x):
            if isinstance(x, Agg):
                found[x] = None
            elif isinstance(x, (And, Or)):
                for p in x.parts:
                    walk(p)
            elif isinstance(x, Not):
                walk(x.part)
            elif isinstance(x, Compare):
                walk(x.left)
            elif isinstance(x, (Between, In, Like, IsNull)):
                walk(x.path)

        for e, _ in self.s.select:
            walk(e)
        walk(self.s.having)
        for o in self.s.order:
            walk(o.key)
        return list(found)

    def grouped(self, df: DataFrame, aggregates: list[Agg]) -> DataFrame:
        s = self.s
        keys = {self.label(p): self.project(p) for p in s.group}
        for e, _ in s.select:
            if isinstance(e, Path) and self.label(e) not in keys:
                raise QueryError(f"{self.label(e)} is neither grouped nor aggregated")
        columns = [c.alias(n) for n, c in keys.items()]
        aggs = [self.aggregate(a).alias(self.agg_name(a)) for a in aggregates]
        out = (df.groupBy(*columns).agg(*aggs) if aggs else df.select(*columns).distinct()) if columns else df.agg(*aggs)
        rows = _Rows(self)
        if s.having is not None:
            out = out.filter(rows.condition(s.having))
        order = {}
        for o in s.order:
            order.setdefault(self.label(o.key), o.descending)
        if order:
            out = out.orderBy(*[F.col(f"`{n}`").desc() if d else F.col(f"`{n}`").asc() for n, d in order.items()])
        return out.select(*[F.col(f"`{self.label(e)}`").alias(named or self.label(e)) for e, named in s.select]) if s.select else out


class _Rows:
    """Conditions over grouped rows, whose columns are labels."""

    def __init__(self, compiler: Compiler):
        self.c = compiler

    def condition(self, node) -> Column:
        if isinstance(node, And):
            return reduce(and_, map(self.condition, node.parts))
        if isinstance(node, Or):
            return reduce(or_, map(self.condition, node.parts))
        if isinstance(node, Not):
            return ~self.condition(node.part)
        if isinstance(node, Const):
            return F.lit(node.value)
        item = node.left if isinstance(node, Compare) else node.path
        kind = T.StringType() if isinstance(item, Agg) else self.c.kind(self.c.full(item))
        return definite(self.c.test(node, kind)(F.col(f"`{self.c.label(item)}`")))
