"""JSON commands on string columns. Reads use Spark's JSON and variant functions; edits rebuild the document in Arrow batches.

Paths: `$` is the root, then `.name`, `['name']`, `[i]` (negative from the end), `.*` and `[*]`.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.([\w$-]+|\*)|\[(-?\d+|\*|'[^']*'|\"[^\"]*\")\]")


def get(doc: Column, path: str = "$") -> Column:
    """The value at a path as JSON text; strings without quotes."""
    return F.get_json_object(doc, path)


def mget(doc: Column, paths: list[str]) -> Column:
    return F.array(*[get(doc, p) for p in paths])


def typed(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(doc), path, kind)


def json_type(doc: Column, path: str = "$") -> Column:
    """object, array, string, integer, number, boolean or null; null where the path leads nowhere."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant"))
    return (
        F.when(kind.isNull(), None).when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def arr_len(doc: Column, path: str = "$") -> Column:
    return F.json_array_length(get(doc, path))


def obj_keys(doc: Column, path: str = "$") -> Column:
    return F.json_object_keys(get(doc, path))


def obj_len(doc: Column, path: str = "$") -> Column:
    return F.size(obj_keys(doc, path))


def str_len(doc: Column, path: str = "$") -> Column:
    return F.when(json_type(doc, path) == "string", F.char_length(get(doc, path)))


def arr_index(doc: Column, path: str, value) -> Column:
    """Where value stands in the array at a path; -1 if nowhere."""
    items = F.from_json(get(doc, path), "array<string>")
    goal = value if isinstance(value, str) else json.dumps(value)
    return (F.array_position(items, goal) - 1).cast("long")


def debug_memory(doc: Column, path: str = "$") -> Column:
    return F.octet_length(get(doc, path))


def steps(path: str) -> list:
    out, at = [], 1 if path.startswith("$") else 0
    path = path if path.startswith(("$", ".", "[")) else "." + path
    while at < len(path):
        found = _STEP.match(path, at)
        if not found:
            raise ValueError(f"bad JSON path {path!r}")
        name, index = found.groups()
        if name is not None:
            out.append(name if name != "*" else Ellipsis)
        else:
            out.append(Ellipsis if index == "*" else index[1:-1] if index[0] in "'\"" else int(index))
        at = found.end()
    return out


def edit(doc, way: list, change, create: bool = False):
    """doc with change(value) at every place a path leads to; change may return DELETE. create makes a missing last field."""
    if not way:
        return change(doc)
    step, rest = way[0], way[1:]
    if isinstance(doc, dict) and (step is Ellipsis or isinstance(step, str)):
        names = list(doc) if step is Ellipsis else [step] if step in doc or (create and not rest) else []
        for n in names:
            new = edit(doc.get(n, MISSING), rest, change, create)
            if new is DELETE:
                doc.pop(n, None)
            elif new is not MISSING:
                doc[n] = new
    elif isinstance(doc, list) and (step is Ellipsis or isinstance(step, int)):
        places = range(len(doc)) if step is Ellipsis else [step if step >= 0 else len(doc) + step]
        for i in sorted((i for i in places if 0 <= i < len(doc)), reverse=True):
            new = edit(doc[i], rest, change, create)
            if new is DELETE:
                del doc[i]
            else:
                doc[i] = new
    return doc


class DELETE:
    """Given by a change to remove what it was given."""


class MISSING:
    """Stands for a field that isn't there. Both are classes, which keep their identity between processes."""


def _rewrite(doc: Column, path: str, change, create: bool = False) -> Column:
    """The document with a change made; null stays null, and a text that is no JSON stays as it is."""
    way = steps(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                read = json.loads(text)
            except ValueError:
                return text
            out = edit(read, way, change, create)
            return None if out is DELETE else json.dumps(out, separators=(",", ":"), ensure_ascii=False)

        return docs.map(one)

    return run(doc)


def _when(kind, change):
    return lambda v: change(v) if isinstance(v, kind) and not (isinstance(v, bool) and kind is not bool) else v


def json_set(doc: Column, path: str, value, only: str | None = None) -> Column:
    """only: nx (where nothing is) or xx (where something is)."""
    return _rewrite(doc, path, lambda v: v if (only == "nx" and v is not MISSING) or (only == "xx" and v is MISSING) else value, create=only != "xx")


def delete(doc: Column, path: str) -> Column:
    """Also FORGET."""
    return _rewrite(doc, path, lambda v: DELETE)


def clear(doc: Column, path: str = "$") -> Column:
    """Containers become empty and numbers 0."""
    return _rewrite(doc, path, lambda v: {} if isinstance(v, dict) else [] if isinstance(v, list) else 0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v)


def merge(doc: Column, path: str, patch) -> Column:
    """RFC 7396: nulls delete, objects merge, the rest replaces."""

    def merged(v, p):
        if not isinstance(p, dict):
            return p
        out = dict(v) if isinstance(v, dict) else {}
        for k, x in p.items():
            if x is None:
                out.pop(k, None)
            else:
                out[k] = merged(out.get(k), x)
        return out

    return _rewrite(doc, path, lambda v: merged(None if v is MISSING else v, patch), create=True)


def num_incr_by(doc: Column, path: str, n) -> Column:
    return _rewrite(doc, path, _when((int, float), lambda v: v + n))


def num_mult_by(doc: Column, path: str, n) -> Column:
    return _rewrite(doc, path, _when((int, float), lambda v: v * n))


def str_append(doc: Column, path: str, text: str) -> Column:
    return _rewrite(doc, path, _when(str, lambda v: v + text))


def toggle(doc: Column, path: str) -> Column:
    return _rewrite(doc, path, _when(bool, lambda v: not v))


def arr_append(doc: Column, path: str, *values) -> Column:
    return _rewrite(doc, path, _when(list, lambda v: [*v, *values]))


def arr_insert(doc: Column, path: str, at: int, *values) -> Column:
    return _rewrite(doc, path, _when(list, lambda v: [*v[:at], *values, *v[at:]]))


def arr_pop(doc: Column, path: str, at: int = -1) -> Column:
    """The array without the element at a place."""

    def cut(v: list) -> list:
        i = min(max(at + len(v) if at < 0 else at, 0), len(v) - 1)
        return v[:i] + v[i + 1 :]

    return _rewrite(doc, path, _when(list, cut))


def arr_trim(doc: Column, path: str, start: int, stop: int) -> Column:
    def cut(v: list) -> list:
        first = max(start + len(v), 0) if start < 0 else start
        last = stop + len(v) if stop < 0 else stop
        return v[first : last + 1]

    return _rewrite(doc, path, _when(list, cut))


def resp(doc: Column, path: str = "$") -> Column:
    """The value in the bracketed form: arrays as [..], objects as {..}, both flattened to text items."""
    return F.coalesce(F.from_json(get(doc, path), "array<string>"), F.array(get(doc, path)))
