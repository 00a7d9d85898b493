"""Vector distances and the scores of the four similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vector(v) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b) -> Column:
    return _sum(a, _vector(b), lambda x, y: x * y)


def l2(a: Column, b) -> Column:
    return F.sqrt(_sum(a, _vector(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b) -> Column:
    """1 - cos; a zero vector is an error."""
    lengths = norm(a) * norm(_vector(b))
    return 1 - dot(a, b) / F.when(lengths > 0, lengths).otherwise(F.raise_error(F.lit("COSINE similarity of a zero vector")).cast("double"))


def distance(a: Column, b, similarity: str) -> Column:
    return {"L2": l2, "COSINE": cosine, "INNER_PRODUCT": dot, "MAX_INNER_PRODUCT": dot}[similarity.upper()](a, b)


def score(d: Column, similarity: str) -> Column:
    kind = similarity.upper()
    if kind == "L2":
        return 1 / (1 + d * d)
    if kind == "MAX_INNER_PRODUCT":
        return F.when(d < 0, 1 / (1 - d)).otherwise(d + 1)
    return 1 / (1 + d)


def nearest_first(d: Column, similarity: str) -> Column:
    """What to order by: small distances, large products."""
    return d.desc() if "INNER_PRODUCT" in similarity.upper() else d.asc()
