"""Entities that queries can name: a DataFrame and how its attributes are indexed."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entity:
    """analyzers: path -> analyzer of a text attribute; similarity: path -> of a vector; points: name -> (latitude, longitude);
    nested: collections whose join alias stands for one element (others are flattened); key and version: column names."""

    name: str
    df: DataFrame
    key: str | None = None
    version: str | None = None
    analyzers: dict[str, str] = field(default_factory=dict)
    similarity: dict[str, str] = field(default_factory=dict)
    points: dict[str, tuple[str, str]] = field(default_factory=dict)
    nested: frozenset[str] = frozenset()
    nulls: dict[str, object] = field(default_factory=dict)


class Statistics:
    """How often each query text was executed, how many rows it gave, and the seconds that took; bounded in texts."""

    def __init__(self, texts: int = 1000):
        self._texts, self._of, self._lock = texts, {}, threading.Lock()

    def record(self, text: str, rows: int, seconds: float) -> None:
        with self._lock:
            held = self._of.pop(text, (0, 0, 0.0, 0.0))
            self._of[text] = (held[0] + 1, held[1] + rows, held[2] + seconds, max(held[3], seconds))
            if len(self._of) > self._texts:
                del self._of[next(iter(self._of))]

    def clear(self) -> None:
        with self._lock:
            self._of.clear()

    def slowest(self) -> tuple[str, float] | None:
        return max(((t, x[3]) for t, x in self._of.items()), key=lambda p: p[1], default=None)

    def df(self, spark: SparkSession) -> DataFrame:
        rows = [(t, n, rows, total / n, most) for t, (n, rows, total, most) in self._of.items()]
        return spark.createDataFrame(rows, "query string, count long, rows long, mean_seconds double, max_seconds double")


class Catalog:
    def __init__(self):
        self._entities: dict[str, Entity] = {}
        self.statistics = Statistics()

    def register(self, name: str, df: DataFrame, **how) -> Entity:
        self._entities[name] = entity = Entity(name, df, **how)
        return entity

    def __getitem__(self, name: str) -> Entity:
        if name not in self._entities:
            raise KeyError(f"unknown entity {name}; known: {', '.join(sorted(self._entities)) or 'none'}")
        return self._entities[name]

    def names(self) -> list[str]:
        return sorted(self._entities)

    def remove(self, name: str) -> None:
        self._entities.pop(name, None)
