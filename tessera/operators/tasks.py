"""Tasks and scripts over entries: code by name, run on the driver or on all partitions; collectors; entry processors."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalog import Catalog
from tessera.plans.query import query

ONE_NODE, ALL_NODES = "ONE_NODE", "ALL_NODES"


@dataclass
class Task:
    """run(spark, **parameters) on the driver, or run(frames, **parameters) over the pandas frames of each partition."""

    name: str
    run: Callable
    mode: str = ONE_NODE
    schema: str | None = None
    parameters: tuple[str, ...] = ()
    language: str = "python"
    roles: frozenset[str] = field(default_factory=frozenset)


class Context:
    """What a task on the driver is given if it names a `context`: its parameters, and queries on the catalog's entities."""

    def __init__(self, tasks: Tasks, parameters: dict):
        self._tasks, self.parameters = tasks, parameters

    def query(self, text: str, **params):
        if self._tasks.catalog is None:
            raise ValueError("these tasks have no catalog")
        return query(self._tasks.catalog, text, **params)


class Tasks:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog, self._tasks = spark, catalog, {}

    def register(self, task: Task) -> None:
        self._tasks[task.name] = task

    def names(self) -> list[str]:
        return sorted(self._tasks)

    def remove(self, name: str) -> None:
        self._tasks.pop(name, None)

    def execute(self, name: str, df: DataFrame | None = None, **parameters):
        task = self._tasks[name]
        missing = [p for p in task.parameters if p not in parameters]
        if missing:
            raise ValueError(f"task {name} misses {', '.join(missing)}")
        if task.mode == ONE_NODE:
            given = {"context": Context(self, parameters)} if "context" in inspect.signature(task.run).parameters else {}
            return task.run(self.spark, **given, **parameters)

        def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return task.run(frames, **parameters)

        return df.mapInPandas(over, task.schema)

    def sql_script(self, name: str, text: str, *parameters: str) -> None:
        """A script as parameterised SQL with :names."""
        self.register(Task(name, lambda spark, **p: spark.sql(text, args=p), ONE_NODE, parameters=parameters, language="sql"))


def collect_by(df: DataFrame, keys: list[str], schema: str, supply: Callable, accumulate: Callable, combine: Callable, finish: Callable) -> DataFrame:
    """A user-defined collector by key: partial states in each partition, combined after a shuffle of states only.

    supply() gives a picklable state, accumulate(state, frame) and combine(a, b) give states, finish(state) a dict of results."""
    import pickle

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, object] = {}
        for frame in frames:
            for k, part in frame.groupby(keys, dropna=False):
                states[k] = accumulate(states.get(k) if k in states else supply(), part)
        yield pd.DataFrame([[*k, pickle.dumps(s)] for k, s in states.items()], columns=[*keys, "_state"])

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        state = None
        for data in frame["_state"]:
            state = pickle.loads(data) if state is None else combine(state, pickle.loads(data))
        return pd.DataFrame([{k: frame[k].iloc[0] for k in keys} | finish(state)])

    return df.mapInPandas(partial, f"{kinds}, _state binary").groupBy(*keys).applyInPandas(final, f"{kinds}, {schema}")


def process_entries(df: DataFrame, key: str, keys: list, changed: DataFrame) -> DataFrame:
    """An entry processor: rows of the given keys replaced by their processed ones."""
    return df.filter(~F.coalesce(F.col(key).isin(keys), F.lit(False))).unionByName(changed)
