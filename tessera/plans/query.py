"""The facade: queries with parameters, paging, a default limit, hit counts, deletes and a timeout."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tessera.plans.catalog import Catalog
from tessera.plans.compiler import Compiler, QueryError
from tessera.plans.parser import parse

DEFAULT_LIMIT, HIT_COUNT_ACCURACY = 100, 10_000


@dataclass(frozen=True)
class Result:
    rows: list
    hit_count: int
    exact: bool


class Query:
    """catalog.query(text).param(..).start_offset(..).max_results(..) then df(), execute(), hit_count() or delete()."""

    def __init__(self, catalog: Catalog, text: str):
        self.catalog, self.text, self.statement = catalog, text, parse(text)
        self.params: dict = {}
        self._offset, self._limit, self._timeout = 0, None, None

    def param(self, name: str, value) -> Query:
        self.params[name] = value
        return self

    def start_offset(self, n: int) -> Query:
        if n < 0:
            raise QueryError("startOffset can't be negative")
        self._offset = n
        return self

    def max_results(self, n: int) -> Query:
        if n < 0:
            raise QueryError("maxResults can't be negative")
        self._limit = n
        return self

    def timeout(self, seconds: float) -> Query:
        self._timeout = seconds
        return self

    def compiler(self) -> Compiler:
        return Compiler(self.statement, self.catalog[self.statement.entity], self.params)

    def all(self) -> DataFrame:
        """Every match, without paging."""
        if self.statement.delete:
            raise QueryError("a DELETE has no rows; call delete()")
        return self.compiler().plan()

    def df(self) -> DataFrame:
        """The page asked for; without max_results every match from the offset on."""
        out = self.all()
        out = out.offset(self._offset) if self._offset else out
        return out if self._limit is None else out.limit(self._limit)

    def execute(self) -> Result:
        """At most max_results rows (100 by default) on the driver, and the number of matches."""
        limit = DEFAULT_LIMIT if self._limit is None else self._limit
        began, found = time.monotonic(), self.all()
        page = found.offset(self._offset).limit(limit)
        rows = self._within(page.collect)
        count, exact = self.hit_count()
        self.catalog.statistics.record(self.text, len(rows), time.monotonic() - began)
        return Result(rows, count, exact)

    def hit_count(self, accuracy: int | None = HIT_COUNT_ACCURACY) -> tuple[int, bool]:
        """Matches, exactly up to the accuracy, else that as a lower bound; without an accuracy all of them."""
        if accuracy is None:
            return self._within(self.all().count), True
        n = self._within(self.all().limit(accuracy + 1).count)
        return (n, True) if n <= accuracy else (accuracy, False)

    def matches(self) -> Column:
        """The WHERE clause as a condition on the entity's rows."""
        where = self.statement.where
        from pyspark.sql import functions as F

        return F.lit(True) if where is None else self.compiler().condition(where)

    def delete(self) -> int:
        """Remove the matches of a DELETE from the entity; returns how many there were."""
        if not self.statement.delete:
            raise QueryError("not a DELETE")
        if self._offset or self._limit is not None:
            raise QueryError("DELETE statements can't use paging")
        entity, matches = self.catalog[self.statement.entity], self.matches()
        count = self._within(entity.df.filter(matches).count)
        entity.df = entity.df.filter(~matches)
        return count

    def _within(self, action):
        if self._timeout is None:
            return action()
        context = self.catalog[self.statement.entity].df.sparkSession.sparkContext
        group = uuid.uuid4().hex
        context.setJobGroup(group, self.text, interruptOnCancel=True)
        timer = threading.Timer(self._timeout, context.cancelJobGroup, (group,))
        timer.start()
        try:
            return action()
        except Exception as e:
            if not timer.is_alive():
                raise TimeoutError(f"the query took more than {self._timeout} s") from e
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)


def query(catalog: Catalog, text: str, **params) -> Query:
    out = Query(catalog, text)
    for k, v in params.items():
        out.param(k, v)
    return out
