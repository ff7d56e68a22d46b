"""Registers of rules that users extend: each holds named builders of columns, in order."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rules:
    """Named conditions; a row gets the names of those that hold."""

    def __init__(self, **rules: Callable[[], Column]):
        self.rules = dict(rules)

    def add(self, name: str, build: Callable[[], Column]) -> Rules:
        self.rules[name] = build
        return self

    def remove(self, name: str) -> Rules:
        self.rules.pop(name, None)
        return self

    def apply(self, df: DataFrame, column: str = "rules") -> DataFrame:
        held = [F.when(build(), F.lit(name)) for name, build in self.rules.items()]
        return df.withColumn(column, F.array_compact(F.array(*held)) if held else F.array().cast("array<string>"))


class Weights:
    """Weights by name that sum to 1 after every change."""

    def __init__(self, weights: dict[str, float]):
        self.set(weights)

    def set(self, weights: dict[str, float]) -> Weights:
        total = sum(weights.values())
        if total <= 0 or min(weights.values()) < 0:
            raise ValueError("weights must be positive in sum and none negative")
        self.values = {k: v / total for k, v in weights.items()}
        return self

    def update(self, **changes: float) -> Weights:
        return self.set(self.values | changes)

    def mean(self, columns: dict[str, Column]) -> Column:
        return sum((c * self.values[k] for k, c in columns.items()), F.lit(0.0)) / sum(self.values[k] for k in columns)


class Thresholds:
    """Levels by metric, the most severe first."""

    def __init__(self, levels: dict[str, tuple[tuple[str, float], ...]]):
        self.levels = {m: dict(pairs) for m, pairs in levels.items()}

    def set(self, metric: str, level: str, value: float) -> Thresholds:
        self.levels.setdefault(metric, {})[level] = value
        return self

    def level(self, metric: str, value: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, t in sorted(self.levels.get(metric, {}).items(), key=lambda x: x[1]):
            out = F.when(value >= t, F.lit(name)).otherwise(out)
        return out


class Sources:
    """Sources of knowledge by name, each a function of a table of queries that gives (query, kind, item), with a priority."""

    def __init__(self):
        self.sources: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}

    def add(self, name: str, source: Callable[[DataFrame], DataFrame], priority: int = 0) -> Sources:
        self.sources[name] = (priority, source)
        return self

    def remove(self, name: str) -> Sources:
        self.sources.pop(name, None)
        return self

    def ask(self, queries: DataFrame) -> DataFrame:
        """(query, source, priority, kind, item) of all sources, for queries (query and more)."""
        out = None
        for name, (priority, source) in sorted(self.sources.items(), key=lambda x: (x[1][0], x[0])):
            found = source(queries).select("query", F.lit(name).alias("source"), F.lit(priority).alias("priority"), "kind", "item")
            out = found if out is None else out.unionByName(found)
        if out is None:
            raise ValueError("no source is registered")
        return out


class Checkers:
    """Health checkers by name: functions without arguments that give a status, or raise."""

    def __init__(self, **checkers: Callable[[], str]):
        self.checkers = dict(checkers)

    def add(self, name: str, checker: Callable[[], str]) -> Checkers:
        self.checkers[name] = checker
        return self

    def run(self, spark: SparkSession) -> DataFrame:
        """(component, status, message); a checker that raises makes its component critical."""
        rows = []
        for name, checker in sorted(self.checkers.items()):
            try:
                rows.append((name, checker(), None))
            except Exception as e:  # what a user's checker raises is its result
                rows.append((name, "critical", str(e)))
        return spark.createDataFrame(rows, "component string, status string, message string")


def executed(tasks: DataFrame, executor: Callable[[dict], str], key: str = "task_id") -> DataFrame:
    """(key, status, result) of tasks run by a user's function of a row, on the executors; one that raises fails its task only."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append((row[key], "done", str(executor(row))))
                except Exception as e:  # what a user's function raises is its result
                    out.append((row[key], "failed", str(e)))
            yield pd.DataFrame(out, columns=[key, "status", "result"])

    return tasks.mapInPandas(run, f"{key} {tasks.schema[key].dataType.simpleString()}, status string, result string")


def cached(ttl: float, clock: Callable[[], float] = time.monotonic):
    """Decorator: a query's result is written once for each of its arguments and read again until it is ttl seconds old."""
    from ..storage import stored

    def wrap(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        kept: dict[tuple, tuple[float, DataFrame]] = {}

        @functools.wraps(query)
        def run(*args) -> DataFrame:
            key = tuple(map(str, args))
            if key not in kept or clock() - kept[key][0] > ttl:
                kept[key] = (clock(), stored(query(*args), "cached"))
            return kept[key][1]

        return run

    return wrap


def monitored(layer: str, operation: str, record: Callable[[dict], None], clock: Callable[[], float] = time.monotonic):
    """Decorator: each call of a function gives record a metric of its layer, operation, seconds and success."""

    def wrap(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(*args, **kwargs):
            began, ok = clock(), False
            try:
                out = function(*args, **kwargs)
                ok = True
                return out
            finally:
                record({"layer": layer, "operation": operation, "seconds": clock() - began, "success": ok})

        return run

    return wrap
