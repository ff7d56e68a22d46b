"""Audit tasks: plans from files, dependencies, schedules, batches, circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..functions import text as X
from ..storage import numbered, stored
from .graph import layers


def planned_tasks(files: DataFrame, batch: int = 10) -> DataFrame:
    """Tasks of files (path, content): risk and group choose the kinds of task; a task has up to `batch` files of a group.

    One row a task: task_id, task_type, priority, risk, grp, files, seconds.  Files of a group go in order of path.
    """
    risk = S.banded(X.file_risk(F.col("path"), F.col("content"), F.lit(0)), ((8, "critical"), (6, "high"), (3, "medium")), "low")
    f = files.select("path", risk.alias("risk"), X.file_group(F.col("path"), F.col("content")).alias("grp"), F.size(X.lines(F.col("content"))).alias("n_lines"))
    f = f.withColumn("plan", F.when(F.col("grp").isin("test", "config"), F.col("grp")).otherwise(F.col("risk")))
    f = numbered(stored(f, "risks"), ["risk", "grp", "path"], "place")
    first = f.groupBy("risk", "grp").agg(F.min("place").alias("first"))  # one row a kind of risk and group
    f = f.join(F.broadcast(first), ["risk", "grp"]).withColumn("batch", F.floor((F.col("place") - F.col("first")) / batch))
    b = f.groupBy("risk", "grp", "plan", "batch").agg(F.array_sort(F.collect_list("path")).alias("files"), F.sum("n_lines").alias("n_lines"))
    plans = F.lit(None).cast("array<struct<task_type:string,priority:int>>")
    for name, tasks in rules.TASK_PLANS.items():
        plans = F.when(F.col("plan") == name, F.array(*[F.struct(F.lit(t).alias("task_type"), F.lit(p).alias("priority")) for t, p in tasks])).otherwise(plans)
    t = b.withColumn("t", F.explode(plans)).select("t.*", "risk", "grp", "batch", "files", "n_lines")
    seconds = X.task_seconds(F.col("task_type"), F.size("files"), F.col("n_lines"))
    return t.select(F.md5(F.concat_ws("|", "task_type", "risk", "grp", F.col("batch").cast("string"))).alias("task_id"), "task_type", "priority", "risk", "grp", "files", F.round(seconds, 6).alias("seconds"))


def task_dependencies(tasks: DataFrame) -> DataFrame:
    """(src, dst, kind): tasks that share a file, by the rules of which kind precedes which."""
    e = tasks.select("task_id", "task_type", F.explode("files").alias("file"))
    pairs = e.select(F.col("task_id").alias("src"), F.col("task_type").alias("a"), "file").join(e.select(F.col("task_id").alias("dst"), F.col("task_type").alias("b"), "file"), "file")
    kind = S.first_match((((F.col("a") == a) & (F.col("b") == b), k) for a, b, k in rules.TASK_RULES))
    return pairs.withColumn("kind", kind).filter("kind is not null").select("src", "dst", "kind").distinct()


def schedule(tasks: DataFrame, dependencies: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """tasks with layer and position under a strategy: priority, dependency, duration or hybrid."""
    l = layers(tasks.select(F.col("task_id").alias("node")), dependencies).withColumnRenamed("node", "task_id")
    order = {
        "priority": ["priority"], "dependency": ["layer", "priority"], "duration": [F.desc("seconds")], "hybrid": ["layer", "priority", F.desc("seconds")],
    }[strategy]
    return numbered(tasks.join(l, "task_id"), [*order, "task_id"], "position")


def ready_tasks(tasks: DataFrame, dependencies: DataFrame, completed: DataFrame) -> DataFrame:
    """Tasks not completed whose prerequisites all are, by priority."""
    unmet = dependencies.join(completed.select(F.col("task_id").alias("src")), "src", "left_anti").select(F.col("dst").alias("task_id")).distinct()
    return tasks.join(completed.select("task_id"), "task_id", "left_anti").join(unmet, "task_id", "left_anti").orderBy("priority", "task_id")


def consecutive_batches(tasks: DataFrame, order: str, keys: list[str], size: int = 10, partition: list[str] | None = None) -> DataFrame:
    """tasks with batch: runs of equal keys in an order, cut at `size`."""
    part = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(order)
    changed = F.lit(False)
    for k in keys:
        changed = changed | (F.lag(k).over(part) != F.col(k))
    t = tasks.withColumn("_run", F.sum(F.coalesce(changed, F.lit(False)).cast("int")).over(part))
    within = F.row_number().over(Window.partitionBy(*(partition or [F.lit(0)]), "_run").orderBy(order))
    return t.withColumn("batch", F.concat_ws("-", F.col("_run").cast("string"), F.floor((within - 1) / size).cast("string"))).drop("_run")


class Breaker:
    """Circuit breaker: opens after so many failures, tries again after a pause, closes after so many successes."""

    def __init__(self, failures: int = 5, pause: float = 60.0, successes: int = 1):
        self.limit, self.pause, self.needed = failures, pause, successes
        self.state, self.failed, self.since, self.good = "closed", 0, 0.0, 0

    def step(self, at: float, ok: bool) -> tuple[bool, str]:
        """(whether the call may run, state behind it)."""
        if self.state == "open":
            if at - self.since <= self.pause:
                return False, self.state
            self.state, self.good = "half_open", 0
        if ok:
            self.good += 1
            if self.state == "half_open" and self.good >= self.needed:
                self.state = "closed"
            if self.state == "closed":
                self.failed = 0
        else:
            self.failed, self.since = self.failed + 1, at
            if self.state == "half_open" or self.failed >= self.limit:
                self.state = "open"
        return True, self.state


def breaker_states(calls: DataFrame, key: str, failures: int = 5, pause: float = 60.0, successes: int = 1) -> DataFrame:
    """calls (key, call_id, ts seconds, ok) with allowed and state, folded in time order for each key.

    Calls come sorted, in Arrow batches, so a key of any length is folded in bounded memory.
    """
    import pandas as pd

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, breaker = object(), Breaker()
        for pdf in batches:
            out = []
            for k, at, ok in zip(pdf[key], pdf["at"], pdf["ok"]):
                if k != now:
                    now, breaker = k, Breaker(failures, pause, successes)
                out.append(breaker.step(at, bool(ok)))
            yield pd.DataFrame({key: pdf[key], "call_id": pdf.call_id, "allowed": [a for a, _ in out], "state": [s for _, s in out]})

    c = calls.select(F.col(key).cast("string").alias(key), "call_id", F.col("at").cast("double").alias("at"), "ok")
    return c.repartition(key).sortWithinPartitions(key, "at", "call_id").mapInPandas(fold, f"{key} string, call_id long, allowed boolean, state string")


def moving_success(outcomes: DataFrame, keys: list[str], chunk: str, alpha: float = 0.1) -> DataFrame:
    """Exponential moving success rate by keys over outcomes (keys, chunk, ord, ok); the first outcome sets it.

    chunk grows with ord and cuts a key's outcomes into parts, such as days.  A part of n outcomes folds to (n, sum), and parts
    fold in order by (n1, s1) + (n2, s2) = (n1 + n2, s1 * (1 - alpha)^n2 + s2), so no task holds a key's outcomes.
    """
    keep = 1.0 - alpha
    back = F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(F.desc("ord"))) - 1
    ok = F.col("ok").cast("double")
    parts = outcomes.withColumn("_s", alpha * ok * F.pow(F.lit(keep), back)).groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("n"), F.sum("_s").alias("s"), F.min_by(ok, "ord").alias("first"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc(chunk)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    folded = parts.withColumn("s", F.col("s") * F.pow(F.lit(keep), later)).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min_by("first", chunk).alias("first"))
    return folded.select(*keys, "n", F.round(F.col("s") + F.col("first") * F.pow(F.lit(keep), F.col("n")), 6).alias("rate"))


def execution_statistics(tasks: DataFrame) -> DataFrame:
    """One row over tasks (status, worker, seconds): counts, utilisation, load balance 1 / (1 + variance of tasks a worker)."""
    by = tasks.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.sum("seconds").alias("busy"))
    return by.agg(F.sum("n").alias("n"), F.sum("done").alias("done"), F.count(F.lit(1)).alias("workers"), F.round(F.avg("busy") / F.max("busy"), 6).alias("utilisation"), F.round(1 / (1 + F.var_pop("n")), 6).alias("balance"))


def eviction_order(entries: DataFrame, policy: str) -> DataFrame:
    """Cache entries (entry, created, used, hits, ttl) with the position at which a policy drops them."""
    order = {"lru": ["used"], "lfu": ["hits", "used"], "ttl": [F.col("created") + F.col("ttl")], "fifo": ["created"]}[policy]
    return numbered(entries, [*order, "entry"], "position")


def completed_tasks(reports: DataFrame, targets: DataFrame) -> DataFrame:
    """Tasks all of whose target agents reported: (task, n) from reports (task, agent) and targets (task, agents)."""
    r = reports.groupBy("task").agg(F.countDistinct("agent").alias("n"))
    return targets.join(r, "task").filter(F.col("n") >= F.size("agents")).select("task", "n")
