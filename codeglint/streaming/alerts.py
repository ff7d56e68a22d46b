"""Quality alerts of five-minute windows, each raised once: a window alarms if its level isn't that of the window before.

`raised` does it over a table, `alerting` over a stream with the last level of each key in its state; both give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions import scoring as S
from ..shipping import by_value

KEYS = ["layer", "operation", "metric_type"]
WIDTH = "300 seconds"
#: Seconds after which the level of a key is forgotten: a week.
FORGET = 7 * 86_400
ALERTS = "layer string, operation string, metric_type string, start timestamp, value double, severity string"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def assessed(metrics: DataFrame, width: str = WIDTH) -> DataFrame:
    """KEYS, start, value, severity of each window; value is a mean of millionths, so it doesn't hang on the order of rows.

    metrics: KEYS, ts, value.  Null times and values are left out; a null key is a key.  Severity is null if no threshold is met.
    """
    m = metrics.filter("ts is not null and value is not null").withColumn("_micro", F.round(F.col("value") * 1_000_000).cast("long"))
    w = m.groupBy(F.window("ts", width).alias("w"), *KEYS).agg(F.sum("_micro").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    mean = F.round(F.col("_sum") / F.col("_n") / 1_000_000, 6)
    return w.select(*[F.col(k).cast("string").alias(k) for k in KEYS], F.col("w.start").alias("start"), mean.alias("value")).withColumn("severity", S.quality_alert(F.col("metric_type"), F.col("value")))


def raised(metrics: DataFrame, width: str = WIDTH, forget: int = FORGET) -> DataFrame:
    """Windows with a severity that the window before of their key didn't have, or had longer than `forget` seconds ago."""
    w = Window.partitionBy(*KEYS).orderBy("start")
    a = assessed(metrics, width).withColumn("_last", F.lag("severity").over(w)).withColumn("_start", F.lag("start").over(w))
    return a.filter("severity is not null").filter(_news(F.col("start"), F.col("severity"), F.col("_start"), F.col("_last"), forget)).drop("_last", "_start")


def _news(start: Column, severity: Column, last_start: Column, last: Column, forget: int) -> Column:
    return last.isNull() | (last != severity) | (F.unix_seconds(start) - F.unix_seconds(last_start) > forget)


class LastLevel(StatefulProcessor):
    """The start and severity of a key's last window; a timer deletes what would be forgotten anyway."""

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start long, severity string")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        # a key's windows of a batch, in order; Spark emits windows only once they are over, so none comes later than the next batch's
        pdf = pd.concat(list(rows)).sort_values("start")
        seen = self.last.get() if self.last.exists() else None
        start, severity = seen if seen else (None, None)
        news = []
        for at, level in zip((int(t.timestamp()) for t in pdf["start"].dt.tz_localize("UTC")), pdf["severity"]):
            level = level if isinstance(level, str) else None
            news.append(level is not None and (severity != level or at - start > self.forget))
            start, severity = at, level
        self.last.update((start, severity))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((start + self.forget + 1) * 1000)
        yield pdf[news]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.last.exists() and self.last.get()[0] + self.forget < timerValues.getCurrentWatermarkInMs() // 1000:
            self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def alerting(stream: DataFrame, path: str, checkpoint: str, late: str = "2 minutes", width: str = WIDTH, forget: int = FORGET) -> StreamingQuery:
    """Starts a query that appends the alerts of a stream of metrics to parquet, through whatever is there now.

    A window alarms when the watermark has passed its end.  State is kept in RocksDB, which keyed state with timers needs.
    """
    spark = stream.sparkSession
    windows = assessed(stream.withWatermark("ts", late), width)
    with by_value(sys.modules[__name__]):
        news = windows.groupBy(*KEYS).transformWithStateInPandas(LastLevel(forget), ALERTS, "append", "EventTime")
    name, before = _ROCKS[0], spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        return news.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
