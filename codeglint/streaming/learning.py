"""Patterns of false positives learned from feedback: a stream upserts them into a table of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import code_to_pattern

PATTERNS = "pattern_id string, finding_type string, pattern string, confidence double, created timestamp, last_finding string, feedbacks long"
#: Days after which a pattern that no feedback renewed is gone.
EXPIRY_DAYS = 90
_KEY = ["finding_type", "pattern"]


def learned(feedback: DataFrame) -> DataFrame:
    """A pattern for each type and generalised snippet of what feedback calls a false positive.

    feedback: finding_id, finding_type, snippet, is_false_positive, confidence, at.  Feedback on a true finding, or without
    type, snippet or time, teaches nothing; a null confidence is 0.6.  The latest feedback of a pattern gives its time and
    confidence, of equal times that of the last finding_id, then the larger confidence.
    """
    f = feedback.filter("is_false_positive and finding_type is not null and snippet is not null and at is not null")
    f = f.select(F.lower("finding_type").alias("finding_type"), code_to_pattern(F.col("snippet")).alias("pattern"), F.coalesce("confidence", F.lit(0.6)).cast("double").alias("confidence"), F.col("at").cast("timestamp").alias("created"), F.col("finding_id").cast("string").alias("last_finding"))
    return _newest(f.withColumn("feedbacks", F.lit(1).cast("long")))


def _newest(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("created", "last_finding", "confidence"))
    g = rows.groupBy(*_KEY).agg(last.alias("l"), F.sum("feedbacks").alias("feedbacks"))
    name = F.concat(F.lit("learned_"), F.md5(F.concat_ws("\n", *_KEY).cast("binary")))
    return g.select(name.alias("pattern_id"), *_KEY, "l.confidence", "l.created", "l.last_finding", "feedbacks")


def unexpired(patterns: DataFrame, now: Column, days: int = EXPIRY_DAYS) -> DataFrame:
    """Patterns whose last feedback is so many whole days old at most."""
    return patterns.filter(F.col("created") > now - F.make_dt_interval(F.lit(days + 1)))


class PatternTable:
    """A table of patterns in a folder, one folder a version; readers see the newest whole one.

    A batch n writes version n from the newest version before n, so a batch that runs again writes the same rows again.  The two
    newest versions stay, as the last batch may be replayed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, version: int):
        return self._folder.suffix(f"/v{version}")

    def versions(self) -> list[int]:
        """Versions that were written to the end, in order."""
        if not self._fs.exists(self._folder):
            return []
        there = [int(s.getPath().getName()[1:]) for s in self._fs.listStatus(self._folder) if s.getPath().getName().startswith("v")]
        return sorted(v for v in there if self._fs.exists(self._at(v).suffix("/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest before a version; without any, no rows."""
        there = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(PATTERNS).parquet(f"{self.path}/v{there[-1]}") if there else self.spark.createDataFrame([], PATTERNS)

    def upsert(self, feedback: DataFrame, version: int) -> None:
        """Version `version`: the one before and what feedback teaches; older patterns are renewed, others stay as they are."""
        _newest(self.read(version).unionByName(learned(feedback))).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        for old in [v for v in self.versions() if v <= version][:-2]:
            self._fs.delete(self._at(old), True)


def learning(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that upserts the patterns of a stream of feedback into the table at path, through whatever is there now."""
    table = PatternTable(stream.sparkSession, path)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: table.upsert(df, n)).trigger(availableNow=True).start()
