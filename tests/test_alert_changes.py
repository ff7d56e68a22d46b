"""Alerts raised once: a stream in several batches and runs against a fold over windows."""

import datetime

from codeglint.streaming import alerts as S

T0 = datetime.datetime(2024, 1, 1)
METRICS = "layer string, operation long, metric_type string, ts timestamp, value double"


def metrics(spark, rows):
    return spark.createDataFrame([(layer, 1, kind, T0 + datetime.timedelta(seconds=at) if at is not None else None, v) for layer, kind, at, v in rows], METRICS)


ROWS = [
    ("a", "accuracy", 0, 0.4), ("a", "accuracy", 10, 0.5), ("a", "accuracy", 300, 0.5), ("a", "accuracy", 600, 0.6), ("a", "accuracy", 900, 0.95), ("a", "accuracy", 1200, 0.6),
    ("a", "accuracy", 1500, 0.6), ("a", "accuracy", 1500 + 9000, 0.6), ("a", "accuracy", 10800, 0.6), (None, "accuracy", 0, 0.1), (None, "accuracy", 900, 0.1), ("a", "false_positive_rate", 0, 0.5),
    ("a", "other", 0, 0.0), ("a", "accuracy", None, 0.1), ("a", "accuracy", 3, None),
]
#: (layer, metric, seconds of the window, severity) with a memory of two hours.
WANT = {
    ("a", "accuracy", 0, "critical"), ("a", "accuracy", 600, "high"), ("a", "accuracy", 1200, "high"), ("a", "accuracy", 10500, "high"), (None, "accuracy", 0, "critical"),
    ("a", "false_positive_rate", 0, "critical"),
}


def found(df):
    got = [(r.layer, r.metric_type, int((r.start - T0).total_seconds()), r.severity) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_batch(spark):
    assert found(S.raised(metrics(spark, ROWS), forget=7200)) == WANT
    assert S.raised(metrics(spark, []), forget=7200).count() == 0


def test_stream_over_runs(spark, tmp_path):
    """Three runs of one query, each with what has come by then; a far row ends the windows."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    order = sorted(ROWS, key=lambda r: r[2] or 0)
    for part in (order[:7], order[7:], [("end", "other", 10**7, 0.0)]):
        metrics(spark, part).coalesce(1).write.mode("append").parquet(source)
        q = S.alerting(spark.readStream.schema(METRICS).parquet(source), out, check, forget=7200)
        q.awaitTermination(120)
        assert q.exception() is None
    assert found(spark.read.schema(S.ALERTS).parquet(out)) == WANT


def test_settings_stay(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    metrics(spark, ROWS[:1]).write.parquet(str(tmp_path / "in"))
    S.alerting(spark.readStream.schema(METRICS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.conf.get(name, None) == before
