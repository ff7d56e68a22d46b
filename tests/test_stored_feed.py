"""The streaming source over stored responses: order, since, restarts, odd files."""

from codeglint.sources import stored_feed as S
from codeglint.streaming import telemetry as T


def page(*rows):
    return "<table>" + "".join(f"<tr><td><a href='/d/{i}'>{i}</a></td><td>t</td><td>c</td><td>{day}</td><td>5</td></tr>" for i, day in rows) + "</table>"


def put(root, day, name, body):
    (root / f"day={day}").mkdir(parents=True, exist_ok=True)
    (root / f"day={day}" / name).write_bytes(body if isinstance(body, bytes) else body.encode())


def drained(spark, root, tmp_path, since=None):
    q = T.to_table(S.stream(spark, f"file:{root}", since), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted((r.day, r.file, r.body) for r in spark.read.schema("day string, file string, body string").parquet(str(tmp_path / "out")).collect())


def test_days_come_once_over_runs(spark, tmp_path):
    root = tmp_path / "in"
    for day in ("2024-01-01", "2024-01-02", "2024-02-30", "x"):
        put(root, day, "a.html", day)
    put(root, "2024-01-02", "b.html", b"\xff\xc3\xa9")
    put(root, "2024-01-02", "_SUCCESS", "")
    put(root, "2024-01-03", "empty.html", "")
    (root / "day=2024-01-04").mkdir()
    first = [("2024-01-02", "a.html", "2024-01-02"), ("2024-01-02", "b.html", "�é"), ("2024-01-03", "empty.html", "")]
    assert drained(spark, root, tmp_path, "2024-01-02") == first
    put(root, "2024-01-01", "late.html", "a day that is behind stays behind")
    put(root, "2024-01-05", "c.html", "c")
    assert drained(spark, root, tmp_path, "2024-01-02") == [*first, ("2024-01-05", "c.html", "c")]
    assert len(drained(spark, root, tmp_path, "2024-01-02")) == 4


def test_nothing_there(spark, tmp_path):
    assert drained(spark, tmp_path / "none", tmp_path) == []


def test_offsets_and_tasks(tmp_path, monkeypatch):
    """Tasks of some bytes, and a replay between two offsets that reads the same files."""
    for i in range(1, 8):
        for name in "ab":
            put(tmp_path, f"2024-01-0{i}", name, "x" * 10)
    put(tmp_path, "2024-01-05", "c", "x" * 90)
    monkeypatch.setattr(S, "TASK_BYTES", 25)
    reader = S.StoredFeedReader(str(tmp_path), None)
    assert reader.latestOffset() == {"day": "2024-01-07"} and reader.initialOffset() == {"day": "0001-01-01"}
    parts = reader.partitions({"day": "2024-01-03"}, {"day": "2024-01-06"})
    assert [len(p.files) for p in parts] == [2, 2, 1, 2]
    replay = S.StoredFeedReader(str(tmp_path), "2024-01-02")
    assert replay.partitions({"day": "2024-01-03"}, {"day": "2024-01-06"}) == parts and replay.initialOffset() == {"day": "2024-01-01"}
    assert sum(len(b) for p in parts for _, _, b in reader.read(p)) == 150


def test_new_items(spark):
    df = spark.createDataFrame([("d", page(("A", "2024-01-05"), ("B", "2024-01-04"), ("C", "soon"))), ("d", None), (None, page(("D", "2025-01-01")))], "day string, body string")
    assert sorted((r.day or "", r.cve_id) for r in S.new_items(df, "2024-01-05").collect()) == [("", "D"), ("d", "A"), ("d", "C")]
