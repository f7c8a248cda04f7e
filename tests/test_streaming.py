"""A stream of landed files gives what the batch gives."""

import json

from reviewloom.streaming import landed


def test_repeats_and_days(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda i, day: json.dumps({"id": i, "repo": "r", "at": f"2024-01-{day:02d}T10:00:00Z"})
    (src / "a.json").write_text("\n".join([row(1, 1), row(1, 1), row(2, 1)]))
    (src / "b.json").write_text("\n".join([row(2, 1), row(3, 2)]))
    # the last file moves the watermark past both days
    (src / "c.json").write_text(row(9, 20))
    rows = landed.first_seen(landed.read_landed(spark, str(src), "id long, repo string, at timestamp"), ["id"], "at")
    q = landed.daily_counts(rows, "at", "repo").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.day.day, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2), (2, 1)}
