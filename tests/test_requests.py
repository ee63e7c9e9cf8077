import datetime

from basalt.streaming.requests import coalesced

REQUEST = "repo_key string, requested_at timestamp"


def test_repeated_requests_are_one(spark, tmp_path):
    at = lambda m, s=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m, seconds=s)
    batches = [
        [("a", at(0)), ("a", at(3)), ("b", at(1)), (None, at(2)), ("a", None)],
        [("a", at(4, 59)), ("a", at(6)), ("b", at(0, 30))],  # within the delay, the next work, and an earlier one that comes later
        [("z", at(60))],
        [("a", at(7)), ("z", at(61))],  # behind the watermark; within the delay
        [("z", at(120))],
        [("y", at(240))],
    ]
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(source)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for b in batches:
        spark.createDataFrame(b, REQUEST).coalesce(1).write.mode("append").parquet(source)
        coalesced(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    got = {(r.repo_key, r.first_at, r.last_at, r.requests) for r in spark.read.parquet(out).collect()}
    assert got == {("a", at(0), at(4, 59), 3), ("a", at(6), at(6), 1), ("b", at(0, 30), at(1), 2), (None, at(2), at(2), 1), ("z", at(60), at(61), 2), ("z", at(120), at(120), 1)}
