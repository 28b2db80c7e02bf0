import datetime as dt

from kvasir.streaming import state as S

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, user string, ts timestamp"


def write(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_limiter_over_batches(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    at = lambda s: T0 + dt.timedelta(seconds=s)
    all_rows = []
    for part in ([(1, "a", at(0)), (2, "a", at(10)), (3, "b", at(11))], [(4, "a", at(20)), (5, "a", at(70)), (6, None, at(71))]):
        write(spark, src, part)
        all_rows += part
        stream = spark.readStream.schema(EVENTS).parquet(src).withWatermark("ts", "1 hour")
        limited = S.stream_fixed_limit(stream, "user", "ts", most=2, seconds=60)
        run(limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark))
    got = {(r.event_id, r.window_no, r.n, r.allowed) for r in spark.read.parquet(out).collect()}
    assert got == {(r.event_id, r.window_no, r.n, r.allowed) for r in S.fixed_window_limit(spark.createDataFrame(all_rows, EVENTS), "user", "ts", most=2, seconds=60).collect()}
    assert (4, 1, 3, False) in got and (5, 2, 1, True) in got


def test_sessions_and_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    at = lambda m: T0 + dt.timedelta(minutes=m)
    write(spark, src, [(1, "a", at(0)), (2, "a", at(5)), (3, "a", at(60)), (4, "b", at(600))])
    stream = lambda: spark.readStream.schema(EVENTS).parquet(src)
    run(S.stream_sessions(stream(), "user", "ts", "10 minutes", "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "s")).option("checkpointLocation", str(tmp_path / "sc")))
    assert {(r.user, r.begin, r.n) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("a", at(0), 2), ("a", at(60), 1)}
    path = str(tmp_path / "u")
    run(S.stream_upsert(stream(), ["user"], "ts", path, str(tmp_path / "uc")))
    write(spark, src, [(5, "a", at(700)), (6, "c", at(1))])
    run(S.stream_upsert(stream(), ["user"], "ts", path, str(tmp_path / "uc")))
    assert {(r.user, r.event_id) for r in spark.read.parquet(path).collect()} == {("a", 5), ("b", 4), ("c", 6)}
