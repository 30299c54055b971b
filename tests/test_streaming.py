from strandlog.model import SCHEMA
from strandlog.streaming.feeds import change_counts, run_job, running_state, stream_changes


class Sink:
    def __init__(self):
        self.got, self.broken = [], False

    def write(self, df):
        if self.broken:
            raise RuntimeError("down")
        self.got += [r.entity_id for r in df.collect()]

    write_all = write


def rows(*versions):
    return [("d", n, i, rec, b, dele, "{}", "{}") for n, (i, rec, b, dele) in enumerate(versions)]


def test_job_on_a_stream(spark, tmp_path):
    path, check = str(tmp_path / "log"), str(tmp_path / "check")
    spark.createDataFrame(rows(("a", 1, 0, False), ("b", 2, 0, False)), SCHEMA).write.parquet(path)
    sink = Sink()
    run = lambda: run_job(stream_changes(spark, path, SCHEMA), sink, check, lambda df: df.where("NOT deleted"), ["d"]).awaitTermination()
    run()
    assert sorted(sink.got) == ["a", "b"]
    spark.createDataFrame(rows(("c", 3, 0, False), ("x", 4, 0, True)), SCHEMA).write.mode("append").parquet(path)
    sink.broken = True
    try:
        run()
    except Exception:
        pass
    sink.broken = False
    run()  # the same batch again
    run()
    assert sorted(sink.got) == ["a", "b", "c"]


def test_running_state_ignores_late_versions(spark, tmp_path):
    path = str(tmp_path / "log")
    held = {}
    batches = [[("a", 5, 0, False), ("a", 3, 0, True)], [("a", 4, 9, True), ("b", 1, 0, False)], [("a", 5, 1, True), ("a", 5, 0, False)], [("b", 1, 0, False)]]

    def keep(df, _):
        for r in df.collect():
            held.setdefault(r.entity_id, []).append((r.recorded, r.batch_seq, r.deleted))

    spark.createDataFrame([], SCHEMA).write.parquet(path)
    stream = stream_changes(spark, path, SCHEMA)
    for b in batches:
        spark.createDataFrame(rows(*b), SCHEMA).coalesce(1).write.mode("append").parquet(path)
        running_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert held == {"a": [(5, 0, False), (5, 1, True)], "b": [(1, 0, False)]}


def test_change_counts(spark, tmp_path):
    path, day = str(tmp_path / "log"), 86_400 * 10**9
    spark.createDataFrame(rows(("a", day, 0, False), ("b", day + 5, 0, True), ("c", 2 * day, 0, False)), SCHEMA).write.parquet(path)
    q = change_counts(stream_changes(spark, path, SCHEMA)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n_changes, r.n_deleted) for r in spark.table("counts").collect()) == [(1, 0), (2, 1)]


def test_change_counts_take_late_rows(spark, tmp_path):
    path, day = str(tmp_path / "log"), 86_400 * 10**9
    counts = {}

    def keep(df, _):
        counts.update({r.window.start: (r.n_changes, r.n_deleted) for r in df.collect()})

    spark.createDataFrame([], SCHEMA).write.parquet(path)
    stream = stream_changes(spark, path, SCHEMA)
    for batch in ([("a", day, 0, False), ("b", 30 * day, 0, False)], [("c", 30 * day, 1, False)], [("d", day + 5, 0, True)]):
        spark.createDataFrame(rows(*batch), SCHEMA).coalesce(1).write.mode("append").parquet(path)
        change_counts(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(counts.values()) == [(2, 0), (2, 1)]
