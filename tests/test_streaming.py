import os
import time

from linkloom.streaming import pages as st


def run(query, mode, name, spark):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_matches_batch(spark, rows, tmp_path):
    page = '<a href="/b">x y</a> x'
    data = [(1, "http://s/a", page, "2024-01-01 00:00:00"), (2, "http://S/a#q", page, "2024-01-01 01:00:00"), (3, "http://s/c", "<p>z", "2024-01-01 02:00:00"), (4, None, page, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, t string").selectExpr("page_id", "url", "html", "cast(t as timestamp) as fetched_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = st.read_pages(spark, str(tmp_path / "in"))
    assert rows(run(st.edges(st.fresh(stream)), "append", "stream_edges", spark)) == [("http://s/a", "http://s/b")]
    counts = run(st.term_counts(stream), "complete", "stream_terms", spark)
    assert rows(counts, "term", "url", "n") == [("x", "http://s/a", 4), ("y", "http://s/a", 2), ("z", "http://s/c", 1)]


def test_late_events_are_dropped(spark, rows, tmp_path):
    def put(k, *events):
        df = spark.createDataFrame([("UrlProcessed", t) for t in events], "status string, t string").selectExpr("status", "cast(t as timestamp) as reported_at")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(0.05)

    put(0, "2024-01-01 00:10:00", "2024-01-01 00:20:00")
    put(1, "2024-01-01 05:00:00")
    put(2, "2024-01-01 05:30:00")  # a watermark holds for late rows from the batch after the next
    put(3, "2024-01-01 00:30:00", "2024-01-01 09:00:00")
    put(4, "2024-01-01 09:30:00")
    for k, f in enumerate(sorted(tmp_path.glob("events/*.parquet"), key=lambda p: p.stat().st_mtime_ns)):
        os.utime(f, (time.time() + k, time.time() + k))
    stream = spark.readStream.schema("status string, reported_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = rows(run(st.events_by_window(stream), "append", "stream_events", spark), "start", "events")
    assert [n for _, n in got] == [2, 2]


def test_all_events_are_given(spark):
    from linkloom.plans import catalog

    d = "/root/testdata/sf0.001"
    got = {(r["start"], r["status"]): r["events"] for r in catalog.stream_events(spark, d).collect()}
    batch = st.events_by_window(spark.read.parquet(f"{d}/report.parquet"))
    assert got == {(r["start"], r["status"]): r["events"] for r in batch.collect()}
