import datetime as dt

from vellum.streaming import live as L

FEED = "seq long, document_id string, library_id string, status string"


def write(spark, path, rows, schema=FEED):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_counts_follow_the_feed(spark, tmp_path):
    path, out = str(tmp_path / "feed"), []
    publish = lambda df, n: out.append({r.library_id: (r.indexed, r.processing) for r in df.collect()})
    write(spark, path, [(1, "d1", "l", "pending"), (2, "d2", "l", "indexed")])
    run = lambda: L.stream_counts(spark.readStream.schema(FEED).parquet(path), publish, str(tmp_path / "cp")).awaitTermination()
    run()
    write(spark, path, [(3, "d1", "l", "indexed"), (4, "d3", "m", "parsing")])
    run()
    assert out[-1] == {"l": (2, 0), "m": (0, 1)}
    assert {r.library_id: (r.indexed, r.processing) for r in L.live_counts(spark.read.parquet(path)).collect()} == out[-1]


def test_ingest_queue_handles_each_file_once(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    handle = lambda df, n: seen.extend(sorted(r.document_id for r in df.collect()))
    for rows in ([(1, "a", "l", "x")], [(2, "b", "l", "x"), (3, "c", "l", "x")]):
        write(spark, path, rows)
        L.stream_ingest(spark.readStream.schema(FEED).parquet(path), handle, str(tmp_path / "cp")).awaitTermination()
    assert seen == ["a", "b", "c"]


def test_debounce(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("u", at(0), "a"), ("u", at(200), "ab"), ("u", at(450), "abc"), ("u", at(900), "d"), ("v", at(100), "x")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, q string")
    assert sorted((r.k, r.q) for r in L.debounced(df, "k", "ts", "q").collect()) == [("u", "abc"), ("u", "d"), ("v", "x")]
    path = str(tmp_path / "ev")
    df.coalesce(1).write.parquet(path)
    stream = L.debounced_stream(spark.readStream.schema(df.schema).parquet(path), "k", "ts", "q")
    stream.writeStream.format("memory").queryName("debounced").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.q) for r in spark.table("debounced").collect()) == [("u", "abc"), ("u", "d"), ("v", "x")]


def test_edges(spark):
    df = spark.createDataFrame([("l", 1, 2, 0), ("l", 2, 0, 1), ("l", 3, 0, 1), ("m", 1, 1, 0), ("m", 2, 0, 0)], "k string, t int, p long, i long")
    got = [(r.k, r.t, r.all_indexed, r.redirect) for r in L.edges(df, "k", "t", "p", "i").orderBy("k", "t").collect()]
    assert got == [("l", 1, False, False), ("l", 2, True, True), ("l", 3, False, False), ("m", 1, False, False), ("m", 2, True, False)]
