from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ordina import Aggregate
from ordina.streaming.rows import aggregate_windows, filter_rows, with_each


def test_stream_equals_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at + timedelta(minutes=i), i % 3, float(i) if i % 5 else None) for i in range(100)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))

    def work(df):
        df = with_each(filter_rows(df, lambda r: r["v"] > 3), "twice", lambda r: r["v"] * 2)
        return aggregate_windows(df, "ts", "30 minutes", "1 hour", "k", [("twice", [Aggregate.SUM, Aggregate.MAXIMUM])])

    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = work(stream).writeStream.format("memory").queryName("made").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    order = lambda df: [tuple(r) for r in df.orderBy("start", "k").collect()]
    assert order(spark.table("made")) == order(work(batch)) and spark.table("made").agg(F.count("*")).first()[0] > 8
    with pytest.raises(TypeError):
        aggregate_windows(batch, "ts", "1 hour", "1 hour", "k", [("v", [Aggregate.FIRST])])
