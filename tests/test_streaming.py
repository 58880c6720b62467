from pyspark.sql import types as T

from marlstone.sources.csv_io import write_csv
from marlstone.streaming.ingest import csv_stream, stream_to_store, windowed_counts


def test_each_file_once(spark, tmp_path):
    schema = T.StructType.fromDDL("a int, s string")
    write_csv(spark.createDataFrame([(1, ""), (2, "x")], schema), str(tmp_path / "in"))
    for _ in range(2):
        stream_to_store(csv_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, ""), (2, "x")]


def test_windowed_counts(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:01' AS ts, 'a' AS k UNION ALL SELECT TIMESTAMP'2024-01-01 00:00:09', 'a' UNION ALL SELECT TIMESTAMP'2024-01-01 01:00:00', 'b'")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "10 seconds", "1 minute", ["k"])
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]
