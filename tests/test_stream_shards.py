"""Many texts that share a state are told apart, as in the batch form."""

from pyspark.sql import functions as F

from recollect.operators.governance import dedup_window
from recollect.streaming.operators import dedup_stream
from tests.test_streaming import run, stream


def test_texts_of_one_shard(spark, tmp_path):
    at = [(i * 97) % 1500 for i in range(240)]
    rows = [(i, "uvw"[i % 3], ["hi", " hi ", "ho", "", "é"][i % 5], f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}") for i, s in enumerate(at)]
    schema = "id long, user_id string, text string, at string"
    df = stream(spark, tmp_path, [rows], schema).withColumn("ts", F.col("at").cast("timestamp"))
    got = {r["id"] for r in run(dedup_stream(df, shards=2), "shards", "append", spark).collect()}
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.col("at").cast("timestamp"))
    want = {r["id"] for r in dedup_window(batch, 300).collect() if r["accepted"]}
    assert got == want and 20 < len(got) < 120
