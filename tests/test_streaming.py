"""Streams give what the batch forms give, where time does not part them."""

from pyspark.sql import functions as F

from recollect.streaming.operators import access_counts, access_sessions, dedup_stream, rule_stream, strength_stream


def run(df, name, mode, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/in")


def logs(spark, tmp_path):
    rows = [[(i % 4, i % 2, "get" if i % 3 else "search", f"2024-01-01 {h:02d}:{m:02d}:00") for i, (h, m) in enumerate((h, m) for h in range(6) for m in (0, 10, 50))]]
    df = stream(spark, tmp_path, rows, "memory_id long, app_id long, access_type string, at string")
    return df.withColumn("accessed_at", F.col("at").cast("timestamp")).drop("at"), rows[0]


def test_dedup(spark, tmp_path):
    rows = [[(1, "u", "hi", "2024-01-01 00:00:00"), (2, "u", " hi ", "2024-01-01 00:01:00"), (3, "v", "hi", "2024-01-01 00:01:00"), (4, "u", "other", "2024-01-01 00:02:00")]]
    df = stream(spark, tmp_path, rows, "id long, user_id string, text string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    got = {r["id"] for r in run(dedup_stream(df), "dedup", "append", spark).collect()}
    assert got == {1, 3, 4}


def test_dedup_waits_from_the_accepted_row(spark, tmp_path):
    """As the batch form: a repeat at exactly the wait is one, a second later it counts again, and repeats in between don't prolong the wait."""
    from recollect.operators.governance import dedup_window

    at = [0, 200, 300, 301, 500, 601, 602, 1300]
    rows = [(i, "u", "hi", f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}") for i, s in enumerate(at)]
    df = stream(spark, tmp_path, [rows], "id long, user_id string, text string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    got = {r["id"] for r in run(dedup_stream(df), "waits", "append", spark).collect()}
    batch = spark.createDataFrame(rows, "id long, user_id string, text string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    assert got == {0, 3, 6, 7} == {r["id"] for r in dedup_window(batch, 300).collect() if r["accepted"]}


def test_counts_and_sessions(spark, tmp_path):
    df, rows = logs(spark, tmp_path)
    got = run(access_counts(df), "counts", "complete", spark).collect()
    assert sum(r["n"] for r in got) == len(rows) and len({r["start"] for r in got}) == 6
    slide = run(access_counts(df, "2 hours", "1 hour"), "slide", "complete", spark).collect()
    assert sum(r["n"] for r in slide) == 2 * len(rows)
    s = run(access_sessions(df), "sessions", "complete", spark).collect()
    assert sum(r["n"] for r in s) == len(rows) and len(s) > 2


def test_state(spark, tmp_path):
    df, rows = logs(spark, tmp_path)
    got = {r["memory_id"]: r for r in run(strength_stream(df, 0.1).withColumn("x", F.lit(1)), "strength", "update", spark).collect()}
    assert {k: r["access_count"] for k, r in got.items()} == {k: sum(r[0] == k for r in rows) for k in range(4)}
    for k, r in got.items():
        at = sorted(int(x[3][11:13]) * 60 + int(x[3][14:16]) for x in rows if x[0] == k)
        least = min(0.5 ** ((b - a) / 144) for a, b in zip(at, at[1:]))
        assert abs(r["least"] - least) < 1e-6 and r["least"] < 0.9 and r["strength"] == 1.0


def test_rules(spark, tmp_path):
    rows = [[(1, i, ok) for i, ok in enumerate([False, False, False, True, True, True, True])]]
    df = stream(spark, tmp_path, rows, "rule_id long, seq long, helpful boolean")
    r = run(rule_stream(df), "rules", "update", spark).collect()[-1]
    assert (r["helpful_count"], r["harmful_count"], r["deprecated"]) == (4, 3, True)
