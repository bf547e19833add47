"""Windowed features on a stream against the batch form."""

import math

from pyspark.sql import functions as F

from brackwater.operators import features
from brackwater.sources import generators
from brackwater.streaming import features as live


def test_stream_equals_batch(spark, tmp_path):
    cells = ["entity", *live.FIELDS]
    events = generators.security_events(spark, 1500)
    have = set(events.columns)
    events = events.select(*[F.col(c) if c in have else F.lit(None).cast(live.FIELDS.get(c, "string")).alias(c) for c in cells]).unionByName(
        events.limit(1).select(*[F.lit("u0").alias(c) if c == "entity" else F.lit(None).cast(live.FIELDS[c]).alias(c) if c not in ("us", "seq") else F.col(c) for c in cells]).withColumn("us", F.col("us") + F.lit(10**9))
    )
    events = events.selectExpr(*[f"CAST({c} AS {live.FIELDS.get(c, 'string')}) AS {c}" for c in cells]).cache()
    lo, hi = events.agg(F.min("us"), F.max("us")).first()
    for i in range(6):  # a file a batch, in time
        a, b = lo + (hi - lo) * i // 6, lo + (hi - lo) * (i + 1) // 6 + (i == 5)
        events.filter((F.col("us") >= a) & (F.col("us") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_micros("us"))
    out = live.feature_stream(stream, lo, delay="0 seconds")
    q = out.writeStream.format("memory").queryName("features").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.entity, r.win): r for r in spark.table("features").collect()}
    want = {(r.entity, r.win): r for r in features.window_features(events).collect()}
    last = max(w for _, w in want)
    closed = {k for k in want if k[1] < last}  # the watermark is in milliseconds, and the last window ends at the last event
    assert closed <= set(got) <= set(want) and len(closed) > 20
    for k in got:
        assert (got[k].win_start, got[k].event_count) == (want[k].win_start, want[k].event_count)
        for f in features.FEATURES:
            assert math.isclose(got[k][f], want[k][f], rel_tol=1e-9, abs_tol=1e-9), (k, f)
    state = q.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= events.select("entity").distinct().count()
