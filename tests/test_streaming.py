import os
import time

from pyspark.sql import functions as F

from revsift.operators import hours as hr
from revsift.streaming import jobs
from tests.conftest import rows


def test_availability_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "req")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    req = ev.select("event_id", F.col("user_id").alias("business_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                    (F.lit(1) + F.pmod("event_id", F.lit(8))).cast("int").alias("pax"))
    req.filter("event_id < 500").write.parquet(src + "/part1")
    req.filter("event_id >= 500").write.parquet(src + "/part2")
    hours = spark.createDataFrame([(i, {"Monday": "8:30-20:0", "Tuesday": None, "Friday": "0:0-23:0"})
                                   for i in range(150)], "business_id long, hours map<string,string>")
    hrows = hr.parse_hours(hours)
    out = str(tmp_path / "out")
    q = jobs.availability_stream(spark, src + "/*", hrows, out, name=f"avail-{time.time_ns()}")
    q.awaitTermination(120)
    streamed = rows(spark.read.parquet(out), "event_id", "ok")
    batch = rows(hr.check_availability(req, hrows), "event_id", "ok")
    assert streamed == batch and len(streamed) == req.count()


def test_collect_log_stream_last_value_wins(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "a.log").write_text("[COLLECT] n_docs=10 \nnoise\n[COLLECT] mrr=0.5 \n")
    os.utime(d / "a.log", (1_000_000, 1_000_000))
    (d / "b.log").write_text("[COLLECT] mrr=0.75 \n")
    os.utime(d / "b.log", (2_000_000, 2_000_000))
    seen = {}

    def sink(batch, epoch):
        for r in batch.collect():
            seen[r.key] = r.value
    q = jobs.collect_log_stream(spark, str(d), sink, name=f"log-{time.time_ns()}")
    q.awaitTermination(120)
    assert seen == {"n_docs": 10.0, "mrr": 0.75}


def test_collect_log_stream_restarts_from_its_checkpoint(spark, tmp_path):
    d = tmp_path / "logs2"
    d.mkdir()
    (d / "a.log").write_text("[COLLECT] n_docs=10 \n[COLLECT] mrr=0.5 \n")
    os.utime(d / "a.log", (1_000_000, 1_000_000))
    name = f"log-restart-{time.time_ns()}"
    batches = []

    def sink(batch, epoch):
        batches.append({r.key: r.value for r in batch.collect()})
    jobs.collect_log_stream(spark, str(d), sink, name=name).awaitTermination(120)
    assert batches[-1] == {"n_docs": 10.0, "mrr": 0.5}
    # a new file arrives; the restarted query reads only it and updates only mrr
    (d / "b.log").write_text("[COLLECT] mrr=0.75 \n")
    os.utime(d / "b.log", (2_000_000, 2_000_000))
    jobs.collect_log_stream(spark, str(d), sink, name=name).awaitTermination(120)
    assert batches[-1] == {"mrr": 0.75}


def test_availability_stream_in_several_micro_batches(spark, tmp_path):
    src = str(tmp_path / "req")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    req = ev.select("event_id", F.col("user_id").alias("business_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                    (F.lit(1) + F.pmod("event_id", F.lit(8))).cast("int").alias("pax"))
    for i in range(3):
        req.filter(F.pmod("event_id", F.lit(3)) == i).coalesce(1).write.parquet(f"{src}/p{i}")
    hours = spark.createDataFrame([(i, {"Monday": "8:30-20:0", "Friday": "0:0-23:0"}) for i in range(150)],
                                  "business_id long, hours map<string,string>")
    hrows = hr.parse_hours(hours)
    out = str(tmp_path / "out")
    q = jobs.availability_stream(spark, src + "/*", hrows, out, name=f"avail-mb-{time.time_ns()}",
                                 max_files_per_trigger=1)
    q.awaitTermination(180)
    assert q.lastProgress is not None
    assert rows(spark.read.parquet(out), "event_id", "ok") == rows(hr.check_availability(req, hrows), "event_id", "ok")
