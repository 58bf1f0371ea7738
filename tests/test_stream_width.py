"""The reconciliation stream keeps as much state as there are draws, and its log reads the items once."""

import os

from drawloom.plans.catalog.canonical import replayed_log
from drawloom.session import scratch
from drawloom.streaming import jobs


def test_state_partitions_follow_the_draws(spark):
    assert [jobs.state_width(spark, n) for n in (0, 100, 101, 10_000)] == [1, 1, 2, 4]  # the session's width is 4
    root = scratch(spark, "width")
    rows = spark.sql("SELECT 'F' AS game, DATE'2020-01-06' AS draw_date, k AS arrival_seq, array(1, 2, 3, 4, 5, 6) AS mains, 7 AS bonus FROM VALUES (1), (2) t(k)")
    for part in ("arrival_seq = 1", "arrival_seq = 2"):
        rows.filter(part).write.mode("append").parquet(f"{root}/in")
        jobs.run_append(jobs.reconcile(jobs.file_stream(spark, f"{root}/in", rows.schema)), f"{root}/checkpoint", f"{root}/out", 1)
    assert sorted((r.arrival_seq, r.outcome) for r in spark.read.parquet(f"{root}/out").collect()) == [(1, "accepted"), (2, "corroborated")]
    kept = os.listdir(f"{root.removeprefix('file:')}/checkpoint/state/0")
    assert [k for k in kept if k.isdigit()] == ["0"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_the_log_reads_the_items_once(spark, sf_dir):
    for part in replayed_log(spark, sf_dir):
        assert not [f for f in part.inputFiles() if "lineitem" in f]
