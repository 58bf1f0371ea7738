"""Exports with mixed headers and bad values, late arrivals in the stream, refused models, the shared folder."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from drawloom import session
from drawloom.operators import learn
from drawloom.sources import files
from drawloom.streaming import jobs

HEADER = "date,n1,n2,n3,n4,n5,n6,bonus,jackpot,currency,jackpotWinners\n"


def exports(spark, tmp_path, **bodies):
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_text(body)
    rows = files.draw_exports(spark, str(tmp_path / "*.csv")).collect()
    out = {}
    for r in rows:
        out.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append(r)
    return out


def test_each_file_has_its_own_header(spark, tmp_path):
    got = exports(
        spark, tmp_path,
        a=HEADER + "2020-01-06,1,2,3,4,5,6,7,100.50,EUR,0\n",
        b='﻿n6,n5,n4,n3,n2,n1,date,jackpot,bonus\n6,5,4,3,2,1,2020-01-08,"9.00",25\n',
    )
    (a,), (b,) = got["a"], got["b"]
    assert (a.mains, a.bonus, str(a.jackpot), a.outcome, a.reject) == ([1, 2, 3, 4, 5, 6], 7, "100.50", "Roll", None)
    assert (b.mains, b.bonus, str(b.jackpot), b.outcome, b.reject) == ([1, 2, 3, 4, 5, 6], 25, "9.00", None, None)


def test_a_file_of_zero_bytes_is_rejected(spark, tmp_path):
    got = exports(spark, tmp_path, good=HEADER + "2020-01-06,1,2,3,4,5,6,7,1,EUR,0\n", zero="")
    assert {k: [r.reject for r in v] for k, v in got.items()} == {"good": [None], "zero": ["bad_file"]}


def test_a_bad_row_rejects_its_file(spark, tmp_path):
    good = "2020-01-06,1,2,3,4,5,6,7,1,EUR,0\n"
    got = exports(
        spark, tmp_path,
        good=HEADER + good, amount=HEADER + good + "2020-01-08,1,2,3,4,5,6,7,abc,EUR,0\n", mains=HEADER + good + "2020-01-08,1,1,1,1,99,200,7,1,EUR,0\n",
        empty=HEADER, header="day,n1\n1,2\n", short=HEADER + good + "2020-01-08,1,2\n", day=HEADER + "2020-13-08,1,2,3,4,5,6,7,1,EUR,0\n",
    )
    assert set(got) == {"good", "amount", "mains", "empty", "header", "short", "day"}
    assert {name for name, rows in got.items() if all(r.reject is None for r in rows)} == {"good"}
    assert all(r.reject is not None for name, rows in got.items() if name != "good" for r in rows)


def test_late_new_keys_are_kept_and_changes_rejected(spark, tmp_path):
    rows = spark.createDataFrame([("c", "2020-03-01", 3)], "k string, day string, v int")
    run = lambda: jobs.ingest(jobs.file_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/log", f"{tmp_path}/cp", ["k"], ["v"])
    rows.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    late = spark.createDataFrame([("a", "2019-12-01", 1), ("c", "2020-03-01", 3), ("c", "2020-03-01", 4)], rows.schema)
    late.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [("a", 1), ("c", 3)]
    assert [r.k for r in spark.read.parquet(f"{tmp_path}/log_rejects").collect()] == ["c"]


def test_models_that_may_not_be_fitted_are_refused(spark):
    rows = [(m, float(x), y) for m, ys in (("both", (0, 1, 0, 1)), ("one", (1, 1, 1, 1)), ("nan", (0, 1, 0, 1))) for x, y in zip((1, 2, 4, 3), ys)]
    df = spark.createDataFrame(rows, "m string, x double, hit int").withColumn("x", F.when((F.col("m") == "nan") & (F.col("x") == 4), float("nan")).otherwise(F.col("x")))
    models = learn.fit_logistic(df, ["m"], ["x"])
    got = {r.m: (r.refused, r.converged, r.beta is None) for r in models.collect()}
    assert got == {"both": (None, True, False), "one": ("one_class", None, True), "nan": ("not_finite", None, True)}
    assert {r.m: r.probability is None for r in learn.predict_logistic(df, models, ["m"], ["x"]).collect()} == {"both": False, "one": True, "nan": True}


def test_grid_of_settings():
    got = learn.grid()
    assert len(got) == 4 + 6 + 4 + 4 and {f for f, _ in got} == set(learn.SEARCH_SPACE)
    assert {(p["max_leaf_nodes"], p["learning_rate"]) for f, p in got if f == "boosting"} == {(a, b) for a in (3, 7, 15) for b in (0.03, 0.1)}


def test_a_cluster_must_name_the_shared_folder():
    class Other:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Other)
    assert SparkSession.getActiveSession() is None or session.shared_root(SparkSession.getActiveSession())


def test_scheduled_is_read_from_the_payload_itself(spark):
    from drawloom.operators.validate import check_curated

    bodies = ['{"day":"2020-01-01","scheduled":true,"description":"x","game":"F"}', '{"day":"2020-01-01","scheduled":"true","description":"x","game":"F"}', '{"day":"2020-01-01","nested":{"scheduled":true},"description":"x","game":"F"}']
    rows = spark.createDataFrame([("calendar_events", str(k), None, b) for k, b in enumerate(bodies)], "dataset string, record_key string, published_at string, payload string")
    got = {r.record_key: "scheduled_not_boolean" in r.reasons for r in check_curated(rows).collect()}
    assert got == {"0": False, "1": True, "2": True}


def test_a_folder_name_may_come_again_below(spark):
    paths = spark.createDataFrame([("file:/a/bodies/x/bodies/f",), ("hdfs://h:1/a/bodies/g",), ("viewfs://s/in/bodies/h",)], "p string")
    assert [r.f for r in paths.select(files.below(F.col("p"), "file:///a/bodies").alias("f")).collect()] == ["x/bodies/f", "g", "h"]
