"""Ledgers, snapshots and streaming jobs on small fixtures."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from drawloom.operators import prospective
from drawloom.session import scratch
from drawloom.sources import files, pages, sinks, snapshot
from drawloom.sources.ledger import Ledger
from drawloom.streaming import jobs

DAY = date(2020, 1, 6)


def test_append_is_idempotent_and_refuses_changes(spark):
    path = scratch(spark, "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sinks.append_keyed(rows, path, ["k"], ["v"]).isEmpty()
    assert sinks.append_keyed(rows, path, ["k"], ["v"]).isEmpty()
    assert spark.read.parquet(path).count() == 2
    more = spark.createDataFrame([("a", 9), ("c", 3), ("c", 3), ("d", 4), ("d", 5)], "k string, v int")
    rejects = {r["k"]: r["reject"] for r in sinks.append_keyed(more, path, ["k"], ["v"]).collect()}
    assert rejects == {"a": "changed_payload", "d": "differs_within_batch"}
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 2, "c": 3}


def test_fingerprint_ignores_order_and_sees_duplicates(spark):
    df = spark.range(100).withColumn("t", F.col("id") % 7)
    a = sinks.fingerprint(df).first()["digest"]
    assert a == sinks.fingerprint(df.repartition(5).orderBy(F.desc("id"))).first()["digest"]
    assert a != sinks.fingerprint(df.unionByName(df.filter("id = 3"))).first()["digest"]
    assert a != sinks.fingerprint(df.withColumn("t", F.col("t") + (F.col("id") == 50).cast("int"))).first()["digest"]


def test_snapshot_is_reused_verified_and_refused(spark):
    root = scratch(spark, "t")
    tables = {"draws": spark.range(10).toDF("n"), "rules": spark.range(2).toDF("r")}
    digest = sinks.write_snapshot(spark, root, tables)
    assert sinks.write_snapshot(spark, root, tables) == digest
    assert sinks.verify_snapshot(spark, root, digest).isEmpty()
    spark.range(11).toDF("n").write.mode("overwrite").parquet(f"{root}/{digest}/draws")
    assert [r["table"] for r in sinks.verify_snapshot(spark, root, digest).collect()] == ["draws"]
    with pytest.raises(ValueError, match="overlapping"):
        sinks.write_snapshot(spark, root, tables, ["overlapping_rules"])


def intact_tables(spark):
    draw = (DAY, [1, 2, 3, 4, 5, 6])
    return {
        "draws": spark.createDataFrame(
            [("g", "R1", DAY, draw[1], 7, "k1"), ("g", "R1", date(2020, 1, 8), [2, 3, 4, 5, 6, 7], None, "k2")],
            "game string, rule_code string, draw_date date, mains array<int>, bonus int, observation_key string",
        ),
        "missing_days": spark.createDataFrame([("g", date(2020, 1, 7))], "game string, day date"),
        "rules": spark.createDataFrame(
            [("g", "R1", date(2019, 1, 1), None, 47, True, "a0")],
            "game string, code string, starts_on date, ends_on date, pool int, verified boolean, artifact_sha256 string",
        ),
        "lineage": spark.createDataFrame(
            [("k1", *draw, "a1"), ("k2", date(2020, 1, 8), [7, 6, 5, 4, 3, 2], "a1")],
            "observation_key string, draw_date date, mains array<int>, artifact_sha256 string",
        ),
        "evidence": spark.createDataFrame([("a0",), ("a1",)], "artifact_sha256 string"),
    }


def test_damaged_files_are_found_and_refused(spark, tmp_path):
    root = str(tmp_path / "s")
    digest = sinks.write_snapshot(spark, root, intact_tables(spark))
    assert snapshot.violations(spark, root, digest).isEmpty()
    assert [r["gap_before"] for r in snapshot.load_population(spark, root, digest, "R1").orderBy("draw_date").collect()] == [False, True]
    home = tmp_path / "s" / digest
    (victim,) = list((home / "rules").glob("*.parquet"))[:1]
    body = victim.read_bytes()
    (home / "rules" / f".{victim.name}.crc").unlink(missing_ok=True)
    victim.write_bytes(body[:40] + bytes([body[40] ^ 1]) + body[41:])
    extra = home / "evidence" / "extra.parquet"
    extra.write_bytes(body)
    lost = next(p for p in (home / "lineage").glob("*.parquet"))
    lost.unlink()
    found = {(r["item"], r["reason"]) for r in sinks.verify_files(spark, root, digest).collect()}
    assert found == {(f"rules/{victim.name}", "hash_differs"), ("evidence/extra.parquet", "unlisted_file"), (f"lineage/{lost.name}", "missing_file")}
    with pytest.raises(ValueError, match="damaged"):
        snapshot.load_population(spark, root, digest, "R1")
    # A list rewritten to match the damage no longer has the published root.
    sinks.file_hashes(spark, str(home)).write.parquet(str(tmp_path / "forged"))
    spark.read.parquet(str(tmp_path / "forged")).write.mode("overwrite").parquet(str(home / "files"))
    assert [r["reason"] for r in sinks.verify_files(spark, root, digest).collect()] == ["list_differs"]


def test_draws_need_rule_lineage_and_evidence(spark):
    fine = intact_tables(spark)
    parts = [fine[t] for t in ("draws", "rules", "lineage", "evidence")]

    def faults(**changed):
        rows = snapshot.draw_violations(*[changed.get(t, fine[t]) for t in ("draws", "rules", "lineage", "evidence")]).collect()
        return sorted((r["item"][-2:], r["reason"]) for r in rows)

    assert snapshot.draw_violations(*parts).isEmpty()
    draws, rules, seen = parts[:3]
    assert faults(rules=rules.withColumn("verified", F.lit(None).cast("boolean"))) == [("06", "unverified_rule"), ("08", "unverified_rule")]
    assert faults(rules=rules.withColumn("starts_on", F.lit(date(2020, 1, 7)))) == [("06", "no_covering_rule")]
    assert faults(rules=rules.withColumn("pool", F.lit(6))) == [("06", "invalid_numbers"), ("08", "invalid_numbers")]
    assert faults(rules=rules.unionByName(rules)) == []
    assert faults(lineage=seen.filter("observation_key = 'k1'")) == [("08", "no_observation")]
    assert faults(lineage=seen.unionByName(seen.withColumn("draw_date", F.lit(DAY)))) == [("08", "observation_differs")]
    assert faults(evidence=fine["evidence"].filter("artifact_sha256 = 'a0'")) == [("06", "no_evidence"), ("08", "no_evidence")]
    assert faults(draws=draws.unionByName(draws.limit(1))) == [("06", "repeated_date"), ("06", "repeated_date")]
    assert faults(draws=draws.withColumn("observation_key", F.lit(None).cast("string"))) == [("06", "no_observation"), ("08", "no_observation")]
    assert faults(draws=draws.limit(0)) == []


def test_write_once(spark):
    path = scratch(spark, "t")
    assert sinks.write_once(spark.range(3), path) == "written"
    assert sinks.write_once(spark.range(3), path) == "unchanged"
    with pytest.raises(ValueError):
        sinks.write_once(spark.range(4), path)


def test_prospective_pass(spark):
    line = "game string, draw_date date, arm string, budget int, line_index int, mains array<int>"
    lines = spark.createDataFrame([("g", DAY, "a", 1, 0, [1, 2, 3, 4, 5, 6])], line)

    def results(status, evidence, mains):
        return spark.createDataFrame([("g", DAY, status, evidence, mains)], "game string, draw_date date, status string, evidence string, mains array<int>")

    none = spark.createDataFrame([], "game string, draw_date date, arm string, budget int, line_index int, evidence string, revision long, matched int")
    assert prospective.score_pass(lines, results("accepted", "e", [1]).limit(0), none).first()["action"] == "pending"
    assert prospective.score_pass(lines, results("quarantined", None, [1]), none).first()["action"] == "disputed"
    first = prospective.score_pass(lines, results("accepted", "e1", [1, 2, 3, 40, 41, 42]), none)
    assert (first.first()["action"], first.first()["matched"], first.first()["revision"]) == ("scored", 3, 1)
    ledger = prospective.evaluation_rows(first)
    assert prospective.score_pass(lines, results("accepted", "e1", [1, 2, 3, 40, 41, 42]), ledger).first()["action"] == "unchanged"
    second = prospective.score_pass(lines, results("accepted", "e2", [7, 8, 9, 40, 41, 42]), ledger)
    assert (second.first()["action"], second.first()["revision"], second.first()["matched"]) == ("revised", 2, 0)


def test_stream_scoring_repeats_nothing(spark):
    root = scratch(spark, "t")
    lines = spark.createDataFrame([("g", DAY, "a", 1, 0, [1, 2, 3, 4, 5, 6], datetime(2020, 1, 1))], "game string, draw_date date, arm string, budget int, line_index int, mains array<int>, issued_at timestamp")
    schema = "game string, draw_date date, status string, evidence string, mains array<int>, result_at timestamp"
    lines.write.parquet(root + "/lines")
    for evidence, mains in (("e1", [1, 2, 3, 9, 10, 11]), ("e1", [1, 2, 3, 9, 10, 11]), ("e2", [1, 2, 3, 4, 10, 11])):
        spark.createDataFrame([("g", DAY, "accepted", evidence, mains, datetime(2020, 1, 7))], schema).write.mode("append").parquet(root + "/results")
        jobs.score(jobs.file_stream(spark, root + "/lines", lines.schema), jobs.file_stream(spark, root + "/results", schema), root + "/ledger", root + "/cp")
    got = [(r["revision"], r["matched"]) for r in spark.read.parquet(root + "/ledger").orderBy("revision").collect()]
    assert got == [(1, 3), (2, 4)]


def test_blocked_and_plus_pages_are_rejected(spark):
    balls = '<ul class="balls">' + "".join(f"<li>{n}</li>" for n in range(1, 8)) + "</ul>"
    url = "https://www.irishlottery.com/results/irish-lotto-result-06-01-2020"
    rows = [
        (url, f"<title>ok</title><h1>Irish Lotto 6th January 2020</h1>{balls}"),
        (url, f"<title>Just a moment</title><h1>Irish Lotto 6th January 2020</h1>{balls}"),
        (url, f"<title>ok</title><h1>Irish Lotto Plus 6th January 2020</h1>{balls}"),
        (url, f"<title>ok</title><h1>Irish Lotto 6th January 2020</h1>{balls}{balls}"),
    ]
    got = [r["reject_reason"] for r in pages.detail_records(spark.createDataFrame(rows, "url string, html string").coalesce(1)).collect()]
    assert got == [None, "blocked_page", "unrecognised_page", "ambiguous_numbers"]


def test_csv_needs_its_columns(spark):
    path = scratch(spark, "t")
    spark.createDataFrame([("2020-01-06", "1")], "date string, n1 string").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="lacks columns"):
        files.draw_exports(spark, path)


def test_metric_table_drift_is_refused(spark):
    with pytest.raises(ValueError, match="changed"):
        files.wide_metrics(spark.createDataFrame([("2020", "1")], "Year string, Other string"), {"Sales": ("s", "count")})


def month_ledger(spark, path):
    return Ledger(spark, path, ["k", "day"], ["v"], F.date_format("day", "yyyy-MM"))


def test_ledger_reads_only_parts_that_may_hold_a_key(spark, tmp_path):
    path = str(tmp_path / "log")
    book = month_ledger(spark, path)
    rows = spark.range(600).select(F.concat(F.lit("k"), "id").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"), F.col("id").cast("int").alias("v"))
    assert book.append(rows).isEmpty()
    assert book.append(rows).isEmpty()
    assert spark.read.parquet(f"{path}/rows").count() == 600
    few = rows.filter("v in (1, 2)")
    placed = book._placed(few)
    read = book.rows(few, book._maybe_stored(placed))
    assert {f.split("part=")[1][:7] for f in read.inputFiles()} == {"2020-01"}
    assert len(book.rows(few).inputFiles()) > 15
    new = few.withColumn("k", F.concat(F.lit("other"), "v"))
    assert book._maybe_stored(book._placed(new)).count() <= 1  # a bit of 262,144 set by chance
    assert book.append(new).isEmpty()
    assert spark.read.parquet(f"{path}/rows").count() == 602


def test_ledger_equals_a_plain_dictionary_on_random_batches(spark, tmp_path):
    import random

    rng = random.Random(7)
    book, plain = month_ledger(spark, str(tmp_path / "log")), {}
    for _ in range(6):
        batch = [(rng.choice(["a", "b", None]), rng.choice([None, DAY, date(2020, 2, 1), date(2021, 3, 1)]), rng.choice([1, 1, 2, None])) for _ in range(rng.choice([0, 3, 9]))]
        got = {(r["k"], r["day"]): r["reject"] for r in book.append(spark.createDataFrame(batch, "k string, day date, v int")).collect()}
        want, seen = {}, {}
        for k, day, v in batch:
            seen.setdefault((k, day), set()).add(v)
        for key, values in seen.items():
            if len(values) > 1:
                want[key] = "differs_within_batch"
            elif key in plain and plain[key] not in values:
                want[key] = "changed_payload"
            else:
                plain.setdefault(key, *values)
        assert got == want
    like = spark.createDataFrame([], "k string, day date, v int")
    stored = book.rows(like).collect()
    assert {(r["k"], r["day"]): r["v"] for r in stored} == plain and len(stored) == len(plain)


def test_ledger_inserts_once_and_keeps_the_first(spark, tmp_path):
    book = month_ledger(spark, str(tmp_path / "log"))
    make = lambda *rows: spark.createDataFrame(rows, "k string, day date, v int")
    first = book.insert_once(make(("a", DAY, 5), ("a", DAY, 3), (None, None, 9)), F.col("v"))
    assert {(r["k"], r["v"], r["inserted"]) for r in first.collect()} == {("a", 3, True), (None, 9, True)}
    again = book.insert_once(make(("a", DAY, 1), (None, None, 1), ("b", DAY, 1)), F.col("v"))
    assert {(r["k"], r["v"], r["inserted"]) for r in again.collect()} == {("a", 3, False), (None, 9, False), ("b", 1, True)}
    with pytest.raises(ValueError, match="part"):
        book.append(make().withColumn("part", F.lit("x")))


def test_ledger_survives_a_writer_lost_after_its_bits(spark, tmp_path):
    import shutil

    path = str(tmp_path / "log")
    book = month_ledger(spark, path)
    rows = spark.createDataFrame([("a", DAY, 1), ("b", date(2020, 5, 5), 2)], "k string, day date, v int")
    book.append(rows)
    shutil.rmtree(f"{path}/rows/part=2020-05")  # its bits stay
    assert book.append(rows).isEmpty()
    assert spark.read.parquet(f"{path}/rows").count() == 2
