"""Evidence bodies and manifests in files whose number does not grow with the pages."""

import os

from drawloom.plans.catalog import sources
from drawloom.sources import files


def pages(spark, tmp_path, n):
    rows = [(k, None if k == 5 else f"https://h.example/{k}", None if k == 4 else f"<p>{k % 50}</p>\n") for k in range(n)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/in{n}/pages.parquet")
    return f"{tmp_path}/in{n}"


def written(root):
    return sum(len(names) for _, _, names in os.walk(root.removeprefix("file:")))


def test_files_do_not_grow_with_the_pages(spark, tmp_path):
    few, many = (sources.evidence(spark, pages(spark, tmp_path, n)) for n in (40, 400))
    assert written(many) <= max(40, written(few))
    assert spark.read.parquet(f"{many}/bodies").count() == 400


def test_every_page_is_checked_once(spark, tmp_path):
    d = pages(spark, tmp_path, 250)
    got = sorted(((r.url, r.body_ok) for r in sources.evidence_check(spark, d).collect()), key=str)
    truth = [(None if k == 5 else f"https://h.example/{k}", k % 9 != 0 and k % 11 != 0 and k % 7 != 0) for k in range(250)]
    assert got == sorted(truth, key=str)
    listed = {r.status: (r.artifacts, r.positions) for r in sources.artifact_manifest(spark, d).collect()}
    assert listed == {"blocked": (36, 98), "valid": (214, 99)}


def test_damaged_and_lost_bodies_do_not_pass(spark):
    bodies = spark.createDataFrame([("a", b"x"), ("a", b"x"), ("b", b"x"), ("b", b"y")], "body_path string, content binary")
    sha = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"  # of x
    listed = spark.createDataFrame([(p, sha, "valid") for p in "abc"], "body_path string, sha256 string, status string")
    checked = files.check_evidence(listed, files.bundled_bodies(bodies)).collect()
    assert sorted((r.body_path, r.body_ok) for r in checked) == [("a", True), ("b", False), ("c", False)]
