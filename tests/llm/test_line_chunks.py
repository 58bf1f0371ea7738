"""Line dedup against a plain search for repeated runs of lines that knows no chunks or hashes."""

import random

from drawloom.llm import line_chunks as lc
from drawloom.llm.catalog import QUERIES


def order(doc):
    return 2**63 if doc is None else doc


def brute(docs):
    """Texts without the lines of runs (two lines with text or more, or one of 50 words) that stand earlier too."""
    texts = sorted({(order(d), t or "") for d, t in docs})
    seen, left = {}, {}
    for doc, text in texts:
        lines = text.split("\n")
        full = [k for k, line in enumerate(lines) if line.split()]
        gone = set()
        for j, a in enumerate(full):
            own = [(a, a, j)] if len(lines[a].split()) >= 50 else []
            for first, last, k in own + ([(a, full[j + 1], j + 1)] if j + 1 < len(full) else []):
                run = tuple(lines[first : last + 1])
                if run in seen:
                    gone |= {j, k}
                seen.setdefault(run, (doc, first))
        drop = {x for j in gone for x in range(full[j] if j else 0, full[j + 1] if j + 1 < len(full) else len(lines))}
        left[doc, text] = "\n".join(line for k, line in enumerate(lines) if k not in drop), len(drop)
    return [(d, None if t is None else left[order(d), t][0], left[order(d), t or ""][1]) for d, t in docs]


def run(spark, docs):
    return lc.dedup_lines(spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, hash string").repartition(3))


def check(spark, docs):
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in run(spark, docs).collect()), key=repr)
    assert got == sorted(brute(docs), key=repr)
    return got


def words(rng, n):
    return " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n))


def test_passages_over_several_lines_go(spark):
    """A passage of short lines in two texts that differ otherwise is left in the first one only, to its last line."""
    rng, docs, shared = random.Random(4), [], []
    for k, (n, size) in enumerate([(2, 30), (3, 20), (4, 15), (6, 12), (10, 12), (20, 12)] * 5):
        passage = [words(rng, size) for _ in range(n)]
        shared.append(passage)
        for side in (0, 1):
            docs.append((2 * k + side, "\n".join([*(words(rng, 12) for _ in range(9)), *passage, *(words(rng, 12) for _ in range(9))])))
    got = {d: (t, n) for d, t, n in check(spark, docs)}
    for k, passage in enumerate(shared):
        assert "\n".join(passage) in got[2 * k][0] and got[2 * k][1] == 0
        assert got[2 * k + 1][1] == len(passage) and not any(line in got[2 * k + 1][0] for line in passage)


def test_equals_plain_search(spark):
    rng = random.Random(9)
    pool = [words(rng, rng.randint(1, 9)) for _ in range(60)] + ["", " ", "\t", "\r", words(rng, 55)]
    tabs = "\t".join(f"t{k}" for k in range(50))
    shared = [rng.choice(pool) for _ in range(8)]
    docs = []
    for k in range(150):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(lines))
        lines[at:at] = shared if k % 3 == 0 else [tabs] if k % 5 == 0 else []
        docs.append((k, "\n".join(lines)))
    docs += [(7000, None), (7001, ""), (7002, "\n\n\n"), (7003, "a\nb\n" * 3000), (7004, "q\nq\nq"), (7005, "\n\nq\nq\n\n"), (None, docs[3][1]), (9, docs[9][1])]
    got = check(spark, docs)
    assert sum("t3\tt4" in (t or "") for _, t, _ in got) == 1
    assert ("", 6) in {(t, n) for d, t, n in got if d == 7005} and run(spark, []).count() == 0


def test_chunks_survive_shifts(spark):
    from pyspark.sql import functions as F

    body = [f"line {k} of the body" for k in range(60)]
    df = spark.createDataFrame([("\n".join(body),), ("\n".join(["new first line", *body]),)], "text string")
    ends = [{c.seam.at for c in r.c if c.seam} for r in df.select(lc.chunks(lc.lines_of(F.col("text"))).alias("c")).collect()]
    a, b = sorted(ends, key=min)
    assert len(a) > 8 and min(len(a - {e - 1 for e in b}), len(b - {e - 1 for e in a})) <= 2


def test_repeated_rows_and_clashing_names(spark):
    text = "one two\nthree four\nfive six\nseven eight\nnine ten"
    df = spark.createDataFrame([(1, text, 5, "a", 6, 7), (1, text, 5, "a", 6, 7), (2, text, 5, "a", 6, 7)], "doc_id long, text string, n_lines int, _id string, _k1 int, gone int")
    rows = lc.dedup_lines(df)
    assert rows.columns == ["doc_id", "text", "n_lines", "_id", "_k1", "gone", "n_lines_", "n_removed", "n_chunks"]
    got = sorted(map(tuple, rows.collect()))
    assert got == [(1, text, 5, "a", 6, 7, 5, 0, 0)] * 2 + [(2, "", 5, "a", 6, 7, 5, 5, 1)]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.text, r.n_removed) for r in QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: (t, n) for d, t, n in brute([(d.doc_id, d.text) for d in docs])}
