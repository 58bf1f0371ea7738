"""Decontamination against a plain search of all windows."""

import hashlib
import random
import re

from drawloom.llm import winnowing as wn
from drawloom.llm.catalog import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, n_words int, mark string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in wn.decontaminate(d, b).collect()), key=repr)


def test_equals_all_windows(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "a", "Ünit", "été", "x1", "7", "and", "to"]
    items = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 12, 13, 14, 30])))) for k in range(25)]
    items = [(k, t) for k, t in items if len(words(t)) != 1] + [(3, items[3][1]), (None, "the of a and to"), (99, None)]
    docs = []
    for k in range(120):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))]
        if k % 2:
            w = re.split(r"[ ,\n]+", rng.choice(items[:24])[1] or "")
            parts += [" ".join(w[rng.randint(0, 3) :]).upper(), "tail é"]
        docs.append((k, "! ".join(parts)))
    docs += [(1, docs[1][1]), (None, docs[3][1]), (500, None), (501, ""), (502, "?!"), (503, "word " * 20_000 + (items[5][1] or ""))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, [])]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()
    truth = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n) for d, n, h, i in brute(docs, items)]
    got = QUERIES["op3_benchmark_decontamination"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(truth) and any(t[2] for t in truth)
