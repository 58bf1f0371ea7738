"""Runs, Lyndon arrays and digests against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from drawloom.llm import periodic_runs as pr
from drawloom.llm.catalog import QUERIES
from drawloom.llm.common import table


def brute_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length, part = j - i + p, w[i : j + p]
            if j > i and length >= max(12, 2 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if plant and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None,) * 3
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def sequences(rng, count, most):
    for _ in range(count):
        n, size = rng.randint(0, most), rng.randint(1, 4)
        w = [rng.randrange(size) for _ in range(n)]
        if rng.random() < 0.4 and n > 4:
            unit = w[: rng.randint(1, n // 2)]
            w = (unit * n)[:n]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(n)] = rng.randrange(size)
        yield w, size


def test_lyndon_arrays_under_both_orders():
    for w, size in sequences(random.Random(3), 1500, 30):
        assert pr.lyndon_array(w, size) == brute_lyndon(w)
        flipped = [size - 1 - c for c in w]
        assert pr.lyndon_array(flipped, size) == brute_lyndon(flipped)


def test_runs_equal_brute_force():
    found = 0
    for w, _ in sequences(random.Random(4), 2500, 48):
        truth = brute_runs(w)
        assert pr.text_runs([b"w%d" % c for c in w]) == truth
        found += len(truth)
    assert found > 1000


@pytest.mark.parametrize("word", ["a", "ab", "aab", "abaab"])
def test_very_long_texts_are_one_run(word):
    n = 60_000
    letters = (list(word) * n)[:n]
    assert pr.runs_of(np.array([ord(c) for c in letters])) == [(0, n, len(word))]


def test_rows_and_edges(spark):
    rng = random.Random(7)
    docs = [(k, " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 60)))) for k in range(200)]
    docs += [(500, None), (501, ""), (502, " \t\n\x0b\f\r "), (503, "x x " * 40), (503, "x x " * 40), (None, "a b " * 20), (504, "\x1c \x1c " * 9)]
    frame = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, n_runs string, start int").repartition(3)
    got = sorted((tuple(r)[:8] for r in pr.detect(frame, plant=True).collect()), key=repr)
    assert got == sorted((brute_row(d, t) for d, t in docs), key=repr)
    plain = sorted((tuple(r)[:8] for r in pr.detect(frame).collect()), key=repr)
    assert plain == sorted((brute_row(d, t, False) for d, t in docs), key=repr)
    rows = sorted((r.doc_id, r.start, r.length, r.period) for r in pr.run_rows(frame).filter("doc_id is not null").collect())
    assert rows == sorted((d, *r) for d, t in docs if d is not None for r in brute_runs([w for w in (t or "").encode().split()]))
    assert pr.detect(frame.limit(0)).count() == 0


def test_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    short = [d for d in docs if len((d.text or "").split()) < 400]
    got = {r.doc_id: tuple(r)[:8] for r in QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[d.doc_id] == brute_row(d.doc_id, d.text) for d in short)
    assert sum(r[1] > 0 for r in got.values()) >= len(docs) // 20
